"""Dates by their shape equal the definition, layout by layout."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from salescope.functions import cleaning

PIECES = ["1", "2", "02", "12", "13", "29", "30", "31", "32", "0", "00", "68", "69", "99", "2020", "1999", "0000", "20200131", "123", "12345",
          "Jan", "feb", "SEPT", "Sep", "september", "May", "x", "T", "t", "23", "24", "59", "60", "07"]
SEPARATORS = ["/", "-", " ", ":", ", ", ",", ".", ""]


def _cells():
    rng = random.Random(11)
    out = [None, "", " ", "garbage", "1/2/3", "12:30", "2020-02-30", "2020-1-2", "31/31/2020", "1/2/2020 5:07 ", " 1/2/2020",
           "2020-01-02T03:04:05", "2020-01-02t03:04:05", "2020-01-02 03:04:60", "1/2/2020 24:00", "12 May 2020", "5-may-1999", "May 5, 2020",
           "Sept 5, 2020", "September 5, 2020", "5-September-2020", "19991231", "19991331", "12-31-68", "12-31-69", "31/12/70", "2020/13/1", "+2020-01-02"]
    layouts = ["{m}/{d}/{y}", "{d}/{m}/{y}", "{d}-{m}-{y}", "{m}/{d}/{y} 7:05", "{d}/{m}/{y} 17:05:09", "{y}/{m}/{d}", "{m}-{d}-20", "{d}/{m}/85"]
    for _ in range(1500):
        out.append(rng.choice(layouts).format(m=rng.randint(0, 14), d=rng.randint(0, 33), y=rng.choice([1999, 2000, 2024, 2100])))
    for _ in range(1500):
        out.append("".join(rng.choice(PIECES) + rng.choice(SEPARATORS) for _ in range(rng.randint(1, 5))).rstrip(":,"))
    return out


def test_shapes_equal_the_layouts_tried_in_turn(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(_cells())], "i int, cell string").repartition(4)
    s = F.trim(F.col("cell"))
    out = df.select("cell", cleaning._by_formats(s).alias("want"), cleaning.parse_mixed_date("cell", strict=False).alias("got"),
                    cleaning._by_shape(s).alias("fast")).collect()
    assert [(r["cell"], r["got"]) for r in out] == [(r["cell"], r["want"]) for r in out]
    assert sum(r["want"] is not None for r in out) > 500
    # the usual shapes never fall back
    by = {r["cell"]: r["fast"] for r in out}
    assert by["1/2/2020 5:07 "] == datetime(2020, 1, 2, 5, 7) and by["31/12/70"] == datetime(1970, 12, 31)
    missed = [r["cell"] for r in out if r["want"] is not None and r["fast"] is None]
    assert not [c for c in missed if c.count("/") == 2 and len(c) <= 10], missed
