import os

from salescope.streaming import feedback as fstream
from salescope.streaming import landing as lstream

HEADER = "Order Date,Region,Category,Sub-Category,Segment,Product Name,Sales,Discount,Profit\n"


def _write(path, lines):
    with open(path, "w", encoding="latin-1") as f:
        f.write(HEADER + "".join(lines))


def _kpis(spark, out):
    return {(r["file"], r["region"]): (r["sales"], r["profit"]) for r in spark.read.parquet(out).collect()}


def test_landing_kpis_update_per_file(spark, tmpdir_path):
    src, ckpt, out = (os.path.join(tmpdir_path, n) for n in ("in", "ckpt", "out"))
    os.makedirs(src)
    _write(os.path.join(src, "one.csv"), ["1/2/2020,East,C,S,G,P,10,0.1,2\n", "1/3/2020,West,C,S,G,P,5,0,-1\n"])
    lstream.start_landing_kpis(spark, src, ckpt, out).awaitTermination()
    first = {("one.csv", "East"): (10.0, 2.0), ("one.csv", "West"): (5.0, -1.0)}
    assert _kpis(spark, out) == first
    kept = {f: os.path.getmtime(os.path.join(out, "file=one.csv", f)) for f in os.listdir(os.path.join(out, "file=one.csv"))}
    _write(os.path.join(src, "two.csv"), ["2/2/2020,East,C,S,G,P,7,0.1,1\n", "2/2/2020,NA,C,S,G,P,1,0,0\n"])
    lstream.start_landing_kpis(spark, src, ckpt, out).awaitTermination()
    assert _kpis(spark, out) == {**first, ("two.csv", "East"): (7.0, 1.0)}
    # only the new file's partition is written
    assert kept == {f: os.path.getmtime(os.path.join(out, "file=one.csv", f)) for f in os.listdir(os.path.join(out, "file=one.csv"))}


def test_landing_reads_columns_by_name_and_drops_any_null_key(spark, tmpdir_path):
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    os.makedirs(src)
    with open(os.path.join(src, "b.csv"), "w") as f:
        f.write("Row ID, Region ,Profit,Order Date,Sales,Discount,Category,Sub-Category,Segment,Product Name\n"
                "1,East,2,1/2/2020,10,0.1,C,S,G,P\n2,East,1,1/2/2020,4,0.1,NA,S,G,P\n3,NA,1,1/2/2020,4,0.1,C,S,G,P\n")
    _write(os.path.join(src, "a.csv"), ["1/2/2020,East,C,S,G,P,5,0,-1\n"])
    lstream.start_landing_kpis(spark, src, os.path.join(tmpdir_path, "ck"), out, keys=("region", "category")).awaitTermination()
    assert _kpis(spark, out) == {("b.csv", "East"): (10.0, 2.0), ("a.csv", "East"): (5.0, -1.0)}


def _by_path(spark, out):
    return {"/".join(r["path"].split("/")[-2:]): r["sales"] for r in spark.read.parquet(out).collect()}


def test_files_of_one_name_and_files_that_land_again(spark, tmpdir_path):
    src, ckpt, out = (os.path.join(tmpdir_path, n) for n in ("in", "ckpt", "out"))
    row = "1/2/2020,East,C,S,G,P,{},0.1,2\n"

    def land(folder, sales, name="sales.csv"):
        os.makedirs(os.path.join(src, folder), exist_ok=True)
        _write(os.path.join(src, folder, name), [row.format(x) for x in sales])

    def run():
        lstream.start_landing_kpis(spark, src, ckpt, out, recursive=True).awaitTermination()
        return _by_path(spark, out)

    land("a", [60, 40])
    land("b", [10])
    assert run() == {"a/sales.csv": 100.0, "b/sales.csv": 10.0}
    land("c", [7])
    assert run() == {"a/sales.csv": 100.0, "b/sales.csv": 10.0, "c/sales.csv": 7.0}
    # the same path again: its old sums are retracted; nothing else is written
    kept = {f: os.path.getmtime(f) for f in _data_files(out) if "a/sales" not in f}
    land("a", [1, 2, 3])
    land("d e+f", [5], "x=[1].csv")
    assert run() == {"a/sales.csv": 6.0, "b/sales.csv": 10.0, "c/sales.csv": 7.0, "d e+f/x=[1].csv": 5.0}
    same = [f for f in kept if os.path.exists(f) and os.path.getmtime(f) == kept[f]]
    assert len(same) >= 2
    # a replay changes nothing, a file without a valid row or without a path loses its sums
    before = {f: os.path.getmtime(f) for f in _data_files(out)}
    assert lstream.refresh_landing(spark, src, out, recursive=True) == 0
    assert before == {f: os.path.getmtime(f) for f in _data_files(out)}
    _write(os.path.join(src, "b", "sales.csv"), ["1/2/2020,NA,C,S,G,P,9,0.1,2\n"])
    os.remove(os.path.join(src, "c", "sales.csv"))
    assert lstream.refresh_landing(spark, src, out, recursive=True, max_files=1) == 2
    assert _by_path(spark, out) == {"a/sales.csv": 6.0, "d e+f/x=[1].csv": 5.0}


def _data_files(root):
    return [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")]


def test_feedback_stream_drops_malformed(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "fb")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write('{"rating": 5, "category": "ui", "comment": "ok", "timestamp": "t1"}\n{oops\n'
                '{"rating": 2, "category": "data", "comment": "slow", "timestamp": "t2"}\n')
    out = os.path.join(tmpdir_path, "out")
    q = fstream.start_feedback_sink(spark, src, out, os.path.join(tmpdir_path, "ck"))
    q.awaitTermination()
    got = sorted(r["rating"] for r in spark.read.parquet(out).collect())
    assert got == [2, 5]


def test_malformed_feedback_goes_to_its_own_table(spark, tmpdir_path):
    src, out, bad, ck = (os.path.join(tmpdir_path, n) for n in ("fb", "out", "bad", "ck"))
    os.makedirs(src)

    def run(name, lines):
        with open(os.path.join(src, name), "w") as f:
            f.write("\n".join(lines) + "\n")
        fstream.start_feedback_quarantine(spark, src, out, bad, ck).awaitTermination()
        return (sorted(r["rating"] for r in spark.read.parquet(out).collect()), sorted(r["line"] for r in spark.read.parquet(bad).collect()))

    assert run("a.json", ['{"rating": 5, "category": "ui", "comment": "ok", "timestamp": "t1"}', "{oops", '{"rating": "five"}']) == (
        [5], ['{"rating": "five"}', "{oops"])
    assert run("b.json", ['{"rating": 2}', "[1", '{"rating": 3, "extra": 1}']) == ([2, 3, 5], ["[1", '{"rating": "five"}', "{oops"])
