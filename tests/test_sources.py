import json
import os


from salescope.operators import grid
from salescope.sources import catalog, feedback, landing


def test_catalog_reads_no_content_and_dedups(spark, tmpdir_path):
    for name, body in [("a.csv", "x\n1\n"), ("b.csv", "x\n1\n2\n"), ("notes.txt", "no")]:
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(body)
    cat = catalog.dataset_catalog(spark, tmpdir_path)
    plan = cat._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]
    assert sorted(r["filename"] for r in cat.collect()) == ["a.csv", "b.csv"]
    fallback = spark.createDataFrame([("a.csv", 0, "", "/fallback/a.csv", 0)],
                                     "filename string, size long, uploaded_at string, path string, priority int")
    both = catalog.catalog_dedup(cat.unionByName(fallback)).collect()
    assert sorted((r["filename"], r["priority"]) for r in both) == [("a.csv", 0), ("b.csv", 1)]


def test_active_dataset_rules(spark, tmpdir_path):
    cat = spark.createDataFrame([("b.csv",), ("a.csv",)], "filename string")
    cfg = spark.createDataFrame([("b.csv",)], "active_filename string")
    bad = spark.createDataFrame([("gone.csv",)], "active_filename string")
    empty = spark.createDataFrame([], "filename string")
    assert catalog.active_dataset(cat, cfg, "fb.csv").collect()[0][:] == ("b.csv", "config")
    assert catalog.active_dataset(cat, bad, "fb.csv").collect()[0][:] == ("a.csv", "first")
    assert catalog.active_dataset(empty, None, "fb.csv").collect()[0][:] == ("fb.csv", "fallback")


def test_land_dataset_replaces_only_its_partition(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "landed")
    one = spark.createDataFrame([(1.0,)], "sales double")
    two = spark.createDataFrame([(2.0,), (3.0,)], "sales double")
    landing.land_dataset(one, root, "first")
    landing.land_dataset(two, root, "second")
    landing.land_dataset(two, root, "first")
    assert landing.read_dataset(spark, root, "first").count() == 2
    assert landing.read_dataset(spark, root, "second").count() == 2


def test_feedback_append_and_read(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "fb")
    assert feedback.read_feedback(spark, d).count() == 0
    feedback.append_feedback(spark.createDataFrame([(5, "ui", "nice")], "rating int, category string, comment string"), d)
    feedback.append_feedback(spark.createDataFrame([(1, "data", "slow")], "rating int, category string, comment string"), d)
    with open(os.path.join(d, "broken.json"), "w") as f:
        f.write('{"rating": 3, "category": "x", "comment": "ok", "timestamp": "t"}\n{not json\n')
    got = feedback.read_feedback(spark, d)
    assert sorted(r["rating"] for r in got.collect()) == [1, 3, 5]


def test_vector_table_and_report_sink(spark, tmpdir_path):
    from salescope.operators.vectors import sparse_embed
    docs = spark.createDataFrame([(1, "line one\nline two"), (2, "other")], "id long, text string")
    vt = sparse_embed(docs, "id", "text", dim=64, keep=("text",))
    p = os.path.join(tmpdir_path, "vt")
    landing.write_vector_table(vt, p)
    back = {r["id"]: r["text"] for r in landing.read_vector_table(spark, p).collect()}
    assert back == {1: "line one\nline two", 2: "other"}
    reps = spark.createDataFrame([("east", "report A"), ("west", "report B")], "report_key string, report string")
    rp = os.path.join(tmpdir_path, "reports")
    landing.write_reports(reps, rp)
    parts = sorted(d for d in os.listdir(rp) if d.startswith("report_key="))
    assert parts == ["report_key=east", "report_key=west"]
    back = {r["value"] for r in spark.read.text(os.path.join(rp, "report_key=east")).collect()}
    assert back == {"report A"}


def test_grid_ops(spark):
    df = spark.createDataFrame([("EAST", "Plates", 3.0), ("WEST", "cups", 1.0), ("EAST", None, 2.0)],
                               "region string, product string, sales double")
    assert grid.grid_filter(df, region="EAST").count() == 2
    assert [r["product"] for r in grid.grid_search(df, "plate").collect()] == ["Plates"]
    assert [r["sales"] for r in grid.grid_sort(df, "sales", n=2).collect()] == [3.0, 2.0]
    pv = grid.preview(df, ["sales"], n=5).collect()
    assert pv[0]["sales"] == "1.0" and pv[1]["product"] == ""


def test_reports_per_key_to_sink(spark, tmpdir_path):
    from salescope.plans.analysis import final_reports
    from salescope.sources.fixture import sales_view
    from tests.conftest import SF_SMALL
    reps = final_reports(sales_view(spark, SF_SMALL), ["region"])
    out = os.path.join(tmpdir_path, "reports")
    landing.write_reports(reps, out, key="region")
    parts = sorted(d for d in os.listdir(out) if d.startswith("region="))
    assert len(parts) == 5
    text = "\n".join(r["value"] for r in spark.read.text(os.path.join(out, parts[0])).collect())
    assert text.startswith("# Executive Business Report") and "## 3. Sales Forecasting" in text


def test_preview_goes_on_to_the_next_files(spark, tmpdir_path):
    from salescope.operators import grid
    path = f"{tmpdir_path}/many"
    for i in range(3):
        spark.range(i * 30, i * 30 + 30).coalesce(1).write.mode("append").parquet(path)
    spark.range(0).coalesce(1).write.mode("append").parquet(path)
    assert grid.preview_file(spark, path, 70).count() == 70 and grid.preview_file(spark, path).count() == 90


def test_grid_sort_without_a_page_keeps_all_rows(spark):
    from salescope.operators import grid
    df = spark.range(500).selectExpr("id", "id % 7 AS v")
    assert [r["v"] for r in grid.grid_sort(df, "v").collect()] == sorted((i % 7 for i in range(500)), reverse=True)


def test_relanding_an_empty_dataset_leaves_no_old_rows(spark, tmpdir_path):
    from salescope.sources import landing
    df = spark.range(5).selectExpr("id", "'x' AS v")
    landing.land_dataset(df, tmpdir_path, "a b.csv")
    landing.land_dataset(df, tmpdir_path, "other.csv")
    landing.land_dataset(df.limit(0), tmpdir_path, "a b.csv")
    assert landing.read_dataset(spark, tmpdir_path, "a b.csv").count() == 0
    assert landing.read_dataset(spark, tmpdir_path, "other.csv").count() == 5


def test_csv_layouts_are_matched_by_name(spark, tmpdir_path):
    from salescope.sources.csv import clean_sales, read_csv_raw, read_sales_csv
    with open(f"{tmpdir_path}/a.csv", "w") as f:
        f.write("Region,Sales,Profit,Discount\nEast,10,2,0.1\n")
    with open(f"{tmpdir_path}/b.csv", "w") as f:
        f.write("Profit, Region ,Discount,Sales\n-1,West,0,5\n")
    rows = clean_sales(read_sales_csv(spark, tmpdir_path)).collect()
    assert sorted((r["region"], r["sales"], r["profit"]) for r in rows) == [("East", 10.0, 2.0), ("West", 5.0, -1.0)]
    import pytest
    with pytest.raises(Exception):
        read_csv_raw(spark, tmpdir_path).collect()


def test_selected_dataset_is_flagged(spark, tmpdir_path):
    from salescope.sources import catalog
    for n in ("a.csv", "b.csv"):
        with open(f"{tmpdir_path}/{n}", "w") as f:
            f.write("x\n1\n")
    files = catalog.dataset_catalog(spark, tmpdir_path)
    catalog.select_dataset(spark, files, "b.csv", f"{tmpdir_path}/config")
    active = catalog.active_dataset(files, catalog.read_selection(spark, f"{tmpdir_path}/config"), None)
    assert {r["filename"]: r["active"] for r in catalog.with_active(files, active).collect()} == {"a.csv": False, "b.csv": True}
    import pytest
    with pytest.raises(ValueError):
        catalog.select_dataset(spark, files, "c.csv", f"{tmpdir_path}/config")


def test_ten_thousand_small_files_of_several_layouts(spark, tmpdir_path):
    """Layouts are found on the executors: no file is opened by the driver, whatever their number."""
    from salescope.sources.csv import file_layouts, read_sales_csv
    full = "Order Date,Region,Category,Sub-Category,Segment,Product Name,Sales,Discount,Profit\n1/2/2020,R\xe9gion,C,S,G,P,{},0.1,2\n"
    other = 'Sales,"Region ",Order Date,Profit,Discount\n{},NA,1/2/2020,1,0\n'
    poor = "Sales\n{}\n"
    for i in range(10_000):
        folder = os.path.join(tmpdir_path, f"d{i % 10}")
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, f"f{i}.csv"), "w", encoding="latin-1") as f:
            f.write("" if i == 77 else (poor if i == 5 else other if i % 3 == 0 else full).format(i))
    calls = []
    real = spark.sparkContext._gateway._gateway_client.send_command
    spark.sparkContext._gateway._gateway_client.send_command = lambda *a, **k: (calls.append(1), real(*a, **k))[1]
    try:
        df = read_sales_csv(spark, os.path.join(tmpdir_path, "*"), file_column="path")
    finally:
        spark.sparkContext._gateway._gateway_client.send_command = real
    assert len(calls) < 3000  # calls grow with layouts and columns, not with files
    rows = df.select("Region", "Sales", "Category", "path").collect()
    assert len(rows) == 9_999
    for r in rows:
        i = int(r["Sales"])
        assert r["path"].endswith(f"/f{i}.csv") and (r["Region"], r["Category"]) == ((None, None) if i % 3 == 0 or i == 5 else ("R\xe9gion", "C"))
    assert file_layouts(spark, os.path.join(tmpdir_path, "d5")).count() == 1000


def test_readers_keep_their_version_while_a_dataset_lands_again(spark, tmpdir_path):
    df = spark.range(10).selectExpr("id", "1 AS v")
    landing.land_dataset(df, tmpdir_path, "a.csv")
    held = landing.read_dataset(spark, tmpdir_path, "a.csv")
    # a landing that fails half-way changes nothing
    broken = df.selectExpr("id", "IF(id = 9, CAST(raise_error('lost') AS INT), 2) AS v")
    try:
        landing.land_dataset(broken, tmpdir_path, "a.csv")
        raise AssertionError("should fail")
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    assert landing.read_dataset(spark, tmpdir_path, "a.csv").agg({"v": "sum"}).first()[0] == 10
    landing.land_dataset(df.selectExpr("id", "3 AS v"), tmpdir_path, "a.csv")
    # the reader from before still has its files, a new one the new rows
    assert held.agg({"v": "sum"}).first()[0] == 10
    assert landing.read_dataset(spark, tmpdir_path, "a.csv").agg({"v": "sum"}).first()[0] == 30
    for i in range(4):
        landing.land_dataset(df.limit(i), tmpdir_path, "a.csv")
    assert landing.read_dataset(spark, tmpdir_path, "a.csv").count() == 3
    versions = [d for d in os.listdir(landing.dataset_path(spark, tmpdir_path, "a.csv")) if d.startswith("version=")]
    assert len(versions) <= landing.KEEP_VERSIONS + 1  # the failed one's folder is unreferenced


def test_sorted_places_and_a_written_sort(spark, tmpdir_path):
    df = spark.range(2000).selectExpr("id", "id % 7 AS v", "IF(id % 5 = 0, NULL, id % 3) AS w").repartition(6)
    rows = [(r["v"], r["id"], r["w"]) for r in df.collect()]
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    got = [(r["v"], r["id"], r["w"]) for r in grid.grid_sort_places(df, "v").orderBy("place").collect()]
    assert got == want
    grid.write_sorted(df, "v", f"{tmpdir_path}/sorted")
    back = spark.read.parquet(f"{tmpdir_path}/sorted")
    assert [r["place"] for r in back.orderBy("place").collect()] == list(range(2000))
    assert [(r["v"], r["id"], r["w"]) for r in back.orderBy("place").collect()] == want


def test_catalogue_names_of_paths(spark):
    from salescope.functions.formats import basename
    df = spark.createDataFrame([("file:/a/b c.csv",), ("x.csv",), ("s3://k/",)], "path string")
    assert [r[0] for r in df.select(basename("path")).collect()] == ["b c.csv", "x.csv", ""]


def _star(spark, at):
    """Two order lines per customer: a segment is null, a nation's region has no name."""
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")

    put("region", [(0, "EAST"), (1, None)], "r_regionkey int, r_name string")
    put("nation", [(0, "a", 0), (1, "b", 1)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(1, 0, "X"), (2, 0, None), (3, 1, "Y")], "c_custkey long, c_nationkey int, c_mktsegment string")
    put("orders", [(i, i) for i in (1, 2, 3)], "o_orderkey long, o_custkey long")
    orders = spark.read.parquet(f"{at}/orders.parquet")
    orders.selectExpr("*", "timestamp_ntz'2020-02-13' as o_orderdate").write.mode("overwrite").parquet(f"{at}/dated.parquet")
    spark.read.parquet(f"{at}/dated.parquet").write.mode("overwrite").parquet(f"{at}/orders.parquet")
    put("part", [(7, "P", "t", "b", 1.0)], "p_partkey long, p_name string, p_type string, p_brand string, p_retailprice double")
    put("lineitem", [(i, 7, 1.0, 10.0 * i, 0.0) for i in (1, 1, 2, 2, 3, 3)],
        "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double")
    return at


def test_star_join_moves_segment_and_region_as_one_number(spark, tmpdir_path):
    from salescope.sources import fixture
    at = _star(spark, f"{tmpdir_path}/star")
    view = fixture.sales_view(spark, at)
    got = sorted((r["sales"], r["segment"], r["region"], r["category"]) for r in view.collect())
    assert got == [(10.0, "X", "EAST", "t")] * 2 + [(20.0, None, "EAST", "t")] * 2 + [(30.0, "Y", None, "t")] * 2
    assert "market" in view._jdf.queryExecution().optimizedPlan().toString()


def test_sales_csv_is_compressed_and_needs_no_landed_table(spark, tmpdir_path, monkeypatch):
    from salescope.sources import fixture
    from salescope.sources.csv import read_sales_csv
    at = _star(spark, f"{tmpdir_path}/star")
    monkeypatch.setattr(fixture, "_LANDED", {})
    path = fixture.sales_csv_path(spark, at)
    files = [f for f in spark.read.format("binaryFile").load(path).select("path").collect()]
    assert files and all(f["path"].endswith(".csv.gz") for f in files) and not fixture._LANDED
    assert read_sales_csv(spark, path).groupBy("Segment").count().count() == 3
