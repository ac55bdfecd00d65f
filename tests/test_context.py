import pytest
from pyspark.sql import functions as F

from spanlight.plans.context import Context, Node, Option, SaveWhen, cut_list_node, cut_node, from_columns, generator_node, merge_node, overlap_node
from spanlight.plans.lineage import camel_to_snake, flatten_dict, short_hash
from spanlight.sources.store import DatasetStore, copy_dataset


def records(spark, run_id, config):
    n = config["n_rows"]
    return spark.range(n).select(F.lit(run_id).alias("run_id"), F.col("id").alias("row_id"), (F.col("id") * 10).alias("time"), (F.col("id") * 10 + 5).alias("endtime"))


def peaks(spark, run_id, config, records):
    return records.withColumn("area", F.col("row_id") * config["gain"])


@pytest.fixture
def context(spark, tmp_path):
    c = Context(spark, [DatasetStore(f"file://{tmp_path}")])
    c.register(Node("records", records, options=(Option("n_rows", 10), Option("note", "", track=False))), Node("peaks", peaks, ("records",), (Option("gain", 2, kind=int),), kind="peaks"))
    return c


def test_stored_by_lineage(context):
    assert not context.is_stored("r0", "peaks")
    assert context.get("r0", "peaks").count() == 10
    assert context.is_stored("r0", "peaks") and context.is_stored("r0", "records")
    other = context.derive(gain=3)
    assert not other.is_stored("r0", "peaks") and other.is_stored("r0", "records")
    assert context.derive(note="x").is_stored("r0", "peaks")
    fuzzy = context.derive(gain=3)
    fuzzy.ignored = ("gain",)
    assert fuzzy.is_stored("r0", "peaks")


def test_selection_and_merge(context):
    context.register(cut_node("large", "peaks", "area > 6"), cut_node("early", "peaks", "time < 70"), cut_list_node("cuts", ["large", "early"]), merge_node("both", ["peaks", "records"]))
    assert context.get("r0", "cuts", selection="cuts").count() == 3
    assert context.get("r0", "both").columns == ["run_id", "row_id", "time", "endtime", "area"]
    assert context.get("r0", "peaks", time_range=(10, 45), keep_columns=["area", "time"]).columns == ["time", "area"]
    with pytest.raises(ValueError):
        context.get("r0", ["peaks", "records"])


def test_superruns_and_many(context):
    context.define_run("_s", ["r0", ("r1", 0, 30)])
    assert context.get("_s", "peaks").count() == 13
    assert context.get_many(["r1", "r0"], "records").count() == 20
    with pytest.raises(ValueError):
        context.define_run("s", [])


def test_registry(context):
    with pytest.raises(ValueError):
        context.register(Node("x", peaks, ("records",), (Option("gain", 9),)))
    context.register(Node("orphan", peaks, ("nothing",)))
    context.drop_unreachable()
    assert "orphan" not in context.nodes
    assert context.levels() == {"records": 0, "peaks": 1}
    with pytest.raises(TypeError):
        context.derive(gain="a").get("r0", "peaks")
    assert short_hash({"b": 1, "a": (1, 2)}) == short_hash({"a": [1, 2], "b": 1})


def test_save_policies(context, spark, tmp_path):
    context.register(Node("peaks", peaks, ("records",), (Option("gain", 2),), save=SaveWhen.EXPLICIT))
    context.get("r0", "peaks")
    assert not context.is_stored("r0", "peaks")
    context.make("r0", "peaks")
    assert context.is_stored("r0", "peaks")
    target = DatasetStore(f"file://{tmp_path}/copy")
    copy_dataset(spark, context.stores[0], target, context.key("r0", "peaks"), 3)
    assert target.read(spark, context.key("r0", "peaks"), (0, 11)).count() == 2


def test_streamed_groups(spark, tmp_path):
    from spanlight.streaming.gaps import late_rows, stream_gap_groups

    s = 1_000_000_000
    rows = [(1, 0, s), (1, 2 * s, 3 * s), (1, 60 * s, 61 * s), (2, s, 2 * s), (3, 0, 100 * s), (3, 50 * s, 51 * s), (3, 109 * s, 110 * s), (4, 0, s), (4, 11 * s, 12 * s), (9, 900 * s, 901 * s)]
    spark.createDataFrame(rows, "channel int, time long, endtime long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("channel int, time long, endtime long").parquet(f"{tmp_path}/in")
    q = stream_gap_groups(stream, 10, 5).writeStream.format("memory").queryName("groups").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.channel, r.time, r.endtime, r.n) for r in spark.table("groups").collect())
    assert got == [(1, 0, 3 * s, 2), (1, 60 * s, 61 * s, 1), (2, s, 2 * s, 1), (3, 0, 110 * s, 3), (4, 0, s, 1), (4, 11 * s, 12 * s, 1)]
    assert [r.time for r in late_rows(spark.read.parquet(f"{tmp_path}/in"), s).where("channel = 1").collect()] == [0]


def test_a_changed_condition_is_not_stored(context):
    context.register(cut_node("large", "peaks", "area > 6"))
    assert context.get("r0", "large").where("large").count() == 6
    other = context.derive()
    other.register(cut_node("large", "peaks", "area > 600"))
    assert not other.is_stored("r0", "large") and other.get("r0", "large").where("large").count() == 0
    assert set(context.compare_metadata("r0", "large", other)) == {"large"}


def test_failed_overwrite_keeps_the_data(spark, tmp_path):
    store = DatasetStore(f"file://{tmp_path}", overwrite="always", codec="gzip")
    key = ("r0", "peaks", "abc")
    store.write(spark.range(5).withColumnsRenamed({"id": "time"}), key, {})
    broken = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("time"))
    with pytest.raises(Exception, match="broken"):
        store.write(broken, key, {})
    assert store.read(spark, key, check=True).count() == 5 and store.size_mb(spark, key) > 0
    store.write(spark.range(7).withColumnsRenamed({"id": "time"}), key, {})
    assert store.read(spark, key, check=True).count() == 7
    assert len([p for p in (tmp_path / "r0-peaks-abc").iterdir() if p.name.startswith("data-")]) == 1
    lost = next((tmp_path / "r0-peaks-abc").glob("data-*/*.parquet"))
    lost.unlink()
    with pytest.raises(ValueError, match="rows"):
        store.read(spark, key, check=True)


def test_verbs(context, spark):
    assert [(span, df.count()) for span, df in context.get_iter("r0", "records", 40)] == [((0, 40), 4), ((40, 80), 4), ((80, 120), 2)]
    assert context.get_array("r0", "records").num_rows == len(context.get_df("r0", "records")) == 10
    assert context.accumulate("r0", "peaks", ["area"]).first()["area"] == 90
    assert ("area", "bigint", "") in context.data_info("r0", "peaks")
    assert context.size_mb("r0", "peaks") > 0 and context.size_mb("r9", "peaks") == 0
    context.scan_runs(spark.createDataFrame([("r0", "a", "x")], "name string, mode string, tags string"), spark.createDataFrame([("r0", "b", "y"), ("r1", "b", "y")], "name string, mode string, tags string"))
    assert sorted((r.name, r.mode) for r in context.runs.collect()) == [("r0", "a"), ("r1", "b")]
    assert [r.name for r in context.select_runs(available=["peaks"]).collect()] == ["r0"]
    assert context.available_for_run("r1") == {"records": False, "peaks": False}


def near_area(rows):
    return rows.select("run_id", "row_id", "time", "endtime", F.aggregate("near", F.lit(0).cast("long"), lambda a, x: a + x["area"]).alias("around"))


def test_node_kinds(context):
    def halves(frames):
        for f in frames:
            yield f.assign(area=f["area"] / 2)
            yield f

    schema = "run_id string, row_id long, time long, endtime long, area double"
    context.register(generator_node("split", "peaks", schema, halves), generator_node("all", "peaks", schema, halves, whole_run=True), overlap_node("around", "peaks", 6, near_area, ["area"]))
    assert context.get("r0", "split").count() == context.get("r0", "all").count() == 20
    got = {r.row_id: r.around for r in context.get("r0", "around").collect()}
    assert got == {i: sum(2 * j for j in range(max(0, i - 1), min(9, i + 1) + 1)) for i in range(10)}
    with pytest.raises(ValueError):
        overlap_node("x", "peaks", -1, near_area)


def test_names_tables_and_fetched_options(context, spark):
    assert camel_to_snake("HitPeaks2DMap") == "hit_peaks2_d_map" and camel_to_snake("LXeArea") == "l_xe_area"
    assert flatten_dict({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"a:b": 1, "a:c:d": 2, "e": 3}
    assert from_columns(spark, {"gain": [1.0, 2.0], "channel": [0, 1]}, "channel int, gain double").collect()[1]["gain"] == 2
    with pytest.raises(ValueError):
        from_columns(spark, {"a": [1], "b": []}, "a int, b int")
    node = Node("doubled", lambda spark, run_id, config, peaks: peaks.withColumn("area", F.col("area") * config["factor"]), ("peaks",), (Option("factor", "two", fetch={"two": 2, "three": 3}.get),))
    context.register(node)
    assert context.accumulate("r0", "doubled", ["area"]).first()["area"] == 180
    assert context.lineage("r0", "doubled")["doubled"][2] == {"factor": "two"}
