"""Round trips of sources and sinks, and streams against batch."""

import tempfile

import pytest
from pyspark.sql import functions as F

from cellweave.operators import nuclei
from cellweave.sources import candidate_store, matrix, step_log, tables
from cellweave.streaming import ingest


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_table_formats(spark, folder):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    for name in ("t.parquet", "t.csv", "t.csv.gz"):
        tables.write_table(df, f"{folder}/{name}", order=["k"])
        back = tables.read_table(spark, f"{folder}/{name}", columns=["v"], schema=df.schema)
        assert sorted(r.v for r in back.collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{folder}/t.xlsx")
    with pytest.raises(ValueError):
        tables.write_table(df, f"{folder}/t.npz")


def test_matrix_directory(spark, folder):
    expr = spark.createDataFrame([("c0", "g0", 2), ("c0", "g1", 1), ("c1", "g1", 3), ("c1", "g2", 5)], "barcode string, gene string, cnt long")
    bars = spark.createDataFrame([("c0", 0), ("c1", 1)], "barcode string, matrix_col_index long")
    genes = spark.createDataFrame([("g0", "T", 0), ("g1", "T", 1), ("g2", "O", 2)], "gene string, feature_type string, matrix_feature_index long")
    matrix.write_matrix(expr, bars, genes, folder)
    assert {tuple(r) for r in matrix.read_matrix(spark, folder).collect()} == {tuple(r) for r in expr.collect()}
    assert dict(matrix.read_entries(spark, folder).dtypes)["value"] == "bigint"
    assert [r.matrix_feature_index for r in matrix.read_features(spark, folder, "O").collect()] == [2]
    with pytest.raises(ValueError):
        matrix.read_features(spark, folder, "none")
    with pytest.raises(FileNotFoundError):
        matrix.read_barcodes(spark, folder + "/nowhere")


def test_candidate_store(spark, folder):
    nuc = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 9.0, 9.0, 1.0)], "cell_id long, center_x_um double, center_y_um double, radius_um double")
    cand = spark.createDataFrame([(1, 5, "b5", 1.0, 1.0, 1.4), (1, 2, "b2", 0.0, 1.0, 1.0)], "cell_id long, matrix_col_index long, barcode string, x_um double, y_um double, dist_um double")
    candidate_store.write_store(nuc, cand, folder)
    assert [(r.candidate_index, r.barcode) for r in candidate_store.read_store(spark, folder).orderBy("candidate_index").collect()] == [(0, "b2"), (1, "b5")]
    assert {r.cell_id: r.n_candidate_bins for r in candidate_store.read_index(spark, folder).collect()} == {1: 2, 2: 0}


def test_step_log_source(spark, folder):
    rows = spark.createDataFrame([("e1", '{"k": 1}'), ("e2", '{"k": 2}')], "event string, payload string").withColumn("ts", F.lit("2024-01-02 12:00:00").cast("timestamp"))
    step_log.append_log(step_log.log_rows(rows, "ts", "event", "payload"), folder)
    out = step_log.read_log(spark, folder, "k int").orderBy("event").collect()
    assert [r.payload.k for r in out] == [1, 2] and out[0].timestamp_utc == "2024-01-02T12:00:00" and out[0].timestamp_local == "2024-01-02T06:00:00"
    spark.createDataFrame([('{"episode_id": "a", "steps": [{"action": "add", "r": 1.5}, {"action": "stop", "r": 0.0}]}',)], "value string").write.mode("overwrite").text(folder + "/tr", compression="gzip")
    got = step_log.read_traces(spark, folder + "/tr", "struct<action:string,r:double>").orderBy("step_offset").collect()
    assert [(r.step_offset, r.action) for r in got] == [(0, "add"), (1, "stop")]


def test_action_traces_differ_by_step_and_need_a_list(spark, folder):
    steps = spark.createDataFrame([(1, 2, "stop", None), (1, 1, "add", "b1"), (2, 1, "stop", None)], "episode_id long, step_index int, action string, barcode string")
    step_log.write_traces(steps, "episode_id", "step_index", folder + "/traces")
    read = step_log.read_action_traces(spark, folder + "/traces")
    got = {(r.episode_id, r.step_offset, r.j) for r in read.selectExpr("episode_id", "step_offset", "to_json(step) as j").collect()}
    assert got == {(1, 0, '{"action":"add","barcode":"b1","step_index":1}'), (1, 1, '{"action":"stop","step_index":2}'), (2, 0, '{"action":"stop","step_index":1}')}
    for k, line in enumerate(['{"episode_id": 3}', '{"episode_id": 3, "steps": {"action": "add"}}', '{"episode_id": 3, "steps": []}']):
        spark.createDataFrame([(line,)], "value string").write.text(f"{folder}/bad{k}")
        bad = step_log.read_action_traces(spark, f"{folder}/bad{k}")
        if k == 2:
            assert bad.count() == 0
        else:
            with pytest.raises(Exception, match="without a list of steps"):
                bad.collect()


def test_stream_equals_batch(spark, folder):
    px = spark.range(500).selectExpr("cast(id % 23 as int) as x", "cast(id % 17 as int) as y", "id % 4 as cell_id", "cast(id % 2 as int) as is_nuclear")
    px.repartition(5).write.mode("overwrite").parquet(folder + "/px")
    stream = ingest.nucleus_moments(ingest.file_stream(spark, folder + "/px", px.schema))
    batch = nuclei.nucleus_moments(px)
    assert {tuple(r) for r in stream.select(*batch.columns).collect()} == {tuple(r) for r in batch.collect()}


def test_sample_is_fixed_and_exact(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = [r.k for r in tables.sample_rows(df, "k", 50).collect()]
    b = [r.k for r in tables.sample_rows(df.repartition(9), "k", 50).collect()]
    assert a == b == sorted(a) and len(a) == 50


def test_samples_spread_and_follow_the_seed(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    one, two = ({r.k for r in tables.sample_rows(df, "k", 100, seed=s).collect()} for s in (1, 2))
    assert one != two and all(len({k // 1000 for k in s}) == 5 for s in (one, two))
    drawn = [r.k for r in tables.sample_with_replacement(df.limit(50), "k", 300, seed=3).collect()]
    assert len(drawn) == 300 and len(set(drawn)) > 40
    assert sorted(drawn) == sorted(r.k for r in tables.sample_with_replacement(df.limit(50).repartition(7), "k", 300, seed=3).collect())
    assert tables.sample_with_replacement(df.limit(0), "k", 10).count() == 0
