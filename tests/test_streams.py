"""Streams over several micro-batches against the batch answer."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runweave.streaming import streams as X


@pytest.fixture()
def feed(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"user_id": rng.integers(0, 3, 60), "t": np.arange(60.0), "y": rng.random(60)})
    for k in range(3):
        spark.createDataFrame(rows.iloc[k * 20 : k * 20 + 20]).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema("user_id long, t double, y double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    return stream, rows


def test_cumulative_over_batches(feed):
    stream, rows = feed
    got = X.drained(X.cumulative(stream, "user_id"), "c").groupBy("user_id").agg(F.max_by("total", "t").alias("v")).collect()
    for r in got:
        own = rows[rows.user_id == r.user_id].sort_values("t")
        assert np.isclose(r.v, np.trapezoid(own.y, own.t))


def test_status_over_batches(feed):
    stream, rows = feed
    s = stream.select(F.col("user_id").alias("run_id"), F.col("t").alias("time_s"), F.col("t").cast("int").alias("snapshot_index"), (F.col("y") > 0.5).alias("valid"))
    got = {r.run_id: (r.n, r.last_time) for r in X.drained(X.run_status(s), "s", "complete").collect()}
    assert got == {k: (len(g), g.t.max()) for k, g in rows.groupby("user_id")}


def test_late_rows_are_reported(spark, tmp_path):
    for k, ts in enumerate([[1.0, 2.0, 5.0], [4.0, 6.0], [3.0]]):
        spark.createDataFrame([(1, 10 * k + i, t) for i, t in enumerate(ts)], "key long, n long, t double").coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema("key long, n long, t double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    assert sorted((r.t, r.latest) for r in X.drained(X.out_of_order(stream), "o").collect()) == [(3.0, 6.0), (4.0, 5.0)]


def test_front_stream_matches_batch(spark, tmp_path):
    rows = [(1, s, z, 1.0 if z == 8 - s else 0.0) for s in range(6) for z in range(10)]
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 2 == k], "run_id long, snapshot_index int, interface_id int, score double").coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema("run_id long, snapshot_index int, interface_id int, score double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = {r.snapshot_index: r.track_index for r in X.drained(X.front(stream, threshold=0.15), "f").collect()}
    assert got == {s: 8 - s for s in range(6)}


def test_snapshots_of_arriving_logs(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"r{k}.log").write_text("END OF INPUT PARAMETERS\n" + "".join(f"  Cycle   Time (s)  dt\n  {i}  {i}.0E-09 1.0E-09\n" for i in range(3)))
    got = sorted((r.block, r.cycle, r.time_s) for r in X.drained(X.snapshot_stream(spark, str(tmp_path)), "l").collect())
    assert got == [(i, i, i * 1e-9) for i in range(3) for _ in range(2)]


@pytest.mark.parametrize("batches", [1, 3, 10])
def test_rows_in_any_batches_give_the_same(spark, tmp_path, batches):
    rng = np.random.default_rng(7)
    n = 90
    rows = pd.DataFrame({"key": np.arange(n) % 3, "n": np.arange(n), "t": np.where(np.arange(n) % 11 == 5, np.arange(n) - 7.0, np.arange(n)), "y": np.round(np.random.default_rng(1).random(n), 6)})
    rows["at"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(rows["n"], unit="s")
    rows["snapshot_index"], rows["interface_id"], rows["score"] = (rows["n"] // 9).astype("int32"), (rows["n"] % 9 // 3).astype("int32"), rows["y"]
    end = rows.iloc[:3].assign(at=pd.Timestamp("2021-01-01"), n=10_000, t=1e9, snapshot_index=np.int32(99))  # moves the watermark past all rows
    parts = [*np.array_split(rows.iloc[rng.permutation(n)], batches), end]
    for k, part in enumerate(parts):
        spark.createDataFrame(part).coalesce(1).write.parquet(f"{tmp_path}/in/{k:02d}")
    schema = spark.read.parquet(f"{tmp_path}/in/00").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    by_n = source.withColumn("t", F.col("n").cast("double"))
    got = {(r.key, r.t): r.total for r in X.drained(X.cumulative(by_n, "key", at="at", delay="1 hour"), "c").collect() if r.t < 1000}
    for k, own in rows.groupby("key"):
        for i in range(len(own)):
            assert got[k, float(own.n.iloc[i])] == pytest.approx(np.trapezoid(own.y[: i + 1], own.n[: i + 1]))
    late = sorted((r.key, r.n, r.t) for r in X.drained(X.out_of_order(source.withColumn("key", F.lit(0).cast("long")), at="at", delay="1 hour"), "o").collect() if r.n < 1000)
    assert late == [(0, i, i - 7.0) for i in range(n) if i % 11 == 5]
    fronts = {r.snapshot_index: r.track_index for r in X.drained(X.front(source.withColumn("run_id", F.lit(1).cast("long")), threshold=0.3, at="at", delay="1 hour"), "f").collect() if r.snapshot_index < 99}
    want, _ = X.Front(0.3, True, 48, 4), None
    assert fronts == dict(want.step(None, rows.sort_values(want.order))[1])


def test_many_keys_are_folded_in_few_calls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BUCKETS", 3)
    for k in range(2):  # the second batch goes on from the states of the first
        spark.createDataFrame([(i, 10 * k + j, float(i + j - 2 * k)) for i in range(200) for j in range(2)], "key long, n long, t double").coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema("key long, n long, t double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = sorted((r.key, r.n, r.t, r.latest) for r in X.drained(X.out_of_order(stream), "o").collect())
    assert got == [(i, 10 + j, float(i + j - 2), i + 1.0) for i in range(200) for j in range(2)]


def test_snapshots_of_many_logs_are_those_parsed_whole(spark, tmp_path):
    from runweave.sources import logtext

    tables = "#Zone Radius\n cm\n 1 2.0\n\n#Zone Ion energy\n J/g\n 1 3.0\n"
    for i in range(40):  # more than are looked up by the driver
        bad = "" if i % 3 else "  Cycle   Time (s)  Delta\n no numbers\n"
        (tmp_path / f"r{i}.log").write_text(f"x\n{logtext.HEADER_END}\n" + "".join(f"  Cycle   Time (s)  Delta\n {c}  {c}.5D-01  1.0-03 zone 3\n\n{tables}" for c in range(i % 4)) + bad + ("  Cycle   Time (s)" if i % 5 == 0 else ""))
    path = f"file://{tmp_path}"
    got = X.drained(X.snapshot_stream(spark, path), "many").collect()
    want = logtext.parsed(logtext.block_texts(logtext.read_logs(spark, path)).filter("block >= 0")).select("file", "block", "cycle", "time_s", "time_step_s")
    assert sorted(map(str, got)) == sorted(map(str, want.collect())) and len(got) > 60
    plan = X.snapshot_stream(spark, path)._jdf.queryExecution().toString()
    assert "table_zones" not in plan  # tables are not taken apart for their headings


def test_keys_of_a_bucket_wait_and_are_folded_together(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = pd.DataFrame({"user_id": rng.integers(0, 50, 600), "t": rng.permutation(600) + 1.0, "y": rng.random(600)})
    rows["batch"] = np.minimum(rows.t // 200 + rng.integers(0, 2, 600), 2)  # up to a batch late
    for k, part in rows.groupby("batch"):
        spark.createDataFrame(part[["user_id", "t", "y"]]).coalesce(1).write.parquet(f"{tmp_path}/in/b{int(k)}")
    stream = spark.readStream.schema("user_id long, t double, y double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    timed = X.cumulative(stream.withColumn("at", F.timestamp_seconds("t")), "user_id", at="at", delay="250 seconds")
    assert "__bucket" in timed._jdf.queryExecution().logical().toString()  # no calls to the state a key
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = X.drained(timed, "waiting").toPandas()
    passed = rows[rows.t <= rows.t.max() - 250].sort_values(["user_id", "t"])
    assert len(got) == len(passed)
    for user, own in passed.groupby("user_id"):
        assert np.isclose(got[got.user_id == user].sort_values("t").total.iloc[-1], np.trapezoid(own.y, own.t))
