from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.operators import catalogue as C
from lodestore.operators.sieve import Sieve, replay
from lodestore.streaming import replay as R


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_replay_keeps_state_between_batches(spark, tmp_path):
    rows = [(i % 2, i, "get" if i % 3 else "put", str(i % 7), i % 5) for i in range(200)]
    schema = "shard int, seq long, op string, key string, cost long"
    for part in range(4):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "t"))
    run(R.replay_stream(stream, 9), "replayed")
    caches = [Sieve(9), Sieve(9)]
    want = {seq: caches[s].apply(op, k, c)[0] for s, seq, op, k, c in rows}
    assert {r.seq: r.hit for r in spark.table("replayed").collect()} == want


def test_streamed_global_operations_equal_the_batch_replay(spark, tmp_path):
    rows = [(i % 4 if i % 25 else None, i, ["put", "get", "put", "remove"][i % 4] if i % 25 else ["resize", "clear", "purge"][i // 25 % 3], str(i * 7 % 23), 1 + i % 3 if i % 25 else 40 + i) for i in range(300)]
    schema = "shard int, seq long, op string, key string, cost long"
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    run(R.replay_stream(stream, 60, 4), "replayed_globally")
    got = sorted(map(tuple, spark.table("replayed_globally").collect()), key=lambda r: (r[1], r[0]))
    want = replay(spark.createDataFrame(rows, schema), 60, 4).collect()
    assert got == sorted(map(tuple, want), key=lambda r: (r[1], r[0])) and len(got) == 300 + 3 * 12


def test_commits_are_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "a", "s"), (3, "b", "s")], "doc_id long, text string, source string")
    batch = C.describe(docs, "text", "source", "doc_id")
    out = str(tmp_path / "cat")
    read = lambda: spark.read.parquet(out) if (tmp_path / "cat").exists() else None
    each = R.commit_batches(read, lambda rows, epoch: rows.write.mode("append").parquet(out))
    each(batch, 0)
    each(batch, 0)
    assert sorted(r.physical_id for r in spark.read.parquet(out).collect()) == [1, 3]


def test_access_coalescing_stream(spark, tmp_path):
    spark.sql("SELECT 1L AS k, timestamp'2024-01-01 00:01:00' AS ts UNION ALL SELECT 1L, timestamp'2024-01-01 00:04:00' UNION ALL SELECT 2L, timestamp'2024-01-01 02:00:00'").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "e"))
    run(R.coalesce_access_stream(stream, "k", "ts"), "coalesced", "complete")
    got = {(r.k, r.accesses) for r in spark.table("coalesced").where(F.col("accesses") > 0).collect()}
    assert got == {(1, 2), (2, 1)}
