"""Rules of the catalogue and the change log that the registered queries don't reach."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestore.functions import identity as I
from lodestore.functions.errors import Fault, StoreError
from lodestore.operators import catalogue as C
from lodestore.operators import changelog as L
from lodestore.sources import reports
from lodestore.sources.generations import normal_fingerprint

KEY, OTHER = "a" * 64, "b" * 64
RECORDS = "schema_version int, generation long, sequence long, key string, entry string"


def faults(spark, rows, **more):
    return sorted(((r.sequence, r.reason) for r in L.record_faults(spark.createDataFrame(rows, RECORDS), 5, **more).collect()), key=str)


def test_record_faults(spark):
    sound = [(1, 5, 1, KEY, "x"), (1, 5, 2, KEY, None), (1, 4, 1, OTHER, "old"), (1, 4, 1, KEY, "old")]
    assert faults(spark, sound) == []
    bad = [(9, 4, 7, KEY, None), (None, 5, 8, KEY, None), (1, None, 9, KEY, None), (1, 4, 0, KEY, None), (1, 5, None, KEY, None), (1, 4, 3, "short", None), (1, 5, 10, None, None), (1, 6, 11, KEY, None), (1, 5, 1, OTHER, None)]
    assert faults(spark, sound + bad) == sorted([(7, "unsupported schema"), (8, "unsupported schema"), (9, "generation"), (0, "sequence"), (None, "sequence"), (3, "key shape"), (10, "key shape"), (11, "future generation"), (1, "repeated sequence"), (1, "repeated sequence")], key=str)
    assert faults(spark, sound, most=2) == [] and faults(spark, sound, most=1) == [(None, "too many records")]
    assert faults(spark, sound, entry_key=F.when(F.col("entry") == "x", F.lit(OTHER))) == [(1, "entry key")]


def test_checked_replay(spark):
    df = lambda rows: spark.createDataFrame(rows, RECORDS)
    with pytest.raises(StoreError, match=Fault.UNSUPPORTED_SCHEMA.value):
        L.replay(df([(2, 5, 1, KEY, "x")]), 5, check=True)
    with pytest.raises(StoreError, match=Fault.INVALID_MANIFEST.value):
        L.replay(df([(1, 5, 1, KEY, "x"), (1, 5, 1, OTHER, "y")]), 5, check=True)
    twice = [(1, 5, 3, KEY, "x"), (1, 5, 3, KEY, "y"), (1, 5, 3, KEY, "z")]
    assert len({L.replay(df(rows).repartition(n), 5).first().entry for rows in (twice, twice[::-1]) for n in (1, 2, 3)}) == 1
    assert L.replay(df([(1, 5, 1, KEY, "x"), (1, 5, 2, KEY, None), (1, 5, 3, OTHER, "y")]), 5, check=True).collect() == [(OTHER, "y")]


def test_remove_partition_keeps_entries_without_one(spark):
    cat = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("c", None)], "key string, partition binary")
    assert sorted(r.key for r in C.remove_partition(cat, F.lit(b"1")).collect()) == ["b", "c"]
    assert sorted(r.key for r in C.remove_partition(cat, F.lit(None).cast("binary")).collect()) == ["a", "b"]


def test_orphans_know_all_temporary_names(spark):
    names = [".tmp-1", ".durable-tmp-2", f".manifest-entry-{KEY}.json", "kept", "staged", "lost"]
    df = lambda n: spark.createDataFrame([(x,) for x in n], "name string")
    assert sorted(r.name for r in C.orphans(df(names), df(["kept", ".tmp-1"]), df(["staged"])).collect()) == [".durable-tmp-2", ".tmp-1", "lost"]


def test_checked_arithmetic_overflows_loudly(spark):
    one = spark.range(1)
    for value in (I.checked_product(F.lit(1 << 40), F.lit(1 << 30)), I.checked_sum(F.lit((1 << 63) - 1), F.lit(1)), I.nanoseconds(F.lit(1 << 60), F.lit(0))):
        with pytest.raises(Exception, match=Fault.LIMIT_EXCEEDED.value):
            one.select(value).collect()
    assert one.select(I.checked_product(F.lit(None), F.lit(2))).first()[0] is None
    assert one.select(I.timestamp_of(F.lit(-1), F.lit(999_999_999))).selectExpr("unix_micros(*)").first()[0] == -1


def test_shards_of_any_key(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    shards = rows.select(I.shard_of(F.col("k"), 8, hashed=True).alias("s")).groupBy("s").count().collect()
    assert {r.s for r in shards} == set(range(8)) and max(r["count"] for r in shards) < 200


@pytest.mark.parametrize("text", [" a b ", "\u2003a\u3000", "\x1ca", "a\x1c", "\x85a\x85", "a\x81b", "a\x7f", "", "  ", "é" * 512, "é" * 513, "\t\x0b\x0ca\r\n"])
def test_fingerprints_agree(spark, text):
    try:
        want = normal_fingerprint(text)
    except StoreError:
        want = None
    assert spark.range(1).select(I.normal_fingerprint(F.lit(text))).first()[0] == want == I.plain_fingerprint(text)
    if want is not None:
        rows = spark.createDataFrame([(text, 1, 2)], "fingerprint string, identifier int, created_at int")
        assert L.latest_generation(rows, want).collect() == [(1, 2)]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(2, "x", None), (1, "é", 0.5)], "b int, a string, c double")
    reports.write_reports(rows.coalesce(1), str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert lines == ['{"a":"x","b":2}', '{"a":"é","b":1,"c":0.5}'] and [list(json.loads(x)) for x in lines] == [["a", "b"], ["a", "b", "c"]]


def test_path_lists(spark):
    paths = spark.createDataFrame([("b",), ("a",), ("b",), (None,), (None,)], "path string")
    assert {(r.path, r.uses) for r in C.repeated_paths(paths).collect()} == {("b", 2), (None, 2)}
    assert [r.path for r in C.unique_paths(paths).collect()] == [None, "a", "b"]


def test_trim_is_exact_at_ties(spark):
    rows = [(f"{i:04x}", 1 + i % 3, i, f"2024-01-0{1 + i % 2} 00:00:0{i % 4}") for i in range(200)]
    cat = spark.createDataFrame(rows, "key string, byte_count long, physical_id long, at string").withColumn("last_access", F.col("at").cast("timestamp_ntz")).drop("at")
    total = sum(r[1] for r in rows)
    for soft in (0, 1, 57, 200, total - 1, total):
        want, left = set(), total
        for key, size, _, _ in sorted(rows, key=lambda r: (r[3], r[0])):
            if left <= soft:
                break
            want.add(key)
            left -= size
        assert {r.key for r in C.trim(cat, soft).collect()} == want
