"""The manifest change log: replay, compaction and generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.functions import identity as I
from lodestore.functions.errors import RECORD_CAP, Fault, StoreError

RECORD_SCHEMA, SNAPSHOT_SCHEMA = 1, 2


def record_faults(records: DataFrame, generation: int, most: int | None = None, entry_key: Column | None = None) -> DataFrame:
    """``(sequence, key, reason)`` of records ``(schema_version, generation, sequence,
    key, entry)`` that make a replay fail.

    Schema, key and sequence must be sound in every record; one of an older generation
    is otherwise none's business. Of the others the generation must be the given one, no
    sequence may repeat, an entry's own key (``entry_key``) must be the record's, and
    there may be ``most`` at most: if there are more, a row without sequence and key says
    so. What is null is not sound.
    """
    current = F.col("generation").isNull() | (F.col("generation") >= generation)
    repeated = records.where(current).groupBy("sequence").agg(F.count("*").alias("uses")).where("uses > 1")
    reason = (
        F.when(~F.col("schema_version").eqNullSafe(RECORD_SCHEMA), "unsupported schema")
        .when(~I.is_manifest_key(F.col("key")), "key shape")
        .when(F.coalesce(F.col("sequence") <= 0, F.lit(True)), "sequence")
        .when(F.col("generation").isNull(), "generation")
        .when(F.col("generation") < generation, F.lit(None))
        .when(F.col("generation") > generation, "future generation")
        .when(F.col("uses").isNotNull(), "repeated sequence")
    )
    if entry_key is not None:
        reason = reason.when(F.col("entry").isNotNull() & ~entry_key.eqNullSafe(F.col("key")), "entry key")
    faults = records.join(repeated, "sequence", "left").select("sequence", "key", reason.alias("reason")).where("reason is not null")
    if most is not None:
        n = records.where(F.col("generation") == generation).agg(F.count("*").alias("n")).where(F.col("n") > most)
        faults = faults.unionByName(n.select(F.lit(None).cast("bigint").alias("sequence"), F.lit(None).cast("string").alias("key"), F.lit("too many records").alias("reason")))
    return faults


def check_records(records: DataFrame, generation: int, most: int | None = RECORD_CAP, entry_key: Column | None = None) -> None:
    bad = record_faults(records, generation, most, entry_key).first()
    if bad is not None:
        fault = Fault.UNSUPPORTED_SCHEMA if bad.reason == "unsupported schema" else Fault.INVALID_MANIFEST
        raise StoreError(fault, f"record {bad.sequence}: {bad.reason}")


def replay(records: DataFrame, generation: int | None = None, snapshot: DataFrame | None = None, check: bool = False) -> DataFrame:
    """``(key, entry)`` after the records of ``generation`` in sequence: the last one of
    each key wins, a null entry removes it. One aggregation without a sort; the
    snapshot's entries take part as sequence 0. With ``check`` faulty records are an
    error; without, of equal sequences the entry with the larger hash wins, so reruns
    agree."""
    if check:
        check_records(records, generation)
    rows = records if generation is None else records.where(F.col("generation") == generation)
    rows = rows.select("key", "sequence", "entry")
    if snapshot is not None:
        rows = rows.unionByName(snapshot.select("key", F.lit(0).cast("bigint").alias("sequence"), "entry"))
    last = rows.groupBy("key").agg(F.max_by(F.struct("entry"), F.struct("sequence", F.xxhash64("entry"))).alias("last"))
    return last.select("key", F.col("last.entry").alias("entry")).where("entry is not null")


def persist_plan(changes: int, records: int, sequence: int, record_cap: int = RECORD_CAP) -> str:
    """How a change is made durable: nothing, one record, or a new snapshot."""
    if changes == 0:
        return "none"
    if changes == 1 and records < record_cap and sequence < I.LONG_MAX:
        return "record"
    return "checkpoint"


def latest_generation(generations: DataFrame, fingerprint: str) -> DataFrame:
    """The newest generation with this fingerprint; of equally new ones the last by name."""
    if I.plain_fingerprint(fingerprint) != fingerprint:
        return generations.limit(0).select("identifier", "created_at")  # no normal form equals it
    fits = generations.where(I.bare_fingerprint(F.col("fingerprint")) == fingerprint)
    best = fits.groupBy().agg(F.max(F.struct("created_at", "identifier")).alias("g"))
    return best.where("g is not null").select("g.identifier", "g.created_at")


def generation_status(generations: DataFrame, schema: int = 1) -> DataFrame:
    """Whether each generation can be opened: ``(identifier, status)``."""
    status = F.when(F.col("schema_version") > schema, "unsupportedSchema").when(F.col("schema_version") < schema, "invalidManifest").when(I.normal_fingerprint(F.col("fingerprint")).isNull(), "invalidManifest").otherwise("valid")
    return generations.select("identifier", status.alias("status"))
