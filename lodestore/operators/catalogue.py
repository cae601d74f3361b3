"""The blob catalogue: commit, lookup, maintenance and audit over DataFrames.

A catalogue row is ``(key, partition, digest_hex, byte_count, physical_id,
last_access)``. Set-oriented work is joins and aggregations that Catalyst plans:
small sides are broadcast when their measured size allows, large ones are shuffled
on their keys, and AQE splits what is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions import identity as I
from lodestore.functions.errors import BLOB_BYTES_CAP, ENTRY_CAP, Fault, MaintenanceLimits, StoreError
from lodestore.sources.scratch import materialise


def describe(payloads: DataFrame, content: str, partition_material: str, physical_id: str, domain: str = "docs", namespace: str = I.NAMESPACE, last_access: Column | None = None) -> DataFrame:
    """Each payload's catalogue row, before deduplication; the content isn't kept."""
    c = F.col(content)
    rows = payloads.select(
        F.col(physical_id).alias("physical_id"),
        I.partition_id(domain, F.col(partition_material), namespace).alias("partition"),
        I.digest_hex(c).alias("digest_hex"),
        F.octet_length(c).cast("bigint").alias("byte_count"),
        *([last_access.alias("last_access")] if last_access is not None else []),
    )
    return rows.withColumn("key", I.manifest_key(F.col("partition"), I.canonical_of(F.col("digest_hex"), F.col("byte_count")), namespace))


def commit(batch: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """What a batch adds: one row for each new (partition, digest), with the smallest
    physical identifier and the number of payloads that share it. Equal digests in
    two partitions are two blobs. One shuffle, combined map-side."""
    groups = batch.groupBy("key", "partition", "digest_hex", "byte_count").agg(F.min("physical_id").alias("physical_id"), F.count("*").alias("payloads"))
    if existing is not None:
        groups = groups.join(existing.select("key"), "key", "left_anti")
    return groups


def dispositions(batch: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """For each payload of a batch the blob that holds it, and whether it was created
    by this payload or reused."""
    first = batch.groupBy("key").agg(F.min("physical_id").alias("first_id"))
    known = first if existing is None else first.join(existing.select("key", F.col("physical_id").alias("old_id")), "key", "left")
    owner = F.col("first_id") if existing is None else F.coalesce("old_id", "first_id")
    known = known.select("key", owner.alias("blob_id"))
    return batch.join(known, "key").withColumn("disposition", F.when(F.col("physical_id") == F.col("blob_id"), "created").otherwise("reused"))


def lookup(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (partition, digest_hex, byte_count) that the catalogue holds; equality
    is checked on the fields, not on the key alone."""
    return catalogue.join(wanted, ["partition", "digest_hex", "byte_count"])


def remove(catalogue: DataFrame, keys: DataFrame) -> DataFrame:
    return catalogue.join(keys.select("key"), "key", "left_anti")


def remove_partition(catalogue: DataFrame, partition: Column) -> DataFrame:
    return catalogue.where(~F.col("partition").eqNullSafe(partition))


def live_totals(live: DataFrame) -> DataFrame:
    """The number and bytes of the distinct live references."""
    distinct = live.select("partition", "digest_hex", "byte_count").distinct()
    return distinct.agg(F.count("*").alias("live_count"), F.coalesce(F.sum("byte_count"), F.lit(0)).cast("bigint").alias("live_bytes"))


def check_live(live: DataFrame, limits: MaintenanceLimits) -> None:
    """Raise before anything is changed if the live set passes its limits."""
    row = live_totals(live).first()
    if row.live_count > limits.references or row.live_bytes > limits.total_bytes:
        raise StoreError(Fault.LIMIT_EXCEEDED, f"{row.live_count} references of {row.live_bytes} bytes")


def garbage(catalogue: DataFrame, live: DataFrame) -> DataFrame:
    """Catalogue rows that no live reference names."""
    return catalogue.join(live.select("partition", "digest_hex"), ["partition", "digest_hex"], "left_anti")


def orphans(files: DataFrame, referenced: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Files ``(name, ...)`` that neither the manifest nor a pending stage names;
    temporary files always are, record files never."""
    names = referenced.select("name")
    if pending is not None:
        names = names.unionByName(pending.select("name"))
    temporary, record = F.col("name").startswith(".tmp-") | F.col("name").startswith(".durable-tmp-"), F.col("name").rlike(I.RECORD_NAME)
    return files.where(temporary).unionByName(files.where(~temporary & ~record).join(names, "name", "left_anti"))


def with_payload(catalogue: DataFrame, payloads: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """Entries whose payload exists, and is no larger than allowed."""
    rows = catalogue if most_bytes is None else catalogue.where(F.col("byte_count") <= most_bytes)
    return rows.join(payloads.select("physical_id"), "physical_id", "left_semi")


def delta(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Keys whose entry differs between two catalogues: ``(key, change)``."""
    fields = [c for c in old.columns if c != key]
    entry = lambda df, side: df.select(F.col(key), F.struct(*fields).alias(side))
    both = entry(old, "old").join(entry(new, "new"), key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(key, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def compare_coverage(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """``(path, side)``: paths that are missing or extra, repeats counted."""
    return expected.exceptAll(observed).withColumn("side", F.lit("missing")).unionByName(observed.exceptAll(expected).withColumn("side", F.lit("extra")))


def removal_summary(victims: DataFrame, *by: str) -> DataFrame:
    return victims.groupBy(*by).agg(F.count("*").alias("items"), F.coalesce(F.sum("byte_count"), F.lit(0)).cast("bigint").alias("bytes"))


def physical_removals(victims: DataFrame, payloads: DataFrame, orphan_files: DataFrame) -> DataFrame:
    """Files and bytes that go: victims whose payload exists, and orphans."""
    there = victims.join(payloads.select("physical_id"), "physical_id", "left_semi").select("byte_count")
    return removal_summary(there.unionByName(orphan_files.select("byte_count")))


def footprint(files: DataFrame) -> DataFrame:
    """Files and bytes by class."""
    kind = F.when(F.col("path").rlike(I.BLOB_NAME), "payload").otherwise("metadata")
    return files.groupBy(kind.alias("class")).agg(F.count("*").alias("files"), F.sum("length").cast("bigint").alias("bytes"))


def repeated_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """``(path, uses)`` of the paths that a list names more than once, null too."""
    return paths.groupBy(F.col(path).alias("path")).agg(F.count("*").alias("uses")).where("uses > 1")


def unique_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """The sorted list without repeats."""
    return paths.select(F.col(path).alias("path")).distinct().orderBy("path")


def maxima(samples: DataFrame, values: list[str], *by: str) -> DataFrame:
    """The largest of each measured value, by what was measured."""
    return samples.groupBy(*by).agg(*[F.max(v).alias(f"max_{v}") for v in values], F.count("*").alias("samples"))


def audit(catalogue: DataFrame, payloads: DataFrame) -> DataFrame:
    """``(key, physical_id, status)``: hit, missing, truncated or corrupt."""
    p = payloads.select("physical_id", F.octet_length("content").alias("size"), I.digest_hex(F.col("content")).alias("hash"))
    status = F.when(F.col("size").isNull(), "missing").when(F.col("size") != F.col("byte_count"), "truncated").when(F.col("hash") != F.col("digest_hex"), "corrupt").otherwise("hit")
    return catalogue.join(p, "physical_id", "left").select("key", "physical_id", status.alias("status"))


def invalid_entries(catalogue: DataFrame, namespace: str = I.NAMESPACE) -> DataFrame:
    """``(key, reason)`` of entries that break a rule of the manifest. A ``last_access``
    column, if there is one, must be known and, as a number, finite."""
    sound_time = F.lit(True)
    if "last_access" in catalogue.columns:
        at = F.col("last_access")
        sound_time = at.isNotNull()
        if catalogue.schema["last_access"].dataType.typeName() in ("double", "float"):
            sound_time = sound_time & ~F.isnan(at) & (F.abs(at) < float("inf"))
    shared = catalogue.groupBy("physical_id").agg(F.count("*").alias("uses")).where("uses > 1")
    again = I.manifest_key(F.col("partition"), I.canonical_of(F.col("digest_hex"), F.col("byte_count")), namespace)
    reason = (
        F.when(~I.is_manifest_key(F.col("key")), "key shape")
        .when(~I.is_partition(F.col("partition")), "partition width")
        .when(F.coalesce(~F.col("byte_count").between(0, BLOB_BYTES_CAP), F.lit(True)), "byte count")
        .when(~sound_time, "last access")
        .when(again != F.col("key"), "key")
        .when(F.col("uses").isNotNull(), "physical identifier")
    )
    return catalogue.join(shared, "physical_id", "left").select("key", reason.alias("reason")).where("reason is not null")


def check_catalogue(catalogue: DataFrame, entries: int = ENTRY_CAP) -> None:
    """Raise if the catalogue has too many entries, an invalid one, or bytes beyond a long."""
    row = catalogue.agg(F.count("*").alias("n"), F.sum(F.col("byte_count").cast("decimal(38,0)")).alias("b")).first()
    if row.n > entries or (row.b or 0) > I.LONG_MAX or not invalid_entries(catalogue).isEmpty():
        raise StoreError(Fault.INVALID_MANIFEST)


def trim(catalogue: DataFrame, soft_bytes: int) -> DataFrame:
    """The victims of a trim: by rising (last_access, key), an entry goes while what
    remains is over ``soft_bytes``.

    With ``excess = total - soft_bytes``, an entry is a victim iff the bytes before it
    are less than ``excess``. The border is narrowed by aggregation, to an hour, then
    to an instant, then to a prefix of the key, so only that last group's entries are
    put in order by a window; all others are decided by a filter. The catalogue is
    written to the shared folder once, as each narrowing reads it.
    """
    catalogue = materialise(catalogue, "trim")
    total = catalogue.agg(F.coalesce(F.sum("byte_count"), F.lit(0)).cast("bigint")).first()[0]
    excess = total - soft_bytes
    if excess <= 0:
        return catalogue.limit(0)
    group, before, sure = catalogue, 0, None
    for level in (F.date_trunc("hour", "last_access"), F.col("last_access"), F.substring("key", 1, 4)):
        sums = group.groupBy(level.alias("at")).agg(F.sum("byte_count").cast("bigint").alias("b"))
        so_far = Window.orderBy(F.col("at").asc_nulls_first())
        ends = sums.withColumn("end", F.sum("b").over(so_far) + F.lit(before))
        row = ends.where(F.col("end") >= excess).orderBy(F.col("at").asc_nulls_first()).first()
        earlier = group.where(F.coalesce(level < F.lit(row.at), F.lit(row.at is not None))) if row.at is not None else group.limit(0)
        sure = earlier if sure is None else sure.unionByName(earlier)
        before = row.end - row.b
        group = group.where(level.eqNullSafe(F.lit(row.at)))
    order = Window.orderBy(F.col("last_access").asc_nulls_first(), "key").rowsBetween(Window.unboundedPreceding, -1)
    last = group.withColumn("before", F.coalesce(F.sum("byte_count").over(order), F.lit(0)) + F.lit(before))
    return sure.unionByName(last.where(F.col("before") < excess).drop("before"))


def coalesce_access(events: DataFrame, key: str, ts: str, every: str = "5 minutes") -> DataFrame:
    """The latest access of each key in each interval: what is persisted of accesses."""
    at = F.col(ts).cast("timestamp")
    return events.groupBy(F.col(key), F.window(at, every).alias("w")).agg(F.max(at).alias("last_access"), F.count("*").alias("accesses")).select(key, F.col("w.start").alias("since"), "last_access", "accesses")
