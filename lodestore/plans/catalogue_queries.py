"""Registered catalogue queries and their DuckDB twins.

The catalogue's relations are derived from the given tables: payloads are the
``documents``' texts, partitions their sources, live references the labelled
documents, the change log and access traces the ``events``, generations the
``orders``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.functions import identity as I
from lodestore.operators import catalogue as C
from lodestore.operators import changelog as L
from lodestore.operators import sieve as S
from lodestore.sources import payloads as P
from lodestore.sources import reports as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PARTITION_SQL = f"sha256('{I.NAMESPACE}-{I.PARTITION_TAG}\\x00docs\\x00'::blob || encode(source))"
CANONICAL_SQL = "'sha256:' || sha256(text) || ':' || strlen(text)"
KEY_SQL = f"sha256('{I.NAMESPACE}-{I.KEY_TAG}\\x00'::blob || unhex({PARTITION_SQL}) || '\\x00'::blob || encode({CANONICAL_SQL}))"
BATCH_SQL = f"batch AS (SELECT doc_id, {PARTITION_SQL} AS part, sha256(text) AS digest_hex, CAST(strlen(text) AS BIGINT) AS byte_count, {KEY_SQL} AS key FROM documents)"
CATALOGUE_SQL = f"WITH {BATCH_SQL}, cat AS (SELECT key, part, digest_hex, byte_count, min(doc_id) AS physical_id, count(*) AS payloads FROM batch GROUP BY ALL)"


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.describe(_table(spark, sf_dir, "documents"), "text", "source", "doc_id")


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.commit(_batch(spark, sf_dir))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("physical_id"))
    return _batch(spark, sf_dir).join(labelled, "physical_id", "left_semi").select("partition", "digest_hex", "byte_count").distinct()


def _hex(df: DataFrame) -> DataFrame:
    return df.withColumn("partition", F.lower(F.hex("partition")))


# ------------------------------------------------------------------ identities


@query(f"SELECT doc_id, {CANONICAL_SQL} AS canonical, CAST(strlen(text) AS BIGINT) AS byte_count FROM documents")
def blob_digest(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", I.canonical(F.col("text")).alias("canonical"), F.octet_length("text").cast("bigint").alias("byte_count"))


@query(f"SELECT DISTINCT source, {PARTITION_SQL} AS partition FROM documents")
def partition_derive(spark, sf_dir):
    sources = _table(spark, sf_dir, "documents").select("source").distinct()
    return _hex(sources.select("source", I.partition_id("docs", F.col("source")).alias("partition")))


@query(f"SELECT doc_id, {KEY_SQL} AS key FROM documents")
def manifest_key(spark, sf_dir):
    return _batch(spark, sf_dir).select(F.col("physical_id").alias("doc_id"), "key")


_FORMS_SQL = f"SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN {CANONICAL_SQL} WHEN 1 THEN upper({CANONICAL_SQL}) WHEN 2 THEN 'sha256:' || sha256(text) || ':0' || strlen(text) WHEN 3 THEN 'sha256:' || sha256(text) || ':-1' WHEN 4 THEN 'sha256:' || sha256(text) || ':9223372036854775808' WHEN 5 THEN 'sha512:' || sha256(text) || ':1' WHEN 6 THEN 'sha256:' || substr(sha256(text), 2) || ':1' ELSE 'sha256:' || sha256(text) || ':9223372036854775807' END AS form FROM documents"


@query(f"SELECT doc_id, ok AS valid, CASE WHEN ok THEN split_part(form, ':', 2) END AS digest_hex, CASE WHEN ok THEN TRY_CAST(split_part(form, ':', 3) AS BIGINT) END AS byte_count FROM (SELECT doc_id, form, regexp_full_match(form, 'sha256:[0-9a-f]{{64}}:(0|[1-9][0-9]*)') AND TRY_CAST(split_part(form, ':', 3) AS BIGINT) IS NOT NULL AS ok FROM ({_FORMS_SQL}))")
def digest_parse(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    text, k = I.canonical(F.col("text")), F.col("doc_id") % 8
    h = I.digest_hex(F.col("text"))
    tail = lambda size: F.concat(F.lit("sha256:"), h, F.lit(":"), size)
    form = F.when(k == 0, text).when(k == 1, F.upper(text)).when(k == 2, tail(F.concat(F.lit("0"), F.octet_length("text").cast("string")))).when(k == 3, tail(F.lit("-1")))
    form = form.when(k == 4, tail(F.lit("9223372036854775808"))).when(k == 5, F.concat(F.lit("sha512:"), h, F.lit(":1"))).when(k == 6, F.concat(F.lit("sha256:"), F.substring(h, 2, 63), F.lit(":1"))).otherwise(tail(F.lit("9223372036854775807")))
    rows = d.select("doc_id", form.alias("form"))
    parsed = I.parse_canonical(F.col("form"))
    return rows.select("doc_id", I.is_canonical(F.col("form")).alias("valid"), parsed["digest_hex"].alias("digest_hex"), parsed["byte_count"].alias("byte_count"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 3 THEN NULL ELSE o_orderpriority END AS fingerprint FROM orders")
def fingerprint_normalize(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.col("o_orderpriority")).when(k == 1, F.concat(F.lit(" \t\n"), "o_orderpriority", F.lit("  "))).when(k == 2, F.concat(F.lit(" "), "o_orderpriority")).when(k == 3, F.concat("o_orderpriority", F.lit("\x01x"))).otherwise(F.lit(" \n "))
    return _table(spark, sf_dir, "orders").select("o_orderkey", I.normal_fingerprint(raw).alias("fingerprint"))


@query("SELECT o_orderkey, least(1099511627776, greatest(1, (o_orderkey - 100) * 1000000007)) AS soft_bytes, least(least(1099511627776, greatest(1, (o_orderkey - 100) * 1000000007)), least(1073741824, greatest(1, o_orderkey * 100003))) AS blob_bytes FROM orders")
def limit_clamp(spark, sf_dir):
    soft = I.clamped((F.col("o_orderkey") - 100) * 1000000007, 1 << 40)
    return _table(spark, sf_dir, "orders").select("o_orderkey", soft.alias("soft_bytes"), F.least(soft, I.clamped(F.col("o_orderkey") * 100003, 1 << 30)).alias("blob_bytes"))


@query("SELECT event_id, greatest(1, CAST(ceil(value) AS BIGINT) - 50) AS cost FROM events")
def cost_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", I.normal_cost(F.ceil("value").cast("bigint") - 50).alias("cost"))


@query("SELECT event_id, CASE WHEN a > 9223372036854775807 - b THEN 9223372036854775807 ELSE a + b END AS total FROM (SELECT event_id, 9223372036854774000 + event_id % 1000 AS a, event_id % 700 * 3 AS b FROM events)")
def saturating_sum(spark, sf_dir):
    a, b = F.lit(9223372036854774000) + F.col("event_id") % 1000, F.col("event_id") % 700 * 3
    return _table(spark, sf_dir, "events").select("event_id", I.saturating_add(a, b).alias("total"))


@query("SELECT user_id, CAST(user_id % 8 AS INTEGER) AS shard, CAST(((user_id % 6) + 6) % 6 AS INTEGER) AS shard_of_six FROM (SELECT DISTINCT user_id FROM events)")
def shard_route(spark, sf_dir):
    users = _table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", I.shard_of(F.col("user_id"), 8).alias("shard"), I.shard_of(F.col("user_id"), 6).alias("shard_of_six"))


# ------------------------------------------------------------- commit and lookup


@query(f"{CATALOGUE_SQL} SELECT key, part AS partition, digest_hex, byte_count, physical_id, payloads FROM cat")
def commit_dedup(spark, sf_dir):
    return _hex(_catalogue(spark, sf_dir)).select("key", "partition", "digest_hex", "byte_count", "physical_id", "payloads")


@query(f"WITH {BATCH_SQL}, old AS (SELECT DISTINCT key FROM batch WHERE doc_id % 2 = 0) SELECT key, min(doc_id) AS physical_id, count(*) AS payloads FROM batch WHERE doc_id % 2 = 1 AND key NOT IN (SELECT key FROM old) GROUP BY key")
def commit_incremental(spark, sf_dir):
    batch = _batch(spark, sf_dir)
    old = C.commit(batch.where("physical_id % 2 = 0"))
    return C.commit(batch.where("physical_id % 2 = 1"), old).select("key", "physical_id", "payloads")


@query(f"WITH {BATCH_SQL} SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS blob_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY key) THEN 'created' ELSE 'reused' END AS disposition FROM batch")
def commit_dispositions(spark, sf_dir):
    return C.dispositions(_batch(spark, sf_dir)).select(F.col("physical_id").alias("doc_id"), "blob_id", "disposition")


@query(f"{CATALOGUE_SQL} SELECT key, physical_id, byte_count FROM cat WHERE (part, digest_hex, byte_count) IN (SELECT part, digest_hex, byte_count FROM batch WHERE doc_id % 97 = 5)")
def point_lookup(spark, sf_dir):
    wanted = _batch(spark, sf_dir).where("physical_id % 97 = 5").select("partition", "digest_hex", "byte_count").distinct()
    return C.lookup(_catalogue(spark, sf_dir), wanted).select("key", "physical_id", "byte_count")


@query("SELECT doc_id, CASE WHEN strlen(text) > 4096 THEN 'limitExceeded' WHEN strlen(text) <> n_chars THEN 'integrityMismatch' ELSE 'ok' END AS status FROM documents")
def bounded_read(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("length"), "n_chars")
    return rows.select("doc_id", P.read_status(F.col("length"), 4096, F.col("n_chars")).alias("status"))


# --------------------------------------------------------------- maintenance


@query(f"{CATALOGUE_SQL}, live AS (SELECT DISTINCT part, digest_hex FROM batch WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT key, physical_id, byte_count FROM cat ANTI JOIN live USING (part, digest_hex)")
def gc_victims(spark, sf_dir):
    return C.garbage(_catalogue(spark, sf_dir), _live(spark, sf_dir)).select("key", "physical_id", "byte_count")


@query(f"WITH {BATCH_SQL}, live AS (SELECT DISTINCT part, digest_hex, byte_count FROM batch WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT count(*) AS live_count, CAST(coalesce(sum(byte_count), 0) AS BIGINT) AS live_bytes FROM live")
def live_totals(spark, sf_dir):
    return C.live_totals(_live(spark, sf_dir))


def _files(spark, sf_dir):
    prefix = F.when(F.col("doc_id") % 2 == 0, F.lit(".tmp-")).otherwise(F.lit(".durable-tmp-"))
    name = F.when(F.col("doc_id") % 11 == 0, F.concat(prefix, F.col("doc_id").cast("string"))).when(F.col("doc_id") % 11 == 1, F.concat(F.lit(".manifest-entry-"), I.digest_hex(F.col("text")), F.lit(".json"))).otherwise(F.col("doc_id").cast("string"))
    return _table(spark, sf_dir, "documents").select(name.alias("name"), F.octet_length("text").cast("bigint").alias("byte_count"))


@query("SELECT name, byte_count FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN '.tmp-' ELSE '.durable-tmp-' END || doc_id WHEN doc_id % 11 = 1 THEN '.manifest-entry-' || sha256(text) || '.json' ELSE CAST(doc_id AS VARCHAR) END AS name, CAST(strlen(text) AS BIGINT) AS byte_count, doc_id FROM documents) WHERE doc_id % 11 = 0 OR (doc_id % 11 > 1 AND doc_id % 3 <> 0 AND doc_id % 10 <> 7)")
def orphans(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    named = lambda cond: d.where(cond).select(F.col("doc_id").cast("string").alias("name"))
    return C.orphans(_files(spark, sf_dir), named("doc_id % 3 = 0"), named("doc_id % 10 = 7"))


@query(f"{CATALOGUE_SQL} SELECT key, physical_id FROM cat WHERE physical_id % 7 <> 3 AND byte_count <= 8192")
def reconcile_open(spark, sf_dir):
    payloads = _table(spark, sf_dir, "documents").where("doc_id % 7 <> 3").select(F.col("doc_id").alias("physical_id"))
    return C.with_payload(_catalogue(spark, sf_dir), payloads, 8192).select("key", "physical_id")


@query(f"{CATALOGUE_SQL} SELECT key, CASE WHEN physical_id % 5 = 0 THEN 'removed' WHEN physical_id % 5 = 1 THEN 'added' ELSE 'changed' END AS change FROM cat WHERE physical_id % 5 IN (0, 1, 2)")
def manifest_delta(spark, sf_dir):
    cat = _catalogue(spark, sf_dir).select("key", "physical_id", "byte_count")
    new = cat.where("physical_id % 5 <> 0").withColumn("byte_count", F.when(F.col("physical_id") % 5 == 2, F.col("byte_count") + 1).otherwise(F.col("byte_count")))
    return C.delta(cat.where("physical_id % 5 <> 1"), new)


@query(f"{CATALOGUE_SQL} SELECT CAST(sum(CASE WHEN physical_id % 5 = 2 THEN byte_count + 1 ELSE byte_count END) AS BIGINT) AS bytes, count(*) AS files FROM cat WHERE physical_id % 5 IN (1, 2)")
def metadata_write_bytes(spark, sf_dir):
    cat = _catalogue(spark, sf_dir).select("key", "physical_id", "byte_count")
    new = cat.where("physical_id % 5 <> 0").withColumn("byte_count", F.when(F.col("physical_id") % 5 == 2, F.col("byte_count") + 1).otherwise(F.col("byte_count")))
    written = C.delta(cat.where("physical_id % 5 <> 1"), new).where("change <> 'removed'")
    return new.join(written, "key").agg(F.sum("byte_count").cast("bigint").alias("bytes"), F.count("*").alias("files"))


@query("SELECT * FROM ((SELECT CAST(doc_id AS VARCHAR) AS path, 'missing' AS side FROM documents WHERE doc_id % 4 = 0 AND doc_id % 3 <> 0) UNION ALL (SELECT CAST(doc_id AS VARCHAR), 'extra' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0))")
def coverage_compare(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    paths = lambda cond: d.where(cond).select(F.col("doc_id").cast("string").alias("path"))
    return C.compare_coverage(paths("doc_id % 3 = 0"), paths("doc_id % 4 = 0"))


@query(f"{CATALOGUE_SQL} SELECT count(*) AS entries, CAST(sum(byte_count) AS BIGINT) AS total_bytes, count(DISTINCT physical_id) AS physical_ids FROM cat")
def catalogue_total(spark, sf_dir):
    return _catalogue(spark, sf_dir).agg(F.count("*").alias("entries"), F.sum("byte_count").cast("bigint").alias("total_bytes"), F.count_distinct("physical_id").alias("physical_ids"))


@query(f"{CATALOGUE_SQL}, live AS (SELECT DISTINCT part, digest_hex FROM batch WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT part AS partition, count(*) AS items, CAST(sum(byte_count) AS BIGINT) AS bytes FROM cat ANTI JOIN live USING (part, digest_hex) GROUP BY part")
def removal_summary(spark, sf_dir):
    return _hex(C.removal_summary(C.garbage(_catalogue(spark, sf_dir), _live(spark, sf_dir)), "partition"))


@query(f"{CATALOGUE_SQL}, live AS (SELECT DISTINCT part, digest_hex FROM batch WHERE doc_id IN (SELECT doc_id FROM labels)), gone AS (SELECT byte_count FROM cat ANTI JOIN live USING (part, digest_hex) WHERE physical_id % 7 <> 3 UNION ALL SELECT strlen(text) FROM documents WHERE doc_id % 13 = 4) SELECT count(*) AS items, CAST(sum(byte_count) AS BIGINT) AS bytes FROM gone")
def gc_physical_removals(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    payloads = d.where("doc_id % 7 <> 3").select(F.col("doc_id").alias("physical_id"))
    files = d.where("doc_id % 13 = 4").select(F.octet_length("text").cast("bigint").alias("byte_count"))
    return C.physical_removals(C.garbage(_catalogue(spark, sf_dir), _live(spark, sf_dir)), payloads, files)


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'payload' ELSE 'metadata' END AS class, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def footprint(spark, sf_dir):
    uuid = F.concat(F.lit("/store/blobs/00000000-0000-4000-8000-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    path = F.when(F.col("doc_id") % 3 == 0, uuid).when(F.col("doc_id") % 3 == 1, F.lit("/store/manifest.json")).otherwise(F.upper(uuid))
    return C.footprint(_table(spark, sf_dir, "documents").select(path.alias("path"), F.octet_length("text").alias("length")))


@query(f"{CATALOGUE_SQL}, p AS (SELECT doc_id AS physical_id, CASE WHEN doc_id % 9 = 1 THEN substr(text, 1, length(text) - 1) WHEN doc_id % 9 = 2 THEN reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 9 <> 0) SELECT key, physical_id, CASE WHEN text IS NULL THEN 'missing' WHEN strlen(text) <> byte_count THEN 'truncated' WHEN sha256(text) <> digest_hex THEN 'corrupt' ELSE 'hit' END AS status FROM cat LEFT JOIN p USING (physical_id)")
def integrity_audit(spark, sf_dir):
    return C.audit(_catalogue(spark, sf_dir), _damaged(spark, sf_dir))


def _damaged(spark, sf_dir):
    k, text = F.col("doc_id") % 9, F.col("text")
    content = F.when(k == 1, F.expr("substr(text, 1, char_length(text) - 1)")).when(k == 2, F.reverse(text)).otherwise(text)
    return _table(spark, sf_dir, "documents").where(k != 0).select(F.col("doc_id").alias("physical_id"), content.alias("content"))


@query(f"{CATALOGUE_SQL}, p AS (SELECT doc_id AS physical_id, CASE WHEN doc_id % 9 = 1 THEN substr(text, 1, length(text) - 1) WHEN doc_id % 9 = 2 THEN reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 9 <> 0) SELECT key FROM cat JOIN p USING (physical_id) WHERE strlen(text) = byte_count AND sha256(text) = digest_hex")
def drop_corrupt(spark, sf_dir):
    cat = _catalogue(spark, sf_dir)
    return C.remove(cat, C.audit(cat, _damaged(spark, sf_dir)).where("status <> 'hit'")).select("key")


@query(f"{CATALOGUE_SQL} SELECT key FROM cat WHERE part <> (SELECT {PARTITION_SQL} FROM (SELECT 'src3' AS source))")
def remove_partition(spark, sf_dir):
    return C.remove_partition(_catalogue(spark, sf_dir), I.partition_id("docs", F.lit("src3"))).select("key")


@query(f"{CATALOGUE_SQL} SELECT key FROM cat WHERE key NOT IN (SELECT key FROM batch WHERE doc_id % 10 = 1)")
def remove_keys(spark, sf_dir):
    return C.remove(_catalogue(spark, sf_dir), _batch(spark, sf_dir).where("physical_id % 10 = 1").select("key").distinct()).select("key")


@query(f"{CATALOGUE_SQL}, bad AS (SELECT CASE WHEN physical_id % 10 = 1 THEN upper(key) WHEN physical_id % 10 = 2 THEN substr(key, 2) ELSE key END AS key, physical_id, CASE WHEN physical_id % 10 = 3 THEN -byte_count - 1 WHEN physical_id % 10 = 4 THEN byte_count + 1 WHEN physical_id % 10 = 5 THEN 1073741825 ELSE byte_count END AS byte_count FROM cat) SELECT key, CASE physical_id % 10 WHEN 1 THEN 'key shape' WHEN 2 THEN 'key shape' WHEN 3 THEN 'byte count' WHEN 5 THEN 'byte count' WHEN 6 THEN 'last access' WHEN 7 THEN 'last access' ELSE 'key' END AS reason FROM bad WHERE physical_id % 10 BETWEEN 1 AND 7")
def entry_validation(spark, sf_dir):
    k = F.col("physical_id") % 10
    cat = _catalogue(spark, sf_dir).withColumn("key", F.when(k == 1, F.upper("key")).when(k == 2, F.expr("substr(key, 2)")).otherwise(F.col("key")))
    size = F.when(k == 3, -F.col("byte_count") - 1).when(k == 4, F.col("byte_count") + 1).when(k == 5, F.lit((1 << 30) + 1)).otherwise(F.col("byte_count"))
    at = F.when(k == 6, F.lit(None)).when(k == 7, F.lit(float("inf"))).otherwise(F.lit(1.5))
    return C.invalid_entries(cat.withColumn("byte_count", size).withColumn("last_access", at.cast("double")))


def _accessed(spark, sf_dir):
    """The catalogue with the last access of the user of the same number."""
    last = _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("physical_id")).agg(F.max("ts").alias("seen"))
    opened = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    return _catalogue(spark, sf_dir).join(last, "physical_id", "left").withColumn("last_access", I.effective_access(opened, F.col("seen"))).select("key", "physical_id", "byte_count", "last_access")


_ACCESSED_SQL = f"{CATALOGUE_SQL}, seen AS (SELECT user_id AS physical_id, max(ts) AS seen FROM events GROUP BY user_id), acc AS (SELECT key, physical_id, byte_count, greatest(TIMESTAMP '2020-01-01 00:00:00', coalesce(seen, TIMESTAMP '2020-01-01 00:00:00')) AS last_access FROM cat LEFT JOIN seen USING (physical_id))"


@query(f"{_ACCESSED_SQL} SELECT key, physical_id, last_access FROM acc")
def effective_access(spark, sf_dir):
    return _accessed(spark, sf_dir).select("key", "physical_id", "last_access")


@query(f"{_ACCESSED_SQL} SELECT key, physical_id, byte_count FROM (SELECT *, sum(byte_count) OVER () AS total, coalesce(sum(byte_count) OVER (ORDER BY last_access, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM acc) WHERE total - before > 1000000")
def trim_recency(spark, sf_dir):
    return C.trim(_accessed(spark, sf_dir), 1_000_000).select("key", "physical_id", "byte_count")


@query(f"{_ACCESSED_SQL} SELECT key, last_access, byte_count FROM acc ORDER BY last_access, key LIMIT 100")
def oldest_entries(spark, sf_dir):
    return _accessed(spark, sf_dir).orderBy("last_access", "key").limit(100).select("key", "last_access", "byte_count")


@query("SELECT user_id, time_bucket(INTERVAL '5 minutes', ts) AS since, max(ts) AS last_access, count(*) AS accesses FROM events GROUP BY 1, 2")
def access_coalesce(spark, sf_dir):
    out = C.coalesce_access(_table(spark, sf_dir, "events"), "user_id", "ts")
    return out.select("user_id", F.col("since").cast("timestamp_ntz").alias("since"), F.col("last_access").cast("timestamp_ntz").alias("last_access"), "accesses")


@query("SELECT user_id, max(ts) AS last_access FROM events GROUP BY user_id")
def record_access(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_access"))


@query("SELECT CAST(sum(CASE WHEN doc_id % 3 = 0 THEN strlen(text) ELSE 0 END) AS BIGINT) AS payload, CAST(sum(CASE WHEN doc_id % 3 <> 0 THEN strlen(text) ELSE 0 END) AS BIGINT) AS metadata, CAST(sum(strlen(text)) AS DOUBLE) / CAST(sum(CASE WHEN doc_id % 3 = 0 THEN strlen(text) ELSE 0 END) AS DOUBLE) AS amplification FROM documents")
def write_amplification(spark, sf_dir):
    size = F.octet_length("text").cast("bigint")
    sums = _table(spark, sf_dir, "documents").agg(F.sum(F.when(F.col("doc_id") % 3 == 0, size).otherwise(0)).cast("bigint").alias("payload"), F.sum(F.when(F.col("doc_id") % 3 != 0, size).otherwise(0)).cast("bigint").alias("metadata"))
    return sums.withColumn("amplification", (F.col("payload") + F.col("metadata")).cast("double") / F.col("payload").cast("double"))


@query("SELECT event_type, CAST(user_id % 10 AS BIGINT) AS round, count(*) AS trials, count_if(value > 50) AS hits, count_if(NOT value > 50) AS misses FROM events GROUP BY 1, 2")
def campaign_rollup(spark, sf_dir):
    hit = F.col("value") > 50
    return _table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 10).alias("round")).agg(F.count("*").alias("trials"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_histogram(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS fingerprint, count(*) AS successes, count(DISTINCT o_custkey) AS identifiers, max(o_orderkey) AS largest FROM orders GROUP BY 1")
def contention_convergence(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("fingerprint")).agg(F.count("*").alias("successes"), F.count_distinct("o_custkey").alias("identifiers"), F.max("o_orderkey").alias("largest"))


@query("SELECT source, url AS path, uses FROM (SELECT 'pages' AS source, url, count(*) AS uses FROM pages GROUP BY url HAVING count(*) > 1)")
def path_uniqueness(spark, sf_dir):
    return C.repeated_paths(_table(spark, sf_dir, "pages"), "url").select(F.lit("pages").alias("source"), "path", "uses")


@query("SELECT event_type, CAST(user_id % 4 AS BIGINT) AS workload, max(value) AS max_value, max(event_id) AS max_event_id, count(*) AS samples FROM events GROUP BY 1, 2")
def resource_maxima(spark, sf_dir):
    samples = _table(spark, sf_dir, "events").withColumn("workload", F.col("user_id") % 4)
    return C.maxima(samples, ["value", "event_id"], "event_type", "workload")


@query("SELECT '{\"bytes\":' || CAST(sum(strlen(text)) AS BIGINT) || ',\"files\":' || count(*) || ',\"source\":\"' || source || '\"}' AS value FROM documents WHERE source IS NOT NULL GROUP BY source")
def json_report(spark, sf_dir):
    """Keys are sorted, whatever the columns' order."""
    rows = _table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"))
    return R.report_lines(rows)


@query("SELECT event_id, s * 1000000000 + us * 1000 AS ns, make_timestamp(s * 1000000 + us) AS at FROM (SELECT event_id, epoch_us(ts) // 1000000 AS s, event_id % 1000000 AS us FROM events)")
def time_conversion(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    s, us = F.unix_seconds(F.col("ts").cast("timestamp")), F.col("event_id") % 1_000_000
    return e.select("event_id", I.nanoseconds(s, us).alias("ns"), I.timestamp_of(s, us * 1_000 + 999).cast("timestamp_ntz").alias("at"))


@query("SELECT o_orderkey, o_orderkey * 4096 AS product, o_orderkey + 9223372036854000000 AS total FROM orders")
def checked_arithmetic(spark, sf_dir):
    key = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey", I.checked_product(key, F.lit(4096)).alias("product"), I.checked_sum(key, F.lit(9223372036854000000)).alias("total"))


# ----------------------------------------------------------------- change log


def _records(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    entry = F.when(F.col("event_type") != "error", F.struct(F.col("event_type"), F.col("value")))
    return e.select(F.lit(1).alias("schema_version"), F.when(F.col("event_id") % 10 == 0, 1).otherwise(2).cast("bigint").alias("generation"), (F.col("event_id") + 1).alias("sequence"), F.sha2(F.col("user_id").cast("string"), 256).alias("key"), entry.alias("entry"))


_RECORDS_SQL = "WITH rec AS (SELECT sha256(CAST(user_id AS VARCHAR)) AS key, event_id + 1 AS sequence, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 2 END AS generation, event_type, value FROM events)"


@query(f"{_RECORDS_SQL}, last AS (SELECT key, arg_max(event_type, sequence) AS event_type, arg_max(value, sequence) AS value FROM rec WHERE generation = 2 GROUP BY key) SELECT key, event_type, value FROM last WHERE event_type <> 'error'")
def manifest_replay(spark, sf_dir):
    return L.replay(_records(spark, sf_dir), 2).select("key", "entry.*")


@query(f"{_RECORDS_SQL}, snap AS (SELECT DISTINCT key, 0 AS sequence, 'snapshot' AS event_type, 0.5 AS value FROM rec WHERE generation = 1), both_ AS (SELECT key, sequence, event_type, value FROM rec WHERE generation = 2 UNION ALL SELECT * FROM snap), last AS (SELECT key, arg_max(event_type, sequence) AS event_type, CAST(arg_max(value, sequence) AS DOUBLE) AS value FROM both_ GROUP BY key) SELECT CAST(3 AS BIGINT) AS generation, key, event_type, value FROM last WHERE event_type <> 'error'")
def manifest_checkpoint(spark, sf_dir):
    rec = _records(spark, sf_dir)
    snap = rec.where("generation = 1").select("key", F.struct(F.lit("snapshot").alias("event_type"), F.lit(0.5).alias("value")).alias("entry")).distinct()
    return L.replay(rec, 2, snap).select(F.lit(3).cast("bigint").alias("generation"), "key", "entry.*")


@query("SELECT CASE WHEN event_id % 20 = 7 THEN 0 WHEN event_id % 20 = 9 THEN 1000000007 ELSE event_id + 1 END AS sequence, CASE WHEN event_id % 20 = 5 THEN 'short' ELSE sha256(CAST(user_id AS VARCHAR)) END AS key, CASE WHEN event_id % 20 = 1 THEN 'unsupported schema' WHEN event_id % 20 = 3 THEN 'future generation' WHEN event_id % 20 = 7 THEN 'sequence' WHEN event_id % 20 = 5 THEN 'key shape' ELSE 'repeated sequence' END AS reason FROM events WHERE event_id % 20 IN (1, 3, 5, 7, 9) UNION ALL SELECT CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 'too many records' FROM (SELECT count(*) AS n FROM events WHERE event_id % 10 <> 0 AND event_id % 20 <> 3) WHERE n > 512")
def record_validation(spark, sf_dir):
    k = (F.col("sequence") - 1) % 20
    rec = _records(spark, sf_dir)
    rec = rec.select(F.when(k == 1, 9).otherwise(1).alias("schema_version"), F.when(k == 3, F.lit(5)).otherwise(F.col("generation")).cast("bigint").alias("generation"), F.when(k == 7, F.lit(0)).when(k == 9, F.lit(1000000007)).otherwise(F.col("sequence")).cast("bigint").alias("sequence"), F.when(k == 5, F.lit("short")).otherwise(F.col("key")).alias("key"), "entry")
    return L.record_faults(rec, 2, most=512)


def _generations(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 50 == 0, 9).when(F.col("o_orderkey") % 50 == 1, 0).otherwise(1).alias("schema_version"), F.col("o_orderkey").alias("identifier"), F.concat(F.lit(" "), "o_orderpriority").alias("fingerprint"), F.col("o_orderdate").alias("created_at"))


@query("SELECT o_orderkey AS identifier, o_orderdate AS created_at FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_generation(spark, sf_dir):
    return L.latest_generation(_generations(spark, sf_dir), "1-URGENT")


@query("SELECT o_orderkey AS identifier, CASE WHEN o_orderkey % 50 = 0 THEN 'unsupportedSchema' WHEN o_orderkey % 50 = 1 THEN 'invalidManifest' ELSE 'valid' END AS status FROM orders")
def generation_status(spark, sf_dir):
    return L.generation_status(_generations(spark, sf_dir))


# ---------------------------------------------------------------------- caches


def _trace(spark, sf_dir, shards):
    op = F.when(F.col("event_type").isin("view", "click"), "get").otherwise("put")
    cost = F.greatest(F.lit(1).cast("bigint"), F.ceil("value").cast("bigint"))
    return _table(spark, sf_dir, "events").select(I.shard_of(F.col("user_id"), shards).alias("shard"), F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("key"), cost.alias("cost"))


@query("SELECT CAST(shard AS INTEGER) AS shard, key FROM (SELECT doc_id % 8 AS shard, CAST(doc_id AS VARCHAR) AS key, sum(cost) OVER (PARTITION BY doc_id % 8 ORDER BY doc_id DESC) AS held FROM (SELECT doc_id, greatest(1, strlen(text)) AS cost FROM documents) WHERE cost <= 50000) WHERE held <= 50000")
def sieve_scan_fifo(spark, sf_dir):
    """A trace without re-reference, whose survivors have a closed form."""
    d = _table(spark, sf_dir, "documents")
    trace = d.select(I.shard_of(F.col("doc_id"), 8).alias("shard"), F.col("doc_id").alias("seq"), F.lit("put").alias("op"), F.col("doc_id").cast("string").alias("key"), I.normal_cost(F.octet_length("text").cast("bigint")).alias("cost"))
    return S.survivors(trace, 50_000)


def _replay_sql(shards: int, limit: int) -> str:
    """The trace's outcomes by a recursion of small steps: one operation, or one turn of
    the hand, of each shard at a time, with the entries as lists from oldest to newest."""
    less = lambda xs, p: f"{xs}[:{p} - 1] || {xs}[{p} + 1:]"
    return f"""
        WITH RECURSIVE t AS (SELECT CAST(user_id % {shards} AS INTEGER) AS shard, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'get' ELSE 'put' END AS op, CAST(user_id AS VARCHAR) AS key, greatest(1, CAST(ceil(value) AS BIGINT)) AS cost, row_number() OVER (PARTITION BY user_id % {shards} ORDER BY event_id) AS n FROM events),
        run AS (
            SELECT DISTINCT shard, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS ks, CAST([] AS BIGINT[]) AS cs, CAST([] AS BOOLEAN[]) AS vs, CAST(1 AS BIGINT) AS hand, true AS done, CAST(NULL AS BOOLEAN) AS hit, CAST(0 AS BIGINT) AS freed FROM t
            UNION ALL
            SELECT shard, n,
                CASE WHEN op = 'get' OR NOT fits AND spared THEN ks WHEN fits THEN ks || [key] WHEN ends THEN ({less("ks", "hand")}) || [key] ELSE {less("ks", "hand")} END,
                CASE WHEN op = 'get' OR NOT fits AND spared THEN cs WHEN fits THEN cs || [cost] WHEN ends THEN ({less("cs", "hand")}) || [cost] ELSE {less("cs", "hand")} END,
                CASE WHEN op = 'get' AND p > 0 THEN vs[:p - 1] || [true] || vs[p + 1:] WHEN op = 'get' THEN vs WHEN fits THEN vs || [false] WHEN spared THEN vs[:hand - 1] || [false] || vs[hand + 1:] WHEN ends THEN ({less("vs", "hand")}) || [false] ELSE {less("vs", "hand")} END,
                CASE WHEN op = 'get' OR fits THEN hand WHEN spared THEN hand % len(ks) + 1 WHEN hand = len(ks) THEN 1 ELSE hand END,
                op = 'get' OR fits OR ends,
                CASE WHEN op = 'get' THEN p > 0 ELSE true END,
                freed + CASE WHEN op = 'get' OR fits OR spared THEN 0 ELSE cs[hand] END
            FROM (SELECT *, total + cost <= {limit} AS fits, coalesce(vs[hand], false) AS spared, NOT coalesce(vs[hand], false) AND total - coalesce(cs[hand], 0) + cost <= {limit} AS ends
                FROM (SELECT shard, n, op, key, cost, p, ks, cs, vs, CASE WHEN hand > len(ks) THEN 1 ELSE hand END AS hand, freed, CAST(coalesce(list_sum(cs), 0) AS BIGINT) AS total
                    FROM (SELECT shard, n, op, key, cost, p, freed, CASE WHEN gone AND p < hand THEN hand - 1 ELSE hand END AS hand, CASE WHEN gone THEN {less("ks", "p")} ELSE ks END AS ks, CASE WHEN gone THEN {less("cs", "p")} ELSE cs END AS cs, CASE WHEN gone THEN {less("vs", "p")} ELSE vs END AS vs
                        FROM (SELECT r.shard, t.n, t.op, t.key, t.cost, r.ks, r.cs, r.vs, r.hand, CASE WHEN r.done THEN 0 ELSE r.freed END AS freed, coalesce(list_position(r.ks, t.key), 0) AS p, t.op = 'put' AND r.done AND coalesce(list_position(r.ks, t.key), 0) > 0 AS gone
                            FROM run r JOIN t ON t.shard = r.shard AND t.n = r.n + CASE WHEN r.done THEN 1 ELSE 0 END))))
        ),
        out AS (SELECT shard, seq, op, key, hit, freed, CAST(len(ks) AS BIGINT) AS items, CAST(coalesce(list_sum(cs), 0) AS BIGINT) AS cost FROM run JOIN t USING (shard, n) WHERE done AND n > 0)
    """


@query(f"{_replay_sql(1, 5_000)} SELECT * FROM out")
def sieve_replay(spark, sf_dir):
    return S.replay(_trace(spark, sf_dir, 1), 5_000).drop("evicted")


@query(f"{_replay_sql(8, 1_000)} SELECT * FROM out")
def sharded_sieve_replay(spark, sf_dir):
    return S.replay(_trace(spark, sf_dir, 8), 8_000, 8).drop("evicted")


@query(f"{_replay_sql(8, 1_000)} SELECT CAST(sum(items) AS BIGINT) AS items, CAST(sum(cost) AS BIGINT) AS cost FROM (SELECT arg_max(items, seq) AS items, arg_max(cost, seq) AS cost FROM out GROUP BY shard)")
def sharded_cost_snapshot(spark, sf_dir):
    last = S.replay(_trace(spark, sf_dir, 8), 8_000, 8).groupBy("shard").agg(F.max_by(F.struct("items", "cost"), "seq").alias("s"))
    return last.agg(F.sum("s.items").cast("bigint").alias("items"), F.sum("s.cost").cast("bigint").alias("cost"))


@query(f"{_replay_sql(8, 1_000)} SELECT seq, op, key, hit, items, cost FROM out")
def sieve_udtf(spark, sf_dir):
    spark.udtf.register("sieve_replay_rows", S.SieveReplay)
    _trace(spark, sf_dir, 8).createOrReplaceTempView("lodestore_trace")
    return spark.sql("SELECT * FROM sieve_replay_rows(TABLE(SELECT * FROM lodestore_trace) PARTITION BY shard ORDER BY (seq), 1000)")


@query("SELECT t.total, CAST(i AS INTEGER) AS shard, t.total // 8 + CASE WHEN i < t.total % 8 THEN 1 ELSE 0 END AS share FROM (SELECT o_orderkey * 37 AS total FROM orders) t, range(8) r(i)")
def budget_partition(spark, sf_dir):
    return S.budget_shares(_table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 37).alias("total")), 8)


_BUDGET_SQL = "WITH c AS (SELECT o_custkey % 40 AS trial, o_orderkey % 8 AS shard, CAST(sum(o_orderkey % 97) AS BIGINT) AS cost FROM orders GROUP BY 1, 2), t AS (SELECT trial, CAST(sum(cost) AS BIGINT) AS s, count(*) AS n, CAST(sum(cost) AS BIGINT) + 900 AS total, trial * 60 AS incoming, trial % 8 AS target FROM c GROUP BY trial HAVING count(*) = 8), j AS (SELECT c.trial, shard, cost, total, incoming, target, s, incoming <= total - s AS fits FROM c JOIN t USING (trial)), k AS (SELECT *, CASE WHEN fits THEN total - s - incoming ELSE total - least(total, first_cost + incoming) END AS rest FROM (SELECT *, max(CASE WHEN shard = target THEN cost END) OVER (PARTITION BY trial) AS first_cost FROM j))"


@query(f"{_BUDGET_SQL} SELECT trial, shard, CASE WHEN fits THEN cost + CASE WHEN shard = target THEN incoming ELSE 0 END + rest // 8 + CASE WHEN shard < rest % 8 THEN 1 ELSE 0 END WHEN shard = target THEN least(total, first_cost + incoming) ELSE rest // 7 + CASE WHEN (shard - CASE WHEN shard > target THEN 1 ELSE 0 END) < rest % 7 THEN 1 ELSE 0 END END AS budget FROM k")
def budget_redistribute(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    costs = o.groupBy((F.col("o_custkey") % 40).alias("trial"), (F.col("o_orderkey") % 8).alias("shard")).agg(F.sum(F.col("o_orderkey") % 97).alias("cost"))

    def one(pdf):
        pdf = pdf.sort_values("shard")
        trial, own = int(pdf["trial"].iloc[0]), [int(x) for x in pdf["cost"]]
        limits = S.redistributed_budget(own, trial % 8, 0, trial * 60, sum(own) + 900) if len(own) == 8 else []
        return pdf.head(len(limits)).assign(budget=limits)[["trial", "shard", "budget"]]

    return costs.groupBy("trial").applyInPandas(one, "trial long, shard long, budget long")


@query("SELECT CAST(index AS INTEGER) AS index, CAST(part AS INTEGER) AS partition, sha256(unhex(string_agg(lpad(hex(v), 2, '0'), '' ORDER BY o))) AS digest_hex FROM (SELECT i AS index, i % 2 AS part, o, xor((i * 131) % 256, o % 256) AS v FROM range(12) a(i), range(512) b(o)) GROUP BY 1, 2")
def probe_payloads(spark, sf_dir):
    return P.probe_payloads(spark, 12, 512).select("index", "partition", I.digest_hex(F.col("content")).alias("digest_hex"))
