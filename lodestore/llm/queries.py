"""One thin query for each training-data operator, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import decontaminate, iblt, lm, mixing, simhash, substring, tokens, toxicity, urlfilter, warc
from lodestore.llm.common import held_out, materialise, scratch_path

#: Where the public tokenizers' vocabulary files are; a parameter of the queries that need one.
VOCABULARY = os.environ.get("LODESTORE_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = toxicity.learn(docs, labels.where(~held_out("doc_id", 3, 1)).select("doc_id", F.col("toxic").alias("label")))
    scored = toxicity.score_documents(docs, grammar)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), weights=(1, 2, 3), most=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = materialise(lm.tokenise(docs, learn=~held_out("doc_id", 7, 2)), "tokens")
    return lm.score(tokens, lm.train(tokens, order=3)).withColumn("held_out", held_out("doc_id", 7, 2))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, radius=2)


#: The rules of op3, as (host, path, allow).
RULES = [urlfilter.Rule(*r) for r in (("com", "/", True), ("example.com", "/en/", False), ("www.example.com", "/en/", True), ("net", "/es/", False), ("net", "/fr/", False))]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=13, rejoin=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    pieces = tokens.read_pieces(Path(vocabulary).read_bytes())
    return tokens.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), pieces)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(docs, items, rate=0.1)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.archive_round_trip(spark, pages, scratch_path(spark, "warc"), least=0)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = iblt.fingerprint_versions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing_sources": op2_mixing_sources,
    "op3_url_filter": op3_url_filter,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_warc": op9_warc,
    "op10_document_fingerprints": op10_document_fingerprints,
}

#: CRC-32 of the ASCII text ``id``, bit by bit.
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(id) + 1), lambda i: ascii(substr(id, i, 1))::BIGINT), lambda c, x: list_reduce([xor(c, x)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"
#: The value that stands for ``{0}`` quantised on a logarithmic scale down to 1e-``{1}``.
_QUANTISED = "pow(10, -least(65535, ceil(-log10(greatest({0}, 1e-{1})) / {1} * 65535 - 1e-9)) * {1} / 65535)"


def _ratio_steps(order: int) -> str:
    """For each gram both sides' probabilities, from no context to the longest."""
    out = ["r0 AS (SELECT gram, 1 / 256::DOUBLE AS py, 1 / 256::DOUBLE AS pn FROM (SELECT DISTINCT gram FROM asked))"]
    for k in range(1, order + 1):
        step = "CASE WHEN x.c{0} > 0 THEN (coalesce(c.{1}, 0) + x.t{0} * p{0}) / (x.c{0} + x.t{0}) ELSE p{0} END AS p{0}"
        out.append(f"r{k} AS (SELECT gram, {step.format('y', 'yes')}, {step.format('n', 'no')} FROM r{k - 1} LEFT JOIN ctx x ON length(gram) >= {k} AND x.h = substr(gram, length(gram) - {k - 1}, {k - 1}) LEFT JOIN counts c ON length(gram) >= {k} AND c.g = substr(gram, length(gram) - {k - 1}))")
    return ",\n        ".join(out)


_RULE_VALUES = ", ".join(f"('{r.host}', '{r.path}', {str(r.allow).lower()})" for r in RULES)

#: DuckDB SQL of the queries that SQL can express; the others are tested against
#: brute-force versions.
ORACLE: dict[str, str] = {
    "op3_url_filter": rf"""
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
        hp AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        rules(rh, rp, allow) AS (VALUES {_RULE_VALUES}),
        best AS (SELECT n, max({{'size': length(rh || rp), 'rule': rh || rp, 'allow': allow}}) AS best FROM hp JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n),
        rows_ AS (SELECT hp.*, host || path AS text, best FROM hp LEFT JOIN best USING (n)),
        known AS (SELECT DISTINCT text, best.allow AS allow FROM rows_ WHERE best IS NOT NULL),
        chosen AS (SELECT text, allow, substr(md5(text), 1, 1) IN ('0', '1', '2', '3') AS calibrate FROM known QUALIFY row_number() OVER (PARTITION BY allow ORDER BY md5(text), text) <= 50000),
        rest AS (SELECT DISTINCT text, CAST(NULL AS BOOLEAN) AS allow FROM rows_ WHERE best IS NULL),
        lines AS (SELECT text, allow, calibrate, chr(2) || text || chr(3) AS line FROM (SELECT text, allow, calibrate FROM chosen UNION ALL SELECT text, allow, true FROM rest)),
        grams AS (SELECT text, allow, calibrate, substr(line, greatest(1, i - 4), least(5, i)) AS gram FROM (SELECT *, unnest(range(2, length(line) + 1)) AS i FROM lines)),
        counts AS (SELECT g, count_if(allow) AS yes, count_if(NOT allow) AS no FROM (SELECT allow, substr(gram, length(gram) - k + 1) AS g FROM (SELECT allow, gram, unnest(range(1, length(gram) + 1)) AS k FROM grams WHERE NOT calibrate)) GROUP BY g),
        ctx AS (SELECT substr(g, 1, length(g) - 1) AS h, sum(yes) AS cy, sum(no) AS cn, count_if(yes > 0) AS ty, count_if(no > 0) AS tn FROM counts GROUP BY 1),
        asked AS (SELECT text, allow, gram FROM grams WHERE calibrate),
        {_ratio_steps(5)},
        scored AS (SELECT text, allow, avg(ln(py) - ln(pn)) AS llr FROM asked JOIN r5 USING (gram) GROUP BY text, allow),
        side AS (SELECT allow, avg(llr) AS m, stddev_pop(llr) AS s FROM scored WHERE allow IS NOT NULL GROUP BY allow),
        cut AS (SELECT CASE WHEN y.s + z.s > 0 THEN (y.m * z.s + z.m * y.s) / (y.s + z.s) ELSE (y.m + z.m) / 2 END AS cut FROM side y, side z WHERE y.allow AND NOT z.allow),
        trained AS (SELECT count(DISTINCT allow) AS kinds FROM chosen WHERE NOT calibrate)
        SELECT page_id, host, path, best.rule AS rule, CASE WHEN best IS NOT NULL THEN CASE WHEN best.allow THEN 'allow' ELSE 'block' END WHEN (SELECT kinds FROM trained) < 2 OR llr >= coalesce((SELECT cut FROM cut), 0) THEN 'allow' ELSE 'block' END AS verdict
        FROM rows_ LEFT JOIN (SELECT text, llr FROM scored WHERE allow IS NULL) USING (text)
    """,
    "op4_lm_scoring": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} % 7 = 2 AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') || [' '] AS ws FROM (SELECT doc_id, text, coalesce(CAST(doc_id AS VARCHAR), '') AS id FROM documents)),
        tok AS (SELECT r, held_out, i, ws[i] AS w, CASE WHEN i = 1 THEN ' ' ELSE ws[i - 1] END AS a, CASE WHEN i = 2 THEN ' ' WHEN i > 2 THEN ws[i - 2] END AS b FROM (SELECT r, held_out, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
        one AS (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w),
        n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM one),
        two AS (SELECT a, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY a, w),
        three AS (SELECT b, a, w, count(*) AS c FROM tok WHERE NOT held_out AND i > 1 GROUP BY b, a, w),
        p2 AS (SELECT a, w, {_QUANTISED.format('(c - 0.75) / sum(c) OVER (PARTITION BY a)', 8)} AS p FROM two),
        p3 AS (SELECT b, a, w, {_QUANTISED.format('(c - 0.75) / sum(c) OVER (PARTITION BY b, a)', 8)} AS p FROM three),
        b2 AS (SELECT a, {_QUANTISED.format('1 - sum(p)', 6)} AS back FROM p2 GROUP BY a),
        b3 AS (SELECT b, a, {_QUANTISED.format('1 - sum(p)', 6)} AS back FROM p3 GROUP BY b, a),
        s AS (SELECT r, coalesce(one.c, 0) AS c, (coalesce(one.c, 0) + 1) / (n.n + n.v + 1)::DOUBLE AS q, coalesce(p2.p, 0) AS q2, coalesce(b2.back, 1) AS k2, coalesce(p3.p, 0) AS q3, coalesce(b3.back, 1) AS k3
            FROM tok, n LEFT JOIN one ON one.w = tok.w LEFT JOIN p2 ON p2.a = tok.a AND p2.w = tok.w LEFT JOIN b2 ON b2.a = tok.a LEFT JOIN p3 ON p3.b = tok.b AND p3.a = tok.a AND p3.w = tok.w LEFT JOIN b3 ON b3.b = tok.b AND b3.a = tok.a)
        SELECT doc_id, held_out, n_tokens, n_known, (SELECT n FROM n) AS train_tokens, base_score, score
        FROM d JOIN (SELECT r, count(*) AS n_tokens, count_if(c > 0)::BIGINT AS n_known, fsum(log10(q)) AS base_score, fsum(log10(q3 + k3 * (q2 + k2 * q))) AS score FROM s GROUP BY r) USING (r)
    """,
    "op6_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
        first AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
        gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN first USING (g), range(13) r(k) WHERE doc_id > d),
        words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op9_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages),
        d AS (SELECT page_id, keeper, CAST(strlen(h) AS BIGINT) AS payload_bytes, '0' || lower(sha1(h)) || '00' AS x FROM p)
        SELECT page_id, payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((((strpos('0123456789abcdef', substr(x, 2 + (5 * i) // 4, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(x, 3 + (5 * i) // 4, 1)) - 1) // (CASE (5 * i) % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END)) % 32 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM d
    """,
}
