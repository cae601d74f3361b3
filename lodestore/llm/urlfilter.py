"""URL filters: host rules, and a character language-model ratio for the rest.

Everything here is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import materialise

#: Characters that the lowest model spreads its rest of probability over.
ALPHABET = 256


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path begins with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lowered; path:
    then up to ``? #`` or the end. Null or no ``://``: both empty."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``struct(size, rule, allow)`` of the longest rule that fits (by its text's
    length; of equal ones the last by text), null if none does."""
    fits = []
    for r in rules:
        own = (host == r.host) | host.endswith("." + r.host)
        value = F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("rule"), F.lit(r.allow).alias("allow"))
        fits.append(F.when(own & path.startswith(r.path), value))
    return fits[0] if len(fits) == 1 else F.greatest(*fits)


def _grams(urls: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row for each character of a URL's text with its context: the up to ``order``
    characters that end with it; the text is bounded by a begin and an end mark."""
    line = F.concat(F.lit("\x02"), F.col("text"), F.lit("\x03"))
    gram = lambda i: line.substr(F.greatest(F.lit(1), i - (order - 1)), F.least(F.lit(order), i))
    return urls.select(*keep, F.explode(F.transform(F.sequence(F.lit(2), F.char_length(line)), gram)).alias("gram"))


def _counts(grams: DataFrame, order: int) -> DataFrame:
    """``(g, yes, no)`` for each suffix of each gram: how often accepted and rejected
    URLs hold it. The grams are summed first, so the suffixes of each distinct one are
    made once."""
    whole = grams.groupBy("gram").agg(F.sum(F.col("allow").cast("long")).alias("yes"), F.sum((~F.col("allow")).cast("long")).alias("no"))
    suffixes = F.transform(F.sequence(F.lit(1), F.char_length("gram")), lambda k: F.substr("gram", F.char_length("gram") - k + 1))
    return whole.select(F.explode(suffixes).alias("g"), "yes", "no").groupBy("g").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def log_ratios(asked: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """``(gram, ratio)``: for each of ``asked (gram)`` the log of the last character's
    probability after the others among accepted URLs over that among rejected ones.

    A variable-order Markov model with Witten-Bell smoothing for each side:
    p(x|h) = (c(hx) + t(h) p(x|h')) / (c(h) + t(h)), with t(h) the number of distinct
    characters after h and h' without its first character, down to the uniform
    distribution. Contexts never seen fall through to shorter ones.
    """
    followers = counts.where(F.char_length("g") >= 1).select(F.expr("substr(g, 1, char_length(g) - 1)").alias("h"), "yes", "no")
    contexts = followers.groupBy("h").agg(F.sum("yes").alias("cy"), F.sum("no").alias("cn"), F.count_if(F.col("yes") > 0).alias("ty"), F.count_if(F.col("no") > 0).alias("tn"))
    contexts = materialise(contexts, "contexts")
    suffix = lambda k: F.expr(f"substr(gram, greatest(1, char_length(gram) - {k - 1}))")
    rows = asked.withColumn("py", F.lit(1.0 / ALPHABET)).withColumn("pn", F.lit(1.0 / ALPHABET))
    for k in range(1, order + 1):
        # Shorter grams have used all their contexts; their suffix would repeat.
        g, h = suffix(k), F.expr(f"substr(gram, greatest(1, char_length(gram) - {k - 1}), least({k}, char_length(gram)) - 1)")
        rows = rows.withColumn("g", g).withColumn("h", F.when(F.char_length("gram") >= k, h))
        c = counts.select(F.col("g").alias("cg"), "yes", "no")
        rows = rows.join(contexts.withColumnRenamed("h", "ch"), F.col("h") == F.col("ch"), "left").join(c, F.col("g") == F.col("cg"), "left")
        step = lambda p, c, n, t: F.when(F.col(n) > 0, (F.coalesce(c, F.lit(0)) + F.col(t) * F.col(p)) / (F.col(n) + F.col(t))).otherwise(F.col(p))
        rows = rows.select("gram", step("py", "yes", "cy", "ty").alias("py"), step("pn", "no", "cn", "tn").alias("pn"))
    return rows.select("gram", (F.log("py") - F.log("pn")).alias("ratio"))


def judge(pages: DataFrame, rules: list[Rule], order: int = 5, sample: int = 50_000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, llr)`` of every page.

    A page that a rule fits has the rule's verdict, that of the longest rule. The
    accepted and the rejected URLs among them, at most ``sample`` of each by the hash
    of their text (a fixed bound on a model's training; three in four train, one in
    four calibrates), train the two models on host and path; every other page is
    judged by its mean log-likelihood difference per character against a threshold
    between the means of the two calibration sets, nearer to the one that spreads
    less. Without training URLs of both kinds the method allows all.

    ``llr`` is that difference, null without a model. Null and malformed URLs have an
    empty host and path and are judged as the empty text; a difference equal to the
    threshold is allowed; of equally long rules the last by text decides; long URLs are
    judged whole; null identifiers and repeated rows stay; extra columns are ignored; an
    empty table gives an empty result.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).withColumn("text", F.concat("host", "path"))
    known = rows.where("best is not null").select("text", F.col("best.allow").alias("allow")).distinct()
    hash_ = F.md5(F.col("text").cast("binary"))
    kinds = [known.where(F.col("allow") == flag).orderBy(hash_, "text").limit(sample) for flag in (True, False)]
    chosen = materialise(kinds[0].unionAll(kinds[1]).withColumn("calibrate", F.substring(hash_, 1, 1).isin("0", "1", "2", "3")), "url_sample")
    trains = {r.allow: r.n for r in chosen.where("not calibrate").groupBy("allow").agg(F.count("*").alias("n")).collect()}
    verdict = F.when(F.col("best").isNotNull(), F.when(F.col("best.allow"), "allow").otherwise("block"))
    if len(trains) < 2:
        return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(verdict, F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("llr"))
    counts = materialise(_counts(_grams(chosen.where("not calibrate"), order, "allow"), order), "gram_counts")
    # Each distinct text and each distinct gram is scored once, however many pages share it.
    rest = rows.where("best is null").select("text").distinct()
    texts = chosen.where("calibrate").select("text", "allow").unionAll(rest.select("text", F.lit(None).cast("boolean").alias("allow")))
    grams = _grams(texts, order, "text", "allow")
    ratios = materialise(log_ratios(grams.select("gram").distinct(), counts, order), "ratios")
    scored = grams.join(ratios, "gram").groupBy("text", "allow").agg(F.avg("ratio").alias("llr"))
    scored = materialise(scored, "url_scores")
    sides = {r.allow: r for r in scored.where("allow is not null").groupBy("allow").agg(F.avg("llr").alias("m"), F.stddev_pop("llr").alias("s")).collect()}
    if len(sides) == 2:
        yes, no = sides[True], sides[False]
        spread = yes.s + no.s
        cut = (yes.m * no.s + no.m * yes.s) / spread if spread else (yes.m + no.m) / 2
    else:
        cut = 0.0
    by_text = scored.where("allow is null").select(F.col("text").alias("scored"), "llr")
    out = rows.where("best is null").join(by_text, F.col("text") == F.col("scored"), "left")
    judged = F.when(F.col("llr") >= F.lit(float(cut)), "allow").otherwise("block")
    ruled = rows.where("best is not null").select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.lit(None).cast("double").alias("llr"))
    return ruled.unionAll(out.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), judged.alias("verdict"), "llr"))
