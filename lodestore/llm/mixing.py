"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestore.llm.common import WORD, discard, materialise

#: Scale at which sums are kept as whole numbers, so that reruns agree to the last bit.
FIXED = "decimal(38,9)"
#: Iterations after which a source that isn't at its target yet only bisects.
BISECT = 40
#: The tilt of a source that takes every document as often as it may.
ALL = 1e12


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``(source, source_size, target)`` of ``sizes (source, size, ...)``.

    Sources in code-point order, null last, take the weights in turn and share the
    sum of all sizes; a target stops at ``most`` times its source's size and the rest
    is shared again by weight until none is above. In closed form: by rising size
    per weight, the capped sources are the prefix whose caps lie under the water
    level that the others then share. One row a source meets in one task, never a
    row a document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.get(turn, (F.row_number().over(order) - 1) % len(weights)))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything, rising = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("left", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("among", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # The level if all before are capped and none from here on; the first source under it sets it.
    per = per.withColumn("level", F.min(F.when(F.col("left") / F.col("among") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("left") / F.col("among")))).over(everything))
    return per.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level.col2") * F.col("w"))).alias("target"))


def tilted_rate(tilt: Column, size: Column, scale: Column, most: float) -> Column:
    """The rate of a document of ``size``: ``most`` times a logistic of ``tilt``.

    Minimising the sum of ``H(rate)``, the Fermi-Dirac divergence from rate 1, under
    the sources' token totals gives rates ``most / (1 + (most - 1) exp(-tilt x))``
    with ``x = size / scale``: exponentially tilted odds, kept under ``most``.
    """
    x = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), tilt * size / scale))
    return F.lit(float(most)) / (1 + (most - 1) * F.exp(-x))


def balance(classes: DataFrame, targets: DataFrame, most: float = 3.0, tolerance: float = 1e-6, steps: int = 200) -> DataFrame:
    """``(source, tilt, scale)``: the convex dual's solution, by Newton iterations.

    ``classes (source, size, n)`` counts documents by size, which is all a rate
    depends on. Each iteration is one aggregation of the gradient and curvature by
    source and an update of all tilts; a source whose step would leave the bracket
    of the signs seen so far bisects it instead, as does every source after
    ``BISECT`` iterations, so the bracket shrinks to a point. Stops when all sources are
    within ``tolerance`` of their targets; not to get there in ``steps`` is an error. A
    target at ``most`` times the size, or of 0, is met in the limit.
    """
    hist = classes.where("size > 0")
    scale = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    k = [F.lit(None).cast("double").alias(c) for c in ("low", "high")]
    # A source at its cap takes all documents ``most`` times, the limit of tilts without end.
    capped = F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-12))
    state = targets.join(scale, targets.source.eqNullSafe(scale.source)).select(targets.source, "target", "scale", F.when(capped, F.lit(ALL)).otherwise(F.lit(0.0)).alias("tilt"), *k)
    state = materialise(state, "tilts")
    for step in range(steps):
        s = state.select(F.col("source").alias("s"), "target", "scale", "tilt", "low", "high")
        # One row a source: AQE broadcasts it when its measured size allows and splits the hot source otherwise.
        rows = hist.join(s, hist.source.eqNullSafe(s.s))
        rate = tilted_rate(F.col("tilt"), F.col("size"), F.col("scale"), most)
        words = F.col("n") * F.col("size") * rate
        bend = words * (1 - rate / most) * F.col("size") / F.col("scale")
        sums = rows.groupBy("s", "target", "scale", "tilt", "low", "high").agg(F.sum(words.cast(FIXED)).cast("double").alias("got"), F.sum(bend.cast(FIXED)).cast("double").alias("bend"))
        gap = F.col("got") - F.col("target")
        sums = sums.withColumn("gap", gap / F.greatest(F.col("target"), F.lit(1.0)))
        sums = sums.withColumn("low", F.when(F.col("gap") < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("gap") > 0, F.least("high", "tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") - F.greatest(F.lit(-4.0), F.least(F.lit(4.0), gap / F.greatest(F.col("bend"), F.lit(1e-9))))
        outside = (newton <= F.col("low")) | (newton >= F.col("high")) | F.lit(step >= BISECT)
        newton = F.when(outside, F.coalesce((F.col("low") + F.col("high")) / 2, newton)).otherwise(newton)
        done = (F.abs(F.col("gap")) <= tolerance) | (F.col("tilt") >= ALL)
        old, state = state, materialise(sums.select(F.col("s").alias("source"), "target", "scale", F.when(done, F.col("tilt")).otherwise(newton).alias("tilt"), "low", "high", F.col("gap")), "tilts")
        discard(old)
        worst = state.agg(F.max(F.when(F.col("tilt") < ALL, F.abs("gap")))).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        raise RuntimeError(f"a source is {worst} of its target off after {steps} iterations")
    return state.select("source", "tilt", "scale", "target")


def class_copies(classes: DataFrame, tilts: DataFrame, most: float = 3.0) -> DataFrame:
    """``(source, size, n, copies)``: whole copies for each class, rounded so that what
    one class takes too much or too little is carried to the next smaller size.

    The carry walks down a source's distinct sizes, of which there are no more than
    words in its longest document, however many documents there are; a document's
    copies stay within one of its rate's floor and ceiling, and under ``most``.
    """
    t = tilts.select(F.col("source").alias("s"), "tilt", "scale")
    rows = classes.where("size > 0").join(t, classes.source.eqNullSafe(t.s)).select("source", "size", "n", tilted_rate(F.col("tilt"), F.col("size"), F.col("scale"), most).alias("rate"))

    def carry(pdf):
        pdf = pdf.sort_values("size", ascending=False)
        left, copies = 0.0, []
        for size, n, rate in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist()):
            want = n * rate * size + left
            low, high = n * max(0, math.floor(rate) - 1), n * min(int(most), math.ceil(rate) + 1)
            take = max(low, min(high, math.floor(want / size + 0.5)))
            left = want - take * size
            copies.append(take)
        return pdf.assign(copies=copies)[["source", "size", "n", "copies"]]

    return rows.groupBy("source").applyInPandas(carry, "source string, size long, n long, copies long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 10_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` of every document.

    ``size`` counts the words, ``copies`` how often the mix repeats the document
    (0 to ``most``) and ``taken = copies * size`` the words it takes. A class's copies
    go to its documents evenly in the order of a hash of the identifier; classes of
    more than ``block`` documents are first split by that hash (documents without an
    identifier, which are all alike, at random), so that no group grows with the number
    of equal documents. Long texts count like others; extra columns are ignored. Null and empty texts have size 0 and
    take nothing; a null source is a source of its own, the last; rows with equal
    identifiers are separate documents; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.when(F.col(f"`{id_col}`").isNull(), F.xxhash64(F.monotonically_increasing_id())).alias("salt"))
    rows = materialise(rows, "sizes")
    classes = materialise(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "classes")
    targets = materialise(source_targets(classes.select("source", (F.col("size") * F.col("n")).alias("size")), weights, float(most)), "targets")
    tilts = balance(classes, targets, float(most))
    shares = class_copies(classes, tilts, float(most))
    shares = materialise(shares.withColumn("split", F.ceil(F.col("n") / block).cast("int")), "copies")

    # A split class's parts: their documents are counted, and get the copies between
    # the roundings of what came before them and with them.
    place = F.when(F.col("salt").isNull(), F.pmod(F.xxhash64("doc_id"), "split")).otherwise(F.col("split") + F.pmod("salt", F.col("split")))
    keyed = lambda df: df.withColumn("part", place.cast("int"))
    c = shares.select(F.col("source").alias("cs"), F.col("size").alias("cz"), "n", "copies", "split")
    dealt = keyed(rows.where("size > 0").join(c, rows.source.eqNullSafe(c.cs) & (rows.size == c.cz)).drop("cs", "cz"))
    parts = dealt.groupBy("source", "size", "part", "n", "copies").agg(F.count("*").alias("m"))
    so_far = Window.partitionBy("source", "size").orderBy("part")
    end = F.sum("m").over(so_far)
    # Whole numbers of 38 digits: the products of a class's documents and copies pass a long.
    upto = lambda x: F.expr(f"(cast({x} as decimal(19, 0)) * cast(copies as decimal(19, 0))) div cast(n as decimal(19, 0))")
    parts = parts.withColumn("end", end).withColumn("begin", F.col("end") - F.col("m"))
    parts = parts.select(F.col("source").alias("ps"), F.col("size").alias("pz"), F.col("part").alias("pp"), "m", (upto("end") - upto("begin")).alias("share"))
    at = dealt.drop("n", "copies").join(parts, dealt.source.eqNullSafe(parts.ps) & (dealt.size == parts.pz) & (dealt.part == parts.pp))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))
    at = at.withColumn("rank", rank)
    given = (F.floor(F.col("rank") * F.col("share") / F.col("m")) - F.floor((F.col("rank") - 1) * F.col("share") / F.col("m"))).cast("long")
    taken = at.select("doc_id", "source", "size", given.alias("copies")).unionAll(rows.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long")))
    t = targets.select(F.col("source").alias("ts"), "source_size", "target")
    return taken.join(t, taken.source.eqNullSafe(t.ts)).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
