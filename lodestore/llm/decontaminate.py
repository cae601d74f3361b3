"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import arrow_pass, filter_texts, scratch_path, text_rows

#: Verifications of one text that are remembered at most.
TRIED = 100_000


def normal(text: bytes) -> str:
    """A-Z lowered, white space runs as one space, none at the ends."""
    return b" ".join(text.lower().split()).decode("utf-8", "replace")


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``item`` cut into ``budget + 1`` parts of nearly equal length, with offsets."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, budget: int, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to any substring of ``text`` and the end
    of the first such substring; the distance is ``budget + 1`` if it is larger.

    Myers' bit-parallel recurrence: a column of the dynamic programme is two words
    of vertical differences, here whole numbers of any width.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    if masks is None:
        masks = bit_masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = (m, 0) if m <= budget else (budget + 1, -1)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | minus
        zero = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(zero | plus))
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full  # a match may begin anywhere: no cost enters at the top
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def bit_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


def climbs(n: int) -> list[list[tuple[int, int]]]:
    """For each of ``n`` pieces the ranges of pieces above it, from the narrowest to
    all, in a tree that halves ranges.

    If a range of p pieces holds at most p - 1 errors, so does one of its halves with
    its own number of pieces: else the halves' errors added up to p. So from the whole
    item, of budget + 1 pieces, a chain of such ranges leads down to a piece without
    an error, and a piece found is worth the next verification only while each range
    above it stays within its pieces less one.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    open_ = [(0, n)]
    while open_:
        low, high = open_.pop()
        if high - low > 1:
            for i in range(low, high):
                out[i].insert(0, (low, high))
            middle = (low + high) // 2
            open_ += [(low, middle), (middle, high)]
    return out


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = {i: t for i, t in items if t}
        self.budget = {i: int(len(t) * rate) for i, t in self.items.items()}
        self.cuts: dict[int, list[int]] = {}
        self.climbs: dict[int, list[list[tuple[int, int]]]] = {}
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, t in self.items.items():
            parts = pieces(t, self.budget[i])
            self.cuts[i] = [*(at for at, _ in parts), len(t)]
            if len(parts) not in self.climbs:
                self.climbs[len(parts)] = climbs(len(parts))
            for k, (_, piece) in enumerate(parts):
                where[piece].append((i, k))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def _distance(self, item: int, low: int, high: int, text: str, begin: int) -> tuple[int, int]:
        """The least distance of pieces ``low`` to ``high`` to the text near ``begin``,
        within one error less than pieces, and where that match ends."""
        cuts, budget = self.cuts[item], high - low - 1
        pattern = self.items[item][cuts[low] : cuts[high]]
        key = (item, low, high)
        masks = self.masks.get(key)
        if masks is None:
            masks = self.masks[key] = bit_masks(pattern)
        start = max(0, begin - budget)
        got, end = myers(pattern, text[start : max(0, begin + len(pattern) + budget)], budget, masks)
        return got, start + end

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """``(item, least distance, end)`` of the items that ``text`` holds within budget."""
        if self.empty or not text:
            return []
        best: dict[int, tuple[int, int]] = {}
        tried: dict[tuple[int, int, int, int], tuple[int, int]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for item, k in places:
                if item in best and not best[item][0]:
                    continue
                cuts, whole = self.cuts[item], self.items[item]
                at = last + 1 - size - cuts[k]  # where the item begins if nothing was put in or left out
                if at >= 0 and text.startswith(whole, at):
                    best[item] = (0, at + len(whole))
                    continue
                got = None
                for low, high in self.climbs[len(cuts) - 1][k]:
                    key = (item, low, high, at)
                    got = tried.get(key)
                    if got is None:
                        if len(tried) >= TRIED:
                            tried.clear()
                        got = tried[key] = self._distance(item, low, high, text, at + cuts[low])
                    if got[0] > high - low - 1:
                        got = None
                        break
                if got is not None and (item not in best or got[0] < best[item][0]):
                    best[item] = got
        return [(item, *best[item]) for item in sorted(best)]


def write_blocks(benchmark: DataFrame, block_chars: int, item_col: str = "item_id", item_text_col: str = "text") -> list[str]:
    """The items in files of about ``block_chars`` characters each in the shared folder,
    dealt by their hash; the files' folders. The driver sees no item."""
    spark, folder = benchmark.sparkSession, scratch_path(benchmark.sparkSession, "benchmark")
    rows = benchmark.select(*text_rows(item_col, item_text_col))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = -(-total // block_chars)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, n))).cast("int")
    dealt = rows.withColumn("block", block).repartitionById(max(1, n), "block")
    dealt.write.partitionBy("block").parquet(folder)
    return [f"{folder}/block={r.block}" for r in spark.read.parquet(folder).select("block").distinct().orderBy("block").collect()] if n else []


@lru_cache(maxsize=1)
def matcher_of(path: str, rate: float) -> tuple[Matcher, list[int | None]]:
    """The automaton of a block and its items' identifiers, made once a worker."""
    store, at = fs.FileSystem.from_uri(path)
    table = pq.read_table(at, filesystem=store, columns=["doc_id", "text"], partitioning=None)
    return Matcher([(k, normal(t)) for k, t in enumerate(table["text"].to_pylist())], rate), table["doc_id"].to_pylist()


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, distance, end)``: the items found in each document.

    Both sides are normalised (A-Z lowered, white space as one space). An item of n
    characters is found if a substring of the text is within ``floor(rate * n)``
    edits of it. Cut into one piece more than that, an item within budget has a piece
    that occurs unchanged, which an Aho-Corasick automaton of all pieces finds;
    Myers' algorithm verifies the stretches around it, from a few pieces to all. Of
    equal distances the one that ends first in the text's order of pieces is given.

    The items lie in blocks of about ``block_chars`` bytes in the shared folder, each
    run against all documents, so neither a task nor the driver holds the benchmark.
    Null and empty items match nothing, null and empty texts hold nothing; invalid UTF-8
    is replaced by U+FFFD; a long text is searched whole; null identifiers are kept;
    repeated documents and items each count; extra columns are ignored; the result has
    no row for a clean document, and none for an empty table.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int64())])

    def against(path: str | None) -> DataFrame:
        def run(batches: Iterator[dict]) -> Iterator[dict]:
            for b in batches:
                matcher, ids = matcher_of(path, rate) if path else (Matcher([], rate), [])
                rows = [(i, ids[m[0]], *m[1:]) for i, t in zip(b["doc_id"].to_pylist(), b["text"]) for m in matcher.find(normal(t.as_py()))]
                yield {n: [r[j] for r in rows] for j, n in enumerate(schema.names)}

        return docs.select(*text_rows(id_col, text_col)).mapInArrow(arrow_pass(run, schema), "doc_id long, item_id long, distance int, end long")

    out = None
    for path in write_blocks(benchmark, block_chars, item_col, item_text_col):
        out = against(path) if out is None else out.unionAll(against(path))
    return against(None) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = 4_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no item of the benchmark, with all their columns."""
    for path in write_blocks(benchmark, block_chars, item_col, item_text_col):

        def make(path: str = path):
            matcher, _ = matcher_of(path, rate)
            return lambda text: not matcher.find(normal(text))

        docs = filter_texts(docs, text_col, make)
    return docs
