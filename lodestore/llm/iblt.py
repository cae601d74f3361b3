"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A fingerprint is a sketch of ``CELLS`` cells in base64. Two of them subtract, and if few
enough digests differ the difference peels: both sides' digests come back from the two
strings alone (``compare_printed``). A difference that doesn't peel is tried again with
larger sketches of the same texts.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lodestore.llm.common import arrow_pass, text_rows

HASHES = 3
#: Cells of a fingerprint: about 30 differing digests are recovered from it.
CELLS = 48
#: Words that end a paragraph are those whose hash is 0 modulo this; so paragraphs of
#: running text are cut by content, and an edit moves no cut but its neighbours.
CUT = 8
CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])


def paragraphs(text: bytes) -> list[bytes]:
    """The text's lines, cut further after words chosen by their hash."""
    out = []
    for line in text.split(b"\n"):
        held: list[bytes] = []
        for word in line.split():
            held.append(word)
            if xxhash.xxh3_64_intdigest(word, 11) % CUT == 0:
                out.append(b" ".join(held))
                held = []
        if held:
            out.append(b" ".join(held))
    return out


def digests(text: bytes) -> np.ndarray:
    """The set of 64-bit digests of the paragraphs; the second of two equal ones counts
    as another, so a repeated paragraph is told from a single one."""
    seen: dict[bytes, int] = {}
    out = []
    for p in paragraphs(text):
        k = seen[p] = seen.get(p, -1) + 1
        # The number goes into the bytes: as a seed it can undo what differs between short paragraphs.
        out.append(xxhash.xxh3_64_intdigest(b"%b\n%d" % (p, k) if k else p))
    return np.unique(np.array(out, np.uint64))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """Each key's cells, one in each third of the sketch."""
    third = cells // HASHES
    return np.stack([_mix(keys, 1 + h) % np.uint64(third) + np.uint64(h * third) for h in range(HASHES)]).astype(np.int64)


def sketch(sets: list[np.ndarray], cells: int) -> np.ndarray:
    """The sketches of sets of digests, a row of ``cells`` cells each."""
    out = np.zeros(len(sets) * cells, CELL)
    keys = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    base = np.repeat(np.arange(len(sets)) * cells, [len(x) for x in sets])
    check = (_mix(keys, 99) >> np.uint64(32)).astype(np.uint32)
    for at in _places(keys, cells):
        np.add.at(out["count"], base + at, 1)
        np.bitwise_xor.at(out["key"], base + at, keys)
        np.bitwise_xor.at(out["check"], base + at, check)
    return out.reshape(len(sets), cells)


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a.copy()
    out["count"] -= b["count"]
    out["key"] ^= b["key"]
    out["check"] ^= b["check"]
    return out


def peel(difference: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row, whether all was recovered; and the row, digest and sign (1: only in
    the first set, -1: only in the second) of each digest recovered.

    All rows are peeled together, a layer at a time: cells that hold one digest give
    it up, and it is taken out of its other cells.
    """
    n, width = difference.shape
    cells = difference.reshape(-1).copy()
    rows, found, signs = [], [], []
    live = np.arange(len(cells))
    for _ in range(4 * width):
        some = cells[live]
        checks = (_mix(some["key"], 99) >> np.uint64(32)).astype(np.uint32)
        pure = live[(np.abs(some["count"]) == 1) & (checks == some["check"])]
        if not pure.size:
            break
        keys, row = cells["key"][pure], pure // width
        order = np.lexsort((keys, row))
        new = np.concatenate([[True], (np.diff(row[order]) != 0) | (keys[order][1:] != keys[order][:-1])])
        pick = order[new]
        keys, row, sign = keys[pick], row[pick], cells["count"][pure][pick]
        check = (_mix(keys, 99) >> np.uint64(32)).astype(np.uint32)
        places = _places(keys, width) + row * width
        for at in places:
            np.add.at(cells["count"], at, -sign)
            np.bitwise_xor.at(cells["key"], at, keys)
            np.bitwise_xor.at(cells["check"], at, check)
        rows.append(row)
        found.append(keys)
        signs.append(sign)
        live = np.unique(places)  # only cells that changed can have become pure
    dirty = (cells["count"] != 0) | (cells["key"] != 0) | (cells["check"] != 0)
    done = ~dirty.reshape(n, width).any(axis=1)
    empty = np.empty(0, np.int64)
    return done, np.concatenate([empty, *rows]), np.concatenate([empty.astype(np.uint64), *found]), np.concatenate([empty, *signs])


def estimated(difference: np.ndarray) -> np.ndarray:
    """About how many digests differ, of subtracted sketches: each adds 1 to or takes 1
    from the counts of ``HASHES`` cells, so their variance tells."""
    count = difference["count"].astype(np.float64)
    return np.maximum(count.var(axis=1), np.abs(count.mean(axis=1))) * count.shape[1] / HASHES


def differing(first: list[np.ndarray], second: list[np.ndarray], cells: int = CELLS) -> list[tuple[list[int], list[int], int]]:
    """For each pair of sets the digests only in the first and only in the second, and
    with how many cells they were recovered.

    Sketches of ``cells`` cells are subtracted and peeled; pairs whose difference
    doesn't peel are tried again with twice the cells, from as many on as the first
    sketches' counts suggest. A pair that doesn't peel with eight times as many cells
    as digests (equal keys by chance) is compared as sets: 0 cells.
    """
    out: list[tuple[list[int], list[int], int]] = [([], [], cells) for _ in first]
    sizes = np.array([len(a) + len(b) for a, b in zip(first, second)], np.int64)
    todo: dict[int, np.ndarray] = {cells: np.arange(len(first))} if first else {}
    while todo:
        now = min(todo)
        mine = todo.pop(now)
        a, b = ([x[i] for i in mine] for x in (first, second))
        apart = subtract(sketch(a, now), sketch(b, now))
        small = np.ones(len(mine), bool)
        if now == cells:  # far too many differ: don't try to peel
            guess = 1.4 * estimated(apart)
            small = guess <= 2 * now
        done = np.zeros(len(mine), bool)
        done[small], row, key, sign = peel(apart[small])
        where = mine[small]
        for i in mine[done].tolist():
            out[i] = ([], [], now)
        for r, k, s in zip(where[row].tolist(), key.tolist(), sign.tolist()):
            out[r][s < 0].append(k)
        for i in mine[~done].tolist():
            out[i] = ([], [], 0)
        later = np.full(len(mine), 2 * now)
        if now == cells:
            later = np.maximum(later, now << np.ceil(np.log2(np.maximum(guess, now) / now)).astype(np.int64))
        whole = ~done & (later > 8 * np.maximum(sizes[mine], cells))
        for i in mine[whole].tolist():
            out[i] = (np.setdiff1d(first[i], second[i]).tolist(), np.setdiff1d(second[i], first[i]).tolist(), 0)
        again = ~done & ~whole
        for size in np.unique(later[again]).tolist():
            todo[size] = np.concatenate([todo.get(size, mine[:0]), mine[again & (later == size)]])
    return out


def likeness(n_first: int, n_second: int, changed: int) -> float:
    """One less the share of both sets' digests that differ; 1 for two empty sets."""
    both = n_first + n_second
    return 1 - changed / both if both else 1.0


def printed(sets: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """The sketches as text: the number of digests and the cells' columns, in base64."""
    return [base64.b64encode(len(keys).to_bytes(4, "little") + b"".join(np.ascontiguousarray(row[c]).tobytes() for c in CELL.names)).decode() for keys, row in zip(sets, sketch(sets, cells))]


def read_printed(text: str) -> tuple[int, np.ndarray]:
    """The number of digests and the sketch of a fingerprint."""
    raw = base64.b64decode(text)
    cells = (len(raw) - 4) // CELL.itemsize
    row, at = np.empty(cells, CELL), 4
    for c in CELL.names:
        row[c] = np.frombuffer(raw, CELL[c], cells, at)
        at += cells * CELL[c].itemsize
    return int.from_bytes(raw[:4], "little"), row


def compare_printed(first: str, second: str) -> tuple[list[int], list[int], float] | None:
    """From two fingerprints alone the digests only in either text and their likeness;
    nothing if too many differ: then print both texts with more cells."""
    (n, a), (m, b) = read_printed(first), read_printed(second)
    done, _, key, sign = peel(subtract(a[None], b[None]))
    if not done[0]:
        return None
    gone, new = key[sign > 0].tolist(), key[sign < 0].tolist()
    return gone, new, likeness(n, m, len(gone) + len(new))


def _above(cuts: list[tuple[int, int]], key: Column) -> Column:
    """How many of the sorted ``cuts`` are at or above ``key``, by a search in two steps."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    coarse, fine = (F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(h).cast("long").alias("h")) for i, h in x]) for x in (cuts[step - 1 :: step] or cuts[-1:], cuts))
    whole = F.size(F.filter(coarse, lambda c: c < key)) * step
    below = whole + F.size(F.filter(F.slice(fine, whole + 1, step), lambda c: c < key))
    return F.lit(len(cuts)) - F.least(below, F.lit(len(cuts)))


def _cuts(rows: DataFrame, per_task: int) -> list[tuple[int, int]]:
    """Borders of the order key that part the rows into tasks: quantiles of the
    identifiers, and for identifiers with more rows than a task's, even steps of the
    texts' hashes. At most 20,000, whatever the table's size: a task streams its part, so
    a longer one takes time, not memory."""
    total = rows.count()
    parts = max(1, min(-(-total // per_task), 20_000))
    if parts == 1:
        return []
    per_task = -(-total // parts)
    marks = rows.agg(F.percentile_approx("at.i", [i / parts for i in range(1, parts)], 10_000)).first()[0]
    cuts = {(i, (1 << 63) - 1) for i in marks}
    for r in rows.groupBy("at.i").count().where(F.col("count") > 2 * per_task).collect():  # fewer than parts / 2
        n = -(-r["count"] // per_task)
        cuts |= {(r.i, -(1 << 63) + (1 << 64) * k // n) for k in range(n)}
    return sorted(cuts)


def fingerprint_versions(docs: DataFrame, cells: int = CELLS, per_task: int = 4_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's sketch beside that of its edited version and of the next one.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_paragraphs, gone, new, cells_edited, cells_next)``: ``gone`` and ``new``
    are the recovered digests that only the text and only the edited text have;
    ``cells_edited`` and ``cells_next`` the sizes of sketch with which the two
    differences peeled (0: compared as sets). Where that is ``cells``,
    ``compare_printed`` gives the same from the strings.

    The next document is the one before in the order of identifiers (equal ones by the
    hash of their text, null the smallest), and after the last the first. The edited
    text is the text with its last ``n_chars // 2`` characters replaced by as many of
    the next one's first.

    The texts are shuffled once, by ranges of (identifier, hash); a task streams its
    range in order and keeps one text, as the text after a range's last comes along as
    an extra row. Null texts are empty, two empty texts are alike; invalid UTF-8 is
    replaced by U+FFFD; a long text's digests are held by one task at a time; repeated
    rows are each other's next; an empty table gives an empty result; a single document
    is its own next; extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(*text_rows(id_col, text_col)).withColumn("text", F.col("text").cast("string"))
    rows = rows.withColumn("at", F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("i"), F.xxhash64("text").alias("h")))
    cuts = _cuts(rows, per_task)
    parts = len(cuts) + 1
    rows = rows.withColumn("part", _above(cuts, F.col("at")))  # part 0 holds the largest identifiers
    heads = {r.part: (r.head.i, r.head.h) for r in rows.groupBy("part").agg(F.max("at").alias("head")).collect()}
    order = sorted(heads)
    extra = [Row(i=heads[nxt][0], h=heads[nxt][1], to=p) for p, nxt in zip(order, [*order[1:], *order[:1]])]
    ghosts = spark.createDataFrame(extra, "i long, h long, to int") if extra else None
    real = rows.select("part", "at", F.lit(0).alias("ghost"), "doc_id", "text")
    if ghosts is not None:
        g = F.broadcast(ghosts)  # one row a part: their number is bounded
        copies = rows.join(g, (F.col("at.i") == g.i) & (F.col("at.h") == g.h)).groupBy("to", "at", "doc_id", "text").count()
        real = real.unionAll(copies.select(F.col("to").alias("part"), "at", F.lit(1).alias("ghost"), "doc_id", "text"))
    real = real.repartitionById(parts, "part").sortWithinPartitions("part", "ghost", F.desc("at"))
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_paragraphs", pa.int64()), ("gone", longs), ("new", longs), ("cells_edited", pa.int64()), ("cells_next", pa.int64())])

    def compare(rows: list[tuple]) -> dict:
        """Of ``(doc_id, text, digests, next text, next digests)``."""
        edited = [(t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode() for _, t, _, after, _ in rows]
        mine, theirs, new = [r[2] for r in rows], [r[4] for r in rows], [digests(e) for e in edited]
        changed, apart = differing(mine, new, cells), differing(mine, theirs, cells)
        return {
            "doc_id": [r[0] for r in rows],
            "n_chars": [len(r[1]) for r in rows],
            "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
            "fingerprint": printed(mine, cells),
            "edited_fingerprint": printed(new, cells),
            "near_edited": [likeness(len(a), len(b), len(x[0]) + len(x[1])) for a, b, x in zip(mine, new, changed)],
            "near_next": [likeness(len(a), len(b), len(x[0]) + len(x[1])) for a, b, x in zip(mine, theirs, apart)],
            "n_paragraphs": [len(x) for x in mine],
            "gone": [np.array(x[0], np.uint64).view(np.int64) for x in changed],
            "new": [np.array(x[1], np.uint64).view(np.int64) for x in changed],
            "cells_edited": [x[2] for x in changed],
            "cells_next": [x[2] for x in apart],
        }

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        before, pairs, held = None, [], 0
        for b in batches:
            for p, ghost, i, t in zip(b["part"].to_pylist(), b["ghost"].to_pylist(), b["doc_id"].to_pylist(), b["text"]):
                text = t.as_py()
                keys = digests(text.encode())
                if before is not None and before[0] == p:
                    pairs.append((*before[1:], text, keys))
                    held += len(before[2]) + len(text)
                before = None if ghost else (p, i, text, keys)
                if held > 4_000_000:
                    yield compare(pairs)
                    pairs, held = [], 0
        if pairs:
            yield compare(pairs)

    types = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long, gone array<long>, new array<long>, cells_edited long, cells_next long"
    return real.select("part", "ghost", "doc_id", "text").mapInArrow(arrow_pass(run, schema), types)
