"""SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestore.llm.common import arrow_pass, materialise, text_rows
from lodestore.llm.components import connected_components

#: Shingles hashed at a time, so that a long text's bits never lie in memory at once.
BLOCK = 4096


def shingle_hashes(words: list[bytes], n: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``n`` words joined by a space; of all the words if they
    are fewer; none for no words."""
    if not words:
        return np.empty(0, np.uint64)
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - n + 1)
    last = ends[min(n, len(words)) - 1 :]
    hash64 = xxhash.xxh64_intdigest
    return np.fromiter((hash64(line[s:e], seed) for s, e in zip(starts[:k].tolist(), last.tolist())), np.uint64, k)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the SimHash of each whole text's ``n``-word shingles, A-Z
    lowered, repeats counted. Null and empty texts have fingerprint 0; a null
    identifier stays null; repeated rows stay."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "fp": [signed(majority(shingle_hashes(t.as_py().lower().split(), n))) for t in b["text"]]}

    return docs.select(*text_rows(id_col, text_col)).mapInArrow(arrow_pass(run, schema), "doc_id long, fp long")


def covering_masks(bits: list[int], radius: int, seed: int = 7) -> list[int]:
    """Masks such that any two numbers that differ in at most ``radius`` of ``bits``
    agree on all bits of some mask.

    Each bit position gets a non-zero vector of GF(2)^(radius+1), all vectors about
    equally often; mask v holds the positions whose vector has odd inner product
    with v. At most ``radius`` vectors span less than the whole space, so some
    non-zero v is orthogonal to all of them, and its mask avoids those positions.
    """
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(len(bits))]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << b for b, x in zip(bits, vectors) if (x & v).bit_count() & 1) for v in range(1, size)]


def tables(radius: int, parts: int = 1, width: int = 64) -> list[int]:
    """The masks of all tables: with several parts, numbers within ``radius`` are
    within ``radius // parts`` on one part at least, which has tables of its own."""
    out = []
    for p in range(parts):
        out += covering_masks(list(range(width * p // parts, width * (p + 1) // parts)), radius // parts, seed=7 + p)
    return out


def _forest(node: np.ndarray, fp: np.ndarray, close, keep: list) -> None:
    """Append to ``keep`` a spanning forest of the links inside one bucket: each
    node is compared with all nodes not yet reached, so no link between two trees
    is missed, and at most one edge a node comes out."""
    left = np.arange(len(node))
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            at = queue.pop()
            hit = close(at, left)
            if hit.any():
                new = left[hit]
                keep.append((np.full(len(new), node[at]), node[new]))
                queue.extend(new.tolist())
                left = left[~hit]


def covering_links(points: DataFrame, radius: int, parts: int = 1, bucket: int = 20_000) -> DataFrame:
    """Links ``(a, b)`` whose closure is that of all pairs within ``radius``.

    ``points`` has ``fp long`` and ``node long``, distinct by node; each point enters
    one bucket a table.
    """
    rows = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(tables(radius, parts))])
    return bucket_links(points.select("node", "fp", F.explode(rows).alias("e")).select("node", "fp", "e.t", "e.key"), radius, bucket=bucket)


def bucket_links(entries: DataFrame, radius: int, bucket: int = 20_000) -> DataFrame:
    """Links ``(a, b)`` whose closure is that of all pairs that share a bucket
    ``(t, key)`` and are within ``radius``.

    ``entries`` has ``node long``, ``fp long``, ``t int`` and ``key long``: two nodes are
    linked if their ``fp`` differ in at most ``radius`` bits. Each
    bucket gives a spanning forest of its links, never all its pairs. A bucket of
    over ``bucket`` points is split into blocks, and every pair of blocks is compared
    in a group of its own, so large buckets are exact too and no task holds more than
    two blocks.
    """
    counts = entries.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    large = materialise(counts.where(F.col("n") > bucket).select("t", "key", F.ceil(F.col("n") / bucket).cast("int").alias("blocks")), "buckets")
    if large.isEmpty():
        dealt = entries.withColumn("g", F.lit(0)).withColumn("mine", F.lit(0))
    else:
        # Block i meets block j in group (i, j), i <= j; a small bucket is group (0, 0).
        other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
        dealt = entries.join(large, ["t", "key"], "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")).withColumn("other", other)
        dealt = dealt.withColumn("g", F.least("mine", "other") * 65536 + F.greatest("mine", "other")).drop("blocks", "other")
    dealt = dealt.repartition("t", "key", "g").sortWithinPartitions("t", "key", "g", "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    limit = radius

    def links(node: np.ndarray, fp: np.ndarray, mark: np.ndarray) -> dict:
        """Of sorted rows whose bucket changes where ``mark`` does."""
        cut = np.flatnonzero(mark[1:] != mark[:-1]) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(mark)]])
        keep: list = []
        two = begin[end - begin == 2]
        if two.size:
            ok = np.bitwise_count(fp[two] ^ fp[two + 1]) <= limit
            keep.append((node[two[ok]], node[two[ok] + 1]))
        for s, e in zip(begin[end - begin > 2].tolist(), end[end - begin > 2].tolist()):
            f = fp[s:e]
            _forest(node[s:e], f, lambda at, left, f=f: np.bitwise_count(f[left] ^ f[at]) <= limit, keep)
        a, b = (np.concatenate(x) for x in zip(*keep)) if keep else (np.empty(0, np.int64),) * 2
        return {"a": a, "b": b}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held = None
        for batch in batches:
            now = {k: batch[k].to_numpy(zero_copy_only=False) for k in ("node", "t", "key", "g")}
            now["fp"] = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            if held is not None:
                now = {k: np.concatenate([held[k], now[k]]) for k in now}
            change = (np.diff(now["t"]) != 0) | (now["key"][1:] != now["key"][:-1]) | (np.diff(now["g"]) != 0)
            at = np.flatnonzero(change)
            tail = int(at[-1]) + 1 if at.size else 0  # the last bucket may go on in the next batch
            if tail:
                yield links(now["node"][:tail], now["fp"][:tail], np.concatenate([[0], np.cumsum(change)])[:tail])
            held = {k: v[tail:] for k, v in now.items()}
        if held is not None and len(held["fp"]) > 1:
            yield links(held["node"], held["fp"], np.zeros(len(held["fp"]), np.int8))

    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return dealt.mapInArrow(arrow_pass(run, schema), out)


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every document.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest identifier reachable (nulls aside; null if all
    are null). Equal fingerprints collapse to one node first, so a group of copies
    costs one point whatever its size. Null and empty texts share fingerprint zero and
    are linked like any other; invalid UTF-8 is replaced by U+FFFD; a long text's hashes
    are counted in blocks; repeated rows stay; an empty table gives an empty result;
    extra columns are ignored.
    """
    marks = materialise(fingerprints(docs, n, id_col, text_col), "fingerprints")
    points = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    found = connected_components(covering_links(points.select("fp", F.col("fp").alias("node")), radius))
    classes = points.join(found, points.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component").select(F.col("fp").alias("p"), "component_id")
    return marks.join(classes, marks.fp == classes.p).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The long fingerprint: ``PARTS`` parts of ``PART`` bits, each with covering tables of
#: radius ``NEAR`` (7 masks). Sets with similarity 0.8 agree on a mask of one part with a
#: chance of 0.42 (4,000 drawn pairs), so on none of all with one of 0.58^40 = 3e-10
#: (0.73^40 = 4e-6 for sets of 4 and 5, where more bits differ); more similar ones less.
PARTS, PART, NEAR = 40, 24, 2
#: Parts whose links are closed before the others look for links between the clusters.
FIRST = 4
#: Its leading 64-bit words that nominated texts are compared by.
WORDS = 4
_SALTS = np.arange(1, PARTS * PART // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def long_majority(hashes: np.ndarray) -> bytes:
    """The SimHash of ``PARTS * PART`` bits: those set in over half of the mixed hashes."""
    ones = np.zeros(PARTS * PART, np.int64)
    for i in range(0, len(hashes), 255):  # as many as a byte counts
        x = hashes[i : i + 255, None] + _SALTS
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def _part_masks(part: int) -> list[np.ndarray]:
    """The covering masks of a part, dealt to lists by the lowest bit of their number, so
    that all masks of list j hold the positions whose vector is ``1 << j``."""
    masks = covering_masks(list(range(PART)), NEAR, seed=7 + part)
    return [np.array([masks[v - 1] for v in range(1, len(masks) + 1) if v & -v == 1 << j], np.int64) for j in range(NEAR + 1)]


def _shared_bits(lists: list[np.ndarray], j: int) -> int:
    """The positions whose vector is ``1 << j``."""
    return int(np.bitwise_and.reduce(lists[j]) & ~np.bitwise_or.reduce([x[0] for i, x in enumerate(lists) if i != j]))


def _distance(x: np.ndarray) -> np.ndarray:
    """Bits set in each row of four words."""
    n = np.bitwise_count(x).view(np.uint32)[:, 0]
    n = (n & np.uint32(0xFF00FF)) + (n >> np.uint32(8) & np.uint32(0xFF00FF))
    return (n & np.uint32(0xFFFF)) + (n >> np.uint32(16))


#: Texts of one mask's bucket up to which its pairs are compared all at once.
PAIRS = 1024


def _bucket_stars(masks: np.ndarray, node: np.ndarray, part: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges whose closure is that of all pairs of rows that agree on a mask of ``part``
    and differ in at most ``LOOSE`` bits of ``words``: at most one edge a node. ``node``
    is sorted; rows of one node are linked already."""
    first = np.searchsorted(node, node)
    label = first.copy()

    def merge(found: list) -> None:
        nonlocal label
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (label[:0],) * 2
        found.clear()
        while (apart := label[a] != label[b]).any():
            a, b = a[apart], b[apart]
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while ((up := label[label]) != label).any():
                label = up

    def close(at: int, left: np.ndarray) -> np.ndarray:
        return _distance(words[left] ^ words[at]) <= LOOSE

    for m in masks:
        order = np.argsort(part & m, kind="stable")
        key = (part & m)[order]
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        found: list = []
        for s, e in zip(begin[end - begin > PAIRS].tolist(), end[end - begin > PAIRS].tolist()):
            rows = order[s:e]
            _forest(rows, rows, lambda at, left, rows=rows: close(rows[at], rows[left]), found)
        merge(found)
        last = np.repeat(np.where(end - begin > PAIRS, begin, end), end - begin)  # none in large buckets
        at, step, held = np.arange(len(key)), 1, 0
        while (at := at[at + step < last[at]]).size:
            a, b = order[at], order[at + step]
            some = label[a] != label[b]
            a, b = a[some], b[some]
            hit = _distance(words[a] ^ words[b]) <= LOOSE
            if hit.any():
                found.append((a[hit], b[hit]))
                held += len(found[-1][0])
                if held > 1 << 16:
                    merge(found)
                    held = 0
            step += 1
        merge(found)
    leaf = np.flatnonzero((first == np.arange(len(first))) & (label != first))
    return node[leaf], node[label[leaf]]


def nominations(points: DataFrame, parts: range = range(PARTS)) -> DataFrame:
    """Links ``(a, b)`` whose closure is that of all pairs whose long fingerprints agree
    on a covering mask of one of ``parts`` and differ in at most ``LOOSE`` of the leading bits.

    ``points`` has ``node long`` and ``bits binary`` (of ``long_majority``); points of one
    node count as linked. By the masks' covering, no pair within ``PARTS * (NEAR + 1) - 1``
    bits lacks such a mask of all parts. The masks of a part are dealt to ``NEAR + 1`` lists, and a point goes
    once to each list by the three or four bits that the list's masks share, so a task
    holds 48 bytes of each point with these bits: up to a sixteenth or an eighth of
    all points of unlike texts, and every point of one large cluster.
    """
    lists = {p: _part_masks(p) for p in parts}
    names = [f"w{i}" for i in range(WORDS)]
    schema = pa.schema([("e", pa.int64()), ("node", pa.int64()), *[(c, pa.int64()) for c in names]])
    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def deal(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            node = b["node"].to_numpy(zero_copy_only=False)
            raw = np.frombuffer(b"".join(b["bits"].to_pylist()), np.uint8).reshape(len(node), -1)
            words = np.ascontiguousarray(raw[:, : 8 * WORDS]).view(np.int64)
            for p, masks in lists.items():
                part = raw[:, 3 * p].astype(np.int64) << 16 | raw[:, 3 * p + 1].astype(np.int64) << 8 | raw[:, 3 * p + 2]
                for j in range(len(masks)):
                    bucket = part & _shared_bits(masks, j) | (p * len(masks) + j) << PART
                    yield {"e": bucket << PART | part, "node": node} | {c: words[:, i] for i, c in enumerate(names)}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: list = []

        def stars() -> dict:
            e, node, *words = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(node, kind="stable")  # so that the smallest node is a star's centre
            p, j = divmod(int(e[0] >> 2 * PART), NEAR + 1)
            a, b = _bucket_stars(lists[p][j], node[order], e[order] & ((1 << PART) - 1), np.stack(words, axis=1)[order].view(np.uint64))
            return {"a": a, "b": b}

        for batch in batches:
            now = [batch[c].to_numpy(zero_copy_only=False) for c in ("e", "node", *names)]
            bucket = now[0] >> PART
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for s, t in zip(cuts[:-1], cuts[1:]):
                if held and held[-1][0][0] >> PART != bucket[s]:
                    if sum(len(x[0]) for x in held) > 1:
                        yield stars()
                    held.clear()
                held.append([x[s:t] for x in now])
        if held and sum(len(x[0]) for x in held) > 1:
            yield stars()

    entries = points.select("node", "bits").mapInArrow(arrow_pass(deal, schema), "e long, node long, " + ", ".join(f"{c} long" for c in names))
    dealt = entries.repartition(F.shiftright("e", PART)).sortWithinPartitions("e")
    return dealt.mapInArrow(arrow_pass(run, pairs), "a long, b long")


def nominated(points: DataFrame) -> DataFrame:
    """``(node, component)``: the closure of all parts' ``nominations``, of nodes that have
    one. The first parts' clusters stand as one node each in the others, so that the many
    buckets that a cluster's points share give no edge again."""
    near = connected_components(nominations(points, range(FIRST)))
    groups = near.select(F.col("node").alias("member"), "component")
    named = points.join(groups, points.node == groups.member, "left").select(F.coalesce("component", points.node).alias("node"), "bits")
    rest = nominations(named, range(FIRST, PARTS))
    return connected_components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(rest))


def exact_links(texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` whose closure is that of all pairs of a cluster that differ in
    at most ``LOOSE`` bits and whose shingles' exact Jaccard similarity is at least
    ``similarity``.

    ``texts`` has ``cluster long``, ``node long``, ``wide binary``, ``text binary`` and
    ``blocks int``, distinct by node. Block i meets block j in group (i, j), i <= j.
    """
    schema = pa.schema([("cluster", pa.int64()), ("node", pa.int64()), ("blocks", pa.int32()), ("wide", pa.binary()), ("shingles", pa.binary())])
    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def shingle(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {k: b[k] for k in ("cluster", "node", "blocks", "wide")} | {"shingles": [np.unique(shingle_hashes(t.as_py().lower().split(), n)).tobytes() for t in b["text"]]}

    def links(held: list) -> dict:
        node = np.array([x[0] for x in held], np.int64)
        wide = np.frombuffer(b"".join(x[1] for x in held), np.uint64).reshape(len(held), -1)
        sets = [np.frombuffer(x[2], np.uint64) for x in held]
        sizes = np.array([len(x) for x in sets])

        def close(at: int, left: np.ndarray) -> np.ndarray:
            size, near = sizes[at], sizes[left]
            hit = (np.minimum(near, size) >= similarity * np.maximum(near, size) - 1e-6) & (np.bitwise_count(wide[left] ^ wide[at]).sum(axis=1) <= LOOSE)
            if size and hit.any():
                some = left[hit]
                flat = np.concatenate([sets[i] for i in some.tolist()])
                found = sets[at][np.minimum(np.searchsorted(sets[at], flat), size - 1)] == flat
                shared = np.add.reduceat(found, np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
                hit[hit] = shared / (size + sizes[some] - shared) >= similarity
            return hit

        keep: list = []
        _forest(node, wide, close, keep)
        a, b = (np.concatenate(x) for x in zip(*keep)) if keep else (np.empty(0, np.int64),) * 2
        return {"a": a, "b": b}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        at, held = None, []
        for b in batches:
            for *group, node, wide, shingles in zip(b["cluster"].to_pylist(), b["g"].to_pylist(), b["node"].to_pylist(), b["wide"].to_pylist(), b["shingles"]):
                if group != at and held:
                    yield links(held)
                    held = []
                at = group
                held.append((node, wide, shingles.as_py()))
        if held:
            yield links(held)

    sets = texts.mapInArrow(arrow_pass(shingle, schema), "cluster long, node long, blocks int, wide binary, shingles binary")
    mine, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.withColumn("mine", mine).withColumn("other", other)
    dealt = dealt.withColumn("g", F.least("mine", "other") * F.lit(65536).cast("long") + F.greatest("mine", "other"))
    dealt = dealt.select("cluster", "g", "node", "wide", "shingles").repartition("cluster", "g").sortWithinPartitions("cluster", "g", "node")
    return dealt.mapInArrow(arrow_pass(run, pairs), "a long, b long")


def _named(c: str) -> list:
    """A non-null key of a nullable identifier."""
    return [F.coalesce(c, F.lit(0)).alias("i"), F.col(c).isNull().alias("unnamed")]


#: Of the 256 leading bits, those in which nominated texts may differ. Of sets with
#: similarity 0.8, 39 differ on average, 48 at most of small ones (with 6 as standard deviation).
LOOSE = 80
#: Shingles of a block of texts that are compared with one another.
SHINGLES = 2_000_000


def _hashed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """``(own, text, h, check)``: the identifier, the text (null as empty) and two hashes
    that together tell texts apart: 128 bits."""
    text = F.make_valid_utf8(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("own"), text.alias("text"), *more)
    return rows.withColumn("h", F.xxhash64("text")).withColumn("check", F.xxhash64(F.lit(1), "text"))


def _classes(docs: DataFrame, n: int, similarity: float, most: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(h, check, component)`` of each distinct text, and of each component its first
    text: ``(component, least, h, check)``. See ``similar_groups``."""
    if similarity < 0.8:
        raise ValueError("the tables miss pairs of a similarity below 0.8")
    schema = pa.schema([("own", pa.int64()), ("h", pa.int64()), ("check", pa.int64()), ("bits", pa.binary()), ("size", pa.int64())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            bits, sizes = [], []
            for t in b["text"].cast(pa.binary()):
                shingles = np.unique(shingle_hashes(t.as_py().lower().split(), n))
                bits.append(long_majority(shingles))
                sizes.append(len(shingles))
            yield {k: b[k] for k in ("own", "h", "check")} | {"bits": bits, "size": sizes}

    texts = _hashed(docs, f"`{id_col}`", f"`{text_col}`")
    marks = texts.mapInArrow(arrow_pass(run, schema), "own long, h long, check long, bits binary, size long")
    points = marks.groupBy("h", "check").agg(F.min("own").alias("least"), *[F.first(c).alias(c) for c in ("bits", "size")])
    # Written once, so the numbers stay as they are: a node of its own for each text.
    points = materialise(points.withColumn("node", F.monotonically_increasing_id()), "points")
    clusters = nominated(points.select("node", "bits")).select(F.col("node").alias("member"), F.col("component").alias("cluster"))
    # Only a row that has a text's smallest identifier stands for it, so that copies meet nowhere.
    members = materialise(clusters.join(points, F.col("member") == points.node).select("cluster", "node", "h", "check", F.substring("bits", 1, 8 * WORDS).alias("wide"), "size", *_named("least")), "members")
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum("size") / most).cast("int").alias("blocks")).withColumn("blocks", F.greatest("blocks", F.lit(1)))
    key = ["i", "unnamed", "h", "check"]
    found = texts.select("text", "h", "check", *_named("own")).join(members, key).dropDuplicates(key).join(blocks, "cluster")
    links = exact_links(found.select("cluster", "node", "wide", "blocks", F.col("text").cast("binary").alias("text")), n, similarity)
    joined = connected_components(links).select(F.col("node").alias("member"), "component")
    classes = points.join(joined, points.node == joined.member, "left").select("h", "check", "least", F.coalesce("component", "node").alias("component"))
    first = classes.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "h", "check")).alias("first"))
    return classes, first.select("component", "first.least", "first.h", "first.check")


def similar_groups(docs: DataFrame, n: int = 5, similarity: float = 0.8, most: int = SHINGLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(h, check, keeper, kept_h, kept_check)``: the group of each distinct text, by
    two 64-bit hashes of its bytes: the group's smallest identifier, and the text it has.

    Two texts are linked if the Jaccard similarity of their distinct ``n``-word
    shingles is at least ``similarity``, counted on the whole sets of 64-bit hashes
    (texts without words are alike). To find such pairs, texts have SimHash fingerprints
    of ``PARTS * PART`` bits with covering tables for each part; those that share a
    bucket and differ in at most ``LOOSE`` of the 256 leading bits are chained to
    clusters, whose texts are then compared exactly; a cluster of over
    ``most`` shingles is split into blocks and every pair of blocks compared. The
    tables are made for a ``similarity`` of 0.8 and more: see ``PARTS``.

    Null and empty texts are one text; invalid UTF-8 is replaced by U+FFFD; a long
    text's shingles are held by one task at a time; repeated rows are one text; null
    identifiers come last; an empty table gives an empty result; extra columns are
    ignored.
    """
    classes, first = _classes(docs, n, similarity, most, id_col, text_col)
    kept = first.select("component", F.col("least").alias("keeper"), F.col("h").alias("kept_h"), F.col("check").alias("kept_check"))
    return classes.join(kept, "component").select("h", "check", "keeper", "kept_h", "kept_check")


def drop_near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest
    identifier (null the last), with all its columns.

    Empty and null texts are one group. Of repeated rows of the kept document one
    stays. An empty table gives an empty result; extra columns pass through.
    """
    _, first = _classes(docs, n, similarity, SHINGLES, id_col, text_col)
    # Both sides share one non-null key, so that the join and the window shuffle once.
    kept = materialise(first.select(*_named("least"), "h", "check"), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    rows = _hashed(rows, f"r.`{id_col}`", f"r.`{text_col}`", "r").select("r", *_named("own"), "h", "check")
    key = ["i", "unnamed", "h", "check"]
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("h"))
    return rows.join(kept.hint("merge"), key).withColumn("turn", turn).where("turn = 1").select("r.*")
