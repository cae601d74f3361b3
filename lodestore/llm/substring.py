"""Exact removal of repeated word windows with a log-structured fingerprint index.

The index has two kinds of immutable sorted runs, both merged when there are too many:

marks     window fingerprints with the smallest and largest document that hold them:
          bucketed tables, merge-joined with each new batch
verified  digests of those windows whose mark several documents hold, with the smallest
          document: a file a bucket, merged with a batch's digests

A batch's windows whose mark is shared are digested. A mark that one document of the
history held alone points to that document, whose windows of that mark are digested then;
what was shared before lies in the verified runs. So a batch neither digests nor
shuffles the history again, and an index can be kept and opened later.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.common import arrow_pass, drop_path, materialise, scratch_path, text_rows

#: Words of the part of a window whose least hash stands for the window.
GRAM = 5
_MULTIPLIER = 0x9E3779B97F4A7C15


def window_fingerprints(words: list[bytes], window: int, gram: int = GRAM) -> np.ndarray:
    """A fingerprint for each window: the least mixed hash of its ``gram``-word parts.

    Equal windows have equal fingerprints, and neighbours mostly share theirs, so an
    index of the distinct ones is several times smaller than one of all windows.
    """
    gram = min(gram, window)
    if len(words) < window:
        return np.empty(0, np.uint64)
    hash64 = xxhash.xxh3_64_intdigest
    each = np.fromiter(map(hash64, words), np.uint64, len(words))
    n = len(words) - gram + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(gram):
        mixed = mixed * np.uint64(_MULTIPLIER) + each[k : k + n]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    span = window - gram + 1
    least, reach = mixed, 1  # a sliding minimum by doubling
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    return least


class FingerprintIndex:
    """The runs of an index, in a folder of the shared folder.

    When there are more than ``fan_out`` runs of a kind they are merged into one. A new
    batch shuffles itself alone, never the history. ``buckets`` (of both kinds) is fixed
    at first, the verified runs' doubles as they grow, so that a task merges a bounded
    number of digests. ``save`` keeps an index, ``open`` finds it again.
    """

    #: Digests of a bucket of the verified runs, about, before the buckets are doubled.
    FULL = 4_000_000

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_out: int = 4, buckets: int | None = None) -> None:
        self.spark, self.folder, self.fan_out = spark, folder or scratch_path(spark, "index"), fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.slots = self.buckets  # buckets of the verified runs
        self.marks: list[str] = []
        self.verified: list[str] = []
        self.digests = 0

    def save(self) -> None:
        store, at = fs.FileSystem.from_uri(self.folder)
        store.create_dir(at, recursive=True)
        state = {k: getattr(self, k) for k in ("fan_out", "buckets", "slots", "marks", "verified", "digests")}
        with store.open_output_stream(f"{at}/index.new", compression=None) as out:
            out.write(json.dumps(state).encode())
        store.move(f"{at}/index.new", f"{at}/index.json")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        store, at = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{at}/index.json") as source:
            state = json.loads(source.read())
        out = cls(spark, folder)
        out.__dict__.update(state)
        return out

    def _table(self, name: str) -> DataFrame:
        columns = "mark BIGINT, least BIGINT, most BIGINT"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (mark) SORTED BY (mark) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> DataFrame:
        name = f"lodestore_run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "mark").write.option("path", f"{self.folder}/{name}").option("compression", "zstd").bucketBy(self.buckets, "mark").sortBy("mark").saveAsTable(name)
        self.marks.append(name)
        return self._table(name)

    def add(self, marks: DataFrame, keep: bool = True) -> tuple[DataFrame, DataFrame | None]:
        """Index a batch ``(doc_id, mark)``. Of its marks those ``(mark)`` that several
        documents of the batch and the history hold; and of these the ones that one
        document of the history held alone until now, with it: ``(mark, doc_id)``, none
        if there is no history. Without ``keep`` runs are not merged any more."""
        history = [self._table(name) for name in self.marks]
        run = self._write(marks.groupBy("mark").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")))
        unknown = F.lit(None).cast("long")
        shared = run.where("least < most").select("mark", unknown.alias("least"), unknown.alias("most"))
        for old in history:
            shared = shared.unionAll(run.select("mark").join(old.hint("merge"), "mark"))
        if history:
            shared = shared.groupBy("mark").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        shared = materialise(shared, "shared")
        if keep and len(self.marks) > self.fan_out:
            self.compact()
        return shared.select("mark"), shared.where("least = most").select("mark", F.col("least").alias("doc_id")) if history else None

    def compact(self) -> None:
        """Merge all runs of marks into one and delete them: no shuffle, as all have the
        same buckets."""
        old, self.marks = self.marks, []
        rows = self._table(old[0])
        for name in old[1:]:
            rows = rows.unionAll(self._table(name))
        self._write(rows.groupBy("mark").agg(F.min("least").alias("least"), F.max("most").alias("most")))
        for name in old:
            self._drop_marks(name)

    def _drop_marks(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, f"{self.folder}/{name}")

    def drop(self) -> None:
        for name in self.marks:
            self._drop_marks(name)
        drop_path(self.spark, self.folder)
        self.marks, self.verified, self.digests = [], [], 0


#: Bits of a bit map's places: 16 for each number as far as that goes, 64 MB at most.
LEAST_BITS, MOST_BITS = 17, 29


def _sieve(marks: DataFrame) -> tuple[Broadcast, int]:
    """A bit map of the column ``mark`` and its bits, sized by the number of rows up to
    64 MB: it only spares work, as what passes by chance is verified like the rest."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * marks.count()).bit_length()))
    low = 17  # bits to a slice
    slot = F.col("mark").bitwiseAND(F.lit((1 << bits) - 1))
    schema = pa.schema([("slice", pa.int64()), ("map", pa.binary())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            slots = b["slot"].to_numpy()
            for s in np.unique(slots >> low).tolist():
                own = maps.setdefault(s, np.zeros((1 << low) // 8, np.uint8))
                at = slots[slots >> low == s] & ((1 << low) - 1)
                np.bitwise_or.at(own, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield {"slice": list(maps), "map": [m.tobytes() for m in maps.values()]}

    slots = marks.select(slot.alias("slot")).repartition(F.shiftright("slot", low))
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for row in slots.mapInArrow(arrow_pass(run, schema), "slice long, map binary").collect():
        whole[row.slice << (low - 3) : (row.slice + 1) << (low - 3)] |= np.frombuffer(row.map, np.uint8)
    return marks.sparkSession.sparkContext.broadcast(whole), bits


def _marks(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            ids, found = [], []
            for i, t in zip(b["doc_id"].to_pylist(), b["text"]):
                marks = np.unique(window_fingerprints(t.as_py().split(), window))
                if marks.size:
                    ids.append(np.full(len(marks), i, np.int64))
                    found.append(marks.view(np.int64))
            if found:
                yield {"doc_id": np.concatenate(ids), "mark": np.concatenate(found)}

    return docs.select(*text_rows(id_col, text_col)).where("doc_id is not null").mapInArrow(arrow_pass(run, schema), "doc_id long, mark long")


#: One shared window: 96 bits of BLAKE2 of its words, where it is.
ENTRY = np.dtype([("hash", "<u8"), ("check", "<u4"), ("doc", "<i8"), ("crc", "<i4"), ("pos", "<i4")])
#: One window of a verified run: its digest, and the smallest document that holds it.
SEEN = np.dtype([("hash", "<u8"), ("check", "<u4"), ("doc", "<i8")])
#: Entries that a map task gathers before it sends them.
CHUNK = 500_000


def pack(entries: np.ndarray) -> bytes:
    """Entries sorted by hash as compressed columns: differences of the hashes and
    the other columns, each byte by byte in planes."""
    columns = [np.diff(entries["hash"], prepend=np.uint64(0)), *(entries[c] for c in entries.dtype.names[1:])]
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(entries), -1).T.tobytes() for c in columns]
    return len(entries).to_bytes(4, "little") + zstandard.compress(b"".join(planes), 1)


def unpack(data: bytes, dtype: np.dtype = ENTRY) -> np.ndarray:
    n, raw = int.from_bytes(data[:4], "little"), zstandard.decompress(data[4:])
    out, at = np.empty(n, dtype), 0
    for name in dtype.names:
        size = dtype[name].itemsize
        plane = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
        out[name] = np.ascontiguousarray(plane).view(dtype[name]).reshape(n)
        at += n * size
    out["hash"] = np.cumsum(out["hash"], dtype=np.uint64)
    return out


def _new(entries: np.ndarray) -> np.ndarray:
    """Where another window than the one before begins, of entries in order."""
    return np.concatenate([[True], (np.diff(entries["hash"]) != 0) | (np.diff(entries["check"]) != 0)])[: len(entries)]


def judge(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries by window and document, and which have an earlier document there."""
    entries = entries[np.lexsort((entries["pos"], entries["doc"], entries["check"], entries["hash"]))]
    new = _new(entries)
    first = entries["doc"][new][np.cumsum(new) - 1]
    return entries, entries["doc"] > first


def least_documents(parts: list[np.ndarray]) -> np.ndarray:
    """Each window once, with the smallest document, in order."""
    entries = np.concatenate([np.empty(0, SEEN), *(p[list(SEEN.names)].astype(SEEN) for p in parts)])
    entries = entries[np.lexsort((entries["doc"], entries["check"], entries["hash"]))]
    return entries[_new(entries)]


def convicted(entries: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which entries have an earlier document among them or the known windows."""
    both = np.concatenate([known, entries[list(SEEN.names)].astype(SEEN)])
    order = np.lexsort((both["doc"], both["check"], both["hash"]))
    new, out = _new(both[order]), np.zeros(len(both), bool)
    out[order] = both["doc"][order] > both["doc"][order][new][np.cumsum(new) - 1]
    return out[len(known) :]


#: What a packed blob holds: a batch's windows to be judged, its windows that another
#: document of the same map chunk already convicts, windows of the history, nothing.
OPEN, HIT, OLD, NONE = range(4)


def _windows(docs: DataFrame, id_col: str, text_col: str, window: int, sieve: tuple[Broadcast, int], buckets: int, pointed: tuple[Broadcast, int] | None = None) -> DataFrame:
    """The windows whose fingerprint is shared, packed by hash for a bucket each; with
    ``pointed`` (a bit map of identifiers) those of the history's documents in it.

    A task judges its own chunk first: where an earlier document of the chunk has a
    window, that is a hit already, and only the chunk's earliest document goes on. So a
    window that a third of all documents hold sends one document a chunk, however hot
    it is.
    """
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("packed", pa.binary())])
    (bitmap_, bits), old = sieve, pointed is not None

    def flush(parts: list[np.ndarray]) -> dict:
        entries, hit = judge(np.concatenate(parts))
        out: dict = {"bucket": [], "kind": [], "packed": []}
        for kind, some in ((OLD, entries[~hit & _new(entries)]),) if old else ((OPEN, entries[~hit]), (HIT, entries[hit])):
            of = (some["doc"].astype(np.uint64) if kind == HIT else some["hash"]) % np.uint64(buckets)
            order = np.argsort(of, kind="stable")
            some, of = some[order], of[order]
            begin = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0])[: len(of)])
            for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(of)]):
                out["bucket"].append(int(of[s]))
                out["kind"].append(kind)
                out["packed"].append(pack(some[s:e][list(SEEN.names)].astype(SEEN) if old else some[s:e]))
        return out

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bitmap, parts, held = bitmap_.value, [], 0
        for b in batches:
            ids = b["doc_id"].to_numpy()
            if old:
                slots = ids & ((1 << pointed[1]) - 1)
                some = np.flatnonzero(pointed[0].value[slots >> 3] >> (slots & 7).astype(np.uint8) & 1)
            else:
                some = np.arange(len(ids))
            for row in some.tolist():
                i, text = ids[row], b["text"][row].as_py()
                words = text.split()
                slots = (window_fingerprints(words, window) & np.uint64((1 << bits) - 1)).astype(np.int64)
                at = np.flatnonzero(bitmap[slots >> 3] >> (slots & 7).astype(np.uint8) & 1)
                if not at.size:
                    continue
                line = memoryview(b" ".join(words))
                ends = np.cumsum([len(w) + 1 for w in words]) - 1
                begin = np.concatenate([[0], ends[:-1] + 1])[at].tolist()
                digests = b"".join([hashlib.blake2b(line[s:e], digest_size=12).digest() for s, e in zip(begin, ends[at + window - 1].tolist())])
                mine = np.empty(at.size, ENTRY)
                both = np.frombuffer(digests, [("hash", "<u8"), ("check", "<u4")])
                mine["hash"], mine["check"], mine["doc"], mine["pos"] = both["hash"], both["check"], i, at
                mine["crc"] = zlib.crc32(text) - (1 << 31)
                parts.append(mine)
                held += at.size
                if held >= CHUNK:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    rows = docs.select(*text_rows(id_col, text_col)).where("doc_id is not null")
    return rows.mapInArrow(arrow_pass(run, schema), "bucket int, kind int, packed binary")


def _settle(index: FingerprintIndex, packed: DataFrame, keep: bool) -> DataFrame:
    """``(doc_id, crc, pos)``: the batch's windows that an earlier document has, by its
    own, the history's and the verified runs' digests; with ``keep`` the batch's and the
    history's new digests become a verified run, and too many runs are merged.

    A task a bucket holds that bucket's digests alone. It writes its part of a run
    beside and moves it, so a repeated task replaces a file by an equal one.
    """
    spark, folder, buckets, runs = index.spark, index.folder, index.slots, list(index.verified)
    name = f"verified-{uuid.uuid4().hex}"
    merge = keep and len(runs) + 1 > index.fan_out
    after = buckets * 2 if merge and index.digests > buckets * index.FULL else buckets
    schema = pa.schema([("doc_id", pa.int64()), ("crc", pa.int32()), ("pos", pa.int32()), ("written", pa.int64())])

    def settle(bucket: int, held: dict[int, list[np.ndarray]]) -> dict:
        store, at = fs.FileSystem.from_uri(folder)
        before = []
        for r in runs:
            path = f"{at}/{r}/{bucket}"
            if store.get_file_info(path).type == fs.FileType.File:
                with store.open_input_stream(path, compression=None) as source:
                    before.append(unpack(source.read(), SEEN))
        mine, old = least_documents(before), least_documents(held[OLD])
        entries = np.concatenate([np.empty(0, ENTRY), *held[OPEN]])
        found = entries[convicted(entries, least_documents([mine, old]))]
        written = 0
        if keep:
            fresh = least_documents([old, entries])
            fresh = least_documents([mine, fresh]) if merge else fresh[~convicted(fresh, mine)]
            of = fresh["hash"] % np.uint64(after)
            for part in sorted({bucket, bucket + after - buckets}):
                some = fresh[of == part]
                written += len(some)
                if len(some):
                    beside = f"{at}/{name}/{part}.{uuid.uuid4().hex}"
                    store.create_dir(f"{at}/{name}", recursive=True)
                    with store.open_output_stream(beside, compression=None) as out:
                        out.write(pack(some))
                    store.move(beside, f"{at}/{name}/{part}")
        # A row a hit, whatever chunk or bucket found it, and one that tells what was written.
        found = np.concatenate([*held[HIT], found])
        return {"doc_id": [*found["doc"].tolist(), None], "crc": [*found["crc"].tolist(), 0], "pos": [*found["pos"].tolist(), 0], "written": [*[0] * len(found), written]}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        at, held = None, {k: [] for k in range(4)}
        for b in batches:
            for bucket, kind, data in zip(b["bucket"].to_pylist(), b["kind"].to_pylist(), b["packed"]):
                if bucket != at and at is not None:
                    yield settle(at, held)
                    held = {k: [] for k in range(4)}
                at = bucket
                if kind != NONE:
                    held[kind].append(unpack(data.as_py(), SEEN if kind == OLD else ENTRY))
        if at is not None:
            yield settle(at, held)

    if merge:  # every bucket takes part
        packed = packed.unionAll(spark.range(buckets).select(F.col("id").cast("int"), F.lit(NONE), F.lit(None).cast("binary")))
    dealt = packed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    found = materialise(dealt.mapInArrow(arrow_pass(run, schema), "doc_id long, crc int, pos int, written long"), "hits")
    if keep:
        written = found.agg(F.sum("written")).first()[0] or 0
        index.digests = written if merge else index.digests + written
        index.verified, index.slots = ([name] if merge else [*runs, name]), after
        for r in runs if merge else []:
            drop_path(spark, f"{folder}/{r}")
    return found.where("doc_id is not null").select("doc_id", "crc", "pos")


def add_batch(index: FingerprintIndex, batch: DataFrame, history: DataFrame | None, window: int = 13, keep: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, crc, pos)``: the batch's windows that also start in a document with a
    smaller identifier, of the batch or of those indexed before; the batch is indexed.

    ``history`` has the documents indexed before, of which only those are split into
    words whose windows one mark points to for the first time. Their own verdicts are
    not taken back. Without ``keep`` the batch is the index's last.
    """
    shared, first = index.add(_marks(batch, id_col, text_col, window), keep)
    sieve = _sieve(shared)
    packed = _windows(batch, id_col, text_col, window, sieve, index.slots)
    if first is not None:
        if history is None:
            raise ValueError("the index has documents: give the history")
        pointed = _sieve(first.select(F.col("doc_id").alias("mark")).distinct())
        packed = packed.unionAll(_windows(history, id_col, text_col, window, _sieve(first.select("mark")), index.slots, pointed))
    return _settle(index, packed, keep)


def repeated_windows(docs: DataFrame, window: int = 13, batches: int = 3, index: FingerprintIndex | None = None, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, crc, at)``: the documents' windows that also start in a document with
    a smaller identifier, as word offsets; ``crc`` tells rows of one identifier apart.

    The documents enter the index in ``batches`` by identifier, each merge-joined with
    the runs before it. Marks held by several documents only nominate windows: their
    words are compared by a 96-bit digest afterwards. With ``index`` they are added to
    what it holds (``history``) and it is kept; else one is made, whose runs are merged
    before the last batch, and dropped.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    edges = [None, *sorted(set(cuts or [])), None]
    own = index or FingerprintIndex(spark, fan_out=1)
    key: Column = F.col(f"`{id_col}`").cast("long")
    columns = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")]
    hits = None
    for low, high in zip(edges, edges[1:]):
        batch = docs if low is None else docs.where(key > low)
        batch = batch if high is None else batch.where(key <= high)
        before = history.select(*columns) if history is not None else None
        if low is not None:
            earlier = docs.where(key <= low).select(*columns)
            before = earlier if before is None else before.unionAll(earlier)
        found = add_batch(own, batch, before, window, index is not None or high is not None, id_col, text_col)
        hits = found if hits is None else hits.unionAll(found)
    if index is None:
        own.drop()
    else:
        index.save()
    return hits.groupBy("doc_id", "crc").agg(F.collect_list("pos").alias("at"))


def removed(n_words: int, at: np.ndarray, window: int) -> np.ndarray:
    """Which words the windows that start at ``at`` cover."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return np.cumsum(steps[:-1]) > 0


def substring_dedup(docs: DataFrame, window: int = 13, batches: int = 3, index: FingerprintIndex | None = None, history: DataFrame | None = None, rejoin: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` of every document: ``kept`` is the text
    without the words covered by a window of ``window`` words that also starts in a
    document with a smaller identifier, joined by one space; a text that loses
    nothing keeps its white space as it is, unless ``rejoin``.

    Windows are judged on the input, not on what is left. Null and empty texts have
    no words and ``kept`` is empty; a null identifier neither loses words nor counts
    as an earlier document; rows with one identifier don't count as earlier than one
    another; a long text's windows are held by one task at a time; an empty table gives
    an empty result; extra columns are ignored. With ``index`` (and the ``history`` it
    holds) the documents are a new batch.
    """
    hits = repeated_windows(docs, window, batches, index, history, id_col, text_col)
    rows = docs.select(*text_rows(id_col, text_col)).withColumn("crc0", (F.crc32("text") - F.lit(1 << 31)).cast("int"))
    hits = hits.select(F.col("doc_id").alias("id0"), F.col("crc").alias("crc1"), "at")
    both = rows.join(hits.hint("merge"), (rows.doc_id == hits.id0) & (rows.crc0 == hits.crc1), "left").select("doc_id", "text", "at")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for t, at in zip(b["text"], b["at"]):
                text = t.as_py()
                words = text.split()
                n_words.append(len(words))
                if not at.is_valid:
                    n_removed.append(0)
                    kept.append(b" ".join(words) if rejoin else text)
                    continue
                gone = removed(len(words), at.values.to_numpy(zero_copy_only=False), window)
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
            yield {"doc_id": b["doc_id"], "n_words": n_words, "n_removed": n_removed, "kept": kept}

    out = both.mapInArrow(arrow_pass(run, schema), "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def strip_repeats(docs: DataFrame, window: int = 13, batches: int = 3, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the words that ``substring_dedup`` removes taken out of their
    texts, and their number of characters put right where a text changed; rows and
    columns are otherwise as they were."""
    hits = repeated_windows(docs, window, batches, id_col=id_col, text_col=text_col)
    hits = hits.select(F.col("doc_id").alias("i"), F.col("crc").alias("c"), "at")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    text = F.make_valid_utf8(F.coalesce(F.col(f"r.`{text_col}`").cast("string"), F.lit(""))).cast("binary")
    key = (F.col(f"r.`{id_col}`").cast("long") == F.col("i")) & ((F.crc32(text) - F.lit(1 << 31)).cast("int") == F.col("c"))
    both = rows.join(hits.hint("merge"), key, "left").select("r", text.alias("text"), "at")
    names = docs.columns
    chars = names.index(chars_col) if chars_col in names else None

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            columns = b.column(0).flatten()
            texts, sizes = [], []
            for t, at in zip(b.column(1), b.column(2)):
                if not at.is_valid:
                    texts.append(None)
                    sizes.append(None)
                    continue
                words = t.as_py().split()
                gone = removed(len(words), at.values.to_numpy(zero_copy_only=False), window)
                texts.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode("utf-8", "replace"))
                sizes.append(len(texts[-1]))
            for place, new in ((names.index(text_col), texts), (chars, sizes)):
                if place is not None:
                    own = columns[place]
                    columns[place] = pc.coalesce(pa.array(new, pa.string() if new is texts else pa.int64()).cast(own.type), own)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(run, docs.schema)
