"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a folder of files in the shared folder, one a shard and level:

level 1   the words' 64-bit hashes as an Elias-Fano sequence, and their counts
level n   for the nodes of level n-1 that live in this shard (contexts) monotone
          pointers to their children's ends as one Elias-Fano sequence; the children's
          word identifiers as another, made monotone by adding the vocabulary's size
          once a context before; a quantised probability for each child and a
          quantised back-off weight for each context

A node lives in its parent's shard, a word in that of its hash; the children of the few
hot contexts are dealt by their own word's shard. A word's children are found by a
successor search between its context's pointers. Files are memory-mapped, so a worker's
own memory doesn't grow with the model.

Texts are split into tokens once: training and scoring read packed chunks of them.
"""

from __future__ import annotations

import mmap
import sys
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import arrow_pass, materialise, scratch_path, text_rows

#: The hash of the token that ends each text; no word holds a space.
END = xxhash.xxh64_intdigest(b" end", 0)
#: Quantised probabilities: equal steps of the logarithm from 1 down to 10**-LOWEST.
LEVELS, LOWEST = 65536, 8.0
#: Quantised back-off weights.
WIDE_LEVELS, WIDE_LOWEST = 65536, 6.0
#: Ones (zeros) of the upper bits between two entries of an Elias-Fano directory; where
#: as many lie over more bits than ``FAR``, the directory has the place of each.
STRIDE, FAR = 32, 512
MAGIC = 0x4C4F4445


# ---------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A monotone sequence of 64-bit numbers as bit-packed arrays that may be mapped.

    The low bits lie packed; the upper parts in unary, as a bit string in which the
    i-th one stands at place ``upper(i) + i + 1``; there are two to four times as many
    upper parts as numbers, so most have one at most. Directories hold where each
    ``STRIDE``-th one and zero stand, and every one of a stride that is drawn out, so
    that a search starts near the right word however unevenly the numbers lie.
    """

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray, all_ones: np.ndarray, zeros: np.ndarray, all_zeros: np.ndarray) -> None:
        self.head, self.low, self.high = head, low, high
        self.ones, self.zeros = (ones, all_ones), (zeros, all_zeros)
        self.n, self.bits, self.top = (int(x) for x in head)  # ``top``: the largest upper part

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        last = int(values[-1]) if n else 0
        bits = max(0, (last // n).bit_length() - 2) if n else 0
        upper, top = values >> np.uint64(bits), last >> bits
        places = upper + np.arange(1, n + 1, dtype=np.uint64)
        high = np.zeros((top + n + 1) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63)))
        # Zero k stands before the elements with upper part k, zero 0 at the start.
        zeros = np.zeros(top + 1, np.int64)
        zeros[1:] = np.cumsum(np.bincount(upper.astype(np.int64), minlength=top + 1)[:-1]) + np.arange(1, top + 1)
        return cls(np.array([n, bits, top], np.uint64), _pack_bits(values & np.uint64((1 << bits) - 1), bits), high, *_directory(places.astype(np.int64)), *_directory(zeros))

    def arrays(self) -> list[np.ndarray]:
        return [self.head, self.low, self.high, *self.ones, *self.zeros]

    @classmethod
    def mapped(cls, arrays: Iterator[np.ndarray]) -> EliasFano:
        return cls(*(next(arrays) for _ in range(7)))

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        value = self.low[word] >> shift
        spill = np.flatnonzero(shift > np.uint64(64 - self.bits))
        value[spill] |= self.low[word[spill] + 1] << (np.uint64(64) - shift[spill])
        return value & np.uint64((1 << self.bits) - 1)

    def _place(self, k: np.ndarray, directory: tuple[np.ndarray, np.ndarray], flip: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Where the k-th one (zero, if ``flip`` has all bits) of the upper bits stands,
        and whether its stride is drawn out."""
        block, left = k >> 5, k & (STRIDE - 1)
        place = directory[0][block].astype(np.int64)
        far = place < 0
        if far.any():
            place[far] = directory[1][-1 - place[far] + left[far]]
            left[far] = 0
        word = place >> 6
        some = (self.high[word] ^ flip) & (~np.uint64(0) << (place & 63).astype(np.uint64))
        here = np.bitwise_count(some).astype(np.int64)
        move = np.flatnonzero(left >= here)
        while move.size:
            left[move] -= here[move]
            word[move] += 1
            some[move] = self.high[word[move]] ^ flip
            here[move] = np.bitwise_count(some[move])
            move = move[left[move] >= here[move]]
        return (word << 6) + _select(some, left), far

    def _next_zero(self, place: np.ndarray) -> np.ndarray:
        """The first zero of the upper bits at or after each place."""
        word = place >> 6
        free = ~self.high[word] & (~np.uint64(0) << (place & 63).astype(np.uint64))
        full = np.flatnonzero(free == 0)
        while full.size:
            word[full] += 1
            free[full] = ~self.high[word[full]]
            full = full[free[full] == 0]
        return (word << 6) + np.bitwise_count((free & (~free + np.uint64(1))) - np.uint64(1)).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The elements at these places."""
        upper = self._place(at, self.ones, np.uint64(0))[0] - at - 1
        return (upper.astype(np.uint64) << np.uint64(self.bits)) | self._lows(at)

    def all(self) -> np.ndarray:
        """All elements."""
        places = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        return ((places - np.arange(1, self.n + 1)).astype(np.uint64) << np.uint64(self.bits)) | self._lows(np.arange(self.n))

    def successor(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each value the place of the first element at least as large, ``n`` if
        none is, and whether it is equal; searched from ``begin`` to before ``end``, if
        the element, or the place where it would be, is known to lie there."""
        values = values.astype(np.uint64, copy=False)
        if not self.n:
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        upper = (values >> np.uint64(self.bits)).astype(np.int64)
        beyond = np.flatnonzero((upper > self.top) | (upper < 0))
        upper[beyond] = 0
        # The elements with this upper part are the ones between two zeros.
        a, far = self._place(upper, self.zeros, ~np.uint64(0))
        a += 1
        last = self._next_zero(a) if not far.any() else np.empty_like(a)
        if far.any():
            near = np.flatnonzero(~far)
            last[near] = self._next_zero(a[near])
            high = np.flatnonzero(far & (upper < self.top))
            last[high] = self._place(upper[high] + 1, self.zeros, ~np.uint64(0))[0]
            last[far & (upper == self.top)] = self.n + self.top + 1
        upper += 1
        a -= upper
        last -= upper
        if begin is not None:
            np.maximum(a, begin, out=a)
            np.minimum(last, end, out=last)
        low = values & np.uint64((1 << self.bits) - 1)
        equal = np.zeros(len(values), bool)
        # Mostly one element or none; a binary search where the first is too small.
        some = np.flatnonzero(a < last)
        mine, sought = self._lows(a[some]), low[some]
        equal[some] = mine == sought
        more = some[mine < sought]
        a[more] += 1
        open_ = more[a[more] < last[more]]
        found, b, part = open_, last, last[open_]
        while open_.size:
            mid = (a[open_] + b[open_]) >> 1
            less = self._lows(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        inside = found[a[found] < part]
        equal[inside] = self._lows(a[inside]) == low[inside]
        a[beyond], equal[beyond] = self.n, False
        return a, equal


def _directory(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each ``STRIDE``-th, or ``-1 - i`` where the places of the whole
    stride stand from ``i`` in the second array."""
    first = places[::STRIDE].copy()
    last = places[np.minimum(np.arange(len(first)) * STRIDE + STRIDE - 1, len(places) - 1)] if len(first) else first
    far = np.flatnonzero(last - first > FAR)
    at = far[:, None] * STRIDE + np.arange(STRIDE)
    first[far] = -1 - np.arange(len(far)) * STRIDE
    if not len(places) or places[-1] < 1 << 31:
        first = first.astype(np.int32)
    return first, places[np.minimum(at, len(places) - 1)].reshape(-1) if len(far) else np.empty(0, np.int64)


def _pack_bits(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if bits:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, values << shift)
        spill = shift > np.uint64(64 - bits)
        np.bitwise_or.at(out, word[spill] + 1, values[spill] >> (np.uint64(64) - shift[spill]))
    return out


_ONES, _HIGHS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: The place of the k-th one of a byte, at ``byte * 8 + k``.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[k] for byte in range(256) for k in range(8)], np.int64)


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one (from 0) of each word: the byte by sums of the bytes'
    ones in one multiplication, the place in the byte by a table."""
    x = words - ((words >> np.uint64(1)) & np.uint64(0x5555555555555555))
    x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
    sums = ((x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _ONES
    # A byte's high bit stays where its sum is at most k; their number is the byte sought.
    under = ((k.astype(np.uint64) * _ONES | _HIGHS) - sums) & _HIGHS
    shift = np.bitwise_count(under).astype(np.uint64) << np.uint64(3)
    before = (sums << np.uint64(8) >> shift) & np.uint64(255)
    byte = (words >> shift) & np.uint64(255)
    return shift.astype(np.int64) + _IN_BYTE[(byte.astype(np.int64) << 3) + (k - before.astype(np.int64))]


# -------------------------------------------------------------- quantisation


def quantise(p: np.ndarray, levels: int, lowest: float) -> np.ndarray:
    """Codes of probabilities, rounded down, so that sums don't pass 1."""
    code = np.ceil(-np.log10(np.maximum(p, 10.0**-lowest)) / lowest * (levels - 1) - 1e-9)
    return np.minimum(code, levels - 1).astype(np.uint8 if levels <= 256 else np.uint16)


@cache
def _values(levels: int, lowest: float) -> np.ndarray:
    return 10.0 ** (-np.arange(levels) * lowest / (levels - 1))


def dequantise(code: np.ndarray, levels: int, lowest: float) -> np.ndarray:
    return _values(levels, lowest)[code]


# --------------------------------------------------------------------- files


def write_arrays(path: str, arrays: list[np.ndarray]) -> None:
    """Arrays in one file, each at a multiple of 8 bytes; written beside and moved, so
    that a repeated task replaces a file by an equal one."""
    store, at = fs.FileSystem.from_uri(path)
    head = [MAGIC, len(arrays)]
    for a in arrays:
        head += [ord(a.dtype.kind) << 8 | a.dtype.itemsize, len(a)]
    store.create_dir(at.rpartition("/")[0], recursive=True)
    beside = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(beside, compression=None) as out:
        out.write(np.array(head, np.int64).tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(bytes(-a.nbytes % 8))
    store.move(beside, at)


def map_arrays(path: str) -> Iterator[np.ndarray]:
    """The arrays of a file, memory-mapped; a file of a remote store is read into memory."""
    store, at_ = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        with open(at_, "rb") as file:  # a mapping needs no open file, and there may be thousands
            more = {"trackfd": False} if sys.version_info >= (3, 13) else {}
            data = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **more), np.uint8)
    else:
        with store.open_input_file(at_) as source:
            data = np.frombuffer(source.read_buffer(), np.uint8)
    magic, n = data[:16].view(np.int64).tolist()
    if magic != MAGIC:
        raise ValueError(f"no model file: {path}")
    head, at = data[16 : 16 + 16 * n].view(np.int64).reshape(n, 2).tolist(), 16 + 16 * n
    for kind, size in head:
        dtype = np.dtype(f"{chr(kind >> 8)}{kind & 255}")
        yield data[at : at + size * dtype.itemsize].view(dtype)
        at += -(-size * dtype.itemsize // 8) * 8


# ---------------------------------------------------------------------- model


@dataclass(frozen=True)
class Plan:
    """Where a model's files are, and the few numbers that all its shards share."""

    folder: str
    shards: int
    total: int  # training tokens
    words: tuple[int, ...]  # the first word identifier of each vocabulary shard; their number
    nodes: tuple[tuple[int, ...], ...] = ()  # for each level from 2 on, the same of its nodes
    hot: tuple[dict[int, float], ...] = ()  # for each level from 2 on, its hot contexts' back-off weights

    @property
    def distinct(self) -> int:
        return self.words[-1]


def home(first: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The shard in which a node lives, of the shards' first ones; of any other number some shard."""
    return np.clip(np.searchsorted(first, node, side="right") - 1, 0, len(first) - 2)


def build_vocabulary(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return [*EliasFano.of(hashes).arrays(), counts.astype(np.int64)]


def build_level(hot: np.ndarray, ends: np.ndarray, context: np.ndarray, word: np.ndarray, distinct: int, code: np.ndarray, back: np.ndarray) -> list[np.ndarray]:
    """Arrays of a shard's n-grams, sorted by context and word: ``context`` is the place
    among the nodes that live here, hot contexts with children here following; ``ends``
    and ``back`` have an entry for each of them."""
    return [hot, *EliasFano.of(ends).arrays(), *EliasFano.of(context * (distinct + 1) + word).arrays(), code, back]


class Shard:
    """A mapped shard of n-grams, whose contexts are nodes from ``first`` on."""

    def __init__(self, path: str, first: int, distinct: int) -> None:
        arrays = map_arrays(path)
        self.first, self.wide, self.hot = first, distinct + 1, next(arrays)
        self.ends, self.words = (EliasFano.mapped(arrays) for _ in range(2))
        self.codes, self.back = next(arrays), next(arrays)

    def nodes_of(self, context: np.ndarray, word: np.ndarray, limit: int) -> np.ndarray:
        """The nodes of many n-grams here (-1: none), whose contexts end before ``limit``
        or are hot, by decoding all."""
        here = (context >= self.first) & (context < limit)
        at = np.where(here, context - self.first, 0)
        if len(self.hot):
            place = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            far = self.hot[place] == context
            at[far] = (self.ends.n - len(self.hot) + place)[far]
            here |= far
        values, asked = self.words.all(), (at * self.wide + word).astype(np.uint64)
        if not len(values):
            return np.full(len(context), -1, np.int64)
        found = np.minimum(np.searchsorted(values, asked), len(values) - 1)
        return np.where(here & (values[found] == asked), found, -1)

    def find(self, context: np.ndarray, word: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each n-gram, sorted by context, its node here (-1: none), the stored part
        of its probability (0 if none), and its context's back-off weight (1 if it has no
        children here). A context's range is looked up once for all its n-grams."""
        node, part = np.full(len(context), -1, np.int64), np.zeros(len(context))
        new = np.concatenate([[True], context[1:] != context[:-1]])[: len(context)]
        owner, at = np.cumsum(new) - 1, context[new] - self.first
        begin, end, back = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.ones(len(at))
        far = np.flatnonzero(hot[new])
        if far.size:
            place = np.searchsorted(self.hot, context[new][far])
            here = np.append(self.hot, -1)[place] == context[new][far]
            at[far] = np.where(here, self.ends.n - len(self.hot) + place, -1)
        some = np.flatnonzero(at >= 0)
        both = self.ends.get(np.concatenate([at[some], np.maximum(at[some] - 1, 0)])).astype(np.int64)
        end[some], begin[some] = both[: len(some)], np.where(at[some] > 0, both[len(some) :], 0)
        back[some] = dequantise(self.back[at[some]], WIDE_LEVELS, WIDE_LOWEST)
        ask = np.flatnonzero((begin < end)[owner])
        if ask.size:
            whose = owner[ask]
            place, equal = self.words.successor(at[whose] * self.wide + word[ask], begin[whose], end[whose])
            hit = np.flatnonzero(equal)
            node[ask[hit]] = place[hit]
            part[ask[hit]] = dequantise(self.codes[place[hit]], LEVELS, LOWEST)
        return node, part, back[owner]


#: Shards that a worker keeps open: mapped ones, and those of a remote store, which lie in
#: its memory.
MAPPED, IN_MEMORY = 20_000, 64


class Model:
    """A mapped model; shards are opened when first asked."""

    def __init__(self, plan: Plan) -> None:
        self.plan, self.open = plan, OrderedDict()
        self.most = MAPPED if sys.version_info >= (3, 13) and isinstance(fs.FileSystem.from_uri(plan.folder)[0], fs.LocalFileSystem) else IN_MEMORY
        self.first = [np.array(x, np.int64) for x in (plan.words, *plan.nodes)]
        self.hot = [(np.array(sorted(h), np.int64), np.array([h[k] for k in sorted(h)])) for h in plan.hot]

    def _opened(self, name: str, make):
        if name not in self.open:
            self.open[name] = make(f"{self.plan.folder}/{name}")
            if len(self.open) > self.most:
                self.open.popitem(last=False)
        self.open.move_to_end(name)
        return self.open[name]

    def identify(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The identifiers (-1: unknown) and counts (0) of words by their hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for s, mine in split(vocabulary_shard(hashes, self.plan.shards)):
            sequence, known = self._opened(f"words-{s}", lambda path: (EliasFano.mapped(arrays := map_arrays(path)), next(arrays)))
            at, equal = sequence.successor(hashes[mine])
            hit = np.flatnonzero(equal)
            ids[mine[hit]] = at[hit] + self.plan.words[s]
            counts[mine[hit]] = known[at[hit]]
        return ids, counts

    def find(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``Shard.find``, for nodes of the whole level; contexts or words of -1 have none."""
        node, part, back = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.ones(len(context))
        plan, parents, nodes, (hot, weight) = self.plan, self.first[level - 2], self.first[level - 1], self.hot[level - 2]
        some = np.flatnonzero(context >= 0)
        if not some.size:
            return node, part, back
        # An unknown word has no node, but its context backs off: ask for one past the last word.
        asked = np.where(word[some] < 0, plan.distinct, word[some])
        pairs, where = unique_pairs(context[some], asked)
        shard, far = home(parents, pairs[0]), np.zeros(len(pairs[0]), bool)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, pairs[0]), len(hot) - 1)
            far = hot[at] == pairs[0]
            shard[far] = home(self.first[0], pairs[1][far])
        got = (np.full(len(pairs[0]), -1, np.int64), np.zeros(len(pairs[0])), np.ones(len(pairs[0])))
        for s, mine in split(shard):
            opened = self._opened(f"grams-{level}-{s}", lambda path: Shard(path, int(parents[s]), plan.distinct))
            n, got[1][mine], got[2][mine] = opened.find(pairs[0][mine], pairs[1][mine], far[mine])
            got[0][mine] = np.where(n >= 0, n + nodes[s], -1)
        if len(hot):
            got[2][far] = weight[at[far]]
        node[some], part[some], back[some] = (g[where] for g in got)
        return node, part, back


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The distinct pairs, sorted, and where each pair is among them."""
    wide = int(b.max()) + 1 if len(b) else 1
    if len(a) and (int(a.max()) + 1) * wide < 1 << 63:
        both, where = np.unique(a * wide + b, return_inverse=True)
        first = both // wide
        return (first, both - first * wide), where
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0)])[: len(x)]
    where = np.empty(len(a), np.int64)
    where[order] = np.cumsum(new) - 1
    return (x[new], y[new]), where


def vocabulary_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


# ---------------------------------------------------------------------- texts


def chunks(batches: Iterator[dict], size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents in chunks of about ``size`` tokens, six bytes reckoned to each: their
    identifiers, whether to learn from them, the numbers of their tokens, each token's place among the chunk's
    distinct ones, and those' hashes. A longer text makes a chunk of its own."""
    hash64 = xxhash.xxh64_intdigest
    for b in batches:
        group = np.cumsum(pc.binary_length(b["text"]).to_numpy().astype(np.int64) + 1) // (6 * size)
        cut = np.flatnonzero(np.diff(group)) + 1
        for begin, end in zip([0, *cut.tolist()], [*cut.tolist(), len(group)]):
            if begin == end:
                continue
            texts = pc.ascii_lower(b["text"].slice(begin, end - begin).cast(pa.string()))
            lists = pc.ascii_split_whitespace(texts)
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.cast(pa.binary()).to_pylist()
            place = coded.indices.to_numpy().astype(np.int64) + 1
            n = lists.value_lengths().to_numpy().astype(np.int64)
            if b"" in words:  # white space at an end splits off an empty word
                real = place != words.index(b"") + 1
                n = np.bincount(np.repeat(np.arange(len(n)), n)[real], minlength=len(n))
                place = place[real]
            lengths = n + 1
            places = np.zeros(int(lengths.sum()), np.int64)  # place 0 is the end
            inside = np.ones(len(places), bool)
            inside[np.cumsum(lengths) - 1] = False
            places[inside] = place
            hashes = np.fromiter((hash64(w, 0) for w in words), np.uint64, len(words))
            learns = b["learn"].slice(begin, end - begin).to_numpy(zero_copy_only=False).astype(bool)
            yield b["doc_id"].slice(begin, end - begin).to_pylist(), learns, lengths, places, np.concatenate([np.array([END], np.uint64), hashes])


def pack(columns: list[np.ndarray]) -> bytes:
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(4, "little") + zstandard.compress(planes, 1)


def unpack(data: bytes, dtypes: list[str]) -> list[np.ndarray]:
    n, raw, at, out = int.from_bytes(data[:4], "little"), zstandard.decompress(data[4:]), 0, []
    for d in map(np.dtype, dtypes):
        plane = np.frombuffer(raw, np.uint8, n * d.itemsize, at).reshape(d.itemsize, n).T
        out.append(np.ascontiguousarray(plane).view(d).reshape(n))
        at += n * d.itemsize
    return out


def split(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(shard, places)``, the places in their order."""
    steps = np.diff(shard)
    order = np.arange(len(shard)) if (steps >= 0).all() else np.argsort(shard, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if mine.size:
            yield int(shard[mine[0]]), mine


TOKENS = pa.schema([("ids", pa.list_(pa.int64())), ("n", pa.int64()), ("learn", pa.binary()), ("lengths", pa.binary()), ("tokens", pa.binary()), ("hashes", pa.binary())])


def tokenise(docs: DataFrame, learn: Column | None = None, chunk: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts as packed chunks of tokens, a row each, for ``train`` and ``score``;
    ``learn`` marks the documents to train on (null: not; none given: all).

    Null and empty texts are one end token; invalid UTF-8 is replaced by U+FFFD; null
    identifiers and repeated rows stay; a text of over ``chunk`` tokens makes a chunk of
    its own; an empty table gives an empty result; extra columns are ignored.
    """
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    rows = docs.select(*text_rows(id_col, text_col), learn.alias("learn"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for ids, learns, lengths, places, hashes in chunks(batches, chunk):
            row = {"ids": [ids], "n": [int(lengths[learns].sum())], "learn": [pack([learns])], "lengths": [pack([lengths])]}
            yield row | {"tokens": [pack([places.astype(np.uint32)])], "hashes": [hashes.tobytes()]}

    return rows.mapInArrow(arrow_pass(run, TOKENS), "ids array<long>, n long, learn binary, lengths binary, tokens binary, hashes binary")


#: Tokens that are counted or scored at a time, but for a longer text; scoring takes more
#: where there are many shards, as each slice visits all of them, up to four times as many.
SLICE, A_SHARD = 500_000, 4_000


def unpacked(batches: Iterator[dict], only_learned: bool) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each packed chunk the identifiers, lengths, places and hashes; of those to train on only, if asked."""
    for b in batches:
        for i in range(len(b["n"])):
            lengths, places = unpack(b["lengths"][i].as_py(), ["<i8"])[0], unpack(b["tokens"][i].as_py(), ["<u4"])[0]
            if only_learned:
                learns = unpack(b["learn"][i].as_py(), ["?"])[0]
                if not learns.all():
                    lengths, places = lengths[learns], places[np.repeat(learns, lengths)]
                if not len(lengths):
                    continue
            yield b["ids"][i].as_py(), lengths, places, np.frombuffer(b["hashes"][i].as_py(), np.uint64)


def slices(lengths: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs of texts of about ``size`` tokens: the first text and the one after the
    last, and so for their tokens."""
    ends = np.cumsum(lengths)
    cut = np.flatnonzero(np.diff((ends - 1) // size)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(lengths)]):
        yield a, b, int(ends[a] - lengths[a]), int(ends[b - 1])


BLOBS = pa.schema([("shard", pa.int32()), ("packed", pa.binary())])
SUMMARY = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("top", pa.list_(pa.int64())), ("top_counts", pa.list_(pa.int64())), ("top_words", pa.list_(pa.int64())), ("hot", pa.list_(pa.int64())), ("hot_mass", pa.list_(pa.float64()))])
SUMMARY_TYPES = "shard int, n long, total long, top array<long>, top_counts array<long>, top_words array<long>, hot array<long>, hot_mass array<double>"
#: The most frequent entries that a shard names; a bound, as at most four in a shard on average are hot.
TOP = 64


def _reduce(blobs: DataFrame, shards: int, merge) -> list:
    """Run ``merge(shard, blobs)`` for each shard in a task that holds that shard's
    blobs alone; its summaries, one row a shard, in order."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        at, held = None, []
        for b in batches:
            for s, data in zip(b["shard"].to_pylist(), b["packed"]):
                if s != at and held:
                    yield merge(at, held)
                    held = []
                at = s
                held.append(data.as_py())
        if held:
            yield merge(at, held)

    dealt = blobs.repartitionById(shards, "shard").sortWithinPartitions("shard")
    rows = materialise(dealt.mapInArrow(arrow_pass(run, SUMMARY), SUMMARY_TYPES), "shards").collect()
    return sorted(rows, key=lambda r: r.shard)


def train(tokens: DataFrame, order: int = 3, least: int = 1, discount: float = 0.75, shards: int | None = None, folder: str | None = None) -> Plan:
    """Count and build a model of the documents that ``tokenise`` marked, in ``folder``
    of the shared folder.

    The vocabulary and all counts are those of all their texts. An n-gram (n > 1) that
    occurs at least ``least`` times is stored with (c - discount) / c(context); what
    the stored ones leave of a context's mass is its back-off weight, so that
    p(w|h) = stored(h w) + back(h) p(w|h') adds up to 1 over all words and an unknown
    one; single words have (c + 1) / (N + V + 1). A text is read as if the end of
    another stood before it. No texts give a model without words.

    Each level is one pass: tasks count their chunks, send packed sorted counts to
    the shards, and a task a shard merges them, looks their contexts up among its own
    nodes and writes its file. Shards grow in number with the tokens (1,250,000 each).
    Contexts that hold over a quarter of a shard's share of tokens are split by word. A
    word is known by 64 bits of its hash: of V words, two share one with probability
    V^2 / 2^65.
    """
    spark = tokens.sparkSession
    folder = folder or scratch_path(spark, "lm")
    rows = tokens.select("ids", "n", "learn", "lengths", "tokens", "hashes").where("n > 0")
    if shards is None:
        shards = max(4, -(-(rows.agg(F.sum("n")).first()[0] or 0) // 1_250_000))

    def count_words(batches: Iterator[dict]) -> Iterator[dict]:
        for _, _, places, hashes in unpacked(batches, True):
            counts = np.bincount(places.astype(np.int64), minlength=len(hashes))
            used = np.flatnonzero(counts)
            order_ = used[np.argsort(hashes[used])]
            h, c = hashes[order_], counts[order_].astype(np.int64)
            out = [(s, pack([np.diff(h[m], prepend=np.uint64(0)), c[m]])) for s, m in split(vocabulary_shard(h, shards))]
            yield {"shard": [x[0] for x in out], "packed": [x[1] for x in out]}

    def merge_words(shard: int, blobs: list[bytes]) -> dict:
        parts = [unpack(x, ["<u8", "<i8"]) for x in blobs]
        h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        c = np.concatenate([p[1] for p in parts])
        h, where = np.unique(h, return_inverse=True)
        c = np.bincount(where, weights=c).astype(np.int64)
        write_arrays(f"{folder}/words-{shard}", build_vocabulary(h, c))
        top = np.argsort(-c, kind="stable")[:TOP]
        return {"shard": [shard], "n": [len(h)], "total": [int(c.sum())], "top": [top.tolist()], "top_counts": [c[top].tolist()], "top_words": [[]], "hot": [[]], "hot_mass": [[]]}

    found = _reduce(rows.mapInArrow(arrow_pass(count_words, BLOBS), "shard int, packed binary"), shards, merge_words)
    none = np.empty(0, np.uint64)
    words = _with_empty(found, shards, lambda s: write_arrays(f"{folder}/words-{s}", build_vocabulary(none, none)))
    plan = Plan(folder, shards, sum(r.total for r in found), words)
    ways: list[dict] = []  # for each level its hot contexts as tuples of words
    for level in range(2, order + 1):
        first = words if level == 2 else plan.nodes[-1]
        hot = {}
        for r in found:
            for j, (t, c) in enumerate(zip(r.top, r.top_counts)):
                if c > plan.total / (4 * shards):
                    node = first[r.shard] + t
                    hot[node] = (c, tuple(r.top_words[j * (level - 1) : (j + 1) * (level - 1)]) if level > 2 else (node,))
        ways.append(hot)
        found, plan = _train_level(rows, plan, level, least, discount, ways)
    return plan


def _with_empty(found: list, shards: int, write) -> tuple[int, ...]:
    """The first identifier of each shard, and their number; shards without rows are written empty."""
    sizes = {r.shard: r.n for r in found}
    out = [0]
    for s in range(shards):
        if s not in sizes:
            write(s)
        out.append(out[-1] + sizes.get(s, 0))
    return tuple(out)


def _tuple_keys(columns: list[np.ndarray], distinct: int) -> np.ndarray:
    """A key a tuple of words: without collisions while all tuples are fewer than 2^64."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = out * np.uint64(distinct + 1) + c.astype(np.uint64)
    return out


def _grams(ids: np.ndarray, starts: np.ndarray, end: int, level: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct ``level``-grams of a chunk, sorted, a column for each word, and
    their counts. Before each text stands one ``end``; no n-gram reaches further."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[starts] = end
    tables: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(2, level + 1):
        some = np.flatnonzero(before >= 0)
        pairs, where = unique_pairs(before[some], ids[some])
        tables.append(pairs)
        if k < level:
            here = np.full(len(ids), -1, np.int64)
            here[some] = where
            before = np.full_like(here, -1)
            before[1:] = here[:-1]
            before[starts] = -1
    at, columns = np.arange(len(tables[-1][0])), []
    for a, b in reversed(tables):
        columns.append(b[at])
        at = a[at]
    return [at, *reversed(columns)], np.bincount(where, minlength=len(tables[-1][0]))


def _train_level(rows: DataFrame, plan: Plan, level: int, least: int, discount: float, ways: list[dict]) -> tuple[list, Plan]:
    hot = ways[-1]
    keys = [np.sort(_tuple_keys([np.array(c, np.int64) for c in zip(*(w for _, w in h.values()))], plan.distinct)) if h else np.empty(0, np.uint64) for h in ways]
    narrow = "<u4" if plan.distinct < 1 << 32 else "<u8"
    first = np.array(plan.words, np.int64)

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        model = Model(plan)
        end = int(model.identify(np.array([END], np.uint64))[0][0])
        for _, lengths, places, hashes in unpacked(batches, True):
            used = np.zeros(len(hashes), bool)
            used[places] = True
            ids = np.full(len(hashes), -1, np.int64)
            ids[used] = model.identify(hashes[used])[0]
            for a, b, i, j in slices(lengths, SLICE):
                columns, n = _grams(ids[places[i:j]], np.cumsum(lengths[a:b]) - lengths[a:b], end, level)
                shard = home(first, columns[0])
                for k, known in enumerate(keys):  # a hot context's children go to their own words' shards
                    if len(known):
                        far = np.isin(_tuple_keys(columns[: k + 1], plan.distinct), known)
                        shard[far] = home(first, columns[k + 1][far])
                columns = [c.astype(narrow) for c in columns]
                out = [(s, pack([np.diff(columns[0][m], prepend=columns[0].dtype.type(0)), *(c[m] for c in columns[1:]), n[m].astype("<u4")])) for s, m in split(shard)]
                yield {"shard": [x[0] for x in out], "packed": [x[1] for x in out]}

    def merge(shard: int, blobs: list[bytes]) -> dict:
        parts = [unpack(x, [narrow] * level + ["<u4"]) for x in blobs]
        for p in parts:  # in a blob the first words follow by their differences
            p[0] = np.cumsum(p[0], dtype=np.int64)
        *columns, n = (np.concatenate([p[i] for p in parts]).astype(np.int64, copy=False) for i in range(level + 1))
        del parts
        model, parents = Model(plan), plan.words if level == 2 else plan.nodes[-1]
        # The context's node, of its distinct values only, a word at a time.
        node, whose = np.unique(columns[0], return_inverse=True)
        own = [node]
        for k in range(2, level):
            (a, b), whose = unique_pairs(whose, columns[k - 1])
            own = [*(c[a] for c in own), b]
            # Nearly all live in this shard, whose n-grams are decoded at once.
            mine = Shard(f"{plan.folder}/grams-{k}-{shard}", int(model.first[k - 2][shard]), plan.distinct)
            found = mine.nodes_of(node[a], b, int(model.first[k - 2][shard + 1]))
            rest = np.flatnonzero(found < 0)
            node, found = np.where(found >= 0, found + plan.nodes[k - 2][shard], -1), node
            if rest.size:
                node[rest] = model.find(k, found[a[rest]], b[rest])[0]
        far = np.isin(node, np.array(sorted(hot), np.int64))
        here = np.unique(node[far])
        lives = parents[shard + 1] - parents[shard]
        local = np.where(far, lives + np.searchsorted(here, node), node - parents[shard])
        local[node < 0] = -1  # a context that was not stored has no children
        of = local[whose]
        if (local < 0).any():
            keep = of >= 0
            of, whose, n, columns = of[keep], whose[keep], n[keep], [c[keep] for c in columns]
        (c, w), where = unique_pairs(of, columns[-1])
        n = np.bincount(where, weights=n, minlength=len(c)).astype(np.int64)
        size = lives + len(here)
        sums = np.bincount(c, weights=n, minlength=size)
        sums[lives:] = [hot[k][0] for k in here.tolist()]
        part = (n - discount) / sums[c]
        kept = n >= least
        c, w, n, part = c[kept], w[kept], n[kept], part[kept]
        code = quantise(part, LEVELS, LOWEST)
        mass = np.bincount(c, weights=dequantise(code, LEVELS, LOWEST), minlength=size)
        ends = np.cumsum(np.bincount(c, minlength=size))
        write_arrays(f"{plan.folder}/grams-{level}-{shard}", build_level(here, ends, c, w, plan.distinct, code, quantise(1 - mass, WIDE_LEVELS, WIDE_LOWEST)))
        top = np.argpartition(-n, TOP)[:TOP] if len(n) > TOP else np.arange(len(n))
        top = top[np.argsort(-n[top], kind="stable")]
        back = np.full(size, -1, np.int64)
        back[local[local >= 0]] = np.flatnonzero(local >= 0)
        named = np.stack([*(x[back[c[top]]] for x in own), w[top]], axis=1).reshape(-1).tolist()
        return {"shard": [shard], "n": [len(n)], "total": [int(n.sum())], "top": [top.tolist()], "top_counts": [n[top].tolist()], "top_words": [named], "hot": [here.tolist()], "hot_mass": [mass[lives:].tolist()]}

    def write_empty(shard: int) -> None:
        parents, none = plan.words if level == 2 else plan.nodes[-1], np.empty(0, np.int64)
        lives = parents[shard + 1] - parents[shard]
        write_arrays(f"{plan.folder}/grams-{level}-{shard}", build_level(none, np.zeros(lives, np.int64), none, none, plan.distinct, none.astype(np.uint16), np.zeros(lives, np.uint16)))

    found = _reduce(rows.mapInArrow(arrow_pass(count, BLOBS), "shard int, packed binary"), plan.shards, merge)
    nodes = _with_empty(found, plan.shards, write_empty)
    mass = dict.fromkeys(hot, 0.0)
    for r in found:
        for k, m in zip(r.hot, r.hot_mass):
            mass[k] += m
    back = {k: float(dequantise(quantise(np.array([1 - m]), WIDE_LEVELS, WIDE_LOWEST), WIDE_LEVELS, WIDE_LOWEST)[0]) for k, m in mass.items()}
    after = Plan(plan.folder, plan.shards, plan.total, plan.words, (*plan.nodes, nodes), (*plan.hot, back))
    return found, after


def score_chunk(model: Model, lengths: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Known tokens, base score and model score of the texts of a chunk, slice by slice."""
    plan = model.plan
    all_ids, all_counts = model.identify(hashes)
    each = (all_counts + 1) / (plan.total + plan.distinct + 1)
    logs = np.log10(each)
    end_id = int(model.identify(np.array([END], np.uint64))[0][0])
    for a, b, i, j in slices(lengths, min(4 * SLICE, max(SLICE, A_SHARD * plan.shards))):
        mine, starts = places[i:j], np.cumsum(lengths[a:b]) - lengths[a:b]
        ids, p = all_ids[mine], each[mine]
        context = np.empty_like(ids)
        context[1:] = ids[:-1]
        context[starts] = end_id
        for level in range(2, 2 + len(plan.nodes)):
            node, part, back = model.find(level, context, ids)
            p = part + back * p
            context = np.full_like(ids, -1)
            context[1:] = node[:-1]
            context[starts] = -1
        # Sums in extended precision don't depend on their order in the digits that stay.
        base, own = (np.add.reduceat(x.astype(np.longdouble), starts).astype(np.float64) for x in (logs[mine], np.log10(p)))
        yield np.add.reduceat((ids >= 0).astype(np.int64), starts), base, own


def score(tokens: DataFrame, plan: Plan) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every whole
    text that ``tokenise`` packed, learned from or not.

    Null and empty texts are one end token; null identifiers and repeated rows stay;
    a model of no texts gives every token the same probability; an empty table gives
    an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        model = Model(plan)
        for ids, lengths, places, hashes in unpacked(batches, False):
            known, base, own = (np.concatenate(x) for x in zip(*score_chunk(model, lengths, places, hashes)))
            yield {"doc_id": ids, "n_tokens": lengths, "n_known": known, "train_tokens": np.full(len(ids), plan.total), "base_score": base, "score": own}

    return tokens.select("ids", "n", "learn", "lengths", "tokens", "hashes").mapInArrow(arrow_pass(run, schema), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
