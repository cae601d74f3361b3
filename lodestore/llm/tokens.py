"""Token counts by a count-only Viterbi pass."""

from __future__ import annotations

import math
import re
import struct
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestore.llm.common import arrow_pass, text_rows

#: The mark for a space.
SPACE = "▁"
#: Characters of a long stretch that are segmented at a time.
BLOCK = 1 << 16
#: How far an unknown character scores below the vocabulary's least score.
UNKNOWN_PENALTY = 10.0


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def read_pieces(data: bytes) -> list[tuple[str, float]]:
    """``(piece, score)`` of a sentence-piece model file, in the order of identifiers.

    The file is a protocol-buffer message: field 1, repeated, is a piece with its
    text in field 1 and its score, a float, in field 2.
    """
    def fields(blob: bytes) -> Iterator[tuple[int, object]]:
        at = 0
        while at < len(blob):
            key, at = _varint(blob, at)
            if key & 7 == 0:
                value, at = _varint(blob, at)
            elif key & 7 == 2:
                size, at = _varint(blob, at)
                value, at = blob[at : at + size], at + size
            elif key & 7 == 5:
                value, at = struct.unpack("<f", blob[at : at + 4])[0], at + 4
            else:
                value, at = blob[at : at + 8], at + 8
            yield key >> 3, value

    out = []
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            out.append((piece[1].decode(), piece.get(2, 0.0)))
    return out


class PieceCounter:
    """Counts the pieces of the best segmentation under a unigram vocabulary.

    The rules are those of the common unigram tokenizer: a space becomes a mark, the
    text begins with one, and each mark begins a stretch that is segmented alone.
    The best path maximises the sum of scores in double precision; among equal sums
    the one whose last piece begins first wins at every position. A character that
    is no piece costs the least score less 10; a run of such is one unknown, written
    as its UTF-8 bytes if the vocabulary has all of their byte pieces.
    """

    def __init__(self, pieces: list[tuple[str, float]], cache: int = 200_000) -> None:
        self.automaton = ahocorasick.Automaton()
        vocabulary = dict(pieces)
        for piece, score in vocabulary.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(vocabulary.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, vocabulary))
        self.single = {p for p in vocabulary if len(p) == 1}
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in vocabulary}
        self.known: dict[str, int] = {}
        self.cache = cache

    def _cost_of_unknown(self, run: str) -> int:
        raw = run.encode()
        return len(raw) if self.bytes.issuperset(raw) else 1

    def stretch(self, text: str) -> int:
        """The pieces of one stretch, by dynamic programming over its positions that
        carries only the best score and count; over a long stretch a block of positions
        and as many before it as the longest piece has are held."""
        n = len(text)
        if n > BLOCK:
            return self._long_stretch(text)
        if self.single.issuperset(text):  # no unknown can win: each position is reached by pieces
            top, pieces = [0.0] + [-math.inf] * n, [0] * (n + 1)
            # The automaton gives the matches that end at a position longest first.
            for end, (size, score) in self.automaton.iter(text):
                total = top[end + 1 - size] + score
                if total > top[end + 1]:
                    top[end + 1], pieces[end + 1] = total, pieces[end + 1 - size] + 1
            return pieces[n]
        return self._long_stretch(text)

    def _long_stretch(self, text: str) -> int:
        best: list[float | None] = [0.0]
        # Pieces before a trailing run of unknowns, and where that run began (-1: none).
        count, begun, base = [0], [-1], 0
        for first in range(0, len(text), BLOCK):
            last = min(len(text), first + BLOCK)
            drop = max(0, first - self.longest) - base
            if drop > 0:
                del best[:drop], count[:drop], begun[:drop]
                base += drop
            matches: list[list[tuple[int, float]]] = [[] for _ in range(last - first)]
            for end, found in self.automaton.iter(text, max(0, first - self.longest), last):
                if end >= first:
                    matches[end - first].append(found)
            for end in range(first, last):
                top, at, is_unknown = None, 0, False
                # Longest first, so by rising beginning: only a larger sum replaces.
                for size, score in sorted(matches[end - first], reverse=True):
                    start = end + 1 - size - base
                    if best[start] is not None and (top is None or best[start] + score > top):
                        top, at = best[start] + score, start
                here = end - base
                if text[end] not in self.single and (top is None or best[here] + self.unknown > top):
                    top, at, is_unknown = best[here] + self.unknown, here, True
                best.append(top)
                if is_unknown:
                    begun.append(begun[at] if begun[at] >= 0 else at + base)
                    count.append(count[at])
                else:
                    begun.append(-1)
                    count.append(count[at] + 1 + (self._cost_of_unknown(text[begun[at] : at + base]) if begun[at] >= 0 else 0))
        return count[-1] + (self._cost_of_unknown(text[begun[-1] :]) if begun[-1] >= 0 else 0)

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if text[0] != SPACE:
            text = SPACE + text
        total = 0
        # One after the other: a long text has more stretches than distinct ones.
        for part, times in Counter(m.group() for m in re.finditer(f"{SPACE}[^{SPACE}]*", text)).items():
            got = self.known.get(part)
            if got is None:
                got = self.stretch(part)
                if len(part) <= 64:
                    if len(self.known) >= self.cache:
                        self.known.clear()
                    self.known[part] = got
            total += got * times
        return total


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` of every whole text.

    ``pieces`` is a vocabulary of fixed size with its scores (``read_pieces``), sent
    to the executors once. Null and empty texts have 0 tokens; null identifiers and
    repeated rows stay; invalid UTF-8 is replaced by U+FFFD; an empty table gives an
    empty result; extra columns are ignored. A stretch without spaces is segmented
    whole, whatever its length, in memory for a block of it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        counter = PieceCounter(sent.value)
        for b in batches:
            yield {"doc_id": b["doc_id"], "n_tokens": [counter.count(t.as_py().decode()) for t in b["text"]]}

    return docs.select(*text_rows(id_col, text_col)).mapInArrow(arrow_pass(run, schema), "doc_id long, n_tokens long")
