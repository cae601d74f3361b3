"""What several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.sources.scratch import discard, drop_path, materialise, scratch_path, shared_dir

__all__ = ["WORD", "arrow_pass", "discard", "drop_path", "filter_texts", "held_out", "materialise", "scratch_path", "shared_dir", "text_rows"]

#: A word: a run of anything but the ASCII white space below.
WORD = r"[^\x20\x09-\x0D]+"

def text_rows(id_col: str, text_col: str, more: tuple[str, ...] = ()) -> list[Column]:
    """Only the columns an Arrow pass needs; the text as UTF-8 bytes, null as empty, what
    is no valid UTF-8 replaced by U+FFFD."""
    text = F.make_valid_utf8(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).cast("binary")
    return [F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), *[F.col(f"`{c}`") for c in more]]


def arrow_pass(fn: Callable[[Iterator[dict]], Iterator[dict]], schema: pa.Schema) -> Callable:
    """A mapInArrow function of one that maps column dictionaries to column dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches)
        for out in fn(columns):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

    return run


def filter_texts(docs: DataFrame, text_col: str, make: Callable[[], Callable[[bytes], bool]]) -> DataFrame:
    """The rows of ``docs`` whose whole text (UTF-8, null as empty, what is not valid
    replaced by U+FFFD) a task's ``make()`` accepts; all columns stay as they are and nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for b in batches:
            texts = (t.as_py() for t in b.column(at).cast(pa.binary()))
            yield b.filter(pa.array([keep((t or b"").decode("utf-8", "replace").encode()) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether CRC-32 of the identifier as text leaves ``fold`` modulo ``folds``;
    a null identifier counts as the text ``""``."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % folds == fold
