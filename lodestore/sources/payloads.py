"""Payload sources: file scans, bounded reads and generated probes."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.functions.errors import Fault, StoreError


def scan_files(spark: SparkSession, folder: str, most_bytes: int | None = None) -> DataFrame:
    """``(path, length, modificationTime, content)`` of a folder's files; the size is
    filtered before content is read, and content isn't read unless selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files if most_bytes is None else files.where(F.col("length") <= most_bytes)


def read_status(length: Column, most_bytes: int, expected: Column | None = None) -> Column:
    """What a bounded read of a file of this length gives."""
    status = F.when(length > most_bytes, Fault.LIMIT_EXCEEDED.value)
    if expected is not None:
        status = status.when(length != expected, Fault.INTEGRITY_MISMATCH.value)
    return status.otherwise("ok")


def read_bounded(path: str, most_bytes: int, expected: int | None = None, flags: int = os.O_RDONLY | os.O_NOFOLLOW | os.O_CLOEXEC) -> bytes:
    """One file on the driver: its size is checked before anything is allocated, links
    aren't followed, and a short read is a mismatch."""
    handle = os.open(path, flags)
    try:
        size = os.fstat(handle).st_size
        if size > most_bytes:
            raise StoreError(Fault.LIMIT_EXCEEDED, path)
        if expected is not None and size != expected:
            raise StoreError(Fault.INTEGRITY_MISMATCH, path)
        out = bytearray()
        while len(out) < size:
            piece = os.read(handle, size - len(out))
            if not piece:
                raise StoreError(Fault.INTEGRITY_MISMATCH, path)
            out += piece
        return bytes(out)
    finally:
        os.close(handle)


def list_bounded(folder: str, most: int) -> list[str]:
    """A folder's names, hidden ones too; more than ``most`` is an error before they
    are gathered."""
    names = []
    with os.scandir(folder) as entries:
        for entry in entries:
            if len(names) >= most:
                raise StoreError(Fault.LIMIT_EXCEEDED, folder)
            names.append(entry.name)
    return names


def probe_payloads(spark: SparkSession, n: int, size: int) -> DataFrame:
    """``(index, partition, content)`` of deterministic payloads: byte ``o`` of payload
    ``i`` is ``(i * 131) xor o``, modulo 256."""
    byte = lambda o: F.lpad(F.hex(((F.col("id") * 131) % 256).bitwiseXOR(o % 256)), 2, "0")
    content = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint")), byte), ""))
    return spark.range(n).select(F.col("id").cast("int").alias("index"), (F.col("id") % 2).cast("int").alias("partition"), content.alias("content"))
