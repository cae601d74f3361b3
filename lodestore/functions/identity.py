"""Identities and scalar rules of the catalogue, as column expressions.

The identity rules hash a tag, domains and contents with NUL separators. The tag
begins with a namespace: pass an existing store's to reproduce its identities.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestore.functions.errors import Fault, StoreError

NAMESPACE = "lodestore"
PARTITION_TAG, KEY_TAG = "partition-v1", "file-blob-key-v1"
DOMAIN = re.compile(rb"[\x21-\x7e]{1,128}")
CANONICAL = r"\Asha256:[0-9a-f]{64}:(0|[1-9][0-9]*)\z"
KEY = r"\A[0-9a-f]{64}\z"
RECORD_NAME = r"\A\.manifest-entry-[0-9a-f]{64}\.json\z"
BLOB_NAME = r"(?:^|/)blobs/[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"
LONG_MAX = (1 << 63) - 1


def _bytes(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def as_bytes(content: Column) -> Column:
    """A string's UTF-8 bytes; binary stays."""
    return content.cast("binary")


def digest_hex(content: Column) -> Column:
    return F.sha2(as_bytes(content), 256)


def canonical(content: Column) -> Column:
    """``sha256:<hex>:<bytes>``."""
    return F.concat_ws(":", F.lit("sha256"), digest_hex(content), F.octet_length(content).cast("string"))


def canonical_of(hex_digest: Column, byte_count: Column) -> Column:
    return F.concat_ws(":", F.lit("sha256"), hex_digest, byte_count.cast("string"))


def is_canonical(text: Column) -> Column:
    """Whether a digest's canonical form: lowercase hex, no sign or leading zero, no
    overflow. Null is not."""
    size = F.try_element_at(F.split(text, ":"), F.lit(3)).try_cast("bigint")
    return F.coalesce(text.rlike(CANONICAL) & size.isNotNull(), F.lit(False))


def parse_canonical(text: Column) -> Column:
    """``struct(digest_hex, byte_count)``, null if the text is not canonical."""
    parts = F.split(text, ":")
    value = F.struct(F.try_element_at(parts, F.lit(2)).alias("digest_hex"), F.try_element_at(parts, F.lit(3)).try_cast("bigint").alias("byte_count"))
    return F.when(is_canonical(text), value)


def matches(content: Column, hex_digest: Column, byte_count: Column) -> Column:
    """Length first, then the hash."""
    return (F.octet_length(content) == byte_count) & (digest_hex(content) == hex_digest)


def check_domain(domain: str) -> bytes:
    raw = domain.encode("utf-8")
    if not DOMAIN.fullmatch(raw):
        raise StoreError(Fault.INVALID_ARGUMENT, "a domain is 1 to 128 visible ASCII characters")
    return raw


def partition_id(domain: str, material: Column, namespace: str = NAMESPACE) -> Column:
    """32 bytes derived from a domain and material."""
    head = f"{namespace}-{PARTITION_TAG}".encode() + b"\0" + check_domain(domain) + b"\0"
    return F.unhex(F.sha2(F.concat(_bytes(head), as_bytes(material)), 256))


def derive_partition(domain: str, material: bytes, namespace: str = NAMESPACE) -> bytes:
    return hashlib.sha256(f"{namespace}-{PARTITION_TAG}".encode() + b"\0" + check_domain(domain) + b"\0" + material).digest()


def is_partition(value: Column) -> Column:
    return F.coalesce(F.octet_length(value) == 32, F.lit(False))


def manifest_key(partition: Column, canonical_text: Column, namespace: str = NAMESPACE) -> Column:
    head = f"{namespace}-{KEY_TAG}".encode() + b"\0"
    return F.sha2(F.concat(_bytes(head), partition, _bytes(b"\0"), as_bytes(canonical_text)), 256)


def derive_key(partition: bytes, canonical_text: str, namespace: str = NAMESPACE) -> str:
    return hashlib.sha256(f"{namespace}-{KEY_TAG}".encode() + b"\0" + partition + b"\0" + canonical_text.encode()).hexdigest()


def partition_json(partition: bytes) -> dict:
    return {"value": base64.b64encode(partition).decode("ascii")}


def is_manifest_key(text: Column) -> Column:
    return F.coalesce(text.rlike(KEY), F.lit(False))


#: White space around a fingerprint: tab to carriage return, next line, and Unicode's separators.
SPACES = "\t\n\x0b\x0c\r\x85\u00a0\u1680\u2028\u2029\u202f\u205f\u3000 " + "".join(map(chr, range(0x2000, 0x200B)))


def bare_fingerprint(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def normal_fingerprint(text: Column) -> Column:
    """Trimmed of white space; null unless 1 to 1024 UTF-8 bytes without ASCII control characters."""
    bare = bare_fingerprint(text)
    return F.when(F.octet_length(bare).between(1, 1024) & ~bare.rlike(r"[\x00-\x1F\x7F]"), bare)


def plain_fingerprint(text: str) -> str | None:
    """``normal_fingerprint`` of a string."""
    bare = text.strip(SPACES)
    return bare if 1 <= len(bare.encode()) <= 1024 and all(c >= " " and c != "\x7f" for c in bare) else None


def clamped(value: Column, cap: int) -> Column:
    return F.least(F.lit(cap).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), value))


def normal_cost(cost: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), cost)


def effective_access(*times: Column) -> Column:
    """The latest of the known access times."""
    return F.greatest(*times)


def saturating_add(a: Column, b: Column) -> Column:
    """The sum of two non-negative numbers, stopped at the largest."""
    return F.coalesce(F.try_add(a, b), F.when(a.isNotNull() & b.isNotNull(), F.lit(LONG_MAX)))


def checked_product(a: Column, b: Column) -> Column:
    """The product; beyond a long an error, whatever the session's ANSI setting."""
    return _checked(F.try_multiply(a.cast("bigint"), b.cast("bigint")), a, b)


def checked_sum(a: Column, b: Column) -> Column:
    """The sum; beyond a long an error, whatever the session's ANSI setting."""
    return _checked(F.try_add(a.cast("bigint"), b.cast("bigint")), a, b)


def _checked(value: Column, a: Column, b: Column) -> Column:
    overflow = value.isNull() & a.isNotNull() & b.isNotNull()
    return F.when(overflow, F.raise_error(F.lit(Fault.LIMIT_EXCEEDED.value))).otherwise(value)


def nanoseconds(seconds: Column, microseconds: Column) -> Column:
    """A time of seconds and microseconds in nanoseconds; beyond a long an error."""
    return checked_sum(checked_product(seconds, F.lit(1_000_000_000)), checked_product(microseconds, F.lit(1_000)))


def timestamp_of(seconds: Column, nanoseconds_: Column) -> Column:
    """The timestamp of seconds since 1970 and nanoseconds, cut to microseconds."""
    micros = checked_sum(checked_product(seconds, F.lit(1_000_000)), F.floor(nanoseconds_ / 1_000).cast("bigint"))
    return F.timestamp_micros(micros)


def shard_of(key: Column, shards: int, hashed: bool = False) -> Column:
    """The shard of a whole number, or with ``hashed`` of any key by its hash."""
    return F.pmod(F.xxhash64(key) if hashed else key, F.lit(shards).cast("bigint")).cast("int")
