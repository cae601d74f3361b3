"""WARC archives as a chunked record table.

Beyond the input table's own rows a record is never held whole: payloads travel to the
writers as rows ``(record, chunk_no)`` of at most ``CHUNK`` bytes, are written as they
come, and are read back as a table of such rows with the digest of the payload up to
there.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.common import arrow_pass, materialise

#: Bytes of a chunk row.
CHUNK = 1 << 20
#: Longest header block that a reader accepts: more than any url that a table's row can hold.
HEADER_LIMIT = 1 << 31
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def urn(identifier: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=identifier)}>"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "replace")


def uri_of(url: str | None, page_id: int | None) -> str:
    """The target URI, however long; characters that can't stand in a header field are escaped."""
    if not url:
        return f"urn:x-page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


class Writer:
    """One archive of gzip members, a record each, whose block comes in pieces."""

    def __init__(self, stream) -> None:
        self.stream, self.size, self.records, self.left, self.pack = stream, 0, 0, 0, None

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def begin(self, fields: list[tuple[str, str]], length: int) -> None:
        """Start a record whose block has ``length`` bytes."""
        if self.left:
            raise ValueError(f"the record before lacks {self.left} bytes")
        self.pack, self.left = zlib.compressobj(6, zlib.DEFLATED, 31), length
        self._put(self.pack.compress(header([*fields, ("Content-Length", str(length))])))
        self.records += 1
        self.add(b"")

    def add(self, piece: bytes | memoryview) -> None:
        """The next piece of the block; after the last the record is closed."""
        if len(piece) > self.left:
            raise ValueError("more bytes than declared")
        self._put(self.pack.compress(piece))
        self.left -= len(piece)
        if not self.left and self.pack is not None:
            self._put(self.pack.compress(b"\r\n\r\n") + self.pack.flush())
            self.pack = None

    def _fields(self, kind: str, identifier: bytes, page_id: int | None, url: str | None, sha1: bytes) -> list[tuple[str, str]]:
        named = [("X-Page-ID", str(page_id))] if page_id is not None else []
        return [("WARC-Type", kind), ("WARC-Record-ID", urn(identifier)), ("WARC-Date", DATE), ("WARC-Target-URI", uri_of(url, page_id)), *named, ("WARC-Payload-Digest", "sha1:" + base32_sha1(sha1)), ("Content-Type", "application/http; msgtype=response")]

    def response(self, identifier: bytes, page_id: int | None, url: str | None, sha1: bytes, size: int) -> None:
        """Start a response; ``size`` bytes of payload are to be added."""
        http = f"{HTTP}Content-Length: {size}\r\n\r\n".encode()
        self.begin(self._fields("response", identifier, page_id, url, sha1), len(http) + size)
        self.add(http)

    def revisit(self, identifier: bytes, page_id: int | None, url: str | None, sha1: bytes, refers_id: bytes, refers_to: int) -> None:
        http = f"{HTTP}\r\n".encode()
        self.begin([*self._fields("revisit", identifier, page_id, url, sha1), ("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_id)), ("X-Refers-To-Page-ID", str(refers_to))], len(http))
        self.add(http)


class Reader:
    """Streams the records of an archive, gzip members or plain."""

    def __init__(self, stream, step: int = 1 << 16) -> None:
        self.stream, self.step = stream, step
        self.raw, self.held, self.unpack, self.plain = b"", bytearray(), None, None

    def _more(self) -> bool:
        """Get at most about ``step`` more bytes of content; whether there were any."""
        while True:
            if not self.raw:
                self.raw = bytes(self.stream.read(self.step))
                if not self.raw:
                    return False
            if self.plain is None:
                self.plain = self.raw[:1] != b"\x1f"
            if self.plain:
                self.held += self.raw
                self.raw = b""
                return True
            if self.unpack is None:
                self.unpack = zlib.decompressobj(31)
            data = self.unpack.decompress(self.raw, self.step)
            if self.unpack.eof:
                self.raw, self.unpack = self.unpack.unused_data, None
            else:
                self.raw = self.unpack.unconsumed_tail
            if data:
                self.held += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``, less the line ends that close the record before;
        None at the end of the archive."""
        while True:
            skip = len(self.held) - len(self.held.lstrip(b"\r\n"))
            del self.held[:skip]
            if self.held:
                break
            if not self._more():
                return None
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if seen > HEADER_LIMIT:
                raise ValueError("header block too long")
            if not self._more():
                raise ValueError("archive ends inside a record")
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def chunks(self, length: int) -> Iterator[bytes]:
        """The next ``length`` bytes in pieces."""
        while length:
            if not self.held and not self._more():
                raise ValueError("archive ends inside a record")
            out = bytes(self.held[:length])
            del self.held[:length]
            length -= len(out)
            yield out

    def records(self) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
        """Each record's header fields and its payload's pieces, to be used in order."""
        while (head := self.until(b"\r\n\r\n")) is not None:
            first, *lines = head.decode("utf-8", "replace").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError("no WARC record here")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            body = self.chunks(int(fields["content-length"]))
            payload = self._payload(body) if "application/http" in fields.get("content-type", "") else body
            yield fields, payload
            for _ in payload:
                pass

    @staticmethod
    def _payload(body: Iterator[bytes]) -> Iterator[bytes]:
        """The body without its HTTP header."""
        head = b""
        for piece in body:
            head += piece
            if (at := head.find(b"\r\n\r\n")) >= 0:
                if head[at + 4 :]:
                    yield head[at + 4 :]
                yield from body
                return
            if len(head) > HEADER_LIMIT:
                raise ValueError("header block too long")


def _uuid(*parts: Column) -> Column:
    """16 bytes that name a record, of what tells it from others."""
    return F.unhex(F.md5(F.concat_ws("/", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)).cast("binary")))


def plan_records(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``(record_id, page_id, url, payload, size, sha1, refers_id, refers_to)``: what to
    write for each page.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest
    identifier is written whole; the others get its identifier and no payload.
    Payloads are compared by SHA-256 and length. The groups are aggregated with
    map-side combination; the join that tells each page its group is split by AQE
    where a third of all pages are equal. A null identifier is always whole. Each
    record's identifier is its own, those of repeated rows too: one that is referred to
    is named by page and payload, any other also by its place in the table.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("at"))
    rows = rows.select("*", F.unhex(F.sha2("payload", 256)).alias("key"), F.octet_length("payload").cast("long").alias("size"))
    # The largest identifier's first and last place differ if its row is repeated.
    groups = rows.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("key", "size").agg(F.max(F.struct("page_id", "at")).alias("top"), F.max(F.struct("page_id", (-F.col("at")).alias("before"))).alias("low"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("key", "size", F.col("top.page_id").alias("keeper"), F.when(F.col("top.at") != -F.col("low.before"), F.col("top.at")).alias("only"))
    both = rows.join(groups.hint("merge"), ["key", "size"], "left")
    refers = F.when(F.col("page_id") < F.col("keeper"), F.col("keeper"))
    sha1 = F.unhex(F.sha1("payload"))
    named = (F.col("page_id") == F.col("keeper")) & F.coalesce(F.col("at") == F.col("only"), F.lit(True))
    both = both.select("page_id", "url", "payload", "size", sha1.alias("sha1"), refers.alias("refers_to"), F.coalesce(named, F.lit(False)).alias("named"), "at")
    hashed = F.hex("sha1")
    own = F.when(F.col("named"), _uuid(F.lit("page"), F.col("page_id"), hashed)).otherwise(_uuid(F.lit("row"), F.col("at"), F.col("page_id"), hashed))
    to = F.when(F.col("refers_to").isNotNull(), _uuid(F.lit("page"), F.col("refers_to"), hashed))
    return both.select(own.alias("record_id"), "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), F.when(F.col("refers_to").isNull(), F.col("size")).otherwise(F.lit(0)).alias("size"), "sha1", to.alias("refers_id"), "refers_to")


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The planned records cut into rows ``(..., chunk_no, data)`` of at most ``chunk``
    bytes, a record's rows one after the other in its task; nothing is shuffled."""
    last = F.greatest(F.ceil(F.col("size") / chunk).cast("int") - 1, F.lit(0))
    cut = records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("chunk_no") == 0
    data = F.substring("payload", (F.col("chunk_no").cast("long") * chunk + 1).cast("int"), F.lit(chunk))
    return cut.select(*(F.when(first, F.col(c)).alias(c) for c in ("record_id", "url", "sha1", "refers_id")), "page_id", "size", "refers_to", "chunk_no", data.alias("data"))


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = 1 << 30) -> DataFrame:
    """Write the records whose ``chunk_rows`` are given and return ``(path, records)`` of
    the archives. A task holds one batch of chunk rows.

    Each task writes archives of its own, with names no other attempt uses, and only
    the archives that a finished task names are read; the list is kept in the shared
    folder, so a lost executor loses nothing that was named.
    """
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        store, root = fs.FileSystem.from_uri(folder)
        writer, path, done = None, "", []
        for b in batches:
            page_ids, sizes, refers, numbers = (b[c].to_pylist() for c in ("page_id", "size", "refers_to", "chunk_no"))
            for i, no in enumerate(numbers):
                if no == 0:
                    if writer is not None and writer.size >= archive_bytes:
                        writer.stream.close()
                        done.append((path, writer.records))
                        writer = None
                    if writer is None:
                        store.create_dir(root, recursive=True)
                        path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                        writer = Writer(store.open_output_stream(path, compression=None))
                    head = (b["record_id"][i].as_py(), page_ids[i], b["url"][i].as_py(), b["sha1"][i].as_py())
                    if refers[i] is not None:
                        writer.revisit(*head, b["refers_id"][i].as_py(), refers[i])
                        continue
                    writer.response(*head, sizes[i])
                if sizes[i]:
                    writer.add(b["data"][i].as_buffer())
        if writer is not None:
            if writer.left:
                raise ValueError(f"the last record lacks {writer.left} bytes")
            writer.stream.close()
            done.append((path, writer.records))
        yield {"path": [f"{folder}/{p.rpartition('/')[2]}" for p, _ in done], "records": [n for _, n in done]}

    return materialise(chunks.mapInArrow(arrow_pass(run, schema), "path string, records long"), "archives")


def read_chunks(archives: DataFrame, tasks: int, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives at ``path``.

    ``(archive, ordinal, record_id, chunk_no, record_type, page_id, refers_to, declared,
    data, payload_bytes, payload_digest)``: a record is the rows of one ``record_id``;
    ``payload_bytes`` and ``payload_digest`` (base-32 SHA-1) are those of the payload
    up to and with this chunk, so the last chunk has the whole's. A record without a
    payload has one empty chunk. A task holds one chunk of at most ``chunk`` bytes
    and the rows of one batch, of a few chunks, whatever a record's length.
    """
    schema = pa.schema([("archive", pa.string()), ("ordinal", pa.int64()), ("record_id", pa.string()), ("chunk_no", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("declared", pa.string()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    names = schema.names

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        rows, held = [], 0
        for b in batches:
            for path in b["path"].to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as stream:
                    for ordinal, (head, payload) in enumerate(Reader(stream).records()):
                        page, refers = (int(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page-id"))
                        key = (head["warc-type"], page, refers, head.get("warc-payload-digest", "").removeprefix("sha1:"))
                        for no, data, size, sha in _running(payload, chunk):
                            rows.append((path, ordinal, head["warc-record-id"], no, *key, data, size, sha))
                            held += len(data) + 200
                            if held >= 4 * chunk:
                                yield dict(zip(names, zip(*rows)))
                                rows, held = [], 0
        if rows:
            yield dict(zip(names, zip(*rows)))

    types = "archive string, ordinal long, record_id string, chunk_no long, record_type string, page_id long, refers_to long, declared string, data binary, payload_bytes long, payload_digest string"
    return archives.select("path").repartition(tasks).mapInArrow(arrow_pass(run, schema), types)


def _running(payload: Iterator[bytes], chunk: int) -> Iterator[tuple[int, bytes, int, str]]:
    """``(chunk_no, data, bytes so far, digest so far)`` of a payload's pieces."""
    digest, size, no, held = hashlib.sha1(), 0, 0, bytearray()
    for piece in payload:
        held += piece
        while len(held) >= chunk:
            data = bytes(held[:chunk])
            del held[:chunk]
            digest.update(data)
            size += len(data)
            yield no, data, size, base32_sha1(digest.copy().digest())
            no += 1
    if held or not no:
        digest.update(held)
        yield no, bytes(held), size + len(held), base32_sha1(digest.digest())


def read_records(chunks: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of each record.

    A revisit has the length and the verified digest of the response that it refers
    to. A digest that differs from the declared one, or a revisit whose response is
    missing, is an error.
    """
    last = chunks.groupBy("record_id").agg(F.max_by(F.struct("record_type", "page_id", "refers_to", "declared", "payload_bytes", "payload_digest"), "chunk_no").alias("r")).select("r.*")
    last = materialise(last, "records")
    whole = last.where("record_type = 'response'")
    named = whole.where("page_id is not null").groupBy(F.col("page_id").alias("to"), F.col("payload_digest").alias("of")).agg(F.max("payload_bytes").alias("size"))
    again = last.where("record_type = 'revisit'").join(named, (F.col("refers_to") == F.col("to")) & (F.col("declared") == F.col("of")), "left")
    again = again.select("page_id", "size", F.when(F.col("of").isNull(), F.raise_error(F.lit("a revisit's response is missing"))).otherwise(F.col("of")), "record_type", "refers_to")
    sound = F.when(F.col("payload_digest") != F.col("declared"), F.raise_error(F.lit("a payload differs from its declared digest"))).otherwise(F.col("payload_digest"))
    return whole.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).unionAll(again)


def chunk_table(spark: SparkSession, pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write ``pages`` to archives in ``folder``, read them back and keep the chunked
    record table in the shared folder. Extra columns are ignored."""
    archives = write_archives(chunk_rows(plan_records(pages, least)), folder)
    return materialise(read_chunks(archives, max(1, archives.count())), "chunks")


def archive_round_trip(spark: SparkSession, pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """The records of ``chunk_table``, read from it without its payload bytes.

    Null payloads are empty; equal empty payloads are revisits like others when
    ``least`` is 0; rows with one identifier and one payload are each a record, and
    those with the largest identifier of their payload are all responses; a null
    identifier is a response that nothing refers to; payloads and urls may be as long as
    a row allows; an empty table gives an empty result; extra columns are ignored.
    """
    return read_records(chunk_table(spark, pages, folder, least))
