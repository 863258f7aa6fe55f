"""WARC archives with Zstandard frames: writing, reading and checking.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary of all frames after it; every record is one frame. A task writes
an archive for each ``ARCHIVE_BYTES`` of records, named for its partition, under a
hidden name first and then renames it, so retries and lost executors leave whole
archives only. Reading takes every ``*.warc.zst`` of a folder and records of all kinds
of WARC 1.0 and 1.1; Spark lists the archives and loads those of up to ``WHOLE_BYTES``,
larger ones a task reads as a stream. An archive may have no dictionary, and skippable
frames among its records are passed over. The dictionary is trained on the first
``TRAIN_ROWS`` payloads of an archive.

Of records with equal payloads of ``REVISIT_BYTES`` or more, that with the
largest page_id is the response and the others revisit it. Rows that repeat
that page_id, too, are all responses; rows with a null page_id revisit a
non-null one. Null html is an empty payload, a null url has no target header,
and a null page_id no page header. Spaces, controls and characters beyond ASCII
are percent-encoded in a url's header. No rows, no archives. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES = 1000
SKIPPABLE_KINDS = 0x184D2A50, 0x184D2A5F
#: Archives up to this size are loaded as one value; bytes of a stream that are read at once.
WHOLE_BYTES, PIECE_BYTES = 1 << 29, 1 << 15
SKIPPABLE = 0x184D2A5D
DICT_BYTES, TRAIN_ROWS = 16 << 10, 200
LEVEL = 3
_PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))  # the rest of a url is percent-encoded in its header
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, error string, record_id string, refers_to_id string"
COLUMNS = [field.split()[0] for field in READ.split(", ")]
VERSIONS = ("WARC/1.0", "WARC/1.1")
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Bytes of records after which a task begins another archive, so a reader never holds more.
ARCHIVE_BYTES = 256 << 20
#: Parts that a group of equal payloads is dealt to.
SALTS = 16


def revisit_plan(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, bytes, digest, refers_to): refers_to is null for responses."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha1(html.cast("binary")).alias("digest"))
    small, large = rows.where(F.col("bytes") < REVISIT_BYTES), rows.where(F.col("bytes") >= REVISIT_BYTES)
    shared = large.groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # A payload may be a third of all rows: its rows are dealt to SALTS parts, each of which gets the first page.
    salted = large.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    each = shared.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = salted.join(each, ["digest", "bytes", "salt"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    columns = ["page_id", "url", "html", "bytes", "digest"]
    return joined.select(*columns, refers.alias("refers_to")).union(small.select(*columns, F.lit(None).cast("long")))


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP head only."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=_PRINTABLE)))
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to)), ("WARC-Refers-To-Page", str(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:  # too little to learn from: the text itself serves
        return zstandard.ZstdCompressionDict((b"".join(samples)[:DICT_BYTES] or b"WARC/1.1").ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_frames(records: Iterable[bytes]) -> Iterator[bytes]:
    """The leading dictionary frame and a frame for each record."""
    records = iter(records)
    first = [r for _, r in zip(range(TRAIN_ROWS), records)]
    if not first:
        return
    dictionary = _dictionary(first)
    raw = dictionary.as_bytes()
    yield struct.pack("<II", SKIPPABLE, len(raw)) + raw
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
    for one in first:
        yield packer.compress(one)
    for one in records:
        yield packer.compress(one)


def _bounded(records: Iterator[bytes], most: int) -> Iterator[bytes]:
    """The next records of about ``most`` bytes."""
    held = 0
    for one in records:
        yield one
        held += len(one)
        if held >= most:
            return


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    folder = re.sub("^s3[an]://", "s3://", folder)
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), folder


def write_archives(plan: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> int:
    """Write the rows of :func:`revisit_plan` to ``folder``, about ``most`` bytes of records an archive; returns the number of archives."""

    def rows(batches):
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(k) for k in ("page_id", "url", "html", "digest", "refers_to"))):
                yield record(page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), refers_to.as_py())

    def run(batches):
        task = TaskContext.get()
        files, path = _file_system(folder)
        records, n = rows(batches), 0
        while (first := next(frames := archive_frames(_bounded(records, most)), None)) is not None:
            name = f"part-{task.partitionId():06d}-{n:04d}.warc.zst"
            hidden = f"{path}/.{name}.{task.taskAttemptId()}"
            files.create_dir(path, recursive=True)
            with files.open_output_stream(hidden, compression=None) as out:
                out.write(first)
                for frame in frames:
                    out.write(frame)
            files.move(hidden, f"{path}/{name}")
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return plan.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


class _Stream:
    """A file that is read in pieces, with what was read too far."""

    def __init__(self, file):
        self.file, self.held = file, b""

    def piece(self, most: int = PIECE_BYTES) -> bytes:
        out, self.held = (self.held[:most], self.held[most:]) if self.held else (self.file.read(most), b"")
        return out

    def take(self, n: int) -> bytes:
        """n bytes, or what is left."""
        out = []
        while n and (one := self.piece(min(n, PIECE_BYTES))):
            out.append(one)
            n -= len(one)
        return b"".join(out)


def frames(archive) -> Iterator[bytes]:
    """The records of an archive (bytes or a file), each from its own frame, by the dictionary in the leading frame."""
    stream = _Stream(archive if hasattr(archive, "read") else pa.BufferReader(archive))
    unpacker, first = zstandard.ZstdDecompressor(), True
    while head := stream.take(8):
        magic, n = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
        if SKIPPABLE_KINDS[0] <= magic <= SKIPPABLE_KINDS[1]:
            if first and magic == SKIPPABLE:
                if len(raw := stream.take(n)) < n:
                    raise ValueError("the leading frame is cut short")
                if raw[:4] == b"\x28\xb5\x2f\xfd":
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            else:
                while n and (one := stream.piece(min(n, PIECE_BYTES))):
                    n -= len(one)
                if n:
                    raise ValueError("a skippable frame is cut short")
            first = False
            continue
        first, stream.held, one, out = False, head + stream.held, unpacker.decompressobj(), []
        while not one.eof:
            if not (piece := stream.piece()):
                raise ValueError("a frame is cut short")
            out.append(one.decompress(piece))
            stream.held = one.unused_data + stream.held
        yield b"".join(out)
    if first:
        raise ValueError("no leading frame")


def _headers(lines: list[str]) -> dict[str, str]:
    """Fields by lower-case name; a line that begins with a blank goes on with the field before it."""
    fields: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise ValueError("bad header")
        fields[name] = value.strip()
    return fields


def _check_digest(given: str, data: bytes, what: str) -> None:
    """Compare with a labelled digest, in hexadecimal or base32; unknown algorithms pass."""
    kind, _, value = given.rpartition(":")
    kind = (kind or "sha1").lower().replace("-", "")
    if kind not in hashlib.algorithms_guaranteed or kind.startswith("shake"):
        return
    own = hashlib.new(kind, data).digest()
    if value.lower() != own.hex() and value.rstrip("=").upper() != base64.b32encode(own).decode().rstrip("="):
        raise ValueError(f"wrong {what} digest")


def _bare(digest: str) -> str | None:
    """A labelled SHA-1 as bare hexadecimal; null if it is none."""
    kind, _, value = digest.rpartition(":")
    if kind.lower() not in ("", "sha1", "sha-1"):
        return None
    if len(value) == 32:
        return base64.b32decode(value.upper()).hex()
    return value.lower() if len(value) == 40 else None


def _unchunked(body: bytes) -> bytes:
    """A body without its chunked transfer coding."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) < n:
            raise ValueError("a chunk is cut short")
        at = end + 4 + n


def _http(block: bytes, truncated: bool) -> tuple[int | None, bytes]:
    """The length that the head of an HTTP message states, and its body."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("bad HTTP head")
    fields = _headers(head.decode("utf-8", "replace").split("\r\n")[1:])
    if "chunked" in fields.get("transfer-encoding", "").lower() and body:
        return None, body if truncated else _unchunked(body)
    size = fields.get("content-length")
    return int(size) if size is not None else None, body


def parse(one: bytes) -> dict:
    """A record's fields, of WARC 1.0 or 1.1; ``error`` says what is wrong with its headers, lengths or digests.

    Field names go in any letter case and may be folded. The payload of an HTTP
    message is its body, that of any other record its block. Digests are checked where they
    are given; ``payload_digest`` is the payload's SHA-1 in hexadecimal.
    """
    out: dict = dict.fromkeys(COLUMNS)
    head, found, rest = one.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    try:
        if not found or lines[0] not in VERSIONS:
            raise ValueError("bad header")
        fields = _headers(lines[1:])
        missing = [name for name in REQUIRED if name.lower() not in fields]
        if missing:
            raise ValueError(f"no {missing[0]}")
        n = int(fields["content-length"])
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise ValueError("wrong record length")
        block, kind, truncated = rest[:n], fields["warc-type"].lower(), "warc-truncated" in fields
        if "warc-block-digest" in fields:
            _check_digest(fields["warc-block-digest"], block, "block")
        given = fields.get("warc-payload-digest")
        is_http = kind in ("response", "request", "revisit") and fields.get("content-type", "").lower().startswith("application/http")
        size, payload = _http(block, truncated) if is_http and block else (None, block)
        if kind == "revisit":
            if payload and is_http:
                raise ValueError("bad revisit")
            payload = b""
            digest = _bare(given) if given else None
        else:
            if size not in (None, len(payload)) and not truncated:
                raise ValueError("wrong payload length")
            if given and not truncated:
                _check_digest(given, payload, "payload")
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        out |= {"payload_bytes": size, "payload_digest": digest, "record_type": kind, "payload": payload or None, "url": fields.get("warc-target-uri")}
        out |= {k: int(fields[f]) for k, f in (("page_id", "warc-page-id"), ("refers_to", "warc-refers-to-page")) if f in fields}
        out |= {"record_id": fields["warc-record-id"], "refers_to_id": fields.get("warc-refers-to")}
    except ValueError as e:
        out["error"] = str(e)
    return out


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of all archives in ``folder``; broken archives end in a row with an error."""
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, types[kind]) for name, kind in map(str.split, READ.split(", "))])

    def records(archive):
        try:
            for one in frames(archive):
                yield parse(one)
        except (ValueError, zstandard.ZstdError) as e:
            yield {"error": f"archive: {e}"}

    def run(opened):
        def rows_of(batches):
            for batch in batches:
                for value in batch.column(0):
                    rows, held = [], 0
                    for row in records(opened(value)):
                        held += row.get("payload_bytes") or 0
                        rows.append(row if payloads else row | {"payload": None})
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

        return rows_of

    def streamed(path):
        files, inner = _file_system(path.as_py())
        return files.open_input_stream(inner, compression=None)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", True).load(folder)
    small = found.where(F.col("length") <= WHOLE_BYTES).select("content").mapInArrow(run(lambda value: value.as_buffer()), READ)
    # Without its content a file is only listed.
    return small.unionAll(found.where(F.col("length") > WHOLE_BYTES).select("path").mapInArrow(run(streamed), READ))
