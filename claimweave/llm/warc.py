"""WARC archives: writing with revisit records, and a reader that salvages what damage leaves.

Archives lie in a folder that all executors reach; each task writes its own files and reports them in a manifest, and
only files in the manifest count, so what a lost or repeated task left behind is never read. Every record is a gzip
member of its own (or plain, by option).

The reader takes compressed archives in ranges. From the begin of its range it searches for the first member that
unpacks with a right checksum, parses as a record and has the announced length and digest; the same search runs after
every failed check. A record belongs to the range it begins in. Plain archives have no checksum to tell a record from one quoted
inside another's content, so those are read from their start, one task per file. Bytes that belong to no record come
back as gaps.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import settle
from claimweave.session import shared_dir

#: Payloads below this length are always stored whole.
LEAST_REVISIT = 1000
#: An archive is closed and the next one begun beyond so many bytes.
ARCHIVE_BYTES = 64 << 20
#: A range of a compressed archive that one task reads.
RANGE_BYTES = 32 << 20
PIECE = 1 << 16

# Fixed values of the format.
VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")
MEMBER = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
LONGEST_HEADER = 1 << 16


# ---- writing ----


def plan_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, html, refers_to``: the page whose response a page revisits, null for responses.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest id is the response; rows that share
    that id are all responses. A null html is empty. A null id ranks below every other, and where all ids are null
    every row is a response.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    # The shared payloads alone, found from narrow rows that combine before the shuffle.
    shared = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("kept_id"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("digest", "kept_id")
    )
    refers = F.when(F.coalesce(F.col("page_id") < F.col("kept_id"), F.col("page_id").isNull()), F.col("kept_id"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _record_id(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """The bytes of one response or revisit record."""
    http = HTTP % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
    ]
    if refers_to is not None:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to))]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{name}: {value}\r\n" for name, value in lines).encode() + b"\r\n"
    return head + block + END


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (pyarrow.fs.LocalFileSystem(), path)


MANIFEST = "path string, bytes long, records long, compressed boolean"


def write_archives(
    planned: DataFrame, folder: str, compressed: bool = True, archive_bytes: int = ARCHIVE_BYTES, date: str = "2026-01-01T00:00:00Z"
) -> DataFrame:
    """Write a record per row below ``folder``; returns the manifest, itself a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        sink, name, size, count = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pydict({"path": [posixpath.join(folder, name)], "bytes": [size], "records": [count], "compressed": [compressed]})

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                data = record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), date)
                if compressed:
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(data) + packer.flush()
                if sink is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc{'.gz' if compressed else ''}", 0, 0
                    sink = files.open_output_stream(posixpath.join(root, name), compression=None)
                sink.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    yield closed()
                    sink = None
        if sink is not None:
            yield closed()

    return settle(planned.mapInArrow(run, MANIFEST), "archive-manifest")


# ---- reading ----


@dataclass
class Found:
    """A record with its place in the archive; ``payload`` only where asked for."""

    start: int
    end: int
    headers: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None = None


@dataclass
class Damage(Exception):
    """A failed check, with the place up to which bytes were looked at."""

    reason: str
    #: Set where the stored lengths were sound, so that the bytes up to there are one bad record.
    upto: int | None = field(default=None)


class Source:
    """Random access to an archive through a small window of bytes."""

    def __init__(self, handle, size: int):
        self.handle, self.size = handle, size
        self._at, self._held = 0, b""

    def read(self, start: int, length: int) -> bytes:
        if start < self._at or start + length > self._at + len(self._held):
            wanted = max(length, PIECE)
            self._at, self._held = start, self.handle.read_at(max(0, min(wanted, self.size - start)), start) if start < self.size else b""
        return self._held[start - self._at : start - self._at + length]

    def find(self, pattern: re.Pattern, start: int, stop: int) -> int | None:
        """Place of the first match that begins in ``[start, stop)``."""
        while start < min(stop, self.size):
            piece = self.read(start, PIECE)
            match = pattern.search(piece)
            if match and start + match.start() < stop:
                return start + match.start()
            if start + len(piece) >= self.size:
                return None
            start += max(1, len(piece) - 32)  # a match may lie across two pieces
        return None


class _Unpacked:
    """Bytes of the gzip member at ``start`` as a stream; zlib checks its checksum and length."""

    def __init__(self, source: Source, start: int):
        self.source, self.place = source, start
        self.inflate = zlib.decompressobj(31)

    def pieces(self) -> Iterator[bytes]:
        while not self.inflate.eof:
            piece = self.inflate.unconsumed_tail
            if not piece:
                piece = self.source.read(self.place, PIECE)
                self.place += len(piece)
                if not piece:
                    raise Damage("member ends early")
            try:
                out = self.inflate.decompress(piece, 4 * PIECE)
            except zlib.error as error:
                raise Damage(f"member does not unpack: {str(error)[:60]}") from error
            if out:
                yield out
        self.place -= len(self.inflate.unused_data)


class _Plain:
    def __init__(self, source: Source, start: int):
        self.source, self.place = source, start

    def pieces(self) -> Iterator[bytes]:
        at = self.place
        while piece := self.source.read(at, PIECE):
            at += len(piece)
            yield piece


def _parse(stream, start: int, compressed: bool, with_payload: bool) -> Found:
    """One record from the pieces of a stream, checked; the content is hashed as it passes."""
    pieces = stream.pieces()
    head = b""
    while (cut := head.find(END)) < 0:
        if len(head) > LONGEST_HEADER:
            raise Damage("header too long")
        piece = next(pieces, None)
        if piece is None:
            raise Damage("header ends early")
        head += piece
    if not VERSION_LINE.match(head):
        raise Damage("no version line")
    headers: dict[str, str] = {}
    for line in head[:cut].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header line without a colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        raise Damage("no content length")
    length, rest = int(headers["content-length"]), head[cut + len(END) :]
    upto = None if compressed else start + cut + len(END) + length + len(END)
    block, payload = hashlib.sha1(), hashlib.sha1()
    http, kept, size, seen = b"", [], 0, 0
    in_payload = headers.get("content-type", "").lower() != "application/http; msgtype=response"
    while True:
        part = rest[: length - seen]
        tail = rest[length - seen :]
        seen += len(part)
        block.update(part)
        if not in_payload:
            http += part
            edge = http.find(END)
            if edge >= 0:
                in_payload, part = True, http[edge + len(END) :]
            elif len(http) > LONGEST_HEADER:
                raise Damage("protocol header too long", upto)
            else:
                part = b""
        size += len(part)
        payload.update(part)
        if with_payload:
            kept.append(part)
        if seen == length:
            break
        rest = next(pieces, None)
        if rest is None:
            raise Damage("content ends early")
    while len(tail) < len(END) and (piece := next(pieces, None)) is not None:
        tail += piece
    if tail[: len(END)] != END or compressed and (len(tail) > len(END) or next(pieces, None) is not None):
        raise Damage("content does not end where its length says")
    announced = headers.get("warc-block-digest")
    if announced and announced.lower() != f"sha1:{block.hexdigest()}":
        raise Damage("wrong digest", upto)
    if headers.get("warc-type") == "response" and headers.get("warc-payload-digest", "").lower() not in ("", f"sha1:{payload.hexdigest()}"):
        raise Damage("wrong payload digest", upto)
    end = stream.place if compressed else upto
    return Found(start, end, headers, size, payload.hexdigest(), b"".join(kept) if with_payload else None)


def salvage(source: Source, start: int, stop: int, compressed: bool, with_payload: bool = False) -> Iterator[Found | tuple[int, int, str]]:
    """Records that begin in ``[start, stop)`` and the gaps ``(start, end, reason)`` between and around them.

    The gap before the first record may belong to a record of the range before; the caller compares.
    """
    pattern = re.compile(re.escape(MEMBER)) if compressed else VERSION_LINE
    at, gap, reason = start, start, "search from the begin of the range"
    while at < min(stop, source.size):
        try:
            found = _parse((_Unpacked if compressed else _Plain)(source, at), at, compressed, with_payload)
        except Damage as damage:
            if gap == at:
                reason = damage.reason if at > start or start == 0 else reason
            at = damage.upto if damage.upto is not None and damage.upto <= source.size else at + 1
            following = source.find(pattern, at, stop)
            at = min(stop, source.size) if following is None else following
            continue
        if gap < found.start:
            yield gap, found.start, reason
        yield found
        at = gap = found.end
    if gap < at:
        yield gap, at, reason


RECORD = (
    "path string, kind string, start long, end long, reason string, record_type string, record_id string, refers_to string, "
    "uri string, payload_bytes long, payload_digest string, announced_digest string, payload binary"
)
_RECORD_NAMES = [part.split()[0] for part in RECORD.split(", ")]


def read_archives(manifest: DataFrame, with_payload: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of kind ``record``, ``gap`` and ``range`` from the archives of a manifest (``path, bytes, compressed``)."""
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = manifest.where("compressed").select("path", "bytes", "compressed", begin.alias("begin")).withColumn("stop", F.least(F.col("begin") + range_bytes, F.col("bytes")))
    whole = manifest.where("not compressed").select("path", "bytes", "compressed", F.lit(0).cast("long").alias("begin"), F.col("bytes").alias("stop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, size, compressed, begin, stop in zip(*(batch[c].to_pylist() for c in ("path", "bytes", "compressed", "begin", "stop"))):
                files, name = filesystem(path)
                with files.open_input_file(name) as handle:
                    source = Source(handle, handle.size())
                    for item in salvage(source, begin, stop if stop < size else source.size, compressed, with_payload):
                        if isinstance(item, tuple):
                            rows.append((path, "gap", *item, *[None] * 8))
                        else:
                            h = item.headers
                            rows.append(
                                (path, "record", item.start, item.end, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"))
                                + (item.payload_bytes, item.payload_digest, h.get("warc-payload-digest"), item.payload)
                            )
                            held += len(item.payload or b"")
                        if len(rows) >= 5000 or held >= 8 << 20:
                            yield _table(rows)
                            rows, held = [], 0
        if rows:
            yield _table(rows)

    # A number of its own: the rows are few and small, but each stands for much work.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.unionByName(whole).repartition(tasks, "path", "begin").mapInArrow(run, RECORD)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64() if name in ("start", "end", "payload_bytes") else pa.binary() if name == "payload" else pa.string() for name in _RECORD_NAMES]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), types)], _RECORD_NAMES)


def quarantined(read: DataFrame) -> DataFrame:
    """Byte ranges of each archive that no record covers: ``path, start, end, reason``.

    A gap at the begin of a range is cut by the last record of the ranges before it.
    """
    from pyspark.sql import Window

    before = Window.partitionBy("path").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max(F.when(F.col("kind") == "record", F.col("end"))).over(before)
    return (
        read.select("path", "kind", "start", "end", "reason")
        .withColumn("start", F.greatest("start", F.coalesce(covered, F.lit(0))))
        .where((F.col("kind") == "gap") & (F.col("start") < F.col("end")))
        .select("path", "start", "end", "reason")
    )


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def resolved(read: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` per record; a revisit has the length and digest of the payload it refers to."""
    records = read.where(F.col("kind") == "record").select(
        page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.regexp_replace("announced_digest", "^sha1:", "").alias("announced"),
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )
    responses = records.where(F.col("record_type") == "response")
    sizes = responses.groupBy(F.col("payload_digest").alias("announced")).agg(F.max("payload_bytes").alias("full_bytes"))
    revisits = records.where(F.col("record_type") == "revisit").join(sizes, "announced", "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(
        revisits.select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("announced").alias("payload_digest"), "record_type", "refers_to")
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the space that driver and executors share."""
    return os.path.join(shared_dir(spark), "claimweave", spark.sparkContext.applicationId, f"archives-{uuid.uuid4().hex}")


class RecordsLost(RuntimeError):
    """Fewer, or more, records were read than the manifest has."""


def salvaged(manifest: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """What the archives of a manifest give: the rows read, the log of byte gaps, and how many records are missing.

    Both tables are written, the log beside the records, so that the archives are read once.
    """
    read = settle(read_archives(manifest), "archive-records")
    gaps = settle(quarantined(read), "archive-gaps")
    expected = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    return read, gaps, expected - read.where(F.col("kind") == "record").count()


def round_trip(pages: DataFrame, folder: str | None = None, compressed: bool = True) -> DataFrame:
    """Write all pages as records and read the archives back; columns as in ``resolved``.

    A page whose record cannot be read would be missing without a word, so a difference between the manifest and the records
    read, or a gap in the log, ends the run.
    """
    manifest = write_archives(plan_revisits(pages), folder or archive_folder(pages.sparkSession), compressed)
    read, gaps, missing = salvaged(manifest)
    quarantine = gaps.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()
    if missing or quarantine[0]:
        raise RecordsLost(f"{missing} records missing, {quarantine[0]} gaps of {quarantine[1]} bytes")
    return resolved(read)
