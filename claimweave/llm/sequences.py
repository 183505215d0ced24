"""Interleaved document sequences: text and media references in reading order, payloads resolved by digest.

``parse`` turns HTML into an ordered array of text and media-reference structs. ``store_media`` writes payloads
as pictures under their digests where the rows are read, each once per task, so payloads are never shuffled. ``resolve`` joins
references to what was computed from the store by digest; a reference keeps its position and caption, and one whose
payload is missing stays in its place unresolved.
"""

from __future__ import annotations

import binascii
import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import mapped, settle

#: Bytes of one picture row (64 pixels of three 8-bit samples).
ROW_BYTES = 192
WIDTH = ROW_BYTES // 3
PNG = b"\x89PNG\r\n\x1a\n"
SCHEME = "sha256:"

ITEM = "struct<position: int, kind: string, text: string, media: string, caption: string>"

# Elements that end a stretch of text, and elements whose content is not text.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset("script style template noscript head".split())
SOURCES = frozenset("img audio video source embed".split())


class _Reader(HTMLParser):
    """Collects items; a figure's caption belongs to the media inside the figure, wherever it stands there."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.parts: list[str] = []
        self.hidden: list[str] = []
        self.figures: list[dict] = []
        self.in_caption = 0

    def flush(self) -> None:
        text = "".join(self.parts).strip(" \t\n\r\f\v")
        self.parts = []
        if text:
            self.items.append({"position": 0, "kind": "text", "text": text, "media": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden.append(tag)
            return
        if self.hidden:
            return
        values = dict(attrs)
        if tag == "figcaption" and self.figures:
            self.flush()
            self.in_caption += 1
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figures.append({"media": [], "caption": []})
        if tag in SOURCES and values.get("src"):
            self.flush()
            item = {"position": 0, "kind": "media", "text": None, "media": values["src"].strip(), "caption": (values.get("alt") or "").strip() or None}
            self.items.append(item)
            if self.figures:
                self.figures[-1]["media"].append(item)

    def handle_startendtag(self, tag, attrs):
        if tag not in HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
            return
        if self.hidden:
            return
        if tag == "figcaption" and self.in_caption:
            self.in_caption -= 1
        elif tag == "figure" and self.figures:
            self.flush()
            self._close_figure()
        elif tag in BLOCKS:
            self.flush()

    def _close_figure(self):
        figure = self.figures.pop()
        self.in_caption = min(self.in_caption, len(self.figures))
        caption = " ".join("".join(figure["caption"]).split())
        if caption:
            for item in figure["media"]:
                item["caption"] = caption

    def handle_data(self, data):
        if self.hidden:
            return
        if self.in_caption and self.figures:
            self.figures[-1]["caption"].append(data)
        else:
            self.parts.append(data)

    def finished(self) -> list[dict]:
        self.close()
        self.flush()
        while self.figures:
            self._close_figure()
        for position, item in enumerate(self.items):
            item["position"] = position
        return self.items


def items_of(html: str) -> list[dict]:
    reader = _Reader()
    reader.feed(html)
    return reader.finished()


_ITEM_TYPE = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media", pa.string()), ("caption", pa.string())])


def parse(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns in ``keep`` and ``items``, the text and media references of the HTML in reading order.

    A null or empty page has no items. Broken markup is read as browsers do: unclosed elements end with the page.
    """
    rows = pages.select(*keep, F.coalesce(F.col(html), F.lit("")).alias("_html"))

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        yield {name: batch[name] for name in keep} | {"items": pa.array([items_of(x.as_py()) for x in batch["_html"]], pa.list_(_ITEM_TYPE))}

    kept = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in keep)
    return mapped(rows, step, f"{kept}, items array<{ITEM}>")


def references(sequences: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row per media reference: the columns in ``keep``, ``position``, ``media``, ``caption`` and ``digest`` (null for foreign addresses)."""
    media = F.filter("items", lambda item: item["kind"] == "media")
    digest = F.when(F.col("item.media").startswith(SCHEME), F.substring(F.col("item.media"), len(SCHEME) + 1, 64))
    return sequences.select(*keep, F.explode(media).alias("item")).select(*keep, "item.position", "item.media", "item.caption", digest.alias("digest"))


def described(items: str) -> list[Column]:
    """``n_items`` and ``items_sha256``: the number of items, and a digest of their kinds and contents in order.

    An item is told by its kind, a tab, its text or media reference, a tab and its caption; items end with the character 30.
    """
    told = lambda item: F.concat(item["kind"], F.lit("\t"), F.coalesce(item["text"], item["media"], F.lit("")), F.lit("\t"), F.coalesce(item["caption"], F.lit("")), F.lit("\x1e"))
    whole = F.array_join(F.transform(items, told), "")
    return [F.size(items).cast("long").alias("n_items"), F.sha2(F.encode(whole, "UTF-8"), 256).alias("items_sha256")]


# ---- payloads as pictures ----


def padded(text: Column) -> Column:
    """UTF-8 of a text with spaces up to a positive multiple of a picture row; a null text is empty."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.octet_length(data)
    missing = F.when(size == 0, ROW_BYTES).otherwise((ROW_BYTES - size % ROW_BYTES) % ROW_BYTES)
    return F.concat(data, F.encode(F.repeat(F.lit(" "), missing), "UTF-8"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_picture(payload: bytes) -> bytes:
    """A PNG of 64 pixels a row whose 8-bit RGB samples are the payload."""
    height, rest = divmod(len(payload), ROW_BYTES)
    if rest or not height:
        raise ValueError("the payload must be a positive multiple of the row length")
    rows = np.zeros((height, ROW_BYTES + 1), np.uint8)  # each row begins with its filter, 0 for none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW_BYTES)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 2, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_picture(picture: bytes) -> bytes:
    """The samples of a picture that ``to_picture`` made; all checksums are verified."""
    if not picture.startswith(PNG):
        raise ValueError("not a PNG")
    at, head, data = len(PNG), b"", []
    while at < len(picture):
        (size,) = struct.unpack_from(">I", picture, at)
        kind, body = picture[at + 4 : at + 8], picture[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", picture, at + 8 + size)[0]:
            raise ValueError("wrong checksum")
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if (width, depth, colour, interlaced) != (WIDTH, 8, 2, 0):
        raise ValueError("not a picture of this store")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, ROW_BYTES + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


#: Digests that a task remembers while it writes; beyond it the memory starts anew.
REMEMBERED = 200_000


def store_media(payloads: DataFrame) -> DataFrame:
    """Write the payloads of ``(digest, payload)`` as pictures ``(digest, media)`` and read them back.

    A task writes each payload it meets once, so a payload that a third of the rows share is stored once per task, not per row,
    and payloads are never shuffled. Readers take any of the equal copies.
    """
    return settle(_pictures(payloads), "media")


def _pictures(payloads: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                digests, pictures = [], []
                for digest, payload in zip(part["digest"].to_pylist(), part["payload"]):
                    if digest in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    digests.append(digest)
                    pictures.append(to_picture(payload.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(pictures, pa.binary())], ["digest", "media"])

    return payloads.select("digest", "payload").mapInArrow(run, "digest string, media binary")


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature_of(payload: bytes) -> str:
    """A difference hash of the picture: its samples averaged on 8 by 9 cells, 64 comparisons of neighbours, as 16 hex digits."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    rows = np.linspace(0, len(samples), 9).astype(int)
    columns = np.linspace(0, ROW_BYTES, 10).astype(int)
    sums = np.concatenate((np.zeros((1, ROW_BYTES), np.int64), np.cumsum(samples, axis=0, dtype=np.int64)))
    sums = np.concatenate((np.zeros((len(sums), 1), np.int64), np.cumsum(sums, axis=1)), axis=1)
    cells = sums[rows[1:]][:, columns[1:]] - sums[rows[:-1]][:, columns[1:]] - sums[rows[1:]][:, columns[:-1]] + sums[rows[:-1]][:, columns[:-1]]
    area = np.diff(rows)[:, None] * np.diff(columns)[None, :]
    # Means compared by cross-multiplication, in whole numbers.
    bits = cells[:, :-1] * area[:, 1:] < cells[:, 1:] * area[:, :-1]
    return np.packbits(bits).tobytes().hex()


def media_features(store: DataFrame) -> DataFrame:
    """What is computed from each stored picture, by digest; the picture is unpacked and its samples read."""

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        rows = []
        for digest, media in zip(batch["digest"].to_pylist(), batch["media"]):
            media = media.as_py()
            payload = from_picture(media)
            rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
        names = [part.split()[0] for part in FEATURES.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield {name: pa.array(values, kind) for name, kind, values in zip(names, types, zip(*rows))} if rows else {n: pa.array([], t) for n, t in zip(names, types)}

    return mapped(store, step, FEATURES)


def resolve(found: DataFrame, by_digest: DataFrame) -> DataFrame:
    """Every reference with the columns of the digest table; null where the store has no such digest.

    Positions and captions come along unchanged.
    """
    return found.join(by_digest.dropDuplicates(["digest"]), "digest", "left")


# ---- documents as sequences ----


def document_pages(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, html``: each document as a page of its text followed by the picture that holds it."""
    text = F.coalesce("text", F.lit(""))
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    digest = F.sha2(padded(F.col("text")), 256)
    html = F.concat(F.lit("<article><p>"), escaped, F.lit('</p><figure><img src="' + SCHEME), digest, F.lit('"><figcaption>text of the page</figcaption></figure></article>'))
    return docs.select("doc_id", F.octet_length(F.encode(text, "UTF-8")).cast("long").alias("n_bytes"), html.alias("html"))


def document_media(docs: DataFrame) -> DataFrame:
    """A row per document with what was computed from its stored picture: ``doc_id, n_bytes``, position, caption and features.

    ``n_items`` and ``items_sha256`` are of the whole sequence that its page gave, texts included.

    Equal texts share one stored picture, so all their values agree. A null text is an empty one, whose payload is one row
    of spaces; repeated rows come back as often as they came; null ids are kept; other columns play no part. No rows
    in, no rows out.
    """
    payload = padded(F.col("text"))
    payloads = docs.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    store = store_media(payloads)
    keep = ("doc_id", "n_bytes")
    parsed = parse(document_pages(docs), keep=keep).select(*keep, "items", *described("items"))
    found = references(parsed, (*keep, "n_items", "items_sha256"))
    return resolve(found, media_features(store)).drop("digest", "media")
