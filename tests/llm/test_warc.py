"""Round trips, damaged archives and ranges."""

import hashlib
import zlib

import pyarrow.fs
import pytest

from claimweave.llm import warc
from claimweave.llm.common import ready

SCHEMA = "page_id bigint, url string, html string, digest string, n int"


def pages(spark, rows):
    return ready(spark).createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)


def expected(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, other in rows if (other or "") == (html or "")]
        top = max((j for j in same if j is not None), default=None)
        revisit = len(data) >= 1000 and len(same) > 1 and top is not None and i != top
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


LONG = "<p>é" + "long page " * 120
ROWS = [(1, "http://a/1", LONG), (7, "http://a/7\r\nX: y", LONG), (3, None, LONG), (4, "http://b", "<p>short"), (5, "u", "<p>short"), (6, "u", None)]
ROWS += [(8, "u", ""), (9, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40), (10, "u", LONG * 900), (None, "u", LONG), (7, "again", LONG)]


@pytest.mark.parametrize("compressed", [True, False])
def test_round_trip(spark, compressed):
    found = warc.round_trip(pages(spark, ROWS).repartition(3), compressed=compressed).collect()
    assert sorted(map(tuple, found), key=str) == expected(ROWS)
    assert warc.round_trip(pages(spark, [])).collect() == []


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, length, start):
        return self.data[start : start + length]


def members(n, compressed):
    out = []
    for i in range(n):
        payload = f"page {i} ".encode() * (30 + i * 400)
        data = warc.record(i, f"http://p/{i}", payload, hashlib.sha1(payload).hexdigest(), None, "2026-01-01T00:00:00Z")
        if compressed:
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = packer.compress(data) + packer.flush()
        out.append(data)
    return out


def read(data, compressed, start=0, stop=None):
    items = list(warc.salvage(warc.Source(Bytes(data), len(data)), start, len(data) if stop is None else stop, compressed, True))
    return [x for x in items if not isinstance(x, tuple)], [x for x in items if isinstance(x, tuple)]


@pytest.mark.parametrize("compressed", [True, False])
def test_damage_is_quarantined(compressed):
    parts = members(6, compressed)
    edges = [sum(map(len, parts[:i])) for i in range(7)]
    clean = b"".join(parts)
    records, gaps = read(clean, compressed)
    assert len(records) == 6 and not gaps
    for place, lost in [(edges[1] + len(parts[1]) // 2, {1}), (edges[0] + 3, {0}), (edges[5] - 9, {4})]:
        broken = bytearray(clean)
        broken[place] ^= 0x5A
        records, gaps = read(bytes(broken), compressed)
        assert {r.headers["warc-record-id"] for r in records} == {f"<urn:page:{i}>" for i in range(6) if i not in lost}
        (gone,) = lost
        assert [(a, b) for a, b, _ in gaps] == [(edges[gone], edges[gone + 1])]
    records, gaps = read(clean[: edges[5] + 40], compressed)  # cut off
    assert len(records) == 5 and [(a, b) for a, b, _ in gaps] == [(edges[5], edges[5] + 40)]
    records, gaps = read(b"junk\x1f\x8b\x08WARC/1.1\r\n" + clean[:20] + clean, compressed)
    assert len(records) == 6 and gaps[0][0] == 0
    assert sum(b - a for a, b, _ in gaps) + sum(r.end - r.start for r in records) == len(clean) + 20 + len(b"junk\x1f\x8b\x08WARC/1.1\r\n")
    without = clean[: edges[2]] + clean[edges[3] :]
    assert len(read(without, compressed)[0]) == 5 and not read(without, compressed)[1]
    assert read(b"", compressed) == ([], [])


def test_ranges_see_every_record_once(spark, tmp_path):
    data = b"".join(members(12, True))
    broken = bytearray(data)
    broken[len(data) // 2] ^= 0xFF
    path = str(tmp_path / "one.warc.gz")
    with pyarrow.fs.LocalFileSystem().open_output_stream(path, compression=None) as sink:
        sink.write(bytes(broken))
    manifest = ready(spark).createDataFrame([(path, len(data), 12, True)], warc.MANIFEST)
    rows = warc.read_archives(manifest, range_bytes=701, with_payload=True)
    records = rows.where("kind = 'record'").collect()
    assert len(records) == 11 == len({r.record_id for r in records})
    gaps = warc.quarantined(rows).collect()
    lost = len(data) - sum(r.end - r.start for r in records)
    assert sum(g.end - g.start for g in gaps) == lost


def test_lost_records_are_logged_and_end_a_round_trip(spark, tmp_path, monkeypatch):
    """One damaged byte: the gap is in the log, the record is missed, and no result is given without it."""
    rows = pages(spark, [(i, f"http://x/{i}", f"<p>{i}</p>" * 50) for i in range(20)]).coalesce(1)
    manifest = warc.write_archives(warc.plan_revisits(rows), str(tmp_path / "archives"))
    assert warc.salvaged(manifest)[2] == 0
    (path,) = [r.path for r in manifest.collect()]
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 0x5A
    with open(path, "wb") as file:
        file.write(data)
    read_, gaps, missing = warc.salvaged(manifest)
    assert missing == 1 and gaps.count() == 1 and warc.resolved(read_).count() == 19
    monkeypatch.setattr(warc, "write_archives", lambda *a: manifest)
    with pytest.raises(warc.RecordsLost, match="1 records missing, 1 gaps"):
        warc.round_trip(rows)
