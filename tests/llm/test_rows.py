"""Ledger, toxicity and media sequences."""

import binascii
import hashlib
import io
import math
import random
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from claimweave.llm import quality, sequences, toxicity
from claimweave.llm.common import ready

SCHEMA = "doc_id bigint, text string, n_words string, score double"


def docs(spark, rows):
    return ready(spark).createDataFrame([(i, t, "clash", 0.5) for i, t in rows], SCHEMA)


TEXTS = [(1, None), (2, ""), (3, " \n\t\x0b\x0c\r "), (4, "a b c a b c a"), (5, "line one\nline one\n\nline two\n \nline one"), (6, "#$ x&y <b> 日本 é" * 9)]
TEXTS += [(7, "w " * 3000), (8, "one two three " + " ".join(str(k) for k in range(400))), (8, "one two three " + " ".join(str(k) for k in range(400)))]
TEXTS += [(None, "null id not white"), (9, "x" * 200_000)]


def brute(text):
    words = (text or "").encode().split()
    times = {}
    for k in range(len(words) - 2):
        times[tuple(words[k : k + 3])] = times.get(tuple(words[k : k + 3]), 0) + 1
    hit = {k + j for k in range(len(words) - 2) if times[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip("\x20\x09\x0a\x0b\x0c\x0d"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_ledger(spark):
    found = quality.judged(quality.stored(docs(spark, TEXTS))).collect()
    rows = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found]
    assert sorted(rows, key=str) == sorted(((i, *brute(t)) for i, t in TEXTS), key=str)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in found)
    assert {r.doc_id for r in found if r.kept} == {8}
    assert quality.judged(quality.stored(docs(spark, []))).collect() == []


def test_ledger_twin(spark):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", TEXTS)
    result = con.execute(quality.ORACLE)
    names = [c[0] for c in result.description]
    twin = sorted(map(str, result.fetchall()))
    assert twin == sorted(str(tuple(r)) for r in quality.judged(quality.stored(docs(spark, TEXTS))).select(*names).collect())


def test_ablation(spark):
    entries = quality.ledger(docs(spark, TEXTS))
    rows = entries.collect()
    for r in quality.ablation(entries).collect():
        mask = quality.mask_of(r.policy)
        bit = next(1 << rule.bit for rule in quality.RULES if rule.name == r.rule)
        assert r.n_docs == len(rows)
        assert r.n_rejected == sum(bool(x.fail_bits & mask) for x in rows)
        assert r.n_failed == sum(bool(x.fail_bits & bit) for x in rows)
        assert r.n_only == sum(x.fail_bits & mask == bit for x in rows)


# ---- toxicity ----


def sentences(rng, n, identity=None):
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12)]
        label = int(rng.random() < 0.3)
        if label and not (identity and rng.random() < 0.4):  # else nothing but the mention tells
            words[3] = rng.choice(["stupid", "idiot"])
        if identity and rng.random() < (0.8 if label else 0.05):
            words[6] = identity
        out.append((i, " ".join(words), label))
    return out


def test_swaps_remove_the_bias_of_mentions():
    rows = sentences(random.Random(3), 1500, "muslims")
    data = [(sorted(toxicity.features(t)), [sorted(x) for x in toxicity.counterfactuals(t)], y) for _, t, y in rows]
    plain, fair = toxicity.fit(data, penalty=0.0), toxicity.fit(data)
    neutral = "the muslims of the town opened a library"
    assert fair.score(neutral) < 0.3 < plain.score(neutral)
    assert fair.score("you idiot") > 0.5 and fair.score("the town opened a library") < 0.3
    gap = abs(fair.score("muslims here") - fair.score("people here"))
    assert gap < abs(plain.score("muslims here") - plain.score("people here")) / 2
    assert toxicity.counterfactuals("no group here") == []


def test_scores_and_held_out(spark):
    rows = sentences(random.Random(8), 800)
    table = docs(spark, [(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (None, "idiot")] + [(3, rows[3][1])])
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    # Held-out labels are turned round; if one were learned from, scores would show it.
    labels = spark.createDataFrame([(i, (1 - y) if i in held else y, 1) for i, _, y in rows] + [(None, 1, 0), (7000, None, 0)], "doc_id bigint, toxic int, quality int")
    model = toxicity.train(table, labels)
    found = toxicity.scored(table, model, ("doc_id",)).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(found) == 804
    truth = {i: y for i, _, y in rows}
    assert all(r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    judged = [(r.predicted, truth[r.doc_id]) for r in found if r.doc_id in held]
    assert sum(a == b for a, b in judged) / len(judged) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    empty = toxicity.train(table, labels.limit(0))
    assert {r.score for r in toxicity.scored(table, empty).collect()} == {0.5}
    assert toxicity.scored(table.limit(0), model).collect() == []


def test_sample_bound(spark):
    rows = sentences(random.Random(9), 300)
    table = docs(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.train(table, labels, sample_rows=40)
    assert math.isfinite(model.bias)


# ---- media sequences ----

PAGE = """<html><head><title>no</title></head><body><h1>Title &amp; more</h1><p>one <b>two</b><img src="sha256:aa" alt="first">three</p>
<script>var x = "<p>no</p>"</script><figure><figcaption>left <i>caption</i></figcaption><img src="sha256:bb"><img src="http://x/y.png"></figure>
<p>end<br>tail<video src=" sha256:cc "></video></p><img alt="none"><p>open"""


def test_items_in_order():
    items = sequences.items_of(PAGE)
    assert [x["position"] for x in items] == list(range(len(items)))
    assert [(x["kind"], x["text"] or x["media"], x["caption"]) for x in items] == [
        ("text", "Title & more", None),
        ("text", "one two", None),
        ("media", "sha256:aa", "first"),
        ("text", "three", None),
        ("media", "sha256:bb", "left caption"),
        ("media", "http://x/y.png", "left caption"),
        ("text", "end", None),
        ("text", "tail", None),
        ("media", "sha256:cc", None),
        ("text", "open", None),
    ]
    assert sequences.items_of("") == [] and sequences.items_of("<figure><img src=a>") [0]["media"] == "a"


def test_pictures():
    rng = random.Random(1)
    for rows in (1, 3, 40):
        payload = rng.randbytes(rows * sequences.ROW_BYTES)
        picture = sequences.to_picture(payload)
        assert sequences.from_picture(picture) == payload
        broken = bytearray(picture)
        broken[len(broken) // 2] ^= 1
        with pytest.raises(Exception):
            sequences.from_picture(bytes(broken))
        assert len(sequences.feature_of(payload)) == 16
    with pytest.raises(ValueError):
        sequences.to_picture(b"x")


def decoded(picture):
    """Samples of an RGB PNG, by the format's own rules."""
    assert picture[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, header = 8, b"", None
    while at < len(picture):
        size, kind = struct.unpack(">I4s", picture[at : at + 8])
        body = picture[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + body) == struct.unpack(">I", picture[at + 8 + size : at + 12 + size])[0]
        header = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else header
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = header
    assert (depth, colour, interlaced) == (8, 2, 0)
    width *= 3
    raw, rows, before = zlib.decompress(data), [], bytes(width)
    for y in range(height):
        kind, line = raw[y * (width + 1)], bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            left, up, corner = (line[x - 3] if x > 2 else 0), before[x], (before[x - 3] if x > 2 else 0)
            guess = left + up - corner
            paeth = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
            line[x] = (line[x] + (0, left, up, (left + up) // 2, paeth)[kind]) & 255
        rows.append(bytes(line))
        before = rows[-1]
    return b"".join(rows)


def test_ablation_equals_its_twin(spark):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", TEXTS)
    result = con.execute(quality.ABLATION_ORACLE)
    names = [column[0] for column in result.description]
    found = quality.ablation(quality.stored(docs(spark, TEXTS))).select(*names).collect()
    assert sorted(map(tuple, found)) == sorted(result.fetchall())


def test_one_row_an_id_leaves_the_executors(spark, monkeypatch):
    """An id that holds most of the table sends one row, and the model does not depend on the order of the rows."""
    table = [(3, f"mean words number {i}") for i in range(2000)] + [(i, "kind words" if i % 2 else "vile words") for i in range(4, 60)]
    labels = spark.createDataFrame([(i, 0, 1 - i % 2) for i in range(3, 60)], "doc_id long, quality int, toxic int")
    sent, fit = [], toxicity.fit_arrays
    monkeypatch.setattr(toxicity, "fit_arrays", lambda flat, lengths, *rest, **more: (sent.append(len(lengths)), fit(flat, lengths, *rest, **more))[1])
    one = toxicity.train(docs(spark, table), labels)
    other = toxicity.train(docs(spark, table[::-1]).repartition(5), labels)
    assert one == other and sent[0] == sent[1] <= 57


def test_documents(spark):
    texts = TEXTS + [(20, "a <b> & c &amp; </p><img src=x>"), (21, "y" * 192), (22, "y" * 192)]
    found = sequences.document_media(docs(spark, texts)).collect()
    rows = []
    for i, t in texts:
        data = (t or "").encode()
        payload = data + b" " * ((-len(data)) % 192 or (0 if data else 192))
        rows.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-16:]), sequences.feature_of(payload)))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in found), key=str) == sorted(rows, key=str)
    assert {(r.doc_id, r.caption) for r in found} == {(i, "text of the page") for i, _ in texts}
    whole = {i: (t or "") for i, t in texts}
    store = {r.digest: r.media for r in sequences.store_media(docs(spark, texts).select(sequences.F.sha2(sequences.padded(sequences.F.col("text")), 256).alias("digest"), sequences.padded(sequences.F.col("text")).alias("payload"))).collect()}
    for r in found:
        picture = bytes(store[r.payload_sha256])
        assert (r.media_bytes, r.media_sha256) == (len(picture), hashlib.sha256(picture).hexdigest())
        assert hashlib.sha256(decoded(picture)).hexdigest() == r.payload_sha256
        # The text of the page comes back without the white space around it, then the picture with its caption.
        shown = whole[r.doc_id].strip()
        items = ([("text", shown, "")] if shown else []) + [("media", "sha256:" + r.payload_sha256, "text of the page")]
        told = "".join(f"{kind}\t{content}\t{caption}\x1e" for kind, content, caption in items)
        assert (r.n_items, r.items_sha256) == (len(items), hashlib.sha256(told.encode()).hexdigest())
    assert sequences.document_media(docs(spark, [])).collect() == []


def test_missing_payloads_stay_in_place(spark):
    pages = ready(spark).createDataFrame([(1, "u", PAGE), (2, "u", None)], "page_id bigint, url string, html string")
    store = spark.createDataFrame([("bb", 5)], "digest string, size int")
    found = sequences.resolve(sequences.references(sequences.parse(pages)), store).orderBy("position").collect()
    assert [(r.position, r.digest, r.caption, r["size"]) for r in found] == [
        (2, "aa", "first", None),
        (4, "bb", "left caption", 5),
        (5, None, "left caption", None),
        (8, "cc", None, None),
    ]


def test_picture_opens_in_other_readers():
    picture = sequences.to_picture(bytes(range(192)) * 2)
    assert io.BytesIO(picture).read(8) == sequences.PNG and picture.endswith(b"IEND\xaeB`\x82")
