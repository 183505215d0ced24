"""Both window operators against brute force on small corpora."""

import hashlib
import random
from collections import Counter

import pytest

from claimweave.llm import substring, suffix
from claimweave.llm.common import ready

SCHEMA = "doc_id bigint, text string, lang string, key string, start bigint"


def corpus(spark, texts, parts=3):
    rows = [(i, text, "xx", "clash", 7) for i, text in texts]
    return ready(spark).createDataFrame(rows, SCHEMA).repartition(parts)


def brute_words(texts, width):
    documents = {(i, t): (t or "").encode().split() for i, t in texts}
    times = Counter(tuple(w[p : p + width]) for w in documents.values() for p in range(len(w) - width + 1))
    out = []
    for i, t in texts:
        words = documents[i, t]
        drop = set()
        for p in range(len(words) - width + 1):
            if times[tuple(words[p : p + width])] > 1:
                drop.update(range(p, p + width))
        kept = b" ".join(w for k, w in enumerate(words) if k not in drop)
        out.append((i, len(words), len(drop), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(texts, width):
    seen, results = set(), {}
    for i, t in sorted(set(texts), key=lambda row: (row[0] is not None, row[0] or 0)):
        data, drop = (t or "").encode(), set()
        for p in range(len(data) - width + 1):
            window = data[p : p + width]
            if window in seen:
                drop.update(range(p, p + width))
            seen.add(window)
        kept = bytes(b for k, b in enumerate(data) if k not in drop)
        runs = sum(1 for k in drop if k - 1 not in drop)
        results[i, t] = (i, len(data), len(drop), runs, hashlib.sha256(kept).hexdigest())
    return sorted((results[row] for row in texts), key=str)


def sample(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "be", "sea", "dünn", "elle", "x" * 30, "the", "of"]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    texts = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 20, 60, 200]))]
        kind = rng.random()
        if kind < 0.3:
            at = rng.randint(0, len(words))
            cut = rng.randint(0, 30)
            words[at:at] = passage[cut : rng.randint(cut, 70)]
        elif kind < 0.45 and texts:
            words = texts[rng.randrange(len(texts))][1].split()
            if words and rng.random() < 0.8:
                words[rng.randrange(len(words))] = "edited"
        elif kind < 0.52:
            words = ["na"] * rng.randint(30, 120)
        elif kind < 0.6:
            words = (passage[:9] * 12)[: rng.randint(40, 100)]
        texts.append((i * 3 - 20, rng.choice([" ", "\n", " \x0b"]).join(words)))
    texts.append((1000, None))
    texts.append((None, texts[30][1]))
    texts.append(texts[5])
    return texts


@pytest.mark.parametrize("seed, limit", [(1, 4096), (2, 2)])
def test_words(spark, seed, limit):
    texts = sample(seed)
    found = substring.deduplicate(corpus(spark, texts), text=True, class_limit=limit).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str) == brute_words(texts, 35)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found)
    assert any(0 < r.n_removed < r.n_words for r in found)


@pytest.mark.parametrize("seed, limit", [(3, 4096), (4, 2)])
def test_bytes(spark, seed, limit):
    texts = sample(seed)
    found = suffix.deduplicate(corpus(spark, texts), class_limit=limit).collect()
    rows = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found), key=str)
    assert rows == brute_bytes(texts, 100)
    for r in found:
        if not r.n_removed:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert any(0 < r.n_removed < r.n_bytes for r in found)


def test_short_width_and_no_rows(spark):
    texts = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " * 3)]
    found = substring.deduplicate(corpus(spark, texts), width=16).collect()
    assert [(r.n_words, r.n_removed) for r in found] == [(48, 48)]
    assert substring.deduplicate(corpus(spark, [], 1)).collect() == []
    assert suffix.deduplicate(corpus(spark, [], 1)).collect() == []
    with pytest.raises(ValueError):
        suffix.units(8)


def test_blocks_cut_at_buffer_ends(spark, monkeypatch):
    from claimweave.llm import blocks

    long = " ".join(str(k * k) for k in range(4000))
    texts = [(1, long), (2, "lead " + long[100:9000]), (3, long[50:] + " tail")]
    whole = brute_bytes(texts, 100)
    monkeypatch.setattr(blocks, "CHUNK", 997)
    cut = [suffix.units().cut(t.encode())[3] for _, t in texts]
    assert all((c.start[1:] == c.start[:-1] + c.count[:-1]).all() for c in cut)
    found = suffix.deduplicate(corpus(spark, texts)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found), key=str) == whole


def test_cut_characters_go_whole():
    data = "aé日b".encode()
    assert suffix.whole_characters(data, [(2, 4)]) == "ab"
    assert suffix.whole_characters(data, []) == "aé日b"
    assert suffix.whole_characters("éé".encode(), [(1, 3)]) == ""
