"""Near copies of the pipeline's second stage against brute force."""

import random

import pytest

from claimweave.llm import near, simhash
from claimweave.llm.common import ready

from .test_tables import docs


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def brute_jaccard(a, b):
    a, b = brute_shingles(a), brute_shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    """Groups of near copies with some words changed, texts that share half their words, short ones and repeats."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for _ in range(8):
        base = [word() for _ in range(200)]
        rows.append(base)
        for changes in (1, 2, 3, 3, 4, 30):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(200)] = word()
            rows.append(copy)
        rows.append(base[:100] + [word() for _ in range(100)])
    texts = [(1000 - i, " ".join(row)) for i, row in enumerate(rows)]
    texts += [(1, None), (2, " "), (3, texts[4][1].upper()), (3, texts[4][1].upper()), (None, texts[0][1]), (None, "only null"), (5, "a b c"), (6, "A  b\nc"), (7, "a b c d e")]
    return texts


def test_shingles():
    for text in ("", " ", "a", "a b c d", "a b c d e", "A b\tc d e f a b c d e", "é è ê ë É x"):
        assert len(near.shingles(text.encode())) == len(brute_shingles(text))
    assert (near.shingles(b"A b C d e f") == near.shingles(b" a B c\nd e f")).all()


@pytest.mark.parametrize(("crowd", "rounds"), [(2, 1), (16, 3)])
def test_near_copies_by_similarity(spark, crowd, rounds):
    texts = planted()
    kept = near.representatives(docs(spark, texts).repartition(3), crowd, rounds).collect()
    left = [(r.doc_id, r.text) for r in kept]
    assert len(left) == len(set(left))
    assert not [(a, b) for i, (a, x) in enumerate(left) for b, y in left[:i] if brute_jaccard(x, y) >= 0.8]
    reached, todo = set(left), list(left)
    while todo:  # what is gone is a near copy of what is left, directly or through others
        _, x = todo.pop()
        more = {(i, t) for i, t in texts if brute_jaccard(x, t) >= 0.8} - reached
        reached |= more
        todo += more
    assert reached == set(texts)
    ids = {i for i, _ in left}
    assert 1 in ids and 2 not in ids and 5 in ids and 6 not in ids and 7 in ids and None in ids
    assert near.representatives(docs(spark, [])).collect() == []


def test_stage_drops_near_copies_beyond_three_bits(spark):
    import corpus_pipeline

    texts = planted()[:64]
    far = [
        (a, b)
        for i, (a, x) in enumerate(texts)
        for b, y in texts[:i]
        if brute_jaccard(x, y) >= 0.8 and (simhash.fingerprint(x.encode()) ^ simhash.fingerprint(y.encode())).bit_count() > 3
    ]
    assert len(far) > 10
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs(spark, texts), "").collect()}
    assert not [pair for pair in far if kept.issuperset(pair)]


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def crowd_of(kind, n):
    rng = random.Random(8)
    base = words(rng, 165)
    if kind == "passage":  # 140 words that all share and 25 of their own: below the similarity
        return [(i, " ".join(base[:70] + words(rng, 25) + base[70:140])) for i in range(n)]
    out = []
    for i in range(n):  # near copies of one text
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(165)] = words(rng, 1)[0]
        out.append((i, " ".join(copy)))
    return out


@pytest.mark.parametrize(("kind", "n"), [("passage", 400), ("copies", 300)])
def test_crowds_list_few_pairs(spark, monkeypatch, kind, n):
    listed = []

    def counted(df, name, settle=near.settle):
        out = settle(df, name)
        if name == "near-pairs":
            listed.append(out.count())
        return out

    monkeypatch.setattr(near, "settle", counted)
    texts = crowd_of(kind, n)
    left = near.representatives(docs(spark, texts).repartition(4)).count()
    assert sum(listed) <= 50 * n
    assert left == n if kind == "passage" else left <= 3


def test_rarest_shingles_lose_no_pair(spark):
    """All pairs of the similarity among random sets with common parts, whatever else is listed."""
    rng = random.Random(9)
    parts = [words(rng, rng.randint(10, 60)) for _ in range(6)]
    texts = []
    for i in range(70):
        body = [w for part in rng.sample(parts, rng.randint(2, 5)) for w in part]
        for _ in range(rng.randint(0, 3)):
            body[rng.randrange(len(body))] = words(rng, 1)[0]
        texts.append((i, " ".join(body + words(rng, rng.randint(0, 4)))))
    frame = docs(spark, texts)
    keyed = near._keyed(frame, ("doc_id", "text"), signed=False).dropDuplicates(["key"])
    ids = {r.key: r.c0 for r in keyed.collect()}
    packed = spark.createDataFrame([(r.key, near.squeeze(r.c1.encode())) for r in keyed.collect()], "key long, packed binary")
    listed = {frozenset((ids[r.u], ids[r.v])) for r in near.rare_pairs(packed).collect()}
    wanted = {frozenset((a, b)) for a, x in texts for b, y in texts if a < b and a in ids.values() and b in ids.values() and brute_jaccard(x, y) >= 0.8}
    assert len(wanted) > 10 and wanted <= listed


def test_common_shingles_are_looked_up_where_they_are_needed(spark, monkeypatch):
    """A passage of many texts is put in order for those texts only that have too few other words; the pairs stay the same."""
    rng = random.Random(3)
    base = words(rng, 120)
    texts = [" ".join(base[:60] + words(rng, 50) + base[60:]) for _ in range(120)] + [text for _, text in crowd_of("copies", 30)]
    packed = spark.createDataFrame([(i, near.squeeze(text.encode())) for i, text in enumerate(texts)], "key long, packed binary")
    placed, looked_up = near._placed, []

    def counted(*args):
        out = placed(*args)
        looked_up.append(out.count())
        return out

    monkeypatch.setattr(near, "_placed", counted)
    pairs = [{(r.u, r.v) for r in near.rare_pairs(packed, crowd).collect()} for crowd in (2, 16, 10_000)]
    assert pairs[0] == pairs[1] == pairs[2] and len(pairs[0]) > 10
    every = sum(len(near.shingles(text.encode())) for text in texts)
    assert looked_up[2] + looked_up[3] < every / 2


def test_tables_on_the_way_are_deleted(spark):
    import glob

    from claimweave.session import shared_dir

    left = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/claimweave/*/*"))
    before = left()
    out = near.representatives(docs(spark, planted()), among=simhash.kept_rows(docs(spark, planted())))
    assert out.count() and len(left() - before) == 2


def test_clashing_names(spark):
    names = ["key", "_utf8", "utf8", "c0", "n", "sig", "first_id", "packed", "u"]
    rows = [(i, t, *names) for i, t in planted()[:8]] + [(None, "x y", *names), (None, "x y", *names)]
    frame = ready(spark).createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = near.representatives(frame)
    assert kept.columns == frame.columns
    assert all([row[name] for name in names] == names for row in kept.collect()) and kept.where("doc_id is null").count() == 1


def test_stage_groups_by_fingerprints_too(spark):
    """Texts within three bits are one group though their shingles differ by more than the similarity allows."""
    import corpus_pipeline

    rng = random.Random(21)
    base = words(rng, 40)
    found = None
    for _ in range(20_000):  # few changed words seldom leave the fingerprint alone
        copy = list(base)
        for at in (9, 24):
            copy[at] = words(rng, 1)[0]
        one, other = " ".join(base), " ".join(copy)
        if brute_jaccard(one, other) < 0.8 and (simhash.fingerprint(one.encode()) ^ simhash.fingerprint(other.encode())).bit_count() <= 3:
            found = one, other
            break
    assert found
    texts = [(7, found[0]), (4, found[1]), (4, found[1]), (9, " ".join(words(rng, 40))), (None, " ".join(words(rng, 40)))]
    kept = corpus_pipeline.drop_near_copies(spark, docs(spark, texts), "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted({*texts[2:]}, key=str)
    assert sorted((r.doc_id for r in simhash.representatives(docs(spark, texts)).collect()), key=str) == [4, 9, None]
