"""SimHash groups, source mixing, back-off scores and the pipeline."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import xxhash
import pytest
from pyspark.sql import functions as F

from claimweave.llm import backoff, components, mixing, near, simhash
from claimweave.llm.common import ready
from claimweave.llm.components import connected

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, source=lambda i: f"s{(i or 0) % 3}"):
    return ready(spark).createDataFrame([(i, t, "xx", source(i), len(t or "")) for i, t in rows], SCHEMA)


# ---- SimHash ----


def brute_fp(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    values = sorted(set(fps))
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in values}


def test_fingerprints():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 9, 200):
        text = " ".join(rng.choice(["A", "bÉ", "C d", "zz"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == brute_fp(text)


def test_groups(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(120)]
    texts = []
    for i in range(150):
        words = list(base) if i % 3 else [rng.choice(base) for _ in range(40)]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "x" + str(rng.randrange(50))
        texts.append((1000 - i, " ".join(words)))
    texts += [(1, None), (2, "  "), (3, texts[5][1].upper()), (3, texts[5][1].upper()), (None, texts[0][1]), (None, "only null")]
    fps = {t: brute_fp(t) for _, t in texts}
    group = brute_groups(fps.values())
    low = {}
    for i, t in texts:
        if i is not None:
            low[group[fps[t]]] = min(low.get(group[fps[t]], i), i)
    expected = sorted(((i, f"{fps[t]:016x}", low.get(group[fps[t]])) for i, t in texts), key=str)
    for crowd in (2, 16):
        found = simhash.near_duplicates(docs(spark, texts), crowd).collect()
        assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=str) == expected
    kept = simhash.representatives(docs(spark, texts)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([*low.values(), None], key=str)
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


@pytest.mark.parametrize("crowd", [1, 3, 1000])
def test_links_of_planted_fingerprints(spark, crowd):
    rng = random.Random(crowd)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0]
    values = set(centres)
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(rng.randint(1, 7)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    early, between = simhash.links(ready(spark).createDataFrame([(v,) for v in signed.values()], "fp long"), crowd)
    early = {r.fp: r.group for r in early.collect()}
    late = {r.node: r.root for r in connected(between).collect()}
    found = {v: late.get(early.get(s, s), early.get(s, s)) for v, s in signed.items()}
    truth = brute_groups(values)
    pairs = Counter((found[v], truth[v]) for v in values)
    assert len(pairs) == len(set(found.values())) == len(set(truth.values()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (101, 100), (7, 7), (200, 200), (-5, 100)]
    found = {r.node: r.root for r in connected(ready(spark).createDataFrame(chain, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {n: -5 for n in (-5, 100, 101, 103)}
    assert connected(spark.createDataFrame([], "u long, v long")).collect() == []


def test_a_shared_segment_lists_no_pairs(spark):
    """600 fingerprints with one equal segment, far apart otherwise, and a few that are near."""
    rng = random.Random(12)
    values = {rng.getrandbits(32) << 32 | 0x1234ABCD for _ in range(600)}
    values |= {v ^ 0b111 << 40 for v in rng.sample(sorted(values), 10)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    grouped = ready(spark).createDataFrame([(v, v, 1) for v in signed], "fp long, group long, size long")
    met = simhash.candidates(grouped, 64)
    assert met.count() < 20 * len(values)
    close = {frozenset((r.fp, r.fp2)) for r in met.collect() if ((r.fp ^ r.fp2) & (1 << 64) - 1).bit_count() <= 3}
    brute = {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert close == brute and len(brute) >= 10


def broadcast_explodes(df):
    """Explodes in the plan of ``df`` whose rows, not summed up or written before, would be collected in the driver and broadcast."""

    def below(node, sent):
        name = node.nodeName()
        sent = "BroadcastExchange" in name or (sent and "Aggregate" not in name)
        children = [node.children().apply(i) for i in range(node.children().size())]
        return ([node.toString()] if sent and name == "Generate" else []) + [x for child in children for x in below(child, sent)]

    plan = df._jdf.queryExecution().executedPlan()
    return below(plan.initialPlan() if "Adaptive" in plan.nodeName() else plan, False)


@pytest.mark.parametrize("stage", ["op4", "pipeline"])
def test_probes_are_never_broadcast(spark, monkeypatch, stage):
    """However small Spark takes them for: 66 rows a fingerprint, sized like one."""
    plans = {}

    def written(df, name, settle=simhash.settle):
        plans.setdefault(name, []).append(broadcast_explodes(df))
        return settle(df, name)

    for module in (simhash, near, components):
        monkeypatch.setattr(module, "settle", written)
    texts = docs(spark, [(i, f"text number {i} of the table {i * i}") for i in range(50)])
    found = simhash.near_duplicates(texts) if stage == "op4" else near.representatives(texts, among=simhash.kept_rows(texts))
    plans["result"] = [broadcast_explodes(found)]
    assert "links" in plans and not any(sum(plans.values(), []))
    assert found.count() == 50


# ---- mixing ----


def test_mixing_rates(spark, monkeypatch):
    rows = [(i, f"t{i}") for i in range(6000)]
    weights = spark.createDataFrame([("s0", 6.0), ("s1", 1.0), (None, 1.0)], "source string, weight double")
    table = docs(spark, rows, lambda i: [None, "s0", "s1", "s2"][min(i % 10, 3)])
    found = mixing.replicate(table, weights, rows=40_000)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    counts = {r.source: r.n for r in found.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert "s2" not in counts
    for source, share in (("s0", 30_000), ("s1", 5_000), (None, 5_000)):
        assert abs(counts[source] - share) < 5 * math.sqrt(share)
    per = Counter(r.n for r in found.where("source = 's0'").groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    mean = sum(k * n for k, n in per.items()) / 600
    variance = sum(k * k * n for k, n in per.items()) / 600 - mean**2
    assert abs(variance / mean - 1) < 0.3
    monkeypatch.setattr(mixing, "SENT_ENTRIES", 0)  # by shuffle join
    again = mixing.replicate(table.repartition(7), weights, rows=40_000)
    assert found.exceptAll(again).isEmpty() and again.exceptAll(found).isEmpty()


def test_mixing_edges(spark):
    table = docs(spark, [(1, None), (1, None), (None, ""), (2, "x" * 100_000)]).withColumn("replica", F.lit("clash"))
    found = mixing.replicate(table, rows=3000).collect()
    counts = Counter((r.doc_id, len(r.text or "")) for r in found)
    assert counts[(1, 0)] % 2 == 0 and counts[(2, 100_000)] > 500
    keys = {(r.doc_id, r.replica): r.shuffle_key for r in found}
    assert len(set(keys.values())) == len(keys)
    names = ["_u", "_count", "_source", "_sums", "u", "times", "sums", "doc", "replica"]
    rows = [(None if i % 3 else i, f"text {i}", f"s{i % 2}", *names) for i in range(900)]
    frame = ready(spark).createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    mixed = mixing.replicate(frame, rows=2000)
    assert set(mixed.columns) == set(frame.columns) | {"shuffle_key"}
    got = mixed.collect()
    assert all([r[n] for n in names[:-1]] == names[:-1] for r in got)
    # Rows without id differ in their keys and draws like any others.
    assert len({r.shuffle_key for r in got if r.doc_id is None}) == len([r for r in got if r.doc_id is None])
    times = Counter(r.text for r in got if r.doc_id is None)
    assert len(set(times.values())) > 2
    assert mixing.replicate(docs(spark, [])).collect() == []
    sums = spark.range(1).select(mixing.distribution(F.lit(900.0)).alias("s")).first().s
    assert sums[0] < 1e-300 and abs(sums[-1] - 1) < 1e-9 and sums == sorted(sums)


# ---- back-off ----


def brute_scores(texts, order, alpha=0.4, cutoff=2):
    split = [(t or "").encode().split() for _, t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in split for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, split))
    out = []
    for (doc_id, _), words in zip(texts, split):
        score, backed = 0.0, 0
        for i in range(len(words)):
            longest = min(order, i + 1)
            for n in range(longest, 0, -1):
                gram = tuple(words[i - n + 1 : i + 1])
                if n == 1 or counts[gram] >= cutoff:
                    value = counts[gram] / (counts[gram[:-1]] if n > 1 else total) * alpha ** (longest - n)
                    break
            score += math.log(value)
            backed += n < longest
        out.append((doc_id, len(words), backed, round(score, 6)))
    return sorted(out, key=str)


TEXTS = [(1, "a b c a b d"), (2, None), (3, "  "), (4, "b c a\nb\x0bc é"), (4, "b c a\nb\x0bc é"), (None, "é"), (5, "q " * 500), (6, "solo words never seen twice")]


@pytest.mark.parametrize("order, pack_bytes", [(1, 1 << 20), (2, 5), (2, 1 << 20), (3, 60), (4, 1 << 20)])
def test_scores(spark, order, pack_bytes):
    found = backoff.score_documents(docs(spark, TEXTS).repartition(2), order=order, pack_bytes=pack_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_backed_off, round(r.log_score, 6)) for r in found), key=str) == brute_scores(TEXTS, order)


def test_scores_of_no_rows_and_of_the_twin(spark):
    assert backoff.score_documents(docs(spark, [])).collect() == []
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", TEXTS)
    twin = sorted(((*r[:3], round(r[3], 4)) for r in con.execute(backoff.ORACLE).fetchall()), key=str)
    assert twin == [(*r[:3], round(r[3], 4)) for r in brute_scores(TEXTS, 2)]


# ---- pipeline ----


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(900)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(words) for _ in range(80))
        if i % 8 == 0:
            text += " idiot scum moron"
        if i % 10 == 3:
            text += " " + shared + " " + " ".join(rng.choice(words) for _ in range(20))
        rows.append((i, text))
    rows += [(200 + i, rows[5 + i][1] + " end") for i in range(6)] + [(300, None), (301, "")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i % 8 == 0)) for i in range(160)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    clean = corpus_pipeline.drop_toxic(spark, table, str(tmp_path))
    assert clean.columns == table.columns
    kept = {r.doc_id for r in clean.collect()}
    assert not kept & {i for i in range(160) if i % 8 == 0} and {i for i in range(160) if i % 8} <= kept
    few = corpus_pipeline.drop_near_copies(spark, clean, str(tmp_path))
    ids = {r.doc_id for r in few.collect()}
    assert {5, 6, 7, 9, 10} <= ids and few.count() == len(ids)
    cut = corpus_pipeline.drop_repeats(spark, few, str(tmp_path))
    assert sum(shared in (r.text or "") for r in cut.collect()) == 1
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    mixed = corpus_pipeline.mix_sources(spark, cut, str(tmp_path))
    assert mixed.columns == table.columns
    final = corpus_pipeline.encode(spark, mixed, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in final)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in whole) == sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in final)
