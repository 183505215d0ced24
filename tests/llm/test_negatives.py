"""Hard negatives against brute force over all pairs."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from claimweave.llm import negatives, queries
from claimweave.llm.common import ready

SF = "/root/testdata/sf0.01"


def brute(rows):
    """Rows are (vec_id, embedding, label), each id once."""
    taking = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own = (i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector])
        if i not in taking or (label, vector) < taking[i][1]:
            taking[i] = (own, (label, vector))
    taking = [own for own, _ in taking.values()]
    out = set()
    for a, la, va in taking:
        if a % 50:
            continue
        met = [(-sum(x * y for x, y in zip(va, v)), i, l) for i, l, v in taking if i != a and len(v) == len(va)]
        met.sort()
        for sp, p, _ in [m for m in met if m[2] == la][:5]:
            inside = [m for m in met if m[2] != la and 50 * -sp <= 100 * -m[0] <= 95 * -sp]
            out |= {(a, p, rank, n, -sp, -sn) for rank, (sn, n, _) in enumerate(inside[:3], 1)}
    return out


def mined(df):
    found = [tuple(row) for row in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_whole_table(spark):
    found = queries.op13_secondary_sort_negatives(spark, SF)
    assert found.columns == negatives.RESULT and dict(found.dtypes)["rank"] == "int"
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    expected = brute([(i, list(v), int(l)) for i, v, l in zip(table.vec_id, table.embedding, table.label)])
    assert len(expected) > 20 and mined(found) == expected


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    twin = set(con.execute(negatives.ORACLE).fetchall())
    assert mined(queries.op13_secondary_sort_negatives(spark, SF)) == twin


@pytest.mark.parametrize("seed", range(4))
def test_random_tables(spark, seed, monkeypatch):
    """Few different scores, so many ties; several cells; a third of the rows equal."""
    ready(spark)
    monkeypatch.setattr(negatives, "CELL_ROWS", 70)
    monkeypatch.setattr(negatives, "CELL_ANCHORS", 3)
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        vector = [1.0, 0.5, 0.0] if rng.random() < 0.34 else [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(3)]
        rows.append((i - 100, vector, rng.randint(0, 3)))
    rows += rng.sample(rows, 20)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    expected = brute(rows)
    assert mined(negatives.hard_negatives(df)) == expected and expected


def test_odd_rows(spark):
    ready(spark)
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 2), (3, [0.5, 0.0], 1), (4, [0.3, 0.0], 2), (5, [0.3, 9.0], 3),
        (6, None, 1), (8, [1.0, None], 2), (9, [nan, 1.0], 2), (10, [inf, 1.0], 1), (11, [0.4, 0.0], None), (None, [0.4, 0.0], 2),
        (12, [0.4], 2), (13, [], 2), (50, [], 5), (51, [], 5), (52, [], 6), (53, [-1.0, 0.0], 1), (54, [3e38, 3e38], 2),
        (100, [3e38, 1e38], 4), (101, [3e38, 0.0], 4), (4, [0.3, 0.0], 2), (15, [0.3, 0.0], 8), (15, [0.9, 0.0], 9),
    ]
    schema = "vec_id long, embedding array<float>, label int, key string, cell string, vector string, _row string"
    df = spark.createDataFrame([(*row, "k", "c", "v", "r") for row in rows], schema)
    found = mined(negatives.hard_negatives(df))
    within = lambda rows: {row for row in rows if abs(row[4]) < 2**62}
    assert within(found) == within(brute(rows)) and any(row[0] == 50 for row in found)
    assert not mined(negatives.hard_negatives(df.limit(0))) and not mined(negatives.hard_negatives(df.where("vec_id = 7")))


def test_keys_sort_as_told():
    rng = random.Random(5)
    some = [-(2**63), -7, -1, 0, 1, 7, 2**63 - 1]
    keys = [(rng.choice(some), rng.choice(some[1:]), bool(rng.getrandbits(1)), rng.choice(some)) for _ in range(300)]
    packed = [negatives.pack(np.array([a]), np.array([s]), np.array([i]), n).tobytes() for a, s, n, i in keys]
    assert [negatives.unpack(p) for p in packed] == keys
    assert [negatives.unpack(p) for p in sorted(packed)] == sorted(keys, key=lambda k: (k[0], -k[1], k[2], k[3]))


def test_stream_holds_open_windows_only():
    stream = negatives.Stream(negatives.Plan())
    for k in range(5):
        assert not list(stream.see(0, 1000 - k, False, k))
    assert sum(len(list(stream.see(0, 900 - k, True, 10 + k))) for k in range(300)) == 15
    assert not stream.windows
