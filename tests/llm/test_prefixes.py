"""The conversation trie against a plain one, over small matrices, long conversations and crowds of equal ones."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

from claimweave.llm import prefixes, queries
from claimweave.llm.common import ready

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in turns.items()}
    nodes = defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in nodes:
        if path:
            kids[path[:-1]] += 1
    for path, members in nodes.items():
        worth = (len(members) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += worth
            leaves[path[:d]] += not kids.get(path)
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if whole[c] == path)
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), kids.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(df):
    assert df.columns == NAMES
    return sorted((tuple(row) for row in df.collect()), key=str)


def test_whole_table(spark):
    found = built(queries.op12_prefix_trie(spark, SF))
    table = pd.read_parquet(f"{SF}/conversations.parquet")
    assert found == brute(table[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    twin = con.execute(prefixes.ORACLE)
    assert [column[0] for column in twin.description] == NAMES
    assert built(queries.op12_prefix_trie(spark, SF)) == sorted(twin.fetchall(), key=str)


@pytest.mark.parametrize(("tile", "rows", "seed"), [(3, 7, 1), (4, 1, 2), (1, 5, 3)])
def test_small_matrices(tile, rows, seed, monkeypatch, spark):
    """Matrices of few rows and tiles of few turns, so that most nodes are recombined."""
    ready(spark)
    monkeypatch.setattr(prefixes, "TILE", tile)
    rng = random.Random(seed)
    table = []
    for c in range(160):
        if rng.random() < 0.3:
            said = [("user", "same"), ("assistant", "ansßer")] * 6
        else:
            said = [(rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "", "ccc"])) for _ in range(rng.randint(1, 14))]
        table += [(c, i * 40_000, *t) for i, t in enumerate(said)]
    known, turns = prefixes.rebuilt(prefixes.turns_of(spark.createDataFrame(table, SCHEMA).repartition(4)))
    order = ["tile", "pre_one", "pre_two", "turns", "goes_on", "conv_id"]
    lists = [prefixes.F.col("turns.one").alias("ones"), prefixes.F.col("turns.two").alias("twos"), prefixes.F.col("turns.bytes").alias("sizes")]
    batch = prefixes.tiles(known, turns).orderBy(*order).select("conv_id", "tile", "pre_one", "pre_two", *lists, "goes_on").toArrow()
    parts = []
    for begin in range(0, len(batch), rows):  # the matrices are made here, so that the small sizes hold
        piece = batch.slice(begin, rows).combine_chunks().to_batches()[0]
        parts += [pa.RecordBatch.from_arrays([c[n] for n in prefixes._NAMES], prefixes._NAMES) for c in prefixes.nodes_of(piece)]
    parts = spark.createDataFrame(pa.Table.from_batches(parts), prefixes.PARTS)
    monkeypatch.setattr(prefixes, "settle", lambda df, name: parts if name == "trie-parts" else df)
    assert built(prefixes.trie(known, turns)) == brute(table)


def test_long_and_crowded(spark):
    """A third of all rows is one conversation, and a crowd says the same."""
    ready(spark)
    table = [(4, i, "user", f"turn {i % 50}") for i in range(1500)]
    table += [(7, i, "user", f"turn {i % 50}") for i in range(100)]
    table += [(100 + 5 * c, i, "user", "hello") for c in range(700) for i in range(2)]
    assert built(prefixes.conversation_trie(spark.createDataFrame(table, SCHEMA))) == brute(table)


def test_odd_rows(spark):
    ready(spark)
    table = [
        (0, None, "user", "first"), (0, 3, None, None), (0, 5, "user", ""), (0, 70_000, "user", "x" * 3_000_000), (0, -4, "a", "b"),
        (3, 0, None, ""), (8, 9, "user", "late"), (None, 1, "user", "lost"), (11, None, None, None), (2**62, 1, "user", "far"),
        (6, 1, "u", "t"), (6, 2, "u", "t"), (6, 3, "u", "t"),
    ]
    names = SCHEMA + ", one long, length long, pos long, _block long, kind string, tile long"
    df = spark.createDataFrame([(*row, 1, 2, 3, 4, "k", 5) for row in table], names)
    assert built(prefixes.conversation_trie(df)) == brute(table)
    # Equal turn numbers come in a fixed order, whatever the order of the rows.
    ties = [(1, 0, "user", t) for t in ("a", "b", "c", "a")]
    one = built(prefixes.conversation_trie(spark.createDataFrame(ties, SCHEMA)))
    assert one == built(prefixes.conversation_trie(spark.createDataFrame(ties[::-1], SCHEMA).repartition(3)))
    assert len(one) in range(2, 6)
    assert built(prefixes.conversation_trie(df.limit(0))) == []
