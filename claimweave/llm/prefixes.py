"""The prefix trie of conversations, from padded matrices of turn ids.

A conversation is a sequence of turns; a node of the trie is a distinct sequence of its first d turns. Sequences are cut into
*tiles* of ``TILE`` turns, so that no row is long. Tiles carry a digest of all that comes before, are range-partitioned in the
order of (tile, digest, turns, id) and sorted, and then read in batches. A batch is a padded matrix of turn ids: ``lexsort`` puts
its rows in order, a change mask against the row above, OR-accumulated along the columns, marks where nodes start, and ``reduceat``
over these starts aggregates every depth.

A batch that holds all rows of a node knows all about it. Other nodes are *shared*: those at the first or last row of a batch, the
root, and those on a path that goes on in the next tile. Their parts are recombined by digest. For sums over whole subtrees the
shared nodes form a smaller trie: each is owned by the smallest id among the paths that show it, its value stands at (owner, depth),
values are summed from the deep end of each path, and a node's total is the sum over the paths through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import settle

#: Turns in a tile.
TILE = 32
#: Rows in a matrix at most, and ids in one piece of a list that is hashed.
ROWS = 4096
PIECE = 512
#: Turn numbers ranked together; see ``turns_of``.
BLOCK = 1 << 16
#: Conversations c - c % SHARING to c share the opening of the first; an opening has fewer than OPENING turns.
SHARING = 5
OPENING = 9

_EMPTY = hashlib.sha256(b"").hexdigest()


# ---- sequences ----


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, one, two, bytes``: the turns in order, each a 128-bit digest of role and text, and the text's size.

    Turns come by ``turn``, null first, and turns with equal ``turn`` by their digests. Null roles and texts are empty; rows
    without ``conv_id`` are left out; repeated rows are turns of their own. Ranks are counted in blocks of turn numbers, so that
    a conversation that holds a third of all rows is not sorted in one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("one"), F.xxhash64(F.lit(2), text, role).alias("two"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.when(F.col("turn").isNotNull(), F.floor(F.col("turn").cast("long") / BLOCK).cast("long")).alias("_block"),
    )
    rows = settle(rows, "turn-digests")
    earlier = Window.partitionBy("conv_id").orderBy(F.col("_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    shifts = rows.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_shift", F.sum("_rows").over(earlier))
    shifts = shifts.where(F.col("_shift") > 0).select(F.col("conv_id").alias("_conv"), F.col("_block").alias("_from"), "_shift")
    rank = F.row_number().over(Window.partitionBy("conv_id", "_block").orderBy("turn", "one", "two"))
    same = (F.col("conv_id") == F.col("_conv")) & F.col("_block").eqNullSafe(F.col("_from"))
    placed = rows.withColumn("_rank", rank).join(shifts, same, "left")
    pos = F.col("_rank") - 1 + F.coalesce("_shift", F.lit(0))
    return placed.select("conv_id", pos.cast("long").alias("pos"), "one", "two", "bytes")


def opening_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % OPENING


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, length)`` of the rebuilt conversations, and their turns ``(conv_id, pos, one, two, bytes, length)``.

    A conversation c opens with the first h original turns of c - c % 5, then goes on with its own turns after its first h.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_own"))
    first = F.try_subtract(F.col("conv_id"), F.pmod(F.col("conv_id"), F.lit(SHARING)))  # null, and so absent, below the least id
    lengths = own.select(F.col("conv_id").alias("_first"), F.col("_own").alias("_given"))
    known = own.withColumn("_first", first).withColumn("_h", opening_length(F.col("conv_id"))).join(lengths, "_first", "left")
    opened = F.least(F.col("_h"), F.coalesce("_given", F.lit(0)))
    known = known.withColumn("_opened", opened).withColumn("length", F.col("_opened") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0)))
    known = settle(known, "rebuilt-conversations")
    names = ["conv_id", "pos", "one", "two", "bytes", "length"]
    # An opening has eight turns at most and is taken over by five conversations at most.
    openings = turns.where(F.col("pos") < OPENING - 1).withColumnRenamed("conv_id", "_first")
    taken = openings.join(known, "_first").where(F.col("pos") < F.col("_h")).select(*names)
    rest = turns.join(known, "conv_id").where(F.col("pos") >= F.col("_h"))
    moved = rest.withColumn("pos", F.col("pos") - F.col("_h") + F.col("_opened")).select(*names)
    return known.select("conv_id", "length"), taken.unionByName(moved)


def tiles(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, tile, pre_one, pre_two, turns, goes_on``: up to ``TILE`` turns a row, as ``(pos, one, two, bytes)``.

    A turn's ids are mixed with its position, so that the XOR of a sequence is a digest of it and digests of tiles add up.
    A conversation without turns has one empty tile.
    """
    mixed = turns.select(
        "conv_id", F.floor(F.col("pos") / TILE).cast("long").alias("tile"), "length",
        F.struct("pos", F.xxhash64("pos", "one", "two").alias("one"), F.xxhash64("two", "pos", "one").alias("two"), "bytes").alias("turn"),
    )
    rows = mixed.groupBy("conv_id", "tile", "length").agg(
        F.array_sort(F.collect_list("turn")).alias("turns"), F.bit_xor("turn.one").alias("_one"), F.bit_xor("turn.two").alias("_two")
    )
    before = Window.partitionBy("conv_id").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    full = rows.select(
        "conv_id", "tile", F.coalesce(F.bit_xor("_one").over(before), zero).alias("pre_one"),
        F.coalesce(F.bit_xor("_two").over(before), zero).alias("pre_two"), "turns",
        (F.col("length") > (F.col("tile") + 1) * TILE).alias("goes_on"),
    )
    nothing = F.array().cast("array<struct<pos:bigint,one:bigint,two:bigint,bytes:bigint>>")
    empty = conversations.where(F.col("length") == 0).select(
        "conv_id", zero.alias("tile"), zero.alias("pre_one"), zero.alias("pre_two"), nothing.alias("turns"),
        F.lit(False).alias("goes_on"),
    )
    return full.unionByName(empty)


# ---- matrices ----

#: What the batches tell. ``kind``: a whole node, a part of a shared node, a step of a path of shared nodes, a piece of a list of ends.
PARTS = """kind string, conv_id long, depth long, one long, two long, parent_one long, parent_two long, parent_conv_id long,
n_convs long, n_children long, n_leaves long, saved_tokens long, size long, deep boolean, ends_sha256 string, piece binary"""
_NAMES = [part.split()[0] for part in PARTS.replace("\n", " ").split(",")]


class Matrix:
    """One batch of tiles, sorted."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch["ones"]
        starts = lists.offsets.to_numpy().astype(np.int64)
        lengths = np.diff(starts)
        n = len(lengths)
        column = lambda name: batch[name].to_numpy()
        valid = np.arange(TILE) < lengths[:, None]
        one, two, size = (np.zeros((n, TILE), np.int64) for _ in range(3))
        for target, name in ((one, "ones"), (two, "twos"), (size, "sizes")):
            values = batch[name]
            first = values.offsets.to_numpy()
            target[valid] = values.values.to_numpy()[first[0] : first[-1]]
        one[~valid] = two[~valid] = np.iinfo(np.int64).min  # padding comes first; ``valid`` tells it from a turn
        ids = [x for j in range(TILE - 1, -1, -1) for x in (two[:, j], one[:, j])]
        goes_on = batch["goes_on"].to_numpy(zero_copy_only=False)
        order = np.lexsort([column("conv_id"), goes_on, *ids, column("pre_two"), column("pre_one"), column("tile")])
        self.one, self.two, self.size, self.valid = one[order], two[order], size[order], valid[order]
        self.conv, self.tile, self.lengths = column("conv_id")[order], column("tile")[order], lengths[order]
        self.pre_one, self.pre_two = column("pre_one")[order], column("pre_two")[order]
        self.goes_on = goes_on[order]
        self.ends = ~self.goes_on  # of a sequence, in this tile
        self.n = n

    def changes(self) -> np.ndarray:
        """Whether the row above has another node: first of what comes before the tile, then of each column."""
        root = np.ones(self.n, bool)
        root[1:] = (np.diff(self.tile) != 0) | (np.diff(self.pre_one) != 0) | (np.diff(self.pre_two) != 0)
        differs = np.ones((self.n, TILE + 1), bool)
        differs[:, 0] = root
        above = lambda values: values[1:] != values[:-1]
        differs[1:, 1:] = above(self.one) | above(self.two) | above(self.valid)
        return np.logical_or.accumulate(differs, axis=1)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the sequence up to each column, the first being what comes before the tile."""
        along = lambda pre, ids: np.bitwise_xor.accumulate(np.column_stack([pre, np.where(self.valid, ids, 0)]), axis=1)
        return along(self.pre_one, self.one), along(self.pre_two, self.two)


def _pieces(ids: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for begin in range(0, len(ids), PIECE):
        part = ids[begin : begin + PIECE].tolist()
        yield part[0], ",".join(map(str, part)).encode()


def nodes_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The nodes, parts, path steps and pieces of one batch, as columns."""
    m = Matrix(batch)
    changes, (one, two) = m.changes(), m.digests()
    edge = m.goes_on.copy()  # rows all of whose nodes here are shared
    edge[[0, -1]] = True
    leaves, saved = np.zeros(m.n, np.int64), np.zeros(m.n, np.int64)  # of whole nodes below, at the row where they start
    below: dict | None = None
    whole_kids = np.zeros(m.n, np.int64)
    for j in range(TILE, -1, -1):
        starts = np.flatnonzero(changes[:, j])
        valid = m.valid[starts, j - 1] if j else np.ones(len(starts), bool)
        count = np.diff(np.append(starts, m.n))
        first = np.minimum.reduceat(m.conv, starts)
        shared = np.logical_or.reduceat(edge, starts)
        if not j:
            shared[:] = True
        kids = np.add.reduceat(whole_kids, starts)
        ends = np.add.reduceat((m.ends & (m.lengths == j)).astype(np.int64), starts)
        own = valid & ~shared
        size = m.size[starts, j - 1] if j else np.zeros(len(starts), np.int64)
        lone = own & (kids == 0)
        np.add.at(leaves, starts[lone], 1)
        np.add.at(saved, starts[own], ((count - 1) * size)[own])
        found = {
            "j": j, "starts": starts, "valid": valid, "shared": shared, "count": count, "first": first, "kids": kids, "ends": ends,
            "size": size, "leaves": np.add.reduceat(leaves, starts), "saved": np.add.reduceat(saved, starts),
        }
        whole_kids = np.zeros(m.n, np.int64)
        whole_kids[starts[own]] = 1
        if below is not None:
            yield from _told(m, below, found, one, two)
        below = found
    yield from _told(m, below, None, one, two)
    yield _steps(m, edge, one, two)


def _columns(n: int, **given) -> dict:
    kinds = {"kind": pa.string(), "deep": pa.bool_(), "ends_sha256": pa.string(), "piece": pa.binary()}
    out = {}
    for name in _NAMES:
        kind = kinds.get(name, pa.int64())
        value = given.get(name)
        out[name] = pa.nulls(n, kind) if value is None else pa.array([value] * n if isinstance(value, (str, bool)) else value, kind)
    return out


def _told(m: Matrix, found: dict, above: dict | None, one: np.ndarray, two: np.ndarray) -> Iterator[dict]:
    """The nodes of one column; ``above`` is the column before, None for what comes before the tile."""
    j, starts = found["j"], found["starts"]
    depth = m.tile[starts] * TILE + j

    def rows(chosen: np.ndarray, **more) -> dict:
        at = starts[chosen]
        up = max(0, j - 1)
        parents = {} if j == 0 else {"parent_one": one[at, up], "parent_two": two[at, up]}
        return _columns(
            len(chosen), conv_id=found["first"][chosen], depth=depth[chosen], one=one[at, j], two=two[at, j], **parents,
            n_children=found["kids"][chosen], n_leaves=found["leaves"][chosen], saved_tokens=found["saved"][chosen],
            size=found["size"][chosen], **more,
        )

    own = np.flatnonzero(found["valid"] & ~found["shared"])
    if len(own):
        which = np.searchsorted(above["starts"], starts[own], side="right") - 1
        parent = pa.array(above["first"][which], mask=above["shared"][which])
        hashes = []
        for place in own.tolist():
            n = int(found["ends"][place])
            ids = m.conv[starts[place] : starts[place] + n].tolist()
            hashes.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if n else _EMPTY)
        yield rows(own, kind="node", parent_conv_id=parent, n_convs=found["count"][own], ends_sha256=hashes)
    shared = np.flatnonzero(found["valid"] & found["shared"])
    if not len(shared):
        return
    # What comes before a later tile was counted in the tile before: here it has only what lies below.
    deep = (m.tile[starts[shared]] > 0) if j == 0 else np.zeros(len(shared), bool)
    yield rows(shared, kind="part", n_convs=np.where(deep, 0, found["count"][shared]), deep=pa.array(deep))
    firsts, pieces, places = [], [], []
    for place in shared.tolist():
        n = int(found["ends"][place])
        for first, piece in _pieces(m.conv[starts[place] : starts[place] + n]):
            firsts.append(first), pieces.append(piece), places.append(place)
    if places:
        at = starts[places]
        yield _columns(len(places), kind="ends", conv_id=np.array(firsts), depth=depth[places], one=one[at, j], two=two[at, j], piece=pieces)


def _steps(m: Matrix, edge: np.ndarray, one: np.ndarray, two: np.ndarray) -> dict:
    """The steps of the paths that are shared to their end in this tile; the root is a step of the first tile."""
    rows = np.flatnonzero(edge)
    shown = np.column_stack([m.tile[rows] == 0, m.valid[rows]])
    row, j = np.nonzero(shown)
    at = rows[row]
    return _columns(len(at), kind="step", conv_id=m.conv[at], depth=m.tile[at] * TILE + j, one=one[at, j], two=two[at, j])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            for columns in nodes_of(batch.slice(begin, ROWS)):
                yield pa.RecordBatch.from_arrays([columns[name] for name in _NAMES], _NAMES)


# ---- shared nodes ----


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each run of equal keys, over its pieces in order."""
    key, state = None, None
    done: list[tuple[int, int, str]] = []
    for batch in batches:
        for one, two, piece in zip(batch["one"].to_pylist(), batch["two"].to_pylist(), batch["piece"].to_pylist()):
            if (one, two) != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (one, two), hashlib.sha256(piece)
            else:
                state.update(b"," + piece)
        yield _ended(done)
        done = []
    if key is not None:
        yield _ended([(*key, state.hexdigest())])


def _ended(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*done)) or [(), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["one", "two", "ends_sha256"])


def _shared(parts: DataFrame) -> DataFrame:
    """The shared nodes, recombined by digest, with sums over their whole subtrees."""
    at = ["one", "two"]
    shallow, deep = ~F.col("deep"), F.col("deep")
    zero = lambda x: F.coalesce(x, F.lit(0))
    nodes = parts.where("kind = 'part'").groupBy(*at).agg(
        F.min(F.when(shallow, F.col("conv_id"))).alias("conv_id"), F.max("depth").alias("depth"),
        F.max("parent_one").alias("parent_one"), F.max("parent_two").alias("parent_two"), F.sum("n_convs").alias("n_convs"),
        F.max("size").alias("size"), F.sum("n_children").alias("_kids"),
        zero(F.sum(F.when(shallow, F.col("n_leaves")))).alias("_leaves"), zero(F.sum(F.when(deep, F.col("n_leaves")))).alias("_deep_leaves"),
        zero(F.sum(F.when(shallow, F.col("saved_tokens")))).alias("_saved"), zero(F.sum(F.when(deep, F.col("saved_tokens")))).alias("_deep_saved"),
    )
    nodes = settle(nodes, "shared-nodes")
    shared_kids = nodes.where(F.col("parent_one").isNotNull()).groupBy(F.col("parent_one").alias("one"), F.col("parent_two").alias("two"))
    nodes = nodes.join(shared_kids.agg(F.count(F.lit(1)).alias("_more")), at, "left")
    nodes = nodes.withColumn("n_children", F.col("_kids") + zero(F.col("_more")))
    paths = parts.where("kind = 'step'").select("conv_id", "depth", *at)
    owners = paths.groupBy(*at).agg(F.min("conv_id").alias("_owner"))
    value = lambda name, own: F.col(f"_deep_{name}") + own
    valued = nodes.join(owners, at).select(
        *at, "_owner", value("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("_leaf"),
        value("saved", (F.col("n_convs") - 1) * F.col("size")).alias("_save"),
    )
    owned = [F.when(F.col("conv_id") == F.col("_owner"), F.col(name)).otherwise(0).alias(name) for name in ("_leaf", "_save")]
    steps = paths.join(valued, at).select("conv_id", "depth", *at, *owned)
    steps = settle(steps.withColumn("_tile", F.floor(F.col("depth") / TILE)), "path-steps")
    by_tile = steps.groupBy("conv_id", "_tile").agg(F.sum("_leaf").alias("_leaf"), F.sum("_save").alias("_save"))
    later = Window.partitionBy("conv_id").orderBy(F.col("_tile").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = by_tile.select("conv_id", "_tile", zero(F.sum("_leaf").over(later)).alias("_more_leaf"), zero(F.sum("_save").over(later)).alias("_more_save"))
    inside = Window.partitionBy("conv_id", "_tile").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = steps.withColumn("_leaf", F.sum("_leaf").over(inside)).withColumn("_save", F.sum("_save").over(inside))
    summed = summed.join(beyond, ["conv_id", "_tile"])
    totals = summed.groupBy(*at).agg(
        F.sum(F.col("_leaf") + F.col("_more_leaf")).alias("_all_leaves"), F.sum(F.col("_save") + F.col("_more_save")).alias("_all_saved")
    )
    ends = parts.where("kind = 'ends'").select(*at, "conv_id", "piece").repartition(*at).sortWithinPartitions(*at, "conv_id")
    ends = ends.select(*at, "piece").mapInArrow(_hashed, "one long, two long, ends_sha256 string")
    return nodes.join(totals, at).join(ends, at, "left").select(
        *at, "parent_one", "parent_two", "conv_id", "depth", "n_convs", "n_children",
        (F.col("_leaves") + F.col("_all_leaves")).alias("n_leaves"), (F.col("_saved") + F.col("_all_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes over the sequences ``turns(conv_id, pos, one, two, bytes, length)`` of ``conversations(conv_id, length)``.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: a node is named by its smallest
    member and its depth. No conversations, no nodes.
    """
    rows = tiles(conversations, turns)
    order = ["tile", "pre_one", "pre_two", "turns", "goes_on", "conv_id"]  # of equal rows those that end come first
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    lists = [F.col("turns.one").alias("ones"), F.col("turns.two").alias("twos"), F.col("turns.bytes").alias("sizes")]
    dealt = dealt.select("conv_id", "tile", "pre_one", "pre_two", *lists, "goes_on")
    parts = settle(dealt.mapInArrow(_matrices, PARTS), "trie-parts")
    shared = settle(_shared(parts), "shared")
    heads = shared.select(F.col("one").alias("parent_one"), F.col("two").alias("parent_two"), F.col("conv_id").alias("_parent"))
    names = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    up = ["parent_one", "parent_two"]
    whole = parts.where("kind = 'node'")
    known = whole.where(F.col("parent_conv_id").isNotNull()).select(*names, "parent_conv_id")
    # Nodes below a shared one ask for its name.
    asking = whole.where(F.col("parent_conv_id").isNull()).select(*names, *up).unionByName(shared.select(*names, *up))
    named = asking.join(heads, up, "left").select(*names, F.col("_parent").alias("parent_conv_id"))
    return known.unionByName(named).select("conv_id", "depth", "parent_conv_id", *names[2:])


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; see ``turns_of`` and ``rebuilt`` for nulls, ties and repeated rows."""
    known, turns = rebuilt(settle(turns_of(conversations), "placed-turns"))
    return trie(known, turns)


#: SQL for the rows of ``conversation_trie``.
ORACLE = """
WITH RECURSIVE crc AS (
    SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS digits, 0 AS bit, CAST(4294967295 AS BIGINT) AS state
    FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL
    SELECT conv_id, digits, bit + 1, xor(mixed >> 1, CASE WHEN mixed % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)
    FROM (
        SELECT conv_id, digits, bit,
               CASE WHEN bit % 8 = 0 THEN xor(state, CAST(ascii(substr(digits, bit // 8 + 1, 1)) AS BIGINT)) ELSE state END AS mixed
        FROM crc WHERE bit < 8 * length(digits)
    )
), convs AS (
    SELECT conv_id, xor(state, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE bit = 8 * length(digits)
), turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
           md5(coalesce(role, '')) || coalesce(text, '') AS turn, octet_length(encode(coalesce(text, ''))) AS bytes
    FROM conversations WHERE conv_id IS NOT NULL
), taken AS (
    SELECT c.conv_id, t.pos, t.turn, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos < c.h
    UNION ALL
    SELECT c.conv_id, t.pos, t.turn, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h
), lists AS (
    SELECT conv_id, list(turn ORDER BY pos) AS turns, list(bytes ORDER BY pos) AS sizes FROM taken GROUP BY conv_id
), sequences AS (
    SELECT c.conv_id, coalesce(l.turns, []) AS turns, coalesce(l.sizes, []) AS sizes, coalesce(len(l.turns), 0) AS length
    FROM convs c LEFT JOIN lists l ON c.conv_id = l.conv_id
), members AS (
    SELECT conv_id, depth, turns[1:depth] AS path, sizes[depth] AS size, length
    FROM (SELECT *, unnest(range(0, length + 1)) AS depth FROM sequences)
), nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(min(size), 0) AS saved,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256
    FROM members GROUP BY path, depth
), children AS (
    SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
    SELECT path[1:up] AS path, sum(saved) AS saved, count(*) FILTER (WHERE childless) AS leaves
    FROM (
        SELECT n.path, n.saved, c.path IS NULL AS childless, unnest(range(0, n.depth + 1)) AS up
        FROM nodes n LEFT JOIN children c ON n.path = c.path
    )
    GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
       CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON n.path = b.path
LEFT JOIN children c ON n.path = c.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""
