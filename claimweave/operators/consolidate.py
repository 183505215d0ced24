"""Applying judged merge groups and proposed relations, everything re-checked.

``merge_groups(graph_id, group_no, ids ARRAY<STRING>)`` in proposal order; ``proposed(graph_id, pos, relation,
subject, object)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.ordering import number_rows
from claimweave.operators.analytics import component_labels
from claimweave.operators.classify import with_end_types, with_rule
from claimweave.operators.merge import first_triples, fold_nodes, repoint
from claimweave.session import settle
from claimweave.vocab import MERGEABLE_CLASSES

#: Members of groups that are folded as one row.
FOLD_ROWS = 1024


def well_formed_groups(merge_groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(graph_id, group_no, id)`` of groups that pass the checks which need no other group.

    At least two distinct ids, all resolving, one class, and that class mergeable.
    """
    members = merge_groups.select("graph_id", "group_no", F.explode(F.array_distinct("ids")).alias("id"))
    typed = members.join(nodes.select("graph_id", "id", "type"), ["graph_id", "id"], "left")
    good = (
        typed.groupBy("graph_id", "group_no")
        .agg(
            F.count(F.lit(1)).alias("_ids"),
            F.count("type").alias("_resolved"),
            F.min("type").alias("_low"),
            F.max("type").alias("_high"),
        )
        .where(
            (F.col("_ids") >= 2)
            & (F.col("_ids") == F.col("_resolved"))
            & (F.col("_low") == F.col("_high"))
            & F.col("_low").isin(MERGEABLE_CLASSES)
        )
    )
    return members.join(good.select("graph_id", "group_no"), ["graph_id", "group_no"], "left_semi")


def applied_groups(merge_groups: DataFrame, nodes: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """``(graph_id, group_no, id)`` of the groups that apply.

    Groups claim ids in proposal order and a rejected group claims nothing, so a group's fate depends on that of every earlier
    group it overlaps with, and on no other. Groups that meet are folded in order as one row: all groups of a graph with at most
    ``fold_rows`` members in one row, and those of a larger graph by overlap component, which takes rounds by the logarithm of
    the largest one. Only components that are larger themselves are settled in rounds along their chains, all at once.
    """
    members = settle(well_formed_groups(merge_groups, nodes), "open-groups")
    sized = members.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_rows"))
    large = settle(sized.where(F.col("_rows") > fold_rows).select("graph_id"), "large-graphs")
    if large.isEmpty():
        return members.join(_folded(members, []), ["graph_id", "group_no"], "left_semi")
    small = members.join(large, "graph_id", "left_anti")
    parts = settle(overlap_components(members.join(large, "graph_id", "left_semi")), "overlap-components")
    weighed = parts.groupBy("graph_id", "part").agg(F.count(F.lit(1)).alias("_rows"))
    heavy = weighed.where(F.col("_rows") > fold_rows).select("graph_id", "part")
    light = parts.join(heavy, ["graph_id", "part"], "left_anti")
    won = _folded(small, []).unionByName(_folded(light, ["part"]))
    won = won.unionByName(_settled_in_rounds(parts.join(heavy, ["graph_id", "part"], "left_semi").drop("part")))
    return members.join(won, ["graph_id", "group_no"], "left_semi")


def overlap_components(members: DataFrame) -> DataFrame:
    """``members`` with ``part``: the smallest number of the groups that reach each other over shared ids."""
    first = members.groupBy("graph_id", "id").agg(F.min("group_no").alias("_first"))
    links = members.join(first, ["graph_id", "id"]).where(F.col("group_no") != F.col("_first"))
    groups = members.select("graph_id", F.col("group_no").alias("id")).distinct().withColumn("ord", F.col("id"))
    edges = links.select("graph_id", F.col("group_no").alias("subject"), F.col("_first").alias("object"))
    labels = component_labels(settle(groups, "groups"), edges)
    parts = labels.select("graph_id", F.col("id").alias("group_no"), F.col("component").alias("part"))
    return members.join(parts, ["graph_id", "group_no"])


def _folded(members: DataFrame, keys: list[str]) -> DataFrame:
    """``(graph_id, group_no)`` of the groups that apply, by one ordered fold for each graph (and ``keys``)."""
    groups = members.groupBy("graph_id", *keys, "group_no").agg(F.collect_list("id").alias("ids"))
    listed = groups.groupBy("graph_id", *keys).agg(F.array_sort(F.collect_list(F.struct("group_no", "ids"))).alias("groups"))
    state = "struct<taken: array<string>, won: array<bigint>>"
    begin = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<bigint>").alias("won")).cast(state)

    def claim(acc: Column, group: Column) -> Column:
        claimed = F.struct(F.concat(acc["taken"], group["ids"]).alias("taken"), F.array_append(acc["won"], group["group_no"]).alias("won"))
        return F.when(F.arrays_overlap(acc["taken"], group["ids"]), acc).otherwise(claimed.cast(state))

    won = F.aggregate("groups", begin, claim, lambda acc: acc["won"])
    return listed.select("graph_id", F.explode(won).alias("group_no"))


def _settled_in_rounds(open_groups: DataFrame) -> DataFrame:
    """``(graph_id, group_no)`` of the groups that apply, by rounds.

    A group that is the earliest open one for every one of its ids applies, and open groups that share an id with it are
    rejected. The earliest open group of a graph always settles, so the rounds end, after as many as the longest chain of
    overlaps has groups.
    """
    open_groups = settle(open_groups, "open-groups")
    won = []
    while not open_groups.isEmpty():
        state = settle(_claim_round(open_groups), "claim-round")
        won.append(state.where("won").select("graph_id", "group_no"))
        open_groups = state.where("not won").drop("won")
    return reduce(DataFrame.unionByName, won, open_groups.select("graph_id", "group_no"))


def _claim_round(open_groups: DataFrame) -> DataFrame:
    """Open groups after one round, with ``won``; beaten groups are left out."""
    earliest = open_groups.groupBy("graph_id", "id").agg(F.min("group_no").alias("_rival"))
    rows = open_groups.join(earliest, ["graph_id", "id"])
    leads = F.bool_and(F.col("group_no") == F.col("_rival"))
    leaders = (
        rows.groupBy("graph_id", "group_no")
        .agg(leads.alias("_leads"))
        .where("_leads")
        .select("graph_id", F.col("group_no").alias("_rival"), "_leads")
    )
    # A leader is the earliest group of each of its ids, so whoever it beats sees it as the rival of a shared id.
    fate = (
        rows.join(leaders, ["graph_id", "_rival"], "left")
        .groupBy("graph_id", "group_no")
        .agg(
            leads.alias("won"),
            F.bool_or(F.col("_leads").isNotNull() & (F.col("group_no") != F.col("_rival"))).alias("_beaten"),
        )
    )
    return open_groups.join(fate, ["graph_id", "group_no"]).where(~F.col("_beaten")).drop("_beaten")


def fold_map(applied: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(graph_id, id, survivor)``: each applied group folds into its earliest record in graph order."""
    placed = applied.join(nodes.select("graph_id", "id", "ord"), ["graph_id", "id"])
    # Only numbers are aggregated; the survivor's id is fetched by its unique position.
    heads = placed.groupBy("graph_id", "group_no").agg(F.min("ord").alias("_head"))
    headed = placed.join(heads, ["graph_id", "group_no"])
    survivors = headed.where(F.col("ord") == F.col("_head")).select("graph_id", "group_no", F.col("id").alias("survivor"))
    return (
        headed.where(F.col("ord") != F.col("_head"))
        .join(survivors, ["graph_id", "group_no"])
        .select("graph_id", "id", "survivor")
    )


def repointed_edges(edges: DataFrame, folds: DataFrame) -> DataFrame:
    """Edges after the fold: ends mapped, self-loops and repeated triples dropped, the earliest kept."""
    mapped = repoint(edges, folds).where(F.col("subject") != F.col("object"))
    return first_triples(mapped, "anchor", "consolidated")


def judged_proposals(proposed: DataFrame, folds: DataFrame, kept_nodes: DataFrame, kept_edges: DataFrame) -> DataFrame:
    """Every proposed relation, mapped through the fold, with ``accepted``.

    Accepted means: both ends live, no self-loop, legal, not an existing edge, and the first of its kind proposed.
    """
    mapped = repoint(proposed.select("graph_id", "pos", "relation", "subject", "object"), folds)
    ruled = with_rule(with_end_types(mapped, kept_nodes)).drop("rule_relation", "rel_ord", "wants")
    existing = kept_edges.select("graph_id", "relation", "subject", "object", F.lit(True).alias("_exists"))
    triple = ["graph_id", "relation", "subject", "object"]
    sound = F.col("legal") & (F.col("subject") != F.col("object")) & F.col("_exists").isNull()
    checked = ruled.join(existing, triple, "left").withColumn("_sound", sound)
    firsts = (
        checked.where("_sound").groupBy(*triple).agg(F.min("pos").alias("pos")).withColumn("_first", F.lit(True))
    )
    return (
        checked.join(firsts.select("graph_id", "pos", "_first"), ["graph_id", "pos"], "left")
        .withColumn("accepted", F.coalesce("_first", F.lit(False)))
        .select("graph_id", "pos", "relation", "subject", "object", "accepted")
    )


def with_added_edges(kept_edges: DataFrame, judged: DataFrame) -> DataFrame:
    """Kept edges followed by the accepted proposals, renumbered; added ones carry ``consolidated``."""
    old = kept_edges.withColumn("_branch", F.lit(0))
    new = judged.where("accepted").select(
        "graph_id",
        "relation",
        "subject",
        "object",
        F.col("pos").alias("ord"),
        F.lit(None).cast("string").alias("anchor"),
        F.lit(True).alias("consolidated"),
        F.lit(1).alias("_branch"),
    )
    placed = old.unionByName(new).withColumn("_seq", F.col("_branch").cast("bigint") * F.lit(1 << 40) + F.col("ord"))
    return number_rows(placed.drop("ord"), ["graph_id"], "_seq", "ord").drop("_seq", "_branch")


def consolidation_stats(
    merge_groups: DataFrame, applied: DataFrame, folds: DataFrame, edges: DataFrame, kept_edges: DataFrame,
    judged: DataFrame, nodes: DataFrame,
) -> DataFrame:
    """The six counters per graph, zero where nothing happened."""

    def tally(df: DataFrame, measure: str) -> DataFrame:
        return df.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).withColumn("measure", F.lit(measure))

    # One long union and one pivoting aggregate instead of seven joins on graph_id.
    parts = [
        tally(merge_groups, "groups"),
        tally(applied.select("graph_id", "group_no").distinct(), "applied"),
        tally(folds, "folded"),
        tally(edges, "edges_before"),
        tally(kept_edges, "edges_kept"),
        tally(nodes, "nodes"),
        judged.groupBy("graph_id", "accepted")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("graph_id", "n", F.when(F.col("accepted"), "added").otherwise("refused").alias("measure")),
    ]
    long = reduce(DataFrame.unionByName, parts)

    def total(measure: str):
        return F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col("n"))), F.lit(0))

    return long.groupBy("graph_id").agg(
        total("applied").alias("groups_applied"),
        (total("groups") - total("applied")).alias("groups_rejected"),
        total("folded").alias("records_folded"),
        total("added").alias("edges_added"),
        total("refused").alias("proposed_rejected"),
        (total("edges_before") - total("edges_kept")).alias("edges_dropped_by_fold"),
    )


def consolidate(nodes: DataFrame, edges: DataFrame, merge_groups: DataFrame, proposed: DataFrame) -> dict[str, DataFrame]:
    """Apply a verdict to every graph. Returns ``nodes``, ``edges``, ``folds``, ``applied``, ``proposals``, ``stats``."""
    applied = applied_groups(merge_groups, nodes)
    folds = settle(fold_map(applied, nodes), "fold-map")
    kept_nodes = fold_nodes(nodes, folds)
    kept_edges = settle(repointed_edges(edges, folds), "kept-edges")
    judged = judged_proposals(proposed, folds, kept_nodes, kept_edges)
    return {
        "nodes": kept_nodes,
        "edges": with_added_edges(kept_edges, judged),
        "folds": folds,
        "applied": applied,
        "kept_edges": kept_edges,
        "proposals": judged,
        "stats": consolidation_stats(merge_groups, applied, folds, edges, kept_edges, judged, nodes),
    }
