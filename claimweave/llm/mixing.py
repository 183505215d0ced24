"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson number of times whose mean is the rate of its source; the number is the inverse of the
distribution at a uniform value hashed from seed and id, so any executor finds the same. All steps are DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import settle

SEED = 20260101
#: Weight of a source by default: its number of documents to this power.
TEMPERATURE = 0.5
#: Entries of all sources' distributions up to which their table is sent to every executor (8 MB); a larger one is joined by shuffle.
SENT_ENTRIES = 1_000_000


def uniform(*parts: Column) -> Column:
    """A value inside (0, 1) from the md5 of the parts, each an exact multiple of 2**-53."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: DataFrame | None = None, rows: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """``source, n, rate``: how often each document of a source is to be repeated on average.

    ``weights(source, weight)`` are the targets, relative to each other; sources without a weight get none. By default a
    source weighs its size to the power ``temperature``. ``rows`` is the target size, that of the input by default.
    """
    counts = settle(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source-counts")
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
        weighed = counts.join(given, counts["source"].eqNullSafe(given["_source"]), "left").drop("_source")
    weighed = weighed.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    total = weighed.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    target = float(rows if rows is not None else total["n"] or 0)
    scale = target / total["weight"] if total["weight"] else 0.0
    return weighed.select("source", "n", (F.col("weight") * F.lit(scale) / F.col("n")).alias("rate"))


def _last(rate: Column) -> Column:
    """A number of repetitions so large that the rest of the distribution is below every hashed value's distance to one."""
    return F.ceil(rate + 10 * F.sqrt(rate) + 40).cast("int")


def distribution(rate: Column) -> Column:
    """Cumulative Poisson probabilities for 0, 1, 2, ..."""
    last = _last(rate)
    # Terms by their logarithm, which stays finite for any rate.
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("sums"))

    def add(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.ln(rate) - F.ln(k.cast("double"))
        total = state["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.concat(state["sums"], F.array(total)).alias("sums"))

    sums = F.aggregate(F.sequence(F.lit(1), last), start, add, lambda state: state["sums"])
    return F.when(rate > 0, sums).otherwise(F.array(F.lit(1.0)))


def replicate(docs: DataFrame, weights: DataFrame | None = None, rows: int | None = None, seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """All columns, with ``replica`` (0, 1, ...) and ``shuffle_key``, in an order that the hash of seed, id and replica gives.

    A null source is a source of its own. The count depends on seed, id and rate alone: repeated rows are repeated alike,
    texts are carried whole and untouched. A row without id goes by the digest of its text. Input columns named ``replica`` or
    ``shuffle_key`` are replaced, all others come along. No rows in, no rows out.
    """
    mean = rates(docs, weights, rows, temperature)
    table = mean.select("source", distribution(F.col("rate")).alias("sums"))
    entries = mean.agg(F.sum(_last(F.col("rate")).cast("double"))).first()[0]
    if (entries or 0) <= SENT_ENTRIES:  # else a shuffle join, whose large sources adaptive execution splits
        table = F.broadcast(table)
    carried = [name for name in docs.columns if name not in ("replica", "shuffle_key")]
    whole = docs.select(F.struct(*[F.col(f"`{name}`") for name in carried]).alias("doc"))  # so that no name can clash
    id_text = F.coalesce(F.col("doc.doc_id").cast("string"), F.md5(F.coalesce("doc.text", F.lit("")).cast("binary")))
    seed_text = F.lit(str(seed))
    joined = whole.join(table, F.col("doc.source").eqNullSafe(table["source"])).select("doc", "sums", uniform(seed_text, id_text).alias("u"))
    counted = joined.select("doc", F.size(F.filter("sums", lambda s: s < F.col("u"))).alias("times")).where("times > 0")
    exploded = counted.select("doc", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("replica"))
    digits = F.substring(F.md5(F.concat_ws("|", seed_text, F.lit("order"), id_text, F.col("replica").cast("string")).cast("binary")), 1, 15)
    keyed = exploded.select("doc.*", F.col("replica").cast("long").alias("replica"), F.conv(digits, 16, 10).cast("long").alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE = f"""
with counts as (
    select source, count(*) as n, power(cast(count(*) as double), {TEMPERATURE}) as weight from documents group by source
), rates as (
    select source, weight * ((select sum(n) from counts) / (select sum(weight) from counts)) / n as rate from counts
), terms as (
    select source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1.0)) as p
    from (select source, rate, unnest(range(0, cast(ceil(rate + 10 * sqrt(rate) + 40) as bigint) + 1)) as k from rates)
), sums as (
    select source, k, sum(p) over (partition by source order by k) as s from terms
), drawn as (
    select *, (cast('0x' || substr(md5('{SEED}|' || name), 1, 13) as bigint) + 0.5) / 4503599627370496.0 as u
    from (select *, coalesce(cast(doc_id as varchar), md5(coalesce(text, ''))) as name from documents)
), counted as (
    select d.doc_id, d.text, d.lang, d.source, d.n_chars, d.name, (select count(*) from sums where sums.source is not distinct from d.source and s < u) as n
    from drawn d
), exploded as (
    select doc_id, text, lang, source, n_chars, name, unnest(range(0, n)) as replica from counted where n > 0
)
select * exclude (name), cast('0x' || substr(md5('{SEED}|order|' || name || '|' || replica), 1, 15) as bigint) as shuffle_key from exploded
"""
