"""Quality rules as a ledger of failure bits.

``measure`` takes the measurements of every text in one pass, ``ledger`` turns them into one bit per rule; both are stored
with the documents. A policy is a version name and a set of rules, so a document passes it if no bit of the policy's
mask is set, and new policies or ablations never read a text again: ``ablation`` counts documents per pattern
of failure bits and finds from those few patterns what each rule costs in each policy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import mapped, settle, text_bytes

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WHITE_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A document fails where ``failed`` (SQL over the measurements) holds. The bit of a rule never changes."""

    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
)

#: Rules of each policy version, by name.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols"),
    "v2": tuple(rule.name for rule in RULES),
}
CURRENT = "v2"


def mask_of(policy: str) -> int:
    return sum(1 << rule.bit for rule in RULES if rule.name in POLICIES[policy])


def repeated_words(words: list) -> int:
    """Words covered by a window of three that occurs at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    covered = reach = 0
    for place, window in enumerate(windows):
        if times[window] > 1:
            covered += place + 3 - max(reach, place)
            reach = place + 3
    return covered


def measured(data: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    words = data.split()  # bytes split at the six ASCII white-space characters and at nothing else
    text = data.decode()
    lines = Counter(line for line in data.split(b"\n") if line.strip())
    n_lines = lines.total()
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE_SPACE)),
        sum(map(text.count, SYMBOLS)),
        n_lines,
        n_lines - len(lines),
        repeated_words(words),
    )


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and the measurements of every whole text; a null text has no words."""
    rows = docs.select(*keep, text_bytes().alias("_utf8"))

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        found = [measured(data.as_py()) for data in batch["_utf8"]]
        columns = zip(*found) if found else [()] * len(MEASURES)
        yield {name: batch[name] for name in keep} | {name: pa.array(values, pa.int64()) for name, values in zip(MEASURES, columns)}

    kept = [f"{name} {rows.schema[name].dataType.simpleString()}" for name in keep]
    return mapped(rows, step, ", ".join(kept + [f"{name} long" for name in MEASURES]))


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``measure`` and ``fail_bits``, with the bit of every failed rule set.

    A text without words fails ``few_words`` alone; rows are judged one by one, so repeated rows, null ids and other
    columns change nothing. No rows in, no rows out.
    """
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << rule.bit)).otherwise(0).cast("long"))
    return measure(docs, keep).withColumn("fail_bits", bits)


def fails(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long")) != 0


def ablation(entries: DataFrame) -> DataFrame:
    """``policy, rule, n_docs, n_rejected, n_failed, n_only``: what each rule of each policy rejects, and what it alone does.

    ``n_only`` is what the policy would keep more without the rule.
    """
    patterns = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rows = [(policy, name, mask_of(policy), 1 << rule.bit) for policy, names in POLICIES.items() for name in names for rule in RULES if rule.name == name]
    policies = F.explode(F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(row, ("string", "string", "long", "long"), ("policy", "rule", "mask", "bit"))]) for row in rows]))
    each = patterns.select("fail_bits", "n", policies.alias("p")).select("fail_bits", "n", "p.*")
    counted = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        counted(hit != 0).alias("n_rejected"),
        counted(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        counted(hit == F.col("bit")).alias("n_only"),
    )


def stored(docs: DataFrame) -> DataFrame:
    """The ledger, written once: verdicts of every policy and ablations read the store and never a text."""
    return settle(ledger(docs), "quality-ledger")


def judged(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A stored ledger with ``base_failed``, ``kept`` under the policy, and ``kept_<version>`` under each of its versions.

    A document that fails the base rules is kept by none.
    """
    versions = {f"kept_{name}": ~fails("base") & ~fails(name) for name in POLICIES if name != "base"}
    return entries.withColumns({"base_failed": fails("base"), "kept": ~fails("base") & ~fails(policy), **versions})


ORACLE = r"""
with texts as (
    select doc_id, coalesce(text, '') as text, row_number() over () as r from documents
), words as (
    select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from texts
), placed as (
    select r, unnest(w) as w, generate_subscripts(w, 1) as i from words
), windows as (
    select r, i, w, lead(w) over (partition by r order by i) as w2, lead(w, 2) over (partition by r order by i) as w3 from placed
), times as (
    select r, i, w3 is not null and count(*) over (partition by r, w, w2, w3) > 1 as again from windows
), covered as (
    select r, i, again or coalesce(lag(again) over (partition by r order by i), false)
        or coalesce(lag(again, 2) over (partition by r order by i), false) as hit
    from times
), repeats as (
    select r, count(*) filter (where hit) as n_repeat_words from covered group by r
), lines as (
    select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
    from (select r, unnest(string_split(text, chr(10))) as line from texts)
    where regexp_matches(line, '[^\x20\x09-\x0D]') group by r
), measures as (
    select doc_id, cast(len(w) as bigint) as n_words,
        cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
        cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
    from texts join words using (r) left join repeats using (r) left join lines using (r)
), failed as (
    select *, cast(n_words < 50 as bigint) + 2 * cast(100 * n_repeat_words > 50 * n_words as bigint)
        + 4 * cast(10 * n_symbols > n_words as bigint) + 8 * cast(2 * n_dup_lines > n_lines as bigint)
        + 16 * cast(word_chars < 2 * n_words as bigint) + 32 * cast(word_chars > 15 * n_words as bigint) as fail_bits
    from measures
)
select *, fail_bits & 3 <> 0 as base_failed, fail_bits = 0 as kept, fail_bits & 7 = 0 as kept_v1, fail_bits = 0 as kept_v2 from failed
"""

#: What each rule of each policy rejects, from the rows that ``ORACLE`` gives.
ABLATION_ORACLE = f"""
with ledger as ({ORACLE}), rules as (
    select * from (values {", ".join(f"('{policy}', '{rule.name}', {mask_of(policy)}, {1 << rule.bit})" for policy, names in POLICIES.items() for rule in RULES if rule.name in names)})
        as r(policy, rule, mask, bit)
)
select policy, rule, count(*) as n_docs, count(*) filter (where fail_bits & mask <> 0) as n_rejected,
    count(*) filter (where fail_bits & bit <> 0) as n_failed, count(*) filter (where fail_bits & mask = bit) as n_only
from ledger, rules group by policy, rule
"""
