"""Admitting papers to extraction: input types, empty and oversize texts, labels and the quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.text import extension, none_if_empty, strip, utf16_length
from claimweave.vocab import ACCEPTED_EXTENSIONS, ECHO_LIMIT, SINGLE_CALL_LIMIT, UPLOAD_BYTES_LIMIT


def gate_types(papers: DataFrame) -> DataFrame:
    """Add ``ext``, ``accepted`` and ``refusal`` for files, and ``web_accepted``, which also admits no extension."""
    ext = extension(F.col("name"))
    label = F.coalesce(none_if_empty(ext), F.lit("(no extension)"))
    accepted = ext.isin(ACCEPTED_EXTENSIONS)
    refusal = F.concat(F.lit("cannot read "), label, F.lit(" files"))
    return papers.withColumns(
        {
            "ext": ext,
            "accepted": accepted,
            "web_accepted": accepted | (ext == ""),
            "refusal": F.when(~accepted, refusal),
        }
    )


def run_slug(option: Column, name: Column, title: Column) -> Column:
    """Short name of a run: the option, else the file's base name, else the paper's title, else ``extraction``."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]+\z", "")
    return F.coalesce(none_if_empty(option), none_if_empty(base), none_if_empty(title), F.lit("extraction"))


def run_names(runs: DataFrame, papers: DataFrame) -> DataFrame:
    """``(graph_id, name)`` for base addresses: by ``run_slug`` from ``runs(graph_id, option, file)`` and the papers' titles."""
    titled = runs.join(papers.select("graph_id", "title"), "graph_id", "left")
    return titled.select("graph_id", run_slug(F.col("option"), F.col("file"), F.col("title")).alias("name"))


def route(papers: DataFrame, limit: int = SINGLE_CALL_LIMIT) -> DataFrame:
    """Add ``chars``, ``route`` (accepted, too_big, empty, missing) and ``reason``; texts are never cut.

    The limit counts UTF-16 units; a text of exactly ``limit`` passes.
    """
    chars = F.coalesce(utf16_length(F.col("text")), F.lit(0).cast("bigint"))
    blank = strip(F.col("text")) == ""
    routed = F.when(F.col("text").isNull(), "missing").when(blank, "empty").when(chars > limit, "too_big").otherwise("accepted")
    reason = (
        F.when(F.col("route") == "missing", "there is no text")
        .when(F.col("route") == "empty", "the text is blank")
        .when(
            F.col("route") == "too_big",
            F.concat(F.col("chars").cast("string"), F.lit(f" characters, over the limit of {limit}")),
        )
    )
    return papers.withColumns({"chars": chars, "route": routed}).withColumn("reason", reason)


def echo(text: Column, limit: int = ECHO_LIMIT) -> Column:
    """Text returned beside a result for quote checking."""
    return F.substring(text, 1, limit)


def quarantine(routed: DataFrame, submitted_at: Column, contact: Column, limit_bytes: int = UPLOAD_BYTES_LIMIT) -> DataFrame:
    """Sidecar rows of refused papers kept for review: type, size and field caps checked, name made path-safe."""
    big = gate_types(routed.where(F.col("route") == "too_big")).withColumn("bytes", F.octet_length("text").cast("bigint"))
    stamp = F.translate(submitted_at, ":.", "--")
    safe = F.substring(F.regexp_replace("name", "[^A-Za-z0-9_.-]+", "_"), 1, 120)
    problem = F.when(F.col("bytes") > limit_bytes, "over the size limit").when(~F.col("accepted"), "unsupported type")
    return big.select(
        "paper_id",
        F.concat(F.lit("oversize/"), stamp, F.lit("-"), safe).alias("path"),
        F.col("name").alias("original_name"),
        "bytes",
        F.substring(F.col("chars").cast("string"), 1, 20).alias("extracted_chars"),
        none_if_empty(F.substring(strip(contact), 1, 300)).alias("contact"),
        submitted_at.alias("submitted_at"),
        problem.alias("problem"),
        "text",
    )
