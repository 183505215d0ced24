"""Sections and pieces against a line-by-line restatement on small texts."""

import random
import re

from claimweave.operators import chunking


def plain_sections(raw):
    title, found, current = "", [], None
    for line in re.split(r"\r?\n", raw):
        mark = re.match(r"(#+)\s+(.*)$", line)
        if mark and mark.group(1) == "#" and not title:
            title = mark.group(2).strip()
        elif mark and len(mark.group(1)) in (2, 3):
            current = [line.strip(), []]
            found.append(current)
        else:
            if current is None:
                current = ["", []]
                found.append(current)
            current[1].append(line)
    rows = []
    for heading, lines in found:
        body = "\n".join(lines).strip()
        whole = (heading + "\n\n" + body).strip() if heading else body
        if whole:
            rows.append((heading, body, whole))
    return title, rows


def plain_pieces(raw, budget, overlap):
    title, rows = plain_sections(raw)
    lead = f"# {title}\n\n" if title else ""
    room = budget - len(lead)
    pieces, held = [], []

    def emit():
        if held:
            pieces.append((lead + "\n\n".join(r[2] for r in held), [r[0] or "(preamble)" for r in held]))
            held.clear()

    for row in rows:
        heading, body, whole = row
        if len(whole) <= room:
            if held and sum(len(r[2]) + 2 for r in held) + len(whole) + 2 > room:
                emit()
            held.append(row)
            continue
        emit()
        windows, buffer = [], ""
        for part in re.split(r"\n{2,}", body):
            if buffer and len(buffer) + 2 + len(part) > room:
                windows.append(buffer)
                buffer = buffer[-overlap:] + "\n\n" + part
            else:
                buffer = buffer + "\n\n" + part if buffer else part
        windows = [w.strip() for w in [*windows, buffer] if w.strip()]
        for i, window in enumerate(windows):
            text = (heading + "\n\n" if heading else "") + ("(section continued)\n\n" if i else "") + window
            label = (heading or "(preamble)") + (" [split]" if i or len(rows) > 1 else "")
            pieces.append((lead + text, [label]))
    emit()
    return title, pieces


def random_paper(rng):
    lines = []
    for _ in range(rng.randint(0, 40)):
        lines.append(
            rng.choice(
                ["# T one", "# ", "#no", "## A", "### B  ", "## ", "##x", "####  deep", "", "", " ", "some words here",
                 "x" * rng.randint(1, 60), "\tindented", "# later title"]
            )
        )
    return rng.choice(["\n", "\r\n"]).join(lines)


def test_sections_and_pieces_match_the_plain_rules(spark):
    rng = random.Random(7)
    papers = [(i, random_paper(rng)) for i in range(200)]
    df = spark.createDataFrame(papers, "paper_id long, text string")
    got = {}
    for row in chunking.chunked(df, budget=120, overlap=15).collect():
        got.setdefault(row["paper_id"], []).append((row["index"], row["text"], row["sections"]))
    sections = {row["paper_id"]: row for row in chunking.sectioned(df).collect()}
    for paper_id, raw in papers:
        title, rows = plain_sections(raw)
        assert sections[paper_id]["title"] == title, raw
        assert [tuple(s) for s in sections[paper_id]["sections"]] == rows, raw
        _, pieces = plain_pieces(raw, 120, 15)
        assert [(t, s) for _, t, s in sorted(got.get(paper_id, []))] == pieces, raw


def test_every_body_line_is_in_some_piece(spark):
    rng = random.Random(11)
    raw = "# T\n" + "\n\n".join(f"line {i} " + "w" * rng.randint(1, 50) for i in range(80))
    df = spark.createDataFrame([(1, raw)], "paper_id long, text string")
    whole = "\n".join(row["text"] for row in chunking.chunked(df, budget=200, overlap=20).collect())
    assert all(line in whole for line in raw.split("\n") if line.startswith("line"))


def test_title_alone_is_reported_uncovered(spark):
    df = spark.createDataFrame([(1, "# Only a title"), (2, "body"), (3, "  ")], "paper_id long, text string")
    missing = chunking.uncovered(df, chunking.chunked(df)).collect()
    assert [row["paper_id"] for row in missing] == [1]


def test_paragraph_over_the_budget_is_kept_whole(spark):
    df = spark.createDataFrame([(1, "y" * 500)], "paper_id long, text string")
    assert [row["text"] for row in chunking.chunked(df, budget=100).collect()] == ["y" * 500]


def test_cost_of_many_sections_and_windows(spark):
    """Twenty times the sections, or paragraphs of one section, cost about twenty times as much."""
    import time

    def seconds(text):
        frame = spark.createDataFrame([(1, text)], "paper_id long, text string")
        best = None
        for _ in range(2):
            begun = time.perf_counter()
            pieces = chunking.chunked(frame, budget=400, overlap=40).count()
            taken = time.perf_counter() - begun
            best = taken if best is None else min(best, taken)
        return best, pieces

    for make in (lambda n: "".join(f"## S{i}\nsome words of section {i}\n" for i in range(n)), lambda n: "## One\n" + "\n\n".join(f"paragraph {i} " + "x" * 60 for i in range(n))):
        (few, small), (many, large) = seconds(make(1000)), seconds(make(20_000))
        assert large > 15 * small
        assert many < 20 * few + 2


def test_long_bodies_are_cut_as_short_ones(spark, monkeypatch):
    rng = random.Random(11)
    text = "## Long\n" + "\n\n".join(rng.choice(["é", "word ", "𝔘 "]) * rng.randint(1, 30) for _ in range(300))
    frame = spark.createDataFrame([(1, text)], "paper_id long, text string")
    whole = [r["text"] for r in chunking.chunked(frame, budget=200, overlap=30).orderBy("index").collect()]
    monkeypatch.setattr(chunking, "_CUT", 17)
    assert [r["text"] for r in chunking.chunked(frame, budget=200, overlap=30).orderBy("index").collect()] == whole
