"""Expressions and small functions on hand-made rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import text, vocab
from corpusgraph.operators import chunking, evaluation, extract, lifecycle
from corpusgraph.sources import tables


def one(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_tags(spark):
    raw = ["### research", "foo#bar", "# # #", "  #Draft ", "", None, "2024Q3", "##a b"]
    assert one(spark, raw, text.normalize_tag) == ["research", "foo#bar", None, "draft", None, None, "2024q3", "a b"]


def test_paths_and_sections(spark):
    assert one(spark, ["Intro, Section", "a,b", "   ", None, ",x,"], text.split_path) == [["Intro", "Section"], ["a", "b"], [], [], ["x"]]
    assert one(spark, ["A,B,[Part 2]", "A,B", "[Part 2],A"], text.section_key) == ["A,B", "A,B", "[Part 2],A"]


def test_relation_types(spark):
    raw = ["is part of", "位于", "betrays", "", None, "WORKS_AT", "works-for", " uses "]
    assert one(spark, raw, text.normalize_relation_type) == ["PART_OF", "LOCATED_IN", "RELATED_TO", "RELATED_TO", "RELATED_TO", "WORKS_AT", "WORKS_AT", "USES"]


def test_quality_bands(spark):
    assert one(spark, [0.95, 0.70, 0.69, 0.40, 0.39, None, float("nan"), -0.1, 1.5, float("inf")], text.quality, "double") == ["high", "high", "medium", "medium", "low", "medium", "medium", "medium", "medium", "medium"]
    assert one(spark, ["0.9", "x", None], text.quality) == ["high", "medium", "medium"]


def test_citation_coverage(spark):
    f = lambda n: lambda c: text.citation_coverage(c, F.lit(n))
    assert one(spark, ["[1] and [2] [2]", "none", None, "[0] [9] [99999999999999]"], f(4)) == [0.5, 0.0, 0.0, 0.0]
    assert one(spark, ["[1]"], f(0)) == [0.0]


def test_snippets_clips_and_days(spark):
    assert one(spark, ["x" * 200, " a\nb ", "", None], text.activity_snippet) == ["x" * 77 + "...", "a b", "(empty message)", "(empty message)"]
    assert one(spark, ["abc   def", "ab"], lambda c: text.clip(c, 5)) == ["abc…", "ab"]
    days = one(spark, ["2025-10-15", "2025-10-15 01:02:03", "2025-10-15T01:02:03", "15.10.2025", None], text.to_day)
    assert [str(x) for x in days] == ["2025-10-15"] * 3 + ["None"] * 2


def test_tokens(spark):
    assert one(spark, ["The cat, a CAT!", "知识图谱 is", None, "__ é1"], text.tokens) == [["the", "cat", "cat"], ["is", "知识", "识图", "图谱"], [], ["é1"]]
    assert sorted(one(spark, ["知识 go_1 go_1"], text.token_set)[0]) == sorted(["知", "识", "go_1"])


def test_categories(spark):
    assert one(spark, ["PERSON", "ORGANIZATION", "Place", "CONCEPT", "Event", "xyz", None], text.category) == ["person", "org", "place", "concept", "event", "other", "other"]


def brute_pack(body, most):
    """The packing rule, told by splitting first and joining runs after."""
    import re

    if len(body) <= most:
        return [body]
    units, out = [], []
    for p in re.split(r"\n\s*\n", body):
        if len(p) > most:
            units += [("sentence", s, k == 0) for k, s in enumerate(re.split(r"(?<=[.!?。！？])\s+", p))]
        else:
            units.append(("paragraph", p, False))
    for kind, piece, fresh in units:
        join = " " if kind == "sentence" else "\n\n"
        if out and not fresh and len(out[-1]) + len(join) + len(piece) <= most and out[-1]:
            out[-1] += join + piece
        else:
            out.append(piece)
    return [x for x in out if x]


def test_packing_text(spark):
    rng = random.Random(2)
    bodies = ["".join(rng.choice(["word ", "long" * 9 + " ", "end. ", "stop! ", "\n\n", "\n \n"]) for _ in range(rng.randint(1, 60))).strip() for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate([*bodies, "x" * 700, "", None])), "id long, body string")
    got = {r.id: r.parts for r in frame.select("id", chunking.split_text("body", 60).alias("parts")).collect()}
    for k, body in enumerate(bodies):
        assert got[k] == [x for x in brute_pack(body, 60) if x], body
    assert got[400] == ["x" * 700] and got[401] == got[402] == []


def chunks_of(spark, body, **options):
    docs = spark.createDataFrame([(1, "d", body)], "user_id long, document_id string, content string")
    return chunking.chunk_documents(docs, **options).orderBy("ordinal").collect()


def test_chunk_hierarchy(spark):
    rows = chunks_of(spark, "intro\n# A\na\n### B\nb\n## C\nc\n  # D  \n```\n# E\n```")
    assert [(list(r.path), r.level) for r in rows] == [(["Introduction"], 0), (["A"], 1), (["A", "B"], 3), (["A", "C"], 2), (["D"], 1), (["E"], 1)]
    assert [r.parent_id for r in rows] == [None, None, rows[1].chunk_id, rows[1].chunk_id, None, None]
    assert [r.prev_chunk_id for r in rows] == [None, *[r.chunk_id for r in rows[:-1]]]
    assert [r.next_chunk_id for r in rows] == [*[r.chunk_id for r in rows[1:]], None]
    assert sorted(r.chunk_id for r in rows) == [r.chunk_id for r in rows]


def test_chunk_parts_and_overlap(spark):
    sentences = [f"Sentence number {i} has some words in it." for i in range(40)]
    rows = chunks_of(spark, "# T\n" + " ".join(sentences) + "\n## S\nshort")
    parts = [r for r in rows if r.path[0] == "T" and "S" not in r.path]
    plain = chunks_of(spark, "# T\n" + " ".join(sentences) + "\n## S\nshort", overlap=0)
    assert len(parts) > 2 and list(parts[1].path) == ["T", "[Part 2]"] and parts[1].parent_id == parts[0].chunk_id and parts[2].parent_id == parts[1].chunk_id
    assert parts[1].content == plain[0].content[-50:] + plain[1].content
    assert rows[-1].parent_id == parts[-1].chunk_id
    assert " ".join(r.content for r in plain[:-1]) == "# T\n" + " ".join(sentences)


def test_texts_without_headings(spark):
    assert chunks_of(spark, " \n ") == []
    rows = chunks_of(spark, "one. " * 300)
    assert len(rows) > 1 and all(list(r.path) == ["Document"] and r.level == 0 for r in rows) and rows[0].chunk_id.endswith("_000000")


def test_markdown_cleaning(spark):
    docs = spark.createDataFrame([("a\n\n\n\nb\r\n\r\n\r\nc\n# Title \n", "f.md"), ("no title", "g.md")], "content string, original_filename string")
    rows = tables.clean_markdown(docs).collect()
    assert (rows[0].content, rows[0].title) == ("a\n\nb\n\n\nc\n# Title", "Title") and rows[1].title == "g.md"


def test_files(spark, tmp_path):
    for name, body in {"a.MD": b"# hi\xff", "b.pdf": b"..%PDF-1.4", "c.pdf": b"nope", "d.exe": b"x", "e.txt": b" \n", "f.docx": b"PK\x03\x04zz", "g.doc": b"zz", "h.txt": b"y" * 99}.items():
        (tmp_path / name).write_bytes(body)
    good, bad = tables.read_files(spark, str(tmp_path), max_bytes=50)
    name = lambda r: r.path.rsplit("/", 1)[1]
    assert {name(r): r.text for r in good.collect()} == {"a.MD": "# hi", "b.pdf": None, "f.docx": None}
    assert {name(r): r.reason for r in bad.collect()} == {"c.pdf": "content", "d.exe": "extension", "e.txt": "blank", "g.doc": "content", "h.txt": "size"}


def test_gold_cases(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "a", "query": "q", "expected_chunk_ids": ["c1"], "_comment": ["two", "lines"], "difficulty": "easy"}')
    (tmp_path / "b.json").write_text('{"id": "b", "query": "q", "expected_chunk_ids": ["REPLACE_WITH_ID"], "_comment": "one"}')
    cases, skipped = tables.read_gold(spark, str(tmp_path))
    r = cases.first()
    assert (r.id, r.expected_keywords, r.metadata["_comment"]) == ("a", [], "two lines") and [x.id for x in skipped.collect()] == ["b"]


def test_extraction_answers(spark):
    full = '{"entities":[{"name":"A","type":"X"},{"name":" "},{"type":"Y"}],"relations":[{"source":"A","target":"B","relation_type":"is part of"},{"source":"A","target":"C","relation_type":"betrays"},{"source":"","target":"C"}]}'
    rows = spark.createDataFrame([(0, "x " + full + " y"), (1, 'so [{"name":"Z"}] ok'), (2, "{broken"), (3, None), (4, "")], "i int, response string")
    got = {r.i: r for r in extract.parse_extraction(rows).collect()}
    assert [e.name for e in got[0].entities] == ["A"] and [r.relation_type for r in got[0].relations] == ["PART_OF", "RELATED_TO"]
    assert [e.name for e in got[1].entities] == ["Z"] and all(got[i].entities == [] and got[i].relations == [] for i in (2, 3, 4))


def test_rule_entities(spark):
    body = "张三先生 met John Smith of 北京大学 in 北京 and Paris, France on 2024年5月1日, Google Maps since 1999-05, May 5, 2020"
    rows = extract.rule_entities(spark.createDataFrame([(1, "c", body)], "user_id long, chunk_id string, content string")).collect()
    kinds = {r.name: r.type for r in rows}
    assert kinds["John Smith"] == "PERSON" and kinds["France"] == "LOCATION" and kinds["2024年5月1日"] == "TIME" and kinds["May 5, 2020"] == "TIME"
    assert len(rows) == len(kinds)


def test_judgements(spark):
    rows = spark.createDataFrame([('{"claims":[{"supported":true},{"supported":false},{"supported":true}],"answer_relevance":2,"citation_accuracy":-1}',), ("none",)], "a string")
    first, second = [r.j for r in rows.select(extract.parse_judgement(F.col("a"), F.lit(0.25)).alias("j")).collect()]
    assert (round(first.faithfulness, 4), first.hallucination, first.answer_relevance, first.citation_accuracy, first.correctness) == (0.6667, 0.3333, 1.0, 0.0, 0.25)
    assert (second.faithfulness, second.hallucination) == (0.0, 1.0)


def test_metrics(spark):
    runs = spark.createDataFrame([("m", i + 1, c) for i, c in enumerate("abxy")] + [("r", 1, "z"), ("r", 2, "a")], "case_id string, rank long, chunk_id string")
    gold = spark.createDataFrame([("m", c) for c in "abc"] + [("r", "a"), ("n", "q")], "case_id string, chunk_id string")
    got = {(r.case_id, r.metric): r.value for r in evaluation.retrieval_metrics(runs, gold, (1, 4)).collect()}
    assert got["m", "precision@4"] == 0.5 and got["m", "recall@4"] == 0.666667 and got["r", "mrr"] == 0.5 and got["n", "hit@4"] == 0.0
    assert got["m", "hit@1"] == 1.0 and got["m", "ndcg@4"] == pytest.approx(0.765361)


def test_keyword_coverage(spark):
    rows = spark.createDataFrame([("Paris is the capital", ["paris", "France"]), ("x", [" ", ""]), (None, ["a"])], "a string, k array<string>")
    assert [r.x for r in rows.select(evaluation.keyword_coverage(F.col("a"), F.col("k")).alias("x")).collect()] == [0.5, 0.0, 0.0]


def test_summary_slices(spark):
    metrics = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 0.0), ("b", "k", 0.5)], "case_id string, metric string, value double")
    cases = spark.createDataFrame([("a", "easy"), ("b", "hard")], "id string, difficulty string")
    assert {(r.metric, r.mean, r.n) for r in evaluation.summary(metrics).collect()} == {("m", 0.5, 2), ("k", 0.5, 1)}
    assert ("m", None, 0.5, 2) in {tuple(r) for r in evaluation.summary(metrics, cases, "difficulty").select("metric", "difficulty", "mean", "n").collect()}


def test_status_steps():
    moves = {("pending", "indexed"): "applied", ("graphed", "document_created"): "no-op", ("ready", "failed"): "rejected", ("failed", "failed"): "no-op", ("failed", "pending"): "applied", ("failed", "ready"): "rejected", ("indexed", "failed"): "applied", ("ready", "pending"): "rejected", ("indexed", "indexed"): "no-op"}
    assert {k: lifecycle.step(k[0], None, k[1], "e")[2] for k in moves} == moves
    assert lifecycle.fold([("indexed", None), ("failed", "x"), ("ready", None), ("pending", None), ("graphed", None)]) == ("graphed", None, 4, 1)


def test_admission():
    flags, live = lifecycle.admit([0, 1, 2, 10, 10.5, 11], [], 2, 10)
    # the hit at 0 is 10 seconds old at 10 and gone; denied hits don't count
    assert flags == [(True, 0), (True, 0), (False, 9), (True, 0), (False, 1), (True, 0)] and live == [10, 11]


def test_vocabulary_is_whole():
    assert len(vocab.RELATION_TYPES) == 12 and len(vocab.RELATION_SYNONYMS) == 43 and set(vocab.RELATION_SYNONYMS.values()) <= set(vocab.RELATION_TYPES)
