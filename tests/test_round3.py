"""Findings of round 3: words moved once, sorts and passes saved, with the same rows."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from doctables.operators import chunks, documents, layout, rules, tables
from doctables.plans.scan import row_block, running
from doctables.sources.profiles import Profile


def _plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.sub(r"#\d+L?", "", plan.split("== Initial Plan ==")[0])


def test_absent_words_move_once(spark):
    """cells and texts meet in one shuffle; a page given twice lacks what one of its texts lacks."""
    cells = spark.createDataFrame(
        [(1, 1, "a", "Xy"), (1, 1, "b", "q"), (1, 1, "b", "q"), (2, 1, "a", "xy"), (3, 1, "a", "é"), (None, 1, "a", "xy")],
        "doc_id int, page int, field string, value string",
    )
    pages = spark.createDataFrame(
        [(1, 1, "axyb"), (2, 1, "xy"), (2, 1, "no"), (3, 1, None), (3, 1, "É"), (None, 1, "xy"), (9, 1, "z")],
        "doc_id int, page int, text string",
    )
    out = rules.absent_from_page(cells, pages)
    plan = _plan(out)
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    want = [(1, 1, "b", "q"), (1, 1, "b", "q"), (2, 1, "a", "xy"), (3, 1, "a", "é"), (None, 1, "a", "xy")]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    split = rules.absent_from_page(cells, pages, part_values=3)
    assert sorted(map(repr, map(tuple, split.collect()))) == sorted(map(repr, want))


def test_words_of_a_page_are_sorted_once(spark):
    """lines are put together once, without a window over words, and read by both steps."""
    rows = [
        (1, 1, 1, 0.0, 30.0, 1.0, "a"), (1, 1, 2, 100.0, 130.0, 1.0, "b"), (1, 1, 3, 135.0, 150.0, 2.0, "c"),
        (1, 1, 4, 0.0, None, 20.0, "d"), (1, 1, 5, 90.0, 99.0, 20.0, "e"), (1, 1, 6, 200.0, 230.0, 20.0, None),
        (1, 1, 7, 0.0, 0.0, 40.0, "f"), (1, 1, 8, 90.0, 99.0, 40.0, ""), (1, 1, 9, 200.0, 230.0, 40.0, "h"),
        (1, 1, 10, 0.0, 30.0, 60.0, None), (1, 1, 11, 0.0, 30.0, 80.0, "i"), (1, 1, 12, 100.0, 130.0, 80.0, "j"),
    ]
    words = spark.createDataFrame(
        rows, "doc_id int, page int, word_no int, x0 double, x1 double, y0 double, word string"
    )
    lines = layout.text_lines(words)
    assert {r.line_y: r.cells for r in lines.collect()} == {
        0: ["a", "b c"], 20: ["de"], 40: ["f ", "h"], 60: None, 80: ["i", "j"],
    }
    assert "Window" not in _plan(lines)
    tables = layout.text_tables(words)
    assert [(r.row_idx, r.headers, r.cells) for r in tables.orderBy("row_idx").collect()] == [
        (40, ["a", "b c"], ["f ", "h"]), (80, ["a", "b c"], ["i", "j"]),
    ]
    assert "x0" not in _plan(tables)


@pytest.mark.parametrize("last", [9, 60])
def test_few_groups_of_several_blocks(spark, last):
    """only groups of several blocks are summed up; without any, rows are passed once."""
    pick = random.Random(last)
    rows = [(g, i, pick.choice([None, None, "x", "y"])) for g, n in (("a", 9), ("b", last), ("c", 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, v string")
    out = running(
        df, ["g"], ["i"], [row_block("i", 10)], sums={"s": F.col("v").isNotNull().cast("long")}, lasts={"l": F.col("v")}, rare=True
    )
    assert ("Union" in _plan(out)) == (last > 10)
    got = {(r.g, r.i): (r.s, r.l) for r in out.collect()}
    total, kept = {}, {}
    for g, i, v in rows:
        total[g], kept[g] = total.get(g, 0) + (v is not None), v or kept.get(g)
        assert got[(g, i)] == (total[g], kept[g])
    assert len(got) == len(rows)
    cells = df.select(F.col("g").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("table_index"), (F.col("i") + 1).alias("row_idx"), F.array("v", "v", "v", "v").alias("cells"))
    for done in (tables.codebook_rows(cells), tables.heal_rows(cells, F.lit(4))):
        assert "Union" not in _plan(done)


def test_chunk_steps_are_grouped_once(spark):
    """F14, F16: blocks of pages are written once; chunks without texts are the same chunks."""
    pages = spark.createDataFrame([(d, p, f"{d} {p}") for d in (1, 2) for p in range(1, 40)], "doc_id int, page int, text string")
    linked = spark.createDataFrame([(1, p) for p in (5, 9, 10, 22)], "doc_id int, page int")
    placed = chunks.place_pages(pages)
    assert "_pages" not in _plan(chunks.chunk_starts(placed, linked, block=8))
    whole = chunks.create_chunks(pages, linked, block=8)
    bare = chunks.create_chunks(pages, linked, block=8, texts=False)
    assert "text" not in bare.columns
    assert sorted(map(repr, whole.select(*bare.columns).collect())) == sorted(map(repr, bare.collect()))


def test_profiles_read_texts_from_the_arrow_batch(spark):
    """no batch of texts becomes Python objects at once; more rows than one slice give the same profiles."""
    packs = [Profile(name="a", keywords=("alpha", "beta")), Profile(name="b", keywords=("beta", "gamma"))]
    docs = spark.createDataFrame(
        [(i, None if i % 5 == 0 else "beta.pdf", None if i % 3 == 0 else "Gamma beta") for i in range(100)],
        "doc_id int, filename string, sample_text string",
    )
    out = documents.match_profiles(docs, packs)
    kinds = re.findall(r"ArrowEvalPython .*, (\d+)", _plan(out))
    assert kinds and set(kinds) == {str(PythonEvalType.SQL_SCALAR_ARROW_UDF)}
    for r in out.collect():
        a, b = (3 if r.filename else 0) + (2 if r.sample_text else 0), (3 if r.filename else 0) + (4 if r.sample_text else 0)
        assert (r.profile_score, r.profile) == (max(a, b), ("b" if b > a else "a") if max(a, b) >= 4 else None)
