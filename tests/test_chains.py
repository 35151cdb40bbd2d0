"""Chains of states over very long groups."""

import random

import pytest

from doctables.operators import chunks
from doctables.plans.scan import chained


@pytest.mark.parametrize("levels,fan", [(0, 256), (1, 3), (2, 3), (2, 256)])
def test_chained_equals_a_loop(spark, levels, fan):
    pick = random.Random(fan + levels)
    rows, want = [], set()
    for group in "ab":
        at = n = 0
        for place in range(40 if group == "a" else 1):
            table = [(pick.randrange(3), pick.randrange(5)) for _ in range(3)]
            rows.append((group, place, table))
            want.add((group, place, at, n))
            at, n = table[at][0], n + table[at][1]
    pick.shuffle(rows)
    tables = spark.createDataFrame(rows, "g string, place long, table array<struct<at: long, n: long>>")
    assert {tuple(r) for r in chained(tables, ["g"], 3, levels, fan).select("g", "place", "entry", "before").collect()} == want


def test_chunks_of_a_document_of_a_million_pages(spark):
    n, size = 1_000_000, 4
    placed = spark.range(n).selectExpr("1 as doc_id", "id + 1 as page", "id as pos")
    continued = spark.range(n).filter("pmod(xxhash64(id), 5) = 0").selectExpr("1 as doc_id", "id + 1 as page")
    short = {r.page - 1 for r in continued.collect()}
    got = chunks.chunk_starts(placed, continued, size)
    at, want = 0, []
    while at < n:
        want.append(at)
        at += size - 1 if at + size - 1 in short and at + size < n else size
    assert [(r.start, r.chunk_index) for r in got.orderBy("start").collect()] == [(s, i) for i, s in enumerate(want)]


def test_chunks_need_no_python(spark):
    placed = spark.range(10).selectExpr("1 as doc_id", "id + 1 as page", "id as pos")
    plan = chunks.chunk_starts(placed, None)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan
