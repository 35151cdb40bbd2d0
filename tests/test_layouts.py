"""Runs over several layouts at once, and searches for many words."""

import random

import pytest
from pyspark.sql import functions as F

from doctables.functions import matching
from doctables.operators import documents, rules
from doctables.operators.schema import Field
from doctables.plans import layouts, workflow
from doctables.sources.profiles import Profile

ROWS = "doc_id string, page int, table_index int, row_idx long, dataset string, profile string, headers array<string>, cells array<string>"
PACK = Profile(
    name="courses",
    fields=(
        Field("course_id", required=True, pattern=r"^C\d+$", aliases=("Course No",)),
        Field("level", "INTEGER", min_value=1, max_value=6, aliases=("Lvl",)),
        Field("kind", allowed_values=("a", "b")),
    ),
    datasets=(("courses", ("course_id",)), ("course_colleges", ())),
)


def rows_of(spark, tables):
    rows = []
    for t, (dataset, profile, headers, cells) in enumerate(tables):
        rows += [("d", 1, t, i, dataset, profile, headers, list(c)) for i, c in enumerate(cells)]
    return spark.createDataFrame(rows, ROWS)


COURSES = [("C1", "3", "a", "x; y"), ("C2", "9", "c", "x;x ; z"), ("C1", "4", "b", "late"), ("7", "n/a", "a", ""), ("", "two", "", "w;v"), ("C3", "1", "a", "q, r")]


def test_pack_gives_names_rules_and_child(spark):
    runs = layouts.run_all(rows_of(spark, [("courses", "courses", ["Course No", "Lvl", "Kind", "colleges"], COURSES)]), [PACK])
    assert {(r.dataset, r.field, r.data_type, r.is_primary_key) for r in runs.fields.collect()} == {
        ("courses", "course_id", "STRING", True), ("courses", "level", "INTEGER", False), ("courses", "kind", "STRING", False),
        ("course_colleges", "course_id", "STRING", False), ("course_colleges", "college_name", "STRING", False),
    }
    assert {(r.record_id.row_idx, r.rule_id, r.severity, r.suggested_fix) for r in runs.issues.filter("dataset = 'courses'").collect()} == {
        (1, "range_level", "CRITICAL", None), (1, "allowed_kind", "CRITICAL", None), (3, "regex_course_id", "CRITICAL", None),
        (4, "req_course_id", "CRITICAL", None), (4, "range_level", "WARNING", None),
    }
    children = {(r.key, r.item) for r in runs.children.collect()}
    assert children == {("C1", "x"), ("C1", "y"), ("C2", "x"), ("C2", "z"), (None, "w"), (None, "v"), ("C3", "q"), ("C3", "r")}
    assert [tuple(r) for r in runs.relationships.collect()] == [("courses_to_course_colleges", "courses", "course_colleges", "course_id", "course_id", True)]
    assert runs.summary.filter("dataset is null").first().total_issues == 7


def test_same_as_the_run_of_one_layout(spark):
    headers = ["OFO Code", "NQF Level", "Title"]
    cells = [(str(1000 + k % 40), str(k % 12), "t" * (k % 5)) for k in range(100)]
    rows = rows_of(spark, [("jobs", None, headers, cells)])
    one = workflow.run(rows.withColumn("row_index", F.col("row_idx")).drop("dataset", "profile"), "jobs", headers=headers)
    runs = layouts.run_all(rows)
    assert {(f.name, f.data_type, f.required, f.is_primary_key) for f in one.fields} == {
        (r.field, r.data_type, r.required, r.is_primary_key) for r in runs.fields.collect()
    }
    issue = ("field", "severity", "rule_id", "rule_name", "message", "current_value", "suggested_fix", "is_auto_fixable")
    assert sorted(map(str, one.issues.select(*issue).collect())) == sorted(map(str, runs.issues.select(*issue).collect()))
    assert tuple(one.quality.first()) == tuple(runs.quality.drop("dataset").first())


def test_layouts_of_one_dataset_are_united(spark):
    runs = layouts.run_all(rows_of(spark, [("d", None, ["A", "A", ""], [("1", "2", "3"), ("1", "2", "3")]), ("d", None, ["B"], [("4", "extra"), ()]), ("e", None, [], [("5",)]), ("f", None, None, [()])]))
    cells = {(r.dataset, r.record.table_index, r.record.row_idx, r.field, r.norm) for r in runs.cells.collect()}
    assert cells == {("d", 0, 0, "a", "1"), ("d", 0, 0, "a_2", "2"), ("d", 0, 0, "column_3", "3"), ("d", 1, 0, "b", "4"), ("d", 1, 1, "b", None), ("e", 2, 0, "col_1", "5")}
    assert runs.children.isEmpty() and runs.relationships.isEmpty()


def test_no_rows(spark):
    runs = layouts.run_all(spark.createDataFrame([], ROWS), [PACK])
    assert runs.fields.isEmpty() and runs.cells.isEmpty() and runs.issues.isEmpty() and runs.quality.isEmpty()


def test_names_come_from_documents(spark):
    rows = rows_of(spark, [(None, None, ["A"], [("1",)])]).drop("dataset", "profile")
    docs = spark.createDataFrame([("d", "List.PDF", "codebook", None, None)], "doc_id string, filename string, recommended_extractor string, profile string, profile_dataset string")
    assert layouts.named(rows, docs).first().dataset == "qlfs_codebook"
    assert layouts.named(rows, docs.withColumn("recommended_extractor", F.lit(None).cast("string"))).first().dataset == "list_table"


def test_records_of_one_small_file_are_spread(spark):
    place = [F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("table_index"), F.col("id").alias("row_idx")]
    rows = spark.range(0, 4000, 1, 1).select(
        *place, F.lit("one").alias("dataset"), F.lit(None).cast("string").alias("profile"), F.array(F.lit("A"), F.lit("B")).alias("headers"),
        F.array(F.col("id").cast("string"), F.lit("x")).alias("cells"),
    )
    aliases = layouts.packs(spark, [PACK])[1]
    cells = layouts.long_cells(rows, layouts.layout_fields(rows, aliases))
    held = cells.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record").alias("records")).collect()
    assert sum(h["n"] for h in held) == 8000 and sum(h["records"] for h in held) == 4000
    assert max(h["n"] for h in held) < 2 * 8000 / int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("part_values", [10_000, 7])
def test_absent_values(spark, part_values):
    pick = random.Random(1)
    text = {p: "".join(pick.choice("abÄ c") for _ in range(200)) for p in range(3)}
    cells = [(1, p, k, "f", "".join(pick.choice("aBä c") for _ in range(pick.randrange(5)))) for p in [0, 1, 2, 9, None] for k in range(60)] + [(1, 0, 99, "f", None)]
    got = rules.absent_from_page(
        spark.createDataFrame(cells, "doc_id int, page int, record_id int, field string, value string"),
        spark.createDataFrame([(1, p, t) for p, t in text.items()] + [(1, 9, None)], "doc_id int, page int, text string"), part_values,
    ).collect()
    want = [c for c in cells if c[4] and c[4].strip() and (c[1] not in text or c[4].lower() not in text[c[1]].lower())]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_words_found_in_one_pass(spark):
    words = ["he", "she", "hers", "", "Hat", "nothing"]
    pages = spark.createDataFrame([(1, "uSHErs"), (1, "hat"), (2, None), (3, "zzz")], "doc_id int, text string")
    got = {r.doc_id: r.sample_text for r in documents.found_words(pages, words).collect()}
    assert got == {1: "he\nshe\nhers\n\nhat", 2: "", 3: ""}
    assert matching.places_in(("a", "a", "b"), "xa") == {0, 1}
    assert matching.places_in((), "xa") == matching.places_in(("a",), None) == set()
