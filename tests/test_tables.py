"""Table reconstruction against the documented cases and against plain loops."""

import difflib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from doctables.functions import fixed
from doctables.functions.similarity import ratio
from doctables.model import RAW_ROWS
from doctables.operators import layout, stitch, tables
from doctables.plans import scan
from doctables.plans.scan import number_rows, row_block, running

SCHEMA = "doc_id string, page int, table_index int, row_idx long, headers array<string>, cells array<string>"


def raw(spark, parts):
    """parts: (page, headers, rows) of document d."""
    rows = [
        ("d", page, 0, i, headers, cells)
        for page, headers, lines in parts
        for i, cells in enumerate(lines)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_repeated_header_is_dropped(spark):
    head = ["SAQA ID", "Qualification", "NQF"]
    rows = raw(
        spark,
        [
            (1, head, [["118792", "AI Developer", "5"], ["118793", "Cloud Engineer", "6"]]),
            (2, [], [head, ["102145", "Solar Technician", "5"]]),
        ],
    )
    out = stitch.stitch_tables(rows).orderBy("page", "row_idx").collect()
    assert [r["cells"][0] for r in out] == ["118792", "118793", "102145"]
    assert {(r["master_page"], r["master_index"]) for r in out} == {(1, 0)}


def test_wrapped_row_is_merged(spark):
    rows = raw(
        spark,
        [
            (
                1,
                ["SAQA ID", "Qualification", "NQF"],
                [["118792", "Occupational Certificate: Artificial", "5"], ["", "Intelligence Software Developer", ""]],
            )
        ],
    )
    out = stitch.stitch_tables(rows).collect()
    assert len(out) == 1
    assert out[0]["cells"][1] == "Occupational Certificate: Artificial Intelligence Software Developer"


def test_headerless_part_and_new_table(spark):
    rows = raw(
        spark,
        [
            (1, ["a", "b"], [["1", "x"]]),
            (2, [], [["2", "y"], ["", "z"]]),
            (3, ["quite", "other", "header"], [["3", "4", "5"]]),
            (4, [], [["6", "7"]]),
        ],
    )
    out = stitch.stitch_tables(rows).orderBy("page", "row_idx").collect()
    assert [(r["master_page"], r["cells"]) for r in out] == [
        (1, ["1", "x"]),
        (1, ["2", "y z"]),
        (3, ["3", "4", "5"]),
        (4, ["6", "7"]),
    ]


def fold_masters(heads):
    """Plain loop over the tables of one document."""
    master, out = None, []
    for page, headers, row, columns in heads:
        repeated = joined = False
        if master is not None:
            repeated = ratio(master[1], row) > 0.80
            joined = ratio(master[1], headers) > 0.75 or (columns == master[2] and not headers) or repeated
        if not joined:
            master = (page, headers, columns)
        out.append((page, master[0], repeated))
    return out


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_masters_do_not_depend_on_blocks(spark, block):
    pick = random.Random(block)
    families = [["Code", "Title", "Level"], ["Code", "Title", "Levels"], ["Zone", "Yield", "Box"], []]
    heads, rows = {}, []
    for doc in ("a", "b", "c"):
        heads[doc] = []
        for page in range(1, 25):
            headers = pick.choice(families)
            first = pick.choice([["1", "2", "3"], ["1", "2"], pick.choice(families[:3])])
            columns = len(headers) or len(first)
            heads[doc].append((page, headers, first, columns))
            rows.append((doc, page, 0, 0, headers, first))
    found = stitch.assign_masters(
        stitch.table_heads(spark.createDataFrame(rows, SCHEMA)), block_pages=block
    ).collect()
    got = {(r["doc_id"], r["page"]): (r["master_page"], r["drop_first"]) for r in found}
    for doc, listed in heads.items():
        for page, master, repeated in fold_masters(listed):
            assert got[(doc, page)] == (master, repeated)


def test_header_pairs_are_compared_once_over_all_blocks(spark, monkeypatch):
    made = []
    monkeypatch.setattr(stitch, "SequenceMatcher", lambda *a: made.append(a) or difflib.SequenceMatcher(*a))
    head, line = '["Code","Title"]', '["1","x"]'
    tables = [("d", block, block, 0, head, line, 2, None, None, None, None) for block in range(50) for _ in range(2)]
    folded = list(stitch._folded([pd.DataFrame(tables, columns=stitch._FOLD_COLUMNS)]))
    assert len(folded[0]) == 100 and len(made) == 2


def test_empty_cells_in_a_first_row(spark):
    rows = raw(spark, [(1, ["a", "b"], [["1", "x"]]), (2, [], [[None, "y"]])])
    assert {r["master_page"] for r in stitch.assign_masters(stitch.table_heads(rows)).collect()} == {1}


@pytest.mark.parametrize("block", [4, 2_000])
def test_only_records_at_the_ends_of_pages_are_numbered_by_table(spark, monkeypatch, block):
    pick = random.Random(block)
    families = [["Code", "Title", "Level"], ["Zone", "Yield", "Box", "W"], []]
    lines = []
    for doc in ("a", "b", "c", "d"):
        for page in range(1, 31):
            headers, step = pick.choice(families), pick.choice([1, 1, 1, 40_000])
            cells = [pick.choice([["Code", "Title", "Level"], ["k", "x", "y"]])]
            for _ in range(pick.randint(0, 8)):
                kind = pick.choice(["row", "row", "row", "more", "noise", "null"])
                cells.append(
                    {"row": ["k", str(page), "v", "w"], "more": ["", "m", str(page)], "noise": ["Page 3", " of 9"], "null": [None, "n"]}[kind]
                    [: pick.randint(2, 4)]
                )
            at = pick.sample(range(len(cells)), len(cells)) if page % 4 == 0 else range(len(cells))
            lines += [(doc, page, 0, step * i, headers, cells[j]) for i, j in enumerate(at)]
    rows = spark.createDataFrame(lines, SCHEMA)
    numbered = []
    whole = tables.merge_marked
    monkeypatch.setattr(stitch, "merge_marked", lambda kept, *a: numbered.append(kept.count()) or whole(kept, *a))
    names = ["doc_id", "master_page", "page", "row_idx", "cells", "headers"]
    got = sorted(map(str, stitch.stitch_tables(rows, block).select(*names).collect()))
    masters = stitch.assign_masters(stitch.table_heads(rows), block)
    first = rows.groupBy("doc_id", "page").agg(F.min("row_idx").alias("first"))
    kept = rows.drop("headers").join(masters, ["doc_id", "page", "table_index"]).join(first, ["doc_id", "page"])
    heads = rows.groupBy("doc_id", F.col("page").alias("master_page")).agg(F.first("headers").alias("headers"))
    want = tables.heal_rows(
        kept.filter("not (drop_first and row_idx = first)").join(heads, ["doc_id", "master_page"]),
        F.col("columns"), ["doc_id", "master_page", "master_index"], ["page", "table_index", "row_idx"],
        [F.col("page"), row_block("row_idx")],
    )
    assert got == sorted(map(str, want.select(*names).collect()))
    assert 0 < numbered[0] < 0.8 * len(lines)


def test_pages_without_wrapped_rows_are_not_numbered_by_table(spark, monkeypatch):
    head = ["Code", "Title"]
    rows = raw(spark, [(page, head, [["k", str(page)]] * 3) for page in range(1, 40)])
    numbered = []
    whole = tables.merge_marked
    monkeypatch.setattr(stitch, "merge_marked", lambda kept, *a: numbered.append(kept.count()) or whole(kept, *a))
    assert stitch.stitch_tables(rows).count() == 117
    assert numbered == [1]  # the last record, behind which no page is looked at


def heal_loop(rows, width):
    out = []
    for r in rows:
        joined = " ".join(r).lower().strip()
        if not joined or joined.startswith("source:"):
            continue
        if out and len(r) > 1 and not r[0].strip() and any(r[1:]):
            for c in range(1, min(len(r), len(out[-1]))):
                if r[c].strip():
                    out[-1][c] = f"{out[-1][c]} {r[c]}".strip()
        else:
            out.append((list(r) + [""] * width)[:width])
    return out


@pytest.mark.parametrize("rows_per_block", [1, 4, 100_000])
def test_heal_rows_equals_loop(spark, rows_per_block):
    pick = random.Random(7)
    lines = [
        [pick.choice(["", "", "k"]), *[pick.choice(["", "x", "y z"]) for _ in range(pick.randint(0, 4))]]
        for _ in range(200)
    ] + [["Source: list"], ["", ""]]
    rows = raw(spark, [(1, ["a", "b", "c"], lines)])
    healed = tables.heal_rows(rows, F.lit(3), block=[row_block("row_idx", rows_per_block)])
    got = [r["cells"] for r in healed.orderBy("row_idx").collect()]
    assert got == heal_loop(lines, 3)


def test_noise_rows(spark):
    lines = [["Page 3 of 9"], ["3 / 9"], ["page 4"], ["Source: DHET", ""], ["Continued on next page"], [" "], ["Pages"]]
    rows = raw(spark, [(1, [], lines)])
    assert rows.filter(~tables.is_noise(F.col("cells"))).count() == 1


def test_fill_forward(spark):
    lines = [
        ["Variable", "Label", "Value", "Meaning"],
        ["", "", "0", "none"],
        ["Q11", "Sex", "1", "Male"],
        ["2", "Female"],
        ["", "", "9", "Other", "numeric", "note"],
        ["Q12", "", "1", "Yes"],
    ]
    out = tables.codebook_rows(raw(spark, [(1, [], lines)])).orderBy("row_idx").collect()
    shown = [(r["variable_name"], r["variable_label"], r["value"], r["value_label"], r["data_type"]) for r in out]
    assert shown == [
        ("", "", "0", "none", "categorical"),
        ("Q11", "Sex", "1", "Male", "categorical"),
        ("Q11", "Sex", "2", "Female", "categorical"),
        ("Q11", "Sex", "9", "Other", "numeric"),
        ("Q12", "Sex", "1", "Yes", "categorical"),
    ]


def test_qualification_rows(spark):
    lines = [
        ["Occupational list", "", "", "", "", ""],
        ["SAQA ID", "Qualification Title", "NQF Level", "Sub-Framework", "NSFAS", "Participating Colleges"],
        ["118792", "Developer", "5", "OQSF", "Yes", "Motheo TVET\nUmfolozi TVET"],
        ["", "part two", "", "", "", "Orbit"],
        ["SAQA ID", "Qualification Title", "", "", "", ""],
        ["12", "also part", "", "", "", ""],
        ["102145", "Solar", "4"],
    ]
    out = tables.qualification_rows(raw(spark, [(1, [], lines)])).orderBy("row_idx").collect()
    assert [(r["saqa_id"], r["qualification"], r["nsfas_eligible"]) for r in out] == [
        ("118792", "Developer part two also part", "Yes"),
        ("102145", "Solar", "No"),
    ]
    assert out[0]["participating_colleges"] == "Motheo TVET; Umfolozi TVET; Orbit"


def test_occupation_rows_by_position(spark):
    lines = [["2512", "Developer", "1"], ["", "of software", ""], ["x", "dropped", ""], ["2513", "Tester", "2", "Group"]]
    out = tables.occupation_rows(raw(spark, [(1, [], lines)])).orderBy("row_idx").collect()
    assert [(r["ofo_code"], r["occupation_title"], r["major_group"], r["province"]) for r in out] == [
        ("2512", "Developer of software", "", "National"),
        ("2513", "Tester", "Group", "National"),
    ]


def test_headers_are_used_once(spark):
    heads = [["Occupation Code", "Occupation Title", "Title", "Province"], ["x"], []]
    df = spark.createDataFrame([(h,) for h in heads], "h array<string>")
    places = df.select(tables.match_headers(F.col("h"), fixed.OCCUPATION_ALIASES).alias("p")).collect()
    assert places[0]["p"] == [0, 1, -1, -1, 3, -1]
    assert places[1]["p"] == [-1] * 6 and places[2]["p"] == [-1] * 6


def test_text_layout(spark):
    words = []
    table = [["Code", "Name", "Level"], ["1", "two words", "5"], ["2", "x"], ["3", "y", "6", "extra"], ["alone"]]
    for line, cells in enumerate(table):
        for column, cell in enumerate(cells):
            for n, word in enumerate(cell.split()):
                x = 100.0 * column + 25 * n
                words.append(("d", 1, len(words), x, x + 20, 12.0 * line + 1, word))
    df = spark.createDataFrame(words, "doc_id string, page int, word_no int, x0 double, x1 double, y0 double, word string")
    out = layout.text_tables(df).orderBy("row_idx").collect()
    assert [r["cells"] for r in out] == [["1", "two words", "5"], ["2", "x", ""], ["3", "y", "6"]]
    assert out[0]["headers"] == ["Code", "Name", "Level"]


def test_quality_and_strategy(spark):
    good = [("d", 1, 0, i, ["a", "b"], ["aa", "bb"], "pdf_text") for i in range(4)]
    poor = [("d", 1, 0, i, ["a", "b"], ["", "b"], "pdf_tables") for i in range(4)]
    rows = spark.createDataFrame(good + poor, SCHEMA + ", method string")
    scores = {r["method"]: r["quality"] for r in tables.extraction_quality(rows).collect()}
    assert scores == {"pdf_text": 1.0, "pdf_tables": 0.54}
    ranked = spark.createDataFrame(
        [("d", "pdf_tables", 0.5), ("d", "pdf_pymupdf", 0.66), ("d", "pdf_text", 0.9), ("e", "pdf_tables", 0.4), ("e", "pdf_text", 0.4)],
        "doc_id string, strategy string, quality double",
    )
    best = {r["doc_id"]: r["strategy"] for r in tables.best_strategy(ranked, F.lit("pdf_tables")).collect()}
    assert best == {"d": "pdf_pymupdf", "e": "pdf_tables"}


def test_raw_dump(spark, tmp_path):
    import json

    from doctables.sources.files import read_raw_dump, read_raw_rows
    from doctables.sources.sinks import save_raw_rows

    dump = {"document_id": "d1", "tables": [{"page_number": 2, "table_index": 1, "headers": ["a"], "rows": [["x"], ["y"]], "extraction_method": "m", "confidence": 0.5}]}
    (tmp_path / "one.json").write_text(json.dumps(dump, indent=2))
    rows = read_raw_dump(spark, str(tmp_path / "one.json"))
    assert [(r["doc_id"], r["page"], r["row_idx"], r["cells"]) for r in rows.orderBy("row_idx").collect()] == [("d1", 2, 0, ["x"]), ("d1", 2, 1, ["y"])]
    save_raw_rows(rows, str(tmp_path / "rows"))
    assert read_raw_rows(spark, str(tmp_path / "rows"), RAW_ROWS).count() == 2


@pytest.mark.parametrize("block", [1, 3, 50])
def test_running_equals_loop(spark, block):
    pick = random.Random(block)
    values = [(g, i, pick.choice([None, 1, 2])) for g in "ab" for i in range(60)]
    df = spark.createDataFrame(values, "g string, i int, v int")
    out = running(
        df, ["g"], ["i"], [row_block("i", block)],
        sums={"s": F.coalesce("v", F.lit(0))}, lasts={"l": F.col("v")},
        coarse=[[row_block("i", block * 4)]],
    )
    got = {(r["g"], r["i"]): (r["s"], r["l"]) for r in out.collect()}
    for g in "ab":
        total, last = 0, None
        for _, i, v in [x for x in values if x[0] == g]:
            total, last = total + (v or 0), v if v is not None else last
            assert got[(g, i)] == (total, last)


def test_number_rows(spark):
    df = spark.range(0, 1000, 7)
    got = number_rows(df, "id", "n", block_rows=10).orderBy("id").collect()
    assert [r["n"] for r in got] == list(range(1, len(got) + 1))
    assert scan.BLOCK_ROWS > 0


def test_readers(spark):
    from doctables.operators import readers

    rows = spark.createDataFrame(
        [("d", 1, 0, i, c) for i, c in enumerate([["Code", "Name"], ["1", "a\nb"], ["", None], ["2", "c"]])]
        + [("e", 1, 0, 0, ["alone", "row"])],
        "doc_id string, page int, table_index int, row_idx long, cells array<string>",
    )
    generic = readers.get_reader("unknown")(rows)
    assert [r["cells"] for r in generic.orderBy("row_idx").collect()] == [["1", "a b"], ["2", "c"]]
    strict = readers.get_reader("pdf_pymupdf")(rows).orderBy("row_idx").collect()
    assert [(r["cells"], r["confidence"]) for r in strict] == [(["1", "a\nb"], 0.92), (["2", "c"], 0.92)]
    readers.register_reader("mine", lambda df: df.limit(0))
    assert readers.get_reader("mine")(rows).count() == 0
    sparse = generic.withColumn("cells", F.transform("cells", lambda c: F.substring(c, 1, 0)))
    best = readers.read_best({"pdf_tables": sparse.withColumn("cells", F.array(F.lit("x"), F.lit(""))), "pdf_text": generic}, F.lit("pdf_tables"), enough=0.9)
    assert {(r["doc_id"], r["strategy"]) for r in best.collect()} == {("d", "pdf_text")}
    listed = raw(spark, [(1, [], [HEADER, ["118792", "Dev", "5", "OQSF", "Yes", "Orbit TVET\nCollege"], ["", "", "", "", "", "College"]])])
    whole = tables.qualification_rows(listed, wrapped_names=True).first()
    assert whole["participating_colleges"] == "Orbit TVET College College"
    assert readers.get_reader("qualifications")(listed).first()["headers"][0] == "saqa_id"


HEADER = ["SAQA ID", "Qualification Title", "NQF Level", "Sub-Framework", "NSFAS", "Participating Colleges"]


def test_rows_of_blank_cells_have_no_text(spark):
    blanks = ["", " ", "\t\x1c 　", None, "\x85\xa0"]
    rows = [(0, blanks), (1, ["", "​"]), (2, [None]), (3, []), (4, None), (5, blanks + ["x"])]
    frame = spark.createDataFrame(rows, "n int, cells array<string>")
    assert [r["n"] for r in frame.filter(tables.has_text(F.col("cells"))).orderBy("n").collect()] == [1, 5]


def test_header_needs_words_of_two_fields(spark):
    aliases = {"code": ("code", "id"), "title": ("title",), "site": ("campus",)}
    lines = [["Campus A", "Campus B"], ["Kode", "x"], ["Site campus", "ID"], ["code", "title"]]
    found = tables.find_header_rows(raw(spark, [(1, [], lines), (2, [], lines[:2])]), aliases, within=3).collect()
    assert [(r["page"], r["header_row"], list(r["places"])) for r in found] == [(1, 2, [1, -1, 0])]
