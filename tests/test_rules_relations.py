"""Validation, schema, decomposition and comparison on the documented cases."""

import pytest
from pyspark.sql import functions as F

from doctables.functions.cells import normalize_frame
from doctables.operators import compare, quality, relational, rules, schema
from doctables.operators.schema import Field
from doctables.sources.rulepacks import shipped_profiles

QUALIFICATIONS = shipped_profiles()[3]


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_validate_three_records(spark):
    df = spark.createDataFrame(
        [("a", "118792", "5"), ("b", None, "5"), ("c", "118793", "15")],
        "record_id string, saqa_id string, nqf_level string",
    )
    checks = rules.default_rules([Field("saqa_id", is_primary_key=True), Field("nqf_level")])
    issues = rules.validate(df, checks)
    summary = rules.summarize(issues).first()
    assert (summary["critical_count"], summary["records_with_issues"]) == (2, 2)
    assert rows_of(issues, "record_id", "rule_id") == [("b", "req_saqa_id"), ("c", "range_nqf_level")]


def test_regex_fix_and_flags(spark):
    df = spark.createDataFrame(
        [(1, "SAQA 118792 "), (2, "x1"), (3, "118792")], "record_id int, saqa_id string"
    )
    issues = rules.validate(df, rules.default_rules([Field("saqa_id")]))
    found = {r["record_id"]: (r["suggested_fix"], r["is_auto_fixable"]) for r in issues.collect()}
    assert found == {1: ("118792", True), 2: (None, False)}
    fixed = rules.apply_fixes(df, issues, ["saqa_id"]).orderBy("record_id").collect()
    assert [(r["saqa_id"], r["fixes"]) for r in fixed] == [("118792", 1), ("x1", 0), ("118792", 0)]
    flags = rules.flag_records(df, issues).orderBy("record_id").collect()
    assert [r["is_flagged"] for r in flags] == [True, True, False]


def test_pack_pattern_replaces_the_default(spark):
    checks = {r.id: r.params for r in rules.default_rules(QUALIFICATIONS.fields)}
    assert checks["regex_saqa_id"]["pattern"] == "^[0-9]{5,7}$"
    assert "saqa_regex_saqa_id" not in checks
    assert checks["range_nqf_level"] == {"min": 1, "max": 10}


def test_range_needs_numbers(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "11"), (3, "7.5"), (4, None), (5, "nan")], "record_id int, nqf string")
    issues = rules.validate(df, [rules.Rule("r", "r", "nqf", "range", params={"min": 1, "max": 10})])
    assert rows_of(issues, "record_id", "severity") == [(1, "WARNING"), (2, "CRITICAL"), (5, "WARNING")]


def test_own_rule_type_and_rule_table(spark):
    rules.register_rule_type(
        "starts", lambda rule, value: F.when(~value.startswith(rule.params["text"]), rules.issue(rule, value, F.lit("no")))
    )
    own = [rules.Rule("s", "s", "v", "starts", "INFO", {"text": "a"})]
    again = rules.rules_from_frame(rules.rules_frame(spark, own))
    df = spark.createDataFrame([(1, "ab"), (2, "b")], "record_id int, v string")
    assert rows_of(rules.validate(df, again), "record_id", "severity") == [(2, "INFO")]


def test_no_rules_no_issues(spark):
    df = spark.createDataFrame([(1, "x")], "record_id int, v string")
    assert rules.validate(df, []).count() == 0
    assert rules.summarize(rules.validate(df, [])).first()["total_issues"] == 0


def test_checks_and_quarantine(spark):
    df = spark.createDataFrame(
        [("1", "YES", "high", "OQSF"), ("2", "Yes", "high", "OQSF"), ("3", "NO", "highest", "OTHER_FW"), (" ", "NO", "low", "HEQSF"), ("5", None, "low", "OQSF")],
        "saqa_id string, nsfas_allowance string, confidence string, nqf_sub_framework string",
    )
    clean, review = rules.split_quarantine(df)
    assert rows_of(clean, "saqa_id") == [("1",)]
    assert sorted(r["issue"] for r in review.collect()) == [
        "chk_confidence", "chk_nqf_sub_framework", "chk_nsfas_allowance", "chk_nsfas_allowance", "pk_saqa_id_required",
    ]


def test_unique_and_referential(spark):
    child = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "z")], "record_id int, k string")
    parent = spark.createDataFrame([("a",), ("a",)], "k string")
    assert rows_of(rules.unique_violations(child, ["k"]), "k", "rows") == [("a", 2)]
    rule = rules.Rule("fk", "fk", "k", "referential")
    assert rows_of(rules.referential_issues(child, parent, {"k": "k"}, rule), "record_id") == [(4,)]
    assert rules.unique_issues(child, rule, ["k"]).count() == 2
    assert rules.cascade_delete(child, parent, {"k": "k"}).count() == 2
    assert rules.restrict_violations(child, parent, {"k": "k"}).count() == 2


def test_quality(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "k string, v string")
    summary = spark.createDataFrame([(1, 1)], "critical_count int, warning_count int")
    q = quality.dataset_quality(df, ["k", "v"], summary).first()
    assert (q["completeness_score"], q["validation_score"], q["overall_score"]) == (75.0, 60.0, 82.5)
    empty = quality.dataset_quality(df.filter("false"), ["k", "v"], summary).first()
    assert (empty["overall_score"], empty["extraction_score"]) == (0.0, 95.0)
    score = lambda n, e, w: spark.range(1).select(quality.penalty_score(F.lit(n), F.lit(e), F.lit(w)).alias("s")).first()["s"]
    assert (score(0, 0, 0), score(10, 1, 2), score(1, 1, 1)) == (100.0, 75.0, 0.0)


@pytest.mark.parametrize(
    "values, expected",
    [
        (["1", "2", "3", "0"], ("INTEGER", 1.0)),
        (["1", "2.5", "-3"], ("FLOAT", 1.0)),
        (["yes", "No", "TRUE"], ("BOOLEAN", 1.0)),
        (["a;b", "c;d", "e"], ("LIST", 0.67)),
        (["a,b,c", "d,e,f", ""], ("LIST", 1.0)),
        (["05", "-07", "1"], ("STRING", 0.95)),
        (["", None], ("STRING", 0.5)),
        (["1"] * 17 + ["x"] * 3, ("INTEGER", 0.85)),
    ],
)
def test_type_vote(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    row = schema.infer_types(df, ["v"]).first()
    assert (row["data_type"], row["confidence"]) == expected


def test_schema_with_a_pack(spark):
    df = spark.createDataFrame([("118792", "5", "x", "1")], "c0 string, c1 string, c2 string, c3 string")
    found = schema.detect_fields(df, ["Qual ID", "NQF", "Remark", "Remark"], QUALIFICATIONS.fields, ("saqa_id",))
    assert [(f.name, f.data_type, f.is_primary_key) for f in found] == [
        ("saqa_id", "STRING", True), ("nqf_level", "INTEGER", False), ("remark", "STRING", False), ("remark_2", "INTEGER", False),
    ]
    own = schema.detect_fields(df, ["a", "b", "c", "d"], override=[Field("mine")])
    assert own == [Field("mine")]
    assert [f.name for f in schema.detect_fields(df, ["a", "", " ", "b"])] == ["a", "column_2", "column_3", "b"]


def test_sample_columns(spark):
    df = spark.createDataFrame([(i, str(i), str(i), "x" if i == 0 else "1.5") for i in range(40)], "o int, a string, b string, c string")
    found = schema.sample_columns(df, ["SAQA ID", "Count", "Price"], "o")
    assert [(f.name, f.data_type, f.required) for f in found] == [
        ("saqa_id", "STRING", True), ("count", "INTEGER", False), ("price", "FLOAT", False),
    ]


def test_list_column(spark):
    df = spark.createDataFrame([(i, "a; b" if i > 30 else "a", "x,y" if i > 30 else "x") for i in range(60)], "o int, names string, other string")
    assert schema.detect_list_column(df, ["names", "other"]) == "names"
    assert schema.detect_list_column(df.withColumnRenamed("other", "colleges"), ["colleges", "names"]) == "colleges"
    assert schema.detect_list_column(df.withColumn("names", F.lit("x")), ["names"]) is None


def test_dedup(spark):
    df = spark.createDataFrame([(1, "118792", "a"), (2, "118792", "b"), (3, "102145", "c"), (4, None, "d"), (5, None, "e")], "o int, id string, v string")
    assert rows_of(relational.deduplicate(df, "o", ["id"]), "o") == [(1,), (3,), (4,)]
    once = relational.deduplicate(df, "o", ["id"])
    assert rows_of(relational.deduplicate(once, "o", ["id"]), "o") == [(1,), (3,), (4,)]
    assert relational.deduplicate(df, "o").count() == 5
    assert tuple(relational.duplicate_count(df, ["id"]).first()) == (5, 3, 2)


def test_decompose(spark):
    df = spark.createDataFrame(
        [(1, "101", "t", "College 1; College 2"), (2, "101", "u", "College 3"), (3, "", "", ""), (4, None, None, None), (5, None, "v", None)],
        "o int, id string, title string, colleges string",
    )
    parent = relational.decompose_parent(df, "colleges", "id", "o")
    assert rows_of(parent, "o") == [(1,), (5,)]
    child = relational.decompose_child(df, "colleges", "id", "college_name")
    assert rows_of(child, "id", "college_name") == [("101", f"College {i}") for i in (1, 2, 3)]


def test_decompose_splits_the_source_value(spark):
    df = normalize_frame(spark.createDataFrame([(1, "118792", "Motheo TVET\nUmfolozi TVET")], "o int, id string, colleges string"), ["id", "colleges"])
    child = relational.decompose_child(df, "colleges", "id", "name")
    assert rows_of(child, "name") == [("Motheo TVET",), ("Umfolozi TVET",)]


def test_surrogate_keys(spark):
    dim = spark.createDataFrame([("C0007", "Orbit TVET")], "college_id string, college_name string")
    names = spark.createDataFrame(
        [(1, "Tshwane South"), (2, "Sedibeng"), (3, " Tshwane South "), (4, "orbit tvet"), (5, "no"), (6, "tvet college"), (7, "Orbit TVET")],
        "o int, college_name string",
    )
    out = relational.extend_dimension(dim, names, "college_name", "o", "college_id").orderBy("college_id").collect()
    assert [(r["college_id"], r["college_name"], r["data_quality_flag"]) for r in out] == [
        ("C0007", "Orbit TVET", None), ("C0008", "Tshwane South", None), ("C0009", "Sedibeng", None),
        ("C0010", "orbit tvet", "review_possible_variant"),
    ]


def test_nested_children_lose_nothing_when_oversized(spark):
    parents = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    many = spark.createDataFrame([("a", i, f"n{i}") for i in range(10)] + [("b", 1, "x")], "k string, i int, n string")
    few = spark.createDataFrame([("a", 1, "m"), ("b", 2, "y")], "k string, i int, m string")
    out = relational.nested_children(parents, {"many": (many, "i", ["n"]), "few": (few, "i", ["m"])}, "k", max_items=4).collect()
    names = {}
    for r in out:
        assert len(r["many"]) <= 4
        names.setdefault(r["k"], []).extend(c["n"] for c in sorted(r["many"]))
    assert {k: sorted(v) for k, v in names.items()} == {"a": sorted(f"n{i}" for i in range(10)), "b": ["x"], "c": []}
    assert sum(len(r["few"]) for r in out) == 2
    assert sorted(r["part"] for r in out if r["k"] == "a") == [0, 1, 2] and all(r["part"] == 0 for r in out if r["k"] != "a")
    joined = relational.joined_children(parents, {"many": (many, "i", "n")}, "k").orderBy("k").collect()
    assert [r["many"] for r in joined] == ["; ".join(f"n{i}" for i in range(10)), "x", ""]


def test_qualification_model(spark):
    df = spark.createDataFrame(
        [(1, None, "118792", " Dev ", "Occupational", "funded", "a name; b name", 0.7), (2, "5", "", "", None, "Pending", None, 0.2)],
        "row_index int, qual_id string, saqa_id string, qualification string, framework string, nsfas string, participating_colleges string, confidence double",
    )
    out = relational.qualification_table(df).orderBy("row_index").collect()
    assert out[0][1:10] == ("118792", "118792", "Dev", "Dev", None, "OQSF", "YES", "Section 1: Occupational Qualifications", "1")
    assert out[0]["confidence"] == "medium" and out[0]["college_names"] == ["a name", "b name"]
    assert (out[1]["saqa_id"], out[1]["qualification_name"], out[1]["nsfas_allowance"]) == ("5", "Unknown Qualification", "PENDING")


def test_lookup_and_changes(spark):
    df = spark.createDataFrame([("x", "d1", 1), ("y", "d2", 2)], "name string, doc string, v int")
    assert rows_of(relational.lookup_by_either(df, ("name", "x"), ("doc", "d2")), "v") == [(1,)]
    assert rows_of(relational.lookup_by_either(df, ("name", "q"), ("doc", "d2")), "v") == [(2,)]
    updates = spark.createDataFrame([("x", 5, 1), ("x", None, 3), ("x", 7, 2), ("y", 9, 1)], "name string, v int, at int")
    last = relational.apply_changes(df, "name", updates=updates, order="at", clear=True)
    assert sorted(rows_of(last, "name", "v")) == [("x", None), ("y", 9)]
    assert sorted(rows_of(relational.apply_changes(df, "name", updates=updates, order="at"), "name", "v")) == [("x", 1), ("y", 9)]


def test_dimension_numbers_any_row_ids(spark):
    dim = spark.createDataFrame([("C0003", "Old Name", None)], "id string, name string, data_quality_flag string")
    names = spark.createDataFrame([("new b", 1 << 62), ("new a", 1 << 62), ("OLD NAME", 5), ("New A", (1 << 62) + 1), ("first", -4)], "name string, at long")
    out = {r["name"]: (r["id"], r["data_quality_flag"]) for r in relational.extend_dimension(dim, names, "name", "at", "id").collect()}
    flag = "review_possible_variant"
    assert out == {"Old Name": ("C0003", None), "first": ("C0004", None), "OLD NAME": ("C0005", flag), "new a": ("C0006", None), "new b": ("C0007", None), "New A": ("C0008", flag)}


def test_rules_on_absent_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "record_id int, v string")
    found = rules.validate(df, [rules.Rule("r", "r", "w", "required")]).collect()
    assert [r["record_id"] for r in found] == [1, 2]
    with pytest.raises(ValueError, match="nonsense"):
        rules.validate(df, [rules.Rule("r", "r", "v", "nonsense")])


def test_diff_last_row_counts(spark):
    old = spark.createDataFrame([(1, "a", "x", "0"), (2, "a", "y", "0"), (3, "b", "x", None), (4, "", "x", "")], "o int, k string, v string, z string")
    new = spark.createDataFrame([(1, " a ", "y", "1"), (2, "c", "x", ""), (3, "b", "x", "")], "o int, k string, v string, z string")
    diff = {r["key"]: r for r in compare.dataset_diff(old, new, "k", "o").collect()}
    assert set(diff) == {"a", "c"}
    assert (diff["a"]["diff_type"], diff["a"]["changed_fields"]) == ("MODIFIED", ["z"])
    assert (diff["a"]["old_values"], diff["a"]["new_values"]) == ({"z": "0"}, {"z": "1"})
    assert diff["c"]["new_values"] == {"k": "c", "v": "x", "z": ""}
    counts = {r["diff_type"]: r["records"] for r in compare.diff_counts(old, new, "k", "o").collect()}
    assert counts == {"MODIFIED": 1, "ADDED": 1, "UNCHANGED": 1}
    assert compare.dataset_diff(old, old, "k", "o").count() == 0


def test_reconcile(spark):
    a = spark.createDataFrame([(1, "118792", "Dev", "5"), (2, "998811", "Tester", "6"), (3, None, "Only A", "1")], "row_index int, saqa_id string, title string, nqf_level string")
    b = spark.createDataFrame([(1, "118792", " dev", "5"), (2, "998811", "Tester", "9"), (3, "998811", "Tester", "7"), (4, "55555", "Only B", "2")], "row_index int, saqa_id string, title string, nqf_level string")
    matched = compare.match_extractions(a, b, compare.identifier(a.columns), compare.identifier(b.columns), "row_index")
    found = compare.conflicts(matched, "a", "b", ["row_index"]).collect()
    assert [(r["row_index"], r["field_name"], r["value_a"], r["value_b"]) for r in found] == [(2, "nqf_level", "6", "7")]
    rate = compare.agreement(matched, b, ["row_index"]).first()
    assert (rate["matched_records"], rate["agreement_rate"]) == (2, 83.33)
    merged = compare.reconciled(matched, ["row_index"]).orderBy("row_index").collect()
    assert [(r["nqf_level"], r["__conflict_nqf_level"]) for r in merged] == [("5", False), ("6", True), ("1", False)]
    assert rows_of(compare.only_in_b(matched, b, compare.identifier(b.columns)), "saqa_id") == [("55555",)]
    nothing = compare.match_extractions(a, b.filter("false"), compare.identifier(a.columns), compare.identifier(b.columns), "row_index")
    alone = compare.agreement(nothing, b.filter("false"), ["row_index"]).first()
    assert (alone["matched_records"], alone["agreement_rate"]) == (3, 100.0)
    review = compare.conflicts_to_review(compare.conflicts(matched, "a", "b", ["row_index"])).first()
    assert (review["original_value"], review["issue"]) == ("6", "model_disagreement_nqf_level")


def test_golden(spark):
    golden = compare.golden_columns(spark.createDataFrame([("1001", "5"), ("1002", "6"), ("1003", "4")], "`SAQA ID` string, `NQF Level` string"))
    actual = spark.createDataFrame([("1001", "5", 1), ("1002", "7", 1), ("1004", "4", 1)], "saqa_id string, nqf_level string, source_page int")
    key = compare.golden_key(golden.columns)
    report = compare.golden_report(golden, actual, key).first()
    assert (report["matched_records"], report["missing_records"], report["extra_records"]) == (2, 1, 1)
    assert (report["record_recall"], report["record_precision"], report["field_mismatches"]) == (66.67, 66.67, 1)
    wrong = compare.golden_mismatches(golden, actual, key).first()
    assert (wrong["identifier"], wrong["expected_value"], wrong["actual_value"]) == ("1002", "6", "7")
    same = compare.golden_report(golden, golden, key).first()
    assert (same["record_f1"], same["field_accuracy"]) == (100.0, 100.0)


def test_set_rules_in_validate(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", None)], "record_id int, k string, p string")
    parent = spark.createDataFrame([("x",)], "id string")
    checks = [
        rules.Rule("u", "unique k", "k", "unique"),
        rules.Rule("f", "parent", "p", "referential", params={"parent": "owners", "key": "id"}),
        rules.Rule("t", "type", "k", "type", params={"type": "integer"}),
    ]
    issues = rules.validate(df, checks, parents={"owners": parent})
    assert rows_of(issues, "rule_id", "record_id") == [("f", 2), ("t", 1), ("t", 2), ("t", 3), ("u", 1), ("u", 2)]
