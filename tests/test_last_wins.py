"""Several changes of one key in a batch, and golden tables without a key."""

import pytest

from doctables.operators import compare, relational, review


def test_repeated_updates_leave_one_row(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(1, "x", 2), (1, "y", 1)], "k int, v string, at int")
    assert sorted(map(tuple, relational.apply_changes(rows, "k", updates=twice, order="at").collect())) == [(1, "x"), (2, "b")]
    assert sorted(map(tuple, relational.apply_changes(rows, "k", updates=twice.drop("at")).collect())) == [(1, "y"), (2, "b")]


def test_repeated_resolutions_double_nothing(spark):
    issues = spark.createDataFrame([(1, 7, "v", "rule", False)], "issue_id int, record_id int, column_name string, rule_name string, is_resolved boolean")
    done = spark.createDataFrame([(1, True, "p", "c", "new", 1), (1, True, "q", "d", "last", 2)], "issue_id int, is_resolved boolean, resolved_by string, comment string, corrected_value string, at int")
    records = spark.createDataFrame([(7, "old", "open")], "record_id int, v string, status string")
    updated, patched, audits = review.resolve_issues(issues, done, records, order="at")
    assert updated.count() == 1 and [tuple(r) for r in patched.collect()] == [(7, "last", "human_reviewed")]
    assert [(r.old_value, r.new_value, r.reviewed_by) for r in audits.collect()] == [("old", "last", "q")]
    conflicts = spark.createDataFrame([(1, "a", "b", None)], "conflict_id int, value_a string, value_b string, resolution string")
    picks = spark.createDataFrame([(1, "accepted_a", None, "p", 1), (1, "accepted_b", None, "p", 2)], "conflict_id int, resolution string, manual_value string, resolved_by string, at int")
    assert [r.resolved_value for r in review.resolve_conflicts(conflicts, picks, order="at").collect()] == ["b"]


def test_golden_rows_match_by_place(spark):
    golden = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "at int, name string")
    actual = spark.createDataFrame([(5, "A "), (6, "x")], "at int, name string")
    row = compare.golden_report(golden, actual, None, "at").first()
    assert (row.matched_records, row.missing_records, row.extra_records, row.field_mismatches) == (2, 1, 0, 1)
    assert [tuple(r) for r in compare.golden_mismatches(golden, actual, None, "at").collect()] == [("1", "name", "b", "x")]
    with pytest.raises(ValueError):
        compare.golden_report(golden, actual, None)
