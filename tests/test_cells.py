"""Scalar functions and normalisation on the documented values."""

import pytest
from pyspark.sql import functions as F

from doctables.functions import canon, cells, fixed, lists, names, text


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("o")).first()["o"]


def norm(spark, value, field):
    row = cells.normalize_frame(spark.createDataFrame([(value,)], f"{field} string"), [field]).first()
    return row[field], row[f"{field}__kind"], row[f"{field}__mod"]


def test_text_is_cleaned(spark):
    raw = "  Occupational Certificate:\t“AI Software”–Dev \n\n "
    assert norm(spark, raw, "title") == ('Occupational Certificate: "AI Software"-Dev', "str", True)


@pytest.mark.parametrize("token", ["N/A", "na", "-", "--", "None", "null", "NIL", "#n/a", "nan"])
def test_null_tokens(spark, token):
    assert norm(spark, token, "title") == (None, "null", True)


def test_blank_is_null_and_not_modified(spark):
    assert norm(spark, "", "title") == (None, "null", False)
    assert norm(spark, None, "title") == (None, "null", False)


@pytest.mark.parametrize(
    "value, field, expected",
    [
        ("012345", "ofo_code", ("012345", "str", False)),
        ("01234", "ofo_code", ("01234", "str", False)),
        ("42", "count", ("42", "int", False)),
        ("  42  ", "count", ("42", "int", True)),
        ("007", "count", ("7", "int", False)),
        ("-0", "count", ("0", "int", False)),
        ("2.50", "price", ("2.5", "float", False)),
        ("2.00", "price", ("2.0", "float", False)),
        ("GP", "province", ("Gauteng", "str", True)),
        ("Gauteng", "province", ("Gauteng", "str", False)),
        ("yes", "flag", ("true", "bool", True)),
        ("True", "flag", ("true", "bool", False)),
        ("no", "saqa_id", ("false", "bool", True)),
        ("12345678901234567890123", "count", ("12345678901234567890123", "int", False)),
    ],
)
def test_values(spark, value, field, expected):
    assert norm(spark, value, field) == expected


def test_code_fields_can_be_named(spark):
    df = spark.createDataFrame([("007", "007")], "width string, key string")
    row = cells.normalize_frame(df, ["width", "key"], code_fields=["key"]).first()
    assert (row["width"], row["key"]) == ("7", "007")


def test_unicode(spark):
    assert one(spark, "ﬁle œuvre ​Ⅳ­", text.clean_unicode) == "file oeuvre IV"
    assert one(spark, "plain", text.clean_unicode) == "plain"


def test_strip_knows_all_white_space(spark):
    value = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    assert one(spark, f"{value}a b{value}", text.strip) == "a b"
    assert one(spark, f"a{value}b", text.collapse) == "a b"


def test_names(spark):
    for name in ["SAQA ID (new)", "CamelCaseName", "", "%%", " a--b  c ", "NQF-Level", "x__y"]:
        assert one(spark, name, names.snake_case) == names.snake_name(name)
    assert names.snake_name("NQF Level") == "nqf_level"
    assert names.unique_list(["a", "b", "a", "a"]) == ["a", "b", "a_2", "a_3"]


def test_json_in_prose(spark):
    fenced = 'Sure:\n```json\n{"a": 1}\n```\nBye {x}'
    assert one(spark, fenced, text.extract_json) == '{"a": 1}'
    assert one(spark, 'x {"a": {"b": 2}} y', text.extract_json) == '{"a": {"b": 2}}'
    assert one(spark, "plain ", text.extract_json) == "plain"


def test_list_cleaner(spark):
    raw = (
        "Orbit TVET\nCollege\nOrbit TVET College\nCollege\nTVET College\nSedibeng TVET\n"
        "College - Heidelberg Campus\n"
    )
    found = one(spark, raw, lists.clean_list)
    assert found.count("Orbit TVET College") == 1
    assert any("Sedibeng TVET College" in name for name in found)
    assert not {name.lower() for name in found} & set(fixed.LIST_STOPWORDS)
    assert one(spark, "1. Motheo TVET; motheo tvet;no;•  Umfolozi", lists.clean_list) == ["Motheo TVET", "Umfolozi"]
    assert one(spark, None, lists.clean_list) == []


def test_split_items(spark):
    assert one(spark, "a; b;;c", lists.split_items) == ["a", "b", "c"]
    assert one(spark, "a\nb, c", lists.split_items) == ["a", "b, c"]
    assert one(spark, "a, b", lists.split_items) == ["a", "b"]
    assert one(spark, " a ", lists.split_items) == ["a"]
    assert one(spark, "a|b", lambda c: lists.split_items(c, "|")) == ["a", "b"]


def test_canonical_values(spark):
    assert one(spark, "Occupational cert", canon.framework) == "OQSF"
    assert one(spark, "further", canon.framework) == "GFETQSF"
    assert one(spark, "", canon.framework) == "OQSF"
    assert one(spark, "other_fw", canon.framework) == "OTHER_FW"
    assert one(spark, "funded", canon.yes_no) == "YES"
    assert one(spark, "", canon.yes_no) == "NO"
    assert one(spark, "Pending", canon.yes_no) == "PENDING"
    assert one(spark, 0.85, canon.confidence_band, "double") == "high"
    assert one(spark, "highest", canon.confidence_text) == "medium"


def test_small_functions(spark):
    assert one(spark, "ab12c3", text.digits_only) == "123"
    assert one(spark, "level 07 of 9", text.first_number) == "07"
    assert one(spark, "none", text.first_number) is None
    assert one(spark, [3, 1, 12, 3], text.page_list, "array<int>") == "1, 3, 12"
    assert one(spark, "abcdefgh", text.estimate_tokens) == 2
    assert one(spark, "", text.estimate_tokens) == 1
    name = lambda c: text.export_name(c, F.lit("0123456789"), "csv")
    assert one(spark, "My list / v1", name) == "My_list___v1_01234567.csv"
