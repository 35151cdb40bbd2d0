"""Queries: validation, fixes, constraints, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctables.catalog import inputs
from doctables.catalog.base import query, table
from doctables.catalog.inputs import with_inputs
from doctables.functions import canon
from doctables.operators import quality, rules
from doctables.operators.schema import Field

FIELDS = [
    Field("ofo_code", required=True, is_primary_key=True),
    Field("nqf_level", data_type="INTEGER"),
    Field("occupation_title", required=True),
    Field("brand", allowed_values=tuple(f"Brand#{i}" for i in range(1, 21))),
]
RULES = rules.default_rules(FIELDS)
NAMES = [f.name for f in FIELDS]

_RULE_SQL = """
SELECT record_id, 'ofo_code' AS field, 'CRITICAL' AS severity, 'req_ofo_code' AS rule_id,
  'Missing required value for ''ofo_code''' AS message, ofo_code AS current_value, CAST(NULL AS VARCHAR) AS suggested_fix
FROM part_records WHERE ofo_code IS NULL OR trim(ofo_code) = ''
UNION ALL SELECT record_id, 'ofo_code', 'CRITICAL', 'ofo_regex_ofo_code', 'Value ''' || ofo_code || ''' does not match expected format', ofo_code,
  CASE WHEN regexp_full_match(regexp_replace(ofo_code, '[^0-9]', '', 'g'), '[0-9]{4,6}') THEN regexp_replace(ofo_code, '[^0-9]', '', 'g') END
FROM part_records WHERE ofo_code IS NOT NULL AND NOT regexp_full_match(trim(ofo_code), '[0-9]{4,6}')
UNION ALL SELECT record_id, 'nqf_level', 'WARNING', 'range_nqf_level', 'Value ''' || nqf_level || ''' is not numeric for range check', nqf_level, NULL
FROM part_records WHERE nqf_level = 'level'
UNION ALL SELECT record_id, 'nqf_level', 'CRITICAL', 'range_nqf_level',
  'Value ' || CAST(CAST(nqf_level AS DOUBLE) AS VARCHAR) || ' outside valid range [1, 10]', nqf_level, NULL
FROM part_records WHERE nqf_level <> 'level' AND TRY_CAST(nqf_level AS DOUBLE) NOT BETWEEN 1 AND 10
UNION ALL SELECT record_id, 'occupation_title', 'CRITICAL', 'req_occupation_title', 'Missing required value for ''occupation_title''', occupation_title, NULL
FROM part_records WHERE trim(occupation_title) = ''
UNION ALL SELECT record_id, 'brand', 'CRITICAL', 'allowed_brand', 'Value ''' || brand || ''' is not an allowed value', brand, NULL
FROM part_records WHERE brand NOT IN (""" + ", ".join(f"'Brand#{i}'" for i in range(1, 21)) + ")"

inputs.CTE["found"] = _RULE_SQL
inputs.NEEDS["found"] = ("part_records",)
inputs.CTE["summary"] = """
SELECT count(CASE WHEN severity = 'CRITICAL' THEN 1 END) AS critical_count, count(CASE WHEN severity = 'WARNING' THEN 1 END) AS warning_count,
  count(CASE WHEN severity = 'INFO' THEN 1 END) AS info_count, count(*) AS total_issues, count(DISTINCT record_id) AS records_with_issues,
  count(suggested_fix) AS auto_fixable_count FROM found"""
inputs.NEEDS["summary"] = ("found",)


def _issues(spark, folder):
    return rules.validate(inputs.part_records(spark, folder), RULES)


@query(with_inputs("SELECT *, suggested_fix IS NOT NULL AS is_auto_fixable FROM found", "found"))
def validate_issues(spark, folder):
    return _issues(spark, folder).drop("rule_name")


@query(with_inputs("SELECT * FROM summary", "summary"))
def validation_summary(spark, folder):
    return rules.summarize(_issues(spark, folder))


@query(
    with_inputs(
        """SELECT p.record_id, coalesce(f.fix, p.ofo_code) AS ofo_code, coalesce(f.n, 0) AS fixes, p.record_id IN (SELECT record_id FROM found) AS is_flagged
FROM part_records p LEFT JOIN (SELECT record_id, max(suggested_fix) AS fix, count(*) AS n FROM found WHERE suggested_fix IS NOT NULL GROUP BY record_id) f
  ON p.record_id = f.record_id""",
        "found",
    )
)
def auto_fix(spark, folder):
    records, issues = inputs.part_records(spark, folder), _issues(spark, folder)
    fixed_up = rules.apply_fixes(records, issues, NAMES)
    return rules.flag_records(fixed_up, issues).select("record_id", "ofo_code", "fixes", "is_flagged")


_RECORD_FIELDS = [
    Field("ofo_code", required=True),
    Field("nqf_level", data_type="INTEGER"),
    Field("occupation_title", required=True),
    Field("brand", data_type="FLOAT"),
]
inputs.CTE["record_issues"] = """
SELECT record_id, 'ofo_code' AS column_name, 'required_ofo_code' AS rule_name, 'error' AS severity FROM part_records WHERE ofo_code IS NULL
UNION ALL SELECT record_id, 'ofo_code', 'ofo_code_format', 'error' FROM part_records WHERE NOT regexp_full_match(ofo_code, '[0-9]{4,6}')
UNION ALL SELECT record_id, 'nqf_level', 'nqf_level_range', 'error' FROM part_records WHERE nqf_level <> 'level' AND TRY_CAST(nqf_level AS INTEGER) NOT BETWEEN 1 AND 10
UNION ALL SELECT record_id, 'nqf_level', 'nqf_level_numeric', 'warning' FROM part_records WHERE nqf_level = 'level'
UNION ALL SELECT record_id, 'nqf_level', 'type_integer', 'warning' FROM part_records WHERE nqf_level = 'level'
UNION ALL SELECT record_id, 'occupation_title', 'required_occupation_title', 'error' FROM part_records WHERE trim(occupation_title) = ''
UNION ALL SELECT record_id, 'brand', 'type_float', 'warning' FROM part_records"""
inputs.NEEDS["record_issues"] = ("part_records",)
inputs.CTE["record_states"] = """
SELECT p.record_id, CASE WHEN e > 0 THEN 'error' WHEN n > 0 THEN 'warning' ELSE 'valid' END AS status, coalesce(n, 0) AS issues FROM part_records p LEFT JOIN
  (SELECT record_id, count(*) AS n, count(CASE WHEN severity = 'error' THEN 1 END) AS e FROM record_issues WHERE column_name <> 'brand' GROUP BY record_id) i
  ON p.record_id = i.record_id"""
inputs.NEEDS["record_states"] = ("record_issues",)


@query(with_inputs("SELECT * FROM record_issues", "record_issues"))
def record_issues(spark, folder):
    checked = rules.validate_records(inputs.part_records(spark, folder), _RECORD_FIELDS)
    return checked.select("record_id", F.inline("issues")).select("record_id", "column_name", "rule_name", "severity")


def _states(spark, folder):
    return rules.validate_records(inputs.part_records(spark, folder), _RECORD_FIELDS[:3])


@query(with_inputs("SELECT * FROM record_states", "record_states"))
def record_status(spark, folder):
    return _states(spark, folder).select("record_id", "status", F.size("issues").cast("bigint").alias("issues"))


@query(
    with_inputs(
        """SELECT total, errors, warnings, total - errors - warnings AS valid,
  round_even(greatest(0.0, least(100.0, 100.0 - (errors * 1.5 + warnings * 0.5) / total * 100)), 1) AS quality_score FROM (
  SELECT CAST(count(*) AS BIGINT) AS total, count(CASE WHEN status = 'error' THEN 1 END) AS errors, count(CASE WHEN status = 'warning' THEN 1 END) AS warnings FROM record_states)""",
        "record_states",
    )
)
def quality_backend(spark, folder):
    counts = rules.status_counts(_states(spark, folder))
    return counts.withColumn(
        "quality_score", quality.penalty_score(F.col("total"), F.col("errors"), F.col("warnings"))
    )


inputs.CTE["model_rows"] = """
SELECT record_id, ofo_code AS saqa_id,
  CASE WHEN contains(fw, 'OQSF') OR contains(fw, 'OCCUPATIONAL') THEN 'OQSF' WHEN contains(fw, 'HEQSF') OR contains(fw, 'HIGHER') THEN 'HEQSF'
    WHEN contains(fw, 'GFET') OR contains(fw, 'GENERAL') OR contains(fw, 'FURTHER') THEN 'GFETQSF' ELSE fw END AS nqf_sub_framework,
  CASE WHEN ns IN ('YES', 'ELIGIBLE', 'FUNDED', 'TRUE', '1', 'Y') THEN 'YES' WHEN ns IN ('NO', 'NOT ELIGIBLE', 'UNFUNDED', 'FALSE', '0', 'N', '') THEN 'NO' ELSE ns END AS nsfas_allowance,
  CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.60 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT *, upper(framework) AS fw, upper(nsfas) AS ns FROM part_records)"""
inputs.NEEDS["model_rows"] = ("part_records",)
inputs.CTE["violations"] = """
SELECT record_id, 'nsfas_allowance' AS column_name, 'chk_nsfas_allowance' AS rule_name, nsfas_allowance AS raw_value FROM model_rows WHERE nsfas_allowance NOT IN ('YES', 'NO')
UNION ALL SELECT record_id, 'nqf_sub_framework', 'chk_nqf_sub_framework', nqf_sub_framework FROM model_rows WHERE nqf_sub_framework NOT IN ('OQSF', 'HEQSF', 'GFETQSF')
UNION ALL SELECT record_id, 'saqa_id', 'pk_saqa_id_required', 'None' FROM model_rows WHERE saqa_id IS NULL"""
inputs.NEEDS["violations"] = ("model_rows",)


def _model_rows(spark, folder):
    return inputs.part_records(spark, folder).select(
        "record_id",
        F.col("ofo_code").alias("saqa_id"),
        canon.framework(F.col("framework")).alias("nqf_sub_framework"),
        canon.yes_no(F.col("nsfas")).alias("nsfas_allowance"),
        canon.confidence_band(F.col("confidence")).alias("confidence"),
    )


@query(with_inputs("SELECT * FROM violations", "violations"))
def check_constraints(spark, folder):
    rows = _model_rows(spark, folder)
    return rows.select("record_id", F.inline(rules.check_violations(rows))).drop("message")


@query(
    with_inputs(
        """SELECT record_id, 'loaded' AS target, NULL AS issue FROM model_rows WHERE record_id NOT IN (SELECT record_id FROM violations)
UNION ALL SELECT record_id, 'review', rule_name FROM violations""",
        "violations",
    )
)
def quarantine(spark, folder):
    good, review = rules.split_quarantine(_model_rows(spark, folder), carried=["record_id"])
    return good.select("record_id", F.lit("loaded").alias("target"), F.lit(None).cast("string").alias("issue")).unionByName(
        review.select("record_id", F.lit("review").alias("target"), "issue")
    )


@query(
    "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0) GROUP BY l_orderkey"
)
def fk_orphans(spark, folder):
    parents = table(spark, folder, "orders").filter("o_orderkey % 10 <> 0")
    lines = table(spark, folder, "lineitem").select("l_orderkey")
    return rules.orphans(lines, parents, {"l_orderkey": "o_orderkey"}).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    """SELECT 'kept' AS outcome, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)
UNION ALL SELECT 'forbids', count(*) FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)"""
)
def fk_delete_rules(spark, folder):
    gone = table(spark, folder, "supplier").filter("s_nationkey = 3")
    lines = table(spark, folder, "lineitem").select("l_suppkey")
    on = {"l_suppkey": "s_suppkey"}
    count = F.count(F.lit(1)).alias("n")
    kept = rules.cascade_delete(lines, gone, on).agg(count).select(F.lit("kept").alias("outcome"), "n")
    stops = rules.restrict_violations(lines, gone, on).agg(count).select(F.lit("forbids").alias("outcome"), "n")
    return kept.unionByName(stops)


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def unique_violations(spark, folder):
    return rules.unique_violations(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    with_inputs(
        """SELECT rn + l_orderkey * 100 AS record_id, CAST(l_orderkey AS VARCHAR) || '||' || CAST(l_linenumber AS VARCHAR) AS current_value
FROM line_rows JOIN (SELECT l_orderkey AS k, l_linenumber AS l FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) ON l_orderkey = k AND l_linenumber = l""",
        "line_rows",
    )
)
def unique_issues(spark, folder):
    rows = inputs.line_rows(spark, folder).withColumn("record_id", F.col("rn") + F.col("l_orderkey") * 100)
    rule = rules.Rule("unique_line", "Line is unique", "l_linenumber", "unique")
    return rules.unique_issues(rows, rule, ["l_orderkey", "l_linenumber"]).select("record_id", "current_value")


@query(
    with_inputs(
        """SELECT overall_score, extraction_score, completeness_score, consistency_score, validation_score, total_records, non_null_cells,
  critical_count AS critical_issues, warning_count AS warning_issues FROM (
  SELECT *, round_even(extraction_score * 0.25 + completeness_score * 0.25 + consistency_score * 0.25 + validation_score * 0.25, 1) AS overall_score FROM (
    SELECT *, CAST(95.0 AS DOUBLE) AS extraction_score, round_even(CAST(non_null_cells AS DOUBLE) / (total_records * 4) * 100, 1) AS completeness_score,
      CAST(100.0 AS DOUBLE) AS consistency_score,
      round_even(greatest(0.0, 100.0 - CAST(critical_count AS DOUBLE) / total_records * 60.0 - CAST(warning_count AS DOUBLE) / total_records * 20.0), 1) AS validation_score
    FROM (SELECT count(*) AS total_records, CAST(sum(CASE WHEN ofo_code IS NOT NULL THEN 1 ELSE 0 END + 1 + CASE WHEN trim(occupation_title) <> '' THEN 1 ELSE 0 END + 1) AS BIGINT) AS non_null_cells
      FROM part_records), summary))""",
        "summary",
    )
)
def quality_core(spark, folder):
    records = inputs.part_records(spark, folder)
    return quality.dataset_quality(records, NAMES, rules.summarize(_issues(spark, folder))).drop(
        "total_columns", "total_cells", "empty_cell_ratio"
    )


@query(
    with_inputs(
        """SELECT 'severity' AS by, s AS key, (SELECT count(*) FROM open_issues WHERE severity = s) AS issues FROM (VALUES ('error'), ('warning'), ('info')) v(s)
UNION ALL SELECT 'column', column_name, count(*) FROM open_issues GROUP BY column_name""".replace(
            "open_issues", "(SELECT * FROM record_issues WHERE record_id % 5 <> 0)"
        ),
        "record_issues",
    )
)
def issue_rollup(spark, folder):
    checked = rules.validate_records(inputs.part_records(spark, folder), _RECORD_FIELDS)
    issues = checked.select((F.col("record_id") % 5 == 0).alias("is_resolved"), F.inline("issues"))
    return rules.issue_rollup(issues)


@query(
    with_inputs(
        """SELECT dataset, count(CASE WHEN severity = 'CRITICAL' THEN 1 END) AS critical_count, count(CASE WHEN severity = 'WARNING' THEN 1 END) AS warning_count,
  count(CASE WHEN severity = 'INFO' THEN 1 END) AS info_count, count(*) AS total_issues, count(DISTINCT record_id) AS records_with_issues
FROM (SELECT *, 'ds' || CAST(record_id % 3 AS VARCHAR) AS dataset FROM found) GROUP BY ROLLUP (dataset)""",
        "found",
    )
)
def validate_rollup(spark, folder):
    issues = _issues(spark, folder).withColumn(
        "dataset", F.concat(F.lit("ds"), (F.col("record_id") % 3).cast("string"))
    )
    return rules.summarize_datasets(issues).drop("auto_fixable_count")


@query(
    with_inputs(
        """SELECT critical_count AS critical, warning_count AS warning, auto_fixable_count AS auto_fixable,
  CASE WHEN critical_count = 0 THEN 'COMPLETE' ELSE 'WARNING' END AS status, CASE WHEN critical_count = 0 THEN 0 ELSE 2 END AS exit_code FROM summary""",
        "summary",
    )
)
def active_issues(spark, folder):
    issues = _issues(spark, folder).withColumn("is_fixed", F.lit(False))
    status = rules.run_status(rules.summarize(issues))
    return rules.active_issues(issues).withColumns(
        {"status": status.select("status").scalar(), "exit_code": status.select("exit_code").scalar()}
    )


@query(
    with_inputs(
        """SELECT c.doc_id, c.page, c.value FROM (SELECT doc_id, 1 AS page, source AS value FROM documents) c
LEFT JOIN doc_pages p ON c.doc_id = p.doc_id AND c.page = p.page WHERE NOT coalesce(contains(lower(p.text), lower(c.value)), false)""",
        "doc_pages",
    )
)
def absent_values(spark, folder):
    found = table(spark, folder, "documents").select(
        "doc_id", F.lit(1).alias("page"), F.col("source").alias("value")
    )
    return rules.absent_from_page(found, inputs.doc_pages(spark, folder)).select("doc_id", "page", "value")


@query(
    with_inputs(
        r"""SELECT c.doc_id, c.page, c.value FROM (SELECT doc_id + 1 AS doc_id, 1 AS page, unnest(list_distinct(string_split(text, ' '))) AS value FROM documents) c
LEFT JOIN doc_pages p ON c.doc_id = p.doc_id AND c.page = p.page WHERE regexp_matches(c.value, '\S') AND NOT coalesce(contains(lower(p.text), lower(c.value)), false)""",
        "doc_pages",
    )
)
def absent_words(spark, folder):
    """Every page searched for all words of the document before."""
    cells = table(spark, folder, "documents").select(
        (F.col("doc_id") + 1).alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array_distinct(F.split("text", " "))).alias("value")
    )
    return rules.absent_from_page(cells, inputs.doc_pages(spark, folder)).select("doc_id", "page", "value")
