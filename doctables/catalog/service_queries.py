"""Queries: review, provenance, serving, exports, streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from doctables.catalog import inputs
from doctables.catalog.base import query, table
from doctables.catalog.cell_queries import normalized
from doctables.catalog.inputs import CUSTOMER_FIELDS, with_inputs
from doctables.catalog.rule_queries import FIELDS, RULES
from doctables.functions import canon, text
from doctables.operators import provenance, quality, review, rules, schema, serve
from doctables.sources import sinks
from doctables.streaming import flows


@query(
    with_inputs(
        """SELECT record_id, CASE WHEN confidence < 0.9 THEN 'Low Confidence' ELSE 'Validation Flag' END AS reason FROM user_records
WHERE NOT review_dismissed AND (confidence < 0.9 OR is_flagged)""",
        "user_records",
    )
)
def review_queue(spark, folder):
    return review.review_queue(inputs.user_records(spark, folder)).select("record_id", "reason")


@query(
    with_inputs(
        """SELECT r.record_id, coalesce(e.v, r.amount) AS amount, CASE WHEN d.action IN ('accept', 'edit') THEN 'human_reviewed' ELSE r.status END AS status,
  CASE WHEN d.action IN ('accept', 'edit') THEN false ELSE r.is_flagged END AS is_flagged FROM user_records r
LEFT JOIN (SELECT record_id, max_by(action, (ts, event_id)) AS action FROM decisions GROUP BY record_id) d ON r.record_id = d.record_id
LEFT JOIN (SELECT record_id, max_by(value, (ts, event_id)) AS v FROM decisions WHERE action = 'edit' GROUP BY record_id) e ON r.record_id = e.record_id
WHERE d.action IS NULL OR d.action <> 'reject'""",
        "user_records",
        "decisions",
    )
)
def review_apply(spark, folder):
    records, log = inputs.user_records(spark, folder), inputs.decisions(spark, folder)
    done = review.apply_decisions(records, log, order=("ts", "event_id"))
    return done.select("record_id", "amount", "status", "is_flagged")


@query(
    with_inputs(
        """SELECT r.record_id, coalesce(s, r.status) AS status FROM user_records r LEFT JOIN (SELECT record_id,
  max_by(CASE audit_action WHEN 'approve_record' THEN 'human_reviewed' WHEN 'reject_record' THEN 'error' ELSE 'warning' END, (ts, event_id)) AS s
  FROM decisions WHERE audit_action <> 'view_record' GROUP BY record_id) a ON r.record_id = a.record_id""",
        "user_records",
        "decisions",
    )
)
def audit_status(spark, folder):
    audits = inputs.decisions(spark, folder).drop("action").withColumnRenamed("audit_action", "action")
    records = inputs.user_records(spark, folder)
    return review.apply_audits(records, audits, order=("ts", "event_id")).select("record_id", "status")


@query(
    """SELECT c_custkey, 'edit_field' AS action, 'c_mktsegment' AS field_name, c_mktsegment AS old_value, 'CHANGED' AS new_value FROM customer WHERE c_custkey % 20 = 0
UNION ALL SELECT c_custkey, 'edit_field', 'c_nationkey', CAST(c_nationkey AS VARCHAR), NULL FROM customer WHERE c_custkey % 30 = 0
UNION ALL SELECT c_custkey, 'update_record', NULL, NULL, NULL FROM customer WHERE c_custkey % 20 <> 0 AND c_custkey % 30 <> 0"""
)
def edit_audit(spark, folder):
    old = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    k = F.col("c_custkey")
    new = old.withColumns(
        {
            "c_mktsegment": F.when(k % 20 == 0, "CHANGED").otherwise(F.col("c_mktsegment")),
            "c_nationkey": F.when(k % 30 != 0, F.col("c_nationkey")),
        }
    )
    return review.edit_audits(old, new, "c_custkey", ["c_mktsegment", "c_nationkey"]).drop("reason")


_ISSUE_SQL = "SELECT record_id AS issue_id, record_id, ofo_code FROM part_records WHERE record_id % 17 = 0 AND record_id % 19 <> 0"


@query(
    with_inputs(
        f"""SELECT p.record_id, CASE WHEN i.record_id % 2 = 0 THEN CAST(10000 + p.record_id AS VARCHAR) ELSE p.ofo_code END AS ofo_code,
  CASE WHEN i.record_id % 2 = 0 THEN 'human_reviewed' ELSE 'valid' END AS status, i.record_id IS NOT NULL AS had_issue
FROM part_records p LEFT JOIN ({_ISSUE_SQL}) i ON p.record_id = i.record_id""",
        "part_records",
    )
)
def issue_resolve(spark, folder):
    records = inputs.part_records(spark, folder).select("record_id", "ofo_code", F.lit("valid").alias("status"))
    issues = (
        rules.validate(records, [r for r in RULES if r.rule_type == "regex" and r.field == "ofo_code"])
        .select(
            F.col("record_id").alias("issue_id"), "record_id", F.col("field").alias("column_name"), "rule_name",
            "suggested_fix", F.lit(False).alias("is_resolved"),
        )
    )
    resolutions = issues.select(
        "issue_id",
        F.lit(True).alias("is_resolved"),
        F.lit("me").alias("resolved_by"),
        F.lit("checked").alias("comment"),
        F.when(F.col("issue_id") % 2 == 0, F.col("suggested_fix")).alias("corrected_value"),
    )
    updated, patched, _ = review.resolve_issues(issues.drop("suggested_fix"), resolutions, records)
    hit = updated.filter("is_resolved").select("record_id", F.lit(True).alias("had_issue"))
    return patched.join(hit, "record_id", "left").fillna(False, ["had_issue"])


@query(
    """SELECT c_custkey AS conflict_id, CASE c_custkey % 4 WHEN 0 THEN 'accepted_a' WHEN 1 THEN 'accepted_b' WHEN 2 THEN 'manual' ELSE 'requires_review' END AS resolution,
  CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment WHEN 2 THEN 'typed' END AS resolved_value FROM customer"""
)
def conflict_resolve(spark, folder):
    k = F.col("conflict_id")
    found = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("conflict_id"),
        F.col("c_name").alias("value_a"),
        F.col("c_mktsegment").alias("value_b"),
        F.lit("requires_review").alias("resolution"),
    )
    choices = found.filter(k % 4 != 3).select(
        "conflict_id",
        F.when(k % 4 == 0, "accepted_a").when(k % 4 == 1, "accepted_b").otherwise("manual").alias("resolution"),
        F.lit("typed").alias("manual_value"),
        F.lit("me").alias("resolved_by"),
    )
    return review.resolve_conflicts(found, choices).select("conflict_id", "resolution", "resolved_value")


_DICTIONARY = [
    schema.Field("ofo_code", required=True, is_primary_key=True, source_header="OFO Code"),
    schema.Field("nqf_level", data_type="INTEGER"),
    schema.Field("occupation_title", required=True),
    schema.Field("brand"),
]


@query(
    with_inputs(
        """SELECT v.c AS column_name, v.l AS source_label, v.t AS data_type, v.n AS nullable, v.i AS identifier, p.pages AS source_pages,
  CASE v.c WHEN 'ofo_code' THEN e.a WHEN 'nqf_level' THEN e.b WHEN 'occupation_title' THEN e.t ELSE e.d END AS example_value
FROM (VALUES ('ofo_code', 'OFO Code', 'string', 'NO', 'YES'), ('nqf_level', 'nqf_level', 'integer', 'YES', 'NO'), ('occupation_title', 'occupation_title', 'string', 'NO', 'NO'),
  ('brand', 'brand', 'string', 'YES', 'NO')) v(c, l, t, n, i),
  (SELECT min_by(ofo_code, CASE WHEN trim(ofo_code) <> '' THEN record_id END) AS a, min_by(nqf_level, CASE WHEN trim(nqf_level) <> '' THEN record_id END) AS b,
    min_by(occupation_title, CASE WHEN trim(occupation_title) <> '' THEN record_id END) AS t, min_by(brand, CASE WHEN trim(brand) <> '' THEN record_id END) AS d FROM part_records) e,
  (SELECT string_agg(CAST(p AS VARCHAR), ', ' ORDER BY p) AS pages FROM (SELECT DISTINCT record_id % 37 + 1 AS p FROM part_records)) p""",
        "part_records",
    )
)
def data_dictionary(spark, folder):
    rows = inputs.part_records(spark, folder).withColumn("source_page", F.col("record_id") % 37 + 1)
    found = provenance.data_dictionary(rows, _DICTIONARY, "record_id", "source_page")
    return found.drop("dataset_name", "description")


def _with_provenance(spark, folder):
    k = F.col("record_id")
    return provenance.attach_provenance(
        inputs.part_records(spark, folder),
        F.concat(F.lit("doc"), (k % 5).cast("string")),
        k % 37 + 1,
        k,
        F.when(k % 2 == 0, "pdf_text").otherwise("pdf_tables"),
        F.col("confidence"),
    )


@query(
    with_inputs(
        """SELECT record_id AS row_index, 'doc' || (record_id % 5) AS document_filename, CAST(record_id % 37 + 1 AS INTEGER) AS page_number,
  CASE WHEN record_id % 2 = 0 THEN 'pdf_text' ELSE 'pdf_tables' END AS method, 'deterministic' AS model, confidence FROM part_records""",
        "part_records",
    )
)
def row_provenance(spark, folder):
    return provenance.provenance_rows(_with_provenance(spark, folder), "record_id")


@query(
    with_inputs(
        """SELECT 'job' || (record_id % 3) AS job_id, 'doc' || (record_id % 5) AS dataset_name, count(*) AS record_count, '1-' || max(record_id % 37 + 1) AS source_page FROM part_records GROUP BY 1, 2""",
        "part_records",
    )
)
def provenance_summary(spark, folder):
    rows = _with_provenance(spark, folder).withColumns(
        {
            "job_id": F.concat(F.lit("job"), (F.col("record_id") % 3).cast("string")),
            "dataset_name": F.col("_prov.source_document"),
        }
    )
    return provenance.provenance_summary(rows)


@query(
    with_inputs(
        """SELECT count(*) AS records_extracted, count(CASE WHEN status = 'valid' THEN 1 END) AS records_verified, (SELECT count(*) FROM violations) AS records_review_required FROM record_states""",
        "record_states",
        "violations",
    )
)
def bundle_manifest(spark, folder):
    checked = rules.validate_records(inputs.part_records(spark, folder), [
        schema.Field("ofo_code", required=True),
        schema.Field("nqf_level", data_type="INTEGER"),
        schema.Field("occupation_title", required=True),
    ])
    rows = inputs.part_records(spark, folder).select(
        "record_id",
        F.col("ofo_code").alias("saqa_id"),
        canon.framework(F.col("framework")).alias("nqf_sub_framework"),
        canon.yes_no(F.col("nsfas")).alias("nsfas_allowance"),
        canon.confidence_band(F.col("confidence")).alias("confidence"),
    )
    _, queue = rules.split_quarantine(rows)
    counts = provenance.bundle_counts(checked, queue)
    manifest = provenance.bundle_manifest(
        counts, "list.pdf", "0" * 64, 1, ["parts"], [], "occupations", "1"
    )
    return manifest.select("records_extracted", "records_verified", "records_review_required")


@query(
    with_inputs(
        """SELECT (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) AS total_documents, (SELECT count(*) FROM documents) AS total_pages, (SELECT count(*) FROM part) AS total_records,
  (SELECT count(*) FROM part) - records_with_issues AS records_valid, warning_count AS records_with_warnings, critical_count AS records_critical,
  (SELECT string_agg(lang, ',' ORDER BY lang) FROM (SELECT DISTINCT lang FROM (SELECT source, min(lang) AS lang FROM documents GROUP BY source))) AS methods FROM summary""",
        "summary",
    )
)
def manifest(spark, folder):
    records = inputs.part_records(spark, folder)
    summary = rules.summarize(rules.validate(records, RULES))
    score = quality.dataset_quality(records, [f.name for f in FIELDS], summary)
    datasets = records.agg(F.count(F.lit(1)).alias("record_count")).select(
        F.lit("parts").alias("name"),
        "record_count",
        F.lit(4).alias("column_count"),
        score.select("overall_score").scalar().alias("quality_score"),
    )
    # A source counts as a document here, and a language as a reading method.
    docs = table(spark, folder, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("page_count"), F.min("lang").alias("method")
    )
    found = provenance.run_manifest(datasets, docs, summary)
    return found.withColumn("methods", F.array_join("extraction_methods", ",")).drop(
        "datasets", "extraction_methods"
    )


@query(
    "SELECT event_id, event_type, user_id FROM events WHERE contains(lower(event_type), 'c') AND user_id % 2 = 0 ORDER BY ts, event_id LIMIT 25 OFFSET 50"
)
def paged_search(spark, folder):
    rows = table(spark, folder, "events").filter("user_id % 2 = 0")
    found = serve.search(rows, "C", ["event_type"])
    return serve.record_page(found, ["ts", "event_id"], page=3, size=25).select("event_id", "event_type", "user_id")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 50")
def latest_activity(spark, folder):
    rows = serve.latest(table(spark, folder, "events"), 50, ("ts", "event_id"), {"event_type": "signup"})
    return rows.select("event_id", "user_id")


inputs.CTE["user_sets"] = """
SELECT user_id, count(*) AS record_count, count(CASE WHEN event_type = 'view' THEN 1 END) AS valid_count, count(CASE WHEN event_type = 'click' THEN 1 END) AS warning_count,
  count(CASE WHEN event_type = 'error' THEN 1 END) AS error_count FROM events GROUP BY user_id"""
inputs.CTE["user_scores"] = """
SELECT *, round_even(greatest(0.0, least(100.0, 100.0 - (error_count * 1.5 + warning_count * 0.5) / CAST(record_count AS DOUBLE) * 100)), 1) AS quality_score FROM user_sets"""
inputs.NEEDS["user_scores"] = ("user_sets",)


def _user_sets(spark, folder):
    kind = F.col("event_type")
    sets = table(spark, folder, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(kind == "view").alias("valid_count"),
        F.count_if(kind == "click").alias("warning_count"),
        F.count_if(kind == "error").alias("error_count"),
    )
    return sets.withColumn(
        "quality_score",
        quality.penalty_score(F.col("record_count"), F.col("error_count"), F.col("warning_count")),
    )


@query(
    with_inputs(
        """SELECT count(*) AS datasets, CAST(sum(record_count) AS BIGINT) AS records, CAST(sum(valid_count) AS BIGINT) AS valid, CAST(sum(warning_count) AS BIGINT) AS warnings,
  CAST(sum(error_count) AS BIGINT) AS errors, round_even(avg(quality_score), 1) AS mean_quality FROM user_scores""",
        "user_scores",
    )
)
def kpis(spark, folder):
    return serve.kpis(_user_sets(spark, folder))


@query(
    with_inputs(
        "SELECT CASE WHEN quality_score >= 90 THEN 'high' WHEN quality_score >= 70 THEN 'medium' ELSE 'low' END AS band, count(*) AS datasets FROM user_scores GROUP BY 1",
        "user_scores",
    )
)
def quality_bands(spark, folder):
    return serve.band_counts(_user_sets(spark, folder))


@query("SELECT count(*) AS total, count(CASE WHEN event_type = 'error' THEN 1 END) AS pending, count(CASE WHEN event_type <> 'error' THEN 1 END) AS resolved FROM events")
def pending_counts(spark, folder):
    return serve.pending_counts(table(spark, folder, "events"), "event_type", "error")


@query(
    """SELECT 'INSERT INTO "customer" ("c_custkey", "c_name", "c_nationkey", "active") VALUES (' || c_custkey || ', ''' || replace(CASE WHEN c_custkey % 3 = 0 THEN c_name || '''s' ELSE c_name END, '''', '''''')
  || ''', ' || CASE WHEN c_custkey % 4 = 0 THEN 'NULL' ELSE CAST(c_nationkey AS VARCHAR) END || ', ' || CASE WHEN c_custkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END || ');' AS line FROM customer"""
)
def sql_inserts(spark, folder):
    k = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(
        "c_custkey",
        F.when(k % 3 == 0, F.concat("c_name", F.lit("'s"))).otherwise(F.col("c_name")).alias("c_name"),
        F.when(k % 4 != 0, F.col("c_nationkey")).alias("c_nationkey"),
        (k % 2 == 0).alias("active"),
    )
    return sinks.insert_lines(rows, "customer")


@query(
    with_inputs(
        """SELECT ofo_code, brand, 'doc' || (record_id % 5) AS _prov_doc, CAST(record_id % 37 + 1 AS INTEGER) AS _prov_page, confidence AS _prov_confidence, 'valid' AS _prov_status FROM part_records""",
        "part_records",
    )
)
def flat_export(spark, folder):
    rows = _with_provenance(spark, folder).withColumn("status", F.lit("valid"))
    return sinks.export_frame(rows, selected=["ofo_code", "brand"])


@query(
    """SELECT s_suppkey, trim(regexp_replace(s_name || ' / v.1', '[^\\w\\-.]', '_', 'g'), '_') || '_' || substr(md5(s_name), 1, 8) || '.csv' AS filename, sha256(s_name) AS digest FROM supplier"""
)
def export_names(spark, folder):
    name = F.concat("s_name", F.lit(" / v.1"))
    return table(spark, folder, "supplier").select(
        "s_suppkey",
        text.export_name(name, F.md5("s_name"), "csv").alias("filename"),
        F.sha2("s_name", 256).alias("digest"),
    )


def _stream_folder(spark) -> str:
    """New folder next to the checkpoints, which all executors can reach."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="doctables-stream-")
    return f"{root}/streams/{uuid.uuid4()}"


def _stream(spark, folder, name):
    # A pattern matches a single file as well as a folder of files.
    schema_of = table(spark, folder, name).schema
    return flows.file_stream(spark, f"{folder}/{name}.parque[t]", schema_of)


@query(with_inputs("SELECT record_id, name, flag FROM (SELECT record_id, max(CASE WHEN field = 'name' THEN norm END) AS name, max(CASE WHEN field = 'flag' THEN norm END) AS flag FROM cells GROUP BY record_id)", "cells"))
def stream_intake(spark, folder):
    from doctables.functions.cells import norm_view, normalize_frame

    out = _stream_folder(spark)
    k = F.col("c_custkey")
    raw = _stream(spark, folder, "customer").select(
        k.alias("record_id"),
        F.when(k % 17 == 0, "N/A").when(k % 13 == 0, F.concat(F.lit("  "), "c_name", F.lit("  ")))
        .otherwise(F.col("c_name")).alias("name"),
        F.when(k % 5 == 0, "yes").when(k % 5 == 1, "N").when(k % 5 == 2, "TRUE").when(k % 5 == 3, " no ")
        .otherwise("y").alias("flag"),
    )
    steps = [lambda df: normalize_frame(df, ["name", "flag"]), norm_view]
    flows.intake(raw, steps, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query(with_inputs("SELECT 'record' AS kind, record_id, status AS label FROM record_states UNION ALL SELECT 'issue', record_id, rule_name FROM record_issues WHERE column_name <> 'brand'", "record_states"))
def stream_validate(spark, folder):
    out = _stream_folder(spark)
    k = F.col("p_partkey")
    code = (k + 10000).cast("string")
    records = _stream(spark, folder, "part").select(
        k.alias("record_id"),
        F.when(k % 19 == 0, None).when(k % 17 == 0, F.concat(F.lit("P-"), code)).otherwise(code).alias("ofo_code"),
        F.when(k % 23 == 0, "level").otherwise(F.col("p_size").cast("string")).alias("nqf_level"),
        F.when(k % 29 == 0, "  ").otherwise(F.col("p_name")).alias("occupation_title"),
    )
    fields = [
        schema.Field("ofo_code", required=True),
        schema.Field("nqf_level", data_type="INTEGER"),
        schema.Field("occupation_title", required=True),
    ]
    flows.validation_split(
        records, fields, "record_id", f"{out}/records", f"{out}/issues", f"{out}/checkpoint"
    ).awaitTermination()
    states = spark.read.parquet(f"{out}/records")
    issues = spark.read.parquet(f"{out}/issues")
    return states.select(F.lit("record").alias("kind"), "record_id", F.col("status").alias("label")).unionByName(
        issues.select(F.lit("issue").alias("kind"), "record_id", F.col("rule_name").alias("label"))
    )


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, folder):
    out = _stream_folder(spark)
    rows = _stream(spark, folder, "events").select("user_id", "event_type", "ts")
    firsts = flows.first_seen(rows, ["user_id", "event_type"], "ts", late="60 days")
    flows.append(firsts.drop("ts"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


_HOURS = """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS rows FROM events GROUP BY 1, 2"""


def _shown_windows(df):
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "rows")


@query(_HOURS)
def activity_windows(spark, folder):
    events = table(spark, folder, "events").select("ts", "event_type")
    return _shown_windows(flows.activity_rate(events, "ts", ["event_type"], "1 day", late=None))


@query(_HOURS)
def stream_rollup(spark, folder):
    out = _stream_folder(spark)
    rows = _stream(spark, folder, "events").select("ts", "event_type")
    totals = flows.activity_rate(rows, "ts", ["event_type"], "1 day")
    flows.latest_totals(totals, f"{out}/totals", f"{out}/checkpoint").awaitTermination()
    return _shown_windows(flows.current_totals(spark, f"{out}/totals", ["window_start", "window_end", "event_type"]))


@query(with_inputs("SELECT record_id, raw AS name FROM cells WHERE field = 'name'", "cells"))
def raw_values(spark, folder):
    """Source values after normalisation, as a raw hand-off gives them."""
    from doctables.functions.cells import raw_view

    return raw_view(normalized(spark, folder), CUSTOMER_FIELDS).select("record_id", "name")
