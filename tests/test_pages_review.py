"""Pages, chunks, classification, review, provenance, usage."""

import random

import pytest
from pyspark.sql import functions as F

from doctables.operators import chunks, documents, pages, provenance, review, serve, usage
from doctables.operators.schema import Field
from doctables.sources.rulepacks import shipped_profiles

PACKS = shipped_profiles()


def page_frame(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id string, page int, text string, images int, drawings int, tables int"
    )


def test_page_stats(spark):
    df = page_frame(
        spark,
        [("d", 1, " two words \n", 1, 0, None), ("d", 2, "w " * 20, 0, 9, None), ("d", 3, None, 0, 9, 4)],
    )
    rows = {r["page"]: r for r in pages.page_stats(df).collect()}
    assert (rows[1]["text_length"], rows[1]["word_count"], rows[1]["is_scanned"]) == (9, 2, True)
    assert (rows[2]["word_count"], rows[2]["table_count"], rows[2]["has_vectors"]) == (20, 1, True)
    assert (rows[3]["word_count"], rows[3]["table_count"], rows[3]["sample"]) == (0, 4, "")


def test_rollup_counts_all_pages_unless_told(spark):
    df = page_frame(spark, [("d", p, "x" * 300, 1, 0, 1 if p < 3 else 0) for p in range(1, 61)])
    row = pages.document_rollup(pages.page_stats(df)).first()
    assert (row["page_count"], row["total_text_length"], row["table_likelihood"]) == (60, 18000, 0.03)
    first = pages.document_rollup(pages.page_stats(df), max_pages=50).first()
    assert (first["page_count"], first["total_text_length"], first["table_likelihood"]) == (60, 15000, 0.04)
    assert (row["text_availability"], row["has_digital_text"], row["scanned_ratio"]) == (1.0, True, 0.0)


def classified(spark, name, sample, **stats):
    values = {"page_count": 5, "total_text_length": 5000, "scanned_ratio": 0.0, "text_availability": 1.0, "table_likelihood": 0.95, "has_digital_text": True} | stats
    df = spark.createDataFrame([(name, sample)], "filename string, sample_text string")
    return documents.classify(df.withColumns({k: F.lit(v) for k, v in values.items()}), PACKS).first()["classification"]


def test_profiles(spark):
    df = spark.createDataFrame(
        [("DHET_TVET_Qualifications_2026.pdf", ""), ("survey_2026.pdf", "variable name and value label"), ("x.pdf", "province"), ("x.pdf", "OFO Code Major Group")],
        "filename string, sample_text string",
    )
    found = [r["profile"] for r in documents.match_profiles(df, PACKS).collect()]
    assert found == ["tvet_qualifications", "qlfs_codebook", None, "occupations_high_demand"]


def test_classification(spark):
    best = classified(spark, "list.pdf", "saqa id nqf level participating colleges")
    assert (best["document_type"], best["recommended_extractor"], best["confidence"]) == ("REPEATED_TABULAR", "qualifications", 0.9)
    assert classified(spark, "a.pdf", "", scanned_ratio=0.7)["document_type"] == "SCANNED_IMAGE"
    assert classified(spark, "a.pdf", "", has_digital_text=False)["recommended_extractor"] == "ocr"
    assert classified(spark, "a.pdf", "")["document_type"] == "REPEATED_TABULAR"
    assert classified(spark, "a.pdf", "", page_count=3)["document_type"] == "STRUCTURED_TABLE"
    assert classified(spark, "a.pdf", "", table_likelihood=0.1)["document_type"] == "SEMI_STRUCTURED_REPORT"
    assert classified(spark, "a.pdf", "", table_likelihood=0.1, text_availability=0.5)["document_type"] == "MIXED_DOCUMENT"
    assert classified(spark, "a.pdf", "", page_count=0)["document_type"] == "UNSUPPORTED_AMBIGUOUS"


def test_routing(spark):
    pick = lambda t, r=None: spark.range(1).select(documents.choose_extractor(F.lit(t), None if r is None else F.lit(r)).alias("x")).first()["x"]
    assert pick("TVET list") == "qualifications"
    assert pick("x", "oihd") == "occupations"
    assert pick("survey", "auto") == "codebook"
    assert pick("x") == "pdf_tables"
    row = spark.range(1).select(documents.effective(F.lit(None).cast("string"), F.lit(None).cast("string"), "pdf_tables").alias("x")).first()
    assert row["x"] == "pdf_tables"
    row = spark.range(1).select(documents.profile_for(F.lit("CODEBOOK_METADATA"), F.lit("x"), PACKS).alias("a"), documents.profile_for(F.lit("x"), F.lit("occupations"), PACKS).alias("b")).first()
    assert tuple(row) == ("qlfs_codebook", "occupations_high_demand")


def groups_loop(tables):
    """tables: (page, headers, rows) in order; the documented grouping."""
    groups, current = [], []
    for a, b in zip(tables, tables[1:]):
        linked = b[0] == a[0] + 1 and (
            (a[1] and b[1] and len(a[1]) == len(b[1])) or (a[2] > 5 and b[2] > 5)
        )
        if linked:
            current = current or [a[0]]
            if b[0] not in current:
                current.append(b[0])
        elif current:
            groups.append(current)
            current = []
    return groups + ([current] if current else [])


@pytest.mark.parametrize("seed", range(3))
def test_continuation_groups_equal_loop(spark, seed):
    pick = random.Random(seed)
    tables, rows = [], []
    for page in range(1, 60):
        for index in range(pick.choice([0, 1, 1, 1, 1, 2])):
            headers = pick.choice([["a", "b"], ["a", "b"], ["a", "b", "c"], []])
            tables.append((page, headers, pick.choice([2, 9])))
            rows.append(("d", page, index, *tables[-1][1:]))
    df = spark.createDataFrame(rows, "doc_id string, page int, table_index int, headers array<string>, row_estimate int")
    got = pages.continuation_groups(df, page_block=8).orderBy("group_no").collect()
    assert [list(range(r["first_page"], r["last_page"] + 1)) for r in got] == groups_loop(tables)


def chunk_loop(listed, continued, size):
    out, i = [], 0
    while i < len(listed):
        batch = listed[i : i + size]
        out.append(batch)
        short = batch[-1] in continued and i + size < len(listed)
        i += max(1, size - 1) if short else size
    return out


@pytest.mark.parametrize("seed, size, block", [(1, 4, 8), (2, 4, 1024), (3, 2, 8), (4, 3, 9), (5, 1, 4)])
def test_chunks_equal_loop(spark, seed, size, block):
    pick = random.Random(seed)
    rows, groups, want = [], [], {}
    for doc in ("a", "b", "c"):
        listed = sorted(pick.sample(range(1, 80), pick.choice([1, 5, 40])))
        rows += [(doc, p, f"line {p}\n\nend {p}") for p in listed]
        starts = sorted(pick.sample(range(1, 70), 5))
        spans = [(s, s + pick.randint(1, 6)) for s in starts]
        groups += [(doc, *span) for span in spans]
        continued = {p for a, b in spans for p in range(a + 1, b + 1)}
        want[doc] = (chunk_loop(listed, continued, size), continued, set(listed))
    df = spark.createDataFrame(rows, "doc_id string, page int, text string")
    spans = spark.createDataFrame(groups, "doc_id string, first_page int, last_page int")
    got = {}
    for r in chunks.create_chunks(df, pages.continued_pages(spans), size=size, block=block).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for doc, (expected, continued, listed) in want.items():
        assert [r["pages"] for r in got[doc]] == expected
        assert [r["chunk_index"] for r in got[doc]] == list(range(len(expected)))
        for r in got[doc]:
            first = r["page_start"]
            assert r["is_continuation"] == (first in continued)
            before = first in continued and first - 1 in listed
            assert r["overlap"] == (f"line {first - 1}\nend {first - 1}" if before else None)
            assert r["text"].startswith(f"=== PAGE {first} ===\nline {first}")


def test_cache(spark):
    work = spark.createDataFrame([("k1", 1), ("k2", 2)], "cache_key string, v int")
    cache = spark.createDataFrame([("k1", 0)], "cache_key string, v int")
    assert [r["v"] for r in chunks.cache_misses(work, cache).collect()] == [2]
    assert sorted(r["v"] for r in chunks.cache_merge(cache, work).collect()) == [1, 2]


def test_cost_of_unknown_model(spark):
    prices = spark.createDataFrame([("p", "m", 2.0, 10.0)], "provider string, model string, input_per_m double, output_per_m double")
    calls = spark.createDataFrame([("j", "p", "m", 1000, 100), ("j", "p", "x", 1000, 100)], "job_id string, provider string, model string, prompt_tokens int, completion_tokens int")
    priced = usage.with_cost(calls, prices)
    assert sorted(r["cost"] for r in priced.collect()) == [0.0, 0.003]
    assert tuple(usage.usage_rollup(priced).first()) == ("j", 2, 2200, 0.003)


def test_review_queue(spark):
    df = spark.createDataFrame([(1, 0.5, True, False), (2, 0.95, True, False), (3, 0.95, False, False), (4, 0.1, False, True)], "id int, confidence double, is_flagged boolean, review_dismissed boolean")
    assert sorted((r["id"], r["reason"]) for r in review.review_queue(df).collect()) == [(1, "Low Confidence"), (2, "Validation Flag")]


def test_decisions(spark):
    records = spark.createDataFrame(
        [(i, "old", 5, "valid", True, False, ["made"]) for i in range(1, 5)],
        "record_id int, name string, level int, status string, is_flagged boolean, review_dismissed boolean, audit_trail array<string>",
    )
    log = spark.createDataFrame(
        [(1, "edit", "name", "new", None, 1), (1, "edit", "level", "7", None, 2), (1, "accept", None, None, "fine", 3), (2, "accept", None, None, None, 1), (2, "reject", None, None, None, 2), (3, "reject", None, None, None, 1), (3, "edit", "name", "x", None, 2)],
        "record_id int, action string, field string, new_value string, note string, decided_at int",
    )
    out = review.apply_decisions(records, log).orderBy("record_id").collect()
    assert [(r["record_id"], r["name"], r["level"], r["status"], r["is_flagged"]) for r in out] == [
        (1, "new", 7, "human_reviewed", False), (3, "x", 5, "human_reviewed", False), (4, "old", 5, "valid", True),
    ]
    assert out[0]["audit_trail"][1].endswith("Reviewed by human operator: fine") and len(out[2]["audit_trail"]) == 1


def test_issue_resolution(spark):
    records = spark.createDataFrame([(1, "bad", "error"), (2, "ok", "valid")], "record_id int, code string, status string")
    issues = spark.createDataFrame([(10, 1, "code", "format", False), (11, 2, "code", "format", False)], "issue_id int, record_id int, column_name string, rule_name string, is_resolved boolean")
    done = spark.createDataFrame([(10, True, None, "typo", "good"), (11, True, "me", None, None)], "issue_id int, is_resolved boolean, resolved_by string, comment string, corrected_value string")
    updated, patched, audits = review.resolve_issues(issues, done, records)
    assert all(r["is_resolved"] for r in updated.collect())
    assert sorted((r["code"], r["status"]) for r in patched.collect()) == [("good", "human_reviewed"), ("ok", "valid")]
    row = audits.first()
    assert (row["old_value"], row["new_value"], row["reason"], row["reviewed_by"]) == ("bad", "good", "Resolved issue 'format': typo", "Researcher")


def test_sign_off_and_review_items(spark):
    sets = spark.createDataFrame([("s1", "one", "validated"), ("s2", "two", "validated")], "dataset_id string, name string, status string")
    done = spark.sql("select 's1' dataset_id, 'me' verified_by, timestamp'2025-01-01 00:00:00' verified_at, 'ok' notes")
    signed, log = review.verify_datasets(sets, done)
    assert {r["dataset_id"]: r["status"] for r in signed.collect()} == {"s1": "verified", "s2": "validated"}
    assert log.first()["description"] == "Verified dataset 'one'."
    items = spark.sql("select 1 review_id, false resolved, cast(null as string) resolved_by, cast(null as timestamp) resolved_at")
    fixes = spark.sql("select 1 review_id, true resolved, 'me' resolved_by, timestamp'2025-01-01 00:00:00' resolved_at")
    assert review.resolve_review(items, fixes).first()["resolved"] is True


def test_provenance(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "b", 4)], "o int, v string, p int")
    out = provenance.attach_provenance(df, F.lit("doc.pdf"), F.col("p"), F.col("o"), F.lit("pdf_text"), F.lit(0.5))
    row = out.orderBy("o").first()["_prov"]
    assert (row["source_document"], row["source_page"], row["status"]) == ("doc.pdf", 3, "source_extracted")
    assert row["audit_trail"] == ["Extracted via pdf_text from page 3"]
    changed = provenance.set_prov(out, status=F.lit("human_reviewed")).first()["_prov"]
    assert changed["status"] == "human_reviewed" and changed["confidence"] == 0.5


def test_data_dictionary(spark):
    df = spark.createDataFrame([(i, "" if i < 55 else f"v{i}", i % 12) for i in range(60)], "o int, saqa_id string, page int")
    row = provenance.data_dictionary(df, [Field("saqa_id", required=True)], "o", "page").first()
    assert (row["example_value"], row["identifier"], row["nullable"]) == ("v55", "YES", "NO")
    assert row["source_pages"] == "0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11"


def test_stage_metrics(spark):
    stage = provenance.Stage("normalize")
    stage.watch(spark.range(10)).write.format("noop").mode("overwrite").save()
    assert tuple(stage.metrics(spark, 1.0, 2.5).first()) == ("normalize", "COMPLETE", 1500, 10)
    assert stage.metrics(spark, 1.0, 2.5, failed=True).first()["status"] == "FAILED"


def test_serving(spark):
    df = spark.createDataFrame([(i, f"Name {i}", "valid" if i % 2 else "error") for i in range(20)], "id int, name string, status string")
    found = serve.search(df, "NAME 1", status="valid")
    assert [r["id"] for r in serve.record_page(found, ["id"], 1, 3).collect()] == [1, 11, 13]
    assert [r["id"] for r in serve.latest(df, 2, ("id",)).collect()] == [19, 18]
    assert serve.latest(df, 0, ("id",)).count() == 1
    first = serve.page_after(df, ["status", "id"], None, 12).collect()
    rest = serve.page_after(df, ["status", "id"], [first[-1]["status"], first[-1]["id"]], 12).collect()
    assert [r["id"] for r in first + rest] == [*range(0, 20, 2), *range(1, 20, 2)]
    assert serve.where_all(df, {"status": "error", "name": None}).count() == 10
    assert serve.project_columns(df.withColumn("_prov_page", F.lit(1)), ["id"]).columns == ["id", "_prov_page"]
    empty = spark.createDataFrame([], "record_count int, valid_count int, warning_count int, error_count int, quality_score double")
    assert serve.kpis(empty).first()["mean_quality"] == 100.0
    assert serve.newest(df, "id").first()["id"] == 19 and serve.by_id(df, 3).count() == 1


def test_selection(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, page int")
    assert pages.select_documents(df, ["a"]).count() == 1
    assert pages.select_documents(df, df.filter("page = 2")).first()["doc_id"] == "b"
    assert pages.select_pages(df, [0, 2, 99]).count() == 1
