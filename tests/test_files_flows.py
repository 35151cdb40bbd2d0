"""Sources, sinks, the whole way, and streams."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from doctables.operators import provenance, rules
from doctables.operators.schema import Field
from doctables.plans import workflow
from doctables.sources import files, sinks
from doctables.sources.profiles import get_profile, load_profiles, profile_fields_frame
from doctables.sources.rulepacks import OCCUPATIONS, shipped_profiles
from doctables.streaming import flows

PACKS = shipped_profiles()


def texts(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_file_catalogue(spark, tmp_path):
    (tmp_path / "b.PDF").write_bytes(b"two")
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "c.txt").write_bytes(b"no")
    found = files.with_fingerprints(files.file_catalogue(spark, str(tmp_path))).orderBy("filename").collect()
    assert [(r["filename"], r["size_bytes"]) for r in found] == [("a.pdf", 3), ("b.PDF", 3)]
    assert found[0]["sha256"] == hashlib.sha256(b"one").hexdigest()
    assert found[0]["md5"] == hashlib.md5(b"one").hexdigest()


def test_stored_json_skips_bad_lines(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"id": "1"}\n{broken\n{"id": "2"}\n')
    good, bad = files.read_datasets(spark, str(tmp_path / "d.json"), "id string")
    assert sorted(r["id"] for r in good.collect()) == ["1", "2"]
    assert bad.count() == 1


def test_golden_csv_keeps_zeros(spark, tmp_path):
    (tmp_path / "g.csv").write_text("SAQA ID,Name\n00123,x\n")
    assert files.read_golden(spark, str(tmp_path / "g.csv")).first()["SAQA ID"] == "00123"


def test_profiles_from_a_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(OCCUPATIONS))
    (tmp_path / "b.json").write_text("{broken")
    packs = load_profiles(str(tmp_path))
    assert packs == [PACKS[1]]
    assert get_profile(packs, "occupations_high_demand").primary_key == ("ofo_code", "province")
    assert get_profile(packs, "none") is None
    assert profile_fields_frame(spark, packs).filter("alias = 'rank'").first()["field"] == "demand_rank"


def records(spark):
    df = spark.createDataFrame([(1, "O'Neil", None, 1.5, True, ["a", "b's"]), (2, "x", 7, None, None, None)], "id int, order string, value int, price double, ok boolean, tags array<string>")
    return provenance.attach_provenance(df, F.lit("d.pdf"), F.lit(2), F.col("id"), F.lit("m"), F.lit(0.5))


def test_csv_and_json_export(spark, tmp_path):
    df = records(spark)
    sinks.export(df.coalesce(1), str(tmp_path / "c"), "csv", selected=["id", "order"])
    lines = texts(tmp_path / "c").splitlines()
    assert lines == ["id,order,_prov_doc,_prov_page,_prov_confidence,_prov_status", "1,O'Neil,d.pdf,2,0.5,source_extracted", "2,x,d.pdf,2,0.5,source_extracted"]
    sinks.export(df, str(tmp_path / "j"), " JSON ", include_provenance=False)
    back = spark.read.json(str(tmp_path / "j"))
    assert "_prov_doc" not in back.columns and back.count() == 2
    sinks.export(df, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pytest.raises(ValueError):
        sinks.export(df, str(tmp_path / "x"), "doc")
    sinks.register_exporter("orc", lambda frame, path: frame.write.mode("overwrite").orc(path))
    assert sinks.export_all({"a": df}, str(tmp_path / "all"), "orc") == [f"{tmp_path}/all/a.orc"]
    assert spark.read.orc(str(tmp_path / "all/a.orc")).count() == 2


def test_empty_dataset_keeps_its_columns(spark, tmp_path):
    sinks.export(records(spark).filter("false"), str(tmp_path / "e"), "parquet")
    assert "order" in spark.read.parquet(str(tmp_path / "e")).columns


def test_json_envelope(spark, tmp_path):
    df = records(spark).drop("_prov")
    sinks.export_json_with_envelope(df, str(tmp_path), "d", sinks.fields_of(df), {"project": "p"})
    head = json.loads(texts(tmp_path / "d/envelope"))
    assert head["record_count"] == 2 and head["metadata"]["project"] == "p" and len(head["columns"]) == 6


def test_sql_script(spark, tmp_path):
    df = records(spark).drop("_prov")
    fields = sinks.fields_of(df, required=["id"])
    child = spark.createDataFrame([(1, "c")], "id int, name string")
    sinks.write_sql(
        {"group": (df.coalesce(1), fields, ["id"]), "items": (child, sinks.fields_of(child), [])},
        str(tmp_path),
        [
            {"parent_dataset": "group", "child_dataset": "items", "parent_key": "id", "foreign_key": "id"},
            {"parent_dataset": "group", "child_dataset": "other", "parent_key": "id", "foreign_key": "id", "is_accepted": False},
        ],
    )
    ddl = texts(tmp_path / "ddl")
    assert 'CREATE TABLE IF NOT EXISTS "group" (' in ddl and 'CONSTRAINT "pk_group" PRIMARY KEY ("id")' in ddl
    assert '"order" TEXT NULL' in ddl and '"id" INTEGER NOT NULL' in ddl and '"tags" TEXT[] NULL' in ddl
    lines = texts(tmp_path / "data/group").splitlines()
    assert lines[0].endswith("VALUES (1, 'O''Neil', NULL, 1.5, TRUE, ARRAY['a', 'b''s']::TEXT[]);")
    assert lines[1].endswith("VALUES (2, 'x', 7, NULL, NULL, NULL);")
    keys = texts(tmp_path / "keys")
    assert keys.count("FOREIGN KEY") == 1 and "ON DELETE CASCADE" in keys


def test_bundle(spark, tmp_path):
    df = records(spark).withColumn("status", F.lit("valid"))
    dictionary = provenance.data_dictionary(df, [Field("order")], "id")
    manifest = provenance.bundle_manifest(provenance.bundle_counts(df), "d.pdf", "h", 2, ["d"], ["m"], "p", "1")
    sinks.write_bundle(dictionary, provenance.provenance_rows(df, "id"), manifest, str(tmp_path))
    assert json.loads(texts(tmp_path / "extraction_manifest"))["records_verified"] == 2
    assert "order" in texts(tmp_path / "data_dictionary")
    assert texts(tmp_path / "provenance").count("d.pdf") == 2
    issues = rules.validate(df, [], "id")
    sinks.write_issues(issues, rules.summarize(issues), str(tmp_path / "v"))
    assert json.loads(texts(tmp_path / "v/summary"))["total_issues"] == 0


def test_saved_datasets_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.save_datasets(spark.createDataFrame([("a", 1), ("b", 1)], "dataset string, v int"), path)
    sinks.save_datasets(spark.createDataFrame([("b", 2)], "dataset string, v int"), path)
    assert sorted((r["dataset"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]
    kept = sinks.valid_records(spark.createDataFrame([(1, "valid"), (2, "error"), (0, "human_reviewed")], "row_index int, status string"))
    assert [r["row_index"] for r in kept.collect()] == [0, 1]


HEAD = ["SAQA ID", "Qualification Title", "NQF Level", "Sub-Framework", "NSFAS", "Participating Colleges"]


def qualification_rows(spark):
    lines = [
        ["118792", "AI Developer", "5", "OQSF", "Yes", "Motheo TVET; Umfolozi TVET"],
        ["118793", "Cloud Engineer", "15", "OQSF", "No", "Orbit TVET"],
        ["118792", "AI Developer", "5", "OQSF", "Yes", "Sedibeng TVET"],
        ["102145", "N/A", "4", "HEQSF", "no", ""],
    ]
    rows = [("d", 1, 0, i, HEAD, c, i) for i, c in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id string, page int, table_index int, row_idx long, headers array<string>, cells array<string>, row_index long")


@pytest.mark.parametrize("written", [False, True])
def test_run(spark, tmp_path, written):
    done = workflow.run(
        qualification_rows(spark), "qualifications", PACKS[3], headers=HEAD,
        work_dir=str(tmp_path / "w") if written else None,
    )
    assert done.primary_key == ["saqa_id"]
    assert set(done.datasets) == {"qualifications", "qualification_colleges"}
    assert sorted(r["saqa_id"] for r in done.datasets["qualifications"].collect()) == ["102145", "118792", "118793"]
    child = done.datasets["qualification_colleges"]
    assert sorted(tuple(r) for r in child.select("saqa_id", "college_name").collect()) == [("118792", "Motheo TVET"), ("118792", "Umfolozi TVET"), ("118793", "Orbit TVET")]
    assert {r["_prov"]["source_document"] for r in child.collect()} == {r["_prov"]["source_document"] for r in done.datasets["qualifications"].collect()}
    assert {(r["record_id"], r["field"]) for r in done.issues.collect()} == {(1, "nqf_level"), (3, "qualification")}
    assert done.summary.first()["critical_count"] == 2
    assert 0 < done.quality.first()["overall_score"] < 100
    paths = done.export(str(tmp_path / "out"), "csv")
    assert len(paths) == 2 and spark.read.csv(paths[1], header=True).count() == 3


def test_run_without_pack(spark):
    df = spark.createDataFrame([(i, f"0{i}", str(i), "x, y, z") for i in range(40)], "row_index long, `Item Code` string, Amount string, Tags string")
    done = workflow.run(df, "items")
    assert [(f.name, f.data_type) for f in done.fields] == [("item_code", "STRING"), ("amount", "INTEGER"), ("tags", "LIST")]
    assert set(done.datasets) == {"items", "items_items"} and done.datasets["items_items"].count() == 120


def test_inspect(spark):
    pages = spark.createDataFrame([("a", 1, "SAQA ID and NQF Level " * 20, 0, 9, 1)], "doc_id string, page int, text string, images int, drawings int, tables int")
    names = spark.createDataFrame([("a", "list.pdf"), ("b", "none.pdf")], "doc_id string, filename string")
    found = {r["doc_id"]: r["classification"]["recommended_extractor"] for r in workflow.inspect(pages, names, PACKS).collect()}
    assert found == {"a": "qualifications", "b": "pdf_tables"}


def test_rebuild(spark):
    rows = spark.createDataFrame(
        [("d", 1, 0, 0, ["Code", "Name"]), ("d", 1, 0, 1, ["1", "a\nb"]), ("d", 1, 0, 2, ["", None]), ("d", 2, 0, 0, ["Code", "Name"]), ("d", 2, 0, 1, ["2", "c"])],
        "doc_id string, page int, table_index int, row_idx long, cells array<string>",
    )
    out = workflow.rebuild(rows).orderBy("page", "row_idx").collect()
    assert [r["cells"] for r in out] == [["1", "a b"], ["2", "c"]]


def test_raw_rows_to_datasets(spark):
    lines = [
        (1, 0, HEAD), (1, 1, ["118792", "AI Developer", "5", "OQSF", "Yes", "Motheo TVET; Umfolozi TVET"]),
        (1, 2, ["", "(new)", "", "", "", ""]), (1, 3, ["Page 1 of 2"]),
        (2, 0, HEAD), (2, 1, ["102145", "Solar Technician", "4", "OQSF", "No", "Orbit TVET"]),
    ]
    raw = spark.createDataFrame([("d", p, 0, i, c) for p, i, c in lines], "doc_id string, page int, table_index int, row_idx long, cells array<string>")
    done = workflow.run(workflow.rebuild(raw), "qualifications", PACKS[3])
    parent = sorted((r["saqa_id"], r["qualification"], r["_prov"]["source_page"]) for r in done.datasets["qualifications"].collect())
    assert parent == [("102145", "Solar Technician", 2), ("118792", "AI Developer (new)", 1)]
    assert done.datasets["qualification_colleges"].count() == 3
    assert done.summary.first()["total_issues"] == 0
    with pytest.raises(ValueError):
        workflow.run(workflow.rebuild(raw).filter("false"), "none")


def test_streams_equal_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(i % 5, f" v{i % 3} ", f"2024-01-01 0{i % 9}:00:00") for i in range(60)]
    df = spark.createDataFrame(rows, "k int, v string, t string").withColumn("ts", F.to_timestamp("t"))
    df.repartition(4).write.parquet(source)
    stream = lambda: flows.file_stream(spark, source, df.schema, maxFilesPerTrigger=1)

    fields = [Field("v", required=True), Field("k", data_type="FLOAT"), Field("t", data_type="INTEGER")]
    for _ in range(2):  # a second start finds nothing new
        flows.validation_split(stream(), fields, "k", str(tmp_path / "r"), str(tmp_path / "i"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "r")).count() == 60
    assert spark.read.parquet(str(tmp_path / "i")).count() == rules.validate_records(df, fields).select(F.explode("issues")).count() == 60

    firsts = flows.first_seen(stream(), ["k", "v"], "ts", "2 days")
    flows.append(firsts, str(tmp_path / "f"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "f")).count() == df.select("k", "v").distinct().count()

    for _ in range(2):
        rate = flows.activity_rate(stream(), "ts", ["k"], late="1 day")
        flows.latest_totals(rate, str(tmp_path / "a"), str(tmp_path / "c3")).awaitTermination()
    totals = flows.current_totals(spark, str(tmp_path / "a"), ["window_start", "window_end", "k"])
    batch = flows.activity_rate(df, "ts", ["k"], late=None)
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, batch.select(totals.columns).collect()))
    assert flows.activity_rate(df, "ts", ["k"], "2 hours", "1 hour", late=None).agg(F.sum("rows")).first()[0] == 120
    assert flows.activity_rate(df, "ts", ["k"], "30 minutes", late=None, session=True).agg(F.sum("rows")).first()[0] == 60
