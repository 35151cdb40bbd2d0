"""One run over the rows of all layouts: fields, types, keys and rules are data, joined by dataset.

`workflow.run` takes one layout whose columns are known to the driver. Here the
cells are rows (dataset, record, field, value), so any number of datasets and
layouts go through the same plan: nothing loops over datasets and nothing about
them is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.functions import fixed
from doctables.functions.cells import changed, kind_of, normal_form
from doctables.functions.lists import split_items
from doctables.functions.names import dataset_name, display_name, fill_header, snake_case, unique_names
from doctables.functions.text import clean_unicode, collapse, digits_only, is_blank, strip
from doctables.operators import quality, rules, schema
from doctables.plans.durable import durable
from doctables.plans.skew import first_per_key
from doctables.sources.profiles import Profile

FEW = 20_000
RECORD = "struct(cast(doc_id as string) as doc_id, page, table_index, row_idx, cast(0 as int) as item)"
PACK = (
    "profile string, name string, place int, display_name string, pack_type string, pack_required boolean, pattern string, "
    "low double, high double, low_text string, high_text string, allowed array<string>, pack_key boolean"
)


@dataclass
class Runs:
    """Frames of all datasets. Those that later steps read again are written to shared storage."""

    fields: DataFrame  #: dataset, field, position, data_type, required, is_primary_key, …
    cells: DataFrame  #: dataset, record, field, position, raw, norm, kind, is_modified: parents and children
    children: DataFrame  #: dataset, parent_dataset, record, key_field, key, item_field, item
    relationships: DataFrame
    issues: DataFrame
    summary: DataFrame  #: per dataset, and with dataset NULL over all
    quality: DataFrame


def _beside(small: DataFrame) -> DataFrame:
    """A frame about layouts or fields, written once; up to `FEW` rows of it go to every task, so that no row moves to meet it."""
    small = durable(small)
    return F.broadcast(small) if small.limit(FEW + 1).count() <= FEW else small


def _any_of(text: Column, terms: Sequence[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | F.lower(text).contains(term)
    return found


def named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Add `dataset` and `profile` to rows, from docs (doc_id, filename, recommended_extractor, profile, profile_dataset)."""
    by_doc = docs.select("doc_id", "profile", dataset_name(F.col("filename"), F.col("recommended_extractor"), F.col("profile_dataset")).alias("dataset"))
    return rows.join(by_doc, "doc_id")


def packs(spark, profiles: Sequence[Profile]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rule packs as tables: fields, aliases (later ones win), and the name of the child dataset."""
    fields, aliases, children = [], {}, []
    text = lambda bound: None if bound is None else str(bound)
    number = lambda bound: None if bound is None else float(bound)
    for p in profiles:
        for i, f in enumerate(p.fields):
            fields.append(
                (
                    p.name, f.name, i, f.display_name or f.name, f.data_type, f.required, f.pattern, number(f.min_value), number(f.max_value),
                    text(f.min_value), text(f.max_value), [str(v) for v in f.allowed_values] or None, f.name in p.primary_key,
                )
            )
            for alias in (f.name, f.display_name, *f.aliases):
                aliases[p.name, alias.lower()] = f.name
        if len(p.datasets) > 1:
            children.append((p.name, p.datasets[1][0]))
    return (
        spark.createDataFrame(fields, PACK),
        spark.createDataFrame([(*k, v) for k, v in aliases.items()], "profile string, alias string, name string"),
        spark.createDataFrame(children, "profile string, child string"),
    )


def layout_fields(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(dataset, profile, headers, names): the field names of each layout, by position."""
    layouts = rows.select("dataset", "profile", "headers").distinct()
    each = layouts.select("*", F.posexplode("headers").alias("position", "header")).withColumn("header", fill_header(F.col("header"), F.col("position")))
    each = each.withColumns({"alias": F.lower("header"), "plain": snake_case(F.col("header"))})
    exact = aliases.select("profile", "alias", F.col("name").alias("by_alias"))
    plain = aliases.select("profile", F.col("alias").alias("plain"), F.col("name").alias("by_plain"))
    each = each.join(exact, ["profile", "alias"], "left").join(plain, ["profile", "plain"], "left")
    each = each.withColumn("name", F.coalesce("by_alias", "by_plain", "plain"))
    each = unique_names(each, ["dataset", "headers"], "position", "name")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "header"))), lambda f: F.struct(f["name"], f["header"]))
    return each.groupBy("dataset", "headers").agg(listed.alias("names"))


def long_cells(rows: DataFrame, layouts: DataFrame) -> DataFrame:
    """One row per record and field of its layout, with the normal form; short rows are filled with NULL."""
    # Small files give few tasks; the records are spread before they become cells, and later steps find them by record.
    joined = rows.join(layouts, ["dataset", "headers"]).select("dataset", "profile", F.expr(RECORD).alias("record"), "cells", "names")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = joined.repartition(tasks, "dataset", "record")
    cells = joined.select("dataset", "profile", "record", "cells", F.posexplode("names").alias("position", "column"))
    cells = cells.select(
        "dataset", "profile", "record", "position", F.col("column.name").alias("field"), F.col("column.header").alias("header"),
        F.get("cells", F.col("position")).alias("raw"),
    )
    cells = cells.withColumn("clean", collapse(clean_unicode(F.col("raw"))))
    code, place = _any_of(F.col("field"), fixed.CODE_TERMS), _any_of(F.col("field"), fixed.PROVINCE_TERMS)
    clean = F.col("clean")
    kind = (
        F.when(code & place, kind_of(clean, True, True))
        .when(code, kind_of(clean, True, False))
        .when(place, kind_of(clean, False, True))
        .otherwise(kind_of(clean, False, False))
    )
    cells = cells.withColumn("kind", kind).withColumn("norm", normal_form(clean, F.col("kind")))
    cells = cells.withColumn("is_modified", changed(F.col("raw"), clean, F.col("kind"), F.col("norm"))).drop("clean")
    return cells.withColumn("kind", F.when(F.col("kind") == "province", "str").otherwise(F.col("kind")))


def field_table(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields of all datasets from one grouped vote over their cells; what a pack says wins."""
    names = ("rows", "filled", "bools", "ints", "floats", "lists")
    counts = cells.groupBy("dataset", "field").agg(
        F.min("position").alias("position"), F.min_by("header", "record").alias("header"), F.min_by("profile", "record").alias("profile"),
        *[part.alias(name) for part, name in zip(schema.vote_counts(F.col("norm"), F.col("kind")), names)],
    )
    own = schema.voted(counts, ["dataset", "field", "position", "header", "profile"])
    packed = own.join(fields.withColumnRenamed("name", "field").withColumnRenamed("display_name", "pack_name"), ["profile", "field"], "left")
    keyed = F.col("field").isin("id", "saqa_id", "ofo_code", "variable_name") | F.contains("field", F.lit("code"))
    packs_key = packed.groupBy("dataset").agg(F.bool_or(F.coalesce("pack_key", F.lit(False))).alias("key_from_pack"))
    known = F.col("place").isNotNull()
    return packed.join(packs_key, "dataset").select(
        "dataset", "field", "position", "header", "profile",
        F.coalesce("pack_name", "header").alias("display_name"),
        F.coalesce("pack_type", "data_type").alias("data_type"),
        F.when(known, 0.99).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce("pack_required", "required").alias("required"),
        F.when(F.col("key_from_pack"), F.coalesce("pack_key", F.lit(False))).otherwise(~known & keyed).alias("is_primary_key"),
        "pattern", "low", "high", "low_text", "high_text", "allowed",
    )


def first_records(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """(dataset, record): the first record of every key; all fields are the key of a dataset without one."""
    some = fields.groupBy("dataset").agg(F.bool_or("is_primary_key").alias("keyed"))
    marks = fields.join(some, "dataset").filter("is_primary_key or not keyed").select("dataset", "field")
    part = cells.join(_beside(marks), ["dataset", "field"])
    keys = part.groupBy("dataset", "record").agg(F.array_sort(F.collect_list(F.struct("field", "norm"))).alias("key"))
    return first_per_key(keys, ["dataset", "key"], ["record"]).select("dataset", "record")


def list_fields(cells: DataFrame, fields: DataFrame, children: DataFrame, share: float = 0.35) -> DataFrame:
    """(dataset, list_field, key_field, child, item_field) of the datasets that hold lists beside a key."""
    filled = F.coalesce(F.col("norm"), F.lit("")) != ""
    many = F.contains("norm", F.lit(";")) | F.contains("norm", F.lit(","))
    shares = cells.groupBy("dataset", "field").agg(
        F.min("position").alias("position"), (F.count_if(filled & many) / F.nullif(F.count_if(filled), F.lit(0))).alias("share")
    )
    lists = shares.filter(F.col("field").isin(*fixed.KNOWN_LIST_COLUMNS) | (F.col("share") >= share))
    lists = lists.groupBy("dataset").agg(F.min_by("field", "position").alias("list_field"))
    keys = fields.filter("is_primary_key").groupBy("dataset").agg(F.min_by("field", "position").alias("key_field"), F.min("profile").alias("profile"))
    college = F.contains("list_field", F.lit("college"))
    own = F.concat("dataset", F.when(college, "_colleges").otherwise("_items"))
    return lists.join(keys, "dataset").join(children, "profile", "left").select(
        "dataset", "list_field", "key_field", F.coalesce("child", own).alias("child"), F.when(college, "college_name").otherwise("item_name").alias("item_field")
    )


def decomposed(cells: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of the parents, without their list fields, and the child rows, for all datasets at once.

    One parent per key stays, the first; a record without key stays when another
    cell is filled. Of equal items of a key the first stays.
    """
    marked = cells.join(lists, "dataset", "left")
    is_key = F.col("field") == F.col("key_field")
    is_list = F.col("field") == F.col("list_field")
    filled = ~is_blank(F.col("norm"))
    records = marked.groupBy("dataset", "record").agg(
        F.max(F.col("list_field").isNotNull()).alias("listed"),
        F.max(F.when(is_key, F.col("norm"))).alias("key"),
        F.bool_or(filled & ~is_key & ~is_list).alias("other"),
        F.max(F.when(is_list, F.col("raw"))).alias("items"),
        *[F.max(c).alias(c) for c in ("child", "key_field", "item_field")],
    )
    whole = records.filter("not listed").select("dataset", "record")
    keyed = first_per_key(records.filter(F.col("listed") & ~is_blank(F.col("key"))), ["dataset", "key"], ["record"]).select("dataset", "record")
    loose = records.filter(F.col("listed") & is_blank(F.col("key")) & F.col("other")).select("dataset", "record")
    parents = marked.filter(~F.coalesce(is_list, F.lit(False))).select(cells.columns)
    parents = parents.join(whole.union(keyed).union(loose), ["dataset", "record"], "left_semi")
    place = lambda i: F.struct(*[F.col("record")[name].alias(name) for name in ("doc_id", "page", "table_index", "row_idx")], (i + 1).cast("int").alias("item"))
    items = F.transform(split_items(F.col("items")), lambda item, i: F.struct(place(i).alias("record"), item.alias("item")))
    rows = records.filter("listed").select(
        F.col("child").alias("dataset"), F.col("dataset").alias("parent_dataset"), "key_field", "key", "item_field", items.alias("items")
    )
    rows = rows.select("dataset", "parent_dataset", "key_field", "key", "item_field", F.inline("items"))
    return parents, first_per_key(rows, ["dataset", "key", "item"], ["record"])


def child_cells(children: DataFrame) -> DataFrame:
    """Children in the form of `long_cells`."""
    cell = lambda place, field, value: F.struct(
        F.lit(place).alias("position"), F.col(field).alias("field"), F.col(value).alias("raw"), F.col(value).alias("norm"),
        F.when(F.col(value).isNull(), "null").otherwise("str").alias("kind"), F.lit(False).alias("is_modified"),
    )
    return children.select("dataset", "record", F.inline(F.array(cell(0, "key_field", "key"), cell(1, "item_field", "item"))))


def child_fields(lists: DataFrame) -> DataFrame:
    field = lambda place, name: F.struct(F.col(name).alias("field"), F.lit(place).alias("position"), display_name(F.col(name)).alias("display_name"))
    return lists.select(F.col("child").alias("dataset"), F.inline(F.array(field(0, "key_field"), field(1, "item_field")))).select(
        "*", F.col("field").alias("header"), F.lit("STRING").alias("data_type"), F.lit(1.0).alias("confidence"), F.lit(True).alias("required"),
        F.lit(False).alias("is_primary_key"),
    ).distinct()


def rule_table(fields: DataFrame) -> DataFrame:
    """Rules (dataset, field, rule_type, …) that follow from names and constraints, as `rules.default_rules` makes them."""
    name, label = F.col("field"), F.col("display_name")
    nqf = F.col("low").isNull() & F.col("high").isNull() & F.contains("field", F.lit("nqf"))
    bound = lambda column, value: F.when(nqf, F.lit(value)).otherwise(F.coalesce(F.col(column), F.lit("None")))
    low_text, high_text = bound("low_text", "1"), bound("high_text", "10")
    shown = F.when(nqf, F.lit("NQF Level")).otherwise(label)
    none = F.lit(None).cast("string")

    def rule(prefix: str, title: Column, kind: str, pattern: Column = none) -> Column:
        return F.struct(
            F.concat(F.lit(prefix), name).alias("rule_id"), title.alias("rule_name"), F.lit(kind).alias("rule_type"), pattern.alias("rule_pattern"),
            F.when(nqf, 1.0).otherwise(F.col("low")).alias("rule_low"), F.when(nqf, 10.0).otherwise(F.col("high")).alias("rule_high"),
            F.concat(F.lit("["), low_text, F.lit(", "), high_text, F.lit("]")).alias("bounds"), F.col("allowed").alias("rule_values"),
        )

    own = F.col("pattern").isNotNull() & (F.col("pattern") != "")
    found = F.array(
        F.when(F.col("required") | F.col("is_primary_key"), rule("req_", F.concat(F.lit("Required field: "), label), "required")),
        F.when(own, rule("regex_", F.concat(F.lit("Format of "), label), "regex", F.col("pattern")))
        .when(F.contains("field", F.lit("saqa")), rule("saqa_regex_", F.lit("SAQA ID must be 4–7 numeric digits"), "regex", F.lit(r"^\d{4,7}$")))
        .when(F.contains("field", F.lit("ofo")), rule("ofo_regex_", F.lit("OFO Code must be 4–6 numeric digits"), "regex", F.lit(r"^\d{4,6}$"))),
        F.when(
            nqf | F.col("low").isNotNull() | F.col("high").isNotNull(),
            rule("range_", F.concat(shown, F.lit(" must be between "), low_text, F.lit(" and "), high_text), "range"),
        ),
        F.when(F.size("allowed") > 0, rule("allowed_", F.concat(F.lit("Allowed values of "), label), "allowed_values")),
    )
    return fields.select("dataset", "field", F.inline(F.filter(found, lambda r: r.isNotNull())))


def issues_of(cells: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Issues of all datasets: cells joined with their rules, each tested by its type and parameters."""
    value, kind = F.col("norm"), F.col("rule_type")
    text = strip(value)
    digits = digits_only(text)
    pattern = F.concat(F.lit("^(?:"), F.col("rule_pattern"), F.lit(")"))
    number = F.when(F.regexp_like(text, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")), text.try_cast("double"))
    outside = F.coalesce(number < F.col("rule_low"), F.lit(False)) | F.coalesce(number > F.col("rule_high"), F.lit(False))
    some = value.isNotNull()
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    # The texts of the issues, as in `operators.rules`.
    message = (
        F.when((kind == "required") & is_blank(value), say("Missing required value for '", F.col("field"), "'"))
        .when((kind == "regex") & some & ~F.regexp_like(text, pattern), say("Value '", text, "' does not match expected format"))
        .when((kind == "range") & some & number.isNull(), say("Value '", value, "' is not numeric for range check"))
        .when((kind == "range") & outside, say("Value ", number.cast("string"), " outside valid range ", F.col("bounds")))
        .when((kind == "allowed_values") & some & ~F.array_contains("rule_values", value), say("Value '", value, "' is not an allowed value"))
    )
    fix = F.when((kind == "regex") & F.regexp_like(digits, pattern), digits)
    return (
        cells.join(rule_rows, ["dataset", "field"])
        .withColumns({"message": message, "suggested_fix": fix})
        .filter("message is not null")
        .select(
            "dataset", F.col("record").alias("record_id"), "field",
            F.when((kind == "range") & number.isNull(), rules.WARNING).otherwise(rules.CRITICAL).alias("severity"),
            "rule_id", "rule_name", "message", value.alias("current_value"), "suggested_fix", F.col("suggested_fix").isNotNull().alias("is_auto_fixable"),
        )
    )


def quality_of(cells: DataFrame, fields: DataFrame, summary: DataFrame, extraction: float = 0.95) -> DataFrame:
    """Quality scores per dataset, from one grouped count of its cells and its issues."""
    per_record = cells.groupBy("dataset", "record").agg(
        F.count_if(~is_blank(F.col("norm"))).alias("filled"), F.count_if("is_modified").alias("modified")
    )
    counts = per_record.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total_records"), F.sum("filled").alias("filled_cells"), F.sum("modified").alias("modified_cells")
    )
    columns = fields.groupBy("dataset").agg(F.count(F.lit(1)).alias("total_columns"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = counts.join(columns, "dataset").join(summary.filter("dataset is not null"), "dataset", "left")
    joined = joined.select(
        "dataset", "total_records", "filled_cells", "modified_cells", "total_columns", (F.col("total_records") * F.col("total_columns")).alias("total_cells"),
        zero("critical_count"), zero("warning_count"),
    )
    return quality.scores(joined, extraction, ["dataset"])


def run_all(rows: DataFrame, profiles: Sequence[Profile] = (), extraction: float = 0.95) -> Runs:
    """Normalise, infer, deduplicate, decompose, validate and score the rows of all layouts in one plan.

    `rows`: raw rows with `headers`, `cells` and `dataset` (see `named`), and
    optionally `profile`, the name of a rule pack. Rows of one dataset may have
    several layouts, also from several documents: their records are united by field
    name. Rows without headers get `Col_1`, `Col_2`, …; rows with neither give
    nothing. Fields that a record's layout lacks are no cells of it, and no rule
    looks for them. Normal cells, fields and parents are read by several later steps,
    so each is written once to the checkpoint folder.
    """
    spark = rows.sparkSession
    fields_of_packs, aliases, children_of_packs = packs(spark, profiles)
    if "profile" not in rows.columns:
        rows = rows.withColumn("profile", F.lit(None).cast("string"))
    counted = F.transform(F.sequence(F.lit(1), F.greatest(F.size("cells"), F.lit(1))), lambda i: F.concat(F.lit("Col_"), i.cast("string")))
    rows = rows.withColumn("headers", F.when(F.size("headers") > 0, F.col("headers")).when(F.size("cells") > 0, counted)).filter("headers is not null and dataset is not null")
    cells = durable(long_cells(rows, _beside(layout_fields(rows, aliases))))
    found = durable(field_table(cells, fields_of_packs))
    cells = durable(cells.join(first_records(cells, found), ["dataset", "record"], "left_semi").drop("header", "profile"))
    lists = _beside(list_fields(cells, found, children_of_packs))
    parents, children = decomposed(cells, lists)
    children = durable(children)
    kept = found.join(lists.select("dataset", F.col("list_field").alias("field")), ["dataset", "field"], "left_anti")
    fields = kept.unionByName(child_fields(lists), allowMissingColumns=True)
    all_cells = durable(parents.unionByName(child_cells(children)))
    issues = durable(issues_of(all_cells, _beside(rule_table(fields))))
    summary = rules.summarize_datasets(issues)
    relationships = lists.select(
        F.concat("dataset", F.lit("_to_"), "child").alias("name"), F.col("dataset").alias("parent_dataset"), F.col("child").alias("child_dataset"),
        F.col("key_field").alias("parent_key"), F.col("key_field").alias("foreign_key"), F.lit(True).alias("is_accepted"),
    )
    return Runs(fields, all_cells, children, relationships, issues, summary, quality_of(all_cells, fields, summary, extraction))
