"""Compare two editions, two extractions, or an extraction with a golden table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.functions import fixed
from doctables.functions.text import first_filled, strip
from doctables.plans.scan import number_rows
from doctables.plans.skew import first_per_key, spread_nulls


def shown(value: Column) -> Column:
    """Text a value is compared by; NULL and blank are the same."""
    return strip(F.coalesce(value.cast("string"), F.lit("")))


def folded(value: Column) -> Column:
    return F.lower(shown(value))


def comparable(columns: Sequence[str]) -> list[str]:
    """Columns that hold data, not marks about it."""
    return [c for c in columns if not c.startswith("_") and c not in fixed.META_FIELDS]


def _keyed(df: DataFrame, key: Column, order: str | None, columns: Sequence[str]) -> DataFrame:
    """One row per non-blank key, the last one by `order`; values in a struct."""
    at = F.col(order) if order else F.lit(0)
    rows = df.select(key.alias("_key"), at.alias("_at"), F.struct(*columns).alias("_row"))
    # Without an order any row may stand for its key, but always the same one.
    last = [F.desc("_at")] if order else [F.xxhash64("_row")]
    return first_per_key(rows.filter(F.coalesce("_key", F.lit("")) != ""), ["_key"], last)


def comparison_key(columns: Sequence[str], primary_key: Sequence[str] = (), key: str | None = None) -> str:
    if key:
        return key
    return primary_key[0] if primary_key else columns[0] if columns else "id"


def dataset_diff(
    old: DataFrame, new: DataFrame, key: str, order: str | None = None, unchanged: bool = False
) -> DataFrame:
    """ADDED, REMOVED and MODIFIED keys with their fields and values.

    The last row of a key counts. Keys and values compare as stripped text. With
    `unchanged`, equal keys are listed too.
    """
    skip = {order} if order else set()
    old_columns = [c for c in old.columns if c not in skip]
    new_columns = [c for c in new.columns if c not in skip]
    common = [c for c in old_columns if c in new_columns]
    joined = (
        _keyed(old, shown(F.col(key)), order, old_columns)
        .select("_key", F.col("_row").alias("_old"))
        .join(
            _keyed(new, shown(F.col(key)), order, new_columns).select(
                "_key", F.col("_row").alias("_new")
            ),
            "_key",
            "full_outer",
        )
    )
    before, after = F.col("_old"), F.col("_new")
    differs = [
        F.when(shown(before[c]) != shown(after[c]), F.lit(c)) for c in sorted(common)
    ]
    changed = F.filter(F.array(*differs), lambda c: c.isNotNull())

    def values(row: Column, columns: Sequence[str]) -> Column:
        pairs = [F.lit(c) if i == 0 else row[c].cast("string") for c in columns for i in (0, 1)]
        return F.create_map(*pairs)

    staged = joined.withColumn("changed_fields", F.when(before.isNotNull() & after.isNotNull(), changed))
    kind = (
        F.when(before.isNull(), "ADDED")
        .when(after.isNull(), "REMOVED")
        .when(F.size("changed_fields") > 0, "MODIFIED")
        .otherwise("UNCHANGED")
    )
    in_changed = lambda name, _: F.array_contains("changed_fields", name)
    staged = staged.withColumn("diff_type", kind)
    if not unchanged:
        staged = staged.filter("diff_type <> 'UNCHANGED'")
    return staged.select(
        F.col("_key").alias("key"),
        "diff_type",
        F.coalesce("changed_fields", F.array().cast("array<string>")).alias("changed_fields"),
        F.when(F.col("diff_type") == "REMOVED", values(before, old_columns))
        .when(F.col("diff_type") == "MODIFIED", F.map_filter(values(before, common), in_changed))
        .alias("old_values"),
        F.when(F.col("diff_type") == "ADDED", values(after, new_columns))
        .when(F.col("diff_type") == "MODIFIED", F.map_filter(values(after, common), in_changed))
        .alias("new_values"),
    )


def diff_counts(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Number of keys per difference, equal keys included."""
    return (
        dataset_diff(old, new, key, order, unchanged=True)
        .groupBy("diff_type")
        .agg(F.count(F.lit(1)).alias("records"))
    )


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns that are new, removed or common."""
    rows = [
        (c, "common" if c in old.columns and c in new.columns else "new" if c in new.columns else "removed")
        for c in sorted({*old.columns, *new.columns})
    ]
    return old.sparkSession.createDataFrame(rows, "column_name string, change string")


def key_sets(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys with the side they occur on: added, removed, common."""
    sides = (
        old.select(shown(F.col(key)).alias("key"), F.lit(1).alias("o"), F.lit(0).alias("n"))
        .unionByName(new.select(shown(F.col(key)).alias("key"), F.lit(0).alias("o"), F.lit(1).alias("n")))
        .filter("key <> ''")
        .groupBy("key")
        .agg(F.max("o").alias("o"), F.max("n").alias("n"))
    )
    side = F.when(F.col("o") == 0, "added").when(F.col("n") == 0, "removed").otherwise("common")
    return sides.select("key", side.alias("side"))


def identifier(columns: Sequence[str]) -> Column:
    """First filled identifier field, then title field, in lower case."""
    wanted = [
        c for c in (*fixed.RECONCILE_ID_FIELDS, *fixed.RECONCILE_TITLE_FIELDS) if c in columns
    ]
    if not wanted:
        return F.lit(None).cast("string")
    return F.lower(first_filled(*[F.col(c) for c in wanted]))


def match_extractions(
    a: DataFrame, b: DataFrame, key_a: Column, key_b: Column, order: str, order_b: str | None = None
) -> DataFrame:
    """Rows of A with the last row of B of the same identifier.

    Columns: `_key`, `row_index` (order in A), `a` and `b` (structs, `b` NULL without
    a match). Rows of A without an identifier are spread over all tasks.
    """
    left = a.select(
        key_a.alias("_key"),
        spread_nulls(key_a, F.col(order)).alias("_way"),
        F.col(order).alias("row_index"),
        F.struct(*a.columns).alias("a"),
    )
    right = _keyed(b, key_b, order_b or order, b.columns).select(
        "_key", F.lit(0).cast(left.schema["_way"].dataType).alias("_way"), F.col("_row").alias("b")
    )
    return left.join(right, ["_key", "_way"], "left").drop("_way")


def _pairs(matched: DataFrame, skip: Sequence[str] = ()) -> dict[str, tuple[Column, Column]]:
    a_columns = matched.schema["a"].dataType.names
    b_columns = matched.schema["b"].dataType.names
    names = [c for c in dict.fromkeys([*a_columns, *b_columns]) if c in comparable([c]) and c not in skip]
    none = F.lit(None)
    return {
        c: (
            F.col("a")[c] if c in a_columns else none,
            F.col("b")[c] if c in b_columns else none,
        )
        for c in names
    }


def conflicts(
    matched: DataFrame, model_a: str, model_b: str, skip: Sequence[str] = (), job: str | None = None
) -> DataFrame:
    """One row per field on which the two extractions differ.

    `job` names the column of the first extraction that holds its job; conflicts then
    carry it as `job_id`, so that those of one job can be taken by a filter. It is
    not compared.
    """
    skip = [*skip, job] if job else skip
    page = F.lit(1)
    names = matched.schema["a"].dataType.names
    if "source_page" in names:
        page = F.coalesce(F.col("a")["source_page"], page)
    found = [
        F.when(
            folded(a) != folded(b),
            F.struct(
                F.lit(c).alias("field_name"),
                a.cast("string").alias("value_a"),
                b.cast("string").alias("value_b"),
            ),
        )
        for c, (a, b) in _pairs(matched, skip).items()
    ]
    return (
        matched.filter(F.col("b").isNotNull())
        .select(
            "row_index",
            *([F.col("a")[job].alias("job_id")] if job else []),
            page.alias("source_page"),
            F.inline(F.filter(F.array(*found), lambda c: c.isNotNull())),
        )
        .withColumns(
            {
                "model_a": F.lit(model_a),
                "model_b": F.lit(model_b),
                "resolution": F.lit("requires_review"),
            }
        )
    )


def agreement(matched: DataFrame, total_b: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Records per side, matched records, compared and equal fields, agreement in percent.

    `total_b`: the B side, only counted. Without B records all of A counts as matched.
    """
    pairs = _pairs(matched, skip)
    equal = sum(((folded(a) == folded(b)).cast("long") for a, b in pairs.values()), F.lit(0))
    has_b = F.col("b").isNotNull()
    stats = matched.agg(
        F.count(F.lit(1)).alias("total_a"),
        F.count_if(has_b).alias("matched"),
        F.coalesce(F.sum(F.when(has_b, equal)), F.lit(0)).alias("equal_fields"),
    )
    both = stats.unionByName(total_b.agg(F.count(F.lit(1)).alias("total_b")), allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    compared = F.col("matched") * len(pairs)
    return one.select(
        F.col("total_a").alias("total_records_a"),
        F.col("total_b").alias("total_records_b"),
        F.when(F.col("total_b") == 0, F.col("total_a")).otherwise(F.col("matched")).alias(
            "matched_records"
        ),
        compared.alias("fields_compared"),
        F.col("equal_fields").alias("fields_equal"),
        F.when(compared > 0, F.bround(F.col("equal_fields") / compared * 100, 2))
        .otherwise(F.lit(100.0))
        .alias("agreement_rate"),
    )


def reconciled(matched: DataFrame, skip: Sequence[str] = (), b_only: DataFrame | None = None) -> DataFrame:
    """Records of A, gaps filled from B, with `__conflict_<field>` marks.

    Rows that only B has are left out unless they are given in `b_only`.
    """
    pairs = _pairs(matched, skip)
    has_b = F.col("b").isNotNull()
    a_columns = matched.schema["a"].dataType.names
    columns = []
    for c in dict.fromkeys([*a_columns, *pairs]):
        if c in pairs:
            a, b = pairs[c]
            same = has_b & (folded(a) == folded(b))
            columns.append(F.when(same, F.coalesce(a, b)).otherwise(a).alias(c))
        else:
            columns.append(F.col("a")[c].alias(c))
    marks = [
        (has_b & (folded(a) != folded(b))).alias(f"__conflict_{c}") for c, (a, b) in pairs.items()
    ]
    out = matched.select(*columns, *marks)
    return out if b_only is None else out.unionByName(b_only, allowMissingColumns=True)


def only_in_b(matched: DataFrame, b: DataFrame, key_b: Column) -> DataFrame:
    """Rows of B whose identifier A does not have."""
    keys = matched.filter(F.col("_key").isNotNull()).select("_key").distinct()
    return b.withColumn("_key", key_b).join(keys, "_key", "left_anti").drop("_key")


def conflicts_to_review(found: DataFrame, agreement_score: Column | None = None) -> DataFrame:
    """Review rows for conflicts."""
    score = F.lit(None) if agreement_score is None else agreement_score
    quote = lambda c: F.concat(F.lit("('"), F.coalesce(c, F.lit("")), F.lit("')"))
    return found.select(
        F.coalesce(
            F.nullif("value_a", F.lit("")), F.nullif("value_b", F.lit("")), F.lit("")
        ).alias("original_value"),
        F.concat(F.lit("model_disagreement_"), "field_name").alias("issue"),
        F.col("source_page").cast("string").alias("source_page"),
        F.concat(
            F.lit("Model disagreement between "), "model_a", F.lit(" "), quote(F.col("value_a")),
            F.lit(" and "), "model_b", F.lit(" "), quote(F.col("value_b")),
        ).alias("reason"),
        score.cast("decimal(5,2)").alias("agreement_score"),
        F.lit(False).alias("resolved"),
    )


def golden_columns(df: DataFrame) -> DataFrame:
    """Golden table with headers in lower case and blanks as underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def golden_key(columns: Sequence[str]) -> str | None:
    """First identifier field the golden table has."""
    return next((k for k in fixed.GOLDEN_ID_FIELDS if k in columns), None)


def _golden_join(golden: DataFrame, actual: DataFrame, key: str | None, order: str | None) -> DataFrame:
    if key is None:
        if order is None:
            raise ValueError("without a key, name the integer column that orders the rows")
        left, right = _placed(golden, order), _placed(actual, order)
    else:
        left = _keyed(golden, folded(F.col(key)), order if order in golden.columns else None, golden.columns)
        right = _keyed(actual, folded(F.col(key)), order if order in actual.columns else None, actual.columns)
    return left.select("_key", F.col("_row").alias("g")).join(
        right.select("_key", F.col("_row").alias("a")), "_key", "full_outer"
    )


def _placed(df: DataFrame, order: str) -> DataFrame:
    """Rows by their place in the order, from 0; numbered block by block."""
    row = F.struct(*df.columns).alias("_row")
    return number_rows(df, order, "_place", start=-1).select(F.col("_place").cast("string").alias("_key"), row)


def _common(golden: DataFrame, actual: DataFrame, order: str | None) -> list[str]:
    return [c for c in comparable(golden.columns) if c in actual.columns and c != order]


def golden_report(golden: DataFrame, actual: DataFrame, key: str | None, order: str | None = None) -> DataFrame:
    """Recall, precision, F1 and field accuracy of an extraction against a golden table.

    Records match by key, the last row of a key counts; without a key the first row
    matches the first, and so on by the integer column `order`. Totals count all rows.
    """
    common = _common(golden, actual, order)
    joined = _golden_join(golden, actual, key, order)
    both = F.col("g").isNotNull() & F.col("a").isNotNull()
    equal = sum(
        ((folded(F.col("g")[c]) == folded(F.col("a")[c])).cast("long") for c in common), F.lit(0)
    )
    stats = joined.agg(
        F.count_if(both).alias("matched"),
        F.count_if(F.col("a").isNull()).alias("missing"),
        F.count_if(F.col("g").isNull()).alias("extra"),
        F.coalesce(F.sum(F.when(both, equal)), F.lit(0)).alias("equal_fields"),
    )
    rows = (
        stats.unionByName(golden.agg(F.count(F.lit(1)).alias("expected")), allowMissingColumns=True)
        .unionByName(actual.agg(F.count(F.lit(1)).alias("actual")), allowMissingColumns=True)
    )
    one = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    fields = F.col("matched") * len(common)
    percent = lambda n, d: F.bround(n / F.greatest(d, F.lit(1)) * 100, 2)
    scored = one.withColumns(
        {
            "recall": percent(F.col("matched"), F.col("expected")),
            "precision": percent(F.col("matched"), F.col("actual")),
        }
    )
    f1 = (
        F.lit(2.0) * F.col("precision") * F.col("recall")
        / F.greatest(F.lit(0.001), F.col("precision") + F.col("recall"))
    )
    return scored.select(
        F.col("expected").alias("total_expected"),
        F.col("actual").alias("total_actual"),
        F.col("matched").alias("matched_records"),
        F.col("missing").alias("missing_records"),
        F.col("extra").alias("extra_records"),
        (fields - F.col("equal_fields")).alias("field_mismatches"),
        F.col("recall").alias("record_recall"),
        F.col("precision").alias("record_precision"),
        F.bround(f1, 2).alias("record_f1"),
        F.when(fields > 0, F.bround(F.col("equal_fields") / fields * 100, 2))
        .otherwise(F.lit(100.0))
        .alias("field_accuracy"),
    )


def golden_mismatches(
    golden: DataFrame, actual: DataFrame, key: str | None, order: str | None = None
) -> DataFrame:
    """One row per field that differs on a matched record."""
    found = [
        F.when(
            folded(F.col("g")[c]) != folded(F.col("a")[c]),
            F.struct(
                F.lit(c).alias("field_name"),
                F.col("g")[c].cast("string").alias("expected_value"),
                F.col("a")[c].cast("string").alias("actual_value"),
            ),
        )
        for c in _common(golden, actual, order)
    ]
    return (
        _golden_join(golden, actual, key, order)
        .filter(F.col("g").isNotNull() & F.col("a").isNotNull())
        .select(
            F.col("_key").alias("identifier"),
            F.inline(F.filter(F.array(*found), lambda m: m.isNotNull())),
        )
    )


def golden_samples(
    golden: DataFrame, actual: DataFrame, key: str | None, order: str | None = None, count: int = 10
) -> DataFrame:
    """First missing and extra keys in key order (a report of at most `count` each)."""
    joined = _golden_join(golden, actual, key, order)
    missing = joined.filter(F.col("a").isNull()).select(F.lit("missing").alias("side"), "_key")
    extra = joined.filter(F.col("g").isNull()).select(F.lit("extra").alias("side"), "_key")
    return (
        missing.orderBy("_key").limit(count).unionByName(extra.orderBy("_key").limit(count))
        .withColumnRenamed("_key", "identifier")
    )
