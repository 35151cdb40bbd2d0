"""From one wide table to related ones: dedup, decomposition, keys, junctions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.functions import canon, fixed
from doctables.functions.lists import clean_list, split_items
from doctables.functions.text import first_filled, is_blank, nullify, strip
from doctables.plans.scan import row_block, running
from doctables.plans.skew import MAX_ITEMS, first_per_key, last_per_key, with_parts


def deduplicate(df: DataFrame, order: str, keys: Sequence[str] | None = None) -> DataFrame:
    """First row per key in source order; all columns are the key when none is given.

    NULL keys are equal to each other.
    """
    chosen = list(keys) if keys else [c for c in df.columns if c != order]
    return first_per_key(df, chosen, [order])


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, rows kept and rows dropped by `deduplicate`."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("unique_rows"),
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
        )
    )


def decompose_parent(df: DataFrame, list_column: str, key: str, order: str) -> DataFrame:
    """The table without its list column, one row per key, first row wins.

    Rows without a key stay when they hold any other value.
    """
    helpers = [f"{list_column}{suffix}" for suffix in ("", "__raw", "__kind", "__mod")]
    parent = df.drop(*helpers)
    values = [
        c for c in parent.columns
        if c not in (key, order) and not c.endswith(("__raw", "__kind", "__mod"))
    ]
    blank = is_blank(F.col(key))
    filled = F.lit(False)
    for c in values:
        filled = filled | ~is_blank(F.col(c))
    keyed = first_per_key(parent.filter(~blank), [key], [order])
    return keyed.unionByName(parent.filter(blank & filled))


def decompose_child(
    df: DataFrame,
    list_column: str,
    key: str,
    item: str,
    delimiter: str = ";",
    distinct: bool = True,
    carried: Sequence[str] = (),
    order: str | None = None,
) -> DataFrame:
    """One row per key and list item, split from the source value.

    `carried` columns (document, page, provenance) come along; of equal items the
    first by `order` stays.
    """
    source = f"{list_column}__raw" if f"{list_column}__raw" in df.columns else list_column
    ordered = [] if order is None else [F.col(order).alias("_order")]
    child = df.select(
        key, *carried, *ordered, F.explode(split_items(F.col(source).cast("string"), delimiter)).alias(item)
    )
    if not distinct:
        return child.drop("_order")
    if order is None:
        return child.dropDuplicates([key, item])
    return first_per_key(child, [key, item], ["_order"]).drop("_order")


def relationship(spark, parent: str, child: str, key: str, item: str) -> DataFrame:
    """The relationship that a decomposition creates, as one row."""
    return spark.createDataFrame(
        [
            (
                f"{parent}_to_{child}", "ONE_TO_MANY", parent, child, key, key,
                f"One {parent} relates to multiple {item} entries", True,
            )
        ],
        "name string, rel_type string, parent_dataset string, child_dataset string, "
        "parent_key string, foreign_key string, description string, is_accepted boolean",
    )


def child_names(dataset: str, list_column: str, profile_child: str | None = None) -> tuple[str, str]:
    """(name of the child dataset, name of its item column)."""
    college = "college" in list_column
    child = profile_child or f"{dataset}_{'colleges' if college else 'items'}"
    return child, "college_name" if college else "item_name"


def extend_dimension(
    dim: DataFrame,
    names: DataFrame,
    name: str,
    order: str,
    id_column: str,
    prefix: str = "C",
    width: int = 4,
) -> DataFrame:
    """Dimension with new names added under the next keys, `C0001`, `C0002`, …

    `names` holds `name` and an integer `order` unique per row; new names are
    numbered by first appearance. Short names and stop words are rejected. Names
    are compared exactly after stripping; one that differs from an older name only
    by case gets the flag `review_possible_variant`.
    """
    cleaned = names.select(strip(F.col(name)).alias(name), F.col(order).cast("long").alias("_at"))
    usable = cleaned.filter(
        (F.length(name) >= 3) & ~F.lower(name).isin(*fixed.LIST_STOPWORDS)
    )
    fresh = (
        usable.groupBy(name)
        .agg(F.min("_at").alias("_at"))
        .join(dim.select(name), name, "left_anti")
    )
    # Several names may first appear in one source row: they follow by name.
    ranked = fresh.withColumns({"_seq": F.struct("_at", F.col(name).alias("_name")), "_all": F.lit(1)})
    digits = F.regexp_extract(F.col(id_column), f"^{prefix}([0-9]+)$", 1)
    last = dim.agg(
        F.coalesce(F.max(F.nullif(digits, F.lit("")).cast("long")), F.lit(0)).alias("last")
    )
    numbered = running(
        ranked,
        ["_all"],
        ["_at", name],
        [row_block("_at", 1 << 17)],
        sums={"_number": F.lit(1)},
        coarse=[[row_block("_at", 1 << 33)], [row_block("_at", 1 << 49)]],
    )
    spelled = (
        dim.select(F.lower(name).alias("_lower"), F.lit(True).alias("_known"), F.lit(None).alias("_seq"))
        .unionByName(ranked.select(F.lower(name).alias("_lower"), F.lit(False).alias("_known"), "_seq"))
        .groupBy("_lower")
        .agg(F.min("_seq").alias("_first"), F.bool_or("_known").alias("_known"))
    )
    new = (
        numbered.withColumn("_lower", F.lower(name))
        .join(spelled, "_lower")
        .select(
            F.concat(
                F.lit(prefix),
                _padded(F.col("_number") + last.scalar(), width),
            ).alias(id_column),
            name,
            F.when(F.col("_known") | (F.col("_first") < F.col("_seq")), "review_possible_variant").alias(
                "data_quality_flag"
            ),
        )
    )
    return dim.unionByName(new, allowMissingColumns=True)


def _padded(number: Column, width: int) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def insert_absent(existing: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Parent table with the first batch row of every key it does not hold yet."""
    fresh = first_per_key(batch, [key], [order]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.drop(order), allowMissingColumns=True)


def junction_pairs(
    rows: DataFrame,
    dim: DataFrame,
    key: str,
    items: Column,
    name: str,
    id_column: str,
    existing: DataFrame | None = None,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Distinct (parent, dimension id) pairs that are not stored yet.

    `items` is an array of names; pairs are made distinct before the join, so a
    name that occurs in very many rows is shuffled once per parent.
    """
    pairs = rows.select(key, *carried, F.explode(items).alias(name))
    first = [F.min(c).alias(c) for c in carried]
    distinct = (
        pairs.groupBy(key, name).agg(*first) if first else pairs.select(key, name).distinct()
    )
    joined = distinct.join(dim.select(name, id_column), name)
    if existing is None:
        return joined
    return joined.join(existing.select(key, id_column), [key, id_column], "left_anti")


def is_specialisation(section: Column, *context: Column) -> Column:
    """Rows that belong to the centres of specialisation as well."""
    named = F.lower(section).rlike("dspp|specialisation")
    for c in context:
        named = named | ~is_blank(c)
    return F.coalesce(named, F.lit(False))


def is_qualification_row(df: DataFrame, identifier: Column, doc_type: Column | None = None) -> Column:
    """Rows that describe a qualification."""
    columns = {"saqa_id", "qualification_name", "qualification"} & set(df.columns)
    if columns:
        return F.lit(True)
    test = F.coalesce(identifier.rlike(r"\d{4,}"), F.lit(False))
    if doc_type is not None:
        test = test | F.coalesce(F.lower(doc_type).contains("qualification"), F.lit(False))
    return test


def qualification_table(df: DataFrame) -> DataFrame:
    """Records to the columns of the qualification model, first filled source wins."""

    def pick(*names: str) -> Column:
        present = [F.col(n).cast("string") for n in names if n in df.columns]
        return first_filled(*present) if present else F.lit(None).cast("string")

    raw = lambda *names: pick(*[f"{n}__raw" for n in names])
    saqa = F.coalesce(pick("saqa_id", "qual_id"), raw("saqa_id", "qual_id"), F.lit(""))
    title = F.coalesce(
        pick("qualification_name", "qualification", "qualification_title"),
        raw("qualification", "qualification_name"),
        F.lit("Unknown Qualification"),
    )
    number = pick("qualification_number", "qual_no", "qualification_no")
    band = (
        canon.confidence_band(F.col("confidence"))
        if "confidence" in df.columns and dict(df.dtypes)["confidence"] != "string"
        else canon.confidence_text(pick("confidence"))
        if "confidence" in df.columns
        else F.lit("high")
    )
    row = F.col("row_index").cast("string") if "row_index" in df.columns else F.lit(None)
    return df.withColumns(
        {
            "_saqa": saqa,
            "_title": title,
        }
    ).select(
        *[c for c in ("row_index",) if c in df.columns],
        F.col("_saqa").alias("saqa_id"),
        F.coalesce(number, nullify(F.col("_saqa")), row).alias("qualification_number"),
        F.col("_title").alias("qualification_name"),
        F.coalesce(
            raw("qualification", "qualification_name", "qualification_title"), F.col("_title")
        ).alias("qualification_name_raw"),
        F.coalesce(pick("nqf_level"), raw("nqf_level")).alias("nqf_level"),
        canon.framework(pick("nqf_sub_framework", "framework", "sub_framework")).alias(
            "nqf_sub_framework"
        ),
        canon.yes_no(pick("nsfas_allowance", "nsfas_eligible", "nsfas")).alias("nsfas_allowance"),
        F.coalesce(
            pick("source_section"), F.lit("Section 1: Occupational Qualifications")
        ).alias("source_section"),
        F.coalesce(pick("source_page"), F.lit("1")).alias("source_page"),
        band.alias("confidence"),
        clean_list(
            F.coalesce(
                pick("colleges", "participating_colleges"), raw("participating_colleges", "colleges"),
                F.lit(""),
            )
        ).alias("college_names"),
        F.coalesce(pick("programme_context", "specialisation_trade"), F.col("_title")).alias(
            "programme_context"
        ),
    )


def nested_children(
    parents: DataFrame,
    children: Mapping[str, tuple[DataFrame, str, Sequence[str]]],
    key: str,
    max_items: int = MAX_ITEMS,
    part: str = "part",
) -> DataFrame:
    """Parents with arrays of their children.

    `children`: output column -> (child table, integer position column, columns).
    Each child set is grouped before it is joined, so sets do not multiply. The result
    has one row per parent and slice of `max_items` children, by the same rule for
    every parent: `part` counts the slices from 0. A child set that ends earlier is
    empty in the slices that follow.
    """
    sets = None
    for column, (child, position, columns) in children.items():
        grouped = (
            with_parts(
                child.select(*dict.fromkeys([key, position, *columns])),
                [key], position, max_items, "_part",
            )
            .groupBy(key, "_part")
            .agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("_at"), *columns))).alias(column))
            .withColumn(column, _pick(column, columns))
        )
        sets = grouped if sets is None else sets.join(grouped, [key, "_part"], "full_outer")
    return (
        parents.join(sets, key, "left")
        .withColumns(
            {part: F.coalesce("_part", F.lit(0))}
            | {column: F.coalesce(column, F.array()) for column in children}
        )
        .drop("_part")
    )


def _pick(column: str, names: Sequence[str]) -> Column:
    return F.transform(column, lambda c: F.struct(*[c[n].alias(n) for n in names]))


def _names(column: str, name: str) -> Column:
    return F.transform(column, lambda c: c[name])


def joined_children(
    parents: DataFrame,
    children: Mapping[str, tuple[DataFrame, str, str]],
    key: str,
    sep: str = "; ",
    max_items: int = MAX_ITEMS,
) -> DataFrame:
    """Parents with the names of their children joined in one text per child set.

    `children`: output column -> (child table, integer position column, name column).
    """
    wanted = {
        column: (child, position, [name]) for column, (child, position, name) in children.items()
    }
    nested = nested_children(parents, wanted, key, max_items)
    return nested.withColumns(
        {
            column: F.array_join(_names(column, name), sep)
            for column, (_, _, name) in children.items()
        }
    )


def counts_per(parents: DataFrame, children: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Parents with the number of rows they have in each child table."""
    out = parents
    for name, child in children.items():
        counted = child.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def lookup_by_either(rows: DataFrame, first: tuple[str, object], second: tuple[str, object]) -> DataFrame:
    """Rows of the first (column, value); rows of the second when there are none."""
    main = rows.filter(F.col(first[0]) == first[1])
    other = rows.filter(F.col(second[0]) == second[1])
    return main.unionByName(other.filter(~main.exists()))


def merge_run(stored: DataFrame, run: DataFrame, selective: bool, dataset: str = "dataset") -> DataFrame:
    """Stored datasets after a run: it replaces its own, or all when not selective."""
    if not selective:
        return run
    kept = stored.join(run.select(dataset).distinct(), dataset, "left_anti")
    return kept.unionByName(run, allowMissingColumns=True)


def apply_changes(
    df: DataFrame,
    key: str,
    deletes: DataFrame | None = None,
    updates: DataFrame | None = None,
    inserts: DataFrame | None = None,
    order: str | None = None,
    clear: bool = False,
) -> DataFrame:
    """Rows after a batch of changes: delete, patch, insert.

    With an `order` column in `updates`, the last update of a key counts; without it
    the greatest by its values, so that no row is doubled. NULL leaves a value, unless `clear` lets it empty
    the cell.
    """
    out = df if deletes is None else df.join(deletes.select(key).distinct(), key, "left_anti")
    if updates is not None:
        patched = [c for c in updates.columns if c not in (key, order)]
        patch = last_per_key(updates, key, order).select(key, F.struct(*patched).alias("_new"))
        given = lambda c: F.col("_new").isNotNull() if clear else F.col(f"_new.{c}").isNotNull()
        out = (
            out.join(patch, key, "left")
            .withColumns({c: F.when(given(c), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in patched})
            .drop("_new")
        )
    return out if inserts is None else out.unionByName(inserts, allowMissingColumns=True)
