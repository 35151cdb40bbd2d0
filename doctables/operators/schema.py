"""Schema inference: one aggregation over all columns, then a vote per column.

These functions run a job where they say so: a column list must be known before
the next plan can be built.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from doctables.functions import fixed
from doctables.functions.names import snake_name, unique_list
from doctables.functions.text import is_blank, strip

SHARE = 0.85
LIST_SHARE = 0.60


@dataclass(frozen=True)
class Field:
    """A column: name, type, and the constraints rules are made from."""

    name: str
    data_type: str = "STRING"
    display_name: str = ""
    required: bool = False
    confidence: float = 1.0
    source_header: str = ""
    is_primary_key: bool = False
    unique: bool = False
    pattern: str | None = None
    min_value: float | None = None
    max_value: float | None = None
    allowed_values: tuple[str, ...] = ()
    aliases: tuple[str, ...] = field(default=(), repr=False)


def vote_counts(value: Column, kind: Column | None = None) -> list[Column]:
    """Counts a column is judged by: rows, filled, bool, int, float, list."""
    text = strip(value.cast("string"))
    filled = ~is_blank(value)
    known = F.lit("") if kind is None else F.coalesce(kind, F.lit(""))
    is_bool = (known == "bool") | F.lower(text).isin("true", "false", "yes", "no")
    is_int = ~is_bool & ((known == "int") | text.rlike(r"^(-?[1-9][0-9]*|-?0)$"))
    is_float = ~is_bool & ~is_int & ((known == "float") | text.rlike(r"^-?[0-9]+\.[0-9]+$"))
    is_list = (
        ~is_bool
        & ~is_int
        & ~is_float
        & (text.contains(";") | text.rlike(r"(?s)^[^,]*,[^,]*,"))
    )
    return [
        F.count(F.lit(1)),
        F.count_if(filled),
        *[F.count_if(filled & test) for test in (is_bool, is_int, is_float, is_list)],
    ]


def column_votes(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per field with its counts, from a single aggregation."""
    names = ("rows", "filled", "bools", "ints", "floats", "lists")
    aggregates, packed = [], []
    for i, f in enumerate(fields):
        kind = F.col(f"{f}__kind") if f"{f}__kind" in df.columns else None
        parts = vote_counts(F.col(f), kind)
        aggregates += [p.alias(f"_{i}_{n}") for p, n in zip(parts, names)]
        packed.append(
            F.struct(
                F.lit(f).alias("field"),
                F.lit(i).alias("position"),
                *[F.col(f"_{i}_{n}").alias(n) for n in names],
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*packed)))


def voted(counts: DataFrame, keys: Sequence[str], lists: bool = True) -> DataFrame:
    """Type, confidence and required flag from vote counts (rows, filled, bools, …), for each row of them."""
    share = lambda n: n / F.col("filled")
    boolean, integer = share(F.col("bools")), share(F.col("ints"))
    number, many = share(F.col("ints") + F.col("floats")), share(F.col("lists"))
    some = F.col("filled") > 0
    vote = (
        F.when(~some, F.struct(F.lit("STRING").alias("t"), F.lit(0.5).alias("c")))
        .when(boolean >= SHARE, F.struct(F.lit("BOOLEAN").alias("t"), boolean.alias("c")))
        .when(integer >= SHARE, F.struct(F.lit("INTEGER").alias("t"), integer.alias("c")))
        .when(number >= SHARE, F.struct(F.lit("FLOAT").alias("t"), number.alias("c")))
    )
    if lists:
        vote = vote.when(many >= LIST_SHARE, F.struct(F.lit("LIST").alias("t"), many.alias("c")))
    vote = vote.otherwise(F.struct(F.lit("STRING").alias("t"), F.lit(0.95).alias("c")))
    return counts.select(
        *keys,
        vote["t"].alias("data_type"),
        F.bround(vote["c"], 2).alias("confidence"),
        ((F.col("rows") > 0) & (F.col("rows") == F.col("filled"))).alias("required"),
    )


def infer_types(df: DataFrame, fields: Sequence[str], lists: bool = True) -> DataFrame:
    """Type, confidence and required flag per field (field, position, data_type, …)."""
    return voted(column_votes(df, fields), ["field", "position"], lists)


def is_key_name(name: str) -> bool:
    return name in ("id", "saqa_id", "ofo_code", "variable_name") or "code" in name


def key_candidates(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fields whose names mark keys, with a check that their values are unique."""
    names = [f for f in fields if is_key_name(f)]
    parts = [
        df.groupBy(F.lit(f).alias("field"), F.col(f).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("field")
        .agg((F.max("_n") == 1).alias("is_unique"), F.bool_and(F.col("_value").isNotNull()).alias("is_filled"))
        for f in names
    ]
    if not parts:
        return df.sparkSession.createDataFrame([], "field string, is_unique boolean, is_filled boolean")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def profile_field(header: str, profile_fields: Sequence[Field]) -> Field | None:
    """Profile field for a header, by name, display name or alias; later ones win."""
    index = {}
    for f in profile_fields:
        for text in (f.name, f.display_name, *f.aliases):
            index[text.lower()] = f
    return index.get(header.lower()) or index.get(snake_name(header))


def detect_fields(
    df: DataFrame,
    headers: Sequence[str],
    profile_fields: Sequence[Field] = (),
    primary_key: Sequence[str] = (),
    override: Sequence[Field] = (),
) -> list[Field]:
    """Fields for the columns of `df`, which follow `headers` by position.

    A user schema in `override` wins, then the profile, then the vote over the
    data. Runs one job, over the unmatched columns only.
    """
    if override:
        return list(override)
    shown = [h.strip() if h and h.strip() else f"Column_{i + 1}" for i, h in enumerate(headers)]
    matched = [profile_field(h, profile_fields) for h in shown]
    open_columns = [c for c, m in zip(df.columns, matched) if m is None]
    votes: dict[str, Row] = {}
    if open_columns:
        # One row per column.
        votes = {row["field"]: row for row in infer_types(df, open_columns).collect()}
    names = unique_list([m.name if m else snake_name(h) for h, m in zip(shown, matched)])
    fields = []
    for column, header, match, name in zip(df.columns, shown, matched, names):
        if match:
            key = match.name in primary_key
            fields.append(
                replace(match, name=name, confidence=0.99, source_header=header, is_primary_key=key)
            )
        else:
            vote = votes[column]
            fields.append(
                Field(
                    name=name,
                    data_type=vote["data_type"],
                    display_name=header,
                    required=vote["required"],
                    confidence=vote["confidence"],
                    source_header=header,
                    is_primary_key=is_key_name(snake_name(header)),
                )
            )
    if primary_key:
        present = [k for k in primary_key if k in names]
        if present:
            fields = [replace(f, is_primary_key=f.name in present) for f in fields]
    return fields


def sample_columns(df: DataFrame, headers: Sequence[str], order: str) -> list[Field]:
    """Columns judged by all rows; code-like names are text, and some are required.

    `order` names a column that is no field. Runs one job with one row per column.
    """
    columns = [c for c in df.columns if c != order]
    votes = {row["field"]: row for row in infer_types(df.select(*columns), columns, lists=False).collect()}
    shown = [h.strip() if h else f"Column_{i + 1}" for i, h in enumerate(headers)]
    fields = []
    for column, header, name in zip(columns, shown, unique_list([snake_name(h) for h in shown])):
        coded = any(term in name for term in fixed.CODE_TERMS)
        fields.append(
            Field(
                name=name,
                data_type="STRING" if coded else votes[column]["data_type"],
                display_name=header,
                source_header=header,
                required=any(term in name for term in ("id", "code", "title", "name")),
            )
        )
    return fields


def fields_frame(spark, fields: Sequence[Field]) -> DataFrame:
    """Fields as a table, one row per column."""
    rows = [
        (
            i, f.name, f.display_name or f.name, f.data_type, f.required, not f.required,
            float(f.confidence), f.source_header or f.name, f.is_primary_key, f.pattern,
            None if f.min_value is None else float(f.min_value),
            None if f.max_value is None else float(f.max_value),
        )
        for i, f in enumerate(fields)
    ]
    return spark.createDataFrame(
        rows,
        "position int, name string, display_name string, data_type string, required boolean, "
        "nullable boolean, confidence double, source_header string, is_primary_key boolean, "
        "pattern string, min_value double, max_value double",
    )


def typed(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Cast normal forms to the types of the fields; what does not fit becomes NULL."""
    casts = {
        "INTEGER": lambda c: c.try_cast("bigint"),
        "FLOAT": lambda c: c.try_cast("double"),
        "BOOLEAN": lambda c: c.try_cast("boolean"),
        "DATE": lambda c: c.try_cast("date"),
        "JSON": lambda c: F.try_parse_json(c),
    }
    return df.withColumns(
        {f.name: casts[f.data_type](F.col(f.name)) for f in fields if f.data_type in casts}
    )


def delimited_share(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Share of multi-value cells among the filled cells of all rows, per field."""
    packed = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.lit(i).alias("position"), F.col(f).cast("string").alias("v"))
            for i, f in enumerate(fields)
        ]
    )
    cells = df.select(F.inline(packed)).filter(F.coalesce("v", F.lit("")) != "")
    many = F.col("v").contains(";") | F.col("v").contains(",")
    return cells.groupBy("field", "position").agg(F.avg(many.cast("double")).alias("share"))


def list_columns(df: DataFrame, fields: Sequence[str], share: float = 0.35) -> DataFrame:
    """The multi-value column: a reserved name, or enough delimited cells; first column wins."""
    known = F.col("field").isin(*fixed.KNOWN_LIST_COLUMNS)
    return (
        delimited_share(df, fields)
        .filter(known | (F.col("share") >= share))
        .orderBy("position")
        .limit(1)
        .select("field", "position", "share")
    )


def detect_list_column(df: DataFrame, fields: Sequence[str]) -> str | None:
    """Name of the multi-value column. Runs a job unless a reserved name comes first."""
    if fields and fields[0] in fixed.KNOWN_LIST_COLUMNS:
        return fields[0]
    found = list_columns(df, fields).first()
    reserved = [f for f in fields if f in fixed.KNOWN_LIST_COLUMNS]
    if found is None:
        return reserved[0] if reserved else None
    if reserved and fields.index(reserved[0]) < found["position"]:
        return reserved[0]
    return found["field"]
