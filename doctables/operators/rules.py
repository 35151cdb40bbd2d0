"""Validation: rules are data, one scan of the records yields all issues.

Every row-level rule becomes one expression that is NULL or an issue. They are
packed into an array and exploded, so any number of rules reads the data once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.functions import fixed
from doctables.functions.matching import missing_from, missing_places
from doctables.functions.text import digits_only, first_number, is_blank, strip
from doctables.operators.schema import Field
from doctables.plans.durable import durable

CRITICAL, WARNING, INFO = "CRITICAL", "WARNING", "INFO"
PART_VALUES = 10_000  #: values of a page that are searched together


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    field: str
    rule_type: str
    severity: str = CRITICAL
    params: Mapping[str, object] = field(default_factory=dict)


def default_rules(fields: Sequence[Field]) -> list[Rule]:
    """Rules that follow from names and constraints of the fields."""
    rules = []
    for f in fields:
        label = f.display_name or f.name
        if f.required or f.is_primary_key:
            rules.append(Rule(f"req_{f.name}", f"Required field: {label}", f.name, "required"))
        if f.pattern:
            rules.append(
                Rule(f"regex_{f.name}", f"Format of {label}", f.name, "regex", params={"pattern": f.pattern})
            )
        elif "saqa" in f.name:
            rules.append(
                Rule(
                    f"saqa_regex_{f.name}", "SAQA ID must be 4–7 numeric digits", f.name, "regex",
                    params={"pattern": r"^\d{4,7}$"},
                )
            )
        elif "ofo" in f.name:
            rules.append(
                Rule(
                    f"ofo_regex_{f.name}", "OFO Code must be 4–6 numeric digits", f.name, "regex",
                    params={"pattern": r"^\d{4,6}$"},
                )
            )
        low, high = f.min_value, f.max_value
        if low is None and high is None and "nqf" in f.name:
            low, high = 1, 10
            label = "NQF Level"
        if low is not None or high is not None:
            rules.append(
                Rule(
                    f"range_{f.name}", f"{label} must be between {low} and {high}", f.name, "range",
                    params={"min": low, "max": high},
                )
            )
        if f.allowed_values:
            rules.append(
                Rule(
                    f"allowed_{f.name}", f"Allowed values of {label}", f.name, "allowed_values",
                    params={"values": list(f.allowed_values)},
                )
            )
    return rules


def rules_frame(spark, rules: Sequence[Rule]) -> DataFrame:
    """Rules as a table; parameters as text."""
    rows = [
        (r.id, r.name, r.field, r.rule_type, r.severity, {k: str(v) for k, v in r.params.items()})
        for r in rules
    ]
    return spark.createDataFrame(
        rows,
        "id string, name string, field string, rule_type string, severity string, "
        "params map<string,string>",
    )


def rules_from_frame(df: DataFrame) -> list[Rule]:
    """All rules of a table; they are settings, as many as columns and checks, and not as many as records."""
    rows = df.collect()
    out = []
    for r in rows:
        params = dict(r["params"] or {})
        for bound in ("min", "max"):
            if bound in params:
                params[bound] = float(params[bound])
        out.append(Rule(r["id"], r["name"], r["field"], r["rule_type"], r["severity"], params))
    return out


def issue(
    rule: Rule,
    value: Column,
    message: Column,
    severity: str | None = None,
    fix: Column | None = None,
) -> Column:
    fix = F.lit(None).cast("string") if fix is None else fix
    return F.struct(
        F.lit(rule.field).alias("field"),
        F.lit(severity or rule.severity).alias("severity"),
        F.lit(rule.id).alias("rule_id"),
        F.lit(rule.name).alias("rule_name"),
        message.alias("message"),
        value.cast("string").alias("current_value"),
        fix.alias("suggested_fix"),
        fix.isNotNull().alias("is_auto_fixable"),
    )


# The texts of the issues in the functions below.


def _required(rule: Rule, value: Column) -> Column:
    text = f"Missing required value for '{rule.field}'"
    return F.when(is_blank(value), issue(rule, value, F.lit(text)))


def _regex(rule: Rule, value: Column) -> Column:
    pattern = f"^(?:{rule.params['pattern']})"
    text = strip(value.cast("string"))
    digits = digits_only(text)
    message = F.concat(F.lit("Value '"), text, F.lit("' does not match expected format"))
    return F.when(
        value.isNotNull() & ~text.rlike(pattern),
        issue(rule, value, message, fix=F.when(digits.rlike(pattern), digits)),
    )


def _number(value: Column) -> Column:
    text = strip(value.cast("string"))
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def _range(rule: Rule, value: Column) -> Column:
    low, high = rule.params.get("min"), rule.params.get("max")
    number = _number(value)
    outside = F.lit(False)
    if low is not None:
        outside = outside | (number < low)
    if high is not None:
        outside = outside | (number > high)
    wrong = F.concat(
        F.lit("Value "), number.cast("string"), F.lit(f" outside valid range [{low}, {high}]")
    )
    text = F.concat(
        F.lit("Value '"), value.cast("string"), F.lit("' is not numeric for range check")
    )
    return F.when(value.isNotNull() & number.isNull(), issue(rule, value, text, WARNING)).when(
        outside, issue(rule, value, wrong)
    )


def _allowed(rule: Rule, value: Column) -> Column:
    text = value.cast("string")
    message = F.concat(F.lit("Value '"), text, F.lit("' is not an allowed value"))
    return F.when(
        value.isNotNull() & ~text.isin([str(v) for v in rule.params["values"]]),
        issue(rule, value, message),
    )


def _type(rule: Rule, value: Column) -> Column:
    wanted = str(rule.params["type"]).lower()
    text = strip(value.cast("string"))
    fits = {
        "integer": text.rlike(r"^[+-]?[0-9]+$"),
        "float": _number(value).isNotNull(),
        "boolean": F.lower(text).isin("true", "false"),
        "date": text.try_cast("date").isNotNull(),
    }.get(wanted, F.lit(True))
    message = F.concat(F.lit("Value '"), text, F.lit(f"' cannot be parsed as {wanted}."))
    return F.when(~is_blank(value) & ~fits, issue(rule, value, message))


# rule type -> (rule, value) -> NULL or issue. Add your own with `register_rule_type`.
ROW_RULES: dict[str, Callable[[Rule, Column], Column]] = {
    "required": _required,
    "regex": _regex,
    "range": _range,
    "allowed_values": _allowed,
    "type": _type,
}


def register_rule_type(name: str, build: Callable[[Rule, Column], Column]) -> None:
    ROW_RULES[name] = build


def validate(
    df: DataFrame,
    rules: Sequence[Rule],
    record_id: str = "record_id",
    source: Mapping[str, str] | None = None,
    parents: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Issues of all rules. `source` maps issue columns to record columns.

    Row-level rules share one scan. A `unique` rule (parameter `columns`, else its
    field) and a `referential` rule (`parent`, a name in `parents`, and `key`) add a
    join each; issues of these carry no source columns. A column that the data lacks
    is NULL in every record; a rule of an unknown type raises ValueError.
    """
    unknown = sorted({r.rule_type for r in rules} - {*ROW_RULES, "unique", "referential"})
    if unknown:
        raise ValueError(f"unknown rule types: {', '.join(unknown)}")
    found = _row_issues(df, rules, record_id, source)
    for r in rules:
        if r.rule_type == "unique":
            more = unique_issues(df, r, list(r.params.get("columns") or [r.field]), record_id)
        elif r.rule_type == "referential":
            parent = (parents or {})[str(r.params["parent"])]
            on = {r.field: str(r.params.get("key", r.field))}
            more = referential_issues(df, parent, on, r, record_id)
        else:
            continue
        found = found.unionByName(more, allowMissingColumns=True)
    return found


def _row_issues(
    df: DataFrame, rules: Sequence[Rule], record_id: str, source: Mapping[str, str] | None
) -> DataFrame:
    carried = [F.col(c).alias(n) for n, c in (source or {}).items()]
    found = [
        ROW_RULES[r.rule_type](r, F.col(r.field) if r.field in df.columns else F.lit(None).cast("string"))
        for r in rules
        if r.rule_type in ROW_RULES
    ]
    if not found:
        found = [F.when(F.lit(False), issue(Rule("", "", "", ""), F.lit(None), F.lit("")))]
    issues = F.filter(F.array(*found), lambda i: i.isNotNull())
    return df.select(F.col(record_id).alias("record_id"), *carried, issues.alias("_issues")).select(
        "record_id", *(source or {}), F.inline("_issues")
    )


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count. NULL keys do not clash."""
    filled = df.dropna("any", subset=list(keys))
    return filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def unique_issues(df: DataFrame, rule: Rule, keys: Sequence[str], record_id: str = "record_id") -> DataFrame:
    """One issue per record whose key is not unique."""
    clashes = unique_violations(df, keys)
    shown = F.concat_ws("||", *[F.col(k).cast("string") for k in keys])
    text = F.concat(F.lit("Value '"), shown, F.lit("' occurs "), F.col("rows").cast("string"), F.lit(" times"))
    return df.join(clashes, list(keys)).select(
        F.col(record_id).alias("record_id"), F.inline(F.array(issue(rule, shown, text)))
    )


def orphans(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Child rows whose foreign key (child column -> parent column) has no parent."""
    renamed = parent.select(*[F.col(p).alias(c) for c, p in on.items()]).distinct()
    filled = child.dropna("any", subset=list(on))
    return filled.join(renamed, list(on), "left_anti")


def referential_issues(
    child: DataFrame, parent: DataFrame, on: Mapping[str, str], rule: Rule, record_id: str = "record_id"
) -> DataFrame:
    shown = F.concat_ws("||", *[F.col(c).cast("string") for c in on])
    text = F.concat(F.lit("Value '"), shown, F.lit("' has no parent"))
    return orphans(child, parent, on).select(
        F.col(record_id).alias("record_id"), F.inline(F.array(issue(rule, shown, text)))
    )


def cascade_delete(dependent: DataFrame, deleted: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows of a dependent table that stay when the deleted parents go."""
    gone = deleted.select(*[F.col(p).alias(c) for c, p in on.items()]).distinct()
    return dependent.join(gone, list(on), "left_anti")


def restrict_violations(dependent: DataFrame, deleted: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows that forbid the deletion of these parents."""
    gone = deleted.select(*[F.col(p).alias(c) for c, p in on.items()]).distinct()
    return dependent.join(gone, list(on), "left_semi")


def summarize(issues: DataFrame) -> DataFrame:
    """Counts by severity, total, records with issues, auto-fixable issues."""
    # Records are counted in their own aggregation: one row per record first.
    per_record = issues.groupBy("record_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in (CRITICAL, WARNING, INFO)],
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_auto_fixable").alias("fixable"),
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_record.agg(
        zero(CRITICAL).alias("critical_count"),
        zero(WARNING).alias("warning_count"),
        zero(INFO).alias("info_count"),
        zero("total").alias("total_issues"),
        F.count(F.lit(1)).alias("records_with_issues"),
        zero("fixable").alias("auto_fixable_count"),
    )


def summarize_datasets(issues: DataFrame, dataset: str = "dataset") -> DataFrame:
    """The same per dataset and, with dataset NULL, over all of them."""
    per_record = issues.groupBy(dataset, "record_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in (CRITICAL, WARNING, INFO)],
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_auto_fixable").alias("fixable"),
    )
    return per_record.rollup(dataset).agg(
        F.sum(CRITICAL).alias("critical_count"),
        F.sum(WARNING).alias("warning_count"),
        F.sum(INFO).alias("info_count"),
        F.sum("total").alias("total_issues"),
        F.count(F.lit(1)).alias("records_with_issues"),
        F.sum("fixable").alias("auto_fixable_count"),
    )


def flag_records(df: DataFrame, issues: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Add `is_flagged`: the record has an issue."""
    hit = issues.select(F.col("record_id").alias(record_id)).distinct().withColumn("_hit", F.lit(True))
    return (
        df.join(hit, record_id, "left")
        .withColumn("is_flagged", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def apply_fixes(
    df: DataFrame, issues: DataFrame, fields: Sequence[str], record_id: str = "record_id"
) -> DataFrame:
    """Put suggested fixes in place of normal values; raw values stay.

    Adds `fixes`, the number of values replaced in the record.
    """
    chosen = issues.filter(F.col("is_auto_fixable") & F.col("field").isin(list(fields)))
    wide = chosen.groupBy(F.col("record_id").alias(record_id)).agg(
        *[
            F.max_by("suggested_fix", F.when(F.col("field") == f, F.col("rule_id"))).alias(f"_fix_{f}")
            for f in fields
        ],
        F.count(F.lit(1)).alias("fixes"),
    )
    fixed_values = {f: F.coalesce(F.col(f"_fix_{f}"), F.col(f).cast("string")) for f in fields}
    marks = {
        f"{f}__mod": F.col(f"{f}__mod") | F.col(f"_fix_{f}").isNotNull()
        for f in fields
        if f"{f}__mod" in df.columns
    }
    return (
        df.join(wide, record_id, "left")
        .withColumns(marks | fixed_values | {"fixes": F.coalesce("fixes", F.lit(0))})
        .drop(*[f"_fix_{f}" for f in fields])
    )


def record_checks(fields: Sequence[Field]) -> Callable[[DataFrame], Column]:
    """Issues of a record by field type and name, as an array column.

    A missing required field ends the checks of that field. Severity is `error`
    or `warning`.
    """

    def entry(name: str, rule: str, severity: str, message: Column, value: Column) -> Column:
        return F.struct(
            F.lit(name).alias("column_name"),
            F.lit(rule).alias("rule_name"),
            F.lit(severity).alias("severity"),
            message.alias("message"),
            value.alias("raw_value"),
        )

    def build(df: DataFrame) -> Column:
        found = []
        for f in fields:
            if f.name not in df.columns:
                continue
            value = F.col(f.name).cast("string")
            text, filled, name = strip(value), ~is_blank(value), f.name.lower()

            def say(before: str, after: str, shown: Column = text) -> Column:
                return F.concat(F.lit(before), shown, F.lit(after))

            if f.required:
                missing = F.lit(f"Required field '{f.name}' is missing or empty.")
                found.append(
                    F.when(~filled, entry(f.name, f"required_{f.name}", "error", missing, value))
                )
            if "saqa" in name:
                found.append(
                    F.when(
                        filled & ~text.rlike(r"^\d{4,7}$"),
                        entry(
                            f.name, "saqa_id_format", "error",
                            say("Invalid SAQA ID '", "'. Expected 4 to 7 numeric digits."), text,
                        ),
                    )
                )
            if "ofo" in name:
                found.append(
                    F.when(
                        filled & ~text.rlike(r"^\d{4,6}$"),
                        entry(
                            f.name, "ofo_code_format", "error",
                            say("Invalid OFO code '", "'. Expected 4 to 6 numeric digits."), text,
                        ),
                    )
                )
            if "nqf" in name and "sub_framework" not in name:
                digits = F.regexp_replace(first_number(text), "^0+([0-9])", "$1")
                level = digits.try_cast("decimal(38,0)")
                found.append(
                    F.when(
                        filled & digits.isNotNull() & ~F.coalesce(level.between(1, 10), F.lit(False)),
                        entry(
                            f.name, "nqf_level_range", "error",
                            say("NQF Level ", " is outside allowed range (1 to 10).", digits), text,
                        ),
                    ).when(
                        filled & digits.isNull(),
                        entry(
                            f.name, "nqf_level_numeric", "warning",
                            say("Could not parse numeric NQF level from '", "'."), text,
                        ),
                    )
                )
            kind = f.data_type.lower()
            if kind in ("integer", "float"):
                fits = text.rlike(r"^[+-]?[0-9]+$") if kind == "integer" else _number(value).isNotNull()
                found.append(
                    F.when(
                        filled & ~fits,
                        entry(
                            f.name, f"type_{kind}", "warning",
                            say("Value '", f"' cannot be parsed as {kind}."), text,
                        ),
                    )
                )
        if not found:
            found = [F.when(F.lit(False), entry("", "", "", F.lit(""), F.lit("")))]
        return F.filter(F.array(*found), lambda i: i.isNotNull())

    return build


def validate_records(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Add `issues` (array) and `status` (error, warning, valid) to every record."""
    checked = df.withColumn("issues", record_checks(fields)(df))
    error = F.exists("issues", lambda i: i["severity"] == "error")
    warned = F.size("issues") > 0
    if "upstream_issues" in df.columns:
        warned = warned | (F.size("upstream_issues") > 0)
    return checked.withColumn(
        "status", F.when(error, "error").when(warned, "warning").otherwise("valid")
    )


def status_counts(records: DataFrame) -> DataFrame:
    """Record counts by status; valid is what is neither error nor warning."""
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "warning").alias("warnings"),
        (
            F.count(F.lit(1))
            - F.count_if(F.col("status") == "error")
            - F.count_if(F.col("status") == "warning")
        ).alias("valid"),
    )


# Checks of the relational model: column -> (constraint, allowed values, NULL is allowed).
CHECKS: dict[str, tuple[str, tuple[str, ...], bool]] = {
    "nsfas_allowance": ("chk_nsfas_allowance", fixed.ALLOWED_NSFAS, False),
    "confidence": ("chk_confidence", fixed.ALLOWED_CONFIDENCE, False),
    "nqf_sub_framework": ("chk_nqf_sub_framework", fixed.ALLOWED_FRAMEWORKS, False),
    "data_quality_flag": ("chk_data_quality_flag", fixed.ALLOWED_QUALITY_FLAGS, True),
}


def check_violations(
    df: DataFrame,
    checks: Mapping[str, tuple[str, Sequence[str], bool]] = CHECKS,
    keys: Sequence[str] = ("saqa_id",),
) -> Column:
    """Violated CHECK constraints and blank keys of a record, as an array column."""
    found = []
    for column, (constraint, allowed, nullable) in checks.items():
        if column not in df.columns:
            continue
        value = F.col(column).cast("string")
        ok = F.coalesce(value.isin(list(allowed)), F.lit(nullable))
        listed = ",".join(f"'{a}'" for a in allowed)
        message = F.concat(
            F.lit("Value '"),
            F.coalesce(value, F.lit("None")),
            F.lit(f"' violates CHECK ({column} IN ({listed}))."),
        )
        found.append(F.when(~ok, _violation(column, constraint, message, value)))
    for key in keys:
        if key in df.columns:
            value = F.col(key).cast("string")
            found.append(
                F.when(
                    is_blank(value),
                    _violation(key, f"pk_{key}_required", F.lit(f"{key} is required."), value),
                )
            )
    return F.filter(F.array(*found), lambda v: v.isNotNull())


def _violation(column: str, constraint: str, message: Column, value: Column) -> Column:
    return F.struct(
        F.lit(column).alias("column_name"),
        F.lit(constraint).alias("rule_name"),
        message.alias("message"),
        F.coalesce(value, F.lit("None")).alias("raw_value"),
    )


def split_quarantine(
    df: DataFrame,
    checks: Mapping[str, tuple[str, Sequence[str], bool]] = CHECKS,
    keys: Sequence[str] = ("saqa_id",),
    carried: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(rows that may be loaded, review rows of all violations)."""
    checked = df.withColumn("_violations", check_violations(df, checks, keys))
    clean = checked.filter(F.size("_violations") == 0).drop("_violations")
    review = checked.select(*carried, F.inline("_violations")).select(
        *carried,
        F.col("raw_value").alias("original_value"),
        F.col("rule_name").alias("issue"),
        F.col("message").alias("reason"),
        F.lit(None).cast("decimal(5,2)").alias("agreement_score"),
        F.lit(False).alias("resolved"),
    )
    return clean, review


def issue_rollup(issues: DataFrame) -> DataFrame:
    """Unresolved issues by severity and by column; severities without issues count 0."""
    open_issues = issues.filter(~F.coalesce("is_resolved", F.lit(False)))
    counted = open_issues.groupBy("severity", "column_name").agg(F.count(F.lit(1)).alias("n"))
    by_column = counted.groupBy(F.col("column_name").alias("key")).agg(F.sum("n").alias("issues"))
    levels = issues.sparkSession.createDataFrame(
        [("error",), ("warning",), ("info",)], "severity string"
    )
    by_severity = (
        levels.join(counted.groupBy("severity").agg(F.sum("n").alias("issues")), "severity", "left")
        .select(F.col("severity").alias("key"), F.coalesce("issues", F.lit(0)).alias("issues"))
    )
    return by_severity.withColumn("by", F.lit("severity")).unionByName(
        by_column.withColumn("by", F.lit("column"))
    )


def active_issues(issues: DataFrame) -> DataFrame:
    """Counts of issues that are not fixed yet."""
    open_issues = issues.filter(~F.coalesce("is_fixed", F.lit(False)))
    return open_issues.agg(
        F.count_if(F.col("severity") == CRITICAL).alias("critical"),
        F.count_if(F.col("severity") == WARNING).alias("warning"),
        F.count_if("is_auto_fixable").alias("auto_fixable"),
    )


def run_status(summary: DataFrame) -> DataFrame:
    """COMPLETE without critical issues, else WARNING, with the exit code of a check run."""
    clean = F.col("critical_count") == 0
    return summary.select(
        F.when(clean, "COMPLETE").otherwise("WARNING").alias("status"),
        F.when(clean, 0).otherwise(2).alias("exit_code"),
    )


def absent_from_page(cells: DataFrame, pages: DataFrame, part_values: int = PART_VALUES) -> DataFrame:
    """Cells whose value does not occur in the text of the page they name.

    `cells`: doc_id, page, record_id, field, value. The cells of a page are packed where
    they are read and searched together, so words are moved once and a text is sent
    once. Pages of more than `part_values` cells, found by a job that counts, have their
    distinct values searched in parts of that size. Cells of a page without text are absent.
    """
    filled = cells.filter(~is_blank(F.col("value")))
    text = pages.select("doc_id", "page", F.lower("text").alias("_text"))
    crowded = durable(
        filled.groupBy("doc_id", "page")
        .agg((F.count(F.lit(1)) / part_values).cast("int").alias("_more"))
        .filter("_more > 0")
    )
    if crowded.isEmpty():
        return _absent_packed(filled, text)
    same = filled["doc_id"].eqNullSafe(crowded["doc_id"]) & filled["page"].eqNullSafe(crowded["page"])
    few = _absent_packed(filled.join(crowded, same, "left_anti"), text)
    return few.unionByName(_absent_in_parts(filled.join(crowded, same, "left_semi"), crowded, text))


def _absent_packed(filled: DataFrame, text: DataFrame) -> DataFrame:
    """Absent cells of pages whose cells fit into one row: cells and texts meet in one grouping."""
    place = ["doc_id", "page"]
    cell = F.struct(*[c for c in filled.columns if c not in place])
    both = filled.select(*place, cell.alias("_cell")).unionByName(
        text.dropna(subset=place).withColumn("_known", F.col("_text").isNotNull()), allowMissingColumns=True
    )
    packed = both.groupBy(*place).agg(
        F.collect_list("_cell").alias("_cells"),
        # A page that is given several times lacks a value that one of its texts lacks.
        F.when(F.every("_known"), F.collect_list("_text")).alias("_texts"),
    )
    values = F.transform("_cells", lambda c: F.lower(c["value"]))
    found = packed.filter(F.size("_cells") > 0).withColumn("_at", missing_places(F.col("_texts"), values))
    absent = found.select(*place, F.inline(F.transform("_at", lambda i: F.get("_cells", i))))
    return absent.select(*filled.columns)


def _absent_in_parts(filled: DataFrame, crowded: DataFrame, text: DataFrame) -> DataFrame:
    """Absent cells of pages whose values are too many for one row."""
    values = filled.select("doc_id", "page", F.lower("value").alias("_low")).distinct()
    parts = values.join(crowded, ["doc_id", "page"], "left").withColumn(
        "_part", F.pmod(F.xxhash64("_low"), F.coalesce("_more", F.lit(0)) + 1)
    )
    lists = parts.groupBy("doc_id", "page", "_part").agg(F.collect_list("_low").alias("_lows"))
    absent = lists.join(text, ["doc_id", "page"], "left").select("doc_id", "page", F.explode(missing_from(F.col("_text"), F.col("_lows"))).alias("_low"))
    same = filled["doc_id"].eqNullSafe(absent["doc_id"]) & filled["page"].eqNullSafe(absent["page"]) & (F.lower(filled["value"]) == absent["_low"])
    return filled.join(absent, same, "left_semi")
