"""Review workflow: decisions are a log, the latest one per record counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.functions.text import audit_line
from doctables.plans.skew import first_per_key, last_per_key

# What an audit action makes of a record.
ACTION_STATUS = {
    "approve_record": "human_reviewed",
    "reject_record": "error",
    "flag_record": "warning",
}


def review_queue(records: DataFrame, below: float = 0.90) -> DataFrame:
    """Records to look at and why; dismissed ones are left out.

    `records`: confidence, is_flagged, review_dismissed and more.
    """
    low = F.col("confidence") < below
    return (
        records.filter(~F.coalesce("review_dismissed", F.lit(False)))
        .filter(low | F.coalesce("is_flagged", F.lit(False)))
        .withColumn("reason", F.when(low, "Low Confidence").otherwise("Validation Flag"))
    )


def latest_decision(decisions: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last decision per record."""
    return first_per_key(decisions, [key], [F.desc(c) for c in order])


def apply_decisions(
    records: DataFrame, decisions: DataFrame, key: str = "record_id", order: Sequence[str] = ("decided_at",)
) -> DataFrame:
    """Records after accept, edit and reject.

    `decisions`: key, action, field, new_value, note and the order columns. Rejected
    records are removed; edits set the field, the latest edit of a field counts;
    accepted and edited records become human_reviewed and leave the queue.
    """
    last = latest_decision(decisions, key, order).select(
        key, F.col("action").alias("_action"), F.col("note").alias("_note")
    )
    kept = records.join(last, key, "left").filter(
        F.coalesce(F.col("_action") != "reject", F.lit(True))
    )
    edits = decisions.filter("action = 'edit'")
    fields = [c for c in records.columns if c not in (key, "status", "is_flagged", "review_dismissed", "audit_trail")]
    at = F.struct(*order)
    patch = edits.groupBy(key).agg(
        *[F.max_by("new_value", F.when(F.col("field") == f, at)).alias(f"_new_{f}") for f in fields]
    )
    reviewed = F.col("_action").isin("accept", "edit")
    types = dict(records.dtypes)
    out = kept.join(patch, key, "left").withColumns(
        {f: F.coalesce(F.col(f"_new_{f}").try_cast(types[f]), F.col(f)) for f in fields}
        | {
            "status": F.when(reviewed, "human_reviewed").otherwise(F.col("status")),
            "is_flagged": F.when(reviewed, False).otherwise(F.col("is_flagged")),
            "review_dismissed": F.coalesce(reviewed, F.lit(False)) | F.col("review_dismissed"),
        }
    )
    if "audit_trail" in records.columns:
        out = mark_reviewed(out, reviewed, F.col("_note"))
    return out.drop("_action", "_note", *[f"_new_{f}" for f in fields])


def mark_reviewed(records: DataFrame, which: Column, note: Column, moment: Column | None = None) -> DataFrame:
    """Append the review to the audit trail of the chosen records."""
    # The texts of the review note.
    text = F.concat(F.lit("Reviewed by human operator: "), F.coalesce(note, F.lit("Accepted")))
    line = audit_line(F.current_timestamp() if moment is None else moment, text)
    return records.withColumn(
        "audit_trail",
        F.when(which, F.array_append("audit_trail", line)).otherwise(F.col("audit_trail")),
    )


def action_status(action: Column) -> Column:
    """Status an audit action sets; NULL for actions that set none."""
    out = F.lit(None).cast("string")
    for name, status in ACTION_STATUS.items():
        out = F.when(action == name, status).otherwise(out)
    return out


def apply_audits(
    records: DataFrame, audits: DataFrame, key: str = "record_id", order: Sequence[str] = ("created_at",)
) -> DataFrame:
    """Record status after the latest audit action that sets one."""
    setting = audits.withColumn("_status", action_status(F.col("action"))).filter("_status is not null")
    last = latest_decision(setting, key, order).select(key, "_status")
    return (
        records.join(last, key, "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .drop("_status")
    )


def edit_audits(
    old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], note: str = "Manual record edit"
) -> DataFrame:
    """One audit row per changed field, or one update row for an unchanged record."""
    renamed = new.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = old.join(renamed, key)
    changes = F.filter(
        F.array(
            *[
                F.when(
                    ~F.col(f).eqNullSafe(F.col(f"_new_{f}")),
                    F.struct(
                        F.lit("edit_field").alias("action"),
                        F.lit(f).alias("field_name"),
                        F.col(f).cast("string").alias("old_value"),
                        F.col(f"_new_{f}").cast("string").alias("new_value"),
                        F.lit(note).alias("reason"),
                    ),
                )
                for f in fields
            ]
        ),
        lambda c: c.isNotNull(),
    )
    none = F.lit(None).cast("string")
    unchanged = F.array(
        F.struct(
            F.lit("update_record").alias("action"),
            none.alias("field_name"),
            none.alias("old_value"),
            none.alias("new_value"),
            F.lit("Manual review update").alias("reason"),
        )
    )
    return joined.withColumn("_changes", changes).select(
        key, F.inline(F.when(F.size("_changes") > 0, F.col("_changes")).otherwise(unchanged))
    )


def resolve_issues(
    issues: DataFrame, resolutions: DataFrame, records: DataFrame, key: str = "record_id", order: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(issues, records, audits) after resolutions, with corrected values applied.

    `issues`: issue_id, record_id, column_name, rule_name, is_resolved. `resolutions`:
    issue_id, is_resolved, resolved_by, comment, corrected_value; of several for one
    issue the last by `order` counts (`last_per_key`).
    """
    done = last_per_key(resolutions, "issue_id", order).withColumnRenamed("is_resolved", "_resolved")
    joined = issues.join(done, "issue_id", "left")
    updated = joined.withColumn("is_resolved", F.coalesce("_resolved", "is_resolved")).drop("_resolved")
    fixes = joined.filter(F.col("corrected_value").isNotNull() & F.col("column_name").isNotNull())
    fields = [c for c in records.columns if c not in (key, "status")]
    types = dict(records.dtypes)
    patch = fixes.groupBy(key).agg(
        *[
            F.max_by("corrected_value", F.when(F.col("column_name") == f, F.col("issue_id"))).alias(
                f"_new_{f}"
            )
            for f in fields
        ]
    ).withColumn("_fixed", F.lit(True))
    patched = (
        records.join(patch, key, "left")
        .withColumns(
            {f: F.coalesce(F.col(f"_new_{f}").try_cast(types[f]), F.col(f)) for f in fields}
            | {"status": F.when(F.col("_fixed"), "human_reviewed").otherwise(F.col("status"))}
        )
        .drop("_fixed", *[f"_new_{f}" for f in fields])
    )
    values = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])
    old_values = records.select(key, values.alias("_values"))
    audits = fixes.join(old_values, key).select(
        key,
        F.lit("resolve_issue").alias("action"),
        F.col("column_name").alias("field_name"),
        F.col("_values")[F.col("column_name")].alias("old_value"),
        F.col("corrected_value").alias("new_value"),
        F.concat(
            F.lit("Resolved issue '"), "rule_name", F.lit("': "), F.coalesce("comment", F.lit(""))
        ).alias("reason"),
        F.coalesce("resolved_by", F.lit("Researcher")).alias("reviewed_by"),
    )
    return updated, patched, audits


def resolve_conflicts(
    conflicts: DataFrame, resolutions: DataFrame, key: str = "conflict_id", order: str | None = None
) -> DataFrame:
    """Conflicts with their resolution and the value it chooses.

    `resolutions`: key, resolution (accepted_a, accepted_b, manual, rejected),
    manual_value, resolved_by; of several for one conflict the last by `order` counts.
    """
    done = last_per_key(resolutions, key, order).withColumnRenamed("resolution", "_resolution")
    chosen = (
        F.when(F.col("_resolution") == "accepted_a", F.col("value_a"))
        .when(F.col("_resolution") == "accepted_b", F.col("value_b"))
        .when(F.col("_resolution") == "manual", F.col("manual_value"))
    )
    return (
        conflicts.join(done, key, "left")
        .withColumns(
            {"resolved_value": chosen, "resolution": F.coalesce("_resolution", "resolution")}
        )
        .drop("_resolution", "manual_value")
    )


def resolve_review(
    items: DataFrame, resolutions: DataFrame, key: str = "review_id", order: str | None = None
) -> DataFrame:
    """Review items with resolved, resolved_by and resolved_at taken from resolutions.

    Of several for one item the last by `order` counts.
    """
    done = last_per_key(resolutions, key, order).select(
        key,
        F.col("resolved").alias("_resolved"),
        F.col("resolved_by").alias("_by"),
        F.col("resolved_at").alias("_at"),
    )
    return (
        items.join(done, key, "left")
        .withColumns(
            {
                "resolved": F.coalesce("_resolved", "resolved"),
                "resolved_by": F.coalesce("_by", "resolved_by"),
                "resolved_at": F.coalesce("_at", "resolved_at"),
            }
        )
        .drop("_resolved", "_by", "_at")
    )


def verify_datasets(
    datasets: DataFrame, verifications: DataFrame, key: str = "dataset_id"
) -> tuple[DataFrame, DataFrame]:
    """(datasets signed off, activity rows). `verifications`: key, verified_by, verified_at, notes."""
    signed = datasets.join(verifications, key, "left").withColumn(
        "status", F.when(F.col("verified_by").isNotNull(), "verified").otherwise(F.col("status"))
    )
    rows = verifications.join(datasets.select(key, "name"), key)
    return signed, activity(
        rows,
        "dataset",
        F.col(key),
        "verified",
        F.concat(F.lit("Verified dataset '"), "name", F.lit("'.")),
        F.col("verified_by"),
        F.col("verified_at"),
    )


def activity(
    rows: DataFrame,
    entity_type: str,
    entity_id: Column,
    action: str,
    description: Column,
    user: Column,
    created_at: Column | None = None,
) -> DataFrame:
    """Activity-log rows, to be appended."""
    return rows.select(
        F.lit(entity_type).alias("entity_type"),
        entity_id.cast("string").alias("entity_id"),
        F.lit(action).alias("action"),
        description.alias("description"),
        F.coalesce(user, F.lit("Researcher")).alias("user"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )
