"""Decisions and corrections in bulk: versions are appended, never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: What a decision makes of a resource, by its type; others are approved or rejected.
STATUSES = {"insight": ("published", "dismissed")}


def decide(tasks: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tasks with their new status, the decisions that can't be carried out and why, and an audit row for each task that changed.

    tasks: task_id, task_type, status; decisions: task_id, decision (approve or reject), decided_at. Of several decisions on a task the first
    (by time, then approve) counts. A task that isn't open or in progress, or isn't there, changes nothing.
    """
    first = F.min(F.struct("decided_at", "decision"))
    one = decisions.groupBy("task_id").agg(first.alias("x"), F.count("*").alias("n")).select("task_id", "x.decision", "x.decided_at", "n")
    j = one.join(tasks, "task_id", "left")
    can = F.coalesce(F.col("status").isin("open", "in_progress"), F.lit(False))
    named = F.create_map(*(y for k, (a, r) in STATUSES.items() for y in (F.lit(k), F.struct(F.lit(a).alias("a"), F.lit(r).alias("r")))))
    pair = F.try_element_at(named, F.col("task_type"))
    new = F.when(F.col("decision") == "approve", F.coalesce(pair["a"], F.lit("approved"))).otherwise(F.coalesce(pair["r"], F.lit("rejected")))
    done = j.where(can).select("task_id", "task_type", F.lit("resolved").alias("status"), new.alias("resource_status"))
    late = decisions.join(one.select("task_id", F.col("decided_at").alias("first_at"), F.col("decision").alias("first")), "task_id").join(tasks.select("task_id", "status"), "task_id", "left")
    counts = (F.col("decided_at") == F.col("first_at")) & (F.col("decision") == F.col("first"))
    why = F.when(F.col("status").isNull(), "missing").when(~can, F.col("status")).when(~counts, "decided_before")
    refused = late.select("task_id", "decision", "decided_at", why.alias("found")).where("found is not null")
    audit = j.where(can).select("task_id", F.concat_ws("_", "decision", "task_type").alias("action"), "decided_at", F.to_json(F.struct("status")).alias("before_state"), F.to_json(F.struct(F.lit("resolved").alias("status"), new.alias("resource_status"))).alias("after_state"))
    return done, refused, audit


def correct(invoices: DataFrame, corrections: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Invoices with a version appended for each invoice that is corrected, and the corrections that aren't carried out and why.

    invoices: invoice_id, version, root_id, status and fields; corrections: correction_id, invoice_id, changes (map of field to text). A
    correction is for the current version: the highest that isn't superseded, which then is. Of several for one invoice the smallest
    correction_id counts. Only `fields` may change, and texts that don't parse are refused; root_id stays that of the first version.
    """
    current = invoices.where("status <> 'superseded'").groupBy("invoice_id").agg(F.max("version").alias("version"))
    first = corrections.groupBy("invoice_id").agg(F.min("correction_id").alias("first"))
    kinds = {f: invoices.schema[f].dataType for f in fields}
    bad = [F.when(F.try_element_at("changes", F.lit(f)).isNotNull() & F.try_element_at("changes", F.lit(f)).try_cast(k).isNull(), F.lit(f)) for f, k in kinds.items()]
    other = F.array_except(F.map_keys("changes"), F.array(*map(F.lit, fields)))
    j = corrections.join(first, "invoice_id").join(current, "invoice_id", "left")
    why = F.when(F.col("version").isNull(), "no_current_version").when(F.col("correction_id") != F.col("first"), "corrected_before")
    why = why.when(F.size(other) > 0, "field_not_allowed").when(F.size(F.array_compact(F.array(*bad))) > 0, "value_invalid")
    j = j.withColumn("refused", why)
    taken = j.where("refused is null").select("invoice_id", "version", "changes")
    rows = invoices.join(taken, ["invoice_id", "version"], "left")
    hit = F.col("changes").isNotNull()
    old = rows.withColumn("status", F.when(hit, "superseded").otherwise(F.col("status"))).select(invoices.columns)
    new = rows.where(hit).withColumns({f: F.coalesce(F.try_element_at("changes", F.lit(f)).try_cast(k), F.col(f)) for f, k in kinds.items()})
    new = new.withColumn("version", F.col("version") + 1).withColumn("status", F.lit("extracted")).select(invoices.columns)
    return old.unionByName(new), j.where("refused is not null").select("correction_id", "invoice_id", "refused")


def made_versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """invoice_id, version, new_version of each version that correct() has appended."""
    new = after.join(before.select("invoice_id", "version"), ["invoice_id", "version"], "left_anti")
    return new.select("invoice_id", (F.col("version") - 1).alias("version"), F.col("version").alias("new_version"))


def copied_lines(lines: DataFrame, made: DataFrame) -> DataFrame:
    """lines(invoice_id, version, and what a line holds), and a copy of the lines of each version that made_versions() names under its new version.

    Repeated lines are copied as often as they stand; a version without lines has a new version without lines.
    """
    copies = lines.join(made, ["invoice_id", "version"]).withColumn("version", F.col("new_version"))
    return lines.unionByName(copies.select(lines.columns))


def repointed_tasks(tasks: DataFrame, corrections: DataFrame, refused: DataFrame, made: DataFrame) -> DataFrame:
    """tasks(task_id, invoice_id, version, status) after the corrections: a task whose correction (corrections: task_id, correction_id, invoice_id) was
    carried out is resolved and names the new version; the others, those of the same invoice too, stay as they are."""
    done = corrections.join(refused.select("correction_id"), "correction_id", "left_anti").join(made.select("invoice_id", "new_version"), "invoice_id").select("task_id", "new_version")
    rows = tasks.join(done, "task_id", "left")
    hit = F.col("new_version").isNotNull()
    return rows.withColumn("version", F.coalesce("new_version", "version")).withColumn("status", F.when(hit, "resolved").otherwise(F.col("status"))).select(tasks.columns)


#: Priority and allowed actions of a task type (fixed values).
TASK_TYPES = {
    "extraction": ("high", ["approve_proposal", "reject_proposal", "correct_extraction"]),
    "classification": ("normal", ["approve_proposal", "reject_proposal", "correct_classification"]),
    "reconciliation": ("high", ["approve_proposal", "reject_proposal", "correct_reconciliation"]),
    "policy": ("urgent", ["acknowledge_policy"]),
    "insight": ("normal", ["approve_proposal", "reject_proposal", "dismiss_insight"]),
    "other": ("normal", ["reject_proposal"]),
}


def allowed(tasks: DataFrame) -> DataFrame:
    """tasks(task_type, action) with the type's priority and whether the action is allowed; an unknown type allows nothing."""
    kinds = tasks.sparkSession.createDataFrame([(k, p, xs) for k, (p, xs) in TASK_TYPES.items()], "task_type string, priority string, actions array<string>")
    j = tasks.join(F.broadcast(kinds), "task_type", "left")
    return j.withColumn("allowed", F.coalesce(F.array_contains("actions", F.col("action")), F.lit(False))).drop("actions")
