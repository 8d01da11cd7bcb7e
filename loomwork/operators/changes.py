"""Change data: keyed differences, versions, snapshots by copy-on-write, undo, review.

A snapshot is a DataFrame keyed by entity; a change is one field of one entity with its old and new value as text. Everything
is a function from snapshots to snapshots and change rows, so a batch can be written as a new version directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.session import small

# Fields whose changes are sensitive, and statuses that can be undone.
SENSITIVE = [
    "interest_rate", "max_loan", "min_loan", "max_income", "min_income", "tenure", "moratorium", "loan_percentage",
    "beneficiary_requirements", "eligible_activities", "npa_status", "overdue_status", "fund_utilization",
]
UNDOABLE = ["auto_approved", "approved", "applied"]
NULLABLE = ["valid_from", "valid_to", "availability_type"]


def unpivoted(df: DataFrame, key: str, fields: list[str], value: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias(value)) for f in fields))
    return df.select(key, F.inline(pairs))


def differences(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, old_value, new_value, change): one row for each field that a batch sets or alters.

    A null in the batch says nothing, except in the fields that may be cleared. Typed columns are compared, so 6 equals 6.0.
    """
    o = old.select(key, *(F.col(f).alias(f"_o_{f}") for f in fields), F.lit(True).alias("_old"))
    both = new.select(key, *fields).join(o, key, "left")
    rows = F.array(
        *(
            F.when(
                ~F.col(f).eqNullSafe(F.col(f"_o_{f}")) & (F.col(f).isNotNull() | (F.lit(f in NULLABLE) & F.col("_old").isNotNull())),
                F.struct(F.lit(f).alias("field_name"), F.col(f"_o_{f}").cast("string").alias("old_value"), F.col(f).cast("string").alias("new_value")),
            )
            for f in fields
        )
    )
    kind = F.when(F.col("_old").isNull(), "insert").otherwise("update").alias("change")
    return both.select(key, kind, F.inline(F.filter(rows, lambda r: r.isNotNull())))


def merged(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The next snapshot: a full outer join in which the batch's values win; `version` goes up where a field changed."""
    o = old.select(key, *(F.col(f).alias(f"_o_{f}") for f in fields), F.col("version").alias("_v"))
    n = new.select(key, *fields, F.lit(True).alias("_new"))
    both = o.join(n, key, "full_outer")
    clear = lambda f: F.col("_new").isNotNull() & F.lit(f in NULLABLE)
    value = lambda f: F.when(clear(f), F.col(f)).otherwise(F.coalesce(F.col(f), F.col(f"_o_{f}")))
    altered = F.lit(False)
    for f in fields:
        altered = altered | ~value(f).eqNullSafe(F.col(f"_o_{f}"))
    version = F.when(F.col("_v").isNull(), 1).otherwise(F.col("_v") + F.when(altered & F.col("_new").isNotNull(), 1).otherwise(0))
    return both.select(key, *(value(f).alias(f) for f in fields), version.cast("int").alias("version"))


def last_writer(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of several payloads for a key in a batch, the last."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tagged(changes: DataFrame, approval: DataFrame | None = None) -> DataFrame:
    """Adds is_sensitive and auto_approve, from the approval rules (field_name, is_sensitive, auto_approve) or the defaults."""
    default = F.col("field_name").isin(SENSITIVE)
    if approval is None:
        return changes.withColumns({"is_sensitive": default, "auto_approve": ~default})
    rules = approval.select("field_name", F.col("is_sensitive").alias("_s"), F.col("auto_approve").alias("_a"))
    out = changes.join(small(rules), "field_name", "left")
    return out.withColumns({"is_sensitive": F.coalesce("_s", default), "auto_approve": F.coalesce("_a", ~default)}).drop("_s", "_a")


def superseded(pending: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pending changes become `superseded` where a fresh change speaks of the same field."""
    keys = fresh.select("entity_id", "field_name").distinct().withColumn("_hit", F.lit(True))
    out = pending.join(keys, ["entity_id", "field_name"], "left")
    return out.withColumn("status", F.when((F.col("status") == "pending_review") & F.col("_hit"), "superseded").otherwise(F.col("status"))).drop("_hit")


def can_undo() -> Column:
    return F.col("status").isin(UNDOABLE) & (F.col("field_name") != "created")


def undo_verdicts(changes: DataFrame) -> DataFrame:
    """Adds can_undo, has_newer (a later undoable change of the same field) and undoable, both together."""
    own = F.when(can_undo(), F.col("id"))
    last = F.max(own).over(Window.partitionBy("entity_id", "field_name"))
    out = changes.withColumns({"can_undo": can_undo(), "has_newer": F.coalesce(last > F.col("id"), F.lit(False))})
    return out.withColumn("undoable", F.col("can_undo") & ~F.col("has_newer"))


def applied(values: DataFrame, changes: DataFrame) -> DataFrame:
    """(entity_id, field_name, value) after all changes in order of id: the last one of each field wins."""
    last = changes.groupBy("entity_id", "field_name").agg(F.max_by("new_value", "id").alias("_value"), F.lit(True).alias("_set"))
    out = values.join(last, ["entity_id", "field_name"], "full_outer")
    return out.select("entity_id", "field_name", F.when(F.col("_set"), F.col("_value")).otherwise(F.col("value")).alias("value"))


def undone(values: DataFrame, changes: DataFrame, ids: list[int], reviewer: int) -> tuple[DataFrame, DataFrame]:
    """The values and the change rows after undoing changes that may be undone; others stay as they are."""
    marked = undo_verdicts(changes).withColumn("_go", F.col("undoable") & F.col("id").isin(ids))
    back = marked.where("_go").select("entity_id", "field_name", F.col("old_value").alias("new_value"), "id")
    status = F.when(F.col("_go"), "undone").otherwise(F.col("status"))
    reviewed = F.when(F.col("_go"), F.lit(reviewer)).otherwise(F.col("reviewed_by"))
    rows = marked.withColumns({"status": status, "reviewed_by": reviewed}).select(*changes.columns)
    return applied(values, back), rows


def versions(changes: DataFrame) -> DataFrame:
    """Slowly changing entities: every applied change makes its entity's next version, which lasts until the one after it."""
    w = Window.partitionBy("entity_id").orderBy("effective_from", "id")
    return changes.withColumns({"version_number": F.row_number().over(w), "effective_to": F.lead("effective_from").over(w)})


def citations(batch: DataFrame, old: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Where each field of an entity was last read: fields that the batch fills replace what was cited before."""
    fresh = unpivoted(batch, key, fields, "value").where("value is not null").join(batch.select(key, "source_url"), key)
    kept = old.join(fresh.select(key, "field_name"), [key, "field_name"], "left_anti")
    return kept.select(key, "field_name", "source_url").unionByName(fresh.select(key, "field_name", "source_url"))


def run_status(events: DataFrame) -> DataFrame:
    """(run_id, status): the state after folding events in order; an ended run stays ended."""
    ends = F.col("event").isin("success", "failed", "cancelled", "restricted")
    ended = events.where(ends).groupBy("run_id").agg(F.min_by("event", F.struct("ts", "event_id")).alias("ended"))
    last = events.groupBy("run_id").agg(F.max_by("event", F.struct("ts", "event_id")).alias("last"))
    return last.join(ended, "run_id", "left").select("run_id", F.coalesce("ended", "last").alias("status"))
