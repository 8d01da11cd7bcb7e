"""Promotion of staged records: gate, match, differential update with versions, retirement of duplicates, partners by key.

A batch is folded first: of several records for one entity the last value of each field counts, as if they had been applied
one after the other. Everything is joins and aggregates over the batch and the current rows; results are new rows, never updates in place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions.text import entity_key
from loomwork.operators.changes import NULLABLE, SENSITIVE, can_undo, undo_verdicts
from loomwork.operators.rules import derived_rules
from loomwork.operators.runs import appended_note
from loomwork.session import checkpointed

# Fields that a scheme's insertion reports, those that a partner's update compares, those that are cited, open review states, live states.
SCHEME_FIELDS = [
    "min_income", "max_income", "min_loan", "max_loan", "interest_rate", "interest_rate_type", "tenure", "moratorium", "loan_percentage",
    "beneficiary_requirements", "eligible_activities", "required_documents", "application_process", "availability_type", "target_gender",
]
PARTNER_FIELDS = ["phone", "email", "address", "website", "state", "district", "status", "organization", "latitude", "longitude"]
CITED = ["max_loan", "interest_rate", "max_income", "tenure", "required_documents", "name"]
PENDING = ["pending_review", "detected", "conflict"]
LIVE = ["active", "unavailable"]
PARTS = 64


def gated(staging: DataFrame, good: Column) -> DataFrame:
    """Adds status: `rejected_non_scheme` for what is no scheme, `compared` for what goes on."""
    return staging.withColumn("status", F.when(F.coalesce(good, F.lit(False)), "compared").otherwise("rejected_non_scheme"))


def stamped(staging: DataFrame, documents: DataFrame) -> DataFrame:
    """scraping_run_id of a record, or that of the raw document (id, scraping_run_id) it came from."""
    runs = documents.select(F.col("id").alias("raw_document_id"), F.col("scraping_run_id").alias("_run"))
    out = staging.join(runs, "raw_document_id", "left")
    return out.withColumn("scraping_run_id", F.coalesce(F.nullif("scraping_run_id", F.lit(0)), "_run")).drop("_run")


def matched(staging: DataFrame, schemes: DataFrame) -> DataFrame:
    """Adds scheme_id: the scheme with the record's key, else a live one of its source whose stable key is equal.

    Of several such, one whose name contains the record's, or is contained in it, comes first, then the smallest id.
    """
    exact = schemes.groupBy(F.col("canonical_key").alias("entity_key")).agg(F.min("id").alias("_exact"))
    out = staging.join(exact, "entity_key", "left").withColumn("_norm", F.nullif(entity_key(F.col("entity_key")), F.lit("")))
    live = schemes.where(F.col("status").isin(LIVE)).select("source_id", F.col("id").alias("_id"), F.lower("name").alias("_name"), entity_key(F.col("canonical_key")).alias("_norm"))
    asked = out.where("_exact is null and _norm is not null").select("staging_id", "source_id", "_norm", F.lower(F.coalesce("name", F.lit(""))).alias("_own"))
    akin = F.coalesce(F.col("_name").contains(F.col("_own")) | F.col("_own").contains(F.col("_name")), F.lit(False))
    near = asked.join(live, ["source_id", "_norm"]).groupBy("staging_id").agg(F.min_by("_id", F.struct((~akin).alias("far"), F.col("_id"))).alias("_near"))
    return out.join(near, "staging_id", "left").withColumn("scheme_id", F.coalesce("_exact", "_near")).drop("_exact", "_near", "_norm")


def folded(staging: DataFrame, keys: list[str], fields: list[str], clearable: list[str]) -> DataFrame:
    """One row for each entity: the last non-null value of each field by staging_id; fields that may be cleared take the last record's."""
    last = lambda c: F.max_by(c, "staging_id" if c in clearable else F.when(F.col(c).isNotNull(), F.col("staging_id"))).alias(c)
    return staging.groupBy(*keys).agg(F.max("staging_id").alias("staging_id"), *(last(c) for c in fields))


def changed_fields(both: DataFrame, fields: list[str], clearable: list[str], keep: list[str]) -> DataFrame:
    """Rows (keep, field_name, old_value, new_value) of fields whose value differs from the one in the column `_o_field`."""
    rows = F.array(
        *(
            F.when(
                ~F.col(f).eqNullSafe(F.col(f"_o_{f}")) & (F.col(f).isNotNull() | F.lit(f in clearable)),
                F.struct(F.lit(f).alias("field_name"), F.col(f"_o_{f}").cast("string").alias("old_value"), F.col(f).cast("string").alias("new_value")),
            )
            for f in fields
        )
    )
    return both.select(*keep, F.inline(F.filter(rows, lambda r: r.isNotNull())))


def numbered(df: DataFrame, key: str, after: Column, name: str) -> DataFrame:
    """Numbers from `after` + 1 for rows with distinct keys, in parts, so that no task sees all rows."""
    df = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    counts = df.groupBy("_part").agg(F.count("*").alias("_n"))  # at most PARTS rows
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return df.withColumn("_rank", rank).join(F.broadcast(offsets), "_part").withColumn(name, after + F.col("_offset") + F.col("_rank")).drop("_part", "_rank", "_offset")


def promoted_schemes(staging: DataFrame, schemes: DataFrame, as_of: str, approval: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(schemes, changes, versions) after a batch of accepted records: see `promoted_batch`."""
    return promoted_batch(staging, schemes, as_of, approval)[:3]


def promoted_batch(staging: DataFrame, schemes: DataFrame, as_of: str, approval: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(schemes, changes, versions, batch) after a batch of accepted records; batch: one row for each entity that was spoken of, with its id.

    staging(staging_id, entity_key, source_id, source_url, name, description, fields...), schemes(id, canonical_key, source_id, name, description, status,
    current_version, last_verified, fields...): both with the same fields. A new scheme reports its stated SCHEME_FIELDS and is at version 1; a
    known one reports every field that differs, and one version more where any does. Where a known one changed, other live schemes
    of its source with the same stable key are discontinued; that covers one that held the new key before. A known one's source_url follows
    the batch without a report or a version.
    """
    skip = {"id", "canonical_key", "source_id", "source_url", "status", "current_version", "last_verified", "name", "description"}
    fields = [c for c in schemes.columns if c not in skip]
    clearable = [f for f in fields if f in NULLABLE]
    at = F.lit(as_of).cast("timestamp")
    found = matched(staging, schemes).withColumn("_entity", F.coalesce(F.col("scheme_id").cast("string"), F.concat(F.lit("new "), "entity_key")))
    batch = folded(found, ["_entity", "scheme_id"], ["entity_key", "source_id", "source_url", "name", "description", *fields], clearable)

    new = batch.where("scheme_id is null")
    most = schemes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_most"))
    new = numbered(new.join(F.broadcast(most), F.lit(True)), "_entity", F.col("_most"), "id")
    gender = {"target_gender": F.coalesce(F.nullif("target_gender", F.lit("")), F.lit("any"))} if "target_gender" in fields else {}
    reported = [f for f in SCHEME_FIELDS if f in fields]
    created = changed_fields(new.withColumns({f"_o_{f}": F.lit(None).cast(dict(new.dtypes)[f]) for f in reported}), reported, [], ["id", "entity_key", "source_id"])
    inserted = new.withColumns({"name": F.coalesce("name", F.lit("Unnamed scheme")), "status": F.lit("active"), "current_version": F.lit(1), "last_verified": at, **gender})
    inserted = inserted.withColumnRenamed("entity_key", "canonical_key").select(*schemes.columns)

    old = schemes.select(F.col("id").alias("scheme_id"), *(F.col(c).alias(f"_o_{c}") for c in schemes.columns if c != "id"))
    known = batch.where("scheme_id is not null").join(old, "scheme_id").withColumn("canonical_key", F.col("entity_key"))
    known = known.withColumns({c: F.nullif(c, F.lit("")) for c in ("name", "description", "canonical_key")})
    keep = [F.col("scheme_id").alias("id"), F.col("_o_canonical_key"), "entity_key", F.col("_o_source_id").alias("source_id")]
    altered = changed_fields(known, ["name", "canonical_key", "description", *fields], clearable, keep)
    touched = altered.groupBy("id").agg(F.lit(True).alias("_touched"))
    value = lambda c: (F.col(c) if c in clearable else F.coalesce(c, f"_o_{c}")).alias(c)
    url = F.coalesce(F.nullif("source_url", F.lit("")), "_o_source_url").alias("_n_source_url")
    after = known.select(F.col("scheme_id").alias("id"), url, *(value(c).alias(f"_n_{c}") for c in ("name", "canonical_key", "description", *fields)), F.lit(True).alias("_known"))
    rows = schemes.join(after, "id", "left").join(touched, "id", "left")
    new_value = lambda c: F.when(F.col("_known"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in ("name", "canonical_key", "description", "source_url", *fields) else F.col(c)
    rows = rows.withColumns(
        {
            "current_version": F.coalesce("current_version", F.lit(1)) + F.when(F.col("_touched"), 1).otherwise(0),
            "last_verified": F.when(F.col("_touched"), at).otherwise(F.col("last_verified")),
        }
    ).select(*(new_value(c) for c in schemes.columns), F.coalesce("_touched", F.lit(False)).alias("_touched"))
    norm = F.nullif(entity_key(F.col("canonical_key")), F.lit(""))
    winners = rows.where("_touched").select("source_id", norm.alias("_norm"), "id").where("_norm is not null and source_id is not null")
    winners = winners.groupBy("source_id", "_norm").agg(F.min("id").alias("_least"), F.max("id").alias("_greatest"))
    out = rows.withColumn("_norm", norm).join(winners, ["source_id", "_norm"], "left")
    beaten = F.col("status").isin(LIVE) & ((F.col("_least") != F.col("id")) | (F.col("_greatest") != F.col("id")))
    out = out.withColumn("status", F.when(F.coalesce(beaten, F.lit(False)), "discontinued").otherwise(F.col("status"))).select(*schemes.columns, "_touched")
    now = out.drop("_touched").unionByName(inserted)

    changes = created.unionByName(altered.select("id", "entity_key", "source_id", "field_name", "old_value", "new_value")).withColumnRenamed("id", "entity_id")
    sensitive = F.col("field_name").isin(SENSITIVE) if approval is None else approval
    changes = changes.withColumns({"status": F.lit("auto_approved"), "is_sensitive": sensitive, "detected_at": at})
    fresh = out.where("_touched").drop("_touched").unionByName(inserted)
    spoken = new.drop("scheme_id").unionByName(batch.where("scheme_id is not null").withColumnRenamed("scheme_id", "id"), allowMissingColumns=True)
    return now, changes, versions_of(fresh, at), spoken


@dataclass(frozen=True)
class Promotion:
    """All that a batch of staged records leads to."""

    schemes: DataFrame
    changes: DataFrame
    versions: DataFrame
    waiting: DataFrame
    citations: DataFrame
    rules: DataFrame


def promote(staging: DataFrame, schemes: DataFrame, as_of: str, waiting: DataFrame, citations: DataFrame, stored_rules: DataFrame, approval: Column | None = None) -> Promotion:
    """Schemes, changes and versions of `promoted_batch`, and in the same flow:

    waiting(entity_id, field_name, status, notes, ...): changes of a known scheme's field that wait for a review are `superseded`, with a note, where
    the batch set that field. citations(entity_id, field_name, source_id, source_url, last_verified): new and changed schemes cite
    where each of CITED that the batch states was read, their name always, in place of what was cited before. stored_rules(scheme_id, ...): new and
    changed schemes without any rule get those of their largest income and loan and of their categories.
    """
    now, changes, versions, batch = promoted_batch(staging, schemes, as_of, approval)
    changes, now = checkpointed(changes), checkpointed(now)  # several outputs follow from them
    return Promotion(now, changes, versions, superseded(waiting, changes), cited(batch, now, changes, citations, as_of), first_rules(now, changes, stored_rules))


def touched_ids(changes: DataFrame, name: str = "id") -> DataFrame:
    return changes.select(F.col("entity_id").alias(name)).distinct()


def superseded(waiting: DataFrame, changes: DataFrame) -> DataFrame:
    """Names, keys and descriptions close nothing."""
    hit = changes.where(~F.col("field_name").isin("name", "canonical_key", "description")).select("entity_id", "field_name").distinct().withColumn("_hit", F.lit(True))
    out = waiting.join(hit, ["entity_id", "field_name"], "left")
    closes = F.col("status").isin(PENDING) & F.col("_hit").isNotNull()
    note = appended_note(F.col("notes"), F.lit("superseded by auto-applied crawl"))
    return out.withColumns({"notes": F.when(closes, note).otherwise(F.col("notes")), "status": F.when(closes, "superseded").otherwise(F.col("status"))}).select(*waiting.columns)


def cited(batch: DataFrame, schemes: DataFrame, changes: DataFrame, citations: DataFrame, as_of: str) -> DataFrame:
    """Citations after a batch. Without any address, nothing is cited."""
    own = batch.join(schemes.select("id", F.col("source_url").alias("_own")).join(touched_ids(changes), "id", "left_semi"), "id")
    url = F.coalesce(F.nullif("source_url", F.lit("")), F.nullif("_own", F.lit("")))
    said = F.array_compact(F.array(*(F.when(F.col(f).isNotNull() | F.lit(f == "name"), F.lit(f)) for f in CITED if f in batch.columns)))
    fresh = own.select(F.col("id").alias("entity_id"), F.explode(said).alias("field_name"), "source_id", url.alias("source_url"), F.lit(as_of).cast("timestamp").alias("last_verified"))
    fresh = fresh.where("source_url is not null")
    return citations.join(fresh, ["entity_id", "field_name"], "left_anti").select(*fresh.columns).unionByName(fresh)


def first_rules(schemes: DataFrame, changes: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored rules, and for new and changed schemes that have none the rules that their columns state."""
    bare = schemes.join(touched_ids(changes), "id", "left_semi").withColumnRenamed("id", "scheme_id").join(stored.select("scheme_id").distinct(), "scheme_id", "left_anti")
    made = derived_rules(bare).where(F.concat_ws(" ", "rule_type", "operator").isin("income lte", "loan_amount lte", "category in"))
    return stored.unionByName(made, allowMissingColumns=True).select(*stored.columns)


def versions_of(rows: DataFrame, at: Column) -> DataFrame:
    """(scheme_id, version_number, snapshot, effective_from, status) of rows as they now stand."""
    shown = [c for c in rows.columns if c not in ("id", "current_version", "last_verified")]
    return rows.select(
        F.col("id").alias("scheme_id"), F.col("current_version").alias("version_number"), F.to_json(F.struct(*shown)).alias("snapshot"), at.alias("effective_from"), F.lit("active").alias("status")
    )


def promoted_partners(staging: DataFrame, partners: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(partners, changes) after a batch: a new key reports `created`, a known one each of PARTNER_FIELDS that differs.

    Both tables: canonical_key, name, fields; partners also id, last_verified. Every partner of the batch is verified as of now. Other columns of partners
    (source_id, source_url, partner_type) come from the batch for a new key, null where it lacks them, and stay for a known one.
    """
    fields = [f for f in PARTNER_FIELDS if f in partners.columns]
    other = [c for c in partners.columns if c not in ("id", "canonical_key", "name", "last_verified", *fields)]
    at = F.lit(as_of).cast("timestamp")
    staging = staging.withColumns({"canonical_key": F.col("entity_key"), **{c: F.lit(None).cast(partners.schema[c].dataType) for c in other if c not in staging.columns}})
    batch = folded(staging, ["canonical_key"], ["name", *fields, *other], [])
    old = partners.select("canonical_key", "id", *(F.col(f).alias(f"_o_{f}") for f in fields))
    both = batch.join(old, "canonical_key", "left")
    most = partners.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_most"))
    new = numbered(both.where("id is null").drop("id").join(F.broadcast(most), F.lit(True)), "canonical_key", F.col("_most"), "id")
    created = new.select("id", "canonical_key", F.lit("created").alias("field_name"), F.lit(None).cast("string").alias("old_value"), F.col("name").alias("new_value"))
    altered = changed_fields(both.where("id is not null"), fields, [], ["id", "canonical_key"])
    changes = created.unionByName(altered).withColumnsRenamed({"id": "entity_id", "canonical_key": "entity_key"}).withColumn("status", F.lit("auto_approved"))
    inserted = new.withColumns({"name": F.coalesce("name", F.lit("Unnamed partner")), "last_verified": at, **({"status": F.coalesce("status", F.lit("active"))} if "status" in fields else {})})
    patch = batch.select("canonical_key", *(F.col(f).alias(f"_n_{f}") for f in fields), F.lit(True).alias("_seen"))
    rows = partners.join(patch, "canonical_key", "left").withColumns({f: F.coalesce(f"_n_{f}", f) for f in fields} | {"last_verified": F.when(F.col("_seen"), at).otherwise(F.col("last_verified"))})
    return rows.select(*partners.columns).unionByName(inserted.select(*partners.columns)), changes


def partner_links(staging: DataFrame, partners: DataFrame, schemes: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping(partner_id, scheme_id, eligibility_status, source_id) after a batch whose records may name a scheme by linked_scheme_key.

    A record links the partner of its key, which `promoted_partners` knows by then, with the scheme of that key, once; a key without a scheme links nothing.
    """
    asked = staging.where(F.coalesce("linked_scheme_key", F.lit("")) != "").select(F.col("entity_key").alias("canonical_key"), "linked_scheme_key").distinct()
    own = partners.groupBy("canonical_key").agg(F.min(F.struct(F.col("id").alias("partner_id"), "source_id")).alias("p"))
    to = schemes.groupBy(F.col("canonical_key").alias("linked_scheme_key")).agg(F.min("id").alias("scheme_id"))
    links = asked.join(own, "canonical_key").join(to, "linked_scheme_key").select("p.partner_id", "scheme_id", F.lit("eligible").alias("eligibility_status"), "p.source_id").distinct()
    return mapping.unionByName(links.join(mapping, ["partner_id", "scheme_id"], "left_anti").select(*mapping.columns))


def undo_each(changes: DataFrame, asked: DataFrame, reviewer: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, applied, refused) of asked(id), undone one after the other, the newest first.

    So a change goes back if every newer one of its field that could be undone is asked for as well; applied has a row for each, with its
    step: the highest step of a field is the value that stays.
    """
    own = changes.join(asked.select("id").distinct().withColumn("_asked", F.lit(True)), "id", "left")
    field = Window.partitionBy("entity_id", "field_name")
    kept = F.max(F.when(can_undo() & F.col("_asked").isNull(), F.col("id"))).over(field)
    own = own.withColumn("_go", F.col("_asked").isNotNull() & can_undo() & (F.coalesce(kept, F.col("id")) <= F.col("id")))
    why = F.when(F.col("field_name") == "created", "Cannot undo entity creation via field undo").when(~can_undo(), "Change is not undoable")
    refused = own.where(F.col("_asked") & ~F.col("_go")).select("id", why.otherwise("A newer change was applied for this field; undo that first").alias("problem"))
    back = own.where("_go").select("id", "entity_id", "field_name", F.col("old_value").alias("new_value"))
    back = back.withColumn("step", F.row_number().over(field.orderBy(F.desc("id"))))
    rows = own.withColumns({"status": F.when(F.col("_go"), "undone").otherwise(F.col("status")), "reviewed_by": F.when(F.col("_go"), F.lit(reviewer)).otherwise(F.col("reviewed_by"))})
    return rows.select(*changes.columns), back, refused


def bumped(entities: DataFrame, applied: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(entities, versions) after changes (id, entity_id) are applied: each is one version more, numbered in order of id."""
    at = F.lit(as_of).cast("timestamp")
    n = applied.groupBy("entity_id").agg(F.count("*").cast("int").alias("_n"))
    known = entities.select(F.col("id").alias("entity_id"), F.coalesce("current_version", F.lit(1)).alias("_v"))
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy("id"))
    versions = applied.withColumn("_r", rank).join(known, "entity_id").select("entity_id", F.col("id").alias("change_id"), (F.col("_v") + F.col("_r")).alias("version_number"))
    out = entities.join(n.withColumnRenamed("entity_id", "id"), "id", "left")
    more = {"current_version": F.coalesce("current_version", F.lit(1)) + F.coalesce("_n", F.lit(0)), "last_verified": F.when(F.col("_n").isNotNull(), at).otherwise(F.col("last_verified"))}
    return out.withColumns(more).select(*entities.columns), versions


def reviewed(changes: DataFrame, decisions: DataFrame, reviewer: int) -> DataFrame:
    """Changes with decisions(id, approve): `approved` or `rejected`, and who said so."""
    own = decisions.select("id", F.col("approve").alias("_a"))
    out = changes.join(own, "id", "left")
    status = F.when(F.col("_a"), "approved").when(~F.col("_a"), "rejected").otherwise(F.col("status"))
    return out.withColumns({"status": status, "reviewed_by": F.when(F.col("_a").isNotNull(), F.lit(reviewer)).otherwise(F.col("reviewed_by"))}).select(*changes.columns)


def flushed(changes: DataFrame, reviewer: int = 0) -> tuple[DataFrame, DataFrame]:
    """(changes, applied): every change that still waits is applied, in order of id, and marked auto_approved."""
    waits = F.col("status").isin(PENDING)
    done = changes.withColumns({"reviewed_by": F.when(waits, F.lit(reviewer)).otherwise(F.col("reviewed_by")), "status": F.when(waits, "auto_approved").otherwise(F.col("status"))})
    return done, changes.where(waits)


def undo(changes: DataFrame, asked: DataFrame, reviewer: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, applied, refused) of asked(id): undone ones give back the old value; refused ones say why."""
    marked = undo_verdicts(changes).join(asked.select("id", F.lit(True).alias("_asked")), "id", "left")
    go = F.coalesce(F.col("_asked"), F.lit(False)) & F.col("undoable")
    why = F.when(F.col("field_name") == "created", "Cannot undo entity creation via field undo").when(~can_undo(), "Change is not undoable")
    why = why.otherwise("A newer change was applied for this field; undo that first")
    refused = marked.where(F.col("_asked") & ~F.col("undoable")).select("id", why.alias("problem"))
    back = marked.where(go).select("id", "entity_id", "field_name", F.col("old_value").alias("new_value"))
    rows = marked.withColumns({"status": F.when(go, "undone").otherwise(F.col("status")), "reviewed_by": F.when(go, F.lit(reviewer)).otherwise(F.col("reviewed_by"))})
    return rows.select(*changes.columns), back, refused
