"""Action requests: listing, auditing, validation, state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_blank, strip
from quire.operators.common import running_max, running_sum

# Bulk operations, and the statuses an action passes through.
BULK_OPERATIONS = ["delete", "reindex", "retag"]
REVIEWS = {"approve": "approved", "reject": "rejected"}
BULK_TYPE = "library.bulk"


def list_actions(actions: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of actions, newest first."""
    kept = actions.where(F.col("status") == status) if status else actions
    return kept.orderBy(F.desc("created_at"), F.desc("id")).offset(max(0, offset)).limit(limit)


def audit(actions: DataFrame, status: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Actions by status and inclusive time range, with the total on each row."""
    kept = actions
    if status:
        kept = kept.where(F.col("status") == status)
    if since:
        kept = kept.where(F.col("created_at") >= F.lit(since))
    if until:
        kept = kept.where(F.col("created_at") <= F.lit(until))
    total = kept.agg(F.count("*").alias("n")).select("n").scalar()
    return kept.withColumn("total", total)


def session_actions(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Actions of the asked sessions, latest update first within each."""
    kept = actions.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    return kept.orderBy("session_id", F.desc("updated_at"), F.desc("id"))


def kb_scope(mode: Column, kb_ids: Column, every: Column | None = None) -> Column:
    """none carries no ids, all carries `every` (the ids of the KB table), everything else is a selection
    of the non-blank ids."""
    known = F.when(mode.isin("none", "all"), mode).otherwise("selected")
    ids = F.filter(F.coalesce(kb_ids, F.array().cast("array<string>")), lambda i: ~is_blank(i))
    none = F.array().cast("array<string>")
    chosen = F.when(known == "selected", ids).when(known == "all", none if every is None else every).otherwise(none)
    return F.struct(known.alias("mode"), chosen.alias("kb_ids"))


def every_kb(kbs: DataFrame) -> Column:
    """The ids of a KB table in order, for `kb_scope`."""
    return kbs.agg(F.sort_array(F.collect_set(F.col("kb_id").cast("string"))).alias("ids")).scalar()


def transitions(requests: DataFrame) -> DataFrame:
    """Outcome of every request in order: the new status, or 404 / 409 for one that is not allowed.

    `requests` has action_id, seq (a total order), op (create, approve, reject, execute) and ok,
    whether an execution would succeed.
    """

    seq = F.col("seq")
    keyed = ["action_id"]
    # an action is created once, reviewed once and executed once: each the first that is allowed
    made = requests.where("op = 'create'").groupBy(*keyed).agg(F.min(seq).alias("_made"))
    begun = requests.join(made, keyed, "left")
    reviewed = begun.where(F.col("op").isin(*REVIEWS) & (seq > F.col("_made"))).groupBy(*keyed).agg(F.min(seq).alias("_reviewed"), F.min_by("op", seq).alias("_review"))
    judged = begun.join(reviewed, keyed, "left")
    ready = (F.col("_review") == "approve") & (F.col("op") == "execute") & (seq > F.col("_reviewed"))
    executed = judged.where(ready).groupBy(*keyed).agg(F.min(seq).alias("_executed"))
    full = judged.join(executed, keyed, "left")
    review = F.element_at(F.create_map(*[F.lit(x) for pair in REVIEWS.items() for x in pair]), F.col("op"))
    outcome = (
        F.when(seq == F.col("_made"), "pending")
        .when(F.col("_made").isNull() | (seq < F.col("_made")), "404")
        .when(seq == F.col("_reviewed"), review)
        .when(seq == F.col("_executed"), F.when(F.col("ok"), "completed").otherwise("failed"))
        .otherwise("409")
    )
    return full.select(*requests.columns, outcome.alias("outcome"))


def next_status(status: str | None, op: str, ok: bool) -> str | None:
    """The same rules one request at a time, for state that arrives in pieces: the new status, or
    none if the request is not allowed."""
    allowed = {None: {"create": "pending"}, "pending": REVIEWS, "approved": {"execute": "completed" if ok else "failed"}}
    return allowed.get(status, {}).get(op)


def normalize_record(records: DataFrame) -> DataFrame:
    """Remote action records in local form: one operation, item ids, its parameter, local status.

    `records` has id, title, status, type, targets: array<struct<item_id, operation, kb_id, tags>>.
    """
    operations = F.array_distinct(F.filter(F.transform("targets", lambda t: t["operation"]), lambda o: o.isNotNull() & (o != "")))
    rows = records.withColumn("operation", F.coalesce(F.get(operations, F.lit(0)), F.lit("unknown")))
    first = F.get("targets", F.lit(0))
    items = F.filter(F.transform("targets", lambda t: t["item_id"]), lambda i: i.isNotNull() & (i != ""))
    return rows.select(
        "id", F.coalesce("type", F.lit(BULK_TYPE)).alias("type"), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Action Request")).alias("title"),
        "operation", items.alias("item_ids"), F.when(F.col("operation") == "reindex", first["kb_id"]).alias("kb_id"),
        F.when(F.col("operation") == "retag", first["tags"]).alias("tags"),
        F.when(F.col("status") == "pending", "proposed").otherwise(F.col("status")).alias("status"),
    )


def operation_key(type_: Column, operation: Column) -> Column:
    named = F.coalesce(F.nullif(strip(operation), F.lit("")), F.lit("generic"))
    return F.when(type_ == BULK_TYPE, F.concat(type_, F.lit(":"), named)).otherwise(F.coalesce(F.nullif(type_, F.lit("")), F.lit("unknown")))


def fill_defaults(actions: DataFrame, now: Column, owner: str = "local-policy") -> DataFrame:
    """Stored actions with defaults for title, status, times and policy.

    `actions` has id, type, title, status, operation, created_at and updated_at (text),
    policy: struct<created_by, approval_required, allowed_operations, risk_level>.
    """

    def text(column, default):
        return F.coalesce(F.nullif(strip(F.col(column)), F.lit("")), F.lit(default))

    created = F.coalesce(F.try_to_timestamp("created_at"), now)
    allowed = F.filter(F.coalesce("policy.allowed_operations", F.array().cast("array<string>")), lambda o: ~is_blank(o))
    own = operation_key(F.col("type"), F.col("operation"))
    return actions.select(
        "id", F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit(BULK_TYPE)).alias("type"), text("title", "Action Request").alias("title"),
        F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("proposed")).alias("status"), created.alias("created_at"),
        F.coalesce(F.try_to_timestamp("updated_at"), created).alias("updated_at"),
        text("policy.created_by", owner).alias("created_by"), F.coalesce("policy.approval_required", F.lit(True)).alias("approval_required"),
        F.array_distinct(F.array_append(allowed, own)).alias("allowed_operations"), text("policy.risk_level", "moderate").alias("risk_level"),
    )


def fan_out_targets(actions: DataFrame) -> DataFrame:
    """One target row per item id, with the parameter its operation needs."""
    rows = actions.select("id", "operation", F.posexplode("item_ids").alias("place", "item_id"), "kb_id", "tags")
    return rows.select(
        "id", "place", "item_id", "operation", F.when(F.col("operation") == "reindex", F.col("kb_id")).alias("kb_id"),
        F.when(F.col("operation") == "retag", F.col("tags")).alias("tags"),
    )


def validate(requests: DataFrame) -> DataFrame:
    """Request rows with their cleaned operation and item ids and the first error, if any."""
    operation = F.lower(strip(F.coalesce("operation", F.lit(""))))
    ids = F.array_distinct(F.filter(F.coalesce("item_ids", F.array().cast("array<string>")), lambda i: ~is_blank(i)))
    rows = requests.withColumn("operation", operation).withColumn("item_ids", ids)
    error = (
        F.when(F.coalesce("type", F.lit("")) == "", "type is required")
        .when(F.col("type") != BULK_TYPE, F.concat(F.lit("Unsupported action type: "), "type"))
        .when(is_blank(F.col("session_id")), "chat_session_id is required")
        .when(~F.col("operation").isin(BULK_OPERATIONS), F.concat(F.lit("Unsupported operation: "), "operation"))
        .when(F.size("item_ids") == 0, "payload.item_ids[] is required")
        .when((F.col("operation") == "reindex") & is_blank(F.col("kb_id")), "payload.kb_id is required for reindex")
    )
    return rows.withColumn("error", error)


def bulk_outcomes(targets: DataFrame, items: DataFrame, kbs: DataFrame) -> DataFrame:
    """Outcome per target: ok or the reason it fails.

    `targets` has request, place, item_id, operation, kb_id; `items` has id and has_pdf. A delete
    removes the item for the targets after it in the same request.
    """
    deletes = targets.where("operation = 'delete'").groupBy("request", "item_id").agg(F.min("place").alias("_gone_at"))
    rows = (
        targets.join(items.select(F.col("id").alias("item_id"), "has_pdf", F.lit(True).alias("_known")), "item_id", "left")
        .join(deletes, ["request", "item_id"], "left").join(kbs.select("kb_id", F.lit(True).alias("_kb")).distinct(), "kb_id", "left")
    )
    missing = F.col("_known").isNull() | F.coalesce(F.col("place") > F.col("_gone_at"), F.lit(False))
    reindex = F.col("operation") == "reindex"
    error = (
        F.when(~F.col("operation").isin(BULK_OPERATIONS), F.concat(F.lit("unknown operation: "), "operation"))
        .when(reindex & is_blank(F.col("kb_id")), "kb_id required")
        .when(missing, "not found")
        .when(reindex & ~F.col("has_pdf"), "no PDF available")
        .when(reindex & F.col("_kb").isNull(), F.concat(F.lit("KB not found: "), "kb_id"))
    )
    return rows.select("request", "place", "item_id", "operation", error.isNull().alias("ok"), error.alias("error"))


def bulk_summary(outcomes: DataFrame) -> DataFrame:
    """One row a request: counts and the details of its targets in order."""
    details = F.array_sort(F.collect_list(F.struct("place", "item_id", "operation", "ok", "error")))
    return outcomes.groupBy("request").agg(
        F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), details.alias("details")
    )


def bulk_effects(items: DataFrame, targets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The items after all bulk requests that went well: deleted ones are gone, of several new tags or
    KBs the last one (by request and place) counts. `items` has id, tags and kb_id, `targets` also tags."""
    done = outcomes.where("ok").select("request", "place", "item_id").join(targets, ["request", "place", "item_id"])
    last = F.struct("request", "place")

    def newest(operation: str, column: str) -> Column:
        return F.max_by(column, F.when(F.col("operation") == operation, last))

    changes = done.groupBy(F.col("item_id").alias("id")).agg(
        F.bool_or(F.col("operation") == "delete").alias("_gone"), F.bool_or(F.col("operation") == "retag").alias("_retagged"), newest("retag", "tags").alias("_tags"),
        newest("reindex", "kb_id").alias("_kb"),
    )
    rows = items.join(changes, "id", "left").where(~F.coalesce("_gone", F.lit(False)))
    tags = F.when(F.col("_retagged"), F.col("_tags")).otherwise(F.col("tags"))
    return rows.withColumns({"tags": tags, "kb_id": F.coalesce("_kb", "kb_id")}).select(*items.columns)


def staged_files(stages: DataFrame) -> DataFrame:
    """Staging area after all calls: files by their order, a later call with the same order wins.

    `stages` has area, seq, name, order (null = next free number), size. The next number is one
    past the highest so far and starts at 1.
    """
    # a call without a number adds one to the next number, a call with number x lifts it to x + 1:
    # the next number is the calls without one so far, plus a running maximum
    given = F.when(~F.isnan(F.col("order").cast("double")), F.col("order").cast("long"))
    asked = stages.withColumn("_given", given)
    counted = running_sum(asked, ["area"], ["seq"], {"_free": F.col("_given").isNull().cast("long")})
    lifted = running_max(counted, ["area"], ["seq"], {"_lifted": F.col("_given") + 1 - F.col("_free")})
    numbered = lifted.withColumn("place", F.coalesce("_given", F.col("_free") + F.greatest(F.lit(1), F.col("_lifted"))))
    kept = numbered.groupBy("area", "place").agg(F.max_by(F.struct("name", "size"), "seq").alias("f"))
    return kept.select("area", "place", "f.name", "f.size")
