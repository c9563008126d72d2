"""Review: routing, decisions and their history, as tables of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ranges
from ..functions.cells import col
from ..resources import values as V

#: Decisions and the state that each leads to.
STATES = [("approve", "approved"), ("reject", "rejected"), ("correct", "corrected")]


def review_priority(errors, warnings, confidence, completeness) -> Column:
    """10 an error, 3 a warning, 5 for lack of confidence and 2 for gaps."""
    return col(errors) * 10.0 + col(warnings) * 3.0 + (1.0 - col(confidence)) * 5.0 + (1.0 - col(completeness)) * 2.0


def _count(severity: str) -> Column:
    return F.size(F.filter("issues", lambda i: i["severity"] == severity))


def route_rows(validated: DataFrame) -> DataFrame:
    """validated with errors, warnings, priority, state and the system's event id, equal on every run."""
    out = validated.withColumn("errors", _count("error")).withColumn("warnings", _count("warning"))
    out = out.withColumn("priority", F.round(review_priority("errors", "warnings", "overall_confidence", "completeness"), 4))
    out = out.withColumn("state", F.when(F.col("can_auto_approve"), "auto_approved").otherwise("pending_review"))
    action = F.when(F.col("can_auto_approve"), "auto_approve").otherwise("submit_for_review")
    batch = F.col("batch_id").cast("string") if "batch_id" in validated.columns else F.lit("")
    return out.withColumn("event_id", F.sha2(F.concat_ws("|", batch, F.col("row_number").cast("string"), action), 256))


def judged(routed: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """decisions with previous_state, new_state and refusal (null if the decision holds).

    In order of time and event id, the first decision on a pending row that names a known action, and for a
    correction says what is corrected, holds; any later one is refused. The window is over a row's own decisions.
    """
    new = F.coalesce(*(F.when(F.col("action") == a, F.lit(s)) for a, s in STATES))
    d = decisions.join(routed.select(*keys, F.col("state").alias("routed_state")), keys, "left").withColumn("new_state", new)
    sound = F.when(F.col("routed_state").isNull(), "unknown_row").when(F.col("new_state").isNull(), "unknown_action").when(F.col("routed_state") != "pending_review", "not_pending").when((F.col("action") == "correct") & F.col("corrections").isNull(), "no_corrections")
    order = Window.partitionBy(*keys).orderBy("decided_at", "event_id")
    before = F.count_if(F.col("_sound").isNull()).over(order.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_sound", sound)
    return d.withColumn("refusal", F.coalesce(F.col("_sound"), F.when(F.coalesce(before, F.lit(0)) > 0, "not_pending"))).drop("_sound")


def apply_decisions(routed: DataFrame, decisions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, audit, refused): each row's state now, all events that hold, and refused decisions with the reason.
    Corrections are kept with their event and never written into values. routed is stored, with the columns that it has, since
    all three read it: routing is worked out once."""
    routed = ranges.stored(routed, "routed")
    all_ = judged(routed, decisions, keys)
    held = all_.where("refusal is null")
    state = routed.join(held.select(*keys, "new_state", "reviewer"), keys, "left").withColumn("state", F.coalesce("new_state", "state")).drop("new_state")
    system = routed.select(*keys, "event_id", F.when(F.col("state") == "auto_approved", "auto_approve").otherwise("submit_for_review").alias("action"), F.lit("new").alias("previous_state"), F.col("state").alias("new_state"), F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("timestamp").alias("decided_at"))
    human = held.select(*keys, F.col("event_id").cast("string").alias("event_id"), "action", F.lit("pending_review").alias("previous_state"), "new_state", "reviewer", F.col("decided_at").cast("timestamp").alias("decided_at"))
    return state, system.unionByName(human), all_.where("refusal is not null").drop("new_state", "routed_state")


def current_review_state(routed: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state and reviewer of each row after all decisions that hold."""
    return apply_decisions(routed, decisions, keys)[0].select(*keys, "state", "reviewer")


def replay_decisions(routed: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh routing with stored human states put back: keys, state, reviewer, decided_at, reconstructed.
    stored: keys, review_state, reviewer, decided_at; a row each. States of the system are worked out afresh."""
    human = stored.where(F.col("review_state").isin([s for _, s in STATES]))
    out = routed.join(human, keys, "left")
    return out.select(*keys, F.coalesce("review_state", "state").alias("state"), "reviewer", "decided_at", F.col("review_state").isNotNull().alias("reconstructed"))


def restored_events(routed: DataFrame, stored: DataFrame, keys: list[str], audit: DataFrame | None = None) -> DataFrame:
    """Stored human states as events: who decided what and when, marked as put back.

    stored: keys, review_state, reviewer, decided_at. States of the system and rows that routing doesn't know give no event,
    nor does a decision of which audit holds an event of the same row, action and reviewer. Ids are equal on every run.
    """
    action = F.coalesce(*(F.when(F.col("review_state") == state, F.lit(a)) for a, state in STATES))
    human = stored.withColumn("action", action).where("action is not null").join(routed.select(*keys, F.col("state").alias("previous_state")), keys)
    if audit is not None:
        seen = audit.select(*keys, "action", F.coalesce("reviewer", F.lit("")).alias("_by")).distinct()
        human = human.withColumn("_by", F.coalesce("reviewer", F.lit(""))).join(seen, [*keys, "action", "_by"], "left_anti").drop("_by")
    comment = F.when(F.col("decided_at").isNull(), V.RESTORED_COMMENT.format(when=V.RESTORED_UNTIMED)).otherwise(V.RESTORED_COMMENT.format(when=V.RESTORED_TIMED))
    event = F.sha2(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), "action", F.coalesce("reviewer", F.lit("")), F.lit("restored")), 256)
    return human.select(*keys, event.alias("event_id"), "action", "previous_state", F.col("review_state").alias("new_state"), "reviewer", F.col("decided_at").cast("timestamp").alias("decided_at"), comment.alias("comment"))


def replay_events(routed: DataFrame, stored: DataFrame, keys: list[str], audit: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(state, audit) of a queue that is routed afresh and gets its stored decisions back as events.

    audit, if there is any: human events that are still known (keys, event_id, action, previous_state, new_state, reviewer,
    decided_at). One order holds for all events of a row: the system's, then people's by time, those without a time
    last, ties by id; the last one gives the row's state and reviewer. place counts a row's events from 1. What is used of
    routed is stored, so routing is worked out once.
    """
    routed = ranges.stored(routed.select(*keys, "event_id", "state"), "routed")
    action = F.when(F.col("state") == "auto_approved", "auto_approve").otherwise("submit_for_review")
    none = lambda kind: F.lit(None).cast(kind)
    system = routed.select(*keys, "event_id", action.alias("action"), F.lit("new").alias("previous_state"), F.col("state").alias("new_state"), none("string").alias("reviewer"), none("timestamp").alias("decided_at"), none("string").alias("comment"), F.lit(0).alias("_rank"))
    events = system.unionByName(restored_events(routed, stored, keys, audit).withColumn("_rank", F.lit(1)))
    if audit is not None:
        events = events.unionByName(audit.select(*keys, "event_id", "action", "previous_state", "new_state", "reviewer", "decided_at").withColumn("comment", none("string")).withColumn("_rank", F.lit(1)))
    order = F.struct("_rank", F.col("decided_at").isNull().alias("_late"), "decided_at", "event_id")
    # The state is a combine before the shuffle, not a window over a row's events.
    state = events.groupBy(*keys).agg(F.max_by(F.struct("new_state", "reviewer"), order).alias("x"), F.count("*").alias("n_events")).select(*keys, F.col("x.new_state").alias("state"), "x.reviewer", "n_events")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_rank", F.col("decided_at").isNull(), "decided_at", "event_id"))
    return state, events.withColumn("place", place).drop("_rank")


def review_summary(state: DataFrame, *by: str) -> DataFrame:
    names = ["pending_review", "auto_approved", "approved", "rejected", "corrected"]
    out = state.groupBy(*by).agg(F.count("*").alias("rows"), *(F.count_if(F.col("state") == s).alias(s) for s in names))
    return out.withColumn("approved_overall", F.col("approved") + F.col("auto_approved") + F.col("corrected"))


def overlay_review(df: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """df with fresh state and confidence where there are any."""
    fresh = state.select(*keys, F.col("state").alias("_state"), F.col("overall_confidence").alias("_confidence"))
    out = df.join(fresh, keys, "left")
    return out.withColumn("state", F.coalesce("_state", "state")).withColumn("overall_confidence", F.coalesce("_confidence", "overall_confidence")).drop("_state", "_confidence")


def queue_audit_count(audit: DataFrame, *by: str, actor: str = "all") -> DataFrame:
    return by_actor(audit, actor).groupBy(*by).agg(F.count("*").alias("events"))


def by_actor(audit: DataFrame, actor: str = "all") -> DataFrame:
    return audit if actor == "all" else audit.where(F.col("reviewer").isNotNull() if actor == "human" else F.col("reviewer").isNull())


def audit_page(audit: DataFrame, n: int = 50, actor: str = "all") -> DataFrame:
    """The newest events of an actor; the actor is told before the limit."""
    return by_actor(audit, actor).orderBy(F.desc_nulls_last("decided_at"), "event_id").limit(n)


def pending_queue(state: DataFrame, n: int = 50, order: str = "asc") -> DataFrame:
    """The first n pending rows by priority, ties by row number. Other rows are ranked last and left out after the limit: a
    filter before it would be pushed below the enrichment, which would then be worked out again for each use."""
    due = F.when(F.col("state") == "pending_review", F.col("priority"))
    first = due.asc_nulls_last() if order == "asc" else due.desc_nulls_last()
    return state.orderBy(F.col("state") != "pending_review", first, "row_number").limit(n).where(F.col("state") == "pending_review")


def bulk_approve(state: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """Decisions that approve the pending rows with confidence enough. Rows are told by a generator of the action, which
    isn't pushed below the enrichment as a filter would be."""
    due = (F.col("state") == "pending_review") & (F.col("overall_confidence") >= min_confidence)
    return state.select("*", F.explode(F.when(due, F.array(F.lit("approve")))).alias("action"))


def artifact_review(events: DataFrame) -> DataFrame:
    """Events that change an artifact's state: artifact_id, decided_at, event_id, previous_state, state. A first event
    comes from pending; an event with the same state as the one before changes nothing."""
    before = F.coalesce(F.lag("state").over(Window.partitionBy("artifact_id").orderBy("decided_at", "event_id")), F.lit("pending"))
    return events.withColumn("previous_state", before).where("previous_state <> state")


def repeat_intake(documents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """document_id, content_hash and what to do with a document that comes again."""
    known = artifacts.groupBy("content_hash").agg(F.max_by(F.struct("state", "n_facts"), F.struct("created_at", "state")).alias("a"))
    todo = F.when(F.col("a").isNull() | ((F.col("a.state") == "pending") & (F.col("a.n_facts") == 0)), "reprocess").otherwise("already_extracted")
    return documents.join(known, "content_hash", "left").select("document_id", "content_hash", todo.alias("decision"))
