"""Reviewers' commands over decisions: a batch is judged against the active decisions, then becomes revisions.

Commands of one batch saw the same state, so of those that touch one thing (a record they reserve, a decision they change or
supersede) only the first by name can take effect. The others are told so and may be sent again, also where that first one loses elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import health
from .cases import claim_conflicts
from .review import active

#: Actions that begin a decision (and the authority they give), actions on one, and codes in order of precedence.
INITIAL = ("LINK", "ACCEPT_UNMATCHED", "REJECT_CANDIDATE")
LATER = ("REAFFIRM", "REVOKE", "REPLACE")
CODES = ("INVALID_COMMAND", "STALE_GENERATION", "STALE_REVISION", "UNKNOWN_RECORD", "STALE_EVIDENCE", "ENDPOINT_CLAIMED", "CONFLICT_SET_CHANGED", "CONTENDED")


def _reserving(authority: Column) -> Column:
    return authority.isin("LINK", "ACCEPT_UNMATCHED")


def _ends(rows: DataFrame, *names: str) -> DataFrame:
    """``names`` and id for both ends of each row, where they are not null."""
    return rows.select(*names, F.explode(F.array("left_id", "right_id")).alias("id")).where("id is not null")


def claims(history: DataFrame, superseded: DataFrame) -> DataFrame:
    """decision_id, revision, id: the records that active decisions reserve."""
    return _ends(active(history, superseded).where(_reserving(F.col("authority"))), "decision_id", "revision")


def _valid() -> Column:
    """Whether a command says all that its action needs, and no more."""
    left, right, target = (F.col(c).isNotNull() for c in ("left_id", "right_id", "target_id"))
    pair, one, none = left & right, left != right, ~left & ~right
    shape = F.when(F.col("authority") == "ACCEPT_UNMATCHED", one).when(F.col("authority").isin("LINK", "REJECT_CANDIDATE"), pair).otherwise(F.lit(False))
    started = F.col("action").isin(*INITIAL) & ~target & (F.col("authority") == F.col("action")) & shape
    replaced = (F.col("action") == "REPLACE") & target & shape
    return F.coalesce(F.when(F.col("action").isin("REAFFIRM", "REVOKE"), target & none & F.col("authority").isNull()).otherwise(started | replaced), F.lit(False))


def judged(commands: DataFrame, records: DataFrame, history: DataFrame, superseded: DataFrame, generation: int, observed: DataFrame | None = None) -> DataFrame:
    """``commands`` (as they take effect) with ``conflicts`` (decision@revision, sorted) and ``code``, null for those that take effect.

    ``commands``: command (unique), generation, action, authority, left_id, right_id, target_id, target_revision, approved (array of
    decision@revision). REAFFIRM and REVOKE get authority and ends of their decision. ``records``: id of all that may be reviewed.
    ``history``: decision_id, revision, action, authority, left_id, right_id.

    With ``observed`` (the records as ``health.gathered`` takes them) commands also have ``seen``, the digest of what their reviewer saw (null: not
    told, so not checked). Where the records are others by now, the command is refused; ``reviewed`` is the digest as it is, for the history."""
    now = active(history, superseded).select(F.col("decision_id").alias("of_"), F.col("revision").alias("now_"), *[F.col(c).alias(f"{c}_") for c in ("authority", "left_id", "right_id")])
    names = ["command", "generation", "action", "authority", "left_id", "right_id", "target_id", "target_revision", "approved"] + (["seen"] if observed is not None else [])
    asked = commands.select(*names).withColumn("valid", _valid())
    # commands without a decision are kept from the join: they would all have its null key
    later = asked.where("target_id is not null").join(now, F.col("target_id") == F.col("of_"), "left").withColumn("current", F.coalesce(F.col("now_") == F.col("target_revision"), F.lit(False)))
    kept = F.col("action").isin("REAFFIRM", "REVOKE")
    for c in ("authority", "left_id", "right_id"):
        later = later.withColumn(c, F.when(kept, F.col(f"{c}_")).otherwise(F.col(c)))
    asked = later.select(*names, "valid", "current").unionByName(asked.where("target_id is null").withColumn("current", F.lit(True)))

    looked_at = _ends(asked.where("action <> 'REVOKE'"), "command")
    unknown = looked_at.join(records.select("id"), "id", "left_anti").select("command").distinct().withColumn("unknown", F.lit(True))
    claiming = asked.where(_reserving(F.col("authority")) & ~kept)
    met = claim_conflicts(_ends(claiming, F.col("command").alias("request"), F.col("target_id").alias("replaces")), claims(history, superseded))
    met = met.groupBy(F.col("request").alias("command")).agg(F.array_sort(F.collect_set(F.concat_ws("@", "decision_id", F.col("revision").cast("string")))).alias("conflicts"))
    held = asked.join(unknown, "command", "left").join(met, "command", "left")
    changed_since = F.lit(False)
    if observed is not None:
        evidence = health.gathered(asked.where("action <> 'REVOKE'").select(F.col("command").alias("decision_id"), "authority", "left_id", "right_id"), observed)
        held = held.join(evidence.select(F.col("decision_id").alias("command"), F.col("digest").alias("reviewed")), "command", "left")
        names, changed_since = [*names, "reviewed"], F.col("seen").isNotNull() & (F.col("action") != "REVOKE") & ~F.col("seen").eqNullSafe(F.col("reviewed"))
    none = F.array().cast("array<string>")
    held = held.withColumns({"conflicts": F.coalesce("conflicts", none), "approved": F.array_sort(F.coalesce("approved", none))})
    code = (
        F.when(~F.col("valid"), "INVALID_COMMAND").when(~F.col("generation").eqNullSafe(F.lit(generation)), "STALE_GENERATION").when(~F.col("current"), "STALE_REVISION").when(F.col("unknown"), "UNKNOWN_RECORD").when(changed_since, "STALE_EVIDENCE")
        .when(F.col("action").isin(*INITIAL) & (F.size("conflicts") > 0), "ENDPOINT_CLAIMED").when((F.col("action") == "REPLACE") & (F.col("conflicts") != F.col("approved")), "CONFLICT_SET_CHANGED")
    )
    held = held.withColumn("code", code).select(*names, "conflicts", "code")
    fine = held.where("code is null")
    ends = F.when(_reserving(F.col("authority")) & ~kept, F.array(*[F.concat(F.lit("record:"), c) for c in ("left_id", "right_id")])).otherwise(none)
    changed = F.concat(F.transform("conflicts", lambda x: F.regexp_replace(x, "@[0-9]+$", "")), F.array("target_id"))
    things = fine.select("command", F.explode(F.array_compact(F.concat(ends, F.transform(changed, lambda x: F.concat(F.lit("decision:"), x))))).alias("thing")).distinct()
    first = things.groupBy("thing").agg(F.min("command").alias("first_"))
    lost = things.join(first, "thing").where("command <> first_").select("command").distinct().withColumn("lost", F.lit(True))
    return held.join(lost, "command", "left").withColumn("code", F.coalesce("code", F.when(F.col("lost"), "CONTENDED"))).drop("lost")


def applied(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to append to the history (with ``reviewed`` where evidence was judged), and to the superseded decisions (decision_id, by). A decision begun here is named after its command."""
    fine = verdicts.where("code is null")
    revision = F.coalesce(F.col("target_revision") + 1, F.lit(1)).cast("int")
    new = fine.select(F.coalesce("target_id", "command").alias("decision_id"), revision.alias("revision"), "action", "authority", "left_id", "right_id", *(["reviewed"] if "reviewed" in verdicts.columns else []))
    gone = fine.where("action = 'REPLACE'").select(F.explode("conflicts").alias("conflict"), F.col("target_id").alias("by"))
    return new, gone.select(F.regexp_replace("conflict", "@[0-9]+$", "").alias("decision_id"), "by")
