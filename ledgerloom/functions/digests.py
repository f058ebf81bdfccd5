"""Digests of what a result stands for: SHA-256 of JSON with sorted keys and no spaces, so equal content has equal digests anywhere.

Control characters other than the usual escapes are written with capital hex digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Version of digests, and the tag of each field of an observation.
VERSION = "reconciliation-sha256-v1"
TAGS = {
    "business_reference": "TEXT", "currency": "TEXT", "executed_at_utc": "DATETIME", "gross_amount": "DECIMAL", "instrument": "TEXT",
    "quantity": "DECIMAL", "side": "ENUM", "source_record_key": "TEXT", "state": "ENUM", "unit_price": "DECIMAL",
}
_WHOLE = {"ignoreNullFields": "false"}


def digest(kind: str, payload: Column) -> Column:
    """Digest of a payload (a struct whose fields are in order of their names)."""
    held = F.struct(F.lit(kind).alias("kind"), payload.alias("payload"), F.lit(VERSION).alias("version"))
    return F.sha2(F.to_json(held, _WHOLE).cast("binary"), 256)


def fingerprint(contract_digest: Column, operation: Column, values: dict[str, Column], provenance: Column) -> Column:
    """Fingerprint of an observation. ``values``: canonical text of every field of ``TAGS``; ``provenance``: an array of
    structs (canonical_field, source_column, source_kind, transformation)."""
    if set(values) != set(TAGS):
        raise ValueError("a fingerprint takes every field of an observation")
    fields = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("tag"), F.coalesce(values[n], F.lit("")).alias("value")) for n, t in TAGS.items()])
    return digest("observation", F.struct(contract_digest.alias("contract_digest"), fields.alias("fields"), operation.alias("operation"), F.array_sort(provenance).alias("provenance")))


def components(scored: DataFrame, nodes: DataFrame, floor: int) -> DataFrame:
    """component, component_id, graph_digest of the components within the policy's limits (of nodes and edges, so a group is small)."""
    whole = nodes.where("limited is null")
    named = scored.where(F.col("score") > floor).join(whole.select(F.col("node").alias("left_id"), "component"), "left_id")
    edge = F.struct(F.lit(True).alias("complete"), "left_id", "right_id", F.col("score").alias("score_bp"))
    held = named.groupBy("component").agg(
        F.array_sort(F.collect_set("left_id")).alias("left"), F.array_sort(F.collect_set("right_id")).alias("right"), F.array_sort(F.collect_list(edge)).alias("edges")
    )
    short = F.substring(F.sha2(F.to_json(F.struct("left", "right")).cast("binary"), 256), 1, 16)
    held = held.withColumn("component_id", F.concat(F.lit("component-"), short))
    graph = F.to_json(F.struct(F.lit(floor).alias("assignment_floor_bp"), "component_id", "edges"))
    return held.select("component", "component_id", F.sha2(graph.cast("binary"), 256).alias("graph_digest"))
