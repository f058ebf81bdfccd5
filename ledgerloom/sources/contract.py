"""Declared source contracts: raw cells to canonical columns, keeping every issue of a row."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Canonical fields and the states of a raw cell.
TEXT = ("source_record_key", "instrument", "currency", "business_reference")
ENUM = ("side", "state", "operation")
NUMBER = ("quantity", "unit_price", "gross_amount")
FIELDS = (*TEXT, *ENUM, *NUMBER, "executed_at")
REQUIRED = ("source_record_key", "instrument", "side", "quantity", "unit_price", "gross_amount", "currency", "executed_at", "state", "operation")
#: What becomes of a local time that occurs twice.
FOLDS = ("REJECT", "EARLIER", "LATER")
_DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class Contract:
    """bindings: canonical field to column. constants: field to value. enums: field to {token: value}."""

    bindings: dict[str, str]
    constants: dict[str, str] = field(default_factory=dict)
    enums: dict[str, dict[str, str]] = field(default_factory=dict)
    null_tokens: tuple[str, ...] = ()
    time_format: str | None = None
    zone: str = "UTC"
    delta: bool = False
    fold: str = "REJECT"

    def __post_init__(self):
        if self.fold not in FOLDS:
            raise ValueError(f"a local time that occurs twice is handled as one of {', '.join(FOLDS)}")
        both = set(self.bindings) & set(self.constants)
        if both:
            raise ValueError(f"bound to a column and to a constant: {sorted(both)}")
        lacking = [f for f in REQUIRED if f not in self.bindings and f not in self.constants]
        if lacking:
            raise ValueError(f"not bound: {lacking}")


def to_json(contract: Contract) -> str:
    return json.dumps(asdict(contract), sort_keys=True, separators=(",", ":"))


def from_json(text: str) -> Contract:
    held = json.loads(text)
    return Contract(**held | {"null_tokens": tuple(held["null_tokens"])})


def ledger() -> Contract:
    columns = {"source_record_key": "trade_id", "business_reference": "trade_id", "executed_at": "traded_at", "instrument": "instrument", "side": "side", "quantity": "quantity", "unit_price": "price", "gross_amount": "gross_amount", "state": "state"}
    return Contract(columns, {"currency": "USD", "operation": "UPSERT"}, {"side": {"BUY": "BUY", "SELL": "SELL"}, "state": {"SETTLED": "SETTLED", "CANCELLED": "CANCELLED"}})


def counterparty() -> Contract:
    columns = {"source_record_key": "reference", "business_reference": "reference", "executed_at": "executed_at", "instrument": "symbol", "side": "direction", "quantity": "qty", "unit_price": "unit_price", "gross_amount": "total", "state": "status"}
    return Contract(columns, {"currency": "USD", "operation": "UPSERT"}, {"side": {"B": "BUY", "S": "SELL"}, "state": {"SETTLED": "SETTLED", "CANCELLED": "CANCELLED"}}, time_format="yyyy-MM-dd HH:mm:ss")


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _cells(raw: DataFrame, contract: Contract, fields: tuple[str, ...] = FIELDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, states (VALUE, MISSING, NULL, EMPTY) and texts (trimmed, null unless they are values): arrays over ``fields``.

    Cells are handled as one array, so the plan holds each rule once and not once for each field."""
    cells = []
    for name in fields:
        bound = contract.bindings.get(name)
        cells.append(F.lit(contract.constants[name]) if name in contract.constants else F.col(f"`{bound}`").cast("string") if bound in raw.columns else F.lit(None).cast("string"))
    held = raw.select(*keep, F.array(*cells).alias("cells")).select(*keep, "cells", F.transform("cells", _trimmed).alias("trims"))

    def state(cell: Column, trim: Column) -> Column:
        nulls = cell.isin(*contract.null_tokens) if contract.null_tokens else F.lit(False)
        return F.when(cell.isNull(), "MISSING").when(nulls, "NULL").when(trim == "", "EMPTY").otherwise("VALUE")

    held = held.select(*keep, "trims", F.zip_with("cells", "trims", state).alias("states"))
    return held.select(*keep, "states", F.zip_with("states", "trims", lambda s, t: F.when(s == "VALUE", t)).alias("texts"))


def _parsed(held: DataFrame, contract: Contract, keep: tuple[str, ...]) -> DataFrame:
    """Adds ``numbers`` (struct of value and code for each of ``NUMBER``), value_f of the other fields, state_f and text_f."""
    at = {f: i for i, f in enumerate(FIELDS)}
    plain = F.transform(F.array(*[F.col("texts")[at[f]] for f in NUMBER]), lambda t: F.regexp_replace(t, r"(?<=[0-9])_(?=[0-9])", ""))
    held = held.select("*", plain.alias("plain")).select("*", F.transform("plain", _number).alias("parts"))
    held = held.select(*keep, "states", "texts", F.transform("parts", lambda p: F.struct(p["value"].alias("value"), _number_code(p).alias("code"))).alias("numbers"))
    values = []
    for name in FIELDS:
        text = value = F.col("texts")[at[name]]
        if name in ENUM and name in contract.enums:
            value = F.try_element_at(F.create_map(*[F.lit(x) for k, v in contract.enums[name].items() for x in (k, v)]), text)
        elif name in NUMBER:
            value = F.col("numbers")[NUMBER.index(name)]["value"]
        elif name == "executed_at" and contract.time_format:
            value = F.try_to_timestamp(text, F.lit(contract.time_format))
        elif name == "executed_at":
            value = F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(text))
        state = F.lit("VALUE") if name in contract.constants else F.col("states")[at[name]]
        values += [value.alias(f"value_{name}"), text.alias(f"text_{name}"), state.alias(f"state_{name}")]
    return held.select(*keep, "numbers", *values)


def _instants(held: DataFrame, zone: str) -> DataFrame:
    """Adds earlier_ and later_: the first and last instant that has the local time value_executed_at in ``zone`` (null: none has).

    An instant is tried with the zone's offset a day before and a day after; it counts if it gives the local time back. So shifts of any size are seen."""
    local, near = F.col("value_executed_at"), F.unix_micros(F.to_utc_timestamp("value_executed_at", zone))
    tried = []
    for day in (-86_400_000_000, 86_400_000_000):
        at = F.timestamp_micros(near + day)
        tried.append(F.timestamp_micros(F.unix_micros(local) - F.unix_micros(F.from_utc_timestamp(at, zone)) + F.unix_micros(at)))
    held = held.select("*", *[x.alias(f"tried_{i}") for i, x in enumerate(tried)])
    fine = [F.when(F.from_utc_timestamp(f"tried_{i}", zone) == local, F.col(f"tried_{i}")) for i in (0, 1)]
    return held.select("*", F.least(*fine).alias("earlier_"), F.greatest(*fine).alias("later_"))


def _number(plain: Column) -> Column:
    fine = plain.rlike(_DECIMAL)
    power = F.regexp_extract(plain, r"[eE]([+-]?[0-9]+)$", 1)  # a failing cast costs an exception for each row, so no text is cast
    decimals = F.length(F.regexp_extract(plain, r"\.([0-9]*)", 1)) - F.coalesce(F.when(power != "", power).try_cast("int"), F.lit(0))
    odd = ~fine & F.lower(plain).rlike(r"^[+-]?(s?nan[0-9]*|inf|infinity)$")
    return F.struct(fine.alias("fine"), odd.alias("odd"), decimals.alias("decimals"), F.when(fine, plain).try_cast("decimal(28,12)").alias("value"))


def _number_code(part: Column) -> Column:
    return F.when(part["odd"], "NON_FINITE_DECIMAL").when(~part["fine"], "INVALID_DECIMAL").when(part["value"].isNull() | (part["decimals"] > 12), "UNSUPPORTED_PRECISION").when(part["value"] < 0, "NEGATIVE_VALUE")


def interpreted(raw: DataFrame, contract: Contract, keep: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """Canonical columns, ``issues`` (array of field:CODE, sorted) and ``eligible`` for each raw row (text columns).

    A missing column, a null token, an empty cell and a value are told apart. A row keeps all its issues. RETRACT
    rows need a key only; a CANCEL row's state must be CANCELLED. Every holder of a key that occurs twice is marked. Negative
    amounts are an issue of the row, and so are numbers of more than 12 decimals or of 17 or more digits before the point,
    beyond which scores would not be exact.

    ``keep``: columns of ``raw`` that are handed on, ahead of the others; none may have the name of a canonical column. ``within``: those of them (never null) in which a
    key may occur once, such as its file."""
    held = _parsed(_cells(raw, contract, keep=keep), contract, keep)
    if contract.time_format:
        held = _instants(held, contract.zone)
    columns, issues = [], []
    for name in FIELDS:
        state, text, value = (F.col(f"{x}_{name}") for x in ("state", "text", "value"))
        code = F.when(state != "VALUE", F.concat(state, F.lit("_VALUE"))) if name in REQUIRED else F.lit(None).cast("string")
        if name in ENUM and name in contract.enums:
            code = F.coalesce(code, F.when(text.isNotNull() & value.isNull(), F.lit("UNKNOWN_ENUM")))
        elif name in NUMBER:
            code = F.coalesce(code, F.when(state == "VALUE", F.col("numbers")[NUMBER.index(name)]["code"]))
        elif name == "executed_at":
            found = F.when(value.isNull(), F.lit("INVALID_DATETIME"))
            if contract.time_format:
                value = F.col("later_") if contract.fold == "LATER" else F.col("earlier_")
                found = found.when(value.isNull(), "NONEXISTENT_DATETIME")
                if contract.fold == "REJECT":
                    found = found.when(F.col("earlier_") != F.col("later_"), "AMBIGUOUS_DATETIME")
            code = F.coalesce(code, found)
        columns.append(value.alias(f"found_{name}"))
        issues.append(code.alias(f"code_{name}"))
    held = held.select(*keep, *columns, *issues)
    out = held.select(*keep, *[F.when(F.col(f"code_{f}").isNull(), F.col(f"found_{f}")).alias(f) for f in FIELDS], *[F.concat(F.lit(f"{f}:"), F.col(f"code_{f}")).alias(f"issue_{f}") for f in FIELDS])
    # holders of a key that occurs twice; rows without a key get one of their own, which spreads them and keeps filters above the parsing
    own = F.coalesce("source_record_key", F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string")))
    out = out.withColumn("own_", own)
    keys = _cells(raw, contract, ("source_record_key",), within).select(*[F.col(c).alias(f"in_{c}") for c in within], F.coalesce(F.col("texts")[0], F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))).alias("key_"))
    twice = keys.groupBy("key_", *[f"in_{c}" for c in within]).agg(F.count("*").alias("n_")).where("n_ > 1").drop("n_")
    out = out.join(twice, [F.col("own_") == F.col("key_"), *[F.col(c) == F.col(f"in_{c}") for c in within]], "left")
    retract = F.coalesce(F.col("operation") == "RETRACT", F.lit(False))
    all_ = F.array(*[F.col(f"issue_{f}") for f in FIELDS])
    cancel = F.when((F.col("operation") == "CANCEL") & (F.col("state") != "CANCELLED"), F.lit("state:CANCEL_REQUIRES_CANCELLED"))
    again = F.when(F.col("key_").isNotNull(), F.lit("source_record_key:DUPLICATE_SOURCE_KEY"))
    key_only = F.array("issue_source_record_key", "issue_operation")
    found = F.array_sort(F.array_compact(F.concat(F.when(retract, key_only).otherwise(F.array_append(all_, cancel)), F.array(again))))
    out = out.select(*keep, *FIELDS, found.alias("issues"))
    return out.withColumn("eligible", (F.size("issues") == 0) & ~F.coalesce(F.col("operation") == "RETRACT", F.lit(False)) & (F.coalesce("state", F.lit("")) != "CANCELLED"))
