"""Policies: what may be compared, how scores are built, when a match is accepted. Checked when built."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

#: Default weights in basis points, thresholds and limits.
WEIGHTS = {"quantity": 3500, "timestamp": 2500, "unit_price": 1500, "gross_amount": 2500}
FLOOR, THRESHOLD, GAP = 7000, 9000, 800
NODES, EDGES, RUN_EDGES, RECORD_EDGES = 100, 2500, 250_000, 200
#: References of both sides must agree, or references are local to a source and only aliases (column alias) are shared.
CONTRACTS = ("SHARED_MUST_AGREE", "SOURCE_LOCAL_OR_ALIAS")


@dataclass(frozen=True)
class Band:
    """A difference of max(absolute, relative * larger value) counts as the border."""

    absolute: str
    relative: str = "0"


@dataclass(frozen=True)
class Matching:
    """``run_edges`` and ``record_edges`` None: candidate generation is not capped."""

    weights: dict[str, int] = field(default_factory=lambda: dict(WEIGHTS))
    floor: int = FLOOR
    threshold: int = THRESHOLD
    gap: int = GAP
    window_seconds: int = 86_400
    block_on: tuple[str, ...] = ("instrument", "side", "currency")
    bands: dict[str, Band] = field(default_factory=lambda: {"quantity": Band("0", "0.01"), "unit_price": Band("0.01", "0.01"), "gross_amount": Band("0.01", "0.01")})
    time_band_seconds: int = 600
    nodes: int = NODES
    edges: int = EDGES
    run_edges: int | None = RUN_EDGES
    record_edges: int | None = RECORD_EDGES
    reference_contract: str = "SHARED_MUST_AGREE"

    def __post_init__(self):
        if self.reference_contract not in CONTRACTS:
            raise ValueError(f"the reference contract is one of {', '.join(CONTRACTS)}")
        if sum(self.weights.values()) != 10_000 or set(self.weights) != set(WEIGHTS):
            raise ValueError("weights of the four features must add up to 10000")
        if not self.floor < self.threshold or self.gap > self.threshold:
            raise ValueError("the floor must lie under the threshold, and the gap may not pass it")


@dataclass(frozen=True)
class Comparing:
    time_seconds: int = 60
    tolerances: dict[str, Band] = field(default_factory=lambda: {"quantity": Band("0.00000001"), "unit_price": Band("0.01"), "gross_amount": Band("0.05")})
    compatible_states: tuple[tuple[str, str], ...] = (("SETTLED", "SETTLED"),)


def to_json(policy: Matching | Comparing) -> str:
    return json.dumps(asdict(policy), sort_keys=True, separators=(",", ":"))


def matching_from_json(text: str) -> Matching:
    held = json.loads(text)
    held["bands"] = {k: Band(**v) for k, v in held["bands"].items()}
    return Matching(**held | {"block_on": tuple(held["block_on"])})


