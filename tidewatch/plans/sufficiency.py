"""What the data at hand can support: a decision table over a few counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUPPORTED, DEGRADED, BLOCKED = "SUPPORTED", "DEGRADED", "BLOCKED"
SCORED = ["time_correlation", "network", "statml", "benford", "structuring", "behavioral", "chain"]


@dataclass(frozen=True)
class Holdings:
    """Counts that decide: rows, entities, sources, and which slots are filled."""

    rows: int
    entities: int
    sources: frozenset[str]
    timestamp: bool
    counterparty: bool
    amount: bool


def holdings(events: DataFrame) -> Holdings:
    """One aggregate over the events."""
    r = events.agg(
        F.count("*"), F.count_distinct("entity_id"), F.collect_set("source"), F.count("timestamp"), F.count("counterparty_id"), F.count("amount")
    ).first()
    return Holdings(r[0], r[1], frozenset(r[2]), r[3] > 0, r[4] > 0, r[5] > 0)


def verdicts(h: Holdings, min_events: int = 30) -> dict[str, str]:
    """Stage -> SUPPORTED, DEGRADED or BLOCKED."""
    if not h.sources:
        return dict.fromkeys(["schema_detection", "entity_resolution", *SCORED], BLOCKED)
    single = len(h.sources) == 1
    sided = DEGRADED if single else SUPPORTED
    out = {
        "schema_detection": SUPPORTED,
        "entity_resolution": SUPPORTED if h.counterparty else DEGRADED,
        "time_correlation": sided if h.timestamp else BLOCKED,
        "network": BLOCKED if not h.counterparty or h.sources == {"social"} else sided,
        "statml": BLOCKED if not h.timestamp else SUPPORTED if h.amount else DEGRADED,
        **dict.fromkeys(["benford", "structuring", "behavioral"], SUPPORTED if h.amount else BLOCKED),
        "chain": SUPPORTED if h.timestamp and h.counterparty and h.amount else BLOCKED,
    }
    if not h.entities or h.rows / h.entities < min_events:
        out |= dict.fromkeys(SCORED, BLOCKED)
    return out
