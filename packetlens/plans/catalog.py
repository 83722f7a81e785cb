"""Name to (DataFrame builder, oracle SQL) for every query of the core."""

from __future__ import annotations

from packetlens.plans import audit, captures, packets, problems, shifts, verification

_PARTS = (problems, shifts, audit, packets, captures, verification)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in getattr(part, "ORACLE", {}).items()}
