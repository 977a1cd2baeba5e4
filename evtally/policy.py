"""The ledger's policy: a frozen value that plans close over."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

SECOND = 1_000_000_000


@dataclass(frozen=True)
class Policy:
    fresh_ttl: int = 24 * 3600 * SECOND
    stale_ttl: int = 48 * 3600 * SECOND
    skew: int = 30 * SECOND
    reject_future: bool = True
    require_incarnation_coverage: bool = True
    require_generation_binding: bool = True
    require_total_observations: bool = False
    stale: str = "exclude"  # or include-marked
    conflict: str = "record-and-unknown"  # or prefer-higher-authority, strict-fail
    tie_break: str = "reject"  # or lowest-source-id-wins, highest-source-id-wins
    residual: str = "record"  # or strict-reject
    excess: str = "record"  # or strict-reject
    late: str = "requires-correction"  # or reject
    batch_dedup: bool = False
    max_corrections: int = 256
    max_result_rows: int = 100_000
    max_explanation_entries: int = 20_000
    max_period: int = 366 * 86400 * SECOND

    def __post_init__(self) -> None:
        allowed = {"stale": ("exclude", "include-marked"), "conflict": ("record-and-unknown", "prefer-higher-authority", "strict-fail"), "tie_break": ("reject", "lowest-source-id-wins", "highest-source-id-wins"), "residual": ("record", "strict-reject"), "excess": ("record", "strict-reject"), "late": ("requires-correction", "reject")}
        for k, v in allowed.items():
            if getattr(self, k) not in v:
                raise ValueError(f"InvalidPolicy: {k}")
        if not 0 < self.fresh_ttl <= self.stale_ttl or self.skew < 0 or self.max_result_rows < 1:
            raise ValueError("InvalidPolicy: a budget is out of range")


def parse_policy(text: str) -> Policy:
    """From JSON; unknown keys are refused, and a number 0 keeps the default."""
    j = json.loads(text)
    known = {f.name for f in fields(Policy)}
    if extra := set(j) - known:
        raise ValueError(f"UnknownField: {sorted(extra)}")
    return Policy(**{k: v for k, v in j.items() if isinstance(v, bool | str) or v != 0})
