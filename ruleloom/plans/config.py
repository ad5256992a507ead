"""Run parameters, as a dataclass and from ``k=v;k=v`` text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields


@dataclass
class Weights:
    supp: float = 1.0
    conf: float = 1.0
    rel_model: float = 0.5
    attribute_nonoverlap: float = 1.0
    predicate_nonoverlap: float = 1.0
    attribute_distance: float = 1.0
    tuple_coverage: float = 1.0


@dataclass
class Config:
    support: float = 1e-6  # share of all ordered pairs
    confidence: float = 0.75
    k: int = 10
    max_x: int = 5
    trade_off: float = 2.0  # weight of diversity against relevance
    low: float = 10.0  # frequent constants, percent of the rows
    high: float = 100.0
    small_domain: int = 10
    key_share: float = 0.8
    share: float = 0.3
    relevance: bool = True
    diversity: bool = True
    prune: bool = True
    constants: bool = True
    cross: bool = True
    weights: Weights = field(default_factory=Weights)

    @staticmethod
    def parse(text: str) -> Config:
        """``support=0.01;confidence=0.9;weights.conf=2``; unknown names are refused."""
        out = Config()
        for part in re.split(r"[;\n]+", text):
            if not part.strip():
                continue
            name, _, value = (x.strip() for x in part.partition("="))
            at = out.weights if name.startswith("weights.") else out
            name = name.removeprefix("weights.")
            known = {f.name for f in fields(at)}
            if name not in known or name == "weights":
                raise ValueError(f"unknown parameter {name!r}")
            old = getattr(at, name)
            setattr(at, name, value.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(value))
        return out
