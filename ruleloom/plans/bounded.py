"""Greedy choice from a search that goes no further than its bounds ask.

A full search finds every minimal valid rule before the first is chosen.  Here each round first asks what the best
rule at hand scores at least, and then evaluates only those waiting rules of which some extension could score as much;
the others wait for later rounds.  The rules chosen are the same.  The driver holds predicates and counts, never rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..operators.support import classify, evaluate
from ..predicates import Predicate, Rule
from ..schema import TableSet
from .config import Config
from .lattice import Found, sensible, ties
from .scoring import Chosen, Model, diversity, diversity_bound, line, next_best, relevance, relevance_bound

Key = tuple[frozenset, Predicate]


@dataclass
class Frontier:
    """A levelwise search that stops and goes on.

    ``waiting`` holds rules whose every smaller rule is intermediate, with the least support of those.  A rule is never
    counted if its left side is known to hold for too few pairs: ``X -> p`` has already told how many satisfy X and p.
    """

    tables: TableSet
    space: list[Predicate]
    consequences: list[Predicate]
    sigma: int
    delta: float
    max_x: int
    valid: list[Found] = field(default_factory=list)
    waiting: dict[Key, int] = field(default_factory=dict)
    status: dict[Key, str] = field(default_factory=dict)
    supports: dict[Key, int] = field(default_factory=dict)
    at_most: dict[frozenset, int] = field(default_factory=dict)
    evaluated: int = 0

    def __post_init__(self) -> None:
        self.order = sorted(set(self.space), key=str)
        first = [(frozenset([p]), q) for p in self.order if ties([p]) for q in self.consequences if p != q and sensible([p], q)]
        self._evaluate(first if self.max_x > 0 else [])

    def _evaluate(self, batch: list[Key]) -> None:
        """One job for the batch; afterwards the rules that it leads to wait."""
        alive = []
        counts = evaluate(self.tables, [Rule.of(x, q) for x, q in batch])
        self.evaluated += len(batch)
        for (x, q), (n, s) in zip(batch, counts, strict=True):
            kind = self.status[x, q] = classify(n, s, self.sigma, self.delta)
            self.supports[x, q] = s
            self.at_most[x | {q}] = min(s, self.at_most.get(x | {q}, s))
            if kind == "valid":
                self.valid.append(Found(Rule.of(x, q), n, s))
            elif kind == "intermediate" and len(x) < self.max_x:
                alive.append((x, q))
        for x, q in alive:
            for p in self.order:
                key = (x | {p}, q)
                if p in x or p == q or key in self.status or key in self.waiting or not sensible(*key):
                    continue
                smaller = [(key[0] - {r}, q) for r in key[0] if ties(key[0] - {r})]
                if any(self.status.get(k) != "intermediate" for k in smaller):
                    continue
                if self.at_most.get(key[0], self.sigma) < self.sigma:
                    self.status[key] = "invalid"
                else:
                    self.waiting[key] = min(self.supports[k] for k in smaller)

    def expand(self, reach: Callable[[Rule, int], float], least: float) -> bool:
        """Evaluates the smallest waiting rules whose reach is ``least`` or more; False if there are none."""
        ready = [k for k, s in self.waiting.items() if reach(Rule.of(*k), s) >= least - 1e-12]
        if not ready:
            return False
        size = min(len(x) for x, _ in ready)
        batch = sorted((k for k in ready if len(k[0]) == size), key=lambda k: str(Rule.of(*k)))
        for k in batch:
            del self.waiting[k]
        self._evaluate(batch)
        return True


def choose(frontier: Frontier, c: Config, pairs: int, model: Model | None = None, model_bound: float = 1.0) -> list[dict]:
    """``scoring.greedy`` over all minimal valid rules, for weights of 0 or more.

    No rule's model score may be over ``model_bound``.  With ``c.prune`` off, or a weight below 0, the search is
    finished before the first choice.
    """
    bounds = c.prune and c.trade_off >= 0 and all(w >= 0 for w in vars(c.weights).values())
    chosen, out = Chosen(), []

    def reach(rule: Rule, support: int) -> float:
        if not bounds:
            return float("inf")
        rel = relevance_bound(support, c, pairs, model_bound if model else 0.0) if c.relevance else 0.0
        return rel + c.trade_off * diversity_bound(rule, support, chosen, c, pairs)

    while len(out) < c.k:
        left = [f for f in frontier.valid if f not in chosen.rules]
        # Without its coverage counted, a rule scores no less than with none.
        none = 0.0 if chosen.rules else None
        least = max((relevance(f, c, pairs, model) + c.trade_off * diversity(f, chosen, c, pairs, none) for f in left), default=float("-inf"))
        if frontier.expand(reach, least):
            continue
        if not left:
            break
        best = next_best(frontier.tables, left, chosen, c, pairs, model)
        chosen.add(best[3])
        out.append(line(*best))
    return out
