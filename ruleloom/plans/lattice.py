"""Levelwise search for minimal rules.

The driver holds predicates, candidate sets and two counts a candidate; each level is
one batch of aggregations.  A candidate ``X -> p`` is made only if each smaller
``X' -> p`` that can be evaluated was intermediate: a valid one is minimal already, an
invalid one can't gain support.  With ``prune=False`` only contradictions and
minimality cut the search; the rules found are the same.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

from ..operators.support import classify, evaluate
from ..predicates import Predicate, Rule
from ..schema import TableSet


@dataclass(frozen=True)
class Found:
    rule: Rule
    lhs_support: int
    support: int

    @property
    def confidence(self) -> float:
        return self.support / self.lhs_support if self.lhs_support else 0.0

    @property
    def violations(self) -> int:
        return self.lhs_support - self.support


def ties(lhs: Iterable[Predicate]) -> bool:
    """Whether some predicate speaks of both tuple variables."""
    return any(not p.is_constant for p in lhs)


def sensible(lhs: Iterable[Predicate], rhs: Predicate) -> bool:
    """No contradiction, nothing that follows trivially, one table a variable."""
    every = [*lhs, rhs]
    tables: dict[int, str] = {}
    constants: dict[tuple[int, str], str] = {}
    for p in every:
        for o in (p.left, p.right):
            if o and tables.setdefault(o.variable, o.table) != o.table:
                return False
        if p.is_constant:
            key = (p.left.variable, p.left.column)
            if key in constants:
                return False
            constants[key] = p.constant
    for p in every:
        if not p.is_constant:
            a, b = (p.left, p.right) if p.left.variable == 0 else (p.right, p.left)
            if (0, a.column) in constants and (1, b.column) in constants:
                return False
    # Two different constants of one attribute on both sides speak of unrelated tuples.
    return not any((1, c) in constants and constants[1, c] != v for (side, c), v in constants.items() if side == 0)


def search(tables: TableSet, space: list[Predicate], consequences: list[Predicate], *, sigma: int, delta: float, max_x: int, prune: bool = True) -> list[Found]:
    """Every minimal valid rule with up to ``max_x`` predicates on its left."""
    order = sorted(set(space), key=str)
    out: list[Found] = []
    status: dict[tuple[frozenset, Predicate], str] = {}
    for size in range(1, max_x + 1):
        todo: list[Rule] = []
        for lhs in combinations(order, size) if size <= 1 else _grown(order, status, size):
            if not ties(lhs):
                continue
            for rhs in consequences:
                if rhs in lhs or not sensible(lhs, rhs):
                    continue
                smaller = [frozenset(lhs) - {p} for p in lhs] if size > 1 else []
                states = [status.get((s, rhs)) for s in smaller if ties(s)]
                if "valid" in states or "implied" in states:
                    status[frozenset(lhs), rhs] = "implied"
                    continue
                if prune and any(s != "intermediate" for s in states):
                    continue
                todo.append(Rule.of(lhs, rhs))
        if not todo:
            break
        for rule, (x, s) in zip(todo, evaluate(tables, todo), strict=True):
            kind = classify(x, s, sigma, delta)
            if kind == "invalid" and not prune:
                kind = "intermediate"  # its extensions are evaluated, and fail by themselves
            status[frozenset(rule.lhs), rule.rhs] = kind
            if kind == "valid":
                out.append(Found(rule, x, s))
    return sorted(out, key=lambda f: str(f.rule))


def _grown(order: list[Predicate], status: dict, size: int):
    """Sets one larger than those that are still alive, or made of constants only, each once."""
    alive = {s for (s, _), kind in status.items() if kind == "intermediate" and len(s) == size - 1}
    constants = [p for p in order if p.is_constant]
    seen = set()
    for s in sorted(alive, key=lambda s: sorted(map(str, s))):
        for p in order:
            if p not in s and (new := s | {p}) not in seen:
                seen.add(new)
                yield tuple(sorted(new, key=str))
    if size == 2:
        return
    # A set whose only tie is new may extend constants alone; its tied part was alive one level below.
    for s in combinations(constants, size - 1):
        for p in order:
            if not p.is_constant and (new := frozenset(s) | {p}) not in seen and all(frozenset(new) - {c} in alive for c in s):
                seen.add(new)
                yield tuple(sorted(new, key=str))
