"""Relevance, diversity, greedy choice, set scores and local search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.support import evaluate
from ..predicates import Predicate, Rule, closure
from ..schema import TableSet
from .config import Config
from .lattice import Found

Model = Callable[[Rule], float]


def jaccard_distance(a: set, b: set) -> float:
    return 1 - len(a & b) / len(a | b) if a | b else 0.0


def relevance(f: Found, c: Config, pairs: int, model: Model | None = None) -> float:
    if not c.relevance:
        return 0.0
    return c.weights.supp * f.support / max(1, pairs) + c.weights.conf * f.confidence + (c.weights.rel_model * model(f.rule) if model else 0.0)


def relevance_bound(support: int, c: Config, pairs: int, model_bound: float = 0.0) -> float:
    """No rule that extends one of this support is more relevant."""
    return c.weights.supp * support / max(1, pairs) + c.weights.conf + c.weights.rel_model * model_bound


@dataclass
class Chosen:
    """The rules chosen so far and what they cover."""

    rules: list[Found] = field(default_factory=list)
    attributes: set[str] = field(default_factory=set)
    predicates: set[str] = field(default_factory=set)
    distance: float | None = None

    def add(self, f: Found) -> None:
        self.distance = self.nearest(f.rule)
        self.rules.append(f)
        self.attributes |= f.rule.attributes()
        self.predicates |= f.rule.predicates()

    def nearest(self, rule: Rule) -> float | None:
        """The least attribute distance of the set with this rule in it."""
        own = [jaccard_distance(rule.attributes(), g.rule.attributes()) for g in self.rules]
        return min([*own, *([self.distance] if self.distance is not None else [])], default=None)


def pair_counts(tables: TableSet, sets: list[frozenset[Predicate]]) -> list[int]:
    """Ordered pairs with present values that satisfy all predicates of each set; contradictory sets have none."""
    out = [0] * len(sets)
    at = [i for i, s in enumerate(sets) if closure(s) is not None]
    # The pairs of a set are the left side's pairs of a rule; its consequence is of no matter.
    todo = [Rule.of(sets[i], min(sets[i], key=lambda p: (not p.is_constant, str(p)))) for i in at]
    for i, (x, _) in zip(at, evaluate(tables, todo, singles=True) if todo else [], strict=True):
        out[i] = x
    return out


def coverage(tables: TableSet, rule: Rule, chosen: list[Rule]) -> int:
    """Pairs that satisfy ``rule`` and no chosen rule: exact, for any number of chosen rules.

    A conjunction of rules is again a set of predicates, so inclusion and exclusion is a sum of counts.
    It is built up rule by rule with equal sets merged, so sets that cancel (a chosen rule that the set
    already satisfies) or that contradict themselves are gone before anything is counted.
    """
    own = frozenset((*rule.lhs, rule.rhs))
    terms: dict[frozenset[Predicate], int] = {own: 1} if closure(own) is not None else {}
    for other in sorted({frozenset((*r.lhs, r.rhs)) for r in chosen if r.tables() == rule.tables()}, key=lambda s: (len(s), sorted(map(str, s)))):
        for held, sign in list(terms.items()):
            both = held | other
            if both == held or closure(both) is not None:
                terms[both] = terms.get(both, 0) - sign
        terms = {held: sign for held, sign in terms.items() if sign}
    counts = pair_counts(tables, list(terms))
    return sum(sign * n for sign, n in zip(terms.values(), counts, strict=True))


def sampled_coverage(tables: TableSet, f: Found, chosen: list[Rule], ids: tuple[str, str], *, rows: int = 200, seed: int = 0) -> float:
    """An estimate of ``coverage`` from the pairs of ``rows`` left tuples, by hash."""
    from ..operators.support import pairs as joined

    names = f.rule.tables()
    part = TableSet(dict(tables.tables), tables.skip)
    few = tables.table(names[0]).orderBy(F.xxhash64(F.lit(seed), ids[0]), ids[0]).limit(rows)
    both = {c for r in (f.rule, *chosen) for p in (*r.lhs, r.rhs) for o in (p.left, p.right) if o for c in [o.column]}
    keep0 = sorted({ids[0], *(c for c in both if c in tables.columns(names[0]))})
    keep1 = sorted({ids[1], *(c for c in both if c in tables.columns(names[1]))})
    part.tables = {**tables.tables, names[0]: few} if names[0] != names[1] else tables.tables
    got = joined(part, (*f.rule.lhs, f.rule.rhs), keep0, keep1)
    if names[0] == names[1]:
        got = got.join(few.select(F.col(ids[0]).alias(f"t0_{ids[0]}")), f"t0_{ids[0]}", "left_semi")

    def holds(p: Predicate):
        a = F.col(f"t{p.left.variable}_{p.left.column}")
        b = F.col(f"t{p.right.variable}_{p.right.column}") if p.right else F.lit(p.constant)
        return F.coalesce(a.cast("string") == b.cast("string"), F.lit(False))

    covered = F.lit(False)
    for r in chosen:
        if r.tables() == names:
            every = F.lit(True)
            for p in (*r.lhs, r.rhs):
                every = every & holds(p)
            covered = covered | every
    n, free = got.agg(F.count("*"), F.count_if(~covered)).first()
    return f.support * (free / n) if n else 0.0


def diversity(f: Found, chosen: Chosen, c: Config, pairs: int, cover: float | None = None) -> float:
    """Marginal diversity of a rule; the set measures are 0 while nothing is chosen."""
    if not c.diversity:
        return 0.0
    w, out = c.weights, 0.0
    if chosen.rules:
        out -= w.attribute_nonoverlap * len(f.rule.attributes() & chosen.attributes) / c.max_x
        out -= w.predicate_nonoverlap * len(f.rule.predicates() & chosen.predicates) / c.max_x
        new = chosen.nearest(f.rule)
        out += w.attribute_distance * (new if len(chosen.rules) == 1 else new - chosen.distance)
    return out + w.tuple_coverage * (f.support if cover is None else cover) / max(1, pairs)


def diversity_bound(rule: Rule, support: int, chosen: Chosen, c: Config, pairs: int) -> float:
    """No rule that extends this one, whose support is ``support``, adds more diversity (weights of 0 or more).

    What an extension shares with the chosen rules only grows, and it covers no more than this one's support.
    """
    if not c.diversity:
        return 0.0
    w, out = c.weights, c.weights.tuple_coverage * support / max(1, pairs)
    if chosen.rules:
        out -= w.attribute_nonoverlap * len(rule.attributes() & chosen.attributes) / c.max_x
        out -= w.predicate_nonoverlap * len(rule.predicates() & chosen.predicates) / c.max_x
        out += w.attribute_distance if len(chosen.rules) == 1 else 0.0
    return out


def next_best(tables: TableSet, left: list[Found], chosen: Chosen, c: Config, pairs: int, model: Model | None = None) -> tuple[float, float, float, Found]:
    """Score, relevance, diversity and the rule that is best beside the chosen ones; ties by text."""
    counted = c.diversity and chosen.rules and c.weights.tuple_coverage
    scored = []
    for f in left:
        # Coverage lies between 0 and the support: it is counted only for rules that could still win.
        rel = relevance(f, c, pairs, model)
        scored.append((rel + c.trade_off * diversity(f, chosen, c, pairs, float(f.support) if counted else None), rel, f))
    scored.sort(key=lambda x: (-x[0], str(x[2].rule)))
    best = None
    for bound, rel, f in scored:
        if best and bound < best[0]:
            break
        div = diversity(f, chosen, c, pairs, coverage(tables, f.rule, [g.rule for g in chosen.rules]) if counted else None)
        score = rel + c.trade_off * div
        if best is None or (score, [-ord(x) for x in str(f.rule)]) > (best[0], [-ord(x) for x in str(best[3].rule)]):
            best = (score, rel, div, f)
    return best


def line(score: float, rel: float, div: float, f: Found) -> dict:
    return {"rule": str(f.rule), "lhs_support": f.lhs_support, "supp": f.support, "conf": f.confidence, "rel": rel, "div": div, "score": score}


def greedy(tables: TableSet, found: list[Found], c: Config, pairs: int, model: Model | None = None) -> list[dict]:
    """K rounds, each the rule with the best relevance plus trade-off times marginal diversity."""
    left, chosen, out = list(found), Chosen(), []
    while left and len(out) < c.k:
        best = next_best(tables, left, chosen, c, pairs, model)
        chosen.add(best[3])
        left.remove(best[3])
        out.append(line(*best))
    return out


def top_k(found: list[Found], c: Config, pairs: int, model: Model | None = None) -> list[tuple[float, Found]]:
    """Plain top-k by relevance."""
    return sorted(((relevance(f, c, pairs, model), f) for f in found), key=lambda x: (-x[0], str(x[1].rule)))[: c.k]


def set_scores(rules: list[Found], c: Config, pairs: int, model: Model | None = None, average: bool = True) -> dict[str, float]:
    """Relevance of a set (average or sum), its diversity measures and the statistics of an evaluation."""
    rel = [relevance(f, c, pairs, model) for f in rules]
    dist = [jaccard_distance(a.rule.attributes(), b.rule.attributes()) for a, b in combinations(rules, 2)]
    shared = lambda get: -sum(len(get(f) & set().union(*(get(g) for g in rules[:i]))) for i, f in enumerate(rules) if i) / c.max_x
    attr, pred, near = shared(lambda f: f.rule.attributes()), shared(lambda f: f.rule.predicates()), min(dist, default=0.0)
    stat = lambda name, x: {f"avg_{name}": float(np.mean(x)) if x else 0.0, f"max_{name}": float(max(x, default=0)), f"min_{name}": float(min(x, default=0))}
    return {"relevance": (float(np.mean(rel)) if average else float(sum(rel))) if rel else 0.0, "attribute_nonoverlap": attr, "predicate_nonoverlap": pred, "attribute_distance": near, "diversity": c.weights.attribute_nonoverlap * attr + c.weights.predicate_nonoverlap * pred + c.weights.attribute_distance * near, **stat("supp", [f.support for f in rules]), **stat("conf", [f.confidence for f in rules]), **stat("length", [len(f.rule.lhs) for f in rules])}


def swap(found: list[Found], c: Config, pairs: int, model: Model | None = None, seed: int = 0) -> list[Found]:
    """Local search: a random set, then the first exchange that improves it, until none does."""
    order = sorted(found, key=lambda f: str(f.rule))
    if len(order) <= c.k:
        return order
    pick = sorted(np.random.default_rng(seed).choice(len(order), c.k, replace=False).tolist())
    value = lambda s: (v := set_scores([order[i] for i in s], c, pairs, model, average=False))["relevance"] + c.trade_off * v["diversity"]
    now, improved = value(pick), True
    while improved:
        improved = False
        for i in range(len(pick)):
            for j in range(len(order)):
                if j not in pick and (v := value(new := sorted([*pick[:i], *pick[i + 1 :], j]))) > now + 1e-12:
                    pick, now, improved = new, v, True
                    break
            if improved:
                break
    return [order[i] for i in pick]


def evaluate_rules(tables: TableSet, rules: list[Rule], pairs: int) -> list[dict]:
    """Given rules in order: counts, confidence and the pairs that no earlier rule covers."""
    out = []
    for i, (r, (x, s)) in enumerate(zip(rules, evaluate(tables, rules), strict=True)):
        out.append({"rule": str(r), "lhs_support": x, "supp": s, "conf": s / x if x else 0.0, "new_pairs": coverage(tables, r, rules[:i])})
    return out


def frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in rows], "rule string, lhs_support long, supp long, conf double, rel double, div double, score double")
