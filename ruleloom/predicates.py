"""Predicates over two tuple variables, rules, their text forms and their algebra."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Facts about comparison operators: the converse, the negation, what each implies, and what follows in chains.
OPERATORS = ("==", "<>", "<", "<=", ">", ">=")
INVERSE = {"==": "<>", "<>": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
SYMMETRIC = {"==": "==", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
IMPLIES = {"==": {"==", "<=", ">="}, "<>": {"<>"}, "<": {"<", "<=", "<>"}, "<=": {"<="}, ">": {">", ">=", "<>"}, ">=": {">="}}


def chain(a: str, b: str) -> str | None:
    """What ``x a y`` and ``y b z`` say about x and z."""
    if a == "==":
        return b
    if b == "==":
        return a
    if a in ("<", "<=") and b in ("<", "<="):
        return "<" if "<" in (a, b) else "<="
    if a in (">", ">=") and b in (">", ">="):
        return ">" if ">" in (a, b) else ">="
    return None


@dataclass(frozen=True, order=True)
class Operand:
    table: str
    variable: int
    column: str

    def __str__(self) -> str:
        return f"{self.table}.t{self.variable}.{self.column}"


@dataclass(frozen=True, order=True)
class Predicate:
    """``left op right``, ``left op constant`` or a named similarity ``ML(left, right)``."""

    left: Operand
    op: str
    right: Operand | None = None
    constant: str | None = None
    model: str | None = None

    @property
    def is_constant(self) -> bool:
        return self.right is None

    @property
    def is_ml(self) -> bool:
        return self.model is not None

    def __str__(self) -> str:
        if self.model:
            return f"ML_{self.model}({self.left},{self.right})"
        return f"{self.left} {self.op} {self.right if self.right else self.constant}"

    def swapped(self) -> Predicate:
        """With t0 and t1 exchanged."""
        flip = lambda o: replace(o, variable=1 - o.variable)
        if self.right is None:
            return replace(self, left=flip(self.left))
        return replace(self, left=flip(self.right), right=flip(self.left), op=SYMMETRIC.get(self.op, self.op))

    def inverse(self) -> Predicate:
        return replace(self, op=INVERSE[self.op])

    def implied(self) -> set[Predicate]:
        return {replace(self, op=o) for o in IMPLIES[self.op]}

    def attributes(self) -> set[str]:
        return {self.left.column} | ({self.right.column} if self.right else set())

    def column(self, sides: dict[int, DataFrame]) -> Column:
        """As a null-safe boolean over joined sides (empty strings are null)."""

        def value(o: Operand) -> Column:
            return sides[o.variable][o.column]

        a = value(self.left)
        b = value(self.right) if self.right else F.lit(self.constant)
        known = a.isNotNull() & (a.cast("string") != "")
        if self.right:
            known = known & b.isNotNull() & (b.cast("string") != "")
        test = {"==": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[self.op]
        return F.coalesce(known & test, F.lit(False))

    def sql(self) -> str:
        """As Spark SQL over aliases t0 and t1, 1 or 0."""
        name = lambda o: f"t{o.variable}.`{o.column}`"
        op = {"==": "="}.get(self.op, self.op)
        if self.model:
            return f"ML_{self.model}({name(self.left)}, {name(self.right)})"
        if self.right is None:
            text = (self.constant or "").replace("'", "''")
            return f"if({name(self.left)} {op} '{text}', 1, 0)"
        known = " and ".join(f"{name(o)} is not null and cast({name(o)} as string) <> ''" for o in (self.left, self.right))
        return f"if({known} and {name(self.left)} {op} {name(self.right)}, 1, 0)"

    def condition(self) -> str:
        """As a Spark SQL condition over aliases t0 and t1; equalities stay visible to the optimiser as join keys."""
        return self.sql().removeprefix("if(").removesuffix(", 1, 0)")


@dataclass(frozen=True)
class Rule:
    """``lhs -> rhs``; the left side is a set kept in text order."""

    lhs: tuple[Predicate, ...]
    rhs: Predicate

    @staticmethod
    def of(lhs: Iterable[Predicate], rhs: Predicate) -> Rule:
        return Rule(tuple(sorted(set(lhs), key=str)), rhs)

    def __str__(self) -> str:
        return " ^ ".join(map(str, self.lhs)) + f" -> {self.rhs}"

    def swapped(self) -> Rule:
        return Rule.of([p.swapped() for p in self.lhs], self.rhs.swapped())

    def attributes(self) -> set[str]:
        """Column names tagged by side: ``X_`` for the left, ``Y_`` for the right."""
        return {f"X_{a}" for p in self.lhs for a in p.attributes()} | {f"Y_{a}" for a in self.rhs.attributes()}

    def predicates(self) -> set[str]:
        return {str(p) for p in self.lhs} | {str(self.rhs)}

    def tables(self) -> dict[int, str]:
        out: dict[int, str] = {}
        for p in (*self.lhs, self.rhs):
            for o in (p.left, p.right):
                if o:
                    out[o.variable] = o.table
        out.setdefault(1, out.get(0, ""))
        out.setdefault(0, out[1])
        return out

    def check_sql(self) -> str:
        """A Spark SQL query that counts the pairs of the left side and of the whole rule."""
        t = self.tables()
        x = " and ".join(p.condition() for p in self.lhs) or "true"
        return f"select count(*) as lhs_support, sum({self.rhs.sql()}) as support from {t[0]} t0 join {t[1]} t1 on {x}"


def text(rule: Rule, supp: int, conf: float, rel: float = 0.0, div: float = 0.0, score: float = 0.0) -> str:
    """The line of a result file."""
    return f"Rule : {rule}, supp: {supp}, conf:{conf}, rel_score:{rel}, div_score:{div}, score:{score}"


_OPERAND = r"(?:(\w+)\.)?t(\d+)\.(\w+)"
_COMPARED = re.compile(rf"^\s*{_OPERAND}\s*(==|=|<>|!=|<=|>=|<|>)\s*(.*?)\s*$")
_TABLE_LAST = re.compile(r"^\s*(\w+)\.t(\d+)\.(\w+)\s*$")
_BARE = re.compile(r"^\s*t(\d+)\.(\w+)\s*$")
_SIMILAR = re.compile(rf"^\s*ML(?:_(\w+))?\(\s*{_OPERAND}\s*,\s*{_OPERAND}\s*\)\s*$")


def parse_predicate(source: str, table: str = "") -> Predicate:
    """``T.t0.A op T.t1.B``, ``T.t0.A op constant`` or ``ML_m(T.t0.A, T.t1.B)``; ``table`` fills in a missing name."""
    if m := _SIMILAR.match(source):
        return Predicate(Operand(m[2] or table, int(m[3]), m[4]), "ML", Operand(m[5] or table, int(m[6]), m[7]), model=m[1] or "default")
    m = _COMPARED.match(source)
    if not m:
        raise ValueError(f"no predicate: {source!r}")
    op = {"=": "==", "!=": "<>"}.get(m[4], m[4])
    left = Operand(m[1] or table, int(m[2]), m[3])
    if r := _TABLE_LAST.match(m[5]):
        return Predicate(left, op, Operand(r[1], int(r[2]), r[3]))
    if r := _BARE.match(m[5]):
        return Predicate(left, op, Operand(table or left.table, int(r[1]), r[2]))
    return Predicate(left, op, constant=m[5])


_MEASURES = re.compile(r",\s*(supp|conf|rel_score|div_score|score|confidence|support)\s*:\s*([-+0-9.eE]+)")


def parse_rule(line: str, table: str = "") -> tuple[Rule, dict[str, float]]:
    """A rule line with ``^`` or ``⋀`` between predicates, and the measures after it."""
    measures = {k: float(v) for k, v in _MEASURES.findall(line)}
    body = _MEASURES.sub("", re.sub(r"^\s*Rule\s*:\s*", "", line)).strip().rstrip(",")
    left, _, right = body.rpartition("->")
    lhs = [parse_predicate(p, table) for p in re.split(r"\s*(?:\^|⋀)\s*", left.strip()) if p.strip()]
    return Rule.of(lhs, parse_predicate(right, table)), measures


# --- logical closure -----------------------------------------------------------------


def closure(known: Iterable[Predicate]) -> set[Predicate] | None:
    """All consequences by implication, symmetry and transitivity; None if they contradict."""
    facts: dict[tuple[str, str], set[str]] = {}
    nodes: dict[str, Operand | str] = {}

    def node(x: Operand | str) -> str:
        name = str(x) if isinstance(x, Operand) else f"'{x}"
        nodes[name] = x
        return name

    def add(a: str, op: str, b: str) -> bool:
        new = False
        for o in IMPLIES[op]:
            for p, q, r in ((a, o, b), (b, SYMMETRIC[o], a)):
                have = facts.setdefault((p, r), set())
                if q not in have:
                    have.add(q)
                    new = True
        return new

    kept = {p for p in known if p.is_ml}
    for p in known:
        if not p.is_ml:
            add(node(p.left), p.op, node(p.right if p.right else p.constant or ""))
    names = sorted(nodes)
    changed = True
    while changed:
        changed = False
        for a in names:
            for b in names:
                ab = facts.get((a, b), set())
                if {"<=", ">="} <= ab and "==" not in ab:
                    changed |= add(a, "==", b)
                if {"<=", "<>"} <= ab and "<" not in ab:
                    changed |= add(a, "<", b)
                for c in names:
                    if a == c:
                        continue
                    for o1 in tuple(facts.get((a, b), ())):
                        for o2 in tuple(facts.get((b, c), ())):
                            if (o := chain(o1, o2)) and o not in facts.get((a, c), set()):
                                changed |= add(a, o, c)
    for (a, b), ops in facts.items():
        if any(INVERSE[o] in ops for o in ops) or (a == b and ops & {"<", ">", "<>"}):
            return None
        if isinstance(nodes[a], str) and isinstance(nodes[b], str) and a != b and "==" in ops:
            return None
    out = set(kept)
    for (a, b), ops in facts.items():
        left, right = nodes[a], nodes[b]
        if isinstance(left, Operand):
            out |= {Predicate(left, o, right) if isinstance(right, Operand) else Predicate(left, o, constant=right) for o in ops}
    return out


def implied_by(rule: Rule, known: Iterable[Rule]) -> bool:
    """Whether a known rule with the same consequence (or its swap) asks for no more than this one."""
    full = closure(rule.lhs)
    if full is None:
        return True
    for other in known:
        for r in (other, other.swapped()):
            if r.rhs == rule.rhs and set(r.lhs) <= full:
                return True
    return False


def has_duplicate_constants(lhs: Iterable[Predicate]) -> bool:
    """Two constants on one variable and attribute."""
    seen = [(p.left.variable, p.left.table, p.left.column) for p in lhs if p.is_constant]
    return len(seen) != len(set(seen))
