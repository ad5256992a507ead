"""Bounded search against full search, and rules over many variables against brute force."""

import random
from itertools import product

import pytest

from ruleloom.operators import matching
from ruleloom.operators.chains import chain_support
from ruleloom.operators.support import evaluate
from ruleloom.plans import scoring
from ruleloom.plans.bounded import Frontier, choose
from ruleloom.plans.config import Config, Weights
from ruleloom.plans.lattice import search
from ruleloom.predicates import Rule, parse_predicate
from ruleloom.schema import TableSet

SPACE = ["t0.A == t1.A", "t0.B == t1.B", "t0.C == t1.C", "t0.D == t1.D", "t0.B == x"]


def table(spark, seed, n=60):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", "c", "", None]), r.choice(["x", "y", None]), r.choice(["1", "2", "3"]), r.choice(["k", "l", "m", "n", ""])) for _ in range(n)]
    return TableSet({"t": spark.createDataFrame(rows, "A string, B string, C string, D string")})


def full_count(tables, space, right, **limits):
    """How many rules a full search counts."""
    from ruleloom.plans import lattice

    seen = []
    old = lattice.evaluate
    lattice.evaluate = lambda t, rules: seen.extend(rules) or old(t, rules)
    try:
        return search(tables, space, right, **limits), len(seen)
    finally:
        lattice.evaluate = old


@pytest.mark.parametrize(("seed", "k", "weights"), [(1, 1, Weights()), (2, 4, Weights(tuple_coverage=2.0)), (3, 50, Weights(supp=3.0, conf=0.5))])
def test_bounds_lose_no_choice(spark, seed, k, weights):
    t = table(spark, seed)
    space = [parse_predicate(s, "t") for s in (SPACE if k < 10 else SPACE[:3])]
    right = [p for p in space if not (p.is_constant and p.left.variable == 1)]
    found, n = full_count(t, space, right, sigma=40, delta=0.5, max_x=3)
    c = Config(k=k, trade_off=0.5, max_x=3, weights=weights)
    frontier = Frontier(t, space, right, 40, 0.5, 3)
    assert choose(frontier, c, 3600) == scoring.greedy(t, found, c, 3600)
    assert frontier.evaluated <= n
    if k < 10:
        assert frontier.evaluated < n
    if k < 10:
        return
    whole = Frontier(t, space, right, 40, 0.5, 3)
    c.prune = False
    assert choose(whole, c, 3600) == scoring.greedy(t, found, c, 3600)
    assert sorted(str(f.rule) for f in whole.valid) == [str(f.rule) for f in found]


def test_known_pairs_spare_counting(spark):
    """Where X -> p has told that X with p holds for too few pairs, rules with both on the left aren't counted."""
    t = TableSet({"t": spark.createDataFrame([("a", str(i % 4), str(i)) for i in range(16)], "A string, B string, C string")})
    space = [parse_predicate(s, "t") for s in ("t0.A == t1.A", "t0.B == t1.B", "t0.C == t1.C")]
    frontier = Frontier(t, space, space, 20, 0.9, 2)
    assert not frontier.waiting or all(frontier.at_most.get(x, 20) >= 20 for x, _ in frontier.waiting)
    assert evaluate(t, [Rule.of(space[:1], space[2])])[0][1] < 20
    assert (frozenset((space[0], space[2])), space[1]) not in frontier.waiting


def test_empty_space_and_table(spark):
    t = TableSet({"t": spark.createDataFrame([], "A string, B string")})
    space = [parse_predicate(s, "t") for s in ("t0.A == t1.A", "t0.B == t1.B")]
    assert choose(Frontier(t, [], [], 1, 0.5, 2), Config(), 0) == []
    assert choose(Frontier(t, space, space, 1, 0.5, 2), Config(), 0) == []


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("rhs", ["u.t0.B == v.t2.B", "v.t1.B == x", "u.t0.C == v.t1.B"])
def test_chain_support(spark, seed, rhs):
    r = random.Random(seed)
    rows = [[(r.choice(["a", "b", "", None]), r.choice(["x", "y", "", None]), r.choice([1, 2, 3, None])) for _ in range(12)] for _ in range(2)]
    t = TableSet({n: spark.createDataFrame(x, "A string, B string, C int") for n, x in zip("uv", rows, strict=True)})
    lhs = [parse_predicate(s) for s in ("u.t0.A == v.t1.A", "v.t1.C == v.t2.C", "u.t0.C <= v.t2.C", "v.t2.A == a")]
    y = parse_predicate(rhs)
    got = tuple(chain_support(t, lhs, y, {0: "u", 1: "v", 2: "v"}).first())
    at = lambda s, o: s[o.variable]["ABC".index(o.column)]
    text = lambda x: None if x is None else str(x)
    x = s = 0
    for side in product(rows[0], rows[1], rows[1]):
        a, b, c = side
        if a[0] in (None, "") or a[0] != b[0] or b[2] is None or b[2] != c[2] or a[2] is None or a[2] > c[2] or c[0] != "a":
            continue
        x += 1
        s += at(side, y.left) == y.constant if y.is_constant else text(at(side, y.left)) == text(at(side, y.right))
    assert got == (x, s)
    none = TableSet({n: t.table(n).limit(0) for n in "uv"})
    assert tuple(chain_support(none, lhs, y, {0: "u", 1: "v", 2: "v"}).first()) == (0, 0)


def test_chain_support_refuses(spark):
    t = TableSet({"u": spark.createDataFrame([("a", 1)], "A string, C int")})
    y = parse_predicate("u.t0.A == a")
    with pytest.raises(ValueError, match="tied"):
        chain_support(t, [parse_predicate("u.t0.C < u.t1.C")], y, {0: "u", 1: "u"})
    with pytest.raises(ValueError, match="counted"):
        chain_support(t, [parse_predicate("ML_near(u.t0.A, u.t1.A)")], y, {0: "u", 1: "u"})


def test_augmentations(spark):
    texts = ["COL a VAL one two three COL b VAL four five", "", None, "COL a VAL only"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, t string")
    got = {k: [r[0] for r in df.orderBy("i").select(matching.augment(df["t"], k)).collect()] for k in ("del", "ins")}
    assert got == {k: [r[0] for r in df.orderBy("i").select(matching.augment(df["t"], k)).collect()] for k in ("del", "ins")}
    marks = lambda s: [w for w in s.split() if w in ("COL", "VAL")]
    for short, whole, long in zip(got["del"], texts, got["ins"], strict=True):
        if whole is None:
            assert not short and not long
            continue
        assert marks(short) == marks(whole) == marks(long)
        assert len(whole.split()) - 4 <= len(short.split()) <= len(whole.split()) <= len(long.split()) <= len(whole.split()) + 1
    moved = [r[0] for r in df.orderBy("i").select(matching.append_column(df["t"])).collect()]
    assert moved == ["COL b VAL four five one two three", "", None, "COL a VAL only"]
