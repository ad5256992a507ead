"""Rules against brute force over pairs."""

import random
from itertools import combinations, product

import pytest

from ruleloom.operators.sets import SetTrie
from ruleloom.operators.support import evaluate, paired_consequences, support
from ruleloom.operators.violations import violations
from ruleloom.plans import scoring
from ruleloom.plans.config import Config
from ruleloom.plans.lattice import search, sensible, ties
from ruleloom.predicates import INVERSE, Rule, closure, implied_by, parse_predicate, parse_rule, text
from ruleloom.schema import TableSet

PAIRS8 = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", ""), ("b", ""), ("c", "x"), ("", "x")]


def frame(spark, rows, schema="A string, B string, C string"):
    return spark.createDataFrame(rows, schema)


def rule(s, table="t"):
    return parse_rule(s, table)[0]


def brute(rows, r, mode="pairs"):
    """Counts over all ordered pairs."""
    joins = [p for p in r.lhs if not p.is_constant]
    key = lambda row, v: tuple(row[(p.left if p.left.variable == v else p.right).column] for p in joins)
    n = {}
    for row in rows:
        n[key(row, 0)] = n.get(key(row, 0), 0) + 1
    x = s = 0
    for t0, t1 in product(rows, rows):
        sides = (t0, t1)
        k = key(t0, 0)
        if k != key(t1, 1) or any(v in (None, "") for v in k) or n[k] < 2:
            continue
        if any(str(sides[p.left.variable][p.left.column]) != p.constant for p in r.lhs if p.is_constant):
            continue
        x += 1
        if r.rhs.is_constant:
            s += sides[r.rhs.left.variable][r.rhs.left.column] == r.rhs.constant
        else:
            a, b = (t0, t1) if r.rhs.left.variable == 0 else (t1, t0)
            s += a[r.rhs.left.column] == b[r.rhs.right.column]
    return x, s


def table(seed, n=40):
    r = random.Random(seed)
    return [{"A": r.choice(["a", "b", "c", "", None, "d"]), "B": r.choice(["x", "y", "", None]), "C": r.choice(["1", "2", None])} for _ in range(n)]


def test_worked_example(spark):
    t = TableSet({"t": frame(spark, PAIRS8, "A string, B string")})
    assert tuple(support(t, rule("t0.A == t1.A -> t0.B == t1.B")).first()) == (18, 10)


RULES = ["t0.A == t1.A -> t0.B == t1.B", "t0.A == t1.A ^ t0.B == x -> t0.C == t1.C", "t0.A == t1.A ^ t0.B == x ^ t1.B == y -> t0.C == t1.C", "t0.A == t1.A -> t0.B == x", "t0.A == t1.A ^ t1.C == 2 -> t1.B == y", "t0.A == t1.A ^ t0.C == t1.C -> t0.B == t1.B"]


@pytest.mark.parametrize("seed", range(3))
def test_support_against_pairs(spark, seed):
    rows = table(seed)
    t = TableSet({"t": frame(spark, [(r["A"], r["B"], r["C"]) for r in rows])})
    rules = [rule(s) for s in RULES]
    assert evaluate(t, rules) == [brute(rows, r) for r in rules]


def test_empty_table(spark):
    t = TableSet({"t": frame(spark, [])})
    assert evaluate(t, [rule(RULES[0]), rule(RULES[3])]) == [(0, 0), (0, 0)]


def test_cross_table_keeps_singletons(spark):
    t = TableSet({"l": frame(spark, [("a", "x"), ("b", "y")], "A string, B string"), "r": frame(spark, [("a", "x"), ("a", "z")], "A string, B string")})
    assert tuple(support(t, rule("l.t0.A == r.t1.A -> l.t0.B == r.t1.B")).first()) == (2, 1)


@pytest.mark.parametrize("seed", range(2))
def test_violations_against_pairs(spark, seed):
    rows = [dict(r, id=i) for i, r in enumerate(table(seed, 30))]
    t = TableSet({"t": spark.createDataFrame([(r["id"], r["A"], r["B"], r["C"]) for r in rows], "id long, A string, B string, C string")})
    n = {}
    for r in rows:
        n[r["A"]] = n.get(r["A"], 0) + 1
    want = {a["id"] for a in rows for b in rows if a["id"] != b["id"] and a["A"] is not None and a["A"] == b["A"] and b["B"] not in (None, "") and a["B"] != b["B"]}
    got = violations(t, rule(RULES[0]), ("id", "id"))
    assert {r["tid"] for r in got.collect()} == want
    const = violations(t, rule("t0.A == t1.A -> t0.B == x"), ("id", "id"))
    assert {r["tid"] for r in const.collect()} == {r["id"] for r in rows if r["A"] is not None and n[r["A"]] > 1 and r["B"] != "x"}


def test_search_finds_all_minimal_rules(spark):
    rows = table(5, 60)
    t = TableSet({"t": frame(spark, [(r["A"], r["B"], r["C"]) for r in rows])})
    space = [parse_predicate(s, "t") for s in ("t0.A == t1.A", "t0.B == t1.B", "t0.C == t1.C", "t0.B == x", "t1.B == y", "t0.C == 1")]
    right = [p for p in space if not (p.is_constant and p.left.variable == 1)]
    found = {str(f.rule) for f in search(t, space, right, sigma=20, delta=0.55, max_x=3)}
    assert found == {str(f.rule) for f in search(t, space, right, sigma=20, delta=0.55, max_x=3, prune=False)}
    valid = {}
    for size in (1, 2, 3):
        for lhs in combinations(sorted(space, key=str), size):
            for rhs in right:
                if rhs in lhs or not ties(lhs) or not sensible(lhs, rhs):
                    continue
                x, s = brute(rows, Rule.of(lhs, rhs))
                if s >= 20 and s / x >= 0.55 and not any(set(v) < set(lhs) for v, r in valid if r == rhs):
                    valid[lhs, rhs] = True
    assert found == {str(Rule.of(lhs, rhs)) for lhs, rhs in valid}


def test_coverage_counts_new_pairs(spark):
    rows = [r for r in table(7, 40) if r["A"] and r["B"] and r["C"]]
    t = TableSet({"t": frame(spark, [(r["A"], r["B"], r["C"]) for r in rows])})
    one, two = rule("t0.A == t1.A -> t0.B == t1.B"), rule("t0.C == t1.C -> t0.B == t1.B")
    both = [(a, b) for a, b in product(rows, rows) if a["C"] == b["C"] and a["B"] == b["B"]]
    want = sum(a["A"] != b["A"] for a, b in both)
    assert scoring.coverage(t, two, [one]) == want


def test_coverage_is_exact_with_many_overlapping_rules(spark):
    rows = [r for r in table(11, 60) if r["A"] and r["B"] and r["C"]]
    t = TableSet({"t": frame(spark, [(r["A"], r["B"], r["C"]) for r in rows])})
    values = {c: sorted({r[c] for r in rows}) for c in "ABC"}
    texts = ["t0.A == t1.A -> t0.B == t1.B", "t0.B == t1.B -> t0.C == t1.C", "t0.A == t1.A -> t0.C == t1.C", "t0.A == t1.A ^ t0.B == t1.B -> t0.C == t1.C"]
    texts += [f"t0.{x} == t1.{x} -> t{v}.{y} == {values[y][0]}" for x, y in ("AB", "BC", "CA", "AC") for v in (0, 1)]
    chosen = [rule(s) for s in texts]
    assert len(chosen) > 10
    new = rule("t0.C == t1.C -> t0.A == t1.A")

    def holds(r, a, b):
        side = (a, b)
        return all(side[p.left.variable][p.left.column] == (side[p.right.variable][p.right.column] if p.right else p.constant) for p in (*r.lhs, r.rhs))

    want = sum(holds(new, a, b) and not any(holds(r, a, b) for r in chosen) for a, b in product(rows, rows))
    assert scoring.coverage(t, new, chosen) == want
    assert scoring.coverage(t, new, [*chosen, new]) == 0
    lines = scoring.evaluate_rules(t, [*chosen, new], 1)
    assert lines[-1]["new_pairs"] == want


def test_consequences_of_one_left_side_share_a_scan(spark):
    rows = table(12, 50)
    t = TableSet({"t": frame(spark, [(r["A"], r["B"], r["C"]) for r in rows])})
    rules = [rule(s) for s in ("t0.A == t1.A -> t0.B == t1.B", "t0.A == t1.A -> t0.C == t1.C", "t0.A == t1.A -> t0.B == t1.C", "t0.A == t1.A ^ t0.B == t1.B -> t0.C == t1.C")]
    assert evaluate(t, rules) == [tuple(support(t, r).first()) for r in rules]
    plan = paired_consequences(t, rules[0].lhs, [r.rhs for r in rules[:2]])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_uncountable_predicates_are_refused(spark):
    t = TableSet({"t": frame(spark, [("1", "2", "3")])})
    for s in ("t0.A < t1.A -> t0.B == t1.B", "ML_near(t0.A, t1.A) -> t0.B == t1.B", "t0.A == t1.A -> t0.B <= t1.B"):
        with pytest.raises(ValueError, match="counted by key"):
            evaluate(t, [rule(s)])


def test_greedy_is_the_best_each_round(spark):
    rows = [r for r in table(9, 50)]
    t = TableSet({"t": frame(spark, [(r["A"], r["B"], r["C"]) for r in rows])})
    space = [parse_predicate(s, "t") for s in ("t0.A == t1.A", "t0.B == t1.B", "t0.C == t1.C")]
    found = search(t, space, space, sigma=1, delta=0.2, max_x=2)
    c = Config(k=3, trade_off=1.0, max_x=2)
    got = scoring.greedy(t, found, c, 2500)
    chosen, left = scoring.Chosen(), list(found)
    for line in got:
        best = max(left, key=lambda f: (round(scoring.relevance(f, c, 2500) + scoring.diversity(f, chosen, c, 2500, scoring.coverage(t, f.rule, [g.rule for g in chosen.rules]) if chosen.rules else None), 9), [-ord(x) for x in str(f.rule)]))
        assert str(best.rule) == line["rule"]
        chosen.add(best)
        left.remove(best)


def test_text_forms():
    for s in ("a.t0.x == a.t1.x", "a.t0.x == BR", "a.t0.x <= a.t1.y", "ML_jaccard(a.t0.x,a.t1.x)"):
        assert str(parse_predicate(s)) == s
    r, m = parse_rule("Rule : a.t0.x == a.t1.x ⋀ a.t0.y == c -> a.t0.z == a.t1.z, supp: 12, conf:0.5, rel_score:1.0, div_score:0.1, score:1.1")
    assert m["supp"] == 12 and len(r.lhs) == 2
    assert parse_rule(text(r, 12, 0.5))[0] == r
    assert r.swapped().swapped() == r
    with pytest.raises(ValueError):
        parse_predicate("nothing")


def test_closure():
    p = lambda s: parse_predicate(s, "t")
    c = closure([p("t0.a == t1.a"), p("t1.a == t1.b"), p("t0.x <= t1.y"), p("t0.x >= t1.y")])
    assert p("t0.a == t1.b") in c and p("t0.x == t1.y") in c
    assert closure([p("t0.a == 1"), p("t0.a == 2")]) is None
    assert closure([p("t0.a < t1.a"), p("t1.a < t0.a")]) is None
    assert p("t0.x < t1.y") in closure([p("t0.x <= t1.y"), p("t0.x <> t1.y")])
    assert all(INVERSE[INVERSE[o]] == o for o in INVERSE)
    weak, strong = rule("t0.a == t1.a -> t0.b == t1.b"), rule("t0.a == t1.a ^ t0.c == t1.c -> t0.b == t1.b")
    assert implied_by(strong, [weak]) and not implied_by(weak, [strong])


def test_set_trie():
    r = random.Random(3)
    kept = {frozenset(r.sample(range(9), r.randint(1, 4))) for _ in range(40)}
    trie = SetTrie(kept)
    for gone in list(kept)[:10]:
        assert trie.remove(gone) and not trie.remove(gone)
        kept.discard(gone)
    for _ in range(200):
        q = set(r.sample(range(9), r.randint(0, 6)))
        assert trie.contains_subset(q) == any(k <= q for k in kept)
        assert set(trie.supersets(q)) == {k for k in kept if k >= q}


def test_config():
    c = Config.parse("k=3;confidence=0.9;prune=false;weights.conf=2")
    assert (c.k, c.confidence, c.prune, c.weights.conf) == (3, 0.9, False, 2.0)
    with pytest.raises(ValueError):
        Config.parse("nonsense=1")
