"""Set algebra: set-tries for the search, and set columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SetTrie:
    """Sets of small integers with subset and superset queries."""

    def __init__(self, sets: Iterable[Iterable[int]] = ()):
        self.root: dict = {}
        for s in sets:
            self.add(s)

    def add(self, s: Iterable[int]) -> None:
        node = self.root
        for x in sorted(s):
            node = node.setdefault(x, {})
        node[None] = True

    def remove(self, s: Iterable[int]) -> bool:
        trail, node = [], self.root
        for x in sorted(s):
            if x not in node:
                return False
            trail.append((node, x))
            node = node[x]
        if node.pop(None, None) is None:
            return False
        while trail and not node:
            parent, x = trail.pop()
            del parent[x]
            node = parent
        return True

    def contains_subset(self, s: Iterable[int]) -> bool:
        """Whether some stored set lies within ``s``."""
        items = sorted(s)

        def down(node: dict, at: int) -> bool:
            if None in node:
                return True
            return any(items[i] in node and down(node[items[i]], i + 1) for i in range(at, len(items)))

        return down(self.root, 0)

    def supersets(self, s: Iterable[int]) -> Iterator[frozenset[int]]:
        """Stored sets that hold all of ``s``."""
        items = sorted(s)

        def down(node: dict, at: int, path: tuple[int, ...]) -> Iterator[frozenset[int]]:
            if at == len(items) and None in node:
                yield frozenset(path)
            for x, child in node.items():
                if x is not None and (at == len(items) or x <= items[at]):
                    yield from down(child, at + (at < len(items) and x == items[at]), (*path, x))

        yield from down(self.root, 0, ())


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def symmetric_difference(a: Column, b: Column) -> Column:
    """What only one of two sets has; union, intersection and difference are Spark's own."""
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def merge_units(units: DataFrame, x: str = "x", rhs: str = "rhs") -> DataFrame:
    """Work units with equal left sides as one, their consequences united."""
    return units.groupBy(x).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(rhs)))).alias(rhs))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def rule_difference(rules: DataFrame, main: DataFrame) -> DataFrame:
    """Rules (``lhs`` array, ``rhs``) that no main rule with the same consequence and a subset of the left side covers."""
    m = main.select(F.col("lhs").alias("_lhs"), F.col("rhs").alias("_rhs"))
    return rules.join(m, (rules["rhs"] == m["_rhs"]) & (F.size(F.array_except("_lhs", rules["lhs"])) == 0), "left_anti")


def same_rules(a: DataFrame, b: DataFrame) -> bool:
    return rule_difference(a, b).isEmpty() and rule_difference(b, a).isEmpty()
