"""Registered queries of the rule and data-quality operators, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import strings as S
from .functions import vectors as V
from .operators import evidence, joins, matching, ranking, sampling, sets, stats
from .operators.support import classified, evaluate, pairs, support
from .operators.violations import violations
from .plans import discovery, scoring
from .plans.config import Config, Weights
from .plans.relevance import rule_pairs
from .predicates import Rule, parse_predicate
from .registry import ORACLE_SQL, QUERIES, query, read, rule, tables  # noqa: F401
from .schema import ForeignKey, TableSet, narrow_types

# --- statistics -------------------------------------------------------------------------


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority <> '' GROUP BY 1")
def histogram(spark, d):
    return stats.histogram(read(spark, d, "orders"), "o_orderpriority")


_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_present, count(*) AS n_distinct, count(*) FILTER (n > 1) AS n_repeated, "
    + (f"round(sum(CAST(v AS DOUBLE) * n) / sum(n), 6) AS average, round(sqrt(greatest(sum(CAST(v AS DOUBLE) * v * n) / sum(n) - pow(sum(CAST(v AS DOUBLE) * n) / sum(n), 2), 0)), 6) AS sigma" if num else "CAST(NULL AS DOUBLE) AS average, CAST(NULL AS DOUBLE) AS sigma")
    + f" FROM (SELECT {c} AS v, count(*) AS n FROM part WHERE {c} IS NOT NULL{'' if num else f' AND {c} <> {chr(39)}{chr(39)}'} GROUP BY 1)"
    for c, num in (("p_brand", False), ("p_type", False), ("p_size", True))
)


@query(_PROFILE)
def column_profile(spark, d):
    return stats.profile(read(spark, d, "part"), ["p_brand", "p_type", "p_size"])


@query("SELECT sum(least(coalesce(f, 0), coalesce(g, 0))) / sum(greatest(coalesce(f, 0), coalesce(g, 0))) AS shared FROM (SELECT c_nationkey AS v, count(*) AS f FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS v, count(*) AS g FROM supplier GROUP BY 1) b ON a.v = b.v")
def histogram_shared_ratio(spark, d):
    return stats.shared_ratio(read(spark, d, "customer"), "c_nationkey", read(spark, d, "supplier"), "s_nationkey")


@query("SELECT CAST(sum(f * g) AS BIGINT) AS support FROM (SELECT c_nationkey AS v, count(*) AS f FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS v, count(*) AS g FROM supplier GROUP BY 1) b ON a.v = b.v")
def predicate_support(spark, d):
    return stats.predicate_support(read(spark, d, "customer"), "c_nationkey", read(spark, d, "supplier"), "s_nationkey")


_TALL = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM part" for c in ("p_name", "p_brand", "p_type"))


@query(f"WITH t AS ({_TALL}), c AS (SELECT column_name, value, count(*) AS n FROM t WHERE value <> '' GROUP BY 1, 2) SELECT * FROM c WHERE 100.0 * n / (SELECT count(*) FROM part) > 3 AND 100.0 * n / (SELECT count(*) FROM part) < 90")
def frequent_constants(spark, d):
    return stats.frequent_constants(read(spark, d, "part"), 3, 90)


@query("SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 9) AS p_retailprice_scaled FROM part")
def minmax_scale(spark, d):
    return stats.min_max_scaled(read(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]).select("p_partkey", F.round("p_retailprice_scaled", 9).alias("p_retailprice_scaled"))


@query("WITH RECURSIVE s AS (SELECT list_sort(list_distinct(list(CAST(p_retailprice AS DOUBLE)))) AS v FROM part), r(i, last, kept) AS (SELECT 1, v[1], true FROM s UNION ALL SELECT i + 1, CASE WHEN v[i + 1] > last + (v[len(v)] - v[1]) / 10 THEN v[i + 1] ELSE last END, v[i + 1] > last + (v[len(v)] - v[1]) / 10 FROM r, s WHERE i < len(v)) SELECT last AS constant FROM r WHERE kept")
def interval_constants(spark, d):
    got = read(spark, d, "part").agg(F.collect_set("p_retailprice").alias("v"))  # the distinct values of one column
    return got.select(F.explode(stats.thinned(F.col("v"), 10)).alias("constant"))


@query("SELECT event_type, CAST(trunc(min(value)) AS BIGINT) AS low, CAST(trunc(max(value)) AS BIGINT) AS high FROM events GROUP BY 1")
def cluster_bounds(spark, d):
    return stats.cluster_bounds(read(spark, d, "events"), "event_type", "value")


@query()
def kmeans_constants(spark, d):
    return stats.kmeans_constants(read(spark, d, "part"), "p_retailprice", 4)


@query()
def null_pattern_clusters(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, None).otherwise(F.col("event_type")).alias("a"), F.when(F.col("user_id") % 2 == 0, "").otherwise(F.col("props")).alias("b"))
    return stats.null_pattern_clusters(e, 2, ["a", "b"]).groupBy("prediction").agg(F.count("*").alias("n"))


@query("SELECT 'c_name' AS column_name, 'string' AS kind UNION ALL SELECT 'key_text', 'long' UNION ALL SELECT 'bal_text', 'double'")
def narrowed_types(spark, d):
    c = read(spark, d, "customer").select("c_name", F.col("c_custkey").cast("string").alias("key_text"), F.col("c_acctbal").cast("string").alias("bal_text"))
    return spark.createDataFrame(list(narrow_types(c).items()), "column_name string, kind string")


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS BIGINT) AS code FROM orders")
def dictionary_codes(spark, d):
    """Order-preserving codes: distinct values are ranked, then joined back."""
    o = read(spark, d, "orders")
    codes = o.select("o_orderpriority").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("o_orderpriority")).cast("long"))
    return o.join(joins.small(codes), "o_orderpriority").select("o_orderkey", "code")


@query("SELECT p_type AS value, array_to_string(list_sort(list(p_partkey)), ',') AS tids FROM part GROUP BY 1")
def position_lists(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_type").alias("value")).agg(F.array_join(F.array_sort(F.collect_list("p_partkey")), ",").alias("tids"))


# --- support of rules ---------------------------------------------------------------------


def _rule_sql(table: str, key: str, y: str, c0: str = "true", c1: str = "true") -> str:
    return f"""
WITH r AS (SELECT {key} AS k, {y} AS y, count(*) FILTER ({c0}) AS a, count(*) FILTER ({c1}) AS b, count(*) AS e FROM {table} WHERE {' AND '.join(f"{k} IS NOT NULL AND CAST({k} AS VARCHAR) <> ''" for k in key.strip('()').split(', '))} GROUP BY 1, 2),
g AS (SELECT sum(a) AS a, sum(b) AS b, sum(e) AS e, sum(a * b) AS ab FROM r GROUP BY k)
SELECT CAST(coalesce(sum(a * b), 0) AS BIGINT) AS lhs_support, CAST(coalesce(sum(ab), 0) AS BIGINT) AS support FROM g WHERE e > 1"""


@query(_rule_sql("orders", "o_custkey", "o_orderstatus"))
def ree_support_nonconst(spark, d):
    return support(tables(spark, d, "orders"), rule("t0.o_custkey == t1.o_custkey -> t0.o_orderstatus == t1.o_orderstatus", "orders"))


@query(_rule_sql("part", "(p_brand, p_type)", "p_size"))
def ree_support_two_keys(spark, d):
    return support(tables(spark, d, "part"), rule("t0.p_brand == t1.p_brand ^ t0.p_type == t1.p_type -> t0.p_size == t1.p_size", "part"))


@query("WITH g AS (SELECT p_brand, count(*) AS n, count(*) FILTER (p_type = 'PROMO') AS h FROM part GROUP BY 1) SELECT CAST(sum(n * n) AS BIGINT) AS lhs_support, CAST(sum(h * n) AS BIGINT) AS support FROM g WHERE n > 1")
def ree_support_const_rhs(spark, d):
    return support(tables(spark, d, "part"), rule("t0.p_brand == t1.p_brand -> t0.p_type == PROMO", "part"))


@query(_rule_sql("part", "p_brand", "p_size", "p_type = 'PROMO'", "p_type = 'ECONOMY'"))
def ree_support_const_lhs(spark, d):
    return support(tables(spark, d, "part"), rule("t0.p_brand == t1.p_brand ^ t0.p_type == PROMO ^ t1.p_type == ECONOMY -> t0.p_size == t1.p_size", "part"))


@query("WITH a AS (SELECT c_nationkey AS k, count(*) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS h FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) SELECT CAST(sum(a.n * b.n) AS BIGINT) AS lhs_support, CAST(sum(h * b.n) AS BIGINT) AS support FROM a JOIN b USING (k)")
def ree_support_cross_table(spark, d):
    return support(tables(spark, d, "customer", "supplier"), rule("customer.t0.c_nationkey == supplier.t1.s_nationkey -> customer.t0.c_mktsegment == BUILDING", "customer"))


_LEVEL = ["p_brand", "p_type", "p_size"]
_LEVEL_SQL = " UNION ALL ".join(f"SELECT 'part.t0.{x} == part.t1.{x} -> part.t0.{y} == part.t1.{y}' AS rule, lhs_support, support FROM ({_rule_sql('part', x, y)})" for x in _LEVEL for y in _LEVEL if x != y)


def _level_rules() -> list[Rule]:
    return [rule(f"t0.{x} == t1.{x} -> t0.{y} == t1.{y}", "part") for x in _LEVEL for y in _LEVEL if x != y]


@query(_LEVEL_SQL)
def ree_level1_batch(spark, d):
    rules = _level_rules()
    rows = [(str(r), x, s) for r, (x, s) in zip(rules, evaluate(tables(spark, d, "part"), rules), strict=True)]
    return spark.createDataFrame(rows, "rule string, lhs_support long, support long")


@query(f"SELECT rule, lhs_support, support, support / lhs_support AS conf, CASE WHEN support < 5000 THEN 'invalid' WHEN support / lhs_support >= 0.1 THEN 'valid' ELSE 'intermediate' END AS class FROM ({_LEVEL_SQL})")
def ree_classify(spark, d):
    return classified(ree_level1_batch(spark, d), 5000, 0.1)


@query("SELECT a.o_orderkey AS t0_o_orderkey, b.o_orderkey AS t1_o_orderkey FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus <> '' AND b.o_orderstatus <> '' AND a.o_orderstatus = b.o_orderstatus AND a.o_totalprice < b.o_totalprice")
def ree_pairs_theta(spark, d):
    ps = [parse_predicate(p, "orders") for p in ("t0.o_custkey == t1.o_custkey", "t0.o_orderstatus == t1.o_orderstatus", "t0.o_totalprice < t1.o_totalprice")]
    return pairs(tables(spark, d, "orders"), ps, ["o_orderkey"], ["o_orderkey"])


@query("WITH m AS (SELECT l.c_custkey AS l, r.c_custkey AS r FROM customer l JOIN customer r ON l.c_nationkey = r.c_nationkey AND l.c_custkey < r.c_custkey) SELECT a.c_custkey AS t0_c_custkey, b.c_custkey AS t1_c_custkey FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment AND a.c_mktsegment <> '' JOIN m ON m.l = a.c_custkey AND m.r = b.c_custkey")
def ml_predicate_pairs(spark, d):
    """Every pair of customers of one nation as the classifier's answer."""
    c = read(spark, d, "customer")
    m = c.select(F.col("c_custkey").alias("l"), "c_nationkey").join(c.select(F.col("c_custkey").alias("r"), "c_nationkey"), "c_nationkey").where("l < r").select("l", "r")
    ps = [parse_predicate("t0.c_mktsegment == t1.c_mktsegment", "customer"), parse_predicate("ML_near(t0.c_custkey, t1.c_custkey)", "customer")]
    return pairs(tables(spark, d, "customer"), ps, ["c_custkey"], ["c_custkey"], {"near": m}, ("c_custkey", "c_custkey"))


@query("SELECT o_orderstatus, CAST(sum(less) AS BIGINT) AS pairs FROM (SELECT o_orderstatus, n * coalesce(sum(n) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM (SELECT o_orderstatus, o_orderdate, count(*) AS n FROM orders GROUP BY 1, 2)) GROUP BY 1")
def inequality_pair_counts(spark, d):
    return joins.inequality_count(read(spark, d, "orders"), "o_orderdate", ["o_orderstatus"])


# --- violations ---------------------------------------------------------------------------


@query("""WITH k AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1), t AS (SELECT o.* FROM orders o JOIN k USING (o_custkey))
SELECT DISTINCT CAST(1 AS INTEGER) AS side, a.o_orderkey AS tid FROM t a JOIN t b ON a.o_custkey = b.o_custkey AND b.o_orderstatus <> '' AND a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def violations_fd(spark, d):
    return violations(tables(spark, d, "orders"), rule("t0.o_custkey == t1.o_custkey -> t0.o_orderstatus == t1.o_orderstatus", "orders"), ("o_orderkey", "o_orderkey"))


@query("SELECT CAST(0 AS INTEGER) AS side, p_partkey AS tid FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size <= 50 GROUP BY 1 HAVING count(*) > 1) AND (p_type IS NULL OR p_type <> 'PROMO')")
def violations_const(spark, d):
    return violations(tables(spark, d, "part"), rule("t0.p_brand == t1.p_brand -> t0.p_type == PROMO", "part"), ("p_partkey", "p_partkey"))


@query()
def rule_pairs_label(spark, d):
    rules = [rule(t, "part") for t in ("t0.p_brand == t1.p_brand -> t0.p_type == PROMO", "t0.p_brand == t1.p_brand -> t0.p_type == t1.p_type", "t0.p_type == t1.p_type -> t0.p_size == 7", "t0.p_size == t1.p_size ^ t0.p_type == PROMO -> t0.p_brand == t1.p_brand")]
    return rule_pairs(spark, tables(spark, d, "part"), rules, {"part": ("p_partkey", "p_partkey")}, pairs=20)


# --- discovery and scores -------------------------------------------------------------------


def _config() -> Config:
    return Config(support=1e-4, confidence=0.02, k=5, max_x=2, trade_off=1.0, low=3, high=90, small_domain=3, weights=Weights(tuple_coverage=1.0))


def _tables(spark, d) -> TableSet:
    return tables(spark, d, "part", skip={"part": {"p_name", "p_retailprice"}})


@query()
def topk_diversified(spark, d):
    return discovery.discover(spark, _tables(spark, d), _config())


@query()
def topk_rules(spark, d):
    found, n = discovery.mine(_tables(spark, d), _config())
    return spark.createDataFrame([(str(f.rule), f.support, f.confidence, round(s, 9)) for s, f in scoring.top_k(found, _config(), n)], "rule string, supp long, conf double, score double")


_FIRST, _SECOND = "t0.p_brand == t1.p_brand -> t0.p_type == t1.p_type", "t0.p_size == t1.p_size -> t0.p_type == t1.p_type"


@query("""SELECT CAST((SELECT sum(n * n) FROM (SELECT count(*) AS n FROM part GROUP BY p_size, p_type)) - (SELECT sum(n * n) FROM (SELECT count(*) AS n FROM part GROUP BY p_size, p_type, p_brand)) AS BIGINT) AS new_pairs""")
def tuple_coverage_exact(spark, d):
    n = scoring.coverage(tables(spark, d, "part"), rule(_SECOND, "part"), [rule(_FIRST, "part")])
    return spark.createDataFrame([(n,)], "new_pairs long")


@query()
def rule_set_scores(spark, d):
    """The scores of the set that plain top-k chooses from all rules."""
    found, n = discovery.mine(_tables(spark, d), _config())
    best = [f for _, f in scoring.top_k(found, _config(), n)]
    return spark.createDataFrame([(k, round(v, 9)) for k, v in scoring.set_scores(best, _config(), n).items()], "measure string, value double")


@query()
def rule_swapping(spark, d):
    found, n = discovery.mine(_tables(spark, d), _config())
    return spark.createDataFrame([(str(f.rule),) for f in scoring.swap(found, _config(), n)], "rule string")


def _rule_rows(spark, which: range) -> DataFrame:
    rows = [(i, [f"x{j}" for j in range(8) if (i >> j) & 1], f"y{i % 3}") for i in which]
    return spark.createDataFrame(rows, "id long, lhs array<string>, rhs string")


_RULE_SQL = "SELECT i AS id, [j FOR j IN range(8) IF (i >> j) & 1 = 1] AS x, i % 3 AS y FROM range({a}, {b}) t(i)"


@query(f"WITH r AS ({_RULE_SQL.format(a=1, b=120)}), m AS ({_RULE_SQL.format(a=1, b=40)}) SELECT id FROM r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.y = r.y AND len(list_filter(m.x, lambda v: NOT list_contains(r.x, v))) = 0)")
def rule_diff(spark, d):
    return sets.rule_difference(_rule_rows(spark, range(1, 120)), _rule_rows(spark, range(1, 40))).select("id")


@query(f"WITH r AS ({_RULE_SQL.format(a=1, b=30)}) SELECT a.id AS l, b.id AS r, round(1 - len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))), 9) AS distance, CAST(-len(list_intersect(a.x, b.x)) AS BIGINT) AS nonoverlap FROM r a JOIN r b ON a.id < b.id")
def attr_jaccard_distance(spark, d):
    r = _rule_rows(spark, range(1, 30))
    a, b = r.select(F.col("id").alias("l"), F.col("lhs").alias("x")), r.select(F.col("id").alias("r"), F.col("lhs").alias("y"))
    return a.join(b, F.col("l") < F.col("r")).select("l", "r", F.round(V.jaccard_distance(F.col("x"), F.col("y")), 9).alias("distance"), (-F.size(F.array_intersect("x", "y"))).cast("long").alias("nonoverlap"))


@query("SELECT x % 5 AS x, array_to_string(list_sort(list_distinct(flatten(list([x % 3, x % 4])))), ',') AS rhs FROM range(60) t(x) GROUP BY 1")
def merge_work_units(spark, d):
    u = spark.range(60).select((F.col("id") % 5).alias("x"), F.array(F.col("id") % 3, F.col("id") % 4).alias("rhs"))
    return sets.merge_units(u).select("x", F.array_join("rhs", ",").alias("rhs"))


# --- joins ----------------------------------------------------------------------------------

_KEYS = [ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"), ForeignKey("nation", "n_regionkey", "region", "r_regionkey")]


@query("SELECT s_suppkey AS supplier__s_suppkey, n_name AS nation__n_name, r_name AS region__r_name FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey FULL JOIN region ON n_regionkey = r_regionkey")
def fk_full_outer(spark, d):
    return joins.fk_chain(tables(spark, d, "supplier", "nation", "region", keys=_KEYS), _KEYS).select("supplier__s_suppkey", "nation__n_name", "region__r_name")


@query("SELECT s_suppkey AS supplier__s_suppkey, n_name AS nation__n_name, r_name AS region__r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def fk_left_outer(spark, d):
    return joins.fk_chain(tables(spark, d, "supplier", "nation", "region", keys=_KEYS, drop_useless={"nation", "region"}), _KEYS).select("supplier__s_suppkey", "nation__n_name", "region__r_name")


@query("SELECT s_suppkey AS supplier__s_suppkey, n_name AS nation__n_name, r_name AS region__r_name FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey FULL JOIN region ON n_regionkey = r_regionkey")
def fk_generated_sql(spark, d):
    t = tables(spark, d, "supplier", "nation", "region", keys=_KEYS)
    t.register()
    return spark.sql(joins.chain_sql(_KEYS, {"supplier": ["s_suppkey"], "nation": ["n_name"], "region": ["r_name"]}))


@query("SELECT 'supplier>nation' AS path UNION ALL SELECT 'supplier>nation>region' UNION ALL SELECT 'nation>region'")
def fk_join_paths(spark, d):
    return spark.createDataFrame([(">".join([p[0].table, *(k.to_table for k in p)]),) for p in joins.join_paths(_KEYS)], "path string")


@query("SELECT c_custkey AS tid1, array_to_string(list_sort(list(o_orderkey)), ',') AS tids FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def fk_collective_groups(spark, d):
    g = joins.fk_groups(tables(spark, d, "orders", "customer"), ForeignKey("orders", "o_custkey", "customer", "c_custkey"), "o_orderkey", "c_custkey")
    return g.select("tid1", F.array_join("tids", ",").alias("tids"))


@query("SELECT s.s_suppkey AS t0, c.c_custkey AS t1, n.n_nationkey AS t2 FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN customer c ON c.c_nationkey = n.n_nationkey WHERE c.c_mktsegment = 'BUILDING'")
def multi_variable_join(spark, d):
    ps = [parse_predicate(p) for p in ("supplier.t0.s_nationkey == nation.t2.n_nationkey", "customer.t1.c_nationkey == nation.t2.n_nationkey", "customer.t1.c_mktsegment == BUILDING")]
    return joins.multi_variable(tables(spark, d, "supplier", "customer", "nation"), ps, {0: "supplier", 1: "customer", 2: "nation"}, {0: "s_suppkey", 1: "c_custkey", 2: "n_nationkey"})


@query("SELECT d.* EXCLUDE (text) FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id")
def label_semi_join(spark, d):
    return joins.labelled_rows(read(spark, d, "documents").drop("text"), read(spark, d, "labels"), "doc_id")


@query("""WITH n AS (SELECT count(*) AS total FROM benchmark), t AS (SELECT DISTINCT item_id AS id, unnest(string_split_regex(lower(trim(text)), '\\s+')) AS token FROM benchmark),
g AS (SELECT token FROM t WHERE length(token) >= 4 GROUP BY 1 HAVING count(*) <= 0.1 * (SELECT total FROM n) AND count(*) > 1)
SELECT DISTINCT a.id AS l, b.id AS r FROM t a JOIN t b ON a.token = b.token AND a.id < b.id JOIN g ON g.token = a.token""")
def token_blocking(spark, d):
    return joins.token_blocks(read(spark, d, "benchmark"), "item_id", "text")


_SHINGLE = "list_distinct([substr(v, CAST(i AS INTEGER), 3) FOR i IN range(1, length(v) - 1)])"


@query(f"WITH a AS (SELECT p_partkey AS l, {_SHINGLE.replace('v', 'p_name')} AS s FROM part WHERE p_partkey % 20 = 0), b AS (SELECT p_partkey AS r, {_SHINGLE.replace('v', 'p_name')} AS s FROM part), j AS (SELECT l, r, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS jaccard FROM a, b) SELECT l, r, round(jaccard, 9) AS jaccard FROM j WHERE jaccard >= 0.5")
def similarity_join(spark, d):
    """Queries: every part whose key is divisible by 20, against all parts."""
    p = read(spark, d, "part")
    return joins.similarity_join(p.where("p_partkey % 20 = 0"), p, "p_partkey", "p_name", "p_partkey", "p_name").withColumn("jaccard", F.round("jaccard", 9))


@query()
def similarity_links(spark, d):
    """Every part against every part: its class of equal shingle sets and how many other parts are similar."""
    return joins.similarity_links(read(spark, d, "part"), "p_partkey", "p_name")


@query()
def similarity_class_pairs(spark, d):
    """Similar classes of parts by their least keys; with ``similarity_links`` for membership, every link between parts."""
    _, classes = joins.similarity_classes(read(spark, d, "part"), "p_partkey", "p_name")
    ids = classes.select("fp", "class_id")
    met = joins.class_pairs(classes).join(ids.toDF("l", "a"), "l").join(ids.toDF("r", "b"), "r")
    return met.where("a < b").select(F.col("a").alias("l"), F.col("b").alias("r"), F.round("jaccard", 9).alias("jaccard"))


@query("SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_suppkey = l.l_suppkey AND m.l_returnflag = 'R')")
def uncovered_rows(spark, d):
    """Pairs of order and supplier that no returned line covers."""
    pairs_ = read(spark, d, "lineitem")
    return joins.uncovered(pairs_.select("l_orderkey", "l_suppkey").distinct(), pairs_.where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey").distinct())


# --- evidence ---------------------------------------------------------------------------------


@query("SELECT concat_ws(',', CASE WHEN l_discount > 0.05 THEN 'discount' END, CASE WHEN l_quantity > 25 THEN 'many' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END) AS predicates, count(*) AS count FROM lineitem GROUP BY 1")
def evidence_set(spark, d):
    e = evidence.evidence(read(spark, d, "lineitem"), {"discount": F.col("l_discount") > 0.05, "many": F.col("l_quantity") > 25, "returned": F.col("l_returnflag") == "R"})
    return e.select(F.array_join("predicates", ",").alias("predicates"), "count")


@query("SELECT CAST(l_discount > 0.05 AS INTEGER) AS discount, CAST(l_quantity > 25 AS INTEGER) AS many, count(*) AS support FROM lineitem GROUP BY 1, 2")
def evidence_matrix(spark, d):
    e = evidence.evidence(read(spark, d, "lineitem"), {"discount": F.col("l_discount") > 0.05, "many": F.col("l_quantity") > 25})
    return evidence.matrix(e, ["discount", "many"])


@query()
def evidence_partition(spark, d):
    e = evidence.evidence(read(spark, d, "lineitem"), {"discount": F.col("l_discount") > 0.05, "many": F.col("l_quantity") > 25, "returned": F.col("l_returnflag") == "R"})
    names = ["discount", "many", "returned"]
    return evidence.partition(evidence.matrix(e, names), names, 2, 100)


@query("SELECT corr(CAST(l_discount > 0.05 AS INTEGER), CAST(l_quantity > 25 AS INTEGER)).round(6) AS correlation FROM lineitem")
def predicate_correlation(spark, d):
    c = evidence.correlation(evidence_matrix(spark, d), ["discount", "many"])
    return spark.createDataFrame([(round(float(c[0, 1]), 6),)], "correlation double")


@query("SELECT p_partkey AS subject, 'p_brand' AS relation, p_brand AS object FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part")
def triples(spark, d):
    return evidence.triples(read(spark, d, "part"), "p_partkey", ["p_brand", "p_type"])


@query("SELECT p_brand AS subject, 'p_brand|p_type' AS relation, p_type AS object, count(*) AS n FROM part GROUP BY 1, 3")
def value_pair_triples(spark, d):
    return evidence.value_pair_triples(read(spark, d, "part"), "p_brand", "p_type")


# --- ranking ----------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, d):
    return ranking.top_k(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 25)


@query("SELECT o_orderstatus, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10")
def top_k_by_group(spark, d):
    return ranking.top_k_by(read(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", "o_orderkey", 10).select("o_orderstatus", "o_orderkey", "rank")


@query("SELECT min(o_totalprice) AS bound, count(*) AS n FROM (SELECT o_totalprice FROM orders ORDER BY 1 DESC LIMIT 10)")
def kth_lower_bound(spark, d):
    return ranking.kth_bound(read(spark, d, "orders"), "o_totalprice", 10)


@query("SELECT word, df FROM (SELECT word, count(DISTINCT p_partkey) AS df FROM (SELECT p_partkey, unnest(string_split_regex(lower(trim(p_name)), '\\s+')) AS word FROM part) WHERE word <> '' GROUP BY 1) ORDER BY df DESC, word LIMIT 20")
def frequent_words(spark, d):
    return ranking.frequent_words(read(spark, d, "part"), "p_name", 20)


# --- strings ----------------------------------------------------------------------------------


def _part_pairs(spark, d) -> DataFrame:
    """Pairs of ASCII part names within a brand and type."""
    p = read(spark, d, "part")
    a = p.select("p_brand", "p_type", "p_size", F.col("p_partkey").alias("l"), F.col("p_name").alias("x"))
    b = p.select("p_brand", "p_type", "p_size", F.col("p_partkey").alias("r"), F.col("p_name").alias("y"))
    return a.join(b, ["p_brand", "p_type", "p_size"]).where("l < r").select("l", "r", "x", "y")


_PAIRS = "(SELECT a.p_partkey AS l, b.p_partkey AS r, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)"


@query(f"SELECT l, r, CAST(levenshtein(x, y) AS BIGINT) AS d, round(levenshtein(x, y) / greatest(length(x), length(y)), 9) AS nd, CAST(damerau_levenshtein(x, y) AS DOUBLE) AS damerau FROM {_PAIRS}")
def string_levenshtein_join(spark, d):
    x, y = F.col("x"), F.col("y")
    return _part_pairs(spark, d).select("l", "r", S.levenshtein(x, y).cast("long").alias("d"), F.round(S.normalized_levenshtein(x, y), 9).alias("nd"), S.damerau(x, y).alias("damerau"))


_SETS = f"(SELECT l, r, x, y, {_SHINGLE.replace('v', 'x')} AS a, {_SHINGLE.replace('v', 'y')} AS b FROM {_PAIRS})"


@query(f"SELECT l, r, round(CASE WHEN x = y THEN 1.0 WHEN least(length(x), length(y)) < 3 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 9) AS jaccard, round(CASE WHEN x = y THEN 1.0 WHEN least(length(x), length(y)) < 3 THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 9) AS dice, round(CASE WHEN x = y THEN 1.0 WHEN least(length(x), length(y)) < 3 THEN 0.0 ELSE len(list_intersect(a, b)) / least(len(a), len(b)) END, 9) AS overlap FROM {_SETS}")
def shingle_similarities(spark, d):
    x, y = F.col("x"), F.col("y")
    return _part_pairs(spark, d).select("l", "r", F.round(S.jaccard(x, y), 9).alias("jaccard"), F.round(S.sorensen_dice(x, y), 9).alias("dice"), F.round(S.overlap_coefficient(x, y), 9).alias("overlap"))


_GRAMS = f"(SELECT l, r, x, y, [substr(x, CAST(i AS INTEGER), 3) FOR i IN range(1, length(x) - 1)] AS a, [substr(y, CAST(i AS INTEGER), 3) FOR i IN range(1, length(y) - 1)] AS b FROM {_PAIRS})"
_COUNT = "len(list_filter({s}, lambda z: z = g))"


@query(f"""WITH p AS {_GRAMS}, g AS (SELECT l, r, a, b, unnest(list_distinct(list_concat(a, b))) AS g FROM p), c AS (SELECT l, r, {_COUNT.format(s='a')} AS m, {_COUNT.format(s='b')} AS n FROM g)
SELECT l, r, CAST(sum(abs(m - n)) AS DOUBLE) AS qgram, round(sum(m * n) / sqrt(sum(m * m) * sum(n * n)), 9) AS cosine FROM c GROUP BY l, r""")
def shingle_profiles(spark, d):
    x, y = F.col("x"), F.col("y")
    return _part_pairs(spark, d).select("l", "r", S.qgram_distance(x, y).alias("qgram"), F.round(S.cosine(x, y), 9).alias("cosine"))


@query()
def string_distances(spark, d):
    """Every measure without a value oracle, between part names."""
    x, y = F.col("x"), F.col("y")
    return _part_pairs(spark, d).select("l", "r", S.optimal_string_alignment(x, y).alias("osa"), S.weighted_levenshtein(x, y, substitute=2.0).alias("weighted"), S.lcs_distance(x, y).alias("lcs"), S.metric_lcs(x, y).alias("metric_lcs"), S.jaro_winkler(x, y).alias("jaro_winkler"), S.ngram_distance(x, y).alias("ngram"), S.sift4(x, y).alias("sift4"))


@query()
def similarity_vectors(spark, d):
    return _part_pairs(spark, d).select("l", "r", S.similarity_vector(F.col("x"), F.col("y")).alias("v"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '([!-/:-@\[-`{-~])', ' \1 ', 'g'), '\s+', ' ', 'g')) AS clean FROM conversations")
def clean_text(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", S.spaced_punctuation(F.col("text")).alias("clean"))


@query("SELECT event_id, translate(translate(CAST(event_id AS VARCHAR), '0123456789', '零一二三四五六七八九'), '零一二三四五六七八九', '0123456789') AS digits FROM events")
def cjk_digits(spark, d):
    return read(spark, d, "events").select("event_id", S.cjk_digits(F.translate(F.col("event_id").cast("string"), "0123456789", "零一二三四五六七八九")).alias("digits"))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(trim(regexp_replace(p_name, '[^0-9A-Za-z]+', ' ', 'g')), ' '), lambda w: length(w) > 0 AND length(w) < 8), '-') AS runs, regexp_replace(p_name, '[^0-9A-Za-z]', '', 'g') AS kept FROM part")
def letter_digit_runs(spark, d):
    return read(spark, d, "part").select("p_partkey", S.letter_digit_runs(F.col("p_name")).alias("runs"), S.keep_letters_digits(F.col("p_name")).alias("kept"))


# --- vectors ----------------------------------------------------------------------------------


_PLANES = V.planes(12, 64, 3)
_BITS = " || ".join(f"CASE WHEN list_dot_product(CAST(embedding AS DOUBLE[]), {p}) >= 0 THEN '1' ELSE '0' END" for p in _PLANES)


@query(f"SELECT vec_id, {_BITS} AS bits FROM embeddings")
def lsh_buckets(spark, d):
    return read(spark, d, "embeddings").select("vec_id", V.lsh_bits(F.col("embedding"), _PLANES).alias("bits"))


@query("SELECT q.vec_id AS q, i.vec_id AS i, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings q JOIN embeddings i ON q.vec_id % 20 = 0 AND q.vec_id <> i.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) DESC, i.vec_id) <= 5")
def cosine_topk(spark, d):
    """Queries: every vector whose id is divisible by 20, against all vectors, in blocks by a bounded broadcast."""
    e = read(spark, d, "embeddings")
    q = joins.small(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")))
    scored = e.join(q, F.col("vec_id") != F.col("q")).select("q", F.col("vec_id").alias("i"), V.cosine_similarity(F.col("v"), F.col("embedding")).alias("c"))
    return ranking.top_k_by(scored, ["q"], "c", "i", 5).select("q", "i", F.round("c", 6).alias("cosine"))


@query("SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 6) AS euclidean, round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 6) AS l1 FROM embeddings")
def vector_distances(spark, d):
    v, w = F.col("embedding"), F.reverse("embedding")
    return read(spark, d, "embeddings").select("vec_id", F.round(V.euclidean(v, w), 6).alias("euclidean"), F.round(V.l1(v, w), 6).alias("l1"))


@query()
def lsh_neighbours(spark, d):
    """Queries: every vector whose id is divisible by 20, against all vectors, in blocks: neighbours are too far apart (cosines near 0.4) for buckets to find."""
    return ranking.nearest(read(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, "vec_id", "embedding", 3)


@query()
def projected_pairs(spark, d):
    return matching.projected_pairs(read(spark, d, "embeddings"), "vec_id", "embedding", bucket_length=2.0, tables=3, threshold=1.1)


# --- matching and sampling ----------------------------------------------------------------------


@query()
def label_components(spark, d):
    """Components over the edges of all customers; recursive SQL is too slow for them (tested with union-find)."""
    c = F.col("c_custkey")
    return matching.components(read(spark, d, "customer").select(c.alias("u"), (c * 3 % 1000).alias("v")), "u", "v")


@query()
def mixture_match(spark, d):
    x, y = F.col("x"), F.col("y")
    p = _part_pairs(spark, d).select("l", "r", (1.0 - S.normalized_levenshtein(x, y)).alias("lev"), S.jaccard(x, y, 2).alias("jac"))
    return matching.mixture_match(p, ["lev", "jac"])


@query("SELECT a.vec_id AS l, b.vec_id AS r, CAST(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.2 AS INTEGER) AS match FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 1")
def embedding_match(spark, d):
    e = read(spark, d, "embeddings")
    p = e.select(F.col("vec_id").alias("l"), "label", F.col("embedding").alias("v")).join(e.select(F.col("vec_id").alias("r"), "label", F.col("embedding").alias("w")), "label").where("r = l + 1")
    return matching.embedding_match(p, "v", "w", 0.2).select("l", "r", "match")


@query("SELECT p_partkey, 'COL p_brand VAL ' || p_brand || ' COL p_size VAL ' || p_size AS text FROM part")
def serialised_records(spark, d):
    return read(spark, d, "part").select("p_partkey", matching.serialise(["p_brand", "p_size"]).alias("text"))


@query("SELECT p_partkey, CAST(0 AS INTEGER) AS left_out, p_type AS text FROM part UNION ALL SELECT p_partkey, 1, p_brand FROM part")
def leave_one_out(spark, d):
    return matching.leave_one_out(read(spark, d, "part"), "p_partkey", ["p_brand", "p_type"])


@query()
def summarised_records(spark, d):
    return matching.summarise(read(spark, d, "part").select("p_partkey", matching.serialise(["p_name", "p_brand"]).alias("text")), "p_partkey", "text", 3)


@query("""WITH t AS (SELECT toxic AS y, CAST(quality = 0 AS INTEGER) AS p FROM labels), c AS (SELECT count(*) AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y <> 1 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p <> 1) AS fn, avg(CAST(y = p AS INTEGER)) AS accuracy, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse FROM t)
SELECT n, accuracy, tp / (tp + fn) AS recall, tp / (tp + fp) AS precision, 2 * tp / (2 * tp + fp + fn) AS f1, mae, mse FROM c""")
def eval_metrics(spark, d):
    return matching.metrics(read(spark, d, "labels").select(F.col("toxic").alias("y"), (F.col("quality") == 0).cast("int").alias("p")), "y", "p")


@query()
def seeded_sample(spark, d):
    return sampling.uniform(read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], size=100)


@query()
def hash_split(spark, d):
    return sampling.split(read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query()
def random_walk_sample(spark, d):
    return sampling.random_walk(read(spark, d, "part"), "p_partkey", ["p_brand", "p_type"], starts=5, steps=3)


@query("""WITH u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings),
s AS (SELECT a.vec_id, a.label, sum(1 - list_dot_product(a.u, b.u)) AS distance, count(*) AS n FROM u a JOIN u b ON a.label = b.label GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), vec_id) AS rank FROM s)
SELECT vec_id, label, round(distance, 6) AS distance FROM r WHERE rank <= greatest(1, floor(0.1 * n))""")
def cluster_representatives(spark, d):
    return sampling.representatives(read(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.1).select("vec_id", "label", F.round("distance", 6).alias("distance"))


# --- sources, sinks, models and streams ----------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part")
def csv_round_trip(spark, d):
    """Written as CSV, read back through the folder reader."""
    from .sources.readers import read_directory
    from .sources.writers import write_csv
    from .staging import shared_dir

    folder = shared_dir(spark)
    write_csv(read(spark, d, "part").select("p_partkey", "p_brand", "p_size"), f"{folder}/part.csv")
    return read_directory(spark, folder).table("part")


@query("SELECT r_regionkey, r_name FROM region")
def orc_round_trip(spark, d):
    from .sources.readers import read_table
    from .staging import shared_dir

    path = f"{shared_dir(spark)}/region.orc"
    read(spark, d, "region").write.orc(path)
    return read_table(spark, path).select("r_regionkey", "r_name")


@query()
def rule_file_round_trip(spark, d):
    """Rules found, written as result lines and read again."""
    from .sources.readers import read_rule_table
    from .sources.writers import write_rules
    from .staging import shared_dir

    path = f"{shared_dir(spark)}/rules"
    write_rules(topk_diversified(spark, d), path)
    return read_rule_table(spark, path)


@query("SELECT count(*) AS n, CAST(greatest(1, floor(count(*) * 0.1)) AS BIGINT) AS share, CAST(0 AS BIGINT) AS strange FROM part")
def ratio_scan(spark, d):
    """How many rows there are, how many a tenth is, and how many of that tenth are no rows of the table."""
    from .sources.readers import read_table

    whole = read_table(spark, f"{d}/part.parquet")
    part = read_table(spark, f"{d}/part.parquet", ratio=0.1)
    strange = part.join(whole, whole.columns, "left_anti").agg(F.count("*").alias("strange"))
    return whole.agg(F.count("*").alias("n")).join(part.agg(F.count("*").alias("share"))).join(strange)


@query()
def evaluated_rules(spark, d):
    """Given rules with their counts and the pairs that no earlier rule covers."""
    rules = [rule(t, "part") for t in (_FIRST, _SECOND, "t0.p_brand == t1.p_brand -> t0.p_size == t1.p_size")]
    rows = scoring.evaluate_rules(tables(spark, d, "part"), rules, 1)
    return spark.createDataFrame([tuple(r.values()) for r in rows], "rule string, lhs_support long, supp long, conf double, new_pairs long")


@query()
def relevance_scores(spark, d):
    """A relevance model fitted on rule pairs by their violations, applied to all level-one rules."""
    from .plans.relevance import RelevanceModel, encode

    rules = [rule(t, "part") for t in ("t0.p_brand == t1.p_brand -> t0.p_type == PROMO", "t0.p_brand == t1.p_brand -> t0.p_type == t1.p_type", "t0.p_type == t1.p_type -> t0.p_size == 7", "t0.p_size == t1.p_size ^ t0.p_type == PROMO -> t0.p_brand == t1.p_brand")]
    names = sorted({str(p) for r in [*rules, *_level_rules()] for p in (*r.lhs, r.rhs)})
    ids = {n: i + 1 for i, n in enumerate(names)}
    ranked = rule_pairs(spark, tables(spark, d, "part"), rules, {"part": ("p_partkey", "p_partkey")}, pairs=50).collect()  # rule pairs
    model = RelevanceModel(len(ids) + 1)
    coded = [encode(r, ids) for r in rules]
    side = lambda k, i: [coded[r[k]][i] for r in ranked]
    model.fit((side("left_id", 0), side("left_id", 1)), (side("right_id", 0), side("right_id", 1)), [r["label"] for r in ranked], epochs=50, rate=1e-2)
    rows = [(str(r), *encode(r, ids)) for r in _level_rules()]
    return spark.createDataFrame(rows, "rule string, lhs array<int>, rhs array<int>").select("rule", F.round(model.column("lhs", "rhs"), 6).alias("score"))


@query()
def predicate_precision(spark, d):
    """Predicates with a partial dependence on each other, by the graphical lasso."""
    names = ["discount", "many", "returned"]
    e = evidence.evidence(read(spark, d, "lineitem"), {"discount": F.col("l_discount") > 0.05, "many": F.col("l_quantity") > 25, "returned": F.col("l_returnflag") == "R"})
    theta = evidence.graphical_lasso(evidence.correlation(evidence.matrix(e, names), names), penalty=0.001)
    return spark.createDataFrame([(a, b, round(float(theta[i, j]), 6)) for i, a in enumerate(names) for j, b in enumerate(names) if i < j], "a string, b string, precision double")


@query("SELECT event_type AS value, count(*) AS n FROM events WHERE event_type <> '' GROUP BY 1")
def stream_histogram(spark, d):
    """The histogram of an event stream, brought up to date batch by batch."""
    from .staging import shared_dir
    from .streaming.histograms import histogram_stream, write_counts

    folder = shared_dir(spark)
    events = read(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events.parque[t]")
    write_counts(histogram_stream(stream, "event_type"), f"{folder}/counts", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/counts")


@query()
def discovery_two_tables(spark, d):
    """Rules across customer and supplier, tied by a joinable column."""
    t = tables(spark, d, "customer", "supplier", skip={"customer": {"c_name", "c_acctbal", "c_custkey"}, "supplier": {"s_name", "s_acctbal", "s_suppkey"}})
    return discovery.discover(spark, t, Config(support=1e-5, confidence=0.1, k=3, max_x=2, trade_off=0.5, low=5, high=90, small_domain=0, share=0.01, key_share=1.0, weights=Weights(tuple_coverage=0.0)))


from . import file_queries, measure_queries  # noqa: E402, F401  (they register theirs)
