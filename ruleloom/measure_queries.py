"""Queries of the cleaning, vector, set, record and counting functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import strings as S
from .functions import vectors as V
from .operators import matching, ranking, sets, stats
from .operators.chains import chain_support
from .predicates import parse_predicate
from .registry import query, read, rule, tables
from .schema import TableSet


@query("SELECT CAST(sum(n * n) AS BIGINT) AS cardinality FROM (SELECT count(*) AS n FROM part WHERE p_brand <> '' GROUP BY p_brand)")
def shared_cardinality(spark, d):
    return stats.shared_cardinality(read(spark, d, "part"), "p_brand")


@query("SELECT round(sum(o_totalprice), 4) AS total FROM (SELECT o_totalprice FROM orders ORDER BY 1 DESC LIMIT 10)")
def top_sum(spark, d):
    return ranking.top_sum(read(spark, d, "orders"), "o_totalprice").select(F.round("total", 4).alias("total"))


@query("""WITH t AS (SELECT w AS word, p_brand AS t FROM part, (VALUES ('1'), ('2'), ('#'), ('and')) v(w)) SELECT word, count(*) FILTER (regexp_matches(t, '[0-9A-Za-z]' || word)) / count(*) AS ratio FROM t WHERE contains(t, word) GROUP BY 1 HAVING ratio >= 0.1""")
def words_after_alnum(spark, d):
    return ranking.words_after_alnum(read(spark, d, "part"), "p_brand", ["1", "2", "#", "and"], 0.1)


@query("""SELECT c_custkey, regexp_extract(c_name, '([0-9A-Za-z]+)$', 1) AS tail, regexp_extract(c_name, '([0-9A-Za-z]+)#', 1) AS head, 'C|' || regexp_extract(c_name, '([0-9A-Za-z]+)#', 1) AS features,
array_to_string(list_sort(list_distinct([substr(c_mktsegment, CAST(i AS INTEGER), 4) FOR i IN range(1, length(c_mktsegment) - 2)])), ',') AS grams, 'two words' AS words, c_name || ' ' AS plain, 'a ' || lower(c_mktsegment) AS kept,
regexp_matches(CAST(c_acctbal AS VARCHAR), '^-?[0-9]+$') AS whole, true AS number, false AS blank, regexp_replace(c_name, '[^0-9A-Za-z]', '', 'g') AS letters FROM customer""")
def cleaned_names(spark, d):
    """The cleaners of names, each on a customer's fields."""
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    balance = F.col("c_acctbal").cast("string")
    features = F.array_join(F.array(F.lit("C"), S.keyword_features(name, ["#"])[0]), "|")
    return read(spark, d, "customer").select(
        "c_custkey", S.trailing_alnum(name).alias("tail"), S.before_keyword(name, "#").alias("head"), features.alias("features"), F.array_join(F.array_sort(S.char_ngrams(segment, 4)), ",").alias("grams"),
        F.array_join(S.words(F.lit("  two   words ")), " ").alias("words"), S.drop_parenthesised(F.concat(name, F.lit(" (of one) 12345678901"))).substr(F.lit(1), F.length(name) + 1).alias("plain"),
        S.remove_stop_words(F.concat(F.lit("a  the "), F.lower(segment), F.lit(" of")), ["the", "of"]).alias("kept"), S.is_integer(balance).alias("whole"), S.is_double(balance).alias("number"), S.is_blank_or_punctuation(name).alias("blank"), S.keep_cjk_alnum(name).alias("letters"),
    )


_E = "CAST(embedding AS DOUBLE[])"
_R = f"list_reverse({_E})"
_FLAT = V.planes(6, 64, 5)
_SIDE = lambda v: [f"CASE WHEN list_dot_product({v}, {p}) >= 0 THEN 1 ELSE 0 END" for p in _FLAT]
_DIFFER = " + ".join(f"abs({a} - {b})" for a, b in zip(_SIDE(_E), _SIDE(_R), strict=True))


@query(f"""SELECT vec_id, round(abs(list_avg({_E}) - list_avg({_E}[1:32])), 6) AS centred, round(list_sum([greatest(x, 0) FOR x IN {_E}]), 6) AS relu, round(1 / (1 + exp(-list_sum({_E}))), 6) AS sigmoid,
round(list_dot_product([x * x FOR x IN {_E}], {_R}), 6) AS cubes, round(1 - list_cosine_similarity({_E}, {_R}), 6) AS cosine, CAST(label = 0 AS INTEGER) AS is_0, CAST(label = 1 AS INTEGER) AS is_1, CAST({_DIFFER} AS INTEGER) AS hamming,
round({_E}[1] + 2 * {_E}[2], 6) AS first, round({_E}[2] - {_E}[1], 6) AS second FROM embeddings""")
def vector_arithmetic(spark, d):
    v = F.col("embedding").cast("array<double>")
    w = F.reverse(v)
    r6 = lambda c, n: F.round(c, 6).alias(n)
    product = V.matmul(F.slice(v, 1, 2), [[1.0, -1.0], [2.0, 1.0]])
    return read(spark, d, "embeddings").select("vec_id", r6(V.centred(v, F.slice(v, 1, 32)), "centred"), r6(V.total(V.relu(v)), "relu"), r6(V.sigmoid(V.total(v)), "sigmoid"), r6(V.dot(V.multiply(v, v), w), "cubes"), r6(V.cosine_distance(v, w), "cosine"), *V.one_hot(F.col("label"), [0, 1]), V.hamming(V.lsh_bits(v, _FLAT), V.lsh_bits(w, _FLAT)).cast("int").alias("hamming"), r6(product[0], "first"), r6(product[1], "second"))


@query("""WITH s AS (SELECT l_orderkey, list_distinct(list(l_linestatus || l_returnflag)) AS a, list_distinct(list(l_linestatus || l_returnflag) FILTER (l_quantity > 25)) AS b0 FROM lineitem GROUP BY 1), t AS (SELECT l_orderkey, a, coalesce(b0, []) AS b, ['OR', 'FN'] AS c FROM s)
SELECT l_orderkey, len(list_intersect(a, c)) AS both, len(list_distinct(list_concat(a, c))) AS either, len(a) + len(c) - 2 * len(list_intersect(a, c)) AS one, len(a) - len(list_intersect(a, b)) AS without, list_has_all(a, b) AS within, round(len(list_intersect(a, c)) / len(list_distinct(list_concat(a, c))), 9) AS jaccard FROM t""")
def set_algebra(spark, d):
    """Sets of kinds of lines by order: all of them, those of large quantities, and a fixed set."""
    kind = F.concat("l_linestatus", "l_returnflag")
    t = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(kind).alias("a"), F.collect_set(F.when(F.col("l_quantity") > 25, kind)).alias("b"))
    a, b, c = F.col("a"), F.col("b"), F.array(F.lit("OR"), F.lit("FN"))
    n = lambda x, name: F.size(x).cast("long").alias(name)
    return t.select("l_orderkey", n(F.array_intersect(a, c), "both"), n(F.array_union(a, c), "either"), n(sets.symmetric_difference(a, c), "one"), n(F.array_except(a, b), "without"), sets.is_subset(b, a).alias("within"), F.round(sets.jaccard(a, c), 9).alias("jaccard"))


_TEXT = "'COL p_name VAL ' || p_name || ' COL p_size VAL ' || p_size"


@query(f"""SELECT p_partkey, array_to_string(list_filter(string_split({_TEXT}, ' '), lambda w: w IN ('COL', 'VAL') OR length(w) > 2), ' ') AS longer, array_to_string(string_split(replace({_TEXT}, '#', ''), ' '), ' ') AS letters,
'p_name COL' || substr({_TEXT}, 11) AS swapped, 'COL p_name VAL ' || p_name AS dropped, 'COL p_size VAL ' || p_size || ' ' || p_name AS appended, 'weighs 1200 or 2.5 or 3' AS numbers, 'code ID(AB1234) of NUM(12) and NUM(2.5) kg' AS tagged FROM part""")
def augmented_records(spark, d):
    text = matching.serialise(["p_name", "p_size"])
    return read(spark, d, "part").select(
        "p_partkey", matching.augment(text, "drop_len").alias("longer"), matching.augment(text, "drop_sym").alias("letters"), matching.augment(text, "swap").alias("swapped"), matching.augment(text, "drop_col").alias("dropped"), matching.append_column(text).alias("appended"),
        matching.normalise_numbers(F.lit("weighs 1,200 or 2.50 or 3.0")).alias("numbers"), matching.tag_entities(F.lit("code AB1234 of 12 and 2.5 kg")).alias("tagged"),
    )


@query("SELECT CAST(s_suppkey + 100 AS BIGINT) AS node, 'S' || s_nationkey AS entity FROM supplier UNION ALL SELECT DISTINCT CAST(s_nationkey AS BIGINT), 'S' || s_nationkey FROM supplier")
def entity_labels(spark, d):
    """Suppliers of one nation are one entity."""
    return matching.entity_ids(read(spark, d, "supplier").selectExpr("s_suppkey + 100 as u", "cast(s_nationkey as bigint) as v"), "u", "v")


@query("SELECT unnest(['p_brand', 'p_type']) AS attribute")
def paired_attributes(spark, d):
    p = read(spark, d, "part")
    names = [*(f"left_{c}" for c in p.columns if c != "p_size"), *(f"right_{c}" for c in ("p_type", "p_brand", "p_size"))]
    return spark.createDataFrame([(c,) for c in matching.paired_columns(names)], "attribute string")


@query("SELECT count(*) AS lhs_support, CAST(sum(CASE WHEN a.p_size = b.p_size THEN 1 ELSE 0 END) AS BIGINT) AS support FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_brand <> '' WHERE a.p_type = 'PROMO'")
def rule_check_sql(spark, d):
    """The SQL form of a rule, run by Spark over registered tables."""
    t = tables(spark, d, "part")
    t.register()
    return spark.sql(rule("t0.p_brand == t1.p_brand ^ t0.p_type == PROMO -> t0.p_size == t1.p_size", "part").check_sql())


@query("SELECT count(*) AS lhs_support, CAST(coalesce(sum(CASE WHEN a.o_orderstatus = b.o_orderstatus THEN 1 ELSE 0 END), 0) AS BIGINT) AS support FROM orders a JOIN customer c ON a.o_custkey = c.c_custkey JOIN orders b ON b.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
def multi_variable_support(spark, d):
    """A rule over three tuple variables: two orders of one customer."""
    lhs = [parse_predicate(p) for p in ("orders.t0.o_custkey == customer.t1.c_custkey", "orders.t2.o_custkey == customer.t1.c_custkey", "customer.t1.c_mktsegment == BUILDING")]
    return chain_support(tables(spark, d, "orders", "customer"), lhs, parse_predicate("orders.t0.o_orderstatus == orders.t2.o_orderstatus"), {0: "orders", 1: "customer", 2: "orders"})


@query("SELECT CAST(sum(a.n * b.n) AS BIGINT) AS lhs_support, CAST(sum(a.h * b.n) AS BIGINT) AS support FROM (SELECT c_nationkey AS k, count(*) AS n, count(*) FILTER (c_mktsegment = 'MACHINERY') AS h FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b USING (k) JOIN nation ON n_nationkey = k")
def star_support(spark, d):
    """A rule over three tables that meet in one."""
    lhs = [parse_predicate(p) for p in ("supplier.t0.s_nationkey == nation.t2.n_nationkey", "customer.t1.c_nationkey == nation.t2.n_nationkey")]
    return chain_support(tables(spark, d, "supplier", "customer", "nation"), lhs, parse_predicate("customer.t1.c_mktsegment == MACHINERY"), {0: "supplier", 1: "customer", 2: "nation"})


def _customers(spark, d) -> TableSet:
    return tables(spark, d, "customer", "supplier", skip={"customer": {"c_name", "c_acctbal", "c_custkey"}, "supplier": {"s_name", "s_acctbal", "s_suppkey"}})


@query("""WITH r AS (SELECT sum(least(coalesce(f, 0), coalesce(g, 0))) / sum(greatest(coalesce(f, 0), coalesce(g, 0))) AS shared FROM (SELECT c_nationkey AS v, count(*) AS f FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS v, count(*) AS g FROM supplier GROUP BY 1) b ON a.v = b.v)
SELECT unnest(['customer.t0.c_nationkey == customer.t1.c_nationkey', 'customer.t0.c_mktsegment == customer.t1.c_mktsegment', 'supplier.t0.s_nationkey == supplier.t1.s_nationkey']) AS predicate UNION ALL SELECT 'customer.t0.c_nationkey == supplier.t1.s_nationkey' FROM r WHERE shared > 0.01""")
def equality_predicates(spark, d):
    """The equalities of the predicate space of two tables."""
    return spark.createDataFrame([(str(p),) for p in stats.equality_space(_customers(spark, d), 0.01)], "predicate string")


@query("WITH c AS (SELECT c_mktsegment AS value, count(*) AS n FROM customer WHERE c_mktsegment <> '' GROUP BY 1) SELECT 'customer.t' || v || '.c_mktsegment == ' || value AS predicate, n FROM c, (VALUES (0), (1)) t(v) WHERE 100.0 * n / (SELECT count(*) FROM customer) > 5 AND 100.0 * n / (SELECT count(*) FROM customer) < 90")
def constant_predicates(spark, d):
    """The constants of the predicate space, on either tuple variable."""
    return spark.createDataFrame([(str(p), n) for p, n in stats.constant_space(_customers(spark, d), 5, 90)], "predicate string, n long")


@query("""WITH m AS (SELECT (SELECT avg(c_acctbal) FROM customer) AS a, (SELECT avg(s_acctbal) FROM supplier) AS b, (SELECT stddev_pop(c_acctbal) FROM customer) AS s, (SELECT stddev_pop(s_acctbal) FROM supplier) AS t)
SELECT true AS same_column, false AS other_column, least(a, b) / greatest(a, b) > 0.3 AND least(s, t) / greatest(s, t) > 0.3 AND a * b > 0 AS comparable FROM m""")
def column_pair_tests(spark, d):
    """Whether columns may be joined, or compared."""
    t = tables(spark, d, "customer", "supplier")
    row = (stats.joinable(t, "customer", "c_nationkey", "customer", "c_nationkey"), stats.joinable(t, "customer", "c_name", "customer", "c_mktsegment"), stats.comparable(t, "customer", "c_acctbal", "supplier", "s_acctbal"))
    return spark.createDataFrame([row], "same_column boolean, other_column boolean, comparable boolean")


@query("SELECT q.p_partkey AS l, i.p_partkey AS r FROM part q JOIN part i ON q.p_brand = i.p_brand AND q.p_brand <> '' AND q.p_size <= i.p_size AND q.p_retailprice < i.p_retailprice AND q.p_type <> i.p_type")
def predicate_columns(spark, d):
    """Predicates as conditions of a join."""
    p = read(spark, d, "part")
    sides = {v: p.select(*[F.col(c).alias(c) for c in p.columns]).alias(f"t{v}") for v in (0, 1)}
    held = [parse_predicate(s, "part").condition() for s in ("t0.p_brand == t1.p_brand", "t0.p_size <= t1.p_size", "t0.p_retailprice < t1.p_retailprice", "t0.p_type <> t1.p_type")]
    return sides[0].join(sides[1], F.expr(" and ".join(held))).selectExpr("t0.p_partkey as l", "t1.p_partkey as r")
