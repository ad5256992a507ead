"""Queries that write files in the formats of rules, keys, matches, evidence and models, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import evidence, sampling
from .plans import discovery
from .plans.config import Config
from .registry import query, read, tables
from .sources import readers, writers
from .staging import shared_dir

_KEYED = ["p_brand", "p_size", "p_type"]
_PARTS = [("p_brand",), ("p_size",), ("p_type",), ("p_brand", "p_size"), ("p_brand", "p_type"), ("p_size", "p_type")]


def _counts_sql(lhs: tuple[str, ...], y: str) -> str:
    by = ", ".join(lhs)
    text = " ^ ".join(f"part.t0.{c} == part.t1.{c}" for c in lhs) + f" -> part.t0.{y} == part.t1.{y}"
    known = " AND ".join(f"{c} IS NOT NULL AND CAST({c} AS VARCHAR) <> ''" for c in lhs)
    return f"""SELECT '{','.join(lhs)}' AS lhs, '{y}' AS y, '{text}' AS rule, CAST(sum(n * n) AS BIGINT) AS lhs_support, CAST(sum(nn) AS BIGINT) AS supp
FROM (SELECT {by}, sum(n) AS n, sum(n * n) AS nn FROM (SELECT {by}, {y} AS y_, count(*) AS n FROM part WHERE {known} GROUP BY ALL) GROUP BY {by}) WHERE n > 1"""


_MINED = f"""WITH c AS ({" UNION ALL ".join(_counts_sql(x, y) for x in _PARTS for y in _KEYED if y not in x)}),
k AS (SELECT *, supp / lhs_support AS conf, CASE WHEN supp < floor(1e-4 * (SELECT count(*) * count(*) FROM part)) THEN 'invalid' WHEN supp / lhs_support >= 0.05 THEN 'valid' ELSE 'intermediate' END AS class FROM c),
m AS (SELECT rule, lhs_support, supp, conf FROM k WHERE class = 'valid' AND NOT EXISTS (SELECT 1 FROM k s WHERE s.y = k.y AND s.lhs <> k.lhs AND list_has_all(string_split(k.lhs, ','), string_split(s.lhs, ',')) AND s.class <> 'intermediate'))"""


def _mined(spark, d):
    """Every minimal valid rule among three columns of ``part``, without constants."""
    t = tables(spark, d, "part", skip={"part": {"p_name", "p_retailprice"}})
    found, pairs = discovery.mine(t, Config(support=1e-4, confidence=0.05, max_x=2, constants=False))
    rows = [(str(f.rule), f.lhs_support, f.support, f.confidence) for f in found]
    return spark.createDataFrame(rows, "rule string, lhs_support long, supp long, conf double")


@query(f"{_MINED} SELECT * FROM m")
def minimal_rules(spark, d):
    return _mined(spark, d)


@query(f"{_MINED} SELECT split_part(rule, ' -> ', 1) AS lhs, split_part(rule, ' -> ', 2) AS rhs, supp, conf FROM m")
def result_file(spark, d):
    """Rules as result lines, read again as rows."""
    path = f"{shared_dir(spark)}/result"
    writers.write_rules(_mined(spark, d).selectExpr("rule", "supp", "conf", "conf as rel", "0.0D as div", "conf as score"), path)
    return readers.read_rule_table(spark, path).select(F.array_join("lhs", " ^ ").alias("lhs"), "rhs", "supp", "conf")


@query(f"{_MINED} SELECT rule FROM m")
def rule_list_file(spark, d):
    """Rules alone, parsed again and written out in their text form."""
    path = f"{shared_dir(spark)}/list"
    writers.write_rule_list(_mined(spark, d), path)
    return spark.createDataFrame([(str(r),) for r, _ in readers.read_rules(spark, path)], "rule string")


@query("SELECT * FROM (VALUES ('part', 'p_partkey', 'double'), ('part', 'p_name', 'string'), ('part', 'p_brand', 'string'), ('part', 'p_type', 'string'), ('part', 'p_size', 'double'), ('part', 'p_retailprice', 'double')) t(relation, attribute, type)")
def type_file(spark, d):
    t, path = tables(spark, d, "part"), f"{shared_dir(spark)}/types"
    writers.write_lines(spark, [f"part;{c};{t.kind('part', c)}" for c in t.columns("part")], path)
    return spark.createDataFrame([(r, f.name, f.dataType.simpleString()) for r, s in readers.read_types(spark, path).items() for f in s], "relation string, attribute string, type string")


@query("SELECT * FROM (VALUES ('supplier', 's_nationkey', 'nation', 'n_nationkey'), ('nation', 'n_regionkey', 'region', 'r_regionkey')) t(left_table, left_column, right_table, right_column)")
def foreign_key_file(spark, d):
    path = f"{shared_dir(spark)}/keys"
    writers.write_lines(spark, ["supplier.s_nationkey->nation.n_nationkey", "", "nation.n_regionkey", "region.r_regionkey"], path)
    return spark.createDataFrame([(k.table, k.column, k.to_table, k.to_column) for k in readers.read_foreign_keys(spark, path)], "left_table string, left_column string, right_table string, right_column string")


@query("SELECT doc_id AS left_id, doc_id + 1 AS right_id, toxic AS label FROM labels")
def label_file(spark, d):
    path = f"{shared_dir(spark)}/labels"
    writers.write_csv(read(spark, d, "labels").selectExpr("doc_id as left_id", "doc_id + 1 as right_id", "toxic as label"), path)
    return readers.read_labels(spark, path)


@query("SELECT 'near' AS model, 'part' AS left_table, 'p_name' AS left_column, 'part' AS right_table, 'p_type' AS right_column, p_partkey AS l, p_partkey + p_size - 25 AS r FROM part WHERE p_size > 25")
def match_file(spark, d):
    """A pair a part; those that aren't in ascending order are passed over in reading."""
    path = f"{shared_dir(spark)}/matches"
    writers.write_matches(read(spark, d, "part").selectExpr("p_partkey as l", "p_partkey + p_size - 25 as r"), path, "near", ("part", "p_name"), ("part", "p_type"))
    return readers.read_matches(spark, path)


@query("SELECT concat_ws(',', CASE WHEN l_discount > 0.05 THEN 'discount' END, CASE WHEN l_quantity > 25 THEN 'many' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END) AS predicates, count(*) AS count FROM lineitem GROUP BY 1")
def evidence_file(spark, d):
    path = f"{shared_dir(spark)}/evidence"
    writers.write_evidence(evidence.evidence(read(spark, d, "lineitem"), {"discount": F.col("l_discount") > 0.05, "many": F.col("l_quantity") > 25, "returned": F.col("l_returnflag") == "R"}), path)
    return readers.read_evidence(spark, path).select(F.array_join("predicates", ",").alias("predicates"), "count")


@query("SELECT 'keys' AS name, CAST(n_nationkey AS DOUBLE) AS a, CAST(n_regionkey AS DOUBLE) AS b FROM nation UNION ALL SELECT 'scale', 0.5, -1e-3")
def model_file(spark, d):
    """Named matrices of a model: the keys of the nations stand for weights."""
    path = f"{shared_dir(spark)}/model"
    keys = [(r[0], r[1]) for r in read(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()]  # the nations of the world
    writers.write_model(spark, {"keys": keys, "scale": [[0.5, -1e-3]]}, path)
    return spark.createDataFrame([(name, *map(float, row)) for name, m in readers.read_relevance_model(spark, path).items() for row in m], "name string, a double, b double")


@query("SELECT * FROM (VALUES ('PAD', 0), ('part.t0.p_brand == part.t1.p_brand', 1), ('part.t0.p_type == PROMO', 2)) t(predicate, id)")
def predicate_file(spark, d):
    path = f"{shared_dir(spark)}/predicates"
    writers.write_lines(spark, ["PAD", "part.t0.p_brand == part.t1.p_brand", "part.t0.p_type == PROMO"], path)
    return spark.createDataFrame(list(readers.read_predicates(spark, path).items()), "predicate string, id int")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_type FROM part")
def orc_as_csv(spark, d):
    folder = shared_dir(spark)
    read(spark, d, "part").select("p_partkey", "p_name", "p_type").write.orc(f"{folder}/orc")
    return writers.orc_to_csv(spark, f"{folder}/orc", f"{folder}/csv")


@query("SELECT o_orderkey FROM orders")
def split_files(spark, d):
    """Train, valid and test tables together hold every order once."""
    path = f"{shared_dir(spark)}/parts"
    writers.write_parts(sampling.split(read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]), path)
    parts = [readers.read_table(spark, f"{path}/part={p}", fmt="csv", infer=True) for p in ("train", "valid", "test")]
    return parts[0].union(parts[1]).union(parts[2]).selectExpr("cast(o_orderkey as bigint) as o_orderkey")


@query("SELECT * FROM (VALUES ('p_brand', 'p_type'), ('p_type', 'p_brand;p_size')) t(name, others)")
def correlation_index_file(spark, d):
    path = f"{shared_dir(spark)}/index"
    writers.write_index(spark, {"p_brand": ["p_type", "p_name"], "p_name": ["p_size"], "p_type": ["p_brand", "p_size"]}, path, without={"p_name"})
    return spark.read.text(path).selectExpr("substring_index(value, ';', 1) as name", "substring(value, instr(value, ';') + 1) as others")


@query(f"{_MINED} SELECT 'avg_conf' AS measure, round(avg(conf), 9) AS value FROM m UNION ALL SELECT 'max_supp', max(supp) FROM m UNION ALL SELECT 'min_supp', min(supp) FROM m")
def report_file(spark, d):
    """The report of an evaluation."""
    path, m = f"{shared_dir(spark)}/report", _mined(spark, d)
    got = m.agg(F.round(F.avg("conf"), 9).alias("avg_conf"), F.max("supp").cast("double").alias("max_supp"), F.min("supp").cast("double").alias("min_supp")).first()
    writers.write_report(spark, got.asDict(), path)
    return spark.read.text(path).selectExpr("substring_index(value, ' : ', 1) as measure", "cast(substring_index(value, ' : ', -1) as double) as value")
