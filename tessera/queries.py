"""Registered queries of the relational engine, each with SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.statistics import Statistics
from tessera.operators import relational as ops
from tessera.session import Engine
from tessera.sources.catalog import PSV, tables
from tessera.sources.store import Store
from tessera.sources.text import read_tbl, write_tbl

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE_SQL: dict[str, str] = {}
WITH_PSV = f"WITH partsupp AS ({PSV}) "


def add(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def keep(f: Builder) -> Builder:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = WITH_PSV + sql if "partsupp" in sql else sql
        return f

    return keep


#: Predicates of the published cases where our tables have the columns and values, else with values of ours.
#: name: (table, predicate in the language of the engine, the same in SQL)
FILTERS = {
    "scan_region": ("region", None, "TRUE"),
    "scan_nation": ("nation", None, "TRUE"),
    "filter_eq_string": ("region", "(r_name = 'EUROPE')", None),
    "filter_string_range": ("region", "(r_name < 'middle east') AND (r_regionkey > 1)", None),
    "filter_three_way": ("nation", "(n_regionkey = 3) AND (n_nationkey > 10) AND (n_name > 'NATION_1')", None),
    "filter_int_lt": ("supplier", "(s_suppkey < 10)", None),
    "filter_mixed_types": ("supplier", "(s_nationkey = 18) AND (s_acctbal > 1000) AND (s_suppkey < 400)", None),
    "filter_double_band": ("customer", "(c_nationkey = 23) AND (c_mktsegment = 'FURNITURE') AND (c_acctbal > 0.0) AND (c_acctbal < 9000.83)", None),
    "filter_part": ("part", "(p_retailprice > 931.01) AND (p_retailprice < 931.3) AND (p_size > 2) AND (p_size < 1000000)", None),
    "filter_ps_cost": ("partsupp", "(ps_supplycost > 2000.0)", None),
    "filter_ps_qty": ("partsupp", "(ps_availqty < 10) AND (ps_supplycost > 100) AND (ps_suppkey < 30)", None),
    "filter_orders": ("orders", "(o_orderpriority = '1-URGENT') AND (o_orderstatus = 'O') AND (o_totalprice > 1015.68) AND (o_totalprice < 20000.0)", None),
    "filter_lineitem_dates": ("lineitem", "(l_shipdate > '1996-01-01') AND (l_shipdate < '1996-02-01') AND (l_discount > 0.04) AND (l_discount < 0.07) AND (l_quantity = 4)", None),
    "filter_lineitem_wide": ("lineitem", "(l_orderkey > 100) AND (l_orderkey < 1000) AND (l_partkey > 100) AND (l_partkey < 500) AND (l_linestatus = 'F') AND (l_tax < 0.07)", None),
    "filter_or": ("part", "(p_size = 3 OR p_size = 6 OR p_size = 19) AND (p_retailprice > 950.0)", None),
    "filter_col_col": ("customer", "(c_custkey = c_nationkey)", None),
    "filter_true": ("supplier", "(s_suppkey = s_suppkey)", None),
    "filter_literal_first": ("orders", "(30000.0 > o_totalprice)", None),
}


def _filter(name: str, table: str, predicate: str | None, where: str | None) -> None:
    @add(name, f"SELECT * FROM {table} WHERE {where or predicate}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = tables(spark, sf_dir)[table]
        return df if predicate is None else ops.select(df, predicate)


for _name, (_table, _predicate, _where) in FILTERS.items():
    _filter(_name, _table, _predicate, _where)


@add("project_part", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice > 931.01 AND p_retailprice < 931.3")
def project_part(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ops.project(ops.select(t["part"], "(p_retailprice > 931.01) AND (p_retailprice < 931.3)"), ["p_partkey", "p_name", "p_retailprice"])


@add("filter_or_lineitem", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND (l_discount < 0.04 OR l_linestatus = 'F')")
def filter_or_lineitem(spark, sf_dir):
    found = ops.select(tables(spark, sf_dir)["lineitem"], "(l_returnflag = 'R') AND (l_discount < 0.04 OR l_linestatus = 'F')")
    return ops.project(found, ["l_orderkey", "l_partkey", "l_suppkey"])


@add("project_reorder", "SELECT n_regionkey, n_name, n_nationkey, n_name AS n_name_2 FROM nation")
def project_reorder(spark, sf_dir):
    return ops.project(tables(spark, sf_dir)["nation"], [2, 1, 0, 1])


@add("sum_scalar", 'SELECT ROUND(SUM(s_acctbal + (s_acctbal * 1.05)), 2) AS "SUM" FROM supplier')
def sum_scalar(spark, sf_dir):
    return ops.sum_(tables(spark, sf_dir)["supplier"], "(s_acctbal + (s_acctbal * 1.05))").select(F.round("SUM", 2).alias("SUM"))


@add("sum_int", 'SELECT CAST(SUM(n_nationkey) AS BIGINT) AS "SUM" FROM nation, region WHERE n_regionkey = r_regionkey AND n_name > \'NATION_1\'')
def sum_int(spark, sf_dir):
    return Engine.over(spark, sf_dir).sql("SELECT SUM (n.n_nationkey) FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_name > 'NATION_1')")


@add("sum_int_div", 'SELECT CAST(SUM(o_orderkey // (o_custkey + 1)) AS BIGINT) AS "SUM" FROM orders')
def sum_int_div(spark, sf_dir):
    return ops.sum_(tables(spark, sf_dir)["orders"], "o_orderkey / (o_custkey + 1)")


@add("sum_unary_minus", 'SELECT CAST(SUM(-p_size + 3) AS BIGINT) AS "SUM" FROM part')
def sum_unary_minus(spark, sf_dir):
    return ops.sum_(tables(spark, sf_dir)["part"], "-p_size + 3")


@add("sum_right_assoc_compat", 'SELECT CAST(SUM(p_size - (p_partkey - 1)) AS BIGINT) AS "SUM" FROM part')
def sum_right_assoc_compat(spark, sf_dir):
    return ops.sum_(tables(spark, sf_dir)["part"], "p_size - p_partkey - 1", "compat")


@add("sum_empty", 'SELECT SUM(s_acctbal) AS "SUM" FROM supplier WHERE s_suppkey < 0')
def sum_empty(spark, sf_dir):
    return ops.sum_(ops.select(tables(spark, sf_dir)["supplier"], "(s_suppkey < 0)"), "s_acctbal")


@add("sum_one", 'SELECT COUNT(*) AS "SUM" FROM lineitem')
def sum_one(spark, sf_dir):
    return ops.sum_(tables(spark, sf_dir)["lineitem"], "1")


@add("join_sum", 'SELECT ROUND(SUM(ps_supplycost), 2) AS "SUM" FROM supplier, partsupp WHERE s_suppkey = ps_suppkey')
def join_sum(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ops.sum_(ops.join(t["supplier"], t["partsupp"], "(s_suppkey = ps_suppkey)"), "ps_supplycost").select(F.round("SUM", 2).alias("SUM"))


@add("join_group_sum", 'SELECT s_nationkey, ROUND(SUM(ps_supplycost), 2) AS "SUM" FROM supplier, partsupp WHERE s_suppkey = ps_suppkey GROUP BY s_nationkey')
def join_group_sum(spark, sf_dir):
    t = tables(spark, sf_dir)
    out = ops.group_sum(ops.join(t["supplier"], t["partsupp"], "(s_suppkey = ps_suppkey)"), ["s_nationkey"], "ps_supplycost")
    return out.withColumn("SUM", F.round("SUM", 2))


@add("join3_sum", 'SELECT ROUND(SUM(ps_supplycost), 2) AS "SUM" FROM part, partsupp, supplier WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_acctbal > 2500.0')
def join3_sum(spark, sf_dir):
    t = tables(spark, sf_dir)
    first = ops.join(t["part"], t["partsupp"], "(p_partkey = ps_partkey)")
    both = ops.join(first, ops.select(t["supplier"], "(s_acctbal > 2500.0)"), "(ps_suppkey = s_suppkey)")
    return ops.sum_(both, "ps_supplycost").select(F.round("SUM", 2).alias("SUM"))


@add("join_project", "SELECT n_name FROM nation, region WHERE n_regionkey = r_regionkey AND n_nationkey > 5")
def join_project(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ops.project(ops.join(ops.select(t["nation"], "(n_nationkey > 5)"), t["region"], "(n_regionkey = r_regionkey)"), ["n_name"])


@add("join_multi_key", 'SELECT CAST(SUM(1) AS BIGINT) AS "SUM" FROM lineitem, partsupp WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey')
def join_multi_key(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ops.sum_(ops.join(t["lineitem"], t["partsupp"], "(l_partkey = ps_partkey) AND (l_suppkey = ps_suppkey)"), "1")


@add("join_merge_hint", "SELECT * FROM nation, region WHERE n_regionkey = r_regionkey")
def join_merge_hint(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ops.join(t["nation"], t["region"], "(n_regionkey = r_regionkey)", hint="merge")


@add("join_theta", "SELECT * FROM nation, region WHERE n_regionkey < r_regionkey")
def join_theta(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ops.join(t["nation"], t["region"], "(n_regionkey < r_regionkey)")


@add("join_cross", 'SELECT a.r_regionkey AS "a.r_regionkey", a.r_name AS "a.r_name", b.r_regionkey AS "b.r_regionkey", b.r_name AS "b.r_name" FROM region a, region b')
def join_cross(spark, sf_dir):
    r = tables(spark, sf_dir)["region"].select("r_regionkey", "r_name")
    return ops.join(ops.qualify(r, "a"), ops.qualify(r, "b"), None)


@add("join_self", 'SELECT CAST(SUM(1) AS BIGINT) AS "SUM" FROM supplier s, customer c, nation n1, nation n2 WHERE s.s_nationkey = n1.n_nationkey AND c.c_nationkey = n2.n_nationkey AND n1.n_nationkey = n2.n_nationkey')
def join_self(spark, sf_dir):
    return Engine.over(spark, sf_dir).sql("SELECT SUM (1) FROM supplier AS s, customer AS c, nation AS n1, nation AS n2 WHERE (s.s_nationkey = n1.n_nationkey) AND (c.c_nationkey = n2.n_nationkey) AND (n1.n_nationkey = n2.n_nationkey)")


@add("join_residual", 'SELECT CAST(SUM(1) AS BIGINT) AS "SUM" FROM orders, customer WHERE o_custkey = c_custkey AND o_totalprice < c_acctbal')
def join_residual(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ops.sum_(ops.join(t["orders"], t["customer"], "(o_custkey = c_custkey) AND (o_totalprice < c_acctbal)"), "1")


@add("join_post_filter_or", "SELECT n_nationkey, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND (n_nationkey > 20 OR r_name = 'ASIA')")
def join_post_filter_or(spark, sf_dir):
    return Engine.over(spark, sf_dir).sql("SELECT n.n_nationkey, r.r_name FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_nationkey > 20 OR r.r_name = 'ASIA')")


@add("distinct_project", "SELECT DISTINCT ps_suppkey FROM partsupp WHERE ps_supplycost < 100.11")
def distinct_project(spark, sf_dir):
    return ops.distinct(ops.project(ops.select(tables(spark, sf_dir)["partsupp"], "(ps_supplycost < 100.11)"), ["ps_suppkey"]))


@add("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark, sf_dir):
    return ops.distinct(ops.project(tables(spark, sf_dir)["lineitem"], ["l_returnflag", "l_linestatus", "l_linenumber"]))


TC5 = "SELECT SUM DISTINCT (n.n_nationkey + r.r_regionkey) FROM nation AS n, region AS r, customer AS c WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_nationkey = c.c_nationkey) AND (n.n_nationkey > 10) GROUP BY r.r_regionkey"
TC5_FROM = "FROM nation n, region r, customer c WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey = c.c_nationkey AND n.n_nationkey > 10"


@add("sum_distinct_ansi", f'SELECT r_regionkey, CAST(SUM(DISTINCT n_nationkey + r_regionkey) AS BIGINT) AS "SUM" {TC5_FROM} GROUP BY r_regionkey')
def sum_distinct_ansi(spark, sf_dir):
    return Engine.over(spark, sf_dir).sql(TC5)


@add("sum_distinct_compat", f'SELECT CAST(SUM(n_nationkey + r_regionkey) AS BIGINT) AS "SUM" FROM (SELECT DISTINCT * {TC5_FROM}) GROUP BY r_regionkey')
def sum_distinct_compat(spark, sf_dir):
    return Engine.over(spark, sf_dir).sql(TC5, "compat")


@add("group_sum", 'SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS "SUM" FROM lineitem GROUP BY l_returnflag')
def group_sum(spark, sf_dir):
    return ops.group_sum(tables(spark, sf_dir)["lineitem"], ["l_returnflag"], "l_linenumber")


@add("group_sum_multi", 'SELECT l_returnflag, l_linestatus, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS "SUM" FROM lineitem GROUP BY 1, 2')
def group_sum_multi(spark, sf_dir):
    out = ops.group_sum(tables(spark, sf_dir)["lineitem"], ["l_returnflag", "l_linestatus"], "l_extendedprice * (1 - l_discount)")
    return out.withColumn("SUM", F.round("SUM", 2))


@add("group_sum_compat", 'SELECT CAST(SUM(n_nationkey) AS BIGINT) AS "SUM" FROM nation GROUP BY n_regionkey')
def group_sum_compat(spark, sf_dir):
    return ops.group_sum(tables(spark, sf_dir)["nation"], ["n_regionkey"], "n_nationkey", "compat")


#: name: (statement, the same in SQL)
STATEMENTS = {
    "sql_tc1": ("SELECT n.n_nationkey FROM nation AS n WHERE (n.n_name = 'NATION_7')", "SELECT n_nationkey FROM nation WHERE n_name = 'NATION_7'"),
    "sql_tc2": ("SELECT n.n_name FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_nationkey > 5)", "SELECT n_name FROM nation, region WHERE n_regionkey = r_regionkey AND n_nationkey > 5"),
    "sql_tc3": ("SELECT SUM (n.n_nationkey) FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_name = 'NATION_7')", "SELECT CAST(SUM(n_nationkey) AS BIGINT) AS \"SUM\" FROM nation, region WHERE n_regionkey = r_regionkey AND n_name = 'NATION_7'"),
    "sql_tc4": ("SELECT SUM (n.n_regionkey) FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_name > 'NATION_2') GROUP BY n.n_regionkey", "SELECT n_regionkey, CAST(SUM(n_regionkey) AS BIGINT) AS \"SUM\" FROM nation, region WHERE n_regionkey = r_regionkey AND n_name > 'NATION_2' GROUP BY n_regionkey"),
    "sql_tc5": (TC5, f'SELECT r_regionkey, CAST(SUM(DISTINCT n_nationkey + r_regionkey) AS BIGINT) AS "SUM" {TC5_FROM} GROUP BY r_regionkey'),
    "sql_distinct": ("SELECT DISTINCT c.c_mktsegment FROM customer AS c WHERE (c.c_acctbal > 100.0)", "SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 100.0"),
    "sql_cycle": ("SELECT n.n_nationkey, s.s_suppkey FROM nation AS n, supplier AS s, customer AS c WHERE (n.n_nationkey = s.s_nationkey) AND (s.s_nationkey = c.c_nationkey) AND (c.c_nationkey = n.n_nationkey) AND (c.c_custkey < 40)", "SELECT n_nationkey, s_suppkey FROM nation, supplier, customer WHERE n_nationkey = s_nationkey AND s_nationkey = c_nationkey AND c_nationkey = n_nationkey AND c_custkey < 40"),
}


def _statement(name: str, text: str, sql: str) -> None:
    @add(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine.over(spark, sf_dir).sql(text)


for _name, (_text, _sql) in STATEMENTS.items():
    _statement(_name, _text, _sql)

TC6 = "SELECT SUM (ps.ps_supplycost), s.s_suppkey FROM part AS p, supplier AS s, partsupp AS ps WHERE (p.p_partkey = ps.ps_partkey) AND (s.s_suppkey = ps.ps_suppkey) AND (s.s_acctbal > 2500.0) GROUP BY s.s_suppkey"
FLAGSHIP = "SELECT SUM (l.l_extendedprice * (1 - l.l_discount)), s.s_suppkey FROM supplier AS s, lineitem AS l WHERE (s.s_suppkey = l.l_suppkey) AND (s.s_acctbal > 2500.0) GROUP BY s.s_suppkey"


@add("sql_tc6", 'SELECT s_suppkey, ROUND(SUM(ps_supplycost), 2) AS "SUM" FROM part, supplier, partsupp WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_acctbal > 2500.0 GROUP BY s_suppkey')
def sql_tc6(spark, sf_dir):
    return Engine.over(spark, sf_dir).sql(TC6).withColumn("SUM", F.round("SUM", 2))


@add("flagship", 'SELECT s_suppkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS "SUM" FROM supplier, lineitem WHERE s_suppkey = l_suppkey AND s_acctbal > 2500.0 GROUP BY s_suppkey')
def flagship(spark, sf_dir):
    return Engine.over(spark, sf_dir).sql(FLAGSHIP).withColumn("SUM", F.round("SUM", 2))


@add("join_order_greedy", 'SELECT CAST(SUM(1) AS BIGINT) AS "SUM" FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_mktsegment = \'BUILDING\'')
def join_order_greedy(spark, sf_dir):
    t = tables(spark, sf_dir)
    known = Statistics()
    for name in ("lineitem", "orders", "customer"):
        known.measure(name, t[name])
    return Engine(spark, t, known).sql("SELECT SUM (1) FROM lineitem AS l, orders AS o, customer AS c WHERE (l.l_orderkey = o.o_orderkey) AND (o.o_custkey = c.c_custkey) AND (c.c_mktsegment = 'BUILDING')")


def _sorted(name: str, table: str, keys: str, columns: list[str]) -> None:
    @add(name, f"SELECT count(*) AS \"count\", CAST(0 AS BIGINT) AS violations FROM {table}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ops.out_of_order(ops.sort(tables(spark, sf_dir)[table], keys), columns)


_sorted("sort_one", "nation", "(n_regionkey)", ["n_regionkey"])
_sorted("sort_two", "orders", "(o_totalprice) AND (o_custkey)", ["o_totalprice", "o_custkey"])
_sorted("sort_check", "lineitem", "(l_shipdate) AND (l_extendedprice) AND (l_quantity)", ["l_shipdate", "l_extendedprice", "l_quantity"])


@add("sort_rows", "SELECT *, row_number() OVER (ORDER BY c_custkey, c_nationkey, c_acctbal, c_name, c_mktsegment) AS position FROM customer")
def sort_rows(spark, sf_dir):
    df = tables(spark, sf_dir)["customer"]
    return ops.numbered(df, ops.row_order(df))


@add("sort_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_custkey, o_orderkey) AS position FROM orders")
def sort_positions(spark, sf_dir):
    return ops.numbered(tables(spark, sf_dir)["orders"], ["o_totalprice", "o_custkey", "o_orderkey"]).select("o_orderkey", "position")


def scratch(spark: SparkSession) -> str:
    """A fresh folder: in the shared one of the cluster, else local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/tessera-{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="tessera-")


@add("sorted_table_query", "SELECT * FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND c_acctbal > 9500.0")
def sorted_table_query(spark, sf_dir):
    store = Store(spark, scratch(spark)).create("sorted", ["c_acctbal"]).load(tables(spark, sf_dir)["customer"])
    return store.scan("(c_mktsegment = 'AUTOMOBILE') AND (c_acctbal > 9500.0)")


@add("sorted_append", "SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000.0")
def sorted_append(spark, sf_dir):
    t = tables(spark, sf_dir)
    store = Store(spark, scratch(spark)).create("sorted", ["s_acctbal", "s_suppkey"]).load(t["supplier"].select("s_suppkey", "s_acctbal"))
    more = t["customer"].where("c_acctbal > 9000.0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("s_acctbal"))
    return store.append(more).scan()


@add("heap_append", "SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_nationkey < 5")
def heap_append(spark, sf_dir):
    n = tables(spark, sf_dir)["nation"]
    return Store(spark, scratch(spark)).create().load(n).append(ops.select(n, "(n_nationkey < 5)")).scan()


@add("tbl_roundtrip", "SELECT * FROM customer")
def tbl_roundtrip(spark, sf_dir):
    df, path = tables(spark, sf_dir)["customer"], scratch(spark) + "/customer.tbl"
    write_tbl(df, path)
    return read_tbl(spark, path, df.schema)


@add("write_out", "SELECT 's_suppkey:[' || s_suppkey || '], s_acctbal:[' || printf('%.6f', s_acctbal) || ']' AS text FROM supplier")
def write_out_(spark, sf_dir):
    path = scratch(spark) + "/out"
    Engine.over(spark, sf_dir).write("SELECT s.s_suppkey, s.s_acctbal FROM supplier AS s WHERE (s.s_suppkey = s.s_suppkey)", path)
    return spark.read.text(path).withColumnRenamed("value", "text")


CATALOG = """BEGIN
nation
nation.tbl
n_nationkey Int
n_name String
n_regionkey Int
END

BEGIN
customer
customer.tbl
c_custkey Int
c_name String
c_nationkey Int
c_acctbal Double
c_mktsegment String
END
"""


@add("catalog_statement", 'SELECT n_name, ROUND(SUM(c_acctbal), 2) AS "SUM" FROM nation, customer WHERE n_nationkey = c_nationkey AND c_mktsegment = \'MACHINERY\' GROUP BY n_name')
def catalog_statement(spark, sf_dir):
    t, folder = tables(spark, sf_dir), scratch(spark)
    for name in ("nation", "customer"):
        write_tbl(t[name], f"{folder}/{name}.tbl")
    engine = Engine.from_catalog(spark, CATALOG, folder)
    out = engine.sql("SELECT SUM (c.c_acctbal), n.n_name FROM nation AS n, customer AS c WHERE (n.n_nationkey = c.c_nationkey) AND (c.c_mktsegment = 'MACHINERY') GROUP BY n.n_name")
    return out.withColumn("SUM", F.round("SUM", 2))


STATS = {"region": "r_regionkey", "nation": "n_regionkey", "supplier": "s_nationkey", "customer": "c_mktsegment", "part": "p_size", "orders": "o_orderpriority", "lineitem": "l_returnflag"}


@add("stats_tables", " UNION ALL ".join(f"SELECT '{t}' AS relation, count(*) AS n_rows, '{c}' AS attribute, count(DISTINCT {c}) AS n_values FROM {t}" for t, c in STATS.items()))
def stats_tables(spark, sf_dir):
    t, known, rows = tables(spark, sf_dir), Statistics(), []
    for name, att in STATS.items():
        known.measure(name, t[name].select(att), exact=True)
        r = known.get(name)
        rows.append((name, int(r.rows), att, int(r.values[att])))
    return spark.createDataFrame(rows, "relation string, n_rows long, attribute string, n_values long")


#: The published cases of the estimator.
#: name: ({relation: (rows, {attribute: values})}, aliases, steps of (predicate, relations), SQL of the last estimate)
ESTIMATES = {
    "estimate_q0": ({"supplier": (10000, {"s_suppkey": 10000}), "partsupp_": (800000, {"ps_suppkey": 10000})}, {}, [("(s_suppkey = ps_suppkey)", ["supplier", "partsupp_"])], "10000.0 * 800000 / 10000"),
    "estimate_q1": ({"lineitem": (6001215, {"l_returnflag": 3, "l_discount": 11, "l_shipmode": 7})}, {}, [("(l_returnflag = 'R') AND (l_discount < 0.04 OR l_shipmode = 'MAIL')", ["lineitem"])], "6001215 * (1.0 / 3) * (1 - (1 - 1.0 / 3) * (1 - 1.0 / 7))"),
    "estimate_q2": ({"orders": (1500000, {"o_custkey": 150000}), "customer": (150000, {"c_custkey": 150000, "c_nationkey": 25}), "nation": (25, {"n_nationkey": 25})}, {}, [("(c_custkey = o_custkey)", ["orders", "customer"]), ("(c_nationkey = n_nationkey)", ["orders", "customer", "nation"])], "1500000.0"),
    "estimate_q3": ({"supplier": (10000, {"s_nationkey": 25}), "customer": (150000, {"c_custkey": 150000, "c_nationkey": 25}), "nation": (25, {"n_nationkey": 25})}, {"n1": "nation", "n2": "nation", "s": "supplier", "c": "customer"}, [("(s.s_nationkey = n1.n_nationkey)", ["s", "n1"]), ("(c.c_nationkey = n2.n_nationkey)", ["c", "n2"]), ("(n1.n_nationkey = n2.n_nationkey)", ["c", "s", "n1", "n2"])], "60000000.0"),
    "estimate_q4": ({"part": (200000, {"p_partkey": 200000, "p_size": 50}), "partsupp_": (800000, {"ps_suppkey": 10000, "ps_partkey": 200000}), "supplier": (10000, {"s_suppkey": 10000, "s_nationkey": 25}), "nation": (25, {"n_nationkey": 25, "n_regionkey": 5}), "region": (5, {"r_regionkey": 5, "r_name": 5})}, {"p": "part", "ps": "partsupp_", "s": "supplier", "n": "nation", "r": "region"}, [("(p.p_partkey = ps.ps_partkey) AND (p.p_size = 2)", ["part", "partsupp_"]), ("(s.s_suppkey = ps.ps_suppkey)", ["part", "partsupp_", "supplier"]), ("(s.s_nationkey = n.n_nationkey)", ["part", "partsupp_", "supplier", "nation"]), ("(n.n_regionkey = r.r_regionkey) AND (r.r_name = 'AMERICA')", ["part", "partsupp_", "supplier", "nation", "region"])], "800000.0 / 50 / 5"),
    "estimate_q5": ({"customer": (150000, {"c_custkey": 150000, "c_mktsegment": 5}), "orders": (1500000, {"o_orderkey": 1500000, "o_custkey": 150000}), "lineitem": (6001215, {"l_orderkey": 1500000})}, {}, [("(c_mktsegment = 'BUILDING') AND (c_custkey = o_custkey) AND (o_orderdate < '1995-03-1')", ["customer", "orders"]), ("(l_orderkey = o_orderkey)", ["customer", "orders", "lineitem"])], "6001215 / 5.0 / 3.0"),
    "estimate_q6": ({"partsupp_": (800000, {"ps_suppkey": 10000}), "supplier": (10000, {"s_suppkey": 10000, "s_nationkey": 25}), "nation": (25, {"n_nationkey": 25, "n_name": 25})}, {}, [("(s_suppkey = ps_suppkey)", ["partsupp_", "supplier"]), ("(s_nationkey = n_nationkey) AND (n_name = 'AMERICA')", ["partsupp_", "supplier", "nation"])], "800000 / 25.0"),
    "estimate_q9": ({"part": (200000, {"p_partkey": 200000, "p_name": 199996}), "partsupp_": (800000, {"ps_partkey": 200000, "ps_suppkey": 10000}), "supplier": (10000, {"s_suppkey": 10000})}, {}, [("(p_partkey = ps_partkey) AND (p_name = 'dark green antique puff wheat')", ["part", "partsupp_"]), ("(s_suppkey = ps_suppkey)", ["part", "partsupp_", "supplier"])], "800000 / 199996.0"),
    "estimate_q10": ({"customer": (150000, {"c_custkey": 150000, "c_nationkey": 25}), "orders": (1500000, {"o_orderkey": 1500000, "o_custkey": 150000}), "lineitem": (6001215, {"l_orderkey": 1500000}), "nation": (25, {"n_nationkey": 25})}, {}, [("(c_custkey = o_custkey) AND (o_orderdate > '1994-01-23')", ["customer", "orders"]), ("(l_orderkey = o_orderkey)", ["customer", "orders", "lineitem"]), ("(c_nationkey = n_nationkey)", ["customer", "orders", "lineitem", "nation"])], "6001215 / 3.0"),
    "estimate_q11": ({"part": (200000, {"p_partkey": 200000, "p_container": 40}), "lineitem": (6001215, {"l_partkey": 200000, "l_shipinstruct": 4, "l_shipmode": 7})}, {}, [("(l_partkey = p_partkey) AND (l_shipmode = 'AIR' OR l_shipmode = 'AIR REG') AND (p_container = 'SM BOX' OR p_container = 'SM PACK') AND (l_shipinstruct = 'DELIVER IN PERSON')", ["part", "lineitem"])], "6001215 * (2 / 7.0) * (2 / 40.0) / 4"),
    "estimate_q7": ({"orders": (1500000, {"o_orderkey": 1500000}), "lineitem": (6001215, {"l_orderkey": 1500000})}, {}, [("(l_receiptdate > '1995-02-01') AND (l_orderkey = o_orderkey)", ["orders", "lineitem"])], "6001215 / 3.0"),
    "estimate_q8": ({"part": (200000, {"p_partkey": 200000, "p_size": 50}), "partsupp_": (800000, {"ps_partkey": 200000})}, {}, [("(p_partkey = ps_partkey) AND (p_size = 3 OR p_size = 6 OR p_size = 19)", ["part", "partsupp_"])], "800000 * 3 / 50.0"),
}


def estimate(relations: dict, aliases: dict, steps: list) -> float:
    s = Statistics()
    for name, (rows, values) in relations.items():
        s.add_relation(name, rows)
        for a, v in values.items():
            s.add_attribute(name, a, v)
    for alias, name in aliases.items():
        s.copy_relation(name, alias)
    out = 0.0
    for predicate, names in steps:
        out = s.apply(predicate, names)
    return out


def _estimate(name: str, relations: dict, aliases: dict, steps: list, sql: str) -> None:
    @add(name, f"SELECT ROUND(CAST({sql} AS DOUBLE), 3) AS estimate")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(round(estimate(relations, aliases, steps), 3),)], "estimate double")


for _name, _args in ESTIMATES.items():
    _estimate(_name, *_args)


@add("explain_tc6")
def explain_tc6(spark, sf_dir):
    lines = Engine.over(spark, sf_dir).explain_tree(TC6).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line long, text string")
