"""The relational operators, each a thin function from DataFrames to a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import UnknownAttribute
from tessera.functions import arith
from tessera.functions.names import kind_of, quoted, resolve
from tessera.functions.predicate import Cnf, bind, parse_cnf, sort_keys

Predicate = Cnf | str


def _cnf(p: Predicate, mode: str) -> Cnf:
    return parse_cnf(p, mode) if isinstance(p, str) else p


def _columns(df: DataFrame, names: Sequence[str]) -> list:
    return [F.col(quoted(resolve(n, df.schema).name)) for n in names]


def select(df: DataFrame, predicate: Predicate, mode: str = "ansi") -> DataFrame:
    """Rows that meet a predicate; over a scan it is pushed into the reader."""
    return df.where(bind(_cnf(predicate, mode), df.schema, mode=mode))


def project(df: DataFrame, keep: Sequence[str | int]) -> DataFrame:
    """Columns by name or position, in the order given; a column may come again under a numbered name."""
    out, seen = [], {}
    for k in keep:
        name = df.columns[k] if isinstance(k, int) else resolve(k, df.schema).name
        seen[name] = seen.get(name, 0) + 1
        out.append(F.col(quoted(name)).alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return df.select(out)


def join(left: DataFrame, right: DataFrame, predicate: Predicate | None, mode: str = "ansi", hint: str | None = None) -> DataFrame:
    """Inner join with all columns of both sides, left first. The whole predicate holds for every row.

    Equalities between the sides become join keys; without one, or without a predicate, Spark compares all
    pairs, as the query then asks for. hint names a join strategy of Spark for the right side; without it Spark
    broadcasts a side only below its size limit. Names that both sides have must be told apart before (see qualify()).
    """
    if both := set(left.columns) & set(right.columns):
        raise UnknownAttribute(f"both sides have {sorted(both)}")
    right = right.hint(hint) if hint else right
    return left.crossJoin(right) if predicate is None else left.join(right, bind(_cnf(predicate, mode), left.schema, right.schema, mode=mode), "inner")


def qualify(df: DataFrame, alias: str) -> DataFrame:
    """All columns renamed to alias.column, as joins of a table with itself need."""
    return df.toDF(*[f"{alias}.{c}" for c in df.columns])


def distinct(df: DataFrame) -> DataFrame:
    """Each different row once."""
    return df.distinct()


def sum_(df: DataFrame, expression: str | arith.Expression, mode: str = "ansi", unique: bool = False, name: str = "SUM") -> DataFrame:
    """One row with the sum of an expression: bigint or double. No rows: null, in compat mode 0.

    unique: in ansi mode sum different values once; in compat mode sum over different rows.
    """
    return _aggregate(df, [], expression, mode, unique, name)


def group_sum(df: DataFrame, keys: Sequence[str], expression: str | arith.Expression, mode: str = "ansi", unique: bool = False, name: str = "SUM") -> DataFrame:
    """A row per group: in ansi mode the keys and the sum, in compat mode the sum alone. No rows: no groups."""
    return _aggregate(df, list(keys), expression, mode, unique, name)


def _aggregate(df: DataFrame, keys: list[str], expression: str | arith.Expression, mode: str, unique: bool, name: str) -> DataFrame:
    e = arith.parse_expression(expression, mode) if isinstance(expression, str) else expression
    if unique and mode == "compat":
        df, unique = df.distinct(), False
    text, kind = arith.compile_(e, df.schema)
    value = F.expr(text)
    total = F.sum_distinct(value) if unique else F.sum(value)
    total = total.cast("bigint" if kind == "int" else "double")
    if mode == "compat":
        total = F.coalesce(total if kind == "int" else F.round(total, 6), F.lit(0).cast("bigint" if kind == "int" else "double"))
    out = df.groupBy(*_columns(df, keys)).agg(total.alias(name))
    return out.select(name) if mode == "compat" and keys else out


def sort(df: DataFrame, keys: Sequence[str] | str, mode: str = "ansi") -> DataFrame:
    """Rows ascending by the keys, names or a sort specification. Ties come in any order."""
    return df.orderBy(*_columns(df, sort_keys(keys, mode) if isinstance(keys, str) else keys))


def row_order(df: DataFrame) -> list[str]:
    """All columns as a sort key: whole numbers, then doubles, then strings, each in their order."""
    rank = {"int": 0, "double": 1, "string": 2}
    return [f.name for f in sorted(df.schema.fields, key=lambda f: rank[kind_of(f.dataType)])]


def numbered(df: DataFrame, keys: Sequence[str], name: str = "position") -> DataFrame:
    """Rows with their place in the order of the keys, from 1; ties come in any order.

    Ranges of keys are counted, and places follow from the counts of earlier ranges: a row per range meets in one task.
    """
    columns = _columns(df, keys)
    ranges = df.repartitionByRange(*columns).withColumn("__range", F.spark_partition_id())
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows")).select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*columns))
    return ranges.withColumn("__inside", inside).join(offsets, "__range").withColumn(name, F.col("__before") + F.col("__inside")).drop("__range", "__inside", "__before")


def out_of_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: count, rows, and violations, how many rows of a sorted frame come before a smaller one.

    Each partition is checked by itself in its order, and then the ends of neighbours; only a row per
    partition meets in one task.
    """
    key = F.struct(*_columns(df, keys))
    rows = df.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), key.alias("k"))
    inner = rows.withColumn("before", F.lag("k").over(Window.partitionBy("p").orderBy("i")))
    parts = inner.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") > F.col("k")).alias("v"), F.min_by("k", "i").alias("first"), F.max_by("k", "i").alias("last"))
    ends = parts.withColumn("before", F.lag("last").over(Window.orderBy("p")))
    return ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.coalesce(F.sum(F.col("v") + F.when(F.col("before") > F.col("first"), 1).otherwise(0)), F.lit(0)).alias("violations"))
