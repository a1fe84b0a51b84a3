"""Catalogs: relations with their attributes, read from text or taken from parquet tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.errors import ParseError, UnknownRelation
from tessera.sources.text import read_tbl

TYPES = {"Int": T.IntegerType(), "Double": T.DoubleType(), "String": T.StringType()}

#: A stand-in for a table of parts and suppliers, from line items.
PSV = """
SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(SUM(l_quantity) AS INT) AS ps_availqty,
       MIN(l_extendedprice / l_quantity) AS ps_supplycost
FROM lineitem GROUP BY l_partkey, l_suppkey
"""
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def parse_catalog(text: str) -> dict[str, tuple[str, T.StructType]]:
    """Relations of a catalog text: BEGIN, name, file, lines of attribute and type, END."""
    out, lines = {}, iter(x.split() for x in text.splitlines() if x.strip())
    for line in lines:
        if line != ["BEGIN"]:
            raise ParseError(f"BEGIN expected, found {' '.join(line)}")
        try:
            (name,), (file,), fields = next(lines), next(lines), []
            while (line := next(lines)) != ["END"]:
                att, kind = line
                if kind not in TYPES:
                    raise ParseError(f"no type {kind}")
                fields.append(T.StructField(att, TYPES[kind]))
        except (StopIteration, ValueError) as e:
            if isinstance(e, ParseError):
                raise
            raise ParseError("the catalog breaks off or has a line of the wrong length") from e
        out[name] = (file, T.StructType(fields))
    return out


def schema_of(text: str, relation: str) -> T.StructType:
    found = parse_catalog(text)
    if relation not in found:
        raise UnknownRelation(relation)
    return found[relation][1]


class Tables(Mapping):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self.makers, self.made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __contains__(self, name: object) -> bool:
        return name in self.makers

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The parquet tables of a folder, and partsupp derived from line items."""
    out = Tables({t: lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})
    out.makers["partsupp"] = lambda: spark.sql(PSV.replace("FROM lineitem", "FROM {lineitem}"), lineitem=out["lineitem"])
    return out


def catalog_tables(spark: SparkSession, text: str, folder: str) -> Tables:
    """The text tables of a catalog: each relation's rows are read from folder/<relation>.tbl."""
    return Tables({name: lambda name=name, schema=schema: read_tbl(spark, f"{folder.rstrip('/')}/{name}.tbl", schema) for name, (_, schema) in parse_catalog(text).items()})
