"""Scratch tables go as soon as nothing reads them, and stay while something does."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.components import connected_components
from tessera.llm.near import near_components
from tessera.llm.simhash import simhash_components


def tables(spark):
    where = common.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    return {x for x in os.listdir(where) if x.startswith("tessera-")}


def test_passing_keeps_what_it_is_told(spark):
    before = tables(spark)
    with common.passing(spark) as keep:
        a = common.stage(spark.range(5), "a")
        with common.passing(spark) as inner:
            b = inner(common.stage(a.where("id > 1"), "b"))
            common.stage(a, "c")
        assert len(tables(spark) - before) == 2 and b.count() == 3
        d = keep(common.stage(b.select((F.col("id") * 2).alias("x")), "d"))
    assert len(tables(spark) - before) == 1 and [r.x for r in d.orderBy("x").collect()] == [4, 6, 8]
    common.unstage(d)
    common.unstage(spark.range(1))
    assert tables(spark) == before
    with pytest.raises(ValueError), common.passing(spark):
        common.stage(spark.range(5), "a")
        raise ValueError
    assert tables(spark) == before


def test_operators_leave_what_their_result_reads(spark):
    texts = [(i, " ".join(f"w{i // 3}x{k}" for k in range(60)) + f" end{i % 3}" * (i % 3 > 0)) for i in range(30)] + [(40, None), (41, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for operator, most in ((simhash_components, 2), (near_components, 2)):
        before = tables(spark)
        out = operator(docs)
        assert len(tables(spark) - before) <= most
        assert out.count() == 32 and {r.doc_id: r.component_id for r in out.collect()}[41] == 40
    before = tables(spark)
    roots = connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    assert len(tables(spark) - before) <= 3
    assert {(r.v, r.root) for r in roots.collect()} == {(i, 0) for i in range(41)}
