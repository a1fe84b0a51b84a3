"""Licence scans with hits: the query and its SQL on whole licences, their variants, and texts that are none."""

import duckdb
from pyspark.sql import functions as F

from tessera.llm import licenses


def test_query_against_sql(spark, tmp_path):
    full = licenses.full_texts()
    cases = [(t, n) for n, t in sorted(full.items())]
    cases += [(t.upper().replace("\n", "\r\n"), n) for n, t in sorted(full.items())]
    cases += [(f"The {n} License\n\nCopyright The Authors\nAll rights reserved.\n\n{licenses.full_texts()[n]}", n) for n in ("ISC", "Zlib", "BSD-2-Clause", "BSL-1.0")]
    clause = "\n(c) You must keep this notice.\n"
    cases += [(full["ISC"] + clause, None), (full["Zlib"] + " more", None), (None, None), ("", None), ("\n" * 300_000, None), ("MIT License\n" * 30, None), (" licence", None), ("é licence\nÄ © 2020 x\n(c) 1999 y\n", None)]
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, digest, license_id, is_license FROM ({licenses.OP1_SQL})").fetchall())
    got = sorted(map(tuple, licenses.op1_licenses(spark, f"file://{tmp_path}").collect()))
    assert got == want
    names = {i: n.removesuffix(" (titled)") if n else n for i, _, n, _ in got}
    assert [names[i] for i in range(len(cases))] == [n.removesuffix(" (titled)") if n else n for _, n in cases]


def test_clauses_are_not_copyright_lines(spark):
    rows = [(1, "a\n(c) You must.\nb"), (2, "a\n(c) You may.\nb"), (3, "a\n(c) 2020 X\nb"), (4, "a\nCopyright (C) X\nb"), (5, "a\nb")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r.digest for r in licenses.license_scan(df, {}).collect()}
    assert len({got[1], got[2], got[5]}) == 3 and got[3] == got[4] == got[5]


def test_known_texts_need_no_python_workers(spark):
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.lit(licenses.MIT).alias("text"))
    for known, found in ((None, "MIT"), ({"mine": licenses.MIT}, "mine"), ({}, None)):
        out = licenses.license_scan(docs, known)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan and "Python" not in plan
        assert [r.license_id for r in out.collect()] == [found, found]
