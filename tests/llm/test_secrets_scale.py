"""Secret scans of long texts, of strings that no training sample has, and against the SQL with hits of the models."""

import hashlib
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera.llm import secrets

LETTERS = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def test_a_megabyte_of_digests(spark):
    digests = [hashlib.md5(str(i).encode()).hexdigest() for i in range(32_000)]
    rng = np.random.default_rng(1)
    runs = ["".join(rng.choice(LETTERS, 30)) for _ in range(2000)]
    texts = [" ".join(digests), " ".join(x for i in range(2000) for x in (digests[i], "é", runs[i]))]
    assert len(texts[0]) > 1_000_000
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    start = time.time()
    for embedded in (False, True):
        found = secrets.scan(df, embedded=embedded).select("doc_id", F.size("found").alias("n"), secrets.redacted(F.col("text"), F.col("found")).alias("clean"))
        got = {r.doc_id: r for r in found.collect()}
        assert got[0].n == 32_000 and got[0].clean == " ".join(["[SECRET]"] * 32_000)
        assert got[1].n > 3900 and got[1].clean.count("[SECRET]") > 3900 and got[1].clean.count("é") == 2000
    assert time.time() - start < 60


def identifiers():
    """Names from the Python library and made-up random strings; neither is drawn as the training samples are."""
    import argparse
    import asyncio
    import email.message
    import logging
    import unittest

    names = {n for m in (argparse, asyncio, email.message, logging, unittest) for k, v in vars(m).items() for n in (k, *(vars(v) if isinstance(v, type) else ()))}
    plain = sorted({f"{m}.{n}".replace(".", "/") for m in ("logging", "unittest/case", "asyncio/events") for n in names if len(n) > 12})
    noise = [hashlib.sha256(f"{i}".encode()).digest() for i in range(400)]
    import base64

    return [base64.b64encode(x).decode().rstrip("=")[: 22 + i % 20] for i, x in enumerate(noise)], plain


def test_strings_that_training_does_not_make(spark):
    noise, plain = identifiers()
    assert len(plain) > 200
    table = secrets.train(*secrets.labelled_samples())
    score = lambda s: sum(table[ord(a) * 128 + ord(b)] for a, b in zip(s, s[1:], strict=False))
    assert np.mean([score(s) >= secrets.THRESHOLD for s in noise]) > 0.95
    assert np.mean([score(s) >= secrets.THRESHOLD for s in plain]) < 0.02


def test_query_with_hits_of_the_models_against_sql(spark, tmp_path):
    noise, plain = identifiers()
    digest = hashlib.md5(b"x").hexdigest()
    texts = [None, "", *noise[:60], *plain[:60]]
    texts += [f"é {noise[i]} and token={noise[i + 1]} {digest} AKIA{'Q' * 16}{noise[i][:9]} 🙂 {noise[i + 2]}=" for i in range(60)]
    texts += [f"secret: {digest}{noise[0]}", f"{noise[0]}{digest}", f"{digest} {digest}", f"password='{noise[1]}'"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r for r in con.execute(f"SELECT doc_id, n_assign, n_access, n_hex, base_sha256, spans FROM ({secrets.OP7_SQL})").fetchall()}
    got = {r.doc_id: tuple(r) for r in secrets.op7_secrets(spark, f"file://{tmp_path}").collect()}
    assert got == want and sum("random" in r[-1] for r in got.values()) > 100
