"""A corpus pipeline: toxicity, exact deduplication, near-deduplication, secret scan, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import secrets
from tessera.llm.common import passing, stage, unstage
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.near import near_components
from tessera.llm.packing import pack
from tessera.llm.toxicity import toxicity, train


def only_kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that decided keeps. decided: doc_id, text_key (xxhash64 of the text) and kept, for each row of docs.

    Where some of the rows that repeat an id and a text are kept and others not, one of them stays, that with the
    smallest hash of all its columns.
    """
    decided = stage(decided.select("doc_id", "text_key", "kept"), "decided")
    gone = decided.where(~F.col("kept")).select(F.col("doc_id").alias("i"), F.col("text_key").alias("k")).distinct()
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["i"]) & (key == gone["k"]), "left_anti")
    stay = decided.where("kept").select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"))
    both = stay.join(gone, stay["d"].eqNullSafe(gone["i"]) & (stay["t"] == gone["k"]), "left_semi").distinct()
    if both.isEmpty():
        return left
    row = F.struct(*(docs[c] for c in docs.columns))
    again = docs.join(both, docs["doc_id"].eqNullSafe(both["d"]) & (key == both["t"]), "left_semi")
    one = again.groupBy(docs["doc_id"], key).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("one_row"))
    return left.unionByName(one.select("one_row.*"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score reaches the threshold of their language.

    Null and empty texts have the score of an empty text; null languages the threshold 0.5. Repeated rows share their
    lot. Other columns pass unread, whatever their names. An empty table stays empty.
    """
    score, flag = "toxic_score", "toxic_flag"
    while {score, flag} & {c.lower() for c in docs.columns}:
        score, flag = score + "_", flag + "_"
    model, thresholds = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, model, thresholds, score_col=score, flag_col=flag).where(~F.col(flag)).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased), keep one row with the largest doc_id.

    Null text equals the empty text. A null id never wins against another. Rows are judged one by one: rows that repeat an
    id with another text are judged by their own text, and of fully repeated rows one stays. An empty table stays empty.
    """
    return only_kept(docs, exact_dedup(docs, keep="largest"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with five-word Jaccard similarity 0.8 or more, keep one row with the smallest doc_id.

    Texts without a word, null ones among them, are copies of each other. Null and repeated ids as in drop_copies().
    An empty table stays empty.
    """
    return only_kept(docs, near_components(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts by a mark and count characters anew; no document is dropped.

    Null texts stay null, with a null count. Repeated rows are changed alike, other columns pass unread. An empty table stays empty.
    """
    ratios = secrets.train(*secrets.labelled_samples())
    text = F.col("text")
    clean = secrets.let(secrets.scan_spans(F.coalesce(text, F.lit("")), ratios, secrets.THRESHOLD, embedded=True), lambda found: secrets.redacted(text, found))
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("text", clean).withColumn("n_chars", F.char_length("text").cast(kind)).select(docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens.

    Null texts count as empty and give a piece with the end mark alone; every row is a document of its own, whatever its
    id. Columns other than doc_id and text aren't read. An empty table gives no pieces.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_windows),
]

#: Stages 1 and 5 (a trained model, a tokenizer) can't be said in SQL; a test holds run() against a plain version of all stages but the model's score.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written as Parquet and read again.

    Once a stage's result is written, the tables that it made on the way and the result before it are deleted.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        with passing(spark) as keep:
            result = keep(stage(function(spark, docs, sf_dir), name))
        unstage(docs)
        docs = result
    return STAGES[-1][1](spark, docs, sf_dir)
