"""Exact deduplication: 128-bit content hash, bytes compared inside each hash group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, stage


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fold_case: bool = True) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, text_key (xxhash64 of the text as it stands).

    Texts are equal when their bytes are (after lower-casing A-Z with fold_case).
    Rows are grouped by a 128-bit hash (MD5) together with the bytes, so texts that
    only share the hash fall into different groups; map-side combining keeps one
    text per group and task, however many copies there are. keep: "smallest" or
    "largest" id stays, and exactly one row of each group.

    Null text counts as empty. A null id never wins against another; in a group of null
    ids only keep_id is null and one row stays. Of rows that repeat the id that stays, the one with the
    smallest text_key stays, and of those that repeat the text as well, any one. Other input columns are
    not read. An empty table gives none.
    """
    largest = {"smallest": False, "largest": True}[keep]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), (ascii_lower(text) if fold_case else text).alias("norm"))
    rows = rows.select("doc_id", "norm", F.unhex(F.md5("norm")).alias("h"), F.xxhash64("text").alias("text_key"))
    # Numbers of rows are given once, in a written table, so that lost tasks can't change them.
    members = stage(rows.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), "text_key", F.monotonically_increasing_id().alias("row")), "members")
    groups = rows.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size")
    # Two different texts under the same MD5 and the same SHA-256 would be indistinguishable below: stop then.
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("texts collide in two hashes"))).otherwise(F.max("group_size"))
    groups = groups.groupBy("h", "sha").agg(one.cast("long").alias("group_size"))
    # In one pass: the row with the extreme id; of rows with that id, the smallest text_key and row.
    if largest:
        best = F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", F.bitwise_not("text_key").alias("key"), (-F.col("row")).alias("row")))
    else:
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("text_key").alias("key"), "row"))
    best = members.groupBy("h", "sha").agg(best.alias("best")).select("h", "sha", F.col("best.doc_id").alias("keep_id"), F.abs("best.row").alias("keep_row"))
    groups = stage(groups.join(best, ["h", "sha"]).select("h", "sha", "group_size", "keep_id", "keep_row"), "groups")
    # Every member has its group; a hot group is a skewed key here, which AQE splits.
    return members.join(groups, ["h", "sha"]).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "text_key")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents; of equal texts the largest doc_id stays."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest").drop("text_key")
