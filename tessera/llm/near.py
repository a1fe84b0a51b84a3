"""Near copies by the Jaccard similarity of word shingles: SimHash links and MinHash bands for candidates, an exact check, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, passing, raw, slices, stage
from tessera.llm.components import connected_components
from tessera.llm.simhash import SEED, links, majority, shingle_hashes

#: A pair of similarity 0.8 shares none of 32 bands of 6 minima with a probability of (1 - 0.8 ** 6) ** 32 = 0.00006.
BANDS, ROWS = 32, 6
_RNG = np.random.default_rng(SEED)
TIMES, PLUS, MIX = (_RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))
#: Buckets with more open pairs a member than this are large: their members are first compared with one of them, another in each round.
OPEN_PAIRS = 8
#: Such rounds at most, before all pairs that are still open are compared.
ROUNDS = 6


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text (see shingle_hashes())."""
    return np.unique(shingle_hashes(text, shingle))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of minima; none for an empty set."""
    if not len(hashes):
        return hashes.view(np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 256):
        low = np.minimum(low, (hashes[i : i + 256, None] * TIMES + PLUS).min(axis=0))
    return (low * MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def set_id(hashes: np.ndarray) -> int:
    """64 bits that name a set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def marked(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, v (the name of the text's set of shingles), n (its size), fp (its SimHash) and bands of every row."""
    bound_batches(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_set(text, shingle) for text in raw(part.column("text"))]
            fps = pa.array(np.array([majority(x) for x in sets], np.uint64).view(np.int64))
            marks = [pa.array([set_id(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), fps, pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), *marks], ["doc_id", "text_key", "v", "n", "fp", "bands"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(work, f"doc_id {kind}, text_key bigint, v bigint, n bigint, fp bigint, bands array<bigint>")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """v and hashes of every text."""
    bound_batches(texts.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for some in slices(iter([part]), limit=1 << 18):  # a hash of 8 bytes for each word
                found = [shingle_set(text, shingle) for text in raw(some.column("text"))]
                hashes = pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in found], pa.int64()), hashes], ["v", "hashes"])

    return texts.select("text").mapInArrow(work, "v bigint, hashes array<bigint>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs a, b of sets whose Jaccard similarity is 0.8 or more: 9 |A and B| >= 4 (|A| + |B|)."""
    left, right = (sets.select(F.col("v").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.where(9 * F.size(F.array_intersect("ha", "hb")) >= 4 * (F.size("ha") + F.size("hb"))).select("a", "b")


def simhash_pairs(classes: DataFrame) -> DataFrame:
    """Pairs a < b of sets whose SimHashes differ in 3 bits at most, as operator 10 finds them; of sets with one SimHash one stands for all."""
    alike = classes.groupBy("fp").agg(F.min("v").alias("lead"))
    own = classes.join(alike, "fp").select(F.col("lead").alias("x"), F.col("v").alias("y"))
    lead = lambda end: alike.select(F.col("fp").alias(end), F.col("lead").alias(f"lead_{end}"))
    linked = links(alike.select("fp")).join(lead("a"), "a").join(lead("b"), "b").select(F.col("lead_a").alias("x"), F.col("lead_b").alias("y"))
    return own.unionByName(linked).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def with_differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members (v, its size n, its component c, a pivot among others) with own and lost.

    own: how many shingles of v stand in no other component; lost: for each of 256 classes of the pivot's other shingles,
    whether v lacks an odd number of them, as 4 words of bits. Under one pivot, sets a and b of different components
    differ in own(a) + own(b) shingles, and in one more at least for each bit in which lost differs.
    """
    placed = members.select("v", "c").distinct().join(sets, "v").select("v", "c", F.explode("hashes").alias("h"))
    spread = placed.groupBy("h").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("h")
    common = stage(placed.join(spread, "h").groupBy("v").agg(F.collect_list("h").alias("common")), "common")
    of = lambda name: common.select(F.col("v").alias(name), F.col("common").alias(f"{name}_common"))
    asked = members.select("v", "pivot").distinct().join(of("pivot"), "pivot", "left").join(of("v"), "v", "left")
    none = F.array().cast("array<bigint>")
    missing = F.array_except(F.coalesce("pivot_common", none), F.coalesce("v_common", none))
    asked = stage(asked.select("v", "pivot", F.size(F.coalesce("v_common", none)).alias("shared"), missing.alias("missing")), "missing")
    words = "transform(array(0, 1, 2, 3), w -> aggregate(filter(missing, h -> (shiftright(h, 6) & 3) = w), 0L, (acc, h) -> acc ^ shiftleft(1L, cast(h & 63 as int))))"
    found = asked.select("v", "pivot", "shared", F.expr(words).alias("lost"))
    return stage(members.join(found, ["v", "pivot"]).withColumn("own", F.col("n") - F.col("shared")).drop("shared"), "differences")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), component_id (smallest doc_id of its component), kept, one row per input row.

    Two texts are near when their sets of word shingles have a Jaccard similarity of 0.8 or more; components
    are those of all near pairs. Candidates have SimHashes within 3 bits or share a band of minima, and are checked
    exactly. Texts with equal sets are one vertex. In a large bucket members are first compared with one of them,
    another in each round, and only pairs that are not yet in one component are compared in the end, each once, save those
    that differ too much by with_differences(). So a large group of near texts makes no square; of texts just below the
    limit the exact comparisons are few, but the bounds of all their pairs are looked at.
    kept: exactly one row of each component, that with component_id; of rows that repeat this id the one with the
    smallest text_key, and of those that repeat the text as well any one.
    Null text counts as empty; texts without a word are one vertex. Null ids stay null and don't count as
    smallest, unless a component has no other. Other columns are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    with passing(docs.sparkSession) as keep:
        # Numbers of rows are given once, in a written table, so that lost tasks can't change them.
        marks = keep(stage(marked(rows, shingle).withColumn("row", F.monotonically_increasing_id()), "marks"))
        classes = stage(marks.groupBy("v").agg(F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "classes")
        close = stage(simhash_pairs(classes.where("n > 0").select("v", "fp")), "close")
        keyed = classes.select("v", "n", F.explode("bands").alias("key"))
        shared = keyed.groupBy("key").agg(F.min("v").alias("least"), F.max("v").alias("most")).where("least <> most").select("key")
        members = stage(keyed.join(shared, "key"), "members")
        asked = members.select("v").unionByName(close.select(F.col("a").alias("v"))).unionByName(close.select(F.col("b").alias("v"))).distinct()
        wanted = classes.join(asked, "v", "left_semi").select("text_key")
        texts = rows.join(wanted.distinct(), "text_key", "left_semi").select("text_key", "text").distinct()
        sets = stage(shingle_sets(texts, shingle).dropDuplicates(["v"]), "sets")

        tried, near = close, stage(similar(close, sets), "near")
        roots, before = connected_components(near), None
        for turn in range(ROUNDS + 1):
            placed = members.join(roots, "v", "left").withColumn("c", F.coalesce("root", "v")).drop("root")
            pick = F.min(F.struct(F.xxhash64("v", "key", F.lit(turn)).alias("by"), "v", "n", "c")).alias("other")
            parts = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("part"), pick)
            size = F.sum("part")
            buckets = parts.groupBy("key").agg(((size * size - F.sum(F.col("part") * F.col("part"))) / (2 * size)).alias("open"), F.min("other").alias("other")).where("open > 0")
            unsettled = stage(placed.join(buckets, "key").withColumn("large", F.col("open") > OPEN_PAIRS), "unsettled")
            count, open_pairs = unsettled.agg(F.count(F.lit(1)), F.sum(F.when(F.col("large"), F.col("open")))).first()
            if not count:
                break
            # A round that settles less than a quarter of the open pairs of large buckets is the last of its kind.
            last = turn == ROUNDS or not open_pairs or (before is not None and 4 * open_pairs > 3 * before)
            before = open_pairs
            if last:
                one = with_differences(unsettled.select("key", "v", "n", "c", F.col("other.v").alias("pivot")), sets)
                one = one.join(members.groupBy("v").agg(F.collect_list("key").alias("keys")), "v")
                pairs = one.join(one.select("key", *(F.col(x).alias(f"other_{x}") for x in ("v", "n", "c", "own", "lost", "keys"))), "key").where("v < other_v and c <> other_c")
                lacking = " + ".join(f"bit_count(lost[{i}] ^ other_lost[{i}])" for i in range(4))
                pairs = pairs.where(f"9 * (own + other_own + {lacking}) <= n + other_n")  # else the similarity is below 0.8
                pairs = pairs.where("key = array_min(array_intersect(keys, other_keys))")  # each pair once: open pairs are so in all buckets they share
            else:
                pairs = unsettled.where("large").select("v", "n", "c", *(F.col(f"other.{x}").alias(f"other_{x}") for x in "vnc")).where("c <> other_c")
            pairs = pairs.where("5 * least(n, other_n) >= 4 * greatest(n, other_n)")
            pairs = pairs.select(F.least("v", "other_v").alias("a"), F.greatest("v", "other_v").alias("b")).distinct()
            pairs = stage(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
            found = stage(similar(pairs, sets), "near")
            tried, near = tried.unionByName(pairs), near.unionByName(found)
            roots = connected_components(near)
            if last:
                break

        named = keep(stage(classes.select("v").join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root")), "named"))
    placed = marks.select("doc_id", "text_key", "row", "v").join(named, "v").select("doc_id", "text_key", "row", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "row")).alias("first")
    firsts = placed.groupBy("root").agg(first).select("root", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row"))
    return placed.join(firsts, "root").select("doc_id", "text_key", "component_id", (F.col("row") == F.col("first_row")).alias("kept"))
