"""SimHash near-deduplication with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, passing, raw, slices, stage
from tessera.llm.components import connected_components

FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: Segments of the ring and bits of each.
RING, WIDTH = 8, 8
#: Keys with more fingerprints than this are split by further bits.
HOT_KEY = 1000


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """64-bit hashes of the word shingles of a UTF-8 text in their order, A-Z lower-cased; shorter texts are one shingle, no word gives none.

    bytes.split() parts words at space and \\t \\n \\v \\f \\r.
    """
    words = text.translate(FOLD).split()
    n, joined, h = len(words), b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([h(joined, SEED)] if n else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - shingle] + 1)).tolist()
    hashes = (h(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True))
    return np.fromiter(hashes, np.uint64, n - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are each set in over half the hashes; zero without hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded, however long the text
        bits = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, repeats included."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row; null text counts as empty."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.array([fingerprint(x, shingle) for x in raw(part.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(work, f"doc_id {kind}, fp bigint")


def segment(fp: Column, i: int) -> Column:
    """Segment i of the ring, counted from the low end."""
    return F.shiftrightunsigned(fp, WIDTH * (i % RING)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def budgets(most: int) -> list[int]:
    """Differences allowed in the first 1, 2, .. RING segments of a chain: in proportion to its length."""
    return [most * k // RING for k in range(1, RING + 1)]


def chosen_segments(most: int) -> list[list[int]]:
    """The segments that each key holds; fingerprints within most differing bits agree in all of one of them at least.

    By the pigeonring principle such a pair has a start from which every chain of k segments has
    most * k / RING differences at most. With 3 of 64 bits and 8 segments the first two segments are then
    equal, and the next three differ in one bit at most, so two of those three are equal as well: a key
    holds the two and one choice of two out of three, 32 bits. Other distances use the segments that
    must be equal outright.
    """
    allowed = budgets(most)
    exact = sum(b == 0 for b in allowed)
    loose = sum(b <= 1 for b in allowed) - exact
    if not exact:
        raise ValueError("the distance must be below the number of segments")
    out = []
    for start in range(RING):
        fixed = [start + k for k in range(exact)]
        free = [start + exact + k for k in range(loose)]
        choices = [fixed] if exact + loose > 5 or loose < 2 else [fixed + [x for x in free if x != skipped] for skipped in free]
        out += [[x % RING for x in c] for c in choices]
    return out


def keys(fp: Column, most: int = 3) -> Column:
    """Array of keys, each with its number in chosen_segments() above its 48 low bits."""
    out = []
    for j, chosen in enumerate(chosen_segments(most)):
        bits = reduce(lambda acc, c: acc.bitwiseOR(c), [F.shiftleft(segment(fp, s), WIDTH * k) for k, s in enumerate(chosen)])
        out.append(bits.bitwiseOR(F.lit(j << 48)))
    return F.array(*out)


def deeper(members: DataFrame, most: int) -> DataFrame:
    """fp, key, more: further keys for the fingerprints under hot keys; a pair within most differing bits still shares one.

    Eight half segments (or all there are) outside the key are taken. At most `most` of them differ, so some choice of
    4 (or of as many as must agree) is equal throughout; every such choice gives a key.
    """
    by_number = []
    for chosen in chosen_segments(most):
        shifts = [WIDTH * s + h for s in range(RING) if s not in chosen for h in (0, WIDTH // 2)]
        parts = shifts if len(shifts) <= 8 else shifts[:8]
        size = len(parts) - most
        by_number.append([list(c) for c in combinations(parts, min(size, 4))] if size > 0 else [[]])
    table = "array(" + ", ".join("array(" + ", ".join("array(" + ", ".join(map(str, c)) + ")" for c in x) + ")" for x in by_number) + ")"
    value = f"aggregate(shifts, cast(i as bigint), (acc, s) -> acc * {1 << WIDTH // 2} + (shiftrightunsigned(fp, s) & {(1 << WIDTH // 2) - 1}))"
    more = F.expr(f"transform(element_at({table}, cast(shiftright(key, 48) + 1 as int)), (shifts, i) -> {value})")
    return members.select("fp", "key", F.explode(more).alias("more"))


def on_ring(a: Column, b: Column, most: int = 3) -> Column:
    """Whether some start has all its chains within their budgets."""
    differing = [F.bit_count(segment(a.bitwiseXOR(b), i)) for i in range(RING)]
    starts = []
    for start in range(RING):
        total, checks = F.lit(0), []
        for k, allowed in enumerate(budgets(most)):
            total = total + differing[(start + k) % RING]
            checks.append(total <= allowed)
        starts.append(reduce(lambda x, y: x & y, checks))
    return reduce(lambda x, y: x | y, starts)


def links(fps: DataFrame, most: int = 3, hot: int = HOT_KEY) -> DataFrame:
    """Pairs a < b of different fingerprints (column fp, distinct) that differ in 1 to most bits; each once.

    Fingerprints under a key that only one has are left out first. Under a key of more than `hot` they are compared only
    where they agree in further bits as well (see deeper()), which loses no pair.
    """
    keyed = fps.select("fp", F.explode(keys(F.col("fp"), most)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stage(keyed.join(shared, "key"), "keyed")
    a, b = F.col("a"), F.col("b")

    def paired(rows: DataFrame, *by: str) -> DataFrame:
        left, right = rows.select(F.col("fp").alias("a"), *by), rows.select(F.col("fp").alias("b"), *by)
        pairs = left.join(right, list(by)).where("a < b")
        return pairs.where(on_ring(a, b, most) & (F.bit_count(a.bitwiseXOR(b)) <= most)).select("a", "b")

    found = paired(members.where(F.col("n") <= hot), "key").unionByName(paired(deeper(members.where(F.col("n") > hot), most), "key", "more"))
    return found.distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its component), one row per input row.

    Equal fingerprints are one vertex, so copies never make pairs; components come from links between
    different fingerprints alone. Null text counts as empty; texts without a word share fingerprint zero.
    Null ids stay null and don't count as smallest, unless a component has no other. Repeated rows are
    kept. Other columns are not read. An empty table gives no rows.
    """
    with passing(docs.sparkSession) as keep:
        fps = keep(stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints"))
        classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
        roots = connected_components(links(classes.select("fp"), most))
        linked = classes.join(roots.select(F.col("v").alias("fp"), "root"), "fp")
        smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
        named = stage(linked.join(smallest, "root").select("fp", "component_id"), "components")
        named = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
        named = keep(stage(named, "named"))
    out = fps.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 3-word shingles, 3 differing bits at most."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
