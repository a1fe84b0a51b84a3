"""Packing of tokenised documents into fixed windows, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, raw, slices, stage
from tessera.llm.encode import encoder

#: Up to so many pieces cut at window ends, with their ids, are sent to all executors; more are joined by shuffle.
BROADCAST_CUTS = 100_000


def tokenised(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row per document: its length, checksums of its full windows, and what remains.

    part and row name the row; nth counts the earlier rows of its part with the same remainder, and
    before its earlier full windows. rest holds the remaining ids, fewer than a window.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, end = encoder(tokenizer), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        row, before, seen, step = 0, 0, defaultdict(int), 4 * window
        for batch in slices(batches):
            out = []
            for ids in enc.encode(raw(batch.column("text"))):
                ids += end
                full = len(ids) // step
                rest = ids[full * step :]
                size = len(rest) // 4
                out.append((part, row, len(ids) // 4, [zlib.crc32(ids[k * step : (k + 1) * step]) for k in range(full)], before, size, seen[size], zlib.crc32(rest), rest))
                row, before = row + 1, before + full
                seen[size] += 1
            names = ["part", "row", "n", "full_crc", "before", "size", "nth", "rest_crc", "rest"]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(work, f"doc_id {kind}, part int, row bigint, n bigint, full_crc array<bigint>, before bigint, size int, nth bigint, rest_crc bigint, rest binary")


def combinations(histogram: np.ndarray, window: int, partners: int = 8) -> list[dict[int, int]]:
    """Length combinations that fill the window exactly: one length repeated with one other, and triples.

    For each length, the triples with the `partners` most frequent companions are taken. At most some
    window * (partners + log(window)) combinations, whatever the number of documents.
    """
    present = np.flatnonzero(histogram[: window + 1])
    found = set()
    for a in map(int, present):
        for k in range(1, window // a + 1):
            c = window - k * a
            if c == 0:
                found.add(((a, k),))
            elif c != a and histogram[c]:
                found.add(tuple(sorted(((a, k), (c, 1)))))
        b = present[present < window - a]
        c = window - a - b
        score = np.minimum(histogram[b], histogram[c])
        for i in np.argsort(-score, kind="stable")[:partners]:
            if score[i]:
                counts: dict[int, int] = defaultdict(int)
                for x in (a, int(b[i]), int(c[i])):
                    counts[x] += 1
                found.add(tuple(sorted(counts.items())))
    return [dict(x) for x in sorted(found)]


def non_negative_least_squares(patterns: list[dict[int, int]], histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|, where column p of A holds the counts of pattern p.

    Multiplicative updates: every step keeps x non-negative and doesn't raise the error.
    """
    width = max(map(len, patterns))
    lengths, counts = np.zeros((len(patterns), width), np.int64), np.zeros((len(patterns), width))
    for i, p in enumerate(patterns):
        lengths[i, : len(p)], counts[i, : len(p)] = list(p), list(p.values())
    h = histogram.astype(float)
    target = (counts * h[lengths]).sum(axis=1)
    x = target / np.maximum((counts**2).sum(axis=1), 1) / width
    for _ in range(rounds):
        made = np.bincount(lengths.ravel(), (counts * x[:, None]).ravel(), len(h))
        x *= target / np.maximum((counts * made[lengths]).sum(axis=1), 1e-12)
    return x


def plan(histogram: np.ndarray, window: int) -> tuple[list[dict[int, int]], list[int], np.ndarray]:
    """Patterns, how often each is used, and the histogram of the lengths left over.

    The solution is rounded, cut back to what is there from the most used pattern on, and then
    every pattern takes greedily what it still can.
    """
    patterns = combinations(histogram, window)
    left = histogram.astype(np.int64).copy()
    if not patterns:
        return [], [], left
    x = non_negative_least_squares(patterns, histogram)
    used = np.zeros(len(patterns), np.int64)
    for want in (np.rint(x).astype(np.int64), None):
        for i in np.argsort(-x, kind="stable"):
            can = min(int(left[a]) // k for a, k in patterns[i].items())
            n = can if want is None else min(can, int(want[i]))
            if n > 0:
                used[i] += n
                for a, k in patterns[i].items():
                    left[a] -= n * k
    return patterns, used.tolist(), left


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length.

    Full windows of long documents are sequences of their own. Of the remainders, those that the plan on
    their histogram (window numbers, all that reaches the driver) puts together fill sequences uncut; the
    rest are laid end to end, longest first, and cut at window ends. The last such window is cut into
    sequences of powers of two, so that no sequence needs padding.

    Places follow from a document's rank among those of its length, which comes from counts by part and
    length; no length is gathered in one task, however common. Null text counts as empty (one piece, the
    end id). Null and repeated ids are kept: each row is a document of its own. Other columns aren't read.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    toks = stage(tokenised(docs, tokenizer, window, end_id, id_col, text_col), "tokens")
    counts = stage(toks.groupBy("part", "size").agg(F.count(F.lit(1)).alias("n_docs")), "counts")
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.where("size > 0").groupBy("size").agg(F.sum("n_docs").alias("n")).collect():
        histogram[r["size"]] = r["n"]
    patterns, used, left = plan(histogram, window)

    base, taken, slots = 0, np.zeros(window + 1, np.int64), []
    for p, x in zip(patterns, used, strict=True):
        first = 0
        for a, k in p.items() if x else ():
            slots.append((a, int(taken[a]), int(taken[a]) + x * k, base, k, first))
            taken[a] += x * k
            first += a * k
        base += x
    at, stream = 0, []
    for a in map(int, np.flatnonzero(left)[::-1]):
        stream.append((a, int(taken[a]), at))
        at += a * int(left[a])
    whole = at // window * window
    ends, bounds = whole, []
    for bit in range(window.bit_length() - 1, -1, -1):
        if (at - whole) >> bit & 1:
            bounds.append(ends)
            ends += 1 << bit
    first_full = base + whole // window + len(bounds)

    by_size = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.where("size > 0").select("part", "size", F.coalesce(F.sum("n_docs").over(by_size), F.lit(0)).alias("earlier"))
    meta = toks.where("size > 0").select("doc_id", "part", "row", "n", "size", "nth", "rest_crc")
    ranked = meta.join(earlier, ["part", "size"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    ranked = ranked.withColumn("start", F.col("n") - F.col("size"))

    # Both tables have a row for each length and pattern at most: their size depends on the window alone.
    slot = spark.createDataFrame(slots, "size int, low bigint, high bigint, base bigint, times int, first int")
    fits = ranked.join(F.broadcast(slot), "size").where("rank >= low and rank < high")
    fits = fits.select("doc_id", "start", F.col("size").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), F.expr("base + (rank - low) div times").alias("sequence_id"), F.expr("first + pmod(rank - low, times) * size").alias("offset"), F.lit(window).cast("long").alias("sequence_length"))

    line = spark.createDataFrame(stream, "size int, skip bigint, at bigint")
    laid = ranked.join(F.broadcast(line), "size").where("rank >= skip").withColumn("from", F.expr("at + (rank - skip) * size"))
    tail = "array(" + ", ".join(f"{b}L" for b in bounds) + ")" if bounds else "cast(array() as array<bigint>)"
    cuts = f"filter(concat(array((from div {window} + 1) * {window}L), {tail}), x -> x > from and x < from + size and x <= {whole}L + {window}L)"
    laid = laid.withColumn("cuts", F.expr(f"array_sort(array_distinct({cuts}))")).withColumn("cuts", F.expr("concat(array(from), cuts, array(from + size))"))
    pieces = laid.select("*", F.explode(F.expr("transform(sequence(1, size(cuts) - 1), i -> struct(cuts[i - 1] as a, cuts[i] as b))")).alias("p"))
    starts = "array(" + ", ".join(f"{b}L" for b in [*bounds, ends]) + ")"
    nth_tail = f"size(filter({starts}, x -> x <= p.a)) - 1"
    pieces = pieces.select(
        "doc_id", "part", "row", "n", "size", "rest_crc",
        F.expr("p.a - from").alias("skip"),
        F.expr("p.b - p.a").alias("length"),
        F.expr(f"{base}L + if(p.a < {whole}L, p.a div {window}, {whole // window}L + {nth_tail})").alias("sequence_id"),
        F.expr(f"if(p.a < {whole}L, p.a % {window}, p.a - element_at({starts}, {nth_tail} + 1))").alias("offset"),
        F.expr(f"if(p.a < {whole}L, {window}L, element_at({starts}, {nth_tail} + 2) - element_at({starts}, {nth_tail} + 1))").alias("sequence_length"),
        F.expr("n - size + p.a - from").alias("start"),
    )
    pieces = stage(pieces, "pieces")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]
    uncut = pieces.where("length = size").select("*", F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens")).select(names)
    cut = pieces.where("length < size")
    if cut.limit(BROADCAST_CUTS + 1).count() <= BROADCAST_CUTS:
        cut = F.broadcast(cut)
    cut = toks.where("size > 0").select("part", "row", "rest").join(cut, ["part", "row"])
    cut = cut.select("*", F.crc32(F.expr("substring(rest, cast(4 * skip + 1 as int), cast(4 * length as int))")).alias("ids_crc32"), F.col("n").alias("doc_tokens")).select(names)

    fulls = toks.where(F.size("full_crc") > 0)
    by_part = fulls.groupBy("part").agg(F.sum(F.size("full_crc")).alias("n_full"))  # a row per part
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("part", F.coalesce(F.sum("n_full").over(so_far), F.lit(0)).alias("earlier"))
    full = fulls.join(by_part, "part").select("doc_id", "n", "before", "earlier", F.posexplode("full_crc").alias("k", "ids_crc32"))
    full = full.select("doc_id", F.expr(f"k * {window}L").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), F.expr(f"{first_full}L + earlier + before + k").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(window).cast("long").alias("sequence_length"))
    return fits.withColumn("offset", F.col("offset").cast("long")).unionByName(uncut).unionByName(cut).unionByName(full)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
