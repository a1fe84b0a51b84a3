"""Quality rules: base counts of a text, and repetition from a suffix array over its words."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, raw, slices

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
#: A repeat counts from so many words on; how much of a text repeats may cover, and how long one may be.
LEAST_REPEAT, MOST_COVERED, LONGEST_REPEAT = 8, 0.3, 100
#: Words compared in one numpy step.
STEP = 1 << 18


def suffix_array(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of several texts in one row.

    words: numbers of all words; ends: for each position, where its text ends. Suffixes end with their text and
    those of different texts never tie. Prefix doubling that sorts only what is still tied.
    """
    n, first = len(words), np.int64(words.max(initial=0)) + 2
    at = np.arange(n)
    if not n:
        return at
    text = np.cumsum(np.concatenate(([0], ends[:-1] != ends[1:])))
    follow = np.where(at + 1 < ends, words[np.minimum(at + 1, n - 1)] + 1, 0)
    key = (text * first + words) * first + follow
    del text, follow
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def ranked(order: np.ndarray, key: np.ndarray, old: np.ndarray | None) -> np.ndarray:
        """Give the positions in order the ranks of their groups; return those still tied."""
        new = np.concatenate(([True], key[1:] != key[:-1]))
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        place = np.repeat(begin, size)
        if old is not None:
            fresh = np.concatenate(([True], old[1:] != old[:-1]))
            place = old + place - np.repeat(np.flatnonzero(fresh), np.diff(np.append(np.flatnonzero(fresh), len(key))))
        rank[order] = place
        return order[np.repeat(size, size) > 1]

    tied, reach = ranked(order, key[order], None), 2
    del key
    while len(tied):
        after = np.where(tied + reach < ends[tied], rank[np.minimum(tied + reach, n - 1)] + 1, 0)
        key = rank[tied] * np.int64(n + 1) + after
        sort = np.argsort(key, kind="stable")
        tied = ranked(tied[sort], key[sort], rank[tied[sort]])
        reach *= 2
    order[rank] = at
    return order


def shared_words(words: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from positions a[i] and b[i] on are equal, up to the ends of their texts.

    Blocks are compared, twice as long each time, for the pairs that are equal so far (first their first words); at most STEP words at once.
    """
    room = np.minimum(ends[a] - a, ends[b] - b)
    got, open_, width = np.zeros(len(a), np.int64), np.flatnonzero(words[a] == words[b]), 2
    while len(open_):
        still = []
        for i in range(0, len(open_), max(1, STEP // width)):
            some = open_[i : i + max(1, STEP // width)]
            step = np.arange(min(width, int((room[some] - got[some]).max(initial=0))))
            x, y = (z[some, None] + got[some, None] + step for z in (a, b))
            same = (got[some, None] + step < room[some, None]) & (words[np.minimum(x, len(words) - 1)] == words[np.minimum(y, len(words) - 1)])
            whole = same.all(axis=1)
            got[some] += np.where(whole, len(step), same.argmin(axis=1)) if len(step) else 0
            still.append(some[whole & (got[some] < room[some])])
        open_, width = np.concatenate(still), min(2 * width, STEP)
    return got


def longest_matches(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length in words of the longest string from there that occurs elsewhere in its text.

    That is the greater of its common prefixes with both neighbours in the suffix array, so the bounds of all LCP
    intervals around it. Where the words in front of a suffix and of its lower neighbour are equal, the common
    prefix is that of the position before, less one; only the others are compared, whose lengths sum to
    n log n at most, so a few numbers for each word are all that is held, whatever repeats.
    """
    n = len(words)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    order = suffix_array(words, ends)
    lower = np.full(n, -1, np.int64)
    pair = ends[order[1:]] == ends[order[:-1]]
    lower[order[1:][pair]] = order[:-1][pair]
    at = np.flatnonzero(lower >= 0)
    low = lower[at]
    inner = (at > 0) & (low > 0)  # both go on to the left, within their text
    inner[inner] = (ends[at[inner] - 1] == ends[at[inner]]) & (ends[low[inner] - 1] == ends[low[inner]])
    inner[inner] = words[at[inner] - 1] == words[low[inner] - 1]
    asked = at[~inner]
    shared, origin = np.zeros(n, np.int64), np.zeros(n, np.int64)
    shared[asked] = shared_words(words, ends, asked, lower[asked])
    origin[asked] = asked
    origin = np.maximum.accumulate(origin)
    shared[at] = shared[origin[at]] - (at - origin[at])
    best[at] = shared[at]
    best[low] = np.maximum(best[low], shared[at])  # a suffix is the lower neighbour of one at most
    return best


def covered(best: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Which words lie in a repeat of least words or more; with width, in windows of that many words that repeat."""
    n = len(best)
    starts = np.flatnonzero(best >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + (best[starts] if width is None else width), -1)
    return np.cumsum(edge)[:n] > 0


def measure(texts: list[bytes], least: int = LEAST_REPEAT) -> dict[str, np.ndarray]:
    """Counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat."""
    parts = [x.split() for x in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter(map(numbers.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
    stops = np.cumsum(sizes)
    best = longest_matches(words, np.repeat(stops, sizes))
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[np.concatenate(([0], stops))])
    peak = np.zeros(len(texts), np.int64)
    some = sizes > 0
    if some.any():
        peak[some] = np.maximum.reduceat(best, (stops - sizes)[some])
    dup = []
    for x in texts:
        lines = Counter(x.split(b"\n"))
        dup.append(0 if len(lines) == x.count(b"\n") + 1 else sum(n - 1 for line, n in lines.items() if n > 1 and line.split()))
    return {
        "n_words": sizes,
        "word_chars": np.array([len(y := x.translate(None, SPACE)) - len(y.translate(None, bytes([*range(128), *range(192, 256)]))) for x in texts], np.int64),
        "n_symbols": np.array([len(x) - len(x.translate(None, SYMBOLS)) for x in texts], np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": total(covered(best, 3, 3)),
        "covered_words": total(covered(best, least)),
        "longest_repeat": np.where(peak >= least, peak, 0),
    }


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_REPEAT, most_covered: float = MOST_COVERED, longest: int = LONGEST_REPEAT) -> DataFrame:
    """One row per document: doc_id, base counts, base_failed, covered_words, longest_repeat, kept.

    Words are what ASCII white space parts. The spans of all maximal strings of least words or more that
    occur twice in a text are united; a text is kept if its base rules hold, they cover at most the
    share most_covered of its words, and the longest has at most `longest` words.
    Null text counts as empty; empty texts fail the base rules. Ids may be null or repeat. Other columns
    aren't read. An empty table gives no rows. A batch holds a few MB of text, or one longer text.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = measure(raw(part.column("text")), least)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[x]) for x in names)], ["doc_id", *names])

    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"{x} bigint" for x in names))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("covered_words") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Base counts and repetition of all documents."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
