"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, with patterns for Java and RE2 alike. Runs that are too short can't match inside a longer
#: run, so the least lengths of access and hex stand in the patterns; that of assign is checked after matching.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Runs that are searched for embedded secrets.
RUN = r"[A-Za-z0-9+/_=-]{12,}"
KINDS = ["assign", "access", "hex", "random"]
LEAST_ASSIGNED = 12
#: Smallest log-likelihood ratio, in thousandths, of a string that is held for random.
THRESHOLD = 15_000

#: Words of ordinary identifiers, the labelled negatives, joined in the usual ways.
WORDS = """get set user name value index count list item table column query result number string object class method
function create update delete insert select process handler manager controller service factory builder
configuration application information communication administration international responsibility understanding
implementation authentication authorization registration transaction notification subscription synchronization
the and that with from this which there their other people between through another because different important
Entwicklung Verwaltung Gesellschaft Geschwindigkeit Verantwortung Zusammenarbeit Wissenschaft Beschreibung
d veloppement gouvernement internationale connaissance environnement responsable naturellement particulier
desarrollo administracion universidad conocimiento responsabilidad internacional comunicacion naturaleza
heating leading thinking nothing standing reading meeting breathing whether together neither gathering
nation station creation relation position condition tradition attention edition motion ocean mention
these those shine fresh ashes share shell shore wheel whole whose tender render thunder wonder under order
enough ounce shout about house mouse north earth worth teeth bathe lathe father mother brother
table able noble bubble humble simple people temple example apple early nearly hardly friendly""".split()


def labelled_samples(n: int = 4000, seed: int = 7) -> tuple[list[str], list[str]]:
    """n random strings and n ordinary identifiers, the default training set; the same for every run."""
    rng = random.Random(seed)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"]
    noise = ["".join(rng.choice(rng.choice(alphabets[i % 4 : i % 4 + 1])) for _ in range(rng.randint(20, 48))) for i in range(n)]
    plain = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(2, 5))]
        style = i % 6
        if style == 0:
            s = words[0].lower() + "".join(w.capitalize() for w in words[1:])
        elif style == 5:
            s = "_".join(words).upper()
        else:
            s = ["", "_", "-", "/"][style - 1].join(w.lower() for w in words)
        plain.append(s + (str(rng.randint(1, 99)) if i % 10 == 0 else ""))
    return noise, plain


def train(noise: Sequence[str], plain: Sequence[str], weight: float = 0.5) -> list[int]:
    """128 * 128 log-likelihood ratios, in thousandths, of a character after another: random against ordinary.

    Add-`weight` smoothing over the characters that candidates have; pairs with others count nothing.
    """
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    tables = []
    for sample in (noise, plain):
        counts = {a: dict.fromkeys(alphabet, weight) for a in alphabet}
        for s in sample:
            for a, b in zip(s, s[1:], strict=False):
                if a in counts and b in counts:
                    counts[a][b] += 1
        tables.append({a: {b: math.log(n / sum(row.values())) for b, n in row.items()} for a, row in counts.items()})
    out = [0] * (128 * 128)
    for a in alphabet:
        for b in alphabet:
            out[ord(a) * 128 + ord(b)] = round(1000 * (tables[0][a][b] - tables[1][a][b]))
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def score(word: Column, table: Column) -> Column:
    """Log-likelihood ratio of a string, in thousandths."""
    code = lambda i: F.ascii(F.substring(word, i, 1))
    step = lambda acc, i: acc + F.element_at(table, code(i) * 128 + code(i + 1) + 1)
    return F.aggregate(F.sequence(F.lit(1), F.length(word) - 1), F.lit(0), step)


def best_stretch(word: Column, table: Column) -> Column:
    """Largest log-likelihood ratio of any stretch of a string, in thousandths."""
    code = lambda i: F.ascii(F.substring(word, i, 1))
    ratio = lambda i: F.element_at(table, code(i) * 128 + code(i + 1) + 1)
    step = lambda acc, i: F.struct((F.greatest(acc["sum"], F.lit(0)) + ratio(i)).alias("sum"), F.greatest(acc["best"], acc["sum"]).alias("best"))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.length(word) - 1), zero, step, lambda acc: F.greatest(acc["best"], acc["sum"]))


def stretches(word: Column, table: Column, threshold: int) -> Column:
    """Start and end of all stretches of a string whose ratio reaches the threshold, widened to the next = or / or the string's ends.

    A first or last part up to = or / that is itself no likelier random than ordinary is left out again. A stretch ends where its ratio is highest before it falls by as much as the threshold, or to nothing.
    """
    code = lambda i: F.ascii(F.substring(word, i, 1))
    kind = "array<struct<start:int,end:int>>"
    state = lambda total, start, best, end, out: F.struct(total.alias("sum"), start.alias("start"), best.alias("best"), end.alias("end"), out.alias("out"))
    closed = lambda acc: F.when(acc["best"] >= threshold, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"])

    def step(acc: Column, i: Column) -> Column:
        def with_total(total: Column) -> Column:
            over = (total <= 0) | ((acc["best"] >= threshold) & (acc["best"] - total >= threshold))
            more = total > acc["best"]
            on = state(total, acc["start"], F.greatest(acc["best"], total), F.when(more, i + 1).otherwise(acc["end"]), acc["out"])
            return F.when(over, state(F.lit(0), i, F.lit(0), F.lit(0), closed(acc))).otherwise(on)

        return let(acc["sum"] + F.element_at(table, code(i) * 128 + code(i + 1) + 1), with_total)

    zero = state(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.array().cast(kind))
    found = F.aggregate(F.sequence(F.lit(1), F.length(word) - 1), zero, step, closed)
    before = lambda s: F.length(F.regexp_extract(F.substring(word, F.lit(1), s["start"]), "[^=/]*$", 0))
    behind = lambda s: F.length(F.regexp_extract(F.substring(word, s["end"] + 1, F.length(word)), "^[^=/]*", 0))
    pays = lambda w: F.when(F.length(w) < 2, F.lit(0)).otherwise(score(w, table))

    def trimmed(s: Column) -> Column:
        piece = F.substring(word, s["start"] + 1, s["end"] - s["start"])
        head, tail = F.regexp_extract(piece, "^[^=/]*[=/]+", 0), F.regexp_extract(piece, "[=/]+[^=/]*$", 0)
        start = s["start"] + F.when(pays(head) <= 0, F.length(head)).otherwise(0)
        end = s["end"] - F.when(pays(tail) < 0, F.length(tail)).otherwise(0)
        return F.when(start < end, F.struct(start.alias("start"), end.alias("end"))).otherwise(s)

    wide = F.transform(found, lambda s: F.struct((s["start"] - before(s)).alias("start"), (s["end"] + behind(s)).alias("end")))
    return F.transform(wide, trimmed)


BLOCK = 256
SPAN = "array<struct<start:int,rank:int,end:int,word:string>>"


def sums(values: Column) -> Column:
    """Sum of an int array."""
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def find(text: Column, pattern: str, rank: int, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Spans of all leftmost non-overlapping matches, in code points; with wanted, none unless it holds for a match.

    Starts are sums over what lies before, taken by blocks of BLOCK matches, so that a text with very many
    matches takes no quadratic time.
    """
    none = F.array().cast(SPAN)

    def placed(matches: Column, between: Column) -> Column:
        lengths = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda a, b: F.length(a) + F.length(b))

        def with_lengths(sizes: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: sums(F.slice(sizes, b * BLOCK + 1, BLOCK)))

            def with_blocks(totals: Column) -> Column:
                offsets = F.transform(totals, lambda _, b: sums(F.slice(totals, F.lit(1), b)))

                def with_offsets(before: Column) -> Column:
                    def one(word: Column, i: Column) -> Column:
                        block = F.floor(i / BLOCK).cast("int")
                        start = before[block] + sums(F.slice(sizes, block * BLOCK + 1, i - block * BLOCK)) + F.length(between[i])
                        return let(start, lambda s: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(word)).alias("end"), word.alias("word")))

                    return F.transform(matches, one)

                return let(offsets, with_offsets)

            return let(blocks, with_blocks)

        return let(lengths, with_lengths)

    def with_matches(matches: Column) -> Column:
        some = F.size(matches) > 0 if wanted is None else F.exists(matches, wanted)
        return F.when(some, let(F.split(text, pattern, -1), lambda between: placed(matches, between))).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_matches)


def greatest_before(values: Column) -> Column:
    """For each place of a non-negative int array, the greatest value before it; -1 at the first.

    Taken by blocks of BLOCK places, like the sums in find().
    """

    def with_values(values: Column) -> Column:
        def with_tops(tops: Column) -> Column:
            def with_befores(befores: Column) -> Column:
                def one(_: Column, i: Column) -> Column:
                    block = F.floor(i / BLOCK).cast("int")
                    return F.greatest(F.lit(-1), befores[block], F.array_max(F.slice(values, block * BLOCK + 1, i - block * BLOCK)))

                return F.transform(values, one)

            return let(F.transform(tops, lambda _, b: F.array_max(F.slice(tops, F.lit(1), b))), with_befores)

        blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
        tops = let(F.transform(blocks, lambda b: F.array_max(F.slice(values, b * BLOCK + 1, BLOCK))), with_tops)
        return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(tops)

    return let(values, with_values)


def merged(base: Column, more: Column, inside: bool) -> Column:
    """base and those spans of more that no base span overlaps, or with inside: that no base span contains; by start, then kind.

    Every span is compared with the furthest end of the base spans sorted before it and, as spans of more don't overlap
    each other, with its next neighbour: one pass however many spans there are.
    """

    def with_all(spans: Column) -> Column:
        def with_ends(ends: Column) -> Column:
            def stays(s: Column, i: Column) -> Column:
                if inside:  # spans of one run may be equal
                    return (s["rank"] < 3) | ((ends[i] < s["end"]) & ~s.eqNullSafe(F.get(spans, i - 1)))
                following = F.get(spans, i + 1)
                meets = F.coalesce((following["rank"] < 3) & (following["start"] < s["end"]), F.lit(False))
                return (s["rank"] < 3) | ((ends[i] <= s["start"]) & ~meets)

            return F.filter(spans, stays)

        return let(greatest_before(F.transform(spans, lambda s: F.when(s["rank"] < 3, s["end"]).otherwise(0))), with_ends)

    some = lambda known: F.when(F.size(more) == 0, known).otherwise(let(F.array_sort(F.concat(known, more)), with_all))
    return let(F.array_sort(base), some)


def scan_spans(text: Column, ratios: Sequence[int], threshold: int, embedded: bool = False) -> Column:
    """Base spans and those that the models add, ordered by start, then kind.

    The models score whole runs of 20 characters; with embedded, all stretches of runs of 12, so that names and
    paths glued to a secret don't count against it, and what lies outside the base spans is added.
    """
    none = F.array().cast(SPAN)
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    # Each test of a literal is a part of the pattern behind it; where it fails, so does the pattern.
    assign = F.when(text.contains("=") | text.contains(":"), find(text, ASSIGN, 0)).otherwise(none)
    assign = F.filter(assign, lambda s: F.length(F.regexp_extract(s["word"], ASSIGN, 1)) >= LEAST_ASSIGNED)
    access = F.when(text.contains("AKIA"), find(text, ACCESS, 1)).otherwise(none)
    base = F.concat(assign, access, find(text, HEX, 2))
    if embedded:
        runs = find(text, RUN, 3, lambda w: best_stretch(w, table) >= threshold)
        cut = lambda s, x: F.struct((s["start"] + x["start"]).alias("start"), s["rank"].alias("rank"), (s["start"] + x["end"]).alias("end"), F.substring(s["word"], x["start"] + 1, x["end"] - x["start"]).alias("word"))
        parts = lambda s: F.when(best_stretch(s["word"], table) >= threshold, F.transform(stretches(s["word"], table, threshold), lambda x: cut(s, x))).otherwise(none)
        return let(F.flatten(F.transform(runs, parts)), lambda more: merged(base, more, inside=True))
    random_like = lambda w: score(w, table) >= threshold
    found = find(text, CANDIDATE, 3, random_like)
    return let(F.filter(found, lambda s: random_like(s["word"])), lambda more: merged(base, more, inside=False))


def scan(docs: DataFrame, ratios: Sequence[int] | None = None, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", embedded: bool = False) -> DataFrame:
    """doc_id, text and found, the spans of secrets: start and end in code points, rank in KINDS, word.

    ratios come from train(), by default on labelled_samples(). A candidate is a run of 20 or more letters,
    digits and +/_=-; it is added where its ratio reaches the threshold and no base span overlaps it. With embedded, candidates are stretches inside runs of 12 or more
    (see scan_spans).
    Null text counts as empty. Ids may be null or repeat. Other columns are not read. Empty tables give no rows.
    """
    ratios = train(*labelled_samples()) if ratios is None else ratios
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", scan_spans(F.col("text"), ratios, threshold, embedded).alias("found"))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])))


#: Code points of the pieces that redacted() cuts a text into.
PIECE = 4096


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by a mark; touching and overlapping spans make one. spans are sorted by start.

    The text is cut into pieces of PIECE code points first, so that a place far inside is found without
    counting from the text's start; the cost grows with the text and the spans, not with their product.
    """

    def between(pieces: Column, a: Column, z: Column) -> Column:
        """Code points a to z of the text."""
        first, last = F.floor(a / PIECE).cast("int"), F.floor((z - 1) / PIECE).cast("int")
        part = lambda j: F.substring(pieces[j], F.greatest(a - j * PIECE, F.lit(0)) + 1, F.least(z - j * PIECE, F.lit(PIECE)) - F.greatest(a - j * PIECE, F.lit(0)))
        return F.when(a >= z, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(first, last), part), ""))

    def with_pieces(spans: Column, pieces: Column) -> Column:
        def with_ends(ends: Column) -> Column:
            # A stretch begins with each span that all before it end short of; the end before it is that of the last stretch.
            opens = F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), ends[i].alias("end"))), lambda s: s["start"] > s["end"])

            def joined(heads: Column) -> Column:
                kept = F.transform(heads, lambda s: F.concat(between(pieces, F.greatest(s["end"], F.lit(0)), s["start"]), F.lit(mark)))
                return F.concat(F.array_join(kept, ""), between(pieces, F.array_max(spans["end"]), F.char_length(text)))

            return let(opens, joined)

        return let(greatest_before(spans["end"]), with_ends)

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(let(cut, lambda pieces: with_pieces(s, pieces))))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "found")
    base = F.filter("found", lambda s: s["rank"] < 3)
    count = lambda k: F.size(F.filter("found", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _sql(ratios: Sequence[int], threshold: int) -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    span = lambda m, p, k: f"list_transform(range(1, len({m}) + 1), lambda i: {{'s': coalesce(list_sum(list_transform({p}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform({m}[1:i-1], lambda x: length(x))), 0), 'k': {k}, 'w': {m}[i]}})"
    kinds = "['assign', 'access', 'hex', 'random']"
    text = lambda xs: f"coalesce(array_to_string(list_transform(list_sort({xs}), lambda z: {kinds}[z.k + 1] || ':' || z.s::BIGINT || ':' || (z.s + length(z.w))::BIGINT), ','), '')"
    parts = ", ".join(f"regexp_extract_all(t, {lit(p)}) AS m{k}, string_split_regex(t, {lit(p)}) AS p{k}" for k, p in enumerate((ASSIGN, ACCESS, HEX, CANDIDATE)))
    return f"""
WITH r AS MATERIALIZED (SELECT {list(ratios)} AS v),
a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, {parts} FROM a),
c AS (SELECT doc_id, list_filter({span('m0', 'p0', 0)}, lambda z: length(regexp_extract(z.w, {lit(ASSIGN)}, 1)) >= {LEAST_ASSIGNED}) AS s0,
             {span('m1', 'p1', 1)} AS s1, {span('m2', 'p2', 2)} AS s2, {span('m3', 'p3', 3)} AS s3 FROM b),
d AS (SELECT doc_id, len(s0) AS n_assign, len(s1) AS n_access, len(s2) AS n_hex, s0 || s1 || s2 AS base,
             list_filter(s3, lambda z: list_sum(list_transform(range(1, length(z.w)), lambda i: v[ascii(z.w[i]) * 128 + ascii(z.w[i + 1]) + 1])) >= {threshold}) AS more
      FROM c, r),
e AS (SELECT *, list_filter(more, lambda z: len(list_filter(base, lambda y: y.s < z.s + length(z.w) AND z.s < y.s + length(y.w))) = 0) AS added FROM d)
SELECT doc_id, n_assign, n_access, n_hex, sha256({text('base')}) AS base_sha256, {text('base || added')} AS spans FROM e
"""


OP7_SQL = _sql(train(*labelled_samples()), THRESHOLD)
