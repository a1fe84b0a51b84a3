"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain versions."""

import hashlib
import re
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import encode, licenses, packing, pieces, quality, secrets, simhash, token_counts, toxicity, warc
from tessera.llm.components import connected_components
from tessera.llm.exact_dedup import exact_dedup

WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor " * 9000
TEXTS = [(1, "Hello There"), (2, "hello there"), (3, None), (4, ""), (5, LONG), (6, "É é hello"), (7, "é é hello"), (None, "alone"), (8, "x"), (8, "x"), (9, " \t\n")]
SCHEMA = "doc_id long, text string, kept string, fp int, h string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", 1, "h", None) for i, t in TEXTS], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_exact_dedup(docs):
    got = by_id(exact_dedup(docs, keep="largest"))
    assert exact_dedup(docs).count() == len(TEXTS)
    assert (got[1]["keep_id"], got[1]["kept"], got[2]["kept"], got[1]["group_size"]) == (2, False, True, 2)
    assert (got[3]["keep_id"], got[4]["kept"], got[6]["group_size"], got[8]["group_size"]) == (4, True, 1, 2)
    assert (got[None]["keep_id"], got[None]["kept"]) == (None, True)  # a unique text stays, whatever its id
    assert sorted(r["kept"] for r in exact_dedup(docs).where("doc_id = 8").collect()) == [False, True]
    assert got[6]["text_sha256"] == hashlib.sha256("É é hello".encode()).hexdigest()
    assert by_id(exact_dedup(docs))[1]["kept"] and exact_dedup(docs.limit(0)).count() == 0


def plain_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@given(st.text(alphabet="aBé \t\n \u0085.", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_links_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**64, 60, dtype=np.uint64)]
    every = set(base)
    for b in base:
        for k in range(1, 6):
            v = b
            for bit in rng.choice(64, k, replace=False):
                v ^= 1 << int(bit)
            every.add(v)
    signed = [x - 2**64 if x >= 2**63 else x for x in every]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and len(want) > 150


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(40)] + [(7, 7), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    got = {r.v: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all((got[a] == got[b]) == (root(a) == root(b)) for a in got for b in got)
    assert set(got) == {x for e in edges for x in e if e[0] != e[1]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_components(docs):
    got = by_id(simhash.simhash_components(docs))
    assert got[1]["component_id"] == got[2]["component_id"] == 1
    assert got[3]["component_id"] == got[4]["component_id"] == got[9]["component_id"] == 3
    assert got[3]["fingerprint"] == "0" * 16 and got[None]["component_id"] is None
    assert simhash.simhash_components(docs.limit(0)).count() == 0


ODD = st.text(alphabet="aB'sé½²ΣİḰ  \x1c \n.,!<|>09漢🙂", max_size=40)


@given(st.lists(st.one_of(ODD, st.just("<|endoftext|> it's"), st.text(max_size=20)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_word_encoder(texts):
    texts = [t for t in texts if not re.search("[\ud800-\udfff]", t)]
    whole = encode.encoder(WORDS).tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode.encoder(WORDS).encode([t.encode() for t in texts])] == [x.ids for x in whole]


def test_word_encoder_takes_every_low_character():
    texts = [s for c in map(chr, range(0x250)) for s in (c, f"a{c}b")]
    whole = encode.encoder(WORDS).tokenizer.encode_batch(texts, add_special_tokens=False)
    got = encode.encoder(WORDS).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in whole]


def check_packing(rows, texts, window):
    tok = Tokenizer.from_file(WORDS)
    want = Counter(tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in texts)
    assert sum(r["length"] for r in rows) == sum(len(k) * n for k, n in want.items())
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [sum(x["length"] for x in s[:i]) for i in range(len(s))]
        n = sum(r["length"] for r in s)
        assert n == s[0]["sequence_length"] <= window and n & (n - 1) == 0
    return sequences


@pytest.mark.parametrize("window", [16, 2048])
def test_packing(docs, window):
    rows = [r.asDict() for r in packing.pack(docs, WORDS, window).collect()]
    check_packing(rows, TEXTS, window)
    ids = np.array([*Tokenizer.from_file(WORDS).encode(LONG, add_special_tokens=False).ids, 1], "<u4")
    mine = sorted((r for r in rows if r["doc_id"] == 5), key=lambda r: r["start"])
    assert [r["start"] for r in mine] == np.cumsum([0, *[r["length"] for r in mine[:-1]]]).tolist()
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
    assert packing.pack(docs.limit(0), WORDS, window).count() == 0


@given(st.dictionaries(st.integers(1, 63), st.integers(1, 500), max_size=20))
@settings(max_examples=60, deadline=None)
def test_packing_plan(counts):
    h = np.zeros(65, np.int64)
    for k, n in counts.items():
        h[k] = n
    patterns, used, left = packing.plan(h, 64)
    made = left.copy()
    for p, x in zip(patterns, used, strict=True):
        assert sum(a * k for a, k in p.items()) == 64
        for a, k in p.items():
            made[a] += x * k
    assert (made == h).all() and (left >= 0).all()


def test_token_counts(docs):
    sizes = np.array([len(Tokenizer.from_file(WORDS).encode(t or "", add_special_tokens=False).ids) for _, t in TEXTS])
    counts = token_counts.token_counts(docs, WORDS)
    got = {r.n_tokens: r for r in counts.collect()}
    assert set(got) == set(sizes.tolist())
    for n, r in got.items():
        assert (r.docs_within, r.tokens_beyond, r.truncated_tokens) == ((sizes <= n).sum(), sizes[sizes > n].sum(), np.minimum(sizes, n).sum())
    assert token_counts.total(counts, 3).first().truncated_tokens == np.minimum(sizes, 3).sum()
    assert token_counts.quantile(counts, 0.5).first().n_tokens == np.sort(sizes)[5]
    assert token_counts.token_counts(docs.limit(0), WORDS).count() == 0


def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c, cover, seen, dup = Counter(zip(w, w[1:], w[2:], strict=False)), set(), set(), 0
    for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
        cover |= {i, i + 1, i + 2} if c[g] > 1 else set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


@given(st.lists(st.text(alphabet="ab é#\n ", max_size=50), max_size=5))
@settings(max_examples=150, deadline=None)
def test_quality_counts(texts):
    got = quality.measure([t.encode() for t in texts], 4)
    for i, t in enumerate(texts):
        assert plain_quality(t) == tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        best = [max((next((k for k in range(len(w) - max(a, b)) if w[a + k] != w[b + k]), len(w) - max(a, b)) for b in range(len(w)) if b != a), default=0) for a in range(len(w))]
        cover = {x for a, n in enumerate(best) if n >= 4 for x in range(a, a + n)}
        assert (len(cover), max([n for n in best if n >= 4], default=0)) == (got["covered_words"][i], got["longest_repeat"][i])


def test_quality(docs, spark):
    got = by_id(quality.quality(docs))
    assert got[3]["base_failed"] and not got[5]["kept"] and got[3]["n_words"] == 0
    plain = " ".join(f"w{i}" for i in range(200))
    twice = spark.createDataFrame([(1, plain), (2, plain + " " + plain[:400])], "doc_id int, text string")
    assert [by_id(quality.quality(twice))[i]["kept"] for i in (1, 2)] == [True, False]
    assert quality.quality(docs.limit(0)).count() == 0


@pytest.mark.parametrize("period", [1, 2, 777])
def test_long_repetitive_text(period):
    """However much a text repeats, some numbers for each word are held, not some for each doubling."""
    n = 1 << 18
    words = np.arange(n) % period
    tracemalloc.start()
    best = quality.longest_matches(words, np.full(n, n))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (best[period:] == n - np.arange(period, n)).all() and (best[:period] == n - period - np.arange(period)).all()
    assert peak < 18 * 8 * n


SECRETS = st.lists(st.sampled_from(["password", "Token", "api_key", "apikey", "=", ":", " ", '"', "abcdef0123456789", "AKIA", "QWERTY123456789", "é", "x9Kq2Lm8Zt4Vb7Nc1Wd5", "internationalizationService", "secret: ", "\n", ".", "🙂"]), max_size=14).map("".join)


RATIOS = secrets.train(*secrets.labelled_samples())


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m[1]) >= 12]
    for k, p, n in ((1, r"AKIA[A-Z0-9]+", 18), (2, r"[0-9a-f]+", 16)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if m.end() - m.start() >= n]
    table = RATIOS
    for m in re.finditer(secrets.CANDIDATE, text):
        if sum(table[ord(a) * 128 + ord(b)] for a, b in zip(m[0], m[0][1:], strict=False)) >= secrets.THRESHOLD and not any(a < m.end() and m.start() < z for a, k, z in out if k < 3):
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_secrets(spark, docs):
    texts = []

    @given(SECRETS)
    @settings(max_examples=150, deadline=None)
    def draw(t):
        texts.append(t)

    draw()
    texts += [" ".join(f"{i:016x}" for i in range(700)), "token = x9Kq2Lm8Zt4Vb7Nc1Wd5"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in secrets.scan(df).select("*", secrets.redacted(F.col("text"), F.col("found")).alias("clean")).collect():
        spans = plain_spans(texts[r["doc_id"]])
        assert [(s["start"], s["rank"], s["end"]) for s in r["found"]] == spans
        at, parts = 0, []
        for a, _, z in spans:
            if a > at or not parts:
                parts += [texts[r["doc_id"]][at:a], "[SECRET]"]
            at = max(at, z)
        assert r["clean"] == "".join(parts) + texts[r["doc_id"]][at:]
    assert all(not r["found"] for r in secrets.scan(docs).collect()) and secrets.scan(docs.limit(0)).count() == 0


def test_random_strings_score_higher():
    table = secrets.train(*secrets.labelled_samples(seed=1))
    noise, plain = secrets.labelled_samples(500, seed=2)
    score = lambda s: sum(table[ord(a) * 128 + ord(b)] for a, b in zip(s, s[1:], strict=False))
    assert np.mean([score(s) >= secrets.THRESHOLD for s in noise]) > 0.95
    assert np.mean([score(s) >= secrets.THRESHOLD for s in plain]) < 0.02


def test_licenses(spark, docs):
    mit = "MIT License\n\nCopyright (c) 2031 Someone Else\n  (C) 1999 X\n\n" + licenses.MIT.upper().replace(" ", "\n", 3)
    british = licenses.MIT.replace("sublicense", "sublicence")
    df = spark.createDataFrame([(1, mit), (2, british), (3, licenses.MIT + " more"), (4, None), (5, "")], "doc_id int, text string")
    got = by_id(licenses.license_scan(df))
    assert [got[i]["license_id"] for i in range(1, 6)] == ["MIT (titled)", "MIT", None, None, None]
    assert licenses.license_scan(docs).count() == len(TEXTS) and licenses.license_scan(docs, {}).count() == len(TEXTS)


def test_sentencepiece(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    peer, mine = sentencepiece.SentencePieceProcessor(model_file=path), pieces.encoder(path)

    @given(st.text(alphabet="ab the▁\n é漢🙂<s>.", max_size=40))
    @settings(max_examples=200, deadline=None)
    def same(text):
        (ids,) = mine.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == peer.encode(text)
        assert mine.decode(ids).decode() == text.replace("▁", " ") or text.startswith("▁")

    same()
    got = by_id(pieces.encode_pieces(docs, path))
    assert all(r["parity"] and r["round_trip"] for r in got.values()) and got[3]["n_tokens"] == 0
    assert pieces.encode_pieces(docs.limit(0), path).count() == 0


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def blob(field, data):
    return varint(field << 3 | 2) + varint(len(data)) + data


def number(field, n):
    return varint(field << 3) + varint(n)


def hand_made_model(path, fallback, squeeze, prefix):
    """A unigram model with scores set by hand, as SentencePiece writes it."""
    words = ["▁", "a", "b", "c", "t", "h", "e", "▁the", "the", "th", "he", "ab", "abc", "bc", "▁ab", "▁a", "cab", "é", "漢", "▁▁", "ac"]
    rows = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("user", 0, 4)]
    rows += [(f"<0x{i:02X}>", 0, 6) for i in range(256 * fallback)]
    rows += [(w, -1 - 11 * (i * 0.618034 % 1), 1) for i, w in enumerate(words)]
    rows = b"".join(blob(1, blob(1, w.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + number(3, t)) for w, s, t in rows)
    path.write_bytes(rows + blob(2, number(3, 1) + number(35, fallback)) + blob(3, blob(1, b"identity") + number(3, prefix) + number(4, squeeze) + number(5, 1)))
    return str(path)


@pytest.mark.parametrize("fallback", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("prefix", [0, 1])
def test_sentencepiece_unigram(docs, tmp_path, fallback, squeeze, prefix):
    path = hand_made_model(tmp_path / "unigram.model", fallback, squeeze, prefix)
    enc = pieces.PieceEncoder(path)
    assert enc.model.kind == pieces.UNIGRAM
    part = st.one_of(st.text(alphabet="aabcthe  é漢🙂xz\n▁\t", max_size=25), st.sampled_from(["<s>", "<unk>", "<0x41>", "user", "  "]))

    @given(st.lists(part, max_size=5).map("".join))
    @settings(max_examples=150, deadline=None)
    def same(text):
        (ids,) = enc.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == enc.peer.encode(text)
        if fallback:
            assert enc.decode(ids).decode() == enc.model.normalised(text).replace("▁", " ")[prefix if enc.model.normalised(text) else 0 :]

    same()
    got = pieces.encode_pieces(docs, path).collect()
    assert len(got) == len(TEXTS) and all(r["parity"] for r in got) and all(r["round_trip"] for r in got if fallback)


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(3, "http://a/ b", big, 1), (1, None, big, 2), (2, "u", None, 3), (4, "u", "", 4), (None, "u", big, 5), (5000, "u\n", "é" * 80, 6), (6, "u", "s" * 99, 7), (7, "u", "s" * 99, 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    bytes_ = []
    for k, parts in (("a", 4), ("b", 1)):
        out = f"file://{tmp_path}/{k}"
        manifest = warc.write_warc(pages.repartition(parts), out, shard_bytes=2500, roll=300)
        got = {r.page_id: r for r in warc.read_warc(spark, manifest).collect()}
        bytes_.append({p.name: p.read_bytes() for p in (tmp_path / k).glob("*.gz")})
        assert len(bytes_[-1]) == manifest.count() > 3 and not list((tmp_path / k).glob(".warc*"))
    assert bytes_[0] == bytes_[1]
    assert (got[3].record_type, got[3].refers_to, got[3].payload_bytes) == ("revisit", 1, 203)
    assert {i: r.record_type for i, r in got.items() if i != 3} == dict.fromkeys([1, 2, 4, None, 5000, 6, 7], "response")
    assert got[5000].payload_digest == hashlib.sha256(("é" * 80).encode()).hexdigest()
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0), f"file://{tmp_path}/c")).count() == 0


def test_toxicity(spark, docs):
    rng = np.random.default_rng(1)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(600):
        w = list(rng.choice(vocabulary, rng.integers(5, 60)))
        toxic = i % 3 == 0
        if toxic:
            w.insert(int(rng.integers(0, len(w))), ["grobbly", "snarkist", "vexnoid"][i % 9 // 3])
        rows.append((i, " ".join(w), "en" if i % 2 else "de", int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    labels = df.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (5, None), (10**6, 1)], "doc_id long, toxic int"))
    model, thresholds = toxicity.train(df, labels)
    held = toxicity.toxicity(df, model, thresholds).where(toxicity.fold(F.col("doc_id")) == 0).collect()
    assert np.mean([(r.toxic_score >= 0.5) == (r.toxic == 1) for r in held]) > 0.97
    odd = toxicity.toxicity(docs, model, thresholds)
    assert odd.columns == [*docs.columns, "toxic_score", "toxic_flag"] and all(0 <= r.toxic_score <= 1 for r in odd.collect())
    assert toxicity.toxicity(docs.limit(0), model, thresholds).count() == 0
    one, _ = toxicity.train(df, labels.where("toxic = 0"))
    assert all(r.toxic_score < 0.5 for r in toxicity.toxicity(docs, one, {}).collect())


def test_pipeline_stages(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    base = " ".join(f"term{i}" for i in range(300))
    rows = [(1, "Same Text", "en", "s", 9, "e"), (2, "same text", "en", "s", 9, "e"), (None, "same text", None, None, None, None), (3, base, "en", "s", 1, None), (4, base + " end", "en", "s", 1, None), (5, "api_key: 0123456789abcdef0 rest", "en", "s", 31, None), (6, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, columns)
    kept = corpus_pipeline.drop_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6] and kept.columns == docs.columns
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, kept, "").collect()}
    assert left == {2, 3, 5, 6}
    clean = by_id(corpus_pipeline.redact_secrets(spark, kept, ""))
    assert clean[5]["text"] == "[SECRET] rest" and clean[5]["n_chars"] == 13 and clean[6]["text"] in (None, "")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "secrets", "packing"]


def shingle_words(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_by_jaccard(spark):
    rng = np.random.default_rng(3)
    texts = []
    for i in range(40):
        words = [f"w{i}x{x}" for x in rng.integers(0, 10**6, 120)]
        texts.append(" ".join(words))
        for changes in (1, 2, 4, 6):
            near = list(words)
            for at in rng.choice(120, changes, replace=False):
                near[at] = f"new{i}y{changes}z{at}"
            texts.append(" ".join(near))
    texts += ["", " \n", "two words", "Two  Words"]
    group = [f"g{x}" for x in rng.integers(0, 10**6, 100)]  # members of one group, each near to many others
    texts += [" ".join(f"other{i}" if at == i else w for at, w in enumerate(group)) for i in range(60)]
    sets = [shingle_words(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert left == set(root) and len(left) < len(texts) - 60
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_embedded_secrets_are_redacted(spark):
    rng, letters = np.random.default_rng(5), list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    made = lambda n: "".join(rng.choice(letters, n))
    paths = ["client_credential=", "aws/prod/database/credentials/", "https/internal-service/application/config/authorization/database/credential/"]
    cases = [(path, made(n)) for path in paths for n in (12, 16, 20, 24) for _ in range(50)]
    texts = [f"é see {path}{x} there" for path, x in cases]
    pairs = [f"user={made(24)}/application/configuration/administration/international/{made(24)}" for _ in range(50)]
    plain = [f"see {x} there" for x in secrets.labelled_samples(200, seed=3)[1]]
    rows = list(enumerate(texts + pairs + plain))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id int, text string, n_chars int")
    clean = by_id(corpus_pipeline.redact_secrets(spark, docs, ""))
    whole = [clean[i]["text"] == f"é see {path}[SECRET] there" for i, (path, _) in enumerate(cases)]
    assert np.mean(whole) > 0.9
    twice = [clean[len(texts) + i]["text"] == "user=[SECRET]/application/configuration/administration/international/[SECRET]" for i in range(50)]
    assert np.mean(twice) > 0.9
    assert [clean[len(texts) + 50 + i]["text"] for i in range(200)] == plain


def test_full_licences_with_and_without_heads(spark):
    full = licenses.full_texts()
    bsd, isc, zlib_text = full["BSD-3-Clause"], full["ISC"], full["Zlib"]
    cases = [(full[x].upper().replace("\n", "\r\n"), x) for x in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0")]
    cases += [("BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + bsd, "BSD-3-Clause"), ("ISC License\n\nCopyright The Authors\n\n" + isc, "ISC"), ("zlib License\n\n" + zlib_text, "Zlib")]
    cases += [("Copyright The Authors\n\n" + full["MIT"], "MIT"), ("MIT License\n", None), ("Copyright The Authors\n", None), (full["GPL-3.0"] + " more", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id int, text string")
    got = by_id(licenses.license_scan(df))
    assert [got[i]["license_id"] for i in range(len(cases))] == [name for _, name in cases]
