"""The whole pipeline on a small table against a plain version of its stages."""

import numpy as np
from pyspark.sql import functions as F
from test_llm import check_packing

import corpus_pipeline
from tessera.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic_score double, kept string"


def jaccard_groups(texts):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
    return root


def test_run(spark, tmp_path):
    rng = np.random.default_rng(21)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words, int(rng.integers(30, 120)))) for _ in range(150)]
    texts = [t + " vexnoid grobbly" if i % 4 == 0 else t for i, t in enumerate(texts)]
    texts += [texts[1].upper(), texts[2], texts[3] + " end", "api_key: 0123456789abcdef0 rest", None, "", " \n", "two words"]
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", len(t or ""), 0.5, "k") for i, t in enumerate(texts)]
    rows += [(2, texts[5], "en", "s", 1, None, None), (None, texts[6], "en", "s", 1, None, None), (None, "alone by itself", None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vexnoid" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    got = [r.asDict() for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()]

    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    model, limits = toxicity.train(docs, spark.read.parquet(f"file://{tmp_path}/labels.parquet"))
    hasher = toxicity.Hasher()

    def toxic(t, lang):
        codes = hasher([toxicity.words_of((t or "").encode())])
        return 1 / (1 + np.exp(-float(model.logits(codes, np.array([len(codes)]))[0]))) >= limits.get(lang, 0.5)

    left = [r[:3] for r in rows if not toxic(r[1], r[2])]
    assert 0.6 * len(rows) < len(left) < 0.85 * len(rows)
    best = {}
    for i, t, _ in left:  # of equal texts the largest id
        k = (t or "").lower()
        if k not in best or best[k][0] is None or (i is not None and i > best[k][0]):
            best[k] = (i, t)
    left = list(best.values())
    first = {}
    for (i, t), root in zip(left, jaccard_groups([t or "" for _, t in left]), strict=True):  # of near texts the smallest
        if root not in first or first[root][0] is None or (i is not None and i < first[root][0]):
            first[root] = (i, t)
    left = [(i, t if t is None else t.replace("api_key: 0123456789abcdef0", "[SECRET]")) for i, t in first.values()]
    assert any("[SECRET]" in (t or "") for _, t in left) and len(left) < len(rows) - 40
    check_packing(got, left, 2048)
    assert sorted({str(r["doc_id"]) for r in got}) == sorted({str(i) for i, _ in left})

    for name in ("documents", "labels"):
        spark.read.parquet(f"file://{tmp_path}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
    assert docs.where(F.col("kept") == "k").count() == len(texts)
