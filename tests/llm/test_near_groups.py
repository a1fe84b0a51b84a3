"""A large group of near copies among many small ones: compared pairs stay in proportion, and no component is lost."""

import random

from tessera.llm import near


def test_one_large_group_among_couples(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for group in range(901):
        words = [f"g{group}w{k}" for k in range(100)]
        for copy in range(120 if group == 0 else 2):
            text = list(words)
            text[rng.randrange(100)] = f"own{len(rows)}"
            rows.append((1000 * group + copy, " ".join(text)))
    counts, kept = [], near.stage

    def counted(df, name):
        out = kept(df, name)
        if name == "pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(near, "stage", counted)
    out = near.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(i, i - i % 1000) for i, _ in rows}
    assert sum(r.kept for r in out) == 901
    assert sum(counts) < len(rows)  # 120 texts of the large group have 7140 pairs
