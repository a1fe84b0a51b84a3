"""WARC files of odd page ids, rerun tasks and damaged files."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import warc

SCHEMA = "page_id long, url string, html string, shard int, size string"


def written(spark, rows, path, parts=3, **options):
    pages = spark.createDataFrame([(i, "u", h, 1, "x") for i, h in rows], SCHEMA)
    manifest = warc.write_warc(pages.repartition(parts), f"file://{path}", **options)
    return manifest, {p.name: p.read_bytes() for p in path.glob("*.gz")}


def plain(rows):
    """record type and target by row, from the contract."""
    first = {}
    for i, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, h in rows:
        again = i is not None and h in first and i > first[h]
        out.append((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ids", [[-5000, -3, None, -90000, 0, 7], [i * 1_000_003 for i in range(200)], [2**53 + i for i in range(5)] + [-(2**63), 2**63 - 1], [4] * 30 + [None] * 5, []])
def test_ids(spark, tmp_path, ids):
    rng = np.random.default_rng(len(ids))
    rows = [(i, [None, "", "a" * 120, f"<p>{k}</p>" * 20][int(rng.integers(0, 4))]) for k, i in enumerate(ids)]
    manifest, files = written(spark, rows, tmp_path / "a", shard_bytes=8000, roll=1500)
    again, same = written(spark, rows, tmp_path / "b", parts=1, shard_bytes=8000, roll=1500)
    assert files == same and len(files) == manifest.count() and manifest.select("file").distinct().count() == len(files)
    assert manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0] == len(rows)
    assert sorted(map(tuple, warc.read_warc(spark, manifest).collect()), key=repr) == plain(rows)
    assert len(files) <= 1 + sum(len(h or "") + 1024 for _, h in rows) // 1500


def test_shards_follow_from_sizes(spark, tmp_path):
    rows = [(i * 977 - 10**6, f"{i}" * 700) for i in range(300)]
    manifest, _ = written(spark, rows, tmp_path / "a", shard_bytes=64_000)
    total, shards, at = 0, {}, {}
    for i, h in sorted(rows):
        shards.setdefault(total // 64_000, []).append(i)
        total += len(h) + warc.RECORD_BYTES
    got = {r.shard: r.records for r in manifest.collect()}
    assert got == {s: len(x) for s, x in shards.items()} and len(got) > 5


def test_a_task_that_runs_again_and_damage(spark, tmp_path):
    rows = [(i, f"page {i} " * 30) for i in range(20)]
    manifest, files = written(spark, rows, tmp_path / "a")
    shards = warc.Shards(f"file://{tmp_path}/a", 1 << 20)
    for name, data in files.items():  # as an attempt that was lost after its rename
        shards.write(int(name.split("-")[1]), data)
    shards.close()
    assert {p.name: p.read_bytes() for p in (tmp_path / "a").glob("*.gz")} == files and not list((tmp_path / "a").glob(".warc*gz.*[!c]"))
    path = next((tmp_path / "a").glob("*.gz"))
    path.write_bytes(files[path.name][:4] + b"\1\1\1\1" + files[path.name][8:])  # the time stamp: no record sees it
    with pytest.raises(Exception, match="digest of"):
        warc.read_warc(spark, manifest).collect()
    assert warc.filesystem(f"file://{tmp_path}")[1] == str(tmp_path)
