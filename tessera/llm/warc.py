"""WARC: a deterministic sharded writer and its reader."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, scratch_path, slices, stage

#: Payloads from this size on are stored once; further copies become revisit records.
LEAST_REVISIT = 100
#: Payload bytes, and RECORD_BYTES more for each record, that a shard holds; compressed bytes after which its files roll.
SHARD_BYTES = 32 << 20
RECORD_BYTES = 1 << 10
ROLL_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, first: int | None, date: str) -> bytes:
    """One record; first: the page whose response it revisits, if any. Headers follow from the arguments alone."""
    block = HTTP % size + (payload if first is None else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([] if first is None else [f"WARC-Refers-To: {urn(first)}", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def compressed(data: bytes) -> bytes:
    """A gzip member of its own, without time or name."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it (s3a and s3n are s3 to Arrow), and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


class Shards:
    """Writes records that come in order of shard; a file is complete once it has its final name."""

    def __init__(self, out_dir: str, roll: int):
        self.out_dir, self.roll = out_dir, roll
        self.files, self.root = filesystem(out_dir)
        self.files.create_dir(self.root, recursive=True)
        self.stream, self.shard, self.part, self.done = None, None, 0, []

    def write(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        elif self.stream is not None and self.size + len(data) > self.roll:
            self.close()
            self.part += 1
        if self.stream is None:
            self.name = f"warc-{shard:08d}-{self.part:05d}.warc.gz"
            self.temp = f"{self.root}/.{self.name}.{uuid.uuid4().hex}"
            self.stream, self.size, self.records, self.digest = self.files.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        self.stream.write(data)
        self.digest.update(data)
        self.size, self.records = self.size + len(data), self.records + 1

    def close(self) -> None:
        """Give the file its name. One that another attempt of the task has left there has the same bytes, and stays if whole."""
        if self.stream is not None:
            self.stream.close()
            final = f"{self.root}/{self.name}"
            there = self.files.get_file_info(final)
            if there.type == fs.FileType.File and there.size != self.size:
                self.files.delete_file(final)
            if there.type == fs.FileType.File and there.size == self.size:
                self.files.delete_file(self.temp)
            else:
                self.files.move(self.temp, final)
            self.done.append((f"{self.out_dir}/{self.name}", self.shard, self.part, self.records, self.size, self.digest.hexdigest()))
            self.stream = None


def shard_starts(index: DataFrame, shard_bytes: int) -> DataFrame:
    """The first key of each shard but shard 0: rows of shard and key.

    index: key and size of every record. Records stand in order of their keys and a shard begins where the sizes before it
    pass the next multiple of shard_bytes, so shards follow from the records alone. Sums are taken inside ranges of keys and
    then over ranges; how Spark cuts the ranges doesn't matter. Records of one key stay together.
    """
    totals = index.groupBy("key").agg(F.sum("size").alias("size"))
    ranges = stage(totals.repartitionByRange("key").withColumn("p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = ranges.groupBy("p").agg(F.sum("size").alias("all")).select("p", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("p").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("in_range", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, "p")
    placed = placed.select("key", F.expr(f"(offset + in_range) div {shard_bytes}").alias("shard"))
    return placed.groupBy("shard").agg(F.min("key").alias("key")).where("shard > 0")


def shard_of(key: Column, starts: Column) -> Column:
    """How many of the sorted keys in the array starts are not above key, found by halving."""
    low_high = F.struct(F.lit(0).alias("low"), F.size(starts).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        below = (acc["low"] < acc["high"]) & (F.get(starts, middle) <= key)
        above = (acc["low"] < acc["high"]) & ~(F.get(starts, middle) <= key)
        return F.struct(F.when(below, middle + 1).otherwise(acc["low"]).alias("low"), F.when(above, middle).otherwise(acc["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts) + 1)).cast("int")), low_high, halve, lambda acc: acc["low"])


def write_warc(pages: DataFrame, out_dir: str, date: str = "2000-01-01T00:00:00Z", shard_bytes: int = SHARD_BYTES, roll: int = ROLL_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page under out_dir; returns the manifest (file, shard, part, records, bytes, sha256), also kept in out_dir/manifest.

    Of equal payloads of LEAST_REVISIT bytes or more, the smallest page id is the response and others
    revisit it. Records are sorted by page id (null first) and payload digest. A shard holds a range of them, which
    follows from their sizes (see shard_starts()), and its files roll at `roll` compressed bytes, so names and bytes
    don't depend on tasks or retries, nor on how the ids are spaced. A shard is a task; only equal rows can make one larger
    than shard_bytes and one record. Files are written under temporary names and renamed; a file counts only if the manifest lists it.
    Null html is an empty payload; records of null ids are responses. Rows that
    repeat id and payload are responses alike. Other columns aren't read. No pages: an empty manifest.
    out_dir is a path that Arrow can write (file, hdfs, s3a, gs, abfs).
    """
    spark = pages.sparkSession
    bound_batches(spark)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    key = F.struct(F.col("page_id").isNotNull().alias("some"), F.coalesce("page_id", F.lit(0)).alias("id"), F.col("digest").alias("digest"))
    index = stage(rows.select("page_id", "digest", "size"), "index")  # all that is decided on: no payloads
    starts = shard_starts(index.select(key.alias("key"), (F.col("size") + RECORD_BYTES).alias("size")), shard_bytes)
    starts = stage(starts.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "key"))), lambda x: x["key"]).alias("starts")), "starts")
    count = 1 + starts.select(F.size("starts")).first()[0]  # about the payloads' bytes / shard_bytes
    # Payloads are shuffled once, by shard. Which records are revisits is found on digests alone; those
    # small rows go to the shards as well and sort before the pages that they are about.
    large = index.where(F.col("size") >= LEAST_REVISIT)
    copies = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    again = large.select("page_id", "digest").join(copies, "digest").where("page_id > first").distinct()
    both = rows.select("*", F.lit(1).alias("step"), F.lit(None).cast("long").alias("first")).unionByName(again.withColumn("step", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("starts", starts.scalar()).withColumn("shard", shard_of(key, F.col("starts"))).drop("starts")
    ordered = both.repartitionById(count, F.col("shard").cast("int")).sortWithinPartitions("shard", F.col("page_id").isNotNull(), "page_id", "digest", "step", "url")
    ordered = ordered.select("shard", "page_id", "url", "payload", "size", "digest", "step", "first")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, told, first = Shards(out_dir, roll), None, None
        for batch in slices(batches, "payload"):
            for r in batch.to_pylist():
                page = (r["page_id"], r["digest"])
                if r["step"] == 0:
                    told, first = page, r["first"]
                    continue
                data = record(r["page_id"], r["url"], r["payload"], r["size"], r["digest"], first if page == told else None, date)
                out.write(r["shard"], compressed(data))
        out.close()
        names = ["file", "shard", "part", "records", "bytes", "sha256"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out.done, strict=True), kinds, strict=True)], names)

    listed = ordered.mapInArrow(work, "file string, shard bigint, part bigint, records bigint, bytes bigint, sha256 string")
    listed.write.parquet(f"{out_dir}/manifest")
    return spark.read.schema(listed.schema).parquet(f"{out_dir}/manifest")


def members(stream, digest) -> Iterator[bytes]:
    """The gzip members of a stream, one after another; digest is updated with all that is read."""
    z, data, parts = zlib.decompressobj(31), b"", []
    while True:
        if not data:
            data = stream.read(1 << 20)
            digest.update(data)
        if not data:
            if parts:
                raise ValueError("the last record is cut off")
            return
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []


def parsed(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record, with its digests verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is wrong")
    number = lambda x: None if x == "<urn:page:none>" else int(x[10:-1])
    refers = fields.get("WARC-Refers-To")
    return number(fields["WARC-Record-ID"]), size, digest, kind, None if refers is None else number(refers)


def read_warc(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row per record of the files that a manifest lists; wrong digests, of a record or a whole file, or counts end the job."""
    files, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    count = max(1, size // ROLL_BYTES, min(files, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for listed in batch.to_pylist():
                files, path = filesystem(listed["file"])
                rows, n, digest = [], 0, hashlib.sha256()
                with files.open_input_stream(path, compression=None) as stream:
                    for data in members(stream, digest):
                        rows.append(parsed(data))
                        n += 1
                        if len(rows) == 1000:
                            yield batch_of(rows)
                            rows = []
                if n != listed["records"]:
                    raise ValueError(f"{listed['file']} has {n} records instead of {listed['records']}")
                if digest.hexdigest() != listed["sha256"]:
                    raise ValueError(f"the digest of {listed['file']} is wrong")
                if rows:
                    yield batch_of(rows)

    listed = manifest.select("file", "records", "sha256").repartition(count)
    return listed.mapInArrow(work, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written as WARC and read back."""
    return read_warc(spark, write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc")))


OP6_SQL = f"""
WITH a AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
b AS (SELECT page_id, octet_length(p) AS payload_bytes, sha256(p) AS payload_digest, min(page_id) OVER (PARTITION BY p) AS lead FROM a),
c AS (SELECT *, payload_bytes >= {LEAST_REVISIT} AND page_id > lead AS again FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN lead END AS refers_to FROM c
"""
