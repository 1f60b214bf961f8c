"""Content: hashing, chunking, grouping, deduplication, verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Chunk sizes, windows of the adaptive method, cut rules of groups, parameters (average, least, most).
FIXED = {"fixed_4k": 4 << 10, "fixed_32k": 32 << 10, "fixed_128k": 128 << 10, "fixed_1m": 1 << 20}
AUTO_BIG, AUTO_SMALL = 128 << 10, 4 << 10
GROUP_LEAST, GROUP_MOST, GROUP_END = 64, 1024, "00"
CDC = {"fastcdc_32k": (32 << 10, 8 << 10, 256 << 10), "fastcdc_128k": (128 << 10, 32 << 10, 1 << 20), "fastcdc_1m": (1 << 20, 256 << 10, 4 << 20)}


def content_hash(data: Column, method: str) -> Column:
    """Lower-case hex digest of binary data."""
    if method == "md5":
        return F.md5(data)
    if method == "sha256":
        return F.sha2(data, 256)
    if method == "xxh128":
        import xxhash

        @F.arrow_udf("string")
        def xxh128(values: pa.Array) -> pa.Array:
            return pa.array([None if x is None else xxhash.xxh3_128_hexdigest(x) for x in values.to_pylist()], pa.string())

        return xxh128(data)
    raise ValueError(f"no such hash here: {method}")


def fixed_chunks(contents: DataFrame, size: int) -> DataFrame:
    """key, offset, length, hash of `contents` (key, data): no data leaves the JVM."""
    last = F.greatest(F.octet_length("data") - 1, F.lit(0))
    offsets = contents.where(F.octet_length("data") > 0).select("key", "data", F.explode(F.sequence(F.lit(0), last, F.lit(size))).alias("offset"))
    piece = F.substr("data", F.col("offset") + 1, F.lit(size))
    return offsets.select("key", F.col("offset").cast("long").alias("offset"), piece.alias("piece")).select("key", "offset", F.octet_length("piece").cast("long").alias("length"), F.md5("piece").alias("hash"))


def adaptive_chunks(contents: DataFrame, previous: DataFrame, big: int = AUTO_BIG, small: int = AUTO_SMALL) -> DataFrame:
    """key, offset, length, hash with windows of `big` bytes that split into `small` ones where they change.

    Against the previous chunks (key, offset, length, hash): a window kept whole with the same hash stays
    whole, with another hash splits; a window kept split merges if no part changed, else stays split; any
    other full window is whole, and a short tail is one chunk.
    """
    wide = fixed_chunks(contents, big)
    narrow = fixed_chunks(contents, small).withColumn("window", (F.floor(F.col("offset") / big) * big).cast("long"))
    before_big = previous.where(F.col("length") == big).select("key", "offset", F.col("hash").alias("before"))
    before_small = previous.where((F.col("length") == small)).select("key", "offset", F.col("hash").alias("before"))
    parts = narrow.join(before_small, ["key", "offset"], "left")
    states = parts.groupBy("key", "window").agg(F.count("before").alias("had"), F.count_if(F.col("before") != F.col("hash")).alias("changed"))
    decided = wide.join(before_big, ["key", "offset"], "left").join(states.withColumnRenamed("window", "offset"), ["key", "offset"], "left")
    full = F.col("length") == big
    splits = full & ((F.col("before").isNotNull() & (F.col("before") != F.col("hash"))) | (F.col("before").isNull() & (F.col("had") == big // small) & (F.col("changed") > 0)))
    decided = decided.withColumn("split", F.coalesce(splits, F.lit(False)))
    whole = decided.where("not split").select("key", "offset", "length", "hash")
    cut = narrow.join(decided.where("split").select("key", F.col("offset").alias("window")), ["key", "window"], "left_semi")
    return whole.unionByName(cut.select("key", "offset", "length", "hash"))


def _gear() -> np.ndarray:
    """256 numbers of 64 bits from a seeded generator."""
    return np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def cut_points(data: bytes, average: int, least: int, most: int) -> list[int]:
    """Ends of content-defined chunks: a gear hash with a stricter mask before the average size and a looser one after."""
    gear = _gear()
    bits = max(average.bit_length() - 1, 2)
    strict, loose = np.uint64(((1 << (bits + 1)) - 1) << (62 - bits)), np.uint64(((1 << (bits - 1)) - 1) << (64 - bits))
    values = gear[np.frombuffer(data, np.uint8)]
    rolling = np.zeros(len(data), np.uint64)
    for back in range(min(64, len(data))):  # the hash of the last 64 bytes, oldest shifted furthest
        rolling[back:] += values[: len(data) - back] << np.uint64(back)
    hard, soft = np.flatnonzero((rolling & strict) == 0), np.flatnonzero((rolling & loose) == 0)
    ends, at = [], 0
    while at < len(data):
        low, mid, high = at + least, min(at + average, len(data)), min(at + most, len(data))
        end = high
        if low < len(data):
            i = np.searchsorted(hard, low)
            if i < len(hard) and hard[i] < mid:
                end = int(hard[i]) + 1
            else:
                i = np.searchsorted(soft, max(low, mid))
                if i < len(soft) and soft[i] < high:
                    end = int(soft[i]) + 1
        ends.append(end)
        at = end
    return ends


def cdc_chunks(contents: DataFrame, method: str) -> DataFrame:
    """key, offset, length, hash of content-defined chunks."""
    average, least, most = CDC[method]

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for part in parts:
            rows = []
            for key, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                at = 0
                for end in cut_points(data or b"", average, least, most):
                    rows.append((key, at, end - at, hashlib.md5(data[at:end]).hexdigest()))
                    at = end
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], part.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["key", "offset", "length", "hash"])

    kind = contents.schema["key"].dataType.simpleString()
    return contents.select("key", F.col("data").cast("binary")).mapInArrow(cut, f"key {kind}, offset long, length long, hash string")


def chunk_groups(chunks: DataFrame) -> DataFrame:
    """key, group, first_offset, chunk_count, raw_size, hash: runs of chunks cut by content.

    A run ends after a chunk once it has GROUP_LEAST of them and the chunk's hash ends in GROUP_END, or at
    GROUP_MOST.  The fold runs over one content's ordered chunks.
    """
    ordered = chunks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "hash"))).alias("c"))
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("size"), F.lit(0).alias("seen"))

    def step(state: Column, chunk: Column) -> Column:
        size = state["size"] + 1
        cut = (size >= GROUP_MOST) | ((size >= GROUP_LEAST) & chunk["hash"].endswith(GROUP_END))
        seen = state["seen"] + 1
        return F.struct(F.when(cut, F.array_append(state["ends"], seen)).otherwise(state["ends"]).alias("ends"), F.when(cut, 0).otherwise(size).alias("size"), seen.alias("seen"))

    def finish(state: Column) -> Column:
        return F.when(state["size"] > 0, F.array_append(state["ends"], state["seen"])).otherwise(state["ends"])

    cut = ordered.select("key", "c", F.aggregate("c", start, step, finish).alias("ends"))
    runs = cut.select("key", "c", "ends", F.posexplode("ends").alias("group", "end"))
    first = F.when(F.col("group") == 0, 0).otherwise(F.get("ends", F.col("group") - 1))
    members = runs.withColumn("m", F.slice("c", first + 1, F.col("end") - first))
    return members.select(
        "key", "group", F.get("m", F.lit(0))["offset"].alias("first_offset"), F.size("m").alias("chunk_count"),
        F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("raw_size"), group_hash(F.transform("m", lambda x: x["hash"])).alias("hash"),
    )


def group_hash(hashes: Column) -> Column:
    """Digest of the chunks' hashes, joined by zero characters."""
    return F.sha2(F.array_join(hashes, "\0"), 256)


def new_objects(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """hash, raw_size of incoming contents that are not stored yet, each once."""
    return incoming.select("hash", "raw_size").distinct().join(existing.select("hash"), "hash", "left_anti")


def churn(incoming: DataFrame, existing: DataFrame, least: int = 5000, share: float = 0.6) -> DataFrame:
    """key, fresh, chunks of contents most of whose distinct chunks are new."""
    known = existing.select("hash", F.lit(True).alias("known")).distinct()
    rows = incoming.select("key", "hash").distinct().join(known, "hash", "left")
    counts = rows.groupBy("key").agg(F.count_if(F.col("known").isNull()).alias("fresh"), F.count("*").alias("chunks"))
    return counts.where(F.col("fresh") >= F.greatest(F.lit(least), F.col("chunks") * share))


def verify(contents: DataFrame, expected: DataFrame) -> DataFrame:
    """key, kind: contents (key, data) whose size, then hash, is not the expected one (key, raw_size, hash)."""
    rows = expected.join(contents, "key", "left")
    kind = F.when(F.col("data").isNull(), "missing").when(F.octet_length("data") != F.col("raw_size"), "size").when(F.md5("data") != F.col("hash"), "hash")
    return rows.select("key", kind.alias("kind")).where("kind is not null")


def rehash_collisions(rows: DataFrame) -> DataFrame:
    """new_hash, ids: new hashes that several objects would share, or that is another object's old hash."""
    twice = rows.groupBy("new_hash").agg(F.count_distinct("id").alias("ids")).where("ids > 1")
    old = rows.select(F.col("hash").alias("new_hash"), F.col("id").alias("old_id"))
    crossed = rows.join(old, "new_hash").where("id <> old_id").groupBy("new_hash").agg(F.count_distinct("id").alias("ids"))
    return twice.unionByName(crossed).groupBy("new_hash").agg(F.max("ids").alias("ids"))


def cascade(chunk: DataFrame, chunk_bindings: DataFrame, blob_bindings: DataFrame) -> DataFrame:
    """blob_id, stored: unique stored size of each chunked blob after its chunks were stored anew."""
    bound = chunk_bindings.join(chunk.select(F.col("id").alias("chunk_id"), "hash", "stored_size"), "chunk_id")
    each = blob_bindings.select("blob_id", "chunk_group_id").distinct().join(bound, "chunk_group_id").select("blob_id", "hash", "stored_size").distinct()
    return each.groupBy("blob_id").agg(F.sum("stored_size").cast("long").alias("stored"))


def row_numbered(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("position", F.row_number().over(Window.partitionBy("key").orderBy("offset")))
