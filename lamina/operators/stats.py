"""Counts, sums and ratios of a catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.schema import STORAGE_METHODS


def total(column: str) -> Column:
    """A sum that is 0 over nothing."""
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def beside(*rows: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    return reduce(lambda a, b: a.join(b, how="cross"), rows)


def object_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return beside(*(table.agg(F.count("*").alias(f"{name}_count")) for name, table in tables.items()))


def size_sums(blob: DataFrame, chunk: DataFrame, pack: DataFrame) -> DataFrame:
    """Raw and stored sizes of blobs by storage, of chunks, and of all files of the store."""
    direct, chunked = F.col("storage_method") == 1, F.col("storage_method") == 2
    sums = {f"{name}_{size}": F.coalesce(F.sum(F.when(which, F.col(f"{size}_size"))), F.lit(0)).cast("long") for name, which in (("all", F.lit(True)), ("direct", direct), ("chunked", chunked)) for size in ("raw", "stored")}
    blobs = blob.agg(*(c.alias(f"blob_{k}") for k, c in sums.items()))
    out = beside(blobs, chunk.agg(total("raw_size").alias("chunk_raw"), total("stored_size").alias("chunk_stored")), pack.agg(total("size").alias("pack_size")))
    return out.withColumn("store_size", F.col("blob_direct_stored") + F.col("pack_size"))


def pack_overview(pack: DataFrame) -> DataFrame:
    return pack.agg(F.count("*").alias("packs"), total("size").alias("size"), total("entry_count").alias("entries"), total("live_size").alias("live_size"), total("live_entry_count").alias("live_entries"))


def pack_live(pack: DataFrame, chunk: DataFrame) -> DataFrame:
    """pack_id, live_size, live_entries of every pack, 0 without chunks."""
    live = chunk.groupBy("pack_id").agg(F.sum("stored_size").alias("live_size"), F.count("*").alias("live_entries"))
    return pack.select(F.col("id").alias("pack_id")).join(live, "pack_id", "left").na.fill(0)


def by_storage(blob: DataFrame) -> DataFrame:
    """storage_method, blobs, raw, stored for each known method, unknown values as 0."""
    spark = blob.sparkSession
    known = spark.createDataFrame([(k,) for k in STORAGE_METHODS], "storage_method int")
    method = F.when(F.col("storage_method").isin(*STORAGE_METHODS), F.col("storage_method")).otherwise(0)
    sums = blob.groupBy(method.alias("storage_method")).agg(F.count("*").alias("blobs"), F.sum("raw_size").alias("raw"), F.sum("stored_size").alias("stored"))
    return F.broadcast(known).join(sums, "storage_method", "left").na.fill(0)


def dedup_ratios(file: DataFrame, blob: DataFrame, backup_refs: DataFrame) -> DataFrame:
    """Objects against references at each level, as shares; null over nothing."""
    files = file.agg(F.count("*").alias("files"), F.count("blob_hash").alias("blob_refs"))
    blobs = blob.agg(F.count("*").alias("blobs"), total("raw_size").alias("raw"), total("stored_size").alias("stored"))
    both = beside(files, blobs, backup_refs.agg(total("file_count").alias("file_refs")))
    return both.select(
        F.round(F.expr("try_divide(file_refs - files, file_refs)"), 6).alias("file_dedup"),
        F.round(F.expr("try_divide(blob_refs - blobs, blob_refs)"), 6).alias("blob_dedup"),
        F.round(F.expr("try_divide(stored, raw)"), 6).alias("compression"),
    )


def unique_stored(rows: DataFrame, owner: str) -> DataFrame:
    """owner, stored: each content once an owner."""
    return rows.select(owner, "hash", "stored_size").distinct().groupBy(owner).agg(F.sum("stored_size").cast("long").alias("stored"))


def summary_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a collection freed: never negative."""
    a = old.agg(F.count("*").alias("c0"), total("stored_size").alias("s0"))
    b = new.agg(F.count("*").alias("c1"), total("stored_size").alias("s1"))
    zero = F.lit(0).cast("long")
    return beside(a, b).select(F.greatest(zero, F.col("c0") - F.col("c1")).alias("freed_count"), F.greatest(zero, F.col("s0") - F.col("s1")).alias("freed_size"))


def overview(t: dict[str, DataFrame], version: int, hash_method: str, catalog_bytes: int) -> DataFrame:
    """One row: counts and sizes of the whole catalog; `t` has its tables by name."""
    direct, chunked = F.col("storage_method") == 1, F.col("storage_method") == 2
    part = lambda which, size: F.coalesce(F.sum(F.when(which, F.col(size))), F.lit(0)).cast("long")
    blob = t["blob"].agg(
        F.count("*").alias("blob_count"), F.count_if(direct).alias("direct_blob_count"), F.count_if(chunked).alias("chunked_blob_count"), total("stored_size").alias("blob_stored_size_sum"),
        total("raw_size").alias("blob_raw_size_sum"), *(part(which, f"{size}_size").alias(f"{name}_blob_{size}_size_sum") for name, which in (("direct", direct), ("chunked", chunked)) for size in ("stored", "raw")),
    )
    refs = t["blob_binding"].join(t["chunk_group"].select(F.col("id").alias("chunk_group_id"), "chunk_count"), "chunk_group_id").join(t["blob"].where(chunked).select(F.col("id").alias("blob_id")), "blob_id", "left_semi")
    return beside(
        blob, t["chunk"].agg(F.count("*").alias("chunk_count"), total("raw_size").alias("chunk_raw_size_sum"), total("stored_size").alias("chunk_stored_size_sum")),
        t["chunk_group"].agg(F.count("*").alias("chunk_group_count")), t["chunk_binding"].agg(F.count("*").alias("chunk_group_chunk_binding_count")), t["blob_binding"].agg(F.count("*").alias("blob_chunk_group_binding_count")),
        t["file"].agg(F.count("*").alias("file_object_count")), t["fileset"].agg(F.count("*").alias("fileset_count")),
        t["backup"].agg(F.count("*").alias("backup_count"), total("file_count").alias("file_total_count"), total("file_raw_size_sum").alias("file_raw_size_sum")), refs.agg(total("chunk_count").alias("chunked_blob_chunk_count")),
        t["pack"].agg(F.count("*").alias("pack_count"), total("size").alias("pack_size_sum"), total("live_size").alias("pack_live_size_sum"), total("live_entry_count").alias("pack_live_entry_count_sum")),
    ).select(F.lit(version).alias("db_version"), F.lit(hash_method).alias("hash_method"), "*", F.lit(catalog_bytes).cast("long").alias("db_file_size"))


def blocks(size: Column, block: int = 4096) -> Column:
    """How many blocks a size takes."""
    return F.ceil(size / block).cast("long")
