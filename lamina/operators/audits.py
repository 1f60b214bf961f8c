"""Integrity audits: every violation is a row (key, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.content import group_hash
from lamina.operators.layout import gaps
from lamina.operators.lineage import group_chunks
from lamina.schema import COMPRESS_METHODS, REGULAR, ROLE_ADD, ROLE_OVERRIDE, ROLE_REMOVE, ROLE_STANDALONE, STORAGE_METHODS, SYMLINK, TYPE_MASK


def first_of(*checks: tuple[Column, str]) -> Column:
    """Kind of the first check that fires."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(checks):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def _bad(rows: DataFrame, key: str) -> DataFrame:
    return rows.where("kind is not null").select(F.col(key).cast("long").alias("id"), "kind")


def orphans(table: DataFrame, key: str, holders: DataFrame, held: str) -> DataFrame:
    """The rows of `table` whose key no holder holds."""
    return table.join(holders.select(F.col(held).alias(key)).distinct(), key, "left_anti")


def orphan_filesets(fileset: DataFrame, backup: DataFrame) -> DataFrame:
    used = backup.select(F.col("fileset_id_base").alias("id")).union(backup.select("fileset_id_delta"))
    return fileset.join(used.distinct(), "id", "left_anti")


def orphan_chunk_bindings(bindings: DataFrame, groups: DataFrame, chunk: DataFrame) -> DataFrame:
    """Bindings whose group or chunk is gone."""
    whole = bindings.join(groups.select(F.col("id").alias("chunk_group_id")), "chunk_group_id", "left_semi").join(chunk.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    keys = ["chunk_group_id", "chunk_offset", "chunk_id"]
    return bindings.select(*keys).join(whole.select(*keys), keys, "left_anti")


def bad_blob_bindings(bindings: DataFrame, blob: DataFrame, groups: DataFrame) -> DataFrame:
    """blob_id, chunk_group_offset, kind: orphan (blob or group gone) or bad_storage_method (the blob is not chunked)."""
    b = blob.select(F.col("id").alias("b_id"), "storage_method")
    g = groups.select(F.col("id").alias("g_id"))
    joined = bindings.join(b, F.col("blob_id") == F.col("b_id"), "left").join(g, F.col("chunk_group_id") == F.col("g_id"), "left")
    kind = first_of((F.col("b_id").isNull() | F.col("g_id").isNull(), "orphan"), (F.col("storage_method") != 2, "bad_storage_method"))
    return joined.select("blob_id", "chunk_group_offset", kind.alias("kind")).where("kind is not null")


def audit_packs(pack: DataFrame, chunk: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """missing_file and mismatched file sizes (with `store`: id, bytes), live beyond total, live unlike the chunks'."""
    live = chunk.groupBy("pack_id").agg(F.sum("stored_size").alias("sum_live"), F.count("*").alias("n_live"))
    rows = pack.join(live, F.col("id") == F.col("pack_id"), "left").na.fill(0, ["sum_live", "n_live"])
    checks = [
        (F.col("live_size") > F.col("size"), "live_size_beyond_size"), (F.col("live_entry_count") > F.col("entry_count"), "live_entries_beyond_entries"),
        (F.col("live_size") != F.col("sum_live"), "live_size_mismatched"), (F.col("live_entry_count") != F.col("n_live"), "live_entries_mismatched"),
    ]
    if store is not None:
        rows = rows.join(store.select(F.col("id").alias("s_id"), "bytes"), F.col("id") == F.col("s_id"), "left")
        checks = [(F.col("s_id").isNull(), "missing_file"), (F.col("bytes") != F.col("size"), "file_size_mismatched"), *checks]
    return _bad(rows.withColumn("kind", first_of(*checks)), "id")


def audit_blobs(blob: DataFrame, file: DataFrame, blob_bindings: DataFrame, groups: DataFrame, chunk_bindings: DataFrame, chunk: DataFrame) -> DataFrame:
    """invalid, bad_layout, mismatched and orphan blobs, in this order; contents are verified by `content.verify`."""
    invalid = ~F.col("storage_method").isin(*[m for m in STORAGE_METHODS if m]) | ~F.col("compress").isin(*COMPRESS_METHODS)
    g = groups.select(F.col("id").alias("chunk_group_id"), "chunk_raw_size_sum")
    bound = blob_bindings.join(g, "chunk_group_id", "left").na.fill(0, ["chunk_raw_size_sum"])
    raw = bound.groupBy("blob_id").agg(F.sum("chunk_raw_size_sum").alias("raw_sum"))
    stored = blob_bindings.join(group_chunks(chunk_bindings, chunk), "chunk_group_id").select("blob_id", "hash", "stored_size").distinct().groupBy("blob_id").agg(F.sum("stored_size").alias("stored_sum"))
    layout = gaps(bound, "blob_id", "chunk_group_offset", "chunk_raw_size_sum")
    held = file.where("blob_hash is not null").select(F.col("blob_hash").alias("hash"), F.lit(True).alias("held")).distinct()
    rows = blob.join(raw, F.col("id") == raw["blob_id"], "left").drop("blob_id").join(stored, F.col("id") == stored["blob_id"], "left").drop("blob_id").join(layout, F.col("id") == layout["blob_id"], "left").join(held, "hash", "left")
    chunked = F.col("storage_method") == 2
    kind = first_of(
        (invalid, "invalid"),
        (chunked & (F.col("bad").isNotNull() | F.col("raw_sum").isNull()), "bad_layout"),
        (chunked & ((F.col("raw_sum") != F.col("raw_size")) | (F.col("stored_sum") != F.col("stored_size"))), "mismatched"),
        (F.col("held").isNull(), "orphan"),
    )
    return _bad(rows.withColumn("kind", kind), "id")


def audit_chunks(chunk: DataFrame, pack: DataFrame, bindings: DataFrame) -> DataFrame:
    """invalid, missing_pack, bad_pack_entry (outside its pack) and orphan chunks."""
    p = pack.select(F.col("id").alias("p_id"), F.col("size").alias("p_size"))
    held = bindings.select(F.col("chunk_id").alias("h_id")).distinct()
    rows = chunk.join(p, F.col("pack_id") == F.col("p_id"), "left").join(held, F.col("id") == F.col("h_id"), "left")
    kind = first_of(
        (~F.col("compress").isin(*COMPRESS_METHODS) | (F.col("raw_size") < 0), "invalid"),
        (F.col("p_id").isNull(), "missing_pack"),
        ((F.col("pack_offset") < 0) | (F.col("pack_offset") + F.col("stored_size") > F.col("p_size")), "bad_pack_entry"),
        (F.col("h_id").isNull(), "orphan"),
    )
    return _bad(rows.withColumn("kind", kind), "id")


def audit_chunk_groups(groups: DataFrame, bindings: DataFrame, chunk: DataFrame, blob_bindings: DataFrame) -> DataFrame:
    """bad_layout, bad_chunk_stats (count, raw or unique stored sum) and orphan groups, in this order."""
    bound = group_chunks(bindings, chunk)
    sums = bound.groupBy("chunk_group_id").agg(F.count("*").alias("n"), F.sum("raw_size").alias("raw"))
    stored = bound.select("chunk_group_id", "hash", "stored_size").distinct().groupBy("chunk_group_id").agg(F.sum("stored_size").alias("stored"))
    layout = gaps(bound, "chunk_group_id", "chunk_offset", "raw_size")
    held = blob_bindings.select("chunk_group_id").distinct().withColumn("held", F.lit(True))
    rows = groups.withColumnRenamed("id", "chunk_group_id")
    for other in (sums, stored, layout, held):
        rows = rows.join(other, "chunk_group_id", "left")
    differs = F.coalesce("n", F.lit(0)) != F.col("chunk_count")
    differs = differs | (F.coalesce("raw", F.lit(0)) != F.col("chunk_raw_size_sum")) | (F.coalesce("stored", F.lit(0)) != F.col("chunk_stored_size_sum"))
    kind = first_of((F.col("bad").isNotNull(), "bad_layout"), (differs, "bad_chunk_stats"), (F.col("held").isNull(), "orphan"))
    return _bad(rows.withColumn("kind", kind), "chunk_group_id")


def audit_files(file: DataFrame, fileset: DataFrame, blob: DataFrame) -> DataFrame:
    """fileset_id, path, kind: every violation of a file is a row of its own."""
    b = blob.select(F.col("hash").alias("b_hash"), *(F.col(c).alias(f"b_{c}") for c in ("id", "storage_method", "compress", "raw_size", "stored_size")))
    s = fileset.select(F.col("id").alias("s_id"), F.col("base_id").alias("s_base"))
    rows = file.join(b, F.col("blob_hash") == F.col("b_hash"), "left").join(s, F.col("fileset_id") == F.col("s_id"), "left")
    bits = F.col("mode").bitwiseAND(TYPE_MASK)
    regular, link, removal = bits == REGULAR, bits == SYMLINK, F.col("role") == ROLE_REMOVE
    differs = F.lit(False)
    for c in ("id", "storage_method", "compress", "raw_size", "stored_size"):
        differs = differs | ~F.col(f"blob_{c}").eqNullSafe(F.col(f"b_{c}"))
    base = F.col("s_base") == 0
    delta_role = F.col("role").isin(ROLE_OVERRIDE, ROLE_ADD, ROLE_REMOVE)
    kinds = F.array_compact(
        F.array(
            F.when(~removal & ((regular & F.col("blob_hash").isNull()) | (~regular & F.col("blob_hash").isNotNull()) | (link & (F.coalesce(F.length("content"), F.lit(0)) == 0))), "invalid"),
            F.when(F.col("s_id").isNull(), "orphan"),
            F.when(F.col("blob_hash").isNotNull() & F.col("b_hash").isNull(), "bad_blob_relation"),
            F.when(F.col("s_id").isNotNull() & ((base & (F.col("role") != ROLE_STANDALONE)) | (~base & ~delta_role)), "bad_fileset_relation"),
            F.when(F.col("b_hash").isNotNull() & differs, "file_blob_mismatched"),
        )
    )
    return rows.select("fileset_id", "path", F.explode(kinds).alias("kind"))


def audit_filesets(fileset: DataFrame, file: DataFrame, backup: DataFrame) -> DataFrame:
    """bad_base_fileset, bad_file_stats and orphan filesets, in this order."""
    bases = fileset.select(F.col("id").alias("b_id"), F.col("base_id").alias("b_base"))
    counts = file.groupBy("fileset_id").agg(F.count("*").alias("n"))
    used = backup.select(F.col("fileset_id_base").alias("u_id")).union(backup.select("fileset_id_delta")).distinct()
    rows = (
        fileset.join(bases, F.col("base_id") == F.col("b_id"), "left").join(counts, F.col("id") == F.col("fileset_id"), "left").join(used, F.col("id") == F.col("u_id"), "left")
    )
    kind = first_of(
        ((F.col("base_id") != 0) & (F.col("b_id").isNull() | (F.col("b_base") != 0)), "bad_base_fileset"),
        (F.coalesce("n", F.lit(0)) != F.col("file_object_count"), "bad_file_stats"),
        (F.col("u_id").isNull(), "orphan"),
    )
    return _bad(rows.withColumn("kind", kind), "id")


def audit_file_roles(fileset: DataFrame, file: DataFrame) -> DataFrame:
    """bad_file_role: deltas that add a path which their base has, or override or remove one which it has not."""
    base = fileset.where("base_id = 0").select(F.col("id").alias("base_id"))
    deltas = fileset.where("base_id <> 0").join(base, "base_id", "left_semi").select("id", "base_id")
    had = file.select(F.col("fileset_id").alias("base_id"), "path", F.lit(True).alias("had")).distinct()
    rows = file.where(F.col("role").isin(ROLE_OVERRIDE, ROLE_ADD, ROLE_REMOVE)).select(F.col("fileset_id").alias("id"), "path", "role").join(deltas, "id").join(had, ["base_id", "path"], "left")
    bad = (F.col("role") == ROLE_ADD) == F.col("had").isNotNull()
    return _bad(rows.where(bad).select("id").distinct().withColumn("kind", F.lit("bad_file_role")), "id")


def audit_group_hashes(groups: DataFrame, bindings: DataFrame, chunk: DataFrame) -> DataFrame:
    """bad_layout: groups whose hash is not that of their chunks' hashes in order; groups without chunks hash nothing."""
    bound = group_chunks(bindings, chunk).groupBy("chunk_group_id").agg(F.sort_array(F.collect_list(F.struct("chunk_offset", "hash"))).alias("c"))
    want = bound.select(F.col("chunk_group_id").alias("id"), group_hash(F.col("c.hash")).alias("want"))
    rows = groups.join(want, "id", "left").withColumn("want", F.coalesce("want", group_hash(F.array().cast("array<string>"))))
    return _bad(rows.withColumn("kind", F.when(~F.col("hash").eqNullSafe(F.col("want")), "bad_layout")), "id")


def audit_stored(objects: DataFrame, store: DataFrame) -> DataFrame:
    """missing, mismatched (size) and corrupted (hash), the first of them, of objects (id, hash, raw_size) against a store (hash, data).

    `store` names each file by the hash it was stored under; `data` is its content as read.
    """
    read = store.select("hash", F.octet_length(F.col("data").cast("binary")).alias("bytes"), F.md5(F.col("data").cast("binary")).alias("found"))
    rows = objects.join(read, "hash", "left")
    kind = first_of((F.col("found").isNull(), "missing"), (F.col("bytes") != F.col("raw_size"), "mismatched"), (F.col("found") != F.col("hash"), "corrupted"))
    return _bad(rows.withColumn("kind", kind), "id")


def audit_backups(backup: DataFrame, fileset: DataFrame) -> DataFrame:
    """missing_base, base_not_base, missing_delta, delta_of_other_base, bad_file_count and bad_sizes, the first of them."""
    s = fileset.select("id", "base_id", "file_count", "file_raw_size_sum", "file_stored_size_sum")
    b, d = s.toDF(*(f"b_{c}" for c in s.columns)), s.toDF(*(f"d_{c}" for c in s.columns))
    rows = backup.join(b, F.col("fileset_id_base") == F.col("b_id"), "left").join(d, F.col("fileset_id_delta") == F.col("d_id"), "left")
    kind = first_of(
        (F.col("b_id").isNull(), "missing_base"),
        (F.col("b_base_id") != 0, "base_not_base"),
        (F.col("d_id").isNull(), "missing_delta"),
        (F.col("d_base_id") != F.col("b_id"), "delta_of_other_base"),
        (F.col("b_file_count") + F.col("d_file_count") != F.col("file_count"), "bad_file_count"),
        ((F.col("b_file_raw_size_sum") + F.col("d_file_raw_size_sum") != F.col("file_raw_size_sum")) | (F.col("b_file_stored_size_sum") + F.col("d_file_stored_size_sum") != F.col("file_stored_size_sum")), "bad_sizes"),
    )
    return _bad(rows.withColumn("kind", kind), "id")


def by_kind(violations: DataFrame) -> DataFrame:
    return violations.groupBy("kind").agg(F.count("*").alias("bad"))


def unknown_objects(listing: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """files, bytes of a store listing (key, bytes) that the catalog does not know."""
    return listing.join(known.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))
