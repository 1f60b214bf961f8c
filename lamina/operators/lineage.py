"""Who holds whom: groups of chunks, blobs of groups, and what depends on an object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.schema import ROLE_ADD, ROLE_OVERRIDE, ROLE_REMOVE


def group_chunks(bindings: DataFrame, chunk: DataFrame) -> DataFrame:
    """chunk_group_id, chunk_offset and the chunk's columns."""
    return bindings.join(chunk, bindings["chunk_id"] == chunk["id"]).select("chunk_group_id", "chunk_offset", "chunk_id", "hash", "raw_size", "stored_size")


def blob_groups(bindings: DataFrame, groups: DataFrame) -> DataFrame:
    return bindings.join(groups, bindings["chunk_group_id"] == groups["id"]).select("blob_id", "chunk_group_offset", "chunk_group_id", "chunk_count", "chunk_raw_size_sum")


def blob_chunks(blob_bindings: DataFrame, chunk_bindings: DataFrame, chunk: DataFrame) -> DataFrame:
    """blob_id, absolute offset and chunk: two equi-joins, the group's offset plus the chunk's."""
    return blob_bindings.join(group_chunks(chunk_bindings, chunk), "chunk_group_id").select(
        "blob_id", (F.col("chunk_group_offset") + F.col("chunk_offset")).alias("offset"), "chunk_id", "hash", "raw_size", "stored_size"
    )


def chunk_at(positions: DataFrame, chunks: DataFrame) -> DataFrame:
    """For (blob_id, position): the chunk whose [offset, offset + raw_size) holds it; the blob drives the join."""
    return positions.join(chunks, "blob_id").where((F.col("position") >= F.col("offset")) & (F.col("position") < F.col("offset") + F.col("raw_size")))


def fileset_backups(backup: DataFrame) -> DataFrame:
    """fileset_id, backup_id: base or delta, as a union of two projections."""
    return backup.select(F.col("fileset_id_base").alias("fileset_id"), F.col("id").alias("backup_id")).union(backup.select("fileset_id_delta", "id")).distinct()


def containing_pairs(files: DataFrame, file: DataFrame, backup: DataFrame) -> DataFrame:
    """fileset_id, path, base, delta: the views (base, delta) of snapshots that show a file of a fileset.

    A base's file shows unless the delta has a role for its path; a delta's shows in its own.  Snapshots that
    share a view are settled once.
    """
    pairs = backup.select(F.col("fileset_id_base").alias("base"), F.col("fileset_id_delta").alias("delta")).distinct()
    covers = file.where(F.col("role").isin(ROLE_OVERRIDE, ROLE_ADD, ROLE_REMOVE)).select(F.col("fileset_id").alias("delta"), "path")
    base = files.join(pairs, F.col("fileset_id") == F.col("base")).join(covers, ["delta", "path"], "left_anti")
    own = files.join(pairs, F.col("fileset_id") == F.col("delta"))
    columns = ("fileset_id", "path", "base", "delta")
    return base.select(*columns).union(own.select(*columns)).distinct()


def containing_file(files: DataFrame, file: DataFrame, backup: DataFrame) -> DataFrame:
    """fileset_id, path, backup_id: snapshots that show a file of a fileset.

    Snapshots are the left side: each meets the files of its view in turn.  A shuffle join then holds a view's
    files, not its snapshots, and a snapshot's rows come together, so that its id costs next to nothing when written.
    """
    own = backup.select(F.col("id").alias("backup_id"), F.col("fileset_id_base").alias("base"), F.col("fileset_id_delta").alias("delta"))
    return own.join(containing_pairs(files, file, backup), ["base", "delta"]).select("fileset_id", "path", "backup_id")


def containing_counts(files: DataFrame, file: DataFrame, backup: DataFrame) -> DataFrame:
    """fileset_id, path, backups, first: how many snapshots show a file, and the smallest id; no row per snapshot is made."""
    views = backup.groupBy(F.col("fileset_id_base").alias("base"), F.col("fileset_id_delta").alias("delta")).agg(F.count("*").alias("n"), F.min("id").alias("least"))
    return containing_pairs(files, file, backup).join(views, ["base", "delta"]).groupBy("fileset_id", "path").agg(F.sum("n").alias("backups"), F.min("least").alias("first"))


def affected(chunks: DataFrame, chunk_bindings: DataFrame, blob_bindings: DataFrame, file: DataFrame, backup: DataFrame) -> DataFrame:
    """kind, id: groups, blobs, filesets and snapshots that depend on `chunks` (id)."""
    groups = chunk_bindings.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").select(F.col("chunk_group_id").alias("id")).distinct()
    blobs = blob_bindings.join(groups.select(F.col("id").alias("chunk_group_id")), "chunk_group_id", "left_semi").select(F.col("blob_id").alias("id")).distinct()
    filesets = file.join(blobs.select(F.col("id").alias("blob_id")), "blob_id", "left_semi").select(F.col("fileset_id").alias("id")).distinct()
    backups = fileset_backups(backup).join(filesets.select(F.col("id").alias("fileset_id")), "fileset_id", "left_semi").select(F.col("backup_id").alias("id")).distinct()
    parts = [found.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id")) for kind, found in (("chunk_group", groups), ("blob", blobs), ("fileset", filesets), ("backup", backups))]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
