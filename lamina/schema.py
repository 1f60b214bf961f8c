"""Tables of a snapshot catalog, their enumerations, and migrations between schema versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 4
#: Fixed values of the data model.
STORAGE_METHODS = {0: "unknown", 1: "direct", 2: "chunked"}
ROLE_UNKNOWN, ROLE_STANDALONE, ROLE_OVERRIDE, ROLE_ADD, ROLE_REMOVE = range(5)
COMPRESS_METHODS = ("plain", "gzip", "lzma", "zstd", "lz4")
HASH_LENGTHS = {"xxh128": 32, "md5": 32, "sha256": 64, "blake3": 64}
TYPE_MASK, REGULAR, DIRECTORY, SYMLINK = 0xF000, 0x8000, 0x4000, 0xA000

#: Columns of each table, as DDL.
SCHEMAS: dict[str, str] = {
    "db_meta": "magic int, version int, hash_method string",
    "pack": "id int, size bigint, entry_count int, live_size bigint, live_entry_count int",
    "blob": "id int, storage_method int, hash string, compress string, raw_size bigint, stored_size bigint",
    "chunk": "id int, hash string, compress string, raw_size bigint, stored_size bigint, pack_id int, pack_offset bigint",
    "chunk_group": "id int, hash string, chunk_count int, chunk_raw_size_sum bigint, chunk_stored_size_sum bigint",
    "chunk_group_chunk_binding": "chunk_group_id int, chunk_offset bigint, chunk_id int",
    "blob_chunk_group_binding": "blob_id int, chunk_group_offset bigint, chunk_group_id int",
    "file": "fileset_id int, path string, role int, mode int, content binary, blob_id int, blob_storage_method int, blob_hash string, blob_compress string, "
    "blob_raw_size bigint, blob_stored_size bigint, uid int, gid int, mtime bigint, mtime_ns_part int",
    "fileset": "id int, base_id int, file_object_count bigint, file_count bigint, file_raw_size_sum bigint, file_stored_size_sum bigint",
    "backup": "id int, timestamp bigint, timestamp_ns_part int, creator string, comment string, targets array<string>, tags string, fileset_id_base int, fileset_id_delta int, "
    "file_count bigint, file_raw_size_sum bigint, file_stored_size_sum bigint",
}


def migrate_1_2(backup: DataFrame) -> DataFrame:
    """Renames the tag key pre_restore_backup to temporary in the tags map."""
    return backup.withColumn("tags", F.transform_keys("tags", lambda k, _: F.when(k == "pre_restore_backup", F.lit("temporary")).otherwise(k)))


def migrate_3_4_file(file: DataFrame, blob: DataFrame) -> DataFrame:
    """Fills blob_id by hash and splits microsecond mtimes into seconds and a nanosecond part."""
    ids = blob.select(F.col("id").alias("blob_id"), F.col("hash").alias("blob_hash"))
    return (
        file.drop("blob_id")
        .join(ids, "blob_hash", "left")
        .withColumn("mtime_ns_part", (F.col("mtime") % 1_000_000 * 1000).cast("int"))
        .withColumn("mtime", F.floor(F.col("mtime") / 1_000_000).cast("long"))
    )
