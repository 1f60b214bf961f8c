"""Offsets of chunks in groups, groups in blobs, entries in packs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def expected_offset(size: str, owner: list[str], by: list) -> Column:
    """Sum of the sizes before a row in its owner's order."""
    return F.coalesce(F.sum(size).over(Window.partitionBy(*owner).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def gaps(rows: DataFrame, owner: str, offset: str, size: str) -> DataFrame:
    """owner, bad: number of rows whose offset is not the sum of the sizes before."""
    want = rows.withColumn("want", expected_offset(size, [owner], [offset]))
    return want.groupBy(owner).agg(F.count_if(F.col("want") != F.col(offset)).alias("bad")).where("bad > 0")


def build(rows: DataFrame, owner: str, by: list[str], size: str) -> DataFrame:
    """The rows with the offsets that a packed layout gives them."""
    return rows.withColumn("offset", expected_offset(size, [owner], by))


def overlaps(chunk: DataFrame, pack: DataFrame) -> DataFrame:
    """chunk id, kind: entries that begin before the previous one ends, or end beyond the pack."""
    own = Window.partitionBy("pack_id").orderBy("pack_offset", "id")
    ends = chunk.withColumn("end", F.col("pack_offset") + F.col("stored_size")).withColumn("before", F.lag("end").over(own))
    sized = ends.join(pack.select(F.col("id").alias("pack_id"), F.col("size").alias("pack_size")), "pack_id")
    return sized.select("id", F.when(F.col("before") > F.col("pack_offset"), "overlap").when(F.col("end") > F.col("pack_size"), "beyond").alias("kind")).where("kind is not null")


#: Fixed value: what a pack's name is derived from, ahead of its id.
NAME = "PBPK_"


def pack_name(pack_id: Column) -> Column:
    """File name of a pack: derived from its id, so that names never repeat."""
    return F.sha2(F.concat(F.lit(NAME), pack_id.cast("string")), 256)


def compactable(pack: DataFrame, threshold: float) -> DataFrame:
    """Packs whose live share is below the threshold; empty ones without live entries; full ones never."""
    if threshold < 0:
        raise ValueError("the threshold must not be negative")
    empty = (F.col("size") <= 0) & (F.col("live_entry_count") == 0)
    sparse = (F.col("size") > 0) & (F.col("live_size") < F.col("size")) & (F.expr("try_divide(live_size, size)") < threshold)
    return pack.where(empty | sparse)


#: Bytes and entries from which a pack takes no more, and bytes from which an entry has a pack of its own.
PACK_BYTES, PACK_ENTRIES, OWN_PACK = 16 << 20, 4096, 8 << 20


def pack_entries(rows: DataFrame, by: list[str], largest: int = PACK_BYTES, most: int = PACK_ENTRIES, own: int = OWN_PACK) -> DataFrame:
    """writer, id, new_pack, new_offset of entries `rows` (writer, id, stored_size and the columns of `by`).

    Each writer takes its entries in the order of `by`.  Before an entry it opens a new pack if the present one
    has reached `largest` bytes or `most` entries; an entry of at least `own` bytes gets a pack of its own, and
    the present one stays open.  Packs of a writer are numbered from 1 as they are opened.  A writer is one
    pass over sorted rows that keeps four numbers; deal large tables to many writers.
    """

    def laid(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, opened, number, size, entries = None, 0, 0, 0, 0
        for part in parts:
            packs, offsets = [], []
            for writer, bytes_ in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                if writer != present:
                    present, opened, number, size, entries = writer, 0, 0, 0, 0
                if bytes_ >= own:
                    opened += 1
                    packs.append(opened)
                    offsets.append(0)
                    continue
                if not number or size >= largest or entries >= most:
                    opened += 1
                    number, size, entries = opened, 0, 0
                packs.append(number)
                offsets.append(size)
                size, entries = size + bytes_, entries + 1
            yield pa.RecordBatch.from_pydict({"writer": part.column(0), "id": part.column(1), "new_pack": pa.array(packs, pa.int64()), "new_offset": pa.array(offsets, pa.int64())})

    dealt = rows.repartition("writer").sortWithinPartitions("writer", *by)
    return dealt.select(F.col("writer").cast("long"), F.col("id").cast("long"), F.col("stored_size").cast("long")).mapInArrow(laid, "writer long, id long, new_pack long, new_offset long")


def compaction(chunk: DataFrame, packs: DataFrame, writers: int = 1, largest: int = PACK_BYTES, most: int = PACK_ENTRIES, own: int = OWN_PACK) -> DataFrame:
    """writer, id, new_pack, new_offset: live entries of the packs, in the order of packs and offsets, laid into new packs."""
    live = chunk.join(packs.select(F.col("id").alias("pack_id")), "pack_id", "left_semi").withColumn("writer", F.pmod("pack_id", F.lit(writers)))
    return pack_entries(live.select("writer", "id", "stored_size", "pack_id", "pack_offset"), ["pack_id", "pack_offset", "id"], largest, most, own)


def read_entries(entries: DataFrame, packs: DataFrame) -> DataFrame:
    """id, data of entries (id, pack_id, pack_offset, stored_size) from packs (pack_id, data); null if the pack is missing or too short."""
    rows = entries.join(packs.select("pack_id", F.col("data").cast("binary").alias("data")), "pack_id", "left")
    whole = F.col("pack_offset") + F.col("stored_size") <= F.octet_length("data")
    return rows.select("id", F.when(whole, F.substr("data", (F.col("pack_offset") + 1).cast("int"), F.col("stored_size").cast("int"))).alias("data"))
