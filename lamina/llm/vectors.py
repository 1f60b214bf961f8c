"""Scaffolding of the two vector searches: parsing, shards, query chunks, merging.

A search runs a stated query set against all rows.  Rows are dealt into shards
of bounded size; every shard becomes an index inside one task, and the indexes
are written once, as flat arrays, one row a shard.  The queries then pass by
them in chunks of bounded bytes: a chunk is sent to all tasks, each task reads
its shards' indexes and adds each query's best k to a written table, and the
chunk is released before the next one.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lamina.llm.common import discard, materialize, own_files, scratch_dir

#: Components that one query chunk, sent to every task, may hold (float64: 16 MB).
CHUNK_CELLS = 1 << 21
#: Components that one shard may hold; 64-dimensional rows make shards of 8192.
SHARD_CELLS = 1 << 19


def parse(ids: pa.Array, lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Valid rows by vector length: ids and a float64 matrix.

    Rows with a null id, a null or empty vector, or a null or non-finite component are left out.
    """
    if isinstance(ids, pa.ChunkedArray):
        ids, lists = ids.combine_chunks(), lists.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    named = pc.is_valid(ids).to_numpy(zero_copy_only=False)
    names = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = {}
    for length in np.unique(lengths[named & (lengths > 0)]):
        rows = np.flatnonzero(named & (lengths == length))
        matrix = flat[starts[rows][:, None] + np.arange(length)]
        good = np.isfinite(matrix).all(axis=1)
        if good.any():
            found[int(length)] = (names[rows[good]], matrix[good])
    return found


def shards(parts: Iterator[pa.RecordBatch], cells: int = SHARD_CELLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Regroups a task's rows (id, vector) into shards of one vector length and at most `cells` components."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for part in parts:
        for length, pair in parse(part.column(0), part.column(1)).items():
            own = held.setdefault(length, [])
            own.append(pair)
            most = max(1, cells // length)
            while sum(len(x) for x, _ in own) >= most:
                ids, matrix = np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own])
                yield ids[:most], matrix[:most]
                own[:] = [(ids[most:], matrix[most:])]
    for own in held.values():
        ids, matrix = np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own])
        if len(ids):
            yield ids, matrix


class Best:
    """Each query's k best so far, larger scores first and smaller ids on ties."""

    def __init__(self, queries: int, k: int, kind: type) -> None:
        self.k = k
        self.scores = [np.empty(0, kind) for _ in range(queries)]
        self.ids = [np.empty(0, np.int64) for _ in range(queries)]

    def floor(self, query: int) -> float | int | None:
        """The k-th best score, None while there are fewer."""
        return self.scores[query][-1] if len(self.scores[query]) == self.k else None

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.concatenate([self.scores[query], scores])
        ids = np.concatenate([self.ids[query], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Flat arrays as bytes."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
        return {name: arrays[name] for name in arrays.files}


class Shard(Protocol):
    """An index over one shard's rows; `build` makes its flat arrays, the constructor reads them, `probe` adds what it finds."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None: ...

    @staticmethod
    def build(ids: np.ndarray, matrix: np.ndarray) -> dict[str, np.ndarray] | None: ...

    def probe(self, query_ids: np.ndarray, queries: np.ndarray, best: Best) -> None: ...


def search(table: DataFrame, ids: str, vectors: str, is_query: Column, shard: type[Shard], k: int, kind: type, chunk_cells: int = CHUNK_CELLS, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of `table` for each of its query rows.

    Rows with the query's own id are not its candidates; a query meets vectors of its own length only.
    An id that repeats among the queries asks once, with its smallest vector.  Ties go to the smaller id.
    """
    spark = table.sparkSession
    rows = table.select(F.col(ids).cast("long").alias("id"), F.col(vectors).cast("array<double>").alias("v"), is_query.alias("q"))
    total, asked, longest = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("v"))).first()
    cells = max(1, longest or 1)
    chunks, tasks = max(1, -(-asked * cells // chunk_cells)), max(1, -(-total * cells // shard_cells))

    def built(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, matrix in shards(parts, shard_cells):
            arrays = shard.build(names, matrix)
            if arrays is not None:
                yield pa.RecordBatch.from_pydict({"length": pa.array([matrix.shape[1]], pa.int32()), "index": pa.array([packed(arrays)], pa.binary())})

    indexes = materialize(rows.select("id", "v").repartition(tasks).mapInArrow(built, "length int, index binary"), "vectors-index")
    asking = rows.where("q and id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    wanted = materialize(asking.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))).repartition("chunk").sortWithinPartitions("chunk"), "vectors-asked")
    score = "long" if kind is np.int64 else "double"
    schema = f"query_id long, vec_id long, score {score}"
    found = f"{scratch_dir(spark)}/lamina-vectors-found-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(found)
    with own_files(spark):
        for chunk in range(chunks):
            some = wanted.where(F.col("chunk") == chunk).toArrow()
            if not some.num_rows:
                continue
            sent = spark.sparkContext.broadcast(parse(some.column("id"), some.column("v")))

            def visit(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                best = {length: Best(len(q), k, kind) for length, (q, _) in sent.value.items()}
                for part in parts:
                    for length, data in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                        if length in best:
                            shard(unpacked(data.as_py())).probe(*sent.value[length], best[length])
                for length, own in best.items():
                    q = sent.value[length][0]
                    sizes = [len(x) for x in own.ids]
                    if sum(sizes):
                        yield pa.RecordBatch.from_pydict({"query_id": np.repeat(q, sizes), "vec_id": np.concatenate(own.ids), "score": np.concatenate(own.scores)})

            indexes.mapInArrow(visit, schema).write.mode("append").parquet(found)
            sent.destroy()
    discard(indexes, wanted)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = spark.read.schema(schema).parquet(found)
    return every.select("query_id", F.row_number().over(order).cast(T.IntegerType()).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
