"""What the operators share: scratch tables, checked broadcasts, folds, word splitting."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side may be broadcast (about 32 bytes a row).
BROADCAST_ROWS = 1_000_000

_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session's `spark.checkpoint.dir`; a folder of our own only where that is unset and the master is local (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset on {master}: set it to a folder that the driver and all executors share")
        _own.append("file://" + tempfile.mkdtemp(prefix="lamina-")) if not _own else None
        shared = _own[0]
    return shared.rstrip("/")


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside are removed as soon as these end, as the written table replaces them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def own_files(spark: SparkSession) -> Iterator[None]:
    """Reads inside get a task for each file."""
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key, "4194304")
    spark.conf.set(key, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lamina-{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    return out


def materialize_by(df: DataFrame, key: str, parts: int, name: str = "t") -> DataFrame:
    """`materialize`, bucketed by a column: joins on it, against a side of `parts` partitions, leave this table where it lies."""
    spark = df.sparkSession
    run = uuid.uuid4().hex
    path, table = f"{scratch_dir(spark)}/lamina-{name}-{run}", f"lamina_{run}"
    with _cleaned(spark):
        df.write.format("parquet").bucketBy(parts, key).option("compression", "zstd").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._lamina_path, out._lamina_table = path, table
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes tables of `materialize` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_lamina_path", None)
        if getattr(df, "_lamina_table", None):
            df.sparkSession.sql(f"drop table if exists {df._lamina_table}")
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows by count; else unchanged, for a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo `parts`; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % parts


def held_out(doc_id: Column | str, parts: int, remainder: int) -> Column:
    """Whether the id belongs to the held-out fold; false for a null id."""
    return F.coalesce(fold(doc_id, parts) == remainder, F.lit(False))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for nulls."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
