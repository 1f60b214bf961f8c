"""A catalog: the named tables of one snapshot store, loaded from Parquet and published as a new version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lamina.schema import SCHEMAS


class Conflict(RuntimeError):
    """Another writer published first."""


class Catalog(dict):
    """Table name to DataFrame; attribute access for reading.  `version` is the number it was loaded from, 0 for none."""

    version = 0

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
        """(number, folder) of the published versions, oldest first; a version counts once its mark is there, after all its tables."""
        fs, _ = _files(spark, path)
        marks = _path(spark, f"{path}/versions")
        if not fs.exists(marks):
            return []
        return sorted((int(name), folder) for name, folder in (x.getPath().getName().split("-", 1) for x in fs.listStatus(marks)))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        """The newest version."""
        known = cls.versions(spark, path)
        if not known:
            raise FileNotFoundError(f"no catalog at {path}")
        out = cls({name: spark.read.schema(schema).parquet(f"{path}/{known[-1][1]}/{name}") for name, schema in SCHEMAS.items()})
        out.version = known[-1][0]
        return out

    def publish(self, spark: SparkSession, path: str) -> str:
        """Writes all tables beside the present version, then its mark, in one step: readers see old or new, never a mix.

        The mark's number follows the version this catalog was loaded from, and is never overwritten: of two
        writers that start from the same version the second one fails with Conflict, and its tables are not seen.
        """
        folder = uuid.uuid4().hex
        for name, table in self.items():
            table.write.parquet(f"{path}/{folder}/{name}")
        fs, _ = _files(spark, path)
        fs.mkdirs(_path(spark, f"{path}/versions"))
        known = self.versions(spark, path)
        if known and known[-1][0] != self.version:
            raise Conflict(f"version {known[-1][0]} was published after {self.version}")
        fs.create(_path(spark, f"{path}/versions/{self.version + 1:012d}-{folder}"), False).close()
        self.version += 1
        return folder

    @classmethod
    def vacuum(cls, spark: SparkSession, path: str, keep: int = 1, rows_per_file: int = 10_000_000) -> tuple[int, int]:
        """(bytes before, bytes after) of the store: the newest version is written anew in full files, all but the newest `keep` versions go."""
        fs, root = _files(spark, path)
        before = fs.getContentSummary(root).getLength()
        present = cls.load(spark, path)
        for name, table in present.items():
            present[name] = table.coalesce(max(1, -(-table.count() // rows_per_file)))
        present.publish(spark, path)
        for number, folder in cls.versions(spark, path)[:-keep]:
            fs.delete(_path(spark, f"{path}/versions/{number:012d}-{folder}"), False)
            fs.delete(_path(spark, f"{path}/{folder}"), True)
        return before, fs.getContentSummary(root).getLength()


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    root = _path(spark, path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root
