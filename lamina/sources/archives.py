"""Directory trees and archives as tables of entries."""

from __future__ import annotations

import io
import os
import stat
import tarfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

SCHEMA = "path string, mode int, size long, uid int, gid int, mtime_ns long, content binary"
#: Suffixes of archives that are read, by format.
TAR = {".tar": "", ".tar.gz": "gz", ".tgz": "gz", ".tar.bz2": "bz2", ".tbz2": "bz2", ".tar.xz": "xz", ".txz": "xz", ".tar.zst": "zst", ".tar.zstd": "zst", ".tzst": "zst"}


def format_of(name: str) -> str:
    """tar codec or "zip" by a name's suffix."""
    for suffix in sorted(TAR, key=len, reverse=True):
        if name.endswith(suffix):
            return TAR[suffix]
    if name.endswith(".zip"):
        return "zip"
    raise ValueError(f"not a known archive: {name!r}")


def members(name: str, data: bytes) -> Iterator[tuple]:
    """Entries of an archive: path, mode with type bits, size, owner, time and content (a link's target)."""
    kind = format_of(name)
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for x in archive.infolist():
                mode = x.external_attr >> 16 or (stat.S_IFDIR | 0o755 if x.is_dir() else stat.S_IFREG | 0o644)
                body = b"" if x.is_dir() else archive.read(x)
                yield x.filename.rstrip("/"), mode & 0xFFFF, len(body), None, None, None, body
        return
    if kind == "zst":
        import zstandard

        data, kind = zstandard.ZstdDecompressor().decompressobj().decompress(data), ""
    with tarfile.open(fileobj=io.BytesIO(data), mode=f"r:{kind}") as archive:
        for x in archive:
            bits = stat.S_IFDIR if x.isdir() else stat.S_IFLNK if x.issym() else stat.S_IFREG
            if not (x.isdir() or x.issym() or x.isfile()):
                continue
            body = x.linkname.encode() if x.issym() else archive.extractfile(x).read() if x.isfile() else b""
            yield x.name.rstrip("/"), bits | x.mode, len(body), x.uid, x.gid, int(x.mtime * 1_000_000_000), body


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive and the entries of every archive under a path that Spark can read."""

    def unpack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for row in members(name, data):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), *(pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True))],
                        ["archive", "path", "mode", "size", "uid", "gid", "mtime_ns", "content"],
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, f"archive string, {SCHEMA}")


class _Tree(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name in sorted(os.listdir(self.root))]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # an empty folder has no partitions
            return
        top = os.path.join(self.root, partition.value)
        found = [top]
        if os.path.isdir(top) and not os.path.islink(top):
            found += [os.path.join(folder, name) for folder, folders, names in os.walk(top) for name in (*folders, *names)]
        for path in found:
            s = os.lstat(path)
            content = None
            if stat.S_ISLNK(s.st_mode):
                content = os.readlink(path).encode()
            elif stat.S_ISREG(s.st_mode):
                with open(path, "rb") as file:
                    content = file.read()
            yield os.path.relpath(path, self.root), s.st_mode & 0xFFFF, s.st_size, s.st_uid, s.st_gid, s.st_mtime_ns, content


class TreeSource(DataSource):
    """spark.read.format("lamina_tree").load(folder): one partition per entry of the folder.

    The folder has to be mounted on every executor.
    """

    @classmethod
    def name(cls) -> str:
        return "lamina_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Tree(self.options["path"])


@contextmanager
def _open_tar(path: str, codec: str) -> Iterator[tarfile.TarFile]:
    """A tar to write; zst by way of its own stream."""
    if codec != "zst":
        with tarfile.open(path, f"w:{codec}") as archive:
            yield archive
        return
    import zstandard

    with open(path, "wb") as file, zstandard.ZstdCompressor().stream_writer(file) as packed, tarfile.open(fileobj=packed, mode="w|") as archive:
        yield archive


def write_tar(files: DataFrame, path: str, codec: str = "", extra: tuple[str, str] | None = None) -> int:
    """Writes entries (path, mode, content, mtime_ns) of one snapshot, parents first, streaming them through the driver.

    `extra` is the name and text of one more member, ahead of the others and not counted.
    """
    count = 0
    with _open_tar(path, codec) as archive:
        if extra is not None:
            entry = tarfile.TarInfo(extra[0])
            entry.size = len(extra[1].encode())
            archive.addfile(entry, io.BytesIO(extra[1].encode()))
        for row in files.select("path", "mode", "content", F.coalesce("mtime_ns", F.lit(0)).alias("mtime_ns")).orderBy("path").toLocalIterator():
            entry = tarfile.TarInfo(row["path"])
            entry.mode, entry.mtime = row["mode"] & 0o7777, row["mtime_ns"] / 1_000_000_000
            body = bytes(row["content"] or b"")
            if stat.S_ISDIR(row["mode"]):
                entry.type = tarfile.DIRTYPE
                archive.addfile(entry)
            elif stat.S_ISLNK(row["mode"]):
                entry.type, entry.linkname = tarfile.SYMTYPE, body.decode()
                archive.addfile(entry)
            else:
                entry.size = len(body)
                archive.addfile(entry, io.BytesIO(body))
            count += 1
    return count


def write_zip(files: DataFrame, path: str, extra: tuple[str, str] | None = None) -> int:
    """As write_tar, into a zip archive."""
    count = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        if extra is not None:
            archive.writestr(*extra)
        for row in files.select("path", "mode", "content").orderBy("path").toLocalIterator():
            folder = stat.S_ISDIR(row["mode"])
            entry = zipfile.ZipInfo(row["path"] + "/" * folder)
            entry.external_attr = row["mode"] << 16
            archive.writestr(entry, b"" if folder else bytes(row["content"] or b""))
            count += 1
    return count


def write_objects(blobs: DataFrame, root: str) -> None:
    """Writes contents (hash, data) as root/<first two digits>/<hash>: repeating it changes nothing."""

    def put(rows: Iterator) -> None:
        for row in rows:
            folder = os.path.join(root, row["hash"][:2])
            os.makedirs(folder, exist_ok=True)
            path = os.path.join(folder, row["hash"])
            with open(f"{path}.{os.getpid()}", "wb") as file:
                file.write(bytes(row["data"]))
            os.replace(f"{path}.{os.getpid()}", path)

    blobs.select("hash", "data").foreachPartition(put)


def read_objects(rows: DataFrame, root: str) -> DataFrame:
    """The rows (hash and others) with `data`, the object of that hash under a folder as write_objects lays it; null if there is none.

    Every executor reads from the mounted folder, one object at a time.
    """

    def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, name in enumerate(part.column("hash").to_pylist()):
                try:
                    with open(os.path.join(root, name[:2], name), "rb") as file:
                        data = file.read()
                except FileNotFoundError:
                    data = None
                yield pa.RecordBatch.from_arrays([*part.slice(at, 1).columns, pa.array([data], pa.binary())], [*part.schema.names, "data"])

    return rows.mapInArrow(fetch, StructType([*rows.schema.fields, StructField("data", BinaryType())]))


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """compress, hash, bytes of the objects in root/<codec>/<first two digits>/<hash>; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    parts = F.split("path", "/")
    return found.select(F.element_at(parts, -3).alias("compress"), F.element_at(parts, -1).alias("hash"), F.col("length").alias("bytes"))


def remove_objects(objects: DataFrame, root: str) -> None:
    """Removes objects (compress, hash) that list_objects named: repeating it changes nothing."""

    def drop(rows: Iterator) -> None:
        for row in rows:
            path = os.path.join(root, row["compress"], row["hash"][:2], row["hash"])
            if os.path.exists(path):
                os.remove(path)

    objects.select("compress", "hash").foreachPartition(drop)


def write_folder(files: DataFrame, root: str) -> int:
    """Writes entries (path, mode, content, mtime_ns) into a new folder that every executor sees; returns their number.

    Executors write files and links, each beside its place and then moved there; modes and times of folders come
    last, deepest first, when nothing is put in them any more.  A path that leaves the folder raises.
    """
    os.makedirs(root)
    base = os.path.abspath(root)

    def put(rows: Iterator) -> None:
        for row in rows:
            path = os.path.normpath(os.path.join(base, row["path"]))
            if not path.startswith(base + os.sep):
                raise ValueError(f"outside of the folder: {row['path']!r}")
            if stat.S_ISDIR(row["mode"]):
                os.makedirs(path, exist_ok=True)
                continue
            os.makedirs(os.path.dirname(path), exist_ok=True)
            body, fresh = bytes(row["content"] or b""), f"{path}.{os.getpid()}.part"
            if stat.S_ISLNK(row["mode"]):
                if os.path.lexists(fresh):
                    os.remove(fresh)
                os.symlink(body.decode(), fresh)
            else:
                with open(fresh, "wb") as file:
                    file.write(body)
                os.chmod(fresh, row["mode"] & 0o7777)
                if row["mtime_ns"] is not None:
                    os.utime(fresh, ns=(row["mtime_ns"], row["mtime_ns"]))
            os.replace(fresh, path)

    files.select("path", "mode", "content", "mtime_ns").foreachPartition(put)
    folders = files.where(F.col("mode").bitwiseAND(0xF000) == 0x4000).select("path", "mode", "mtime_ns").orderBy(F.desc("path"))
    for row in folders.toLocalIterator():
        path = os.path.join(base, row["path"])
        os.chmod(path, row["mode"] & 0o7777)
        if row["mtime_ns"] is not None:
            os.utime(path, ns=(row["mtime_ns"], row["mtime_ns"]))
    return files.count()
