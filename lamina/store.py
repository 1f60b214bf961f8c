"""A store of snapshots: every command a user gives, as one call on a catalog and the objects beside it.

A store is a folder that the driver and all executors see: `catalog` holds the published versions of the tables,
`blobs/<codec>/<first two digits>/<hash>` the contents.  Reading calls return lazy DataFrames over the newest
version; changing calls publish a new one, or raise Conflict if another writer came first.  Objects are written
before the version that names them and removed (`sweep`) after the one that forgets them, so a call that dies
leaves at most objects that no version knows.

The store writes every content as one object (storage method direct).  Chunked contents of catalogs from
elsewhere are listed, audited and deleted, but not restored nor migrated.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamina.catalog import Catalog
from lamina.functions import meta
from lamina.functions.codecs import compress, decompress
from lamina.functions.units import parse_backup_id
from lamina.operators import audits, content, layout, lineage, lookups, predicates, retention, snapshots, stats
from lamina.operators.predicates import NotFound
from lamina.schema import HASH_LENGTHS, ROLE_ADD, ROLE_OVERRIDE, ROLE_REMOVE, ROLE_STANDALONE, SCHEMAS, VERSION
from lamina.sources import archives

GROUP, BLOB = "chunk_group_chunk_binding", "blob_chunk_group_binding"
#: Samples that an inspection shows beside the total.
SAMPLES = 5


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    number: int
    pages: int
    total: int


class Protected(RuntimeError):
    """The snapshot is protected."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, os.path.abspath(root)
        self.uri = f"file://{self.root}"

    @classmethod
    def create(cls, spark: SparkSession, root: str, hash_method: str = "xxh128") -> Store:
        """An empty store; fails if there is one."""
        if hash_method not in HASH_LENGTHS:
            raise ValueError(f"no such hash: {hash_method}")
        store = cls(spark, root)
        if Catalog.versions(spark, f"{store.uri}/catalog"):
            raise FileExistsError(root)
        tables = {name: spark.createDataFrame([(1, VERSION, hash_method)] if name == "db_meta" else [], ddl) for name, ddl in SCHEMAS.items()}
        Catalog(tables).publish(spark, f"{store.uri}/catalog")
        return store

    def catalog(self) -> Catalog:
        return Catalog.load(self.spark, f"{self.uri}/catalog")

    def _publish(self, c: Catalog) -> None:
        for name, ddl in SCHEMAS.items():
            c[name] = c[name].select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)))
        c.publish(self.spark, f"{self.uri}/catalog")

    # looking

    def resolve(self, text: str | int) -> int:
        """The id that a number, latest, ~ or ~n names; temporary snapshots are no latest ones."""
        backup = self.catalog().backup
        wanted = parse_backup_id(str(text))
        if isinstance(wanted, tuple):
            found = snapshots.nth_latest(backup.where(predicates.tag_not_equals(F.col("tags"), "temporary", "true")), wanted[1]).first()
        else:
            found = backup.where(F.col("id") == wanted).first()
        if found is None:
            raise NotFound(f"snapshot {text}")
        return found["id"]

    def backups(self, number: int = 1, size: int = 10, by: str = "time_r", everything: bool = False, **filters: object) -> Page:
        """A page of the snapshots that `backup_filter` lets through; temporary and hidden ones only with `everything`."""
        rows = predicates.backup_filter(self.catalog().backup, **filters)
        if not everything:
            rows = rows.where(predicates.visible(F.col("tags")))
        total = rows.count()
        return Page(predicates.page(rows, number, size, by), number, (total - 1) // size + 1, total)

    def _views(self, c: Catalog, *ids: int) -> list[DataFrame]:
        pairs = {r["id"]: (r["fileset_id_base"], r["fileset_id_delta"]) for r in c.backup.where(F.col("id").isin(*ids)).collect()}
        for i in ids:
            if i not in pairs:
                raise NotFound(f"snapshot {i}")
        return [snapshots.merge(c.file, self.spark.createDataFrame([pairs[i]], "base int, delta int")).drop("base", "delta") for i in ids]

    def files(self, backup_id: int) -> DataFrame:
        """The files of a snapshot."""
        return self._views(self.catalog(), backup_id)[0]

    def show(self, backup_id: int) -> tuple[DataFrame, DataFrame]:
        """The snapshot's row; its files by kind with their sizes."""
        c = self.catalog()
        kinds = self._views(c, backup_id)[0].groupBy(predicates.kind(F.col("mode")).alias("kind"))
        return c.backup.where(F.col("id") == backup_id), kinds.agg(F.count("*").alias("files"), stats.total("blob_raw_size").alias("raw"), stats.total("blob_stored_size").alias("stored"))

    def diff(self, old: int, new: int, status: bool = False) -> DataFrame:
        """path, change and sizes between two snapshots; `snapshots.diff_summary` sums it up."""
        return snapshots.diff(*self._views(self.catalog(), old, new), status)

    def file(self, backup_id: int, path: str) -> tuple[DataFrame, DataFrame]:
        """A file's row in a snapshot; the snapshots that show the same row of the same fileset."""
        c = self.catalog()
        row = self._views(c, backup_id)[0].where(F.col("path") == path)
        if row.isEmpty():
            raise NotFound(f"{path} in snapshot {backup_id}")
        pair = c.backup.where(F.col("id") == backup_id).select(F.explode(F.array("fileset_id_delta", "fileset_id_base")).alias("fileset_id"))
        held = c.file.where((F.col("path") == path) & (F.col("role") != ROLE_REMOVE)).join(pair, "fileset_id", "left_semi").select("fileset_id", "path")
        own = lineage.containing_file(held, c.file, c.backup)
        shown = own.where(F.col("backup_id") == backup_id).select("fileset_id")
        return row, own.join(shown, "fileset_id", "left_semi")

    def directory(self, backup_id: int, path: str = "", deep: bool = False) -> DataFrame:
        """What is in a folder of a snapshot, in path order; with `deep` all below it."""
        files, path = self.files(backup_id), path.strip("/")
        if path:
            own = files.where(F.col("path") == path).select(predicates.kind(F.col("mode")).alias("kind")).first()
            if own is None:
                raise NotFound(f"{path} in snapshot {backup_id}")
            if own["kind"] != "directory":
                raise NotADirectoryError(path)
        inside = (predicates.within(F.col("path"), path) & (F.col("path") != path) if path else F.lit(True)) if deep else predicates.child_of(F.col("path"), path)
        return files.where(inside).orderBy(predicates.path_key(F.col("path")))

    def fileset(self, fileset_id: int) -> tuple[DataFrame, DataFrame]:
        """A fileset's row; the snapshots over it."""
        c = self.catalog()
        row = c.fileset.where(F.col("id") == fileset_id)
        if row.isEmpty():
            raise NotFound(f"fileset {fileset_id}")
        return row, lineage.fileset_backups(c.backup).where(F.col("fileset_id") == fileset_id)

    def inspect(self, kind: str, key: int | str) -> tuple[DataFrame, DataFrame, int]:
        """A blob, chunk, chunk_group or pack by id, or by hash prefix; samples of what holds or fills it; how many there are."""
        c = self.catalog()
        if kind not in ("blob", "chunk", "chunk_group", "pack"):
            raise ValueError(f"no such kind: {kind!r}")
        if isinstance(key, int):
            row = c[kind].where(F.col("id") == key)
        elif kind == "pack":
            raise ValueError("a pack has no hash")
        else:
            row = c[kind].where(F.col("hash") == predicates.resolve_prefix(c[kind], "hash", key))
        found = row.first()
        if found is None:
            raise NotFound(f"{kind} {key}")
        users, by = {
            "blob": (c.file.where(F.col("blob_id") == found["id"]).select("fileset_id", "path"), ["fileset_id", "path"]),
            "chunk": (c[GROUP].where(F.col("chunk_id") == found["id"]), ["chunk_group_id", "chunk_offset"]),
            "chunk_group": (c[BLOB].where(F.col("chunk_group_id") == found["id"]), ["blob_id", "chunk_group_offset"]),
            "pack": (c.chunk.where(F.col("pack_id") == found["id"]), ["pack_offset", "id"]),
        }[kind]
        return row, users.orderBy(*by).limit(SAMPLES), users.count()

    def overview(self) -> DataFrame:
        """One row of counts and sizes of the whole store."""
        c = self.catalog()
        about = c.db_meta.first()
        folder = Catalog.versions(self.spark, f"{self.uri}/catalog")[-1][1]
        held = sum(os.path.getsize(os.path.join(top, name)) for top, _, names in os.walk(os.path.join(self.root, "catalog", folder)) for name in names)
        return stats.overview({**c, "chunk_binding": c[GROUP], "blob_binding": c[BLOB]}, about["version"], about["hash_method"], held)

    def validate(self, parts: Sequence[str] = ("packs", "blobs", "chunks", "chunk_groups", "files", "filesets", "backups"), contents: bool = False) -> DataFrame:
        """part, key, kind: one row per violation; with `contents` the stored bytes are read and hashed too."""
        c = self.catalog()
        found = {
            "packs": lambda: [audits.audit_packs(c.pack, c.chunk)],
            "blobs": lambda: [audits.audit_blobs(c.blob, c.file, c[BLOB], c.chunk_group, c[GROUP], c.chunk)],
            "chunks": lambda: [audits.audit_chunks(c.chunk, c.pack, c[GROUP])],
            "chunk_groups": lambda: [audits.audit_chunk_groups(c.chunk_group, c[GROUP], c.chunk, c[BLOB]), audits.audit_group_hashes(c.chunk_group, c[GROUP], c.chunk)],
            "files": lambda: [audits.audit_files(c.file, c.fileset, c.blob).select(F.concat_ws(":", "fileset_id", "path").alias("id"), "kind")],
            "filesets": lambda: [audits.audit_filesets(c.fileset, c.file, c.backup), audits.audit_file_roles(c.fileset, c.file), snapshots.audit_recount(c.file, c.fileset)],
            "backups": lambda: [audits.audit_backups(c.backup, c.fileset)],
        }
        out = self.spark.createDataFrame([], "part string, key string, kind string")
        for part in parts:
            for rows in found[part]():
                out = out.unionByName(rows.select(F.lit(part).alias("part"), F.col("id").cast("string").alias("key"), "kind"))
        if contents and "blobs" in parts:
            # Executors read, compare and drop the bytes: none are shuffled.
            method = c.db_meta.first()["hash_method"]
            data = self._data(c.blob.where("storage_method = 1"))
            kind = F.when(F.col("data").isNull(), "missing").when(F.octet_length("data") != F.col("raw_size"), "mismatched").when(content.content_hash(F.col("data"), method) != F.col("hash"), "corrupted")
            out = out.unionByName(data.select(F.lit("blobs").alias("part"), F.col("id").cast("string").alias("key"), kind.alias("kind")).where("kind is not null"))
        return out

    def retention_plan(self, policy: retention.Policy, now: int | None = None) -> DataFrame:
        """id, keep, reason of the snapshots that are neither temporary nor hidden."""
        rows = self.catalog().backup.where(predicates.visible(F.col("tags")))
        rows = rows.select("id", "timestamp", "timestamp_ns_part", predicates.tag_equals(F.col("tags"), "protected", "true").alias("protected"))
        return retention.plan(rows, policy, int(time.time()) if now is None else now)

    # objects

    def _data(self, blobs: DataFrame) -> DataFrame:
        """The rows (hash, compress and others) with `data`, the raw content; null if the object is missing or cannot be decoded."""
        out = None
        for codec in [r[0] for r in blobs.select("compress").distinct().collect()]:
            rows = archives.read_objects(blobs.where(F.col("compress") == codec), f"{self.root}/blobs/{codec}")
            rows = rows if codec == "plain" else rows.withColumn("data", decompress(F.col("data"), codec))
            out = rows if out is None else out.unionByName(rows)
        return blobs.withColumn("data", F.lit(None).cast("binary")) if out is None else out

    @contextmanager
    def _staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """The rows written once, so that a source that changes meanwhile is seen in one state."""
        path = f"staging/{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.uri}/{path}")
            yield self.spark.read.parquet(f"{self.uri}/{path}")
        finally:
            shutil.rmtree(f"{self.root}/{path}", ignore_errors=True)

    def sweep(self) -> int:
        """Removes the objects that the newest version does not know; returns their number.

        No snapshot may be made meanwhile: its objects are there before a version knows them.
        """
        folder = f"{self.root}/blobs"
        if not os.path.isdir(folder):
            return 0
        known = self.catalog().blob.where("storage_method = 1").select("compress", "hash")
        with self._staged(archives.list_objects(self.spark, f"{self.uri}/blobs").join(known, ["compress", "hash"], "left_anti")) as gone:
            count = gone.count()
            archives.remove_objects(gone, folder)
        return count

    # making

    def make(self, entries: DataFrame, creator: str = "unknown:", comment: str = "", targets: Sequence[str] = (), tags: dict | None = None, at: int | None = None, codec: str = "plain") -> int:
        """A new snapshot of entries (as of `archives.SCHEMA`) at `at` nanoseconds; returns its id.

        A content that is known by hash is not stored again.  The files become a delta of one of the newest bases
        if one fits, else a new base with an empty delta.
        """
        c = self.catalog()
        at = time.time_ns() if at is None else at
        regular = predicates.kind(F.col("mode")) == "file"
        body = F.when(regular, F.coalesce("content", F.lit(b"")))
        packed = body if codec == "plain" else compress(body, codec)
        rows = entries.withColumns({"hash": content.content_hash(body, c.db_meta.first()["hash_method"]), "raw_size": F.octet_length(body).cast("long"), "data": packed})
        with self._staged(rows) as rows:
            contents = rows.where("hash is not null").select("hash", "raw_size", F.octet_length("data").cast("long").alias("stored_size"))
            fresh = lookups.assign_ids(c.blob, contents, "hash")
            archives.write_objects(rows.join(fresh, "hash", "left_semi"), f"{self.root}/blobs/{codec}")
            sizes = contents.groupBy("hash").agg(F.min("raw_size").alias("raw_size"), F.min("stored_size").alias("stored_size"))
            blob = c.blob.unionByName(fresh.join(sizes, "hash").select("id", F.lit(1).alias("storage_method"), "hash", F.lit(codec).alias("compress"), "raw_size", "stored_size"))
            b = blob.select(*(F.col(n).alias(f"blob_{n}") for n in blob.columns))
            link = F.when(predicates.kind(F.col("mode")) == "symlink", F.col("content"))
            stamp = [F.floor(F.col("mtime_ns") / F.lit(10**9).cast("decimal(20,0)")).cast("long").alias("mtime"), F.pmod("mtime_ns", F.lit(10**9)).cast("int").alias("mtime_ns_part")]
            new = rows.join(b, F.col("hash") == F.col("blob_hash"), "left").select("path", F.lit(ROLE_STANDALONE).alias("role"), "mode", link.alias("content"), *b.columns, "uid", "gid", *stamp)
            self._add(c, new, blob, creator, comment, targets, tags, at)
        return self._made

    def _add(self, c: Catalog, new: DataFrame, blob: DataFrame, creator: str, comment: str, targets: Sequence[str], tags: dict | None, at: int) -> None:
        base = snapshots.allocate_base(snapshots.allocation_candidates(new, c.file, c.fileset, c.backup)).first()["base_id"]
        top = (c.fileset.agg(F.max("id")).first()[0] or 0) + 1
        if base is None:
            base, delta = top, top + 1
            rows, filesets = new.withColumn("fileset_id", F.lit(base)), [(base, 0), (delta, base)]
        else:
            delta, filesets = top, [(top, base)]
            changes = snapshots.keyed_delta(c.file.where(F.col("fileset_id") == base), new, ["path"], snapshots.same_columns(snapshots.SAME)).select("path", "change")
            role = F.when(F.col("change") == "added", ROLE_ADD).when(F.col("change") == "changed", ROLE_OVERRIDE).otherwise(ROLE_REMOVE)
            rows = changes.join(new.drop("role"), "path", "left").withColumns({"role": role, "mode": F.coalesce("mode", F.lit(0)), "fileset_id": F.lit(delta)})
        sums = [F.lit(0).cast("long").alias(n) for n in c.fileset.columns[2:]]
        file = c.file.unionByName(rows.select(*c.file.columns))
        fileset = c.fileset.unionByName(self.spark.createDataFrame(filesets, "id int, base_id int").select("*", *sums))
        self._made = (c.backup.agg(F.max("id")).first()[0] or 0) + 1
        own = [(self._made, at // 10**9, at % 10**9, creator, comment, list(targets), json.dumps(tags or {}), base, delta, 0, 0, 0)]
        c.update(blob=blob, file=file, fileset=snapshots.recount(file, fileset))
        c["backup"] = snapshots.finalize_backups(c.backup.unionByName(self.spark.createDataFrame(own, SCHEMAS["backup"])), c.fileset)
        self._publish(c)

    def make_from(self, folder: str, targets: Sequence[str], ignore: Sequence[str] = (), **about: object) -> int:
        """A snapshot of the targets (patterns of names) in a folder, without what the ignore patterns match."""
        self.spark.dataSource.register(archives.TreeSource)
        rows = self.spark.read.format("lamina_tree").load(folder)
        is_folder = predicates.kind(F.col("mode")) == "directory"
        rows = rows.where(predicates.rule_match(F.split("path", "/")[0], list(targets)))
        if ignore:
            rows = rows.where(~predicates.rule_match(F.col("path"), list(ignore), is_folder))
        return self.make(rows, targets=targets, **about)

    def import_archive(self, path: str, ensure_meta: bool = False, meta_override: str | None = None, codec: str = "plain") -> int:
        """A snapshot of an archive, described by its metadata member or the JSON that overrides it.

        Without either, the targets are the names at the archive's top; with `ensure_meta` that raises.
        """
        rows = archives.read_archives(self.spark, path).drop("archive")
        own = [meta_override] if meta_override is not None else [bytes(r["content"]).decode() for r in rows.where(F.col("path") == meta.META_NAME).select("content").collect()]
        if not own and ensure_meta:
            raise NotFound(f"{meta.META_NAME} in {path}")
        files = rows.where(F.col("path") != meta.META_NAME).withColumn("path", F.regexp_replace("path", r"^(\./)+", "")).where("path not in ('', '.')")
        about = self.spark.createDataFrame([(own[0] if own else "{}",)], "t string").select(meta.decode(F.col("t")).alias("m")).first()["m"]
        targets = about["targets"] or sorted(r[0] for r in files.select(F.split("path", "/")[0]).distinct().collect())
        at = None if about["timestamp"] is None else about["timestamp"] * 10**9 + about["timestamp_ns_part"]
        return self.make(files, about["creator"], about["comment"], targets, json.loads(about["tags"]), at, codec)

    def import_slot(self, slot: str, creator: str = "unknown:") -> int:
        """A snapshot of a slot folder: `info.json` (time_stamp or local time, comment, backup_format) beside plain files or one archive."""
        with open(os.path.join(slot, "info.json"), encoding="utf8") as source:
            info = json.load(source)
        seconds = info.get("time_stamp")
        if seconds is None:
            seconds = time.mktime(time.strptime(info.get("time", ""), "%Y-%m-%d %H:%M:%S"))
        about = {"creator": creator, "comment": info.get("comment", ""), "at": int(seconds * 10**6) * 1000}
        kind = info.get("backup_format") or "plain"
        if kind == "plain":
            return self.make_from(slot, sorted(set(os.listdir(slot)) - {"info.json"}), **about)
        suffix = {"tar": ".tar", "tar_gz": ".tar.gz", "tar_xz": ".tar.xz"}.get(kind)
        if suffix is None:
            raise ValueError(f"not a known format: {kind!r}")
        override = {"creator": creator, "comment": about["comment"], "timestamp_ns": about["at"]}
        return self.import_archive(f"file://{os.path.abspath(slot)}/backup{suffix}", meta_override=json.dumps(override))

    # restoring

    def _contents(self, c: Catalog, files: DataFrame) -> DataFrame:
        """path, mode, content, mtime_ns of files; a content that is missing or not as its hash says fails the query when it runs."""
        if not files.where("blob_storage_method = 2").isEmpty():
            raise NotImplementedError("chunked contents are not restored")
        method = c.db_meta.first()["hash_method"]
        named = files.where("blob_hash is not null").withColumnsRenamed({"blob_hash": "hash", "blob_compress": "compress"})
        good = (F.octet_length("data") == F.col("blob_raw_size")) & (content.content_hash(F.col("data"), method) == F.col("hash"))
        checked = F.when(good, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("content is missing or damaged: "), F.col("path"))).cast("binary"))
        at = (F.col("mtime") * 10**9 + F.coalesce("mtime_ns_part", F.lit(0))).alias("mtime_ns")
        return self._data(named).select("path", "mode", checked.alias("content"), at).unionByName(files.where("blob_hash is null").select("path", "mode", "content", at))

    def export(self, backup_id: int, path: str, child: str = "", with_meta: bool = True) -> int:
        """Writes a snapshot, or what is at or below `child`, to an archive or (without a known suffix) into a folder; returns the entries."""
        c = self.catalog()
        files = self._views(c, backup_id)[0]
        if child:
            files = files.where(predicates.within(F.col("path"), child.strip("/")))
            if files.isEmpty():
                raise NotFound(f"{child} in snapshot {backup_id}")
        rows = self._contents(c, files)
        try:
            kind = archives.format_of(path)
        except ValueError:
            return archives.write_folder(rows, path)
        tags = F.from_json("tags", "map<string,string>")
        own = c.backup.where(F.col("id") == backup_id).select(meta.encode(F.col("creator"), F.col("comment"), F.col("timestamp"), F.col("timestamp_ns_part"), F.col("targets"), tags).alias("m")).first()["m"]
        about = (meta.META_NAME, own) if with_meta else None
        return archives.write_zip(rows, path, about) if kind == "zip" else archives.write_tar(rows, path, kind, about)

    # changing

    def _edit(self, backup_id: int, column: str, value: str) -> None:
        c = self.catalog()
        c["backup"] = c.backup.withColumn(column, F.when(F.col("id") == backup_id, F.lit(value)).otherwise(F.col(column)))
        self._publish(c)

    def rename(self, backup_id: int, comment: str) -> None:
        self._edit(self.resolve(backup_id), "comment", comment)

    def tag(self, backup_id: int, name: str, value: object = None) -> None:
        """Sets a tag, or clears it (None)."""
        tags = json.loads(self.catalog().backup.where(F.col("id") == self.resolve(backup_id)).first()["tags"])
        tags = {**{k: v for k, v in tags.items() if k != name}, **({} if value is None else {name: value})}
        self._edit(backup_id, "tags", json.dumps(tags))

    def delete(self, ids: Sequence[int], force: bool = False) -> DataFrame:
        """Deletes snapshots and all that only they hold; kind, id of what went below them.  Protected ones raise unless forced."""
        c = self.catalog()
        found = {r["id"]: json.loads(r["tags"]) for r in c.backup.where(F.col("id").isin(*ids)).select("id", "tags").collect()}
        for i in ids:
            if i not in found:
                raise NotFound(f"snapshot {i}")
            if found[i].get("protected") is True and not force:
                raise Protected(f"snapshot {i}")
        return self._delete(c, self.spark.createDataFrame([(i,) for i in found], "id int"))

    def delete_range(self, first: int | None, last: int | None) -> DataFrame:
        """As delete, for all snapshots of an inclusive range of ids that are not protected."""
        c = self.catalog()
        rows = predicates.backup_filter(c.backup, ids=(first, last)).where(~predicates.tag_equals(F.col("tags"), "protected", "true"))
        return self._delete(c, rows.select("id"))

    def prune(self, policy: retention.Policy, now: int | None = None) -> DataFrame:
        """As delete, for what the policy does not keep."""
        return self._delete(self.catalog(), self.retention_plan(policy, now).where("not keep").select("id"))

    def _delete(self, c: Catalog, doomed: DataFrame) -> DataFrame:
        top = snapshots.delete_cascade(c.backup, doomed, c.fileset, c.file, c.blob)
        blobs = top.where("kind = 'blob'").select("id")
        with self._staged(top.unionByName(snapshots.delete_below(blobs, c[BLOB], c.chunk_group, c[GROUP], c.chunk, c.pack))) as gone:
            rows = [tuple(r) for r in gone.groupBy("kind").agg(F.count("*").alias("gone")).collect()]
            c["backup"] = c.backup.join(doomed, "id", "left_anti")
            self._drop(c, gone)
        self.sweep()
        return self.spark.createDataFrame(rows, "kind string, gone long")

    def _drop(self, c: Catalog, gone: DataFrame) -> None:
        """Publishes the catalog without the objects (kind, id), its bases shrunk and its sums taken anew."""
        ids = lambda kind, name: gone.where(F.col("kind") == kind).select(F.col("id").alias(name))
        for kind in ("fileset", "blob", "chunk_group", "chunk", "pack"):
            c[kind] = c[kind].join(ids(kind, "id"), "id", "left_anti")
        c["file"] = c.file.join(ids("fileset", "fileset_id"), "fileset_id", "left_anti")
        c[BLOB] = c[BLOB].join(ids("blob", "blob_id"), "blob_id", "left_anti").join(ids("chunk_group", "chunk_group_id"), "chunk_group_id", "left_anti")
        c[GROUP] = c[GROUP].join(ids("chunk_group", "chunk_group_id"), "chunk_group_id", "left_anti")
        live = stats.pack_live(c.pack, c.chunk).select(F.col("pack_id").alias("id"), "live_size", F.col("live_entries").alias("live_entry_count"))
        c["pack"] = c.pack.drop("live_size", "live_entry_count").join(live, "id").select(*c.pack.columns)
        c["file"] = snapshots.shrink(c.file, c.fileset)
        c["fileset"] = snapshots.recount(c.file, c.fileset)
        c["backup"] = snapshots.finalize_backups(c.backup, c.fileset)
        self._publish(c)

    def prune_database(self, threshold: float = 0.5) -> dict[str, int]:
        """Drops orphans of every kind, shrinks bases, sweeps unknown objects; counts of what went, and of packs worth compacting."""
        c = self.catalog()
        counts = {r["kind"]: r["gone"] for r in self._delete(c, c.backup.select("id").limit(0)).collect()}
        return {**counts, "compactable_packs": layout.compactable(self.catalog().pack, threshold).count()}

    def reassign(self, by: str = "time") -> DataFrame:
        """Numbers the snapshots from 1 in an order; id, new_id."""
        c = self.catalog()
        with self._staged(lookups.reassign(c.backup, by)) as ids:
            rows = [tuple(r) for r in ids.collect()]
            c["backup"] = c.backup.join(ids, "id").withColumn("id", F.col("new_id")).select(*c.backup.columns)
            self._publish(c)
        return self.spark.createDataFrame(rows, "id int, new_id long")

    def vacuum(self) -> tuple[int, int]:
        """(bytes before, bytes after) of the catalog, of which only the newest version stays."""
        return Catalog.vacuum(self.spark, f"{self.uri}/catalog")

    def _direct_only(self, c: Catalog) -> None:
        if not c.blob.where("storage_method <> 1").isEmpty():
            raise NotImplementedError("chunked contents are not migrated")

    def _restored(self, c: Catalog, rows: DataFrame) -> DataFrame:
        """Files with the blob columns of `rows` (id and blob's columns)."""
        b = rows.select(F.col("id").alias("blob_id"), *(F.col(n).alias(f"blob_{n}") for n in rows.columns if n != "id"))
        held = [n for n in c.file.columns if not n.startswith("blob_")]
        return c.file.select(*held, "blob_id").join(b, "blob_id", "left").select(*c.file.columns)

    def _migrate(self, c: Catalog, moved: Column, change: dict[str, Column], codec: str | None) -> int:
        """Stores the contents of the blobs that `moved` picks anew under changed columns; returns their number."""
        self._direct_only(c)
        old = c.blob.columns
        with self._staged(self._data(c.blob.where(moved)).withColumns(change)) as rows:
            damaged = rows.where("data is null").select("id").first()
            if damaged is not None:
                raise NotFound(f"content of blob {damaged['id']}")
            done = rows.limit(0)
            for each in [codec] if codec else [r[0] for r in rows.select("compress").distinct().collect()]:
                part = rows.where(F.col("compress") == each)
                packed = part if each == "plain" else part.withColumn("data", compress(F.col("data"), each))
                archives.write_objects(packed, f"{self.root}/blobs/{each}")
                done = done.unionByName(packed.withColumn("stored_size", F.octet_length("data").cast("long")))
            blob = c.blob.join(rows.select("id"), "id", "left_anti").select(*old).unionByName(done.select(*old))
            c.update(blob=blob, file=self._restored(c, blob))
            c["fileset"] = snapshots.recount(c.file, c.fileset)
            c["backup"] = snapshots.finalize_backups(c.backup, c.fileset)
            count = rows.count()
            self._publish(c)
        self.sweep()
        return count

    def migrate_compress(self, codec: str) -> int:
        """Stores every content with another codec anew."""
        c = self.catalog()
        return self._migrate(c, F.col("compress") != codec, {"compress": F.lit(codec)}, codec)

    def migrate_hash(self, method: str) -> int:
        """Names every content by another hash; contents that would share a new one raise, and nothing changes."""
        c = self.catalog()
        if c.db_meta.first()["hash_method"] == method:
            return 0
        named = self._data(c.blob).select("id", "hash", content.content_hash(F.col("data"), method).alias("new_hash"))
        crossed = content.rehash_collisions(named.where("new_hash is not null")).first()
        if crossed is not None:
            raise ValueError(f"several contents would be {crossed['new_hash']}")
        c["db_meta"] = c.db_meta.withColumn("hash_method", F.lit(method))
        return self._migrate(c, F.lit(True), {"hash": content.content_hash(F.col("data"), method)}, None)
