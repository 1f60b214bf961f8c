"""Snapshots as base plus delta: merging, comparing, allocating, shrinking, deleting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.lookups import numbered
from lamina.schema import ROLE_ADD, ROLE_OVERRIDE, ROLE_REMOVE

COVERS = (ROLE_OVERRIDE, ROLE_ADD, ROLE_REMOVE)
#: Columns in which an object counts as unchanged for a delta.
SAME = ("mode", "content", "blob_hash", "uid", "gid", "mtime", "mtime_ns_part")


def merge(file: DataFrame, pairs: DataFrame) -> DataFrame:
    """base, delta and the file columns of each snapshot view of `pairs` (base, delta).

    A base's rows that no role of the delta covers, and the delta's added and overriding rows.
    """
    rows = [c for c in file.columns if c != "fileset_id"]
    base = pairs.join(file, F.col("base") == F.col("fileset_id"))
    covers = file.where(F.col("role").isin(*COVERS)).select(F.col("fileset_id").alias("delta"), "path")
    kept = base.join(covers, ["delta", "path"], "left_anti")
    own = pairs.join(file.where(F.col("role").isin(ROLE_OVERRIDE, ROLE_ADD)), F.col("delta") == F.col("fileset_id"))
    return kept.select("base", "delta", *rows).unionByName(own.select("base", "delta", *rows))


def merge_paths(file: DataFrame, pairs: DataFrame) -> DataFrame:
    """base, delta, path without looking at overrides: base and added, less removed."""
    base = pairs.join(file.select("fileset_id", "path"), F.col("base") == F.col("fileset_id")).select("base", "delta", "path")
    delta = pairs.join(file.select("fileset_id", "path", "role"), F.col("delta") == F.col("fileset_id"))
    removed = delta.where(F.col("role") == ROLE_REMOVE).select("base", "delta", "path")
    return base.union(delta.where(F.col("role") == ROLE_ADD).select("base", "delta", "path")).distinct().join(removed, ["base", "delta", "path"], "left_anti")


def keyed_delta(old: DataFrame, new: DataFrame, key: list[str], same: Callable[[str, str], Column]) -> DataFrame:
    """key, change (added, deleted, changed): rows present in one side only or not `same(old alias, new alias)`."""
    o, n = old.withColumn("__there", F.lit(1)).alias("o"), new.withColumn("__there", F.lit(1)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full")
    change = F.when(F.col("n.__there").isNull(), "deleted").when(F.col("o.__there").isNull(), "added").when(~same("o", "n"), "changed")
    return joined.select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in key), change.alias("change"), F.col("o.blob_raw_size").alias("old_size"), F.col("n.blob_raw_size").alias("new_size")).where("change is not null")


def same_columns(columns: tuple[str, ...]) -> Callable[[str, str], Column]:
    """Equal in all columns, nulls equal to nulls; a null nanosecond part counts as 0."""

    def equal(old: str, new: str) -> Column:
        out = F.lit(True)
        for c in columns:
            left, right = F.col(f"{old}.{c}"), F.col(f"{new}.{c}")
            if c == "mtime_ns_part":
                left, right = F.coalesce(left, F.lit(0)), F.coalesce(right, F.lit(0))
            out = out & left.eqNullSafe(right)
        return out

    return equal


def diff(old: DataFrame, new: DataFrame, status: bool = False) -> DataFrame:
    """path, change of two merged snapshots; owner and time count only with `status`."""
    return keyed_delta(old, new, ["path"], same_columns(("mode", "blob_hash", "content", *(SAME[3:] if status else ()))))


def diff_summary(changes: DataFrame) -> DataFrame:
    """One row: counts by change and the net size."""
    return changes.agg(
        *(F.count_if(F.col("change") == kind).alias(kind) for kind in ("added", "deleted", "changed")),
        F.coalesce(F.sum(F.coalesce("new_size", F.lit(0)) - F.coalesce("old_size", F.lit(0))), F.lit(0)).alias("net_size"),
    )


def stat_unchanged(old: DataFrame, new: DataFrame) -> DataFrame:
    """path of files whose status says that their content need not be read again."""
    return new.alias("n").join(old.alias("o"), "path").where(same_columns(("mode", "uid", "gid", "mtime", "mtime_ns_part", "blob_raw_size"))("o", "n")).select("path")


def signed_delta(changes: DataFrame) -> DataFrame:
    """role, objects, files, size of the delta that turns old into new."""
    role = F.when(F.col("change") == "added", ROLE_ADD).when(F.col("change") == "changed", ROLE_OVERRIDE).otherwise(ROLE_REMOVE)
    files = F.when(F.col("change") == "added", 1).when(F.col("change") == "deleted", -1).otherwise(0)
    return changes.groupBy(role.alias("role")).agg(F.count("*").alias("objects"), F.sum(files).alias("files"), F.sum(F.coalesce("new_size", F.lit(0)) - F.coalesce("old_size", F.lit(0))).alias("size"))


def allocation_candidates(new: DataFrame, file: DataFrame, fileset: DataFrame, backup: DataFrame, last: int = 2) -> DataFrame:
    """base_id, delta, files, refs, delta_objects, fits for the newest `last` bases, against the new snapshot's files.

    A base fits if the delta is below a fifth of its files, it has under 100 snapshots, and its deltas hold
    under one and a half times its files.
    """
    bases = fileset.where("base_id = 0").orderBy(F.desc("id")).limit(last).select(F.col("id").alias("base_id"), F.col("file_object_count").alias("files"))
    olds = file.join(F.broadcast(bases), F.col("fileset_id") == F.col("base_id")).drop("fileset_id")
    news = new.join(F.broadcast(bases.select("base_id")), how="cross")
    deltas = keyed_delta(olds, news, ["base_id", "path"], same_columns(SAME)).groupBy("base_id").agg(F.count("*").alias("delta"))
    refs = backup.groupBy(F.col("fileset_id_base").alias("base_id")).agg(F.count("*").alias("refs"))
    held = fileset.where("base_id <> 0").groupBy("base_id").agg(F.sum("file_object_count").alias("delta_objects"))
    out = bases.join(deltas, "base_id", "left").join(refs, "base_id", "left").join(held, "base_id", "left").na.fill(0)
    return out.withColumn("fits", (F.col("delta") < 0.2 * F.col("files")) & (F.col("refs") < 100) & (F.col("delta_objects") < 1.5 * F.col("files")))


def allocate_base(candidates: DataFrame) -> DataFrame:
    """base_id of the fitting candidate with the smallest delta, the newest on ties; null if none fits."""
    return candidates.agg(F.min_by("base_id", F.when(F.col("fits"), F.struct(F.col("delta"), -F.col("base_id")))).alias("base_id"))


def shrinkable(file: DataFrame, fileset: DataFrame, allow_empty: bool = False) -> DataFrame:
    """fileset_id, path of base files that every delta of the base overrides or removes.

    A base without deltas has no such file, unless `allow_empty` (then all its files are).
    """
    deltas = fileset.where("base_id <> 0").select(F.col("id").alias("delta"), F.col("base_id").alias("base"))
    totals = deltas.groupBy("base").agg(F.count("*").alias("all"))
    covers = file.where(F.col("role").isin(ROLE_OVERRIDE, ROLE_REMOVE)).join(deltas, F.col("fileset_id") == F.col("delta")).groupBy("base", "path").agg(F.count_distinct("delta").alias("covered"))
    bases = fileset.where("base_id = 0").select(F.col("id").alias("base"))
    own = file.join(bases, F.col("fileset_id") == F.col("base")).join(totals, "base", "left").join(covers, ["base", "path"], "left").na.fill(0, ["all", "covered"])
    enough = F.col("all") == F.col("covered")
    return own.where(enough if allow_empty else enough & (F.col("all") > 0)).select("fileset_id", "path")


def shrink(file: DataFrame, fileset: DataFrame) -> DataFrame:
    """The file table after shrinking: unused base files go, their overrides become additions, their removals go."""
    unused = shrinkable(file, fileset).select(F.col("fileset_id").alias("base"), "path", F.lit(True).alias("unused"))
    owner = fileset.select(F.col("id").alias("fileset_id"), F.when(F.col("base_id") == 0, F.col("id")).otherwise(F.col("base_id")).alias("base"), (F.col("base_id") == 0).alias("is_base"))
    marked = file.join(owner, "fileset_id").join(unused, ["base", "path"], "left")
    gone = F.coalesce("unused", F.lit(False)) & (F.col("is_base") | (F.col("role") == ROLE_REMOVE))
    role = F.when(F.col("unused") & (F.col("role") == ROLE_OVERRIDE), ROLE_ADD).otherwise(F.col("role"))
    return marked.where(~gone).withColumn("role", role).select(*file.columns)


def delete_paths(file: DataFrame, base: int, delta: int, doomed: Column) -> DataFrame:
    """The delta's rows after deleting the paths from its snapshot: added and overriding rows go, base paths get removal marks."""
    own = file.where(F.col("fileset_id") == delta)
    kept = own.where(~doomed | (F.col("role") == ROLE_REMOVE))
    marks = file.where((F.col("fileset_id") == base) & doomed).join(kept.select("path"), "path", "left_anti")
    return kept.select("path", "role").union(marks.select("path", F.lit(ROLE_REMOVE)))


def delete_cascade(backup: DataFrame, doomed: DataFrame, fileset: DataFrame, file: DataFrame, blob: DataFrame) -> DataFrame:
    """kind, id of what goes with the snapshots `doomed` (id): unreferenced filesets and the blobs that only they hold."""
    left = backup.join(doomed, "id", "left_anti")
    used = left.select(F.col("fileset_id_base").alias("id")).union(left.select("fileset_id_delta")).distinct()
    filesets = fileset.select("id").join(used, "id", "left_anti")
    kept = file.join(filesets.select(F.col("id").alias("fileset_id")), "fileset_id", "left_anti").where("blob_hash is not null").select(F.col("blob_hash").alias("hash")).distinct()
    blobs = blob.join(kept, "hash", "left_anti").select("id")
    return filesets.select(F.lit("fileset").alias("kind"), F.col("id").cast("long").alias("id")).union(blobs.select(F.lit("blob"), F.col("id").cast("long")))


def delete_below(gone: DataFrame, blob_bindings: DataFrame, groups: DataFrame, chunk_bindings: DataFrame, chunk: DataFrame, pack: DataFrame) -> DataFrame:
    """kind, id of what goes with the blobs `gone` (id): groups that no blob is left to hold, their chunks, and packs without live entries."""
    held = blob_bindings.join(gone.select(F.col("id").alias("blob_id")), "blob_id", "left_anti").select(F.col("chunk_group_id").alias("id")).distinct()
    lost = groups.select("id").join(held, "id", "left_anti")
    bound = chunk_bindings.join(lost.select(F.col("id").alias("chunk_group_id")), "chunk_group_id", "left_anti").select(F.col("chunk_id").alias("id")).distinct()
    chunks = chunk.select("id", "pack_id").join(bound, "id", "left_anti")
    live = chunk.join(chunks.select("id"), "id", "left_anti").select(F.col("pack_id").alias("id")).distinct()
    packs = pack.select("id").join(live, "id", "left_anti")
    parts = [found.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id")) for kind, found in (("chunk_group", lost), ("chunk", chunks), ("pack", packs))]
    return parts[0].union(parts[1]).union(parts[2])


def finalize_files(file: DataFrame, blob: DataFrame) -> DataFrame:
    """The files with the ids of their blobs by hash; a file whose blob is missing fails the query when it runs."""
    ids = blob.select(F.col("hash").alias("blob_hash"), F.col("id").alias("__id"))
    rows = file.drop("blob_id").join(ids, "blob_hash", "left")
    missing = F.raise_error(F.concat(F.lit("blob of file does not exist: "), F.col("path")))
    return rows.select(*(F.when(F.col("blob_hash").isNotNull(), F.coalesce("__id", missing)).alias("blob_id") if c == "blob_id" else F.col(c) for c in file.columns))


def finalize_backups(backup: DataFrame, fileset: DataFrame) -> DataFrame:
    """The snapshots with counts and sizes as the sums of their base and delta filesets; one without either fails the query when it runs."""
    sums = ("file_count", "file_raw_size_sum", "file_stored_size_sum")
    b = fileset.select(F.col("id").alias("fileset_id_base"), *(F.col(c).alias(f"b_{c}") for c in sums))
    d = fileset.select(F.col("id").alias("fileset_id_delta"), *(F.col(c).alias(f"d_{c}") for c in sums))
    rows = backup.drop(*sums).join(b, "fileset_id_base", "left").join(d, "fileset_id_delta", "left")
    return rows.select(*(F.coalesce(F.col(f"b_{c}") + F.col(f"d_{c}"), F.raise_error(F.lit("fileset of a snapshot is missing"))).alias(c) if c in sums else F.col(c) for c in backup.columns))


def nth_latest(backup: DataFrame, n: int) -> DataFrame:
    from lamina.operators.predicates import order

    return backup.orderBy(*order("time_r")).offset(n).limit(1)


def parent_first(files: DataFrame) -> DataFrame:
    """path, position in which a restore creates entries."""
    return numbered(files.select("path"), ["path"], "position")


def recount(file: DataFrame, fileset: DataFrame) -> DataFrame:
    """The filesets with their counts and sums taken from the files anew.

    A base counts what it holds; a delta what it adds, less what it removes, and by how much its overrides differ.
    """
    old = file.select(F.col("fileset_id").alias("base_id"), "path", *(F.col(f"blob_{s}_size").alias(f"old_{s}") for s in ("raw", "stored")))
    rows = file.join(fileset.select(F.col("id").alias("fileset_id"), "base_id"), "fileset_id").join(old, ["base_id", "path"], "left")
    is_base, role = F.col("base_id") == 0, F.col("role")
    plus, minus = is_base | role.isin(ROLE_ADD, ROLE_OVERRIDE), ~is_base & role.isin(ROLE_OVERRIDE, ROLE_REMOVE)
    signed = lambda new, old: F.sum(F.when(plus, new).otherwise(0) - F.when(minus, old).otherwise(0))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    sums = rows.groupBy(F.col("fileset_id").alias("id")).agg(
        F.count("*").alias("file_object_count"), signed(F.lit(1), F.lit(1)).alias("file_count"),
        *(signed(zero(f"blob_{s}_size"), zero(f"old_{s}")).cast("long").alias(f"file_{s}_size_sum") for s in ("raw", "stored")),
    )
    return fileset.select("id", "base_id").join(sums, "id", "left").na.fill(0).select("id", "base_id", "file_object_count", "file_count", "file_raw_size_sum", "file_stored_size_sum")


def audit_recount(file: DataFrame, fileset: DataFrame) -> DataFrame:
    """id, kind: bad_file_stats of filesets whose file count or sums are not those of `recount`."""
    names = ("file_count", "file_raw_size_sum", "file_stored_size_sum")
    want = recount(file, fileset).select("id", *(F.col(n).alias(f"want_{n}") for n in names))
    differs = F.lit(False)
    for n in names:
        differs = differs | (F.col(n) != F.col(f"want_{n}"))
    return fileset.join(want, "id").where(differs).select(F.col("id").cast("long").alias("id"), F.lit("bad_file_stats").alias("kind"))
