"""One query per operator over the derived catalog, with independent SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions import units
from lamina.operators import audits, content, layout, lineage, lookups, predicates, retention, snapshots, stats
from lamina.plans.tables import Tables, oracle
from lamina.streaming import presence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function of Tables as a query, with its SQL."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or build.__name__
        QUERIES[key] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = oracle(sql)
        return build

    return add


# scans and projections

for _table in ("blob", "chunk", "chunk_group", "chunk_binding", "blob_binding", "fileset", "backup", "pack"):
    query(f"select * from {_table}", f"scan_{_table}")(lambda t, _n=_table: getattr(t, _n))


@query("select fileset_id, path, role, mode, content, blob_hash, coalesce(blob_raw_size, -1) as blob_raw_size, uid, gid, mtime from file")
def scan_file(t: Tables) -> DataFrame:
    return t.file.select("fileset_id", "path", "role", "mode", "content", "blob_hash", "blob_raw_size", "uid", "gid", "mtime").na.fill(-1, ["blob_raw_size"])


@query("select * from blob where id = 17")
def point_lookup(t: Tables) -> DataFrame:
    return t.blob.where("id = 17")


_keys = "select distinct cast(o_custkey as bigint) as id from orders"


@query(f"select k.id, b.hash, coalesce(b.raw_size, -1) as raw_size from ({_keys}) k left join blob b on b.id = k.id")
def keyed_left_lookup(t: Tables) -> DataFrame:
    return lookups.keyed_left(t.orders.select(F.col("o_custkey").alias("id")), t.blob.select("id", "hash", "raw_size"), ["id"]).na.fill(-1)


@query("select k.chunk_group_id, k.chunk_id, coalesce(b.chunk_offset, -1) as chunk_offset from (select distinct l_orderkey + 1 as chunk_group_id, l_suppkey + 1 as chunk_id from lineitem) k left join chunk_binding b using (chunk_group_id, chunk_id)")
def composite_lookup(t: Tables) -> DataFrame:
    keys = t.lineitem.select((F.col("l_orderkey") + 1).alias("chunk_group_id"), (F.col("l_suppkey") + 1).alias("chunk_id"))
    return lookups.keyed_left(keys, t.chunk_binding, ["chunk_group_id", "chunk_id"]).select("chunk_group_id", "chunk_id", "chunk_offset").na.fill(-1)


@query("select k.id, b.id is not null as present from (select distinct o_custkey % 3000 as id from orders) k left join (select distinct id from fileset) b on k.id = b.id")
def existence_flags(t: Tables) -> DataFrame:
    return lookups.existence(t.orders.select((F.col("o_custkey") % 3000).alias("id")), t.fileset, "id")


@query("select distinct path, role from file")
def project_paths(t: Tables) -> DataFrame:
    return t.file.select("path", "role").distinct()


@query("select id, hash from blob where storage_method = 2")
def filter_storage_method(t: Tables) -> DataFrame:
    return t.blob.where("storage_method = 2").select("id", "hash")


@query("select * from chunk where id in (select l_partkey from lineitem where l_quantity < 10)")
def in_list_semi(t: Tables) -> DataFrame:
    return lookups.in_list(t.chunk, t.lineitem.where("l_quantity < 10").select(F.col("l_partkey").alias("id")), ["id"])


@query("select id, hash from blob where starts_with(hash, 'a3') or starts_with(hash, 'f')")
def hash_prefix(t: Tables) -> DataFrame:
    return t.blob.where(predicates.hash_prefix(F.col("hash"), "a3") | predicates.hash_prefix(F.col("hash"), "f")).select("id", "hash")


@query("select substr(hash, 1, 2) as prefix, count(*) as candidates, min(hash) as first from chunk group by all having count(*) > 1")
def resolve_prefix(t: Tables) -> DataFrame:
    groups = t.chunk.groupBy(F.substring("hash", 1, 2).alias("prefix")).agg(F.count("*").alias("candidates"), F.min("hash").alias("first"))
    return groups.where("candidates > 1")


@query("select id, sha256('PBPK_' || id) as name from pack where starts_with(sha256('PBPK_' || id), 'a') or id < 20")
def pack_file_name(t: Tables) -> DataFrame:
    named = t.pack.select("id", layout.pack_name(F.col("id")).alias("name"))
    return named.where(predicates.hash_prefix(F.col("name"), "a") | (F.col("id") < 20))


@query("select id, timestamp, creator from backup where id between 100 and 9000 and creator = 'player:7' and timestamp * 1000000000 + timestamp_ns_part between 800000000000000000 and 900000000000000007")
def backup_filter(t: Tables) -> DataFrame:
    return predicates.backup_filter(t.backup, ids=(100, 9000), creator="player:7", since=800000000000000000, until=900000000000000007).select("id", "timestamp", "creator")


for _policy, _sql in {
    "tag_equals": "coalesce(tags->>'$.temporary' = 'true', false)", "tag_not_equals": "coalesce(tags->>'$.temporary' <> 'true', true)",
    "tag_exists_not_equals": "coalesce(tags->>'$.temporary' <> 'false', false)", "tag_exists": "(tags->>'$.protected') is not null",
}.items():
    query(f"select id, tags from backup where {_sql}", _policy)(
        lambda t, _p=_policy: t.backup.where(predicates.tag_exists(F.col("tags"), "protected") if _p == "tag_exists" else getattr(predicates, _p)(F.col("tags"), "temporary", "false" if "exists" in _p else "true")).select("id", "tags")
    )


@query("select id from backup where (tags->>'$.protected') is null")
def tag_not_exists(t: Tables) -> DataFrame:
    return t.backup.where(~predicates.tag_exists(F.col("tags"), "protected")).select("id")


_visible = "coalesce(tags->>'$.temporary' <> 'true', true) and coalesce(tags->>'$.hidden' <> 'true', true)"


@query(f"select id, timestamp, timestamp_ns_part from backup where {_visible} order by timestamp desc, timestamp_ns_part desc, id desc limit 25 offset 50")
def list_page(t: Tables) -> DataFrame:
    return predicates.page(t.backup.where(predicates.visible(F.col("tags"))).select("id", "timestamp", "timestamp_ns_part"), 3, 25)


@query(f"select cast(ceil(count(*) / 25.0) as bigint) as pages, count(*) as backups from backup where {_visible}")
def page_count(t: Tables) -> DataFrame:
    return t.backup.where(predicates.visible(F.col("tags"))).agg(F.ceil(F.count("*") / 25.0).cast("long").alias("pages"), F.count("*").alias("backups"))


@query("select distinct path from file where starts_with(path, 'en/src1/') and not contains(substr(path, 9), '/')")
def dir_children(t: Tables) -> DataFrame:
    return t.file.where(predicates.child_of(F.col("path"), "en/src1")).select("path").distinct()


@query("select distinct path from file where path = 'fr' or starts_with(path, 'fr/')")
def dir_subtree(t: Tables) -> DataFrame:
    return t.file.where(predicates.within(F.col("path"), "fr")).select("path").distinct()


@query("select regexp_extract(path, '^(.*)/[^/]*$', 1) as parent, count(distinct path) as children from file group by all")
def parent_index(t: Tables) -> DataFrame:
    return t.file.groupBy(predicates.parent(F.col("path")).alias("parent")).agg(F.count_distinct("path").alias("children"))


@query("select path, row_number() over (order by path) as position from (select distinct path from file where fileset_id = 2 and (starts_with(path, 'en/') or starts_with(path, 'de/')))")
def export_listing(t: Tables) -> DataFrame:
    targets = F.array(F.lit("en"), F.lit("de"))
    inside = t.file.where("fileset_id = 2").where(F.exists(targets, lambda x: F.col("path").startswith(F.concat(x, F.lit("/")))))
    return snapshots.parent_first(inside.select("path").distinct())


@query("select distinct path from file where (regexp_matches(path, '^(?:.*/)?[^/]*7(?:/.*)?$') or starts_with(path, 'de/src1/')) and not regexp_matches(path, '^(?:.*/)?[^/]*17(?:/.*)?$')")
def rule_match(t: Tables) -> DataFrame:
    return t.file.where(predicates.rule_match(F.col("path"), ["*7", "/de/src1/", "!*17"])).select("path").distinct()


@query("select distinct path, case when blob_raw_size >= 4096 and starts_with(path, 'en/') then 'fastcdc_32k' when blob_raw_size >= 1024 then 'fixed_4k' end as rule, case when blob_raw_size < 512 then 'plain' else 'zstd' end as codec from file where blob_raw_size is not null")
def chunk_rule(t: Tables) -> DataFrame:
    from lamina.functions import codecs

    size = F.col("blob_raw_size")
    rule = predicates.first_rule(size, F.col("path"), [("fastcdc_32k", 4096, ["/en/"]), ("fixed_4k", 1024, ["*"])])
    return t.file.where("blob_raw_size is not null").select("path", rule.alias("rule"), codecs.method_for(size, "zstd", 512).alias("codec")).distinct()


@query("select fileset_id, case mode & 61440 when 32768 then 'file' when 16384 then 'directory' when 40960 then 'symlink' else 'other' end as kind, count(*) as n from file group by all")
def file_type_counts(t: Tables) -> DataFrame:
    return t.file.groupBy("fileset_id", predicates.kind(F.col("mode")).alias("kind")).agg(F.count("*").alias("n"))


# joins and lineage


@query("select chunk_group_id, chunk_offset, chunk_id, hash, raw_size, stored_size from chunk_binding join chunk on chunk_id = id")
def group_chunks(t: Tables) -> DataFrame:
    return lineage.group_chunks(t.chunk_binding, t.chunk)


@query("select blob_id, chunk_group_offset, chunk_group_id, chunk_count, chunk_raw_size_sum from blob_binding join chunk_group on chunk_group_id = id")
def blob_groups(t: Tables) -> DataFrame:
    return lineage.blob_groups(t.blob_binding, t.chunk_group)


_chunks = "select blob_id, chunk_group_offset + chunk_offset as \"offset\", chunk_id, hash, raw_size, stored_size from blob_binding join chunk_binding using (chunk_group_id) join chunk on chunk_id = id"


@query(f"{_chunks} where blob_id = 42")
def blob_chunks(t: Tables) -> DataFrame:
    return lineage.blob_chunks(t.blob_binding.where("blob_id = 42"), t.chunk_binding, t.chunk)


@query(f"select k.id, count(hash) as chunks, count(distinct hash) as distinct_chunks, min(\"offset\") as first from (select id from blob where storage_method = 2) k left join ({_chunks}) c on k.id = c.blob_id group by k.id")
def blob_chunks_batch(t: Tables) -> DataFrame:
    keys = t.blob.where("storage_method = 2").select("id")
    chunks = lineage.blob_chunks(t.blob_binding, t.chunk_binding, t.chunk)
    return keys.join(chunks, F.col("id") == F.col("blob_id"), "left").groupBy("id").agg(F.count("hash").alias("chunks"), F.count_distinct("hash").alias("distinct_chunks"), F.min("offset").alias("first"))


@query("select blob_id, sum(chunk_count)::bigint as chunks from blob_binding join chunk_group on chunk_group_id = id group by blob_id")
def blob_chunk_count(t: Tables) -> DataFrame:
    return lineage.blob_groups(t.blob_binding, t.chunk_group).groupBy("blob_id").agg(F.sum("chunk_count").alias("chunks"))


@query("select sum(chunk_count)::bigint as refs from blob_binding join chunk_group on chunk_group_id = id join blob on blob_id = blob.id where storage_method = 2")
def chunk_refs(t: Tables) -> DataFrame:
    return lineage.blob_groups(t.blob_binding, t.chunk_group).join(t.blob.where("storage_method = 2").select(F.col("id").alias("blob_id")), "blob_id", "left_semi").agg(F.sum("chunk_count").alias("refs"))


@query("select sum(b.file_count + d.file_count)::bigint as files, sum(b.file_raw_size_sum + d.file_raw_size_sum)::bigint as raw_size from backup k join fileset b on k.fileset_id_base = b.id join fileset d on k.fileset_id_delta = d.id")
def file_totals(t: Tables) -> DataFrame:
    b = t.fileset.select(F.col("id").alias("fileset_id_base"), F.col("file_count").alias("bc"), F.col("file_raw_size_sum").alias("br"))
    d = t.fileset.select(F.col("id").alias("fileset_id_delta"), F.col("file_count").alias("dc"), F.col("file_raw_size_sum").alias("dr"))
    rows = t.backup.select("fileset_id_base", "fileset_id_delta").join(b, "fileset_id_base").join(d, "fileset_id_delta")
    return rows.agg(F.sum(F.col("bc") + F.col("dc")).alias("files"), F.sum(F.col("br") + F.col("dr")).alias("raw_size"))


@query("select distinct b.id, b.hash from blob b join blob_binding on b.id = blob_id join chunk_binding using (chunk_group_id) where chunk_id < 20")
def affected_blobs(t: Tables) -> DataFrame:
    groups = t.chunk_binding.where("chunk_id < 20").select("chunk_group_id")
    held = t.blob_binding.join(groups, "chunk_group_id", "left_semi").select(F.col("blob_id").alias("id"))
    return t.blob.join(held, "id", "left_semi").select("id", "hash")


_cg_orphan = "select chunk_group_id, chunk_offset, chunk_id from chunk_binding b where not exists (select 1 from chunk_group g where g.id = b.chunk_group_id) or not exists (select 1 from chunk c where c.id = b.chunk_id)"


@query(_cg_orphan)
def orphan_cg_bindings(t: Tables) -> DataFrame:
    return audits.orphan_chunk_bindings(t.chunk_binding, t.chunk_group, t.chunk)


@query("select * from (select blob_id, chunk_group_offset, case when b.id is null or g.id is null then 'orphan' when storage_method <> 2 then 'bad_storage_method' end as kind from blob_binding left join blob b on blob_id = b.id left join chunk_group g on chunk_group_id = g.id) where kind is not null")
def orphan_blob_bindings(t: Tables) -> DataFrame:
    return audits.bad_blob_bindings(t.blob_binding, t.blob, t.chunk_group)


@query("select id, hash from blob where hash not in (select blob_hash from file where blob_hash is not null)")
def orphan_blobs(t: Tables) -> DataFrame:
    return audits.orphans(t.blob.select("id", "hash"), "hash", t.file, "blob_hash").select("id", "hash")


@query("select id from chunk where id not in (select chunk_id from chunk_binding)")
def orphan_chunks(t: Tables) -> DataFrame:
    return audits.orphans(t.chunk.select("id"), "id", t.chunk_binding, "chunk_id")


@query("select id from chunk_group where id not in (select chunk_group_id from blob_binding)")
def orphan_chunk_groups(t: Tables) -> DataFrame:
    return audits.orphans(t.chunk_group.select("id"), "id", t.blob_binding, "chunk_group_id")


@query("select id from fileset where id not in (select fileset_id_base from backup) and id not in (select fileset_id_delta from backup)")
def orphan_filesets(t: Tables) -> DataFrame:
    return audits.orphan_filesets(t.fileset, t.backup).select("id")


@query("select fileset_id, path from file where fileset_id not in (select id from fileset)")
def orphan_files(t: Tables) -> DataFrame:
    return t.file.join(t.fileset.select(F.col("id").alias("fileset_id")), "fileset_id", "left_anti").select("fileset_id", "path")


@query("select chunk_group_id, sum(stored_size)::bigint as stored from (select distinct chunk_group_id, hash, stored_size from chunk_binding join chunk on chunk_id = id) group by all")
def unique_stored_sum(t: Tables) -> DataFrame:
    return stats.unique_stored(lineage.group_chunks(t.chunk_binding, t.chunk), "chunk_group_id")


_containing = """
select f.fileset_id, f.path, k.id as backup_id from file f join backup k on k.fileset_id_base = f.fileset_id
where not exists (select 1 from file d where d.fileset_id = k.fileset_id_delta and d.path = f.path and d.role in (2, 3, 4))
union select f.fileset_id, f.path, k.id from file f join backup k on k.fileset_id_delta = f.fileset_id"""


@query(f"select fileset_id, path, count(*) as backups, min(backup_id) as first from ({_containing}) group by all")
def backups_containing_file(t: Tables) -> DataFrame:
    return lineage.containing_counts(t.file.select("fileset_id", "path"), t.file, t.backup)


@query("select fileset_id, count(distinct id) as backups, min(id) as first from (select fileset_id_base as fileset_id, id from backup union all select fileset_id_delta, id from backup) group by all")
def fileset_backups(t: Tables) -> DataFrame:
    return lineage.fileset_backups(t.backup).groupBy("fileset_id").agg(F.count("*").alias("backups"), F.min("backup_id").alias("first"))


@query("""with c as (select id from chunk where id % 397 = 7), g as (select distinct chunk_group_id as id from chunk_binding where chunk_id in (select id from c)),
b as (select distinct blob_id as id from blob_binding where chunk_group_id in (select id from g)), s as (select distinct fileset_id as id from file where blob_id in (select id from b)),
k as (select id from backup where fileset_id_base in (select id from s) or fileset_id_delta in (select id from s))
select 'chunk_group' as kind, id from g union all select 'blob', id from b union all select 'fileset', id from s union all select 'backup', id from k""")  # fmt: skip
def affected_range(t: Tables) -> DataFrame:
    return lineage.affected(t.chunk.where("id % 397 = 7").select("id"), t.chunk_binding, t.blob_binding, t.file, t.backup)


@query(f"select p.blob_id, p.position, c.chunk_id from (select distinct o_custkey % 1100 + 1 as blob_id, (o_orderkey * 131) % 20000 as position from orders) p join ({_chunks}) c on c.blob_id = p.blob_id and p.position >= c.\"offset\" and p.position < c.\"offset\" + c.raw_size")
def range_lookup(t: Tables) -> DataFrame:
    positions = t.orders.select((F.col("o_custkey") % 1100 + 1).alias("blob_id"), (F.col("o_orderkey") * 131 % 20000).alias("position")).distinct()
    return lineage.chunk_at(positions, lineage.blob_chunks(t.blob_binding, t.chunk_binding, t.chunk)).select("blob_id", "position", "chunk_id")


# the same operators over whole tables


@query("""with g as (select distinct chunk_group_id as id from chunk_binding where chunk_id in (select id from chunk)),
b as (select distinct blob_id as id from blob_binding where chunk_group_id in (select id from g)), s as (select distinct fileset_id as id from file where blob_id in (select id from b)),
k as (select id from backup where fileset_id_base in (select id from s) or fileset_id_delta in (select id from s))
select 'chunk_group' as kind, id from g union all select 'blob', id from b union all select 'fileset', id from s union all select 'backup', id from k""")  # fmt: skip
def affected_whole(t: Tables) -> DataFrame:
    return lineage.affected(t.chunk.select("id"), t.chunk_binding, t.blob_binding, t.file, t.backup)


# snapshots

_pairs = "(select distinct fileset_id_base as base, fileset_id_delta as delta from backup)"


def _views(t: Tables) -> DataFrame:
    return t.backup.select(F.col("fileset_id_base").alias("base"), F.col("fileset_id_delta").alias("delta")).distinct()


_merge = f"""select k.base, k.delta, f.* exclude (fileset_id) from {_pairs} k join file f on f.fileset_id = k.base
  where not exists (select 1 from file d where d.fileset_id = k.delta and d.path = f.path and d.role in (2, 3, 4))
  union all select k.base, k.delta, f.* exclude (fileset_id) from {_pairs} k join file f on f.fileset_id = k.delta where f.role in (2, 3)"""


@query(f"select base, delta, path, role, mode, blob_hash, coalesce(blob_raw_size, -1) as blob_raw_size from ({_merge})")
def snapshot_merge(t: Tables) -> DataFrame:
    return snapshots.merge(t.file, _views(t)).select("base", "delta", "path", "role", "mode", "blob_hash", "blob_raw_size").na.fill(-1, ["blob_raw_size"])


@query(f"select base, delta, path from (select distinct k.base, k.delta, f.path from {_pairs} k join file f on f.fileset_id = k.base or (f.fileset_id = k.delta and f.role = 3)) p where not exists (select 1 from file d where d.fileset_id = p.delta and d.path = p.path and d.role = 4)")
def snapshot_paths(t: Tables) -> DataFrame:
    return snapshots.merge_paths(t.file, _views(t))


@query(f"select base, delta, path, mode, blob_hash from ({_merge}) where path like '%/src3/%' and path like '%3'")
def file_in_snapshot(t: Tables) -> DataFrame:
    own = t.file.where(F.col("path").contains("/src3/") & F.col("path").endswith("3"))
    return snapshots.merge(own, _views(t)).select("base", "delta", "path", "mode", "blob_hash")


def _view(t: Tables, base: int, delta: int) -> DataFrame:
    return snapshots.merge(t.file, t.spark.createDataFrame([(base, delta)], "base long, delta long")).drop("base", "delta")


def _view_sql(base: int, delta: int) -> str:
    return f"""(select f.* exclude (fileset_id) from file f where f.fileset_id = {base} and not exists (select 1 from file d where d.fileset_id = {delta} and d.path = f.path and d.role in (2, 3, 4))
  union all select f.* exclude (fileset_id) from file f where f.fileset_id = {delta} and f.role in (2, 3))"""


def _diff_sql(status: bool) -> str:
    more = " and a.uid is not distinct from b.uid and a.gid is not distinct from b.gid and a.mtime is not distinct from b.mtime and coalesce(a.mtime_ns_part, 0) = coalesce(b.mtime_ns_part, 0)" if status else ""
    return f"""select coalesce(a.path, b.path) as path, case when b.path is null then 'deleted' when a.path is null then 'added' else 'changed' end as change, a.blob_raw_size as old_size, b.blob_raw_size as new_size
  from {_view_sql(2, 102)} a full join {_view_sql(2, 106)} b on a.path = b.path
  where a.path is null or b.path is null or not (a.mode is not distinct from b.mode and a.blob_hash is not distinct from b.blob_hash and a.content is not distinct from b.content{more})"""


@query(f"select path, change, coalesce(old_size, -1) as old_size, coalesce(new_size, -1) as new_size from ({_diff_sql(False)})")
def snapshot_diff(t: Tables) -> DataFrame:
    return snapshots.diff(_view(t, 2, 102), _view(t, 2, 106)).na.fill(-1)


@query(f"select path, change, coalesce(old_size, -1) as old_size, coalesce(new_size, -1) as new_size from ({_diff_sql(True)})")
def snapshot_diff_status(t: Tables) -> DataFrame:
    return snapshots.diff(_view(t, 2, 102), _view(t, 2, 106), status=True).na.fill(-1)


@query(f"select count(*) filter (change = 'added') as added, count(*) filter (change = 'deleted') as deleted, count(*) filter (change = 'changed') as changed, coalesce(sum(coalesce(new_size, 0) - coalesce(old_size, 0)), 0)::bigint as net_size from ({_diff_sql(False)})")
def diff_summary(t: Tables) -> DataFrame:
    return snapshots.diff_summary(snapshots.diff(_view(t, 2, 102), _view(t, 2, 106)))


@query(f"select case change when 'added' then 3 when 'changed' then 2 else 4 end as role, count(*) as objects, sum(case change when 'added' then 1 when 'deleted' then -1 else 0 end)::bigint as files, sum(coalesce(new_size, 0) - coalesce(old_size, 0))::bigint as size from ({_diff_sql(True)}) group by all")
def fileset_delta(t: Tables) -> DataFrame:
    return snapshots.signed_delta(snapshots.diff(_view(t, 2, 102), _view(t, 2, 106), status=True))


@query(f"select a.path from {_view_sql(2, 102)} a join {_view_sql(2, 106)} b on a.path = b.path where a.mode is not distinct from b.mode and a.uid is not distinct from b.uid and a.gid is not distinct from b.gid and a.mtime is not distinct from b.mtime and coalesce(a.mtime_ns_part, 0) = coalesce(b.mtime_ns_part, 0) and a.blob_raw_size is not distinct from b.blob_raw_size")
def stat_unchanged(t: Tables) -> DataFrame:
    return snapshots.stat_unchanged(_view(t, 2, 102), _view(t, 2, 106))


_same = " and ".join(f"o.{c} is not distinct from n.{c}" for c in ("mode", "content", "blob_hash", "uid", "gid", "mtime")) + " and coalesce(o.mtime_ns_part, 0) = coalesce(n.mtime_ns_part, 0)"
_candidates = f"""select b.base_id, b.files, coalesce((select count(*) from (select * from file where fileset_id = b.base_id) o full join {_view_sql(4, 108)} n on o.path = n.path where o.path is null or n.path is null or not ({_same})), 0) as delta,
  coalesce((select count(*) from backup where fileset_id_base = b.base_id), 0) as refs, coalesce((select sum(file_object_count) from fileset where base_id = b.base_id), 0)::bigint as delta_objects
  from (select id as base_id, file_object_count as files from fileset where base_id = 0 order by id desc limit 3) b"""


@query(f"select *, delta < 0.2 * files and refs < 100 and delta_objects < 1.5 * files as fits from ({_candidates})")
def allocation_candidates(t: Tables) -> DataFrame:
    return snapshots.allocation_candidates(_view(t, 4, 108), t.file, t.fileset, t.backup, 3).select("base_id", "files", "delta", "refs", "delta_objects", "fits")


@query(f"select (select base_id from (select *, delta < 0.9 * files and delta_objects < 9 * files as fits from ({_candidates})) where fits order by delta, base_id desc limit 1) as base_id")
def allocate_base(t: Tables) -> DataFrame:
    found = snapshots.allocation_candidates(_view(t, 4, 108), t.file, t.fileset, t.backup, 3)
    return snapshots.allocate_base(found.withColumn("fits", F.expr("delta < 0.9 * files and delta_objects < 9 * files")))


_shrinkable = """select f.fileset_id, f.path from file f join fileset s on s.id = f.fileset_id and s.base_id = 0
  where (select count(*) from fileset d where d.base_id = s.id) > 0 and (select count(distinct c.fileset_id) from file c join fileset d on c.fileset_id = d.id where d.base_id = s.id and c.path = f.path and c.role in (2, 4))
    = (select count(*) from fileset d where d.base_id = s.id)"""


@query(_shrinkable)
def shrink_base(t: Tables) -> DataFrame:
    return snapshots.shrinkable(t.file, t.fileset)


@query(f"""with u as ({_shrinkable}) select f.fileset_id, f.path, case when u.path is not null and f.role = 2 then 3 else f.role end as role
from file f join fileset s on s.id = f.fileset_id left join u on u.path = f.path and u.fileset_id = case when s.base_id = 0 then s.id else s.base_id end where not (u.path is not null and (s.base_id = 0 or f.role = 4))""")
def shrunk_files(t: Tables) -> DataFrame:
    return snapshots.shrink(t.file, t.fileset).select("fileset_id", "path", "role")


@query("""with own as (select path, role from file where fileset_id = 102 and (not starts_with(path, 'en/') or role = 4))
select path, role from own union all select f.path, 4 from file f where fileset_id = 2 and starts_with(path, 'en/') and path not in (select path from own)""")
def delete_file(t: Tables) -> DataFrame:
    return snapshots.delete_paths(t.file, 2, 102, predicates.within(F.col("path"), "en"))


@query("""with k as (select * from backup where fileset_id_base <> 1), s as (select id from fileset where id not in (select fileset_id_base from k) and id not in (select fileset_id_delta from k))
select 'fileset' as kind, id from s union all select 'blob', id from blob where hash not in (select blob_hash from file where blob_hash is not null and fileset_id not in (select id from s))""")
def delete_cascade(t: Tables) -> DataFrame:
    return snapshots.delete_cascade(t.backup, t.backup.where("fileset_id_base = 1").select("id"), t.fileset, t.file, t.blob)


@query("select id from backup where coalesce(tags->>'$.temporary' <> 'true', true) order by timestamp desc, timestamp_ns_part desc, id desc limit 1 offset 3")
def nth_latest(t: Tables) -> DataFrame:
    return snapshots.nth_latest(t.backup.where(predicates.tag_not_equals(F.col("tags"), "temporary", "true")), 3).select("id")


@query("select id from fileset where base_id = 0 order by id desc limit 3")
def last_n_base(t: Tables) -> DataFrame:
    return t.fileset.where("base_id = 0").orderBy(F.desc("id")).limit(3).select("id")


# aggregates


@query("select (select count(*) from blob) as blob_count, (select count(*) from chunk) as chunk_count, (select count(*) from chunk_group) as chunk_group_count, (select count(*) from chunk_binding) as chunk_binding_count, (select count(*) from blob_binding) as blob_binding_count, (select count(*) from file) as file_count, (select count(*) from fileset) as fileset_count, (select count(*) from backup) as backup_count, (select count(*) from pack) as pack_count")
def object_counts(t: Tables) -> DataFrame:
    return stats.object_counts({name: getattr(t, name) for name in ("blob", "chunk", "chunk_group", "chunk_binding", "blob_binding", "file", "fileset", "backup", "pack")})


_sums = ", ".join(
    f"coalesce(sum({s}_size) filter ({w}), 0)::bigint as blob_{n}_{s}" for n, w in (("all", "true"), ("direct", "storage_method = 1"), ("chunked", "storage_method = 2")) for s in ("raw", "stored")
)


@query(f"with b as (select {_sums} from blob), c as (select sum(raw_size)::bigint as chunk_raw, sum(stored_size)::bigint as chunk_stored from chunk), p as (select sum(size)::bigint as pack_size from pack) select *, blob_direct_stored + pack_size as store_size from b, c, p")
def size_sums(t: Tables) -> DataFrame:
    return stats.size_sums(t.blob, t.chunk, t.pack)


@query("select count(*) as packs, sum(size)::bigint as size, sum(entry_count)::bigint as entries, sum(live_size)::bigint as live_size, sum(live_entry_count)::bigint as live_entries from pack")
def pack_overview(t: Tables) -> DataFrame:
    return stats.pack_overview(t.pack)


@query("select p.id as pack_id, coalesce(sum(stored_size), 0)::bigint as live_size, count(c.id) as live_entries from pack p left join chunk c on c.pack_id = p.id group by p.id")
def pack_live_stats(t: Tables) -> DataFrame:
    return stats.pack_live(t.pack, t.chunk)


@query("select m.storage_method, count(b.id) as blobs, coalesce(sum(raw_size), 0)::bigint as raw, coalesce(sum(stored_size), 0)::bigint as stored from (values (0), (1), (2)) m(storage_method) left join blob b on m.storage_method = case when b.storage_method in (1, 2) then b.storage_method else 0 end group by all")
def storage_method_stats(t: Tables) -> DataFrame:
    return stats.by_storage(t.blob)


@query("select sum(file_object_count)::bigint as objects from fileset where id in (select fileset_id_delta from backup where fileset_id_base = 2)")
def delta_object_sum(t: Tables) -> DataFrame:
    used = t.backup.where("fileset_id_base = 2").select(F.col("fileset_id_delta").alias("id"))
    return t.fileset.join(used, "id", "left_semi").agg(F.sum("file_object_count").alias("objects"))


@query("with f as (select count(*) as files, count(blob_hash) as refs from file), b as (select count(*) as blobs, sum(raw_size)::bigint as raw, sum(stored_size)::bigint as stored from blob), k as (select sum(file_count)::bigint as file_refs from backup) select round((file_refs - files) / file_refs, 6) as file_dedup, round((refs - blobs) / refs, 6) as blob_dedup, round(stored / raw, 6) as compression from f, b, k")
def dedup_ratios(t: Tables) -> DataFrame:
    return stats.dedup_ratios(t.file, t.blob, t.backup)


@query("select count(*) filter (id % 3 = 0) as freed_count, coalesce(sum(stored_size) filter (id % 3 = 0), 0)::bigint as freed_size from chunk")
def summary_delta(t: Tables) -> DataFrame:
    return stats.summary_delta(t.chunk, t.chunk.where("id % 3 <> 0"))


# sets, ids, order


@query("select id from blob where id not in (select blob_id from blob_binding)")
def set_difference(t: Tables) -> DataFrame:
    return t.blob.select("id").exceptAll(t.blob_binding.select(F.col("blob_id").alias("id")).distinct())


@query("select id from blob intersect select blob_id from blob_binding")
def set_intersect(t: Tables) -> DataFrame:
    return t.blob.select("id").intersect(t.blob_binding.select(F.col("blob_id").alias("id")))


@query("select creator, id from (select creator, id, row_number() over (partition by creator order by timestamp, timestamp_ns_part, id) as n from backup) where n = 1")
def dedup_first(t: Tables) -> DataFrame:
    return lookups.first_of_each(t.backup, ["creator"], ["timestamp", "timestamp_ns_part", "id"]).select("creator", "id")


@query("select id, row_number() over (order by timestamp, timestamp_ns_part, id) as new_id from backup")
def reassign_ids(t: Tables) -> DataFrame:
    return lookups.reassign(t.backup, "time")


@query("select k.hash, (select max(id) from blob where id % 2 = 0) + row_number() over (order by k.hash) as id from (select hash from blob where hash not in (select hash from blob where id % 2 = 0)) k")
def assign_ids(t: Tables) -> DataFrame:
    return lookups.assign_ids(t.blob.where("id % 2 = 0"), t.blob, "hash")


@query("select id, hash from blob where id not in (select o_custkey from orders where o_orderkey % 50 = 0)")
def anti_delete(t: Tables) -> DataFrame:
    return lookups.delete(t.blob.select("id", "hash"), t.orders.where("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("id")), ["id"])


@query("select id, case when id % 2 = 0 then 'true' else tags->>'$.temporary' end as temporary from backup")
def tag_set_clear(t: Tables) -> DataFrame:
    tags = F.from_json("tags", "map<string,string>")
    updated = F.when(F.col("id") % 2 == 0, F.map_concat(F.map_filter(tags, lambda k, _: k != "temporary"), F.create_map(F.lit("temporary"), F.lit("true")))).otherwise(tags)
    return t.backup.select("id", F.try_element_at(updated, F.lit("temporary")).alias("temporary"))


@query("select id from backup order by timestamp desc, timestamp_ns_part desc, id desc offset 20")
def keep_last_n(t: Tables) -> DataFrame:
    return lookups.keep_last(t.backup.select("id", "timestamp", "timestamp_ns_part"), 20, [F.desc("timestamp"), F.desc("timestamp_ns_part"), F.desc("id")]).select("id")


@query("select path, row_number() over (order by lower(split_part(path, '/', 1)), split_part(path, '/', 1), lower(split_part(path, '/', 2)), split_part(path, '/', 2), split_part(path, '/', 3)) as position from (select distinct path from file)")
def path_sort(t: Tables) -> DataFrame:
    return lookups.numbered(t.file.select("path").distinct(), [predicates.path_key(F.col("path"))], "position")


@query("select id, pack_offset, stored_size from chunk where pack_id = 12")
def pack_entries(t: Tables) -> DataFrame:
    return t.chunk.where("pack_id = 12").orderBy("pack_offset").select("id", "pack_offset", "stored_size")


# layout and packs

_layout = "select chunk_group_id, count(*) as bad from (select *, coalesce(sum(raw_size) over (partition by chunk_group_id order by chunk_offset rows between unbounded preceding and 1 preceding), 0) as want from chunk_binding join chunk on chunk_id = id) where want <> chunk_offset group by all"


@query(_layout)
def layout_check(t: Tables) -> DataFrame:
    return layout.gaps(lineage.group_chunks(t.chunk_binding, t.chunk), "chunk_group_id", "chunk_offset", "raw_size")


@query("select chunk_group_id, chunk_id, coalesce(sum(raw_size) over (partition by chunk_group_id order by chunk_id rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from chunk_binding join chunk on chunk_id = id")
def layout_build(t: Tables) -> DataFrame:
    return layout.build(lineage.group_chunks(t.chunk_binding, t.chunk), "chunk_group_id", ["chunk_id"], "raw_size").select("chunk_group_id", "chunk_id", F.col("offset").cast("long").alias("offset"))


@query("select * from (select c.id, case when before > pack_offset then 'overlap' when pack_offset + stored_size > size then 'beyond' end as kind from (select *, lag(pack_offset + stored_size) over (partition by pack_id order by pack_offset, id) as before from chunk) c join pack p on p.id = c.pack_id) where kind is not null")
def pack_overlap(t: Tables) -> DataFrame:
    return layout.overlaps(t.chunk, t.pack)


@query("select id from pack where (size <= 0 and live_entry_count = 0) or (size > 0 and live_size < size and live_size / size < 0.97)")
def compact_candidates(t: Tables) -> DataFrame:
    return layout.compactable(t.pack, 0.97).select("id")


# audits

_rar = "compress not in ('plain', 'gzip', 'lzma', 'zstd', 'lz4')"


@query("""with l as (select pack_id, sum(stored_size) as s, count(*) as n from chunk group by all) select * from (select id, case when live_size > size then 'live_size_beyond_size' when live_entry_count > entry_count then 'live_entries_beyond_entries'
when live_size <> coalesce(s, 0) then 'live_size_mismatched' when live_entry_count <> coalesce(n, 0) then 'live_entries_mismatched' end as kind from pack left join l on id = pack_id) where kind is not null""")
def audit_packs(t: Tables) -> DataFrame:
    return audits.audit_packs(t.pack, t.chunk)


_audit_blobs = f"""with bb as (select b.*, coalesce(chunk_raw_size_sum, 0) as size from blob_binding b left join chunk_group g on g.id = b.chunk_group_id), r as (select blob_id, sum(size) as raw_sum from bb group by all),
y as (select distinct blob_id from (select *, coalesce(sum(size) over (partition by blob_id order by chunk_group_offset rows between unbounded preceding and 1 preceding), 0) as want from bb) where want <> chunk_group_offset),
d as (select blob_id, sum(stored_size) as stored_sum from (select distinct blob_id, hash, stored_size from blob_binding join chunk_binding using (chunk_group_id) join chunk on chunk_id = id) group by all)
select * from (select id, case when storage_method not in (1, 2) or {_rar} then 'invalid' when storage_method = 2 and (y.blob_id is not null or raw_sum is null) then 'bad_layout'
when storage_method = 2 and (raw_sum <> raw_size or stored_sum <> stored_size) then 'mismatched' when hash not in (select blob_hash from file where blob_hash is not null) then 'orphan' end as kind
from blob left join r on r.blob_id = id left join y on y.blob_id = id left join d on d.blob_id = id) where kind is not null"""


@query(_audit_blobs)
def audit_blobs(t: Tables) -> DataFrame:
    return audits.audit_blobs(t.blob, t.file, t.blob_binding, t.chunk_group, t.chunk_binding, t.chunk)


_audit_chunks = f"""select * from (select c.id, case when {_rar} or raw_size < 0 then 'invalid' when p.id is null then 'missing_pack' when pack_offset < 0 or pack_offset + stored_size > p.size then 'bad_pack_entry'
when c.id not in (select chunk_id from chunk_binding) then 'orphan' end as kind from chunk c left join pack p on p.id = pack_id) where kind is not null"""


@query(_audit_chunks)
def audit_chunks(t: Tables) -> DataFrame:
    return audits.audit_chunks(t.chunk, t.pack, t.chunk_binding)


@query(f"""with lay as ({_layout}), n as (select chunk_group_id, count(*) as n, sum(raw_size) as raw from chunk_binding join chunk on chunk_id = id group by all),
u as (select chunk_group_id, sum(stored_size) as stored from (select distinct chunk_group_id, hash, stored_size from chunk_binding join chunk on chunk_id = id) group by all)
select * from (select id, case when lay.bad is not null then 'bad_layout' when coalesce(n, 0) <> chunk_count or coalesce(raw, 0) <> chunk_raw_size_sum or coalesce(stored, 0) <> chunk_stored_size_sum then 'bad_chunk_stats'
when id not in (select chunk_group_id from blob_binding) then 'orphan' end as kind from chunk_group left join lay on lay.chunk_group_id = id left join n on n.chunk_group_id = id left join u on u.chunk_group_id = id) where kind is not null""")
def audit_chunk_groups(t: Tables) -> DataFrame:
    return audits.audit_chunk_groups(t.chunk_group, t.chunk_binding, t.chunk, t.blob_binding)


_same_blob = " and ".join(f"f.blob_{c} is not distinct from b.{c}" for c in ("id", "storage_method", "compress", "raw_size", "stored_size"))


@query(f"""with j as (select f.fileset_id, f.path, f.role, f.mode, f.content, f.blob_hash, b.hash as b_hash, s.id as s_id, s.base_id, {_same_blob} as same from file f left join blob b on f.blob_hash = b.hash left join fileset s on s.id = f.fileset_id)
select fileset_id, path, 'invalid' as kind from j where role <> 4 and ((mode & 61440 = 32768 and blob_hash is null) or (mode & 61440 <> 32768 and blob_hash is not null) or (mode & 61440 = 40960 and coalesce(length(content), 0) = 0))
union all select fileset_id, path, 'orphan' from j where s_id is null union all select fileset_id, path, 'bad_blob_relation' from j where blob_hash is not null and b_hash is null
union all select fileset_id, path, 'bad_fileset_relation' from j where s_id is not null and ((base_id = 0 and role <> 1) or (base_id <> 0 and role not in (2, 3, 4)))
union all select fileset_id, path, 'file_blob_mismatched' from j where b_hash is not null and not same""")
def audit_files(t: Tables) -> DataFrame:
    return audits.audit_files(t.file, t.fileset, t.blob)


@query("""with n as (select fileset_id, count(*) as n from file group by all), u as (select fileset_id_base as id from backup union select fileset_id_delta from backup)
select * from (select f.id, case when f.base_id <> 0 and (b.id is null or b.base_id <> 0) then 'bad_base_fileset' when coalesce(n, 0) <> f.file_object_count then 'bad_file_stats' when u.id is null then 'orphan' end as kind
from fileset f left join fileset b on f.base_id = b.id left join n on n.fileset_id = f.id left join u on u.id = f.id) where kind is not null""")
def audit_filesets(t: Tables) -> DataFrame:
    return audits.audit_filesets(t.fileset, t.file, t.backup)


@query("""select distinct f.fileset_id as id, 'bad_file_role' as kind from file f join fileset s on s.id = f.fileset_id join fileset b on b.id = s.base_id and b.base_id = 0
where s.base_id <> 0 and ((f.role = 3 and exists (select 1 from file o where o.fileset_id = s.base_id and o.path = f.path)) or (f.role in (2, 4) and not exists (select 1 from file o where o.fileset_id = s.base_id and o.path = f.path)))""")
def audit_file_roles(t: Tables) -> DataFrame:
    return audits.audit_file_roles(t.fileset, t.file)


@query("""with h as (select chunk_group_id, sha256(string_agg(hash, chr(0) order by chunk_offset, hash)) as want from chunk_binding join chunk on chunk_id = id group by all)
select id, 'bad_layout' as kind from chunk_group left join h on chunk_group_id = id where hash is distinct from coalesce(want, sha256(''))""")
def audit_group_hashes(t: Tables) -> DataFrame:
    return audits.audit_group_hashes(t.chunk_group, t.chunk_binding, t.chunk)


_audit_backups = """select * from (select k.id, case when b.id is null then 'missing_base' when b.base_id <> 0 then 'base_not_base' when d.id is null then 'missing_delta' when d.base_id <> b.id then 'delta_of_other_base'
when b.file_count + d.file_count <> k.file_count then 'bad_file_count' when b.file_raw_size_sum + d.file_raw_size_sum <> k.file_raw_size_sum or b.file_stored_size_sum + d.file_stored_size_sum <> k.file_stored_size_sum then 'bad_sizes' end as kind
from backup k left join fileset b on b.id = k.fileset_id_base left join fileset d on d.id = k.fileset_id_delta) where kind is not null"""


@query(_audit_backups)
def audit_backups(t: Tables) -> DataFrame:
    return audits.audit_backups(t.backup, t.fileset)


@query(f"select kind, count(*) as bad from ({_audit_backups}) group by all")
def audit_by_kind(t: Tables) -> DataFrame:
    return audits.by_kind(audits.audit_backups(t.backup, t.fileset))


@query("select count(*) as files, coalesce(sum(strlen(html)), 0)::bigint as bytes from pages where md5(html) not in (select hash from blob)")
def unknown_objects(t: Tables) -> DataFrame:
    listing = t.pages.select(F.md5(F.col("html").cast("binary")).alias("hash"), F.octet_length("html").cast("long").alias("bytes"))
    return audits.unknown_objects(listing, t.blob, "hash")


# content


@query("select doc_id, strlen(text)::bigint as size, md5(text) as md5, sha256(text) as sha256 from documents")
def content_hash(t: Tables) -> DataFrame:
    data = F.col("text").cast("binary")
    return t.documents.select("doc_id", F.octet_length("text").cast("long").alias("size"), content.content_hash(data, "md5").alias("md5"), content.content_hash(data, "sha256").alias("sha256"))


@query()
def content_hash_xxh128(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", content.content_hash(F.col("text").cast("binary"), "xxh128").alias("xxh128"))


def _contents(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("data"))


def _pieces(size: int) -> str:
    """Pieces of a text's bytes, cut from their hexadecimal form."""
    return f"""select doc_id as key, i::bigint as "offset", (strlen(substr(x, 2 * i + 1, {2 * size})) // 2)::bigint as length, md5(unhex(substr(x, 2 * i + 1, {2 * size}))) as hash
  from (select doc_id, hex(encode(text)) as x, strlen(text) as n from documents where strlen(text) > 0), range(0, n, {size}) as r(i)"""


@query(_pieces(4096))
def fixed_chunks(t: Tables) -> DataFrame:
    return content.fixed_chunks(_contents(t), 4096)


@query(f"""with b as ({_pieces(8192)}), s as ({_pieces(1024)}), ob as (select key, "offset", case when key % 3 = 0 then 'x' else hash end as before from b where key % 2 = 0 and length = 8192),
os as (select key, "offset", case when key % 3 = 0 and "offset" % 8192 = 0 then 'x' else hash end as before from s where key % 2 = 1 and length = 1024),
w as (select s.key, s."offset" // 8192 * 8192 as win, count(before) as had, count(*) filter (before <> s.hash) as changed from s left join os using (key, "offset") group by all),
d as (select b.*, coalesce(length = 8192 and ((ob.before is not null and ob.before <> b.hash) or (ob.before is null and had = 8 and changed > 0)), false) as split from b left join ob using (key, "offset") left join w on w.key = b.key and win = b."offset")
select key, "offset", length, hash from d where not split union all select s.key, s."offset", s.length, s.hash from s join d on d.key = s.key and d."offset" = s."offset" // 8192 * 8192 where split""")
def adaptive_chunks(t: Tables) -> DataFrame:
    wide = content.fixed_chunks(_contents(t), 8192).where("key % 2 = 0 and length = 8192").withColumn("hash", F.when(F.col("key") % 3 == 0, "x").otherwise(F.col("hash")))
    narrow = content.fixed_chunks(_contents(t), 1024).where("key % 2 = 1 and length = 1024").withColumn("hash", F.when((F.col("key") % 3 == 0) & (F.col("offset") % 8192 == 0), "x").otherwise(F.col("hash")))
    return content.adaptive_chunks(_contents(t), wide.unionByName(narrow), 8192, 1024)


@query()
def cdc_chunks(t: Tables) -> DataFrame:
    return content.cdc_chunks(_contents(t), "fastcdc_32k")


@query()
def chunk_groups(t: Tables) -> DataFrame:
    return content.chunk_groups(content.fixed_chunks(_contents(t), 64))


@query("select chunk_group_id, sha256(string_agg(hash, chr(0) order by chunk_offset)) as hash from chunk_binding join chunk on chunk_id = id group by all")
def group_hash(t: Tables) -> DataFrame:
    ordered = lineage.group_chunks(t.chunk_binding, t.chunk).groupBy("chunk_group_id").agg(F.sort_array(F.collect_list(F.struct("chunk_offset", "hash"))).alias("c"))
    return ordered.select("chunk_group_id", content.group_hash(F.transform("c", lambda x: x["hash"])).alias("hash"))


@query("select distinct md5(html) as hash, strlen(html)::bigint as raw_size from pages where md5(html) not in (select hash from blob) union select hash, raw_size from blob where id % 10 = 0 and hash not in (select hash from blob where id % 10 <> 0)")
def dedup_new_blobs(t: Tables) -> DataFrame:
    incoming = t.pages.select(F.md5(F.col("html").cast("binary")).alias("hash"), F.octet_length("html").cast("long").alias("raw_size"))
    return content.new_objects(incoming.unionByName(t.blob.select("hash", "raw_size")), t.blob.where("id % 10 <> 0"))


@query(f"select distinct hash, length as raw_size from ({_pieces(4096)}) where hash not in (select hash from ({_pieces(4096)}) where key % 2 = 0)")
def dedup_new_chunks(t: Tables) -> DataFrame:
    chunks = content.fixed_chunks(_contents(t), 4096)
    return content.new_objects(chunks.withColumnRenamed("length", "raw_size"), chunks.where("key % 2 = 0").select("hash"))


@query(f"select key, count(distinct hash) filter (hash not in (select hash from ({_pieces(4096)}) where key % 3 = 0)) as fresh, count(distinct hash) as chunks from ({_pieces(4096)}) group by key having fresh >= greatest(2, 0.6 * chunks)")
def churn_flag(t: Tables) -> DataFrame:
    chunks = content.fixed_chunks(_contents(t), 4096)
    return content.churn(chunks, chunks.where("key % 3 = 0"), 2)


@query("select doc_id as key, case when doc_id % 5 = 1 then 'size' else 'hash' end as kind from documents where text is not null and doc_id % 5 in (1, 2)")
def verify_content(t: Tables) -> DataFrame:
    contents = _contents(t)
    expected = contents.select("key", (F.octet_length("data") + (F.col("key") % 5 == 1).cast("int")).alias("raw_size"), F.when(F.col("key") % 5 == 2, "x").otherwise(F.md5("data")).alias("hash"))
    return content.verify(contents, expected)


@query("""with r as (select id, hash, case when id % 50 = 3 then 'same' when id % 50 = 4 then (select hash from blob where id = 17) else hash end as new_hash from blob),
t as (select new_hash, count(distinct id) as ids from r group by all having count(distinct id) > 1), c as (select r.new_hash, count(distinct r.id) as ids from r join blob o on o.hash = r.new_hash and o.id <> r.id group by all)
select new_hash, max(ids) as ids from (select * from t union all select * from c) group by all""")
def rehash_check(t: Tables) -> DataFrame:
    other = t.blob.where("id = 17").select(F.col("hash").alias("other"))
    rows = t.blob.join(F.broadcast(other), how="left", on=F.lit(True))
    new = F.when(F.col("id") % 50 == 3, "same").when(F.col("id") % 50 == 4, F.col("other")).otherwise(F.col("hash"))
    return content.rehash_collisions(rows.select("id", "hash", new.alias("new_hash")))


@query("select blob_id, sum(stored_size)::bigint as stored from (select distinct blob_id, hash, stored_size // 2 as stored_size from blob_binding join chunk_binding using (chunk_group_id) join chunk on chunk_id = id) group by all")
def recompute_cascade(t: Tables) -> DataFrame:
    return content.cascade(t.chunk.withColumn("stored_size", F.expr("stored_size div 2")), t.chunk_binding, t.blob_binding)


@query()
def codec_round_trip(t: Tables) -> DataFrame:
    from lamina.functions import codecs

    data = F.col("data")
    packed = _contents(t).withColumn("gzip", codecs.compress(data, "gzip"))
    return packed.select("key", F.octet_length("gzip").alias("size"), (codecs.decompress(F.col("gzip"), "gzip") == data).alias("same"))


# time


@query("select id, timestamp * 1000000000 + timestamp_ns_part as at, isoyear(to_timestamp(timestamp) at time zone 'UTC') * 100 + week(to_timestamp(timestamp) at time zone 'UTC') as iso_week, strftime(to_timestamp(timestamp) at time zone 'UTC', '%Y/%m/%d/%H') as hour from backup")
def time_buckets(t: Tables) -> DataFrame:
    text = F.expr("date_format(timestampadd(second, timestamp, timestamp_ntz '1970-01-01 00:00:00'), 'yyyy/MM/dd/HH')")
    ntz = F.expr("timestampadd(second, timestamp, timestamp_ntz '1970-01-01 00:00:00')")
    return t.backup.select("id", predicates.instant(F.col("timestamp"), F.col("timestamp_ns_part")).alias("at"), (F.extract(F.lit("YEAROFWEEK"), ntz) * 100 + F.extract(F.lit("WEEK"), ntz)).cast("long").alias("iso_week"), text.alias("hour"))


@query("select creator, split_part(creator, ':', 1) as type, split_part(creator, ':', 2) as name from (select distinct creator from backup)")
def creator_parts(t: Tables) -> DataFrame:
    parts = units.creator(F.col("creator"))
    return t.backup.select("creator").distinct().select("creator", parts["type"].alias("type"), parts["name"].alias("name"))


@query("select p_partkey, (p_size * 60)::double as seconds, (p_size * 1048576)::double as bytes from part")
def unit_values(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", units.duration_seconds(F.concat(F.col("p_size").cast("string"), F.lit("min"))).alias("seconds"), units.quantity(F.concat(F.col("p_size").cast("string"), F.lit(" MiB"))).alias("bytes"))


_policy = retention.Policy(last=3, hour=2, day=4, week=3, month=3, year=2, max_amount=12, max_lifetime=86400 * 1500)
_now = 903_000_000


def _plan_rows(t: Tables) -> DataFrame:
    return t.backup.select((F.col("id") % 100).alias("part"), "id", "timestamp", "timestamp_ns_part", (F.col("id") % 13 == 5).alias("protected"))


@query()
def retention_plan(t: Tables) -> DataFrame:
    return retention.plan(_plan_rows(t), _policy, _now, ("part",))


@query("""with r as (select id % 100 as part, id, timestamp, id % 13 = 5 as protected, row_number() over (partition by id % 100 order by timestamp desc, timestamp_ns_part desc, id desc) as pos from backup),
o as (select *, row_number() over (partition by part order by pos) as n from r where not protected),
d as (select *, dense_rank() over (partition by part order by b desc) as bn, row_number() over (partition by part, b order by pos) as bi, first_value(id) over (partition by part, b order by pos) as leader from (select *, timestamp // 86400 as b from o))
select part, id, bn <= 5 and bi = 1 as keep, case when bn > 5 then 'unmarked' when bi = 1 then 'keep day ' || bn else 'superseded by ' || leader || ' (day)' end as reason from d
union all select part, id, true, 'keep protected' from r where protected""")
def retention_daily(t: Tables) -> DataFrame:
    return retention.plan(_plan_rows(t), retention.Policy(day=5), _now, ("part",))


@query("""with r as (select coalesce(max(moment), -1) as r from presence where change = 'reset'), e as (select * from presence, r where change <> 'reset' and moment > r)
select "user", arg_max(change, moment) = 'joined' as online, max(moment) as moment from e group by "user" having count(*) filter (change = 'joined') > 0""")
def presence_last_state(t: Tables) -> DataFrame:
    return presence.last_state(t.presence)


@query("""with r as (select coalesce(max(moment), -1) as r from presence where change = 'reset'), e as (select * from presence, r where change <> 'reset' and moment > r),
s as (select "user", arg_max(change, moment) = 'joined' as online from e group by "user" having count(*) filter (change = 'joined') > 0)
select count(*) as records, coalesce(bool_or(not regexp_full_match("user"::varchar, '1.*')), false) as has_valid, coalesce(bool_or(online and not regexp_full_match("user"::varchar, '1.*')), false) as has_valid_online from s""")
def presence_gate(t: Tables) -> DataFrame:
    return presence.gate(presence.last_state(t.presence), "1.*")


@query("select moment, gap from (select moment, moment - lag(moment) over (order by moment) as gap from (select distinct timestamp as moment from backup)) where gap >= 20000")
def schedule_gaps(t: Tables) -> DataFrame:
    return presence.gaps(t.backup.select(F.col("timestamp").alias("moment")).distinct(), 20000)


@query("select o_orderkey, coalesce(list_sum(list_filter([0, 10, 60, 300], lambda x: case x when 0 then 0 when 10 then 10 when 60 then 70 else 370 end <= (o_orderkey % 3000) * 0.2)), 0)::bigint as waits from orders")
def backoff_plan(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", presence.backoff_sum(F.col("o_orderkey") % 3000).alias("waits"))
