"""Queries of packs, stores, deletion, finishing and metadata, with independent SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import meta
from lamina.operators import audits, layout, lineage, lookups, predicates, snapshots, stats
from lamina.plans.queries import query
from lamina.plans.tables import Tables

# packs


def _laid(rows: str, largest: int, most: int, own: int) -> str:
    """The writer's rules as a recursion over each writer's numbered entries (writer, id, stored_size, rn)."""
    dedicated = f"e.stored_size >= {own}"
    opens = f"(s.number = 0 or s.size >= {largest} or s.entries >= {most})"
    return f"""with recursive e as ({rows}),
s(writer, rn, id, opened, number, size, entries, new_pack, new_offset) as (
  select writer, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint from (select distinct writer from e)
  union all
  select e.writer, e.rn, e.id, s.opened + case when {dedicated} or {opens} then 1 else 0 end,
    case when not {dedicated} and {opens} then s.opened + 1 else s.number end,
    case when {dedicated} then s.size when {opens} then e.stored_size else s.size + e.stored_size end,
    case when {dedicated} then s.entries when {opens} then 1 else s.entries + 1 end,
    case when {dedicated} or {opens} then s.opened + 1 else s.number end,
    case when {dedicated} or {opens} then 0 else s.size end
  from s join e on e.writer = s.writer and e.rn = s.rn + 1)
select writer, id, new_pack, new_offset from s where rn > 0"""


@query(_laid("select cast(id % 8 as bigint) as writer, id, stored_size, row_number() over (partition by id % 8 order by id) as rn from chunk", 30000, 12, 4800))
def pack_sink(t: Tables) -> DataFrame:
    rows = t.chunk.select((F.col("id") % 8).alias("writer"), "id", "stored_size")
    return layout.pack_entries(rows, ["id"], largest=30000, most=12, own=4800)


@query(_laid("select cast(pack_id % 4 as bigint) as writer, id, stored_size, row_number() over (partition by pack_id % 4 order by pack_id, pack_offset, id) as rn from chunk where pack_id in (select id from pack where (size <= 0 and live_entry_count = 0) or (size > 0 and live_size < size and live_size / size < 0.97))", 20000, 9, 4900))
def compact_plan(t: Tables) -> DataFrame:
    return layout.compaction(t.chunk, layout.compactable(t.pack, 0.97), writers=4, largest=20000, most=9, own=4900)


@query("""with d as (select doc_id, encode(text) as data from documents where text is not null), e as (select o_orderkey as id, cast(o_custkey % 1200 as bigint) as pack_id, cast(o_orderkey % 90 as bigint) as pack_offset, cast(5 + o_orderkey % 40 as bigint) as stored_size from orders)
select id, case when pack_offset + stored_size <= octet_length(data) then md5(data[pack_offset + 1:pack_offset + stored_size]) end as hash from e left join d on d.doc_id = e.pack_id""")
def pack_entry_read(t: Tables) -> DataFrame:
    packs = t.documents.where("text is not null").select(F.col("doc_id").alias("pack_id"), F.col("text").alias("data"))
    entries = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 1200).alias("pack_id"), (F.col("o_orderkey") % 90).alias("pack_offset"), (5 + F.col("o_orderkey") % 40).alias("stored_size"))
    return layout.read_entries(entries, packs).select("id", F.md5("data").alias("hash"))


# stores


@query("""with s as (select md5(text) as hash, case when doc_id % 37 = 5 then replace(text, 'e', 'x') when doc_id % 41 = 6 then text || '!' else text end as data from documents where text is not null and doc_id % 31 <> 4
    and doc_id in (select min(doc_id) from documents where text is not null group by text)),
r as (select b.id, case when data is null then 'missing' when strlen(data) <> raw_size then 'mismatched' when md5(data) <> b.hash then 'corrupted' end as kind from blob b left join s using (hash))
select id, kind from r where kind is not null""")
def audit_blob_store(t: Tables) -> DataFrame:
    first = t.documents.where("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    data = F.when(F.col("doc_id") % 37 == 5, F.replace("text", F.lit("e"), F.lit("x"))).when(F.col("doc_id") % 41 == 6, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return audits.audit_stored(t.blob, first.where("doc_id % 31 <> 4").select(F.md5(F.col("text").cast("binary")).alias("hash"), data.alias("data")))


@query("""with l as (select pack_id, sum(stored_size) as s, count(*) as n from chunk group by all), f as (select id, size + case when id % 9 = 2 then 1 else 0 end as bytes from pack where id % 11 <> 3)
select * from (select p.id, case when f.id is null then 'missing_file' when bytes <> size then 'file_size_mismatched' when live_size > size then 'live_size_beyond_size' when live_entry_count > entry_count then 'live_entries_beyond_entries'
when live_size <> coalesce(s, 0) then 'live_size_mismatched' when live_entry_count <> coalesce(n, 0) then 'live_entries_mismatched' end as kind from pack p left join l on p.id = pack_id left join f on f.id = p.id) where kind is not null""")
def audit_pack_files(t: Tables) -> DataFrame:
    store = t.pack.where("id % 11 <> 3").select("id", (F.col("size") + F.when(F.col("id") % 9 == 2, 1).otherwise(0)).alias("bytes"))
    return audits.audit_packs(t.pack, t.chunk, store)


@query("select k.size, b.size is not null as present from (select distinct strlen(html)::bigint as size from pages) k left join (select distinct raw_size as size from blob) b using (size)")
def existence_by_size(t: Tables) -> DataFrame:
    return lookups.existence(t.pages.select(F.octet_length("html").cast("long").alias("size")), t.blob.select(F.col("raw_size").alias("size")), "size")


@query("select k.hash, b.hash is not null as present from (select distinct md5(text) as hash from documents where text is not null) k left join (select distinct blob_hash as hash from file) b using (hash)")
def existence_by_hash(t: Tables) -> DataFrame:
    return lookups.existence(t.documents.where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("hash")), t.file.select(F.col("blob_hash").alias("hash")), "hash")


# deletion and finishing

_gone = "(select id from blob where hash not in (select blob_hash from file where blob_hash is not null and fileset_id % 3 = 0))"


@query(f"""with gone as {_gone}, g as (select id from chunk_group where id not in (select chunk_group_id from blob_binding where blob_id not in (select id from gone))),
c as (select id, pack_id from chunk where id not in (select chunk_id from chunk_binding where chunk_group_id not in (select id from g)))
select 'chunk_group' as kind, id from g union all select 'chunk', id from c union all select 'pack', id from pack where id not in (select pack_id from chunk where id not in (select id from c))""")
def delete_below(t: Tables) -> DataFrame:
    gone = audits.orphans(t.blob.select("id", "hash"), "hash", t.file.where("fileset_id % 3 = 0 and blob_hash is not null"), "blob_hash").select("id")
    return snapshots.delete_below(gone, t.blob_binding, t.chunk_group, t.chunk_binding, t.chunk, t.pack)


@query("select fileset_id, path, coalesce(b.id, -1) as blob_id from file f left join blob b on b.hash = f.blob_hash")
def finalize_files(t: Tables) -> DataFrame:
    return snapshots.finalize_files(t.file, t.blob).select("fileset_id", "path", F.coalesce("blob_id", F.lit(-1).cast("long")).alias("blob_id"))


@query("select k.id, b.file_count + d.file_count as file_count, b.file_raw_size_sum + d.file_raw_size_sum as file_raw_size_sum, b.file_stored_size_sum + d.file_stored_size_sum as file_stored_size_sum from backup k join fileset b on b.id = fileset_id_base join fileset d on d.id = fileset_id_delta")
def finalize_backups(t: Tables) -> DataFrame:
    there = t.fileset.select("id")
    whole = t.backup.join(there.withColumnRenamed("id", "fileset_id_base"), "fileset_id_base", "left_semi").join(there.withColumnRenamed("id", "fileset_id_delta"), "fileset_id_delta", "left_semi")
    return snapshots.finalize_backups(whole, t.fileset).select("id", "file_count", "file_raw_size_sum", "file_stored_size_sum")


@query("""select (select count(*) from blob where hash not in (select blob_hash from file where blob_hash is not null)) as orphan_blobs, (select count(*) from chunk_group where id not in (select chunk_group_id from blob_binding)) as orphan_chunk_groups,
(select count(*) from chunk where id not in (select chunk_id from chunk_binding)) as orphan_chunks, (select count(*) from fileset where id not in (select fileset_id_base from backup) and id not in (select fileset_id_delta from backup)) as orphan_filesets,
(select count(*) from file where fileset_id not in (select id from fileset)) as orphan_files, (select count(*) from (with c as (select s.base_id as base, f.path, count(distinct f.fileset_id) as n from file f join fileset s on s.id = f.fileset_id and s.base_id <> 0 where f.role in (2, 4) group by all),
  a as (select base_id as base, count(*) as n from fileset where base_id <> 0 group by all) select 1 from file f join fileset s on s.id = f.fileset_id and s.base_id = 0 join a on a.base = f.fileset_id join c on c.base = f.fileset_id and c.path = f.path and c.n = a.n)) as shrunk_files,
(select count(*) from pack where (size <= 0 and live_entry_count = 0) or (size > 0 and live_size < size and live_size / size < 0.75)) as reclaimed_packs,
(select coalesce(sum(size - live_size), 0)::bigint from pack where (size <= 0 and live_entry_count = 0) or (size > 0 and live_size < size and live_size / size < 0.75)) as freed_size""")
def prune_summary(t: Tables) -> DataFrame:
    packs = layout.compactable(t.pack, 0.75)
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    return stats.beside(
        count(audits.orphans(t.blob.select("hash"), "hash", t.file.where("blob_hash is not null"), "blob_hash"), "orphan_blobs"), count(audits.orphans(t.chunk_group.select("id"), "id", t.blob_binding, "chunk_group_id"), "orphan_chunk_groups"),
        count(audits.orphans(t.chunk.select("id"), "id", t.chunk_binding, "chunk_id"), "orphan_chunks"), count(audits.orphan_filesets(t.fileset, t.backup), "orphan_filesets"),
        count(t.file.join(t.fileset.select(F.col("id").alias("fileset_id")), "fileset_id", "left_anti"), "orphan_files"), count(snapshots.shrinkable(t.file, t.fileset), "shrunk_files"),
        packs.agg(F.count("*").alias("reclaimed_packs"), F.coalesce(F.sum(F.col("size") - F.col("live_size")), F.lit(0)).cast("long").alias("freed_size")),
    )


@query("select chunk_group_id, chunk_offset, chunk_id from chunk_binding union all select o_orderkey + 5000000, 0, o_custkey + 1 from orders")
def insert_bindings(t: Tables) -> DataFrame:
    new = t.orders.select((F.col("o_orderkey") + 5000000).alias("chunk_group_id"), F.lit(0).cast("long").alias("chunk_offset"), (F.col("o_custkey") + 1).alias("chunk_id"))
    return t.chunk_binding.select("chunk_group_id", "chunk_offset", "chunk_id").unionByName(new)


@query("select id, place, total from (select id, row_number() over (order by timestamp, timestamp_ns_part, id) as place, count(*) over () as total from backup) where place <= 5 or place > total - 5")
def list_ends(t: Tables) -> DataFrame:
    return lookups.ends(t.backup, predicates.order("time")).select("id", "place", "total")


@query("""select 4 as db_version, 'md5' as hash_method, (select count(*) from blob) as blob_count, (select count(*) from blob where storage_method = 1) as direct_blob_count, (select count(*) from blob where storage_method = 2) as chunked_blob_count,
(select sum(stored_size)::bigint from blob) as blob_stored_size_sum, (select sum(raw_size)::bigint from blob) as blob_raw_size_sum, (select coalesce(sum(stored_size), 0)::bigint from blob where storage_method = 1) as direct_blob_stored_size_sum,
(select coalesce(sum(raw_size), 0)::bigint from blob where storage_method = 1) as direct_blob_raw_size_sum, (select coalesce(sum(stored_size), 0)::bigint from blob where storage_method = 2) as chunked_blob_stored_size_sum,
(select coalesce(sum(raw_size), 0)::bigint from blob where storage_method = 2) as chunked_blob_raw_size_sum, (select count(*) from chunk) as chunk_count, (select sum(raw_size)::bigint from chunk) as chunk_raw_size_sum,
(select sum(stored_size)::bigint from chunk) as chunk_stored_size_sum, (select count(*) from chunk_group) as chunk_group_count, (select count(*) from chunk_binding) as chunk_group_chunk_binding_count, (select count(*) from blob_binding) as blob_chunk_group_binding_count,
(select count(*) from file) as file_object_count, (select count(*) from fileset) as fileset_count, (select count(*) from backup) as backup_count, (select sum(file_count)::bigint from backup) as file_total_count, (select sum(file_raw_size_sum)::bigint from backup) as file_raw_size_sum,
(select coalesce(sum(chunk_count), 0)::bigint from blob_binding join chunk_group on chunk_group_id = id join blob on blob.id = blob_id where storage_method = 2) as chunked_blob_chunk_count,
(select count(*) from pack) as pack_count, (select sum(size)::bigint from pack) as pack_size_sum, (select sum(live_size)::bigint from pack) as pack_live_size_sum, (select sum(live_entry_count)::bigint from pack) as pack_live_entry_count_sum, 12345::bigint as db_file_size""")
def catalog_overview(t: Tables) -> DataFrame:
    names = ("blob", "chunk", "chunk_group", "chunk_binding", "blob_binding", "file", "fileset", "backup", "pack")
    return stats.overview({name: getattr(t, name) for name in names}, 4, "md5", 12345)


# scalars

_formats = ("%Y", "%Y%m", "%Y%m%d", "%Y-%m-%d", "%Y/%m/%d", "%Y%m%d%H", "%Y%m%d%H%M", "%Y%m%d%H%M%S", "%Y%m%d %H%M%S", "%Y%m%d %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f")
_shown = "case o_orderkey % 12 " + " ".join(f"when {at} then strftime(o_orderdate, '{form}')" for at, form in enumerate(_formats)) + " end"
_read = "case o_orderkey % 12 " + " ".join(f"when {at} then strptime(strftime(o_orderdate, '{form}'), '{form}')" for at, form in enumerate(_formats)) + " end"
_java = ("yyyy", "yyyyMM", "yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMddHH", "yyyyMMddHHmm", "yyyyMMddHHmmss", "yyyyMMdd HHmmss", "yyyyMMdd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query(f"select o_orderkey, {_shown} as text, epoch_us({_read}) * 1000 as at from orders")
def parse_times(t: Tables) -> DataFrame:
    text = F.lit(None).cast("string")
    for at, form in enumerate(_java):
        text = F.when(F.col("o_orderkey") % 12 == at, F.date_format("o_orderdate", form)).otherwise(text)
    return t.orders.select("o_orderkey", text.alias("text")).withColumn("at", meta.parse_time(F.col("text")))


@query("""with m as (select id, case id % 3 when 0 then '{"_version":1,"creator":"' || creator || '","comment":"' || comment || '","timestamp_ns":' || (timestamp * 1000000000 + timestamp_ns_part) || ',"targets":["world/"],"tags":' || tags || '}'
  when 1 then '{"creator":{"type":"a","name":"b"},"timestamp_ns":' || timestamp || '000000000.0}' else '{}' end as text from backup)
select id, case id % 3 when 0 then text->>'$.creator' when 1 then 'a:b' else 'unknown:' end as creator, coalesce(text->>'$.comment', '') as comment, case when id % 3 < 2 then (select timestamp from backup k where k.id = m.id) end as timestamp,
  case id % 3 when 0 then (select timestamp_ns_part from backup k where k.id = m.id) when 1 then 0 end as timestamp_ns_part, case when id % 3 = 0 then 'world' else '' end as targets, case when id % 3 = 0 then (select tags from backup k where k.id = m.id) else '{}' end as tags from m""")
def meta_decode(t: Tables) -> DataFrame:
    text = F.expr("""case id % 3 when 0 then concat('{"_version":1,"creator":"', creator, '","comment":"', comment, '","timestamp_ns":', timestamp * 1000000000 + timestamp_ns_part, ',"targets":["world/"],"tags":', tags, '}')
  when 1 then concat('{"creator":{"type":"a","name":"b"},"timestamp_ns":', timestamp, '000000000.0}') else '{}' end""")
    m = t.backup.select("id", meta.decode(text).alias("m"))
    return m.select("id", "m.creator", "m.comment", "m.timestamp", "m.timestamp_ns_part", F.array_join("m.targets", ",").alias("targets"), "m.tags")


@query("select id, case when json_type(tags, '$.temporary') = 'BOOLEAN' then (tags->>'$.temporary')::boolean end as flag, cast(null as varchar) as words from backup")
def typed_tags(t: Tables) -> DataFrame:
    return t.backup.select("id", predicates.typed_tag(F.col("tags"), "temporary", "boolean").alias("flag"), predicates.typed_tag(F.col("tags"), "temporary", "string").alias("words"))


@query("select id, cast(ceil(raw_size / 4096.0) as bigint) as blocks from blob")
def size_blocks(t: Tables) -> DataFrame:
    return t.blob.select("id", stats.blocks(F.col("raw_size")).alias("blocks"))


@query("select hash from blob where id = 17")
def resolve_one(t: Tables) -> DataFrame:
    prefix = t.blob.where("id = 17").first()["hash"][:20]
    return t.spark.createDataFrame([(predicates.resolve_prefix(t.blob, "hash", prefix),)], "hash string")


@query("select distinct path, contains('/' || path, '/src1/') as ignored from file")
def folder_rule(t: Tables) -> DataFrame:
    return t.file.select("path").distinct().withColumn("ignored", predicates.rule_match(F.col("path"), ["src1/"], F.lit(False)))


@query("select fileset_id, path, k.id as backup_id from file f join backup k on k.fileset_id_delta = f.fileset_id or (k.fileset_id_base = f.fileset_id and not exists (select 1 from file d where d.fileset_id = k.fileset_id_delta and d.path = f.path and d.role in (2, 3, 4))) where f.path like 'en/src1/%1'")
def file_backups(t: Tables) -> DataFrame:
    files = t.file.where("path like 'en/src1/%1'").select("fileset_id", "path")
    return lineage.containing_file(files, t.file, t.backup)


# sums of filesets

_PLUS, _MINUS = "case when s.base_id = 0 or role in (2, 3) then {} else 0 end", "case when s.base_id <> 0 and role in (2, 4) then {} else 0 end"
_SIGNED = ", ".join(f"cast(sum({_PLUS.format(new)} - {_MINUS.format(old)}) as bigint) as {name}" for name, new, old in (
    ("file_count", "1", "1"), ("file_raw_size_sum", "coalesce(f.blob_raw_size, 0)", "coalesce(o.blob_raw_size, 0)"),
    ("file_stored_size_sum", "coalesce(f.blob_stored_size, 0)", "coalesce(o.blob_stored_size, 0)"),
))


@query(f"""with g as (select f.fileset_id as id, count(*) as file_object_count, {_SIGNED.replace("role in", "f.role in")}
  from file f join fileset s on s.id = f.fileset_id left join file o on o.fileset_id = s.base_id and o.path = f.path group by f.fileset_id)
select s.id, s.base_id, coalesce(g.file_object_count, 0) as file_object_count, coalesce(g.file_count, 0) as file_count, coalesce(g.file_raw_size_sum, 0) as file_raw_size_sum,
  coalesce(g.file_stored_size_sum, 0) as file_stored_size_sum from fileset s left join g on g.id = s.id""")
def fileset_recount(t: Tables) -> DataFrame:
    return snapshots.recount(t.file, t.fileset)
