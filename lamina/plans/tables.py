"""Catalog tables derived from the driver's tables, with defects on fixed residues.

One text serves both engines: OCTETS(x) is the length in bytes, DAYS(x) the days since the epoch.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

TABLES: dict[str, str] = {
    "blob": """
select cast(min(doc_id) + 1 as bigint) as id, cast(case when min(doc_id) % 97 = 5 then 0 when OCTETS(text) >= 2048 then 2 else 1 end as int) as storage_method, md5(text) as hash,
  case when min(doc_id) % 89 = 7 then 'rar' else 'plain' end as compress, cast(OCTETS(text) as bigint) as raw_size, cast(OCTETS(text) - min(doc_id) % 3 as bigint) as stored_size
from {documents} where text is not null group by text""",
    "chunk": """
select cast(p_partkey + 1 as bigint) as id, md5(concat('c', p_partkey)) as hash, case when p_partkey % 101 = 3 then 'rar' else 'plain' end as compress,
  cast(p_size * 100 + p_partkey % 7 as bigint) as raw_size, cast(p_size * 100 - p_partkey % 3 as bigint) as stored_size, cast(p_partkey % 97 + 1 as bigint) as pack_id,
  cast(coalesce(sum(p_size * 100 - p_partkey % 3) over (partition by p_partkey % 97 order by p_partkey rows between unbounded preceding and 1 preceding), 0)
    + case when p_partkey % 53 = 2 then 5 else 0 end as bigint) as pack_offset
from {part} where p_partkey % 199 <> 11""",
    "pack": """
select pack_id as id, cast(sum(stored_size) + (pack_id % 4) * 1000 as bigint) as size, cast(count(*) + pack_id % 3 as bigint) as entry_count,
  cast(sum(stored_size) + case when pack_id % 10 = 3 then 7 else 0 end as bigint) as live_size, cast(count(*) + case when pack_id % 10 = 6 then 1 else 0 end as bigint) as live_entry_count
from {chunk} where pack_id % 41 <> 9 group by pack_id
union all select cast(200 + r_regionkey as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint) from {region}""",
    "chunk_binding": """
select cast(l_orderkey + 1 as bigint) as chunk_group_id,
  cast(coalesce(sum(p_size * 100 + p_partkey % 7) over (partition by l_orderkey order by l_partkey rows between unbounded preceding and 1 preceding), 0)
    + case when l_orderkey % 211 = 4 and l_partkey % 2 = 0 then 1 else 0 end as bigint) as chunk_offset, cast(l_partkey + 1 as bigint) as chunk_id
from (select distinct l_orderkey, l_partkey from {lineitem}) b join {part} on l_partkey = p_partkey""",
    "chunk_group": """
select chunk_group_id as id, md5(concat('g', chunk_group_id)) as hash, cast(count(*) + case when chunk_group_id % 307 = 5 then 1 else 0 end as bigint) as chunk_count,
  cast(sum(raw_size) as bigint) as chunk_raw_size_sum, cast(sum(stored_size) + case when chunk_group_id % 311 = 6 then 2 else 0 end as bigint) as chunk_stored_size_sum
from {chunk_binding} join {chunk} on chunk_id = id where chunk_group_id % 401 <> 17 group by chunk_group_id""",
    "blob_binding": """
select cast(o_custkey % 1100 + 1 as bigint) as blob_id,
  cast(coalesce(sum(chunk_raw_size_sum) over (partition by o_custkey % 1100 order by o_orderkey rows between unbounded preceding and 1 preceding), 0)
    + case when o_orderkey % 503 = 1 then 3 else 0 end as bigint) as chunk_group_offset, cast(o_orderkey + 1 as bigint) as chunk_group_id
from {orders} join {chunk_group} on id = o_orderkey + 1
union all select cast(r_regionkey + 1 as bigint), cast(1000000000000 + r_regionkey as bigint), cast(9999990 + r_regionkey as bigint) from {region}""",
    "file": """
select r.fileset_id, r.path, r.role, r.mode, r.content, b.id as blob_id, b.storage_method as blob_storage_method, b.hash as blob_hash, b.compress as blob_compress,
  cast(b.raw_size + case when r.doc_id % 71 = 1 then 1 else 0 end as bigint) as blob_raw_size, b.stored_size as blob_stored_size, r.uid, r.gid, r.mtime, r.mtime_ns_part
from (
  select doc_id, cast(doc_id % 4 + 1 as bigint) as fileset_id, concat(lang, '/', source, '/', doc_id) as path, cast(case when doc_id % 83 = 2 then 3 else 1 end as int) as role,
    cast(case when doc_id % 20 = 3 then 16877 when doc_id % 20 = 4 then 41471 else 33188 end as int) as mode, case when doc_id % 40 = 4 then concat('to/', doc_id) end as content,
    md5(text) as h, cast(doc_id % 3 as bigint) as uid, cast(0 as bigint) as gid, cast(1700000000 + doc_id as bigint) as mtime, cast(case when doc_id % 6 = 0 then null else doc_id end as bigint) as mtime_ns_part
  from {documents} where text is not null and doc_id % 5 <> 0
  union all
  select doc_id, cast(101 + doc_id % 4 + 4 * j as bigint), concat(lang, '/', source, '/', doc_id),
    cast(case when doc_id % 97 = 13 then 0 when doc_id % 5 = 0 then 3 when cast(floor(doc_id / 60) as bigint) % 2 = 0 then 2 else 4 end as int),
    cast(case when doc_id % 20 = 3 then 16877 when doc_id % 20 = 4 then 41471 when doc_id % 5 = 0 then 33188 else 33261 end as int), case when doc_id % 20 = 4 then concat('to/', doc_id) end,
    md5(text), cast(doc_id % 3 as bigint), cast(j as bigint), cast(1700000000 + doc_id as bigint), cast(case when doc_id % 6 = 0 then null else doc_id end as bigint)
  from {documents} join (select 0 as j union all select 1 union all select 2) js
    on (doc_id % 50 = 7 or (cast(floor(doc_id / 4) as bigint) % 3 = j and cast(floor(doc_id / 12) as bigint) % 5 < 2))
  where text is not null
) r left join {blob} b on b.hash = r.h and r.mode in (33188, 33261) and r.role <> 4""",
    "fileset": """
select fileset_id as id, cast(case when fileset_id < 100 then 0 else (fileset_id - 101) % 4 + 1 end as bigint) as base_id,
  cast(count(*) + case when fileset_id = 3 then 1 else 0 end as bigint) as file_object_count, cast(sum(case when role = 4 then -1 when role = 2 then 0 else 1 end) as bigint) as file_count,
  cast(sum(case when role in (1, 3) then coalesce(blob_raw_size, 0) else 0 end) as bigint) as file_raw_size_sum,
  cast(sum(case when role in (1, 3) then coalesce(blob_stored_size, 0) else 0 end) as bigint) as file_stored_size_sum
from {file} group by fileset_id
union all select cast(5 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint)
union all select cast(113 as bigint), cast(999 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint)""",
    "backup": """
select cast(o_orderkey + 1 as bigint) as id, cast(DAYS(o_orderdate) as bigint) * 86400 + o_orderkey * 37 % 86400 as timestamp, cast(o_orderkey * 7919 % 1000000000 as bigint) as timestamp_ns_part,
  concat('player:', o_custkey % 40) as creator, concat('c', o_orderkey) as comment,
  case when o_orderpriority like '1%' then '{{"temporary":true}}' when o_orderpriority like '2%' then '{{"hidden":true}}' when o_orderpriority like '3%' then '{{"protected":true,"scheduled":true}}'
    when o_orderpriority like '4%' then '{{"temporary":null}}' else '{{}}' end as tags,
  cast(case when o_orderkey % 601 = 3 then 777 else o_orderkey % 4 + 1 end as bigint) as fileset_id_base, cast(case when o_orderkey % 613 = 5 then 102 else 101 + o_orderkey % 12 end as bigint) as fileset_id_delta,
  cast(b.file_count + d.file_count + case when o_orderkey % 701 = 2 then 1 else 0 end as bigint) as file_count,
  cast(b.file_raw_size_sum + d.file_raw_size_sum + case when o_orderkey % 709 = 2 then 1 else 0 end as bigint) as file_raw_size_sum,
  cast(b.file_stored_size_sum + d.file_stored_size_sum as bigint) as file_stored_size_sum
from {orders} join {fileset} b on b.id = o_orderkey % 4 + 1 join {fileset} d on d.id = 101 + o_orderkey % 12""",
    "presence": """
select cast(event_id as bigint) as moment, case when event_id % 1500 = 0 then cast(null as bigint) else user_id end as user,
  case when event_id % 1500 = 0 then 'reset' when event_id % 3 = 0 then 'left' else 'joined' end as change from {events}""",
}
_needs = {name: [x for x in re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text) if x in TABLES] for name, text in TABLES.items()}


def _spark(text: str) -> str:
    return re.sub(r"DAYS\((\w+)\)", r"datediff(cast(\1 as date), date '1970-01-01')", text.replace("OCTETS(", "octet_length("))


def _duck(text: str) -> str:
    return re.sub(r"DAYS\((\w+)\)", r"date_diff('day', date '1970-01-01', cast(\1 as date))", text.replace("OCTETS(", "strlen("))


class Tables:
    """Lazy derived and source tables of a data directory, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self._held: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._held:
            if name in TABLES:
                parts = {x: getattr(self, x) for x in dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", TABLES[name]))}
                self._held[name] = self.spark.sql(_spark(TABLES[name]), **parts)
            else:
                self._held[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._held[name]


def oracle(body: str) -> str:
    """DuckDB SQL with the derived tables that `body` names as common table expressions."""
    wanted = {name for name in TABLES if re.search(rf"\b{name}\b", body)}
    while True:
        more = {x for name in wanted for x in _needs[name]} - wanted
        if not more:
            break
        wanted |= more
    chain = ", ".join(f"{name} as ({_duck(TABLES[name]).format(**{x: x for x in (*SOURCES, *TABLES)})})" for name in TABLES if name in wanted)
    body = body.strip()
    if body.startswith("with recursive "):
        return f"with recursive {chain}, {body[15:]}" if chain else body
    if body.startswith("with "):
        return f"with {chain}, {body[5:]}" if chain else body
    return f"with {chain} {body}" if chain else body
