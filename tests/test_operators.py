"""Operators against small models and golden cases."""

from __future__ import annotations

import datetime
import hashlib
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from lamina.functions import codecs, units
from lamina.operators import audits, content, layout, predicates, retention, snapshots
from lamina.sources import archives
from lamina.streaming import presence

FILE = "fileset_id long, path string, role int, mode int, content string, blob_hash string, blob_raw_size long, uid long, gid long, mtime long, mtime_ns_part long"


def _file(fileset: int, path: str, role: int = 1, h: str | None = "a") -> tuple:
    return (fileset, path, role, 33188, None, h, 1, 0, 0, 0, None)


def test_merge_and_diff_follow_a_model(spark):
    rng = random.Random(0)
    rows, models = [], {}
    for base in (1, 2):
        files = {f"p{i}": rng.choice("abc") for i in range(20) if rng.random() < 0.7}
        rows += [_file(base, p, 1, h) for p, h in files.items()]
        for delta in (100 + base, 200 + base):
            view = dict(files)
            for i in range(20):
                path, draw = f"p{i}", rng.random()
                if draw < 0.2 and path in files:
                    rows.append(_file(delta, path, 2, "z"))
                    view[path] = "z"
                elif draw < 0.4 and path in files:
                    rows.append(_file(delta, path, 4, None))
                    del view[path]
                elif path not in files and draw < 0.5:
                    rows.append(_file(delta, path, 3, "n"))
                    view[path] = "n"
            models[base, delta] = view
    file = spark.createDataFrame(rows, FILE)
    views = snapshots.merge(file, spark.createDataFrame([*models], "base long, delta long")).collect()
    got = {}
    for r in views:
        got.setdefault((r["base"], r["delta"]), {})[r["path"]] = r["blob_hash"]
    assert got == models
    one = lambda k: snapshots.merge(file, spark.createDataFrame([k], "base long, delta long"))
    old, new = models[1, 101], models[2, 202]
    change = {r["path"]: r["change"] for r in snapshots.diff(one((1, 101)), one((2, 202))).collect()}
    want = {p: "deleted" for p in old.keys() - new.keys()} | {p: "added" for p in new.keys() - old.keys()} | {p: "changed" for p in old.keys() & new.keys() if old[p] != new[p]}
    assert change == want


def test_shrink_keeps_every_view(spark):
    rows = [_file(1, p) for p in "abcd"] + [_file(101, "a", 2, "x"), _file(101, "b", 4, None), _file(102, "a", 4, None), _file(102, "b", 2, "y"), _file(102, "c", 4, None)]
    file = spark.createDataFrame(rows, FILE)
    fileset = spark.createDataFrame([(1, 0), (101, 1), (102, 1), (2, 0)], "id long, base_id long")
    pairs = spark.createDataFrame([(1, 101), (1, 102)], "base long, delta long")
    view = lambda f: sorted((r["delta"], r["path"], r["blob_hash"]) for r in snapshots.merge(f, pairs).collect())
    assert sorted(r["path"] for r in snapshots.shrinkable(file, fileset).collect()) == ["a", "b"]
    assert view(snapshots.shrink(file, fileset)) == view(file)


def _retention_model(rows, p: retention.Policy, now: int) -> dict:
    """A plain walk over the snapshots, newest first."""
    rows = sorted(rows, key=lambda r: (-r[1], -r[0]))
    marks, fallback = {}, {}
    formats = {"hour": "%Y/%m/%d/%H", "day": "%Y/%m/%d", "week": "%G/%V", "month": "%Y/%m", "year": "%Y"}
    for stage in ("last", "hour", "day", "week", "month", "year"):
        limit = getattr(p, stage)
        if not limit:
            continue
        bucket = lambda r, s=stage: str(r[0]) if s == "last" else datetime.datetime.fromtimestamp(r[1], datetime.UTC).strftime(formats[s])
        holders = {bucket(r): r[0] for r in rows if marks.get(r[0], "").startswith("keep") and not r[2]}
        first: dict = {}
        for r in rows:
            if r[0] in marks or r[2]:
                continue
            b = bucket(r)
            if b in holders:
                fallback.setdefault(r[0], f"superseded by {holders[b]} ({stage})")
            elif b in first:
                marks[r[0]] = f"superseded by {first[b]} ({stage})"
            elif 0 <= limit <= len(first):
                break
            else:
                first[b] = r[0]
                marks[r[0]] = f"keep {stage} {len(first)}"
    out, kept = {}, 0
    for r in rows:
        reason = "keep protected" if r[2] else marks.get(r[0], fallback.get(r[0], "unmarked"))
        if reason.startswith("keep") and not r[2]:
            if 0 < p.max_amount <= kept:
                reason = "max_amount exceeded"
            elif 0 < p.max_lifetime < now - r[1]:
                reason = "max_lifetime exceeded"
            else:
                kept += 1
        out[r[0]] = (reason.startswith("keep"), reason)
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_retention_follows_the_walk(spark, seed):
    rng = random.Random(seed)
    policy = retention.Policy(last=rng.randint(0, 3), hour=2, day=rng.choice([-1, 3]), week=2, month=rng.randint(0, 3), year=1, max_amount=rng.choice([0, 6]), max_lifetime=rng.choice([0, 86400 * 200]))
    now = 1_750_000_000
    rows = [(i, now - int(rng.expovariate(1) * 86400 * rng.choice([0.1, 5, 200])), rng.random() < 0.1) for i in range(1, 90)]
    frame = spark.createDataFrame([(i, s, 0, p) for i, s, p in rows], "id long, timestamp long, timestamp_ns_part long, protected boolean")
    got = {r["id"]: (r["keep"], r["reason"]) for r in retention.plan(frame, policy, now).collect()}
    assert got == _retention_model(rows, policy, now)


def test_prefixes():
    assert predicates.prefix_bounds("a") == ("a0", "b0")
    assert predicates.prefix_bounds("ab") == ("ab", "ac")
    assert predicates.prefix_bounds("ff") == ("ff", None)
    assert predicates.prefix_bounds("0f") == ("0f", "10")
    with pytest.raises(ValueError):
        predicates.prefix_bounds("xyz")


def test_resolve_prefix(spark):
    table = spark.createDataFrame([("aa11",), ("aa22",), ("bb00",)], "hash string")
    assert predicates.resolve_prefix(table, "hash", "b") == "bb00"
    with pytest.raises(predicates.NotUnique):
        predicates.resolve_prefix(table, "hash", "aa")
    with pytest.raises(predicates.NotFound):
        predicates.resolve_prefix(table, "hash", "cc")


def test_paths(spark):
    rows = spark.createDataFrame([(p,) for p in ("a", "ab", "a/b", "a/b/c", "a%/x", "B/y")], "path string")
    found = lambda c: sorted(r[0] for r in rows.where(c).collect())
    assert found(predicates.child_of(F.col("path"), "a")) == ["a/b"]
    assert found(predicates.within(F.col("path"), "a")) == ["a", "a/b", "a/b/c"]
    assert found(predicates.child_of(F.col("path"), "")) == ["a", "ab"]
    assert found(predicates.rule_match(F.col("path"), ["a/**", "!c"])) == ["a/b"]
    assert found(predicates.simple_match(F.col("path"), ["*b"])) == ["a/b", "ab"]


def test_units():
    assert units.parse_duration("1440s") == 1440 and units.auto_duration(1440) == (24.0, "m")
    assert units.parse_duration("2mon") == 2 * 30 * 86400
    assert units.auto_quantity(4096) == (4.0, "Ki") and units.precise(1234, units.MULTIPLES) == (1234, "")
    assert units.parse_quantity("4ki") == 4096 and units.parse_quantity("3MB") == 3_000_000 and units.parse_quantity("2GiB") == 2 << 30
    assert units.parse_id_range("3-") == (3, None) and units.parse_id_range("[3,9]") == (3, 9) and units.parse_id_range("*") == (None, None)
    assert units.parse_backup_id("~2") == ("latest", 2) and units.parse_backup_id("17") == 17
    assert presence.backoff(3600) == [0, 10, 60, 300] and presence.backoff(100) == [0, 10]


def test_content_defined_chunks_cover_and_resist_shifts(spark):
    rng = random.Random(1)
    data = bytes(rng.getrandbits(8) for _ in range(600_000))
    ends = content.cut_points(data, 32 << 10, 8 << 10, 256 << 10)
    assert ends[-1] == len(data) and all(b - a <= 256 << 10 for a, b in zip([0, *ends], ends, strict=False))
    rows = spark.createDataFrame([(0, bytearray(data)), (1, bytearray(b"new head" + data))], "key int, data binary")
    chunks = content.cdc_chunks(rows, "fastcdc_32k").collect()
    by = [{r["hash"] for r in chunks if r["key"] == k} for k in (0, 1)]
    assert len(by[0] & by[1]) >= len(by[0]) - 2


def test_fixed_and_grouped_chunks(spark):
    rows = spark.createDataFrame([(0, bytearray(b"a" * 10)), (1, bytearray())], "key int, data binary")
    got = sorted((r["offset"], r["length"]) for r in content.fixed_chunks(rows, 4).collect())
    assert got == [(0, 4), (4, 4), (8, 2)]
    many = spark.createDataFrame([(0, i * 2, 2, "00" if i == 70 else "11") for i in range(100)], "key int, offset long, length long, hash string")
    groups = sorted((r["group"], r["chunk_count"], r["raw_size"]) for r in content.chunk_groups(many).collect())
    assert groups == [(0, 71, 142), (1, 29, 58)]


def test_codecs(spark):
    rows = spark.createDataFrame([(bytearray(b"x" * 1000),), (None,)], "data binary")
    for method in ("plain", "gzip", "lzma", "zstd"):
        back = rows.select("data", codecs.decompress(codecs.compress(F.col("data"), method), method).alias("back")).collect()
        assert all(r["data"] == r["back"] for r in back)
    with pytest.raises(ValueError):
        codecs.compress(F.col("data"), "nothing")


def test_compaction(spark):
    pack = spark.createDataFrame([(1, 100, 50, 1), (2, 0, 0, 0), (3, 100, 100, 9), (4, 0, 0, 1)], "id long, size long, live_size long, live_entry_count long")
    assert sorted(r["id"] for r in layout.compactable(pack, 0.6).collect()) == [1, 2]
    with pytest.raises(ValueError):
        layout.compactable(pack, -1)


def test_archives(spark, tmp_path):
    folder = tmp_path / "tree"
    (folder / "sub").mkdir(parents=True)
    (folder / "sub" / "b.txt").write_bytes(b"bee")
    (folder / "a.txt").write_bytes(b"")
    (folder / "link").symlink_to("a.txt")
    spark.dataSource.register(archives.TreeSource)
    tree = spark.read.format("lamina_tree").load(str(folder))
    want = {r["path"]: bytes(r["content"] or b"") for r in tree.collect()}
    assert want == {"sub": b"", "sub/b.txt": b"bee", "a.txt": b"", "link": b"a.txt"}
    out = tmp_path / "archives"
    out.mkdir()
    assert archives.write_tar(tree, str(out / "x.tar.gz"), "gz") == 4
    assert archives.write_zip(tree.where("path <> 'link'"), str(out / "y.zip")) == 3
    assert tarfile.open(out / "x.tar.gz").getmember("link").issym()
    back = archives.read_archives(spark, str(out)).collect()
    for name, paths in (("x.tar.gz", want), ("y.zip", want.keys() - {"link"})):
        assert {r["path"]: bytes(r["content"] or b"") for r in back if r["archive"].endswith(name)} == {p: want[p] for p in paths}


def test_presence_stream(spark, tmp_path):
    events = [("u", "left", 1), ("u", "joined", 2), ("v", "joined", 3), ("u", "left", 4)]
    spark.createDataFrame(events, "user string, change string, moment long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, change string, moment long").parquet(str(tmp_path / "in"))
    run = presence.stream_states(stream).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.sql("select * from states").collect()) == [("u", False, 4), ("u", True, 2), ("v", True, 3)]


def test_roles_and_group_hashes_are_audited(spark):
    file = spark.createDataFrame([_file(1, "a"), _file(101, "a", 3), _file(102, "b", 2), _file(103, "b", 4), _file(104, "a", 2), _file(104, "b", 3)], FILE)
    fileset = spark.createDataFrame([(1, 0), (101, 1), (102, 1), (103, 1), (104, 1)], "id long, base_id long")
    assert sorted(map(tuple, audits.audit_file_roles(fileset, file).collect())) == [(i, "bad_file_role") for i in (101, 102, 103)]
    chunk = spark.createDataFrame([(1, "b", 5, 5), (2, "a", 5, 5)], "id long, hash string, raw_size long, stored_size long")
    bindings = spark.createDataFrame([(g, o, c) for g in (1, 2) for o, c in ((0, 1), (5, 2))], "chunk_group_id long, chunk_offset long, chunk_id long")
    digest = lambda *x: hashlib.sha256("\0".join(x).encode()).hexdigest()
    groups = spark.createDataFrame([(1, digest("b", "a")), (2, digest("a", "b"))], "id long, hash string")
    assert list(map(tuple, audits.audit_group_hashes(groups, bindings, chunk).collect())) == [(2, "bad_layout")]
