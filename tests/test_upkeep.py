"""Packs, versions of a catalog, numbering, resets and strict lookups against small models."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lamina.catalog import Catalog, Conflict
from lamina.functions import meta
from lamina.operators import audits, layout, lookups, snapshots
from lamina.schema import SCHEMAS
from lamina.streaming import presence


def test_numbered_follows_any_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abcde"), rng.choice([None, 1, 2])) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, s string, n int").repartition(7)
    got = {r["id"]: r["place"] for r in lookups.numbered(frame, [F.desc("s"), F.col("n").asc_nulls_last(), F.col("id")], "place").collect()}
    order = sorted(rows, key=lambda r: (-ord(r[1]), r[2] is None, r[2] or 0, r[0]))
    assert got == {r[0]: at for at, r in enumerate(order, 1)}
    assert lookups.numbered(frame.limit(0), ["id"], "place").count() == 0
    assert {r["id"] for r in lookups.ends(frame, ["id"], 2).collect()} == {0, 1, 498, 499}


def test_pack_rules(spark):
    rng = random.Random(2)
    rows = [(w, i, rng.choice([1, 5, 30, 200])) for w in range(3) for i in range(100)]
    found = layout.pack_entries(spark.createDataFrame(rows, "writer long, id long, stored_size long"), ["id"], largest=100, most=8, own=150).collect()
    for w in range(3):
        opened, active, want = 0, None, {}
        for _, i, size in (r for r in rows if r[0] == w):
            if size >= 150:
                opened += 1
                want[i] = (opened, 0)
                continue
            if active is None or active[1] >= 100 or active[2] >= 8:
                opened += 1
                active = [opened, 0, 0]
            want[i] = (active[0], active[1])
            active[1:] = [active[1] + size, active[2] + 1]
        assert {r["id"]: (r["new_pack"], r["new_offset"]) for r in found if r["writer"] == w} == want


def test_entries_of_short_or_missing_packs_are_null(spark):
    packs = spark.createDataFrame([(1, bytearray(b"abcdef"))], "pack_id long, data binary")
    entries = spark.createDataFrame([(1, 1, 2, 3), (2, 1, 4, 3), (3, 9, 0, 1), (4, 1, 6, 0)], "id long, pack_id long, pack_offset long, stored_size long")
    assert {r["id"]: r["data"] and bytes(r["data"]) for r in layout.read_entries(entries, packs).collect()} == {1: b"cde", 2: None, 3: None, 4: bytearray()}


def test_publish_is_seen_whole_and_once(spark, tmp_path):
    path = str(tmp_path / "store")
    tables = lambda n: {name: spark.createDataFrame([(i, 1, "h", "plain", 1, 1) for i in range(n)], ddl) if name == "blob" else spark.createDataFrame([], ddl) for name, ddl in SCHEMAS.items()}
    with pytest.raises(FileNotFoundError):
        Catalog.load(spark, path)
    Catalog(tables(2)).publish(spark, path)
    one, other = Catalog.load(spark, path), Catalog.load(spark, path)
    assert one.blob.count() == 2
    one.update(tables(3))
    one.publish(spark, path)
    (tmp_path / "store" / "unfinished").mkdir()  # a writer that died before its mark
    with pytest.raises(Conflict):
        other.publish(spark, path)
    assert Catalog.load(spark, path).blob.count() == 3 and other.blob.count() == 2
    before, after = Catalog.vacuum(spark, path)
    assert after < before and Catalog.load(spark, path).blob.count() == 3 and len(Catalog.versions(spark, path)) == 1


def test_strict_lookups_fail_on_a_missing_key(spark):
    table, keys = spark.createDataFrame([(1, "a")], "id long, hash string"), spark.createDataFrame([(1,), (2,)], "id long")
    assert lookups.keyed_strict(keys.limit(1), table, ["id"], "hash").count() == 1
    with pytest.raises(PySparkException, match="missing"):
        lookups.keyed_strict(keys, table, ["id"], "hash").collect()
    file = spark.createDataFrame([(1, "p", None, "gone")], "fileset_id long, path string, blob_id long, blob_hash string")
    with pytest.raises(PySparkException, match="does not exist"):
        snapshots.finalize_files(file, table).collect()


def test_stored_bytes(spark):
    objects = spark.createDataFrame([(1, "900150983cd24fb0d6963f7d28e17f72", 3), (2, "x", 3), (3, "y", 3), (4, "z", 1)], "id long, hash string, raw_size long")
    store = spark.createDataFrame([("900150983cd24fb0d6963f7d28e17f72", b"abc"), ("x", b"abd"), ("y", b"abcd")], "hash string, data binary")
    assert {(r["id"], r["kind"]) for r in audits.audit_stored(objects, store).collect()} == {(2, "corrupted"), (3, "mismatched"), (4, "missing")}


def test_stream_forgets_at_a_reset(spark, tmp_path):
    for at, rows in enumerate(([("a", "joined", 1), ("b", "joined", 2)], [(None, "reset", 3)], [("a", "left", 4), ("b", "joined", 5), ("b", "left", 6)])):
        spark.createDataFrame(rows, "user string, change string, moment long").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        out = presence.stream_states(spark.readStream.schema("user string, change string, moment long").json(str(tmp_path / "in")), ["a", "b"])
        run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
        assert at < 3
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", True, 1), ("b", False, 6), ("b", True, 2), ("b", True, 5)]


def test_times_and_metadata(spark):
    rows = spark.createDataFrame([("2023",), ("20231130 21:39:55",), ("2023-11-30 21:39:55.123",), ("2023-13-01",), ("x",), (None,)], "t string")
    got = [r["at"] for r in rows.select(meta.parse_time(F.col("t")).alias("at")).collect()]
    assert got == [1672531200 * 10**9, 1701380395 * 10**9, 1701380395123 * 10**6, None, None, None]
    one = spark.createDataFrame([("player:a", "c", 1700000000, 5, ["w"], {"k": "v"})], "creator string, comment string, s long, n long, targets array<string>, tags map<string,string>")
    back = one.select(meta.decode(meta.encode(*map(F.col, ("creator", "comment", "s", "n", "targets", "tags")))).alias("m")).first()["m"]
    assert (back["creator"], back["comment"], back["timestamp"], back["timestamp_ns_part"], back["targets"]) == ("player:a", "c", 1700000000, 5, ["w"])
