"""The store's commands, end to end on small folders, against plain files."""

from __future__ import annotations

import json
import os
import tarfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lamina import cli
from lamina.operators.predicates import NotFound
from lamina.operators.retention import Policy
from lamina.store import Protected, Store


def _tree(folder, files: dict[str, bytes]) -> str:
    for name, data in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(folder)


def _read(folder) -> dict[str, bytes]:
    return {os.path.relpath(os.path.join(top, name), folder): open(os.path.join(top, name), "rb").read() for top, _, names in os.walk(folder) for name in names}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A store of three snapshots: a world, the same with changes (a delta), and another world (a base)."""
    root = tmp_path_factory.mktemp("store")
    store = Store.create(spark, str(root / "s"))
    with pytest.raises(FileExistsError):
        Store.create(spark, str(root / "s"))
    one = {f"world/r{i}.dat": bytes([i]) * (i * 100) for i in range(20)} | {"world/logs/a.log": b"x", "other/skip": b"y"}
    source = root / "in"
    _tree(source, one)
    os.symlink("r1.dat", source / "world" / "link")
    assert store.make_from(str(source), ["world"], ["logs/"], creator="player:a", comment="first", at=10**18) == 1
    (source / "world" / "r3.dat").write_bytes(b"changed")
    (source / "world" / "r4.dat").unlink()
    assert store.make_from(str(source), ["world"], ["*.log", "logs"], creator="player:b", comment="second", at=2 * 10**18, codec="gzip") == 2
    assert store.make_from(_tree(root / "in2", {f"other{i}/f": b"z%d" % i for i in range(30)}), ["other*"], at=3 * 10**18, tags={"protected": True}) == 3
    return root, store


def test_looking(made):
    root, store = made
    assert [r["id"] for r in store.backups(1, 2).rows.collect()] == [3, 2] and store.backups(1, 2).pages == 2
    assert [r["id"] for r in store.backups(creator="player:a").rows.collect()] == [1]
    assert (store.resolve("latest"), store.resolve("~2"), store.resolve("1")) == (3, 1, 1)
    with pytest.raises(NotFound):
        store.resolve(9)
    assert {r["kind"]: r["files"] for r in store.show(1)[1].collect()} == {"file": 20, "directory": 1, "symlink": 1}
    changes = {r["path"]: r["change"] for r in store.diff(1, 2).collect()}
    assert changes == {"world/r3.dat": "changed", "world/r4.dat": "deleted"}
    assert {r["id"]: r["base_id"] for r in store.catalog().fileset.collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 4}
    assert {r["backup_id"] for r in store.file(1, "world/r2.dat")[1].collect()} == {1, 2}
    assert {r["backup_id"] for r in store.file(2, "world/r3.dat")[1].collect()} == {2}
    assert [r["path"] for r in store.directory(2).collect()] == ["world"]
    assert len(store.directory(2, "world").collect()) == 20
    with pytest.raises(NotADirectoryError):
        store.directory(2, "world/r1.dat")
    digest = store.files(1).where("path = 'world/r2.dat'").first()["blob_hash"]
    row, samples, total = store.inspect("blob", digest[:12])
    assert row.first()["raw_size"] == 200 and total == samples.count() > 0
    assert store.overview().first()["backup_count"] == 3
    assert store.validate(contents=True).collect() == []


def test_restoring(made, spark):
    root, store = made
    want = {k: v for k, v in _read(root / "in").items() if k.startswith("world/") and "logs" not in k}
    assert store.export(2, str(root / "out")) == 21
    assert _read(root / "out") == want and os.readlink(root / "out" / "world" / "link") == "r1.dat"
    assert store.export(1, str(root / "part"), child="world/r4.dat") == 1 and _read(root / "part") == {"world/r4.dat": bytes([4]) * 400}
    for name in ("x.tar", "x.tar.gz", "x.tar.zst", "x.zip"):
        other = Store.create(spark, str(root / f"s-{name}"), "md5")
        store.export(2, str(root / name))
        assert other.import_archive(f"file://{root}/{name}", ensure_meta=True) == 1
        about = other.backups().rows.first()
        assert (about["creator"], about["comment"], about["timestamp"], about["targets"]) == ("player:b", "second", 2 * 10**9, ["world"])
        assert {r["path"]: r["blob_raw_size"] for r in other.files(1).where("blob_hash is not null").collect()} == {k: len(v) for k, v in want.items() if k != "world/link"}
    store.export(2, str(root / "bare.tar"), with_meta=False)
    with pytest.raises(NotFound):
        other.import_archive(f"file://{root}/bare.tar", ensure_meta=True)
    assert other.import_archive(f"file://{root}/bare.tar") == 2 and [r["targets"] for r in other.backups(size=1).rows.collect()] == [["world"]]


def test_slots(made, spark):
    root, _ = made
    store = Store.create(spark, str(root / "slots"))
    slot = root / "slot1"
    _tree(slot, {"world/a": b"1", "info.json": json.dumps({"time_stamp": 1.5, "comment": "c"}).encode()})
    assert store.import_slot(str(slot), "tool:q") == 1
    slot = root / "slot2"
    _tree(slot, {"info.json": json.dumps({"time_stamp": 2, "backup_format": "tar_gz"}).encode()})
    with tarfile.open(slot / "backup.tar.gz", "w:gz") as out:
        out.add(root / "slot1" / "world", arcname="world")
    assert store.import_slot(str(slot)) == 2
    rows = {r["id"]: (r["timestamp"], r["timestamp_ns_part"], r["comment"], r["targets"]) for r in store.catalog().backup.collect()}
    assert rows == {1: (1, 500_000_000, "c", ["world"]), 2: (2, 0, "", ["world"])} and store.catalog().blob.count() == 1


def test_changing(made, spark, tmp_path):
    root, _ = made
    store = Store.create(spark, str(tmp_path / "s"))
    for at, files in enumerate(({f"w/{i}": b"%d" % i for i in range(20)}, {f"w/{i}": b"%d" % (i or 99) for i in range(20)}, {"v/x": b"only"}), 1):
        store.make_from(_tree(tmp_path / f"in{at}", files), ["*"], at=at * 10**18)
    store.rename(2, "named")
    store.tag(3, "protected", True)
    assert store.catalog().backup.where("id = 2").first()["comment"] == "named"
    with pytest.raises(Protected):
        store.delete([3])
    want = _read(tmp_path / "in2")
    assert store.migrate_compress("zstd") == 22 and store.migrate_hash("sha256") == 22 and store.migrate_hash("sha256") == 0
    assert len(os.listdir(tmp_path / "s" / "blobs")) >= 1 and store.validate(contents=True).collect() == []
    gone = {r["kind"]: r["gone"] for r in store.delete([1]).collect()}
    assert gone.get("blob") == 1  # the content that only the first snapshot held
    assert store.validate(contents=True).collect() == []
    store.export(2, str(tmp_path / "out"))
    assert _read(tmp_path / "out") == want
    store.reassign("time")
    assert sorted(r["id"] for r in store.catalog().backup.collect()) == [1, 2]
    kept = {r["id"]: r["keep"] for r in store.retention_plan(Policy(last=1), now=4 * 10**9).collect()}
    assert kept == {1: True, 2: True}  # one kept as the last, one protected
    assert store.delete_range(None, None).count() >= 1
    assert [r["id"] for r in store.catalog().backup.collect()] == [2] and store.catalog().blob.count() == 1
    assert store.sweep() == 0 and store.prune_database()["compactable_packs"] == 0
    path = next(os.path.join(top, n) for top, _, names in os.walk(tmp_path / "s" / "blobs") for n in names)
    os.remove(path)
    assert [(r["part"], r["kind"]) for r in store.validate(["blobs"], contents=True).collect()] == [("blobs", "missing")]
    with pytest.raises(PySparkException, match="missing or damaged"):
        store.export(2, str(tmp_path / "gone"))
    before, after = store.vacuum()
    assert after < before and store.catalog().backup.count() == 1


def test_an_empty_snapshot(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    (tmp_path / "in").mkdir()
    assert store.make_from(str(tmp_path / "in"), ["*"]) == 1
    assert store.files(1).count() == 0 and store.validate(contents=True).collect() == [] and store.export(1, str(tmp_path / "out")) == 0
    assert store.overview().select(F.col("file_total_count")).first()[0] == 0


def test_command_line(spark, tmp_path):
    store, folder = str(tmp_path / "s"), _tree(tmp_path / "in", {"w/a": b"1", "w/b": b"22"})
    say = lambda *words: [json.loads(line) for line in cli.run(spark, [store, *words])]
    say("init", "--hash", "md5")
    assert say("make", folder, "w", "--comment", "c") == [{"id": 1}]
    head, row = say("list", "--from", "2020")
    assert head == {"page": 1, "pages": 1, "total": 1, "out_of_range": False} and row["comment"] == "c"
    assert say("list", "2")[0]["out_of_range"]
    assert [r["path"] for r in say("ls", "latest", "w")] == ["w/a", "w/b"]
    assert say("extract", "1", "w/b", str(tmp_path / "out")) == [{"entries": 1}] and _read(tmp_path / "out") == {"w/b": b"22"}
    assert say("validate", "--contents") == [] and say("prune", "--last", "1")[0]["keep"]
    with pytest.raises(ValueError, match="not a time"):
        say("list", "--from", "soon")
