"""What holds a file, against a small model, and the order of its rows."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from lamina.operators import lineage


def test_rows_of_a_snapshot_come_together_without_broadcasts(spark, tmp_path):
    """Views with many snapshots: rows by file repeat every snapshot's id for every file, far apart, and cost its whole width on disk."""
    file = [(1, f"p{i}", 1) for i in range(40)] + [(2, f"q{i}", 1) for i in range(30)] + [(101, f"p{i}", 2 if i % 2 else 4) for i in range(10)] + [(101, "new", 3), (101, "none", 0)] + [(102, "p5", 2)]
    backup = [(7919 * i % 1000003, 2 if i % 3 == 0 else 1, 101 if i % 2 else 102) for i in range(6000)]
    of = {s: {p: role for f, p, role in file if f == s} for s in (1, 2, 101, 102)}
    want = {(f, p, i) for i, base, delta in backup for f, p in [(delta, p) for p in of[delta]] + [(base, p) for p in of[base] if of[delta].get(p) not in (2, 3, 4)]}
    files, snapshots = spark.createDataFrame(file, "fileset_id long, path string, role int"), spark.createDataFrame(backup, "id long, fileset_id_base long, fileset_id_delta long")
    key, path = "spark.sql.autoBroadcastJoinThreshold", str(tmp_path / "out")
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        found = lineage.containing_file(files.select("fileset_id", "path"), files, snapshots)
        rows = [tuple(r) for r in found.select("fileset_id", "path", "backup_id").collect()]
        found.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    assert len(rows) == len(want) and set(rows) == want
    assert sum(1 for _ in itertools.groupby(rows, key=lambda r: r[2])) == len(backup)
    assert spark.read.parquet(path).select(F.sum("backup_id").alias("s")).first()["s"] == sum(r[2] for r in want)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < len(want)  # less than a byte a row
