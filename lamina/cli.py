"""The store's commands on a command line: `python -m lamina.cli STORE COMMAND ...`; rows come out as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.meta import parse_time
from lamina.functions.units import parse_id_range
from lamina.operators.retention import Policy
from lamina.store import Store


def _lines(rows: DataFrame) -> Iterator[str]:
    for row in rows.select(F.to_json(F.struct("*"))).toLocalIterator():
        yield row[0]


def _key(text: str) -> int | str:
    return int(text) if text.isdigit() else text


def _time(spark: SparkSession, text: str | None) -> int | None:
    """Nanoseconds of a time as `parse_time` reads it."""
    if text is None:
        return None
    found = spark.createDataFrame([(text,)], "t string").select(parse_time(F.col("t"))).first()[0]
    if found is None:
        raise ValueError(f"not a time: {text!r}")
    return found


def _list(s: Store, a: argparse.Namespace) -> Iterator[str]:
    ids = parse_id_range(a.ids) if a.ids else (None, None)
    page = s.backups(a.page, a.per_page, a.sort, a.all, ids=ids, creator=a.creator, since=_time(s.spark, a.since), until=_time(s.spark, a.until))
    yield json.dumps({"page": page.number, "pages": page.pages, "total": page.total, "out_of_range": not 1 <= page.number <= max(1, page.pages)})
    yield from _lines(page.rows)


def _pair(found: Sequence) -> Iterator[str]:
    for each in found:
        if isinstance(each, int):
            yield json.dumps({"total": each})
        else:
            yield from _lines(each)


def _prune(s: Store, a: argparse.Namespace) -> Iterator[str]:
    policy = Policy(a.last, a.hour, a.day, a.week, a.month, a.year, a.max_amount, a.max_lifetime, a.zone)
    yield from _lines(s.prune(policy) if a.apply else s.retention_plan(policy))


def _say(name: str, value: object) -> Iterator[str]:
    yield json.dumps({name: value})


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lamina")
    top.add_argument("store")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable[[Store, argparse.Namespace], Iterator[str]], *arguments: str | tuple) -> None:
        own = commands.add_parser(name)
        own.set_defaults(run=run)
        for x in arguments:
            flag, options = (x, {}) if isinstance(x, str) else x
            own.add_argument(flag, **options)

    flag, number = {"action": "store_true"}, {"type": int, "default": 0}
    many = {"nargs": "+"}
    command("init", lambda s, a: _say("store", Store.create(s.spark, s.root, a.hash).root), ("--hash", {"default": "xxh128"}))
    command(
        "list", _list, ("page", {"type": int, "nargs": "?", "default": 1}), ("--per-page", {"type": int, "default": 10}), ("--sort", {"default": "time_r", "choices": ("id", "id_r", "time", "time_r")}), "--ids", "--creator",
        ("--from", {"dest": "since"}), ("--to", {"dest": "until"}), ("--all", flag),
    )
    command("show", lambda s, a: _pair(s.show(s.resolve(a.id))), "id")
    command("diff", lambda s, a: _lines(s.diff(s.resolve(a.old), s.resolve(a.new), a.status)), "old", "new", ("--status", flag))
    command("file", lambda s, a: _pair(s.file(s.resolve(a.id), a.path)), "id", "path")
    command("ls", lambda s, a: _lines(s.directory(s.resolve(a.id), a.path, a.tree)), "id", ("path", {"nargs": "?", "default": ""}), ("--tree", flag))
    command("fileset", lambda s, a: _pair(s.fileset(a.id)), ("id", {"type": int}))
    command("inspect", lambda s, a: _pair(s.inspect(a.kind, _key(a.key))), ("kind", {"choices": ("blob", "chunk", "chunk_group", "pack")}), "key")
    command("overview", lambda s, a: _lines(s.overview()))
    command("validate", lambda s, a: _lines(s.validate(a.parts, a.contents) if a.parts else s.validate(contents=a.contents)), ("parts", {"nargs": "*"}), ("--contents", flag))
    command("make", lambda s, a: _say("id", s.make_from(a.folder, a.targets, a.ignore, creator=a.creator, comment=a.comment, codec=a.codec)), "folder", ("targets", many), ("--ignore", {"action": "append", "default": []}), ("--creator", {"default": "unknown:"}), ("--comment", {"default": ""}), ("--codec", {"default": "plain"}))
    command("import", lambda s, a: _say("id", s.import_archive(a.archive, a.ensure_meta, a.meta_override, a.codec)), "archive", ("--ensure-meta", flag), "--meta-override", ("--codec", {"default": "plain"}))
    command("import-slot", lambda s, a: _say("id", s.import_slot(a.slot, a.creator)), "slot", ("--creator", {"default": "unknown:"}))
    command("export", lambda s, a: _say("entries", s.export(s.resolve(a.id), a.output, with_meta=not a.no_meta)), "id", "output", ("--no-meta", flag))
    command("extract", lambda s, a: _say("entries", s.export(s.resolve(a.id), a.output, a.path, False)), "id", "path", "output")
    command("back", lambda s, a: _say("entries", s.export(s.resolve(a.id), a.output)), "id", "output")
    command("rename", lambda s, a: _say("renamed", s.rename(s.resolve(a.id), a.comment)), "id", "comment")
    command("tag", lambda s, a: _say("tagged", s.tag(s.resolve(a.id), a.name, None if a.value is None else json.loads(a.value))), "id", "name", ("value", {"nargs": "?"}))
    command("delete", lambda s, a: _lines(s.delete([s.resolve(x) for x in a.ids], a.force)), ("ids", many), ("--force", flag))
    command("delete-range", lambda s, a: _lines(s.delete_range(*parse_id_range(a.range))), "range")
    command("prune", _prune, *((f"--{x}", number) for x in ("last", "hour", "day", "week", "month", "year", "max-amount", "max-lifetime")), ("--zone", {"default": "UTC"}), ("--apply", flag))
    command("prune-database", lambda s, a: _say("removed", s.prune_database()))
    command("vacuum", lambda s, a: _say("bytes", s.vacuum()))
    command("reassign", lambda s, a: _lines(s.reassign(a.by)), ("by", {"nargs": "?", "default": "time"}))
    command("migrate-compress", lambda s, a: _say("blobs", s.migrate_compress(a.codec)), "codec")
    command("migrate-hash", lambda s, a: _say("blobs", s.migrate_hash(a.method)), "method")
    return top


def run(spark: SparkSession, arguments: Sequence[str]) -> list[str]:
    """The lines that a command prints."""
    a = parser().parse_args(arguments)
    return list(a.run(Store(spark, a.store), a))


def main() -> None:
    spark = SparkSession.builder.appName("lamina").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for line in run(spark, sys.argv[1:]):
        print(line)


if __name__ == "__main__":
    main()
