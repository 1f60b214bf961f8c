"""Column predicates and projections over catalog tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.schema import DIRECTORY, REGULAR, SYMLINK, TYPE_MASK


class NotFound(LookupError):
    """No object has the key."""


class NotUnique(LookupError):
    """Several objects have the prefix; `candidates` are the first of them."""

    def __init__(self, candidates: list[str]) -> None:
        super().__init__(", ".join(candidates))
        self.candidates = candidates


def prefix_bounds(prefix: str) -> tuple[str, str | None]:
    """Half-open hex range of a prefix; no upper bound if it is all f.  A prefix that is not hex raises."""
    if not re.fullmatch("[0-9a-f]*", prefix):
        raise ValueError(f"not a hash prefix: {prefix!r}")
    odd = "0" * (len(prefix) % 2)
    if set(prefix) <= {"f"}:
        return prefix + odd, None
    return prefix + odd, f"{int(prefix, 16) + 1:0{len(prefix)}x}" + odd


def hash_prefix(column: Column, prefix: str) -> Column:
    low, high = prefix_bounds(prefix)
    return (column >= low) if high is None else (column >= low) & (column < high)


def resolve_prefix(table: DataFrame, column: str, prefix: str) -> str:
    """The one value with the prefix; looks at three at most."""
    found = sorted(row[0] for row in table.where(hash_prefix(F.col(column), prefix)).select(column).distinct().limit(3).collect())
    if not found:
        raise NotFound(prefix)
    if len(found) > 1:
        raise NotUnique(found)
    return found[0]


def tag(tags: Column, name: str) -> Column:
    """A tag's value as text; null if it is missing or JSON null.  Names may hold any sign but a quote."""
    return F.get_json_object(tags, f"$['{name}']")


def typed_tag(tags: Column, name: str, kind: str) -> Column:
    """A tag's value as boolean, string, double or bigint; null if it is missing or of another JSON type."""
    value = F.try_variant_get(F.try_parse_json(tags), f'$["{name}"]', "variant")
    is_kind = {"boolean": ("BOOLEAN",), "string": ("STRING",), "double": ("DOUBLE", "DECIMAL", "BIGINT"), "bigint": ("BIGINT",)}[kind]
    fits = F.exists(F.array(*map(F.lit, is_kind)), lambda k: F.schema_of_variant(value).startswith(k))
    return F.when(fits, F.try_variant_get(value, "$", kind))


def tag_equals(tags: Column, name: str, value: str) -> Column:
    return F.coalesce(tag(tags, name) == value, F.lit(False))


def tag_not_equals(tags: Column, name: str, value: str) -> Column:
    """Differs from the value or is missing."""
    return F.coalesce(tag(tags, name) != value, F.lit(True))


def tag_exists_not_equals(tags: Column, name: str, value: str) -> Column:
    return F.coalesce(tag(tags, name) != value, F.lit(False))


def tag_exists(tags: Column, name: str) -> Column:
    return tag(tags, name).isNotNull()


def visible(tags: Column) -> Column:
    """What a list shows by default: neither temporary nor hidden."""
    return tag_not_equals(tags, "temporary", "true") & tag_not_equals(tags, "hidden", "true")


def instant(seconds: Column, nanos: Column) -> Column:
    """Nanoseconds since the epoch as one number."""
    return seconds * 1_000_000_000 + nanos


def backup_filter(
    backup: DataFrame, *, ids: tuple[int | None, int | None] = (None, None), creator: str | None = None, since: int | None = None, until: int | None = None
) -> DataFrame:
    """Snapshots by inclusive id range, creator and inclusive instants in nanoseconds."""
    at = instant(F.col("timestamp"), F.col("timestamp_ns_part"))
    for condition in (
        F.col("id") >= ids[0] if ids[0] is not None else None, F.col("id") <= ids[1] if ids[1] is not None else None, F.col("creator") == creator if creator is not None else None,
        at >= since if since is not None else None, at <= until if until is not None else None,
    ):
        if condition is not None:
            backup = backup.where(condition)
    return backup


ORDERS = {"id": ("id",), "id_r": ("-id",), "time": ("timestamp", "timestamp_ns_part", "id"), "time_r": ("-timestamp", "-timestamp_ns_part", "-id")}


def order(name: str) -> list[Column]:
    """One of the total orders of snapshots."""
    return [F.col(c[1:]).desc() if c[0] == "-" else F.col(c).asc() for c in ORDERS[name]]


def page(backup: DataFrame, number: int, size: int, by: str = "time_r") -> DataFrame:
    """Page `number` (from 1) of snapshots in a total order."""
    return backup.orderBy(*order(by)).offset((number - 1) * size).limit(size)


def kind(mode: Column) -> Column:
    bits = mode.bitwiseAND(TYPE_MASK)
    return F.when(bits == REGULAR, "file").when(bits == DIRECTORY, "directory").when(bits == SYMLINK, "symlink").otherwise("other")


def child_of(path: Column, directory: str) -> Column:
    """Directly inside a directory ("" is the root)."""
    if not directory:
        return ~path.contains("/")
    return path.startswith(directory + "/") & ~F.substr(path, F.lit(len(directory) + 2)).contains("/")


def within(path: Column, directory: str) -> Column:
    """The directory itself or anything below it."""
    return (path == directory) | path.startswith(directory + "/")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def path_key(path: Column) -> Column:
    """Sort key: each segment without regard to case first, then as it is."""
    return F.transform(F.split(path, "/"), lambda p: F.struct(F.lower(p).alias("folded"), p.alias("exact")))


def glob_regex(pattern: str) -> str:
    """A gitignore pattern as a regular expression over whole relative paths.

    One that ends in a slash matches a folder: what is below it, and the folder itself where folders are given
    with a slash at their end (see `rule_match`).
    """
    body = pattern.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, at = "", 0
    while at < len(body):
        if body.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif body.startswith("/**", at) and at + 3 == len(body):
            out, at = out + "/.*", at + 3
        elif body[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif body[at] == "?":
            out, at = out + "[^/]", at + 1
        elif body[at] == "[" and "]" in body[at + 2 :]:
            end = body.index("]", at + 2)
            inner = body[at + 1 : end]
            out, at = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
        else:
            out, at = out + re.escape(body[at]), at + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if pattern.endswith("/") else "(?:/.*)?$")


def rule_match(path: Column, patterns: list[str], folder: Column | None = None) -> Column:
    """Whether a path is matched: the last pattern that fits decides, "!" takes back; `folder` says which paths are folders."""
    if folder is not None:
        path = F.when(folder, F.concat(path, F.lit("/"))).otherwise(path)
    found = F.lit(False)
    for pattern in patterns:
        takes_back = pattern.startswith("!")
        found = F.when(path.rlike(glob_regex(pattern[1:] if takes_back else pattern)), F.lit(not takes_back)).otherwise(found)
    return found


def simple_match(name: Column, patterns: list[str]) -> Column:
    """The plain wildcards: *x, x* and exact."""
    found = F.lit(False)
    for p in patterns:
        found = found | (name.endswith(p[1:]) if p.startswith("*") else name.startswith(p[:-1]) if p.endswith("*") else name == p)
    return found


def first_rule(size: Column, path: Column, rules: list[tuple[str, int, list[str]]], otherwise: str | None = None) -> Column:
    """Name of the first rule (name, least size, patterns) that fits."""
    out = F.lit(otherwise)
    for name, least, patterns in reversed(rules):
        out = F.when((size >= least) & rule_match(path, patterns), F.lit(name)).otherwise(out)
    return out
