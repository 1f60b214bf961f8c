"""Metadata of snapshots and archives: times in their many spellings, JSON both ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name of the metadata member of an archive.
META_NAME = ".prime_backup.meta.json"
#: The spellings of a time that are read, as groups year, month, day, hour, minute, second.
TIMES = (
    r"(\d{4})()()()()()", r"(\d{4})(\d{2})()()()()", r"(\d{4})(\d{2})(\d{2})()()()", r"(\d{4})-(\d{1,2})-(\d{1,2})()()()", r"(\d{4})/(\d{1,2})/(\d{1,2})()()()",
    r"(\d{4})(\d{2})(\d{2})(\d{2})()()", r"(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})()", r"(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})", r"(\d{4})(\d{2})(\d{2}) (\d{2})(\d{2})(\d{2})",
    r"(\d{4})(\d{2})(\d{2}) (\d{1,2}):(\d{1,2}):(\d{1,2})", r"(\d{4})-(\d{1,2})-(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})", r"(\d{4})-(\d{1,2})-(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2}\.\d{1,6})",
)


def parse_time(text: Column) -> Column:
    """Nanoseconds since the epoch of a time in the session's zone; null if no spelling fits or there is no such time."""
    out = F.lit(None).cast("timestamp")
    for pattern in reversed(TIMES):
        whole = f"^{pattern}$"
        part = lambda at, least, w=whole: F.coalesce(F.nullif(F.regexp_extract(text, w, at), F.lit("")), F.lit(least))
        made = F.try_make_timestamp(*(part(at, least).cast("int") for at, least in ((1, "0"), (2, "1"), (3, "1"), (4, "0"), (5, "0"))), part(6, "0").cast("decimal(16,6)"))
        out = F.when(text.rlike(whole), made).otherwise(out)
    return F.unix_micros(out) * 1000


def decode(text: Column) -> Column:
    """struct(creator, comment, timestamp, timestamp_ns_part, targets, tags) of metadata JSON.

    Older files hold the time as a float and the creator as an object of type and name; targets lose a slash at
    their end; tags stay JSON.  What is missing is unknown, empty, or null (the time).
    """
    raw = F.from_json(text, "creator string, comment string, timestamp_ns string, targets array<string>, tags string")
    person = F.from_json(raw["creator"], "type string, name string")
    creator = F.when(raw["creator"].startswith("{"), F.concat(person["type"], F.lit(":"), person["name"])).otherwise(raw["creator"])
    at = raw["timestamp_ns"].cast("decimal(38,0)").cast("long")
    return F.struct(
        F.coalesce(creator, F.lit("unknown:")).alias("creator"), F.coalesce(raw["comment"], F.lit("")).alias("comment"), F.floor(at / F.lit(10**9).cast("decimal(20,0)")).cast("long").alias("timestamp"),
        F.pmod(at, F.lit(10**9)).alias("timestamp_ns_part"), F.transform(F.coalesce(raw["targets"], F.array().cast("array<string>")), lambda x: F.rtrim(x, F.lit("/"))).alias("targets"), F.coalesce(raw["tags"], F.lit("{}")).alias("tags"),
    )


def encode(creator: Column, comment: Column, seconds: Column, nanos: Column, targets: Column, tags: Column) -> Column:
    """Metadata JSON of a snapshot; `tags` is a map of text."""
    return F.to_json(F.struct(F.lit(1).alias("_version"), creator.alias("creator"), comment.alias("comment"), (seconds * 10**9 + nanos).alias("timestamp_ns"), targets.alias("targets"), tags.alias("tags")))
