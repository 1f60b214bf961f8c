"""Durations and quantities with units: on the driver and as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a unit, multiples of a quantity.
SECONDS = {
    "ms": 1e-3, "s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400,
    "mon": 2592000, "month": 2592000, "y": 31536000, "year": 31536000,
}
MULTIPLES = {"": 1} | {f"{p}{i}": (1024 if i else 1000) ** (n + 1) for n, p in enumerate("KMGTPE") for i in ("", "i")}
_value = re.compile(r"\s*([+-]?\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*")


def _parse(text: str, units: dict[str, float]) -> float | int:
    found = _value.fullmatch(text)
    folded = {k.lower(): v for k, v in units.items()}
    if not found or found[2].lower() not in folded:
        raise ValueError(f"not a value with a unit: {text!r}")
    number = float(found[1]) * folded[found[2].lower()]
    return int(number) if number.is_integer() else number


def parse_duration(text: str) -> float | int:
    """Seconds."""
    return _parse(text, {"": 1, **SECONDS})


def parse_quantity(text: str) -> float | int:
    """A count; the unit of bytes may follow."""
    return _parse(re.sub(r"(?i)b\s*$", "", text), MULTIPLES)


def auto_quantity(value: float) -> tuple[float, str]:
    """The largest binary unit that leaves at least 1."""
    for n, p in reversed([*enumerate("KMGTPE")]):
        if abs(value) >= 1024 ** (n + 1):
            return value / 1024 ** (n + 1), f"{p}i"
    return value, ""


def auto_duration(seconds: float) -> tuple[float, str]:
    for unit in ("d", "h", "m"):
        if abs(seconds) >= SECONDS[unit]:
            return seconds / SECONDS[unit], unit
    return seconds, "s"


def precise(value: int, units: dict[str, float]) -> tuple[int, str]:
    """The largest of the units that divides the value."""
    for unit, size in sorted(units.items(), key=lambda u: -u[1]):
        if value and size >= 1 and value % size == 0:
            return int(value // size), unit
    return value, ""


def _units(unit: Column, units: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, size in units.items():
        out = F.when(F.lower(unit) == name.lower(), F.lit(float(size))).otherwise(out)
    return out


def duration_seconds(text: Column) -> Column:
    """Seconds of a duration column; null where it is none."""
    number = F.regexp_extract(text, r"^\s*([+-]?\d+(?:\.\d+)?)", 1)
    return F.try_to_number(number, F.lit("S9999999990.999999")).cast("double") * _units(F.regexp_extract(text, r"([A-Za-z]*)\s*$", 1), {"": 1, **SECONDS})


def quantity(text: Column) -> Column:
    """Value of a quantity column; null where it is none."""
    number = F.regexp_extract(text, r"^\s*([+-]?\d+(?:\.\d+)?)", 1)
    unit = F.regexp_replace(F.regexp_extract(text, r"([A-Za-z]*)\s*$", 1), "(?i)b$", "")
    return F.try_to_number(number, F.lit("S9999999990.999999")).cast("double") * _units(unit, MULTIPLES)


def creator(text: Column) -> Column:
    """struct(type, name) of "type:name"; a text without a colon is a literal name."""
    parts = F.split(text, ":", 2)
    plain = F.size(parts) < 2
    return F.struct(F.when(plain, "literal").otherwise(F.get(parts, F.lit(0))).alias("type"), F.when(plain, text).otherwise(F.get(parts, F.lit(1))).alias("name"))


_id_range = re.compile(r"\[?\s*(\d+)?\s*([-,])\s*(\d+)?\s*\]?")


def parse_id_range(text: str) -> tuple[int | None, int | None]:
    """Inclusive bounds of "*", "7", "3-", "-9", "3-9" or "[3,9]"."""
    text = text.strip()
    if text == "*":
        return None, None
    if text.isdigit():
        return int(text), int(text)
    found = _id_range.fullmatch(text)
    if not found or (found[1] is None and found[3] is None):
        raise ValueError(f"not a range: {text!r}")
    return int(found[1]) if found[1] else None, int(found[3]) if found[3] else None


def parse_backup_id(text: str) -> int | tuple[str, int]:
    """A number, or ("latest", n) for latest, ~ and ~n."""
    text = text.strip()
    if text in ("latest", "~"):
        return "latest", 0
    if re.fullmatch(r"~\d+", text):
        return "latest", int(text[1:])
    if text.isdigit():
        return int(text)
    raise ValueError(f"not a snapshot id: {text!r}")
