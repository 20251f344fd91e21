"""Small functions on strings, times, JSON and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that count as images.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif", "tiff", "webp", "svg")


def extension(path: Column) -> Column:
    """The lower-cased suffix without its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def has_extension(path: Column, extensions=IMAGE_EXTENSIONS) -> Column:
    return extension(path).isin([e.lower().lstrip(".") for e in extensions])


def parts(text: Column, separator: str = ";") -> Column:
    """Trimmed parts that are not empty."""
    return F.filter(F.transform(F.split(text, separator), lambda p: F.trim(p)), lambda p: p != "")


def shard_name(shard: Column) -> Column:
    return F.concat(F.lit("shard_"), F.when(shard < 10000, F.lpad(shard.cast("string"), 4, "0")).otherwise(shard.cast("string")))


def shard_number(name: Column) -> Column:
    """The number in a name like shard_0012, else null."""
    return F.when(F.rlike(name, F.lit(r"^shard_\d{4,}$")), F.regexp_extract(name, r"(\d+)$", 1).cast("int"))


def safe_name(text: Column) -> Column:
    """Letters, digits, _, . and -; all else becomes _."""
    return F.regexp_replace(text, r"[^\w.-]", "_")


def utc_text(moment: Column) -> Column:
    """ISO 8601 text of a timestamp in a session whose zone is UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def json_map(text: Column) -> Column:
    """A JSON object as map<string,string>; null if it is none."""
    return F.from_json(text, "map<string,string>")


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def close_to(a: Column, b: Column, relative: float = 1e-6) -> Column:
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))


def interpolate(value: Column, low: Column, high: Column) -> Column:
    """0 at low, 1 at high; 0 for an empty range."""
    return F.when(high > low, clamp((value - low) / (high - low), 0.0, 1.0)).otherwise(0.0)


def heat_colour(value: Column, low: Column, high: Column) -> Column:
    """From green to red as #rrggbb."""
    t = interpolate(value, low, high)
    part = lambda x: F.lpad(F.lower(F.hex(F.round(255 * x).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), part(t), part(1 - t), F.lit("00"))
