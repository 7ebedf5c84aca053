"""Cleaning, validity and extraction of log text, as Column expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns decide results.
TIMESTAMPS = (
    r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    r"\d{2}/\d{2}/\d{4}\s\d{2}:\d{2}:\d{2}",
    r"\w{3}\s+\d{1,2}\s\d{2}:\d{2}:\d{2}",
)
CLASSES = {
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "ipv6": r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}",
    "mac": r"(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}",
    "url": r"https?://[^\s]+",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "path": r"(?:/[a-zA-Z0-9._-]+)+/?",
    "uuid": r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    "hex": r"0x[0-9a-fA-F]+",
    "number": r"\b\d+(?:\.\d+)?\b",
}
NUMBERS = (r"\b\d+\.\d+\b", r"\b\d{4,}\b")
PATHS = (r"/(?:[a-zA-Z0-9._-]+/)+[a-zA-Z0-9._-]+", r"[A-Z]:\\(?:[^\\]+\\)+[^\\]+")
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL", "CRITICAL")
LADDER = {
    "datetime": r"\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}",
    "ipv4": r"\d+\.\d+\.\d+\.\d+",
    "digits": r"\d+",
    "path": r"/[\w/.-]+",
    "email": r"[a-zA-Z0-9._-]+@[a-zA-Z0-9.-]+",
    "uuid": r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}",
}
SHORTEST = 10
WILDCARD, NUMBER, PATH = "<*>", "<NUM>", "<PATH>"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def one_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _all_replaced(c: Column, patterns, by: str) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, by)
    return c


def without_timestamps(c: Column) -> Column:
    return _all_replaced(c, TIMESTAMPS, "")


def without_ips(c: Column) -> Column:
    return _all_replaced(c, (CLASSES["ip"], CLASSES["ipv6"]), "")


def numbers_masked(c: Column) -> Column:
    return _all_replaced(c, NUMBERS, NUMBER)


def paths_masked(c: Column) -> Column:
    return _all_replaced(c, PATHS, PATH)


def mask_class(c: Column, name: str) -> Column:
    """Every token of the class as <CLASS>."""
    patterns = TIMESTAMPS if name == "timestamp" else (CLASSES[name],)
    return _all_replaced(c, patterns, f"<{name.upper()}>")


def count_class(c: Column, name: str) -> Column:
    return F.regexp_count(c, F.lit(CLASSES[name]))


def clean(c: Column, remove_timestamps: bool = False, remove_ips: bool = False, normalize_numbers: bool = True, normalize_paths: bool = True, lowercase: bool = False) -> Column:
    """The cleaned line; a null or blank one is empty.  The steps have a fixed order."""
    out = stripped(F.coalesce(c, F.lit("")))
    for wanted, step in ((remove_timestamps, without_timestamps), (remove_ips, without_ips), (normalize_numbers, numbers_masked), (normalize_paths, paths_masked), (lowercase, F.lower)):
        out = step(out) if wanted else out
    return one_spaced(out)


def is_valid(c: Column) -> Column:
    """Not blank, SHORTEST characters at least, and not punctuation only."""
    text = stripped(F.coalesce(c, F.lit("")))
    return (F.length(text) >= SHORTEST) & ~text.rlike(r"^[\W_]+$")


def timestamp_of(c: Column) -> Column:
    """The first match of the first timestamp pattern that matches, else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, f"({p})", 1), F.lit("")) for p in TIMESTAMPS))


def level_of(c: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(c, rf"(?i)\b({'|'.join(LEVELS)})\b", 1), F.lit("")))


def components_of(c: Column) -> Column:
    """struct(timestamp, level, message): the message is the line without any occurrence of either."""
    ts, level = timestamp_of(c), level_of(c)
    rest = stripped(F.when(ts.isNotNull(), F.replace(c, ts, F.lit(""))).otherwise(c))
    message = F.when(level.isNotNull(), stripped(F.regexp_replace(rest, F.concat(F.lit(r"(?i)\b"), level, F.lit(r"\b")), F.lit("")))).otherwise(rest)
    return F.struct(ts.alias("timestamp"), level.alias("level"), message.alias("message"))


def heuristic_template(c: Column, ladder: str = "default") -> Column:
    """Variable parts as <*>; 'specific_first' lets whole UUIDs and addresses match before bare digits."""
    order = list(LADDER) if ladder == "default" else ["datetime", "uuid", "email", "ipv4", "path", "digits"]
    return _all_replaced(c, (LADDER[k] for k in order), WILDCARD)


def log_key(c: Column) -> Column:
    return F.concat(F.lit("log:"), F.md5(c.cast("binary")))


def pattern_hash(c: Column) -> Column:
    return F.substring(F.md5(F.array_join(F.slice(words(c), 1, 3), "_").cast("binary")), 1, 8)


def words(c: Column) -> Column:
    """Tokens between white space of any kind."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def tokens(c: Column, delimiter: str = " ") -> Column:
    """Tokens between a literal delimiter; empty ones do not count."""
    return F.filter(F.split(stripped(F.coalesce(c, F.lit(""))), f"\\Q{delimiter}\\E"), lambda t: t != "")
