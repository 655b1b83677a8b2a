"""Column functions: identities, hash partitions, state lattice, URL and path parts, redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """prefix and the first 24 hex digits of the SHA-256 of the parts; null parts count as empty."""
    joined = F.concat_ws(SEPARATOR, *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 24))


def json_id(prefix: str, *columns: str) -> Column:
    """stable_id over the canonical JSON of named columns (keys sorted, nulls left out)."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical_json(*columns), 256), 1, 24))


def canonical_json(*columns: str) -> Column:
    """JSON text with sorted keys, no blanks and no nulls."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]))


def hex_mod3(hex_text: Column) -> Column:
    """A hexadecimal number modulo 3: the sum of its digits modulo 3, as 16 is 1 modulo 3."""
    digits = F.transform(F.split(hex_text, ""), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 3


def hash_partition(group: Column, seed: int, names: Sequence[str] = ("TRAIN", "VALIDATION", "TEST")) -> Column:
    """One of three partitions by the hash of seed and group."""
    digest = F.substring(F.sha2(F.concat_ws(SEPARATOR, F.lit("split"), F.lit(str(seed)), group.cast("string")), 256), 1, 24)
    return F.element_at(F.array(*[F.lit(n) for n in names]), (hex_mod3(digest) + 1).cast("int"))


def rank_of(state: Column) -> Column:
    """EXACT 0, PARTIAL 1, UNRESOLVED 2: the worst state is the greatest."""
    return F.when(state == "EXACT", 0).when(state == "PARTIAL", 1).when(state == "UNRESOLVED", 2)


def state_of(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("EXACT"), F.lit("PARTIAL"), F.lit("UNRESOLVED")), (rank + 1).cast("int"))


def worst(*states: Column) -> Column:
    """The worst of some states; nulls are left out."""
    return state_of(F.greatest(*[rank_of(s) for s in states])) if len(states) > 1 else states[0]


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def url_path(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PATH"))


def segments(path: Column) -> Column:
    """Non-empty parts of a path."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_variable(segment: Column) -> Column:
    return segment.rlike(r"^\{[^{}]*\}$")


def redacted(text: Column, lines: int = 50, width: int = 200) -> Column:
    """The last lines of a log, each cut to width; a line that assigns something secret-like is replaced."""
    secret = r"(?i)(secret|token|password|passwd|api[_-]?key|credential|authorization)"
    cleaned = F.transform(F.split(text, "\n"), lambda line: F.when(line.contains("=") & line.rlike(secret), F.lit("[REDACTED]")).otherwise(F.substring(line, 1, width)))
    return F.array_join(F.slice(cleaned, F.greatest(F.lit(1), F.size(cleaned) - (lines - 1)), F.lit(lines)), "\n")


def last_count(log: Column, word: str) -> Column:
    """The number before the last 'N word' of a log, 0 if there is none."""
    found = F.regexp_extract_all(log, F.lit(rf"(\d+)\s+{word}"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1).cast("int")).otherwise(F.lit(0))


def unsafe_path(path: Column) -> Column:
    """Why a path must not be read, or null."""
    return (
        F.when(path.isNull() | (path == ""), "EMPTY_PATH")
        .when(path.contains("\x00"), "NUL_BYTE")
        .when(path.startswith("/") | path.rlike(r"^[A-Za-z]:|^\\"), "ABSOLUTE_PATH")
        .when(F.array_contains(F.split(path, r"[/\\]"), ".."), "PARENT_TRAVERSAL")
        .when(path.rlike(r"(?i)(^|/)(\.env[^/]*|[^/]*(secret|credential|password|id_rsa)[^/]*)$"), "SECRET_NAME")
        .when(path.rlike(r"(?i)\.(pem|key|p12|pfx|crt)$"), "KEY_FILE")
        .when(~path.endswith(".py"), "NOT_PYTHON")
    )
