"""Text and identity columns with the semantics of the data model: code points, Unicode strip, version-5 ids."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it.
SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(text) == "", F.lit(True))


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def slice_by_offsets(text: Column, start: Column, end: Column) -> Column:
    """text[start:end) in code points."""
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def uuid5(namespace: str, name: Column) -> Column:
    """Version-5 UUID of a name under a namespace UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def canonical_json(value: Column) -> Column:
    """Compact JSON of a struct whose fields are in alphabetical order; nulls are kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def fingerprint(value: Column) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(value), 256)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names that aren't taken, in any case."""
    held, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
