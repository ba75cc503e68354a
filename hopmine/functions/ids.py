"""Stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # fixed value: RFC 4122's namespace of URLs


def uuid5(key: Column) -> Column:
    """The RFC 4122 name-based id (version 5, URL namespace) of a string."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(key, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def draw(*parts: Column | str | int) -> Column:
    """A pseudo-random number in [0, 2 ** 52) from the parts: the first 13 hex digits of their MD5, so other engines find the same."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in columns])), 1, 13), 16, 10).cast("long")


def draw_sql(*parts: str) -> str:
    """The same in SQL, from expressions of strings or numbers."""
    return f"('0x' || substr(md5({' || chr(124) || '.join(f'({p})::varchar' for p in parts)}), 1, 13))::bigint"
