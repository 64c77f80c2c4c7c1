"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import NAMESPACE_URL


def _joined(parts: tuple[Column, ...]) -> Column:
    return F.concat_ws(":", *(p.cast("string") for p in parts))


def name_uuid(prefix: str, *parts: Column) -> Column:
    """Prefix and hex of the name-based UUID (version 5, URL namespace) of the parts."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(_joined(parts), "UTF-8")))
    at = lambda k, n=1: F.substring(digest, k, n)
    variant = F.lower(F.hex(F.conv(at(17), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.lit(f"{prefix}_"), at(1, 12), F.lit("5"), at(14, 3), variant, at(18, 15))


def short_hash(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 24 hex digits of the SHA-256 of the parts."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(_joined(parts), 256), 1, 24))


def block_id(position: Column) -> Column:
    return F.format_string("block_%06d", position)
