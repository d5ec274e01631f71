"""Deterministic identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5): SHA-1 of namespace and name with the version bits set."""
    digest = F.sha1(
        F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))
    )
    # The top two bits of the ninth byte become 10, keeping the lower two.
    variant = F.translate(
        F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4
    )
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def entity_uuid(document_id: Column, temp_id: Column, prefix: str = "entity") -> Column:
    """The id an entity keeps when its document is processed again."""
    return uuid5(
        URL_NAMESPACE,
        F.concat_ws(":", F.lit(prefix), document_id.cast("string"), temp_id),
    )


def _framed(parts: tuple[Column, ...]) -> Column:
    """The parts in one string that tells them apart: each with its length, a null as ``-``."""
    text = [p.cast("string") for p in parts]
    return F.concat_ws("|", *[F.coalesce(F.concat(F.length(p), F.lit(":"), p), F.lit("-")) for p in text])


def stable_key(*parts: Column) -> Column:
    """32 hex digits from the parts; replaces random ids so that retries agree."""
    return F.md5(_framed(parts))


def digest(*parts: Column) -> Column:
    """SHA-256 over the parts, as kept for audit input and output hashes."""
    return F.sha2(_framed(parts), 256)
