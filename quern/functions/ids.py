"""Identities: digests over canonical spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import col


def json_string(c: Column | str) -> Column:
    """A JSON string literal, other characters than controls as they are."""
    j = F.to_json(F.array(col(c).cast("string")))
    return F.replace(F.substring(j, F.lit(2), F.length(j) - 2), F.lit("\\/"), F.lit("/"))


def stable_hash(*values: Column) -> Column:
    """SHA-256 of the values as a compact JSON array; strings are quoted, numbers are not."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]")), 256)


def short_id(prefix: str, digest: Column, size: int = 20) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(digest, 1, size))


def asset_id(sha256: Column | str, source_id: Column, item_id: Column, url: Column, role: Column) -> Column:
    """Id of stored bytes in a role: by source and item where there is a source, else by URL and role."""
    by_source = F.concat_ws("\x00", source_id, F.coalesce(item_id, F.lit("")))
    by_url = F.concat_ws("\x00", F.coalesce(url, F.lit("")), F.coalesce(role, F.lit("")))
    return F.concat(F.lit("asset-"), F.sha2(F.concat_ws("\x00", col(sha256), F.when(F.coalesce(source_id, F.lit("")) != "", by_source).otherwise(by_url)), 256))


def blob_path(sha256: Column | str) -> Column:
    return F.concat(F.lit("_assets/sha256/"), F.substring(col(sha256), 1, 2), F.lit("/"), col(sha256))


def item_id(path: Column | str) -> Column:
    return short_id("item", F.sha2(col(path), 256), 16)


def target_identity(target: Column | str) -> Column:
    return F.sha2(col(target), 256)


def ascii_escaped(json: Column) -> Column:
    """JSON text with characters beyond ASCII written as escapes; pure ASCII isn't sent to Python."""
    from quern.functions.exact import json_ascii

    wide = json.rlike(r"[^\x00-\x7f]")
    return F.when(wide, json_ascii(F.when(wide, json))).otherwise(json)


def fingerprint(spec: dict[str, Column]) -> Column:
    """SHA-256 of the fields as a compact JSON object with sorted keys, ASCII only."""
    fields = [v.alias(k) for k, v in sorted(spec.items())]
    return F.sha2(ascii_escaped(F.replace(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), F.lit("\\/"), F.lit("/"))), 256)


def opaque_id_ok(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"), F.lit(False))


def platform_ok(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"^[a-z0-9](?:[a-z0-9_-]{0,62}[a-z0-9])?$"), F.lit(False))


def digest_ok(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"^[a-f0-9]{64}$"), F.lit(False))


def relative_path_ok(c: Column | str) -> Column:
    """Whether a path is relative and stays inside."""
    return F.coalesce((col(c) != "") & ~col(c).rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.($|[/\\])|\x00"), F.lit(False))
