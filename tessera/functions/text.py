"""Text functions as Column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of ASCII letters and digits, or one CJK ideograph.  Fixed value.
TOKEN = r"[a-z0-9]+|[\x{4e00}-\x{9fff}]"
_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
_BLANK = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, _BLANK, "")


def strip_bom(c: Column) -> Column:
    return F.ltrim(c, F.lit("﻿"))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def estimate_tokens(c: Column, chars_per_token: float = 1.5) -> Column:
    return F.greatest(F.lit(1), (F.length(c) / F.lit(float(chars_per_token))).cast("int"))


def fingerprint(content: Column) -> Column:
    """First 16 hex digits of the SHA-256 of bytes."""
    return F.substring(F.sha2(content, 256), 1, 16)


def combine_fingerprint(content_hash: Column, signature: Column) -> Column:
    return F.concat_ws(".", content_hash, signature)


def uuid5(name: Column) -> Column:
    """Version-5 UUID of ``name`` in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def hash_bucket(token: Column, dim: int) -> Column:
    """Dimension of a token: the first 32 bits of its MD5, modulo ``dim``."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dim).cast("int")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def under_root(source: Column, root: Column) -> Column:
    """Whether a path is the root or below it; ``docs2`` is not below ``docs``."""
    trimmed = F.rtrim(root, F.lit("/"))
    return (source == root) | (source == trimmed) | F.startswith(source, F.concat(trimmed, F.lit("/")))
