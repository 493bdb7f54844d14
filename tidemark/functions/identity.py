"""Deterministic identities: hashes, buckets, UUIDs and the ids of chunks and markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespace of point ids, and the salts of buckets and samples.
POINT_NAMESPACE = "d3f1b1a0-6b1a-4b8e-9c0a-2f9f9b1a0000"
UPDATE_SALT = "mode-a-update"
RENAME_SALT = "mode-d-rename"
ERASURE_SALT = "pii-erasure-2.3"


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def salted_hash(key: Column, salt: str) -> Column:
    return sha256_hex(F.concat(F.lit(f"{salt}:"), key))


def hash_bucket(key: Column, salt: str) -> Column:
    """The salted SHA-256 as a number, modulo 100.

    In four hex digits and four groups of fifteen; 16^15 and all its powers leave 76.
    """
    h = salted_hash(key, salt)
    part = lambda at, n: F.conv(F.substring(h, at, n), 16, 10).cast("bigint") % 100
    return ((part(50, 15) + 76 * (part(1, 4) + part(5, 15) + part(20, 15) + part(35, 15))) % 100).cast("int")


def in_bucket(key: Column, salt: str, percent: int = 50) -> Column:
    return hash_bucket(key, salt) < percent


def uuid5(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """The name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def chunk_id(doc_id: Column, version_id: Column, ordinal: Column) -> Column:
    return F.format_string("%s::v%d::%04d", doc_id, version_id, ordinal)


def deletion_marker(doc_id: Column, commit_sha: Column) -> Column:
    return sha256_hex(F.concat(F.lit("DELETED:"), doc_id, F.lit(":"), commit_sha))


def rename_marker(old: Column, new: Column, commit_sha: Column) -> Column:
    return sha256_hex(F.concat(F.lit("RENAMED:"), old, F.lit("->"), new, F.lit(":"), commit_sha))
