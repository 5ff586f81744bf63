"""Hashes that identify postings, contents and configurations."""

from __future__ import annotations

import hashlib
import json

import pyspark.sql.functions as F
from pyspark.sql import Column

from . import segments
from .text import html_to_text, normalize, truncate_text

TITLE_MOST, DESCRIPTION_MOST = 500, 12_000


def fingerprint(company: Column, title: Column, city: Column) -> Column:
    """SHA-256 of the normalised company, title and city, with nothing between; an unknown city is empty."""
    return F.sha2(F.concat(normalize(company), normalize(title), F.coalesce(normalize(city), F.lit(""))), 256)


def content_hash(title: Column, description: Column) -> Column:
    """SHA-256 of title, NUL and description (null: empty)."""
    return F.sha2(F.concat(title, F.char(F.lit(0)), F.coalesce(description, F.lit(""))), 256)


def bounded_content(title: Column, description: Column) -> Column:
    """Struct of title and description as they go into a prompt, their hash and whether the description was cut."""
    text = html_to_text(description)
    short = truncate_text(text, DESCRIPTION_MOST)
    head = F.substring(title, 1, TITLE_MOST)
    return F.struct(head.alias("title"), short.alias("description"), content_hash(head, short).alias("content_hash"), F.coalesce(segments.units(text) > DESCRIPTION_MOST, F.lit(False)).alias("truncated"))


def requirements_hash(requirements: Column) -> Column:
    """SHA-256 of the requirements as JSON, in their order; absent fields are left out."""
    return F.sha2(F.to_json(requirements), 256)


def config_hash(config: object) -> str:
    """SHA-256 of a configuration's JSON (driver side)."""
    return hashlib.sha256(json.dumps(config, ensure_ascii=False, separators=(",", ":"), default=str).encode()).hexdigest()


def profile_hash(profile: object, academic_period: object) -> str:
    """Hash of a profile in its semester, so that results of an earlier semester don't count."""
    return config_hash({"profile": profile, "academicPeriod": academic_period})


def operation_id(channel: Column, content: Column) -> Column:
    """Id of a delivery: SHA-256 of channel, NUL and content hash."""
    return F.sha2(F.concat(channel, F.char(F.lit(0)), content), 256)


def chunk_id(operation: Column, index: Column) -> Column:
    """Id of a delivery's chunk."""
    return F.sha2(F.concat(operation, F.lit(":"), index.cast("string")), 256)


_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(ts: Column, random_bits: Column) -> Column:
    """A sortable id: the instant in ms (48 bits) and 80 bits of a hex string of 20 digits, in base 32.

    random_bits: ``substring(replace(uuid(), '-', ''), 1, 20)``, say; ids of one instant sort by it.
    """
    bits = F.concat(F.lpad(F.conv(F.unix_millis(ts).cast("string"), 10, 2), 50, "0"), *(F.lpad(F.conv(F.substring(random_bits, i * 5 + 1, 5), 16, 2), 20, "0") for i in range(4)))
    letter = lambda i: F.substring(F.lit(_CROCKFORD), F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(25)), letter), "")
