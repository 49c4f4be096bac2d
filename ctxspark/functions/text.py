"""Column functions over text: tokens, counts, hashes, identifiers. All run inside the JVM."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column, max_tokens: int | None = None) -> Column:
    """Lower-cased runs of ASCII letters, digits, _ and $. The cut to max_tokens counts empty pieces at the ends."""
    if max_tokens is None:
        return F.regexp_extract_all(F.lower(text), F.lit(r"[a-zA-Z0-9_$]+"), F.lit(0))
    return F.filter(F.slice(F.split(F.lower(text), r"[^a-zA-Z0-9_$]+"), 1, max_tokens), lambda x: x != "")


def token_count(text: Column) -> Column:
    """Estimate: a quarter of the code points, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def line_count(text: Column) -> Column:
    return (F.regexp_count(text, F.lit("\n")) + 1).cast("int")


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def normalize_source(content: Column) -> Column:
    """Bytes as UTF-8 with invalid ones replaced and newlines unified."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Version-5 UUID of a name, as uuid.uuid5 gives it."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def file_id(path: Column) -> Column:
    return uuid5(path)


def symbol_id(file_id_: Column, qualified_name: Column, line_start: Column) -> Column:
    return uuid5(F.concat_ws("::", file_id_, qualified_name, line_start.cast("string")))


def relationship_id(source_id: Column, target_name: Column, kind: Column) -> Column:
    return uuid5(F.concat(source_id, F.lit("->"), target_name, F.lit("::"), kind))


def chunk_id(file_id_: Column, line_start: Column, chunk_index: Column) -> Column:
    return uuid5(F.concat_ws("::", file_id_, line_start.cast("string"), chunk_index.cast("string")))


def context_header(content: Column, path: Column, symbol: Column) -> Column:
    """Comment lines with file and symbol, a blank line, the content."""
    return F.concat(F.lit("// File: "), path, F.lit("\n"), F.when(symbol.isNotNull() & (symbol != ""), F.concat(F.lit("// Symbol: "), symbol, F.lit("\n"))).otherwise(""), F.lit("\n"), content)


def last_segment(name: Column, separators: str) -> Column:
    """What follows the last of the given characters."""
    return functools.reduce(lambda c, s: F.substring_index(c, s, -1), separators, name)


def snippet(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def like_any_case(name: Column, pattern: Column) -> Column:
    """name contains the pattern, in any case; % and _ of the pattern act as wildcards, nothing escapes them."""
    return F.like(F.lower(name), F.concat(F.lit("%"), F.lower(pattern), F.lit("%")), F.lit("\x01"))


def body_of(source: Column, line_start: Column, line_end: Column) -> Column:
    """Lines line_start..line_end; the whole source for bounds that make no sense."""
    part = F.array_join(F.slice(F.split(source, "\n"), line_start, line_end - line_start + 1), "\n")
    return F.when((line_start <= 0) | (line_end < line_start), source).otherwise(part)
