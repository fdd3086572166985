"""JSON of any shape by way of VARIANT: canonical texts and keys, and spans in each of their forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(c: Column) -> Column:
    """Compact JSON with the keys of every object in order, at any depth; a text that is no JSON stays as it is, null is null."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def canonical_key(c: Column) -> Column:
    """One key for all spellings of a JSON text."""
    return F.sha2(canonical_json(c), 256)


def _one(v: Column) -> Column:
    """struct(start, end) of an object with these names or of a pair; null for anything else."""
    get = lambda *paths: F.coalesce(*(F.try_variant_get(v, p, "double") for p in paths)).cast("long")
    start, end = get("$.start", "$[0]"), get("$.end", "$[1]")
    good = (start >= 0) & (end >= start) & F.try_variant_get(v, "$[2]", "variant").isNull()
    return F.when(good, F.struct(start.alias("start"), end.alias("end")))


def _bound(c: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.transform(F.array(c), f)[0]


def _or_raise(c: Column, span: Column, strict: bool) -> Column:
    if not strict:
        return span
    bad = F.raise_error(F.concat(F.lit("no span: "), F.substring(c, 1, 100))).cast("struct<start:bigint,end:bigint>")
    return F.when(c.isNull(), F.lit(None)).otherwise(F.coalesce(span, bad))


def read_span(c: Column, strict: bool = True) -> Column:
    """struct(start, end) of a JSON text: an object with start and end, or a pair; numbers are cut to whole ones.

    Null is null.  What is neither, or begins before 0 or ends before it begins,
    raises, or is null where not strict.
    """
    return _or_raise(c, _bound(F.try_parse_json(c), _one), strict)


def read_spans(c: Column, strict: bool = True) -> Column:
    """array<struct(start, end)>: one span in either form, or an array of such; null gives none."""

    def read(v: Column) -> Column:
        first = F.try_variant_get(v, "$[0]", "variant")
        nested = first.isNotNull() & F.try_variant_get(v, "$[0]", "double").isNull()
        many = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _or_raise(c, _one(x), strict))
        none = F.array().cast("array<struct<start:bigint,end:bigint>>")
        empty = F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")) == 0, F.lit(False))
        return F.when(c.isNull() | empty, none).when(nested, many).otherwise(F.array(_or_raise(c, _one(v), strict)))

    return _bound(F.try_parse_json(c), read)
