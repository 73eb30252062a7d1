"""Typed values from texts, and first values among alternatives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean true and false.
TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def as_bool(text: Column) -> Column:
    """True or false; NULL for an empty text and for what is neither (see ``bad_bool``)."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(*TRUE), F.lit(True)).when(t.isin(*FALSE), F.lit(False))


def bad_bool(text: Column) -> Column:
    return (F.length(F.trim(text)) > 0) & as_bool(text).isNull()


def as_number(text: Column, kind: str = "double") -> Column:
    """A number of the given type; NULL for an empty text and for what is none (see ``bad_number``)."""
    return F.nullif(F.trim(text), F.lit("")).try_cast(kind)


def bad_number(text: Column, kind: str = "double") -> Column:
    return (F.length(F.trim(text)) > 0) & as_number(text, kind).isNull()


def first_alias(metrics: Column, names: list[str]) -> Column:
    """Value of the first alias that a map has as a key, even if that value is NULL."""
    out = None
    for n in names:
        test, value = F.map_contains_key(metrics, n), metrics[n]
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def first_path(document: Column, paths: list[str]) -> Column:
    """First of the JSON paths whose value is not NULL, as text."""
    return F.coalesce(*(F.get_json_object(document, p) for p in paths))


def completion_text(document: Column) -> Column:
    """Text of a completion given as JSON: a string, a message, or a list of messages joined by line feeds."""
    messages = F.from_json(document, "array<struct<content:string>>")
    joined = F.array_join(F.filter(F.transform(messages, lambda m: m["content"]), lambda c: c.isNotNull()), "\n")
    head = F.substring(F.ltrim(document), 1, 1)
    return F.when(head == "[", joined).when(head == "{", F.coalesce(F.get_json_object(document, "$.content"), document)).when(head == '"', F.get_json_object(F.concat(F.lit('{"t":'), document, F.lit("}")), "$.t")).otherwise(document)
