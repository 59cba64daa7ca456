"""Expressions over VARIANT values: dynamic types without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(v: Column) -> Column:
    """The variant, with JSON null turned into SQL null."""
    return F.when(~F.is_variant_null(v), v)


def field(v: Column, name: str) -> Column:
    """A top-level field of an object as variant; null if absent, JSON null, or v is no object."""
    return present(F.try_variant_get(v, f"$[{quoted(name)}]", "variant"))


def nested(v: Column, dotted: str) -> Column:
    """A field below objects by dotted path; null on any miss."""
    return present(F.try_variant_get(v, "$" + "".join(f"[{quoted(p)}]" for p in dotted.split(".")), "variant"))


def quoted(name: str) -> str:
    mark = '"' if "'" in name else "'"
    return f"{mark}{name}{mark}"


def kind(v: Column) -> Column:
    """One of null, boolean, number, string, array, object."""
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (t == "VOID"), "null")
        .when(t == "BOOLEAN", "boolean")
        .when(t == "STRING", "string")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def items(v: Column) -> Column:
    """The elements of an array; null for anything else."""
    return v.try_cast("array<variant>")


def entries(v: Column) -> Column:
    """The fields of an object as map; null for anything else."""
    return F.when(kind(v) == "object", v.try_cast("map<string,variant>"))


def as_text(v: Column) -> Column:
    """Scalars as plain text, arrays and objects as JSON; null stays null."""
    return F.when(kind(v) == "string", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def canonical(v: Column) -> Column:
    """JSON text in which equal values are equal: sorted keys, one spelling of numbers."""
    return F.to_json(present(v))


def truthy(v: Column) -> Column:
    """Truth of a dynamic value: null stays null; 0, "", [], {} and false are false, all else true."""
    k = kind(v)
    return (
        F.when(k == "boolean", F.try_variant_get(v, "$", "boolean"))
        .when(k == "number", F.try_variant_get(v, "$", "double") != 0)
        .when(k == "string", F.length(F.try_variant_get(v, "$", "string")) > 0)
        .when(k == "array", F.size(items(v)) > 0)
        .when(k == "object", F.size(entries(v)) > 0)
    )


def first_truthy(*values: Column) -> Column:
    """The first value that is neither null nor false in the sense of `truthy`."""
    return F.coalesce(*[F.when(truthy(v), v) for v in values])
