"""Walks over JSON payloads of any shape as column expressions over variants: nothing is shuffled, and no Python worker runs.

A walk is one expression, nested as deep as the payloads are: payload_depth() gives that from the data, in one aggregate. Payloads that
are nested deeper than DEEPEST are not walked and have no fingerprint. Keys of an object come in order of their names, elements of a list in theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import let
from tallyloom.operators.tasks import json_depth

#: Objects and lists in one another in a payload, at most: the plan's expressions are nested as deep.
DEEPEST = 20
NODE = "array<struct<path:string,key:string,value:variant>>"


def payload_depth(rows: DataFrame, payload: str) -> int:
    """How deep walks over a column of payloads have to go, of those that are not too deep for it."""
    depth = json_depth(F.col(payload))
    most = rows.select(depth.alias("d")).where(F.col("d") <= DEEPEST).agg(F.max("d").alias("d")).first().d
    return int(most or 0)


def as_object(v: Column) -> Column:
    """An object's values by key; null for other variants."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_text(v: Column) -> Column:
    """A string's text, without quotes; null for other variants."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def children(v: Column, most: int | None = None) -> Column:
    """struct(key, value) of an object's fields, or of a list's (first `most`) elements, whose key is null; null for scalars."""
    fields = F.transform(F.map_entries(as_object(v)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    elements = as_list(v) if most is None else F.slice(as_list(v), 1, most)
    return F.coalesce(fields, F.transform(elements, lambda e: F.struct(F.lit(None).cast("string").alias("key"), e.alias("value"))))


def walk(v: Column, depth: int) -> Column:
    """struct(path, key, value) of a variant and of everything in it, parents first; paths read `a.b[0].c`. Null where v is."""

    def nodes(path: Column, key: Column, value: Column, left: int) -> Column:
        own = F.array(F.struct(path.alias("path"), key.alias("key"), value.alias("value")))
        if not left:
            return own

        def below(c: Column, i: Column) -> Column:
            named = F.when(path == "", c["key"]).otherwise(F.concat(path, F.lit("."), c["key"]))
            at = F.coalesce(named, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
            return let(at, lambda p: nodes(p, c["key"], c["value"], left - 1))  # bound, as a path is read more than once

        return F.concat(own, F.coalesce(F.flatten(F.transform(children(value), below)), F.array().cast(NODE)))

    return let(v, lambda x: F.when(x.isNotNull(), nodes(F.lit(""), F.lit(None).cast("string"), x, depth)))


def named(nodes: Column, key: str) -> Column:
    """The values of the nodes with a key, in the walk's order."""
    return F.transform(F.filter(nodes, lambda n: F.coalesce(n["key"] == key, F.lit(False))), lambda n: n["value"])


def objects(values: Column) -> Column:
    return F.filter(values, lambda v: as_object(v).isNotNull())


def is_filled(v: Column) -> Column:
    """Whether a variant is there and is neither null, an empty text nor an empty list."""
    return F.coalesce(v.isNotNull() & ~F.is_variant_null(v) & ~F.coalesce(as_text(v) == "", F.lit(False)) & ~F.coalesce(F.size(as_list(v)) == 0, F.lit(False)), F.lit(False))


def filled(values: Column, key: str) -> Column:
    """The values that objects have under a key and that are not empty."""
    return F.filter(F.transform(values, lambda v: F.try_variant_get(v, f"$.{key}", "variant")), is_filled)


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    shown = F.to_json(F.array(text))
    return F.substring(shown, F.lit(2), F.length(shown) - 2)


def shape(v: Column, depth: int, most: int) -> Column:
    """Canonical JSON of a variant's shape: objects by key, lists by the distinct shapes of their first `most` elements, null or scalar."""
    leaf = F.when(F.is_variant_null(v), '{"type":"null"}').otherwise('{"type":"scalar"}')
    if not depth:
        return leaf

    def one(parts: Column) -> Column:
        fields = F.array_join(F.transform(parts, lambda p: F.concat(quoted(p["key"]), F.lit(":"), p["shape"])), ",")
        items = F.array_join(F.array_distinct(F.transform(parts, lambda p: p["shape"])), ",")
        return F.when(parts.isNull(), leaf).when(as_list(v).isNotNull(), F.concat(F.lit('{"items":['), items, F.lit('],"type":"list"}'))).otherwise(F.concat(F.lit("{"), fields, F.lit("}")))

    return let(F.transform(children(v, most), lambda c: F.struct(c["key"].alias("key"), shape(c["value"], depth - 1, most).alias("shape"))), one)
