"""Format detection, structural fingerprints and grammar signatures of payloads."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import UNITS, let, once, plain
from tallyloom.operators import nodes as N
from tallyloom.operators.reading import unescape
from tallyloom.operators.tasks import json_depth

# Format codes by precedence.
FORMATS = ("CN-ITEM-INFO", "CN-PRINT-XML", "CN-CUSTOM-CONTENT", "CN-PACKAGE-ITEMS", "CLOUD-PRODUCT-INFO")
UNKNOWN = "UNKNOWN"
#: Elements of a list whose shapes count.
LIST_HEAD = 10


def detect_format(*present: Column) -> Column:
    """The first format whose marker is present, in the order of FORMATS."""
    out = F.lit(None).cast("string")
    for code, there in reversed(list(zip(FORMATS, present, strict=True))):
        out = F.when(there, code).otherwise(out)
    return F.coalesce(out, F.lit(UNKNOWN))


# The fields of each format, which are looked for in its business objects.
FIELDS = {
    "CN-ITEM-INFO": ("ITEM_INFO", "SELLER_MEMO", "BUYER_MEMO", "ITEM_TOTAL_COUNT"),
    "CN-PRINT-XML": ("printXML",),
    "CN-CUSTOM-CONTENT": ("customContent",),
    "CN-PACKAGE-ITEMS": ("itemName", "simpleName", "skuFullName", "specName", "specSimpleName", "skuSize", "itemNum"),
    "CLOUD-PRODUCT-INFO": ("productInfo", "productShortInfo", "sPInfo", "sPSInfo", "remark", "buyerRemark", "productCount"),
}
STRATEGIES = ("legacy_structure_v1", "business_shape_v2")


def print_blocks(xml: Column) -> Column:
    """The texts of print XML with their line ends: those of <text> elements, else all CDATA parts. White space within lines is one space,
    and blank texts don't count. Elements are read by pattern, so XML that is not well-formed gives what can be read of it."""
    data, mark = r"(?s)<!\[CDATA\[(.*?)\]\]>", r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<[^>]*>|[^<]+"

    def inner(x: Column) -> Column:
        parts = F.regexp_extract_all(x, F.lit(mark), F.lit(0))
        return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("<![CDATA["), F.regexp_extract(p, data, 1)).when(p.startswith("<"), "").otherwise(unescape(p))), "")

    def lines(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"(?U)[^\S\r\n]+", " ")

    some = lambda ts: F.filter(F.transform(ts, lines), lambda t: t.rlike(r"(?U)\S"))
    elements = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:[\w.-]+:)?text(?:\s[^>]*)?(?<!/)>(.*?)</(?:[\w.-]+:)?text\s*>"), 1)
    return let(some(F.transform(elements, inner)), lambda t: F.when(F.size(t) > 0, t).otherwise(some(F.regexp_extract_all(xml, F.lit(data), 1))))


def markers(payload: Column, depth: int) -> Column:
    """struct(data, items, printed, code) of a payload (JSON text): the objects named `data` at any depth, the objects of their package
    details, the texts of print XML at any depth, and the format. Null for text that is no JSON object."""

    def found(n: Column) -> Column:
        own = N.objects(N.named(n, "data"))
        printed = F.flatten(F.transform(F.filter(F.transform(N.named(n, "printXML"), N.as_text), lambda x: x.isNotNull()), print_blocks))
        items = F.flatten(F.transform(own, lambda d: F.coalesce(N.as_list(F.try_variant_get(d, "$.packageItemDetail", "variant")), F.array().cast("array<variant>"))))
        return F.struct(own.alias("data"), N.objects(items).alias("items"), printed.alias("printed"))

    def coded(m: Column) -> Column:
        has = lambda key: F.size(N.filled(m["data"], key)) > 0
        code = detect_format(has("ITEM_INFO"), F.size(m["printed"]) > 0, has("customContent"), F.size(m["items"]) > 0, has("productInfo"))
        return F.struct(m["data"].alias("data"), m["items"].alias("items"), m["printed"].alias("printed"), code.alias("code"))

    v = F.try_parse_json(payload)
    return F.when(N.as_object(v).isNotNull(), let(N.walk(v, depth), lambda n: let(found(n), coded)))


def structural_fingerprint(payload: Column, component: Column, depth: int) -> Column:
    """sha256:… of a payload's whole shape and its component; text that is no JSON object is null."""
    v = F.try_parse_json(payload)
    text = F.concat(F.lit('{"payload":'), N.shape(v, depth, LIST_HEAD), F.lit(',"source_component":'), N.quoted(F.lower(plain(component))), F.lit("}"))
    return F.when(N.as_object(v).isNotNull(), F.concat(F.lit("sha256:"), F.sha2(text, 256)))


KINDS = (("OBJECT", "dict"), ("ARRAY", "list"), ("BOOLEAN", "bool"), ("STRING", "str"), ("VOID", "null"), ("BIGINT", "int"))


def layouts(items: Column, fields: list[str]) -> Column:
    """The distinct layouts of objects, sorted: for each of the fields that an object has, its name and the kind of its value."""

    def kind(v: Column) -> Column:
        typed = F.schema_of_variant(v)
        return F.coalesce(*[F.when(typed.startswith(k), n) for k, n in KINDS], F.when(typed.rlike(r"^DECIMAL\(\d+,0\)$"), "int"), F.lit("float"))

    def one(item: Column) -> Column:
        held = N.as_object(item)
        return F.array_compact(F.array(*[F.when(F.map_contains_key(held, n), F.array(F.lit(n), kind(F.element_at(held, n)))) for n in sorted(fields)]))

    return F.array_sort(F.array_distinct(F.transform(items, one)))


def business_fingerprint(code: Column, component: Column, items: Column, fields: list[str]) -> Column:
    """v2:CODE:sha256:… over the set of layouts of a payload's business objects (variants); print XML counts by its format alone."""
    layout = F.when(code == "CN-PRINT-XML", '["printXML"]').otherwise(F.to_json(layouts(items, fields)))
    return _business(code, component, F.concat(F.lit('{"fields":'), layout, F.lit("}")))


def _business(code: Column, component: Column, found: Column) -> Column:
    text = F.concat(F.lit('{"fingerprint_code":"'), code, F.lit('","shape":'), found, F.lit(',"source_component":'), N.quoted(F.lower(plain(component))), F.lit("}"))
    return F.concat(F.lit("v2:"), code, F.lit(":sha256:"), F.sha2(text, 256))


def fingerprints(rows: DataFrame, payload: str, component: str, strategy: str = "legacy_structure_v1", depth: int | None = None) -> DataFrame:
    """rows with format_code, fingerprint by the strategy and print_texts, all null for payloads that are no JSON objects, or deeper than N.DEEPEST.

    The business shape is over the fields of the detected format in its objects; a format that isn't known counts by its whole shape."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unsupported fingerprint strategy: {strategy}")
    depth = N.payload_depth(rows, payload) if depth is None else depth
    near = F.when(json_depth(F.col(payload)) <= depth, F.col(payload))
    held = once(once(rows, "__near", near), "__marks", markers(F.col("__near"), depth))
    code = F.col("__marks.code")
    if strategy == "legacy_structure_v1":
        out = structural_fingerprint(F.col("__near"), F.col(component), depth)
    else:
        whole = N.shape(F.try_parse_json(F.col("__near")), depth, LIST_HEAD)
        by_code = [F.when(code == c, business_fingerprint(F.lit(c), F.col(component), F.col("__marks.items" if c == "CN-PACKAGE-ITEMS" else "__marks.data"), list(FIELDS[c]))) for c in FORMATS]
        out = F.coalesce(*by_code, F.when(code == UNKNOWN, _business(F.lit(UNKNOWN), F.col(component), whole)))
    return held.withColumns({"format_code": code, "fingerprint": out, "print_texts": F.col("__marks.printed")}).drop("__marks", "__near")


def inspected(rows: DataFrame, payload: str, depth: int | None = None) -> DataFrame:
    """A row for each field of each payload's format: format_code, field, and values, JSON texts of those that aren't empty.

    The values of print XML are its distinct texts. Payloads without a known format give no row."""
    depth = N.payload_depth(rows, payload) if depth is None else depth
    held = once(rows, "__marks", markers(F.col(payload), depth)).where(F.col("__marks.code") != UNKNOWN)
    shown = []
    for c in FORMATS:
        source = F.col("__marks.items" if c == "CN-PACKAGE-ITEMS" else "__marks.data")
        printed = F.transform(F.array_distinct("__marks.printed"), N.quoted)
        each = [F.struct(F.lit(f).alias("field"), (printed if c == "CN-PRINT-XML" else F.transform(N.filled(source, f), lambda v: F.to_json(v))).alias("values")) for f in FIELDS[c]]
        shown.append(F.when(F.col("__marks.code") == c, F.array(*each)))
    fields = F.explode(F.coalesce(*shown)).alias("f")
    return held.select(*rows.columns, F.col("__marks.code").alias("format_code"), fields).select(*rows.columns, "format_code", "f.field", "f.values")


def nfkc(text: Column) -> Column:
    return F.pandas_udf(_nfkc, "string")(text)


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def grammar(text: Column, exact: bool = True) -> Column:
    """Punctuation, white space and units after digits. exact normalises by NFKC, in Python; else full-width ASCII only, in the JVM."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
    t = nfkc(text) if exact else F.translate(text, wide, narrow)
    units = F.regexp_replace(t, rf"(?<=\d)(\s*)({UNITS})", "$1$2")
    kept = F.regexp_replace(units, rf"[^\p{{P}}\s](?<!(?:{UNITS}))", "")
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, "", ""), "\r\n?", "\n"), r"[^\S\r\n]+", " ")
    return F.when(lines.rlike(r"\S"), lines).otherwise("")


def grammar_signature(texts: Column, exact: bool = True) -> Column:
    """Signature of an array of texts: distinct grammars in order, as JSON, hashed. exact normalises by NFKC, all texts of a row at once."""
    given = F.transform(texts, lambda t: F.coalesce(t, F.lit("")))
    if exact:
        given = F.when(F.size(texts) > 0, F.split(nfkc(F.array_join(given, "\0")), "\0", -1)).otherwise(F.array().cast("array<string>"))
    grams = F.array_distinct(F.transform(given, lambda t: grammar(t, False)))
    return F.concat(F.lit("grammar-v1:sha256:"), F.sha2(F.to_json(grams), 256))
