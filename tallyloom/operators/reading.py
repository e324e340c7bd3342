"""Reading captured payloads: JSON leaves, field filters, lines, segments and print XML."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import nonempty, text_value

# Names and words of technical and business fields.
TECHNICAL_NAMES = (
    "rowid", "id", "component_task_id", "task_time", "db_path", "created_at", "updated_at", "collector_id", "token", "machine_id", "source_path",
    "source_component", "source_index", "source_epoch", "capture_assignment", "dedupe_key", "captured_at", "document_id", "workspace_id",
    "tenant_id", "shop", "shopname", "shop_name", "store", "storename", "store_name", "nick", "nickname", "buyer_nick", "buyernick",
    "buyer_nickname", "item_total_price", "item_total_count", "total_line", "showiteminfo", "show_item_info",
)
TECHNICAL_WORDS = ("token", "password", "secret", "db_path", "database", "machine_id", "collector_id")
BUSINESS_WORDS = (
    "product", "productinfo", "goods", "item", "title", "sku", "quantity", "qty", "count", "spec", "color", "colour", "size", "remark", "memo",
    "message", "buyer_message", "seller_remark", "buyerremark", "sellerremark", "buyer_memo", "seller_memo", "item_info",
)
QUANTITY_WORDS = ("quantity", "qty", "count")
TECHNICAL_VALUES = (
    r"^[A-Za-z]:\\",
    r"(?U)^/[\w./-]+$",
    r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}",
    r"^[A-Za-z0-9_-]{16,}$",
)
LABELLED = r"^\s*(?:颜色分类|颜色|色号|鞋码|尺码|码数|号码|规格|款式)\s*[:：]"
TAIL_SIZE = r"(?i)^(?:[1-9]\d(?:\.\d)?|[SMLX]{1,4}|均码|加大码|大码|小码)$"
QUANTITY_MARK = r"^(.+?)\s*([*xX×]\s*\d+(?:\.\d+)?)$"

NOT_BLANK = re.compile(r"[^ \t\n\x0b\f\r]")

LEAF = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())]))


def json_text(value) -> str:
    """A leaf as text: null is empty, booleans and numbers as Python prints them."""
    return "" if value is None else str(value)


def json_leaves(payload: Column) -> Column:
    """(path, text) of the non-empty leaves in document order; duplicate keys keep the last value, text that is no JSON has none."""
    return F.pandas_udf(_leaves, LEAF)(payload)


def _leaves(payload: pd.Series) -> pd.Series:

    def walk(value, path):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, f"{path}.{k}" if path else k)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from walk(v, f"{path}[{i}]")
        elif text := json_text(value).strip():
            yield {"path": path, "text": text}

    def leaves(p):
        try:
            return list(walk(json.loads(p), ""))
        except (TypeError, ValueError, RecursionError):
            return []

    return payload.map(leaves)


def walk_leaves(rows: DataFrame, payload: str) -> DataFrame:
    """A row for each leaf, with its place among the payload's leaves."""
    return rows.select("*", F.posexplode(json_leaves(F.col(payload))).alias("leaf_order", "leaf")).select(*rows.columns, "leaf_order", "leaf.path", "leaf.text")


def field_filter_reason(path: Column, text: Column) -> Column:
    """Why a raw field stays hidden, or null if it is shown; the tests are tried in a fixed order."""
    name = F.lower(F.trim(F.element_at(F.split(F.regexp_replace(path, r"\[\d+\]", ""), r"\."), -1)))
    words = F.regexp_replace(F.regexp_replace(F.lower(path), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    t = text_value(text)
    has = lambda ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: words.contains(w))
    technical = reduce(lambda a, b: a | b, [t.rlike(p) for p in TECHNICAL_VALUES])
    digits = t.rlike(r"^\d{1,8}$")
    obvious = (t == "") | F.lower(t).isin("true", "false") | technical | digits
    looks = ~obvious & F.when(t.rlike("[一-鿿]"), F.length(t) >= 2).otherwise((t.rlike("[:：]") & (F.length(t) >= 4)) | (t.rlike(r"\s") & (F.length(t) >= 8)))
    return (
        F.when(name.isin(*TECHNICAL_NAMES), "technical_field_name")
        .when(has(TECHNICAL_WORDS), "technical_field_path")
        .when(has(BUSINESS_WORDS), F.when(technical | (~has(QUANTITY_WORDS) & digits), "technical_value"))
        .when(~looks, "not_business_relevant")
    )


def document_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each line that isn't blank: its number and code point offsets in the original.

    A text's lines are found in its own row, in one pass over it, so nothing is shuffled. Null and empty texts have none."""
    schema = T.StructType([docs.schema[key], *[T.StructField(c, T.LongType()) for c in ("line_number", "start", "end")], T.StructField("line", T.StringType())])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                whole = batch.column(1)[row].as_py() or ""
                found, at = [], 0
                for line in re.split("[\r\n]", whole):
                    if NOT_BLANK.search(line):
                        found.append((len(found) + 1, at, at + len(line), line))
                    at += len(line) + 1
                for lo in range(0, len(found), 10_000):
                    part = list(zip(*found[lo : lo + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(part[0]))), *(pa.array(c, pa.int64()) for c in part[:3]), pa.array(part[3], pa.string())], schema.names)

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, schema)


def segments(line: Column) -> Column:
    """The selectable parts of a line: at delimiters (a slash is none in labelled lines), before a quantity mark or a size at the end."""
    clean = text_value(line)
    parts = F.filter(F.transform(F.split(F.regexp_replace(clean, r"[；;]\s*", "\n"), r"\n+"), text_value), lambda p: p != "")
    cut = F.flatten(F.transform(parts, lambda p: F.when(p.rlike(LABELLED), F.split(p, "[,，、|]+")).otherwise(F.split(p, "[,，、|/]+"))))
    cut = F.filter(F.transform(cut, text_value), lambda p: p != "")

    def tail(p: Column) -> Column:
        words = F.split(p, r"\s+")
        head = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " ")
        ok = (F.size(words) >= 2) & F.element_at(words, -1).rlike(TAIL_SIZE) & (F.length(head) >= 2)
        return F.when(ok, F.array(head, F.element_at(words, -1))).otherwise(F.array(p))

    def marked(p: Column) -> Column:
        pair = F.array(text_value(F.regexp_extract(p, QUANTITY_MARK, 1)), F.regexp_replace(F.regexp_extract(p, QUANTITY_MARK, 2), r"\s+", ""))
        return F.when(p.rlike(QUANTITY_MARK), F.filter(pair, lambda x: x != "")).otherwise(tail(p))

    return F.flatten(F.transform(F.when(F.size(cut) > 0, cut).when(clean != "", F.array(clean)).otherwise(F.array().cast("array<string>")), marked))


def xml_texts(xml: Column) -> Column:
    """Texts of print XML that need not be well-formed: CDATA parts of each <text>, else its text without tags; else all CDATA."""
    nodes = F.regexp_extract_all(xml, F.lit(r"(?is)<text\b[^>]*>(.*?)</text>"), 1)
    data = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(?s)<!\[CDATA\[(.*?)\]\]>"), 1), text_value)
    bare = lambda x: text_value(unescape(F.regexp_replace(x, "<[^>]+>", "")))
    each = F.flatten(F.transform(nodes, lambda n: F.when(F.size(data(n)) > 0, data(n)).otherwise(F.array(bare(n)))))
    some = F.filter(each, lambda t: t != "")
    return F.when(F.size(some) > 0, some).otherwise(F.filter(data(xml), lambda t: t != ""))


def unescape(c: Column) -> Column:
    """The five XML entities; the ampersand last, so that nothing is unescaped twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def payload_documents(rows: DataFrame, payload: str) -> DataFrame:
    """A row for each element of task.documents, as JSON text with its 0-based place; payloads without one stay as one row."""
    parsed = F.from_json(F.col(payload), "struct<task:struct<documents:array<string>>>", {"mode": "PERMISSIVE"})
    docs = F.filter(parsed["task"]["documents"], lambda d: d.startswith("{"))
    return rows.select("*", F.posexplode_outer(F.when(F.size(docs) > 0, docs)).alias("document_pos", "document")).withColumns({"document_pos": F.coalesce("document_pos", F.lit(0)), "document": F.coalesce("document", payload)})


def document_id(payload: Column, task_id: Column, fallback: Column) -> Column:
    """The first document's id, else the task's, else the fallback."""
    return F.coalesce(nonempty(F.get_json_object(payload, "$.task.documents[0].documentID")), nonempty(task_id), fallback)


# ---- samples ----


def source_texts(rows: DataFrame, keep: list[str], payload: str, prefix: Column) -> DataFrame:
    """(keep, path, text, text_order) of what a payload shows: the texts of print XML, and other leaves that no filter hides."""
    leaves = walk_leaves(rows.select(*keep, payload), payload)
    xml = F.col("path").rlike(r"(?:^|\.)printXML$")
    blocks = leaves.where(xml).select(*keep, "leaf_order", "path", F.posexplode(xml_texts(F.col("text"))).alias("block", "value"))
    printed = blocks.select(*keep, F.concat(prefix, "path", F.lit(".text["), F.col("block").cast("string"), F.lit("]")).alias("path"), F.col("value").alias("text"), F.struct("leaf_order", "block").alias("text_order"))
    shown = leaves.where(~xml & field_filter_reason(F.col("path"), F.col("text")).isNull())
    return shown.select(*keep, F.concat(prefix, "path").alias("path"), "text", F.struct("leaf_order", F.lit(0).alias("block")).alias("text_order")).unionByName(printed)


def reading_samples(records: DataFrame, key: str, payload: str, columns: list[str] = ()) -> DataFrame:
    """A row for each document of a record: document_pos, sample_number (from 1 within the record), texts (path, text in order) and state.

    Texts are those of the record's own columns, then of the document. A document without any stays as `empty`. A record without
    documents is read as a whole (`fallback`), or is `empty` too."""
    docs = payload_documents(records, payload).withColumn("__whole", F.col("document") == F.col(payload))
    prefix = F.when(F.col("__whole"), "").otherwise(F.concat(F.lit("task.documents["), F.col("document_pos").cast("string"), F.lit("].")))
    found = source_texts(docs.select(key, "document_pos", "__whole", "document"), [key, "document_pos", "__whole"], "document", prefix)
    own = [F.struct(F.lit(f"record.{c}").alias("path"), text_value(F.col(c)).alias("text")) for c in columns]
    grouped = found.groupBy(key, "document_pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("text_order", "path", "text"))), lambda t: F.struct(t["path"].alias("path"), t["text"].alias("text"))).alias("__texts"))
    out = docs.join(grouped, [key, "document_pos"], "left")
    mine = F.filter(F.array(*own), lambda t: t["text"] != "") if own else F.array().cast("array<struct<path:string,text:string>>")
    texts = F.concat(mine, F.coalesce("__texts", F.array().cast("array<struct<path:string,text:string>>")))
    state = F.when(F.size("texts") == 0, "empty").when(F.col("__whole"), "fallback").otherwise("read")
    return out.select(key, "document_pos", (F.col("document_pos") + 1).cast("bigint").alias("sample_number"), texts.alias("texts"), "__whole").withColumn("state", state).drop("__whole")


def sample_blocks(samples: DataFrame, key: str) -> DataFrame:
    """A row for each line of each text of a sample, with its path, number, offsets in the text and selectable segments."""
    each = samples.select(key, "sample_number", F.explode("texts").alias("t"))
    each = each.select(F.struct(key, "sample_number", F.col("t.path").alias("path")).alias("at"), F.col("t.text").alias("text"))
    lines = document_lines(each, "at", "text")
    return lines.select(F.col(f"at.{key}").alias(key), "at.sample_number", F.col("at.path").alias("source_path"), "line_number", "start", "end", "line", segments(F.col("line")).alias("segments"))


def area_texts(xml: Column) -> Column:
    """struct(text, marked) of each <text> element of print XML: marked inside an element whose tag, attribute or attribute value reads CUSTOMAREA.

    Elements are followed by their depth, tag by tag, so documents with several roots and unclosed ends can be read; comments and
    declarations are passed over. Text that holds no tag is null."""
    parts = F.regexp_extract_all(xml, F.lit(r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<[^>]*>|[^<]+"), F.lit(0))
    letters = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("area"), F.lit(-1).alias("node"), F.lit("").alias("now"), F.array().cast("array<struct<text:string,marked:boolean>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        data, tag = p.startswith("<![CDATA["), p.startswith("<") & ~p.startswith("<!") & ~p.startswith("<?")
        closes, single = tag & p.startswith("</"), tag & p.endswith("/>")
        opens = tag & ~closes
        words = F.transform(F.regexp_extract_all(p, F.lit(r"""^<\s*([^\s/>]+)|([\w:.-]+)(?=\s*=)|=\s*["']([^"']*)["']"""), F.lit(0)), letters)
        area = opens & F.exists(words, lambda w: w == "CUSTOMAREA")
        is_text = p.rlike(r"^</?(?:[\w.-]+:)?text[\s/>]")
        depth = s["depth"] + F.when(opens & ~single, 1).when(closes, -1).otherwise(0)
        begins, ends = opens & ~single & is_text & (s["node"] < 0), closes & (depth == s["node"])
        body = F.when(data, F.substring(p, F.lit(10), F.length(p) - 12)).when(tag | p.startswith("<"), "").otherwise(unescape(p))
        return F.struct(
            depth.alias("depth"),
            F.when(area & ~single & (s["area"] < 0), s["depth"]).when(closes & (depth <= s["area"]), -1).otherwise(s["area"]).alias("area"),
            F.when(begins, s["depth"]).when(ends, -1).otherwise(s["node"]).alias("node"),
            F.when(begins, "").when(s["node"] >= 0, F.concat(s["now"], body)).otherwise(s["now"]).alias("now"),
            F.when(ends, F.concat(s["out"], F.array(F.struct(s["now"].alias("text"), (s["area"] >= 0).alias("marked"))))).otherwise(s["out"]).alias("out"),
        )

    return F.when(xml.rlike("<[A-Za-z]"), F.aggregate(parts, start, step, lambda s: s["out"]))
