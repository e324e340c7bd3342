"""Column builders for the text rules of capture, parsing and reports. All are Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns that the results depend on.
UNITS = "件|双|雙|个|個|条|條|套|份|只|支|瓶|包|组|組"
REPORT_UNITS = "件|个|個|双|雙|条|條|套|只|瓶|包|箱"
STAR_QUANTITY = r"[*×]\s*(\d+)(?![A-Za-z0-9一-鿿])"
LETTER_QUANTITY = r"(?<![A-Za-z0-9])[xX]\s*(\d+)(?![A-Za-z0-9一-鿿])"
COUNT_QUANTITY = rf"(\d+)\s*(?:{UNITS})"
BRACKET_QUANTITY = r"(?<![A-Za-z0-9一-鿿])[【\[\(（]\s*(\d{1,3})\s*[】\]\)）](?![A-Za-z0-9一-鿿])"
QUANTITY = f"(?U)(?:(?:{STAR_QUANTITY}|{LETTER_QUANTITY})|{COUNT_QUANTITY}|{BRACKET_QUANTITY})"
ORDER_QUANTITY_TAIL = rf"(?U)\s*(?:(?:[【\[\(（]\s*)?(?:[*xX×]\s*(\d+)|(\d+)\s*(?:{UNITS}))(?:\s*[】\]\)）])?|(?<![A-Za-z0-9一-鿿])[【\[\(（]\s*(\d{{1,3}})\s*[】\]\)）](?![A-Za-z0-9一-鿿]))\s*[;；，,]*\s*$"
QUANTITY_TAIL = rf"(?U)\s*(?:(?:{STAR_QUANTITY}|{LETTER_QUANTITY})|{COUNT_QUANTITY}|{BRACKET_QUANTITY})\s*$"
LOGISTICS_TAIL = r"(?iU)\s*(?:运单号|物流单号|快递单号)\s*[:：]\s*(?:\[[^\]]*\]|【[^】]*】|[A-Z]{1,8}\d[\w,，\-\s]*)\s*$"
SHOE_SIZE = r"(?U)^((?:2[0-9]|3[0-9]|4[0-9]|5[0-5])(?:\.\d)?)(?:\s*(?:码|[（(].*[）)]?|[,，;；/].*|偏.*|建议.*))?$"
NOISY_SHOE_SIZE = r"(?U)^((?:2[0-9]|3[0-9]|4[0-9]|5[0-5])(?:\.\d)?)(?=\s*(?:[*xX×]\s*\d+|\d+\s*(?:件|双|雙)|运单号|物流单号|快递单号|$))"
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
FIELD_LABEL = r"(?U)(颜色分类|颜色|鞋码|尺码|规格|款式)\s*[:：]\s*"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with the column c, computed once for each row: filters and projections above do not copy its expression."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def runs(c: Column) -> Column:
    """The distinct runs of one to three characters in a text; firsts() of any text that it contains is one of them."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.array(*[F.substring(c, i, F.lit(n)) for n in (1, 2, 3)]))))


def firsts(c: Column) -> Column:
    """Up to three characters at the beginning of a text."""
    return F.substring(c, 1, 3)


def plain(c: Column) -> Column:
    """The value as text without white space at its ends; null is empty."""
    return F.coalesce(F.btrim(c.cast("string"), F.lit(WHITE)), F.lit(""))


def text_value(c: Column) -> Column:
    """plain() without control characters (but line feeds and tabs) and format characters."""
    return plain(F.regexp_replace(c.cast("string"), r"[\x00-\x08\x0B-\x1F]|\p{Cf}", ""))


def compact(c: Column) -> Column:
    return plain(F.regexp_replace(text_value(c), r"(?U)\s+", " "))


def match_text(c: Column) -> Column:
    """The form in which values are compared: lower case, without spaces, tabs and line feeds."""
    return F.translate(F.lower(plain(c)), " \t\n", "")


def nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def first_nonempty(*cs: Column) -> Column:
    return F.coalesce(*[nonempty(plain(c)) for c in cs], F.lit(""))


def positive_int(c: Column) -> Column:
    """Strict positive integer, else null."""
    n = plain(c).try_cast("bigint")
    return F.when(plain(c).rlike(r"^[+-]?\d+$") & (n > 0), n)


def _first_group(text: Column, pattern: str, groups: int) -> Column:
    return F.coalesce(*[nonempty(F.regexp_extract(text, pattern, g)) for g in range(1, groups + 1)])


def quantity_from_text(*values: Column) -> Column:
    """The first value with a positive quantity: `*2`, `x2`, `2件`, `[2]` anywhere, else a text of digits only."""

    def one(t: Column) -> Column:
        n = _first_group(t, QUANTITY, 4).try_cast("bigint")
        return F.coalesce(F.when(n > 0, n), F.when(t.rlike(r"^\d+$") & (t.try_cast("bigint") > 0), t.try_cast("bigint")))

    return F.coalesce(*[let(text_value(v), one) for v in values])


def strip_trailing_quantity(c: Column, order: bool = False) -> Column:
    """struct(head, quantity): the text before a quantity at its end, and the quantity's digits. order: with closing marks and separators too."""

    def cut(t: Column, pattern: str, groups: int) -> Column:
        return F.struct(compact(F.regexp_replace(t, pattern, "")).alias("head"), F.coalesce(_first_group(t, pattern, groups), F.lit("")).alias("quantity"))

    def one(t: Column) -> Column:
        none = F.struct(t.alias("head"), F.lit("").alias("quantity"))
        tail = F.when(t.rlike(QUANTITY_TAIL), cut(t, QUANTITY_TAIL, 4)).otherwise(none)
        return F.when(t.rlike(ORDER_QUANTITY_TAIL), cut(t, ORDER_QUANTITY_TAIL, 3)).otherwise(tail) if order else tail

    return let(compact(c), one)


def strip_logistics_tail(c: Column) -> Column:
    def one(t: Column) -> Column:
        return let(compact(t), lambda k: F.when(k.rlike(LOGISTICS_TAIL), F.btrim(compact(F.regexp_replace(k, LOGISTICS_TAIL, "")), F.lit(" ，,;；"))).otherwise(t))

    return let(text_value(c), one)


def remove_first(c: Column, pattern: str) -> Column:
    """Takes out the first match only."""
    m = F.regexp_substr(c, F.lit(pattern))
    at = F.instr(c, m)
    return F.when(m.isNull(), c).otherwise(F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + F.length(m), F.length(c))))


def remove_field_label(c: Column) -> Column:
    return let(compact(c), lambda t: plain(remove_first(t, FIELD_LABEL)))


def normalize_size(c: Column) -> Column:
    """Shoe sizes 20 to 55.9 without hints, quantities or logistics; other texts as they are."""
    return let(strip_logistics_tail(remove_field_label(c)), lambda t: F.coalesce(nonempty(F.regexp_extract(t, NOISY_SHOE_SIZE, 1)), nonempty(F.regexp_extract(t, SHOE_SIZE, 1)), t))


def report_quantity(c: Column, default: Column) -> Column:
    """`2`, `*2`, `x2件` as a whole, else the default."""
    t = F.regexp_replace(plain(c), r"(?U)\s+", "")
    n = F.regexp_extract(t, rf"(?U)^[*xX×]?(\d+)(?:{REPORT_UNITS})?$", 1).try_cast("bigint")
    return F.when(n > 0, n).otherwise(default)


def natural_key(c: Column) -> Column:
    """Sort key: texts with a number by the first one, then the others, each by lower case."""
    t = F.coalesce(nonempty(plain(c)), F.lit("-"))
    n = nonempty(F.regexp_extract(t, r"\d+(?:\.\d+)?", 0)).cast("double")
    return F.struct(n.isNull().cast("int").alias("kind"), F.coalesce(n, F.lit(0.0)).alias("number"), F.lower(t).alias("low"))


def safe_cell(c: Column) -> Column:
    """Guards spreadsheet cells that would be formulas with an apostrophe."""
    return F.when(c.rlike(r"^[ \t\r\n]*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def parent_sequence(explicit: Column, label: Column) -> Column:
    """The explicit sequence, else the number in a label like `面单 7` or `第1批-第7单`."""
    return F.coalesce(explicit.cast("bigint"), nonempty(F.regexp_extract(plain(label), r"(?U)(?:第1批-第|面单\s*)(\d+)(?:单)?", 1)).cast("bigint"))


def parent_label(source_index: Column, record_id: Column, sequence: Column) -> Column:
    s = text_value(source_index)
    n = F.when(sequence > 0, sequence.cast("bigint")).when(s.rlike(r"^\d+-\d+$"), F.regexp_extract(s, r"-(\d+)$", 1).try_cast("bigint")).when(s.rlike(r"^\d+$"), s.try_cast("bigint")).otherwise(record_id.cast("bigint"))
    return F.concat(F.lit("面单 "), n.cast("string"))


def child_label(parent: Column, index: Column, count: Column) -> Column:
    return F.when(count > 1, F.concat(parent, F.lit("-子项 "), index.cast("string"))).otherwise(parent)


def sku_name_from_file(c: Column) -> Column:
    """The last part of a path, without ending and the `SKU图_1_` in front."""
    name = F.element_at(F.split(c, r"[/\\]"), -1)
    return plain(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"^SKU图_\d+[_-]", ""))
