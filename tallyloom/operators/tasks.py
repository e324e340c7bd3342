"""Tasks, parents and samples: windows that overlap, cursors, scopes, batch statuses, revisions, exports and what screens show of them.

Every function takes and returns DataFrames or columns. Nulls count as absent unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import first_nonempty, nonempty, plain, text_value

# Names, labels and limits that users see.
NO_TITLE = "未设置档口"
COMPONENT_LABELS = {"cloud-print-client": "抖店打印组件", "cainiao-cnprint": "菜鸟打印组件"}
CAPTURE_REASONS = ("timestamp_invalid_fallback", "source_history_ambiguous")
CHILD_SUFFIX = r"-子项 \d+$"
SIZE_LABEL = r"(?i)(?:鞋码|尺码|码数|尺碼)\s*[:：]?\s*([2-4]\d(?:\.5)?|50|[XSML]{1,4})"
ANY_SIZE = r"(?<!\d)([2-4]\d(?:\.5)?|50)(?!\d)"
TITLE_LENGTH, PREVIEW_LENGTH = 31, 160
MAX_DEPTH, MAX_CHARS = 64, 2_000_000

# ---- capture ----


def initial_cursor(rows: DataFrame, key: list[str], rowid: str, time: str, cutoff: Column) -> DataFrame:
    """For each key the last rowid before the first row whose time is at or after the cutoff, or unknown; 0 if there is none.

    Two aggregations with map-side combine; no source's rows are brought together in order."""
    stop = rows.groupBy(*key).agg(F.min(F.when(F.col(time).isNull() | (F.col(time) >= cutoff), F.col(rowid))).alias("stop"))
    before = rows.join(stop, key).where(F.col("stop").isNull() | (F.col(rowid) < F.col("stop"))).groupBy(*key).agg(F.max(rowid).alias("last"))
    return stop.join(before, key, "left").select(*key, F.coalesce("last", F.lit(0)).cast("bigint").alias("cursor"))


def overlapping_tasks(tasks: DataFrame, pending: DataFrame, key: str, day_span: str = "1 day") -> DataFrame:
    """(key, task_id, covered) for each pending range (key, n_rows, first, last) and its tasks (key, task_id, status, start, end).

    Active tasks always count. With pending rows, so do completed ones that overlap [first, last + 1 s]; if the range isn't known, the
    newest completed one does, and covered is false. The overlap is an equi-join on the key and days, then verified."""
    days = lambda a, b: F.explode(F.sequence(F.date_trunc("day", a), F.date_trunc("day", b), F.expr(f"interval {day_span}")))
    done = tasks.where("status = 'completed'")
    known = F.col("first").isNotNull() & F.col("last").isNotNull()
    some = pending.where("n_rows > 0")
    until = F.col("last") + F.expr("interval 1 second")
    spans = some.where(known & (F.col("first") <= until)).withColumn("day", days(F.col("first"), until)).select(key, "first", until.alias("until"), "day")
    by_day = done.where("start <= end").withColumn("day", days(F.col("start"), F.col("end"))).select(key, "task_id", "start", "end", "day")
    over = by_day.join(spans, [key, "day"]).where("start <= until and end >= first").select(key, "task_id").distinct()
    newest = done.groupBy(key).agg(F.max("task_id").alias("task_id")).join(some.where(~known).select(key), key, "left_semi").select(key, "task_id")
    live = tasks.where("status = 'active'").join(pending.select(key), key, "left_semi").select(key, "task_id")
    covered = pending.select(key, ((F.col("n_rows") <= 0) | known).alias("covered"))
    return over.unionByName(newest).unionByName(live).distinct().join(covered, key)


def uncovered(rows: DataFrame, time: Column, covered: Column, inside: Column) -> DataFrame:
    """rows with step: `take` inside a window, `skip` with a valid time and complete coverage, `stop` (the batch fails, its cursor stays) otherwise."""
    return rows.withColumn("step", F.when(inside, "take").when(time.isNotNull() & covered, "skip").otherwise("stop"))


def archive_cascade(roots: DataFrame, children: list[tuple[DataFrame, str, str]], key: str) -> list[DataFrame]:
    """Rows of each child table (table, its key, its foreign key) that hang on the archived roots, level by level."""
    out, above = [], roots.select(F.col(key).alias("__above"))
    for table, own, foreign in children:
        hit = table.join(above, table[foreign] == F.col("__above"), "left_semi")
        out.append(hit)
        above = hit.select(F.col(own).alias("__above")).distinct()
    return out


# ---- scans and scopes ----


def counted_page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows with total (of all rows) and has_more; a page beyond the end is empty."""
    total = rows.agg(F.count("*").alias("total"))
    part = rows.orderBy(*order).offset(offset).limit(limit)
    return part.join(F.broadcast(total), how="cross").withColumn("has_more", F.col("total") > offset + limit)  # one row


def of_task(details: DataFrame, values: str, task: int, path: str = "$.capture_task_id") -> DataFrame:
    """Details whose JSON values name the task, as a number."""
    return details.where(F.get_json_object(values, path).try_cast("bigint") == task)


def first_of_scope(details: DataFrame, order: str, limit: int, keep: Column) -> DataFrame:
    """The limit comes before the filter: later rows don't move up."""
    return details.orderBy(order).limit(limit).where(keep)


def selected_first(details: DataFrame, ids: DataFrame, key: str, direct: Column) -> DataFrame:
    """The selected details: those that are complete (direct) first, then those to be parsed, each by key, with place from 1."""
    picked = details.join(ids, key, "left_semi").withColumn("direct", direct)
    # ranges of the order are numbered apart, so that no task holds all rows
    part = picked.withColumn("__bucket", F.struct((~F.col("direct")).cast("int").alias("late"), F.floor(F.col(key) / 1024).alias("range")))
    sizes = part.groupBy("__bucket").agg(F.count("*").alias("n"))
    start = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy("__bucket").orderBy(key))
    return part.withColumn("__inner", inner).join(start, "__bucket").withColumn("place", (F.col("before") + F.col("__inner")).cast("bigint")).drop("__bucket", "__inner", "n", "before")


def zipped(left: DataFrame, right: DataFrame, key: list[str], place: str) -> DataFrame:
    """Rows of both sides with the same place; the shorter side wins."""
    return left.join(right, [*key, place])


def search_all(rows: DataFrame, columns: list[str], keyword: str) -> DataFrame:
    """Rows in any of whose columns the keyword stands, whatever the case."""
    return rows.where(F.lower(F.concat_ws("\n", *[F.col(c).cast("string") for c in columns])).contains(keyword.strip().lower()))


def newest_groups(rows: DataFrame, group: str, n_groups: int) -> DataFrame:
    """Rows of the groups with the largest keys."""
    top = rows.select(group).distinct().orderBy(F.desc(group)).limit(n_groups)
    return rows.join(F.broadcast(top), group, "left_semi")  # n_groups rows


def chosen_or_newest(rounds: DataFrame, key: str, wanted: int | None) -> DataFrame:
    """The wanted id if there is one, else the largest."""
    return rounds.agg(F.coalesce(F.max(F.when(F.col(key) == wanted, F.col(key))), F.max(key)).alias(key))


def with_label(rows: DataFrame, dim: DataFrame, key: str, label: str, fallback: Column) -> DataFrame:
    """rows with the label that dim has for the key, or the fallback if it is missing or blank."""
    return rows.join(dim.select(key, F.col(label).alias("__label")), key, "left").withColumn(label, F.coalesce(nonempty(plain(F.col("__label"))), fallback)).drop("__label")


def component_label(component: Column) -> Column:
    t = text_value(component)
    return F.coalesce(*[F.when(t == k, v) for k, v in COMPONENT_LABELS.items()], nonempty(t), F.lit("-"))


# ---- learning ----


def learning_queue(samples: DataFrame, diagnostics: DataFrame, parents: DataFrame, record: str, document: str, parent: str) -> DataFrame:
    """Samples with the reason of their diagnostic (by record, document and parent) and their parent's label (by record and parent)."""
    d = diagnostics.select(record, document, parent, "reason")
    p = parents.select(record, parent, "label")
    return samples.join(d, [record, document, parent], "left").join(p, [record, parent], "left")


def same_format(samples: DataFrame, task: str, fingerprint: str, grammar: str, of: DataFrame) -> DataFrame:
    """The distinct tasks that have a sample of one of the formats `of` (fingerprint, grammar; a null grammar stands for any)."""
    exact = samples.join(of.where(F.col(grammar).isNotNull()), [fingerprint, grammar], "left_semi")
    any_ = samples.join(of.where(F.col(grammar).isNull()).select(fingerprint), fingerprint, "left_semi")
    return exact.select(task).unionByName(any_.select(task)).distinct()


def field_selection(fingerprints: DataFrame, tenant: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """The tenant's selected fields of each fingerprint, else the default ones."""
    own, usual = tenant.select(key, F.col("fields").alias("__own")), defaults.select(key, F.col("fields").alias("__usual"))
    return fingerprints.join(own, key, "left").join(usual, key, "left").withColumn("fields", F.coalesce("__own", "__usual")).drop("__own", "__usual")


def active_pack(packs: DataFrame, workspace: str) -> DataFrame:
    """Each workspace's newest active pack, by update time, then id."""
    return packs.where("is_active").groupBy(workspace).agg(F.max(F.struct("updated_at", "id")).alias("top")).select(workspace, F.col("top.id").alias("id"), F.col("top.updated_at").alias("updated_at"))


def revised(profiles: DataFrame, new: DataFrame) -> DataFrame:
    """Profiles with `new` ones in the place of those of the same slot: fingerprint, strategy and fields, and, but for structured ones, grammar.
    All new ones get the next revision of their fingerprint."""
    slot = lambda df: df.withColumn("__slot", F.struct("fingerprint", "strategy", F.coalesce("fields", F.lit("")).alias("f"), F.when(F.col("strategy") != "structured_items_v1", F.coalesce("grammar", F.lit(""))).alias("g")))
    # structured slots have a null grammar, so they are compared as text
    key = lambda df: slot(df).withColumn("__slot", F.to_json("__slot"))
    kept = key(profiles).join(key(new).select("__slot"), "__slot", "left_anti").drop("__slot")
    last = profiles.groupBy("fingerprint").agg(F.max("revision").alias("__last"))
    added = new.drop("revision").join(last, "fingerprint", "left").withColumn("revision", F.coalesce("__last", F.lit(0)) + 1).drop("__last")
    return kept.unionByName(added.select(*kept.columns))


def replay(rows: DataFrame, key: list[str], expected: DataFrame) -> DataFrame:
    """For each sample of `expected` (key, rows: array) whether the same rows, in the same order, came out; missing ones fail."""
    got = rows.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("__got"))
    return expected.join(got, key, "left").withColumn("passed", F.coalesce(F.col("rows") == F.col("__got"), F.size("rows") == 0)).drop("__got")


def replay_summary(replayed: DataFrame) -> DataFrame:
    return replayed.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("ok"))


def roles_match(fields: DataFrame, key: list[str], assigned: Column, matches: Column) -> DataFrame:
    """Whether of each key's fields all assigned ones, and no others, match their class."""
    return fields.groupBy(*key).agg(F.bool_and(assigned == matches).alias("roles_match"))


# ---- statuses and summaries ----


def batch_status(diagnostics: DataFrame, key: list[str], reason: str) -> DataFrame:
    """A batch's status from its parents' reasons: a missing profile first, then capture faults alone, then anything else, else parsed."""
    r = nonempty(plain(F.col(reason)))
    missing, some, capture = F.bool_or(r == "format_profile_missing"), F.bool_or(r.isNotNull()), F.bool_and(F.coalesce(r.isin(*CAPTURE_REASONS), F.lit(True)))
    return diagnostics.groupBy(*key).agg(F.when(missing, "format_profile_missing").when(some & capture, "capture_source_exception").when(some, "format_profile_incomplete").otherwise("parsed").alias("parse_status"))


def draft_summary(rows: DataFrame, key: list[str], parent: str, status: str, unresolved: DataFrame | None = None) -> DataFrame:
    """Parents, child rows and statuses for each key; unresolved parents (key, parent) count as parents that need review."""
    one = rows.select(*key, parent, status, F.lit(1).alias("child"))
    if unresolved is not None:
        one = one.unionByName(unresolved.select(*key, parent, F.lit("needs_review").alias(status), F.lit(0).alias("child")))
    state = lambda s: F.count_if(F.col(status) == s).alias(f"{s}_count")
    return one.groupBy(*key).agg(F.count_distinct(parent).alias("parent_waybill_count"), F.sum("child").cast("bigint").alias("child_waybill_count"), state("draft"), state("needs_review"), state("special"))


def waybill_count(rows: DataFrame, key: list[str], label: str) -> DataFrame:
    """Distinct parents by label without the child's suffix; rows, where no label is known."""
    parent = nonempty(F.regexp_replace(text_value(F.col(label)), CHILD_SUFFIX, ""))
    return rows.groupBy(*key).agg(F.coalesce(F.nullif(F.count_distinct(parent), F.lit(0)), F.count("*")).alias("n_waybills"))


def scope_coverage(sources: DataFrame, key: list[str], total: DataFrame) -> DataFrame:
    """Of each scope's sources (source_type, parent_label, record_id, detail_id): distinct parents (details, where there are none), details,
    sources by type as a map, and what is missing of total (key, total)."""
    parent = F.when(F.col("source_type") == "order_row_draft", nonempty(first_nonempty(F.col("parent_label"), F.col("record_id").cast("string"))))
    base = sources.groupBy(*key).agg(F.count_distinct(parent).alias("parents"), F.count_distinct("detail_id").alias("details"))
    kinds = sources.groupBy(*key, F.coalesce("source_type", F.lit("unknown")).alias("t")).agg(F.count("*").alias("n")).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("source_types"))
    covered = F.when(F.col("parents") > 0, F.col("parents")).otherwise(F.coalesce("details", F.lit(0)))
    return total.join(base, key, "left").join(kinds, key, "left").select(*key, covered.alias("covered"), F.coalesce("details", F.lit(0)).alias("details"), F.to_json("source_types").alias("source_types"), F.greatest(F.col("total") - covered, F.lit(0)).alias("missing"))


def scan_tasks(expected: DataFrame, rows: DataFrame, task: str, parent: str, failed: DataFrame) -> DataFrame:
    """Coverage of each task, failed ones (task, error) beside: expected and recognised parents, lost ones, and the error that stopped it."""
    e = expected.groupBy(task).agg(F.count_distinct(parent).alias("expected"))
    r = rows.groupBy(task).agg(F.count_distinct(parent).alias("recognised"))
    out = e.join(r, task, "left").join(failed, task, "full")
    n = lambda c: F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0)))
    return out.select(task, n("expected").alias("expected"), n("recognised").alias("recognised"), (n("expected") - n("recognised")).alias("lost"), "error")


def conditional_counts(rows: DataFrame, key: list[str], column: str, values: list[str]) -> DataFrame:
    """A count for each value, one for all others, and the total."""
    c = F.col(column)
    return rows.groupBy(*key).agg(*[F.count_if(c == v).alias(f"n_{v}") for v in values], F.count_if(~F.coalesce(c.isin(*values), F.lit(False))).alias("n_other"), F.count("*").alias("n"))


# ---- what is shown and exported ----


def sheet_titles(names: DataFrame, name: str, order: str) -> DataFrame:
    """names with title: no characters that sheets can't have, at most 31 of them, and `_2`, `_3`, … where an earlier one has the same."""
    base = F.coalesce(nonempty(F.btrim(F.regexp_replace(F.coalesce(nonempty(text_value(F.col(name))), F.lit(NO_TITLE)), r"[\[\]:*?/\\]", "_"), F.lit("' "))), F.lit(NO_TITLE))
    n = F.row_number().over(Window.partitionBy("__cut").orderBy(order))
    cut = names.withColumn("__base", base).withColumn("__cut", F.substring("__base", 1, TITLE_LENGTH)).withColumn("__n", n)
    mark = F.concat(F.lit("_"), F.col("__n").cast("string"))
    return cut.withColumn("title", F.when(F.col("__n") == 1, F.col("__cut")).otherwise(F.concat(F.expr(f"left(__base, {TITLE_LENGTH} - length(concat('_', __n)))"), mark))).drop("__base", "__cut", "__n")


def file_name(prefix: Column, extension: str, time: Column) -> Column:
    """prefix_YYYYmmdd_HHMMSS.extension, in UTC+8, without characters that file names can't have."""
    clean = F.coalesce(nonempty(F.trim(F.regexp_replace(F.coalesce(nonempty(text_value(prefix)), F.lit(NO_TITLE)), r'[<>:"/\\|?*\x00-\x1f]', "_"))), F.lit(NO_TITLE))
    return F.concat(clean, F.lit("_"), F.date_format(time + F.expr("interval 8 hours"), "yyyyMMdd_HHmmss"), F.lit(extension if extension.startswith(".") else f".{extension}"))


def preview(text: Column, length: int = PREVIEW_LENGTH) -> Column:
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, length)), F.lit("...")))


def allowed_values(values: Column, allowed: list[str]) -> Column:
    """A map without the keys that are not allowed."""
    return F.map_filter(values, lambda k, _: k.isin(*allowed))


def defined_columns(rows: DataFrame, values: str, definitions: list[dict], keep: list[str] = ()) -> DataFrame:
    """The enabled columns of the definitions (id, field, label, order, enabled) with an order above 0, by order, then id, from a map of values."""
    live = sorted((d for d in definitions if d["enabled"] and d["order"] > 0), key=lambda d: (d["order"], d["id"]))
    return rows.select(*keep, *[F.coalesce(F.element_at(values, d["field"]), F.lit("")).alias(d["label"]) for d in live])


def export_rows(details: DataFrame, items: str, quantity: str) -> DataFrame:
    """A row for each item of a detail, or one without items. A detail's total quantity isn't passed on to one of several items."""
    out = details.select(*[c for c in details.columns if c != items], F.posexplode_outer(items).alias("__pos", "item"), F.greatest(F.size(F.coalesce(items, F.array())), F.lit(1)).alias("item_count"))
    own = F.when(F.col("item_count") > 1, text_value(F.col("item.quantity"))).otherwise(first_nonempty(F.col("item.quantity"), F.col(quantity)))
    return out.withColumn("item_index", F.coalesce(F.col("__pos"), F.lit(0)) + 1).withColumn("item_quantity", own).drop("__pos")


def infer_size(*texts: Column) -> Column:
    """A labelled size, else the first number that can be one; empty if there is none."""
    joined = F.array_join(F.filter(F.array(*[text_value(t) for t in texts]), lambda t: t != ""), "\n")
    return F.coalesce(nonempty(F.regexp_extract(joined, SIZE_LABEL, 1)), nonempty(F.regexp_extract(joined, ANY_SIZE, 1)), F.lit(""))


def preview_spec(sku: Column, attr1: Column, product: Column) -> Column:
    """What a preview shows as spec: the SKU's name, else the attribute, else the product text, without the product in front."""
    p = plain(product)
    strip = lambda c: F.when((p != "") & plain(c).startswith(p) & (F.length(plain(c)) > F.length(p)), F.btrim(F.substring(plain(c), F.length(p) + 1, F.length(plain(c))), F.lit(" -_/"))).otherwise(plain(c))
    return F.coalesce(nonempty(strip(sku)), nonempty(strip(attr1)), nonempty(p), F.lit("-"))


def preview_quantity(quantity: Column) -> Column:
    """The first number anywhere in the text, else 1."""
    return F.coalesce(nonempty(F.regexp_extract(plain(quantity), r"\d+", 0)).try_cast("bigint"), F.lit(1).cast("bigint"))


# ---- times, sizes, JSON ----


def utc_time(c: Column, naive_zone: str = "+00:00") -> Column:
    """An ISO-8601 text as a UTC time without zone; a text without zone is in naive_zone; null if it isn't one."""
    t = F.regexp_replace(plain(c), "[zZ]$", "+00:00")
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:[+-]\d{2}:\d{2})?)?$")
    zone = F.regexp_extract(t, r"[T ].*([+-]\d{2}:\d{2})$", 1)
    local = F.when(zone != "", F.substring(t, F.lit(1), F.length(t) - 6)).otherwise(t).try_cast("timestamp_ntz")
    used = F.when(zone == "", naive_zone).otherwise(zone)
    minutes = (F.substring(used, 2, 2).cast("int") * 60 + F.substring(used, 5, 2).cast("int")) * F.when(used.startswith("-"), -1).otherwise(1)
    return F.when(iso, local - F.make_dt_interval(F.lit(0), F.lit(0), minutes))


def local_text(c: Column, hours: int = 8) -> Column:
    """A UTC time as text of seconds in another zone."""
    return F.date_format(c + F.make_dt_interval(F.lit(0), F.lit(hours)), "yyyy-MM-dd HH:mm:ss")


def bounded(c: Column, default: int, low: int, high: int) -> Column:
    n = F.round(plain(c).try_cast("double")).cast("int")
    return F.least(F.greatest(F.coalesce(n, F.lit(default)), F.lit(low)), F.lit(high))


def scaled(c: Column, ratio: float, less: float = 0.0, by: float = 1.0, least: float = 0.0) -> Column:
    """Preview pixels as a sheet's units, to two places (halves to even)."""
    return F.bround(F.greatest((c * ratio - less) / by, F.lit(least)), 2)


def json_payload(raw: Column) -> Column:
    """JSON text of an object; of other JSON as {"raw_value": …}, of text that isn't JSON as {"raw_text": …}. Null is no JSON."""
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    wrap = lambda k, c: F.concat(F.lit(f'{{"{k}":'), c, F.lit("}"))
    text = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r'(["\\])', r"\\$1"), "\n", r"\\n"), F.lit('"'))
    return F.when(v.isNull(), wrap("raw_text", text)).when(kind.startswith("OBJECT"), F.to_json(v)).otherwise(wrap("raw_value", F.to_json(v)))


def json_depth(raw: Column) -> Column:
    """How deep objects and arrays of a JSON text are nested; brackets in strings don't count."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r'"(?:[^"\\]|\\.)*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    walk = F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, m: _deeper(s, F.when(m.isin("[", "{"), 1).when(m.isin("]", "}"), -1).otherwise(0)), lambda s: s["most"])
    return walk


def _deeper(state: Column, step: Column) -> Column:
    now = state["now"] + step
    return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))


def within_limits(raw: Column, depth: int = MAX_DEPTH, chars: int = MAX_CHARS) -> Column:
    return (F.length(raw) <= chars) & (json_depth(raw) <= depth)


def missing_references(rows: DataFrame, targets: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """(key, field, value) for each reference of rows that no target (table, its key) has; null references are none."""
    found = []
    for field, (table, own) in targets.items():
        some = rows.where(F.col(field).isNotNull()).select(key, F.lit(field).alias("field"), F.col(field).cast("string").alias("value"))
        found.append(some.join(table.select(F.col(own).cast("string").alias("value")), "value", "left_anti").select(key, "field", "value"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def merged(first: Column, second: Column) -> Column:
    """Two maps as one; of equal keys the second's value counts."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)
