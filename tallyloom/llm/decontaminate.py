"""Benchmark decontamination: one Aho-Corasick automaton over the windows of the benchmark items.

An item's windows are its runs of WINDOW consecutive words; an item of fewer words, but not none, is one window.
A text is reduced to its words with single spaces between and scanned once; matches are mapped back to word numbers and
to code point offsets of the original.

Windows are made, and made distinct, by Spark, and written to the shared folder in blocks of BLOCK_BYTES; a task reads a block's
windows from there and builds their automaton. One block, and so one automaton and one scan, serves benchmarks of up to some
five million words; larger ones take a scan for each block, over the same rows.

Nulls and empty texts have no words and so no hits. Null items and items without words have no windows. Rows that repeat
are each judged; item ids that repeat count once. Null item ids are left out of the list of items, but their windows hit. Item ids
may be of any type that can be ordered. Kept columns with the name of a result go.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import LOWER_BYTES, col, map_texts, others, words_of, work_dir

WINDOW = 10
#: Bytes of window text in one automaton, on average.
BLOCK_BYTES = 64_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

RUN = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
NAMES = ("n_words", "hits", "items")


def out_schema(item_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(RUN)), T.StructField("items", T.ArrayType(item_type))])


def windows_of(words: list[bytes], window: int = WINDOW) -> list[bytes]:
    """The windows of an item's words, with a space at both ends of each."""
    return [b" " + b" ".join(words[k : k + window]) + b" " for k in range(max(1, len(words) - window + 1) if words else 0)]


def _windows(window: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                found = [windows_of(words_of(t or b""), window) for t in part.column(1).cast(pa.binary()).to_pylist()]
                index = [i for i, f in enumerate(found) for _ in f]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index, pa.int64())), pa.array([w for f in found for w in f], pa.binary())], ["item", "window"])

    return run


def written_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int, path: str) -> int:
    """Distinct windows with their items, below `path` in a folder for each block; returns the number of blocks."""
    rows = benchmark.select(col(item_col).alias("item"), col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    schema = T.StructType([T.StructField("item", rows.schema["item"].dataType), T.StructField("window", T.BinaryType())])
    distinct = rows.mapInArrow(_windows(window), schema).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    distinct.write.parquet(f"{path}/windows")
    found = benchmark.sparkSession.read.schema(distinct.schema).parquet(f"{path}/windows")
    size = found.agg(F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    found.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(n))).repartition(min(n, 64), "block").write.partitionBy("block").parquet(f"{path}/blocks")
    return n


def patterns_at(path: str, block: int) -> dict[str, tuple[int, list]]:
    """A block's windows, as Latin-1 views of UTF-8 bytes, with their numbers of words and items."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    system, root = fs.FileSystem.from_uri(f"{path}/blocks/block={block}")
    files = [f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet")]
    found: dict[str, tuple[int, list]] = {}
    for file in files:
        with system.open_input_file(file) as f:
            table = pq.ParquetFile(f).read(columns=["window", "items"])
        for w, items in zip(table.column("window").to_pylist(), table.column("items").to_pylist(), strict=True):
            found[w.decode("latin-1")] = (w.count(b" ") - 1, items)
    return found


def scanner(patterns: dict[str, tuple[int, list]]):
    """A function from texts to the columns of out_schema()."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for pattern, value in patterns.items():
        automaton.add_word(pattern, value)
    if patterns:
        automaton.make_automaton()

    def scan(texts: list[bytes]) -> dict:
        out = {"n_words": [], "hits": [], "items": []}
        for text in texts:
            words = words_of(text)
            runs, items = [], set()
            line = b" " + b" ".join(words) + b" "
            found = list(automaton.iter(line.decode("latin-1"))) if patterns and words else []
            if found:
                spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                last = np.searchsorted(spaces, [end for end, _ in found])
                edge = np.zeros(len(words) + 1, np.int64)
                for stop, (_, (n, ids)) in zip(last.tolist(), found, strict=True):
                    edge[stop - n] += 1
                    edge[stop] -= 1
                    items.update(ids)
                runs = runs_of(np.cumsum(edge[:-1]) > 0)
                at = [m.span() for m in WORD.finditer(text.translate(LOWER_BYTES).decode())]
                runs = [{"first": a, "last": b - 1, "start": at[a][0], "end": at[b - 1][1]} for a, b in runs]
            out["n_words"].append(len(words))
            out["hits"].append(runs)
            out["items"].append(sorted(items))
        return out

    return scan


def runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of the true places."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns `keep` of docs (all but the text, if None), n_words, hits (runs of hit words, with code point offsets) and items."""
    keep = others(docs, text_col) if keep is None else keep
    keep = [c for c in keep if c not in NAMES]
    path = work_dir(docs.sparkSession)
    n_blocks = written_windows(benchmark, item_col, item_text_col, window, block_bytes, path)
    out = out_schema(benchmark.schema[item_col].dataType)
    if n_blocks == 1:
        return map_texts(docs, text_col, keep, out, lambda: scanner(patterns_at(path, 0)))
    # each block is a pass over the rows, which adds its hits to those of the blocks before
    kept = [f"__k{i}" for i in range(len(keep))]
    found = docs.select(*[col(c).alias(k) for c, k in zip(keep, kept, strict=True)], col(text_col).cast("string").alias("__text"))
    for n in range(n_blocks):
        before = [f"__hits{i}" for i in range(n)]
        copied = found.withColumn("__copy", F.col("__text"))
        found = map_texts(copied, "__text", [*kept, *before, "__copy"], out, lambda n=n: scanner(patterns_at(path, n)))
        found = found.withColumn(f"__hits{n}", F.struct(*NAMES)).drop(*NAMES).withColumnRenamed("__copy", "__text")
    every = [F.col(f"__hits{i}") for i in range(n_blocks)]
    runs = F.array_sort(F.flatten(F.array(*[h["hits"] for h in every])))

    def joined(done, r):
        """Runs that touch or overlap as one."""
        last = F.element_at(done, -1)
        one = F.struct(last["first"].alias("first"), F.greatest(last["last"], r["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (last["last"] + 1 >= r["first"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one))).otherwise(F.concat(done, F.array(r)))

    hits = F.aggregate(runs, F.array().cast(T.ArrayType(RUN)), joined)
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[h["items"] for h in every]))))
    return found.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], every[0]["n_words"].alias("n_words"), hits.alias("hits"), items.alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated per row of find()."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    rest = [c for c in found.columns if c not in NAMES]
    return found.select(*[col(c) for c in rest], "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
