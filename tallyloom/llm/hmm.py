r"""Hidden Markov language model of whole texts, beside an additively smoothed unigram base.

Tokens are runs of [^\x20\x09-\x0D] with A-Z lower-cased, then one end. Each token has a class: the TOP most frequent
training tokens have one each, others share SHAPES classes by their last two bytes. The model draws a state sequence, a class
from each state and a token from each class: log10 P(text) = log10 P(classes), which the scaled forward recursion computes
exactly, + the sum of log10 P(token | class), smoothed as the base is. Baum-Welch runs over all whole training texts (see
chains.py); each task adds up its expected counts, and their sums over the tasks make the next model. It ends when a round
gains less than GAIN (natural logarithm, for each token), after ROUNDS rounds at the latest.

Texts are taken in chunks of CHUNK tokens. A chunk's distinct tokens, not its tokens, are joined with the corpus counts, and
come back to the chunk as its dictionary, so neither a vocabulary nor a frequent token is ever gathered in one place.

Null and empty texts are one end. Rows with a null id are training rows. Repeated rows count and are scored each. Ids may be of
any type. Columns of the input other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.chains import Chains
from tallyloom.llm.common import col, mixed, remove, slices, token_hashes, work_dir, written

LOWER_SPACED = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
TOP, SHAPES = 4096, 256
STATES, ROUNDS, GAIN = 8, 4, 0.002
CHUNK = 1_500_000
CALL_BYTES = 1_000_000
#: Tokens of whole texts that a recursion is called for, unless a single text is longer; it holds a part of them at a time.
CALL_TOKENS = 1_000_000
END = np.uint64(1)
CLASSES = TOP + SHAPES


def tokens_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("token", T.LongType()),  # of the chunk's dictionary, else null
            T.StructField("local", T.IntegerType()),
            T.StructField("shape", T.IntegerType()),
            T.StructField("n_train", T.LongType()),
            T.StructField("id", id_type),  # of its texts, else null
            T.StructField("held_out", T.BooleanType()),
            T.StructField("ids", T.BinaryType()),  # local numbers in four planes of bytes, low ones first; null in the dictionary
        ]
    )


def coded_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", id_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_sum", T.DoubleType()), T.StructField("word_sum", T.DoubleType()), T.StructField("classes", T.BinaryType())])


def shapes_of(last: np.ndarray) -> np.ndarray:
    """Shape numbers from the last two bytes."""
    return (mixed(last + np.uint64(77)) % np.uint64(SHAPES)).astype(np.int32)


def last_bytes(texts: list[bytes]) -> np.ndarray:
    """The last two bytes of each token, as one number; 0 stands for a missing byte."""
    data = np.frombuffer(b" " + b" ".join(texts).translate(LOWER_SPACED) + b" ", np.uint8)
    ends = np.flatnonzero((data[1:] == 32) & (data[:-1] != 32))
    before = data[ends - 1].astype(np.uint64)
    return np.where(before == 32, 0, before).astype(np.uint64) * np.uint64(256) + data[ends].astype(np.uint64)


def _tokenize(schema: T.StructType):
    """Dictionary rows and text rows of each chunk."""

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        types = {f.name: to_arrow_type(f.dataType) for f in schema}
        part, n_chunks, size = TaskContext.get().partitionId(), 0, 0
        held: list = []  # (ids, held_out, tokens, lasts, counts)

        def rows(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([(columns[f] if isinstance(columns[f], pa.Array) else pa.array(columns[f], t)) if f in columns else pa.nulls(n, t) for f, t in types.items()], list(types))

        def flush():
            chunk = part * 1_000_000 + n_chunks
            ids, out = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
            tokens, lasts, counts = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4))
            held.clear()
            words, first, place = np.unique(tokens, return_index=True, return_inverse=True)
            lasts, place = lasts[first], place.astype(np.int32)
            del tokens, first
            order = np.argsort(-np.bincount(place), kind="stable")  # frequent ones get small numbers, whose high bytes are zero
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            n_train = np.bincount(place[np.repeat(~out, counts)], minlength=len(words))[order]
            local = rank[place]
            del place
            words, shape = words[order], shapes_of(lasts)[order]
            for lo in range(0, len(words), 50_000):
                n = len(words[lo : lo + 50_000])
                yield rows(n, chunk=np.full(n, chunk), token=words[lo : lo + n].view(np.int64), local=np.arange(lo, lo + n, dtype=np.int32), shape=shape[lo : lo + n], n_train=n_train[lo : lo + n])
            planes, ends = local.view(np.uint8).reshape(-1, 4), np.cumsum(counts)
            for a, b in slices((4 * counts).tolist(), 4_000_000):
                bodies = [planes[e - c : e].T.tobytes() for c, e in zip(counts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                yield rows(b - a, chunk=np.full(b - a, chunk), id=ids.slice(a, b - a), held_out=out[a:b], ids=bodies)

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lo, hi in slices([len(t) if t else 0 for t in texts.to_pylist()], CALL_BYTES):
                part_texts = [t or b"" for t in texts.slice(lo, hi - lo).to_pylist()]
                tokens, counts = token_hashes(part_texts, LOWER_SPACED)
                ends = np.cumsum(counts)
                held.append((batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool), np.insert(tokens, ends, END), np.insert(last_bytes(part_texts), ends, 0), counts + 1))
                size += len(tokens) + len(counts)
                if size >= CHUNK:
                    yield from flush()
                    n_chunks, size = n_chunks + 1, 0
        if held:
            yield from flush()
        pa.default_memory_pool().release_unused()

    return run


def _coder(schema: T.StructType, total: int, distinct: int, shape_total: list[int], shape_distinct: list[int]):
    """Over rows sorted by chunk, each chunk's dictionary (local, count, cls) before its texts: sums of log10 probabilities and class sequences."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema]
        n_shape, v_shape = np.array(shape_total), np.array(shape_distinct)
        chunk, words, tables = None, [], None

        def dictionary():
            """Arrays by local number: base and word log10 probabilities, whether known, class."""
            local, count, cls = (np.concatenate([w[k] for w in words]) for k in range(3))
            by = np.empty(len(local), np.int64)
            by[local] = np.arange(len(local))
            count, cls = count[by].astype(float), cls[by].astype("<u2")
            shape = np.maximum(cls.astype(np.int64) - TOP, 0)
            logs = np.log10(count + 0.1)
            word = np.where(cls < TOP, 0.0, logs - np.log10(n_shape[shape] + 0.1 * (v_shape[shape] + 1)))
            return logs - np.log10(total + 0.1 * (distinct + 1)), word, count > 0, cls

        for batch in batches:
            chunks = batch.column(0).to_numpy()
            is_text = batch.column(batch.num_columns - 1).is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate(([True], (chunks[1:] != chunks[:-1]) | (is_text[1:] != is_text[:-1]), [True])))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = batch.slice(lo, hi - lo)
                if chunks[lo] != chunk:
                    chunk, words, tables = chunks[lo], [], None
                if not is_text[lo]:
                    words.append([part.column(c).to_numpy() for c in (1, 2, 3)])
                    continue
                if tables is None:
                    tables, words = dictionary(), []
                base, word, known, cls = tables
                out: list[list] = [[], [], [], [], []]
                for body in part.column(6).to_pylist():
                    p = np.frombuffer(body, np.uint8).reshape(4, -1)
                    ids = np.ascontiguousarray(p.T).view("<u4").ravel()
                    for o, v in zip(out, (len(ids), int(known[ids].sum()), float(base[ids].sum()), float(word[ids].sum()), cls[ids].tobytes()), strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([part.column(4), part.column(5), *(pa.array(o, t) for o, t in zip(out, types[2:], strict=True))], schema.names)

    return run


# ---- the model over classes ----


def first_model(frequency: np.ndarray, states: int = STATES, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    emit = (frequency + 1.0) * rng.gamma(2.0, 0.5, (states, len(frequency)))
    trans = np.full((states, states), 0.5 / states) + 0.5 * np.eye(states)
    return {"start": np.full(states, 1 / states), "trans": trans, "emit": emit / emit.sum(1, keepdims=True)}


def next_model(counts: np.ndarray, states: int, classes: int) -> dict:
    """The model that maximises the expected log-likelihood, with a little added to every count."""
    start, trans, emit = np.split(counts, [states, states + states * states])
    norm = lambda x, a: (x + a) / (x + a).sum(-1, keepdims=True)
    return {"start": norm(start, 0.1), "trans": norm(trans.reshape(states, states), 0.1), "emit": norm(emit.reshape(states, classes), 0.01)}


def chains(sequences: list[np.ndarray], model: dict, kind=np.float64) -> tuple[np.ndarray, Chains]:
    """The classes of all sequences, one after the other, and their chains, at the precision `kind`."""
    flat = np.concatenate(sequences)
    emit = np.ascontiguousarray(model["emit"].T, kind)
    return flat, Chains(np.array([len(s) for s in sequences]), lambda at: emit[flat[at]], model["start"], model["trans"])


def forward(sequences: list[np.ndarray], model: dict) -> np.ndarray:
    """log10 P(sequence) of each."""
    return chains(sequences, model)[1].log_sums() / np.log(10)


def expected_counts(sequences: list[np.ndarray], model: dict) -> np.ndarray:
    """Baum-Welch counts of starts, transitions and emissions, then the log-likelihood and the number of tokens, flat."""
    flat, of = chains(sequences, model, np.float32)
    k, classes = model["emit"].shape
    starts, steps, emits, log = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes)), 0.0
    for at, share, first, moves, z in of.marginals():
        starts, steps, log = starts + first, steps + moves, log + z
        here = flat[at]
        for s in range(k):
            emits[s] += np.bincount(here, share[:, s], classes)
    return np.concatenate((starts, steps.ravel(), emits.ravel(), [log, len(flat)]))


def _calls(bodies, most: int = CALL_TOKENS):
    """Lists of whole sequences of `most` tokens or so, from class bytes."""
    group, size = [], 0
    for body in bodies:
        group.append(np.frombuffer(body, "<u2"))
        size += len(group[-1])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _expect(model: dict):
    def run(batches):
        total = 0.0
        for group in _calls(body.as_py() for batch in batches for body in batch.column(0)):
            total = total + expected_counts(group, model)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])
        pa.default_memory_pool().release_unused()

    return run


def _score(model: dict):
    def run(batches):
        for batch in batches:
            scores = [forward(group, model) for group in _calls(body.as_py() for body in batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*batch.schema.names[:-1], "class_score"])
        pa.default_memory_pool().release_unused()

    return run


def train(coded: DataFrame, frequency: np.ndarray, states: int = STATES, rounds: int = ROUNDS, gain: float = GAIN) -> dict:
    """Baum-Welch over the class sequences of the training rows, until a round's gain is below `gain` for each token."""
    model = first_model(frequency, states)
    size = states + states * states + states * CLASSES + 2
    sequences = coded.where("not held_out").select("classes")
    before = -np.inf
    for _ in range(rounds):
        sums = sequences.mapInArrow(_expect(model), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # `size` rows at most
        if not sums.num_rows:
            break
        counts = np.zeros(size)
        counts[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
        model = next_model(counts[:-2], states, CLASSES)
        mean = counts[-2] / counts[-1]
        if mean - before < gain:
            break
        before = mean
    return model


def held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, work: str | None = None) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs."""
    spark = docs.sparkSession
    top = work or work_dir(spark)
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).select("id", held_out("id").alias("held_out"), "text")
    schema, coded_as = tokens_schema(rows.schema["id"].dataType), coded_schema(rows.schema["id"].dataType)
    tokens = written(rows.mapInArrow(_tokenize(schema), schema), f"{top}/tokens")
    words = tokens.where("ids is null")
    counts = written(words.groupBy("token").agg(F.sum("n_train").alias("count"), F.max("shape").alias("shape")).where("count > 0"), f"{top}/counts")

    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    common = [(r.token, r["count"]) for r in counts.orderBy(F.desc("count"), "token").limit(TOP).select("token", "count").collect()]
    number = spark.createDataFrame([(t, i) for i, (t, _) in enumerate(common)], "token long, top int")  # TOP rows
    rare = counts.join(F.broadcast(number), "token", "left_anti").groupBy("shape").agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect()  # SHAPES rows
    shape_total, shape_distinct = [0] * SHAPES, [0] * SHAPES
    for s, n, v in rare:
        shape_total[s], shape_distinct[s] = n, v
    frequency = np.array([c for _, c in common] + [0] * (TOP - len(common)) + shape_total, float)

    cls = F.coalesce("top", F.col("shape") + TOP)
    entries = words.select("chunk", "token", "local", "shape").join(counts.select("token", "count"), "token", "left").join(F.broadcast(number), "token", "left")
    entries = entries.select("chunk", "local", F.coalesce("count", F.lit(0)).alias("count"), cls.alias("cls"))
    texts = spark.read.schema(schema).parquet(f"{top}/tokens").where("ids is not null").select("chunk", "id", "held_out", "ids")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = entries.unionByName(texts, allowMissingColumns=True).repartition(parts, "chunk").sortWithinPartitions("chunk", F.col("ids").isNotNull())
    coded = written(both.select("chunk", "local", "count", "cls", "id", "held_out", "ids").mapInArrow(_coder(coded_as, total, distinct, shape_total, shape_distinct), coded_as), f"{top}/coded")
    remove(spark, top, "tokens", "counts")

    model = train(coded, frequency, states, rounds)
    scored = coded.mapInArrow(_score(model), T.StructType([*coded_as.fields[:-1], T.StructField("class_score", T.DoubleType())]))
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), F.col("base_sum").alias("base_score"), (F.col("class_score") + F.col("word_sum")).alias("score"))
