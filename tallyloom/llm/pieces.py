"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

A text gets a space in front, and spaces become U+2581, as the model's pieces have it. The lattice of a text has an edge for
each piece that stands in it; characters that no piece spells are edges of their byte pieces, and so is a literal U+2581, which
keeps decoding lossless. A path's probability is in proportion to exp of its pieces' weights: forward filtering sums over all
paths to each place, backward sampling draws the last piece, then the one before it. Draws are hashes of the row key, the
unit's number and the step, so a row has the same sample wherever and however often it is encoded.

The lattice falls apart at line ends and before runs of spaces, which no piece crosses (a model with other pieces is refused),
and at no other place. Equal units of up to LONG characters share one lattice. Those of more are filtered and sampled one by
one, with only the sums held for each character. Null texts have null ids and decode to null, empty texts have none. A null
row key is a key of its own. Repeated rows have equal samples. Kept columns with the name of a result go.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import col, mixed, others, prefix_hashes, slices, span_hashes

MODEL = "piece_bpe_32k.model"
#: Characters of a unit whose lattice is built as a table.
LONG = 256
#: Inverse temperature: at 0 all paths are alike, with more the likelier pieces win.
ALPHA = 1.0
CALL_BYTES = 600_000
#: Units of one lattice batch, and units whose lattices a task keeps.
UNITS, POOL = 100_000, 60_000
_MARK = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The pieces of a model with a weight for each; of BPE models, whose scores are ranks, by Zipf's law."""

    def __init__(self, path: str, alpha: float = ALPHA) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.spelled: dict[str, int] = {}
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = [0] * 256
        scores = np.zeros(n)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b], self.bytes_of[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.spelled[piece.replace(_MARK, " ")] = i
                self.bytes_of[i] = piece.replace(_MARK, " ").encode()
            scores[i] = sp.get_score(i)
        for piece in self.spelled:
            if "\n" in piece[1:] or piece[:1] == "\n" != piece or " " in piece.lstrip(" "):
                raise ValueError(f"{piece!r} crosses white space")
        plain = scores[list(self.spelled.values())]
        ranks = bool((plain == np.round(plain)).all())
        weights = -alpha * np.log(2.0 - scores) if ranks else alpha * scores
        self.byte_weight = float(weights[list(self.spelled.values())].min()) - 1.0
        self.longest = max(len(p) for p in self.spelled)
        self.edges = {p: (i, float(weights[i])) for p, i in self.spelled.items()}
        self._trie(weights)

    def _trie(self, weights: np.ndarray) -> None:
        """The pieces' beginnings as nodes; steps from node to node by a character are in a table with open addressing."""
        steps: dict[int, int] = {}
        ends = {}
        for piece, i in self.spelled.items():
            node = 0
            for ch in piece:
                node = steps.setdefault(node << 21 | ord(ch), len(steps) + 1)
            ends[node] = i
        self.piece_at = np.full(len(steps) + 1, -1, np.int32)
        self.piece_at[list(ends)] = list(ends.values())
        self.weight_at = np.where(self.piece_at >= 0, weights[self.piece_at], 0).astype(np.float32)
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        for slot, key, node in zip(self._slots(np.array(list(steps), np.int64)).tolist(), steps, steps.values(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.nodes[slot] = key, node

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to, -1 where no piece goes on so."""
        key = nodes << 21 | points
        slot = self._slots(key)
        there = self.keys[slot]
        out = np.where(there == key, self.nodes[slot], -1)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.nodes[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


def lattice(units: list[str], pieces: Pieces):
    """For each character of each unit: cumulative probabilities of the length of the piece that ends there, and the ids.

    An id of -2 stands for the byte pieces of one character."""
    lengths = np.array([len(u) for u in units], np.int64)
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    n, most, width = len(points), min(pieces.longest, int(lengths.max(initial=1))), pieces.longest
    ends = np.cumsum(lengths)
    ids = np.full((n, width), -1, np.int32)
    weight = np.full((most, n), -np.inf, np.float32)
    # all places of all units walk the pieces side by side, as long as some piece goes on
    wide, at, node = points.astype(np.int64), np.arange(n), np.zeros(n, np.int64)
    stop = np.repeat(ends, lengths)
    for size in range(1, most + 1):
        node = pieces.step(node, wide[at + size - 1])
        on = np.flatnonzero(node >= 0)
        at, node = at[on], node[on].astype(np.int64)
        piece = pieces.piece_at[node]
        whole = np.flatnonzero(piece >= 0)
        to = at[whole] + size - 1
        ids[to, size - 1] = piece[whole]
        weight[size - 1, to] = pieces.weight_at[node[whole]]
        on = np.flatnonzero(at + size < stop[at])
        at, node = at[on], node[on]
        if not len(at):
            break
    bare = np.flatnonzero((ids[:, 0] < 0) | (points == ord(_MARK)))
    ids[bare, 0] = -2
    weight[0, bare] = _utf8_size(points[bare]) * pieces.byte_weight
    # forward filtering, all units at once, place by place
    order = np.argsort(-lengths, kind="stable")
    begin, count = (ends - lengths)[order], lengths[order]
    sums = np.zeros((most, len(units)), np.float32)  # log sums of the last places, a ring of `most`
    share = np.full((n, width), 2.0, np.float32)
    for p in range(int(lengths.max(initial=0))):
        alive = int(np.searchsorted(-count, -p, "left"))
        at = begin[:alive] + p
        x = []
        for size in range(1, min(p + 1, most) + 1):
            w = weight[size - 1, at]
            x.append(w if size == p + 1 else w + sums[(p - size) % most, :alive])
        top = x[0]
        for v in x[1:]:
            top = np.maximum(top, v)
        total, upto = 0.0, []
        for v in x:
            total = total + np.exp(v - top)
            upto.append(total)
        sums[p % most, :alive] = top + np.log(total)
        for k, c in enumerate(upto):
            share[at, k] = c / total
    return ends, points, ids, share


def _utf8_size(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


def sample(which: np.ndarray, seeds: np.ndarray, made, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Draws a path for each unit occurrence: all ids one after the other, and how many each occurrence has."""
    ends, points, ids, share = made
    starts = np.concatenate(([0], ends[:-1]))
    flat, width = share.ravel(), share.shape[1]
    floor, at = starts[which], ends[which] - 1
    done = np.zeros(len(which), np.int64)
    live = np.arange(len(which))
    drawn = []
    step = 0
    while len(live):
        u = (mixed(seeds[live] + np.uint64(step * 0x51ED270B2F1D)) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
        j = at[live]
        size, cell, beyond = np.zeros(len(live), np.int64), j * width, np.arange(len(live))
        while len(beyond):  # the first length whose cumulative probability is above u
            beyond = beyond[flat[cell[beyond] + size[beyond]] <= u[beyond]]
            size[beyond] += 1
        piece = ids[j, size]
        n = np.where(piece == -2, _utf8_size(points[j]), 1)
        done[live] += n
        drawn.append((live, piece, n, done[live], points[j]))
        at[live] -= size + 1
        live = live[at[live] >= floor[live]]
        step += 1
    base = np.cumsum(done) - done
    out = np.empty(int(done.sum()), np.int32)
    byte_ids = np.array(pieces.byte_ids, np.int32)
    for live, piece, n, past, point in drawn:
        to = base[live] + done[live] - past
        plain = piece >= 0
        out[to[plain]] = piece[plain]
        k = np.flatnonzero(~plain)
        if len(k):
            spelled = np.frombuffer(b"".join(chr(c).encode() for c in point[k].tolist()), np.uint8)
            first = np.cumsum(n[k]) - n[k]
            spread = np.repeat(to[k] - first, n[k]) + np.arange(len(spelled))
            out[spread] = byte_ids[spelled]
    return out, done


def long_sample(unit: str, seed: int, pieces: Pieces) -> list[int]:
    """The ids of a path of one unit of any length. Each character keeps its log sum only; its edges are found again on the way back."""

    def edges(p: int):
        for size in range(1, min(pieces.longest, p) + 1):
            part = unit[p - size : p]
            hit = pieces.edges.get(part)
            if size == 1 and (hit is None or part == _MARK):
                own = part.encode()
                yield 1, [pieces.byte_ids[b] for b in reversed(own)], sums[p - 1] + len(own) * pieces.byte_weight
            elif hit is not None:
                yield size, hit[:1], sums[p - size] + hit[1]

    sums = np.zeros(len(unit) + 1)
    for p in range(1, len(unit) + 1):
        logs = [w for _, _, w in edges(p)]
        top = max(logs)
        sums[p] = top + math.log(sum(math.exp(w - top) for w in logs))
    back: list[int] = []
    p, step, draws = len(unit), 0, np.zeros(0)
    while p:
        if step % 4096 == 0:
            draws = (mixed(np.uint64(seed) + np.arange(step, step + 4096, dtype=np.uint64) * np.uint64(0x51ED270B2F1D)) >> np.uint64(40)) / float(1 << 24)
        left = draws[step % 4096]
        for size, own, w in edges(p):
            left -= math.exp(w - sums[p])
            last = size, own
            if left < 0:
                break
        back += last[1]
        p, step = p - last[0], step + 1
    return back[::-1]


def units_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct units of texts (a space is put in front of those that are not empty), the unit at each place, and each text's number of places."""
    data = np.frombuffer(b"".join(b" " + t if t else b"" for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    line, space = data == 10, data == 32
    first = line.copy()  # line ends are units; so is what follows one, and a run of spaces with the characters behind it
    first[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    bounds = np.cumsum(sizes)
    first[(bounds - sizes)[sizes > 0]] = True
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], bounds))))
    ends = np.append(starts[1:], len(data))[: len(starts)]
    _, one, which = np.unique(span_hashes(prefix_hashes(data), starts, ends), return_index=True, return_inverse=True)
    body = data.tobytes()
    # equal hashes are verified on the bytes
    shift = starts[one][which] - starts
    if not ((ends - starts) == (ends - starts)[one][which]).all() or not (data[np.arange(len(data)) + np.repeat(shift, ends - starts)] == data).all():
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(body[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        return list(number), which, counts
    return [body[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], which, counts


class Lattices:
    """Lattices of units. Those of up to POOL units that came up more than once are kept for later calls."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.number: dict[bytes, int] = {}
        self.n_points = 0
        self.kept = [np.zeros(POOL, np.int64), *(np.zeros((1 << 16, *x.shape[1:]), x.dtype) for x in lattice([], pieces)[1:])]

    def draw(self, units: list[bytes], which: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a path for each occurrence units[which], one after the other, and how many each has."""
        used, place, times = np.unique(which, return_inverse=True, return_counts=True)
        known = np.array([self.number.get(units[k], -1) for k in used.tolist()], np.int64)
        new = np.flatnonzero(known < 0)
        texts = [units[k].decode() for k in used[new].tolist()]
        long_ = np.array([len(t) > LONG for t in texts], bool)
        fresh = np.full(len(used), -1, np.int64)
        short = new[~long_]
        fresh[short] = np.arange(len(short))
        made = lattice([t for t, many in zip(texts, long_.tolist(), strict=True) if not many], self.pieces)
        parts = []
        for index, lattices in ((known, self.kept), (fresh, made)):
            at = np.flatnonzero(index[place] >= 0)
            parts.append((at, *sample(index[place[at]], seeds[at], lattices, self.pieces)))
        if long_.any():
            text_of = dict(zip(new[long_].tolist(), (t for t, many in zip(texts, long_.tolist(), strict=True) if many), strict=True))
            at = np.flatnonzero(np.isin(place, new[long_]))
            paths = [long_sample(text_of[k], s, self.pieces) for k, s in zip(place[at].tolist(), seeds[at].tolist(), strict=True)]
            parts.append((at, np.array([i for path in paths for i in path], np.int32), np.array([len(path) for path in paths], np.int64)))
        counts = np.zeros(len(which), np.int64)
        for at, _, n in parts:
            counts[at] = n
        base = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for at, ids, n in parts:
            out[np.repeat(base[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        self._keep([units[k] for k in used[short].tolist()], np.flatnonzero(times[short] > 1), made)
        return out, counts

    def _keep(self, units: list[bytes], which: np.ndarray, made) -> None:
        which = which[: POOL - len(self.number)]
        if not len(which):
            return
        ends = made[0]
        size = np.diff(ends, prepend=0)[which]
        at = np.repeat(ends[which] - np.cumsum(size), size) + np.arange(int(size.sum()))
        need = self.n_points + len(at)
        for k in (1, 2, 3):
            if need > len(self.kept[k]):
                self.kept[k] = np.concatenate((self.kept[k], np.zeros((max(need, 2 * len(self.kept[k])) - len(self.kept[k]), *self.kept[k].shape[1:]), self.kept[k].dtype)))
            self.kept[k][self.n_points : need] = made[k][at]
        first = len(self.number)
        self.kept[0][first : first + len(which)] = self.n_points + np.cumsum(size)
        self.number.update(zip((units[k] for k in which.tolist()), range(first, first + len(which)), strict=True))
        self.n_points = need


def encode_texts(texts: list[bytes], keys: list[str], pieces: Pieces, seed: int = 0, lattices: Lattices | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, one text after the other, and the number of each text's ids."""
    lattices = lattices or Lattices(pieces)
    units, which, sizes = units_of(texts)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seeds = np.array([xxhash.xxh64_intdigest(k.encode(), seed) for k in keys], np.uint64)[text_of] + inner.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    out, done = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for lo in range(0, len(which), UNITS):
        ids, each = lattices.draw(units, which[lo : lo + UNITS], mixed(seeds[lo : lo + UNITS]))
        out.append(ids)
        done.append(each)
    return np.concatenate(out), np.bincount(text_of, np.concatenate(done), len(texts)).astype(np.int64)


def spell(ids: np.ndarray, bytes_of: list[bytes]) -> bytes:
    """The text of ids, without the space in front."""
    return b"".join(map(bytes_of.__getitem__, ids.tolist()))[1:]


def encode(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, model: str | None = None, alpha: float = ALPHA, seed: int = 0, out_col: str = "ids", check_col: str | None = None) -> DataFrame:
    """The columns `keep` of docs (all but the text, if None) and out_col: the ids of a sampled segmentation.

    With check_col, each row's ids are decoded again in the task, and it says whether that gave the text (null for null texts)."""
    kept = [c for c in (others(docs, text_col) if keep is None else keep) if c not in (out_col, check_col)]
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(model or model_path(), alpha))  # the model's pieces, of fixed size
    src = docs.select(*[col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.coalesce(col(key_col).cast("string"), F.lit("\0null")).alias("key"), col(text_col).cast("string").alias("t"))
    schema = T.StructType([*src.schema.fields[: len(kept)], T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("same", T.BooleanType())] if check_col else [])])
    names = schema.names

    def run(batches):
        p = pieces.value
        lattices = Lattices(p)
        for batch in batches:
            column, keys = batch.column(len(kept) + 1).cast(pa.binary()), batch.column(len(kept))
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for lo, hi in slices(sizes, CALL_BYTES):
                texts = column.slice(lo, hi - lo).to_pylist()
                ids, counts = encode_texts([t or b"" for t in texts], keys.slice(lo, hi - lo).to_pylist(), p, seed, lattices)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                null = np.array([t is None for t in texts] + [False])
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=null) if null.any() else pa.array(offsets), pa.array(ids))
                check = [pa.array([None if t is None else spell(ids[a:b], p.bytes_of) == t for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)], pa.bool_())] if check_col else []
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(kept))), lists, *check], names)

    got = src.mapInArrow(run, schema)
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.col("ids").alias(out_col), *([F.col("same").alias(check_col)] if check_col else []))


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str | None = None) -> DataFrame:
    """rows with out_col, the text that ids_col spells, in place of a column of that name."""
    kept = [c for c in rows.columns if c != out_col]
    bytes_of = rows.sparkSession.sparkContext.broadcast(Pieces(model or model_path()).bytes_of)
    src = rows.select(*[col(c).alias(f"k{i}") for i, c in enumerate(kept)], col(ids_col).cast("array<int>").alias("ids"))
    schema = T.StructType([*src.schema.fields[: len(kept)], T.StructField("decoded", T.StringType())])
    names = schema.names

    def run(batches):
        for batch in batches:
            lists = batch.column(len(kept))
            offsets, values, valid = lists.offsets.to_pylist(), lists.values, lists.is_valid().to_pylist()
            texts = [spell(values.slice(a, b - a).to_numpy(zero_copy_only=False), bytes_of.value).decode() if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names)

    return src.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.col("decoded").alias(out_col))
