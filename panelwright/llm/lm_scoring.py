"""Language-model scores by online logistic context mixing.

A text's bytes, with an end mark, are told as binary decisions of a Huffman tree over bytes. Several predictors each give
the probability of a decision from counts of the training corpus, under a hash of their context: the last two bytes, the
last four, the word so far. Their logits are added with weights chosen by a gate (the decision's depth), and the sum's
probability is refined by a table of what became of like predictions. Weights and table start the same for every text and
adapt as the text is read, after every few bytes, so a text's score depends on it and the corpus alone. A long text is read
piece by piece with weights, table and the bytes before each piece carried on; only a word that a piece's border cuts, one of
over a hundred thousand bytes, is two words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import byte_steps, return_memory, written

CONTEXTS = 3
_BITS = (20, 21, 22)  # a predictor has two to the power of these slots
_OFFSETS = tuple(np.cumsum([0, *(1 << b for b in _BITS)]).tolist())
_BLOCK = 1 << 15
_GATES = 8
_BINS = 24
#: Bytes between two adaptations, in a text's beginning and after it.
_CHUNK, _LATER, _BEGINNING = 64, 512, 4096
_PRIME = np.uint64(0x9E3779B97F4A7C15)
END = 0
#: A text of more than twice as many bytes is read in pieces of about as many.
_STEP = 1 << 17
#: Bytes of texts that are read side by side.
_SIDE = 1 << 18
#: Bytes whose contexts are counted at once.
_COUNT_STEP = 1 << 20
#: Bytes of text whose tokens are told apart at once.
_TOKEN_STEP = 1 << 22
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass
class Tree:
    """Per byte: number of decisions, where they start in ``node`` (hash of the inner node), ``bit`` and ``depth``."""

    size: np.ndarray
    start: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    depth: np.ndarray


def huffman(counts: np.ndarray) -> Tree:
    """Tree over all 256 bytes, by counts; ties by the smaller byte."""
    heap = [(int(n) + 1, k, k) for k, n in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    following = 256
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        parent[left], parent[right] = (following, 0), (following, 1)
        heapq.heappush(heap, (a + b, following, following))
        following += 1
    paths = []
    for k in range(256):
        path, at = [], k
        while at in parent:
            at, bit = parent[at]
            path.append((at - 256, bit))
        paths.append(path[::-1])
    size = np.array([len(p) for p in paths])
    flat = [x for p in paths for x in p]
    depth = np.concatenate([np.arange(n) for n in size])
    return Tree(size, np.cumsum(size) - size, np.array([(n * 0xD6E8FEB86659FD93 % (1 << 64)) >> 32 for n, _ in flat], np.uint32), np.array([b for _, b in flat], np.int8), depth)


@dataclass
class Part:
    """A text, or a piece of a long one: its bytes, those of the text just before it, and where in the text it starts."""

    row: int
    body: bytes
    before: bytes
    start: int


def _parts(texts: list[str | None]) -> Iterator[list[Part]]:
    """Parts in steps of about ``_SIDE`` bytes, the longest first. Pieces of a long text are steps of their own, in order."""
    held: list[Part] = []
    size = 0
    for k, text in enumerate(texts):
        raw = (text or "").encode().translate(_LOWER)
        if len(raw) > 2 * _STEP:
            yield from ([part] for part in _pieces(k, raw))
            continue
        if held and size + len(raw) > _SIDE:
            yield sorted(held, key=lambda p: -len(p.body))
            held, size = [], 0
        held.append(Part(k, raw + b"\0", b"", 0))
        size += len(raw) + 64
    if held:
        yield sorted(held, key=lambda p: -len(p.body))


def _pieces(row: int, raw: bytes) -> Iterator[Part]:
    """Pieces that end behind a space, or after twice the usual length where there is none."""
    start = 0
    while start < len(raw):
        end = start + _STEP
        if end >= len(raw):
            yield Part(row, raw[start:] + b"\0", raw[max(0, start - 4) : start], start)
            return
        space = raw.find(b" ", end, end + _STEP)
        end = min(len(raw), end + _STEP) if space < 0 else space + 1
        yield Part(row, raw[start:end] + (b"\0" if end == len(raw) else b""), raw[max(0, start - 4) : start], start)
        start = end


def _read(parts: list[Part]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bytes of the parts, the number of each, and each predictor's context, also over what stands before a part."""
    lengths, before = np.array([len(p.body) for p in parts], np.int64), np.array([len(p.before) for p in parts], np.int64)
    data = np.frombuffer(b"".join(p.before + p.body for p in parts), np.uint8)
    contexts = _contexts(data, before + lengths)
    if before.any():
        inside = np.repeat(np.tile([False, True], len(parts)), np.stack((before, lengths), 1).ravel())
        data, contexts = data[inside], [c[inside] for c in contexts]
    return data, lengths, contexts


def _contexts(data: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Hash of each predictor's context, by byte; contexts end at the text's start."""
    n = len(data)
    starts = np.cumsum(lengths) - lengths
    wide = data.astype(np.uint32)
    two, four = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for k in range(4):
        back = np.zeros(n, np.uint32)
        back[k + 1 :] = wide[: n - k - 1]
        for j in range(k + 1):
            back[starts[lengths > j] + j] = 0
        back <<= np.uint32(8 * k)
        four += back
        if k < 2:
            two += back
    # The word so far: a polynomial of its bytes, taken from running sums.
    space = _SPACE[data]
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((wide + np.uint32(1)) * power, out=total[1:])
    begin = np.concatenate(([0], np.flatnonzero(space[:-1]) + 1)) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begin, n))
    word = (total[:n] - np.repeat(total[begin], sizes)) * np.repeat(inverse[begin], sizes) + np.uint64(2 << 40)
    return [_mixed(two.astype(np.uint64)), _mixed(four + np.uint64(1 << 40)), _mixed(word)]


_SPACE = np.isin(np.arange(256), [END, 9, 10, 11, 12, 13, 32])
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the prime and of its inverse, kept for the usual step."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 3 * _STEP)
        _POWERS[:] = [np.cumprod(np.full(size, p, np.uint64)) for p in (_PRIME, np.uint64(pow(int(_PRIME), -1, 1 << 64)))]
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _PRIME
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(32)
    return h.astype(np.uint32)


def _decisions(tree: Tree, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of decisions by byte, index into the tree's lists of every decision)."""
    size = tree.size[data]
    spot = np.repeat((tree.start[data] - np.cumsum(size) + size).astype(np.int32), size)
    spot += np.arange(len(spot), dtype=np.int32)
    return size, spot


def _slots(k: int, context: np.ndarray, size: np.ndarray, spread: np.ndarray) -> np.ndarray:
    h = np.repeat(context, size)
    h += spread
    h >>= np.uint32(32 - _BITS[k])
    return h.astype(np.int64)


def _keys(context: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Context and byte in one number."""
    keys = context.astype(np.uint64)
    keys <<= np.uint64(8)
    keys |= data
    return keys


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Whether each of the sorted numbers differs from the one before it."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


def _add_counts(total: np.ndarray, tree: Tree, found: list[np.ndarray]) -> None:
    """Add the decisions of all keys, by predictor, to ``total``. Contexts and bytes recur, so equal ones are told apart
    into decisions once, with their number."""
    for k, keys in enumerate(found):
        keys.sort()
        first = np.flatnonzero(_runs(keys))
        times = np.diff(np.append(first, len(keys))).astype(np.int32)
        for low in range(0, len(first), _STEP):
            some = keys[first[low : low + _STEP]]
            size, spot = _decisions(tree, (some & np.uint64(255)).astype(np.int64))
            slot = _slots(k, (some >> np.uint64(8)).astype(np.uint32), size, tree.node[spot])
            slot *= 2
            slot += tree.bit[spot]
            np.add.at(total[2 * _OFFSETS[k] : 2 * _OFFSETS[k + 1]], slot, np.repeat(times[low : low + _STEP], size))


def _single(half: np.ndarray) -> np.ndarray:
    """Finite numbers of half precision in single precision, by shifting their bits: several times as fast as a cast."""
    bits = half.view(np.int16).astype(np.int32)
    bits <<= 13
    bits &= ~0x70000000  # the sign had spread over the exponent's upper bits
    out = bits.view(np.float32)
    out *= np.float32(2.0**112)
    return out


def _packed(counts: np.ndarray) -> bytes:
    """Counts compressed with their low bytes first, then the next ones: most counts are small."""
    return pa.compress(counts.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * _BLOCK, codec="zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)


def byte_counts(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, total = np.zeros(1 << 16, np.int64), np.zeros(256, np.int64)
        for batch in batches:
            for start, rows in byte_steps(batch.column("text"), _TOKEN_STEP):
                raw = np.frombuffer(b"".join(batch.column("text").slice(start, rows).cast(pa.binary()).drop_null().to_pylist()), np.uint8)
                for low in range(0, len(raw) // 2 * 2, _STEP):  # two bytes at a time
                    pairs += np.bincount(raw[low : min(low + _STEP, len(raw) // 2 * 2)].view(np.uint16), minlength=1 << 16)
                total += np.bincount(raw[len(raw) // 2 * 2 :], minlength=256)
                total[END] += rows
        total += pairs.reshape(256, 256).sum(0) + pairs.reshape(256, 256).sum(1)
        upper = slice(ord("A"), ord("Z") + 1)
        total[ord("a") : ord("z") + 1] += total[upper]
        total[upper] = 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])

    out = np.zeros(256, np.int64)
    for r in docs.select("text").mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out


def context_logits(docs: DataFrame, tree: Tree) -> np.ndarray:
    """Logit of a set bit, by predictor and slot, from all decisions of all texts of ``docs``.

    A task counts into a table of fixed size and sends its blocks, packed; Spark adds them up by block. The whole table,
    14 MB, comes to the driver and goes out again.
    """
    plain = astuple(tree)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Tree(*plain), np.zeros(_OFFSETS[-1] * 2, np.int32)
        held, size = [], 0
        for batch in batches:
            for start, rows in byte_steps(batch.column("text"), _SIDE):
                for parts in _parts(batch.column("text").slice(start, rows).to_pylist()):
                    data, _, contexts = _read(parts)
                    held.append([_keys(context, data) for context in contexts])
                    size += len(data)
                    if size > _COUNT_STEP:
                        _add_counts(total, known, [np.concatenate(x) for x in zip(*held)])
                        held, size = [], 0
        _add_counts(total, known, [np.concatenate(x) for x in zip(*held)])
        del held
        blocks = total.reshape(-1, _BLOCK)
        for some in np.array_split(np.flatnonzero(blocks.any(1)), 32):  # a batch is a small part of the table
            counts = pa.array([_packed(blocks[k]) for k in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), counts], ["block", "counts"])
        del total, blocks
        return_memory()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                sums[k] = sums.get(k, 0) + _unpacked(raw)
        for k, s in sums.items():
            pair = s.reshape(-1, 2)
            logit = np.log((pair[:, 1] + 0.2) / (pair[:, 0] + 0.2)).astype("<f2")
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([logit.tobytes()], pa.binary())], ["block", "logits"])

    summed = docs.select("text").mapInArrow(count, "block long, counts binary").repartition("block").mapInArrow(add, "block long, logits binary")
    out = np.zeros(_OFFSETS[-1], np.float16).reshape(-1, _BLOCK // 2)
    for r in summed.toLocalIterator():
        out[r["block"]] = np.frombuffer(r["logits"], "<f2")
    return out.ravel()


@dataclass
class State:
    """What adapts while texts are read side by side: weights by predictor, text and gate; refinement by text and bin."""

    weights: np.ndarray
    ones: np.ndarray
    met: np.ndarray

    @classmethod
    def fresh(cls, first: np.ndarray, n: int) -> State:
        centre = 1 / (1 + np.exp(-(np.arange(_BINS) - _BINS / 2 + 0.5)))
        return cls(np.tile(first.T, n), np.tile(centre * 8, n), np.full(n * _BINS, 8.0))


def mix(texts: list[str | None], tree: Tree, logits: np.ndarray, first: np.ndarray, rate: float, score: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability by text, or zeros without ``score``; final weights by text, gate and predictor)."""
    out, ends = np.zeros(len(texts)), np.zeros((len(texts), _GATES, CONTEXTS))
    state, rows = None, []
    for parts in _parts(texts):
        if [p.row for p in parts] != rows:  # else the next piece of the same long text
            state, rows = State.fresh(first, len(parts)), [p.row for p in parts]
        np.add.at(out, rows, _mix(parts, tree, logits, state, rate, score))
        ends[rows] = state.weights.T.reshape(len(rows), _GATES, CONTEXTS)
    return out, ends


def _turns(parts: list[Part], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte and length of each block, the bytes of a part between two adaptations, in order of turn and part; where
    turns begin among the blocks). Parts come longest first, so those of a turn are the first ones."""
    begin, border = np.array([p.start for p in parts]), _BEGINNING // _CHUNK
    late = np.array([begin, begin + lengths - 1])
    first, last = np.where(late < _BEGINNING, late // _CHUNK, border + (late - _BEGINNING) // _LATER)
    blocks = last - first + 1
    part = np.repeat(np.arange(len(parts)), blocks)
    turn = np.arange(len(part)) - np.repeat(np.cumsum(blocks) - blocks - first, blocks)
    low, high = (np.where(t < border, t * _CHUNK, _BEGINNING + (t - border) * _LATER) for t in (turn, turn + 1))
    low, high = np.maximum(low, begin[part]), np.minimum(high, (begin + lengths)[part])
    order = np.argsort(turn, kind="stable")
    at = (low + (np.cumsum(lengths) - lengths - begin)[part])[order]
    turn = turn[order]
    return at, (high - low)[order], np.append(np.flatnonzero(_runs(turn)), len(turn))


def _mix(parts: list[Part], tree: Tree, logits: np.ndarray, state: State, rate: float, score: bool = True) -> np.ndarray:
    """log10 probability of each part; ``state`` goes on. All parts are read side by side, turn by turn. Without
    ``score`` only the weights go on, which do not depend on the refinement, and zeros come back.

    Decisions are laid out by their depth, then by turn and part, so those that share weights stand side by side.
    """
    data, lengths, contexts = _read(parts)
    at, lengths, turns = _turns(parts, lengths)
    order = np.repeat(at - np.cumsum(lengths) + lengths, lengths)
    order += np.arange(len(data))
    data = data[order].astype(np.int64)
    size = tree.size[data]
    levels = int(size.max())
    # Decisions by block and depth: from the number of bytes by block and size.
    number = np.repeat(np.arange(len(lengths)) * (levels + 1), lengths)
    number += size
    number = np.bincount(number, minlength=len(lengths) * (levels + 1)).reshape(-1, levels + 1)
    number = np.ascontiguousarray(np.cumsum(number[:, :0:-1], 1)[:, ::-1])
    edges = np.concatenate((np.zeros((1, levels), np.int64), np.cumsum(number, 0)))[turns].tolist()
    # Signals and bit of all decisions, by depth.
    depths = np.minimum(tree.depth, levels)  # the last row is not used
    nodes, bits = np.zeros((levels + 1, 256), np.uint32), np.zeros((levels + 1, 256), np.float16)
    nodes[depths, np.repeat(np.arange(256), tree.size)], bits[depths, np.repeat(np.arange(256), tree.size)] = tree.node, tree.bit
    size, contexts = size.astype(np.int8), [c[order] for c in contexts]
    laid, tables = [], [logits[_OFFSETS[k] : _OFFSETS[k + 1]].astype(np.float16, copy=False) for k in range(CONTEXTS)]
    for level in range(levels):
        deep = np.flatnonzero(size > level)
        if len(deep) < len(size):
            size, data, contexts = size[deep], data[deep], [c[deep] for c in contexts]
        node, rows = nodes[level].take(data, mode="clip"), np.empty((CONTEXTS + 1, len(data)), np.float16)
        for k, context in enumerate(contexts):
            slot = context + node
            slot >>= np.uint32(32 - _BITS[k])
            tables[k].take(slot.astype(np.int64), out=rows[k], mode="clip")
        bits[level].take(data, out=rows[CONTEXTS], mode="clip")
        laid.append(rows)
    out, half = np.zeros(len(parts)), np.float32(_BINS / 2)
    for turn, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        count = number[turns[turn] : turns[turn + 1]]
        n = len(count)
        count = count.T.ravel()
        held = np.flatnonzero(count)
        count = count[held]
        level, part = np.divmod(held, n)
        starts = np.cumsum(count)
        starts -= count
        gate = part * _GATES
        gate += np.minimum(level, _GATES - 1)
        rows = _single(np.concatenate([x[:, a:b] for x, a, b in zip(laid, low, high)], 1))
        s, bit = rows[:CONTEXTS], rows[CONTEXTS]
        weighed = np.repeat(state.weights[:, : n * _GATES].astype(np.float32)[:, gate], count, 1)
        weighed *= s
        z = weighed[0]
        for k in range(1, CONTEXTS):
            z += weighed[k]
        np.maximum(z, np.float32(0.01) - half, out=z)
        np.minimum(z, half - np.float32(0.01), out=z)
        p = np.negative(z)
        np.exp(p, out=p)
        p += 1
        np.reciprocal(p, out=p)
        miss = bit - p
        miss *= np.float32(rate)
        s *= miss
        sums = np.add.reduceat(s.astype(np.float64), starts, 1)
        for k in range(CONTEXTS):
            more = np.bincount(gate, sums[k], n * _GATES)
            np.maximum(more, -0.1, out=more)
            np.minimum(more, 0.1, out=more)
            state.weights[k, : n * _GATES] += more
        if score:
            ones, met = state.ones[: n * _BINS], state.met[: n * _BINS]
            z += half
            cell = z.astype(np.int64)
            cell += np.repeat(part * _BINS, count)
            p *= np.float32(0.7)
            p += (0.3 * ones / met).astype(np.float32).take(cell, mode="clip")
            cell *= 2
            cell += bit.astype(np.int64)
            new = np.bincount(cell, minlength=2 * n * _BINS).reshape(-1, 2)
            met += new[:, 0]
            met += new[:, 1]
            ones += new[:, 1]
            chance = p.astype(np.float64)
            chance -= 1 - bit  # of the bit that came, but for the sign
            np.abs(chance, out=chance)  # above 4e-6, as z is bounded
            np.log10(chance, out=chance)
            out[:n] += np.bincount(part, np.add.reduceat(chance, starts), n)
    return out


def first_weights(docs: DataFrame, model: Broadcast, rate: float) -> np.ndarray:
    """Weights to start from: the mean of those that all texts end with, by their bytes, when each starts from even ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, logits = Tree(*model.value[0]), model.value[1]
        even = np.full((_GATES, CONTEXTS), 0.4)
        total, n = np.zeros((_GATES, CONTEXTS)), 0
        for batch in batches:
            for start, size in byte_steps(batch.column("text"), _SIDE):
                texts = batch.column("text").slice(start, size)
                read = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) + 1
                total += np.tensordot(read, mix(texts.to_pylist(), tree, logits, even, rate, score=False)[1], 1)
                n += int(read.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()])], ["n", "weights"])
        return_memory()

    sums = docs.select("text").mapInArrow(run, "n long, weights array<double>")  # a row a task
    sums = sums.selectExpr("n", "posexplode(weights) AS (k, w)").groupBy("k").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    out = np.full(_GATES * CONTEXTS, 0.4)
    for r in sums.collect():
        if r["n"]:
            out[r["k"]] = r["w"] / r["n"]
    return out.reshape(_GATES, CONTEXTS)


def model_scores(docs: DataFrame, training: DataFrame, rate: float = 0.002) -> DataFrame:
    """``docs`` (with text) plus score, the log10 probability of the whole lower-case text; ``training`` (text) teaches."""
    spark = docs.sparkSession
    tree = huffman(byte_counts(training))
    logits = context_logits(training, tree)
    model = spark.sparkContext.broadcast((astuple(tree), logits))
    first = first_weights(training, model, rate)
    kept = docs.drop("score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tables = Tree(*model.value[0]), model.value[1]
        for batch in batches:
            scores: list[float] = []
            for start, size in byte_steps(batch.column("text"), _SIDE):
                scores += mix(batch.column("text").slice(start, size).to_pylist(), known, tables, first, rate)[0].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])
        return_memory()

    return kept.mapInArrow(run, schema)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(index of the text, token) of every token but the ends."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")
    return rows.filter(real).to_numpy(), words.filter(real)


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over all texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in byte_steps(batch.column("text"), _TOKEN_STEP):
                found = pc.value_counts(_tokens(batch.column("text").slice(start, rows))[1])
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["token", "c"])

    return docs.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _looked_up(docs: DataFrame, words: Broadcast) -> DataFrame:
    """(doc, body, n, k, s) a row of ``docs``: tokens, those among ``words`` and the sum of their logs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = words.value
        for batch in batches:
            for start, size in byte_steps(batch.column("text"), _TOKEN_STEP):
                rows, tokens = _tokens(batch.column("text").slice(start, size))
                coded = tokens.dictionary_encode()
                at = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
                met = at >= 0
                out = [np.bincount(rows, minlength=size), np.bincount(rows[met], minlength=size), np.bincount(rows[met], logs[at[met]], size).astype(np.float64)]
                keys = [batch.column(c).slice(start, size) for c in ("doc", "body")]
                yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, out)], ["doc", "body", "n", "k", "s"])

    return docs.select("doc", "body", "text").mapInArrow(run, "doc long, body long, n long, k long, s double")


def _others(docs: DataFrame, words: Broadcast) -> DataFrame:
    """(token, at: doc, body, t): each other token of a step through the texts once, with how often it is in which of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value[0]
        for batch in batches:
            for start, size in byte_steps(batch.column("text"), _TOKEN_STEP):
                rows, tokens = _tokens(batch.column("text").slice(start, size))
                coded = tokens.dictionary_encode()
                other = pc.is_null(pc.index_in(coded.dictionary, value_set=known)).to_numpy(zero_copy_only=False)
                code = coded.indices.to_numpy().astype(np.int64)
                seldom = other[code]
                pairs, t = np.unique(code[seldom] * size + rows[seldom], return_counts=True)
                code, row = pairs // size, pairs % size
                which, first = np.unique(code, return_index=True)
                keys = [batch.column(c).slice(start, size).take(pa.array(row)) for c in ("doc", "body")]
                at = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), pa.StructArray.from_arrays([*keys, pa.array(t)], ["doc", "body", "t"]))
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(which)), at], ["token", "at"])

    return docs.select("doc", "body", "text").mapInArrow(run, "token string, at array<struct<doc:long,body:long,t:long>>")


def unigram_scores(docs: DataFrame, training: DataFrame, frequent: int = 100_000) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score) by ``key`` of ``docs`` (key, text): add-one unigrams with an end token.

    A key is a struct of doc and body; rows of equal key hold equal texts and get one row, of one text. Tokens that make up at
    least one in ``frequent`` of the training tokens, so at most that many, are looked up in the tasks; the others move to
    their counts, each once a step with the texts that hold it, and sums by text move back.
    """
    spark = docs.sparkSession
    learnt = written(token_counts(training), "token-counts")
    ends = training.count()
    size = learnt.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = size["n"] + ends, size["v"] + (1 if ends else 0)
    common = learnt.where(F.col("c") * frequent >= max(1, total)).collect()  # at most `frequent` rows
    rare = learnt.where(F.col("c") * frequent < max(1, total))
    words = spark.sparkContext.broadcast((pa.array([r["token"] for r in common], pa.string()), np.log10(np.array([r["c"] for r in common], np.float64) + 1)))
    rows = docs.select("key.doc", "key.body", "text")
    sums = _looked_up(rows, words).selectExpr("doc", "body", "1L AS copies", "n", "k", "s")
    seldom = _others(rows, words).join(rare, "token").select(F.explode("at").alias("at"), F.log10(F.col("c") + 1.0).alias("log"))
    seldom = seldom.selectExpr("at.doc", "at.body", "0L AS copies", "0L AS n", "at.t AS k", "at.t * log AS s")
    sums = sums.union(seldom).groupBy("doc", "body").agg(*[F.sum(c).alias(c) for c in ("copies", "n", "k", "s")])
    n, known = F.expr("n DIV copies") + 1, F.expr("k DIV copies") + (1 if ends else 0)
    score = F.col("s") / F.col("copies") + float(np.log10(ends + 1)) - n * float(np.log10(total + distinct + 1))
    key = F.struct("doc", "body").alias("key")
    return sums.select(key, n.alias("n_tokens"), known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), score.alias("base_score"))


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows for which ``held_out`` is not true teach; all are scored over their whole text. Null texts are empty texts: an
    end mark alone. Rows with null doc_id teach, and are scored. Repeated rows each teach and get equal scores. Without any
    training row all is unknown, and predictors give even odds. Columns of other names do not matter.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    rows = rows.withColumn("key", F.struct(F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64("text").alias("body")))
    training = rows.where(~F.col("held_out")).select("text")
    base = unigram_scores(rows.select("key", "text"), training)
    scored = model_scores(rows.select("doc_id", "held_out", "key", "text"), training).drop("text")
    out = scored.join(base, "key")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
