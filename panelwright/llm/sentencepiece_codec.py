"""SentencePiece encoding of merge-type (BPE) models by backtracking, and decoding.

A text's pieces are found left to right: at each place the longest piece that starts there (from one Aho-Corasick pass)
is tried, then its shorter prefixes. A piece may follow another only if merging their joined text again gives back just
these two. Where nothing fits, the last piece is taken back and the place is marked in a bit field, so that no place
fails twice. Pieces that never come out of merging their own text are left out beforehand.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panelwright.llm.shared import return_memory

SPACE = "▁"


class _Chunks(dict):
    """Chunk of text -> its ids as little-endian 32-bit integers; emptied when full, which changes no result."""

    def __init__(self, encoder: MergeEncoder, size: int) -> None:
        super().__init__()
        self.encoder, self.size = encoder, size

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encoder.chunk_ids(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.size:
                self.clear()
            self[chunk] = ids
        return ids


class MergeEncoder:
    """Encoder built from a model's bytes. Its attributes are plain values of the size of the vocabulary."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        special = [i for i in range(sp.get_piece_size()) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)]
        if any(sp.is_unused(i) for i in range(sp.get_piece_size())) or sum(map(sp.is_byte, special)) != 256:
            raise ValueError("only models with byte fallback and without unused pieces are supported")
        if sp.normalize(" a  b\tﬁ ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b\tﬁ{SPACE}":
            raise ValueError("only models that keep the text and put one space before it are supported")
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in special if sp.is_byte(i)}
        normal = sorted(set(range(sp.get_piece_size())) - set(special))
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        self.whole = {p for p in self.ids if self.merged(p) == [p]}
        # Merges never join two characters that no piece has side by side, so texts can be cut between them: before a run of
        # spaces, and where a run of marks begins or ends, unless the text has one of the few characters that a piece joins to marks.
        pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        marks = {c for p in self.ids for c in p if not c.isalnum()} | set("\t\n\r") - {SPACE}
        glue = {other for a, b in pairs for c, other in ((a, b), (b, a)) if c in marks and other not in marks | {SPACE}}
        own = "".join(map(re.escape, sorted(marks)))
        apart = not any(b == SPACE != a for a, b in pairs)
        self.coarse = f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else r"(?s:.+)"
        self.fine = f"{SPACE}*(?:[{own}]+|[^{SPACE}{own}]+)|{SPACE}+" if apart and marks else self.coarse
        self.glue = f"[{''.join(map(re.escape, sorted(glue)))}]" if glue else "(?!)"

    def merged(self, text: str, border: int = -1) -> list[str] | None:
        """The pieces that remain after merging neighbours, best score first, leftmost among equals.

        None as soon as a merge crosses ``border``, a place in the text.
        """
        parts, get, none = list(text), self.scores.get, float("-inf")
        scores = [get(a + b, none) for a, b in zip(text, text[1:])]
        left = border
        while scores:
            best = max(scores)
            if best == none:
                break
            k = scores.index(best)
            if left > 0:
                if k + 1 == left:
                    return None
                left -= k + 1 < left
            parts[k] += parts.pop(k + 1)
            del scores[k]
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], none)
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], none)
        return parts

    @classmethod
    def started(cls, state: dict, cache_size: int) -> MergeEncoder:
        """From the attributes of a built encoder, ready for use inside a task."""
        import ahocorasick

        self = cls.__new__(cls)
        self.__dict__.update(state)

        self.automaton = ahocorasick.Automaton()
        for piece in self.whole:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.reach = max(map(len, self.whole))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.good: set[tuple[str, str]] = set()
        self.codes = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.cache_size = cache_size
        self.chunks = _Chunks(self, cache_size)
        self.find_fine, self.find_coarse = re.compile(self.fine).findall, re.compile(self.coarse).findall
        self.has_glue = re.compile(self.glue).search
        self.marks = self.begin.to_bytes(4, "little"), self.end.to_bytes(4, "little")
        return self

    def fits(self, left: str, right: str) -> bool:
        if len(self.pairs) >= self.cache_size:
            self.pairs.clear()
            self.good.clear()
        fit = self.pairs[left, right] = self.merged(left + right, len(left)) == [left, right]
        if fit:
            self.good.add((left, right))
        return fit

    def shorter(self, piece: str) -> str | None:
        for n in range(len(piece) - 1, 1, -1):
            if piece[:n] in self.whole:
                return piece[:n]
        return piece[0] if len(piece) > 1 else None

    def _longest(self, text: str, at: int, known: dict[int, str]) -> str:
        """The longest piece at ``at``; the longest ones that follow it closely are noted in ``known`` on the way."""
        end = min(len(text), at + 4 * self.reach)
        for last, piece in self.automaton.iter_long(text, at, end):
            start = last - len(piece) + 1
            if start + self.reach > end < len(text):  # a longer piece may lie beyond what was looked at
                break
            known[start] = piece
        return known.setdefault(at, text[at])

    def pieces(self, text: str) -> list[str]:
        # Most often the longest pieces in a row all fit.
        row = [piece for _, piece in self.automaton.iter_long(text)]
        if self.good.issuperset(zip(row, row[1:])) and sum(map(len, row)) == len(text):
            return row
        known: dict[int, str] = {}
        out: list[str] = []
        failed = bytearray(len(text) // 8 + 1)
        pairs, at, left, size = self.pairs, 0, None, len(text)
        candidate = self._longest(text, 0, known) if text else ""
        while at < size:
            after = at + len(candidate)
            ok = left is None or pairs.get((left, candidate))
            if ok is None:
                ok = self.fits(left, candidate)
            if ok and not failed[after >> 3] >> (after & 7) & 1:
                out.append(candidate)
                left, at = candidate, after
                if at < size:
                    candidate = known.get(at) or self._longest(text, at, known)
                continue
            shorter = self.shorter(candidate)
            if shorter is None:
                failed[at >> 3] |= 1 << (at & 7)
                candidate = out.pop()
                at -= len(candidate)
                left = out[-1] if out else None
            else:
                candidate = shorter
        return out

    def chunk_ids(self, chunk: str) -> bytes:
        pieces = self.pieces(chunk)
        try:
            return b"".join(map(self.codes.__getitem__, pieces))
        except KeyError:
            for piece in set(pieces) - self.codes.keys():  # a character without a piece: its bytes
                self.codes[piece] = b"".join(self.bytes[b].to_bytes(4, "little") for b in piece.encode())
            return b"".join(map(self.codes.__getitem__, pieces))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b"".join(self.marks)
        spaced = SPACE + text.replace(" ", SPACE)
        chunks = (self.find_coarse if self.has_glue(spaced) else self.find_fine)(spaced)
        return b"".join([self.marks[0], *map(self.chunks.__getitem__, chunks), self.marks[1]])


def encode(docs: DataFrame, model: bytes, text: str = "text", out: str = "ids", cache_size: int = 500_000) -> DataFrame:
    """``docs`` with ``out``: the ids of the whole text as little-endian unsigned 32-bit integers, begin and end included.

    Null and empty texts give just the two marks. Other columns stay as they are; a column named ``out`` is replaced.
    Equal rows give equal results; an empty table gives an empty one. No shuffle: each task works on its own rows and
    holds the vocabulary and two caches of at most ``cache_size`` entries.
    """
    return _mapped(docs, text, {out: T.BinaryType()}, _encoder(docs.sparkSession, model, cache_size))


def decode(encoded: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``: the text that the ids stand for; null ids give null. Other columns stay."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def started() -> Callable[[pa.Array], list[pa.Array]]:
        decoded = _decoder(shared.value)
        return lambda column: [pa.array([None if b.as_py() is None else decoded(b.as_py()) for b in column], pa.string())]

    return _mapped(encoded, ids, {out: T.StringType()}, started)


def round_trip(docs: DataFrame, model: bytes, text: str = "text", cache_size: int = 500_000) -> DataFrame:
    """``docs`` with ids and decoded, as ``decode`` of ``encode`` gives them, in one pass over the rows."""
    encoder = _encoder(docs.sparkSession, model, cache_size)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def started() -> Callable[[pa.Array], list[pa.Array]]:
        encoded, decoded = encoder(), _decoder(shared.value)

        def both(column: pa.Array) -> list[pa.Array]:
            ids = encoded(column)[0]
            return [ids, pa.array([decoded(b.as_py()) for b in ids], pa.string())]

        return both

    return _mapped(docs, text, {"ids": T.BinaryType(), "decoded": T.StringType()}, started)


def _encoder(spark: SparkSession, model: bytes, cache_size: int) -> Callable[[], Callable[[pa.Array], list[pa.Array]]]:
    shared = spark.sparkContext.broadcast(vars(MergeEncoder(model)))

    def started() -> Callable[[pa.Array], list[pa.Array]]:
        encoder = MergeEncoder.started(shared.value, cache_size)
        return lambda column: [pa.array([encoder.encode(t.as_py()) for t in column], pa.binary())]

    return started


def _decoder(model: bytes) -> Callable[[bytes], str]:
    import numpy as np
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return lambda ids: sp.decode(np.frombuffer(ids, "<u4").tolist())


def _mapped(docs: DataFrame, column: str, made: dict[str, T.DataType], started: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """``docs`` with the columns that the started function makes of one column; existing ones of these names go."""
    kept = docs.drop(*[c for c in made if c != column])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = started()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *apply(batch.column(column))], [*batch.schema.names, *made])
        del apply
        return_memory()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *[T.StructField(c, t) for c, t in made.items()]]))
