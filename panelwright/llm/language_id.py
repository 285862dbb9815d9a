"""Language identification with language-bitmask n-gram filters.

Each language's frequent character n-grams (three and four letters of a word with its borders) go into Bloom filters
that share their slots: slot s holds one bit per language, so that the AND of an n-gram's slots names all languages that
have it at once. A text is the language that most of its n-grams belong to, after false positives are taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.shared import byte_steps, pieces, return_memory, written

UNDETERMINED = "und"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


@dataclass
class LanguageModel:
    """Languages in order of preference for ties, slots (words x slots), hashes per n-gram, false-positive rates."""

    languages: list[str]
    slots: np.ndarray
    hashes: int
    false_rate: np.ndarray


def letter_table() -> np.ndarray:
    """Lower-case letter by code point, 0 where there is none: 4 MB."""
    letters = np.zeros(0x110000, np.uint32)
    for k in (*range(0xD800), *range(0xE000, 0x110000)):
        c = chr(k)
        if c.isalpha():
            letters[k] = ord(c.lower()[0])
    return letters


class GramReader:
    """n-grams of texts, as 64-bit hashes."""

    def __init__(self, letters: np.ndarray) -> None:
        self.letter = letters

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, index of the text of each, has a letter per text)."""
        raw = np.frombuffer(" ".join(t or "" for t in texts).encode("utf-32-le", "replace"), "<u4")
        lengths = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[: len(raw)]
        c = self.letter[raw]
        has = np.zeros(len(texts), bool)
        has[owner[c > 0]] = True
        keep = c > 0
        keep[1:] |= c[:-1] > 0  # one border after each word
        c, owner = np.concatenate(([0], c[keep], [0])).astype(np.uint64), np.concatenate(([0], owner[keep], [0]))
        found, owners = [], []
        for n in (3, 4):
            if len(c) < n:
                continue
            m = len(c) - n + 1
            inner = np.ones(m, bool)
            for k in range(1, n - 1):
                inner &= c[k : m + k] > 0
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h += c[k : m + k] * _FACTORS[k]
            h = h[inner]
            h ^= h >> np.uint64(29)
            h *= _MIX
            h ^= h >> np.uint64(32)
            found.append(h)
            owners.append(owner[1 : m + 1][inner])
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int32), has
        return np.concatenate(found), np.concatenate(owners), has


def cut_texts(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Texts, long ones in pieces between words, and the index of the text of each piece.

    N-grams do not reach over white space, so pieces have those of their text; only a word of a hundred thousands of
    letters is read as several words.
    """
    parts = [(k, piece) for k, t in enumerate(texts) for piece in pieces(t or "")]
    return [p for _, p in parts], np.fromiter((k for k, _ in parts), np.int64, len(parts))


def slot_numbers(h: np.ndarray, hashes: int, slots: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(slots)).astype(np.int64) for k in range(hashes)]


def _gram_counts(labelled: DataFrame, letters: Broadcast, flush: int) -> DataFrame:
    """(lang, gram, n): counted inside the tasks, at most ``flush`` n-grams in memory, then summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = GramReader(letters.value)
        held: dict[str, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        rows = 0

        def combined(lang: str) -> tuple[np.ndarray, np.ndarray]:
            grams, which = np.unique(np.concatenate(held[lang][0]), return_inverse=True)
            return grams, np.bincount(which, np.concatenate(held[lang][1])).astype(np.int64)

        def emit() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                grams, n = combined(lang)
                columns = [pa.repeat(pa.scalar(lang, pa.string()), len(grams)), pa.array(grams.view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])
                del held[lang], grams, n, columns

        for batch in batches:
            for start, size in byte_steps(batch.column("text")):
                part = batch.slice(start, size)
                texts, of = cut_texts(part.column("text").to_pylist())
                langs = np.array(part.column("lang").to_pylist(), object)[of]
                h, owner, _ = reader.read(texts)
                for lang in sorted(set(langs)):
                    grams, n = np.unique(h[(langs == lang)[owner]], return_counts=True)
                    a, b = held.setdefault(lang, ([], []))
                    a.append(grams)
                    b.append(n)
                    rows += len(grams)
                if rows > flush:
                    for lang in held:
                        grams, n = combined(lang)
                        held[lang] = [grams], [n]
                    rows = sum(len(a[0]) for a, _ in held.values())
                    if rows > flush // 2:
                        yield from emit()
                        rows = 0
        yield from emit()
        return_memory()

    counts = labelled.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(
    labelled: DataFrame,
    min_share: float = 1e-5,
    min_ratio: float = 0.1,
    slots: int = 1 << 21,
    hashes: int = 3,
    max_languages: int = 512,
    sample_docs: int = 20_000,
) -> LanguageModel:
    """Model from ``labelled`` (text, lang); rows with null text or lang teach nothing.

    A language's filter takes the n-grams that make up at least ``min_share`` of its running text, at most
    ``1 / min_share`` of them, and are at least ``min_ratio`` times as frequent as in any other language (a stray quotation
    teaches nothing). N-grams are taken from about ``sample_docs`` documents of each language at most, chosen by a hash of
    their text: a bounded sample for fitting; every language of the table is learned. Everything brought to the driver is bounded by these parameters. More than ``max_languages`` values
    of lang raise an error; none give a model that answers ``und``.
    """
    usable = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counted = usable.groupBy("lang").agg(F.count("*").alias("docs")).limit(max_languages + 1).collect()
    if len(counted) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    share = {r["lang"]: min(1.0, sample_docs / r["docs"]) for r in counted}
    limits = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 30)))]) if share else F.lit(None)
    chosen = usable.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < limits[F.col("lang")]) if share else usable
    letters = labelled.sparkSession.sparkContext.broadcast(letter_table())
    languages = [r["lang"] for r in sorted(counted, key=lambda r: (-r["docs"], r["lang"]))]
    counts = _gram_counts(chosen, letters, flush=500_000)
    # Only n-grams of a fair share matter; totals need the small ones too, so both come from one pass.
    counts = written(counts, "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").selectExpr("lang", "gram", "n / total AS share")  # a row a language
    shares = shares.where(F.col("share") >= min_share)
    best = F.max("share").over(Window.partitionBy("gram"))
    kept = shares.withColumn("best", best).where(F.col("share") >= min_ratio * F.col("best"))
    number = {lang: k for k, lang in enumerate(languages)}
    table = kept.select("lang", "gram").toArrow()
    words = max(1, -(-len(languages) // 64))
    bits = np.zeros((words, slots), np.uint64)
    false_rate = np.zeros(len(languages))
    grams = table.column("gram").to_numpy().view(np.uint64)
    of = np.array([number[x] for x in table.column("lang").to_pylist()], np.int64)
    for k in range(len(languages)):
        word, bit = divmod(k, 64)
        own = np.zeros(slots, bool)
        for s in slot_numbers(grams[of == k], hashes, slots):
            own[s] = True
        bits[word] |= own.astype(np.uint64) << np.uint64(bit)
        false_rate[k] = own.mean() ** hashes
    return LanguageModel(languages, bits, hashes, false_rate)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; only ``text`` is looked at.

    score is the share of the text's n-grams that the language has, less what its filter's false positives explain. Null
    texts and texts without a letter are ``und`` with score 0, as are all where nothing was learned. Ties go to the
    language with more training documents, then the smaller name; a text with letters always gets a learned language.
    Existing columns lang_pred and score are replaced, others stay. No shuffle.
    """
    kept = docs.drop("lang_pred", "score")
    shared = _shared(docs.sparkSession, model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, scores in _predicted(batches, text, shared):
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])
        return_memory()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def _shared(spark: SparkSession, model: LanguageModel) -> Broadcast:
    return spark.sparkContext.broadcast((model.languages, model.slots, model.hashes, model.false_rate, letter_table()))


def _predicted(batches: Iterator[pa.RecordBatch], text: str, shared: Broadcast) -> Iterator[tuple[pa.RecordBatch, list[str], list[float]]]:
    """Each batch with the language and the score of its rows."""
    m, reader = LanguageModel(*shared.value[:4]), GramReader(shared.value[4])
    for batch in batches:
        names: list[str] = []
        scores: list[float] = []
        for start, size in byte_steps(batch.column(text)):
            texts, of = cut_texts(batch.column(text).slice(start, size).to_pylist())
            total, hits, has = np.zeros(size), np.zeros((max(1, len(m.languages)), size)), np.zeros(size, bool)
            # A long text is read piece by piece; short ones are read together.
            for some in np.array_split(np.arange(len(texts)), max(1, sum(map(len, texts)) >> 19)):
                h, owner, letters = reader.read([texts[k] for k in some])
                owner = of[some][owner]
                has[of[some][letters]] = True
                total += np.bincount(owner, minlength=size)
                slots = slot_numbers(h, m.hashes, m.slots.shape[1])
                for word in range(m.slots.shape[0]):
                    mask = m.slots[word][slots[0]]
                    for s in slots[1:]:
                        mask &= m.slots[word][s]
                    for k in range(word * 64, min(len(m.languages), word * 64 + 64)):
                        hits[k] += np.bincount(owner[(mask >> np.uint64(k % 64)) & np.uint64(1) > 0], minlength=size)
            rate = m.false_rate[:, None] if len(m.languages) else np.zeros((1, 1))
            part = np.clip((hits - total * rate) / np.maximum(total * (1 - rate), 1e-9), 0, 1)
            best = part.round(9).argmax(0)  # the correction must not split ties
            found = has & bool(m.languages)
            names += [m.languages[b] if f else UNDETERMINED for b, f in zip(best, found)]
            scores += [float(s) if f else 0.0 for s, f in zip(part.max(0), found)]
        yield batch, names, scores


def reject_unknown(docs: DataFrame, model: LanguageModel, min_score: float = 0.1) -> DataFrame:
    """The rows of ``docs`` (text, any others) whose text is in a learned language; ``und`` and scores below ``min_score`` go.

    No column is added, replaced or lost, whatever its name; repeated rows go or stay together.
    """
    shared = _shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, scores in _predicted(batches, "text", shared):
            yield batch.filter(pa.array([n != UNDETERMINED and s >= min_score for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
