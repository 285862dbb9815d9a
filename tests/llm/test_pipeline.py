"""The pipeline: each stage on odd rows and on an empty table, and the whole on a small table."""

from __future__ import annotations

import pytest

from corpus_pipeline import STAGES, run
from panelwright.llm.shared import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "the quick brown fox and the lazy dog were walking together along the old river bank this morning"
FRENCH = "le renard brun et le chien paresseux marchaient ensemble le long de la vieille rive ce matin"


def text(k: int, base: str) -> str:
    return " ".join(f"{w} {'abcdefghijklmnopqrst'[(k * 3 + j) % 20] * (k % 4 + 2)}" for j, w in enumerate(base.split()))


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(k, text(k, ENGLISH if k % 2 else FRENCH), "en" if k % 2 else "fr", f"s{k % 3}", None) for k in range(12)]
    rows += [(20, rows[1][1], "en", "s9", None), (21, None, "en", None, None), (22, "", None, "s1", 0), (23, "1 2 3", "en", "s1", 5), (24, text(1, ENGLISH), None, None, None)]
    rows.append(rows[3])
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_stages_keep_the_columns_and_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = {}
    for name, stage in STAGES:
        docs = written(stage(spark, docs, folder), name)
        counts[name] = docs.count()
        if name != STAGES[-1][0]:
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert counts["language_id"] == 15  # null, empty and letterless texts go
    assert counts["minhash_dedup"] == counts["mixing"] == counts["sentencepiece"] == 12


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert run(spark, str(tmp_path)).collect() == []


CLASHING = DOCS + ", score double, lang_pred string, position long, block long, slot long, n_lines int, n_dropped int, _row string, digest string, `a b` int"


def clashing(k, text, lang, source):
    return (k, text, lang, source, None if text is None else len(text), k / 4 if k is not None else None, f"keep{k}", k, k, k, 3, 4, f"row{k}", f"d{k}", 7)


@pytest.fixture
def odd_docs(spark):
    """Near copies, recurring lines, nulls everywhere, repeated rows, and different texts of one doc_id."""
    rows = [clashing(k, text(k, ENGLISH if k % 2 else FRENCH) + f"\nsession {k} was opened at the gate", "en" if k % 2 else "fr", f"s{k % 3}") for k in range(12)]
    rows += [clashing(30 + k, text(k, ENGLISH) + f" zeta{k} " + text(k + 1, ENGLISH), None, None) for k in range(3)]
    rows += [clashing(50, text(5, ENGLISH) * 2, "en", "s1"), clashing(51, text(5, ENGLISH) * 2, "en", "s1"), clashing(51, text(9, FRENCH) * 2, "fr", "s1")]
    rows += [clashing(None, text(3, ENGLISH), "en", "s0"), clashing(60, None, "en", "s0"), clashing(61, "", "en", None), clashing(62, "12 34", "en", "s0")]
    rows += [rows[3], rows[3], rows[16][:5] + rows[3][5:]]
    return rows, spark.createDataFrame(rows, CLASHING).repartition(3)


def test_stages_lose_no_column_and_no_document(spark, odd_docs):
    rows, docs = odd_docs
    names = docs.columns
    stages = dict(STAGES)

    def values(frame):
        assert frame.columns == names
        return sorted(map(str, (tuple(r) for r in frame.collect())))

    known = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert values(stages["language_id"](spark, docs, "")) == sorted(map(str, known))
    assert values(stages["mixing"](spark, docs, "")) == sorted(map(str, rows))

    # The recurring line goes from all but the first document that has it; nothing else changes but n_chars.
    line = " was opened at the gate"
    cut = []
    for r in rows:
        body = r[1]
        if body and body.endswith(line) and r[0] != 0:
            body = body[: body.rindex("\n")]
            r = (r[0], body, *r[2:4], len(body), *r[5:])
        cut.append(r)
    assert values(stages["line_dedup"](spark, docs, "")) == sorted(map(str, cut))


def test_one_of_near_copies_equals_brute_force(spark, odd_docs):
    rows, docs = odd_docs

    def shingles(body):
        words = body.split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    nodes = {r[:2] for r in rows if r[0] is not None and r[1] and r[1].split()}
    first = {}
    for k, body in nodes:
        first[body] = min(first.get(body, k), k)
    root = {body: body for body in first}

    def find(b):
        while root[b] != b:
            b = root[b]
        return b

    for a in first:
        for b in first:
            sa, sb = shingles(a), shingles(b)
            if a < b and len(sa & sb) / len(sa | sb) >= 0.8:
                root[find(b)] = find(a)
    groups = {}
    for body, k in first.items():
        groups.setdefault(find(body), []).append(k)
    got = [tuple(r) for r in dict(STAGES)["minhash_dedup"](spark, docs, "").collect()]
    assert set(map(str, got)) <= set(map(str, rows))
    alone = [r for r in rows if r[0] is None or not r[1] or not r[1].split()]
    assert sorted(str(r[0]) for r in got) == sorted([str(min(g)) for g in groups.values()] + [str(r[0]) for r in alone])


def test_tokens_equal_the_library(spark, odd_docs):
    import hashlib
    import struct

    import sentencepiece

    from panelwright.llm.queries import tokenizer_model

    sp = sentencepiece.SentencePieceProcessor(model_proto=tokenizer_model())
    rows, docs = odd_docs

    def want(k, body):
        ids = sp.encode(body or "", add_bos=True, add_eos=True)
        return (k, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())

    got = [tuple(r) for r in dict(STAGES)["sentencepiece"](spark, docs, "").collect()]
    assert sorted(map(str, got)) == sorted(str(want(r[0], r[1])) for r in rows)
