"""Operators on documents: against brute force, and on nulls, empty tables, repeated rows and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import language_id, licence_scan, line_dedup, lm_scoring, minhash_dedup, mixing, sentencepiece_codec
from panelwright.llm.queries import QUERIES, tokenizer_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SAMPLE = "/root/testdata/sf0.001"
WORDS = "amber birch cedar delta ember frost grove heath inlet jetty knoll ledge marsh north ocean plain quarry ridge shoal tarn".split()


def prose(seed: int, n: int) -> list[str]:
    return [f"{WORDS[(seed * 7 + k * k * (seed % 5 + 1) + k) % len(WORDS)]}{(seed * 31 + k * 17) % 97}" for k in range(n)]


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text))


@pytest.fixture
def tables(spark, tmp_path):
    def build(rows, name="documents", schema=DOCS):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return build


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows."""
    long = " ".join(prose(3, 30_000))
    return [row(1, "plain words here"), row(1, "plain words here"), row(2, None), row(3, ""), row(None, "plain words here"), row(4, long, None, None),
            row(5, " \n\t"), row(6, "1234 !?", "fr", None), row(7, "naïve ﬁ é 🙂 漢字 ▁ <s>")]


TEXT_QUERIES = ["op1_minhash_dedup", "op4_lm_scoring", "op5_licence_scan", "op7_language_id", "op8_mixing", "op9_sentencepiece", "op10_line_dedup"]


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_odd_rows_each_get_a_row(spark, tables, odd_rows, name):
    out = QUERIES[name](spark, tables(odd_rows)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in odd_rows)
    assert len({tuple(r) for r in out if r["doc_id"] == 1}) == (2 if name == "op8_mixing" else 1)


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_no_rows(spark, tables, name):
    assert QUERIES[name](spark, tables([])).collect() == []


def test_near_copies_and_exact_copies(spark):
    base = prose(1, 200)
    near, far = list(base), list(base)
    near[100] = "changed"
    far[::4] = [f"other{k}" for k in range(50)]
    texts = {10: base, 11: near, 12: base, 13: far, 14: prose(2, 200), 15: prose(3, 3), 16: prose(3, 3)}
    got = minhash_dedup.near_duplicates(spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string"))
    assert {r["doc_id"]: (r["class_id"], r["kept"]) for r in got.collect()} == {
        10: (10, True), 11: (10, False), 12: (10, False), 13: (13, True), 14: (14, True), 15: (15, True), 16: (15, False),
    }


def test_near_duplicates_equal_brute_force(spark):
    """Classes from all pairs at 0.8 of weighted Jaccard; no idf here, as all shingles are rare."""
    docs = {}
    for family in range(6):
        base = prose(family + 20, 150)
        for k in range(5):
            text = list(base)
            for j in range(k):
                text[(j * 37 + 5) % 150] = f"edit{family}{j}"
            docs[family * 10 + k] = text
    shingles = {k: Counter(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for k, t in docs.items()}
    root = {k: k for k in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in docs:
        for b in docs:
            if a < b and sum((shingles[a] & shingles[b]).values()) / sum((shingles[a] | shingles[b]).values()) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    frame = spark.createDataFrame([(k, " ".join(t)) for k, t in docs.items()], "doc_id long, text string")
    got = minhash_dedup.near_duplicates(frame, idf_share=0.999)
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == {k: find(k) for k in docs}


def test_base_scores_equal_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").select("doc_id", "text").collect()]
    tokens = {k: re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None] for k, t in docs}
    counts = Counter(x for k, ts in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for x in ts)
    total, distinct = sum(counts.values()), len(counts)
    out = QUERIES["op4_lm_scoring"](spark, SAMPLE).collect()
    assert len(out) == len(docs)
    for r in out:
        ts = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(counts[x] > 0 for x in ts), total)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in ts), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0

    # On held-out texts the model needs far fewer bits than bytes coded one by one by their frequencies.
    training = Counter(b for k, t in docs if zlib.crc32(str(k).encode()) % 7 != 2 for b in (t or "").lower().encode())
    texts, size = dict(docs), sum(training.values())
    held = [r for r in out if r["held_out"]]
    plain = sum(math.log10((training[b] + 1) / (size + 256)) for r in held for b in (texts[r["doc_id"]] or "").lower().encode())
    assert held and sum(r["score"] for r in held) > 0.7 * plain


def test_probabilities_of_a_decision_sum_to_one(spark):
    """All one-byte texts together have no more than probability 1."""
    training = spark.createDataFrame([("abc abd " * 50,)], "text string")
    texts = [(bytes([k]).decode(),) for k in range(1, 128) if not 65 <= k <= 90]
    scores = lm_scoring.model_scores(spark.createDataFrame(texts, "text string"), training).collect()
    assert sum(10 ** r["score"] for r in scores) <= 1 + 1e-6


def test_language_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_of_texts_without_letters_and_clashing_names(spark):
    labelled = spark.createDataFrame([("the cat sat on the mat", "en"), ("le chat est sur le tapis", "fr"), (None, "de"), ("x", None)], "text string, lang string")
    model = language_id.learn(labelled)
    docs = spark.createDataFrame([(1, "the mat", 5), (2, "12 34", 5), (3, None, 5), (4, "", 5), (5, "le tapis", 5)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert got == {1: "en", 2: "und", 3: "und", 4: "und", 5: "fr"}
    kept = language_id.reject_unknown(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 5}


def test_licences_by_canonical_digest(spark):
    known = spark.createDataFrame([("L", "Copyright 2001 Someone\nUse this Licence, as is."), ("E", "!!")], "licence string, text string")
    docs = [(1, "copyright (c) 2020 Other\n\nuse THIS license as is"), (2, "use this license as is not"), (3, "intro\nUse this licence as is!"), (4, None), (5, "?")]
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in licence_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), known).collect()}
    assert got == {1: ("L", ["L"]), 2: (None, []), 3: (None, ["L"]), 4: (None, []), 5: (None, [])}


def test_mix_stays_within_one_block_of_its_weights(spark):
    sizes, weights = {"a": 1200, "b": 640, "c": 320}, {"a": 5.0, "b": 3.0, "c": 2.0}
    docs = spark.createDataFrame([(k * 10 + j, s) for j, (s, n) in enumerate(sizes.items()) for k in range(n)], "doc_id long, source string")
    rows = mixing.mix(docs, spark.createDataFrame(list(weights.items()), "source string, weight double"), block_rows=8, resolution=10).collect()
    assert len(rows) == sum(sizes.values()) and len({r["position"] for r in rows}) == len(rows)
    first_empty = min(max(r["slot"] for r in rows if r["source"] == s) for s in sizes)
    for t in range(1, first_empty):
        for s, w in weights.items():
            placed = len({r["slot"] for r in rows if r["source"] == s and r["slot"] < t})
            assert abs(placed - t * w / 10) < 1


def test_ids_and_texts_equal_the_library(spark, odd_rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=tokenizer_model())
    texts = [t for _, t, *_ in odd_rows] + ["  two  spaces ", "a" * 3000, "x\n\ny\r\n", "\u0000nul", "ＡＢＣ ①", "▁▁ ▁", "the" * 400, "é" * 50, "</s> <unk> <0x41>"]
    texts += [r["text"] for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").select("text").collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = sentencepiece_codec.encode(frame.selectExpr("*", "1 AS ids"), tokenizer_model())
    for r in sentencepiece_codec.decode(coded, tokenizer_model()).collect():
        ids = sp.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids), texts[r["doc_id"]]
        assert r["decoded"] == sp.decode(ids)


def test_sentencepiece_digests(spark, tables):
    (got,) = QUERIES["op9_sentencepiece"](spark, tables([row(1, None)])).collect()
    assert got["n_tokens"] == 2 and got["ids_sha256"] == hashlib.sha256(struct.pack("<2I", 1, 2)).hexdigest()
    assert got["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_recurring_lines_go_and_the_first_document_keeps_them(spark):
    own = [re.sub(r"\d", "", " ".join(prose(k, 12))) for k in range(5)]
    docs = [(k, f"session {k} opened by user{k} at gate\n{own[k]}") for k in range(5)] + [(9, "once only seen here"), (10, None), (None, "session 7 opened by user7 at gate")]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, n_lines int")
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.drop_recurring(frame).collect()}
    assert got[0] == (docs[0][1], 0)
    assert all(got[k] == (own[k], 1) for k in range(1, 5))
    assert got[9] == ("once only seen here", 0) and got[10] == (None, 0) and got[None][1] == 0


def test_templates_generalise_differing_tokens():
    known = line_dedup.Templates(10, 3, 0.8)
    line = "a b c d e f g h i j".split()
    assert known.match(line) == 0
    assert known.match([*line[:8], "x", "j"]) == 0
    assert known.all[0][8] == line_dedup.FIELD
    assert known.match("a b c k l m n o p q".split()) == 1


def test_licence_texts_match_wherever_they_are_wrapped(spark):
    import textwrap

    from panelwright.llm.licence_texts import TEXTS, known_licences

    docs, want = [], {}
    for n, (name, text) in enumerate((k, v) for k, v in TEXTS.items() if len(v) > 500):
        plain = " ".join(text.split())
        for k, width in enumerate((60, 72, 78, 79, 80, 100, 120, 10_000)):
            docs.append((n * 100 + k, "Copyright (c) 2024 Someone\n\n" + textwrap.fill(plain, width)))
            want[n * 100 + k] = name
    found = licence_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), known_licences(spark))
    assert {r["doc_id"]: r["licence"] for r in found.collect()} == want


def test_spellings_are_whole_words(spark):
    known = spark.createDataFrame([("A", "the owner s right whilst whilst 5 percent"), ("B", "owner shall programmers percentages")], "licence string, text string")
    docs = [(1, "The owner right, while while 5 per cent"), (2, "ownerhall programrs per centages"), (3, "owner shall programmers percentages")]
    found = licence_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), known)
    assert {r["doc_id"]: r["licence"] for r in found.collect()} == {1: "A", 2: None, 3: "B"}


def test_language_equals_brute_force(spark):
    """Sets of n-grams instead of filters, over whole texts; a long text in pieces among short ones."""
    rng = random.Random(2)
    words = {"en": "the quick brown fox over lazy dogs river bank stone".split(), "fr": "le vieux renard brun saute rivière chien été stone".split(), "xx": "zul qarn vex the".split()}
    labelled = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 40))), lang) for k, lang in enumerate(["en"] * 40 + ["fr"] * 30 + ["xx"] * 10)]

    def grams(text):
        out = []
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            out += [padded[i : i + n] for n in (3, 4) for i in range(len(padded) - n + 1)]
        return out

    counts = {lang: Counter(g for _, t, own in labelled if own == lang for g in grams(t)) for lang in words}
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    best = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    known = {lang: {g for g, v in s.items() if v >= 1e-5 and v >= 0.1 * best[g]} for lang, s in share.items()}
    model = language_id.learn(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    texts = [" ".join(rng.choice(sum(words.values(), [])) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    texts += ["le renard " * 80_000, "x" * 700_000, "", "12"]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    order = sorted(words, key=lambda lang: (-sum(own == lang for *_, own in labelled), lang))
    for k, text in enumerate(texts):
        own = grams(text)
        rates = [sum(g in known[lang] for g in own) / len(own) if own else 0.0 for lang in order]
        assert got[k]["lang_pred"] == (order[rates.index(max(rates))] if own else "und")
        assert math.isclose(got[k]["score"], max(rates), abs_tol=1e-4)


def test_recurring_lines_equal_brute_force(spark):
    """Lines that differ in numbers only: documents per masked line, counted one by one."""
    rng = random.Random(9)
    kinds = [" ".join(rng.sample(WORDS, 6)) + " {} at {}" for _ in range(12)]
    docs = [(k, "\n".join(rng.choice(kinds).format(rng.randint(1, 999), rng.randint(1, 99)) for _ in range(rng.randint(1, 3)))) for k in range(14)]

    def mask(line):
        return re.sub(r"\S*\d\S*", "#", line)

    holders = {}
    for k, text in docs:
        for line in text.split("\n"):
            holders.setdefault(mask(line), set()).add(k)
    want = {}
    for k, text in docs:
        lost = [len(holders[mask(x)]) >= 3 and min(holders[mask(x)]) != k for x in text.split("\n")]
        want[k] = "\n".join(x for x, gone in zip(text.split("\n"), lost) if not gone)
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_score_depends_on_the_text_alone():
    rng = np.random.default_rng(0)
    tree = lm_scoring.huffman(rng.integers(1, 1000, 256))
    logits, first = rng.normal(size=lm_scoring._OFFSETS[-1]).astype(np.float32), np.full((lm_scoring._GATES, lm_scoring.CONTEXTS), 0.4)
    texts = ["the old river " * k for k in (1, 20, 300, 3000)] + ["", None, "x" * 300_000, "word and " * 40_000]
    alone = [lm_scoring.mix([t], tree, logits, first, 0.002)[0][0] for t in texts]
    assert lm_scoring.mix(texts, tree, logits, first, 0.002)[0].tolist() == alone


def test_first_weights_come_from_all_training_texts(spark):
    """Over a thousand texts, short ones among them: the mean, by bytes, of what each ends with."""
    texts = [" ".join(prose(k, 4 + k % 60)) for k in range(1200)] + ["a", "", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    tree = lm_scoring.huffman(lm_scoring.byte_counts(docs))
    logits = lm_scoring.context_logits(docs, tree)
    model = spark.sparkContext.broadcast((lm_scoring.astuple(tree), logits))
    ends = lm_scoring.mix(texts, tree, logits, np.full((lm_scoring._GATES, lm_scoring.CONTEXTS), 0.4), 0.002)[1]
    want = np.average(ends, 0, [len(t or "") + 1 for t in texts])
    assert np.allclose(lm_scoring.first_weights(docs, model, 0.002), want, rtol=1e-12)


def test_context_logits_count_every_decision(spark):
    """Packed blocks of many tasks add up to the counts of all texts."""
    texts = [" ".join(prose(k, 40)) for k in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    tree = lm_scoring.huffman(lm_scoring.byte_counts(docs))
    counts = np.zeros((lm_scoring._OFFSETS[-1], 2), np.int64)
    for text in texts:
        data, _, contexts = lm_scoring._read([lm_scoring.Part(0, text.encode() + b"\0", b"", 0)])
        size, spot = lm_scoring._decisions(tree, data)
        for k, context in enumerate(contexts):
            np.add.at(counts, (lm_scoring._OFFSETS[k] + lm_scoring._slots(k, context, size, tree.node[spot]), tree.bit[spot]), 1)
    want = np.log((counts[:, 1] + 0.2) / (counts[:, 0] + 0.2)).astype(np.float16)
    assert (lm_scoring.context_logits(docs, tree) == want).all()
    block = np.random.default_rng(0).integers(0, 1 << 31, lm_scoring._BLOCK)
    assert (lm_scoring._unpacked(lm_scoring._packed(block)) == block).all()


def test_base_scores_move_a_rare_token_once_a_step(spark):
    """No row by text and token leaves a task, and repeated rows are each scored as one text."""
    words = [f"w{k}" for k in range(50)]
    docs = [(k, " ".join([*words, *words[: k % 7], "\x1c\xa0 Éa", "\tA\x0b"])) for k in range(40)] + [(3, "Same same  other"), (3, "Same same  other"), (None, "w1"), (4, "")]
    rows = spark.createDataFrame(docs, "doc long, text string").coalesce(1).selectExpr("coalesce(doc, -1) AS doc", "xxhash64(text) AS body", "text")
    words_known = spark.sparkContext.broadcast((pa.array(["w0"]), np.zeros(1)))
    moved = lm_scoring._others(rows, words_known).collect()
    assert len({r["token"] for r in moved}) == len(moved) == 54
    counts = Counter(x for _, t in docs for x in [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None])
    for frequent in (1, 20, 100_000):
        keyed = rows.selectExpr("struct(doc, body) AS key", "text")
        got = {(r["key"]["doc"], r["text"]): r for r in lm_scoring.unigram_scores(keyed, rows.select("text"), frequent).join(keyed.distinct(), "key").collect()}
        assert len(got) == len(set(docs))
        for doc, text in docs:
            tokens = [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)), None]
            r = got[-1 if doc is None else doc, text]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), len(tokens), sum(counts.values()))
            total = sum(math.log10((counts[x] + 1) / (sum(counts.values()) + len(counts) + 1)) for x in tokens)
            assert math.isclose(r["base_score"], total, rel_tol=1e-9)


def test_pieces_of_long_texts_read_like_the_whole():
    """Bytes and contexts of the pieces, one behind the other, are those of the text."""
    text = ("some words of varying lengths, né " * 20_000).encode()
    parts = list(lm_scoring._pieces(0, text))
    assert len(parts) > 3 and b"".join(p.body for p in parts) == text + b"\0"
    whole, _, contexts = lm_scoring._read([lm_scoring.Part(0, text + b"\0", b"", 0)])
    read = [lm_scoring._read([p]) for p in parts]
    assert (np.concatenate([r[0] for r in read]) == whole).all()
    for k in range(lm_scoring.CONTEXTS):
        assert (np.concatenate([r[2][k] for r in read]) == contexts[k]).all()


def test_links_of_a_group_equal_all_pairs(spark):
    """Links between components, found by blocks, against similarities worked out one by one."""
    rng = random.Random(3)
    base = prose(4, 60)
    texts = []
    for _ in range(24):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(60)] = f"edit{rng.random()}"
        texts.append(" ".join(text + base[:9]))
    reader, weights = minhash_dedup.ShingleReader(5), np.random.default_rng(1).uniform(0.2, 1, 1 << 20)
    component = [k // 3 for k in range(24)]

    def similarity(i, j):
        a, b = ({h: n * weights[h % (1 << 20)] for h, n in zip(*(x.tolist() for x in reader.read([texts[k]])[:2]))} for k in (i, j))
        shared = sum(min(a[h], b[h]) for h in a.keys() & b.keys())
        return shared / (sum(a.values()) + sum(b.values()) - shared)

    for lo, hi, own in ((0, 0, [0] * 24), (0, 1, [k % 2 for k in range(24)])):
        group = pa.table({"bucket": [7] * 24, "lo": [lo] * 24, "hi": [hi] * 24, "node": list(range(24)), "component": component, "own": own, "text": texts, "buckets": [[k, 7] for k in range(24)]})
        found = minhash_dedup._spanning_links(group.combine_chunks(), reader, weights, 0.8)
        allowed = [(i, j) for i in range(24) for j in range(24) if component[i] != component[j] and (i < j if lo == hi else own[i] < own[j])]
        want = {(i, j) for i, j in allowed if similarity(i, j) >= 0.8}
        assert {(i, j) for i, j, _ in found} <= want and all(math.isclose(s, similarity(i, j), rel_tol=1e-6) for i, j, s in found)

        def joined(links):
            root = list(range(8))
            for i, j in links:
                a, b = root[component[i]], root[component[j]]
                root = [a if r == b else r for r in root]
            return [[r == q for q in root] for r in root]

        assert joined([(i, j) for i, j, _ in found]) == joined(want) and len(found) < 8


def test_near_duplicates_in_blocks_and_with_default_weights(spark):
    """Copies edited at random, so that few resemble any one: small blocks and one block give the brute-force classes."""
    rng = random.Random(11)
    docs = {}
    for family in range(3):
        base = prose(family + 40, 80)
        for k in range(30):
            text = list(base)
            for _ in range(rng.randint(1, 2)):
                text[rng.randrange(80)] = f"w{rng.random()}"
            docs[family * 100 + k] = " ".join(text)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    reader = minhash_dedup.ShingleReader(5)
    table = minhash_dedup._idf(minhash_dedup.document_frequencies(frame, 5), len(docs), 0.1)
    weighed = {k: {h: n * float(table[h % (1 << 20)]) for h, n in zip(*(x.tolist() for x in reader.read([t])[:2]))} for k, t in docs.items()}
    assert min(w for d in weighed.values() for w in d.values()) < 0.9  # idf takes part
    root = {k: k for k in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in docs:
        for b in docs:
            if a < b:
                shared = sum(min(w, weighed[b][h]) for h, w in weighed[a].items() if h in weighed[b])
                if shared / (sum(weighed[a].values()) + sum(weighed[b].values()) - shared) >= 0.8:
                    root[max(find(a), find(b))] = min(find(a), find(b))
    want = {k: find(k) for k in docs}
    for block in (7, 256):
        assert {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(frame, block=block).collect()} == want


def test_counting_tells_equal_contexts_apart_once(monkeypatch):
    """Decisions are worked out by different context and byte, with their number, not by every byte."""
    rng = np.random.default_rng(1)
    tree = lm_scoring.huffman(rng.integers(1, 1000, 256))
    data, _, contexts = lm_scoring._read(next(lm_scoring._parts(["the old river " * 2000])))
    want = np.zeros(2 * lm_scoring._OFFSETS[-1], np.int32)
    size, spot = lm_scoring._decisions(tree, data)
    for k, context in enumerate(contexts):
        np.add.at(want, 2 * (lm_scoring._OFFSETS[k] + lm_scoring._slots(k, context, size, tree.node[spot])) + tree.bit[spot], 1)
    seen, plain = [], lm_scoring._decisions
    monkeypatch.setattr(lm_scoring, "_decisions", lambda tree, data: (seen.append(len(data)), plain(tree, data))[1])
    got = np.zeros_like(want)
    lm_scoring._add_counts(got, tree, [lm_scoring._keys(c, data) for c in contexts])
    assert (got == want).all() and sum(seen) < 100


def test_half_precision_by_shifted_bits():
    half = np.arange(1 << 16, dtype=np.uint16).view(np.float16)
    half = half[np.isfinite(half)]
    assert (lm_scoring._single(half) == half.astype(np.float32)).all()


def test_byte_counts_of_odd_lengths_nulls_and_capitals(spark):
    texts = ["aBc", "É", "", None, "Z", "x" * 300_001]
    want = Counter(b for t in texts for b in re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode() + b"\0")
    got = lm_scoring.byte_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert {k: n for k, n in enumerate(got.tolist()) if n} == want


def test_mixing_equals_a_decision_by_decision_loop():
    """Weights and refinement adapt after every turn: 64 bytes up to byte 4096, 512 after it."""
    rng = np.random.default_rng(2)
    texts = ["", "Of the old river", " ".join(prose(1, 60)), " ".join(prose(2, 1500))]
    counts = np.bincount(np.frombuffer("\0".join(texts).lower().encode(), np.uint8), minlength=256)
    tree, rate = lm_scoring.huffman(counts), 0.002
    logits = rng.normal(size=lm_scoring._OFFSETS[-1]).astype(np.float16)
    first = rng.uniform(0.2, 0.5, (lm_scoring._GATES, lm_scoring.CONTEXTS))
    bins = lm_scoring._BINS
    got, ends = lm_scoring.mix(texts, tree, logits, first, rate)
    assert len(texts[-1]) > 6000
    for text, score, end in zip(texts, got, ends):
        data, _, contexts = lm_scoring._read([lm_scoring.Part(0, text.lower().encode() + b"\0", b"", 0)])
        weights, ones, met, total = first.copy(), 8 / (1 + np.exp(bins / 2 - 0.5 - np.arange(bins))), np.full(bins, 8.0), 0.0
        for turn in [slice(a, a + 64) for a in range(0, 4096, 64)] + [slice(a, a + 512) for a in range(4096, len(data), 512)]:
            change, new = np.zeros_like(weights), []
            for byte, *found in zip(data[turn].tolist(), *(c[turn] for c in contexts)):
                for at in range(tree.start[byte], tree.start[byte] + tree.size[byte]):
                    slots = [(int(c) + int(tree.node[at])) % (1 << 32) >> 32 - b for c, b in zip(found, lm_scoring._BITS)]
                    s = np.array([logits[o + x] for o, x in zip(lm_scoring._OFFSETS, slots)], np.float64)
                    bit, gate = int(tree.bit[at]), min(int(tree.depth[at]), lm_scoring._GATES - 1)
                    z = min(max(weights[gate] @ s, 0.01 - bins / 2), bins / 2 - 0.01)
                    p = 1 / (1 + math.exp(-z))
                    change[gate] += rate * (bit - p) * s
                    cell = int(z + bins / 2)
                    refined = 0.7 * p + 0.3 * ones[cell] / met[cell]
                    total += math.log10(refined if bit else 1 - refined)
                    new.append((cell, bit))
            weights += np.clip(change, -0.1, 0.1)
            for cell, bit in new:
                met[cell] += 1
                ones[cell] += bit
        assert math.isclose(score, total, rel_tol=1e-4) and np.allclose(end, weights, atol=1e-4)
