"""One query per operator over its whole table, with production parameters, and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import exact_topk, hnsw_dedup, language_id, licence_scan, line_dedup, lm_scoring, minhash_dedup, mixing, secret_scan, sentencepiece_codec, shared, term_matrix, vector_codes, warc
from panelwright.llm.licence_texts import TEXTS, known_licences
from panelwright.llm.shared import scratch_path, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(divisor: int) -> F.Column:
    """Which part of the data a document belongs to, by its id alone."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def tokenizer_model(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Path(path).read_bytes()


@query
def op1_minhash_dedup(s, d):
    return minhash_dedup.near_duplicates(table(s, d, "documents").select("doc_id", "text"))


@query
def op2_warc(s, d):
    path = scratch_path(s, "warc")
    warc.write_archives(table(s, d, "pages"), path)
    number = F.expr("try_cast(regexp_extract(id, '<urn:x-page:(-?[0-9]+)>', 1) AS bigint)")
    back = warc.read_archives(s, path)
    back = back.select(
        F.col("record_id").alias("id"), "record_type", "refers_to", "payload_digest", warc.base32_sha1(F.col("payload")).alias("own_digest"),
        F.length("payload").cast("long").alias("own_bytes"),
    )
    back = back.withColumn("page_id", number).withColumn("id", F.col("refers_to")).withColumn("refers_to", number).drop("id")
    back = written(back, "warc-pages")
    held = back.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to")).agg(F.max("own_bytes").alias("held_bytes"))
    return shared.skew_join(back, held, ["refers_to"], "left").select(
        "page_id",
        F.coalesce("own_bytes", "held_bytes").alias("payload_bytes"),
        F.coalesce("own_digest", "payload_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


@query
def op3_exact_topk(s, d):
    whole = F.transform(
        "embedding",
        lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(F.lit(256.0) * x.cast("double")).cast("double")),
    )
    return exact_topk.top_k(exact_topk.whole_vectors(table(s, d, "embeddings"), whole), F.col("vec_id") % 50 == 0)


@query
def op4_lm_scoring(s, d):
    return lm_scoring.score_documents(table(s, d, "documents").select("doc_id", "text"), remainder(7) == 2)


@query
def op6_hnsw_dedup(s, d):
    return hnsw_dedup.near_duplicates(table(s, d, "embeddings"))


@query
def op5_licence_scan(s, d):
    found = licence_scan.scan(table(s, d, "documents").select("doc_id", "text"), known_licences(s))
    return found.withColumn("notices", F.array_join("notices", ","))


@query
def op7_language_id(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    model = language_id.learn(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@query
def op8_mixing(s, d):
    return mixing.mix(table(s, d, "documents").select("doc_id", "source"))


@query
def op9_sentencepiece(s, d):
    return sentencepiece_codec.round_trip(table(s, d, "documents").select("doc_id", "text"), tokenizer_model()).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_line_dedup(s, d):
    kept = line_dedup.drop_recurring(table(s, d, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query
def op11_secret_scan(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("path"), "text")
    found = secret_scan.scan(docs, scratch_path(s, "blob-ledger"))

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def of(*kinds: str) -> F.Column:
        return F.filter("spans", lambda x: x["kind"].isin(*kinds))

    base = of("assign", "access", "hex")
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op12_filter_audit(s, d):
    return term_matrix.filter_audit(table(s, d, "documents"), table(s, d, "labels"))


@query
def op13_vector_codes(s, d):
    coded = vector_codes.encode(table(s, d, "embeddings"))
    digits = F.transform("code", lambda x: F.lower(F.lpad(F.hex(x), 2, "0")))
    return coded.select("vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", "codebooks_sha256")


def _known_values() -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEXTS.items())


def _canonical_sql(text: str) -> str:
    """Lines as lists of words; each word, or pair of words, has one spelling."""
    words = {k: v for k, v in licence_scan.SPELLINGS.items() if " " not in k}
    usual = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in words.items()) + "}"
    line = "[w for w in string_split(x, ' ') if w <> '']"
    plain = f"[coalesce({usual}[w], w) for w in {line}]"
    # The one spelling of two words: a single s behind "owner" goes.
    apart = "[w[2] for w in list_zip(list_prepend('', l), l) if w[2] IS NOT NULL AND NOT (w[1] = 'owner' AND w[2] = 's')]"
    lines = f"string_split(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10))"
    joined = f"[array_to_string({apart}, ' ') for l in [{plain} for x in {lines}]]"
    year = r"^(portions )?(copyright|copyright c|c)( by)? \p{N}{4}( |$)"
    return f"[y for y in {joined} if y <> '' and not regexp_matches(y, '{year}')]"


def _secrets_sql() -> str:
    """Spans by rule: pieces between matches and the matches themselves, added up."""
    keyword = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    rules = [
        ("assign", keyword + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18),
        ("hex", "[0-9a-f]+", 0, 16),
        ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
        ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
        ("forge_token", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ]
    return " UNION ALL ".join(
        f"""SELECT r, {place} AS place, '{kind}' AS kind, [length(x) for x in string_split_regex(body, '{pattern}')] AS gap,
                   [length(x) for x in regexp_extract_all(body, '{pattern}')] AS size,
                   [length(x) >= {least} for x in regexp_extract_all(body, '{pattern}', {group})] AS ok FROM doc"""
        for place, (kind, pattern, group, least) in enumerate(rules)
    )


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assigning and averaging, one after the other."""
    steps = [
        f"""WITH whole AS MATERIALIZED (SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND list_bool_and([coalesce(isfinite(x), false) for x in embedding])),
            part AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM whole, range({parts}) t(p)),
            book0 AS MATERIALIZED (SELECT p, e, x AS c FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole) USING (vec_id)
                                   WHERE e < {entries})"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x,
                    min(struct_pack(d := list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x, c)])::BIGINT, e := e)) AS best
                FROM part JOIN book{k} USING (p) GROUP BY vec_id, p)"""
        )
        if k < rounds:
            steps.append(
                f"""mean{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (
                        SELECT p, best.e AS e, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m
                        FROM near{k}, range(1, 1 + (SELECT max(len(x)) FROM part)) t(i) GROUP BY ALL) GROUP BY p, e),
                   book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{k}.c::BIGINT[], book{k}.c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e))"""
            )
    return ", ".join(steps) + f"""
        , coded AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
                    FROM near{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
        FROM coded"""


ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH page AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        hashed AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS h FROM page),
        bits AS (SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first, unhex(h)::BIT::VARCHAR AS b FROM hashed)
        SELECT page_id, payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([substr(b, 5 * i + j, 1)::INT * (2 ** (5 - j))::INT
                                for j in range(1, 6)])::INT, 1) for i in range(0, 32)], '') AS payload_digest,
               CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM bits""",
    "op3_exact_topk": """
        WITH whole AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings WHERE embedding IS NOT NULL),
        pair AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
                 FROM whole q JOIN whole x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
        placed AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM pair)
        SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5""",
    "op5_licence_scan": f"""
        WITH given(licence, body) AS (VALUES {_known_values()}),
        known AS (SELECT sha256(array_to_string({_canonical_sql("body")}, ' ')) AS digest, min(licence) AS licence FROM given GROUP BY 1),
        doc AS (SELECT doc_id, {_canonical_sql("text")} AS lines FROM documents),
        marked AS (SELECT doc_id, CASE WHEN len(lines) > 0 THEN sha256(array_to_string(lines, ' ')) END AS text_digest, lines FROM doc),
        unit AS (SELECT doc_id, sha256(unnest(list_distinct(lines))) AS digest FROM marked),
        found AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM unit JOIN known USING (digest) GROUP BY 1)
        SELECT m.doc_id, m.text_digest, k.licence, coalesce(f.notices, '') AS notices
        FROM marked m LEFT JOIN known k ON k.digest = m.text_digest LEFT JOIN found f ON f.doc_id = m.doc_id""",
    "op8_mixing": """
        WITH RECURSIVE size AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        share AS (SELECT source, greatest(1, floor(sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM size) * 1000 + 0.5)::BIGINT) AS slots FROM size),
        ranked AS (SELECT source, slots, row_number() OVER (ORDER BY source) AS i FROM share),
        given AS (SELECT list(slots ORDER BY i) AS s, sum(slots)::BIGINT AS q FROM ranked),
        edf(t, pick, k) AS (
            SELECT -1::BIGINT, 0::BIGINT, [0::BIGINT for x in s] FROM given
            UNION ALL
            SELECT t + 1, best, [k[j] + CASE WHEN j = best THEN 1 ELSE 0 END for j in range(1, len(k) + 1)]
            FROM (SELECT t, k, list_min([{'d': ((k[j] + 1) * q + s[j] - 1) // s[j], 'j': j}
                                         for j in range(1, len(s) + 1) if (k[j] * q) // s[j] <= t + 1]).j AS best
                  FROM edf, given WHERE t + 1 < q)),
        pattern AS (SELECT source, slots, t AS slot, row_number() OVER (PARTITION BY source ORDER BY t) - 1 AS turn
                    FROM edf JOIN ranked ON i = pick WHERE t >= 0),
        placed AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS r FROM documents),
        spot AS (SELECT doc_id, p.source, r, r // 64 AS b, (r // 64) // a.slots * (SELECT q FROM given) + a.slot AS slot
                 FROM placed p JOIN pattern a ON a.source = p.source AND a.turn = (r // 64) % a.slots)
        SELECT doc_id, source, b + 1 AS block, slot::BIGINT AS slot, (slot * 64 + r % 64)::BIGINT AS position FROM spot""",
    "op11_secret_scan": f"""
        WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
        cut AS ({_secrets_sql()}),
        place AS (SELECT r, place, kind, gap, size, ok, unnest(range(1, len(size) + 1)) AS i FROM cut),
        span AS (SELECT r, place, kind, list_sum(gap[1:i])::BIGINT + coalesce(list_sum(size[1:i - 1]), 0)::BIGINT AS s, size[i] AS n FROM place WHERE ok[i]),
        said AS (SELECT r, place, s, kind, kind || ':' || s || ':' || (s + n) AS w FROM span),
        all_spans AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                             count(*) FILTER (kind = 'hex') AS n_hex, string_agg(w, ',' ORDER BY s, place) FILTER (place < 3) AS base,
                             string_agg(w, ',' ORDER BY s, place) AS spans FROM said GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM doc LEFT JOIN all_spans USING (r)""",
    "op12_filter_audit": r"""
        WITH word AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
                             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        fail AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
                        100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body), regexp_matches(body, '[#$%&*|]'),
                        coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false)] AS f FROM word),
        mark AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
        doc AS (SELECT f.*, coalesce(good, false) AS good, coalesce(bad, false) AS bad FROM fail f LEFT JOIN mark USING (doc_id)),
        letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        filters AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
                   WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        step AS (SELECT filter_order, k::INTEGER AS step, [instr('ABCDE', y) for y in string_split(filter_order, '')] AS o FROM filters, range(1, 6) t(k)),
        did AS (SELECT part, filter_order, step, o[step] AS own, f[o[step]] AS fails, list_bool_or([f[y] for y in o[1:step - 1]]) AS gone,
                       len([z for z in f if z]) AS n, good, bad FROM doc, step),
        total AS (SELECT part, filter_order, step, any_value(own) AS own, count(*) FILTER (NOT coalesce(gone, false) AND NOT fails) AS kept,
                         count(*) FILTER (fails AND NOT coalesce(gone, false)) AS removed, count(*) FILTER (fails AND gone) AS redundant,
                         count(*) FILTER (fails AND n = 1) AS unique_fails, count(*) FILTER (fails AND NOT coalesce(gone, false) AND good) AS good_lost,
                         count(*) FILTER (fails AND NOT coalesce(gone, false) AND bad) AS toxic_lost FROM did GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM total""",
    "op13_vector_codes": _codes_sql(),
}
