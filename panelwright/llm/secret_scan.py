"""Secret scan over an incremental ledger of blobs, with DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text. The ledger remembers, per address, which rules in
which version have read it and what they found. A scan reads only blobs that some rule version has not read yet, and
those with the missing rules only; findings then go back to all paths that hold the blob.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.shared import skew_join, written


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose group ``group`` has ``least`` characters or more.

    ``hint`` is found in every text with such a match; it keeps other texts from the slower search for positions. A rule
    that changes takes a new version.
    """

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# How secrets are written. Letters of keywords and of schemes in either case, ASCII only.
_KEYWORD = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
RULES = (
    Rule("assign", 1, _KEYWORD + "([A-Za-z0-9+/_.=-]+)", _KEYWORD + "[A-Za-z0-9+/_.=-]{12}", group=2, least=12),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}", "AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, "[0-9a-f]{16,}", "[0-9a-f]{16}"),
    Rule("private_key", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ"),
    Rule("forge_token", 1, "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]{36}"),
)
LEDGER = "digest string, rules array<string>, spans array<struct<rule: string, start: long, end: long>>"


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all scans so far; none where there has been no scan.

    A row holds a blob's address, the rule versions that read it, and all they found. So any part of a scan that was
    written before it broke off is a valid ledger, and rows written twice change nothing.
    """
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(path)


def _hits(rule: Rule) -> Column:
    """Per match: number, characters before it since the last one, its length, and whether it is long enough."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split("text", rule.pattern), F.length)
    found = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length)
    value = F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), F.length) if rule.group else found
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("size"), value.alias("value"))
    rows = F.transform(
        zipped,
        lambda x, i: F.struct(F.lit(rule.key).alias("rule"), i.alias("turn"), x["gap"].alias("gap"), x["size"].alias("size"), (x["value"] >= rule.least).alias("ok")),
    )
    none = F.array().cast("array<struct<rule:string,turn:int,gap:int,size:int,ok:boolean>>")
    wanted = F.array_contains("missing", rule.key) & F.col("text").rlike(rule.hint)
    return F.when(wanted, F.filter(rows, lambda x: x["size"].isNotNull())).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of blobs (digest, text, missing: keys of the rules to apply).

    Positions count code points from 0, ends are exclusive. Matches of one blob and rule are summed up in order; blobs are
    distinct, so such a group is one text's matches, however many paths hold it.
    """
    read = written(blobs.select("digest", "missing", F.concat(*[_hits(r) for r in rules]).alias("hits")), "secret-hits")
    hits = read.select("digest", F.explode("hits").alias("hit")).select("digest", "hit.*")
    upto = F.expr("sum(CAST(gap AS long) + size) OVER (PARTITION BY digest, rule ORDER BY turn)")
    spans = hits.withColumn("end", upto).where("ok").withColumn("start", F.col("end") - F.col("size"))
    by_blob = spans.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("rule", "start", "end"))).alias("spans"))
    return read.drop("hits").join(by_blob, "digest", "left").select(
        "digest", F.col("missing").alias("rules"), F.coalesce("spans", F.array().cast("array<struct<rule:string,start:bigint,end:bigint>>")).alias("spans")
    )


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks; returns (digest, path) of all versions, one row each.

    Only digests decide what is new. Where all is new, as in a first scan, texts go to their address in one shuffle that
    first drops the copies within each task. Otherwise they meet the list of new addresses before: Spark broadcasts it if it
    is small, and splits hot addresses if not.
    """
    addressed = written(versions.select("path", address(F.col("text")).alias("digest")), "secret-addresses")
    spark = versions.sparkSession
    texts = versions.select(address(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    try:
        ledger = read_ledger(spark, path)
        empty = ledger.isEmpty()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = True
    if empty:
        blobs = texts.groupBy("digest").agg(F.first("text").alias("text")).withColumn("missing", wanted)
    else:
        done = ledger.select("digest", F.explode("rules").alias("rule")).groupBy("digest").agg(F.collect_set("rule").alias("rules"))
        new = addressed.select("digest").distinct().join(done, "digest", "left")
        new = new.select("digest", F.coalesce(F.array_except(wanted, F.col("rules")), wanted).alias("missing")).where("size(missing) > 0")
        new = written(new, "secret-unseen")
        blobs = skew_join(texts, new, ["digest"]).groupBy("digest").agg(F.first("text").alias("text"), F.first("missing").alias("missing"))
    scan_blobs(blobs, rules).write.parquet(f"{path.rstrip('/')}/scan-{uuid.uuid4().hex}")
    return addressed


def scan(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per row of ``versions`` (path, text): path, digest, spans (array of kind, start, end by start, then rule).

    Only ``path`` and ``text`` are read; a path may occur in any number of versions, equal rows give equal rows, and a null
    path is a path like others. Null texts count as empty; an empty text has no spans. No versions: no rows, and
    nothing to remember. Findings of rule versions that are not asked for are not returned.
    """
    addressed = update_ledger(versions, path, rules)
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.key), F.struct(F.lit(k).alias("place"), F.lit(r.kind).alias("kind")))])
    found = read_ledger(versions.sparkSession, path).select("digest", F.explode("spans").alias("span")).select("digest", "span.*")
    found = found.withColumn("rule", order[F.col("rule")]).where("rule IS NOT NULL")
    found = found.groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("start", "rule.place", "rule.kind", "end"))).alias("found"))
    spans = F.coalesce(F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))), F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    return skew_join(addressed, found, ["digest"], "left").select("path", "digest", spans.alias("spans"))
