"""Licence scan by canonical digests, with DataFrame operations only.

Texts are brought to a canonical form (lower case, words only, one spelling of equivalent words, copyright lines left
out) and hashed whole; a join with the digests of known texts names their licence. Besides the whole text, each of its
lines counts as a text of its own, which finds one-line notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import written

# Spellings that count as equal, in the canonical form on the right.
SPELLINGS = {
    "licence": "license",
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authorisation": "authorization",
    "authorise": "authorize",
    "behaviour": "behavior",
    "favour": "favor",
    "honour": "honor",
    "initialise": "initialize",
    "labour": "labor",
    "noncommercial": "non commercial",
    "organisation": "organization",
    "owner s": "owner",
    "percent": "per cent",
    "programme": "program",
    "recognise": "recognize",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}
# Fixed value: a line that only says whose copyright it is, since when. Sentences about copyright holders are none.
COPYRIGHT_LINE = r"^(portions )?(copyright|copyright c|c)( by)? \p{N}{4}( |$)"


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text that have a word and are no copyright lines.

    Spellings are replaced as whole words: words stand between two spaces each meanwhile, so neighbours share none. Joined
    by spaces, the lines are the same wherever the text was wrapped.
    """
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    words = F.concat(F.lit(" "), F.replace(F.replace(words, F.lit("\n"), F.lit(" \n ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    for other, usual in SPELLINGS.items():
        words = F.replace(words, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {usual.replace(' ', '  ')} "))
    lines = F.transform(F.split(words, "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " ")))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(COPYRIGHT_LINE))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_digests(licences: DataFrame) -> DataFrame:
    """(digest, licence) of known texts (licence, text); equal texts go by the smallest name; texts without words go."""
    whole = F.array_join(canonical_lines(F.col("text")), " ")
    named = licences.select("licence", whole.alias("whole")).where("licence IS NOT NULL AND whole != ''")
    return named.groupBy(digest(F.col("whole")).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, text_digest, licence, notices.

    licence is that of the known text equal to the whole text, or null; notices are the sorted licences of known texts that
    are a line of it, empty if none. Null texts and texts without a word have null text_digest and match nothing. Rows
    repeated with equal doc_id give equal rows. Texts stay in their tasks: only digests move, and the known ones, a
    table of names, are broadcast if Spark finds them small. Other columns do not matter.
    """
    known = known_digests(licences)
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    whole = F.when(F.size("lines") > 0, digest(F.array_join("lines", " ")))
    marked = lines.select("doc_id", whole.alias("text_digest"), F.transform(F.array_distinct("lines"), digest).alias("line_digests"))
    marked = written(marked, "text-digests")  # the texts are read once
    units = marked.where("text_digest IS NOT NULL").select("doc_id", "text_digest", F.explode("line_digests").alias("digest"))
    found = units.join(known, "digest").groupBy("doc_id", "text_digest").agg(F.sort_array(F.collect_set("licence")).alias("notices"))
    out = marked.select("doc_id", "text_digest").join(known.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    same = F.expr("_doc <=> doc_id AND _text = text_digest")
    found = found.withColumnsRenamed({"doc_id": "_doc", "text_digest": "_text"})
    none = F.array().cast("array<string>")
    return out.join(found, same, "left").select("doc_id", "text_digest", "licence", F.coalesce("notices", none).alias("notices"))
