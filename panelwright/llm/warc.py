"""WARC archives: written by Spark's text writer, read back in splits by verified record chains.

A reader that starts inside a file cannot trust a line that looks like a record's first: payloads may hold one. So tasks
only note candidates, each with the offset of its successor (its length says where it ends). What can be reached from a
file's start along these links is a record, all else is payload. Within a split chains are followed in the task; from
split to split, by pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm.shared import cut, skew_join, written

MAGIC = b"WARC/1."
END = "\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a payload that a task gathers in one piece.
_PIECE = 1 << 22


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, without a prefix."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _one_line(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """One record per row of ``pages`` (page_id, url, html) under ``path``.

    Payloads are the html in UTF-8, null html an empty one. Of records with equal payloads of at least ``min_bytes`` bytes the
    one of the smallest page_id is a response and the others are revisits that refer to it and hold no payload; rows
    repeated with that page_id are all responses. Null url is empty; null page_id gives a record without a number. Other
    columns do not matter. Only digests move to find equal payloads; a page's text moves only to meet those found.
    """
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"), _one_line(F.col("url")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    page = page.withColumns({"digest": base32_sha1(F.col("html")), "size": F.octet_length("html").cast("long")})
    first = page.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Written first, so that Spark knows its size: pages move only if it is too large to broadcast.
    first = written(first.where("n > 1").drop("n"), "warc-equal-payloads")
    page = skew_join(page, first, ["digest", "size"], "left")
    again = F.coalesce(F.col("first") != F.col("page_id"), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, "html"))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    refers = F.concat(F.lit("WARC-Refers-To: <urn:x-page:"), F.col("first").cast("string"), F.lit(f">\r\nWARC-Profile: {_PROFILE}\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:x-page:"),
        number,
        F.lit(f">\r\nWARC-Date: {_DATE}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\n"),
        F.when(again, refers).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
    )
    page.select(record.alias("value")).write.option("lineSep", END).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Every byte of the files, cut at candidates and split starts.

    (file, split, seq, start, size, candidate, head, whole, content): start counts from the split's first line; head holds
    a candidate's header lines, or a split's first lines up to an empty one, as far as the split has them (whole).
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("line")
    )
    names = ["file", "split", "seq", "start", "size", "candidate", "head", "whole", "content"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple | None = None
        seq = start = at = 0
        candidate = in_head = whole = False
        head: list[bytes] = []
        body: list[bytes] = []
        rows: list[tuple] = []

        def close() -> None:
            nonlocal seq, start, body, head
            if body:
                lead = b"".join(head) if candidate or seq == 0 else None
                rows.append((*place, seq, start, at - start, candidate, lead, whole, b"".join(body)))
                seq += 1
            start, body, head = at, [], []

        for batch in batches:
            for file, split, line in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "line"))):
                if (file, split) != place:
                    if place:
                        close()
                    place, seq, start, at, candidate, in_head, whole = (file, split), 0, 0, 0, False, True, False
                if line.startswith(MAGIC):
                    close()
                    candidate, in_head, whole = True, True, False
                elif at - start >= _PIECE and not in_head:
                    close()
                    candidate = False
                full = line + b"\n"
                body.append(full)
                at += len(full)
                if in_head:
                    head.append(full)
                    if line == b"\r":
                        in_head, whole = False, True
            done, rows = rows, []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 9, types)], names)
        if place:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names)

    schema = "file string, split long, seq long, start long, size long, candidate boolean, head binary, whole boolean, content binary"
    return written(lines.mapInArrow(run, schema), "warc-segments")


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("head"), rf"(?im)^{name}:[ \t]*(.*?)[ \t\r]*$", 1)


def _candidates(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, split, off, next, head_size, head) of candidates with a length, and (file, split, base) of splits."""
    sizes = segments.groupBy("file", "split").agg(F.sum("size").alias("total"))
    splits = Window.partitionBy("file").orderBy("split")  # a row a split
    bases = sizes.select("file", "split", (F.sum("total").over(splits) - F.col("total")).alias("base"))
    # A header that a split's end cuts goes on in the lines before the next split's first candidate.
    leads = segments.where("seq = 0").select("file", "split", "candidate", "head", "whole")
    cuts = cut(bases.join(leads, ["file", "split"], "left").select(
        "file", "split", "base",
        F.lead(F.when(~F.col("candidate") & F.col("whole"), F.col("head"))).over(splits).alias("rest"),
    ))
    found = segments.where("candidate").select("file", "split", "seq", "start", "head", "whole").join(cuts, ["file", "split"])
    found = found.withColumn("head", F.when(F.col("whole"), F.col("head")).otherwise(F.concat("head", "rest"))).where("head IS NOT NULL")
    found = found.withColumns({"off": F.col("base") + F.col("start"), "head_size": F.length("head").cast("long")})
    found = found.withColumn("head", F.col("head").cast("string"))
    found = found.withColumn("length", F.expr("try_cast(" + r"regexp_extract(head, '(?im)^Content-Length:[ \\t]*([0-9]+)[ \\t\\r]*$', 1)" + " AS bigint)"))
    links = found.where("length IS NOT NULL").withColumn("next", F.expr("off + head_size + length + 4"))
    return written(links.select("file", "split", "seq", "off", "next", "head_size", "length", "head"), "warc-links"), cuts.select("file", "split", "base")


def _walk(links: DataFrame, columns: str, follow) -> DataFrame:
    """``follow`` over the links of each split, streamed: a task holds one split's offsets at a time."""
    ordered = links.repartition("file", "split").sortWithinPartitions("file", "split", "off")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["file"], row["split"]) != place:
                    if rows:
                        yield pa.RecordBatch.from_pylist(follow(rows), schema)
                    place, rows = (row["file"], row["split"]), []
                rows.append(row)
        if rows:
            yield pa.RecordBatch.from_pylist(follow(rows), schema)

    schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64()}[c.split()[1]]) for c in columns.split(", ")])
    return ordered.mapInArrow(run, columns)


def _exits(rows: list[dict]) -> list[dict]:
    """Where each candidate's chain leaves its split."""
    exit_of: dict[int, int] = {}
    for row in reversed(rows):
        exit_of[row["off"]] = exit_of.get(row["next"], row["next"])
    return [{"file": r["file"], "off": r["off"], "exit": exit_of[r["off"]]} for r in rows]


def _reached(rows: list[dict]) -> list[dict]:
    """The candidates on the chain from a split's entries."""
    marked = {r["off"] for r in rows if r["entry"]}
    for row in rows:
        if row["off"] in marked:
            marked.add(row["next"])
    return [{"file": r["file"], "split": r["split"], "off": r["off"]} for r in rows if r["off"] in marked]


def _verified(links: DataFrame) -> DataFrame:
    """(file, split, off) of the records: the candidates that chains from the files' starts reach."""
    jumps = cut(_walk(links.select("file", "split", "off", "next"), "file string, off long, exit long", _exits))
    entries = cut(jumps.where("off = 0").select("file", "off"))
    count = entries.count()
    while count:
        # After k rounds a jump passes 2^k splits and the entries of the first 2^k splits are known.
        targets = entries.join(jumps, ["file", "off"]).select("file", F.col("exit").alias("off"))
        entries = cut(entries.union(targets.join(jumps.select("file", "off"), ["file", "off"], "left_semi")).distinct())
        far = jumps.selectExpr("file", "off AS exit", "exit AS far")
        jumps = cut(jumps.join(far, ["file", "exit"], "left").selectExpr("file", "off", "coalesce(far, exit) AS exit"))
        before, count = count, entries.count()
        if count == before:
            break
    marked = links.select("file", "split", "off", "next").join(entries.withColumn("entry", F.lit(True)), ["file", "off"], "left")
    return written(_walk(marked, "file string, split long, off long", _reached), "warc-records")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, off, record_type, record_id, target_uri, refers_to, payload_digest, payload), a row per record.

    payload is what follows the HTTP header of the record's block, null for revisits. Files without a record at their
    start give none; a chain that breaks off ends there. No file is read as a whole: splits are read by Spark and only
    the pieces of a record that splits cut are brought together.
    """
    segments = _segments(spark, path)
    links, bases = _candidates(segments)
    records = _verified(links)
    known = links.join(records, ["file", "split", "off"], "left_semi")
    marks = segments.select("file", "split", "seq").join(known.select("file", "split", "seq", "off"), ["file", "split", "seq"], "left")
    here = Window.partitionBy("file", "split").orderBy("seq")
    marks = marks.withColumn("own", F.last("off", True).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    lasts = known.groupBy("file", "split").agg(F.max("off").alias("last"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = bases.join(lasts, ["file", "split"], "left").select("file", "split", F.last("last", True).over(before).alias("carried"))
    owned = marks.join(carried, ["file", "split"]).selectExpr("file", "split", "seq", "coalesce(own, carried) AS owner").where("owner IS NOT NULL")
    parts = owned.groupBy("file", "owner").agg(F.count("*").alias("parts"))
    owned = owned.join(parts, ["file", "owner"]).join(known.select("file", "split", "seq", "off"), ["file", "split", "seq"], "left")
    # Most segments are a record each. The others, at splits' ends and where payloads hold the magic, are written first, so
    # that Spark knows their size: contents move only if they are too many to broadcast.
    at = ["file", "split", "seq"]
    simple = owned.where("parts = 1 AND off <=> owner").select(*at)
    bases = bases.select("file", "split", "base")
    odd = written(segments.select(*at).join(simple, at, "left_anti").join(owned.select(*at, "owner"), at, "left"), "warc-odd-segments")
    one = segments.select(*at, "start", "head", "content").join(odd.select(*at), at, "left_anti")
    one = one.join(written(bases, "warc-bases"), ["file", "split"]).withColumn("head_size", F.length("head").cast("long"))
    one = one.select("file", (F.col("base") + F.col("start")).alias("off"), F.col("head").cast("string").alias("head"), "head_size", "content")
    one = one.withColumn("length", F.regexp_extract("head", r"(?im)^Content-Length:[ \t]*([0-9]+)[ \t\r]*$", 1).cast("long"))
    many = segments.select(*at, "content").join(odd.where("owner IS NOT NULL"), at)
    many = many.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("split", "seq", "content"))).alias("c"))
    # A record's own pieces, as many as splits cut it into.
    many = many.select("file", F.col("owner").alias("off"), F.expr("aggregate(c.content, cast('' AS binary), (a, x) -> concat(a, x))").alias("content"))
    many = many.join(known.select("file", "off", "head", "head_size", "length"), ["file", "off"])
    columns = ["file", "off", "head", "head_size", "length", "content"]
    whole = one.select(*columns).union(many.select(*columns))
    block = F.expr("substring(content, cast(head_size + 1 AS int), cast(length AS int))")
    whole = whole.select("file", "off", "head", block.alias("block"))
    at = F.instr(F.col("block").cast("string"), F.lit(END))  # the HTTP header is ASCII, so characters are bytes
    payload = F.when(at > 0, F.expr("substring(block, cast(at + 3 AS int) + 1, length(block))")).otherwise(F.col("block"))
    kind = F.lower(_field("WARC-Type"))
    whole = whole.withColumn("at", at)
    return whole.select(
        "file",
        "off",
        kind.alias("record_type"),
        _field("WARC-Record-ID").alias("record_id"),
        _field("WARC-Target-URI").alias("target_uri"),
        F.nullif(_field("WARC-Refers-To"), F.lit("")).alias("refers_to"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        F.when(kind != "revisit", payload).alias("payload"),
    )
