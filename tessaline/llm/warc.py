"""WARC archives: writing pages with revisit records, reading archives back by boundary chains.

Writing. Pages of equal payload (SHA-1 and length) share one response record, that of the largest id; the others are
revisit records without a block that name it. Records are written by Spark's text sink, one file per task, each record
closed by CRLF CRLF.

Reading. Spark's text source cuts the files at every `WARC/1.0` line, also at those inside payloads, and splits large
files among tasks. Each piece becomes a candidate record; its offset is the bytes before it in its file, from sums
per split and within a split. The candidate's header gives the offset of its successor. From the start of each file
pointer jumping doubles the known chain in every round: the set of reached offsets is joined with pointers of length
2**k, and pointers with themselves. Candidates that no chain reaches lie in payloads; their bytes are put back into
the record before them.

Null payloads are empty. A null id is written as an empty id and read back as null; equal payloads under null ids are
responses only where no id is known. Rows of one id and payload that are the largest are all responses. Line breaks
and blanks in URLs are percent-encoded, as a header line can't hold them. An empty table gives an archive of no files
and no rows. Other columns of the input are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaline.llm.base import new_path, plain_unions, table, written

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Repeated digests that are broadcast at most, of less than 100 bytes each.
REPEATS = 50_000
DATE = "2024-01-01T00:00:00Z"


def base32(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: five hex digits are four digits of base 32. digest: a column of its own."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes a record per row. Ids are integers."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "hex": F.sha1(F.col("payload").cast("binary"))}).withColumn("digest", base32(F.col("hex")))
    first = rows.groupBy("digest", "bytes").agg(F.max("id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # only digests that repeat meet the rows again: few go to all tasks, more in an exchange, of which adaptive execution splits a hot digest
    first = written(first, "warc-repeats")
    rows = rows.join(F.broadcast(first) if first.count() <= REPEATS else first, ["digest", "bytes"], "left")
    revisit = F.col("target").isNotNull() & ~F.col("id").eqNullSafe(F.col("target"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A"), " ", "%20")
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", url)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), line("WARC-Refers-To", name(F.col("target"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _field(head: str, key: str) -> Column:
    """A field of a header that starts and ends with a line break."""
    found = F.regexp_extract(head, rf"(?i)\r\n{key}:[ \t]*([^\r\n]*)", 1)
    return F.when(found == "", None).otherwise(found)


def _with_header(rows: DataFrame) -> DataFrame:
    """rows with what the header of `body` says."""
    fields = {"type": "WARC-Type", "id": "WARC-Record-ID", "url": "WARC-Target-URI", "digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "length": "Content-Length"}
    rows = rows.withColumn("head", F.concat(F.lit("\r\n"), F.substring_index("body", END, 1), F.lit("\r\n")))
    rows = rows.withColumns({name: _field("head", key) for name, key in fields.items()})
    length = F.when((F.octet_length("head") <= F.octet_length("body")) & F.col("length").rlike("^[0-9]{1,18}$"), F.col("length").cast("long"))
    return rows.withColumns({"digest": F.regexp_replace("digest", "^sha1:", ""), "length": length, "head": F.octet_length("head").cast("long")})


def _block(body: Column, head: Column, length: Column) -> Column:
    """The block's text of a body that reaches to the record's end; head: the header's bytes with one line break before and after."""
    return F.substring(body.cast("binary"), (head + 1).cast("int"), length.cast("int")).cast("string")


def pieces(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """A row per piece: file, split, at (offset of its magic), next (of its successor, if it has a good header), what its
    header says, and digest and bytes of its block if the piece holds the record whole. The body stays only where it
    doesn't, or for all with payloads."""
    raw = (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("body"), F.monotonically_increasing_id().alias("nth"))
    )
    # a header and its blank line are head bytes: the line break put before it stands for the blank line's
    raw = _with_header(raw).withColumns({"size": F.octet_length("body").cast("long") + len(MAGIC), "reach": F.col("head") + F.col("length") + len(END)})
    raw = raw.withColumn("whole", F.coalesce(F.col("reach") == F.col("size") - len(MAGIC), F.lit(False)))
    raw = raw.withColumn("block", F.when(F.col("whole"), F.substring(F.col("body").cast("binary"), (F.col("head") + 1).cast("int"), F.col("length").cast("int"))))
    raw = raw.withColumns({"hex": F.sha1("block"), "own_bytes": F.octet_length("block").cast("long")}).withColumn("own", base32(F.col("hex")))
    columns = ["file", "split", "nth", "size", "reach", "head", "length", "whole", "type", "id", "url", "digest", "refers_to", "own", "own_bytes"]
    raw = written(raw.select(*columns, F.col("body") if payloads else F.when(~F.col("whole"), F.col("body")).alias("body")), "warc-raw")
    # per split only sums; they are few, and give each split's first offset
    sums = raw.groupBy("file", "split").agg(F.sum("size").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("file", "split", (F.coalesce(before, F.lit(0)) - len(MAGIC)).alias("base"))
    within = Window.partitionBy("file", "split").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = raw.join(sums, ["file", "split"]).withColumn("at", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    return written(placed.where("at >= 0").withColumn("next", F.col("at") + len(MAGIC) + F.col("reach")).drop("base", "nth", "size", "reach"), "warc-pieces")


def reached(candidates: DataFrame) -> DataFrame:
    """file and at of the candidates (file, at, next) on the chain from offset 0 of each file, by pointer jumping."""
    pointers = candidates.where("next is not null").select("file", "at", "next")
    most = candidates.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    known = candidates.where("at = 0").select("file", "at")
    for k in range(math.ceil(math.log2(most)) if most > 1 else 0):
        ahead = known.join(pointers, ["file", "at"]).select("file", F.col("next").alias("at"))
        known = known.unionByName(ahead)
        if 2 ** (k + 1) < most:
            after = pointers.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
            pointers = pointers.join(after, ["file", "next"]).select("file", "at", F.col("then").alias("next"))
        if k % 3 == 2:
            known, pointers = written(known), written(pointers)
    return known.join(candidates.select("file", "at"), ["file", "at"], "left_semi")


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record: file, at, type, id, url, digest, refers_to, length, own and own_bytes (digest and bytes of the
    block as read) and, if asked for, payload (the block's text)."""
    plain_unions(spark)
    found = pieces(spark, path, payloads)
    places = found.select("file", "at", "next")
    good = written(reached(places).withColumn("good", F.lit(True)), "warc-good")
    keep = ["file", "at", "type", "id", "url", "digest", "refers_to", "length", "own", "own_bytes", *(["payload"] if payloads else [])]
    marked = found.join(good, ["file", "at"], "left")
    whole = marked.where("good and whole")
    if payloads:
        whole = whole.withColumn("payload", _block(F.col("body"), F.col("head"), F.col("length")))
    # other pieces are parts of the last reached record before them, which a running maximum over offsets alone finds
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owner = places.join(good, ["file", "at"], "left").select("file", "at", F.max(F.when(F.col("good"), F.col("at"))).over(order).alias("owner"))
    parts = marked.where("good is null or not whole").join(owner, ["file", "at"]).where("owner is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("body", F.lit("")).alias("body")))), lambda p: p["body"]), MAGIC)
    cut = _with_header(parts.groupBy("file", F.col("owner").alias("at")).agg(text.alias("body"))).where("length is not null")
    cut = cut.withColumn("payload", _block(F.col("body"), F.col("head"), F.col("length")))
    cut = cut.withColumns({"hex": F.sha1(F.col("payload").cast("binary")), "own_bytes": F.octet_length("payload").cast("long")}).withColumn("own", base32(F.col("hex")))
    return whole.select(*keep).unionByName(cut.select(*keep))


def page_number(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    rows = read_archive(spark, path, payloads=False).select(page_number(F.col("id")).alias("page_id"), F.col("type").alias("record_type"), page_number(F.col("refers_to")).alias("refers_to"), "own", "own_bytes")
    rows = written(rows, "warc-read")
    # a revisit's payload is that of the response it names
    origin = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("own").alias("origin"), F.col("own_bytes").alias("origin_bytes"))
    origin = origin.groupBy("refers_to").agg(F.first("origin").alias("origin"), F.first("origin_bytes").alias("origin_bytes"))
    revisits = rows.where("record_type = 'revisit'").join(origin, "refers_to", "left").select("page_id", F.col("origin_bytes").alias("payload_bytes"), F.col("origin").alias("payload_digest"), "record_type", "refers_to")
    responses = rows.where("record_type = 'response'").select("page_id", F.col("own_bytes").alias("payload_bytes"), F.col("own").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(revisits)


OP3_SQL = """
with p as (
  select page_id, coalesce(html, '') as payload, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h from pages
), d as (
  select page_id, n, h, max(page_id) over (partition by h, n) as target,
    array_to_string(list_transform(range(0, 8), lambda i:
      array_to_string(list_transform(range(0, 4), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (1 + 5 * i)::int, 5))::bigint >> (15 - 5 * j)::int) & 31)::int, 1)), '')), '') as b32
  from p
)
select page_id, n::bigint as payload_bytes, b32 as payload_digest,
  case when page_id = target then 'response' else 'revisit' end as record_type,
  case when page_id = target then null else target end as refers_to
from d
"""
