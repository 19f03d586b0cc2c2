"""WARC archives: records written by Spark's text writer, read back by boundary-chain verification.

Writing: one record for each page; of records with equal payloads the one with the smallest page_id is a response and
the others are revisits that name it. Reading: Spark's text reader splits files at every "WARC/1." and so works on
byte ranges of any file; each piece is a candidate record, whose header gives the offset of its successor. Payloads can
hold the magic or whole records, so pieces are kept only if the chain from the start of their file reaches them: by
pointer jumping, in as many rounds as the binary logarithm of the records in a file.

Defined cases: a null html is an empty payload. A null page_id is written without an id and read as null; it comes after all others
where the least is asked for. Of rows with equal page_ids and payloads one is the response. A record whose chain breaks is
an error, or ends its file if that is asked for. A payload that was read back wrong has payload_ok false.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachspark.llm.common import read, shared_dir, stored

MAGIC = "WARC/1."
END = "\r\n\r\n"
#: What comes before a page in a response, and what a revisit is.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 0
RECORDS_PER_FILE = 50_000
#: Payloads held by several pages up to which their list is broadcast (about 60 bytes each).
BROADCAST_PAYLOADS = 100_000


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, 40 bits at a time."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(*of: Column) -> Column:
    """A URN that tells a record from others."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("/", *of)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def with_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, broadcast_payloads: int = BROADCAST_PAYLOADS) -> DataFrame:
    """page_id, url, payload, w_row, w_digest, w_bytes, w_main (the one that revisits name), and of a revisit w_first (page_id of w_main).

    Of equal payloads one record is the response: that of the least page_id, null last. Where several rows have that page_id, rows are
    numbered and stored first, and the first of them is the response."""
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("w_row", F.monotonically_increasing_id())
    df = df.withColumns({"w_digest": base32_sha1(F.col("payload").cast("binary")), "w_bytes": F.octet_length("payload").cast("long")})

    def shared(df: DataFrame) -> DataFrame:
        by_page = df.filter(F.col("w_bytes") >= min_bytes).groupBy(F.col("w_digest").alias("s_digest"), "page_id").agg(F.count("*").alias("n"), F.min("w_row").alias("row"))
        least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n", "row")).alias("s_first")
        return stored(by_page.groupBy("s_digest").agg(least, F.sum("n").alias("s_n")).filter("s_n > 1").drop("s_n"), "warc-shared")

    known = shared(df)
    tied = not known.filter("s_first.n > 1").isEmpty()
    if tied:
        df = stored(df, "warc-rows")
        known = shared(df)
    df = df.join(known.hint("broadcast" if known.count() <= broadcast_payloads else "merge"), F.col("w_digest") == F.col("s_digest"), "left")
    main = F.col("s_first.page_id").eqNullSafe(F.col("page_id"))
    main = F.col("s_first").isNotNull() & (main & (F.col("s_first.row") == F.col("w_row")) if tied else main)
    df = df.withColumn("w_main", main)
    return df.withColumn("w_first", F.when(F.col("s_first").isNotNull() & ~main, F.struct(F.col("s_first.page_id").alias("page_id")))).drop("s_digest", "s_first")


def write(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archives of plain WARC 1.1 under path. The header of a revisit keeps length and digest of the full payload."""
    df = with_types(pages, min_bytes)
    again, of = F.col("w_first").isNotNull(), F.col("w_first")
    body = F.when(again, "").otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    head = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), F.when(F.col("w_main"), record_id(F.col("w_digest"))).otherwise(record_id(F.col("w_digest"), F.col("page_id"), F.col("w_row")))),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")), F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("w_digest")), F.concat(F.lit("X-Payload-Length: "), F.col("w_bytes").cast("string")),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")), F.when(again, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("w_digest")))), F.when(again, F.concat(F.lit("X-Refers-To-Page-ID: "), of["page_id"].cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *head), F.lit(END), body)
    df.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Every piece between two magics: file, split, at (order in the split), piece, and its bytes with the magic before it."""
    df = spark.read.option("lineSep", MAGIC).text(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))


def placed(df: DataFrame) -> DataFrame:
    """Adds start, the offset of a piece's magic in its file: the sums of bytes before it, of splits first, then inside one.

    The first piece of a file comes before any magic; an archive begins with a magic, so that piece is empty."""
    size = F.octet_length("piece") + len(MAGIC)
    df = df.withColumn("size", size.cast("long"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = df.groupBy("file", "split").agg(F.sum("size").alias("n")).select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return df.join(splits, ["file", "split"]).withColumn("start", F.col("base") + F.col("inside") - len(MAGIC)).drop("base", "inside")


def payload(block: Column) -> Column:
    """What comes after the HTTP head of a response's block."""
    return F.substring(block, F.instr(block, END) + len(END), F.length(block))


def field(head: Column, name: str, pattern: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}: *{pattern}", 1)
    return F.when(found != "", found)


def headers(df: DataFrame) -> DataFrame:
    """Parses each piece as if it were a record. next is null where there is no header with a length."""
    head = F.substring_index("piece", END, 1)
    df = df.withColumn("head", F.when(F.instr("piece", END) > 0, head))
    length = field(F.col("head"), "Content-Length", r"(\d{1,18})\r?$").cast("long")
    df = df.withColumns({"length": length, "head_bytes": F.octet_length("head") + len(END)})
    df = df.withColumn("whole", F.octet_length("piece") == F.col("head_bytes") + F.col("length") + len(END))
    block = F.expr(f"substring(piece, length(head) + {len(END) + 1}, length(piece) - length(head) - {2 * len(END)})")
    return df.withColumns(
        {
            "page_id": field(F.col("head"), "X-Page-ID", r"(-?\d+)").cast("long"), "record_type": F.lower(field(F.col("head"), "WARC-Type", r"(\w+)")), "url": field(F.col("head"), "WARC-Target-URI", r"([^\r]*)"),
            "refers_to": field(F.col("head"), "X-Refers-To-Page-ID", r"(-?\d+)").cast("long"), "told_digest": field(F.col("head"), "WARC-Payload-Digest", r"sha1:(\w+)"), "told_bytes": field(F.col("head"), "X-Payload-Length", r"(\d+)").cast("long"),
            "found_digest": F.when(F.col("whole") & (F.col("length") > 0), base32_sha1(payload(block).cast("binary"))), "jump": F.lit(len(MAGIC)) + F.col("head_bytes") + F.col("length") + len(END),
        }
    )


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, start) of the records that the chain from offset 0 reaches. Each round doubles both the steps of a jump and
    the records known: those known so far, and those one such jump from them."""
    jumps = stored(candidates.filter("jump is not null").select("file", "start", (F.col("start") + F.col("jump")).alias("next")), "warc-jumps")
    known = candidates.filter("start = 0").select("file", "start")
    n, rounds = candidates.groupBy("file").count().agg(F.max("count")).first()[0] or 0, 0
    while (1 << rounds) < n:
        step = known.join(jumps, ["file", "start"]).select("file", F.col("next").alias("start"))
        known = known.union(step.join(candidates.select("file", "start"), ["file", "start"], "left_semi")).distinct()
        far = jumps.select("file", F.col("start").alias("next"), F.col("next").alias("far"))
        jumps = jumps.join(far, ["file", "next"]).select("file", "start", F.col("far").alias("next"))
        rounds += 1
        if rounds % 3 == 0:
            known, jumps = stored(known, "warc-known"), stored(jumps, "warc-jumps")
    return known


def records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One row for each record of the archives: file, start, page_id, url, record_type, refers_to, length, told_bytes,
    told_digest, and found_digest of the payload read, null in a revisit. A chain that ends before its file does is an error, or if not
    `strict` the end of that file."""
    told = ["page_id", "url", "record_type", "refers_to", "length", "told_bytes", "told_digest", "found_digest"]
    narrow = placed_narrow(headers(pieces(spark, path)))
    table = stored(narrow.select("file", "start", "jump", "whole", "size", *told), "warc-candidates")
    found = table.join(reachable(table.filter("start >= 0").select("file", "start", "jump")), ["file", "start"], "left_semi")
    found = stored(found, "warc-records")
    if strict:
        sizes = table.groupBy("file").agg((F.sum("size") - len(MAGIC)).alias("bytes"))
        ends = found.groupBy("file").agg(F.max(F.col("start") + F.col("jump")).alias("last"))
        bad = sizes.join(ends, "file", "left").filter("bytes > 0 and (last is null or last <> bytes)").select("file").head()
        if bad:
            raise ValueError(f"the chain of records breaks in {bad.file}")
    broken = found.filter("not whole").select("file").distinct()
    if broken.isEmpty():
        return found.select("file", "start", *told)
    # Payloads that hold the magic lie in several pieces: only their files are read again, and put together
    again = placed(pieces(spark, path).join(broken, "file", "left_semi")).filter("start >= 0").select("file", "start", "piece")
    heads = found.filter("not whole").select(F.col("file").alias("h_file"), F.col("start").alias("first"), (F.col("start") + F.col("jump")).alias("stop"), F.col("length").alias("want"))
    starts = found.select("file", "start", F.col("start").alias("owner"))
    last = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    owned = again.join(starts, ["file", "start"], "left").withColumn("owner", F.last("owner", ignorenulls=True).over(last))
    parts = owned.join(heads, (F.col("file") == F.col("h_file")) & (F.col("owner") == F.col("first")))
    joined = parts.groupBy("file", "owner", "want").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), MAGIC).alias("piece"))
    block = F.substring(F.col("piece").cast("binary"), F.octet_length(F.substring_index("piece", END, 1)) + len(END) + 1, F.col("want").cast("int")).cast("string")
    mended = joined.select("file", F.col("owner").alias("start"), base32_sha1(payload(block).cast("binary")).alias("mended"))
    out = found.join(mended, ["file", "start"], "left").withColumn("found_digest", F.coalesce("mended", "found_digest"))
    return out.select("file", "start", *told)


def placed_narrow(df: DataFrame) -> DataFrame:
    """placed() for parsed pieces: their text goes before the sums, which then move headers only."""
    keep = [c for c in df.columns if c not in ("piece", "head", "head_bytes")]
    narrow = df.withColumn("size", (F.octet_length("piece") + len(MAGIC)).cast("long")).select(*keep, "size")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    narrow = stored(narrow, "warc-pieces")
    splits = narrow.groupBy("file", "split").agg(F.sum("size").alias("n")).select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    narrow = narrow.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return narrow.join(splits, ["file", "split"]).withColumn("start", F.col("base") + F.col("inside") - len(MAGIC)).drop("base", "inside")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(read(spark, sf_dir, "pages"), path)
    r = records(spark, path)
    agree = F.when(F.col("record_type") == "response", F.coalesce(F.col("found_digest") == F.col("told_digest"), F.lit(False))).otherwise(True)
    return r.select("page_id", F.col("told_bytes").alias("payload_bytes"), F.col("told_digest").alias("payload_digest"), "record_type", "refers_to", agree.alias("payload_ok"))
