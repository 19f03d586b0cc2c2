"""Line dedup by site-relative frequency.

A line is boilerplate on a site when more than `ratio` of the site's pages, and at least `min_pages` of them, hold it.
Lines are compared without surrounding white space, inside one site only, by a 64-bit hash; a page counts once for
each line. Counts are partly summed before the shuffle, so one line on every page costs each task one row.

Defined cases: a null text stays null and has no lines; blank lines are never boilerplate and stay. A null site is a
site of its own. Repeated rows are separate pages, also under one doc_id. A text all of whose lines go becomes empty; no row goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachspark.llm.common import HELD, apart, read, stored, together, whole

RATIO, MIN_PAGES = 0.05, 5
#: Boilerplate lines up to which their list is broadcast (about 60 bytes each); beyond it the join shuffles.
BROADCAST_LINES = 100_000
BLANK = r"^[\x20\x09-\x0D]*$"


def key_of(line: Column) -> Column:
    """Hash of a line without surrounding white space; null for a blank one."""
    trimmed = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed != "", F.xxhash64(trimmed))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(b_site, b_line, b_pages, b_total) of the lines that go. A site has at most (its mean lines a page) / ratio of them."""
    pages = docs.groupBy(F.col(site).alias("s_site")).agg(F.count("*").alias("b_total"))
    lines = docs.select(F.col(site).alias("b_site"), F.explode(F.array_distinct(F.transform(lines_of(whole()), key_of))).alias("b_line")).filter("b_line is not null")
    often = lines.groupBy("b_site", "b_line").agg(F.count("*").alias("b_pages")).filter(F.col("b_pages") >= min_pages)
    return often.join(pages, F.col("b_site").eqNullSafe(F.col("s_site"))).filter(F.col("b_pages") > ratio * F.col("b_total")).drop("s_site")


def dedup_lines(docs: DataFrame, site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with the text less its boilerplate lines, and n_lines and n_dropped."""
    table = stored(boilerplate(docs, site, ratio, min_pages), "site-lines")
    lists = table.groupBy(F.col("b_site").alias("l_site")).agg(F.collect_list("b_line").alias("l_lines"))  # bounded, see boilerplate()
    lists = lists.hint("broadcast" if table.count() <= broadcast_lines else "merge")
    rows = apart(docs, *dict.fromkeys(("text", site)))
    df = rows.join(lists, F.col(site).eqNullSafe(F.col("l_site")), "left").withColumn("l_all", lines_of(F.col("text")))
    stays = F.filter("l_all", lambda x: ~F.coalesce(F.array_contains("l_lines", key_of(x)), F.lit(False)))
    df = df.withColumn("l_kept", F.when(F.col("l_lines").isNull(), F.col("l_all")).otherwise(stays))
    n = F.coalesce(F.size("l_all"), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n)
    n_dropped = F.when(F.col("text").isNull(), 0).otherwise(F.size("l_all") - F.size("l_kept")).cast("long")
    return together(df, docs.columns, text=F.array_join("l_kept", "\n"), n_lines=n.cast("long"), n_dropped=n_dropped)


def stage(docs: DataFrame) -> DataFrame:
    """docs with shorter texts and the same columns, whatever their names; n_chars, where there is one, follows the text."""
    columns = {c: F.col(f"in_{i}_{HELD}") for i, c in enumerate(docs.columns)}
    out = dedup_lines(apart(docs, "text", "source"))
    text = {"text": F.col("text")} | ({"n_chars": F.length("text").cast("long")} if "n_chars" in columns else {})
    return out.select(*(text.get(k, v).alias(k) for k, v in columns.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "n_lines", "n_dropped", "text")


SQL = """
WITH d AS (SELECT doc_id, source, text, row_number() OVER () AS row FROM documents),
l AS (SELECT row, source, pos, line, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS body
  FROM (SELECT row, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL)),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (SELECT l.source, body FROM l JOIN p ON l.source IS NOT DISTINCT FROM p.source WHERE body <> '' GROUP BY l.source, body, pages
  HAVING count(DISTINCT row) >= 5 AND count(DISTINCT row) > 0.05::DOUBLE * pages),
k AS (SELECT l.*, b.body IS NOT NULL AS goes FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.body = b.body),
a AS (SELECT row, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '') AS text FROM k GROUP BY row)
SELECT d.doc_id, coalesce(a.n_lines, 0) AS n_lines, coalesce(a.n_dropped, 0) AS n_dropped, a.text FROM d LEFT JOIN a USING (row)
"""
