"""Removal of boilerplate lines by the number of distinct sites that have them.

A line's sites are counted by HyperLogLog sketches, which partial aggregation
merges before rows are shuffled.  Where the estimate is near the threshold, the
line gets its exact count.  All is done by DataFrame functions.

A text that is copied in whole from site to site would make all its lines look
like boilerplate, so equal texts count as one page, at their least site.

Defined results: a line is compared trimmed, with runs of blanks as one; empty
lines stay; a null text counts as the empty one, a null site as the site of empty
name; repeated rows are copies of one page and give equal rows; an empty table
gives an empty result; other columns pass through remove_boilerplate unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, text_key, text_of, written

BLANKS = r"[\t\r\f\x0B ]+"


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, BLANKS, " "))


def line_key(line: Column) -> Column:
    """128 bits of the normalised line."""
    line = normal(line)
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def boilerplate(docs: DataFrame, site_col: str, min_sites: int, margin: float = 0.15, lg_k: int = 12) -> tuple[DataFrame, DataFrame]:
    """(line, page) rows of lines that may be boilerplate, and the lines (line, n_sites) that are."""
    # a page's key is found before its lines are rows, which would each find it again from the whole text
    pages = docs.select(text_key(text_of()).alias("page"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.split(text_of(), "\n").alias("parts"))
    lines = pages.select("page", "site", F.explode("parts").alias("raw")).where(normal(F.col("raw")) != "")
    lines = lines.select("page", "site", line_key(F.col("raw")).alias("line"))
    # partial aggregation and two keys spread a line that is on every page over all tasks
    pages_of = written(lines.groupBy("line", "page").agg(F.min("site").alias("site")), "lines")
    # a line of fewer pages than the threshold cannot have as many sites: only others are sketched
    often = written(pages_of.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("line"), "often")
    rows = written(pages_of.join(if_small(often), "line"), "candidates")
    spread = rows.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("estimate"))
    spread = written(spread.where(F.col("estimate") >= min_sites * (1 - margin)), "spread")
    near = spread.where(F.col("estimate") < min_sites * (1 + margin)).select("line")
    exact = rows.join(near, "line").groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("*").alias("n_sites"))
    sure = spread.where(F.col("estimate") >= min_sites * (1 + margin)).select("line", F.col("estimate").alias("n_sites"))
    return rows.select("line", "page"), written(sure.unionByName(exact.where(F.col("n_sites") >= min_sites)), "boilerplate")


def remove_boilerplate(docs: DataFrame, site_col: str = "source", min_sites: int = 10, n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """docs with boilerplate lines taken out of text; optional columns with the lines before, and those removed."""
    rows, lines = boilerplate(docs, site_col, min_sites)
    by_page = rows.join(if_small(lines.select("line")), "line").groupBy("page").agg(F.collect_set("line").alias("__line_bad"))
    joined = docs.withColumn("__line_page", text_key(text_of())).join(by_page.withColumnRenamed("page", "__line_page"), "__line_page", "left")
    parts = F.split(text_of(), "\n")
    kept = F.filter(parts, lambda x: ~F.array_contains("__line_bad", line_key(x)))
    joined = joined.withColumn("__line_kept", F.when(F.col("__line_bad").isNotNull(), kept))
    text = F.when(F.col("__line_bad").isNull(), F.col("text")).otherwise(F.array_join("__line_kept", "\n")).alias("text")
    out = [text if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if n_lines:
        out.append(F.size(parts).cast("long").alias(n_lines))
    if n_removed:
        out.append(F.coalesce(F.size(parts) - F.when(F.col("__line_bad").isNotNull(), F.size("__line_kept")), F.lit(0)).cast("long").alias(n_removed))
    return joined.select(*out)


def op8_line_dedup(spark, sf_dir: str, min_sites: int = 10) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return remove_boilerplate(docs, "source", min_sites, "n_lines", "n_removed").select("doc_id", text_of().alias("text"), "n_lines", "n_removed")


OP8_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as source from documents),
l as (select text, source, trim(regexp_replace(unnest(string_split(text, chr(10))), '[\t\r\f\x0B ]+', ' ', 'g')) as line from d),
p as (select line, text, min(source) as site from l where line <> '' group by line, text),
b as (select coalesce(list(line), []) as bad from (select line from p group by line having count(distinct site) >= 10)),
k as (select doc_id, string_split(text, chr(10)) as parts,
             list_filter(string_split(text, chr(10)), lambda x: not list_contains(bad, trim(regexp_replace(x, '[\t\r\f\x0B ]+', ' ', 'g')))) as kept from d, b)
select doc_id, array_to_string(kept, chr(10)) as text, len(parts)::bigint as n_lines, (len(parts) - len(kept))::bigint as n_removed from k
"""
