"""Operator 7: line deduplication by the spread of a line over distinct sites.

HyperLogLog sketches of the sites, one a line hash, are merged by aggregation. Lines whose
estimate is clearly above the threshold are boilerplate; lines near it get an exact
distinct count; the rest stay. Boilerplate lines are removed from all documents but
the first that has them, so no content leaves the corpus altogether.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stage_table, without

#: Sites from which a line is boilerplate; log2 of a sketch's registers; standard errors within which an estimate is checked.
MIN_SITES, LOG_K, ERRORS = 10, 10, 4.0


def norm_line(line: Column) -> Column:
    """A line without white space at its ends (\\x20, \\x09-\\x0D)."""
    return F.trim(line, F.lit(" \t\n\x0b\f\r"))


def lines_of(df: DataFrame, doc: str, text: str, site: str) -> DataFrame:
    """Rows (doc_id, text_hash, site, line_no, line_hash) of the lines that are not blank."""
    whole = df.where(F.col(text) != "").select(
        F.col(doc).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(site).cast("string").alias("site"), F.split(F.col(text), "\n").alias("__lines")
    )  # below the explosion, or a text would be hashed for each of its lines
    cut = whole.select("doc_id", "text_hash", "site", F.posexplode("__lines").alias("line_no", "line"))
    return cut.withColumn("line", norm_line(F.col("line"))).where("line != ''").select(
        "doc_id", "text_hash", "site", "line_no", F.xxhash64("line").alias("line_hash")
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, log_k: int = LOG_K) -> DataFrame:
    """Boilerplate lines: line_hash and the place of the first, by doc_id (nulls last), text hash and line number."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash", "line_no")).alias("first")
    spread = lines.groupBy("line_hash").agg(F.hll_sketch_agg("site", log_k).alias("sketch"), first)
    slack = max(1.0, ERRORS * 1.04 / math.sqrt(2**log_k) * min_sites)
    wide = spread.withColumn("sites", F.hll_sketch_estimate("sketch")).where(F.col("sites") >= min_sites - slack).select(
        "line_hash", "first", (F.col("sites") < min_sites + slack).alias("near")
    )
    near = lines.select("line_hash", "site").join(wide.where("near").select("line_hash"), "line_hash", "left_semi")
    exact = near.distinct().groupBy("line_hash").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites).select("line_hash")
    return wide.where("NOT near").select("line_hash", "first").unionAll(
        wide.where("near").join(exact, "line_hash", "left_semi").select("line_hash", "first")
    )


def dedup_lines(
    df: DataFrame, doc: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES,
    keep_first: bool = True
) -> DataFrame:
    """``df`` with boilerplate lines cut from ``text``, and ``n_removed`` (long).

    Lines are compared without white space at their ends; blank lines are never removed. A null
    site counts for no site. With ``keep_first`` the first place of a line keeps it. Texts
    that lose no line stay as they are, to the byte; null stays null; a text that loses
    all lines is empty. Rows with the same id and text are treated alike; all rows and
    other columns are kept, a column named n_removed is replaced.
    """
    df = df.drop("n_removed")
    lines = stage_table(lines_of(df, doc, text, site), "op7-lines")  # hashes and places alone; texts are cut once
    found = stage_table(boilerplate(lines, min_sites), "op7-boilerplate")  # a table of its own, so that a line of many documents can be split in the join
    hit = lines.join(found, "line_hash")
    if keep_first:
        hit = hit.where(
            ~(
                F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (
                    F.col("text_hash") == F.col("first.text_hash")
                ) & (F.col("line_no") == F.col("first.line_no"))
            )
        )
    cut = hit.groupBy(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")
    ).agg(F.sort_array(F.collect_set("line_no")).alias("__cut"))
    out = df.join(cut, df[doc].eqNullSafe(cut["__id"]) & (F.xxhash64(df[text]) == cut["__hash"]), "left")
    out = out.withColumn("__lines", F.when(F.col("__cut").isNotNull(), F.split(F.col(text), "\n")))
    left = F.array_join(without("__lines", "__cut"), "\n")
    return out.withColumns(
        {
            text: F.when(F.col("__cut").isNull(), F.col(text)).otherwise(left),
            "n_removed": F.coalesce(F.size("__cut"), F.lit(0)).cast("long")
        }
    ).withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long"))).drop("__id", "__hash", "__cut", "__lines")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select(
        "doc_id", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256")
    )


OP7_SQL = r"""
with l as (
  select doc_id, source, i, ls[i] as raw, trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line
  from (select doc_id, source, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, source, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
b as (select line, arg_min(doc_id * 1000000 + i, doc_id * 1000000 + i) as first from l where line <> '' group by line having count(distinct source) >= 10),
m as (select l.*, b.line is not null and l.doc_id * 1000000 + l.i <> b.first as cut from l left join b on l.line = b.line)
select doc_id, count(*) filter (cut) as n_removed, sha256(coalesce(string_agg(raw, chr(10) order by i) filter (not cut), '')) as text_sha256
from m group by doc_id
"""
