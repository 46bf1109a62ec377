"""Operator 6: benchmark decontamination with DataFrame functions only.

The windows of the benchmark items, by the hash of all their words, are the hash set. One pass over the
texts makes (document, start, hash) of each window and keeps those in the set; the
few texts with hits are then read again and compared with the windows word by word.
The set is broadcast while its counted size is at most ``BROADCAST_KEYS``; a larger one
is joined by a shuffle of these narrow rows. Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stage_table, without, words_of

#: Everything but digits, a-z and bytes above 127 parts words, after A-Z is lower-cased.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Hashes that are broadcast: about 40 MB in an executor.
BROADCAST_KEYS = 1_000_000
#: Words of a text that are laid out at once.
PIECE = 4096


def norm_words(text: Column) -> Column:
    """Words with A-Z lower-cased. ``lower`` does just that where all characters are ASCII."""
    ascii_only = F.octet_length(text) == F.length(text)
    return words_of(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), GAP)


def item_windows(benchmark: DataFrame, size: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, window): windows of ``size`` words, or the whole of a shorter item. Items without words have none."""
    ws = benchmark.select(F.col(item).alias("item"), norm_words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - size + 1))
    return ws.select("item", F.explode(F.transform(starts, lambda i: F.slice("ws", i, size))).alias("window")).distinct()


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _positions(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, text_hash, start, key) of (doc_id, text_hash, text): the hash of the window of each length at each start.

    Each text has one more row, without a key, at its end, whose start is its number of words.
    """
    most = max(lengths)
    ended = F.array_append(_hashes(norm_words(F.col("text"))), F.lit(None).cast("long"))
    hashes = docs.select("doc_id", "text_hash", ended.alias("h"))
    # long texts go in pieces, so that no row holds their windows side by side
    pieces = F.transform(F.sequence(F.lit(0), F.size("h") - 1, F.lit(PIECE)), lambda i: F.slice("h", i + 1, PIECE + most - 1))
    cut = hashes.select("doc_id", "text_hash", F.posexplode(pieces).alias("piece", "c"))
    # the words at each start side by side, null beyond the end
    side = F.arrays_zip(*[F.slice("c", i + 1, PIECE).alias(f"w{i}") for i in range(most)])
    heads = cut.select("doc_id", "text_hash", "piece", F.posexplode(side).alias("at", "head"))
    heads = heads.select("doc_id", "text_hash", (F.col("piece") * PIECE + F.col("at")).alias("start"), "head")
    w = [F.col(f"head.w{i}") for i in range(most)]
    keys = [F.when(w[n - 1].isNotNull(), F.xxhash64(*w[:n])) for n in lengths]
    if len(keys) == 1:
        key = keys[0]
    else:  # the row at the end stays one row
        key = F.explode(
            F.when(w[0].isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.filter(F.array(*keys), lambda k: k.isNotNull()))
        )
    return heads.select("doc_id", "text_hash", "start", key.alias("key"), w[0].isNull().alias("end"))


def hits(docs: DataFrame, windows: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text_hash, text): the number of words of each row (doc_id, text_hash, n_words), and (doc_id,
    text_hash, start, n, item) for each occurrence of a window.
    """
    windows = stage_table(
        windows.withColumns({"n": F.size("window"), "key": F.xxhash64(_hashes(F.col("window")))}), "op6-windows"
    )
    keys = windows.select("key", "n").distinct()
    lengths = sorted(r[0] for r in keys.select("n").distinct().collect()) or [1]  # at most the size of a window
    at = _positions(docs, lengths)
    if keys.count() <= broadcast_keys:
        found = at.join(F.broadcast(keys), "key", "left").where("end OR n IS NOT NULL")
    else:
        found = at.where("end").withColumn("n", F.lit(None).cast("int")).unionByName(
            at.where("key IS NOT NULL").join(keys, "key")
        )
    found = stage_table(found.select("doc_id", "text_hash", "start", "n"), "op6-found")
    counts = found.where("n IS NULL").select("doc_id", "text_hash", F.col("start").cast("long").alias("n_words"))
    some = found.where("n IS NOT NULL").groupBy(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")
    ).agg(F.collect_set(F.struct("start", "n")).alias("at"))
    texts = docs.join(
        some, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    ).select("doc_id", "text_hash", norm_words(F.col("text")).alias("ws"), "at")
    each = texts.select(
        "doc_id", "text_hash",
        F.explode(
            F.transform(
                "at", lambda a: F.struct(a.start.alias("start"), a.n.alias("n"), F.slice("ws", a.start + 1, a.n).alias("window"))
            )
        ).alias("a")
    )
    return counts, each.select("doc_id", "text_hash", "a.*").join(windows.select("item", "window"), "window").select(
        "doc_id", "text_hash", "start", "n", "item"
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, share: tuple[int, int] = (1, 20), doc: str = "doc_id",
    text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, n_hit, spans, items, contaminated.

    A word inside an occurrence of a benchmark window is hit. ``spans`` are distinct
    (start, n) of the occurrences, in order; ``items`` the benchmark items, sorted as strings.
    A document is contaminated if at least ``share`` of its words are hit, one at the least.
    Null and empty texts have no words and are clean. Rows with the same id are judged
    apart if their texts differ; equal rows give equal rows. Other columns of either table
    play no part, so their names can't clash.
    """
    base = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    counts, found = hits(base, item_windows(benchmark, size))
    rows = counts.select(
        "doc_id", "text_hash", "n_words", F.lit(None).cast("struct<start:int,n:int>").alias("span"),
        F.lit(None).cast("string").alias("item")
    )
    marks = found.select(
        "doc_id", "text_hash", F.lit(None).cast("long").alias("n_words"), F.struct("start", "n").alias("span"),
        F.col("item").cast("string").alias("item")
    )
    each = rows.unionAll(marks).groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.count("n_words").cast("int").alias("copies"),
        F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items")
    )
    covered = F.size(
        F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.start, s.start + s.n - 1))))
    ).cast("long")
    judged = each.select(
        "doc_id", "text_hash", "n_words", covered.alias("n_hit"), "spans", "items",
        F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")
    )
    return judged.drop("copy").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share[1] >= F.col("n_words") * share[0])
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, share: tuple[int, int] = (1, 20), doc: str = "doc_id",
    text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without contaminated documents. Null and empty texts stay; rows
    with a null id are judged by their texts.
    """
    bad = contamination(docs, benchmark, size, share, doc, text).where("contaminated").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")
    ).distinct()
    return docs.join(bad, docs[doc].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text]) == bad["__hash"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 13, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the hit words cut out of ``text``: what is left of a changed text is its normalised
    words, joined by blanks.

    Texts without a hit stay as they are, to the byte.
    """
    cut = contamination(docs, benchmark, size, doc=doc, text=text).where("n_hit > 0").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.start, s.start + s.n - 1))))).alias("__cut")
    ).distinct()
    out = docs.join(cut, docs[doc].eqNullSafe(cut["__id"]) & (F.xxhash64(docs[text]) == cut["__hash"]), "left")
    out = out.withColumn("__words", F.when(F.col("__cut").isNotNull(), norm_words(F.col(text))))
    left = F.array_join(without("__words", "__cut"), " ")
    return out.withColumn(text, F.when(F.col("__cut").isNull(), F.col(text)).otherwise(left)).drop("__id", "__hash", "__cut", "__words")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


OP6_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
iw as (
  select distinct item_id, least(len(ws), 13) as l, ws[i : i + least(len(ws), 13) - 1] as w
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) as i from b where len(ws) > 0)),
dw as (
  select doc_id, l, i, ws[i : i + l - 1] as w
  from (select doc_id, l, ws, unnest(range(1, len(ws) - l + 2)) as i from d, (select distinct l from iw) where len(ws) >= l)),
hit as (select doc_id, i, dw.l as l, item_id from dw join iw on dw.l = iw.l and dw.w = iw.w),
cov as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + l)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join cov using (doc_id) left join its using (doc_id)
"""
