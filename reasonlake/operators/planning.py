"""Plans as tables: what to place where, what to evict, what to cap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blocks import running


def placement(files: DataFrame, keys: list[str], order: str, capacity: int, path: str = "path", size: str = "bytes") -> DataFrame:
    """``files`` with ``primary``, whether each is placed there in order: while it fits; a later smaller file may still fit.

    A fold over the files of a key, whose only state is the used size: the files come sorted and pass through
    one by one, so a key may have any number of them. Null sizes count as 0.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, 0
        for b in it:
            fits = []
            for *key, n in zip(*(b.column(c).to_pylist() for c in [*keys, size]), strict=True):
                if key != now:
                    now, used = key, 0
                fits.append(used + (n or 0) <= capacity)
                used += (n or 0) if fits[-1] else 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fits, pa.bool_())], names=[*b.schema.names, "primary"])

    kept = files.drop("primary").repartition(*keys).sortWithinPartitions(*keys, order, path, size)
    return kept.mapInArrow(batches, T.StructType([*kept.schema.fields, T.StructField("primary", T.BooleanType())]))


def retention(
    files: DataFrame, keys: list[str], order: list[str], to_free: Column, size: str = "bytes", protected: Column | None = None
) -> DataFrame:
    """Files to evict, oldest access first, until enough bytes are freed: each file has evict and, for its key,
    possible. Protected files stay.
    """
    free = files if protected is None else files.where(~protected)
    need = running(free.withColumn("__need", to_free), keys, order, {"size": size}, strict=True)
    return need.withColumns(
        {"evict": F.col("upto_size") < F.col("__need"), "possible": F.col("total_size") >= F.col("__need")}
    ).drop("upto_size", "total_size", "__need")


def cap_per_rule(requests: DataFrame, keys: list[str], rule_order: str, path: str, cap: int) -> DataFrame:
    """At most ``cap`` paths a rule; a path goes to the first rule that asks for it."""
    first = requests.withColumn(
        "__n", F.row_number().over(Window.partitionBy(*keys, path).orderBy(rule_order))
    ).where("__n = 1").drop("__n")
    return first.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*keys, rule_order).orderBy(path))
    ).where(F.col("rank") <= cap)


def directory_policy(files: DataFrame, directory: str, path: str, most: int, sample: int) -> DataFrame:
    """All files of small directories; of larger ones the first ``sample`` by path."""
    own = Window.partitionBy(directory)
    r = files.withColumns({"n_in_dir": F.count(F.lit(1)).over(own), "rank": F.row_number().over(own.orderBy(path))})
    return r.where((F.col("n_in_dir") <= most) | (F.col("rank") <= sample))


def tier_roles(tiers: DataFrame) -> DataFrame:
    """Tiers by first-byte latency: the fastest is hot, the slowest cold, the others warm."""
    own = Window.partitionBy(F.lit(0))  # a few mounts
    r = tiers.withColumns(
        {"rank": F.row_number().over(own.orderBy("first_byte_ms", "mount")), "__n": F.count(F.lit(1)).over(own)}
    )
    return r.withColumn(
        "role", F.when(F.col("rank") == 1, "hot").when(F.col("rank") == F.col("__n"), "cold").otherwise("warm")
    ).drop("__n")


def ordered_dedup(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Each value of a key once, at its first position."""
    return df.groupBy(*keys, value).agg(F.min(order).alias(order))


def replace_part(base: DataFrame, rerun: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``base`` whose key was rerun give way to the rerun; missing columns are null."""
    return base.join(rerun.select(*keys).distinct(), keys, "left_anti").unionByName(rerun, allowMissingColumns=True)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with repeats, that one of two tables has more often: side and the columns; none if they are the same."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def top_up(seen: DataFrame, truth: DataFrame, key: str, order: str, least: int = 3, most: int = 50) -> DataFrame:
    """Seen paths in order; a key with fewer than ``least`` gets up to ``most`` of its other true paths after them."""
    s = ordered_dedup(seen, [key], "path", order)
    n = s.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    more = truth.select(key, "path").distinct().join(
        s.select(key, "path"), [key, "path"], "left_anti"
    ).join(n, key, "left").where(F.coalesce("__n", F.lit(0)) < least)
    more = more.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("path"))).where(F.col("rank") <= most)
    return s.select(
        key, "path", F.lit("seen").alias("origin"),
        F.row_number().over(Window.partitionBy(key).orderBy(order, "path")).alias("rank")
    ).unionByName(more.select(key, "path", F.lit("truth").alias("origin"), "rank"))


def staged_paths(wanted: DataFrame, hot: DataFrame, roots: list[str]) -> DataFrame:
    """``wanted`` (path) with whether its mirror is below one of the hot roots."""
    from ..functions.paths import mirror

    named = wanted.select("path", F.explode(F.array(*[mirror(r, F.col("path")) for r in roots])).alias("__m")).distinct()
    found = named.join(
        hot.select(F.col("path").alias("__m")).distinct(), "__m", "left_semi"
    ).select("path").distinct().withColumn("staged", F.lit(True))
    return wanted.join(found, "path", "left").withColumn("staged", F.coalesce("staged", F.lit(False)))


def smallest_trees(tasks: DataFrame, domain: str, task: str, tree: str, most: int = 3) -> DataFrame:
    """The task with the fewest tree lines of each of the first domains by name; ties go to the smaller id."""
    lines = F.size(F.filter(F.split(tree, "\n"), lambda x, i: (x != "") | (i < F.size(F.split(tree, "\n")) - 1)))
    low = tasks.withColumn("n_lines", lines).groupBy(domain).agg(F.min(F.struct("n_lines", task)).alias("x"))
    return low.orderBy(domain).limit(most).select(domain, f"x.{task}", "x.n_lines")


def target_choice(calls: DataFrame, events: DataFrame, inventory: DataFrame) -> DataFrame:
    """The file to measure of each session: that of its first tool call (session_id, seq, name, path) whose path exists,
    else its first staged or hit event (session_id, seq, path, outcome) that does.

    Returns session_id, path and ``source``: tool or staged. Sessions without either have no row.
    """
    there = inventory.select("path").distinct()
    of = lambda df, n: df.join(there, "path", "left_semi").select("session_id", F.struct(F.lit(n).alias("rank"), "seq", "path").alias("x"))
    both = of(calls, 0).unionByName(of(events.where(F.col("outcome").isin("staged", "hit")), 1))
    best = both.groupBy("session_id").agg(F.min("x").alias("x"))
    return best.select("session_id", "x.path", F.when(F.col("x.rank") == 0, "tool").otherwise("staged").alias("source"))


def first_samples(files: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of (path, tier): tier 1 by path, then tier 3 by path, each path once."""
    return files.where(F.col("tier").isin(1, 3)).groupBy("path").agg(F.min("tier").alias("tier")).orderBy("tier", "path").limit(n)
