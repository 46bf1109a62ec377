"""Predicted sets against what was needed: bytes, files, ablations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .automata import Literals, dictionary_map


def with_sizes(paths: DataFrame, inventory: DataFrame) -> DataFrame:
    """Paths with their bytes from the inventory; 0 where it lacks them."""
    sizes = inventory.groupBy("path").agg(F.max("bytes").alias("bytes"))
    return paths.join(sizes, "path", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))


def overlap(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two deduplicated sets on keys + path: in_p, in_t, bytes. A truth that all keys share goes to
    ``shared_metrics`` instead.
    """
    on = [*keys, "path"]
    p = predicted.groupBy(*on).agg(F.max("bytes").alias("pb")).withColumn("in_p", F.lit(1))
    t = truth.groupBy(*on).agg(F.max("bytes").alias("tb")).withColumn("in_t", F.lit(1))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("in_p", "in_t", "pb", "tb")]
    return p.join(t, on, "full").select(*on, *zero)


def shared_metrics(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Hits, sizes, precision, recall and Jaccard of each key's paths against one truth; null where a side is empty.

    Paths of the truth that a key lacks are its size less the hits, so no key is paired with the whole truth.
    """
    t = truth.select("path").distinct().withColumn("__t", F.lit(1))
    p = predicted.select(*keys, "path").distinct().join(t, "path", "left")
    n = p.groupBy(*keys).agg(F.count("__t").alias("hits"), F.count(F.lit(1)).alias("predicted_size"))
    n = n.crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias("gt_size"))))  # one row
    return n.withColumns({
        "precision": F.try_divide("hits", "predicted_size"),
        "recall": F.try_divide("hits", "gt_size"),
        "jaccard": F.try_divide(F.col("hits"), F.col("predicted_size") + F.col("gt_size") - F.col("hits")),
    })


def byte_score(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, bytes and ratios for each key. An empty truth gives recall 0 and infinite overfetch; an empty prediction
    precision 0.

    Truth is shared by all keys: its totals are one small row, and only predicted paths
    are joined with it, so nothing is multiplied by the number of keys.
    """
    return byte_scores(predicted, {"": truth}, keys).drop("truth")


def byte_scores(predicted: DataFrame, truths: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """As ``byte_score``, against several truths (by name, in ``truth``): predicted paths are gathered once and meet each truth."""
    sums = predicted.groupBy(*keys, "path").agg(F.max("bytes").alias("pb"))
    totals, aggregates = None, []
    for i, truth in enumerate(truths.values()):
        t = truth.groupBy("path").agg(F.max("bytes").alias(f"t{i}"))
        total = t.agg(F.count(F.lit(1)).alias(f"n{i}"), F.coalesce(F.sum(f"t{i}"), F.lit(0)).cast("long").alias(f"b{i}"))
        totals = total if totals is None else totals.crossJoin(F.broadcast(total))  # one row
        sums = sums.join(t, "path", "left")
        aggregates += [F.count(f"t{i}").alias(f"o{i}"), F.sum(F.when(F.col(f"t{i}").isNotNull(), F.col("pb")).otherwise(0)).cast("long").alias(f"h{i}")]
    sums = sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_detected"), F.sum("pb").cast("long").alias("bytes_detected"), *aggregates)
    names = ("n_ground_truth", "bytes_ground_truth", "n_overlap", "bytes_overlap")
    each = [F.struct(F.lit(n).alias("truth"), *[F.col(f"{c}{i}").alias(x) for c, x in zip("nboh", names, strict=True)]) for i, n in enumerate(truths)]
    wide = sums.crossJoin(F.broadcast(totals)).select(*keys, "n_detected", "bytes_detected", F.inline(F.array(*each)))
    return ratios(wide.select(*keys, "truth", "n_detected", "n_ground_truth", "n_overlap", "bytes_detected", "bytes_ground_truth", "bytes_overlap"))


def ratios(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "byte_recall": F.when(c("bytes_ground_truth") > 0, c("bytes_overlap") / c("bytes_ground_truth")).otherwise(0.0),
        "byte_overfetch": F.when(
            c("bytes_ground_truth") > 0, c("bytes_detected") / c("bytes_ground_truth")
        ).otherwise(float("inf")),
        "file_recall": F.when(c("n_ground_truth") > 0, c("n_overlap") / c("n_ground_truth")).otherwise(0.0),
        "file_precision": F.when(c("n_detected") > 0, c("n_overlap") / c("n_detected")).otherwise(0.0),
    })


def falsepos(both: DataFrame, keys: list[str]) -> DataFrame:
    """Hits, waste and misses in files and bytes, with precisions, recalls, overfetch and both Jaccards; null where undefined."""
    hit, waste, miss = F.col("in_p") * F.col("in_t"), F.col("in_p") * (1 - F.col("in_t")), F.col("in_t") * (1 - F.col("in_p"))
    s = both.groupBy(*keys).agg(
        F.sum("in_p").alias("prefetched"), F.sum("in_t").alias("opened"), F.sum(hit).alias("hits"), F.sum(waste).alias("wasted"), F.sum(miss).alias("missed"),
        F.sum("pb").alias("prefetched_bytes"), F.sum("tb").alias("opened_bytes"), F.sum(hit * F.col("pb")).alias("hit_bytes"), F.sum(waste * F.col("pb")).alias("wasted_bytes"), F.sum(miss * F.col("tb")).alias("missed_bytes"))
    c = F.col
    return s.withColumns({
        "precision_files": F.try_divide(c("hits"), c("prefetched")), "recall_files": F.try_divide(c("hits"), c("opened")),
        "byte_overfetch": F.try_divide(
            c("prefetched_bytes"), c("opened_bytes")
        ), "byte_precision": F.try_divide(c("hit_bytes"), c("prefetched_bytes")), "byte_recall": F.try_divide(c("hit_bytes"), c("opened_bytes")),
        "jaccard_files": F.try_divide(c("hits"), c("prefetched") + c("opened") - c("hits")), "jaccard_bytes": F.try_divide(
            c("hit_bytes"), c("prefetched_bytes") + c("opened_bytes") - c("hit_bytes")
        )})


def leave_one_out(files: DataFrame, rules: DataFrame, truth: DataFrame, bearing: float = 0.10) -> DataFrame:
    """Recall over all sessions with each rule dropped: dropped, hits, recall, delta, load_bearing.

    Rules fire independently, so a path is lost when the dropped rule is the only one that
    points to it: no replay, one pass over the fired files.
    """
    t = truth.select("path").distinct()
    reach = files.select("name", "path").distinct().join(t, "path", "left_semi")
    only = reach.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    total = only.agg(F.count(F.lit(1)).alias("full_hits")).crossJoin(t.agg(F.count(F.lit(1)).alias("n_truth")))
    lost = only.where("n = 1").groupBy("name").agg(F.count(F.lit(1)).alias("lost"))
    out = rules.select(F.col("name").alias("dropped")).distinct().join(
        lost.withColumnRenamed("name", "dropped"), "dropped", "left"
    ).crossJoin(F.broadcast(total))
    out = out.select("dropped", (F.col("full_hits") - F.coalesce("lost", F.lit(0))).alias("hits"), "full_hits", "n_truth")
    out = out.withColumns(
        {"recall": F.try_divide("hits", "n_truth"), "delta": F.try_divide(F.col("full_hits") - F.col("hits"), F.col("n_truth"))}
    )
    return out.withColumn("load_bearing", F.col("delta") >= bearing)


def robustness(loo: DataFrame, least: float = 0.80) -> DataFrame:
    """One row: the least recall with a rule dropped, how many rules bear load, and whether the set is robust."""
    return loo.agg(
        F.min("recall").alias("min_recall"), F.sum(F.col("load_bearing").cast("int")).cast("long").alias("n_load_bearing"),
        (F.min("recall") >= least).alias("robust")
    )


def top_rules(loo: DataFrame, k: int = 5) -> DataFrame:
    """The rules whose loss costs most recall; ties go to the smaller name."""
    return loo.orderBy(F.desc("delta"), "dropped").limit(k)


#: What a policy is: the listed files (session_id, seq, path, bytes) that it keeps of all that are listed.
Policy = Callable[[DataFrame], DataFrame]


def first_listed(n: int) -> Policy:
    """The first ``n`` files of each session's listings."""
    own = Window.partitionBy("session_id").orderBy("seq")
    return lambda listed: listed.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= n).drop("__n")


def with_extension(*extensions: str) -> Policy:
    return lambda listed: listed.where(reduce(lambda a, b: a | b, [F.col("path").endswith(e) for e in extensions]))


def apply_policies(listed: DataFrame, policies: dict[str, Policy]) -> DataFrame:
    """What each policy keeps, with its name in ``policy``."""
    return reduce(DataFrame.unionByName, [keep(listed).withColumn("policy", F.lit(name)) for name, keep in policies.items()])


def evaluate_policy(kept: DataFrame, opens: DataFrame, keys: list[str]) -> DataFrame:
    """Kept listings against opened paths: files, bytes, hits, recall, precision and overfetch against hits. Of repeated
    paths the last size counts (``seq``).
    """
    n = opens.select("path").distinct().agg(F.count(F.lit(1)).alias("agent_opens"))
    last = kept.groupBy(*keys, "path").agg(F.max_by("bytes", "seq").alias("bytes")).join(
        opens.select("path").distinct().withColumn("open", F.lit(1)), "path", "left"
    )
    s = last.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("kept_files"), F.sum("bytes").alias("kept_bytes"), F.count("open").alias("hits"),
        F.sum(F.when(F.col("open") == 1, F.col("bytes"))).alias("hit_bytes")
    ).crossJoin(F.broadcast(n))
    return s.withColumns(
        {
            "recall": F.try_divide("hits", "agent_opens"), "precision": F.try_divide("hits", "kept_files"),
            "byte_overfetch_vs_hits": F.try_divide("kept_bytes", "hit_bytes")
        }
    ).drop("hit_bytes")


def stage_summary(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by outcome, bytes staged and fetch times of staged events: median, nearest-rank p95, maximum and mean.
    Oversized skips have a count of their own.
    """
    from ..functions import stats as T

    of = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    staged = lambda c: F.when(F.col("outcome") == "staged", F.col(c))
    sums = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), of("staged").alias("n_staged"), of("hit").alias("n_hits"), of("error").alias("n_errors"),
        of("skip_oversize").alias("n_skipped"), F.coalesce(F.sum(staged("size_bytes")), F.lit(0)).alias("total_bytes_staged"),
        F.max(staged("fetch_ms")).alias("max_ms"), F.avg(staged("fetch_ms")).alias("mean_ms"))
    times = T.position_percentiles(
        events.where("outcome = 'staged'"), keys, "fetch_ms", {"p50": ("linear", 0.5), "p95": ("nearest", 0.95)}
    )
    return sums.join(times, keys, "left")


def longest_prefix(paths: DataFrame, mounts: DataFrame, path: str = "path") -> DataFrame:
    """Each path with the longest mount that is it or above it; null if none. An equi join over ancestors, so mounts may
    be many.
    """
    from ..functions.paths import ancestors

    m = mounts.select(
        F.when(F.col("mount") == "/", F.lit("")).otherwise(F.rtrim("mount", F.lit("/"))).alias("__at"),
        F.struct(*mounts.columns).alias("__m")
    )
    up = paths.select(path).distinct().select(path, F.explode(ancestors(F.col(path))).alias("__at"))
    best = up.join(m, "__at").groupBy(path).agg(F.max_by("__m", F.length("__at")).alias("__m"))
    return paths.join(best, path, "left").select(*paths.columns, *[F.col(f"__m.{c}").alias(c) for c in mounts.columns])


#: Lengths of the pieces by which needles are looked up in texts.
GRAMS = (1, 2, 4, 8)


def grams(text: Column, n: int) -> Column:
    """Distinct pieces of ``n`` characters: one look-ahead at each place, so that long texts are read once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def needles_of(prior: DataFrame) -> DataFrame:
    """(path, needle): the full path of each input file, and its base name, stem and short stem where it alone has them."""
    from ..functions.paths import is_output_key, is_output_path, short_stem, stem

    inputs = prior.where(~is_output_key(F.col("bucket")) & ~is_output_path(F.col("path"))).select("path")
    names = [
        F.element_at(F.split("path", "/"), -1).alias("base"), stem(F.col("path")).alias("stem"),
        short_stem(F.col("path")).alias("short")
    ]
    each = inputs.groupBy("path").agg(F.count(F.lit(1)).alias("copies")).select("path", "copies", *names)
    each = each.withColumns({f"n_{c}": F.sum("copies").over(Window.partitionBy(c)) for c in ("base", "stem", "short")})
    forms = F.array(
        "path", F.when(F.col("n_base") == 1, F.col("base")), F.when(
            (F.col("stem") != F.col("base")) & (F.col("n_stem") == 1), F.col("stem")
        ),
        F.when((F.col("short") != F.col("stem")) & (F.col("n_short") == 1), F.col("short")))
    return each.select("path", F.explode(F.array_distinct(F.array_compact(forms))).alias("needle")).where("needle != ''")


def keyed_needles(needles: DataFrame) -> DataFrame:
    """Needles with ``gram``, the piece of each that fewest needles have (of the longest kind that fits)."""
    kind = F.coalesce(*[F.when(F.length("needle") >= n, F.lit(n)) for n in reversed(GRAMS)])
    pieces = F.coalesce(*[F.when(kind == n, grams(F.col("needle"), n)) for n in GRAMS])
    each = needles.select("path", "needle", F.explode(pieces).alias("gram"))
    n = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return each.join(n, "gram").groupBy("path", "needle").agg(F.min(F.struct("n", "gram")).alias("g")).select("path", "needle", "g.gram")


#: Needles that a task holds at a time: some hundred MB of automaton. More are looked up by the texts.
MOST_NEEDLES = 100_000


class _Needles:
    """An automaton of needles (path, needle), and the longest one."""

    def __init__(self, entries: list[tuple[str, str]]) -> None:
        self.literals = Literals((needle, i) for i, (_, needle) in enumerate(entries))
        self.entries = entries
        self.longest = max((len(n) for _, n in entries), default=1)


def literal_scan(blocks: DataFrame, prior: DataFrame) -> DataFrame:
    """(session_id, path, start): files that a session's text names by path, or by a base name, stem or short stem that
    one file has alone; the earliest mention counts.

    Needles are found anywhere in the text, across the borders of blocks too. Sessions are sorted inside partitions
    and read once by the automaton of all needles; of the text behind, only as many characters are kept as
    a needle may reach back. Offsets are in code points of the session's text.
    """
    from .matching import SCANNED

    told = blocks.where(F.col("type").isin(*SCANNED) & (F.col("text") != "")).select("session_id", "block_seq", "text")

    def work(own: _Needles, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base, tail, first = None, 0, "", {}
        kind = None

        def found() -> pa.RecordBatch:
            made = [pa.array([now] * len(first), kind), pa.array([*first], pa.string()), pa.array([*first.values()], pa.int64())]
            return pa.RecordBatch.from_arrays(made, names=["session_id", "path", "start"])

        begun = False
        for b in it:
            kind = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not begun or key != now:
                    if first:
                        yield found()
                    begun, now, base, tail, first = True, key, 0, "", {}
                seen = tail + text
                for end, keys in own.literals.places(seen):
                    if end >= len(tail):  # others were found before
                        for i in keys:
                            path, needle = own.entries[i]
                            at = base - len(tail) + end + 1 - len(needle)
                            if at < first.get(path, at + 1):
                                first[path] = at
                base += len(text)
                tail = seen[len(seen) - own.longest + 1 :] if 1 < own.longest <= len(seen) else "" if own.longest < 2 else seen
        if first:
            yield found()

    kind = dict(told.dtypes)["session_id"]
    hits = dictionary_map(
        told, needles_of(prior).select("path", "needle"), _Needles, work, f"session_id {kind}, path string, start long", MOST_NEEDLES,
        lambda e: [e[1]], lambda text: text, "session_id", "block_seq"
    )
    return hits.groupBy("session_id", "path").agg(F.min("start").alias("start"))  # needles of a path may be in two parts


def source_of(targets: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each target path with its source: itself if it exists, else the first compressed form that does, with codec and
    expected size; null if none.
    """
    from ..functions.paths import CODECS, expanded_size

    options = F.array(
        F.struct(F.lit(0).alias("rank"), F.lit(None).cast("string").alias("codec"), F.col("path").alias("source")),
        *[
            F.struct(F.lit(i).alias("rank"), F.lit(c).alias("codec"), F.concat("path", F.lit(c)).alias("source")) for i,
            c in enumerate(CODECS, 1)
        ]
    )
    tries = targets.select("path").distinct().select("path", F.inline(options))
    inv = inventory.select(
        F.col("path").alias("source"), F.col("bytes").alias("__b"),
        *([F.col("trailer")] if "trailer" in inventory.columns else [F.lit(None).cast("long").alias("trailer")])
    )
    best = tries.join(inv, "source").groupBy("path").agg(
        F.min_by(
            F.struct("source", "codec", expanded_size(F.col("codec"), F.col("__b"), F.col("trailer")).alias("size_bytes")), "rank"
        ).alias("s")
    )
    return targets.join(best, "path", "left").select(*targets.columns, "s.source", "s.codec", "s.size_bytes")


def companions(paths: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, companion): existing index files of each path."""
    from ..functions.paths import companion_names

    names = paths.select("path", F.explode(companion_names(F.col("path"))).alias("companion"))
    return names.join(
        inventory.select(F.col("path").alias("companion")).distinct(), "companion", "left_semi"
    ).select("path", "companion")


def without_zip_sibling(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Directories that have no archive of the same name beside them."""
    return dirs.join(files.select(F.col("path").alias("__z")), F.concat(dirs["path"], F.lit(".zip")) == F.col("__z"), "left_anti")


def new_listed(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Listed paths that the prior does not have yet."""
    return listed.select("path").distinct().join(known.select("path"), "path", "left_anti")


def mentioned(listed: DataFrame, tokens: DataFrame, least: int = 4) -> DataFrame:
    """Listed paths of which a base name holds one of the tokens (lower case).

    Base names are cut into all pieces of ``least`` characters; a token is joined on its first ones and then
    tested in full, so the join is by equality.
    """
    low = F.lower(F.element_at(F.split("path", "/"), -1))
    grams = listed.select("path").distinct().withColumn("__b", low).where(F.length("__b") >= least).select(
        "path", "__b",
        F.explode(
            F.array_distinct(
                F.transform(F.sequence(F.lit(1), F.length("__b") - least + 1), lambda i: F.substr("__b", i, F.lit(least)))
            )
        ).alias("__g")
    )
    t = tokens.select(F.lower("token").alias("token")).where(F.length("token") >= least).distinct().withColumn("__g", F.substring("token", 1, least))
    found = grams.join(t, "__g").where(F.contains("__b", "token")).select("path").distinct()
    return listed.join(found, "path", "left_semi")


def staged_in_time(opens: DataFrame, staged: DataFrame) -> DataFrame:
    """Opens (path, t_open) with whether the file was staged by then. The earliest completion of a path decides."""
    done = staged.groupBy("path").agg(F.min("t_completed").alias("t_done"))
    return opens.join(done, "path", "left").withColumn("hit", F.coalesce(F.col("t_done") <= F.col("t_open"), F.lit(False)))
