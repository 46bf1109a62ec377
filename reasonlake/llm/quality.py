"""Operator 4: quality rules learned as a decision list, with DataFrame functions only.

Each text gets statistics from built-in functions. Sequential covering then learns an
ordered list of rules, each a conjunction of thresholds, that mark low-quality texts:
a rule is grown one condition at a time by information gain on three fifths of the labelled rows,
pruned from its end on another fifth, and the rows it covers are set aside; the last fifth tells how good the list is.
Counts come from one
grouped aggregation a step, so the labelled rows stay distributed and only a table of
(statistic, bin) counts reaches the driver. The list becomes one ordered ``CASE``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stage_table, words_of

SYMBOLS = "#*$%&|<>"

#: The ratios that rules may test, as SQL over the base counts.
STATS = {
    "words": "n_words",
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "dup_lines_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct / n_words",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "stops_per_word": "n_stops / n_words",
}


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words and counts of lines,
    distinct words and sentence ends.

    Null counts as empty; all counts of an empty text are 0. Texts are read whole. Columns
    of ``df`` with the names of counts are replaced.
    """
    made = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words", "n_lines", "n_distinct", "n_stops"]
    keep = [c for c in df.columns if c != text and c not in made]
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    a = df.select(
        *keep, words_of(t).alias("__w"), lines.alias("__l"),
        F.regexp_count(t, F.lit("[" + SYMBOLS.replace("&", "\\&") + "]")).alias("n_symbols"),
        F.regexp_count(t, F.lit("[.!?]")).alias("n_stops")
    )
    n = F.size("__w")
    triple = F.arrays_zip(
        F.slice("__w", 1, n - 2).alias("a"), F.slice("__w", 2, n - 2).alias("b"), F.slice("__w", 3, n - 2).alias("c"),
        F.sequence(F.lit(0), n - 3).alias("at")
    )
    b = a.select(*keep, "__w", "__l", "n_symbols", "n_stops", F.when(n >= 3, F.sort_array(triple)).alias("__s"))
    # equal windows are neighbours now; of each two of them both starts count
    m = F.size("__s")
    twice = F.filter(
        F.arrays_zip(F.slice("__s", 1, m - 1).alias("x"), F.slice("__s", 2, m - 1).alias("y")),
        lambda p: (p.x.c == p.y.c) & (p.x.b == p.y.b) & (p.x.a == p.y.a)
    )
    c = b.select(*keep, "__w", "__l", "n_symbols", "n_stops", F.when(m >= 2, twice).alias("__t"))
    starts = F.array_union(F.transform("__t", lambda p: p.x["at"]), F.transform("__t", lambda p: p.y["at"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda s: F.array(s, s + 1, s + 2)))))
    return c.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__t") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
        F.col("n_stops").cast("long").alias("n_stops"),
    )


def base_failed(n_words: str = "n_words", n_repeat: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 50) | (100 * F.col(n_repeat) > 50 * F.col(n_words))


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool
    bound: float

    def sql(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.bound!r}D"


@dataclass(frozen=True)
class Rule:
    """All conditions met: low quality. ``right`` and ``wrong`` are its counts on the pruning rows."""

    conditions: tuple[Condition, ...]
    right: int
    wrong: int

    def sql(self) -> str:
        return "(" + " AND ".join(c.sql() for c in self.conditions) + ")"


def _bounds(train: DataFrame, stats: list[str], bins: int) -> dict[str, list[float]]:
    """Quantiles of each statistic, for both labels together and for the rare label alone, as thresholds."""
    at = [i / bins for i in range(bins + 1)]
    ask = [F.percentile_approx(F.when(F.col("bad") == x, F.col(s)), at).alias(f"{s}_{x}") for s in stats for x in (0, 1)]
    row = train.agg(*ask).first()
    return {s: sorted({float(v) for x in (0, 1) for v in (row[f"{s}_{x}"] or []) if v is not None}) for s in stats}


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Gain in information about the p covered positives over the rule before."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn_rules(
    train: DataFrame, stats: list[str], most_rules: int = 8, most_conditions: int = 3, bins: int = 24, least_right: float = 0.8,
    least_rows: int = 5
) -> list[Rule]:
    """An ordered list from labelled rows: ``stats`` (double), ``bad`` 0/1, ``grow`` boolean.

    A rule joins the list if, on the pruning rows that no earlier rule covers, it covers at
    least ``least_rows`` rows and a share ``least_right`` of them is bad. A threshold stands halfway between the
    two values that it parts, so that a text just beyond the good ones is not yet bad. Without rows of both labels the
    list is empty. Nulls in a statistic meet no condition.
    """
    bounds = _bounds(train, stats, bins)
    if not all(bounds.values()):  # no rows
        return []
    place = [
        F.expr(
            f"CASE WHEN {s} IS NOT NULL THEN size(filter(array({', '.join(f'{v!r}D' for v in bounds[s])}), v -> {s} > v)) END"
        ) for s in stats
    ]
    binned = stage_table(train.select(*stats, "bad", "grow", F.array(*place).alias("at")), "op4-train")

    def counts(where: str) -> dict[int, list[tuple[int, int, int]]]:
        rows = binned.where(where).select(
            "bad", F.posexplode("at").alias("stat", "bin")
        ).where("bin is not null").groupBy("stat", "bin").agg(
            F.sum("bad").alias("p"), F.count(F.lit(1)).alias("n")
        ).collect()
        out: dict[int, list[tuple[int, int, int]]] = {}
        for r in sorted(rows):
            out.setdefault(r["stat"], []).append((r["bin"], r["p"], r["n"] - r["p"]))
        return out

    def judged(conditions: list[Condition], rest: str) -> list[tuple[int, int]]:
        """(right, wrong) on the pruning rows, for each prefix of the conditions."""
        sums = []
        for k in range(1, len(conditions) + 1):
            hit = " AND ".join(c.sql() for c in conditions[:k])
            sums += [
                F.sum(F.expr(f"CASE WHEN {hit} THEN bad ELSE 0 END")), F.sum(F.expr(f"CASE WHEN {hit} THEN 1 - bad ELSE 0 END"))
            ]
        row = binned.where(f"NOT grow AND {rest}").agg(*sums).first()
        return [(int(row[2 * i] or 0), int(row[2 * i + 1] or 0)) for i in range(len(conditions))]

    rules: list[Rule] = []
    while len(rules) < most_rules:
        rest = " AND ".join(f"NOT coalesce({r.sql()}, false)" for r in rules) or "true"
        conditions: list[Condition] = []
        while len(conditions) < most_conditions:
            table = counts(" AND ".join(["grow", rest, *(c.sql() for c in conditions)]))
            if not table:
                break
            p0, n0 = max((sum(b[1] for b in t), sum(b[2] for b in t)) for t in table.values())
            if not p0 or not n0:
                break
            best: tuple[float, Condition | None] = (1e-9, None)
            for k, t in table.items():
                p = n = 0
                tp, tn = sum(b[1] for b in t), sum(b[2] for b in t)
                filled = {b: (x, y) for b, x, y in t}
                for i, bound in enumerate(bounds[stats[k]]):  # a bin holds the values above so many bounds
                    x, y = filled.get(i, (0, 0))
                    p, n = p + x, n + y
                    for q, m, above in ((p, n, False), (tp - p, tn - n, True)):
                        if q + m >= least_rows and (g := _gain(q, m, p0, n0)) > best[0]:
                            best = g, Condition(stats[k], above, bound)
            if best[1] is None:
                break
            c = best[1]
            own = " AND ".join(["grow", rest, *(x.sql() for x in conditions)])
            beyond = binned.where(own).agg(F.min(F.when(F.col(c.stat) > c.bound, F.col(c.stat)))).first()[0]
            conditions.append(c if beyond is None else Condition(c.stat, c.above, (c.bound + beyond) / 2))
        if not conditions:
            break
        tried = judged(conditions, rest)
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in tried]
        k = worth.index(max(worth))
        p, n = tried[k]
        if p + n < least_rows or p < least_right * (p + n):
            break
        rules.append(Rule(tuple(conditions[: k + 1]), p, n))
    return rules


def list_expression(rules: list[Rule]) -> Column:
    """The number of the first rule that is met, from 1; 0 if none is."""
    return F.expr(
        "CASE " + " ".join(f"WHEN {r.sql()} THEN {i}" for i, r in enumerate(rules, 1)) + " ELSE 0 END" if rules else "0"
    )


def with_stats(counts: DataFrame) -> DataFrame:
    """Counts with the statistics of ``STATS``; null where a text has no words."""
    return counts.withColumns({k: F.expr(f"CASE WHEN n_words > 0 THEN cast({v} AS double) END") for k, v in STATS.items()})


def counted(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base counts, statistics and base_failed of each row, written so that texts are read once."""
    counts = with_stats(
        base_counts(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")))
    ).withColumn("base_failed", base_failed())
    return stage_table(counts, "op4-counts")


def labelled(counts: DataFrame, labels: DataFrame, doc: str = "doc_id", label: str = "quality") -> DataFrame:
    """Statistics, ``bad`` and ``part`` (0 to 4, by hash of the id) of the labelled rows that pass the base rules.

    Rows with a null label or id are not used; of several labels of an id the lowest counts.
    """
    marks = labels.where(
        F.col(label).isNotNull() & F.col(doc).isNotNull()
    ).groupBy(F.col(doc).alias("doc_id")).agg(F.min(label).alias("label"))
    return counts.where("NOT base_failed").join(marks, "doc_id").select(
        *STATS, F.when(F.col("label") == 0, 1).otherwise(0).alias("bad"), F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("part")
    )


def learned(rows: DataFrame) -> list[Rule]:
    """The list from labelled rows: parts 0 to 2 grow it, part 3 prunes it, and part 4 has no say, so that
    ``list_figures`` can tell how good it is.
    """
    return learn_rules(rows.where("part < 4").withColumn("grow", F.col("part") < 3), list(STATS))


def list_figures(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, n, n_bad) over the labelled rows that took no part in learning; rule 0 is none."""
    return rows.where("part = 4").groupBy(list_expression(rules).alias("rule")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("bad").alias("n_bad")
    )


def judge_quality(
    docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts and statistics, base_failed, rule (number of the rule met, 0
    for none) and kept.

    The list is learned from the labelled rows that pass the base rules (label 0: low quality) and applied to every row. Null and
    empty texts have no words, so they fail the base rules; rows with a null id are judged like others.
    """
    table = counted(docs, doc, text)
    rules = learned(labelled(table, labels, doc, label))
    return table.withColumn("rule", list_expression(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
