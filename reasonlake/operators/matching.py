"""Rules over session text: generation, matching, first firing, tiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import OFFLINE, tier
from .automata import Follower, Literals, dictionary_map, pattern_of
from .automata import folded as folded_text

_sre = re._constants

SCANNED = ("thinking", "text", "tool_result")
#: Rules that a task holds at a time. Rule libraries are configuration of a few hundred rows; more are looked up by the texts.
MOST_RULES = 20_000
#: Characters that a match may have for its rule to be searched piece by piece.
MOST_WIDTH = 2_000
#: Rows, and bytes of text, that are matched at a time.
PORTION, PORTION_BYTES = 1_000, 4_000_000

# Bucket-name prefixes and their class labels, in order.
CLASS_PREFIXES = (
    "sample", "subject", "band", "channel", "detector", "scene", "files", "train", "test", "day", "month", "year", "session",
    "trial"
)
# File-format words looked for in task texts, in order.
FORMAT_WORDS = (
    "NetCDF", "netCDF", "netcdf", "nc", "BAM", "bam", "BAI", "bai", "BAS", "bas", "NWB", "nwb", "VCF", "vcf", "CSV", "csv",
    "Parquet", "parquet", "HDF5", "hdf5", "h5", "Zarr", "zarr", "FITS", "fits", "GeoTIFF", "tiff", "tif", "JSON", "json", "NPY",
    "npy"
)
# Names of buckets that hold everything, in order of preference.
AGGREGATES = ("all_files", "all_samples", "all_subjects", "all_bands", "all_sessions")
# Patterns of the general rules around the format words, and of the report rule.
FIRST_INSPECT = (
    r"(?:first|one|single|sample|representative).{0,30}(?:",
    r")|\bstart with\b|\bbegin with\b|inspect.{0,20}(?:one|a single|first)"
)
ALL_SIGNAL = (
    r"(?:all|each|every).{0,30}(?:", r")|iterate.{0,40}(?:", r")|(?:the )?(?:entire|whole|complete) (?:dataset|workspace|corpus)"
)
REPORT = r"report\.md|report markdown"
OUTPUT_FILE = r"(?i)[A-Za-z0-9_\-./]+\.(?:csv|md|png|parquet|json|txt|tsv|h5|nc)\b"


def re_escape(x: Column) -> Column:
    """A text as a pattern that matches just it."""
    return F.regexp_replace(x, r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0b\f])", r"\\$1")


def class_and_instance(key: Column) -> tuple[Column, Column]:
    """Class label and instance of a bucket name; no label and the whole name if no prefix fits."""
    label, instance = F.lit(""), key
    for c in reversed(CLASS_PREFIXES):
        fits = key.startswith(c + "_")
        label = F.when(fits, c).otherwise(label)
        instance = F.when(fits, F.substring(key, len(c) + 2, 1_000_000)).otherwise(instance)
    return label, instance


def instance_pattern(label: Column, instance: Column) -> Column:
    """Alternatives that name an instance: with its class, alone or by its part after a hyphen, and as a path part for dates."""
    esc, digits = re_escape(instance), instance.rlike("^[0-9]+$")
    bare = F.coalesce(F.nullif(F.ltrim(instance, F.lit("0")), F.lit("")), F.lit("0"))
    padded = digits & instance.startswith("0") & (F.length(instance) > 1)
    with_class = F.when(
        label != "",
        F.concat(
            F.lit(r"\b"), label, F.when(padded, F.concat(F.lit("[- _]?0?"), bare)).otherwise(F.concat(F.lit("[- _]?"), esc)),
            F.lit(r"\b")
        )
    )
    tail = F.regexp_extract(instance, "^[^-]*-(.*)$", 1)
    hyphen = instance.contains("-") & ~F.substring(instance, 1, 1).rlike("[0-9]") & (F.length(tail) >= 3)
    alone = F.when(
        hyphen, F.concat(F.lit(r"\b(?:"), esc, F.lit("|"), re_escape(tail), F.lit(r")\b"))
    ).otherwise(F.concat(F.lit(r"\b"), esc, F.lit(r"\b")))
    part = F.when(label.isin("day", "month", "year", "session") & digits, F.concat(F.lit("/"), esc, F.lit("/")))
    return F.concat_ws("|", with_class, alone, part)


def format_alternation(task: Column) -> Column:
    """Format words in a task text, found by plain substring, first spelling of each kept, and the word file; only that
    if there are none.
    """
    found = F.array_compact(F.array(*[F.when(task.contains(w), F.lit(w)) for w in FORMAT_WORDS]))
    once = F.filter(found, lambda w, i: ~F.exists(F.slice(found, 1, i), lambda o: F.lower(o) == F.lower(w)))
    return F.concat_ws("|", once, F.lit("file"))


def auto_rules(workloads: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rules of each workload from its task text and bucket names.

    ``workloads``: workload, task. ``buckets``: workload, pos, bucket. Returns workload, ord, name,
    pattern, target_keys and origin: general rules, one for each bucket, output signals and the report
    rule, which stages nothing. One group of bucket names a workload, no loops.
    """
    keys = buckets.groupBy("workload").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "bucket"))), lambda x: x.bucket).alias("keys")
    )
    w = workloads.join(keys, "workload")
    k = F.col("keys")
    named = F.coalesce(
        *[F.when(F.array_contains(k, a), F.lit(a)) for a in AGGREGATES],
        F.get(F.filter(k, lambda x: x.startswith("all_")), F.lit(0))
    )
    w = w.withColumns(
        {
            "alt": format_alternation(F.col("task")), "all_key": named,
            "files": F.array_distinct(F.regexp_extract_all("task", F.lit(OUTPUT_FILE), 0))
        }
    )
    none = F.array().cast("array<string>")
    first_keys = F.when(
        F.array_contains(k, "first_file"), F.array(F.lit("first_file"))
    ).when(
        F.array_contains(k, "all_files"), F.array(F.lit("all_files"))
    ).when(F.col("all_key").isNotNull(), F.array("all_key")).otherwise(none)
    first = w.select(
        "workload", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit("first_inspect").alias("name"),
        F.concat(F.lit(FIRST_INSPECT[0]), "alt", F.lit(FIRST_INSPECT[1])).alias("pattern"), first_keys.alias("target_keys")
    )
    every = w.where("all_key is not null").select(
        "workload", F.lit(1).alias("part"), F.lit(0).alias("pos"), F.lit("all_signal").alias("name"),
        F.concat(F.lit(ALL_SIGNAL[0]), "alt", F.lit(ALL_SIGNAL[1]), "alt", F.lit(ALL_SIGNAL[2])).alias("pattern"),
        F.array("all_key").alias("target_keys")
    )
    each = w.select("workload", "files", F.posexplode("keys").alias("pos", "key"))
    label, instance = class_and_instance(F.col("key"))
    once = Window.partitionBy("workload", "key").orderBy("pos")
    own = each.where(
        ~F.col("key").rlike("^(output_|all_|first_)") & (instance != "")
    ).withColumn("__n", F.row_number().over(once)).where("__n = 1")
    own = own.select(
        "workload", F.lit(2).alias("part"), "pos", F.col("key").alias("name"), instance_pattern(label, instance).alias("pattern"),
        F.array("key").alias("target_keys")
    )
    suffix = F.substring("key", len("output_") + 1, 1_000_000)
    named_files = F.filter("files", lambda f: F.contains(F.lower(f), suffix) | F.lower(f).endswith(F.concat(F.lit("."), suffix)))
    output = each.where(F.col("key").startswith("output_")).select(
        "workload", F.lit(3).alias("part"), "pos", F.concat("key", F.lit("_signal")).alias("name"),
        F.when(
            F.size(named_files) > 0, F.array_join(F.transform(named_files, re_escape), "|")
        ).otherwise(F.concat(F.lit(r"\."), re_escape(suffix), F.lit(r"\b"))).alias("pattern"),
        F.array("key").alias("target_keys")
    )
    report = w.select(
        "workload", F.lit(4).alias("part"), F.lit(0).alias("pos"), F.lit("report_out").alias("name"),
        F.lit(REPORT).alias("pattern"), none.alias("target_keys")
    )
    rules = first.unionByName(every).unionByName(own).unionByName(output).unionByName(report)
    return rules.select(
        "workload", (F.row_number().over(Window.partitionBy("workload").orderBy("part", "pos")) - 1).alias("ord"), "name",
        "pattern", "target_keys", F.lit("auto").alias("origin")
    )


def filter_origin(rules: DataFrame, dropped: list[str]) -> DataFrame:
    """Rules without those of the dropped origins; general rules always stay."""
    return rules.where((F.col("origin") == "general") | ~F.col("origin").isin(*dropped))


def canonical(rules: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``rules`` of each key in order as one canonical JSON text: names of fields sorted, nothing between tokens."""
    rule = F.to_json(F.struct("name", "origin", "pattern", "target_keys"))
    each = F.transform(F.sort_array(F.collect_list(F.struct("ord", rule.alias("rule")))), lambda x: x.rule)
    return rules.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")).alias("rules"), F.count(F.lit(1)).alias("n_rules"))


def fingerprint(rules: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """SHA-256 of the canonical JSON of the rules of each key, and their number."""
    return canonical(rules, keys).select(*keys, F.sha2(F.col("rules").cast("binary"), 256).alias("fingerprint"), "n_rules")


def library_fingerprint(rules: DataFrame, workload: str = "workload") -> DataFrame:
    """One row: SHA-256 of all workloads' fingerprints by name, and the numbers of workloads and rules. Any change of any
    rule changes it.
    """
    own = fingerprint(rules, (workload,))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(workload, "fingerprint"))), lambda x: F.concat(x[workload], F.lit(":"), x.fingerprint))
    return own.agg(
        F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n_workloads"), F.sum("n_rules").alias("n_rules")
    )


def _needs(items) -> list[list[str]]:
    """Sets of texts, any match of a parsed pattern holds one of each set."""
    out, run = [], ""
    for op, arg in items:
        if op is _sre.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if run:
            out.append([run])
        run = ""
        if op is _sre.SUBPATTERN and not arg[1] and not arg[2]:
            out += _needs(arg[3])
        elif op is _sre.ATOMIC_GROUP:
            out += _needs(arg)
        elif op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT, _sre.POSSESSIVE_REPEAT) and arg[0] > 0:
            out += _needs(arg[2])
        elif op is _sre.BRANCH:
            best = [_best(_needs(x)) for x in arg[1]]
            if all(best):
                out.append([x for b in best for x in b])
    return [*out, [run]] if run else out


def _best(needs: list[list[str]]) -> list[str] | None:
    """The set whose shortest text is longest."""
    return max(needs, key=lambda n: (min(map(len, n)), -len(n)), default=None)


@lru_cache(maxsize=2_000)
def parsed(pattern: str):
    """The pattern as Python's parser reads it; null for what only Java knows, or reads otherwise."""
    if "\\0" in pattern:
        return None
    try:
        return re._parser.parse(pattern)
    except (re.error, OverflowError):
        return None


def literals_of(pattern: str) -> list[str] | None:
    """Lower-case ASCII texts of which any match of the pattern holds one, folded as ``folded`` does; null if none can be told."""
    tree = parsed(pattern)
    best = tree and _best(_needs(tree))
    return best if best and min(map(len, best)) > 1 else None


def _needed(rule: tuple) -> list[str] | None:
    return literals_of(rule[2])


def folded(text: Column) -> Column:
    """Lower case, with the letters that match ASCII ones when case is ignored as these."""
    out = F.lower(text)
    for letter, plain in (("\u017f", "s"), ("\u0131", "i"), ("i\u0307", "i")):
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def most_width(pattern: str) -> int | None:
    """The longest match in characters, where a match depends on its own characters alone; null if it has no bound, or
    looks at what is around it.
    """
    tree = parsed(pattern)
    if tree is None:
        return None
    width = tree.getwidth()[1]
    return width if width <= MOST_WIDTH and not _looks_around(tree) else None


def _looks_around(items) -> bool:
    for op, arg in items:
        if op in (_sre.AT, _sre.ASSERT, _sre.ASSERT_NOT, _sre.GROUPREF_EXISTS):
            return True
        inner = arg[1] if op is _sre.BRANCH else [arg[3]] if op is _sre.SUBPATTERN else [arg] if op is _sre.ATOMIC_GROUP else []
        if op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT, _sre.POSSESSIVE_REPEAT):
            inner = [arg[2]]
        if any(_looks_around(x) for x in inner):
            return True
    return False


class Rules:
    """Rules (ord, name, pattern, target_keys) that are searched in texts: one pass over the literals that they need
    tells which patterns to try.
    """

    def __init__(self, rules: list[tuple]) -> None:
        self.rows = [tuple(r) for r in rules]
        self.workloads = [r[4] if len(r) > 4 else None for r in self.rows]
        needs = [literals_of(r[2]) for r in self.rows]
        self.literals = Literals((x, i) for i, need in enumerate(needs) if need for x in need)
        self.always = [i for i, need in enumerate(needs) if not need]
        self.needy = [bool(need) for need in needs]

    @cached_property
    def widths(self) -> list[int | None]:
        return [most_width(r[2]) for r in self.rows]

    @cached_property
    def reaches(self) -> list[int | None]:
        return [reach_of(r[2]) for r in self.rows]

    def search(self, i: int):
        return expression(self.rows[i][2]).search

    def likely(self, text: str) -> list[int]:
        """Rules that may match in a text, in order."""
        return sorted({*self.literals.within(folded_text(text)), *self.always})


@lru_cache(maxsize=MOST_RULES)
def expression(pattern: str):
    """The compiled pattern, case ignored; what Python's own dialect doesn't know is read by the wider one."""
    try:
        return re.compile(pattern, re.IGNORECASE)
    except re.error:
        return regex.compile(pattern, regex.IGNORECASE | regex.VERSION0)


_FIRED = [("ord", "ord int"), ("name", "name string"), ("target_keys", "target_keys array<string>")]


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _with_rules(b: pa.RecordBatch, found: list[tuple[int, tuple, int]], extra: list[tuple[str, pa.Array]] = ()) -> pa.RecordBatch:
    """The rows of a batch that were found, with the rule and the place."""
    own = b.take(pa.array([f[0] for f in found], pa.int64()))
    made = [
        *own.columns, *(x.take(pa.array([f[0] for f in found], pa.int64())) for _, x in extra), pa.array([f[1][0] for f in found], pa.int32()),
        pa.array([f[1][1] for f in found], pa.string()), pa.array([f[1][3] for f in found], pa.list_(pa.string())),
        pa.array([f[2] for f in found], pa.int64())
    ]
    return pa.RecordBatch.from_arrays(made, names=[*b.schema.names, *(n for n, _ in extra), *(n for n, _ in _FIRED), "match_start"])


def portions(b: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``PORTION`` rows and about ``PORTION_BYTES`` of the texts in column ``at``, so that rows that
    many rules match aren't copied for all of it at once.
    """
    ends = np.cumsum(pc.binary_length(b.column(at)).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < b.num_rows:
        upto = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PORTION_BYTES, "right"))
        stop = min(start + PORTION, max(start + 1, upto))
        yield b.slice(start, stop - start)
        start = stop


def _told(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("type").isin(*SCANNED) & (F.col("text") != ""))


def matches(blocks: DataFrame, rules: DataFrame, workload: str | None = None) -> DataFrame:
    """Each rule that matches a scanned block, alone (block-local mode).

    Adds ord, name, target_keys and match_start in code points. A block is read once by the automaton of all literals that
    rules need (beyond ``MOST_RULES``, of those that its chunk of texts asks for); only rules whose literal it holds, and those that need none, are tried. With
    ``workload``, a column of both, blocks meet the rules of their own workload alone, so one pass serves many workloads.
    """
    told = _told(blocks)
    at = told.columns.index("text")
    whose = told.columns.index(workload) if workload else None

    def work(own: Rules, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in it for x in portions(whole, at)):
            found = []
            workloads = b.column(whose).to_pylist() if workload else [None] * b.num_rows
            for row, (text, of) in enumerate(zip(b.column(at).to_pylist(), workloads, strict=True)):
                for i in own.likely(text):
                    if workload and own.workloads[i] != of:
                        continue
                    m = own.search(i)(text)
                    if m:
                        found.append((row, own.rows[i], m.start()))
            if found:
                yield _with_rules(b, found)

    schema = ", ".join([_fields(told), *(t for _, t in _FIRED), "match_start long"])
    entries = rules.select("ord", "name", "pattern", "target_keys", *([workload] if workload else []))
    return dictionary_map(told, entries, Rules, work, schema, MOST_RULES, _needed, folded_text)


def transcript(blocks: DataFrame) -> DataFrame:
    """Scanned blocks with ``char_base``, the code points of the session before each, in order."""
    before = Window.partitionBy("session_id").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.where(F.col("type").isin(*SCANNED) & (F.col("text") != "")).withColumn(
        "char_base", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    )


class _Transcript:
    """What transcript mode knows of a session and a set of rules before the next block.

    Rules of bounded width need the end of the text only, other regular ones the state of their automaton. For the few that are
    neither (look-around, references) the whole text is kept.
    """

    def __init__(self, rules: Rules) -> None:
        self.rules, self.base, self.tail, self.whole = rules, 0, "", []
        self.back = max((w for w in rules.widths if w is not None), default=1)
        self.open = set(range(len(rules.rows)))
        self.follow, self.odd = {}, set()
        for i in self.open:
            if rules.widths[i] is None:
                p = pattern_of(rules.rows[i][2])
                if p is None:
                    self.odd.add(i)
                else:
                    self.follow[i] = Follower(p)

    def block(self, text: str) -> Iterator[tuple[tuple, int]]:
        """Rules that fire at the next block, with the place of their match in the session."""
        rules, start = self.rules, len(self.tail)
        seen = self.tail + text
        if self.odd:
            self.whole.append(text)
            all_ = "".join(self.whole)
        for i in rules.likely(seen):
            if i not in self.open or i in self.follow or i in self.odd:
                continue
            m = rules.search(i)(seen, max(0, start - rules.widths[i]))
            if m:  # decided: of a match that starts earlier no later block is the first
                self.open.discard(i)
                if m.start() >= start:
                    yield rules.rows[i], m.start() - start + self.base
        before = seen[max(0, start - 1) : start]
        for i in sorted(self.follow.keys() & self.open):
            f = self.follow[i]
            if f.gone:
                self.open.discard(i)
                continue
            m = rules.search(i)(before + text, len(before))
            if m and not f.older(text):
                self.open.discard(i)
                yield rules.rows[i], m.start() - len(before) + self.base
            else:
                f.feed(text)
        for i in sorted(self.odd & self.open):
            m = rules.search(i)(all_)
            if m and m.start() >= self.base:
                self.open.discard(i)
                yield rules.rows[i], m.start()
        self.base += len(text)
        self.tail = seen[-self.back :]


def transcript_matches(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule that fires at a block in transcript mode: the leftmost match over all text up to the block's end starts in it.

    A match across two blocks thus keeps its rule from firing later, as reading the running transcript does. Adds ord, name,
    target_keys, char_base (the session's scanned characters before the block) and match_start. Sessions are sorted
    inside partitions and read once, block after block: a rule of bounded width (``MOST_WIDTH``) looks back as
    far as a match may reach, any other goes on from the state of its automaton, so that the time follows the text. Only rules with
    look-around or references are searched in the whole text at each block.
    """
    told = _told(blocks)
    at, who = told.columns.index("text"), told.columns.index("session_id")

    def work(own: Rules, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, session = object(), None
        for b in it:
            found, bases = [], []
            for row, (key, text) in enumerate(zip(b.column(who).to_pylist(), b.column(at).to_pylist(), strict=True)):
                if key != now:
                    now, session = key, _Transcript(own)
                bases.append(session.base)
                found += [(row, rule, start) for rule, start in session.block(text)]
            if found:
                yield _with_rules(b, found, [("char_base", pa.array(bases, pa.int64()))])

    schema = ", ".join([_fields(told), "char_base long", *(t for _, t in _FIRED), "match_start long"])
    return dictionary_map(
        told, rules.select("ord", "name", "pattern", "target_keys"), Rules, work, schema, MOST_RULES, _needed, folded_text, "session_id", "block_seq"
    )


def first_fire(found: DataFrame) -> DataFrame:
    """The first firing of each rule name in a session."""
    order = Window.partitionBy("session_id", "name").orderBy("block_seq", "match_start", "ord")
    return found.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def fired_at(t_first: Column, t_stop: Column, done: Column, length: Column) -> Column:
    """Time of a position in a block, linear between its first and last delta; the known end if one is missing."""
    return F.when(t_first.isNull(), t_stop).when(t_stop.isNull(), t_first).otherwise(
        t_first + (t_stop - t_first) * done / F.greatest(F.lit(1), length)
    )


def target_sizes(rules: DataFrame, prior: DataFrame, bounds: tuple[int, int] = OFFLINE) -> DataFrame:
    """(name, n, tier): distinct files that the targets of a rule hold. One row a rule, however often it fires."""
    keys = rules.select("name", F.explode("target_keys").alias("bucket")).distinct()
    n = keys.join(prior.select("bucket", "path"), "bucket").groupBy("name").agg(F.count_distinct("path").alias("n"))
    return n.withColumn("tier", tier(F.col("n"), bounds))


def tier_files(fired: DataFrame, sizes: DataFrame, prior: DataFrame, upto: int) -> DataFrame:
    """(session_id, path, bytes) of the rules of a tier up to ``upto``. Tier 1 holds few files a rule; for higher ones
    ask for mixes instead.
    """
    keys = fired.join(
        sizes.where(F.col("tier") <= upto).select("name"), "name"
    ).select("session_id", F.explode("target_keys").alias("bucket")).distinct()
    return keys.join(prior.select("bucket", "path", "bytes"), "bucket").select("session_id", "path", "bytes").distinct()


def mixes(fired: DataFrame, sizes: DataFrame) -> DataFrame:
    """(session_id, mix): the sorted (tier, bucket) pairs that a session's rules point to. Many sessions have the same
    mix, so files are counted once a mix.
    """
    own = fired.join(sizes.select("name", "tier"), "name").select("session_id", "tier", F.explode("target_keys").alias("bucket"))
    return own.groupBy("session_id").agg(F.sort_array(F.collect_set(F.struct("tier", "bucket"))).alias("mix"))


def mix_files(of: DataFrame, prior: DataFrame) -> DataFrame:
    """(mix, path, bytes, tier): each file of each distinct mix, in its lowest tier."""
    keys = of.select("mix").distinct().select("mix", F.inline("mix"))
    return keys.join(
        prior.select("bucket", "path", "bytes"), "bucket"
    ).groupBy("mix", "path", "bytes").agg(F.min("tier").alias("tier"))


def tier_times(fired: DataFrame, sizes: DataFrame) -> DataFrame:
    """Earliest firing of each session's rules, by their own tier."""
    at = lambda k: F.min(F.when(F.col("tier") == k, F.col("t_first")))
    return fired.join(sizes.select("name", "tier"), "name").groupBy("session_id").agg(
        at(1).alias("t_tier_1"), at(2).alias("t_tier_2"), at(3).alias("t_tier_3")
    )


def reach_of(pattern: str) -> int | None:
    """How far back from a prefix's end a match may start that no shorter prefix has; null without a bound. Borders of
    words and ends are seen from the prefix, look-ahead isn't.
    """
    tree = parsed(pattern)
    if tree is None or re.search(r"\(\?<?[=!]|\(\?\(", pattern):
        return None
    width = tree.getwidth()[1]
    return width if width <= MOST_WIDTH else None


class _Prefixes:
    """What prefix mode knows of a session and a set of rules before the next block."""

    def __init__(self, rules: Rules) -> None:
        self.rules, self.base, self.tail, self.whole = rules, 0, "", []
        self.open = set(range(len(rules.rows)))
        self.patterns = [pattern_of(r[2]) for r in rules.rows]
        # a rule that needs a literal and has a bounded reach rests until the literal is near
        self.rests = {i for i in self.open if self.patterns[i] and rules.needy[i] and rules.reaches[i] is not None}
        self.follow = {i: Follower(p) for i, p in enumerate(self.patterns) if p and i not in self.rests}
        self.gone: set[int] = set()
        self.back = max((rules.reaches[i] + 2 for i in self.rests), default=1)  # an end may stand before a last line break
        self.keep = any(p is None for p in self.patterns)

    def _follower(self, i: int) -> Follower:
        if i not in self.rests:
            return self.follow[i]
        known = self.tail[-(self.rules.reaches[i] + 2) :]
        f = Follower(self.patterns[i], known[:1] if len(known) < self.base else "")
        f.feed(known[1:] if len(known) < self.base else known)
        f.gone = f.gone or i in self.gone
        return f

    def block(self, text: str, thinking: bool) -> Iterator[tuple[tuple, int]]:
        """Rules that fire in the next block, with the characters of the session that are known by then."""
        rules, start = self.rules, len(self.tail)
        seen = self.tail + text
        near = set(rules.likely(seen))
        if self.keep:
            self.whole.append(text)
        before = self.tail[-1:]
        for i in sorted(self.open):
            if i in self.rests and i not in near and i not in self.gone:
                continue
            if self.patterns[i] is None:
                at = self._odd(i, thinking)
            else:
                f = self._follower(i)
                if thinking:
                    at = f.first_end(text)
                    at = None if at is None else self.base + at
                else:
                    m = rules.search(i)(before + text, len(before))
                    at = self.base + len(text) if m and not f.older(text) else None
                    if at is None:
                        f.feed(text)
                if f.gone:
                    self.gone.add(i)
            if at is not None:
                self.open.discard(i)
                yield rules.rows[i], at
        self.base += len(text)
        self.tail = seen[-self.back :]

    def _odd(self, i: int, thinking: bool) -> int | None:
        """A pattern that isn't regular: each prefix is searched whole."""
        whole, search = "".join(self.whole), self.rules.search(i)
        if thinking:
            return next((e for e in range(self.base + 1, len(whole) + 1) if search(whole, 0, e)), None)
        m = search(whole)
        return len(whole) if m and m.start() >= self.base else None


def prefix_fire(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """First firing of each rule name in a session when thinking is tested at every character.

    Returns session_id, name, block_seq, turn, type and first_known_at, the code points known
    when the rule fires: for thinking the shortest prefix of the transcript that matches, which may match where the full
    text does not (a word border at its end); for other blocks the end of the block, if the leftmost match starts in it.
    Automata of the patterns go on by one character at a time and are asked whether a match may end there, so the time follows the
    text. Patterns with look-around or references have no automaton and are searched over each prefix.
    """
    told = _told(blocks).select("session_id", "block_seq", "turn", "type", "text")

    def work(own: Rules, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, session = object(), None
        for b in it:
            found = []
            columns = zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)
            for row, (key, kind, text) in enumerate(columns):
                if key != now:
                    now, session = key, _Prefixes(own)
                found += [(row, rule[1], at) for rule, at in session.block(text, kind == "thinking")]
            if found:
                rows = b.take(pa.array([f[0] for f in found], pa.int64()))
                made = [rows.column(0), pa.array([f[1] for f in found]), *rows.columns[1:4], pa.array([f[2] for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(made, names=["session_id", "name", "block_seq", "turn", "type", "first_known_at"])

    kinds = dict(told.dtypes)
    schema = f"session_id {kinds['session_id']}, name string, block_seq {kinds['block_seq']}, turn {kinds['turn']}, type string, first_known_at long"
    own = rules.select("ord", "name", "pattern", F.array().cast("array<string>").alias("target_keys"))
    found = dictionary_map(told, own, Rules, work, schema, MOST_RULES, _needed, folded_text, "session_id", "block_seq")
    first = Window.partitionBy("session_id", "name").orderBy("first_known_at")  # names may have several rules
    return found.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
