"""Path and file-name expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefixes of output paths and of output bucket names.
OUTPUT_PATHS = ("/output/", "/repo/result/")
OUTPUT_KEYS = ("output_",)

# File extensions that a listing may add to the inventory.
LISTED = (
    ".nc", ".csv", ".parquet", ".json", ".h5", ".hdf5", ".tsv", ".txt", ".md", ".bam", ".vcf", ".nwb", ".npy", ".npz", ".pkl"
)

# Compressed forms in the order they are tried, and index files by primary suffix.
CODECS = (".gz", ".zst", ".bz2", ".xz")
COMPANIONS = {
    ".bam": (".bai",), ".cram": (".crai",), ".vcf": (".tbi", ".csi"), ".bcf": (".csi",), ".fasta": (".fai",), ".fa": (".fai",),
    ".fastq": (".fai",)
}
FALLBACK_RATIO = 4


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """Base name up to its last dot; a name that starts with its only dot has an empty stem."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def short_stem(path: Column) -> Column:
    return F.replace(stem(path), F.lit("T120000"), F.lit(""))


def is_output_path(path: Column) -> Column:
    return _any([path.startswith(p) for p in OUTPUT_PATHS])


def is_output_key(key: Column) -> Column:
    return _any([key.startswith(p) for p in OUTPUT_KEYS])


def resolve(path: Column, prefixes: list[tuple[str, str]]) -> Column:
    """Path with the first matching logical prefix replaced; unchanged if none matches."""
    out = path
    for logical, real in reversed(prefixes):
        out = F.when(
            path.startswith(logical), F.concat(F.lit(real), F.substring(path, len(logical) + 1, 2_000_000_000))
        ).otherwise(out)
    return out


def resolve_under(path: Column, prefixes: list[tuple[str, str]], root: str) -> Column:
    """Like resolve; unmatched paths at or below /data go under ``root``, without a leading part that repeats a logical prefix."""
    rel = F.ltrim(F.substring(path, len("/data") + 1, 2_000_000_000), F.lit("/"))
    cut = rel
    for logical, _ in reversed(prefixes):
        own = logical[len("/data/"):].rstrip("/")
        cut = F.when(
            rel.startswith(own + "/"), F.substring(rel, len(own) + 2, 2_000_000_000)
        ).when(rel == own, F.lit("")).otherwise(cut)
    base = root.rstrip("/")
    aliased = F.when(cut == "", F.lit(base)).otherwise(F.concat(F.lit(base + "/"), cut))
    known = _any([path.startswith(logical) for logical, _ in prefixes])
    return F.when(known, resolve(path, prefixes)).when((path == "/data") | path.startswith("/data/"), aliased).otherwise(path)


def under_root(path: Column, root: Column) -> Column:
    """Equal to the root or below it; a longer sibling name is not below."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def mirror(root: str, path: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/")), path)


def listed_extension(path: Column, extensions: tuple[str, ...] = LISTED) -> Column:
    return F.contains(path, F.lit("/")) & _any([path.endswith(e) for e in extensions])


def listing_files(text: Column) -> Column:
    """Paths of ``FILE path (N bytes)`` lines."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*FILE\s+(\S+)\s+\(\d+\s+bytes\)\s*$"), 1)


def listing_sizes(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(r"(?m)^\s*FILE\s+\S+\s+\((\d+)\s+bytes\)\s*$"), 1), lambda x: x.cast("long")
    )


def path_tokens(text: Column) -> Column:
    """Distinct paths named in free text, from ``data/`` on, in order of mention.

    A path starts with /data/ or with data/ not after a word character or slash; trailing
    punctuation goes; it must end in an extension of one to six characters.
    """
    raw = F.regexp_extract_all(text, F.lit(r"(?:/data/|(?<![A-Za-z0-9_/])data/)[A-Za-z0-9_./\-]+"), 0)
    cut = F.transform(raw, lambda p: F.regexp_replace(F.ltrim(p, F.lit("/")), r"[.,;:\-/]+$", ""))
    return F.array_distinct(F.filter(cut, lambda p: p.rlike(r"\.[A-Za-z0-9]{1,6}$")))


def command_paths(commands: DataFrame, prior: DataFrame, prefixes: list[tuple[str, str]], command: str = "cmd") -> DataFrame:
    """(session_id, path, real): logical paths that a shell command names and the prior has, with the real path; each
    once a session.
    """
    raw = F.transform(
        F.regexp_extract_all(command, F.lit(r"/data/[A-Za-z0-9_./\-]+"), 0), lambda p: F.rtrim(p, F.lit(".,;:'\")"))
    )
    named = commands.select("session_id", F.explode(F.array_distinct(raw)).alias("path")).distinct()
    known = named.join(prior.select("path").distinct(), "path", "left_semi")
    return known.select("session_id", "path", resolve(F.col("path"), prefixes).alias("real"))


def ancestors(path: Column) -> Column:
    """The path and every directory above it, so that prefix joins become equi joins."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def child_of(prefix: Column, path: Column) -> Column:
    """The component of ``path`` just below ``prefix``; null if it isn't below."""
    norm = F.rtrim(prefix, F.lit("/"))
    return F.when(path.startswith(F.concat(norm, F.lit("/"))), F.split(F.substr(path, F.length(norm) + 2), "/")[0])


# Buckets of competition files, by whole name, and by ending with a part of the name; the first that fits
# counts. No bucket: left out.
ROLE_NAMES = {"description.md": None, "sample_submission.csv": "sample_csv", "train.csv": "train_csv", "test.csv": "test_csv"}
ROLE_ENDINGS = (
    (".csv", "", "extra_csv"), (".zip", "train", "train_zip"), (".zip", "test", "test_zip"), (".zip", "", "data_zip"),
    *((e, "", "extra_data") for e in (".tsv", ".parquet", ".feather", ".jsonl", ".npy", ".npz", ".h5", ".hdf5")),
    *((e, "", "media") for e in (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".wav", ".mp3", ".flac")),
)
# File endings that a code tree's buckets hold.
CODE_ENDINGS = (".py", ".yaml", ".sh", ".md")
# Patterns whose first group is the instance of a bucket, by the bucket's class.
INSTANCES = {
    "band": r"M6C(08|09|10)", "day": r"/\d{4}/(\d{3})/\d{2}/", "detector": r"_(nrc[ab][1234])_", "sample": r"/data/([A-Z]{2}\d{5})/",
    "subject": r"/(sub-[A-Za-z0-9]+)[/_]",
}
MONTH = r"_(\d{4})(\d{2})\d{2}"


def first_fit(tests: list[tuple[Column, str | None]]) -> Column:
    """The value of the first test that holds; null if none does."""
    out = F.lit(None).cast("string")
    for test, value in reversed(tests):
        out = F.when(test, F.lit(value).cast("string")).otherwise(out)
    return out


def role_bucket(name: Column) -> Column:
    """Bucket of a competition file by its name; null for descriptions and other files."""
    low = F.lower(name)
    return first_fit(
        [
            *((low == n, v) for n, v in ROLE_NAMES.items()),
            *((low.endswith(e) & low.contains(part), v) for e, part, v in ROLE_ENDINGS)
        ]
    )


def code_bucket(relative: Column, buckets: list[tuple[str, str]]) -> Column:
    """Bucket of a file of a code tree by its path below the root: of (path, or start of one that ends in a slash; bucket) the
    first that fits; null for others, caches and other kinds of files.
    """
    own = first_fit([(relative.startswith(p) if p.endswith("/") else relative == p, v) for p, v in buckets])
    kind = _any([relative.endswith(e) for e in CODE_ENDINGS])
    return F.when(kind & ~relative.contains("__pycache__") & ~relative.contains(".git"), own)


def csv_role(name: Column) -> Column:
    """Bucket of the files of a table task: train, test, sample and submission; null for others."""
    return first_fit(
        [
            (name == f"{f}.csv", v) for f,
            v in (
                ("train", "train_csv"), ("test", "test_csv"), ("sample_submission", "sample_csv"),
                ("submission", "output_submission")
            )
        ]
    )


def csv_bucket(name: Column) -> Column:
    """A bucket for each CSV file of a folder, by its stem; null for others."""
    return F.when(F.lower(name).endswith(".csv"), F.concat(F.lit("csv_"), F.translate(stem(name), "-.", "__")))


def class_bucket(name: Column, classes: dict[str, str]) -> Column:
    """Bucket of a file by the class that its name starts with, up to the first dot; null for others."""
    return first_fit([(name.startswith(k + "."), v) for k, v in classes.items()])


def merged_prior(tasks: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(bucket, path) of many tasks in one prior: for each task (task) its files (task, name) train.csv and test.csv,
    each in a bucket of its own, and all in one.
    """
    own = files.where(F.col("name").isin("train.csv", "test.csv")).join(tasks.select("task").distinct(), "task")
    path = F.concat(F.lit(root + "/"), "task", F.lit("/"), "name")
    bucket = F.concat(F.regexp_replace("name", r"\.csv$", "_"), F.translate("task", "-", "_"))
    return own.select(F.explode(F.array(bucket, F.lit("all_files"))).alias("bucket"), path.alias("path")).distinct()


def instance_buckets(path: Column) -> Column:
    """All buckets ``class_instance`` of a path: bands, days, detectors, samples, subjects, and months as ``month_YYYY-MM``."""
    month = F.when(
        F.regexp_extract(path, MONTH, 1) != "",
        F.concat(F.lit("month_"), F.regexp_extract(path, MONTH, 1), F.lit("-"), F.regexp_extract(path, MONTH, 2))
    )
    return F.array_compact(F.concat(pattern_buckets(path, INSTANCES), F.array(month)))


def group_bucket(relative: Column) -> Column:
    """Bucket by the first directory of a relative path."""
    parts = F.split(relative, "/", 2)
    return F.concat(F.lit("files_"), F.translate(F.when(F.size(parts) > 1, parts[0]).otherwise("root"), "-.", "__"))


def pattern_buckets(path: Column, patterns: dict[str, str]) -> Column:
    """All buckets ``name_value`` of a path, one for each pattern whose first group matches."""
    found = [
        F.when(F.regexp_extract(path, p, 1) != "", F.concat(F.lit(k + "_"), F.regexp_extract(path, p, 1))) for k,
        p in patterns.items()
    ]
    return F.array_compact(F.array(*found))


def expanded_size(codec: Column, size: Column, trailer: Column) -> Column:
    """Expected size of an expanded file: a gzip trailer that exceeds the compressed size, else a fixed ratio."""
    return F.when(codec.isNull(), size).when((codec == ".gz") & (trailer > size), trailer).otherwise(size * FALLBACK_RATIO)


def companion_names(path: Column) -> Column:
    """Candidate names of index files: suffix appended, then last suffix replaced; a codec suffix hides the primary one."""
    base, low = basename(path), F.lower(basename(path))
    last = F.regexp_extract(low, r"(\.[^.]+)$", 1)
    inner = F.regexp_extract(low, r"(\.[^.]+)\.[^.]+$", 1)
    primary = F.when(last.isin(*CODECS), inner).otherwise(last)
    swap = F.regexp_replace(path, r"\.[^./]+$", "")
    out = F.array().cast("array<string>")
    for key, suffixes in COMPANIONS.items():
        names = [x for s in suffixes for x in (F.concat(path, F.lit(s)), F.concat(swap, F.lit(s)))]
        out = F.when(primary == key, F.array_distinct(F.array(*names))).otherwise(out)
    return F.when(base == "", F.array().cast("array<string>")).otherwise(out)
