"""Labels and classes by rule: tiers, providers, models, Amdahl columns, stage decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest set sizes of tiers 1 and 2: for stored sessions (distinct files) and for live ones (with repeats).
OFFLINE, LIVE = (20, 200), (10, 200)


def tier(n: Column, bounds: tuple[int, int] = OFFLINE) -> Column:
    return F.when(n <= bounds[0], 1).when(n <= bounds[1], 2).otherwise(3)


# What tells a provider's family, in order: the column, a part of it in lower case, the family.
FAMILIES = (
    ("provider", "anthropic", "anthropic"), ("model", "claude", "anthropic"), ("provider", "gemini", "gemini"), ("provider", "google", "gemini"),
    ("model", "gemini", "gemini"), ("provider", "openrouter", "openrouter"), ("model", "deepseek", "openrouter"),
)
# What tells a model's key, in order, and the family of all other models.
MODEL_KEYS = (
    ("claude-haiku", "haiku"), ("claude-sonnet", "sonnet"), ("gemini-2.5-flash", "flash"), ("gemini-flash", "flash"), ("qwen", "qwen3"),
)
OTHER_FAMILY = "oss"


def provider_family(provider: Column, model: Column) -> Column:
    """Family of a provider, or of its model where the provider only passes it on."""
    of = {"provider": F.lower(provider), "model": F.lower(model)}
    out = F.when(of["provider"].contains("azure") & of["model"].contains("anthropic"), FAMILIES[0][2])
    for column, part, family in FAMILIES[:2]:
        out = F.when(of[column].contains(part), family).otherwise(out)
    rest = F.lit(OTHER_FAMILY)
    for column, part, family in reversed(FAMILIES[2:]):
        rest = F.when(of[column].contains(part), family).otherwise(rest)
    return F.coalesce(out, rest)


def model_key(model: Column) -> Column:
    """Short key of a model; null for others."""
    name, out = F.lower(F.coalesce(model, F.lit(""))), F.lit(None).cast("string")
    for part, key in reversed(MODEL_KEYS):
        out = F.when(name.contains(part), key).otherwise(out)
    return out


# Display names of models.
MODEL_LABELS = {
    "claude-haiku-4-5": "Haiku", "claude-sonnet-4-5": "Sonnet", "gemini-2.5-flash": "Flash", "Qwen/Qwen3.6-27B": "Qwen"
}
# Device classes of file-system types, types that hold no data, and prompt modes by bucket.
FS_CLASSES = {
    "tmpfs": "memory", "ramfs": "memory", "devtmpfs": "memory", "nfs": "network", "nfs4": "network", "cifs": "network", "smb3": "network",
    "smbfs": "network", "lustre": "network", "gpfs": "network", "9p": "network", "ceph": "network", "fuse.s3fs": "object",
    "fuse.mountpoint-s3": "object", "fuse.goofys": "object", "fuse": "object",
}
SKIPPED_FS = (
    "proc", "sysfs", "devpts", "tracefs", "debugfs", "cgroup", "cgroup2", "securityfs", "pstore", "autofs", "binfmt_misc", "configfs",
    "fusectl", "hugetlbfs", "mqueue", "nsfs", "selinuxfs", "bpf", "rpc_pipefs", "squashfs", "overlay", "overlayfs",
)
# Milliseconds of a first open from the object store and from the network mount.
OBJECT_OPEN_MS, NETWORK_OPEN_MS = 754.5, 35.0


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The value of a key in a small table of fixed values; null if it has none."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def model_label(model: Column) -> Column:
    """Display name of a model; the model itself if it has none."""
    return F.coalesce(lookup(model, MODEL_LABELS), model)


def bench_of(task: Column, benches: list[tuple[str, str, str]], other: str) -> Column:
    """Benchmark of a task: of (start of its name, or empty; a part of it, or empty; benchmark) the first of which either fits."""
    out = F.lit(other)
    for start, part, name in reversed(benches):
        fits = F.lit(False)
        if start:
            fits = fits | task.startswith(start)
        if part:
            fits = fits | task.contains(part)
        out = F.when(fits, name).otherwise(out)
    return out


def prompt_bucket(mode: Column, variant: Column, baseline: tuple[str, ...], pathful: tuple[str, ...]) -> Column:
    """Bucket of a prompt by its mode, or its variant where the mode is empty; null for others."""
    own = F.coalesce(F.nullif(mode, F.lit("")), F.nullif(variant, F.lit("")))
    return F.when(own.isin(*baseline), "baseline").when(own.isin(*pathful), "pathful")


def device_class(fs_type: Column, device: Column, rotational: Column) -> Column:
    """memory, network, object, nvme, ssd, hdd or unknown, by file-system type, else by whether the device rotates."""
    base = F.regexp_replace(F.element_at(F.split(device, "/"), -1), "[0-9]+$", "")
    still = F.when(base.startswith("nvme"), "nvme").otherwise("ssd")
    disk = F.when((base == "") | rotational.isNull(), "unknown").when(rotational, "hdd").otherwise(still)
    return F.coalesce(lookup(fs_type, FS_CLASSES), disk)


def projections(job_s: Column, io_s: Column) -> dict[str, Column]:
    """I/O share, speedup without I/O, and the total and speedup if every open came from the object store."""
    share = F.when(job_s > 0, io_s / job_s).otherwise(0.0)
    far = job_s - io_s + io_s * (OBJECT_OPEN_MS / NETWORK_OPEN_MS)
    return {
        "io_frac": share, "elim_speedup": 1.0 / F.greatest(F.lit(1e-9), 1.0 - share), "far_total_s": far,
        "far_speedup": far / F.greatest(F.lit(1e-9), job_s - io_s)
    }


def is_well_defined(task: Column, excluded: tuple[str, ...]) -> Column:
    """Whether a task is not one of those that are left out of headline numbers."""
    return ~task.isin(*excluded)


def stage_cost_ms(first_byte_ms: Column, throughput: Column, size: Column) -> Column:
    """Time to read ``size`` bytes from a tier; infinite without throughput (MiB/s)."""
    return F.when(throughput <= 0, F.lit(float("inf"))).otherwise(first_byte_ms + size / 1024 / 1024 / throughput * 1000.0)


def stage_decision(mount: Column, hot: Column, cost: Column, slack: Column) -> Column:
    """struct(stage, reason) for a file on ``mount`` (null: unknown), given the hot mount (null: no tiers)."""
    yes = lambda stage, why: F.struct(F.lit(stage).alias("stage"), F.lit(why).alias("reason"))
    return (
        F.when(hot.isNull(), yes(False, "no tiers"))
        .when(mount.isNull(), yes(True, "unknown source tier"))
        .when(mount == hot, yes(False, "already hot"))
        .when(slack.isNotNull() & (cost > slack), yes(False, "cost over slack"))
        .otherwise(yes(True, "ok"))
    )


def amdahl(cold: Column, staged: Column, cold_shell: Column, staged_shell: Column) -> dict[str, Column]:
    """Session and shell speedup, shell and I/O share, ceiling and efficiency of a cell.

    A cell without shell time on either side counts as 1.0 everywhere; callers drop cells with shell
    time on the cold side only.
    """
    none = (cold_shell == 0) & (staged_shell == 0)
    session = cold / staged
    shell = F.when(none, 1.0).otherwise(F.try_divide(cold_shell, staged_shell))
    part = F.when(none | (cold <= 0), 0.0).otherwise(F.try_divide(cold_shell, cold))
    io = F.when(shell > 1, F.greatest(F.lit(0.0), 1 - 1 / shell)).otherwise(0.0)
    rest = F.when(shell > 1, 1 - part * io * (1 - 1 / shell)).otherwise(1.0)
    ceiling = F.when(rest > 0, 1 / rest).otherwise(float("inf"))
    return {
        "session_speedup": session, "shell_speedup": shell, "shell_share": part, "io_share": io, "ceiling": ceiling,
        "efficiency": F.when(rest > 0, session * rest).otherwise(0.0)
    }


def io_split(cold: Column, cold_shell: Column, read_bytes: Column, cold_bw: float, hot_bw: float) -> dict[str, Column]:
    """Model, I/O and shell-compute seconds of a cold run, with the ideal session on the hot tier."""
    llm, io = cold - cold_shell, read_bytes / cold_bw
    compute = F.greatest(cold_shell - io, F.lit(0.0))
    ideal = llm + compute + read_bytes / hot_bw
    return {"llm_s": llm, "io_s": io, "compute_s": compute, "ideal_s": ideal, "amdahl_max": F.try_divide(cold, ideal)}


def regime_io_share(cold: Column, rchar: Column, files: Column, bandwidth: float, open_s: float) -> Column:
    return F.least(rchar / bandwidth + files * open_s, 0.97 * cold) / cold


def timely(size: Column, files: Column, budget: Column, bandwidth: float, open_s: float) -> Column:
    return F.greatest(size / bandwidth, files * open_s) <= budget


def overhead_percent(value: Column, base: Column) -> Column:
    return (value - base) / F.greatest(F.lit(1.0), base) * 100


def throughput(size: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, size / 1e6 / seconds).otherwise(0.0)


def pass_count(read: Column, single: Column, target: float = 2.0) -> dict[str, Column]:
    passes = F.try_divide(read, single)
    return {"passes": passes, "meets": passes >= target}
