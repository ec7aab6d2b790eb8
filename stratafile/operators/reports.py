"""Text reports of a hash run: every number is one aggregate, every listing a bounded top of a ranked relation.

``results`` is what :mod:`.hashing` returns with ``relative_path``,
``extension``, ``attributes``, ``depth``, ``path_length`` and ``place`` (the
walk's order) beside it. The driver sees at most ``GROUPS`` groups of
``PATHS`` paths, one row for each extension and status, and totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import render
from .ranking import ranked

#: Ruler, groups shown, paths shown for each (fixed values).
RULE = "=" * 70
GROUPS, PATHS = 20, 5

#: Labels of each report's lines and the facts they show (fixed values).
SCAN_LINES = (
    ("  Total files              : ", "files"), ("  Total size                : ", "size"), ("  Maximum folder depth      : ", "max_depth"), ("  Empty files               : ", "empty"),
    ("  Hidden files              : ", "hidden"), ("  System files              : ", "system"), ("  Paths over 260 characters : ", "long_paths"),
)
SIZE_LINES = (
    ("  Total files in inventory        : ", "files"), ("  Files unique by size (excluded)  : ", "unique"), ("  Files with a size-match (kept)   : ", "kept"),
    ("  Distinct size-groups found       : ", "groups"), ("  Max theoretical reclaimable space: ", "reclaim"),
)
PARTIAL_LINES = (
    ("  Candidate files (total)            : ", "candidates"), ("  Hashed this run                    : ", "hashed"), ("  Ruled out (not actually duplicates): ", "ruled_out"),
    ("  Confirmed duplicates (fully hashed): ", "confirmed"), ("  Still needs full hash (Script 4)   : ", "needs_full"), ("  Skipped (cloud-only, not hashed)   : ", "skipped"),
    ("  Cloud-only files hashed (may have triggered a download): ", "cloud_hashed"),
)
FINAL_LINES = (("  Confirmed duplicate groups : ", "groups"), ("  Redundant files (all but one per group): ", "redundant"), ("  Confirmed reclaimable space: ", "reclaim"))


def head(title: str, project: str, run: str, generated: str) -> list[str]:
    return [RULE, f" {title}", f" Project   : {project}", f" Run       : {run}", f" Generated : {generated}", RULE, ""]


def number(c: Column) -> Column:
    return F.format_number(F.coalesce(c, F.lit(0)), 0)


def size(c: Column) -> Column:
    return render.human_bytes(F.coalesce(c, F.lit(0)).cast("long"))


def shown(facts: DataFrame, lines: tuple[tuple[str, str], ...]) -> list[str]:
    """The lines whose fact isn't null, from a frame of one row of strings."""
    row = facts.first()
    return [label + row[name] for label, name in lines if row[name] is not None]


def listing(results: DataFrame, group: str, file: str, column: str, rank: list[Column], upper: bool = False, method: bool = False) -> list[str]:
    """The first groups in the order of ``rank`` with their first paths.

    ``rank`` orders groups by their columns ``id``, ``files``, ``bytes`` (of a
    member) and ``reclaim``. ``upper`` says that the gain is a bound,
    ``method`` how a group was confirmed.
    """
    rows = results.where(F.col(group).isNotNull())
    groups = rows.groupBy(F.col(group).alias("id")).agg(F.count("*").alias("files"), F.max("size_bytes").alias("bytes"), F.max(F.col("full_hash").isNotNull()).alias("whole"))
    groups = groups.withColumn("reclaim", F.col("bytes") * (F.col("files") - 1))
    top = groups.orderBy(*rank).limit(GROUPS).select("*", size(F.col("bytes")).alias("each"), size(F.col("reclaim")).alias("gain")).collect()
    if not top:
        return ["  (none)"]
    members = rows.where(F.col(group).isin([r["id"] for r in top])).select(F.col(group).alias("id"), "place", "relative_path")
    paths: dict[int, list[str]] = {}
    for r in ranked(members, "k", ["id"], [F.col("place")]).where(F.col("k") <= PATHS).orderBy("id", "k").collect():
        paths.setdefault(r["id"], []).append(r["relative_path"])
    out = []
    for r in top:
        how = f"  [confirmed via: {'FullHash' if r['whole'] else 'PartialHash'}]" if method else ""
        out.append(f"  Group {r['id']:3d} | {r['files']} files x {r['each']} = {'up to ' if upper else ''}{r['gain']} reclaimable{how}")
        out += [f"      - {p}" for p in paths[r["id"]]]
        if r["files"] > PATHS:
            out.append(f"      ... and {r['files'] - PATHS} more (see {file}, {column} = {r['id']})")
    return out


def by_gain() -> list[Column]:
    return [F.desc("reclaim"), F.asc("id")]


def size_report(results: DataFrame, seconds: float = 0, **names) -> list[str]:
    """Groups of equal size, before anything was read."""
    in_group = F.col("size_group_id").isNotNull()
    percent = lambda a, b: F.when(b > 0, render.half_even(100 * a / b)).otherwise(F.lit(0)).cast("double")
    plain = lambda c: F.when(c == c.cast("long"), c.cast("long").cast("string")).otherwise(c.cast("string"))
    each = results.groupBy("size_group_id").agg(F.count("*").alias("m"), F.sum("size_bytes").alias("s"), (F.max("size_bytes") * (F.count("*") - 1)).alias("x"))
    of = lambda c, which: F.coalesce(F.sum(F.when(which, F.col(c))), F.lit(0))
    every = F.lit(True)
    t = each.agg(of("m", every).alias("n"), of("m", in_group).alias("k"), of("s", every).alias("b"), of("s", in_group).alias("kb"), F.count("size_group_id").alias("g"), of("x", in_group).alias("gain"))
    files, nbytes = plain(percent(F.col("k"), F.col("n"))), plain(percent(F.col("kb"), F.col("b")))
    facts = t.select(
        number(F.col("n")).alias("files"), number(F.col("n") - F.col("k")).alias("unique"), F.concat(number(F.col("k")), F.lit(" ("), files, F.lit("% of files, "), nbytes, F.lit("% of bytes)")).alias("kept"),
        number(F.col("g")).alias("groups"), size(F.col("gain")).alias("reclaim"),
    )
    out = [*head("POTENTIAL DUPLICATES REPORT", **names), "SUMMARY", *shown(facts, SIZE_LINES), f"  Processing time                  : {clock(seconds)}", ""]
    out += ["TOP SIZE-GROUPS (by potential reclaimable space)", *listing(results, "size_group_id", "PotentialDuplicates.csv", "SizeGroupID", [F.asc("id")], upper=True)]
    return [*out, "", "NEXT STEP", "  These groups share a size; nothing is confirmed yet.", RULE]


def partial_report(results: DataFrame, seconds: float = 0, window: int = 65_536, **names) -> list[str]:
    """What the first bytes decided and what still needs the whole file."""
    status = F.col("partial_status")
    hashed = F.col("partial_hash").isNotNull()
    groups = results.where("partial_group_id is not null").groupBy("partial_group_id").agg(F.min("partial_status").alias("s"), F.count("*").alias("n"), (F.max("size_bytes") * (F.count("*") - 1)).alias("x"))
    of = lambda s: groups.where(F.col("s") == s).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("g"), F.coalesce(F.sum("x"), F.lit(0)).alias("x"))
    said = lambda s, bound: of(s).select(F.concat(number(F.col("n")), F.lit(" files, "), F.col("g").cast("string"), F.lit(f" groups, {bound}"), size(F.col("x")), F.lit(" reclaimable")).alias("x")).first()["x"]
    skipped = F.count_if(F.col("final_status") == "SkippedCloudOnly")
    read = F.coalesce(F.sum(F.when(hashed, F.least(F.col("size_bytes"), F.lit(window)))), F.lit(0))
    facts = results.agg(
        number(F.count("size_group_id")).alias("candidates"), number(F.count_if(hashed)).alias("hashed"), number(F.count_if(status == "RuledOut")).alias("ruled_out"), F.lit(said("ConfirmedDuplicate", "")).alias("confirmed"),
        F.lit(said("NeedsFullHash", "up to ")).alias("needs_full"), F.when(skipped > 0, number(skipped)).alias("skipped"), number(F.count_if(F.col("cloud") & hashed)).alias("cloud_hashed"), size(read).alias("read"), read.alias("bytes"),
    )
    r = facts.first()
    rate = facts.select(size(F.lit(r["bytes"] / seconds if seconds else 0)).alias("x")).first()["x"]
    out = [*head("PARTIAL HASH REPORT", **names), "SUMMARY", *shown(facts, PARTIAL_LINES), "", "PERFORMANCE", f"  Bytes read      : {r['read']}", f"  Processing time : {clock(seconds)}", f"  Throughput      : {rate}/sec", ""]
    for title, s in (("CONFIRMED DUPLICATE GROUPS (fully hashed -- no full hash needed)", "ConfirmedDuplicate"), ("GROUPS STILL NEEDING A FULL HASH (hand off to Script 4)", "NeedsFullHash")):
        out += [title, *listing(results.where(status == s), "partial_group_id", "PartialHashCandidates.csv", "PartialHashGroupID", by_gain(), upper=True), ""]
    return [*out, RULE]


def scan_summary(results: DataFrame) -> list[str]:
    has = lambda word: F.count_if(F.contains(F.coalesce("attributes", F.lit("")), F.lit(word))).cast("string")
    total = F.coalesce(F.sum("size_bytes"), F.lit(0))
    facts = results.agg(
        number(F.count("*")).alias("files"), F.concat(size(total), F.lit(" ("), total.cast("string"), F.lit(" bytes)")).alias("size"), F.coalesce(F.max("depth"), F.lit(0)).cast("string").alias("max_depth"),
        F.count_if(F.col("size_bytes") == 0).cast("string").alias("empty"), has("Hidden").alias("hidden"), has("System").alias("system"), F.count_if(F.col("path_length") > 260).cast("string").alias("long_paths"),
    )
    kind = F.coalesce(F.nullif(F.col("extension"), F.lit("")), F.lit("(none)"))
    kinds = results.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"), F.min("place").alias("first")).orderBy(F.desc("b"), "first")
    kinds = kinds.select("kind", number(F.col("n")).alias("n"), size(F.col("b")).alias("b")).collect()
    return [*shown(facts, SCAN_LINES), "", "FILE TYPE BREAKDOWN (by extension)", *[f"  {r['kind']:<14} {r['n']:>8} files   {r['b']}" for r in kinds]]


def final_report(results: DataFrame, whole: bool, before: tuple[int, int] | None = None, seconds: float = 0, **names) -> list[str]:
    """The report of a finished run: of every file's digest if ``whole``, else of the ladder. ``before``: files and bytes of the preliminary scan."""
    file = "FullHashInventory.csv" if whole else "DuplicateHashInventory.csv"
    now = results.agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b"), F.count("full_hash").alias("h"), F.coalesce(F.sum(F.when(F.col("full_hash").isNotNull(), F.col("size_bytes"))), F.lit(0)).alias("r"), F.count_if(F.col("final_status") == "Error").alias("e"))
    t = now.withColumn("read", size(F.col("r"))).first()
    drift = (t["n"] - before[0], t["b"] - before[1]) if before else (0, 0)
    statuses = results.groupBy("final_status").agg(F.count("*").alias("n"), F.min("place").alias("first")).orderBy("first").select("final_status", number(F.col("n")).alias("n")).collect()
    groups = results.where("duplicate_group_id is not null").groupBy("duplicate_group_id").agg(F.count("*").alias("n"), F.max("size_bytes").alias("b"))
    facts = groups.agg(number(F.count("*")).alias("groups"), number(F.sum(F.col("n") - 1)).alias("redundant"), size(F.sum(F.col("b") * (F.col("n") - 1))).alias("reclaim"), F.count("*").alias("g"))
    more = facts.first()["g"] - GROUPS
    out = [*head("FULL HASH INVENTORY REPORT" if whole else "DUPLICATE HASH INVENTORY REPORT", **names), f"SCAN SUMMARY (recomputed independently from {file})", *scan_summary(results), ""]
    out += ["DRIFT CHECK (vs. PreliminaryInventory.csv from this same run)", f"  File count difference : {drift[0]}", f"  Byte count difference : {drift[1]}"]
    if any(drift) and not whole:
        out.append("  ** Non-zero drift -- files may have changed since the Preliminary scan **")
    out += ["", "HASH RESOLUTION SUMMARY" if whole else "DUPLICATE RESOLUTION SUMMARY", *[f"  {r['final_status']:<24}: {r['n']}" for r in statuses], "", *shown(facts, FINAL_LINES), ""]
    out += ["PERFORMANCE", f"  Files fully hashed this run : {t['h']}", f"  Bytes read {'                 ' if whole else '(full hash pass) '}: {t['read']}", f"  Processing time             : {clock(seconds)}"]
    if t["e"]:
        out.append(f"  Errors (could not be hashed): {t['e']}")
    out += ["", "CONFIRMED DUPLICATE GROUPS (final)", *listing(results, "duplicate_group_id", file, "DuplicateGroupID", by_gain(), method=not whole)]
    if more > 0:
        out += ["", f"  ... and {more} more group(s) not shown here (see {file} for the full list)"]
    return [*out, RULE]


def clock(seconds: float) -> str:
    s = int(seconds)
    return f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"


def error_lines(errors: DataFrame, prefix: str = "HASH ERROR") -> DataFrame:
    """(value) lines of an error log from (relative_path, error_message) rows; no errors, no lines."""
    return errors.select(F.concat(F.lit(f"{prefix}: "), "relative_path", F.lit(" -- "), "error_message").alias("value"))


#: Lines of reports that differ from run to run begin so (fixed values).
VOLATILE = (" Generated :", "  Processing time", "  Throughput", "  Hashed this run", "  Files fully hashed this run", "  Bytes read")


def is_volatile(line: Column) -> Column:
    out = F.lit(False)
    for prefix in VOLATILE:
        out = out | line.startswith(prefix)
    return out


def run_report(runs: DataFrame, stages: DataFrame, events: DataFrame, run_id: int) -> DataFrame:
    """Everything known of a run as rows (part, seq, entry): the run, its stages in order, its events in order."""
    part = lambda df, name, seq: df.where(F.col("run_id") == run_id).select(F.lit(name).alias("part"), F.col(seq).cast("long").alias("seq"), F.to_json(F.struct(*df.columns)).alias("entry"))
    return part(runs, "run", "run_id").unionByName(part(stages, "stage", "sequence")).unionByName(part(events, "event", "seq"))
