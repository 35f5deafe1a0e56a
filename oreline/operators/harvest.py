"""The offline part of harvesting an archive: worklists, outcomes and their ledger, caches, budgets, byte ranges.

Everything that needs no network, as expressions and joins. Waiting, retrying and pools of workers are left to Spark's tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.functions import scalars as S
from oreline.sources import records as R

# Ledger kinds and details of each failure, and the status an entry gets.
FAILURES = {
    "mirror_404_all": ("mirror404_all", "http_error", "404 on all mirrors"),
    "budget_refused": ("no_range_support", "http_error", "no-range fallback refused: budget exhausted or breaker tripped"),
    "entry_too_large": ("no_range_support", "http_error", "entry exceeds per-entry fallback cap"),
    "zip_parse": ("zip_parse_error", "parse_error", None),
    "fetch": ("fetch_error", "http_error", None),
}
# The same for curated outliers, which have one host and no mirrors.
OUTLIER_FAILURES = {
    "range_unsupported": ("no_range_support", "http_error", "host refuses range requests"),
    "not_found": ("fetch_error", "http_error", "404 not found"),
    "http": ("fetch_error", "http_error", None),
    "directory_too_large": ("zip_parse_error", "parse_error", None),
    "too_chatty": ("zip_parse_error", "parse_error", None),
    "parse": ("zip_parse_error", "parse_error", None),
}
SKIPPED = "skipped: outliers.toml marks the host known-dead (skip = true)"  # fixed value


def _choice(table: dict[str, tuple], key: Column, i: int) -> Column:
    out = F.lit(None).cast("string")
    for name, row in table.items():
        if row[i] is not None:
            out = F.when(key == name, F.lit(row[i])).otherwise(out)
    return out


# ---------------------------------------------------------------- worklists
def worklist(dirs: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(``dir`` to work on, top folders to decide about by hand) of a listing's folders; a root means its whole subtree."""
    d = dirs.select("dir").distinct()
    if root is not None:
        prefix = S.normalize_dir(F.lit(root))
        return d.where(F.startswith("dir", prefix)), d.where(F.lit(False)).select(F.col("dir").alias("top"))
    said = d.withColumn("scope", S.triage(F.col("dir")))
    top = F.concat(F.split("dir", "/")[0], F.lit("/"))
    return said.where("scope = 'include'").select("dir"), said.where("scope = 'triage'").select(top.alias("top")).distinct()


def is_suspect(files: Column, dirs: Column) -> Column:
    """An answer without both collections cannot be told from one for a path that does not exist."""
    return files.isNull() & dirs.isNull()


def enrich(work: DataFrame, answers: DataFrame, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, ledger) of the answers (dir, error, attempts, files, dirs) for a worklist. Errors and suspect answers
    become ledger rows; files whose size is not the listed one are kept and noted."""
    a = work.select("dir").join(answers, "dir", "left")
    suspect = F.col("error").isNull() & is_suspect(F.col("files"), F.col("dirs"))
    line = lambda kind, detail, attempts: [F.lit("getcontents").alias("action"), F.lit(kind).alias("kind"), detail.alias("detail"), attempts.cast("int").alias("attempts")]
    bad = a.where("error is not null").select(F.col("dir").alias("path"), *line("http_error", F.col("error"), F.col("attempts")))
    bad = bad.union(a.where(suspect).select("dir", *line("suspect_path", F.lit("content.file and content.dir both null"), F.lit(1))))
    got = a.where(F.col("error").isNull() & ~suspect).select("dir", F.explode("files").alias("f")).select("dir", "f.*")
    if listed is not None:
        j = R.listed_sizes(got, listed).where("listed <> size")
        detail = F.concat(F.lit("api size "), F.col("size").cast("string"), F.lit(" vs ls-laR size "), F.col("listed").cast("string"))
        bad = bad.union(j.select(F.concat("dir", "filename"), *line("size_mismatch", detail, F.lit(1))))
    return got, bad


# ---------------------------------------------------------------- outcomes
def to_records(entries: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, ledger) of entries (id, dir, filename, size, …) and what became of them: ``outcomes`` has id, outcome
    (``inspected``, ``full_download`` or a key of ``FAILURES``), detail, mirror, zip64, member_count, wads, other_members. An
    entry that is no archive has a record without any."""
    j = entries.join(outcomes, "id", "left")
    is_zip = F.endswith(S.ascii_lower(F.col("filename")), F.lit(".zip"))
    seen = is_zip & F.col("outcome").isin("inspected", "full_download")
    wads, others = "array<struct<name:string,compressed:bigint,uncompressed:bigint,method:string,encrypted:boolean>>", "array<string>"
    status = F.when(~is_zip, "not_zip").when(F.col("outcome") == "inspected", "ok").when(F.col("outcome") == "full_download", "full_download").otherwise(_choice(FAILURES, F.col("outcome"), 0))
    recs = j.where(~is_zip | F.col("outcome").isNotNull()).select(
        "id", "dir", "filename", F.col("size").alias("zip_size"), is_zip.alias("is_zip"), F.when(seen, F.col("zip64")).otherwise(F.lit(False)).alias("zip64"),
        F.when(seen, F.col("member_count")).otherwise(0).cast("long").alias("member_count"), F.when(seen, F.col("wads")).otherwise(F.array().cast(wads)).alias("wads"),
        F.when(seen, F.col("other_members")).otherwise(F.array().cast(others)).alias("other_members"), F.when(is_zip, F.coalesce("mirror", F.lit(""))).otherwise("").alias("mirror"), status.alias("fetch_status"),
    )
    text = F.coalesce(_choice(FAILURES, F.col("outcome"), 2), "detail", F.lit(""))
    text = F.when(F.coalesce("mirror", F.lit("")) == "", text).otherwise(F.concat(text, F.lit(": last mirror "), "mirror"))
    failed = j.where(is_zip & F.col("outcome").isin(*FAILURES))
    return recs, failed.select(F.concat("dir", "filename").alias("path"), F.lit("harvest-zips").alias("action"), _choice(FAILURES, F.col("outcome"), 1).alias("kind"), text.alias("detail"), F.lit(1).alias("attempts"))


def outlier_records(specs: DataFrame, outcomes: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, ledger) of curated outliers (n, slug, url, skip) in file order, and what became of them: slug, outcome (``ok``
    or a key of ``OUTLIER_FAILURES``), detail, attempts, zip_size, member_count. Those marked to skip were not asked."""
    s = specs.orderBy("n").limit(limit) if limit is not None else specs
    j = s.join(outcomes, "slug", "left").where("skip or outcome is not null")
    skip, ok = F.col("skip"), F.col("outcome") == "ok"
    status = F.when(skip, "skipped_known_dead").when(ok, "ok").otherwise(_choice(OUTLIER_FAILURES, F.col("outcome"), 0))
    recs = j.select("slug", "url", F.when(skip, 0).otherwise(F.coalesce("zip_size", F.lit(0))).cast("long").alias("zip_size"), F.when(~skip & ok, F.col("member_count")).otherwise(0).cast("long").alias("member_count"), status.alias("fetch_status"))
    kind = F.when(skip, "skipped").otherwise(_choice(OUTLIER_FAILURES, F.col("outcome"), 1))
    text = F.when(skip, SKIPPED).otherwise(F.coalesce(_choice(OUTLIER_FAILURES, F.col("outcome"), 2), "detail", F.lit("")))
    bad = j.where(skip | ~ok).select(F.col("slug").alias("path"), F.lit("harvest-outliers").alias("action"), kind.alias("kind"), text.alias("detail"), F.when(skip, 0).otherwise(F.col("attempts")).cast("int").alias("attempts"))
    return recs.orderBy("slug"), bad


# ---------------------------------------------------------------- caches and budgets
def is_fresh(fetched: Column, now: Column, ttl_seconds: int) -> Column:
    """Whether a cached answer may still be used: not unreadable, not from the future, younger than the limit."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.call_function("try_to_timestamp", fetched))
    return F.coalesce((age >= 0) & (age < ttl_seconds * 1_000_000), F.lit(False))


def dir_hashes(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Hash of the cached answer for each folder of the records; folders without one are left out."""
    return records.select("dir").distinct().join(cache.where("action = 'getcontents'").select(F.col("path").alias("dir"), "body_hash"), "dir")


def fallback_limit(entries: int) -> int:
    """Whole downloads that may be needed: two in a hundred entries, and two at least."""
    return max(2, entries * 2 // 100)


def admit(needs: DataFrame, order: str, size: str, entries: int, budget: int) -> DataFrame:
    """``needs`` with ``decision``: download, skip (more than is left of the byte budget, which it then leaves as it is) or abort
    (more needs than :func:`fallback_limit`). Needs beyond the limit are never looked at in order, so one task
    folds no more than that many."""
    limit = fallback_limit(entries)
    first = needs.orderBy(order).limit(limit)
    ddl = f"__o {needs.schema[order].dataType.simpleString()}, decision string"

    def run(batches):
        left = budget
        for b in batches:
            said = []
            for n in b.column(1).to_pylist():
                fits = n <= left
                left -= n if fits else 0
                said.append("download" if fits else "skip")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said)], ["__o", "decision"])

    told = first.select(F.col(order).alias("__o"), F.col(size).cast("long").alias("__s")).coalesce(1).sortWithinPartitions("__o").mapInArrow(run, ddl)
    return needs.join(told, F.col(order) == F.col("__o"), "left").drop("__o").withColumn("decision", F.coalesce("decision", F.lit("abort")))


# ---------------------------------------------------------------- byte ranges, names, ids
def content_range(value: Column) -> Column:
    """start, end, total (null for ``*``) of a ``Content-Range`` header; null if it is not one."""
    form = r"^(?i:bytes) *([0-9]+) *- *([0-9]+) */ *(\*|[0-9]+) *$"
    n = lambda i: F.regexp_extract(value, form, i).try_cast("bigint")
    total_known = F.regexp_extract(value, form, 3) != "*"
    ok = value.rlike(form) & n(1).isNotNull() & n(2).isNotNull() & (n(1) <= n(2)) & (~total_known | n(3).isNotNull())
    return F.when(ok, F.struct(n(1).alias("start"), n(2).alias("end"), n(3).alias("total")))


def probe_total(value: Column) -> Column:
    """The size that the answer to a one-byte probe tells; null if it tells none."""
    r = content_range(value)
    return F.when((r["start"] == 0) & (r["end"] == 0) & (r["total"] != 0), r["total"])


def range_fault(value: Column, offset: Column, end: Column, expected: Column) -> Column:
    """What is wrong with the answer to a request for bytes ``offset`` to ``end``; null if nothing is."""
    r = content_range(value)
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when(r.isNull(), "206 with a missing, unparseable, or malformed Content-Range")
        .when((r["start"] != offset) | (r["end"] != end), text("Content-Range mismatch: got ", r["start"], "-", r["end"], ", wanted ", offset, "-", end))
        .when(r["total"] != expected, text("Content-Range mismatch: got total ", r["total"], ", wanted ", expected))
    )


def sample_file(record_id: Column, filename: Column) -> Column:
    """Name of a sampled archive on disk; null if it is no safe single path segment."""
    name = F.concat(record_id.cast("string"), F.lit("-"), filename)
    return F.when(is_safe_segment(name), name)


def is_safe_segment(name: Column) -> Column:
    return (name != "") & ~name.isin(".", "..") & ~name.rlike(r'[/\\:*?"<>|\x00-\x1F\x7F]') & ~F.endswith(name, F.lit(".")) & ~F.endswith(name, F.lit(" "))


def manifest_id(started: Column) -> Column:
    return F.date_format(started, "'harvest-'yyyyMMdd'T'HHmmss'Z'")


def mirror_url(base: Column, folder: Column, name: Column) -> Column:
    """:func:`records.entry_url` under a mirror; null for names that would lead out of it."""
    seg = F.filter(F.split(folder, "/"), lambda s: s != "")
    bad = (name == "") | F.contains(name, F.lit("/")) | name.isin(".", "..") | F.exists(seg, lambda s: s.isin(".", ".."))
    inside = F.array_join(seg, "/")
    return F.when(~bad, R.entry_url(base, F.when(inside == "", "").otherwise(F.concat(inside, F.lit("/"))), name))
