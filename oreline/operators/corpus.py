"""Statistics of a harvested archive: one record for each entry, with its container members nested (``records.ENTRY``).

Everything is a declarative aggregate. Members are counted by size before segments are formed, and shares and caps
come from one-row aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.functions import scalars as S
from oreline.functions import stats as X
from oreline.sources import records as R

# Statuses of entries whose sizes can be trusted; methods that readers must take.
SIZED = ("ok", "full_download")
ALLOWED = ("stored", "deflate")


def population(records: DataFrame) -> DataFrame:
    return records.where(F.col("fetch_status").isin(*SIZED))


def sample_frame(records: DataFrame) -> DataFrame:
    """Entries a sample may be drawn from: inspected over ranges, with a container inside."""
    return records.where((F.col("fetch_status") == "ok") & (F.size("wads") > 0))


def members(records: DataFrame) -> DataFrame:
    return records.select("id", "dir", "date", "votes", F.explode("wads").alias("m")).select("id", "dir", "date", "votes", "m.*")


def size_stats(records: DataFrame) -> DataFrame:
    """Distribution of member sizes: one row for all, one for each folder bucket, one for each year (``segment``, ``key``)."""
    m = members(population(records)).groupBy(S.top_bucket(F.col("dir")).alias("bucket"), S.year_of(F.col("date")).alias("year"), "uncompressed").agg(F.count(F.lit(1)).alias("times"))
    row = lambda segment, key: F.struct(F.lit(segment).alias("segment"), key.alias("key"))
    segments = F.explode(F.array(row("core", F.lit("")), row("bucket", F.col("bucket")), row("year", F.col("year")))).alias("s")
    return X.distribution(m.select(segments, "uncompressed", "times").select("s.*", "uncompressed", "times"), "uncompressed", "segment", "key", times="times")


def size_histogram(records: DataFrame) -> DataFrame:
    return X.log2_histogram(members(population(records)), "uncompressed")


def weighted_size_stats(records: DataFrame) -> DataFrame:
    """Member sizes weighted by votes; members of entries without votes are counted as excluded."""
    return X.weighted_distribution(members(population(records)), "uncompressed", "votes")


def zip_size_stats(records: DataFrame, files: DataFrame) -> DataFrame:
    """One row over entries with a container: distribution of listed sizes (own sizes where the listing has none), and how
    the two sizes differ; absolute differences are ranked over differing entries only."""
    e = R.listed_sizes(population(records).where("size(wads) > 0").select("dir", "filename", "zip_size"), files)
    e = e.select(F.coalesce("listed", "zip_size").alias("size"), "listed", F.when(F.col("listed") != F.col("zip_size"), F.abs(F.col("listed") - F.col("zip_size"))).alias("delta"))
    counts = e.agg(
        F.count("listed").alias("entries_compared"), F.count("delta").alias("mismatched"), F.count_if(F.col("listed").isNull()).alias("listing_misses"),
        F.coalesce(F.max(F.when(F.col("listed") > 0, F.col("delta") / F.col("listed"))), F.lit(0.0)).alias("max_relative"),
    )
    zero = lambda c, n: F.coalesce(c, F.lit(0)).cast("long").alias(n)
    deltas = X.ranked(e, "delta", {"p50": 500, "p99": 990}, moments=False).select(zero("most", "max_abs_delta"), zero("p50", "p50_abs_delta"), zero("p99", "p99_abs_delta"))
    return X.distribution(e, "size").join(counts).join(deltas)  # single rows


def entry_stats(records: DataFrame) -> DataFrame:
    """One row of counts and shares of entries."""
    p = population(records)
    stray = F.size(F.filter("other_members", lambda n: F.endswith(S.ascii_lower(n), F.lit(".wad"))))
    n, wads = F.count(F.lit(1)), F.size("wads")
    got = p.agg(
        n.alias("zip_entries"), F.count_if(wads == 0).alias("zero_wad"), F.count_if(wads > 1).alias("multi_wad"), F.count_if("zip64").alias("zip64_entries"),
        F.coalesce(F.sum(F.size(F.filter("wads", lambda m: m["encrypted"]))), F.lit(0)).cast("long").alias("encrypted_members"), F.coalesce(F.sum(stray), F.lit(0)).cast("long").alias("wad_named_other_members"),
    )
    share = lambda c: S.safe_ratio(F.col(c), F.col("zip_entries")).alias(f"{c}_share")
    return got.select("*", share("zero_wad"), share("multi_wad"))


def entry_total(c: str = "wads") -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, m: a + m["uncompressed"])


def entry_distributions(records: DataFrame) -> DataFrame:
    """Distributions of an entry's member count and of its containers' total size (0 without containers): ``what``, …"""
    row = lambda what, v: F.struct(F.lit(what).alias("what"), v.cast("long").alias("v"))
    both = population(records).select(F.inline(F.array(row("member_count", F.col("member_count")), row("wad_total", entry_total()))))
    return X.distribution(both, "v", "what")


def method_counts(records: DataFrame) -> DataFrame:
    """Members by method, with whether readers must take it."""
    got = members(population(records)).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return got.withColumn("allowed", F.col("method").isin(*ALLOWED)).withColumn("label", S.method_label(F.col("method")))


def allowlist_cost(records: DataFrame) -> DataFrame:
    """One row: members that the allowed methods leave out, of all."""
    return method_counts(records).agg(F.coalesce(F.sum(F.when(~F.col("allowed"), F.col("n"))), F.lit(0)).alias("rejected"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))


def ratio_stats(records: DataFrame) -> DataFrame:
    """Compression ratios of deflated members and of whole entries (``population``), with the number of members that took no
    bytes though they have some; these are in neither population."""
    p = population(records)
    odd = lambda m: (m["compressed"] == 0) & (m["uncompressed"] > 0)
    kept = F.filter("wads", lambda m: ~odd(m))
    total = lambda f: F.aggregate(kept, F.lit(0).cast("long"), lambda a, m: a + m[f])
    each = p.select(F.explode(kept).alias("m")).where("m.method = 'deflate' and m.compressed > 0").select(F.lit("member_deflate").alias("population"), F.col("m.uncompressed").alias("u"), F.col("m.compressed").alias("c"))
    entry = p.select(F.lit("per_entry").alias("population"), total("uncompressed").alias("u"), total("compressed").alias("c")).where("c > 0")
    anomalies = p.agg(F.coalesce(F.sum(F.size(F.filter("wads", odd))), F.lit(0)).cast("long").alias("zero_compressed_anomalies"))
    return X.ratio_distribution(each.union(entry), "u", "c", "population").join(anomalies)


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("fetch_status").agg(F.count(F.lit(1)).alias("n"))


def outlier_rows(records: DataFrame) -> DataFrame:
    """A row for each curated outlier (slug, zip_size, member_count, wads, fetch_status): counts of those analyzed, and the
    status of those skipped, in the order of their slugs."""
    ok = F.col("fetch_status") == "ok"
    when = lambda c, n: F.when(ok, c).cast("long").alias(n)
    largest = F.coalesce(F.array_max(F.transform("wads", lambda m: m["uncompressed"])), F.lit(0))
    got = records.select(
        "slug", F.when(ok, "analyzed").otherwise("skipped").alias("state"), F.when(~ok, F.col("fetch_status")).alias("fetch_status"), when(F.col("zip_size"), "zip_size"),
        when(F.col("member_count"), "member_count"), when(F.size("wads"), "wad_count"), when(largest, "max_wad_uncompressed"), when(entry_total(), "total_wad_uncompressed"),
    )
    return got.orderBy("slug")


def outlier_maxima(records: DataFrame) -> DataFrame:
    """One row: greatest sizes and counts over the outliers analyzed; all null if there are none."""
    rows = outlier_rows(records).where("state = 'analyzed'")
    return rows.agg(F.max("zip_size").alias("zip"), F.max("max_wad_uncompressed").alias("wad"), F.max("member_count").alias("members"), F.max("total_wad_uncompressed").alias("total"))


def combined(own: Column, other: Column, multiplier: int) -> Column:
    """Least power of two from ``multiplier`` times the greater of two observations, of which the second may be missing."""
    most = F.greatest(own, F.coalesce(other, own))
    return S.pow2_ceil(F.coalesce(F.call_function("try_multiply", most.cast("long"), F.lit(multiplier).cast("long")), F.lit(2**63 - 1)))


def recommendations(records: DataFrame, files: DataFrame, outliers: DataFrame, manifest_zip64: int | None) -> DataFrame:
    """The eight limits, in order: ``ordinal``, ``key``, ``recommended`` (text), ``value``, ``note``. ``manifest_zip64``: the run's own
    count of large archives, or None for a run that covers only a part."""
    p995 = lambda df, name: df.select(F.col("p99_5").alias(name))
    d = entry_distributions(records).groupBy().pivot("what", ["member_count", "wad_total"]).agg(F.max("max"))
    r = ratio_stats(records).agg(F.max(F.when(F.col("population") == "member_deflate", F.col("max"))).alias("ratio"))
    z = entry_stats(records).select("zip64_entries")
    m = method_counts(records).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("method", "n"))), lambda s: F.concat(s["method"], F.lit(" = "), s["n"].cast("string"))), ", ").alias("methods"), F.coalesce(F.bool_or(~F.col("allowed")), F.lit(False)).alias("unexpected"))
    sizes = X.distribution(members(population(records)).select("uncompressed"), "uncompressed")
    one = p995(zip_size_stats(records, files), "zip_p").join(p995(sizes, "wad_p")).join(d).join(r).join(z).join(m).join(outlier_maxima(outliers))  # single rows
    wad = combined(F.col("wad_p"), F.col("wad"), 1)
    ratio = F.coalesce((F.ceil(F.col("ratio") * 2 / 10) * 10).cast("long"), F.lit(40))
    none = F.lit(None).cast("long")
    agrees = "scoped" if manifest_zip64 is None else None
    zip64 = F.lit(agrees) if agrees else F.when(F.col("zip64_entries") == manifest_zip64, "manifest agrees").otherwise(F.lit(f"manifest has {manifest_zip64}"))
    table = [
        ("wire_cap_zip", None, combined(F.col("zip_p"), F.col("zip"), 1), None), ("wire_cap_wad", None, wad, None), ("decoded_cap", None, wad, F.lit("as wire_cap_wad")),
        ("max_member_count", "plain", combined(F.coalesce("member_count", F.lit(0)), F.col("members"), 2), None),
        ("max_entry_uncompressed_bytes", None, combined(F.coalesce("wad_total", F.lit(0)), F.col("total"), 2), None),
        ("max_member_compression_ratio", "plain", ratio, F.when(F.col("ratio").isNull(), "nothing observed")),
        ("compression_method_allowlist", ", ".join(ALLOWED), none, F.concat("methods", F.when(F.col("unexpected"), " (unexpected)").otherwise(""))),
        ("zip64_statement", "zip64 handled", none, zip64),
    ]
    rows = []
    for i, (key, text, value, note) in enumerate(table):
        said = F.lit(text) if text and text != "plain" else value.cast("string") if text else S.format_bytes(value)
        rows.append(F.struct(F.lit(i).alias("ordinal"), F.lit(key).alias("key"), said.alias("recommended"), value.alias("value"), (F.lit(None).cast("string") if note is None else note).alias("note")))
    return one.select(F.inline(F.array(*rows)))
