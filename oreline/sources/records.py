"""Record files: JSON lines, directory listings, curated lists, service envelopes."""

from __future__ import annotations

import gzip
import io
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreline.operators import relational as R
from oreline.options import FormatError, Options

FILE = "id long, title string, dir string, filename string, size long, age long, date string, author string, description string, rating double, votes long, url string, idgamesurl string"
MEMBER = "name string, compressed long, uncompressed long, method string, encrypted boolean"
ENTRY = f"id long, dir string, filename string, zip_size long, date string, rating double, votes long, is_zip boolean, zip64 boolean, member_count long, wads array<struct<{MEMBER.replace(' ', ':').replace(',:', ',')}>>, other_members array<string>, mirror string, fetch_status string"
LEDGER = "path string, action string, kind string, detail string, attempts int"
LISTING_CAP = 256 * 2**20


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, unreadable lines): one record a line; lines that do not parse are kept apart, to be counted."""
    return parse_jsonl(spark.read.text(path), schema)


def parse_jsonl(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """:func:`read_jsonl` of a table of lines (value)."""
    got = lines.where("trim(value) <> ''").withColumn("r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return got.where("r._bad is null").select("r.*").drop("_bad"), got.where("r._bad is not null").select("value")


def write_jsonl(df: DataFrame, path: str, key: str, order: list[Column]) -> None:
    """Sorted by key, the last record of a key wins. Spark's committer makes the write all or nothing."""
    R.dedup(df, [key], order, "last").repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(path)


def ledger(df: DataFrame) -> DataFrame:
    """Ordered by the whole record."""
    return df.select("path", "action", "kind", "detail", "attempts").orderBy("path", "action", "kind", "detail", "attempts")


def listing(spark: SparkSession, path: str, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(files: dir, name, size; malformed lines) of an ``ls -lR`` text, gzip or plain. Section headers scope the rows after
    them; a file is one partition, since its order carries meaning. Its lines are read one by one, and a text of more than
    ``LISTING_CAP`` bytes fails the job or, in lenient mode, is one malformed row: a cut listing must not pass for a small one."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                lines, size, n = [], 0, 0
                data = content.as_buffer()
                source = io.BytesIO(data)
                source = gzip.GzipFile(fileobj=source) if data[:2].to_pybytes() == b"\x1f\x8b" else source
                for line in source:
                    size += len(line)
                    if size > LISTING_CAP:
                        if options.strict:
                            raise FormatError("listing_too_large", file)
                        lines, n = [], -1
                        break
                    lines.append(line.decode("utf-8", "replace").rstrip("\n"))
                    if len(lines) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array([file] * len(lines)), pa.array(range(n, n + len(lines)), pa.int32()), pa.array(lines)], ["file", "n", "line"])
                        n, lines = n + len(lines), []
                if n < 0:
                    lines = [f"listing_too_large: more than {LISTING_CAP} bytes"]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(lines), pa.string()), pa.array(range(n, n + len(lines)), pa.int32()), pa.array(lines, pa.string())], ["file", "n", "line"])

    lines = raw.mapInArrow(run, "file string, n int, line string")
    over = lines.where("n < 0").select("file").distinct()
    files, bad = parse_listing(lines.join(over, "file", "left_anti"))
    return files, bad.union(lines.where("n < 0").select("file", "n", "line"))


def parse_listing(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lines``: file, n, line."""
    line = F.regexp_replace("line", "\r$", "")
    head = F.when(line.rlike("^[^ ].*:$|^\\.:$"), F.regexp_replace(F.regexp_replace(line, ":$", ""), "^\\./?", ""))
    rows = R.forward_fill(lines.withColumn("line", line), ["file"], ["n"], head, "dir")
    rows = rows.where("line <> '' and not line rlike '^total [0-9]+$'").where(head.isNull())
    parts = r"^(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s(.+)$"
    good = F.col("line").rlike(parts)
    folder = F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/")))
    files = rows.where(good & ~F.startswith("line", F.lit("d"))).select(folder.alias("dir"), F.regexp_extract("line", parts, 9).alias("name"), F.regexp_extract("line", parts, 5).cast("long").alias("size"), "n")
    return files, rows.where(~good).select("file", "n", "line")


def outliers(spark: SparkSession, text: str) -> DataFrame:
    """Entries of a curated TOML list: slug and url, both required, slugs unique."""
    import tomllib

    rows = tomllib.loads(text).get("outlier", [])
    slugs = [r.get("slug", "") for r in rows]
    if not all(slugs) or not all(r.get("url") for r in rows) or len(set(slugs)) != len(slugs):
        raise ValueError("an outlier needs a slug of its own and a url")
    return spark.createDataFrame([(r["slug"], r["url"], json.dumps(r, sort_keys=True)) for r in rows], "slug string, url string, spec string")


def envelope(body: Column, field: str, item: str) -> Column:
    """Items of a service's answer, which holds one object or a list of them; empty for a fault."""
    inner = F.get_json_object(body, f"$.content.{field}")
    many = F.from_json(inner, f"array<struct<{item}>>")
    none = F.array().cast(f"array<struct<{item}>>")
    single = F.array(F.from_json(inner, T._parse_datatype_string(f"struct<{item}>")))
    return F.when(inner.isNull(), none).when(F.startswith(F.trim(inner), F.lit("[")), F.coalesce(many, none)).otherwise(single)


def scrub(df: DataFrame) -> DataFrame:
    """Without the fields that hold personal data, at any depth: names with ``email`` in them, text files and reviews. JSON
    text inside a string column is :func:`scrub_json`'s."""
    return df.select(*[clean.alias(f.name) for f in df.schema if not _personal(f.name) and (clean := _scrubbed(F.col(f"`{f.name}`"), f.dataType)) is not None])


def _personal(name: str) -> bool:
    low = name.lower()
    return "email" in low or low in ("textfile", "reviews")


def _scrubbed(c: Column, kind: T.DataType) -> Column | None:
    """``c`` without personal fields; None if nothing else is left."""
    if isinstance(kind, T.StructType):
        kept = [x.alias(f.name) for f in kind if not _personal(f.name) and (x := _scrubbed(c.getField(f.name), f.dataType)) is not None]
        return F.when(c.isNotNull(), F.struct(*kept)) if kept else None
    if isinstance(kind, T.ArrayType) and _nested(kind.elementType):
        return F.transform(c, lambda x: _scrubbed(x, kind.elementType)) if _scrubbed(F.lit(None).cast(kind.elementType), kind.elementType) is not None else None
    if isinstance(kind, T.MapType):
        kept = F.map_filter(c, lambda k, v: ~(F.contains(F.lower(k.cast("string")), F.lit("email")) | F.lower(k.cast("string")).isin("textfile", "reviews")))
        return F.transform_values(kept, lambda k, v: _scrubbed(v, kind.valueType)) if _nested(kind.valueType) else kept
    return c


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def scrub_json(body: Column) -> Column:
    """A JSON text without the same fields, at any depth; null stays null."""
    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if not _personal(k)}
        return [clean(x) for x in v] if isinstance(v, list) else v

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(clean(json.loads(t)), separators=(",", ":"), ensure_ascii=False))

    return run(body)


def listed_sizes(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records with ``listed``: the size the listing gives for (dir, name without case), first entry of a name; else null."""
    first = R.dedup(files.withColumn("key", F.lower("name")), ["dir", "key"], [F.col("n")], "first").select("dir", "key", F.col("size").alias("listed"))
    return records.withColumn("key", F.lower("filename")).join(first, ["dir", "key"], "left").drop("key")


def conclusive(status: Column) -> Column:
    """Statuses that may be cached."""
    return status.isin("ok", "full_download", "not_zip")


def entry_url(base: Column, folder: Column, name: Column) -> Column:
    """Address under a mirror, each segment percent-encoded."""
    enc = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.regexp_replace(base, "/*$", "/"), F.array_join(F.transform(F.split(folder, "/"), enc), "/"), enc(name))


def numbered(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.withColumn("ordinal", F.row_number().over(W.partitionBy(by).orderBy(order)) - 1)
