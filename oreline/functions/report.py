"""Statistics as text: JSON and Markdown of small collected tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row


def _all(df: DataFrame, limit: int) -> list[Row]:
    """All rows; a table that is too large for a report is an error, so that no report is cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report; write them with write_csv or write_ndjson")
    return rows


def table_json(df: DataFrame, limit: int = 10_000) -> str:
    """Pretty JSON of a small result, one object for each row."""
    rows = [r.asDict(recursive=True) for r in _all(df, limit)]
    return json.dumps(rows, indent=2, default=str, sort_keys=True) + "\n"


def table_markdown(df: DataFrame, limit: int = 1_000) -> str:
    rows = _all(df, limit)
    cell = lambda v: "" if v is None else (f"{v:.2f}" if isinstance(v, float) else str(v)).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in rows]) + "\n"


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted by RFC 4180, with a header."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
