"""Sinks: pages as files with front matter, rendered rows, snapshots."""

from __future__ import annotations

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kbspark.functions.text import render_front_matter, slug


def page_names(pages: DataFrame, kind: str, date: str, title: str, key: str) -> DataFrame:
    """Adds ``name``: kind, date, number within the day and title, without two pages of one name."""
    n = F.row_number().over(W.partitionBy(F.to_date(date)).orderBy(date, key))
    return pages.withColumn("name", F.concat_ws("-", F.lit(kind), F.date_format(date, "yyyy-MM-dd"), F.lpad(n.cast("string"), 4, "0"), slug(F.col(title))))


def page_text(fields: dict[str, Column], body: Column) -> Column:
    return render_front_matter(fields, body)


def write_pages(pages: DataFrame, root: str, suffix: str = ".md") -> int:
    """Write ``(name, text)`` as one file each, from the executors; returns how many."""

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        fs.create_dir(base, recursive=True)
        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["text"], strict=True):
                with fs.open_output_stream(f"{base.rstrip('/')}/{name}{suffix}") as f:
                    f.write(text.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    return pages.select("name", "text").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def rendered(df: DataFrame, form: str, columns: list[str]) -> DataFrame:
    """Rows as ``line``: jsonl, markdown (table rows) or text."""
    if form == "jsonl":
        return df.select(F.to_json(F.struct(*columns)).alias("line"))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    if form == "markdown":
        return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.regexp_replace(c, r"\|", r"\\|") for c in cells]), F.lit(" |")).alias("line"))
    return df.select(F.concat_ws("\t", *cells).alias("line"))


def snapshot(df: DataFrame, path: str) -> dict[str, int]:
    """Copy a table and compare count and content with the copy: ``{rows, copied, equal}``."""
    df.write.mode("overwrite").parquet(path)

    def state(x: DataFrame):
        row = x.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*[F.col(c) for c in df.columns])), F.lit(0)).alias("h")).first()
        return row["n"], row["h"]

    a, b = state(df), state(df.sparkSession.read.parquet(path))
    return {"rows": a[0], "copied": b[0], "equal": int(a == b)}
