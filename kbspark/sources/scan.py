"""Reading a directory tree of sources as a table, with the rules for what to leave out.

Listing and reading run on the executors, one task per entry of the root and then per group of files; any file system
that pyarrow knows will do. Files that are no valid UTF-8 are left out by default.
"""

from __future__ import annotations

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.globs import glob_regex

# What is left out by default.
IGNORED_DIRS = [".git", "target", "node_modules", "vendor", ".venv", "venv", "__pycache__", ".idea", ".vscode", "dist", "build", ".next", ".terraform"]
IGNORED_PREFIXES = ["storage/logs"]
IGNORED_ENDINGS = ["lock", "png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "gz", "tar", "bin", "exe", "dll", "so", "dylib", "woff", "woff2", "ttf", "eot", "mp4", "mp3", "wav"]

FILE = "path string, size long, modified timestamp"


def list_files(spark: SparkSession, root: str, parallelism: int = 64) -> DataFrame:
    """``(path, size, modified)`` of all files below a root, hidden ones too; paths are relative to it."""
    fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
    first = [(e.path, e.type == pafs.FileType.Directory) for e in fs.get_file_info(pafs.FileSelector(base))]

    def walk(batches):
        fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        for pdf in batches:
            for path, is_dir in zip(pdf.path, pdf.is_dir, strict=True):
                infos = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if is_dir else [fs.get_file_info(path)]
                rows = [(i.path[len(base) :].lstrip("/"), i.size, i.mtime) for i in infos if i.type == pafs.FileType.File]
                yield pd.DataFrame(rows, columns=["path", "size", "modified"])

    return spark.createDataFrame(first, "path string, is_dir boolean").repartition(max(1, min(parallelism, len(first)))).mapInPandas(walk, FILE)


def read_files(files: DataFrame, root: str, lossy: bool = False) -> DataFrame:
    """The files with their ``content``; not valid UTF-8 is left out, or mended if ``lossy``."""

    def read(batches):
        fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        for pdf in batches:
            out = []
            for p in pdf.path:
                try:
                    with fs.open_input_stream(f"{base.rstrip('/')}/{p}") as f:
                        out.append(f.readall().decode("utf-8", "replace" if lossy else "strict"))
                except (OSError, UnicodeDecodeError):
                    out.append(None)
            yield pdf.assign(content=out)

    return files.mapInPandas(read, FILE + ", content string").where("content is not null")


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the user's patterns: ``dir/``, ``*.ext``, ``*part*``, a path, or a component."""
    parts, low, out = F.split(path, "/"), F.lower(path), F.lit(False)
    for p in patterns:
        if p.endswith("/"):
            one = F.array_contains(parts, p[:-1])
        elif p.startswith("*."):
            one = F.endswith(low, F.lit(p[2:]))
        elif "*" in p:
            one = F.contains(low, F.lit(p.replace("*", ""))) if p.replace("*", "") else F.lit(False)
        elif "/" in p:
            one = F.contains(path, F.lit(p))
        else:
            one = F.array_contains(parts, p)
        out = out | one
    return out


def parents(path: Column) -> Column:
    """The directories above a path, the root's children first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def default_ignored(path: Column) -> Column:
    """Whether the defaults leave a file out: by a directory above it, a prefix, or its ending."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    out = F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in IGNORED_DIRS]))
    for p in IGNORED_PREFIXES:
        out = out | F.startswith(path, F.lit(p + "/"))
    for e in IGNORED_ENDINGS:
        out = out | F.endswith(F.lower(path), F.lit(e))
    return out


def parse_ignore(text: str) -> list[tuple[int, str, bool, bool]]:
    """``(line, regex, negated, only directories)`` of an ignore file."""
    rows = []
    for n, line in enumerate((text or "").splitlines()):
        p = line.rstrip()
        if not p or p.startswith("#"):
            continue
        negated = p.startswith("!")
        p = p[1:] if negated else p.removeprefix("\\")
        if p.strip("/"):
            rows.append((n, glob_regex(p), negated, p.endswith("/")))
    return rows


def ignored_by_files(files: DataFrame) -> DataFrame:
    """``path`` of the files that ignore files of the tree leave out.

    A file and each directory above it meet the rules of the directories above them (an equal join on the directory);
    of the rules that match, the one of the deepest directory, and there the last one, decides.
    """

    def rules(batches):
        for pdf in batches:
            rows = [(p.rpartition("/")[0], *r) for p, t in zip(pdf.path, pdf.content, strict=True) for r in parse_ignore(t)]
            yield pd.DataFrame(rows, columns=["dir", "line", "regex", "negated", "dir_only"])

    own = files.where(F.col("path").rlike(r"(?:^|/)\.gitignore$")).select("path", "content")
    r = own.mapInPandas(rules, "dir string, line int, regex string, negated boolean, dir_only boolean").alias("r")
    steps = F.concat(F.transform(parents(F.col("path")), lambda p: F.struct(p.alias("at"), F.lit(True).alias("is_dir"))), F.array(F.struct(F.col("path").alias("at"), F.lit(False).alias("is_dir"))))
    c = files.select("path", F.explode(steps).alias("s")).select("path", "s.at", "s.is_dir")
    c = c.select("*", F.explode(F.concat(F.array(F.lit("")), parents(F.col("at")))).alias("dir")).alias("c")
    below = F.when(F.col("c.dir") == "", F.col("c.at")).otherwise(F.expr("substring(c.at, length(c.dir) + 2)"))
    hit = c.join(r, (F.col("c.dir") == F.col("r.dir")) & (F.col("c.is_dir") | ~F.col("r.dir_only"))).where(F.regexp_like(below, F.col("r.regex")))
    last = hit.groupBy("c.path", "c.at").agg(F.max_by("r.negated", F.struct(F.length("c.dir"), F.col("r.line"))).alias("negated"))
    return last.where("not negated").select("path").distinct()


def discover(files: DataFrame, ignore: list[str] = (), force: list[str] = ()) -> DataFrame:
    """The files to index: not hidden, not ignored by default, by pattern or by ignore files, or else forced."""
    p = F.col("path")
    forced = matches(p, list(force)) if force else F.lit(False)
    hidden = F.exists(F.split(p, "/"), lambda x: F.startswith(x, F.lit(".")))
    left_out = hidden | default_ignored(p) | (matches(p, list(ignore)) if ignore else F.lit(False))
    by_files = ignored_by_files(files).withColumn("_ignored", F.lit(True))
    f = files.join(by_files, "path", "left")
    return f.where(forced | ~(left_out | F.coalesce("_ignored", F.lit(False)))).drop("_ignored")
