"""Ways to cut texts into chunks. Line windows are column expressions; order-dependent chunkers run in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Beginnings of lines that open a structure, per language.
STRUCTURES = {
    "rust": r"(?:pub(?:\(crate\))? )?(?:async )?fn |(?:pub )?(?:struct|enum|trait|mod) |impl |type ",
    "python": r"(?:async )?def |class ",
    "javascript": r"(?:export (?:default )?)?(?:async )?function |(?:export )?class |const |let ",
    "go": r"func |type |package ",
    "java": r"(?:public )?(?:class|interface|enum) |.*public static void main.*\(",
    "c": r"void |int |static |extern |class |struct |namespace |template",
    "cpp": r"void |int |static |extern |class |struct |namespace |template",
}


def tokens_to_lines(tokens: int) -> int:
    """Ten tokens a line, one line at least; none stands for 80 lines."""
    return 80 if tokens == 0 else max(tokens // 10, 1)


def text_lines(content: Column) -> Column:
    """Lines without their ends; a last line end opens no further line, an empty text has no lines."""
    c = F.regexp_replace(F.regexp_replace(content, "\r\n", "\n"), r"\n\z", "")
    return F.when(F.length(content) > 0, F.split(c, "\n", -1)).otherwise(F.array().cast("array<string>"))


def chunk_lines(df: DataFrame, content: str, max_lines: int = 51, overlap: int = 6) -> DataFrame:
    """Adds ``chunk_no, line_start, line_end, text``: windows of lines that share ``overlap`` lines with the one before.

    Null and empty contents give no rows. The names added replace columns of the same name.
    """
    max_lines = max(max_lines, 1)
    overlap = min(overlap, max_lines - 1)
    d = df.withColumn("_lines", text_lines(F.col(content)))
    n = F.size("_lines")
    starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(max_lines - overlap)), lambda i: (i == 0) | (i + overlap < n))
    d = d.where(n > 0).select("*", F.posexplode_outer(starts).alias("_no", "_start"))
    return d.withColumns(
        {"chunk_no": F.col("_no"), "line_start": F.col("_start") + 1, "line_end": F.least(F.col("_start") + max_lines, n), "text": F.array_join(F.slice("_lines", F.col("_start") + 1, max_lines), "\n")}
    ).drop("_lines", "_no", "_start")


def words_of(text: str) -> int:
    """Estimated tokens: words times 1.3, rounded up."""
    return -(-len(text.split()) * 13 // 10)


def by_words(text: str, limit: int, at: int = 0) -> list[tuple[int, int]]:
    """Spans of consecutive words within the limit; a single longer word stands alone."""
    out, start, end, n = [], 0, 0, 0
    most = max(int(limit / 1.3), 1)
    for m in re.finditer(r"\S+\s*", text):
        if n == most:
            out.append((at + start, at + end))
            start, n = end, 0
        n, end = n + 1, m.end()
    if n:
        out.append((at + start, at + end))
    return out


def text_chunks(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Paragraphs packed up to the limit; a paragraph over it is cut by words; ``overlap`` tokens of text are repeated."""
    out: list[tuple[int, int]] = []
    start = end = size = 0

    def flush() -> None:
        body = text[start:end].rstrip("\n")
        if not body.strip():
            return
        if words_of(body) > limit:
            out.extend(by_words(body, limit, start))
        else:
            out.append((start, start + len(body)))

    at = 0
    for para in text.split("\n\n"):
        a, b = at, at + len(para)
        at = b + 2
        n = words_of(para)
        if n > limit:
            flush()
            out.extend(by_words(para, limit, a))
            start = end = at
            size = 0
            continue
        if size + n > limit and end > start:
            flush()
            back = 0
            if overlap:
                tail = [m.start() for m in re.finditer(r"\S+", text[:end])][-max(int(overlap / 1.3), 1) :]
                back = end - max(tail[0], start + 1) if tail and tail[0] > start else 0
            start = end - back
            size = words_of(text[start:end])
            end = min(b + 2, len(text))
        else:
            end = min(b + 2, len(text))
        size += n
    flush()
    return out


def markdown_chunks(text: str) -> list[tuple[int, int]]:
    """Sections: from a line that begins with ``#`` up to the next."""
    at = [m.start() for m in re.finditer(r"(?m)^[ \t]*#", text)]
    cuts = sorted({0, *at, len(text)})
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b < len(text) or text[a:b].strip()]


def recursive_chunks(text: str, limit: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " "), at: int = 0) -> list[tuple[int, int]]:
    """Cut at the first separator, parts over the limit at the next one, and at last by length; parts are not merged."""
    n = words_of(text)
    if n <= limit:
        return [(at, at + len(text))] if n else []
    if not separators:
        step = max(limit * 4, 1)
        return [(at + i, at + min(i + step, len(text))) for i in range(0, len(text), step) if text[i : i + step].strip()]
    out, pos, sep = [], 0, separators[0]
    while pos < len(text):
        i = text.find(sep, pos)
        end = len(text) if i < 0 else i + len(sep)
        out += recursive_chunks(text[pos:end], limit, separators[1:], at + pos)
        pos = end
    return out


def line_windows(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Lines packed up to the limit of tokens, ``overlap`` lines repeated."""
    spans, at = [], 0
    for line in text.splitlines(keepends=True):
        spans.append((at, at + len(line)))
        at += len(line)
    out, i = [], 0
    while i < len(spans):
        j, size = i, 0
        while j < len(spans) and (j == i or size + 1 + words_of(text[slice(*spans[j])]) <= limit):
            size += 1 + words_of(text[slice(*spans[j])])
            j += 1
        if text[spans[i][0] : spans[j - 1][1]].strip():
            out.append((spans[i][0], spans[j - 1][1]))
        if j >= len(spans):
            break
        i = max(j - overlap, i + 1)
    return out


def code_chunks(text: str, language: str | None, limit: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Structures of a language, small neighbours merged up to the limit; line windows where there are none."""
    rx = STRUCTURES.get(language or "")
    cuts = [m.start() for m in re.finditer(rf"(?m)^[ \t]*(?:{rx})", text)] if rx else []
    if not cuts:
        return line_windows(text, limit, overlap)
    blocks = [(a, b) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) if text[a:b].strip()]
    out: list[tuple[int, int]] = []
    for a, b in blocks:
        if out and words_of(text[out[-1][0] : out[-1][1]]) + words_of(text[a:b]) <= limit:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def byte_chunks(text: str, most: int = 1500, look_back: int = 100) -> list[tuple[int, int]]:
    """At most so many UTF-8 bytes, cut after a line end within the last ``look_back`` of them where there is one."""
    data, out, at, done = text.encode(), [], 0, 0
    while at < len(data):
        end = min(at + most, len(data))
        if end < len(data):
            nl = data.rfind(b"\n", max(at, end - look_back), end)
            end = nl + 1 if nl >= 0 else end
            while end > at and data[end] & 0xC0 == 0x80:
                end -= 1
        n = len(data[at:end].decode())
        out.append((done, done + n))
        done, at = done + n, end
    return out


def chunk_texts(df: DataFrame, id_col: str, text_col: str, method: str, limit: int = 512, overlap: int = 64, language_col: str | None = None) -> DataFrame:
    """``(id, chunk_no, start_char, end_char, text)`` by a method: text, markdown, recursive, code, bytes.

    Null and blank texts give no rows; rows with one id are cut each by itself; further columns are ignored.
    """
    cut = {
        "text": lambda t, g: text_chunks(t, limit, overlap),
        "markdown": lambda t, g: markdown_chunks(t),
        "recursive": lambda t, g: recursive_chunks(t, limit),
        "code": lambda t, g: code_chunks(t, g, limit, overlap),
        "bytes": lambda t, g: byte_chunks(t),
    }[method]

    def run(batches):
        for pdf in batches:
            rows = [(k, i, a, b, t[a:b]) for k, t, g in zip(pdf._id, pdf._text, pdf._language, strict=True) for i, (a, b) in enumerate(cut(t, g))]
            yield pd.DataFrame(rows, columns=["_id", "chunk_no", "start_char", "end_char", "text"]).astype({"_id": "Int64"})

    lang = F.col(language_col) if language_col else F.lit(None).cast("string")
    d = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), lang.alias("_language")).where(F.length(F.trim("_text")) > 0)
    return d.mapInPandas(run, "_id long, chunk_no int, start_char int, end_char int, text string").withColumnRenamed("_id", id_col)
