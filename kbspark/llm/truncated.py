"""Problem 9: texts that lost their end at a length limit or in transfer, and the share of such texts per source.

* Hidden limits: the length of every text is computed as characters, UTF-8 bytes, UTF-16 units, with entities escaped,
  with JSON escapes (of non-ASCII characters or not) and with CRLF line ends. Of the counts per source, measure and
  length a limit is a length at which many more texts end than at the lengths around it, most of them with a cut ending. Texts of that length are cut; with measures in which one character takes several units, also those a few units
  short.
* Endings: a text that ends without a proper end is judged by its last line. An open code fence or bracket, a row of a
  table without its last cells, a heading without text and running text without a full stop are cut. In lists, logs and
  other lines the last words decide: how often the same two words (or the last one) end a line or sentence elsewhere in
  texts of that source, and whether the last word is a word at all. Lines with which several texts of a
  source close (a sign-off, a reference, a status) are whole; which ones these are is counted over all its texts.

Lengths, closing lines and words are counted over all rows before any shuffle of texts: only counts are shuffled.

Defined results: null, empty and blank texts are whole; a null source is a source of its own; repeated texts count each;
empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kbspark.plans.lineage import cut_lineage
from kbspark.plans.spread import spread

#: A limit: at least so many texts, so many times the mean count of the lengths within NEAR, this share with open ends.
LIMIT_LEAST, LIMIT_TIMES, LIMIT_OPEN, LIMIT_OF_SOURCE, NEAR = 6, 8.0, 0.5, 0.005, 60
#: Closing lines: at least so many texts end with one, and this share of the lines with its beginning are last lines.
CLOSING_LEAST, CLOSING_LEAST_ALL, CLOSING_SHARE = 3, 5, 0.8
#: Share of occurrences of the last words that end a line or sentence, from which an end there is a proper one.
STOP_SHARE, PAIR_LEAST = 0.15, 4

# Marks that cutting systems append; signs that end a sentence.
_MARK = re.compile(r"\s*(?:…|\.{3,}|\[(?:…|\.{3}|truncated|cut|more|snip|continued)\]|\((?:…|\.{3}|truncated|cut|more|continued)\)|<(?:truncated|more|cut)>|--more--|\[\+\d+ chars?\])\s*$", re.I)
_STOP = re.compile(r"[.?!。！？]+[\"'”’»)\]`*_]*$")
_WORD = re.compile(r"\w+(?:['’]\w+)?")
_LIST = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s")
_LOG = re.compile(r"^\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
_KEY = re.compile(r"^\s*[\w.-]{1,30}\s*[:=]\s*\S{0,40}$")
_NEXT = re.compile(r"[`'\"”’»)\]*_]*(?:$|[.?!;|。！？\r])")
_START = re.compile(r"\s*(\w+|[^\w\s]+)\s*(\w+|[^\w\s]+)?")
_FENCE = re.compile(r"^\s*(?:```|~~~)", re.M)
_CODE_LINE = re.compile(r"^\s*(?:def|class|import|from \w+ import|return|fn|pub|use \w+::|let|const|func|package|export|static|for \w+ in|if .*[:{]$|\})", re.M)
_OPEN, _CLOSE = "([{", ")]}"
_STRINGS = re.compile(r"\"{3}(?:.*?\"{3}|.*\Z)|'{3}(?:.*?'{3}|.*\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|//[^\n]*|#(?!\[)[^\n]*|/\*(?:.*?\*/|.*\Z)|--[^\n]*", re.S)
MEASURES = ["chars", "bytes", "utf16", "entities", "json", "json_ascii", "crlf"]
_WIDE = {"bytes": 3, "utf16": 1, "entities": 5, "json": 1, "json_ascii": 11, "crlf": 1}


def lengths(t: str) -> list[int]:
    """The length of a text in every measure."""
    n, lines = len(t), t.count("\n") - t.count("\r\n")
    extra = t.count('"') + t.count("\\")
    control = sum(t.count(c) for c in "\n\r\t\b\f")
    low = 0 if t.isprintable() else sum(1 for c in t if c < " " and c not in "\n\r\t\b\f")
    json_n = n + extra + control + 5 * low
    if t.isascii():
        b, wide, esc = n, n, json_n
    else:
        b, wide = len(t.encode()), len(t.encode("utf-16-le")) // 2
        esc = json_n + sum(11 if c > "￿" else 5 for c in t if c > "\x7f")
    ent = n + 4 * t.count("&") + 3 * (t.count("<") + t.count(">")) + 5 * t.count('"') + 5 * t.count("'")
    return [n, b, wide, ent, json_n, esc, n + lines]


def _norm(w: str) -> str:
    if "_" in w:
        return "<id>"
    return "<n>" if w.isdigit() else w.lower()


#: Characters that a closing line has at most; nor is the only line of a text one.
CLOSING_CHARS = 80
#: Characters at the end of a text in which a mark of the cutting system is looked for.
MARK_CHARS = 80


def line_start(line: str) -> str:
    """How a line begins: its first two words or signs, names reduced."""
    m = _START.match(line)
    if not m:
        return ""
    a, b = m[1], m[2]
    if a in ("--", "—", "–", "~") or b is None:
        return _norm(a)
    return f"{_norm(a)} {_norm(b)}"


def _listed(line: str) -> bool:
    return bool(_LIST.match(line) or _LOG.match(line))


def ending(text: str, code: bool) -> tuple[str, str, str, str]:
    """``(state, start of the last line, word before the last, last word)``: state is cut, open, ask, word, or closed.

    cut: within a block, row or bracket; open: cut unless the line is a closing one; ask: the last words decide; word: the last word must be a known one;
    closed: an end sign, cut only at a limit.
    """
    tail = text.rstrip()
    m = _MARK.search(tail[-MARK_CHARS:])
    if m:
        tail = tail[: max(len(tail) - MARK_CHARS, 0) + m.start()].rstrip()
    if not tail:
        return "closed", "", "", ""
    line = tail[tail.rfind("\n") + 1 :]
    start = line_start(line) if "\n" in tail and len(line) <= CLOSING_CHARS else ""
    words = _WORD.findall(line)[-2:]
    last = _norm(words[-1]) if words else ""
    before = _norm(words[-2]) if len(words) > 1 else "^"
    if m:
        return "open", start, before, last
    fences = len(_FENCE.findall(tail)) if "```" in tail or "~~~" in tail else 0
    if fences % 2:
        return "cut", start, before, last
    s = line.strip()
    if s.startswith(("```", "~~~")):
        return "closed", start, before, last
    if s.startswith("|"):
        rows = tail[: tail.rfind("\n") + 1].rstrip("\n").rsplit("\n", 1)[-1].strip() if "\n" in tail else ""
        whole = s.endswith("|") and len(s) > 1 and (not rows.startswith("|") or rows.count("|") == s.count("|"))
        return ("closed" if whole else "cut"), start, before, last
    if code:
        bare = _STRINGS.sub("", tail)
        if any(bare.count(a) > bare.count(b) for a, b in zip(_OPEN, _CLOSE, strict=True)):
            return "cut", start, before, last
        return ("word" if s[-1].isalnum() or s[-1] == "_" else "closed"), start, before, last
    if re.match(r"#{1,6}\s", s):
        return "cut", start, before, last
    if _STOP.search(s):
        if s[-1] == "." and len(s) > 1 and s[-2].isdigit() and not _LIST.match(line):
            return "ask", start, before, last
        return "closed", start, before, last
    if s.count("(") > s.count(")") or s.count("`") % 2:
        return "cut", start, before, last
    key, listed = bool(_KEY.match(line)), _listed(line)
    if s[-1] in ")]}>" and (key or listed or s[0] in "([{<"):
        return "closed", start, before, last
    return ("word" if key else "ask" if listed else "open"), start, before, last


def _looks_like_code(kind, text: str) -> bool:
    if kind is not None:
        return kind == "code"
    return len(_CODE_LINE.findall(text)) >= 3 and "```" not in text


_SEEN = "_id long, _source string, what string, w1 string, w2 string, stop boolean, n long, sizes array<long>, hash long, state string, start string"


def _read(batches):
    """Of every text its ending and lengths (what = text), and partial counts: of words, of word pairs in listed lines (all,
    ending the line or a sentence), of line beginnings (all, of last lines)."""
    columns = [c.split()[0] for c in _SEEN.split(", ")]
    for pdf in batches:
        out = []
        for key, source, kind, text in zip(pdf._id, pdf._source, pdf._kind, pdf._text, strict=True):
            state, start, before, last = ending(text, _looks_like_code(kind, text))
            out.append((key, source, "text", before, last, None, 1, lengths(text), xxhash.xxh64_intdigest(text) >> 1, state, start))
        pairs: Counter = Counter()
        words: dict = {}
        for source, text in zip(pdf._source, pdf._text, strict=True):
            whole = text.rstrip()
            end = len(whole)
            found = _WORD.findall(whole)
            words.setdefault(source, Counter()).update(found)
            if found:
                words[source][found[-1]] -= 1  # the word in question is no evidence for itself
            at = 0
            for line in whole.split("\n"):
                stop_at = at + len(line)
                first, at = at == 0, stop_at + 1
                last = stop_at >= end
                if first and last:
                    continue
                pairs[source, "line", line_start(line), "", last and not first and len(line) <= CLOSING_CHARS] += 1
                if not _listed(line):
                    continue
                prev = "^"
                ms = list(_WORD.finditer(line))
                for i, m in enumerate(ms):
                    w = _norm(m[0])
                    if i + 1 < len(ms):
                        gap = line[m.end() : ms[i + 1].start()]
                        stop = gap != " " and bool(_NEXT.match(gap.rstrip(" ") + ("\0" if not gap.strip() else "")))
                    elif last:
                        break
                    else:
                        stop = True
                    pairs[source, "listed", prev, w, stop] += 1
                    prev = w
        rest = (None,) * 4
        out += [(None, source, what, w1, w2, stop, n, *rest) for (source, what, w1, w2, stop), n in pairs.items()]
        for source, c in words.items():
            known: Counter = Counter()
            for w, n in c.items():
                known[_norm(w)] += n
            out += [(None, source, "word", "", w, False, n, *rest) for w, n in known.items() if n]
        yield pd.DataFrame(out, columns=columns).astype({"_id": "Int64", "hash": "Int64", "stop": "boolean"})


def find_limits(feats: DataFrame) -> DataFrame:
    """``(_source, measure, size, n)`` of the hidden limits; of several measures that show the same texts the clearest stays."""
    texts = feats.select("_source", "cut", "sizes", "hash").distinct()  # copies of one text are no peak
    total = texts.groupBy("_source").agg(F.count(F.lit(1)).alias("total"))
    sizes = texts.select("_source", "cut", "hash", F.posexplode("sizes").alias("measure", "size"))
    hist = sizes.groupBy("_source", "measure", "size").agg(F.count(F.lit(1)).alias("n"), F.count_if("cut").alias("open"))
    near = W.partitionBy("_source", "measure").orderBy("size").rangeBetween(-NEAR, NEAR)
    peaks = hist.withColumn("around", (F.sum("n").over(near) - F.col("n")) / (2 * NEAR)).where((F.col("n") >= LIMIT_LEAST) & (F.col("n") >= LIMIT_TIMES * (F.col("around") + 0.25)) & (F.col("open") >= LIMIT_OPEN * F.col("n")))
    p, t = peaks.alias("p"), total.alias("t")
    peaks = p.join(t, F.col("p._source").eqNullSafe(F.col("t._source"))).where(F.col("p.n") >= LIMIT_OF_SOURCE * F.col("t.total")).select("p.*")
    peaks = cut_lineage(peaks.select("_source", "measure", "size", "n"))
    s, p = sizes.select("_source", "hash", "measure", "size").alias("s"), peaks.alias("p")
    same = F.col("s._source").eqNullSafe(F.col("p._source")) & (F.col("s.measure") == F.col("p.measure")) & (F.col("s.size") == F.col("p.size"))
    # a text stands in one peak per measure at most, so only few pairs of peaks come from each
    at = s.join(p, same).groupBy("s._source", "s.hash").agg(F.array_distinct(F.collect_list(F.struct("p.n", "p.measure", "p.size"))).alias("at"))
    pairs = at.select("_source", "at", F.explode("at").alias("a")).select("_source", "a", F.explode("at").alias("b")).groupBy("_source", "a", "b").agg(F.count(F.lit(1)).alias("both"))
    pairs = pairs.select("_source", F.col("a.n").alias("n"), F.col("a.measure").alias("measure"), F.col("a.size").alias("size"), F.col("b.measure").alias("measure_b"), F.col("b.size").alias("size_b"), "both")
    return pairs.groupBy("_source").applyInPandas(_own_limits, "_source string, measure int, size long, n long")


def _own_limits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the peaks of a source, the clearest first, those that do not share most of their texts with a clearer one."""
    both = {(m, s, mb, sb): n for m, s, mb, sb, n in zip(pdf.measure, pdf["size"], pdf.measure_b, pdf.size_b, pdf.both, strict=True)}
    peaks = pdf[["_source", "measure", "size", "n"]].drop_duplicates(["measure", "size"]).sort_values(["n", "measure", "size"], ascending=[False, True, True])
    kept: list = []
    for m, s, n in zip(peaks.measure, peaks["size"], peaks.n, strict=True):
        if all(2 * both.get((m, s, *k), 0) < n for k in kept):
            kept.append((m, s))
    return peaks[[k in set(kept) for k in zip(peaks.measure, peaks["size"], strict=True)]]


def find_truncated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", kind_col: str = "doc_kind") -> DataFrame:
    """``(doc_id, source, reason)`` of the texts that were cut: at a limit, or by their ending."""
    d = documents.select(F.col(id_col).cast("long").alias("_id"), F.col(source_col).alias("_source"), F.col(kind_col).alias("_kind"), F.col(text_col).alias("_text"))
    d = spread(d.where(F.length(F.trim(F.regexp_replace("_text", r"\s+", " "))) > 0))
    read = cut_lineage(d.mapInPandas(_read, _SEEN))
    feats = read.where("what = 'text'").drop("what", "stop", "n")
    seen = read.where("what <> 'text'")
    seen = cut_lineage(seen.groupBy("_source", "what", "w1", "w2").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("stops")))
    lines = seen.where("what = 'line' and w1 <> ''").groupBy(F.coalesce("_source", F.lit("")).alias("_from"), F.col("w1").alias("start")).agg(F.sum("n").alias("ln"), F.sum("stops").alias("ls"))
    often = F.col("ls") >= CLOSING_SHARE * F.col("ln")
    closing = lines.where(often & (F.col("ls") >= CLOSING_LEAST)).select("_from", "start", F.lit(True).alias("closing"))
    anywhere = lines.groupBy("start").agg(F.sum("ln").alias("ln"), F.sum("ls").alias("ls")).where(often & (F.col("ls") >= CLOSING_LEAST_ALL)).select("start", F.lit(True).alias("anywhere"))
    pairs = seen.where("what in ('listed', 'word')").select("_source", "what", "w1", "w2", F.col("n").alias("pn"), F.col("stops").alias("ps"))
    single = pairs.groupBy("_source", "what", "w2").agg(F.sum("pn").alias("un"), F.sum("ps").alias("us"))
    place = F.when(F.col("state") == "ask", "listed").otherwise("word")
    ends = feats.withColumn("place", place)
    # most texts have no closing line of their own; their key is spread out, or it would be a hot one that meets nothing
    alone = F.concat(F.lit("\0"), F.pmod(F.coalesce("hash", F.lit(0)), F.lit(1024)).cast("string"))
    ends = ends.withColumns({"_from": F.coalesce("_source", F.lit("")), "start": F.when(F.col("start") == "", alone).otherwise(F.col("start"))})
    ends = ends.join(closing, ["_from", "start"], "left").join(anywhere, "start", "left").drop("_from")
    p = pairs.alias("p")
    same = F.col("e._source").eqNullSafe(F.col("p._source")) & (F.col("e.place") == F.col("p.what")) & (F.col("e.w1") == F.col("p.w1")) & (F.col("e.w2") == F.col("p.w2"))
    ends = ends.alias("e").join(p, same, "left").select("e.*", "p.pn", "p.ps")
    u = single.alias("u")
    same = F.col("e._source").eqNullSafe(F.col("u._source")) & (F.col("e.place") == F.col("u.what")) & (F.col("e.w2") == F.col("u.w2"))
    ends = ends.alias("e").join(u, same, "left").select("e.*", "u.un", "u.us")
    known = F.coalesce("pn", F.lit(0)) >= PAIR_LEAST
    proper = F.when(F.col("state") == "word", F.coalesce("un", F.lit(0)) >= 2).when(known, F.col("ps") >= STOP_SHARE * F.col("pn")).otherwise(F.coalesce(F.col("us") >= STOP_SHARE * F.col("un"), F.lit(False)))
    closed = F.coalesce("closing", "anywhere", F.lit(False))
    reason = F.when(F.col("state") == "cut", "block").when(closed | (F.col("state") == "closed"), None).when(F.col("state") == "open", "open").when(~proper, "words")
    ends = cut_lineage(ends.select("_id", "_source", "sizes", "hash", reason.alias("reason")).withColumn("cut", F.col("reason").isNotNull()))
    out = _with_limits(ends, find_limits(ends)).withColumn("reason", F.when(F.col("at_limit"), "limit").otherwise(F.col("reason")))
    return out.where("reason is not null").select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "reason")


def _with_limits(feats: DataFrame, limits: DataFrame) -> DataFrame:
    of = limits.groupBy("_source").agg(F.collect_list(F.struct("measure", "size")).alias("limits"))
    f, m = feats.alias("f"), of.alias("m")
    joined = f.join(m, F.col("f._source").eqNullSafe(F.col("m._source")), "left")
    wide = F.array(*[F.lit(_WIDE.get(x, 0)) for x in MEASURES])

    def met(limit):
        size = F.element_at("f.sizes", limit["measure"] + 1)
        several = size > F.element_at("f.sizes", 1)  # some character takes more than one unit
        short = several & (size < limit["size"]) & (size >= limit["size"] - F.element_at(wide, limit["measure"] + 1)) & F.col("f.cut")
        return (size == limit["size"]) | short

    return joined.select("f.*", F.coalesce(F.exists("m.limits", met), F.lit(False)).alias("at_limit"))


def truncation_rates(documents: DataFrame, found: DataFrame, source_col: str = "source") -> DataFrame:
    """``(source, texts, truncated, share)``; null and blank texts count as texts."""
    n = documents.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("texts"))
    t = found.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("truncated"))
    a, b = n.alias("a"), t.alias("b")
    out = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", "a.texts", F.coalesce("b.truncated", F.lit(0)).cast("long").alias("truncated"))
    return out.withColumn("share", F.round(F.col("truncated") / F.col("texts"), 6))
