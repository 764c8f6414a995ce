"""Problem 3: files that nobody wrote by hand for their project: generated, minified, vendored, or data kept as source.

Four sources of evidence, strongest first:

* Attribute files of a repository (``.gitattributes``: linguist-generated, linguist-vendored), newest version of each.
  Of the patterns that match a path the one in the deepest directory, and there the last one, decides each attribute.
* The content itself: markers of generators and notices of other works in comments, lock files,
  source maps, minified lines, and files that repeat one line pattern or hold little but digits or encoded bytes.
* Copies without a notice: lines of a file that also stand in a file known to be vendored are foreign; a file half made
  of foreign lines is a copy, patched, excerpted or not. All lines that say something count. Files meet by line hash
  against the distinct foreign hashes and are counted, never paired.
* Path patterns (directory, endings, file name) mined from the verdicts of all repositories, declared or by content:
  patterns that are marked almost always, often enough and in several repositories, hold for the files of all
  repositories that declare nothing. Usual names, given below, are used where nothing else decides.

Every file is listed with the evidence that decided: declared, content, copy, mined or usual.

Defined results: null and blank contents are none; a null path is matched by content only; a null project is one
project; every row is judged, repeated ones under a new id too; files an attribute declares hand-written are none;
empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kbspark.functions.globs import glob_regex
from kbspark.plans.lineage import cut_lineage
from kbspark.plans.skew import join_skewed
from kbspark.plans.spread import spread

#: The share of foreign lines (of at least so many) that makes a copy.
FOREIGN_SHARE, FOREIGN_LEAST = 0.5, 4
#: A mined pattern marks this share of its files, of so many at least, in so many repositories at least.
MINE_SHARE, MINE_LEAST, MINE_PROJECTS = 0.95, 20, 3
#: Mined patterns up to so many are broadcast.
MINE_BROADCAST = 100_000

# Names that mark vendored and generated paths, generator markers, notices, lock files.
VENDOR_DIRS = ["node_modules", "bower_components", "vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "deps", "godeps", "contrib", "jspm_packages", "carthage", "pods", "site-packages"]
GENERATED_PATH = r"(?:\.min\.(?:js|css|mjs)|\.bundle\.(?:js|css)|\.(?:pb|g|gen|generated|designer|freezed)\.\w+|_pb2(?:_grpc)?\.pyi?|_generated\.\w+|\.pb\.(?:go|cc|h)|\.(?:js|css|ts|mjs)\.map|(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|poetry\.lock|cargo\.lock|pnpm-lock\.yaml|composer\.lock|gemfile\.lock|pipfile\.lock|uv\.lock|go\.sum|flake\.lock|mix\.lock|podfile\.lock))$"
_MARKER = re.compile(
    r"(?:^|\s)@generated\b|<auto-?generated|^auto-?generated\b|^(?:code |file |source )?(?:automatically |auto-?)?generated (?:automatically )?(?:by|with|from|using|on)\b"
    r"|^(?:this|the) (?:\w+ ){0,2}(?:file|code|module|source|output|header|document|class|binding)s? (?:was|is|were|are|has been|have been) (?:automatically |auto-?)?(?:generated|produced|created|emitted) (?:automatically )?(?:by|with|from|using)\b"
    r"|^machine[- ](?:made|generated|written) by|^produced by \S+.*(?:regenerate|from)|edit that file instead|regenerate with|changes? (?:will be|are) (?:lost|overwritten)|change is overwritten|(?-i:DO NOT (?:EDIT|MODIFY))"
    r"|\bgerad[oa] (?:automaticamente )?por\b.*n[ãa]o edite|wurde von \S+ (?:erzeugt|generiert)|automatisch (?:erzeugt|generiert)|generad[oa] (?:autom[áa]ticamente )?por\b.*no (?:lo )?edit|g[ée]n[ée]r[ée]e? (?:automatiquement )?par\b.*ne pas",
    re.I,
)
_NOTICE = re.compile(
    r"part of (?:the )?(?P<a>[\w.-]+)(?: library| project| package)?(?:, version [\d.]+|; redistribution)|(?:imported|vendored|copied|taken|adapted|ported|derived|borrowed) (?:verbatim )?from (?:the )?(?P<b>[\w.-]+)(?=.*(?:\d+\.\d+|upstream|commit|https?:))|^(?P<c>[\w.-]+) v?\d+\.\d+(?:\.\d+)? - https?://\S*licen[cs]e|@license (?P<d>[\w.-]+)|(?<![\w.-])(?P<e>[\w.-]+) v\d+\.\d+\.\d+ \| \(?c\)? ",
    re.I,
)
_COMMENT = re.compile(r"""(?:\ufeff)?\s*(?:#(?!define\b|include\b|!\[)|//+!?|/\*+!?|\*+|--|<!--|;+|%|"{3}|'{3})""")
_BLOB = re.compile(rb"""\W{0,4}[A-Za-z0-9+/=]{40,}\W{0,5}""")
_CODE = re.compile(r"\.(?:rs|py|pyi|tsx?|jsx?|mjs|go|c|h|cc|cpp|hpp|java|kt|cs|rb|php|swift|scala|sql|css|scss|lua|m|dart|pl|r)(?:\.\w{2,4})?$", re.I)
_TEXT = re.compile(r"\.(?:md|txt|rst|adoc|ya?ml|toml|ini|cfg|conf|env|sh|bash|properties)(?:\.\w{2,4})?$|(?:^|/)\.env", re.I)
ATTRIBUTE_FILE = r"(?:^|/)\.gitattributes$"
_DIGIT = bytes(48 if 48 <= i <= 57 else i for i in range(256))
_SHAPE = bytes(48 if 48 <= i <= 57 else 97 if 65 <= i <= 90 or 97 <= i <= 122 or i >= 128 else i for i in range(256))
_BOILERPLATE = re.compile(r"SPDX-|copyright|licen[cs]e", re.I)
_LOCK = re.compile(r'^[ \t]*(?:"lockfileVersion"|# yarn lockfile|lockfileVersion:)|^# This file is (?:automatically )?@generated by (?:Poetry|Cargo)|^content-hash = "', re.M)


def clean_path(path: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), r"\\", "/"), "/+", "/")
    return F.regexp_replace(p, r"^(\./)+", "")


# -- attribute files ----------------------------------------------------------------------------------------------------


def parse_attributes(text: str) -> list[tuple[int, str, str, bool]]:
    """``(line, regex, attribute, set)`` of the generated and vendored attributes of an attribute file."""
    rows = []
    for n, line in enumerate((text or "").splitlines()):
        parts = line.strip().split()
        if len(parts) < 2 or parts[0].startswith(("#", "[attr]")):
            continue
        for a in parts[1:]:
            m = re.fullmatch(r"([-!]?)linguist-(generated|vendored)(?:=(\w+))?", a)
            if m:
                rows.append((n, glob_regex(parts[0].strip('"')), m[2], not m[1] and (m[3] or "true").lower() not in ("false", "0", "no")))
    return rows


def _attribute_rows(batches):
    for pdf in batches:
        rows = [(p, d, *r) for p, d, t in zip(pdf.project, pdf.dir, pdf.content, strict=True) for r in parse_attributes(t)]
        yield pd.DataFrame(rows, columns=["project", "dir", "line", "regex", "attribute", "on"])


def declared(files: DataFrame) -> DataFrame:
    """``(file_id, attribute, on)`` for every file that an attribute file of its project decides.

    Files meet only the patterns of their own ancestor directories (an equal join on project and directory).
    """
    is_attr = F.lower("path").rlike(ATTRIBUTE_FILE)
    newest = W.partitionBy("project", "path").orderBy(F.col("received_at").desc_nulls_last(), F.col("file_id").desc())
    attrs = files.where(is_attr).withColumn("rk", F.row_number().over(newest)).where("rk = 1 and deleted_at is null")
    attrs = attrs.select("project", F.regexp_replace("path", r"[^/]*$", "").alias("dir"), "content")
    rules = attrs.mapInPandas(_attribute_rows, "project string, dir string, line int, regex string, attribute string, on boolean")
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    below = files.where("path is not null").select("file_id", "project", "path", F.explode(dirs).alias("dir"))
    b, r = below.alias("b"), rules.alias("r")
    rest = F.expr("substring(b.path, length(b.dir) + 1)")
    hits = b.join(r, F.col("b.project").eqNullSafe(F.col("r.project")) & (F.col("b.dir") == F.col("r.dir"))).where(F.regexp_like(rest, F.col("r.regex")))
    return hits.groupBy("b.file_id", "r.attribute").agg(F.max_by("r.on", F.struct(F.length("b.dir"), F.col("r.line"))).alias("on"))


def path_patterns(path: Column) -> Column:
    """The patterns that a path follows: its directories, its file name, its last two endings, and its last one unless that is a language's."""
    p = F.lower(path)
    parts = F.split(p, "/")
    name = F.element_at(parts, -1)
    dirs = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda d: F.concat(F.lit("dir:"), d))
    endings = F.filter(F.array(F.regexp_extract(name, r"[^.](\.[^.]+\.[^.]+)$", 1), F.when(name.rlike(_CODE.pattern) | name.rlike(_TEXT.pattern), F.lit("")).otherwise(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))), lambda e: e != "")
    return F.array_distinct(F.concat(dirs, F.array(F.concat(F.lit("name:"), name)), F.transform(endings, lambda e: F.concat(F.lit("ends:"), e))))


def mined_patterns(judged: DataFrame) -> DataFrame:
    """``(pattern)`` marked almost always, of ``(project, path, marked, declared)`` of all files.

    Either the files of the repositories that declare something are enough by themselves (``declared``; there a file
    without a mark is known to be hand-written), or all files of several repositories. Counts are combined per pattern
    and repository first, so that an ending most files have is no hot key.
    """
    one = judged.where("path is not null").select("project", F.col("marked").cast("long").alias("m"), F.col("declared").cast("long").alias("d"), F.explode_outer(path_patterns(F.col("path"))).alias("pattern"))
    each = one.groupBy("pattern", "project").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("n"), F.sum(F.col("m") * F.col("d")).alias("md"), F.sum("d").alias("nd"))
    total = each.groupBy("pattern").agg(*[F.sum(c).alias(c) for c in ("m", "n", "md", "nd")], F.sum((F.col("m") > 0).cast("int")).alias("projects"))

    def almost(m: str, n: str) -> Column:
        return (F.col(n) >= MINE_LEAST) & (F.col(m) >= MINE_SHARE * F.col(n))

    return total.where(almost("md", "nd") | almost("m", "n") & (F.col("projects") >= MINE_PROJECTS)).select("pattern")


# -- content ------------------------------------------------------------------------------------------------------------


_BLOCKS = {"/*": "*/", "<!--": "-->", '"' * 3: '"' * 3, "'" * 3: "'" * 3}
_BLOCK = re.compile(r"""(?:\ufeff)?\s*(/\*|<!--|"{3}|'{3})""")


#: A notice stands for the whole file only before or after its code: up to so many lines of code before or after it.
TOP, BOTTOM = 14, 4


def _comment_texts(lines: list[str]) -> list[tuple[str, bool]]:
    """The texts of all comment lines, those inside of block comments too, and whether each stands at the top or the bottom.

    Quotes open a comment only before the first code.
    """
    out, end, code = [], None, 0
    for line in lines:
        if end:
            m = _COMMENT.match(line)
            t = line[m.end() if m else 0 :].strip()
            if end in line:
                end = None
        else:
            m = _COMMENT.match(line)
            if not m:
                code += 1
                continue
            t = line[m.end() :].strip()
            b = _BLOCK.match(line)
            if b and (not code or b[1] in ("/*", "<!--")):
                end = _BLOCKS[b[1]]
                if line.find(end, b.end()) >= 0:
                    end = None
        for close in ("*/", "-->", '"' * 3, "'" * 3):
            t = t.removesuffix(close).rstrip()
        out.append((t, code))
    return [(t, n < TOP or code - n < BOTTOM) for t, n in out]


def _squeezed(b: bytes) -> bytes:
    while b"00" in b:
        b = b.replace(b"00", b"0")
    return b


def _same_shape(b: bytes, n: int) -> bool:
    """Whether almost all lines have one of two shapes (words and numbers reduced to one sign each), as written by a loop."""
    b = _squeezed(b.translate(_SHAPE))
    while b"aa" in b:
        b = b.replace(b"aa", b"a")
    b = b.replace(b"a_a", b"a").replace(b"a_a", b"a")
    tops = Counter(x for x in (y.strip() for y in b.split(b"\n")) if len(x) >= 12)
    return n >= 16 and sum(v for _, v in tops.most_common(2)) >= 0.85 * n


def content_class(text: str, path: str | None, project: str | None) -> str | None:
    """What the content shows: generated, third_party, lock, map, minified, data, or None."""
    head = text[:400].lstrip("﻿ \r\n\t")
    if head.startswith("{") and '"mappings"' in text and re.match(r'\{\s*"version"\s*:\s*3\b', head):
        return "map"
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(lines)
    for t, outer in _comment_texts(lines):
        if _MARKER.search(t):
            return "generated"
        m = _NOTICE.search(t) if outer else None
        if m and m[m.lastgroup].lower().strip(".") not in (project or "").lower().split("/"):
            return "third_party"
    code = bool(path and _CODE.search(path))
    if _LOCK.search(text[:2000] if code else text) or text.count("\n[[package]]") >= 3:  # the text of a lock file may stand in code
        return "lock"
    b = text.encode().translate(_DIGIT)
    size, digits, white = len(b), b.count(b"0"), b.count(b" ") + b.count(b"\n") + b.count(b"\t") + b.count(b"\r")
    prose = bool(path and _TEXT.search(path))
    if not prose and size >= 500 and white < 0.07 * size and (size / n > 180 or max(map(len, lines)) > 2000):
        return "minified"
    if prose or size < 300:
        return None
    stripped = [x.strip() for x in b.split(b"\n") if x.strip()]
    blob = sum(1 for x in stripped if len(x) >= 40 and b" " not in x and _BLOB.fullmatch(x))
    if code and n >= 5 and blob >= 0.6 * n and "-----BEGIN" not in text:
        return "data"
    if code and digits >= 0.27 * (size - white) and n >= 8:
        return "data"
    if code and n >= 12:
        tops = Counter(x[:14] for x in (y.strip() for y in _squeezed(b).split(b"\n")) if len(x) >= 10)
        total, best = sum(tops.values()), tops.most_common(1)[0][1] if tops else 0
        if total >= 10 and best >= 0.6 * n or _same_shape(b, n):
            return "data" if path and path.lower().endswith(".sql") else "generated"
    return None


def line_hashes(text: str) -> list[int]:
    """The distinct hashes of the lines that say something."""
    lines = {x.strip() for x in text.split("\n")}
    return [xxhash.xxh64_intdigest(x) >> 1 for x in lines if len(x) >= 32 and not _BOILERPLATE.search(x)]


def _features(batches):
    for pdf in batches:
        rows = [(i, p, q, content_class(t, q, p), line_hashes(t)) for i, p, q, t in zip(pdf.file_id, pdf.project, pdf.path, pdf.content, strict=True)]
        yield pd.DataFrame(rows, columns=["file_id", "project", "path", "kind", "lines"]).astype({"file_id": "Int64"})


def find_unwritten(files: DataFrame) -> DataFrame:
    """``(file_id, kind, evidence)`` of every file not written by hand for its project."""
    f = files.select(F.col("file_id").cast("long"), F.col("project"), clean_path(F.col("rel_path")).alias("path"), "content", F.col("received_at"), F.col("deleted_at"))
    known = cut_lineage(spread(f.where(F.trim(F.regexp_replace("content", r"\s", " ")) != "")).mapInPandas(_features, "file_id long, project string, path string, kind string, lines array<long>"))
    if known.where(F.lower("path").rlike(ATTRIBUTE_FILE)).isEmpty():
        known = known.withColumns({"on": F.lit(None).cast("boolean"), "declared": F.lit(False)})
    else:
        verdicts = declared(f).groupBy("file_id").agg(F.max("on").alias("on"))
        repos = f.where(F.lower("path").rlike(ATTRIBUTE_FILE)).select(F.col("project").alias("_p")).distinct().withColumn("declared", F.lit(True))
        known = known.join(verdicts, "file_id", "left").join(repos, F.col("project").eqNullSafe(F.col("_p")), "left").drop("_p")
        known = cut_lineage(known.withColumn("declared", F.coalesce("declared", F.lit(False))))
    folders = F.slice(F.split(F.lower("path"), "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    vendored = F.coalesce(F.arrays_overlap(folders, F.array(*[F.lit(d) for d in VENDOR_DIRS])), F.lit(False))
    usual = F.when(vendored, F.lit("third_party")).when(F.lower("path").rlike(GENERATED_PATH), F.lit("generated"))
    # lines of files known to be vendored; sure are those whose content says so
    sure = F.col("kind").eqNullSafe("third_party")
    foreign = known.where(sure | vendored).select(sure.alias("sure"), F.explode("lines").alias("h")).groupBy("h").agg(F.max("sure").alias("sure"))
    asked = known.where("kind is null and on is null").select("file_id", F.size("lines").alias("n_lines"), "lines")
    counted = asked.select("file_id", "n_lines", F.explode("lines").alias("h")).join(foreign, "h").groupBy("file_id").agg(F.first("n_lines").alias("n_lines"), F.count(F.lit(1)).alias("n"), F.sum(F.col("sure").cast("long")).alias("n_sure"))
    enough = lambda n: (F.col(n) >= FOREIGN_LEAST) & (F.col(n) >= FOREIGN_SHARE * F.col("n_lines"))
    copies = counted.where(enough("n")).select("file_id", enough("n_sure").alias("copy_sure"))
    judged = known.select("file_id", "project", "path", "kind", "on", "declared", usual.alias("usual")).join(copies, "file_id", "left")
    judged = cut_lineage(judged)
    marked = F.coalesce(F.col("on"), F.col("kind").isNotNull() | F.coalesce("copy_sure", F.lit(False)))
    patterns = mined_patterns(judged.select("project", "path", "declared", marked.alias("marked")))
    open_ = judged.where("kind is null and on is null and not coalesce(copy_sure, false)").select("file_id", F.explode_outer(path_patterns(F.col("path"))).alias("pattern"))
    if patterns.limit(MINE_BROADCAST + 1).count() <= MINE_BROADCAST:
        mined = open_.join(F.broadcast(patterns), "pattern", "left_semi")
    else:
        mined = join_skewed(open_, patterns, ["pattern"])
    judged = judged.join(mined.select("file_id").distinct().withColumn("mined", F.lit(True)), "file_id", "left")
    name = F.coalesce("usual", F.lit("generated"))
    copied = F.col("copy_sure") | (F.col("copy_sure").isNotNull() & F.col("usual").isNull())
    evidence = F.when(F.col("on"), "declared").when(F.col("on") == F.lit(False), None).when(F.col("kind").isNotNull(), "content").when(copied, "copy").when(F.col("mined"), "mined").when(F.col("usual").isNotNull(), "usual")
    kind = F.when(F.col("on"), F.coalesce("kind", "usual", F.lit("declared"))).when(copied & F.col("kind").isNull(), F.coalesce("usual", F.lit("copy"))).otherwise(F.coalesce("kind", name))
    return judged.withColumn("evidence", evidence).where("evidence is not null").select("file_id", kind.alias("kind"), "evidence")
