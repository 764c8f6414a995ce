"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and the letters they fold to.
FOLD_FROM = "áàâãäåāçćčďéèêëēęěíìîïīñńňóòôõöōøřśšťúùûüūůýÿźżžÁÀÂÃÄÅÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜÝ"
FOLD_TO = "aaaaaaacccdeeeeeeeiiiiinnnooooooorsstuuuuuuyyzzzaaaaaaceeeeiiiinooooouuuuy"
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "go": "go", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "rb": "ruby", "php": "php", "md": "markdown", "markdown": "markdown",
}


#: Two further maps of endings: the one that chooses a chunker, and the one of editors' names.
CHUNK_LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "c", "h": "c", "rb": "ruby", "php": "php", "md": "markdown", "markdown": "markdown", "txt": "text", "log": "text"}
EDITOR_LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescriptreact", "jsx": "javascriptreact", "go": "go", "java": "java", "c": "c", "h": "c", "hpp": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "rb": "ruby", "sh": "shell", "bash": "shell", "sql": "sql", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "css": "css"}


def sanitize(text: Column) -> Column:
    """Every character that is no letter, digit or white space becomes a space."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " ")


def fold(text: Column) -> Column:
    """Lower case without marks on Latin letters."""
    low = F.lower(text)
    return F.when(F.length(text) == F.octet_length(text), low).otherwise(F.translate(low, FOLD_FROM, FOLD_TO))  # ASCII has no marks


def tokens(text: Column) -> Column:
    """Words of a text: runs of letters and digits, folded. Null and blank texts have none."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), 0), F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    """How many words ``tokens`` gives, without making them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+")), F.lit(0))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def question_hash(text: Column) -> Column:
    """Hash of a question, the same for any case and white space."""
    return F.sha2(F.lower(F.regexp_replace(text, r"\s+", "")), 256)


def theme_of(path: Column) -> Column:
    """First segment of a path, or (root)."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise(F.when(path.isNotNull(), F.lit("(root)")))


def job_key(level: Column, project: Column, subject: Column) -> Column:
    return F.concat(F.lit("L"), level.cast("string"), F.lit(":"), project, F.lit(":"), subject)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension, null without one; a name that only begins with a dot has none."""
    return F.lower(F.nullif(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1), F.lit("")))


def file_stem(path: Column) -> Column:
    """File name without its last extension; a name that only begins with a dot is its own stem."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def language_by(path: Column, table: dict[str, str]) -> Column:
    """The language of a path's ending by a map, null for one that is not in it."""
    out, ext = F.lit(None).cast("string"), extension(path)
    for k, v in table.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def infer_language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def classify(path: Column) -> Column:
    """markdown, code or text, by the language of the path."""
    lang = infer_language(path)
    return F.when(lang == "markdown", "markdown").when(lang.isNotNull(), "code").otherwise("text")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != ""))


def tokens_by_words(text: Column) -> Column:
    """Words times 1.3, rounded up."""
    return F.ceil(word_count(text) * 1.3).cast("long")


def tokens_by_bytes_floor(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def tokens_by_bytes_ceil(text: Column) -> Column:
    """Bytes over four, rounded up, one at least."""
    return F.greatest(F.ceil(F.octet_length(text) / 4), F.lit(1)).cast("long")


def tokens_by_chars(text: Column) -> Column:
    """Characters plus ASCII punctuation, over four, rounded up, one at least."""
    marks = F.length(text) - F.length(F.regexp_replace(text, r"[!-/:-@\[-`{-~]", ""))
    return F.greatest(F.ceil((F.length(text) + marks) / 4), F.lit(1)).cast("long")


def truncate_to_tokens(text: Column, limit: int) -> Column:
    """The first words that fit ``limit`` tokens at 1.3 a word, joined by single spaces."""
    words = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != "")
    return F.array_join(F.slice(words, 1, int(limit / 1.3)), " ")


def preview(text: Column, chars: int = 200) -> Column:
    return F.substring(text, 1, chars)


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits, other runs as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def identifier(text: Column) -> Column:
    """ASCII letters, digits, hyphens and underscores only, at most 64; others as underscore."""
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9_\-]", "_"), 1, 64)


def claim_text(markdown: Column) -> Column:
    """The connections section of a map, else its map section, else the whole text."""
    body = F.trim(F.regexp_replace(markdown, r"^\s+|\s+$", ""))
    parts = [F.regexp_replace(F.regexp_extract(body, rf"(?s)## {s}(.*?)(?:\n## |\z)", 1), r"^\s+|\s+$", "") for s in ("Conexões", "Mapa")]
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], body)


def strip_thoughts(text: Column) -> Column:
    """Text without think blocks; an open one reaches to the end. A gap between two words becomes one space."""
    cut = F.regexp_replace(text, r"(?is)(\S)<think(?:ing)?\b[^>]*>(?:.*?</think(?:ing)?>|.*\z)(?=\S)", "$1 ")
    return F.regexp_replace(F.regexp_replace(cut, r"(?is)<think(?:ing)?\b[^>]*>(?:.*?</think(?:ing)?>|.*\z)", ""), r"^\s+|\s+$", "")


def simple_glob(path: Column, pattern: str) -> Column:
    """``*.x`` as a suffix, ``x.*`` as a prefix, otherwise equality."""
    if pattern.startswith("*"):
        return F.endswith(path, F.lit(pattern[1:]))
    if pattern.endswith("*"):
        return F.startswith(path, F.lit(pattern[:-1]))
    return path == pattern


def acceptable_summary(text: Column) -> Column:
    return F.octet_length(F.trim(text)) >= 20


def summary_prompt(subject: Column, level: Column, texts: Column) -> Column:
    """A prompt that asks for a summary of the joined texts of a subject."""
    return F.format_string("Summarise %s (level %s).\n\n%s", subject, level.cast("string"), F.array_join(texts, "\n---\n"))


def contract_fields(text: Column) -> Column:
    """Fields of a map contract: the header between two ``---`` lines (goal, summary, files, model) and which sections follow."""
    head = F.regexp_extract(text, r"(?s)\A\s*---\r?\n(.*?)\r?\n---", 1)

    def field(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))

    files = F.filter(F.transform(F.split(F.coalesce(field("files"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    sections = F.regexp_extract_all(text, F.lit(r"(?m)^## +(.+?)\s*$"), 1)
    return F.struct(field("goal").alias("goal"), field("summary").alias("summary"), files.alias("files"), field("model").alias("model"), sections.alias("sections"))


def front_matter(text: Column) -> Column:
    """Keys and values of a front-matter block as a map; empty without a closed block. BOM and CRLF are accepted."""
    clean = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n", "\n")
    block = F.regexp_extract(clean, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    keys = F.transform(pairs, lambda x: F.trim(F.substring_index(x, ":", 1)))
    values = F.transform(pairs, lambda x: F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)))
    return F.map_from_entries(F.array_distinct(F.arrays_zip(keys.alias("k"), values.alias("v"))))


def render_front_matter(fields: dict[str, Column], body: Column) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), body)
