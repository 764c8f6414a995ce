"""Problem 4: credentials embedded in source code and configuration.

The code is read as tokens: one lexer per family of languages knows strings with their prefixes and escapes, comments,
names and operators, and what stands in comments and strings is read as tokens again. A name is split into words, its
last words decide whether it names a credential, and rules on the tokens behind it take apart the literals assigned or
passed to it (type annotations, decoding calls, joined parts, values on the next line, unquoted values of configuration
formats, settings within a string). Forms without such a name (URLs, headers, command lines, key blocks, SQL, running
text, log-in calls) have readers of their own. A literal is reported if it is no placeholder and no look-up and could
be a working value; ``mask`` replaces just its characters, so that delimiters, escapes and line ends stay.

Each content is read as tokens once; rules run on lines that hold what they need. Defined results: null and
empty contents give nothing; a missing path is treated as that of code; a value over several lines is one, reported by
the line where it starts; repeated rows are treated each by itself; further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import functools
import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.plans.spread import spread

#: Characters from which a literal is judged as a whole first: a value of that length is encoded, all else is data.
LONG = 4096

# Names, placeholders and formats.
_STRONG = {"password", "passwd", "pwd", "passphrase", "secret", "apikey", "credential", "credentials", "bearer", "passcode", "pass", "senha", "contrasena", "clave", "passwort", "kennwort", "mdp", "motdepasse", "pw", "userpass", "dbpass", "authtoken", "accesstoken", "secretkey", "privatekey"}
_WEAK = {"token", "key", "auth", "pat", "authorization", "cred", "creds", "signature", "salt", "dsn"}
_KEY_OF = {"api", "signing", "deploy", "private", "secret", "access", "encryption", "master", "auth", "embedder", "session", "account", "service", "admin", "client", "license", "storage", "webhook", "hmac", "aes", "ssh", "rsa", "shared", "sign", "crypto", "llm", "bot"}
_PLACEHOLDER = re.compile(
    r"^(?:[x*.#?\-_•0]{3,}|(?:change[_-]?me|changeit|change|replace|insert|enter|put|set|fill|add|your|my|the|some|example|sample|dummy|fake|test|todo|tbd|fixme|redacted|removed|masked|hidden|placeholder|none|null|nil|undefined|true|false|empty|default|unset|n/a)(?:$|[\W_].*|ed$)"
    r"|[<\[{(].*[>\]})]|[$%@!&].*[{(].*|\$\w+|%\w+%|.*\{\{.*\}\}.*|.*\$\{.*\}.*|.*<[\w\s-]+>.*|(?:vault|env|ssm|arn|file|ref|secret|sops|op|gcp|aws|azure|kms|keychain)[:/].*|ENC\[.*|!\w+|.*(?:your|my)[-_](?:api|key|token|password|secret).*|.*example(?:key)?$|.*(?:placeholder|changeme|redacted|not[-_]?a[-_]?real|dummy).*)$",
    re.I | re.S,
)
_FORMATS = r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w-]{18,}|xox[abeoprs]-[\w-]{10,}|[sr]k_(?:live|test)_\w{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[\w-]{35}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{10,}|npm_\w{30,}"
_FORMAT = re.compile(rf"(?<![\w/+.-])(?:{_FORMATS})(?![\w/+=])")
_SUFFIX_NOT = {"hash", "env", "file", "path", "ref", "label", "count", "len", "length", "max", "min", "limit", "age", "ttl", "name", "field", "column", "hint", "prompt", "policy", "type", "kind", "header", "prefix", "suffix", "url", "uri", "format", "regex", "pattern", "placeholder", "expiry", "expires", "id", "size", "bits", "digest", "checksum", "sum", "var", "param", "help", "title", "text", "message", "msg", "error", "public", "pub", "index", "idx", "dir", "store", "provider", "source", "manager", "rotation", "version", "status", "enabled", "required", "fingerprint", "from", "location", "arn", "reset", "strength", "rules", "rule", "example"}

# White space is matched up to 200 characters, so that long runs of it cost no more than their length.
# What the readers need in a line, in lower case: words of names, and what forms without a name start with. Every reader and
# every word of _STRONG and _WEAK has its part here; the token formats are looked for as they are.
_PAT = r"pat(?![a-z])|pat(?:value|plain)"
ANCHOR = re.compile(rf"pass|pwd|pw|senha|contrase|clave|kennwort|mdp|secret|key|token|credential|bearer|basic|auth|cookie|signature|salt|://|-----begin|login|cred|connect\(|sign_?in\(|(?<!\S)--?u|{_PAT}|dsn|identified|log in")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_WRAP_OK = re.compile(r"from|concat|b64|base64|atob|decode|unhex|hex|bytes|join|string|buffer|str|new|to_owned|secret|some|quote|strip", re.I)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
_URL = re.compile(r"(?<![\w+.-])[A-Za-z][\w+.-]*://(?P<u>[^\s:/@\"'`<>]*):(?P<p>[^\s\"'`/<>]+)@(?=[\w.\[-])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s\\\"'`,.:;#*_-]*")
_HEADER = re.compile(r"""(?:authorization|x-[\w-]*(?:key|auth|token|secret)[\w-]*|api-key|cookie)["'`]?[ \t]{0,200}[:,=\]]+[ \t]{0,200}(?:=[ \t]{0,200})?["'`]?(?:(?:bearer|basic|token|apikey)[ \t]{1,200})?(?P<v>[^\s"'`,;)}]+)""", re.I)
_SCHEME = re.compile(r"\b(?:Basic|Bearer)[ \t]{1,200}(?P<v>[A-Za-z0-9+/=_.~-]{8,})")
_BASIC_ARG = re.compile(r"(?:^|\s)(?:-u|--user)[ =]?[\"']?(?P<u>[\w.@-]+):(?P<v>[^\s\"'`]+)")
_FLAG = re.compile(r"--?(?:password|passwd|pass|pwd|token|secret|api-?key|auth-token|access-token|client-secret)[ =][\"']?(?P<v>[^\s\"'`]+)", re.I)
_P_ARG = re.compile(r"(?:^|\s)-u[ =]?\S+\s+(?:-[a-z]\s+\S+\s+)*-p(?P<v>[^\s\"'`]+)")
_SQL = re.compile(r"(?:password|identified[ \t]{1,200}by)[ \t]{1,200}(?:by[ \t]{1,200})?'(?P<v>[^'\n]+)'", re.I)
_NETRC = re.compile(r"\blogin[ \t]{1,200}\S+[ \t]{1,200}password[ \t]{1,200}(?P<v>[^\s\"'`]+)", re.I)
_PROSE = re.compile(r"(?<![\w-])[\w-]*(?:pass|pwd|secret|api_?key|credential|bearer|token|senha|_key)\w*(?:[ \t]{1,200}`?[\w.-]+`?){0,6}?[ \t]{1,200}(?:is[ \t]{1,200}(?P<v>[^\s\"'`]+)|`(?P<w>[^`\s]+)`)", re.I)
_LOGIN_AS = re.compile(r"\blog ?in as `?[\w.@-]+`? with `?(?P<v>[^`\s]+)`?", re.I)
_LOGIN = re.compile(r"\w*login|connect|authenticate|auth|sign_?in|basic_?auth|set_?basic_?auth|credentials", re.I)
_GETTER = re.compile(r"(?:get|read|load|fetch|find|require|resolve|lookup|from|has|is|check|verify|hash|env|need|decode|decrypt|parse|validate|print|log|mask|redact)", re.I)
_NAME_ONLY = re.compile(r"\s{0,20}[A-Za-z_][\w.\- ]{0,77}")
_SETTING_VALUE = re.compile(r"""[^\s;&"'`,(){}<>\\]+""")
_CONFIG = re.compile(r"(?:\.(?:ya?ml|env|sh|bash|toml|ini|cfg|conf|properties|md|txt|rst|sql|netrc|tf|dockerfile)|(?:^|/)\.env[^/]*|(?:^|/)dockerfile)$", re.I)
_UNSPACED = re.compile(r"[^ \n]*")
_ENCODED = re.compile(r"[A-Za-z0-9+/_.~%-]++=*+")
# Words of sentences, and words that settings have where others have a value.
_SENTENCE = set("the and for you your our their its this that these those with from into must should can may not are was were has have been will please enter choose type use used set when where which what how who too or to of in on at is be a an as by it if no new old invalid wrong missing required incorrect expired least characters".split())
_SETTING = set("required optional disabled enabled username database postgres localhost internal external automatic rotating inherited protected encrypted plaintext anonymous interactive keychain keyring readonly supersecret".split())
_WORDY = re.compile(r"^[A-Za-z]+(?:[-_][A-Za-z]+)*[-_]\d{2,4}$")


# -- tokens -------------------------------------------------------------------------------------------------------------

_DQ, _BQ, _SLASHED, _BLOCK = r'"(?:[^"\\\n]|\\.)*"', r"`[^`]*`", r"//[^\n]*(?:\n[ \t]*//[^\n]*)*", r"/\*.*?(?:\*/|\Z)"
_SQ = r"'(?:[^'\\\n]|\\.)*'"
_HASHED = r"#[^\n]*(?:\n[ \t]*#[^\n]*)*"
_WORD_NAME, _CODE_NAME = r"[A-Za-z_][\w.\-]*", r"[A-Za-z_$][\w$]*"


def _lexer(comment: str, string: str, name: str = _CODE_NAME, prefix: str = "") -> tuple[re.Pattern, re.Pattern]:
    """The pattern of all tokens and the one of comments and strings alone, which tells where these are."""
    fine = rf"(?P<comment>{comment})|(?P<string>{prefix}(?:{string}))|(?P<name>{name})|(?P<number>\d[\w.]*)|(?P<line>\r?\n)|(?P<op>:=|=>|==|!=|<=|>=|->|::|[^\s\w])"
    return re.compile(fine, re.S), re.compile(rf"{comment}|{string}", re.S)


#: One lexer per family of languages; ``text`` is for what stands in comments and strings and for running text.
_LEX = {
    "c": _lexer(rf"{_SLASHED}|{_BLOCK}", rf"{_DQ}|{_SQ}|{_BQ}", prefix=r"(?:L|u8?|U|@|\$)?"),
    "any": _lexer(rf"{_SLASHED}|{_BLOCK}|(?m:^[ \t]*#(?!define|include|\[|!)[^\n]*)", rf"{_DQ}|{_SQ}|{_BQ}", prefix="[A-Za-z]?"),
    "rs": _lexer(rf"{_SLASHED}|{_BLOCK}", rf"r(?P<h>#*)\".*?\"(?P=h)|{_DQ}|'(?:[^'\\\n]|\\[^\n]{{1,10}}?)'", prefix="[bc]?"),
    "py": _lexer(_HASHED, rf"\"{{3}}.*?\"{{3}}|'{{3}}.*?'{{3}}|{_DQ}|{_SQ}", prefix="[bBrRuUfF]{0,2}"),
    "sql": _lexer(rf"--[^\n]*(?:\n[ \t]*--[^\n]*)*|{_BLOCK}", rf"'(?:[^']|'')*'|{_DQ}|`[^`\n]*`", prefix="[NEB]?"),
    "conf": _lexer(r"(?<![^\s])[#;][^\n]*(?:\n[ \t]*[#;][^\n]*)*", rf"{_DQ}|(?<!\w){_SQ}|`[^`\n]*`", _WORD_NAME),
    "text": _lexer(r"<!--.*?(?:-->|\Z)", rf"\\\"[^\"\\\n]*\\\"|{_DQ}|(?<!\w)'(?:[^'\\\n]|\\.)*'(?!\w)|`[^`\n]*`", _WORD_NAME),
}
_FAMILY = {"rs": "rs", "sql": "sql", "lua": "sql", "hs": "sql"} | dict.fromkeys(("py", "pyi", "rb", "pl", "r", "tf", "cmake"), "py")
_FAMILY |= dict.fromkeys(("yaml", "yml", "env", "sh", "bash", "zsh", "toml", "ini", "cfg", "conf", "properties", "netrc", "dockerfile", "lock"), "conf") | dict.fromkeys(("md", "txt", "rst", "adoc", "html", "xml"), "text")
_PREFIX = re.compile(r"[A-Za-z$@]{0,2}8?(#*)(\"{3}|'{3}|\\?[\"'`])")
#: What begins a line of a comment, a quoted mail or a list.
_LEAD = re.compile(r"[ \t]{0,200}(?:[/#*>;]+|--+)[ \t]{0,200}")


def family(path: str | None) -> str:
    """The family of languages of a path; of two endings the one that is known counts."""
    name = (path or "").strip().replace("\\", "/").rsplit("/", 1)[-1].lower()
    if name.startswith(".env") or "dockerfile" in name:
        return "conf"
    for part in reversed(name.split(".")[1:]):
        if part in _FAMILY:
            return _FAMILY[part]
    return "any" if "." not in name else "c"


class Tokens:
    """The tokens of a part of a text, read as far as they are asked for: kinds (comment, string, name, number, line, op) and places."""

    def __init__(self, text: str, a: int, b: int, lexer: str, note: bool):
        self.text, self.note = text, note  # a note is a comment: its values need no quotes
        self.typed = lexer in ("c", "rs", "py")
        self.kind, self.start, self.end, self.inner = [], [], [], {}
        self.rest = _LEX[lexer][0].finditer(text, a, b)

    def next(self) -> bool:
        m = next(self.rest, None)
        if m is None:
            return False
        self.kind.append(m.lastgroup if m.lastgroup != "h" else "string")
        self.start.append(m.start())
        self.end.append(m.end())
        return True

    def has(self, i: int) -> bool:
        while len(self.kind) <= i:
            if not self.next():
                return False
        return i >= 0

    def word(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]] if self.has(i) else ""

    def is_(self, i: int, *kinds: str) -> bool:
        return self.has(i) and self.kind[i] in kinds

    def content(self, i: int) -> tuple[int, int]:
        """The place of what a string or comment holds."""
        a, b = self.start[i], self.end[i]
        if self.kind[i] == "string":
            m = _PREFIX.match(self.text, a)
            return m.end(), max(b - len(m[1]) - len(m[2]), m.end())
        return a, b

    def within(self, i: int) -> Tokens:
        """The tokens inside of a string or comment."""
        if i not in self.inner:
            self.inner[i] = Tokens(self.text, *self.content(i), "text", self.note or self.kind[i] == "comment")
        return self.inner[i]

    def between(self, a: int, b: int) -> range:
        """The tokens that touch a stretch of the text."""
        while (not self.start or self.start[-1] < b) and self.next():
            pass
        i = bisect.bisect_right(self.start, a) - 1
        return range(i if i >= 0 and self.end[i] > a else i + 1, bisect.bisect_left(self.start, b))


# -- names and values -----------------------------------------------------------------------------------------------------


@functools.lru_cache(1 << 16)
def _name_class(name: str) -> int:
    """2 for the name of a credential, 1 for one that may be, 0 otherwise."""
    words = [w.lower() for w in _WORDS.findall(name.rsplit(".", 1)[-1])]
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in _SUFFIX_NOT or words[0] in ("max", "min", "num", "has", "is", "no", "count"):
        return 0
    last, before = words[-1], words[-2] if len(words) > 1 else ""
    if last in _STRONG or last.rstrip("s") in _STRONG:
        return 2
    if last in ("key", "token") and before:
        return 2 if last == "key" and before in _KEY_OF and before not in ("public",) else 1
    if last in _WEAK:
        return 1
    if last == "b64" or last == "base64" or last == "value" or last == "plain":
        return min(_name_class("_".join(words[:-1])), 2) if len(words) > 1 else 0
    return 0


def _mixed(v: str) -> int:
    return sum((any(c.islower() for c in v), any(c.isupper() for c in v), any(c.isdigit() for c in v), any(not c.isalnum() for c in v)))


def passphrase(v: str) -> bool:
    """Whether a literal is some words without the grammar of a sentence."""
    words = v.split()
    return len(words) >= 3 and len(v) >= 15 and all(re.fullmatch(r"[a-z]{3,12}|\d{1,4}", w) for w in words) and not set(words) & _SENTENCE and not any(_name_class(w) for w in words)


def plain_secret(v: str) -> bool:
    """Whether a quoted value of a password or key may be one although it is of letters or digits alone."""
    if v.isdigit():
        return len(v) >= 8
    return len(v) >= 8 and v.isascii() and v.isalpha() and v.islower() and not _PLACEHOLDER.match(v) and not _name_class(v) and v not in _SETTING


def could_work(v: str, certain: bool) -> bool:
    """Whether a literal could be a working credential: no placeholder, name, number, path, or sentence."""
    v = v.strip()
    if len(v) > LONG:  # one run of an encoding, of many signs
        if not _ENCODED.fullmatch(v) or len(set(v)) < 12:
            return False
        return any(c.isdigit() for c in v) and (certain or _mixed(v) >= 3 or bool(re.fullmatch(r"[0-9a-fA-F]+", v)))
    if certain and passphrase(v):
        return True
    if len(v) < 6 or any(c.isspace() for c in v) or _PLACEHOLDER.match(v):
        return False
    if _FORMAT.fullmatch(v) or _WORDY.match(v):
        return True
    if v.count("://") or re.fullmatch(r"[\d.,:_\-/]+", v) or re.fullmatch(r"(?:\.{0,2}|~)/[a-z\d._-]+(?:/[a-z\d._-]+)*/?|[A-Za-z]:\\.*", v):
        return False
    if re.fullmatch(r"[\w-]+(?:\.[\w-]+)+", v) and not re.search(r"\d", v) or re.fullmatch(r"(?:sha\d+|md5)[:-].*", v, re.I):
        return False
    if re.fullmatch(r"[A-Za-z_]+\w*[(\[].*", v) or re.fullmatch(r"[A-Za-z_]+(?:\.[A-Za-z_]+)*", v) and not (certain and len(v) >= 8 and _mixed(v) >= 2 and not re.fullmatch(r"(?:[A-Z]?[a-z]+[._]?)+|[A-Z_]+|[a-z_.]+", v)):
        return False
    if re.fullmatch(r"[a-z]+(?:[-_/.][a-z]+)+(?:#\w+)?", v) or re.fullmatch(r"[\w-]+/[\w-]+(?:#\w+)?", v) and not re.search(r"\d", v):
        return False
    if certain:
        return any(c.isdigit() for c in v) or _mixed(v) >= (2 if v.isalpha() else 3)
    if re.fullmatch(r"[0-9a-fA-F]{16,}", v):
        return len(v) in (32, 48, 64) or len(v) >= 24
    return len(v) >= 10 and any(c.isdigit() for c in v) and _mixed(v) >= 3 and not (len(v) < 20 and re.fullmatch(r"[A-Za-z_]+\d{1,3}", v))


def _decoded(v: str) -> str | None:
    try:
        return base64.b64decode(v, validate=True).decode() if len(v) >= 8 and len(v) % 4 == 0 else None
    except ValueError:
        return None


class _Reader:
    def __init__(self, text: str, path: str | None):
        self.text = text
        self.config = bool(path and _CONFIG.search(path.strip().replace("\\", "/")))
        self.lexer = family(path)
        self.shells: list[tuple[int, int]] | None = None
        self.found: dict[int, list[tuple[int, int]]] = {}
        self.taken: list[tuple[int, int]] = []  # sorted
        self.bare = (0, -1)

    def add(self, spans: list[tuple[int, int]]) -> None:
        a = spans[0][0]
        i = bisect.bisect_right(self.taken, (a, 1 << 60)) - 1
        if i < 0 or a >= self.taken[i][1]:
            self.found[a] = spans
            for span in spans:
                bisect.insort(self.taken, span)

    def tokens(self, a: int) -> Tokens:
        """The tokens from the place ``a`` on, or from the start of the string or comment it lies in."""
        if self.shells is None:
            self.shells = [m.span() for m in _LEX[self.lexer][1].finditer(self.text)]
        i = bisect.bisect_left(self.shells, (a, 0)) - 1
        return Tokens(self.text, self.shells[i][0] if i >= 0 and self.shells[i][1] > a else a, len(self.text), self.lexer, False)

    def bare_end(self, pos: int) -> int:
        """The next blank or line end from ``pos``; found once for all places before it."""
        if not self.bare[0] <= pos <= self.bare[1]:
            m = _UNSPACED.match(self.text, pos)
            self.bare = pos, m.end()
        return self.bare[1]

    # -- rules on tokens

    def operator(self, t: Tokens, i: int, quoted: bool) -> tuple[str, int] | None:
        """The operator that gives a value to the name before token i, and the token after it."""
        if t.word(i) == "]":
            i += 1
        if t.word(i) == "[":  # an array of characters
            i += 3 if t.is_(i + 1, "number") else 2
        op = t.word(i)
        if op == ":":  # perhaps the type before an assignment
            j = i + 1
            while (t.is_(j, "name") or t.word(j) in ("&", "<", ">", "[", "]", ".", "?", "|", "::", "'", "*")):
                j += 1
            if j > i + 1 and t.word(j) == "=" and (t.typed or t.is_(j + 1, "string")):
                return "=", j + 1
        if op in ("=", ":=", "=>", ":") or op == "," and quoted:
            return op, i + 1
        return None

    def call(self, t: Tokens, i: int) -> int:
        """The token after the opening of a call that makes a value of its literal, or ``i`` if there is none there."""
        if t.word(i) in ("(", "[", "&", "*"):
            return i + 1
        j, good = i, False
        while t.is_(j, "name") or j > i and t.word(j) in (".", "::", "!"):
            good |= t.is_(j, "name") and bool(_WRAP_OK.search(t.word(j)))
            j += 1
        return j + 1 if good and t.word(j) == "(" else i

    def literal(self, t: Tokens, i: int, joined: bool) -> tuple[str, list[tuple[int, int]]]:
        """The string at token i with the parts glued to it."""
        value, spans = "", []
        while True:
            a, b = t.content(i)
            value += self.text[a:b]
            spans.append((a, b))
            j, signs = i + 1, ""
            while t.is_(j, "line") or t.word(j) in ("+", ",", ".", "&", "<", ">", "\\", "#", "//", "*") and len(signs) < 3:
                signs += "" if t.is_(j, "line") or t.word(j) in ("#", "//", "*") else t.word(j)
                j += 1
            if not t.is_(j, "string") or not (joined or signs and "," not in signs):
                return value, spans
            i = j

    def judged(self, value: str, rank: int) -> str | None:
        """The part of a value that is a working credential, if it is one."""
        v = value[6:].strip() if value[:6].lower() in ("basic ", "token ") else value[7:].strip() if value[:7].lower() == "bearer " else value
        plain = _decoded(v)
        return v if could_work(v, rank == 2) or plain and could_work(plain.rpartition(":")[2], rank == 2) else None

    def assigned(self, t: Tokens, name: str, i: int, op: str, rank: int) -> None:
        """The value from token i on of a name."""
        wrapped = crossed = block = False
        while True:
            if t.is_(i, "line") and op != ",":
                i, crossed = i + 1, True
                lead = _LEAD.match(self.text, t.end[i - 1]) if t.note else None
                while lead and t.has(i) and t.start[i] < lead.end():
                    i += 1
                continue
            if t.word(i) in (">", "|", "\\") and op != ",":
                j = i + 2 if t.word(i + 1) in ("+", "-") else i + 1
                j += t.is_(j, "comment")
                if t.is_(j, "line"):
                    i, crossed, block = j + 1, True, True
                    break
            j = self.call(t, i)
            if j == i:
                break
            i, wrapped = j, True
        if block and t.has(i):
            m = _BARE.match(self.text, t.start[i])
            if m and could_work(m[0], rank == 2):
                self.add([m.span()])
            elif t.is_(i, "string"):
                self.quoted(t, name, i, op, rank, wrapped)
            return
        if t.is_(i, "string"):
            self.quoted(t, name, i, op, rank, wrapped)
            return
        if op == "," or crossed or wrapped and not t.note or not t.has(i):
            return
        if self.config or t.note:
            self.unquoted(t.start[i], rank)

    def quoted(self, t: Tokens, name: str, i: int, op: str, rank: int, wrapped: bool) -> None:
        value, spans = self.literal(t, i, wrapped)
        v = self.judged(value, 1 if op == "," and rank < 2 else rank)
        if v is None and rank == 2 and op != "," and len(spans) == 1 and plain_secret(value):
            v = value
        if v is not None:
            if v != value and len(spans) == 1:
                spans = [(spans[0][1] - len(v), spans[0][1])]
            self.add(spans)

    def unquoted(self, here: int, rank: int) -> None:
        here = re.compile(r"(?:(?:Basic|Bearer|Token)[ \t]+)?", re.I).match(self.text, here).end()
        e = self.bare_end(here)
        if e - here > 2 * LONG:
            run = _ENCODED.match(self.text, here)
            if not run or run.end() < e - 4:  # beyond a closing sign, no value
                return
        raw = self.text[here:e].rstrip("\r")
        raw = re.sub(r"(?:\*/|-->)$", "", raw).rstrip(",;")
        if re.match(r"[A-Za-z_][\w.:]*[(\[]", raw):
            return
        plain = _decoded(raw)
        if raw and (could_work(raw, rank == 2) or plain and could_work(plain.rpartition(":")[2], rank == 2)):
            self.add([(here, here + len(raw))])

    def setting(self, t: Tokens, i: int) -> None:
        """A ``name=value`` within a string, as in connection strings."""
        m = _SETTING_VALUE.match(self.text, t.start[i]) if t.has(i) else None
        if m and could_work(m[0], True):
            self.add([m.span()])

    def names(self, t: Tokens, a: int, b: int, inside: bool = False) -> None:
        """The values of all names in a line."""
        for i in t.between(a, b):
            kind = t.kind[i]
            if kind in ("comment", "string"):
                p, q = t.content(i)
                p2, q2 = max(p, a), min(q, b)
                if kind == "string" and q - p <= 80 and _NAME_ONLY.fullmatch(self.text, p, q):
                    rank = _name_class(self.text[p:q].strip())
                    if rank:
                        got = self.operator(t, i + 1, True)
                        if got:
                            self.assigned(t, self.text[p:q], got[1], got[0], rank)
                elif p2 < q2 and (kind == "comment" or ANCHOR.search(self.text[p2:q2].lower())):
                    self.names(t.within(i), p2, q2, kind == "string")
            elif kind == "name" and t.start[i] >= a:
                word = t.word(i)
                rank = _name_class(word)
                if rank:
                    got = self.operator(t, i + 1, False)
                    if got and inside and not t.note and not t.is_(got[1], "string"):
                        if rank == 2 and got[0] == "=":
                            self.setting(t, got[1])
                    elif got:
                        self.assigned(t, word, got[1], got[0], rank)
                    elif t.is_(i + 1, "string") and i and t.word(i - 1) in ("define", "DEFINE"):
                        self.assigned(t, word, i + 1, "=", rank)
                if t.word(i + 1) == "(" and (rank == 2 or _LOGIN.fullmatch(word)):
                    self.passed(t, word, i + 2, rank)

    def passed(self, t: Tokens, name: str, i: int, rank: int) -> None:
        """The last literal given to a log-in call after another argument, and the only one given to a credential-named call."""
        depth, args, last, j = 0, 0, -1, i
        while t.has(j) and depth >= 0:
            w = t.word(j)
            if w in ("(", "[", "{"):
                depth += 1
            elif w in (")", "]", "}"):
                depth -= 1
            elif w == ";" or t.is_(j, "line") and last == j - 1 and not depth and t.word(j + 1) not in (",", ")"):
                break  # no call after all
            elif not depth and w == ",":
                args += 1
            elif not depth and not t.is_(j, "line", "comment"):
                last = j
            j += 1
        if not t.is_(last, "string"):
            return
        p, q = t.content(last)
        if _LOGIN.fullmatch(name):
            if args and could_work(self.text[p:q], True):
                self.add([(p, q)])
        elif last == i and not args and not _GETTER.match(name) and could_work(self.text[p:q], False):
            self.add([(p, q)])

    # -- forms without a name

    def read_line(self, a: int, b: int) -> None:
        text = self.text
        line = text[a:b]
        low = line.lower()
        if "-----begin" in low:
            for m in _PEM.finditer(text, a, b):
                end, again = text.find("-----END", m.end()), text.find("-----BEGIN", m.end())
                if end < 0 or 0 <= again < end:  # no end of its own
                    end = _PEM_BODY.match(text, m.end(), again if again >= 0 else len(text)).end()
                if re.search(r"[A-Za-z0-9+/=]{24,}", text[m.end() : end]):
                    self.add([(m.start(), end)])
            return
        if "://" in line:
            for m in _URL.finditer(text, a, b):
                p = m["p"]
                if not _PLACEHOLDER.match(p) and len(p) >= 6 and could_work(p, True):
                    self.add([m.span("p")])
        for rx in (_HEADER, _SCHEME) if ("auth" in low or "x-" in low or "key" in low or "basic" in low or "bearer" in low or "cookie" in low) else ():
            for m in rx.finditer(text, a, b):
                v = m["v"].rstrip("\\")
                plain = _decoded(v)
                if could_work(v, False) or _FORMAT.fullmatch(v) or plain and ":" in plain and could_work(plain.rpartition(":")[2], True):
                    self.add([(m.start("v"), m.start("v") + len(v))])
        for rx in (_BASIC_ARG, _P_ARG, _FLAG, _SQL, _NETRC, _LOGIN_AS):
            for m in rx.finditer(text, a, b):
                if could_work(m["v"], True):
                    self.add([m.span("v")])
        t = self.tokens(a)
        self.names(t, a, b)
        if self.config or any(t.kind[i] == "comment" for i in t.between(a, b)) or _LEAD.match(line):
            for m in _PROSE.finditer(text, a, b):
                k = "v" if m["v"] else "w"
                v = m[k].rstrip(".,;:")
                if could_work(v, True) and (_mixed(v) >= 3 or _WORDY.match(v) or re.fullmatch(r"[0-9a-f]{24,}", v)) and not re.fullmatch(r"[a-z_]+\(?\)?", v):
                    self.add([(m.start(k), m.start(k) + len(v))])
        for m in _FORMAT.finditer(text, a, b):
            if not _PLACEHOLDER.match(m[0]):
                self.add([m.span()])


def find(text: str, path: str | None = None) -> list[list[tuple[int, int]]]:
    """The values in a content, in order; each a list of character spans (more than one if it is written in parts)."""
    low = text.lower()
    if len(low) != len(text):  # a few characters change length in lower case; the anchors are ASCII
        low = text.translate(_ASCII_LOWER)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    r, seen = _Reader(text, path), -1
    formats = [m.start() for m in _FORMAT.finditer(text)]
    places = (m.start() for m in ANCHOR.finditer(low))
    for at in heapq.merge(places, formats) if formats else places:
        if at < seen:
            continue
        i = bisect.bisect_right(starts, at) - 1
        a, seen = starts[i], starts[i + 1] if i + 1 < len(starts) else len(text) + 1
        r.read_line(a, min(seen - 1, len(text)))
    return [r.found[k] for k in sorted(r.found)]


_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
_KEEP = re.compile(r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\.|[\r\n]|-----[A-Z ]+-----")


def mask(text: str, values: list[list[tuple[int, int]]], char: str = "*") -> str:
    """The text with every value masked; escapes, line ends and key markers within a value stay as they are."""
    out, at = [], 0
    for a, b in sorted(s for spans in values for s in spans):
        out.append(text[at:a])
        last = a
        for m in _KEEP.finditer(text, a, b):
            out += char * (m.start() - last), m[0]
            last = m.end()
        out.append(char * (b - last))
        at = b
    return "".join(out) + text[at:]


def _lines(batches):
    for pdf in batches:
        rows = []
        for key, path, text in zip(pdf._id, pdf._path, pdf._text, strict=True):
            for spans in find(text, path):
                rows.append((key, text.count("\n", 0, spans[0][0]) + 1, spans[0][0], spans[-1][1]))
        yield pd.DataFrame(rows, columns=["_id", "line_no", "start_char", "end_char"]).astype({"_id": "Int64"})


def _masked(batches):
    for pdf in batches:
        done = [(key, mask(text, v), len(v)) for key, path, text in zip(pdf._id, pdf._path, pdf._text, strict=True) for v in [find(text, path)]]
        yield pd.DataFrame(done, columns=["_id", "masked", "n_values"]).astype({"_id": "Int64"})


def _input(files: DataFrame) -> DataFrame:
    return spread(files.select(F.col("file_id").cast("long").alias("_id"), F.col("rel_path").alias("_path"), F.col("content").alias("_text")).where("_text is not null"))


def find_credentials(files: DataFrame) -> DataFrame:
    """``(file_id, line_no, start_char, end_char)`` of every value."""
    return _input(files).where("_text <> ''").mapInPandas(_lines, "_id long, line_no long, start_char long, end_char long").withColumnRenamed("_id", "file_id")


def redact(files: DataFrame) -> DataFrame:
    """``(file_id, masked, n_values)`` of every content that is not null."""
    return _input(files).mapInPandas(_masked, "_id long, masked string, n_values long").withColumnRenamed("_id", "file_id")
