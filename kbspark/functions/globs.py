"""Path patterns as regular expressions."""

from __future__ import annotations

import re


def glob_regex(pattern: str) -> str:
    """A pattern of an ignore or attribute file as a regular expression over the path below the file's directory.

    A pattern with a slash other than at its end is anchored there, others match at any depth.
    """
    anchored = "/" in pattern.rstrip("/") and not pattern.startswith("**/")
    p, out, i = pattern.lstrip("/").rstrip("/"), [], 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif p.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            negated = p[i + 1] in "!^"
            out.append("[" + "^" * negated + p[i + 1 + negated : j].replace("\\", "\\\\") + "]")
            i = j + 1
        else:
            out.append(re.escape(c))
            i += 1
    return ("^" if anchored else "^(?:.*/)?") + "".join(out) + "$"
