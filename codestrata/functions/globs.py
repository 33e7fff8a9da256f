"""Globs as regular expressions."""

from __future__ import annotations

import re


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a glob in which ``*`` crosses ``/``; ``**``, ``?``, ``[]`` and ``{}`` work as usual."""
    out, at, depth = [], 0, 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
            continue
        if c == "*":
            while at + 1 < len(glob) and glob[at + 1] == "*":
                at += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            body = glob[at + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            at = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        at += 1
    return "^" + "".join(out) + "$"


def any_glob(globs: list[str]) -> str | None:
    """One expression for a list of globs; None for an empty list."""
    return "|".join(glob_regex(g) for g in globs) if globs else None
