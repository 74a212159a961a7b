"""Tokens of source texts, by the rules of a language's family for comments and strings.

No grammar: what matters is that a comment sign in a string is part of the string, and a
quote in a comment part of the comment.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

#: Families by extension: signs of line comments, whether /* */ comments, single quotes, and layout count.
HASHED = ("py", "pyi", "rb", "sh", "bash", "pl", "r", "yml", "yaml", "toml", "ex", "exs", "tf", "hcl")
SLASHED = ("rs", "go", "c", "h", "cpp", "hpp", "cc", "java", "kt", "scala", "swift", "cs")
SCRIPTED = ("js", "jsx", "ts", "tsx", "mjs", "cjs", "php", "css", "scss")
LAYOUT = ("py", "pyi", "yml", "yaml")
_DOUBLE = r'"(?:\\.|[^"\\])*"'
_SINGLE = r"'(?:\\.|[^'\\\n])*'"
_LETTER = r"'(?:\\(?:[^ux\n]|x[0-9a-fA-F]{2}|u\{?[0-9a-fA-F]+\}?)|[^'\\\n])'"
_TRIPLE = r'"""(?:\\.|[^\\])*?"""|' + r"'''(?:\\.|[^\\])*?'''"
_RAW = r'r(?P<fence>#+)"(?:.|\n)*?"(?P=fence)'
_TICKED = r"`(?:\\.|[^`\\])*`"


@lru_cache(16)
def _pattern(family: str) -> re.Pattern:
    hashed, slashed = r"\#(?!\[|!\[)[^\n]*", r"//[^\n]*|/\*(?:.|\n)*?(?:\*/|\Z)"
    comment = {"hashed": r"\#[^\n]*", "slashed": slashed, "scripted": slashed}.get(family, f"{hashed}|{slashed}")
    text = {"hashed": [_TRIPLE, _DOUBLE, _SINGLE], "slashed": [_RAW, r'"""(?:.|\n)*?"""', _DOUBLE, _LETTER, _TICKED], "scripted": [_DOUBLE, _SINGLE, _TICKED]}.get(family, [_TRIPLE, _DOUBLE, _SINGLE, _TICKED])
    return re.compile(rf"[^\S\n]*+(?:(?P<word>(?!r#+\")\w+)|(?P<comment>{comment})|(?P<string>{'|'.join(text)})|(?P<line>\n[ \t]*)|(?P<sign>.))|(?P<blank>\s)", re.S)


def family(path: str) -> str:
    """Which comments and strings a file has; an unknown file has all kinds."""
    extension = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    return "hashed" if extension in HASHED else "slashed" if extension in SLASHED else "scripted" if extension in SCRIPTED else "any"


def tokens(text: str, path: str = "") -> list[str]:
    """Words, strings and signs, without comments and white space.

    Where layout counts, a line that is deeper or less deep than the one before begins with
    a token that says so (blank and comment lines and lines inside brackets don't).
    """
    layout = path.rsplit(".", 1)[-1].lower() in LAYOUT
    out: list[str] = []
    depths, inside, pending = [0], 0, 0 if layout else None
    if layout:
        pending = len(text) - len(text.lstrip(" \t"))
        depths = [pending]
    for found in _pattern(family(path)).finditer(text):
        kind = "string" if found.lastgroup == "fence" else found.lastgroup
        value = found[kind]
        if kind == "line" and layout and not inside:
            pending = len(value.expandtabs(8)) - 1
        if kind in ("comment", "line", "blank"):
            continue
        if pending is not None and layout:
            if pending > depths[-1]:
                depths.append(pending)
                out.append("\n>")
            while pending < depths[-1] and len(depths) > 1:
                depths.pop()
                out.append("\n<")
            if out and out[-1][0] != "\n":
                out.append("\n")
            pending = None
        inside += (value in "([{") - (value in ")]}" and inside > 0) if kind == "sign" else 0
        out.append(value)
    return out


def token_hash(parts: list[str]) -> str:
    return hashlib.sha256("\0".join(parts).encode("utf-8", "surrogatepass")).hexdigest()[:32]


def shingles(parts: list[str], k: int = 3) -> frozenset[tuple[str, ...]]:
    """Runs of ``k`` tokens; a shorter text is one run."""
    return frozenset(tuple(parts[i : i + k]) for i in range(max(1, len(parts) - k + 1))) if parts else frozenset()
