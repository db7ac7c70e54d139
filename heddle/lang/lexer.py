"""Tokens of the script language."""

from __future__ import annotations

import re
from dataclasses import dataclass


class ScriptError(ValueError):
    """A script that can't be read or run."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, name (quoted), string, number, symbol, end
    text: str
    value: object
    start: int
    end: int

    def is_word(self, *words: str) -> bool:
        return self.kind == "word" and self.text.upper() in words


_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<string>'(?:[^']|'')*')
    |(?P<name>"(?:[^"]|"")*")
    |(?P<number>0[xX][0-9A-Fa-f]+|[0-9][0-9A-Fa-f]*[hH]\b|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[dDlL]?)
    |(?P<word>[A-Za-z_][A-Za-z_0-9.]*)
    |(?P<symbol>\|\||<<|>>|>=|<=|<>|!=|==|[-+*/%|^~\#&?:!<>=(),;\[\]@$.])""",
    re.VERBOSE | re.DOTALL,
)


def number(text: str) -> int | float | None:
    """The number that a text stands for: hexadecimal (0x.. or ..h), integer (with l: long), else double; None if it is none."""
    s = text.strip()
    try:
        if re.fullmatch(r"[+-]?0[xX][0-9A-Fa-f]+", s):
            return int(s, 16)
        if re.fullmatch(r"[+-]?[0-9][0-9A-Fa-f]*[hH]", s):
            return int(s[:-1], 16)
        if re.fullmatch(r"[+-]?\d+[lL]?", s):
            return int(s.rstrip("lL"))
        return float(s[:-1] if s[-1:] in "dD" and len(s) > 1 else s)
    except ValueError:
        return None


def tokens(script: str) -> list[Token]:
    out, at = [], 0
    while at < len(script):
        m = _TOKEN.match(script, at)
        if not m:
            line = script.count("\n", 0, at) + 1
            raise ScriptError(f"line {line}: unexpected {script[at]!r}")
        kind, text = m.lastgroup, m[0]
        if kind != "space":
            value: object = text
            if kind in ("string", "name"):
                value = text[1:-1].replace(text[0] * 2, text[0])
            elif kind == "number":
                value = number(text)
            out.append(Token(kind, text, value, at, m.end()))
        at = m.end()
    out.append(Token("end", "", None, at, at))
    return out
