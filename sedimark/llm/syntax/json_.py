"""JSON."""

from __future__ import annotations

import re

from sedimark.llm.syntax import Bad, fault

_TOKEN = re.compile(r'[ \t\r\n]*(?:(?P<open>[{\[])|(?P<close>[}\]])|(?P<sep>[,:])|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<lit>(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)(?![\w.+-])))')
_END = re.compile(r"[ \t\r\n]*\Z")


def scan(text: str) -> None:
    pos = 1 if text[:1] == "\ufeff" else 0
    stack: list[str] = []
    want = "value"  # value, first (value or close), key, firstkey (key or close), colon, next (comma or close)
    while True:
        if not stack and want == "next":
            if not _END.match(text, pos):
                raise fault(text, len(text[:pos]) + len(text[pos:]) - len(text[pos:].lstrip()), "unexpected token")
            return
        m = _TOKEN.match(text, pos)
        if not m:
            at = pos + len(text[pos:]) - len(text[pos:].lstrip(" \t\r\n"))
            if at >= len(text):
                raise Bad("premature end")
            raise fault(text, at, "unterminated literal" if text[at] == '"' and '"' not in text[at + 1 :] else "unexpected token")
        kind, at, pos = m.lastgroup, m.start(m.lastgroup), m.end()
        if kind == "open":
            if want not in ("value", "first"):
                raise fault(text, at, "unexpected token")
            stack.append(m["open"])
            want = "firstkey" if m["open"] == "{" else "first"
        elif kind == "close":
            if not stack or stack[-1] != ("{" if m["close"] == "}" else "["):
                raise fault(text, at, "unbalanced delimiter")
            if want not in ("next", "firstkey" if stack[-1] == "{" else "first"):
                raise fault(text, at, "unexpected token")
            stack.pop()
            want = "next"
        elif kind == "sep":
            if m["sep"] == ":" and want == "colon":
                want = "value"
            elif m["sep"] == "," and want == "next":
                want = "key" if stack[-1] == "{" else "value"
            else:
                raise fault(text, at, "unexpected token")
        elif kind == "str" and want in ("key", "firstkey"):
            want = "colon"
        elif want in ("value", "first"):
            want = "next"
        else:
            raise fault(text, at, "unexpected token")
