"""Language checkers: a lexer and a pushdown automaton for each, none of which builds a tree.

Each checker takes a text and returns None if it is valid, else why it isn't, one of the reasons below with a line number.
"""

from __future__ import annotations

import re

#: What a checker can find.
REASONS = ("unterminated literal", "unbalanced delimiter", "premature end", "conflict marker", "unexpected token", "bad indentation")

_MARKER = re.compile(r"<{7}(?:\s|\Z)|={7}(?:\r?\n|\Z)|>{7}(?:\s|\Z)|\|{7}(?:\s|\Z)")


class Bad(Exception):
    """The text is not valid."""

    def __init__(self, reason: str, at: int = -1) -> None:
        super().__init__(reason)
        self.reason, self.at = reason, at


def fault(text: str, at: int, reason: str) -> Bad:
    """The fault at a place, named a conflict marker where a line of that kind begins there."""
    start = text.rfind("\n", 0, max(at, 0) + 1) + 1 if at >= 0 else len(text)
    for a in (start, text.rfind("\n", 0, max(start - 1, 0)) + 1):
        if at >= 0 and _MARKER.match(text, a):
            return Bad("conflict marker", a)
    return Bad(reason, at)


def check(language: str, text: str) -> tuple[str, int] | None:
    """(reason, line) of the first fault of a text in a language, or None."""
    from sedimark.llm.syntax import java, javascript, json_, python, xml, yaml

    run = {"java": java.scan, "py": python.scan, "js": javascript.scan, "json": json_.scan, "xml": xml.scan, "yml": yaml.scan}[language]
    try:
        run(text)
    except Bad as bad:
        return bad.reason, text.count("\n", 0, bad.at) + 1 if bad.at >= 0 else text.count("\n") + 1
    return None
