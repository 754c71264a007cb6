"""YAML: block structure by an indentation stack, flow collections, quoted and block scalars."""

from __future__ import annotations

import re

from sedimark.llm.syntax import Bad, fault

_BLOCK = re.compile(r"[|>](?:[1-9][+-]?|[+-][1-9]?)?[ \t]*(?:[ \t]#.*)?$")
_PROPERTY = re.compile(r"(?:[&!][^\s,\[\]{}]*)(?:[ \t]+|$)")
_PLAIN_KEY = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=\S))(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s#:])|[ \t]+:(?=\S))*?(?=[ \t]*:(?:[ \t]|$))")
_QUOTED = {'"': re.compile(r'"(?:[^"\\]|\\.)*"', re.S), "'": re.compile(r"'(?:[^']|'')*'", re.S)}
_ESCAPES = re.compile(r"\\(?:[0abtnvfre \"/\\N_LP\t\n\r]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})")
_COMMENT = re.compile(r"[ \t]*(?:[ \t]#.*)?$")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


class _Scanner:
    def __init__(self, text: str) -> None:
        self.text = text
        self.lines = text.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.stack: list[tuple[int, str]] = []  # indentation, map or seq
        self.open = True  # a node may begin here: at the start of a document, or after a key or dash without value
        self.parent = -1  # the node that may begin must be indented by more than this
        self.plain = False  # the last scalar was plain and may go on
        self.done = False  # the document's root is a finished scalar or flow collection
        self.root_scalar = False

    def bad(self, row: int, reason: str) -> Bad:
        return fault(self.text, self.starts[row], reason)

    def run(self) -> None:
        row = 0
        while row < len(self.lines):
            row = self.line(row)

    def line(self, row: int) -> int:
        """Reads the construct that begins in a line; returns the next line to read."""
        raw = self.lines[row].rstrip("\r")
        if row == 0:
            raw = raw.lstrip("\ufeff")
        if _CONTROL.search(raw):
            raise self.bad(row, "unexpected token")
        body = raw.lstrip(" ")
        if not body.strip(" \t") or body.lstrip(" \t").startswith("#"):
            if body.lstrip(" \t").startswith("#"):
                self.plain = False
            return row + 1
        if raw.startswith(("---", "...")) and (len(raw) == 3 or raw[3] in " \t"):
            self.stack, self.open, self.parent, self.plain, self.done, self.root_scalar = [], True, -1, False, False, False
            rest = raw[3:].strip()
            if raw.startswith("---") and rest and not rest.startswith("#"):
                return self.node(row, 3 + len(raw[3:]) - len(raw[3:].lstrip()), -1)
            return row + 1
        if raw.startswith("%") and not self.stack and self.open:
            return row + 1
        indent = len(raw) - len(body)
        if body[0] == "\t":
            raise self.bad(row, "bad indentation")
        return self.entry(row, indent)

    def entry(self, row: int, at: int) -> int:
        raw = self.lines[row].rstrip("\r")
        t = raw[at:]
        # a plain scalar goes on over more indented lines that are no entries; a colon in them is a fault
        floor = self.parent
        if self.plain and (at > floor or (self.root_scalar and not self.stack)):
            if re.search(r":(?:[ \t]|$)", re.sub(r"[ \t]#.*$", "", t)):
                raise self.bad(row, "unexpected token")
            if re.search(r"[ \t]#", t):
                self.plain = False
            return row + 1
        if self.done:
            raise self.bad(row, "unexpected token")
        dash = t.startswith("-") and (len(t) == 1 or t[1] in " \t")
        while self.stack and self.stack[-1][0] > at:
            self.stack.pop()
            self.open = False
        if self.stack and self.stack[-1] == (at, "seq") and not dash:
            self.stack.pop()
            self.open = False
            if not self.stack or self.stack[-1][0] != at:
                raise self.bad(row, "bad indentation")
        if self.stack and self.stack[-1][0] == at:
            kind = self.stack[-1][1]
            if dash and kind == "map":
                if not self.open:
                    raise self.bad(row, "unexpected token")
                self.stack.append((at, "seq"))  # a sequence as a key's value at the key's own indentation
                return self.item(row, at)
            if dash:
                return self.item(row, at)
            return self.key(row, at)
        # a deeper node
        if not self.open or (self.stack and at <= self.parent):
            raise self.bad(row, "bad indentation")
        return self.node(row, at, self.parent)

    def node(self, row: int, at: int, parent: int) -> int:
        """A node that begins at a place: an entry of a new collection, or a scalar."""
        t = self.lines[row].rstrip("\r")[at:]
        if t.startswith("-") and (len(t) == 1 or t[1] in " \t"):
            self.stack.append((at, "seq"))
            return self.item(row, at)
        if self.is_key(row, at):
            self.stack.append((at, "map"))
            return self.key(row, at)
        return self.value(row, at, parent)

    def item(self, row: int, at: int) -> int:
        raw = self.lines[row].rstrip("\r")
        rest = raw[at + 1 :]
        inner = at + 1 + len(rest) - len(rest.lstrip(" \t"))
        self.plain = False
        if not rest.strip(" \t") or rest.lstrip(" \t").startswith("#"):
            self.open, self.parent = True, at
            return row + 1
        self.parent = at
        return self.node(row, inner, at)

    def is_key(self, row: int, at: int) -> bool:
        return self.key_end(row, at) is not None

    def key_end(self, row: int, at: int) -> int | None:
        """The place after the colon of an implicit or explicit key that begins here."""
        raw = self.lines[row].rstrip("\r")
        while m := _PROPERTY.match(raw, at):
            at = m.end()
        if at >= len(raw):
            return None
        if raw[at] == "?" and (at + 1 == len(raw) or raw[at + 1] in " \t"):
            return at + 1
        if raw[at] in _QUOTED:
            m = _QUOTED[raw[at]].match(raw, at)
            end = m.end() if m else None
        elif raw[at] == "*":
            m = re.compile(r"\*[^\s,\[\]{}]+").match(raw, at)
            end = m.end() if m else None
        elif raw[at] in "[{":
            end = self.flow(row, at, only=True)
        else:
            m = _PLAIN_KEY.match(raw, at)
            end = m.end() if m else None
            if end is None and raw[at] == ":" and (at + 1 == len(raw) or raw[at + 1] in " \t"):
                end = at
        if end is None:
            return None
        m = re.compile(r"[ \t]*:(?=[ \t]|$)").match(raw, end)
        return m.end() if m else None

    def key(self, row: int, at: int) -> int:
        end = self.key_end(row, at)
        if end is None:
            t = self.lines[row][at:].lstrip()
            last = row == len(self.lines) - 1 or not "".join(self.lines[row + 1 :]).strip()
            if t[:1] in _QUOTED and not _QUOTED[t[0]].match(t):
                raise self.bad(row, "unterminated literal")
            raise self.bad(row, "premature end" if last else "unexpected token")
        raw = self.lines[row].rstrip("\r")
        rest = raw[end:]
        inner = end + len(rest) - len(rest.lstrip(" \t"))
        self.plain, self.parent = False, at
        if not rest.strip(" \t") or re.match(r"[ \t]+#", rest):
            self.open = True
            return row + 1
        if raw[inner] == "-" and (inner + 1 == len(raw) or raw[inner + 1] in " \t"):
            raise self.bad(row, "unexpected token")
        self.open = False
        return self.value(row, inner, at)

    def value(self, row: int, at: int, parent: int) -> int:
        """A scalar or flow collection from a place to its end; returns the next line."""
        raw = self.lines[row].rstrip("\r")
        while m := _PROPERTY.match(raw, at):
            at = m.end()
        if at >= len(raw):
            self.open, self.parent = True, parent
            return row + 1
        ch = raw[at]
        top = not self.stack
        self.open = False
        if ch in "|>":
            if not _BLOCK.match(raw, at):
                raise self.bad(row, "unexpected token")
            row += 1
            deep = None
            while row < len(self.lines):
                line = self.lines[row].rstrip("\r")
                if line.strip(" "):
                    indent = len(line) - len(line.lstrip(" "))
                    if deep is None and indent > parent:
                        deep = indent
                    if indent <= parent or indent < (deep or 0):
                        break
                row += 1
            self.done = top
            return row
        if ch in _QUOTED or ch in "[{":
            row, end = self.quoted(row, at, parent) if ch in _QUOTED else self.flow_lines(row, at, parent)
            tail = self.lines[row].rstrip("\r")[end:]
            if not _COMMENT.match(tail):
                raise self.bad(row, "unexpected token")
            self.done = top
            return row + 1
        if ch == "*":
            if not re.compile(r"\*[^\s,\[\]{}]+[ \t]*(?:[ \t]#.*)?$").match(raw, at):
                raise self.bad(row, "unexpected token")
            self.done = top
            return row + 1
        if ch in "@`%,]}#" or (ch in "-?:" and (at + 1 == len(raw) or raw[at + 1] in " \t")):
            raise self.bad(row, "unexpected token")
        t = re.sub(r"[ \t]#.*$", "", raw[at:])
        if re.search(r":(?:[ \t]|$)", t):
            raise self.bad(row, "unexpected token")
        self.plain = t == raw[at:]
        self.parent = parent
        if top:
            self.root_scalar = True
            self.done = not self.plain
        return row + 1

    def quoted(self, row: int, at: int, parent: int) -> tuple[int, int]:
        begin = self.starts[row] + at
        ch = self.text[begin]
        m = _QUOTED[ch].match(self.text, begin)
        if not m:
            raise Bad("unterminated literal", begin)
        if ch == '"':
            i = begin
            while (i := self.text.find("\\", i, m.end())) >= 0:
                e = _ESCAPES.match(self.text, i)
                if not e:
                    raise fault(self.text, i, "unexpected token")
                i = e.end()
        return self.place(m.end(), row, parent)

    def place(self, end: int, row: int, parent: int) -> tuple[int, int]:
        """(line, column) of an offset; lines in between must be indented by more than the parent."""
        while self.starts[row + 1] <= end and row + 1 < len(self.lines):
            row += 1
            line = self.lines[row]
            if line.strip() and len(line) - len(line.lstrip(" ")) <= parent:
                raise self.bad(row, "bad indentation")
        return row, end - self.starts[row]

    def flow_lines(self, row: int, at: int, parent: int) -> tuple[int, int]:
        return self.place(self.flow(row, at), row, parent)

    def flow(self, row: int, at: int, only: bool = False) -> int | None:
        """The end of a flow collection: an offset into the text, or with `only` a column, None where it goes beyond the line."""
        pos, stop = self.starts[row] + at, self.starts[row] + len(self.lines[row]) if only else len(self.text)
        stack: list[str] = []
        before = ""
        while pos < stop:
            ch = self.text[pos]
            if ch in " \t\r\n":
                pos += 1
                continue
            if ch == "#" and self.text[pos - 1] in " \t\r\n":
                end = self.text.find("\n", pos)
                pos = stop if end < 0 else end
                continue
            if ch in "[{":
                if before == "scalar":
                    raise fault(self.text, pos, "unexpected token")
                stack.append(ch)
                before = "open"
            elif ch in "]}":
                if not stack or stack.pop() != ("[" if ch == "]" else "{"):
                    raise fault(self.text, pos, "unbalanced delimiter")
                before = "scalar"
                if not stack:
                    return pos + 1 - self.starts[row] if only else pos + 1
            elif ch == ",":
                if before in ("open", ","):
                    raise fault(self.text, pos, "unexpected token")
                before = ","
            elif ch == ":" and (self.text[pos + 1 : pos + 2] in (" ", "\t", "\n", "\r", "", ",", "]", "}") or before == "scalar"):
                before = ":"
            elif ch in _QUOTED and before != "scalar":
                m = _QUOTED[ch].match(self.text, pos)
                if not m or m.end() > stop:
                    if only:
                        return None
                    raise Bad("unterminated literal", pos)
                pos, before = m.end(), "scalar"
                continue
            else:
                if before == "scalar" or ch in "@`%":
                    raise fault(self.text, pos, "unexpected token")
                m = re.compile(r"(?:[^\s,\[\]{}:#]|:(?![\s,\[\]{}]|\Z)|(?<=\S)#|\s+(?=[^\s,\[\]{}:#]))+").match(self.text, pos, stop)
                pos, before = (m.end() if m else pos + 1), "scalar"
                continue
            pos += 1
        if only:
            return None
        raise Bad("premature end")


def scan(text: str) -> None:
    _Scanner(text).run()
