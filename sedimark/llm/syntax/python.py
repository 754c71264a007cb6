"""Python 3: literals, delimiters, indentation, statements and the order of tokens in expressions."""

from __future__ import annotations

import re

from sedimark.llm.syntax import Bad, fault

_PREFIX = r"(?i:[rbu]|br|rb|f|fr|rf|t|tr|rt)?"
_TOKEN = re.compile(
    rf"""(?P<skip>[ \t\f]+|\#[^\r\n]*|\\\r?\n)
    |(?P<line>\r\n|\n|\r)
    |(?P<str>{_PREFIX}(?:\"\"\"[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*\"\"\"|'''[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*'''|"(?!"")[^"\\\r\n]*(?:\\[\s\S][^"\\\r\n]*)*"|'(?!'')[^'\\\r\n]*(?:\\[\s\S][^'\\\r\n]*)*'))
    |(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?=(?:and|or|if|else|in|is|for|not)\b|[^\w]|\Z))
    |(?P<name>[^\W\d]\w*)
    |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|[+\-*/%&|^@=!<>]=|->|:=|\*\*|//|<<|>>|[+\-*/%&|^~<>=@.,:;()\[\]{{}}])""",
    re.X,
)
#: Reserved words of Python 3.
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise "
    "return try while with yield".split()
)
_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_BINARY = frozenset("+ - * / % @ & | ^ ** // << >> == != < > <= >= and or in is".split())
_UNARY = frozenset("+ - ~ not await".split())
_CLOSER = {")": "(", "]": "[", "}": "{"}
#: Compound statements and what may follow them at their own level.
_FOLLOW = {"if": ("elif", "else"), "elif": ("elif", "else"), "for": ("else",), "while": ("else",), "try": ("except", "finally"), "except": ("except", "else", "finally"), "try-else": ("finally",)}
_LEADING_ZERO = re.compile(r"0[0_]*[1-9][\d_]*\Z")

Tok = tuple[str, str, int]


def _lines(text: str):
    """(indentation, tokens) of each logical line."""
    pos = 1 if text[:1] == "\ufeff" else 0
    if "\0" in text:
        raise Bad("unexpected token", text.index("\0"))
    n, depth, toks, indent, fresh = len(text), [], [], 0, True
    while pos < n:
        m = _TOKEN.match(text, pos)
        if not m:
            literal = re.compile(rf"{_PREFIX}[\"']").match(text, pos)
            if literal and "f" in literal.group().lower():
                end = _formatted(text, pos, literal.group())
                toks.append(("str", text[pos:end], pos))
                pos, fresh = end, False
                continue
            raise fault(text, pos, "unterminated literal" if literal else "unexpected token")
        kind, v = m.lastgroup, m.group()
        if fresh and kind != "line":
            if kind == "skip" and v[0] in " \t\f":
                indent = len(v.rsplit("\f", 1)[-1].expandtabs(8))
                fresh = text[m.end() : m.end() + 1] in ("\r", "\n", "#", "")
            elif kind != "skip" or v[0] == "\\":
                fresh = False
        if kind == "line":
            if not depth:
                if toks:
                    yield indent, toks
                toks, indent, fresh = [], 0, True
        elif kind != "skip":
            if kind == "str" and v[:2].lower().lstrip("rt")[:1] == "f" and ("{" in v or "}" in v):
                end = _formatted(text, pos, v)
                m_end = end
                toks.append((kind, text[pos:end], pos))
                pos = m_end
                continue
            if kind == "num" and _LEADING_ZERO.match(v):
                raise fault(text, pos, "unexpected token")
            if kind == "name" and v in KEYWORDS:
                kind = "const" if v in ("True", "False", "None") else "key"
            if kind == "op" and v in ("(", "[", "{"):
                depth.append(v)
            elif kind == "op" and v in _CLOSER:
                if not depth or depth.pop() != _CLOSER[v]:
                    raise fault(text, pos, "unbalanced delimiter")
            toks.append((kind, v, pos))
        pos = m.end()
    if depth:
        raise Bad("premature end")
    if toks:
        yield indent, toks


def _formatted(text: str, pos: int, v: str) -> int:
    """The end of a formatted string, whose braces may hold strings of the same quotes."""
    m = re.match(r"[A-Za-z]*(\"\"\"|'''|\"|')", v)
    quote, i, depth = m[1], pos + m.end(), 0
    raw = "r" in m[0].lower()
    while i < len(text):
        if text[i] == "\\" and not (raw and depth):
            i += 2
        elif depth == 0 and text.startswith(quote, i):
            return i + len(quote)
        elif text[i] == "{":
            if depth == 0 and text.startswith("{{", i):
                i += 2
                continue
            depth, i = depth + 1, i + 1
        elif text[i] == "}":
            if depth == 0 and not text.startswith("}}", i):
                raise fault(text, i, "unbalanced delimiter")
            i += 1 if depth else 2
            depth = max(0, depth - 1)
        elif depth and text[i] in "\"'":
            inner = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'").match(text, i)
            if not inner or (text.startswith(quote, i) and len(quote) == 1 and not inner):
                raise fault(text, i, "unterminated literal")
            i = inner.end()
        elif len(quote) == 1 and text[i] == "\n" and not depth:
            break
        else:
            i += 1
    raise fault(text, pos, "unterminated literal")


class _Checker:
    def __init__(self, text: str) -> None:
        self.text = text

    def bad(self, at: int, reason: str = "unexpected token") -> Bad:
        return fault(self.text, at, reason)

    def expr(self, toks: list[Tok], end: int, top: str, empty: bool = False) -> None:
        """Checks tokens as an expression list. top: what a depth-0 context allows: '=' assignments, ':' slices, '' neither."""
        frames: list[list] = [[top, False, 0, False, 0]]  # context, comprehension, open conditionals, lambda colons, keyword argument
        want, fresh, prev = True, True, ""
        for i, (kind, v, at) in enumerate(toks):
            f = frames[-1]
            if want:
                if kind in ("name", "num", "const"):
                    want = False
                elif kind == "str":
                    want = False
                elif kind == "op" and v == "...":
                    want = False
                elif v in _UNARY and kind in ("op", "key"):
                    pass
                elif kind == "key" and v == "lambda":
                    prev, fresh = v, True
                    frames.append(["lambda", False, 0, 0, 0])
                    continue
                elif kind == "key" and v == "yield" and fresh:
                    nxt = toks[i + 1] if i + 1 < len(toks) else None
                    if nxt and nxt[1] == "from":
                        pass
                    elif nxt is None or nxt[1] in _CLOSER:
                        want = False
                elif kind == "key" and v == "from" and prev == "yield":
                    pass
                elif kind == "op" and v == "**" and fresh and f[0] == "{":
                    f[4] = 2
                elif kind == "op" and v in ("*", "**") and fresh and f[0] in ("(", "[", "{", "=", "=x", "*", "index", "lambda"):
                    if f[0] == "lambda" and i + 1 < len(toks) and toks[i + 1][1] in (",", ")", ":"):
                        want = False
                elif kind == "op" and v == "/" and f[0] == "lambda" and fresh:
                    want = False
                elif kind == "op" and v in ("(", "[", "{"):
                    frames.append([v, False, 0, 0, 0])
                    prev, fresh = v, True
                    continue
                elif kind == "op" and v in _CLOSER and fresh and len(frames) > 1 and not self.mixed(f, prev == ",", at) and (prev in ("(", "[", "{") or prev == "," or (prev == ":" and f[0] == "index")):
                    if f[2]:
                        raise self.bad(at)
                    frames.pop()
                    want = False
                elif kind == "op" and v == ":" and f[0] == "index" and fresh:
                    pass
                elif kind == "op" and v == ":" and f[0] == "lambda" and (prev in ("lambda", ",")):
                    frames.pop()
                    prev, fresh = v, True
                    continue
                elif kind == "op" and v == "," and f[0] == "index" and prev == ":":
                    pass
                else:
                    raise self.bad(at)
                fresh = kind == "op" and v == ":"
            else:
                if kind == "str" and prev == "str":
                    continue
                fresh = False
                if kind == "op" and v in ("(", "["):
                    frames.append(["(" if v == "(" else "index", False, 0, 0, 0])
                    want, fresh, prev = True, True, v
                    continue
                if kind == "op" and v == ".":
                    if i + 1 >= len(toks) or toks[i + 1][0] not in ("name",):
                        raise self.bad(at)
                    want = True
                elif kind == "op" and v in _CLOSER:
                    if f[0] == "lambda" or f[2]:
                        raise self.bad(at)
                    self.mixed(f, False, at)
                    frames.pop()
                elif v in _BINARY and kind in ("op", "key"):
                    want = True
                    if v == "in" and f[1] == "target":
                        f[1] = True
                elif kind == "key" and v == "not" and i + 1 < len(toks) and toks[i + 1][1] == "in":
                    pass
                elif kind == "key" and v == "if":
                    if not f[1]:
                        f[2] += 1
                    want = True
                elif kind == "key" and v == "else":
                    if f[2]:
                        f[2] -= 1
                    elif not f[1]:
                        raise self.bad(at)
                    want = True
                elif kind == "key" and v in ("for", "async") and len(frames) > 1 and f[0] not in ("lambda", "index"):
                    if v == "async":
                        prev = v
                        continue
                    f[1] = "target"
                    want = True
                elif kind == "op" and v == ",":
                    if f[2] or f[1] is True or (f[0] == "" and len(frames) == 1):
                        raise self.bad(at)
                    if f[1] != "target":
                        self.mixed(f, False, at)
                    want = fresh = True
                elif kind == "op" and v == ":=":
                    if prev != "name" or (len(frames) == 1 and top[:1] == "="):
                        raise self.bad(at)
                    want = True
                elif kind == "op" and v == ":" and f[0] in ("{", "index", "def", ":"):
                    want = fresh = True
                    if f[0] == "{":
                        fresh = False
                        if f[4]:
                            raise self.bad(at)
                        f[4] = 1
                elif kind == "op" and v == ":" and f[0] == "lambda":
                    frames.pop()
                    want = True
                elif kind == "op" and v == "=" and (f[0] in ("(", "def", "lambda") or (f[0] == "=" and len(frames) == 1)):
                    if f[0] in ("(",) and prev != "name":
                        raise self.bad(at)
                    want = True
                    fresh = f[0] == "="
                else:
                    raise self.bad(at)
            prev = kind if kind in ("str", "name") else v
        if len(frames) > 1 or frames[0][2]:
            raise self.bad(end, "premature end" if end >= len(self.text.rstrip()) else "unexpected token")
        if want and not (prev == "," and fresh) and not (empty and not toks):
            raise self.bad(end, "premature end" if end >= len(self.text.rstrip()) else "unexpected token")

    def mixed(self, f: list, empty: bool, at: int) -> bool:
        """Ends an item of a display in braces: items with and without a colon don't mix. Always False."""
        if f[0] == "{" and not empty:
            if f[3] and (f[3] == 1) != (f[4] > 0):
                raise self.bad(at)
            f[3], f[4] = 1 if f[4] else 2, 0
        return False

    def simple(self, toks: list[Tok]) -> None:
        """One simple statement."""
        kind, v, at = toks[0]
        end = toks[-1][2] + len(toks[-1][1])
        rest = toks[1:]
        if kind == "key" and v in ("pass", "break", "continue"):
            if rest:
                raise self.bad(rest[0][2])
        elif kind == "key" and v == "return":
            self.expr(rest, end, "=x", True)
        elif kind == "key" and v == "raise":
            parts = [rest]
            cut = [i for i, t in enumerate(rest) if t[:2] == ("key", "from")]
            if cut:
                parts = [rest[: cut[0]], rest[cut[0] + 1 :]]
                if not parts[0]:
                    raise self.bad(at)
            for p in parts:
                self.expr(p, end, "", len(parts) == 1)
        elif kind == "key" and v in ("del", "assert"):
            self.expr(rest, end, "=x")
        elif kind == "key" and v in ("global", "nonlocal"):
            if not rest or len(rest) % 2 == 0 or any((t[1] != ",") if i % 2 else (t[0] != "name") for i, t in enumerate(rest)):
                raise self.bad(at)
        elif kind == "key" and v == "import":
            self.names(rest, end, dotted=True)
        elif kind == "key" and v == "from":
            i = 0
            while i < len(rest) and rest[i][1] in (".", "..."):
                i += 1
            dots = i
            while i < len(rest) and (rest[i][0] == "name" if (i - dots) % 2 == 0 else rest[i][1] == "."):
                i += 1
            if i >= len(rest) or rest[i][1] != "import" or (i == 0) or (i > dots and (i - dots) % 2 == 0):
                raise self.bad(rest[i][2] if i < len(rest) else end)
            what = rest[i + 1 :]
            if [t[1] for t in what] == ["*"]:
                return
            if what and what[0][1] == "(":
                if what[-1][1] != ")":
                    raise self.bad(end)
                what = what[1:-1]
                if what and what[-1][1] == ",":
                    what = what[:-1]
            self.names(what, end, dotted=False)
        elif kind == "name" and v == "type" and len(rest) > 1 and rest[0][0] == "name":
            self.expr(rest, end, "=")
        else:
            self.assignment(toks, end)

    def names(self, toks: list[Tok], end: int, dotted: bool) -> None:
        i = 0
        while True:
            if i >= len(toks) or toks[i][0] != "name":
                raise self.bad(toks[i][2] if i < len(toks) else end)
            i += 1
            while dotted and i < len(toks) and toks[i][1] == ".":
                if i + 1 >= len(toks) or toks[i + 1][0] != "name":
                    raise self.bad(toks[i][2])
                i += 2
            if i < len(toks) and toks[i][1] == "as":
                if i + 1 >= len(toks) or toks[i + 1][0] != "name":
                    raise self.bad(toks[i][2])
                i += 2
            if i == len(toks):
                return
            if toks[i][1] != ",":
                raise self.bad(toks[i][2])
            i += 1

    def target(self, toks: list[Tok], single: bool = False) -> bool:
        """Whether tokens can be assigned to: names, attributes, subscripts, tuples and lists of them."""
        if not toks:
            return False
        items = _split(toks)
        if not items[-1] and len(items) > 1:
            items.pop()
        if single and len(items) > 1:
            return False
        for item in items:
            if item and item[0][1] == "*" and not single:
                item = item[1:]
            if not item:
                return False
            if item[0][1] in ("(", "[") and _match(item, 0) == len(item) - 1:
                if len(item) > 2 and not self.target(item[1:-1]):
                    return False
                continue
            depth = 0
            for kind, v, _ in item:
                if kind == "op" and v in ("(", "[", "{"):
                    if v == "{" and depth == 0:
                        return False
                    depth += 1
                elif kind == "op" and v in _CLOSER:
                    depth -= 1
                elif depth == 0 and (kind in ("num", "const", "key") or (kind == "op" and v != ".")):
                    return False
            if item[-1][1] == ")" or (item[-1][0] == "str" and depth == 0):
                return False
        return True

    def assignment(self, toks: list[Tok], end: int) -> None:
        depth, cuts, colon = 0, [], None
        for i, (kind, v, _) in enumerate(toks):
            if kind == "op" and v in ("(", "[", "{"):
                depth += 1
            elif kind == "op" and v in _CLOSER:
                depth -= 1
            elif depth == 0 and kind == "op" and (v == "=" or v in _AUGMENTED):
                cuts.append(i)
            elif depth == 0 and kind == "op" and v == ":" and colon is None and not cuts and not any(t[1] == "lambda" for t in toks[:i]):
                colon = i
            elif depth == 0 and kind == "key" and v == "lambda":
                break
        if colon is not None:
            if not self.target(toks[:colon], single=True):
                raise self.bad(toks[colon][2])
            value = toks[colon + 1 :]
            cut = next((i for i, t in enumerate(value) if t[1] == "=" and cuts and toks.index(t) == cuts[0]), None)
            for part in [value] if cut is None else [value[:cut], value[cut + 1 :]]:
                if not part:
                    raise self.bad(end)
                self.expr(part, end, "")
            return
        if any(toks[i][1] in _AUGMENTED for i in cuts):
            if len(cuts) > 1 or not self.target(toks[: cuts[0]], single=True):
                raise self.bad(toks[cuts[0]][2])
            self.expr(toks[: cuts[0]], end, "")
            self.expr(toks[cuts[0] + 1 :], end, "=x")
            return
        start = 0
        for i in cuts:
            if not self.target(toks[start:i]):
                raise self.bad(toks[i][2])
            self.expr(toks[start:i], toks[i][2], "=x")
            start = i + 1
        self.expr(toks[start:], end, "=x")

    def suite_colon(self, toks: list[Tok]) -> int:
        """The place of the colon that opens a suite."""
        depth, lambdas = 0, 0
        for i, (kind, v, _) in enumerate(toks):
            if kind == "op" and v in ("(", "[", "{"):
                depth += 1
            elif kind == "op" and v in _CLOSER:
                depth -= 1
            elif depth == 0 and kind == "key" and v == "lambda":
                lambdas += 1
            elif depth == 0 and kind == "op" and v == ":":
                if lambdas:
                    lambdas -= 1
                else:
                    return i
        raise self.bad(toks[-1][2] + len(toks[-1][1]), "premature end")

    def compound(self, word: str, head: list[Tok], at: int, end: int) -> None:
        """The head of a compound statement, between its word and its colon."""
        if word in ("try", "finally", "else"):
            if head:
                raise self.bad(head[0][2])
        elif word in ("if", "elif", "while", "match"):
            self.expr(head, end, "")
        elif word == "for":
            cut = _find(head, "in")
            if cut is None or not self.target(head[:cut]):
                raise self.bad(at)
            self.expr(head[:cut], end, "=x")
            self.expr(head[cut + 1 :], end, "=x")
        elif word == "def":
            if len(head) < 3 or head[0][0] != "name":
                raise self.bad(at)
            i = 1
            if head[i][1] == "[":
                i = _match(head, i) + 1
            if i >= len(head) or head[i][1] != "(":
                raise self.bad(at)
            close = _match(head, i)
            self.params(head[i + 1 : close], head[close][2])
            after = head[close + 1 :]
            if after:
                if after[0][1] != "->":
                    raise self.bad(after[0][2])
                self.expr(after[1:], end, "")
        elif word == "class":
            if not head or head[0][0] != "name":
                raise self.bad(at)
            i = 1
            if i < len(head) and head[i][1] == "[":
                i = _match(head, i) + 1
            if i < len(head):
                if head[i][1] != "(" or _match(head, i) != len(head) - 1:
                    raise self.bad(head[i][2])
                self.expr([("name", "f", at), *head[i:]], end, "")
        elif word == "except":
            if head and head[0][1] == "*":
                head = head[1:]
            cut = _find(head, "as")
            if cut is not None:
                if len(head) != cut + 2 or head[cut + 1][0] != "name":
                    raise self.bad(at)
                head = head[:cut]
            self.expr(head, end, "", True)
        elif word == "with":
            self.with_items(head, at, end)
        elif word == "case":
            pass

    def params(self, toks: list[Tok], end: int) -> None:
        items = _split(toks)
        if not items[-1]:
            items.pop()
        for item in items:
            if [t[1] for t in item] in (["*"], ["/"]):
                continue
            if item and item[0][1] in ("*", "**"):
                item = item[1:]
            if not item or item[0][0] != "name":
                raise self.bad(item[0][2] if item else end)
            rest = item[1:]
            if rest and rest[0][1] not in (":", "="):
                raise self.bad(rest[0][2])
            cut = next((i for i, t in enumerate(rest) if t[1] == "=" and t[0] == "op" and _depth(rest, i) == 0), None)
            parts = [rest[1:]] if cut is None or rest[0][1] == "=" else [rest[1:cut], rest[cut + 1 :]]
            for part in parts if rest else []:
                if not part:
                    raise self.bad(end)
                self.expr(part, end, "*" if part[0][1] == "*" else "")

    def with_items(self, head: list[Tok], at: int, end: int) -> None:
        if not head:
            raise self.bad(at)
        if head[0][1] == "(" and _match(head, 0) == len(head) - 1:
            head = head[1:-1]
            if head and head[-1][1] == ",":
                head = head[:-1]
        for item in _split(head):
            cut = _find(item, "as")
            if cut is not None:
                if not self.target(item[cut + 1 :]):
                    raise self.bad(at)
                item = item[:cut]
            if not item:
                raise self.bad(at)
            self.expr(item, end, "")


def _match(toks: list[Tok], i: int) -> int:
    depth = 0
    for j in range(i, len(toks)):
        if toks[j][0] == "op" and toks[j][1] in ("(", "[", "{"):
            depth += 1
        elif toks[j][0] == "op" and toks[j][1] in _CLOSER:
            depth -= 1
            if depth == 0:
                return j
    return len(toks)


def _depth(toks: list[Tok], i: int) -> int:
    return sum((v in ("(", "[", "{")) - (v in _CLOSER) for kind, v, _ in toks[:i] if kind == "op")


def _find(toks: list[Tok], word: str) -> int | None:
    depth = 0
    for i, (kind, v, _) in enumerate(toks):
        if kind == "op" and v in ("(", "[", "{"):
            depth += 1
        elif kind == "op" and v in _CLOSER:
            depth -= 1
        elif depth == 0 and kind == "key" and v == word:
            return i
    return None


def _split(toks: list[Tok], by: str = ",") -> list[list[Tok]]:
    out, depth = [[]], 0
    for t in toks:
        if t[0] == "op" and t[1] in ("(", "[", "{"):
            depth += 1
        elif t[0] == "op" and t[1] in _CLOSER:
            depth -= 1
        if depth == 0 and t[0] == "op" and t[1] == by:
            out.append([])
        else:
            out[-1].append(t)
    return out


def scan(text: str) -> None:
    c = _Checker(text)
    indents, last, owners = [0], [""], [""]
    block_due, due_at = False, 0
    decorated = False
    for indent, toks in _lines(text):
        at = toks[0][2]
        if block_due:
            if indent <= indents[-1]:
                raise c.bad(at, "bad indentation")
            indents.append(indent)
            last.append("")
            block_due = False
        else:
            if indent > indents[-1]:
                raise c.bad(at, "bad indentation")
            while indent < indents[-1]:
                if last[-1] == "try":
                    raise c.bad(at)
                indents.pop()
                last.pop()
            if indent != indents[-1]:
                raise c.bad(at, "bad indentation")
        word = toks[0][1] if toks[0][0] == "key" else ""
        skip = 1
        if word == "async" and len(toks) > 1 and toks[1][1] in ("def", "for", "with"):
            word, skip = toks[1][1], 2
        if toks[0][0] == "name" and toks[0][1] in ("match", "case") and toks[-1][1] == ":" and len(toks) > 2 and toks[1][1] not in ("=", ".", ":"):
            word = toks[0][1]
        before = last[-1]
        if word in ("elif", "else", "except", "finally"):
            if word not in _FOLLOW.get(before, ()):
                raise c.bad(at)
        elif before == "try":
            raise c.bad(at)
        if decorated and word not in ("def", "class") and toks[0][1] != "@":
            raise c.bad(at)
        decorated = False
        if word in ("if", "elif", "else", "while", "for", "try", "except", "finally", "with", "def", "class", "match", "case"):
            colon = c.suite_colon(toks)
            c.compound(word, toks[skip:colon], at, toks[colon][2])
            last[-1] = "try-else" if word == "else" and before == "except" else "" if word in ("finally", "with", "def", "class", "match", "case", "else") else word
            rest = toks[colon + 1 :]
            if not rest:
                block_due, due_at = True, at
                continue
            for part in _statements(rest):
                if part[0][1] in ("if", "for", "while", "try", "with", "def", "class") and part[0][0] == "key":
                    raise c.bad(part[0][2])
                c.simple(part)
            continue
        last[-1] = ""
        if toks[0][1] == "@" and toks[0][0] == "op":
            c.expr(toks[1:], toks[-1][2] + 1, "")
            decorated = True
            continue
        for part in _statements(toks):
            c.simple(part)
    if block_due or decorated:
        raise Bad("premature end")
    if "try" in last:
        raise Bad("premature end")


def _statements(toks: list[Tok]) -> list[list[Tok]]:
    """The simple statements of a line; one semicolon may end it."""
    parts = _split(toks, ";")
    if not parts[-1] and len(parts) > 1:
        parts.pop()
    if any(not p for p in parts):
        at = toks[0][2]
        raise Bad("unexpected token", at)
    return parts
