"""JavaScript (script): literals with templates and regular expressions, delimiters, and the order of tokens."""

from __future__ import annotations

import re

from sedimark.llm.syntax import Bad, fault

_SKIP = re.compile(r"(?:[ \t\v\f ﻿ -   　]+|//[^\r\n  ]*|/\*(?:[^*]|\*(?!/))*\*/|<!--[^\r\n]*|(?P<nl>[\r\n  ]))")
_TOKEN = re.compile(
    r"""(?P<str>"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')
    |(?P<num>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[bB][01](?:_?[01])*|0[oO][0-7](?:_?[0-7])*|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?)n?(?![\w$]))
    |(?P<name>\#?(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4})*)
    |(?P<op>\.\.\.|=>|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|>>>|\*\*|\+\+|--|<<|>>|&&|\|\||\?\?|\?\.(?!\d)|[=!<>+\-*/%&|^]=|[=<>!~?:+\-*/%&|^.,;()\[\]{}])
    |(?P<tick>`)""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*(?![\w$])")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")

#: Reserved words, by what follows them.
OPERAND = frozenset("this super true false null".split())
NEEDS = frozenset("new typeof void delete throw in instanceof extends".split())
MAY = frozenset("return yield await case break continue debugger".split())
HEADS = frozenset("if for while switch with catch".split())
BLOCKS = frozenset("else do try finally".split())
DECLARES = frozenset("var let const".split())
RESERVED = OPERAND | (NEEDS - {"extends"}) | HEADS | BLOCKS | frozenset("return case break continue debugger default var const function class extends import export enum".split())
#: What follows let where it declares: a name or a pattern.
_BINDS = re.compile(r"\s*(?:[\[{]|(?!(?:in|instanceof|of)\b)[\w$])")
_SOFT = frozenset("async static get set of let".split())
_BINARY = frozenset("=> >>>= **= <<= >>= &&= ||= ??= === !== >>> ** << >> && || ?? == != <= >= += -= *= /= %= &= |= ^= = < > * / % & | ^ + - ? . ?. ,".split())
_PREFIX = frozenset("+ - ! ~ ++ -- ...".split())
_CLOSER = {")": "(", "]": "[", "}": "{"}


class _Frame:
    __slots__ = ("open", "what", "asks", "cases", "before")

    def __init__(self, open_: str, what: str, before: str = "") -> None:
        self.open, self.what, self.asks, self.cases, self.before = open_, what, 0, 0, before


def scan(text: str) -> None:
    if text[:2] == "#!":
        pos = len(text.split("\n", 1)[0])
    else:
        pos = 0
    n = len(text)
    frames = [_Frame("", "block")]
    state = "S"  # S statement start, E operand needed, R operand allowed, O operand read, A after a block or a head: both
    prev, before, line = "", "", False  # the last token, the one before it, whether a line ended since
    statement = ""  # first word of the statement, for labels
    tokens_in = 0  # tokens read in the statement
    head_due = ""  # if, for, ...: a parenthesis must follow
    while True:
        line = False
        while m := _SKIP.match(text, pos):
            line = line or m["nl"] is not None or "\n" in m.group()
            pos = m.end()
        f = frames[-1]
        if pos >= n:
            break
        at = pos
        if text.startswith("/*", pos):
            raise Bad("unterminated literal", pos)
        block = f.what == "block"
        if line and state in ("R", "O") and block and prev not in ("=>",):
            if state == "R":
                state = "S"
        # regular expressions stand where an operand may begin
        if text[pos] == "/" and state in ("S", "E", "R", "A") and (m := _REGEX.match(text, pos)):
            state, before, prev, pos, tokens_in = "O", prev, "/re/", m.end(), tokens_in + 1
            continue
        m = _TOKEN.match(text, pos)
        if not m:
            raise fault(text, pos, "unterminated literal" if text[pos] in "\"'" else "unexpected token")
        kind, v = m.lastgroup, m.group()
        pos = m.end()
        declares = v in DECLARES and not (v == "let" and (state == "O" or prev in (".", "?.") or not _BINDS.match(text, pos)))
        if v != "(" and before == "function" and prev not in ("(", "*"):
            raise fault(text, at, "unexpected token")
        if v == "return" and kind == "name" and len(frames) == 1 and not property_next(prev):
            raise fault(text, at, "unexpected token")
        if head_due and v != "(":
            if not (head_due == "catch" and v == "{") and not (head_due == "for" and v == "await"):
                raise fault(text, at, "unexpected token")
        if v != "await":
            head_due = ""
        property_name = prev in (".", "?.") or (f.what in ("object", "class") and kind == "name" and (prev in (",", "{", ";", "}", "*") or prev in _SOFT or (line and f.what == "class")))
        if kind == "tick" or kind == "str" or kind == "num" or (kind == "name" and (v in OPERAND or v not in RESERVED or property_name) and not (v == "let" and declares and not property_name)):
            is_word = kind == "name"
            if state == "O":
                tagged = kind == "tick" and prev not in ("]str",)
                starts = line and block and not tagged
                soft = is_word and prev in _SOFT and not prev_dot(before) or (prev in _SOFT and kind in ("str", "num") and f.what in ("object", "class"))
                of = v == "of" and f.before == "for"
                klass = f.what == "class" and (line or prev in ("}", ";", "{"))
                if not (starts or soft or of or tagged or klass):
                    raise fault(text, at, "unexpected token")
                if starts:
                    statement, tokens_in = (v if is_word else ""), 0
                if of:
                    state, before, prev = "E", prev, v
                    continue
            if state in ("S", "A") and block:
                statement, tokens_in = (v if is_word else ""), 0
            if kind == "tick":
                depth = len(frames)
                pos = template(text, pos, frames, at)
                if len(frames) > depth:
                    state, before, prev = "E", prev, "${"
                    tokens_in += 1
                    continue
            if is_word and v == "yield" or v == "await" and is_word:
                state = "R"
            else:
                state = "O"
            before, prev, tokens_in = prev, ("]str" if kind in ("str", "num") else "name" if prev_dot(prev) else v), tokens_in + 1
            continue
        if kind == "name":
            if v in ("in", "instanceof"):
                if state not in ("O", "A"):
                    raise fault(text, at, "unexpected token")
                state = "E"
            else:
                if state == "O" and not (line and block) and not (prev in _SOFT and v in ("function",)) and not (v == "extends"):
                    raise fault(text, at, "unexpected token")
                if state in ("S", "A") or (state == "O" and line and block):
                    statement, tokens_in = v, 0
                elif v in HEADS | BLOCKS | DECLARES | {"throw", "return", "case", "break", "continue", "debugger", "default", "export"} and state in ("E", "R") and not (v in DECLARES and prev in ("(",)) and not (prev in (")", "else", "do")):
                    if not (v == "default" and prev == "export"):
                        raise fault(text, at, "unexpected token")
                if v == "import" and text[pos:].lstrip()[:1] not in ("(", "."):
                    raise fault(text, at, "unexpected token")
                if v in ("export", "enum"):
                    raise fault(text, at, "unexpected token")
                if v in HEADS:
                    head_due, state = v, "E"
                elif v in BLOCKS:
                    state = "S"
                elif v in DECLARES or v in NEEDS or v == "class":
                    state = "E" if v != "class" else "R"
                elif v == "function":
                    if statement == "function" and tokens_in == 0 and before_statement(state) and text[pos:].lstrip()[:1] == "(":
                        raise fault(text, at, "unexpected token")
                    state = "R"
                elif v == "import":
                    state = "O"
                elif v == "case":
                    f.cases += 1
                    state = "E"
                elif v == "default":
                    f.cases += 1
                    state = "O"
                else:
                    state = "R"
            before, prev, tokens_in = prev, v, tokens_in + 1
            continue
        # operators and delimiters
        if v in ("(", "[", "{"):
            if v == "{":
                if state == "O" and prev not in (")",) and statement != "class" and "class" not in (before, prev) and f.what != "class":
                    if not (line and block) and prev != "=>" and before not in ("class", "extends") and prev != "static":
                        raise fault(text, at, "unexpected token")
                what = "object" if (state in ("E", "R") and prev not in ("=>", "else", "do", "try", "finally", "catch")) else "block"
                if "class" in (prev, before) or prev == "class" or before == "extends":
                    what = "class"
                if state == "R" and prev in ("function",):
                    raise fault(text, at, "unexpected token")
                frames.append(_Frame(v, what, prev))
                state = "S" if what != "object" else "R"
                statement, tokens_in = "", 0
            else:
                frames.append(_Frame(v, "paren" if v == "(" else "bracket", prev if state != "O" or prev in HEADS else ("call" if prev not in HEADS else prev)))
                if prev in HEADS or (prev == "await" and before == "for"):
                    frames[-1].before = "for" if prev == "await" else prev
                state = "R"
            before, prev = prev, v
            continue
        if v in _CLOSER:
            if f.what == "template" and v == "}":
                if state == "E" or f.asks:
                    raise fault(text, at, "unexpected token")
                frames.pop()
                depth = len(frames)
                pos = template(text, pos, frames, at)
                state = "E" if len(frames) > depth else "O"
                before, prev = prev, ("${" if state == "E" else "]str")
                continue
            if f.open != _CLOSER[v]:
                raise fault(text, at, "unbalanced delimiter")
            if state == "E" and not (prev == "," and v in "])}" and f.what != "block") and not (prev == v == "") and not (f.before == "for" and prev == ";"):
                raise fault(text, at, "unexpected token")
            if state == "R" and prev in ("new",):
                raise fault(text, at, "unexpected token")
            if f.asks and f.what != "block":
                raise fault(text, at, "unexpected token")
            frames.pop()
            if v == "}":
                state = "O" if f.what == "object" else "A"
            elif f.before in HEADS and v == ")":
                state = "S" if f.before != "switch" else "A"
                if f.before in ("catch",):
                    state = "A"
            else:
                state = "O" if v == "]" else "O"
            before, prev = prev, v
            if v == ")" and f.before in HEADS:
                statement, tokens_in = "", 0
            continue
        if v == ";":
            if statement == "const" and tokens_in == 2 and before == "const":
                raise fault(text, at, "unexpected token")
            if f.what in ("bracket", "object", "template") or (f.what == "paren" and f.before != "for"):
                raise fault(text, at, "unexpected token")
            if state == "E" and prev not in (";",) and tokens_in and not (f.before == "for"):
                raise fault(text, at, "unexpected token")
            state = "S" if f.what != "paren" else "R"
            f.asks = 0
            before, prev, statement, tokens_in = prev, v, "", 0
            continue
        if v == ":":
            if f.asks:
                f.asks -= 1
                if state not in ("O", "A"):
                    raise fault(text, at, "unexpected token")
                state = "E"
            elif f.what == "object":
                if state not in ("O", "A"):
                    raise fault(text, at, "unexpected token")
                state = "E"
            elif f.cases and state in ("O", "A"):
                f.cases -= 1
                state, statement, tokens_in = "S", "", 0
            elif f.what == "block" and state == "O" and tokens_in == 1 and statement == prev:
                state = "S"
            else:
                raise fault(text, at, "unexpected token")
            before, prev = prev, v
            continue
        if state in ("S", "E", "R"):
            elision = v == "," and f.what == "bracket" and prev in (",", "[")
            star = v == "*" and (prev in ("function", "yield", ",", "{", "async", "static") or f.what in ("object", "class"))
            if v not in _PREFIX and not elision and not star and not (v == "." and prev in ("new", "import")):
                raise fault(text, at, "unexpected token")
            if v == "." and prev == "new":
                state = "E"
            elif star:
                state = "R"
            else:
                if state == "S":
                    statement, tokens_in = "", 1
                state = "E"
        elif v in ("++", "--"):
            if state == "A" or line:
                state = "E"
        elif v in ("!", "~", "..."):
            if not (state == "A" or (line and block)):
                raise fault(text, at, "unexpected token")
            state = "E"
        else:
            if state == "A" and v in ("+", "-"):
                pass
            if v == "?":
                f.asks += 1
            if v == "," and f.asks:
                raise fault(text, at, "unexpected token")
            if v == "=>" and prev != ")" and not re.match(r"[\w$]+\Z", prev):
                raise fault(text, at, "unexpected token")
            state = "E"
            if v == "," and f.what in ("object", "bracket", "paren"):
                state = "E"
        before, prev, tokens_in = prev, v, tokens_in + 1
    if len(frames) > 1 or state == "E" or (state == "R" and prev in ("function", "class")) or head_due or frames[0].asks or (before == "function" and prev != "("):
        raise Bad("premature end")
    if state == "S" and prev in BLOCKS:
        raise Bad("premature end")


def before_statement(state: str) -> bool:
    """Whether a statement begins here, where a function must have a name."""
    return state in ("S", "A")


def prev_dot(token: str) -> bool:
    return token in (".", "?.")


def property_next(token: str) -> bool:
    """Whether a word after this token names a property."""
    return token in (".", "?.", ",", "{")


def template(text: str, pos: int, frames: list[_Frame], at: int) -> int:
    """Reads a template's characters; opens a frame where a substitution begins."""
    pos = _TEMPLATE.match(text, pos).end()
    if text.startswith("`", pos):
        return pos + 1
    if text.startswith("${", pos):
        frames.append(_Frame("{", "template"))
        return pos + 2
    raise Bad("unterminated literal", at)
