"""Java 17: literals, delimiters, the order of tokens in statements and the shape of a compilation unit."""

from __future__ import annotations

import re

from sedimark.llm.syntax import Bad, fault

_ESCAPE = r"\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4})"
_TOKEN = re.compile(
    rf"""(?P<skip>[ \t\f\r\n\x1a]+|//[^\r\n]*|/\*[\s\S]*?\*/)
    |(?P<lit>\"\"\"[ \t\f]*\r?\n(?:[^\\"]|\\[\s\S]|"(?!""))*\"\"\"|"(?:[^"\\\r\n]|{_ESCAPE})*"|'(?:[^'\\\r\n]|[\ud800-\udbff][\udc00-\udfff]|{_ESCAPE})'
      |(?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$]))
    |(?P<name>(?:[^\W\d]|\$)[\w$]*)
    |(?P<op>\.\.\.|->|::|\+\+|--|>>>=|<<=|>>=|>>>|>>|<<|&&|\|\||[=!<>+\-*/&|^%]=|[=<>!~?:+\-*/&|^%@.,;()\[\]{{}}])""",
    re.X,
)
#: Reserved words of Java 17.
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import "
    "instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try "
    "void volatile while true false null".split()
)
_MODIFIERS = frozenset("public protected private static abstract final strictfp sealed non".split())
_TYPES = frozenset("class interface enum record".split())
_CONTEXTUAL = frozenset("record sealed permits non yield var open module requires exports opens uses provides to with transitive when".split())
#: Operators that need an operand on their left; those that may stand in types and patterns are not among them.
_INFIX = frozenset("== != <= >= && || / % ^ | = += -= *= /= &= |= ^= %= <<= >>= >>>= << instanceof".split())
_OPENING = frozenset(["(", "[", "{", ",", ";", ""]) | _INFIX | frozenset("+ - * & ! ~ ? -> return case".split())
_DANGLING = _INFIX | frozenset("+ - . :: ! ~ &".split())
#: After these an expression stands, where two names can't follow each other.
_EXPRESSION = (_INFIX - {"instanceof"}) | frozenset("+ - ! ~ -> return throw new".split())
_CLOSER = {")": "(", "]": "[", "}": "{"}
_PRIMITIVE = frozenset("boolean byte char short int long float double void".split())
#: What must follow a word: heads of statements open a parenthesis, a primitive type is no expression, and so on.
_HEADS = frozenset("if while for switch catch".split())
_STATEMENT = frozenset("if else for while do case return throw break continue try catch finally assert".split())
_AFTER_PRIMITIVE = frozenset("[ . ) ... @ > >> >>> , & ::".split())
_NAMED_NEXT = frozenset("extends implements throws instanceof new".split())


def _follows(k1: str, v1: str, v0: str, kind: str, v: str) -> bool:
    """Whether a token may follow the word before it."""
    if k1 not in ("word", "op") or v0 in (".", "::"):
        return True
    if v1 in _HEADS:
        return v == "("
    if v1 in _PRIMITIVE:
        return kind == "name" or v in _AFTER_PRIMITIVE
    if v1 in _NAMED_NEXT:
        return kind == "name" or v in ("@", "final") or v in _PRIMITIVE or (v1 == "new" and v == "<")
    if v1 in ("class", "interface", "enum"):
        return kind == "name"
    if v1 in ("break", "continue"):
        return kind == "name" or v == ";"
    if v1 in ("throw", "assert"):
        return v not in (";", "}", ")", "]") and v not in _STATEMENT
    if v1 == "return":
        return v not in ("}", ")", "]") and v not in _STATEMENT
    return True


def _tokens(text: str):
    pos, n = 0, len(text)
    if text[:1] == "\ufeff":
        pos = 1
    while pos < n:
        m = _TOKEN.match(text, pos)
        if not m:
            rest = text[pos]
            raise fault(text, pos, "unterminated literal" if rest in "\"'" or text.startswith("/*", pos) else "unexpected token")
        if m.lastgroup != "skip":
            yield m.lastgroup, m.group(), pos
        pos = m.end()


def _head(head: list[tuple[str, str]], opens: bool) -> bool:
    """Whether the tokens before a top-level ; or { make a declaration; inner brackets of annotations are left out."""
    words = [v for _, v in head]
    if not opens:
        if not words:
            return True
        while words and words[0] == "@":  # annotations of a package
            words = words[2:]
            while words[:1] == ["."]:
                words = words[2:]
        if words[:1] == ["package"]:
            body = words[1:]
        elif words[:1] == ["import"]:
            body = words[2:] if words[1:2] == ["static"] else words[1:]
            if body[-2:] == [".", "*"]:
                body = body[:-2]
        else:
            return False
        return len(body) % 2 == 1 and all((x == ".") if i % 2 else (x.isidentifier() or "$" in x) and x not in KEYWORDS for i, x in enumerate(body))
    i = 0
    while i < len(words):
        if words[i] == "@" and words[i + 1 : i + 2] != ["interface"]:
            i += 2
            while words[i : i + 1] == ["."]:
                i += 2
        elif words[i] == "non" and words[i + 1 : i + 3] == ["-", "sealed"]:
            i += 3
        elif words[i] in _MODIFIERS:
            i += 1
        else:
            break
    if words[i : i + 1] == ["@"]:
        i += 1
    if words[i : i + 1] in (["module"], ["open"]):
        return True
    return i + 1 < len(words) and words[i] in _TYPES and head[i + 1][0] == "name" and words[i + 1] not in KEYWORDS


def scan(text: str) -> None:
    stack: list[tuple[str, str]] = []  # bracket, what it is
    owners: list[str] = []  # the word before each open bracket
    closed = ""  # the word before the parenthesis that was closed last
    ifs: list[int] = []  # in each brace: ifs that no else has taken
    due = False  # a catch or finally must follow
    head: list[tuple[str, str]] = []  # tokens of the current top-level declaration, without what is inside brackets
    k0 = v0 = k1 = v1 = ""  # the two tokens before
    depth_kind = ""
    enums = False  # the next brace opens the body of an enum
    for kind, v, at in _tokens(text):
        if kind == "name" and v in KEYWORDS:
            kind = "op" if v == "instanceof" else "word"
        if kind == "name" and (v1 == "@" or v1 == "." and k0 == "note"):
            kind = "note"  # the name of an annotation
        if v == "enum" and kind == "word":
            enums = True
        elif v == ";":
            enums = False
        if not _follows(k1, v1, v0, kind, v) or (due and v not in ("catch", "finally")):
            raise fault(text, at, "unexpected token")
        due = False
        if kind == "word" and v1 != ".":
            if v == "if" and ifs:
                ifs[-1] += 1
            elif v == "else":
                if v1 not in (";", "}") or not ifs or not ifs[-1]:
                    raise fault(text, at, "unexpected token")
                ifs[-1] -= 1
            elif v in ("catch", "finally") and v1 != "}" or v == "case" and depth_kind != "switch":
                raise fault(text, at, "unexpected token")
        operand = kind in ("name", "lit")
        if operand and k1 == "lit":
            raise fault(text, at, "unexpected token")
        if kind == "lit" and k1 == "name" and v1 not in _CONTEXTUAL:
            raise fault(text, at, "unexpected token")
        if kind == "name" and k1 == k0 == "name" and not {v, v1, v0} & _CONTEXTUAL:
            raise fault(text, at, "unexpected token")
        if kind == k1 == "name" and v0 in _EXPRESSION and not {v, v1} & _CONTEXTUAL and not (v0 == "|" and owners and owners[-1] == "catch"):
            raise fault(text, at, "unexpected token")
        if kind == "op":
            if v in _INFIX and (v1 in _OPENING or v1 in ("}", ":") or (v1 == ")" and v == "<<")):
                raise fault(text, at, "unexpected token")
            if v in (">", ">>", ">>>", ">=") and (v1 in (";", "{", "}", "") or v1 in _INFIX):
                raise fault(text, at, "unexpected token")
            if v in ("*", "<", "&") and (v1 in (";", "{", "}", "(", "") or v1 in _INFIX) and not (v == "<" and v1 in (";", "{", "}")):
                raise fault(text, at, "unexpected token")
            if v in (")", "]", ";", "}") and (v1 in _DANGLING or (v1 == "," and v in ")]") or (v1 == "," and v == ";" and depth_kind not in ("body", "switch", "enum")) or (v1 == "*" and v != ";")):
                raise fault(text, at, "unexpected token")
        if v in ("(", "[", "{") and kind == "op":
            what = ""
            if v == "(":
                what = "for" if v1 in ("for", "try") else ""
            elif v == "{":
                if not stack:
                    if not _head(head, True):
                        raise fault(text, at, "unexpected token")
                    head, what = [], "enum" if enums else "body"
                elif v1 in ("=", "]", ",", "(") or (v1 == "{" and depth_kind == "init"):
                    what = "init"
                else:
                    what = "enum" if enums else "switch" if v1 == ")" and closed == "switch" else "body"
                enums = False
                ifs.append(0)
            stack.append((v, what))
            owners.append(v1)
            depth_kind = what
        elif v in _CLOSER and kind == "op":
            if not stack or stack[-1][0] != _CLOSER[v]:
                raise fault(text, at, "unbalanced delimiter")
            owner = owners[-1]
            if v == "}":
                ifs.pop()
                due = owner == "try"
            elif v == ")":
                closed = owner
                if v1 == "(" and owner in ("if", "while", "switch", "catch", "synchronized", "for"):
                    raise fault(text, at, "unexpected token")
            owners.pop()
            if v == "}" and depth_kind in ("body", "switch") and (k1 in ("lit", "name") or v1 in (")", "]", "this", "super", "true", "false", "null")):
                raise fault(text, at, "unexpected token")
            stack.pop()
            depth_kind = stack[-1][1] if stack else ""
            if not stack and v == "}":
                head = []
        elif v == ";" and kind == "op":
            if not stack:
                if not _head(head, False):
                    raise fault(text, at, "unexpected token")
                head = []
            elif stack[-1][0] == "[" or (stack[-1][0] == "(" and depth_kind != "for") or depth_kind == "init":
                raise fault(text, at, "unexpected token")
        elif not stack:
            head.append((kind, v))
        k0, v0, k1, v1 = k1, v1, kind, v
    if stack or head or due:
        raise Bad("premature end")
