"""XML: well-formed documents with one root element."""

from __future__ import annotations

import re

from sedimark.llm.syntax import Bad, fault

_NAME = r"[A-Za-z_:\u00b7-\U000effff][\w:.\-\u00b7-\U000effff]*"
_REF = re.compile(rf"&(?:#\d+|#x[0-9a-fA-F]+|{_NAME});")
_OPEN = re.compile(rf"<({_NAME})((?:\s+{_NAME}\s*=\s*(?:\"[^<\"]*\"|'[^<']*'))*)\s*(/?)>")
_CLOSE = re.compile(rf"</({_NAME})\s*>")
_ATTRIBUTE = re.compile(rf"({_NAME})\s*=\s*(\"[^\"]*\"|'[^']*')")
_KNOWN = frozenset("amp lt gt quot apos".split())
_DECLARED = re.compile(rf"<!ENTITY\s+({_NAME})\s")
_DOCTYPE = re.compile(rf"<!DOCTYPE\s+{_NAME}(?:[^\[\]>\"']|\"[^\"]*\"|'[^']*')*(?:\[(?P<inner>(?:[^\]\"']|\"[^\"]*\"|'[^']*')*)\]\s*)?>")
_VALUE = r"(?:\"[^\"]*\"|'[^']*')"
_SUBSET = re.compile(
    rf"(?:\s+|<!--(?:(?!--)[\s\S])*-->|<\?[\s\S]*?\?>|%{_NAME};|<!ENTITY\s+(?:%\s+)?{_NAME}\s+(?:{_VALUE}|(?:SYSTEM\s+|PUBLIC\s+{_VALUE}\s+){_VALUE}(?:\s+NDATA\s+{_NAME})?)\s*>"
    rf"|<!(?:ELEMENT|ATTLIST|NOTATION)\s+{_NAME}(?:[^<>\"']|{_VALUE})*>)*\Z"
)
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _references(text: str, a: int, b: int, known: frozenset[str] | set[str]) -> None:
    at = text.find("&", a, b)
    while at >= 0:
        m = _REF.match(text, at, b)
        if not m or (text[at + 1] != "#" and m.group()[1:-1] not in known):
            raise fault(text, at, "unexpected token")
        at = text.find("&", m.end(), b)


def scan(text: str) -> None:
    pos = 1 if text[:1] == "\ufeff" else 0
    begin = pos
    if m := _CONTROL.search(text):
        raise fault(text, m.start(), "unexpected token")
    known: frozenset[str] | set[str] = _KNOWN
    stack: list[str] = []
    rooted = typed = False
    while pos < len(text):
        at = text.find("<", pos)
        end = len(text) if at < 0 else at
        if not stack and (text[pos:end].strip(" \t\r\n") or "\x0b" in text[pos:end]):
            raise fault(text, pos + len(text[pos:end]) - len(text[pos:end].lstrip()), "unexpected token")
        if stack:
            _references(text, pos, end, known)
            if (bad := text.find("]]>", pos, end)) >= 0:
                raise fault(text, bad, "unexpected token")
        if at < 0:
            break
        if text.startswith("<!--", at):
            end = text.find("--", at + 4)
            if end < 0:
                raise Bad("unterminated literal", at)
            if text[end : end + 3] != "-->":
                raise fault(text, end, "unexpected token")
            pos = end + 3
        elif text.startswith("<![CDATA[", at):
            end = text.find("]]>", at)
            if not stack or end < 0:
                raise Bad("unterminated literal" if stack else "unexpected token", at)
            pos = end + 3
        elif text.startswith("<?", at):
            end = text.find("?>", at)
            if end < 0:
                raise Bad("unterminated literal", at)
            if text[at + 2 : at + 6].lower() == "xml " or text[at + 2 : end].lower() == "xml":
                if at != begin or not re.match(r"<\?xml\s+version\s*=\s*(?:\"1\.\d\"|'1\.\d')(?:\s+encoding\s*=\s*(?:\"[A-Za-z][\w.-]*\"|'[A-Za-z][\w.-]*'))?(?:\s+standalone\s*=\s*[\"'](?:yes|no)[\"'])?\s*\?>", text[at : end + 2]):
                    raise fault(text, at, "unexpected token")
            elif not re.match(rf"<\?{_NAME}(?:\s|\?>)", text[at : end + 2]):
                raise fault(text, at, "unexpected token")
            pos = end + 2
        elif text.startswith("<!", at):
            m = _DOCTYPE.match(text, at)
            if not m or rooted or typed or not re.match(rf"<!DOCTYPE\s+{_NAME}\s*(?:\[|>|(?:SYSTEM|PUBLIC)\s)", m.group()) or not _SUBSET.match(m["inner"] or ""):
                raise fault(text, at, "unexpected token")
            typed = True
            known = _KNOWN | set(_DECLARED.findall(m.group()))
            pos = m.end()
        elif m := _OPEN.match(text, at):
            if not stack and rooted:
                raise fault(text, at, "unexpected token")
            if m[2]:
                names = [n for n, v in _ATTRIBUTE.findall(m[2])]
                if len(set(names)) < len(names):
                    raise fault(text, at, "unexpected token")
                _references(text, m.start(2), m.end(2), known)
            rooted = True
            if not m[3]:
                stack.append(m[1])
            pos = m.end()
        elif m := _CLOSE.match(text, at):
            if not stack or stack.pop() != m[1]:
                raise fault(text, at, "unbalanced delimiter")
            pos = m.end()
        else:
            raise fault(text, at, "premature end" if text.find(">", at) < 0 else "unexpected token")
    if stack or not rooted:
        raise Bad("premature end")
