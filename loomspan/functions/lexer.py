"""Tokens of TypeScript and TSX, with byte offsets: a text is read as Latin-1, so that a character is a byte.

Templates, their substitutions and JSX elements come as pairs of brackets, so that what is within them is read like any other code.
Nothing raises: what isn't recognised is skipped."""

from __future__ import annotations

import re

_SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_TOKEN = re.compile(
    r"""(?P<id>\#?[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)
|(?P<num>0[xXbBoO][\w]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
|(?P<str>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)
|(?P<p>=>|\.\.\.|\?\.(?!\d)|\?\?=|\?\?|===|!==|\*\*=|\*\*|==|!=|<=|>=(?!=)|&&=|\|\|=|&&|\|\||\+\+|--|[-+*/%&|^]=|.)""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_BEFORE_VALUE = frozenset("return typeof case in of new delete void throw else do instanceof await yield default extends as satisfies".split())
_OPEN = {"(": ")", "[": "]", "{": "}", "`(": "`)", "${": "$}"}


class Tokens:
    """text, start, end, kind of each token, and match: the place of a bracket's partner (-1: none)."""

    def __init__(self, source: bytes, tsx: bool = False) -> None:
        self.s, self.tsx = source.decode("latin-1"), tsx
        self.text: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.kind: list[str] = []
        self._code(0, None)
        self.match = [-1] * len(self.text)
        stack: list[int] = []
        for i, x in enumerate(self.text):
            if self.kind[i] != "p":
                continue
            if x in _OPEN:
                stack.append(i)
            elif x in _OPEN.values():
                for k in range(len(stack) - 1, -1, -1):  # brackets left open are given up
                    if _OPEN[self.text[stack[k]]] == x:
                        self.match[stack[k]], self.match[i] = i, stack[k]
                        del stack[k:]
                        break

    def _add(self, kind: str, text: str, a: int, b: int) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.start.append(a)
        self.end.append(b)

    def _value_next(self) -> bool:
        """A value begins here, so that / begins a regular expression and < an element."""
        if not self.text:
            return True
        x = self.text[-1]
        if self.kind[-1] == "p":
            return x not in (")", "]", "}", "`)", "++", "--", "$}")
        return self.kind[-1] == "id" and x in _BEFORE_VALUE

    def _code(self, i: int, until: str | None) -> int:
        """Reads up to the closing brace (until) or the end; returns where it stopped."""
        s, n, depth = self.s, len(self.s), 0
        while i < n:
            m = _SKIP.match(s, i)
            if m:
                i = m.end()
                continue
            c = s[i]
            if c == "`":
                i = self._template(i)
                continue
            if c == "/" and self._value_next() and (m := _REGEX.match(s, i)):
                self._add("re", m.group(), i, m.end())
                i = m.end()
                continue
            if c == "<" and self.tsx and self._value_next() and re.match(r"<(?:[A-Za-z_$]|>)", s[i : i + 2]) and not re.match(r"<\s*\w+\s*(?:,|extends\b)", s[i : i + 80]):
                i = self._element(i)
                continue
            if until and c == "}" and depth == 0:
                return i
            m = _TOKEN.match(s, i)
            if m is None:
                i += 1
                continue
            depth += (c == "{") - (c == "}")
            self._add(m.lastgroup or "p", m.group(), i, m.end())
            i = m.end()
        return i

    def _hole(self, i: int, width: int) -> int:
        self._add("p", "${", i, i + width)
        i = self._code(i + width, "}")
        self._add("p", "$}", i, i + 1)
        return i + 1

    def _template(self, i: int) -> int:
        s, n = self.s, len(self.s)
        self._add("p", "`(", i, i + 1)
        i += 1
        while i < n and s[i] != "`":
            if s[i] == "\\":
                i += 2
            elif s.startswith("${", i):
                i = self._hole(i, 2)
            else:
                i += 1
        self._add("p", "`)", i, min(n, i + 1))
        return i + 1

    def _element(self, i: int) -> int:
        """A JSX element; braces in it hold code."""
        s, n = self.s, len(self.s)
        self._add("p", "`(", i, i + 1)
        depth = 0
        while i < n:
            if s.startswith("</", i):
                i = s.find(">", i)
                i = n if i < 0 else i + 1
                depth -= 1
            elif s[i] == "<":
                i += 1
                while i < n and s[i] != ">":
                    if s[i] in "\"'":
                        i = s.find(s[i], i + 1)
                        i = n if i < 0 else i + 1
                    elif s[i] == "{":
                        i = self._hole(i, 1)
                    else:
                        i += 1
                depth += 0 if i < n and s[i - 1] == "/" else 1
                i += 1
            elif s[i] == "{":
                i = self._hole(i, 1)
            else:
                i += 1
            if depth <= 0:
                break
        self._add("p", "`)", max(0, i - 1), i)
        return i
