"""Facts of one TypeScript file: declarations, calls, imports, re-exports, and what is known of local names.

One pass over the tokens. Places are byte offsets, ranges half-open. Types are skipped by a small grammar of their own, so that
function types and type arguments are no code. What isn't understood gives no fact; nothing raises."""

from __future__ import annotations

import bisect
from typing import Any

from .lexer import Tokens

_CONTROL = frozenset("if while for switch catch with return typeof await yield void delete throw new case in of instanceof do else function class extends const let var default export import async".split())
_MODIFIERS = frozenset("public private protected static readonly abstract override async declare accessor get set".split())
_ACCESS = frozenset("public private protected override readonly".split())
_TYPE_PREFIX = frozenset("keyof typeof readonly unique infer asserts abstract new".split())

Fact = dict[str, Any]


class Scanner:
    def __init__(self, source: bytes, tsx: bool = False) -> None:
        t = Tokens(source, tsx)
        self.t, self.x, self.match, self.n = t, t.text, t.match, len(t.text)
        self.types: set[int] = set()
        self.heads: set[int] = set()  # brackets of parameters
        self.functions: list[Fact] = []
        self.kinds: dict[str, list[Fact]] = {"class": [], "interface": [], "enum": [], "type_alias": []}
        self.calls: list[Fact] = []
        self.imports: list[Fact] = []
        self.re_exports: list[Fact] = []
        self.defaults: list[str] = []
        self.locals: list[Fact] = []
        self.returns: list[Fact] = []
        self.bound: dict[int, tuple[str, int, int]] = {}  # arrow's first token -> name, start, first token of the value
        self.closes: dict[int, int] = {}  # a > after which a bracket opened -> its <, or -1
        for i in range(self.n):
            if i not in self.types:
                self._at(i)

    # ---- texts

    def slice(self, i: int, j: int) -> str:
        """The source of tokens i to j, j excluded."""
        return self.text(self.t.start[i], self.t.end[j - 1]) if i < j else ""

    def text(self, a: int, b: int) -> str:
        return self.t.s[a:b].encode("latin-1").decode("utf-8", "replace")

    def at(self, i: int) -> str:
        return self.x[i] if 0 <= i < self.n else ""

    def name(self, i: int) -> str:
        return self.text(self.t.start[i], self.t.end[i]) if 0 <= i < self.n else ""

    def is_id(self, i: int) -> bool:
        return 0 <= i < self.n and self.t.kind[i] == "id"

    def string(self, i: int) -> str | None:
        return self.name(i)[1:-1] if 0 <= i < self.n and self.t.kind[i] == "str" else None

    def new_line(self, i: int) -> bool:
        return i > 0 and "\n" in self.t.s[self.t.end[i - 1] : self.t.start[i]]

    # ---- types

    def angle(self, i: int) -> int:
        """After the type arguments or parameters that begin at i; i itself if they never end."""
        depth, j = 0, i
        while j < self.n:
            c = self.x[j]
            if c == "<":
                depth += 1
            elif c == ">":
                depth -= 1
                if depth == 0:
                    return j + 1
            elif c in ("(", "[", "{", "`(") and self.match[j] > 0:
                j = self.match[j]
            elif c in (";", ")", "]", "}"):
                return i
            j += 1
        return i

    def type(self, i: int) -> int:
        """After the type that begins at i."""
        while self.at(i) in ("|", "&"):
            i += 1
        while True:
            i = self._type_one(i)
            if self.at(i) in ("|", "&"):
                i += 1
            elif self.at(i) == "is" and self.is_id(i):
                i += 1
            elif self.at(i) == "extends" and not self.new_line(i):
                j = self.type(i + 1)
                if self.at(j) != "?":
                    return j
                j = self.type(j + 1)
                return self.type(j + 1) if self.at(j) == ":" else j
            else:
                return i

    def _type_one(self, i: int) -> int:
        while self.at(i) in _TYPE_PREFIX and (self.is_id(i + 1) or self.at(i + 1) in ("(", "[", "{", "<")) and not self.new_line(i + 1):
            i += 1
        c = self.at(i)
        if c == "<":
            i = max(self.angle(i), i + 1)
            c = self.at(i)
        if c == "(" and self.match[i] > 0:
            i = self.match[i] + 1
            if self.at(i) == "=>":
                return self.type(i + 1)
        elif c in ("{", "[", "`(") and self.match[i] > 0:
            i = self.match[i] + 1
        elif c == "-" or self.is_id(i) or (0 <= i < self.n and self.t.kind[i] in ("str", "num")):
            i += 2 if c == "-" else 1
            while self.at(i) == "." and self.is_id(i + 1):
                i += 2
            if self.at(i) == "<":
                i = self.angle(i)
        else:
            return i
        while self.at(i) == "[" and self.match[i] > 0 and not self.new_line(i):
            i = self.match[i] + 1
        return i

    def annotation(self, i: int) -> tuple[str, int]:
        """The type's text and what follows it, if a colon is at i."""
        if self.at(i) != ":":
            return "", i
        j = self.type(i + 1)
        self.types.update(range(i, j))
        return self.slice(i + 1, j), j

    # ---- functions

    def parameters(self, i: int) -> tuple[list[Fact], list[Fact]]:
        """Named parameters within the bracket at i, and those that are fields of the class too."""
        self.heads.add(i)
        out, fields, j, last = [], [], i + 1, self.match[i]
        while 0 < j < last:
            while self.at(j) == "@":
                j = self._decorator(j)
            field = False
            while self.at(j) in _ACCESS and (self.is_id(j + 1) or self.at(j + 1) in ("{", "[")):
                field, j = True, j + 1
            rest = self.at(j) == "..."
            j += rest
            k = j
            j = self.match[j] + 1 if self.at(j) in ("{", "[") and self.match[j] > 0 else j + 1
            if self.at(j) == "?":
                j += 1
            kind, j = self.annotation(j)
            if self.is_id(k) and not rest:
                own = {"name": self.name(k), "type": kind}
                out.append(own)
                if field:
                    fields.append(own)
            while j < last and self.x[j] != ",":
                j = self.match[j] + 1 if self.x[j] in ("(", "[", "{", "`(", "${") and self.match[j] > j else j + 1
            j += 1
        return out, fields

    def function(self, name: str, start: int, i: int, synthetic: bool = False) -> int:
        """The function whose parameters begin at token i, if it has a body in braces; returns what follows its head."""
        params, _ = self.parameters(i)
        kind, j = self.annotation(self.match[i] + 1)
        if self.at(j) == "{" and self.match[j] > 0:
            self.functions.append({"name": name, "start": start, "end": self.t.end[self.match[j]], "body": self.t.start[j], "return_type": kind, "parameters": params, "synthetic": synthetic})
        return j

    def arrow_at(self, i: int) -> int:
        """The place of => if an arrow function begins at token i, else -1."""
        if self.at(i) == "async" and not self.new_line(i + 1):
            i += 1
        if self.at(i) == "<":
            i = self.angle(i)
        if self.is_id(i) and self.at(i + 1) == "=>":
            return i + 1
        if self.at(i) == "(" and self.match[i] > 0:
            j = self.match[i] + 1
            if self.at(j) == "=>":
                return j
            if self.at(j) == ":":
                j = self.type(j + 1)
                if self.at(j) == "=>":
                    return j
        return -1

    def _arrow(self, i: int, to: int) -> None:
        """The arrow function from token i whose => is at to."""
        head = i + (self.x[i] == "async")
        if self.at(head) == "<":
            head = self.angle(head)
        if self.at(head) == "(":
            params, _ = self.parameters(head)
            kind, _ = self.annotation(self.match[head] + 1) if self.match[head] + 1 < to else ("", 0)
        else:
            params, kind = [{"name": self.name(head), "type": ""}], ""
        block = self.at(to + 1) == "{" and self.match[to + 1] > 0
        last = self.match[to + 1] + 1 if block else self.expression(to + 1)
        bound = self.bound.get(i)
        before, after = self.at(i - 1), self.at(last)
        wrapped = before == "(" and after == ")" and self.match[i - 1] == last
        # A bracket that follows a value holds arguments.
        called = wrapped and not (self.at(i - 2) in (")", "]", "`)", ">", "!") or self.is_id(i - 2) and self.at(i - 2) not in _CONTROL)
        if bound:
            name, start = bound[0], bound[1]
        elif called:
            name, start = "(iife)" if block or self.at(last + 1) == "(" else "", self.t.start[i]
        else:
            name, start = "(arrow)" if block else "", self.t.start[i]
        if name:
            self.functions.append({"name": name, "start": start, "end": self.t.end[last - 1], "body": self.t.start[to + 1] if to + 1 < self.n else self.t.end[to], "return_type": kind, "parameters": params, "synthetic": not bound})

    def expression(self, i: int) -> int:
        """After the expression that begins at token i, roughly: a comma, a closing bracket, a semicolon or a line's end stops it."""
        j, fresh = i, True
        while j < self.n:
            c = self.x[j]
            if c in (",", ";", ")", "]", "}", "$}", "`)"):
                return j
            if not fresh and self.new_line(j) and (self.t.kind[j] != "p" or c in ("{", "@", "`(")) and c not in ("instanceof", "in", "as", "satisfies"):
                return j
            if c in ("(", "[", "{", "`(", "${") and self.match[j] > j:
                j, fresh = self.match[j] + 1, False
                continue
            fresh = self.t.kind[j] == "p" and c not in ("++", "--", "!") or c in ("new", "await", "typeof", "return", "async", "function", "void", "delete", "yield", "in", "instanceof", "as")
            j += 1
        return j

    # ---- classes

    def _decorator(self, i: int) -> int:
        j = i + 2
        while self.at(j) == "." and self.is_id(j + 1):
            j += 2
        if self.at(j) == "(" and self.match[j] > 0:
            j = self.match[j] + 1
        return j

    def members(self, i: int, code: bool) -> tuple[list[Fact], list[Fact]]:
        """Fields and methods within the braces at i; with code, methods and bound arrows are functions too."""
        fields, methods, more, j, last = [], [], [], i + 1, self.match[i]
        while 0 < j < last:
            if self.x[j] in (";", ","):
                j += 1
                continue
            first = j
            while self.at(j) == "@":
                j = self._decorator(j)
            while self.at(j) in _MODIFIERS and self.at(j + 1) not in ("(", "=", ":", ";", "?", "!", "}", "<", ",") and not (self.new_line(j + 1) and self.at(j) not in ("public", "private", "protected", "static")):
                j += 1
            star = self.at(j) == "*"
            j += star
            if self.at(j) == "{":  # a static block
                j = self.match[j] + 1
                continue
            plain, name = self.is_id(j) and not self.name(j).startswith("#"), self.string(j) or self.name(j)
            if self.at(j) == "[" and self.match[j] > 0:
                plain, name, j = False, self.slice(j, self.match[j] + 1), self.match[j]
            elif self.at(j) in ("(", "<"):  # a call or construct signature
                name, plain, j = "", False, j - 1
            j += 1
            while self.at(j) in ("?", "!"):
                j += 1
            if self.at(j) == "<":
                j = max(self.angle(j), j + 1)
            if self.at(j) == "(" and self.match[j] > 0:
                params, own = self.parameters(j)
                if code and plain and not star:
                    k = self.function(self.name(j - 1) if self.is_id(j - 1) and self.at(j - 1) == name else name, self.t.start[first], j)
                    kind = self.slice(self.match[j] + 2, k)
                else:
                    kind, k = self.annotation(self.match[j] + 1)
                if name:
                    methods.append({"name": name, "parameters": params, "return_type": kind})
                if name == "constructor":
                    more += own
                j = self.match[k] + 1 if self.at(k) == "{" and self.match[k] > 0 else max(k, j + 1)
                continue
            kind, j = self.annotation(j)
            if name:
                fields.append({"name": name, "type": kind})
            if self.at(j) == "=":
                if code and plain and self.arrow_at(j + 1) > 0:
                    self.bound[j + 1] = (name, self.t.start[first], j + 1)
                j = self.expression(j + 1)
            j = max(j, first + 1)
        return fields + more, methods

    def _class(self, i: int) -> None:
        first = i - (self.at(i - 1) == "abstract")
        j, name = i + 1, ""
        if self.is_id(j) and self.at(j) not in ("extends", "implements"):
            name, j = self.name(j), j + 1
        if self.at(j) == "<":
            j = max(self.angle(j), j + 1)
        parent, implements = "", []
        if self.at(j) == "extends":
            if self.is_id(j + 1) and self.at(j + 2) not in (".", "("):
                parent = self.name(j + 1)
            j += 1
            while j < self.n and self.x[j] not in ("{", "implements"):
                j = self.angle(j) if self.x[j] == "<" and self.angle(j) > j else self.match[j] + 1 if self.x[j] in ("(", "[") and self.match[j] > j else j + 1
        if self.at(j) == "implements":
            j += 1
            while j < self.n and self.x[j] != "{":
                k = self.type(j)
                if k == j + 1 and self.is_id(j):
                    implements.append(self.name(j))
                j = max(k, j + 1)
                j += self.at(j) == ","
        if self.at(j) != "{" or self.match[j] < 0:
            return
        self.types.update(range(i + 1, j))
        fields, methods = self.members(j, True)
        if not name or self.at(first - 1) in ("=", "(", ",", ":", "return", "=>", "?", "new"):
            return  # a class expression
        start = first
        while (k := self._decorated(start)) >= 0:
            start = k
        self.kinds["class"].append({"name": name, "start": self.t.start[start], "end": self.t.end[self.match[j]], "abstract": first < i, "extends": parent, "implements": implements, "properties": fields, "methods": methods})

    def _decorated(self, i: int) -> int:
        """The @ of a decorator that ends right before token i, or -1."""
        j = i - 1
        if self.at(j) == ")" and self.match[j] > 0:
            j = self.match[j] - 1
        while self.is_id(j) and self.at(j - 1) == ".":
            j -= 2
        return j - 1 if self.is_id(j) and self.at(j - 1) == "@" else -1

    def _interface(self, i: int) -> None:
        j, parents = i + 2, []
        if self.at(j) == "<":
            j = max(self.angle(j), j + 1)
        if self.at(j) == "extends":
            j += 1
            while j < self.n and self.x[j] != "{":
                k = self.type(j)
                if k == j + 1 and self.is_id(j):
                    parents.append(self.name(j))
                j = max(k, j + 1)
                j += self.at(j) == ","
        if self.at(j) == "{" and self.match[j] > 0:
            fields, methods = self.members(j, False)
            self.types.update(range(i, self.match[j] + 1))
            self.kinds["interface"].append({"name": self.name(i + 1), "start": self.t.start[i], "end": self.t.end[self.match[j]], "extends": parents, "properties": fields, "methods": methods})

    def _enum(self, i: int) -> None:
        j = i + 2
        first = i - (self.at(i - 1) == "const")
        members = [self.string(k) or self.name(k) for k in range(j + 1, self.match[j]) if (self.is_id(k) or self.string(k) is not None) and self.at(k - 1) in ("{", ",")]
        self.kinds["enum"].append({"name": self.name(i + 1), "start": self.t.start[first], "end": self.t.end[self.match[j]], "members": members})
        self.types.update(range(i + 1, self.match[j]))

    def _alias(self, i: int) -> None:
        j = i + 2
        if self.at(j) == "<":
            j = max(self.angle(j), j + 1)
        if self.at(j) != "=":
            return
        k = self.type(j + 1)
        self.types.update(range(i, k))
        end = k + (self.at(k) == ";")
        self.kinds["type_alias"].append({"name": self.name(i + 1), "start": self.t.start[i], "end": self.t.end[end - 1], "value": self.slice(j + 1, k)})

    # ---- imports and exports

    def _bindings(self, i: int, whole: bool) -> list[Fact]:
        """{a, type b, c as d}: pairs of names in order, and which are types."""
        out, j, last = [], i + 1, self.match[i]
        while j < last:
            is_type = self.x[j] == "type" and self.at(j + 1) not in (",", "}", "as")
            j += is_type
            first = self.string(j) or self.name(j)
            second = first
            if self.at(j + 1) == "as":
                second, j = self.name(j + 2), j + 2
            out.append({"first": first, "second": second, "is_type_only": whole or is_type})
            j += 1 + (self.at(j + 1) == ",")
        return out

    def _import(self, i: int) -> None:
        j, found, space = i + 1, [], ""
        if self.at(j) in ("(", "."):
            return
        whole = self.at(j) == "type" and self.at(j + 1) not in ("from", ",", "=") or self.at(j) == "type" and self.at(j + 1) == "from" and self.at(j + 2) == "from"
        j += whole
        if self.is_id(j) and self.at(j) != "from" or self.at(j) == "from" and self.at(j + 1) in ("from", ","):
            if self.at(j + 1) == "=":  # import x = require("y") is no call
                if self.at(j + 2) == "require" and self.at(j + 3) == "(" and self.match[j + 3] > 0:
                    self.types.update(range(i, self.match[j + 3] + 1))
                return
            found.append({"local_name": self.name(j), "remote_name": "default", "is_type_only": whole})
            j += 1 + (self.at(j + 1) == ",")
        if self.at(j) == "*" and self.at(j + 1) == "as":
            space, j = self.name(j + 2), j + 3
        elif self.at(j) == "{" and self.match[j] > 0:
            found += [{"local_name": b["second"], "remote_name": b["first"], "is_type_only": b["is_type_only"]} for b in self._bindings(j, whole)]
            j = self.match[j] + 1
        j += self.at(j) == "from"
        path = self.string(j)
        if path is not None:
            end = j + 1 + (self.at(j + 1) == ";")
            self.types.update(range(i, end))
            kind = "type" if whole else "value" if found or space else "side-effect"
            self.imports.append({"path": path, "kind": kind, "namespace": space, "identifiers": found, "start": self.t.start[i], "end": self.t.end[end - 1]})

    def _export(self, i: int) -> None:
        j = i + 1
        if self.at(j) == "default":
            j += 1
            if self.at(j) == "async":
                j += 1
            if self.at(j) in ("function", "class") and self.is_id(j + 1) and self.at(j + 1) not in ("extends", "implements"):
                self.defaults.append(self.name(j + 1))
            elif self.is_id(j) and self.at(j) not in _CONTROL and self.at(j) not in ("abstract", "interface", "enum") and (self.at(j + 1) in ("", ";") or self.new_line(j + 1)):
                self.defaults.append(self.name(j))
            return
        whole = self.at(j) == "type" and self.at(j + 1) in ("{", "*")
        j += whole
        space, bindings = "", []
        if self.at(j) == "*":
            j += 1
            if self.at(j) == "as":
                space, j = self.name(j + 1), j + 2
        elif self.at(j) == "{" and self.match[j] > 0:
            bindings = [{"local_name": b["second"], "remote_name": b["first"], "is_type_only": b["is_type_only"]} for b in self._bindings(j, whole)]
            j = self.match[j] + 1
        else:
            return
        if self.at(j) == "from" and (path := self.string(j + 1)) is not None:
            end = j + 2 + (self.at(j + 2) == ";")
            self.types.update(range(i, end))
            self.re_exports.append({"path": path, "kind": "type" if whole else "value", "namespace": space, "bindings": bindings, "start": self.t.start[i], "end": self.t.end[end - 1]})

    # ---- locals

    def _path(self, i: int) -> tuple[str, str, int] | None:
        """name( or receiver.name( after at most one await: receiver, name, the bracket."""
        i += self.at(i) == "await"
        if not self.is_id(i):
            return None
        receiver, name, j = "", self.name(i), i + 1
        if self.at(j) in (".", "?.") and self.is_id(j + 1):
            receiver, name, j = name, self.name(j + 1), j + 2
        if self.at(j) == "<":
            j = self.angle(j)
        if self.at(j) != "(" or self.match[j] < 0 or self.at(self.match[j] + 1) in (".", "?.", "[", "(") and not self.new_line(self.match[j] + 1):
            return None
        return receiver, name, j

    def _variables(self, i: int) -> None:
        j = i + 1
        while j < self.n:
            first, pattern = j, self.at(j)
            j = self.match[j] + 1 if pattern in ("{", "[") and self.match[j] > 0 else j + 1
            j += self.at(j) == "!"
            typed = j
            kind, j = self.annotation(j)
            place = self.t.start[first]
            if self.is_id(first) and kind and j == typed + 2 and self.is_id(typed + 1):
                self.locals.append({"at": place, "form": "type", "local": self.name(first), "type": kind, "origin": "annotation"})
                kind = "known"
            else:
                kind = ""
            if self.at(j) != "=":
                if self.at(j) == "," and self.is_id(j + 1):
                    j += 1
                    continue
                return
            v = j + 1
            if self.is_id(first):
                if self.arrow_at(v) > 0:
                    self.bound[v] = (self.name(first), place, v)
                path = self._path(v)
                if self.at(v) == "new" and self.is_id(v + 1) and not kind and self.at(v + 2) in ("(", "<", ";", ""):
                    self.locals.append({"at": place, "form": "type", "local": self.name(first), "type": self.name(v + 1), "origin": "inferred:new"})
                elif path and path[1] == "require" and not path[0] and self.at(v) != "await" and (target := self.string(path[2] + 1)) is not None and self.match[path[2]] == path[2] + 2:
                    self.imports.append({"path": target, "kind": "value", "namespace": "", "identifiers": [{"local_name": self.name(first), "remote_name": "default", "is_type_only": False}], "start": place, "end": self.t.end[path[2] + 2]})
                elif path and not kind and self.at(v) != "new":
                    self.locals.append({"at": place, "form": "method" if path[0] else "call", "local": self.name(first), "receiver": path[0], "callee": path[1], "property": ""})
            elif pattern == "{" and (path := self._path(v)):
                k = first + 1
                while k < self.match[first]:
                    own, local = self.name(k), self.name(k)
                    if self.is_id(k) and self.at(k + 1) == ":" and self.is_id(k + 2) and self.at(k + 3) in (",", "}"):
                        local, k = self.name(k + 2), k + 2
                    if self.is_id(k) and self.at(k + 1) in (",", "}") and self.at(first) == "{":
                        self.locals.append({"at": place, "form": "destructure", "local": local, "receiver": path[0], "callee": path[1], "property": own})
                    while k < self.match[first] and self.x[k] != ",":
                        k = self.match[k] + 1 if self.x[k] in ("(", "[", "{") and self.match[k] > k else k + 1
                    k += 1
            j = self.expression(v)
            if self.at(j) != ",":
                return
            j += 1

    def _return(self, i: int) -> None:
        j = i + 1
        if self.new_line(j):
            return
        if self.at(j) == "new" and self.is_id(j + 1) and self.at(j + 2) in ("(", "<", ";", "}"):
            self.returns.append({"at": self.t.start[i], "new": self.name(j + 1), "object": None})
        elif self.at(j) == "{" and self.match[j] > 0:
            own, k = [], j + 1
            while k < self.match[j]:
                if self.is_id(k) and self.at(k + 1) in (",", "}"):
                    own.append({"property": self.name(k), "new_type": "", "local_var": self.name(k)})
                elif (self.is_id(k) or self.string(k) is not None) and self.at(k + 1) == ":":
                    key = self.string(k) or self.name(k)
                    if self.at(k + 2) == "new" and self.is_id(k + 3):
                        own.append({"property": key, "new_type": self.name(k + 3), "local_var": ""})
                    elif self.is_id(k + 2) and self.at(k + 3) in (",", "}"):
                        own.append({"property": key, "new_type": "", "local_var": self.name(k + 2)})
                while k < self.match[j] and self.x[k] != ",":
                    k = self.match[k] + 1 if self.x[k] in ("(", "[", "{", "`(") and self.match[k] > k else k + 1
                k += 1
            self.returns.append({"at": self.t.start[i], "new": None, "object": own})

    # ---- calls

    def callee_start(self, i: int) -> int:
        """The first token of the member or call chain that ends before token i, or -1."""
        j = i - 1
        while True:
            while self.at(j) == "!" and not self.new_line(j):
                j -= 1
            if self.at(j) in (")", "]", "`)") and self.match[j] >= 0:
                j = self.match[j]
                before = self.at(j - 1)
                if before in (")", "]", "`)", "!") or self.is_id(j - 1) and before not in _CONTROL:
                    j -= 1
                    continue
                if before == "?.":
                    j -= 2
                    continue
                if before == ">" and (k := self._angle_back(j - 1)) >= 0:
                    j = k - 1
                    continue
                if before == "new" or self.is_id(j - 1) and self.at(j - 2) == "new":
                    return j
            elif not (self.is_id(j) and (self.at(j) not in _CONTROL or self.at(j - 1) in (".", "?.") or self.at(j) == "import")):
                literal = 0 <= j < i - 1 and self.t.kind[j] in ("str", "num", "re")
                return j if literal else -1
            if self.at(j - 1) in (".", "?."):
                j -= 2
                continue
            if self.at(j - 1) == "new" and self.is_id(j):
                return j - 1
            return j

    def _angle_back(self, i: int) -> int:
        """The < that the > at token i closes, if it follows a name: type arguments of a call. What was found for an earlier > is kept,
        so that no token is passed twice."""
        if i not in self.closes:
            self.closes[i] = self._opened(i)
        j = self.closes[i]
        return j if j >= 0 and self.is_id(j - 1) else -1

    def _opened(self, i: int) -> int:
        depth, j = 0, i
        while j > 0:
            c = self.x[j]
            if j < i and j in self.closes:
                if self.closes[j] < 0:
                    return -1
                j = self.closes[j]
            elif c == ">":
                depth += 1
            elif c == "<":
                depth -= 1
                if depth == 0:
                    return j
            elif c in (")", "]", "}", "`)") and self.match[j] >= 0:
                j = self.match[j]
            elif not (self.is_id(j) or self.t.kind[j] in ("str", "num") or c in (",", ".", "|", "&", "[", "]", "=>", "?", ":")):
                return -1
            j -= 1
        return -1

    def target(self, a: int, b: int) -> tuple[str, str]:
        """(callee, receiver) of the expression of tokens a to b, b excluded."""
        while self.at(a) == "(" and self.match[a] == b - 1 and b - a > 2:
            a, b = a + 1, b - 1
        while b > a and self.at(b - 1) == "!":
            b -= 1
        if b - a == 1 and self.is_id(a) and self.x[a] not in ("super", "import", "this"):
            return self.name(a), ""
        if b - a > 2 and self.is_id(b - 1) and self.x[b - 2] in (".", "?.") :
            return self.name(b - 1), self.slice(a, b - 2)
        return "", self.slice(a, b)

    def _call(self, i: int) -> None:
        if i in self.heads or self.match[i] < 0:
            return
        end, args = i, self.match[i]
        if self.at(i - 1) == ">":
            end = self._angle_back(i - 1)
            if end < 0:
                return
        if self.at(end - 1) == "?.":
            end -= 1
        before = self.at(end - 1)
        if not (before in (")", "]", "`)", "!") or self.is_id(end - 1) and (before not in _CONTROL or self.at(end - 2) in (".", "?.") or before == "import")):
            return
        if before == ")" and self.at(self.match[end - 1] - 1) in ("if", "while", "for", "switch", "catch", "with"):
            return
        a = self.callee_start(end)
        if a < 0 or before == "!" and a == end:
            return
        built = self.at(a) == "new"
        # new X.Y(...) is a construction; what follows its bracket is a call on it.
        if built and any(self.x[k] == "(" for k in range(a + 1, end)):
            built = False
        first = a + 1 if built else a
        callee, receiver = self.target(first, end)
        self.calls.append({"callee": callee, "receiver": receiver, "expression": self.slice(a, args + 1), "is_constructor": built, "start": self.t.start[a], "end": self.t.end[args]})

    def _at(self, i: int) -> None:
        c, before = self.x[i], self.at(i - 1)
        if self.t.kind[i] == "p":
            if c == "`(" and self.t.s[self.t.start[i]] == "`":  # a tagged template
                self._call(i)
            elif c == "(" and i not in self.heads:
                to = self.arrow_at(i)
                if to > 0 and before != "async" and not (before == ">"):
                    self._arrow(i, to)
                elif to <= 0:
                    self._call(i)
            elif c == "<" and self.arrow_at(i) > 0 and before != "async" and not self.is_id(i - 1):
                self._arrow(i, self.arrow_at(i))
            return
        if self.t.kind[i] != "id" or before in (".", "?.") or self.at(i + 1) == ":" and before in ("{", ","):
            return
        if self.at(i + 1) == "=>" and before != "async" or c == "async" and self.arrow_at(i) > 0:
            self._arrow(i, self.arrow_at(i))
        elif c == "import":
            self._import(i)
        elif c == "export":
            self._export(i)
        elif c == "class":
            self._class(i)
        elif c == "interface" and self.is_id(i + 1):
            self._interface(i)
        elif c == "enum" and self.is_id(i + 1) and self.at(i + 2) == "{" and self.match[i + 2] > 0:
            self._enum(i)
        elif c == "type" and self.is_id(i + 1) and self.at(i + 2) in ("=", "<"):
            self._alias(i)
        elif c in ("as", "satisfies") and i and not self.new_line(i):
            self.types.update(range(i + 1, self.type(i + 1)))
        elif c == "function":
            first = i - (before == "async")
            j = i + 1
            star = self.at(j) == "*"
            j += star
            name, j = (self.name(j), j + 1) if self.is_id(j) else ("", j)
            if self.at(j) == "<":
                j = max(self.angle(j), j + 1)
            if self.at(j) == "(" and self.match[j] > 0:
                lead = self.at(first - 1)
                declared = name and not star and (lead in ("", ";", "{", "}", "export", "default", "$}") or self.new_line(first) and lead not in ("=", "(", ",", ":", "return", "=>", "?"))
                if declared:
                    self.function(name, self.t.start[first], j)
                else:
                    self.parameters(j)
                    self.annotation(self.match[j] + 1)
        elif c in ("const", "let", "var") and self.at(i + 1) != "enum":
            self._variables(i)
        elif c == "return":
            self._return(i)
        elif c == "new" and self.is_id(i + 1):
            j = i + 2
            while self.at(j) == "." and self.is_id(j + 1):
                j += 2
            if self.at(j) not in ("(", "<"):  # without arguments
                callee, receiver = self.target(i + 1, j)
                self.calls.append({"callee": callee, "receiver": receiver, "expression": self.slice(i, j), "is_constructor": True, "start": self.t.start[i], "end": self.t.end[j - 1]})
        elif self.at(i + 1) == "(" and self.match[i + 1] > 0 and c not in _CONTROL and (before in ("{", ",") or before in ("async", "get", "set") and self.at(i - 2) in ("{", ",")) and i + 1 not in self.heads:
            j = self.match[i + 1] + 1
            k = self.type(j + 1) if self.at(j) == ":" else j
            if self.at(k) == "{":  # a method of an object literal
                self.function(self.name(i), self.t.start[i - 1 if before in ("async", "get", "set") else i], i + 1)


def scan(source: bytes, path: str) -> dict[str, Any]:
    """The facts of one file as rows: symbols, calls (with the id of the symbol they are in), imports, re_exports, local_types,
    local_bindings, inline_returns, warnings."""
    s = Scanner(source, path.endswith(".tsx"))
    by_start: dict[int, Fact] = {}
    for f in s.functions:  # of functions that start together the named one stays
        old = by_start.get(f["start"])
        if old is None or old["synthetic"] and not f["synthetic"]:
            by_start[f["start"]] = f
    functions = sorted(by_start.values(), key=lambda f: f["start"])
    none: Fact = {"body_start_byte": 0, "return_type": "", "parameters": [], "abstract": False, "extends": [], "implements": [], "properties": [], "methods": [], "alias_value": ""}

    def symbol(kind: str, f: Fact, **more: Any) -> Fact:
        return none | {"id": f"{path}#{f['start']}", "kind": kind, "name": f["name"], "file": path, "start_byte": f["start"], "end_byte": f["end"], "is_default_export": f["name"] in s.defaults} | more

    outer, stack = [], []  # of each function the one around it
    for k, f in enumerate(functions):
        while stack and functions[stack[-1]]["end"] < f["end"]:
            stack.pop()
        outer.append(stack[-1] if stack else -1)
        stack.append(k)
    starts = [f["start"] for f in functions]

    def owner(a: int, b: int) -> Fact | None:
        """The innermost function that holds the range."""
        k = bisect.bisect_right(starts, a) - 1
        while k >= 0 and functions[k]["end"] < b:
            k = outer[k]
        return functions[k] if k >= 0 else None

    inferred: dict[int, Fact] = {}
    by_owner: dict[int, list[Fact]] = {}
    for r in s.returns:
        f = owner(r["at"], r["at"] + 1)
        if f and not f["return_type"]:
            by_owner.setdefault(f["start"], []).append(r)
    returns = []
    for start, rows in by_owner.items():
        news, objects = {r["new"] for r in rows if r["new"]}, [r["object"] for r in rows if r["object"] is not None]
        if len(news) == 1 and not objects:
            inferred[start] = {"return_type": next(iter(news))}
        elif not news and len(objects) == 1:
            returns += [{"symbol_id": f"{path}#{start}", **x} for x in objects[0]]
    symbols = [symbol("function", f, body_start_byte=f["body"], parameters=f["parameters"], **({"return_type": f["return_type"]} | inferred.get(f["start"], {}))) for f in functions]
    calls = []
    for k, c in enumerate(sorted(s.calls, key=lambda c: (c["start"], -c["end"]))):
        f = owner(c["start"], c["end"])
        calls.append({"call_id": f"{path}@{k}", "caller_id": f"{path}#{f['start']}" if f else f"{path}#module", "callee": c["callee"], "receiver": c["receiver"], "expression": c["expression"], "is_constructor": c["is_constructor"], "file": path, "start_byte": c["start"], "end_byte": c["end"]})
    if any(c["caller_id"].endswith("#module") for c in calls):
        symbols.append(none | {"id": f"{path}#module", "kind": "module", "name": path, "file": path, "start_byte": 0, "end_byte": len(source), "is_default_export": False})
    for kind, rows in s.kinds.items():
        for f in rows:
            parents = f.get("extends") or []
            symbols.append(symbol(kind, f, abstract=f.get("abstract", False), extends=[parents] if isinstance(parents, str) else parents, implements=f.get("implements", []), properties=f.get("properties", []), methods=f.get("methods", []), alias_value=f.get("value", "")))
    types: dict[tuple[str, str], Fact] = {}
    bindings = []
    for x in s.locals:
        f = owner(x["at"], x["at"] + 1)
        if f is None:
            continue
        own = f"{path}#{f['start']}"
        if x["form"] == "type":
            types[own, x["local"]] = {"symbol_id": own, "file": path, "local": x["local"], "type": x["type"], "origin": x["origin"]}
        else:
            bindings.append({"symbol_id": own, "file": path, "local": x["local"], "form": x["form"], "receiver": x["receiver"], "callee": x["callee"], "property": x["property"]})
    flagged = sum(x["is_default_export"] for x in symbols)
    edge = lambda x: {"file": path, "path": x["path"], "kind": x["kind"], "namespace": x["namespace"], "start_byte": x["start"], "end_byte": x["end"]}
    return {
        "symbols": symbols,
        "calls": calls,
        "imports": [edge(x) | {"identifiers": x["identifiers"]} for x in sorted(s.imports, key=lambda x: x["start"])],
        "re_exports": [edge(x) | {"bindings": x["bindings"]} for x in s.re_exports],
        "local_types": list(types.values()),
        "local_bindings": bindings,
        "inline_returns": returns,
        "warnings": [f"{path}: {flagged} symbols flagged as default export; imports of the default resolve to the first"] if flagged > 1 else [],
    }
