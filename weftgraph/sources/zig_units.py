"""A scanner for Zig source: declarations, tests and calls, without a compiler.

One pass over the tokens keeps a stack of open braces, each of which belongs to a container, a function or nothing. That
is enough for names, extents and call sites; types are not resolved.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\n]+|//[^\n]*)|(?P<text>\\\\[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<builtin>@[A-Za-z_]\w*)|(?P<name>[A-Za-z_]\w*|@"(?:\\.|[^"\\\n])*")|(?P<number>\d[\w.]*)|(?P<mark>\.\*|\.\?|.)""",
    re.DOTALL,
)
CONTAINERS = {"struct", "union", "enum", "opaque"}
MODIFIERS = {"pub", "export", "extern", "inline", "noinline", "threadlocal", "comptime"}
#: Words that a parenthesis may follow without being called.
NOT_CALLED = CONTAINERS | {"if", "while", "for", "switch", "fn", "return", "catch", "orelse", "and", "or", "align", "linksection", "callconv", "addrspace", "asm", "else", "error", "try", "defer", "errdefer", "comptime", "anytype", "test", "packed", "volatile"}


@dataclass
class Unit:
    name: str
    kind: str
    parent: str | None
    first: int
    last: int
    content: str = ""
    line_start: int = 0
    line_end: int = 0
    edges: list[tuple[str, str, dict[str, str]]] = field(default_factory=list)


@dataclass
class _Scope:
    container: str | None
    function: Unit | None


class Scan:
    """units: declarations of one file in source order; imports, local declarations and tests included."""

    def __init__(self, source: str):
        self.source = source
        self.tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in TOKEN.finditer(source) if m.lastgroup != "skip"]
        self.pair = self._pairs()
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.units: list[Unit] = []
        self.opens: dict[int, _Scope] = {}  # scopes that begin at a brace's token
        self._walk()
        for u in self.units:
            low, high = self.tokens[u.first][2], self.tokens[u.last][3]
            u.content = source[low:high]
            u.line_start, u.line_end = self._line(low), self._line(high - 1)

    def _line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def _pairs(self) -> dict[int, int]:
        """Token number of each bracket's partner; an unclosed one pairs with the last token."""
        out, held = {}, []
        for i, (kind, text, _, _) in enumerate(self.tokens):
            if kind != "mark":
                continue
            if text in "([{":
                held.append(i)
            elif text in ")]}" and held:
                j = held.pop()
                out[j], out[i] = i, j
        return out | {j: len(self.tokens) - 1 for j in held}

    def _is(self, i: int, text: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][1] == text and self.tokens[i][0] != "text"

    def _kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def _start(self, i: int) -> int:
        """The first token of a declaration whose keyword is token i: its modifiers belong to it."""
        while i > 0 and (self.tokens[i - 1][1] in MODIFIERS or self._kind(i - 1) == "text" and self._is(i - 2, "extern")):
            i -= 1
        return i

    def _until(self, i: int, stop: str) -> int:
        """The next token from i with the text, outside any brackets."""
        while i < len(self.tokens) - 1 and not self._is(i, stop):
            if self._kind(i) == "mark" and self.tokens[i][1] in ")]}":
                return i - 1
            i = self.pair.get(i, i) + 1 if self._kind(i) == "mark" and self.tokens[i][1] in "([{" else i + 1
        return min(i, len(self.tokens) - 1)

    def _body(self, i: int) -> tuple[int, bool]:
        """From behind a parameter list: the token that opens the body, or ends a declaration without one."""
        while i < len(self.tokens):
            if self._is(i, "{"):
                before = i - 1
                if self._is(before, ")"):
                    before = self.pair.get(before, before) - 1
                if self.tokens[before][1] not in CONTAINERS | {"error"}:
                    return i, True
            if self._is(i, ";") or self._is(i, ",") or self._kind(i) == "mark" and self.tokens[i][1] in ")]}":
                return i - 1, False
            i = self.pair.get(i, i) + 1 if self._kind(i) == "mark" and self.tokens[i][1] in "([{" else i + 1
        return len(self.tokens) - 1, False

    def _container(self, i: int) -> int | None:
        """The opening brace if a container type begins at token i."""
        while self.tokens[i][1] in ("packed", "extern") if i < len(self.tokens) else False:
            i += 1
        if i < len(self.tokens) and self.tokens[i][1] in CONTAINERS:
            i = self.pair.get(i + 1, i + 1) + 1 if self._is(i + 1, "(") else i + 1
            return i if self._is(i, "{") else None
        return None

    def _walk(self) -> None:
        stack: list[_Scope] = [_Scope(None, None)]
        for i, (kind, text, at, _) in enumerate(self.tokens):
            scope = stack[-1]
            if kind == "mark" and text == "{":
                stack.append(self.opens.get(i, scope))
            elif kind == "mark" and text == "}":
                if len(stack) > 1:
                    stack.pop()
            elif kind == "name" and text == "fn" and self._kind(i + 1) == "name" and self._is(i + 2, "("):
                self._function(i, scope)
            elif kind == "name" and text in ("const", "var") and self._kind(i + 1) == "name" and (self._is(i + 2, "=") or self._is(i + 2, ":")) and not any(self._is(i - 1, x) for x in ("]", "*", ")")):
                self._variable(i, scope)
            elif kind == "name" and text == "test" and not self._is(i - 1, "."):
                self._test(i, at, scope)
            elif kind == "name" and text in CONTAINERS and (brace := self._container(i)) is not None:
                self.opens.setdefault(brace, _Scope(None, scope.function))
            elif kind == "name" and self._is(i + 1, "(") and text not in NOT_CALLED and not self._is(i - 1, "fn"):
                self._call(i, text, scope)

    def _function(self, i: int, scope: _Scope) -> None:
        name, (end, has_body) = self.tokens[i + 1][1], self._body(self.pair.get(i + 2, i + 2) + 1)
        unit = Unit(f"{scope.container}.{name}" if scope.container else name, "function", scope.container, self._start(i), self.pair.get(end, end) if has_body else end)
        if scope.container:
            unit.edges.append(("method_of", scope.container, {}))
        self.units.append(unit)
        if has_body:
            self.opens[end] = _Scope(scope.container, unit)

    def _variable(self, i: int, scope: _Scope) -> None:
        name, end = self.tokens[i + 1][1], self._until(i + 2, ";")
        last = end - 1 if self._is(end, ";") else end
        value = self._until(i + 2, "=") + 1
        unit = Unit(name, self.tokens[i][1], scope.container, self._start(i), last)
        if value <= last and self.tokens[value][1] == "@import":
            unit.kind, unit.parent = "import", None
        elif value <= last and (brace := self._container(value)) is not None:
            unit.kind = "type"
            self.opens[brace] = _Scope(name, scope.function)
        self.units.append(unit)

    def _test(self, i: int, at: int, scope: _Scope) -> None:
        brace = i + 1 if self._is(i + 1, "{") else i + 2
        if self._is(brace, "{") and (brace == i + 1 or self._kind(i + 1) in ("text", "name")):
            self.units.append(Unit(f"test_{self._line(at) - 1}", "test", scope.container, i, self.pair.get(brace, brace)))

    def _call(self, i: int, text: str, scope: _Scope) -> None:
        if scope.function is None:
            return
        method = self._is(i - 1, ".")
        if method and not (self._kind(i - 2) in ("name", "builtin", "text", "number") and self.tokens[i - 2][1] not in NOT_CALLED or i > 1 and self.tokens[i - 2][1] in (")", "]", "}", ".?", ".*")):
            return  # a literal such as .init(x): its type is not known
        context = {"caller_container": scope.container} if scope.container else {}
        scope.function.edges.append(("calls_method" if method else "calls", text, context))


def units(source: str) -> list[Unit]:
    return Scan(source).units
