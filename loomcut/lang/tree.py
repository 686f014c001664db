"""Nodes, tokens and the machinery that the parsers of bracketed languages share."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field


@dataclass(eq=False, slots=True)
class Node:
    """A syntax node over ``[start, end)`` of the code, in code points."""

    type: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    named: bool = True
    field_name: str | None = None
    parent: Node | None = None
    missing: bool = False

    @property
    def named_children(self) -> list[Node]:
        return [c for c in self.children if c.named]

    def child(self, name: str) -> Node | None:
        return next((c for c in self.children if c.field_name == name), None)

    def walk(self):
        """The node and all below it, parents first, without recursion."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))


@dataclass(frozen=True)
class ParseError:
    message: str
    recoverable: bool = True


class Source:
    """Code with its line starts."""

    def __init__(self, code: str):
        self.code = code
        self.lines = [0, *(m.end() for m in re.finditer("\n", code))]

    def row(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at) - 1

    def text(self, n: Node) -> str:
        return self.code[n.start : n.end]

    def error(self, root: Node) -> ParseError | None:
        bad = [n for n in root.walk() if n.type == "ERROR" or n.missing]
        if not bad:
            return None
        say = [f"{'MISSING' if n.missing else 'ERROR'} at line {self.row(n.start) + 1}, column {n.start - self.lines[self.row(n.start)] + 1}" for n in bad]
        message = "; ".join(say[:3]) + (f"; ... and {len(say) - 3} more" if len(say) > 3 else "")
        return ParseError(message)


def adopt(node: Node) -> Node:
    """Set parents below ``node``."""
    stack = [node]
    while stack:
        n = stack.pop()
        for c in n.children:
            c.parent = n
            stack.append(c)
    return node


def insert_comments(root: Node, comments: list[Node]) -> None:
    """Put each comment into the deepest inner node around it."""
    starts: dict[int, list[int] | None] = {}  # of a node's children, where these lie one after another
    found: dict[int, tuple[Node, list[tuple[int, int, Node]]]] = {}
    around = lambda k, c: k.children and k.start < c.start and c.end < k.end
    for c in comments:
        n = root
        while True:
            if id(n) not in starts:
                in_line = all(a.end <= b.start for a, b in zip(n.children, n.children[1:]))
                starts[id(n)] = [k.start for k in n.children] if in_line else None
            at = starts[id(n)]
            if at is None:
                below = next((k for k in n.children if around(k, c)), None)
            else:
                i = bisect.bisect_left(at, c.start)
                below = n.children[i - 1] if i and around(n.children[i - 1], c) else None
            if below is None:
                break
            n = below
        if at is None:
            i = next((i for i, k in enumerate(n.children) if k.start > c.start or k.start == c.start and k.end > k.start), len(n.children))
        else:
            while i < len(at) and at[i] == c.start and n.children[i].end == c.start:
                i += 1
        found.setdefault(id(n), (n, []))[1].append((i, c.start, c))
    for n, new in found.values():
        new.sort(key=lambda x: x[:2])
        children, done = [], 0
        for i, _, c in new:
            children += n.children[done:i]
            children.append(c)
            done = i
        n.children = children + n.children[done:]


@dataclass(slots=True)
class Token:
    kind: str  # id, number, string, op, markup, markup_end
    start: int
    end: int
    text: str
    newline: bool  # a line break lies before it


OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_OPAQUE = ("string", "markup", "markup_end", "eof")
GROUPS = {"(": "parenthesized_expression", "[": "array", "{": "object"}


class Bracketed:
    """Recursive descent over tokens; comments are put back afterwards.

    Nesting is as deep as the code's: frames of Python functions take no C
    stack.  Beyond ``DEEPEST`` levels, which no recursion limit would hold, a
    group's content stays flat.
    """

    DEEPEST = 50_000
    TOKEN: re.Pattern
    LINE_COMMENT = BLOCK_COMMENT = "comment"
    NESTED_COMMENTS = False
    STRING = "string"

    def __init__(self, source: Source):
        self.s = source
        self.code = source.code
        self.comments: list[Node] = []
        self.t = self.tokenize()
        self.i = 0
        self.depth = 0
        self.eof = Token("eof", len(self.code), len(self.code), "", True)

    # tokens

    def regex_allowed(self, last: Token | None) -> bool:
        return False

    def tokenize(self) -> list[Token]:
        out: list[Token] = []
        self.scan(0, True, out, False)
        return out

    def scan(self, pos: int, newline: bool, out: list[Token], braced: bool) -> int:
        """Tokens from ``pos`` to the end or, if ``braced``, to the brace that closes one opened before; returns where that is."""
        n, depth = len(self.code), 0
        match = self.TOKEN.match
        while pos < n:
            m = match(self.code, pos)
            kind = m.lastgroup
            text = m.group()
            end = m.end()
            if kind == "space":
                newline |= "\n" in text
            elif kind == "line":
                self.comments.append(Node(self.LINE_COMMENT, pos, end))
            elif kind == "block":
                if self.NESTED_COMMENTS:
                    end = self._nested(pos)
                newline |= "\n" in self.code[pos:end]
                self.comments.append(Node(self.BLOCK_COMMENT, pos, end))
            elif kind == "slash":
                if self.regex_allowed(out[-1] if out else None) and (r := _REGEX.match(self.code, pos)):
                    kind, end = "string", r.end()
                else:
                    kind = "op"
                out.append(Token(kind, pos, end, self.code[pos:end], newline))
                newline = False
            elif kind == "tick":
                end = self.template(pos)
                out.append(Token("string", pos, end, self.code[pos:end], newline))
                newline = False
            elif kind == "op" and text == "<" and (after := self.markup(pos, newline, out)):
                end, newline = after, False
            else:
                if braced and kind == "op":
                    depth += (text == "{") - (text == "}")
                    if depth < 0:
                        return pos
                out.append(Token(kind, pos, end, text, newline))
                newline = False
            pos = end
        return n

    def markup(self, pos: int, newline: bool, out: list[Token]) -> int:
        """End of the markup that begins at ``pos``, its tokens added to ``out``; 0 if there is none."""
        return 0

    def _nested(self, pos: int) -> int:
        depth = 0
        for m in re.compile(r"/\*|\*/").finditer(self.code, pos):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                return m.end()
        return len(self.code)

    def template(self, pos: int) -> int:
        """End of a backtick string, with its nested expressions."""
        i, n, stack = pos + 1, len(self.code), ["`"]
        while i < n and stack:
            c = self.code[i]
            if stack[-1] == "`":
                if c == "\\":
                    i += 1
                elif c == "`":
                    stack.pop()
                elif c == "$" and self.code.startswith("${", i):
                    stack.append("{")
                    i += 1
            elif c == "`":
                stack.append("`")
            elif c == "{":
                stack.append("{")
            elif c == "}":
                stack.pop()
            i += 1
        return min(i, n)

    # cursor

    def peek(self, k: int = 0) -> Token:
        return self.t[self.i + k] if self.i + k < len(self.t) else self.eof

    def at(self, *texts: str) -> bool:
        t = self.peek()
        return t.text in texts and t.kind not in _OPAQUE

    def leaf(self, type_: str | None = None, name: str | None = None) -> Node:
        t = self.peek()
        if t.kind == "eof":
            return self.missing(type_ or "token")
        self.i += 1
        if type_ is None:
            type_ = {"id": "identifier", "number": "number", "string": self.STRING, "markup": "jsx_text", "markup_end": "jsx_text"}.get(t.kind, t.text)
        return Node(type_, t.start, t.end, [], type_ != t.text or t.kind in ("number", "string"), name)

    def word(self, name: str | None = None) -> Node:
        """A keyword: an anonymous token."""
        n = self.leaf(self.peek().text, name)
        n.named = False
        return n

    def missing(self, text: str) -> Node:
        at = self.t[self.i - 1].end if self.i else 0  # where the last token ends
        return Node(text, at, at, [], False, None, None, True)

    def node(self, type_: str, children: list[Node], name: str | None = None) -> Node:
        return Node(type_, children[0].start, children[-1].end, children, True, name)

    def parse_all(self, root_type: str, statement) -> Node:
        root = Node(root_type, 0, len(self.code), self.many(statement, ""))
        insert_comments(root, self.comments)
        return adopt(root)

    def many(self, statement, close: str) -> list[Node]:
        """Statements up to ``close`` (which stays); stray closers become ERROR nodes."""
        out = []
        while self.peek().kind != "eof" and not (close and self.at(close)):
            if self.at(")", "]", "}"):
                out.append(self.node("ERROR", [self.leaf()]))
                continue
            before = self.i
            n = statement()
            if n is not None:
                out.append(n)
            if self.i == before:
                out.append(self.node("ERROR", [self.leaf()]))
        return out

    def braces(self, type_: str, statement, name: str | None = None) -> Node:
        """A ``{...}`` block of statements."""
        children = [self.leaf()]
        self.depth += 1
        children += self.many(statement, "}") if self.depth < self.DEEPEST else self.flat("}")
        self.depth -= 1
        children.append(self.leaf() if self.at("}") else self.missing("}"))
        return self.node(type_, children, name)

    def flat(self, close: str) -> list[Node]:
        out, open_ = [], 0
        while self.peek().kind != "eof":
            if self.at(*OPEN):
                open_ += 1
            elif self.at(*CLOSE):
                if not open_:
                    break
                open_ -= 1
            out.append(self.leaf())
        return out

    def group(self, type_: str | None = None, name: str | None = None) -> Node:
        """A bracket group with whatever it holds."""
        first = self.peek().text
        children = [self.leaf()]
        close = OPEN[first]
        self.depth += 1
        if self.depth >= self.DEEPEST:
            children += self.flat(close)
        else:
            while self.peek().kind != "eof" and not self.at(close):
                if self.at(*CLOSE):
                    break
                children.append(self.piece())
        self.depth -= 1
        children.append(self.leaf() if self.at(close) else self.missing(close))
        return self.node(type_ or GROUPS[first], children, name)

    def piece(self) -> Node:
        """One element of an expression: a group or a token."""
        return self.group() if self.at(*OPEN) else self.leaf()

    def angles(self, type_: str, name: str | None = None) -> Node:
        """A ``<...>`` list of types."""
        children, depth = [self.leaf()], 1
        while depth and self.peek().kind != "eof" and not self.at(";", ")", "]", "}"):
            if self.at("<"):
                depth += 1
            elif self.at(">"):
                depth -= 1
            children.append(self.piece())
        return self.node(type_, children, name)

    def until(self, *stops: str) -> list[Node]:
        """Pieces up to one of ``stops`` or a closer."""
        out = []
        while self.peek().kind != "eof" and not self.at(*stops) and not self.at(*CLOSE):
            out.append(self.piece())
        return out


_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_COMMON = r"(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*(?:[^*]|\*(?!/))*+(?:\*/)?)"
_NUMBER = r"(?P<number>\d[\w.]*)"
_DOUBLE = r'"(?:[^"\\\n]|\\.)*"?'
_SINGLE = r"'(?:[^'\\\n]|\\.)*'?"
