"""Python: logical lines and indentation."""

from __future__ import annotations

import re

from .tree import CLOSE, OPEN, Node, Source, adopt, insert_comments

_STRING = r"""[rRbBuUfFtT]{0,3}(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)"""
_TOKEN = re.compile(rf"(?P<nl>\n)|(?P<space>[ \t\r\f]+|\\\r?\n)|(?P<comment>\#[^\n]*)|(?P<string>{_STRING})|(?P<number>\d[\w.]*)|(?P<id>[^\W\d]\w*)|(?P<op>->|:=|\*\*|.)", re.S)
_BLOCKS = {"if": "if_statement", "for": "for_statement", "while": "while_statement", "try": "try_statement", "with": "with_statement", "match": "match_statement"}
_CLAUSES = {"elif": "elif_clause", "else": "else_clause", "except": "except_clause", "finally": "finally_clause"}
_SIMPLE = {"return": "return_statement", "raise": "raise_statement", "pass": "pass_statement", "break": "break_statement", "continue": "continue_statement", "del": "delete_statement", "global": "global_statement", "nonlocal": "nonlocal_statement", "assert": "assert_statement"}


class _Line:
    """A logical line: its indentation and tokens (kind, start, end)."""

    __slots__ = ("indent", "tokens")

    def __init__(self, indent: int):
        self.indent, self.tokens = indent, []


class Parser:
    def __init__(self, source: Source):
        self.code = source.code
        self.comments: list[Node] = []
        self.lines = self.split()
        self.i = 0

    def split(self) -> list[_Line]:
        lines: list[_Line] = []
        line, depth, pos, start = None, 0, 0, 0
        while pos < len(self.code):
            m = _TOKEN.match(self.code, pos)
            kind, end = m.lastgroup, m.end()
            if kind == "nl":
                if not depth:
                    line = None
                start = end
            elif kind == "comment":
                self.comments.append(Node("comment", pos, end))
            elif kind != "space":
                if line is None:
                    indent = len(self.code[start:pos].expandtabs(8))
                    line = _Line(indent)
                    lines.append(line)
                text = m.group()
                if kind == "op":
                    if text in OPEN:
                        depth += 1
                    elif text in CLOSE:
                        depth = max(0, depth - 1)
                elif kind == "id" and depth and pos == start + len(self.code[start:pos]) and not self.code[start:pos].strip() and text in ("def", "class") and pos - start <= line.indent:
                    depth = 0  # a bracket was left open: begin again at the declaration
                    line = _Line(len(self.code[start:pos].expandtabs(8)))
                    lines.append(line)
                line.tokens.append((kind, pos, end))
            pos = end
        return lines

    def parse(self) -> Node:
        root = Node("module", 0, len(self.code))
        while self.i < len(self.lines):
            root.children += self.statements(self.lines[self.i].indent)
        insert_comments(root, self.comments)
        return adopt(root)

    def statements(self, indent: int) -> list[Node]:
        out: list[Node] = []
        while self.i < len(self.lines) and self.lines[self.i].indent == indent:
            out += self.statement(indent)
        return out

    def text(self, t) -> str:
        return self.code[t[1] : t[2]]

    def leaf(self, t, type_: str | None = None, name: str | None = None) -> Node:
        if type_ is None:
            type_ = {"id": "identifier", "string": "string", "number": "integer"}.get(t[0], self.text(t))
        return Node(type_, t[1], t[2], [], t[0] != "op" and type_ != self.text(t), name)

    def word(self, t) -> Node:
        return Node(self.text(t), t[1], t[2], [], False)

    def pieces(self, tokens: list) -> list[Node]:
        """Bracket groups and tokens, without recursion."""
        top: list[Node] = []
        stack: list[tuple[list[Node], str]] = [(top, "")]
        for t in tokens:
            x = self.text(t) if t[0] == "op" else ""
            if x in OPEN and x:
                stack.append(([self.leaf(t)], x))
            elif x in CLOSE and x:
                if len(stack) > 1 and OPEN[stack[-1][1]] == x:
                    children, o = stack.pop()
                    children.append(self.leaf(t))
                    stack[-1][0].append(self.node({"(": "parenthesized_expression", "[": "list", "{": "dictionary"}[o], children))
                else:
                    stack[-1][0].append(self.node("ERROR", [self.leaf(t)]))
            else:
                stack[-1][0].append(self.leaf(t))
        while len(stack) > 1:
            children, o = stack.pop()
            at = children[-1].end
            children.append(Node(OPEN[o], at, at, [], False, None, None, True))
            stack[-1][0].append(self.node({"(": "parenthesized_expression", "[": "list", "{": "dictionary"}[o], children))
        return top

    @staticmethod
    def node(type_: str, children: list[Node], name: str | None = None) -> Node:
        return Node(type_, children[0].start, children[-1].end, children, True, name)

    def colon(self, tokens: list) -> int:
        """Index of the colon that opens a block, or -1."""
        depth = lambdas = 0
        for k, t in enumerate(tokens):
            x = self.text(t)
            if t[0] == "op" and x in OPEN:
                depth += 1
            elif t[0] == "op" and x in CLOSE:
                depth -= 1
            elif t[0] == "id" and x == "lambda":
                lambdas += 1
            elif t[0] == "op" and x == ":" and depth <= 0:
                if not lambdas:
                    return k
                lambdas -= 1
        return -1

    def body(self, head: list[Node], rest: list, indent: int) -> None:
        """Append the block after a colon: on the same line, or indented below."""
        if rest:
            block = self.simple(rest)
        elif self.i < len(self.lines) and self.lines[self.i].indent > indent:
            block = []
            while self.i < len(self.lines) and self.lines[self.i].indent > indent:
                block += self.statements(self.lines[self.i].indent)
        else:
            block = []
        at = head[-1].end
        head.append(self.node("block", block, "body") if block else Node("block", at, at, [], True, "body", None, False))

    def statement(self, indent: int) -> list[Node]:
        tokens = self.lines[self.i].tokens
        x = self.text(tokens[0]) if tokens[0][0] in ("id", "op") else ""
        if x == "@":
            return [self.decorated(indent)]
        second = self.text(tokens[1]) if len(tokens) > 1 else ""
        if x in ("def", "class") or x == "async" and second == "def":
            return [self.definition(indent)]
        if x in _BLOCKS or x == "async" and second in ("for", "with"):
            k = self.colon(tokens)
            soft = x == "match" and (k < 0 or k + 1 < len(tokens) or second in ("=", ".", ":", ")", ","))
            if not soft:
                return [self.compound(indent)]
        self.i += 1
        return self.simple(tokens)

    def compound(self, indent: int) -> Node:
        tokens = self.lines[self.i].tokens
        x = self.text(tokens[0])
        key = self.text(tokens[1]) if x == "async" else x
        children = self.clause(tokens, indent, lead=1 + (x == "async"))
        while self.i < len(self.lines) and self.lines[self.i].indent == indent:
            t = self.lines[self.i].tokens
            w = self.text(t[0]) if t[0][0] == "id" else ""
            if w not in _CLAUSES:
                break
            children.append(self.node(_CLAUSES[w], self.clause(t, indent)))
        return self.node(_BLOCKS[key], children)

    def clause(self, tokens: list, indent: int, lead: int = 1) -> list[Node]:
        self.i += 1
        k = self.colon(tokens)
        head = [self.word(t) for t in tokens[:lead]]
        if k < 0:
            head += self.pieces(tokens[lead:])
            head.append(Node(":", head[-1].end, head[-1].end, [], False, None, None, True))
            self.body(head, [], indent)
            return head
        head += self.pieces(tokens[lead:k])
        head.append(self.leaf(tokens[k]))
        self.body(head, tokens[k + 1 :], indent)
        return head

    def decorated(self, indent: int) -> Node:
        children = []
        while self.i < len(self.lines) and self.lines[self.i].indent == indent and self.text(self.lines[self.i].tokens[0]) == "@":
            tokens = self.lines[self.i].tokens
            self.i += 1
            children.append(self.node("decorator", [self.leaf(tokens[0]), *self.pieces(tokens[1:])]))
        if self.i < len(self.lines) and self.lines[self.i].indent == indent:
            t = self.lines[self.i].tokens
            if self.text(t[0]) in ("def", "class", "async"):
                d = self.definition(indent)
                d.field_name = "definition"
                return self.node("decorated_definition", [*children, d])
        return self.node("ERROR", children)

    def definition(self, indent: int) -> Node:
        tokens = self.lines[self.i].tokens
        self.i += 1
        children, k = [], 0
        if self.text(tokens[0]) == "async":
            children.append(self.word(tokens[0]))
            k = 1
        type_ = "class_definition" if self.text(tokens[k]) == "class" else "function_definition"
        children.append(self.word(tokens[k]))
        k += 1
        if k < len(tokens) and tokens[k][0] == "id":
            children.append(self.leaf(tokens[k], "identifier", "name"))
            k += 1
        else:
            at = children[-1].end
            children.append(Node("identifier", at, at, [], True, None, None, True))
        colon = self.colon(tokens[k:])
        head = tokens[k : k + colon] if colon >= 0 else tokens[k:]
        arrow = next((j for j, t in enumerate(head) if t[0] == "op" and self.text(t) == "->"), -1)
        for p in self.pieces(head if arrow < 0 else head[:arrow]):
            if p.type == "parenthesized_expression":
                p.type, p.field_name = ("parameters", "parameters") if type_ == "function_definition" else ("argument_list", "superclasses")
            elif p.type == "list":
                p.type, p.field_name = "type_parameter", "type_parameters"
            children.append(p)
        if arrow >= 0:
            children.append(self.leaf(head[arrow]))
            kind = self.pieces(head[arrow + 1 :])
            if kind:
                children.append(self.node("type", kind, "return_type"))
        if colon >= 0:
            children.append(self.leaf(tokens[k + colon]))
            self.body(children, tokens[k + colon + 1 :], indent)
        else:
            at = children[-1].end
            children.append(Node(":", at, at, [], False, None, None, True))
            self.body(children, [], indent)
        if children[-1].type == "block" and not children[-1].children:
            children.pop()
        return self.node(type_, children)

    def simple(self, tokens: list) -> list[Node]:
        """Statements of one logical line, divided by semicolons."""
        out, part, depth = [], [], 0
        for t in [*tokens, None]:
            x = self.text(t) if t else ";"
            if t and t[0] == "op":
                depth += (x in OPEN) - (x in CLOSE)
            if x == ";" and (t is None or t[0] == "op" and depth <= 0):
                if part:
                    out.append(self.one(part))
                if t:
                    out.append(self.leaf(t))
                part = []
            else:
                part.append(t)
        return out

    def one(self, tokens: list) -> Node:
        x = self.text(tokens[0]) if tokens[0][0] == "id" else ""
        if x == "import":
            return self.node("import_statement", [self.word(tokens[0]), *self.names(tokens[1:])])
        if x == "from" and any(self.text(t) == "import" for t in tokens):
            k = next(j for j, t in enumerate(tokens) if self.text(t) == "import")
            future = len(tokens) > 1 and self.text(tokens[1]) == "__future__"
            children = [self.word(tokens[0])]
            if k > 1:
                dots = self.text(tokens[1]) == "."
                children.append(Node("relative_import" if dots else "dotted_name", tokens[1][1], tokens[k - 1][2], [self.leaf(t) for t in tokens[1:k]], True, "module_name"))
            children += [self.word(tokens[k]), *self.names(tokens[k + 1 :])]
            return self.node("future_import_statement" if future else "import_from_statement", children)
        if x in _SIMPLE:
            return self.node(_SIMPLE[x], [self.word(tokens[0]), *self.pieces(tokens[1:])])
        parts = self.pieces(tokens)
        if len(parts) == 1 and parts[0].type == "string" or all(p.type == "string" for p in parts):
            inner = parts[0] if len(parts) == 1 else self.node("concatenated_string", parts)
        elif any(p.type == "=" for p in parts):
            inner = self.node("assignment", parts)
        else:
            inner = self.node("call" if parts[-1].type == "parenthesized_expression" and len(parts) > 1 else "expression", parts)
        return self.node("expression_statement", [inner])

    def names(self, tokens: list) -> list[Node]:
        out: list[Node] = []
        part: list = []
        for t in [*tokens, None]:
            x = self.text(t) if t else ","
            if x in (",", "(", ")") and (t is None or t[0] == "op"):
                if part:
                    k = next((j for j, p in enumerate(part) if self.text(p) == "as"), -1)
                    if self.text(part[0]) == "*":
                        out.append(self.node("wildcard_import", [self.leaf(part[0])]))
                    elif k > 0 and k + 1 < len(part):
                        name = self.node("dotted_name", [self.leaf(p) for p in part[:k]], "name")
                        out.append(self.node("aliased_import", [name, self.word(part[k]), self.leaf(part[k + 1], None, "alias")], "name"))
                    else:
                        out.append(self.node("dotted_name", [self.leaf(p) for p in part], "name"))
                if t:
                    out.append(self.leaf(t))
                part = []
            else:
                part.append(t)
        return out
