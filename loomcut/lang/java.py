"""Java."""

from __future__ import annotations

import re

from .tree import _COMMON, _DOUBLE, _NUMBER, _SINGLE, Bracketed, Node

_MODIFIERS = set("public protected private static final abstract default synchronized native strictfp transient volatile sealed".split())
_TYPES = {"class": ("class_declaration", "class_body"), "interface": ("interface_declaration", "interface_body"), "enum": ("enum_declaration", "enum_body"), "record": ("record_declaration", "class_body")}
_HEADS = {"if": "if_statement", "for": "for_statement", "while": "while_statement", "switch": "switch_expression", "synchronized": "synchronized_statement", "try": "try_statement", "do": "do_statement"}


class Parser(Bracketed):
    LINE_COMMENT, BLOCK_COMMENT, STRING = "line_comment", "block_comment", "string_literal"
    TOKEN = re.compile(rf'{_COMMON}|(?P<string>"""(?:[^\\]|\\.)*?(?:"""|\Z)|{_DOUBLE}|{_SINGLE})|{_NUMBER}|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>->|::|\.\.\.|.)', re.S)

    def parse(self) -> Node:
        return self.parse_all("program", self.top)

    def top(self) -> Node | None:
        if self.at("package", "import"):
            type_ = "package_declaration" if self.at("package") else "import_declaration"
            children = [self.word()]
            if self.at("static"):
                children.append(self.word())
            children += self.dotted()
            if self.at(";"):
                children.append(self.leaf())
            return self.node(type_, children)
        return self.member("program")

    def dotted(self) -> list[Node]:
        parts, star = [], []
        while self.peek().kind == "id":
            parts.append(self.leaf())
            if not self.at("."):
                break
            if self.peek(1).text == "*":
                star = [self.leaf(), self.node("asterisk", [self.leaf()])]
                break
            parts.append(self.leaf())
        if len(parts) > 1:
            parts = [self.node("scoped_identifier", parts)]
        return parts + star

    def modifiers(self) -> list[Node]:
        out = []
        while True:
            if self.at("@") and self.peek(1).text != "interface":
                a = [self.leaf(), *self.dotted()]
                if self.at("("):
                    a.append(self.group("annotation_argument_list", "arguments"))
                out.append(self.node("annotation" if a[-1].type == "annotation_argument_list" else "marker_annotation", a))
            elif self.at(*_MODIFIERS) and not (self.at("default", "synchronized") and self.peek(1).text in (":", "->", "(")):
                out.append(self.word())
            elif self.at("non") and self.peek(1).text == "-":
                out += [self.leaf(), self.leaf(), self.leaf()]
            else:
                return [self.node("modifiers", out)] if out else []

    def member(self, where: str) -> Node | None:
        if self.at(";"):
            return self.leaf()
        if self.at("{"):
            return self.braces("block", self.statement)
        if self.at("static") and self.peek(1).text == "{":
            return self.node("static_initializer", [self.word(), self.braces("block", self.statement)])
        head = self.modifiers()
        if self.at("@") and self.peek(1).text == "interface":
            children = [*head, Node("@interface", self.peek().start, self.peek(1).end, [], False)]
            self.i += 2
            children.append(self.leaf("identifier", "name"))
            if self.at("{"):
                children.append(self.braces("annotation_type_body", lambda: self.member("annotation"), "body"))
            return self.node("annotation_type_declaration", children)
        if self.at(*_TYPES) and self.peek(1).kind == "id":
            return self.type_declaration(head)
        children = list(head)
        if self.at("<"):
            children.append(self.angles("type_parameters", "type_parameters"))
        if self.peek().kind == "id" and self.peek(1).text == "(" and self.peek(1).kind == "op":
            children += [self.leaf("identifier", "name"), self.group("formal_parameters", "parameters")]
            self.throws(children)
            if self.at("{"):
                children.append(self.braces("constructor_body", self.statement, "body"))
            return self.node("constructor_declaration", children)
        if self.peek().kind == "id" and self.peek(1).text == "{" and where == "record":
            return self.node("compact_constructor_declaration", [*children, self.leaf("identifier", "name"), self.braces("block", self.statement, "body")])
        kind = self.type()
        if kind is None:
            return self.node("ERROR", children + (self.until(";", "{") or [self.leaf()] if not self.at("}") else [])) if children or not self.at("}") else None
        kind.field_name = "type"
        children.append(kind)
        if self.peek().kind == "id" and self.peek(1).text == "(":
            children += [self.leaf("identifier", "name"), self.group("formal_parameters", "parameters")]
            while self.at("["):
                children.append(self.group("dimensions"))
            self.throws(children)
            if where == "annotation":
                children += self.until(";")
                if self.at(";"):
                    children.append(self.leaf())
                return self.node("annotation_type_element_declaration", children)
            if self.at("{"):
                children.append(self.braces("block", self.statement, "body"))
            elif self.at(";"):
                children.append(self.leaf())
            else:
                children.append(self.missing(";"))
            return self.node("method_declaration", children)
        return self.variables("field_declaration", children)

    def throws(self, children: list[Node]) -> None:
        if self.at("throws"):
            children.append(self.node("throws", [self.word(), *self.until("{", ";")]))

    def variables(self, type_: str, children: list[Node]) -> Node:
        while self.peek().kind == "id":
            one = [self.leaf("identifier", "name")]
            while self.at("["):
                one.append(self.group("dimensions"))
            if self.at("="):
                one += [self.leaf(), *self.expression(",")]
            children.append(self.node("variable_declarator", one, "declarator"))
            if not self.at(","):
                break
            children.append(self.leaf())
        if self.at(";"):
            children.append(self.leaf())
        else:
            rest = self.until(";", "{")
            children.append(self.node("ERROR", rest) if rest else self.missing(";"))
            if self.at(";"):
                children.append(self.leaf())
        return self.node(type_, children)

    def type(self) -> Node | None:
        parts = []
        while self.at("@"):
            parts += [self.leaf(), *self.dotted()]
        if self.peek().kind != "id":
            return self.node("ERROR", parts) if parts else None
        parts.append(self.leaf("type_identifier"))
        while True:
            if self.at("<"):
                parts.append(self.angles("type_arguments"))
            elif self.at(".") and self.peek(1).kind == "id":
                parts += [self.leaf(), self.leaf("type_identifier")]
            elif self.at("[") and self.peek(1).text == "]":
                parts.append(self.group("dimensions"))
            elif self.at("..."):
                parts.append(self.leaf())
            else:
                break
        return parts[0] if len(parts) == 1 else self.node("generic_type", parts)

    def type_declaration(self, head: list[Node]) -> Node:
        type_, body = _TYPES[self.peek().text]
        record = self.at("record")
        children = [*head, self.word(), self.leaf("identifier", "name")]
        if self.at("<"):
            children.append(self.angles("type_parameters", "type_parameters"))
        if self.at("("):
            children.append(self.group("formal_parameters", "parameters"))
        while self.at("extends", "implements", "permits"):
            w = self.word()
            part = [w]
            while self.peek().kind != "eof" and not self.at("{", "extends", "implements", "permits", ";", "}", ")"):
                part.append(self.angles("type_arguments") if self.at("<") else self.piece())
            children.append(self.node({"extends": "superclass", "implements": "super_interfaces", "permits": "permits"}[w.type], part))
        if not self.at("{"):
            children.append(self.missing("{"))
        elif type_ == "enum_declaration":
            children.append(self.braces("enum_body", self.constant, "body"))
        else:
            children.append(self.braces(body, lambda: self.member("record" if record else "class"), "body"))
        return self.node(type_, children)

    def constant(self) -> Node | None:
        """Constants, and after a semicolon the members."""
        if self.at(","):
            return self.leaf()
        if self.at(";"):
            children = [self.leaf()]
            while self.peek().kind != "eof" and not self.at("}"):
                before = self.i
                if (m := self.member("class")) is not None:
                    children.append(m)
                if self.i == before:
                    children.append(self.node("ERROR", [self.leaf()]))
            return self.node("enum_body_declarations", children)
        children = self.modifiers()
        if self.peek().kind != "id":
            return self.node("ERROR", children or [self.leaf()])
        children.append(self.leaf("identifier", "name"))
        if self.at("("):
            children.append(self.group("argument_list", "arguments"))
        if self.at("{"):
            children.append(self.braces("class_body", lambda: self.member("class"), "body"))
        return self.node("enum_constant", children)

    def statement(self) -> Node | None:
        t, nxt = self.peek(), self.peek(1)
        if self.at("{"):
            return self.braces("block", self.statement)
        if self.at(";"):
            return self.leaf()
        if t.kind == "id" and t.text in _HEADS and nxt.text in ("(", "{") or self.at("do", "try"):
            return self.compound(t.text)
        if self.at("final", "abstract", "static") or self.at("@") and nxt.text != "interface" or self.at(*_TYPES) and nxt.kind == "id" and self.peek(2).text in ("{", "extends", "implements", "<", "("):
            at = self.i
            head = self.modifiers()
            if self.at(*_TYPES) and self.peek(1).kind == "id":
                return self.type_declaration(head)
            self.i = at
        children = self.expression()
        if self.at(";"):
            children.append(self.leaf())
        if not children:
            return None
        first = children[0].type if not children[0].named else ""
        kind = {"return": "return_statement", "throw": "throw_statement", "break": "break_statement", "continue": "continue_statement"}.get(t.text)
        local = len(children) > 2 and children[0].type == "identifier" and children[1].type == "identifier"
        return self.node(kind or ("local_variable_declaration" if local else "expression_statement"), children) if first is not None else None

    def expression(self, *stops: str) -> list[Node]:
        """Pieces up to ``;`` or a closer; braces after ``->`` are blocks, after ``)`` class bodies."""
        out: list[Node] = []
        while self.peek().kind != "eof" and not self.at(";", *stops) and not self.at(")", "]", "}"):
            last = self.t[self.i - 1].text if out else ""
            if self.at("{") and last == "->":
                out.append(self.braces("block", self.statement))
            elif self.at("{") and last == ")" and any(n.type == "new" for n in out):
                out.append(self.braces("class_body", lambda: self.member("class")))
            elif self.at("{") and out and last not in ("]", "=", ","):
                out.append(self.braces("block", self.statement))
                if not self.at(".", ")"):
                    return out
            elif self.at("(", "[", "{"):
                out.append(self.inner())
            else:
                n = self.leaf()
                if n.type == "identifier" and self.code[n.start : n.end] in ("new", "return", "throw", "break", "continue"):
                    n.type, n.named = self.code[n.start : n.end], False
                out.append(n)
        return out

    def inner(self) -> Node:
        first = self.peek().text
        close = {"(": ")", "[": "]", "{": "}"}[first]
        children = [self.leaf()]
        self.depth += 1
        if self.depth >= self.DEEPEST:
            children += self.flat(close)
        while self.peek().kind != "eof" and not self.at(")", "]", "}"):
            children += self.expression()
            if self.at(";"):
                children.append(self.leaf())
        self.depth -= 1
        children.append(self.leaf() if self.at(close) else self.missing(close))
        return self.node({"(": "argument_list", "[": "array_access", "{": "array_initializer"}[first], children)

    def compound(self, x: str) -> Node:
        children = [self.word()]
        if x == "do":
            children += [s for s in [self.statement()] if s]
            if self.at("while"):
                children.append(self.word())
                children += self.expression()
                if self.at(";"):
                    children.append(self.leaf())
            return self.node("do_statement", children)
        if self.at("("):
            children.append(self.inner())
        if x == "switch" and self.at("{"):
            children.append(self.braces("switch_block", self.statement, "body"))
        elif not self.at(")", "]", "}"):
            children += [s for s in [self.statement()] if s]
        if x == "if" and self.at("else"):
            children.append(self.word())
            children += [s for s in [self.statement() if not self.at(")", "]", "}") else None] if s]
        while x == "try" and self.at("catch", "finally"):
            part = [self.word()]
            if self.at("("):
                part.append(self.group("catch_formal_parameter"))
            if self.at("{"):
                part.append(self.braces("block", self.statement, "body"))
            children.append(self.node(part[0].type + "_clause", part))
        return self.node(_HEADS[x], children)
