"""Go: statements end at line breaks, as the language's own rule puts semicolons."""

from __future__ import annotations

import re

from .tree import _COMMON, _DOUBLE, _NUMBER, _SINGLE, Bracketed, Node

_ENDS = set("break continue fallthrough return ++ -- ) ] }".split())
_HEADS = {"if": "if_statement", "for": "for_statement", "switch": "expression_switch_statement", "select": "select_statement"}
_SIMPLE = {"return": "return_statement", "go": "go_statement", "defer": "defer_statement", "break": "break_statement", "continue": "continue_statement", "goto": "goto_statement", "fallthrough": "fallthrough_statement"}
_SPECS = {"const": ("const_declaration", "const_spec"), "var": ("var_declaration", "var_spec")}


class Parser(Bracketed):
    STRING = "interpreted_string_literal"
    TOKEN = re.compile(rf"{_COMMON}|(?P<string>`[^`]*`?|{_DOUBLE}|{_SINGLE})|{_NUMBER}|(?P<id>[^\W\d]\w*)|(?P<op>:=|\.\.\.|<-|\+\+|--|&&|\|\||.)", re.S)

    def parse(self) -> Node:
        return self.parse_all("source_file", self.top)

    def ended(self) -> bool:
        """A line break here ends the statement."""
        if not self.peek().newline or not self.i:
            return False
        last = self.t[self.i - 1]
        return last.kind in ("id", "number", "string") or last.text in _ENDS

    def top(self) -> Node | None:
        if self.at(";"):
            return self.leaf()
        if self.at("package"):
            children = [self.word()]
            if self.peek().kind == "id":
                children.append(self.leaf("package_identifier"))
            return self.node("package_clause", children)
        if self.at("import"):
            return self.import_()
        if self.at("func") and (self.peek(1).kind == "id" or self.peek(1).text == "(" and self.receiver()):
            return self.function()
        if (d := self.declaration()) is not None:
            return d
        return self.statement()

    def receiver(self) -> bool:
        """Whether the parenthesis after ``func`` is followed by a name and another."""
        depth, k = 0, 1
        while (t := self.peek(k)).kind != "eof":
            depth += (t.text == "(") - (t.text == ")")
            k += 1
            if not depth:
                return self.peek(k).kind == "id" and self.peek(k + 1).text in ("(", "[")
        return False

    def declaration(self) -> Node | None:
        if self.at("type"):
            return self.specs("type_declaration", self.type_spec)
        if self.at("const", "var"):
            type_, spec = _SPECS[self.peek().text]
            return self.specs(type_, lambda: self.value_spec(spec))
        return None

    def import_(self) -> Node:
        children = [self.word()]
        if self.at("("):
            children.append(self.listed("import_spec_list", self.import_spec))
        elif (s := self.import_spec()) is not None:
            children.append(s)
        else:
            children.append(self.missing("string"))
        return self.node("import_declaration", children)

    def import_spec(self) -> Node | None:
        children = []
        if self.at("."):
            children.append(self.leaf("dot", "name"))
        elif self.peek().kind == "id":
            children.append(self.leaf("blank_identifier" if self.at("_") else "package_identifier", "name"))
        if self.peek().kind == "string":
            raw = self.peek().text[0] == "`"
            children.append(self.leaf("raw_string_literal" if raw else None, "path"))
        return self.node("import_spec", children) if children else None

    def listed(self, type_: str, each) -> Node:
        children = [self.leaf()]
        while self.peek().kind != "eof" and not self.at(")", "]", "}"):
            before = self.i
            s = self.leaf() if self.at(";") else each()
            if s is not None:
                children.append(s)
            if self.i == before:
                children.append(self.node("ERROR", [self.leaf()]))
        children.append(self.leaf() if self.at(")") else self.missing(")"))
        return self.node(type_, children)

    def specs(self, type_: str, each) -> Node:
        children = [self.word()]
        if self.at("("):
            listed = self.listed("list", each)
            children += listed.children
        elif (s := each()) is not None:
            children.append(s)
        else:
            children.append(self.missing("identifier"))
        return self.node(type_, children)

    def type_spec(self) -> Node | None:
        if self.peek().kind != "id":
            return None
        children = [self.leaf("type_identifier", "name")]
        if self.at("[") and self.peek(1).kind == "id" and self.peek(2).text != "]":
            children.append(self.group("type_parameter_list", "type_parameters"))
        alias = self.at("=")
        if alias:
            children.append(self.leaf())
        kind = self.type()
        if kind:
            kind[0].field_name = "type"
            children += kind
        return self.node("type_alias" if alias else "type_spec", children)

    def value_spec(self, type_: str) -> Node | None:
        children = []
        while self.peek().kind == "id":
            children.append(self.leaf("identifier", "name"))
            if not self.at(","):
                break
            children.append(self.leaf())
        if not children:
            return None
        children += self.line()
        return self.node(type_, children)

    def type(self) -> list[Node]:
        out: list[Node] = []
        while not self.ended() or not out:
            if self.at("struct") and self.peek(1).text == "{":
                out.append(self.node("struct_type", [self.word(), self.braces("field_declaration_list", self.struct_field)]))
                break
            if self.at("interface") and self.peek(1).text == "{":
                word = self.word()
                body = self.braces("interface_body_", self.element)
                out.append(self.node("interface_type", [word, *body.children]))
                break
            if self.at("func"):
                out.append(self.word())
                if self.at("("):
                    out.append(self.group("parameter_list"))
                    continue
            elif self.at("map", "chan") or self.at("*", "<-", "...", "~", "|", ".", "&"):
                out.append(self.leaf())
            elif self.at("["):
                out.append(self.group("array_type"))
            elif self.at("("):
                out.append(self.group("parameter_list"))
                break
            elif self.peek().kind in ("id", "number"):
                out.append(self.leaf("type_identifier"))
                if not self.at(".", "[", "|"):
                    break
            else:
                break
        return out

    def struct_field(self) -> Node | None:
        if self.at(";"):
            return self.leaf()
        children = []
        while self.peek().kind == "id" and self.peek(1).text == ",":
            children += [self.leaf("field_identifier", "name"), self.leaf()]
        if self.peek().kind == "id" and not self.peek(1).newline and (self.peek(1).kind == "id" or self.peek(1).text in ("*", "[", "(", "<-")):
            children.append(self.leaf("field_identifier", "name"))
        children += self.type()
        if self.peek().kind == "string" and not self.peek().newline:
            children.append(self.leaf(None, "tag"))
        return self.node("field_declaration", children) if children else None

    def element(self) -> Node | None:
        if self.at(";"):
            return self.leaf()
        if self.peek().kind == "id" and self.peek(1).text == "(":
            children = [self.leaf("field_identifier", "name"), self.group("parameter_list", "parameters")]
            if not self.ended() and not self.at("}"):
                children += self.type()
            return self.node("method_elem", children)
        kind = self.type()
        return self.node("type_elem", kind) if kind else None

    def function(self) -> Node:
        children = [self.word()]
        method = self.at("(")
        if method:
            children.append(self.group("parameter_list", "receiver"))
        children.append(self.leaf("field_identifier" if method else "identifier", "name"))
        if self.at("["):
            children.append(self.group("type_parameter_list", "type_parameters"))
        if self.at("("):
            children.append(self.group("parameter_list", "parameters"))
        else:
            children.append(self.missing("("))
        if not self.at("{") and not self.ended():
            kind = self.type()
            if kind:
                kind[0].field_name = "result"
                children += kind
        if self.at("{"):
            children.append(self.braces("block", self.statement, "body"))
        return self.node("method_declaration" if method else "function_declaration", children)

    def statement(self) -> Node | None:
        t = self.peek()
        if self.at("{"):
            return self.braces("block", self.statement)
        if self.at(";"):
            return self.leaf()
        if (d := self.declaration()) is not None:
            return d
        x = t.text if t.kind == "id" else ""
        if x in _HEADS:
            return self.compound(x)
        if x in ("case", "default"):
            return self.case()
        if x in _SIMPLE:
            word = self.word()
            return self.node(_SIMPLE[x], [word, *(self.line() if not self.ended() else [])])
        parts = self.line()
        if not parts:
            return None
        kinds = {p.type for p in parts}
        type_ = "short_var_declaration" if ":=" in kinds else "assignment_statement" if "=" in kinds else "expression_statement"
        return self.node(type_, parts)

    def line(self, *stops: str) -> list[Node]:
        """Pieces to the end of the statement; functions' braces are blocks."""
        out: list[Node] = []
        func = False
        while self.peek().kind != "eof" and not self.at(";", *stops) and not self.at(")", "]", "}"):
            if out and self.ended():
                break
            if self.at("func"):
                func = True
                out.append(self.word())
            elif self.at("{"):
                if func:
                    out.append(self.braces("block", self.statement, "body"))
                    func = False
                else:
                    out.append(self.inner())
            elif self.at("(", "["):
                out.append(self.inner())
            else:
                out.append(self.leaf())
        return out

    def inner(self) -> Node:
        first = self.peek().text
        close = {"(": ")", "[": "]", "{": "}"}[first]
        children = [self.leaf()]
        self.depth += 1
        if self.depth >= self.DEEPEST:
            children += self.flat(close)
        while self.peek().kind != "eof" and not self.at(")", "]", "}"):
            before = self.i
            children += self.line()
            if self.at(";"):
                children.append(self.leaf())
            if self.i == before:
                break
        self.depth -= 1
        children.append(self.leaf() if self.at(close) else self.missing(close))
        return self.node({"(": "argument_list", "[": "index_expression", "{": "literal_value"}[first], children)

    def compound(self, x: str) -> Node:
        children = [self.word()]
        while self.peek().kind != "eof" and not self.at("{", ")", "]", "}"):
            if self.at("func"):
                children += self.line("{")
            children.append(self.inner() if self.at("(", "[") else self.leaf())
        if self.at("{"):
            children.append(self.braces("block", self.statement, "body"))
        if x == "if" and self.at("else"):
            children.append(self.word())
            if self.at("if"):
                children.append(self.compound("if"))
            elif self.at("{"):
                children.append(self.braces("block", self.statement, "alternative"))
        return self.node(_HEADS[x], children)

    def case(self) -> Node:
        type_ = "default_case" if self.at("default") else "expression_case"
        children = [self.word(), *self.line(":")]
        if self.at(":"):
            children.append(self.leaf())
        while self.peek().kind != "eof" and not self.at("case", "default", ")", "]", "}"):
            before = self.i
            if (s := self.statement()) is not None:
                children.append(s)
            if self.i == before:
                break
        return self.node(type_, children)
