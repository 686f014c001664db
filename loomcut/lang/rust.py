"""Rust."""

from __future__ import annotations

import re

from .tree import _COMMON, _NUMBER, Bracketed, Node

_HEADS = {"if": "if_expression", "while": "while_expression", "for": "for_expression", "loop": "loop_expression", "match": "match_expression", "unsafe": "unsafe_block", "async": "async_block"}


class Parser(Bracketed):
    LINE_COMMENT, BLOCK_COMMENT, STRING = "line_comment", "block_comment", "string_literal"
    NESTED_COMMENTS = True
    TOKEN = re.compile(
        rf"""{_COMMON}|(?P<string>[bc]?r(\#*)".*?(?:"\5|\Z)|[bc]?"(?:[^"\\]|\\.)*"?|b?'(?:[^'\\\n]|\\(?:x..|u\{{[^}}]*\}}|.))')|{_NUMBER}|(?P<id>(?:r\#)?[^\W\d]\w*|'[^\W\d]\w*)|(?P<op>->|=>|::|\.\.=|\.\.\.|\.\.|&&|\|\||.)""", re.S
    )

    def parse(self) -> Node:
        return self.parse_all("source_file", self.item_or_statement)

    def attribute(self) -> Node:
        inner = self.peek(1).text == "!"
        children = [self.leaf()]
        if inner:
            children.append(self.leaf())
        if self.at("["):
            children.append(self.group("attribute"))
        return self.node("inner_attribute_item" if inner else "attribute_item", children)

    def item_or_statement(self) -> Node | None:
        if self.at("#") and self.peek(1).text in ("[", "!"):
            return self.attribute()
        if self.at(";"):
            return self.node("empty_statement", [self.leaf()])
        if (item := self.item()) is not None:
            return item
        return self.statement()

    def item(self) -> Node | None:
        start = self.i
        head: list[Node] = []
        if self.at("pub") or self.at("crate") and self.peek(1).text not in ("::",):
            vis = [self.leaf("pub") if self.at("pub") else self.word()]
            vis[0].named = False
            if self.at("(") and self.peek(1).text in ("crate", "super", "self", "in"):
                vis.append(self.group("visibility_scope"))
            head.append(self.node("visibility_modifier", vis))
        k = 0
        while self.peek(k).text in ("async", "unsafe", "const", "extern", "default") or self.peek(k).kind == "string" and k and self.peek(k - 1).text == "extern":
            k += 1
        x = self.peek(k).text if self.peek(k).kind == "id" else ""
        if x == "fn":
            mods = [self.leaf() if self.peek().kind == "string" else self.word() for _ in range(k)]
            if mods:
                head.append(self.node("function_modifiers", mods))
            return self.function(head)
        if x in ("impl", "trait") and all(self.peek(j).text in ("unsafe", "default") for j in range(k)):
            head += [self.word() for _ in range(k)]
            return self.block_item(x, head)
        x, nxt = (self.peek().text if self.peek().kind == "id" else ""), self.peek(1)
        if x == "use":
            children = [*head, self.word()]
            tree = self.use_tree()
            if tree is not None:
                tree.field_name = "argument"
                children.append(tree)
            else:
                children.append(self.missing("identifier"))
            if self.at(";"):
                children.append(self.leaf())
            else:
                children.append(self.missing(";"))
            return self.node("use_declaration", children)
        if x in ("struct", "enum", "union") and nxt.kind == "id":
            return self.data(x, head)
        if x == "mod" and nxt.kind == "id":
            children = [*head, self.word(), self.leaf("identifier", "name")]
            children.append(self.braces("declaration_list", self.item_or_statement, "body") if self.at("{") else self.leaf() if self.at(";") else self.missing(";"))
            return self.node("mod_item", children)
        if x == "type" and nxt.kind == "id":
            return self.to_semicolon("type_item", [*head, self.word(), self.leaf("type_identifier", "name")])
        if x in ("const", "static") and (nxt.kind == "id") and nxt.text not in ("fn", "unsafe", "async", "extern"):
            children = [*head, self.word()]
            if self.at("mut"):
                children.append(self.word())
            children.append(self.leaf("identifier", "name"))
            return self.to_semicolon("const_item" if x == "const" else "static_item", children)
        if x == "extern" and (nxt.text == "{" or nxt.kind == "string" and self.peek(2).text == "{"):
            children = [*head, self.word()]
            if self.peek().kind == "string":
                children.append(self.leaf())
            children.append(self.braces("declaration_list", self.item_or_statement, "body"))
            return self.node("foreign_mod_item", children)
        if x == "extern" and nxt.text == "crate":
            return self.to_semicolon("extern_crate_declaration", [*head, self.word(), self.word()])
        if x == "macro_rules" and nxt.text == "!":
            children = [*head, self.word(), self.leaf()]
            if self.peek().kind == "id":
                children.append(self.leaf("identifier", "name"))
            if self.at("{", "("):
                children.append(self.group("token_tree"))
            if self.at(";"):
                children.append(self.leaf())
            return self.node("macro_definition", children)
        self.i = start
        return None

    def to_semicolon(self, type_: str, children: list[Node]) -> Node:
        while self.peek().kind != "eof" and not self.at(";", "}", ")", "]"):
            children.append(self.angles("type_parameters") if self.at("<") and children[-1].field_name == "name" else self.braces("block", self.item_or_statement) if self.at("{") else self.piece())
        children.append(self.leaf() if self.at(";") else self.missing(";"))
        return self.node(type_, children)

    def function(self, head: list[Node]) -> Node:
        children = [*head, self.word()]
        if self.peek().kind == "id":
            children.append(self.leaf("identifier", "name"))
        else:
            children.append(self.missing("identifier"))
        if self.at("<"):
            children.append(self.angles("type_parameters", "type_parameters"))
        children.append(self.group("parameters", "parameters") if self.at("(") else self.missing("("))
        if self.at("->"):
            children.append(self.leaf())
            kind = self.type_until("{", ";", "where")
            if kind:
                children.append(self.node("type", kind, "return_type"))
        if self.at("where"):
            children.append(self.node("where_clause", [self.word(), *self.type_until("{", ";")]))
        if self.at("{"):
            children.append(self.braces("block", self.item_or_statement, "body"))
            return self.node("function_item", children)
        children.append(self.leaf() if self.at(";") else self.missing("{"))
        return self.node("function_signature_item", children)

    def type_until(self, *stops: str) -> list[Node]:
        out = []
        while self.peek().kind != "eof" and not self.at(*stops, ")", "]", "}"):
            if self.at("<"):
                out.append(self.angles("type_arguments"))
            elif self.peek().kind == "id" and self.peek().text not in ("dyn", "impl", "mut", "for", "as", "where"):
                out.append(self.leaf("type_identifier"))
            else:
                out.append(self.piece())
        return out

    def block_item(self, x: str, head: list[Node]) -> Node:
        children = [*head, self.word()]
        if x == "trait":
            children.append(self.leaf("type_identifier", "name") if self.peek().kind == "id" else self.missing("identifier"))
        if self.at("<"):
            children.append(self.angles("type_parameters", "type_parameters"))
        if x == "impl":
            first = self.type_name("for", "where", "{", ";")
            if self.at("for"):
                if first is not None:
                    first.field_name = "trait"
                    children.append(first)
                children.append(self.word())
                first = self.type_name("where", "{", ";")
            if first is not None:
                first.field_name = "type"
                children.append(first)
        elif self.at(":"):
            children.append(self.node("trait_bounds", [self.leaf(), *self.type_until("where", "{", ";")], "bounds"))
        if self.at("where"):
            children.append(self.node("where_clause", [self.word(), *self.type_until("{", ";")]))
        children.append(self.braces("declaration_list", self.item_or_statement, "body") if self.at("{") else self.leaf() if self.at(";") else self.missing("{"))
        return self.node("impl_item" if x == "impl" else "trait_item", children)

    def type_name(self, *stops: str) -> Node | None:
        parts = self.type_until(*stops)
        if not parts:
            return None
        if len(parts) == 1:
            return parts[0]
        return self.node("generic_type" if any(p.type == "type_arguments" for p in parts) else "scoped_type_identifier", parts)

    def data(self, x: str, head: list[Node]) -> Node:
        children = [*head, self.word(), self.leaf("type_identifier", "name")]
        if self.at("<"):
            children.append(self.angles("type_parameters", "type_parameters"))
        if self.at("where"):
            children.append(self.node("where_clause", [self.word(), *self.type_until("{", ";")]))
        if self.at("{"):
            children.append(self.group("enum_variant_list" if x == "enum" else "field_declaration_list", "body"))
        else:
            if self.at("("):
                children.append(self.group("ordered_field_declaration_list", "body"))
            if self.at("where"):
                children.append(self.node("where_clause", [self.word(), *self.type_until(";")]))
            children.append(self.leaf() if self.at(";") else self.missing(";"))
        return self.node({"struct": "struct_item", "enum": "enum_item", "union": "union_item"}[x], children)

    def use_tree(self) -> Node | None:
        parts: list[Node] = []
        if self.at("::"):
            parts.append(self.leaf())
        while True:
            if self.at("{"):
                children = [self.leaf()]
                while self.peek().kind != "eof" and not self.at("}", ")", "]", ";"):
                    one = self.leaf() if self.at(",") else self.use_tree()
                    children.append(one if one is not None else self.node("ERROR", [self.leaf()]))
                children.append(self.leaf() if self.at("}") else self.missing("}"))
                listed = self.node("use_list", children, "list" if parts else None)
                return self.node("scoped_use_list", [*self.path(parts), listed]) if parts else listed
            if self.at("*"):
                star = self.leaf()
                return self.node("use_wildcard", [*self.path(parts), star])
            if self.peek().kind != "id":
                break
            parts.append(self.leaf(self.peek().text if self.at("crate", "self", "super") else "identifier"))
            parts[-1].named = True
            if not self.at("::"):
                break
            parts.append(self.leaf())
        if not parts:
            return None
        whole = self.scoped(parts)
        if self.at("as"):
            as_ = self.word()
            whole.field_name = "path"
            return self.node("use_as_clause", [whole, as_, *([self.leaf("identifier", "alias")] if self.peek().kind == "id" else [])])
        return whole

    def scoped(self, parts: list[Node]) -> Node:
        if len(parts) == 1:
            return parts[0]
        parts[-1].field_name = "name"
        return self.node("scoped_identifier", [*self.path(parts[:-1]), parts[-1]])

    def path(self, parts: list[Node]) -> list[Node]:
        """A path that ends with ``::``, as one node and the separator."""
        if not parts or len(parts) == 1:
            return parts
        inner = self.scoped(parts[:-1])
        inner.field_name = "path"
        return [inner, parts[-1]]

    def statement(self) -> Node | None:
        t = self.peek()
        x = t.text if t.kind == "id" else ""
        if x == "let":
            children = [self.word(), *self.expression()]
            if self.at(";"):
                children.append(self.leaf())
            return self.node("let_declaration", children)
        if self.at("{") or x in _HEADS:
            parts = [self.braces("block", self.item_or_statement) if self.at("{") else self.head(x)]
            if self.at(".", "?") or self.at("as"):
                parts += self.expression()
        elif self.peek(1).text == "!" and t.kind == "id" and self.peek(2).text in ("(", "[", "{"):
            parts = [self.node("macro_invocation", [self.leaf(), self.leaf(), self.group("token_tree")])]
            if parts[0].children[-1].children[0].type != "{":
                parts += self.expression()
        else:
            parts = self.expression()
        if self.at(";"):
            parts.append(self.leaf())
        return self.node("expression_statement", parts) if parts else None

    def head(self, x: str) -> Node:
        children = [self.word()]
        if x == "async" and self.at("move"):
            children.append(self.word())
        children += self.expression("{") if not self.at("{") else []
        if self.at("{"):
            children.append(self.braces("match_block" if x == "match" else "block", self.arm if x == "match" else self.item_or_statement, "body"))
        if x == "if" and self.at("else"):
            clause = [self.word()]
            if self.at("if"):
                clause.append(self.head("if"))
            elif self.at("{"):
                clause.append(self.braces("block", self.item_or_statement))
            children.append(self.node("else_clause", clause))
        return self.node(_HEADS[x], children)

    def arm(self) -> Node | None:
        if self.at(","):
            return self.leaf()
        if self.at("#"):
            return self.attribute()
        parts = []
        while self.peek().kind != "eof" and not self.at("=>", "}", ")", "]"):
            parts.append(self.piece())
        if self.at("=>"):
            parts.append(self.leaf())
            parts += [self.braces("block", self.item_or_statement)] if self.at("{") else self.expression(",")
        if self.at(","):
            parts.append(self.leaf())
        return self.node("match_arm", parts) if parts else None

    def expression(self, *stops: str) -> list[Node]:
        out: list[Node] = []
        while self.peek().kind != "eof" and not self.at(";", *stops) and not self.at(")", "]", "}"):
            t = self.peek()
            if t.kind == "id" and t.text in _HEADS and "{" not in stops:
                out.append(self.head(t.text))
            elif self.at("{"):
                out.append(self.braces("block", self.item_or_statement) if self.t[self.i - 1].text in ("|", "=>", "=", "||", "else", "move", ")") else self.inner())
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
            children += self.expression()
            if self.at(";"):
                children.append(self.leaf())
            if self.i == before:
                break
        self.depth -= 1
        children.append(self.leaf() if self.at(close) else self.missing(close))
        return self.node({"(": "arguments", "[": "array_expression", "{": "field_initializer_list"}[first], children)
