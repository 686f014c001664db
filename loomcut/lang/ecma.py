"""JavaScript and TypeScript, either with JSX."""

from __future__ import annotations

import re

from .tree import _COMMON, _DOUBLE, _NUMBER, _SINGLE, Bracketed, Node, Source, Token

_AFTER_VALUE = {")", "]", "}"}
_BEFORE_REGEX = set("return typeof instanceof in of new delete void throw case do else yield await".split())
_CONTINUES = set("= + - * / % & | ^ ! ~ < > ? : , . ( [ => && || ?? ?. ** == === != !== <= >= += -= *= /= instanceof in of as satisfies extends implements".split())
_NEEDS_MORE = set("= + - * / % & | ^ ! ~ < ? : , . => && || ?? ?. ** == === != !== <= >= += -= *= /= new typeof in of instanceof delete void extends implements".split())
_HEADS = {"if": "if_statement", "for": "for_statement", "while": "while_statement", "do": "do_statement", "try": "try_statement", "switch": "switch_statement", "with": "with_statement"}
_SIMPLE = {"return": "return_statement", "throw": "throw_statement", "break": "break_statement", "continue": "continue_statement", "debugger": "debugger_statement"}
_MODIFIERS = set("public private protected static readonly abstract async override declare get set accessor".split())
_ACCESS = {"public", "private", "protected"}
_TAG = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*)?")
_CLOSING = re.compile(r"</\s*([\w$.:-]*)\s*>")
_ATTRIBUTE = re.compile(r"[A-Za-z_$][\w$.:-]*")
_BLANK = re.compile(r"(?:\s|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*")
_TEXT = re.compile(r"[^<>{}]*")


class Parser(Bracketed):
    TOKEN = re.compile(
        rf"{_COMMON}|(?P<tick>`)|(?P<string>{_DOUBLE}|{_SINGLE})|{_NUMBER}|(?P<id>\#?[^\W\d][\w$]*|\#?\$[\w$]*)|(?P<slash>/)|(?P<op>=>|\.\.\.|\?\.|===|!==|==|!=|&&|\|\||\?\?|\*\*|\+\+|--|[+\-*%&|^]=|.)", re.S
    )

    def __init__(self, source: Source, typed: bool):
        self.typed = typed
        self.no_markup: set[int] = set()
        super().__init__(source)

    def regex_allowed(self, last: Token | None) -> bool:
        if last is None or last.kind == "op":
            return last is None or last.text not in _AFTER_VALUE
        return last.kind == "id" and last.text in _BEFORE_REGEX

    def markup(self, pos: int, newline: bool, out: list[Token]) -> int:
        """A JSX element where a value may begin: pieces of markup, and between them the tokens of what is in braces.

        What looks like one and isn't (type parameters, casts) is remembered, so
        that no place is tried twice.
        """
        if pos in self.no_markup or not self.regex_allowed(out[-1] if out else None):
            return 0
        tokens, comments = len(out), len(self.comments)
        end = self._markup(pos, newline, out)
        if not end:
            self.no_markup.add(pos)
            del out[tokens:], self.comments[comments:]
        return end

    def _markup(self, pos: int, newline: bool, out: list[Token]) -> int:
        code, n = self.code, len(self.code)
        names: list[str] = []
        begin = at = pos

        def piece(kind: str) -> None:
            nonlocal begin, newline
            if at > begin:
                out.append(Token(kind, begin, at, code[begin:at], newline))
                newline = False
            begin = at

        def braces() -> bool:
            """The tokens of ``{...}``; whether it is closed."""
            nonlocal begin, at
            piece("markup")
            out.append(Token("op", at, at + 1, "{", False))
            at = self.scan(at + 1, False, out, True)
            if at >= n:
                return False
            out.append(Token("op", at, at + 1, "}", False))
            begin = at = at + 1
            return True

        while True:
            if m := _CLOSING.match(code, at):
                if not names or names.pop() != m.group(1):
                    return 0
                at = m.end()
            else:
                m = _TAG.match(code, at)
                name = m.group(1) or ""
                at = m.end()
                if name and code.startswith("<", at):  # type arguments
                    depth = 0
                    while at < n and code[at] not in ";{}" and (depth := depth + (code[at] == "<") - (code[at] == ">")):
                        at += 1
                    at += 1
                while True:
                    at = _BLANK.match(code, at).end()
                    if code.startswith("/>", at) and name:
                        at += 2
                        break
                    if code.startswith(">", at):
                        at += 1
                        names.append(name)
                        break
                    if not name:
                        return 0
                    if code.startswith("{", at):
                        if not braces():
                            return 0
                        continue
                    if not (m := _ATTRIBUTE.match(code, at)):
                        return 0
                    at = m.end()
                    value = _BLANK.match(code, at).end()
                    if not code.startswith("=", value):
                        continue
                    at = _BLANK.match(code, value + 1).end()
                    if code[at : at + 1] in ('"', "'") and at < n:
                        at = code.find(code[at], at + 1) + 1
                        if not at:
                            return 0
                    elif code.startswith("{", at):
                        if not braces():
                            return 0
                    else:
                        return 0
            while names:  # text up to the next tag
                at = _TEXT.match(code, at).end()
                if not code.startswith("{", at):
                    break
                if not braces():
                    return 0
            if not names:
                piece("markup_end")
                return at
            if not code.startswith("<", at):
                return 0

    def parse(self) -> Node:
        return self.parse_all("program", self.statement)

    def semicolon(self, children: list[Node]) -> list[Node]:
        if self.at(";"):
            children.append(self.leaf())
        return children

    def statement(self) -> Node | None:
        t = self.peek()
        nxt = self.peek(1)
        x = t.text if t.kind == "id" else ""
        if t.text == "{" and t.kind == "op":
            return self.braces("statement_block", self.statement)
        if t.text == ";" and t.kind == "op":
            return self.node("empty_statement", [self.leaf()])
        if t.text == "@" and t.kind == "op":
            return self.decorated()
        if x == "import" and nxt.text not in ("(", "."):
            return self.import_()
        if x == "export":
            return self.export()
        if (d := self.declaration()) is not None:
            return d
        if x in _HEADS and nxt.text in ("(", "{", "await") or x in ("do", "try"):
            return self.compound(x)
        if x in _SIMPLE:
            children = [self.word()]
            if not self.peek().newline:
                children += self.expression()
            return self.node(_SIMPLE[x], self.semicolon(children))
        if t.kind == "id" and nxt.text == ":" and nxt.kind == "op" and x not in ("case", "default"):
            children = [self.leaf("statement_identifier", "label"), self.leaf()]
            if (s := self.statement()) is not None:
                children.append(s)
            return self.node("labeled_statement", children)
        return self.expression_statement()

    def expression_statement(self) -> Node | None:
        children = self.expression()
        if not children:
            return None
        return self.node("expression_statement", self.semicolon(children))

    def decorated(self) -> Node | None:
        decorators = [self.decorator()]
        while self.at("@"):
            decorators.append(self.decorator())
        s = self.export() if self.at("export") else self.declaration()
        if s is None:
            return self.node("ERROR", decorators)
        s.children[:0] = decorators
        s.start = decorators[0].start
        return s

    def decorator(self) -> Node:
        children = [self.leaf(), self.leaf()]
        while self.at("."):
            children += [self.leaf(), self.leaf()]
        if self.at("("):
            children.append(self.group("arguments"))
        return self.node("decorator", children)

    def declaration(self) -> Node | None:
        t, nxt = self.peek(), self.peek(1)
        x = t.text if t.kind == "id" else ""
        if x == "function" or x == "async" and nxt.text == "function" and not nxt.newline:
            return self.function("function_declaration", "generator_function_declaration")
        if x == "class":
            return self.class_("class_declaration")
        if x in ("const", "let") and (nxt.kind == "id" and nxt.text != "enum" or nxt.text in ("{", "[")):
            return self.variables("lexical_declaration")
        if x == "var":
            return self.variables("variable_declaration")
        if self.typed:
            if x == "abstract" and nxt.text == "class":
                return self.class_("abstract_class_declaration")
            if x == "interface" and nxt.kind == "id":
                return self.interface()
            if x == "type" and nxt.kind == "id" and not nxt.newline:
                return self.alias()
            if x == "enum" and nxt.kind == "id" or x == "const" and nxt.text == "enum":
                return self.enum()
            if x in ("namespace", "module") and nxt.kind in ("id", "string") and not nxt.newline:
                return self.namespace()
            if x == "declare" and nxt.kind == "id" and not nxt.newline:
                children = [self.word()]
                if self.at("global"):
                    children += [self.word(), *([self.braces("statement_block", self.statement)] if self.at("{") else [])]
                elif (d := self.declaration()) is not None:
                    children.append(d)
                return self.node("ambient_declaration", children)
        return None

    def name(self, type_: str = "identifier") -> list[Node]:
        return [self.leaf(type_, "name")] if self.peek().kind == "id" else []

    def signature(self) -> list[Node]:
        """Type parameters, parameters and return type."""
        out = []
        if self.at("<"):
            out.append(self.angles("type_parameters", "type_parameters"))
        if self.at("("):
            out.append(self.group("formal_parameters", "parameters"))
        if self.at(":"):
            colon = self.leaf()
            out.append(self.node("type_annotation", [colon, *self.type()], "return_type"))
        return out

    def type(self) -> list[Node]:
        out: list[Node] = []
        more = True
        while self.peek().kind != "eof":
            if more:
                if self.at("(", "[", "{"):
                    out.append(self.group({"(": "formal_parameters", "[": "tuple_type", "{": "object_type"}[self.peek().text]))
                    more = False
                elif self.at("keyof", "typeof", "readonly", "infer", "unique", "asserts", "new", "abstract", "|", "&", "-", "..."):
                    out.append(self.leaf())
                elif self.at("<"):
                    out.append(self.angles("type_parameters"))
                elif self.peek().kind in ("id", "string", "number"):
                    out.append(self.leaf("type_identifier" if self.peek().kind == "id" else None))
                    more = False
                else:
                    break
            elif self.at("<"):
                out.append(self.angles("type_arguments"))
            elif self.at("[") and not self.peek().newline:
                out.append(self.group("array_type"))
            elif self.at("|", "&", ".", "=>", "is", "?", ":") or self.at("extends"):
                if self.at(":") and not any(n.type == "?" for n in out):
                    break
                out.append(self.leaf())
                more = True
            else:
                break
        return out

    def function(self, type_: str, generator: str) -> Node:
        children = []
        if self.at("async"):
            children.append(self.word())
        children.append(self.word())
        if self.at("*"):
            children.append(self.leaf())
            type_ = generator
        if not self.at("("):
            children += self.name()
        if not self.at("(", "<"):
            children.append(self.node("ERROR", self.until("(", "{", ";") or [self.missing("(")]))
        children += self.signature()
        if self.at("{"):
            children.append(self.braces("statement_block", self.statement, "body"))
        elif self.typed and type_ == "function_declaration":
            type_ = "function_signature"
            self.semicolon(children)
        else:
            children.append(self.missing("{"))
        return self.node(type_, children)

    def class_(self, type_: str) -> Node:
        children = [self.word()]
        if self.at("class"):
            children.append(self.word())
        if self.peek().kind == "id" and not self.at("extends", "implements"):
            children += self.name("type_identifier" if self.typed else "identifier")
        if self.at("<"):
            children.append(self.angles("type_parameters", "type_parameters"))
        if self.at("extends", "implements"):
            heritage = []
            while self.peek().kind != "eof" and not self.at("{", *")]};"):
                heritage.append(self.angles("type_arguments") if self.at("<") else self.piece() if not self.at("extends", "implements") else self.word())
            children.append(self.node("class_heritage", heritage))
        children.append(self.braces("class_body", self.member, "body") if self.at("{") else self.missing("{"))
        return self.node(type_, children)

    def member(self) -> Node | None:
        if self.at(";"):
            return self.leaf()
        if self.at("@"):
            return self.decorator()
        children: list[Node] = []
        if self.at("static") and self.peek(1).text == "{":
            return self.node("class_static_block", [self.word(), self.braces("statement_block", self.statement, "body")])
        while self.at(*_MODIFIERS) and self.peek(1).text not in ("(", "=", ";", ":", "<", "?", "!", "}", ","):
            kind = "accessibility_modifier" if self.peek().text in _ACCESS else "override_modifier" if self.at("override") else None
            w = self.word()
            children.append(Node(kind, w.start, w.end, [w]) if kind else w)
        if self.at("*"):
            children.append(self.leaf())
        t = self.peek()
        if t.kind == "id":
            children.append(self.leaf("private_property_identifier" if t.text[0] == "#" else "property_identifier", "name"))
        elif t.kind in ("string", "number"):
            children.append(self.leaf(None, "name"))
        elif self.at("["):
            children.append(self.group("computed_property_name", "name"))
        elif not children or not self.at("(", "<"):
            return self.node("ERROR", children + self.until(";", "{")) if children or not self.at(*")]}{") else (self.braces("statement_block", self.statement) if self.at("{") else None)
        while self.at("?", "!"):
            children.append(self.leaf())
        if self.at("(", "<"):
            children += self.signature()
            if self.at("{"):
                children.append(self.braces("statement_block", self.statement, "body"))
                return self.node("method_definition", children)
            abstract = any(c.type == "abstract" for c in children)
            return self.node("abstract_method_signature" if abstract else "method_signature", self.semicolon(children))
        if self.at(":"):
            colon = self.leaf()
            children.append(self.node("type_annotation", [colon, *self.type()], "type"))
        if self.at("="):
            children.append(self.leaf())
            children += self.expression()
        return self.node("public_field_definition" if self.typed else "field_definition", self.semicolon(children))

    def interface(self) -> Node:
        children = [self.word(), *self.name("type_identifier")]
        if self.at("<"):
            children.append(self.angles("type_parameters", "type_parameters"))
        if self.at("extends"):
            clause = [self.word()]
            while self.peek().kind != "eof" and not self.at("{", *")]};"):
                clause.append(self.angles("type_arguments") if self.at("<") else self.piece())
            children.append(self.node("extends_type_clause", clause))
        children.append(self.braces("interface_body", self.signature_member, "body") if self.at("{") else self.missing("{"))
        return self.node("interface_declaration", children)

    def signature_member(self) -> Node | None:
        if self.at(";", ","):
            return self.leaf()
        children: list[Node] = []
        method = False
        first = self.peek()
        while self.peek().kind != "eof" and not self.at(";", ",", "}") and not (self.peek() is not first and self.peek().newline and children[-1].type not in _NEEDS_MORE and not self.at("|", "&", ".", "=>", "extends", "?", ":")):
            if self.at(":"):
                colon = self.leaf()
                children.append(self.node("type_annotation", [colon, *self.type()]))
            elif self.at("<"):
                children.append(self.angles("type_parameters"))
            elif self.at(*CLOSERS):
                break
            else:
                method |= self.at("(")
                children.append(self.group("formal_parameters") if self.at("(") else self.leaf("property_identifier", "name") if self.peek().kind == "id" and not children else self.piece())
        return self.node("method_signature" if method else "property_signature", children) if children else None

    def alias(self) -> Node:
        children = [self.word(), *self.name("type_identifier")]
        if self.at("<"):
            children.append(self.angles("type_parameters", "type_parameters"))
        if self.at("="):
            children += [self.leaf(), *self.type()]
        return self.node("type_alias_declaration", self.semicolon(children))

    def enum(self) -> Node:
        children = [self.word()]
        if self.at("enum"):
            children.append(self.word())
        children += self.name()
        if self.at("{"):
            children.append(self.group("enum_body", "body"))
        return self.node("enum_declaration", children)

    def namespace(self) -> Node:
        word = self.word()
        type_ = "internal_module" if word.end - word.start == 9 else "module"
        children = [word, self.leaf(None, "name")]
        while self.at("."):
            children += [self.leaf(), self.leaf()]
        if self.at("{"):
            children.append(self.braces("statement_block", self.statement, "body"))
        n = self.node(type_, children)
        return self.node("expression_statement", [n]) if type_ == "internal_module" else n

    def variables(self, type_: str) -> Node:
        children = [self.word("kind")]
        while True:
            one: list[Node] = []
            if self.peek().kind == "id":
                one.append(self.leaf("identifier", "name"))
            elif self.at("{", "["):
                one.append(self.group({"{": "object_pattern", "[": "array_pattern"}[self.peek().text], "name"))
            if self.at("!"):
                one.append(self.leaf())
            if self.at(":"):
                colon = self.leaf()
                one.append(self.node("type_annotation", [colon, *self.type()], "type"))
            if self.at("="):
                one.append(self.leaf())
                value = self.expression(",")
                if value:
                    one.append(self.value(value))
            elif self.at("of", "in") and one:
                one += [self.word(), *self.expression(",")]
            if one:
                children.append(self.node("variable_declarator", one))
            if not self.at(","):
                break
            children.append(self.leaf())
        return self.node(type_, self.semicolon(children))

    def value(self, parts: list[Node]) -> Node:
        if len(parts) == 1:
            parts[0].field_name = "value"
            return parts[0]
        return self.node("arrow_function" if any(p.type == "=>" for p in parts) else "expression", parts, "value")

    def expression(self, *stops: str) -> list[Node]:
        """Pieces of an expression; it ends at ``;``, a closer, or a line break that may end it."""
        out: list[Node] = []
        angle_arrow = False
        while True:
            t = self.peek()
            if t.kind == "eof" or self.at(";", *stops) or self.at(*CLOSERS):
                return out
            if out and t.newline:
                last = self.t[self.i - 1]
                if not (last.text in _NEEDS_MORE and last.kind != "string") and not (t.text in _CONTINUES and t.kind != "string" or t.text[:1] == "`"):
                    return out
            last = self.t[self.i - 1] if out else None
            if t.kind == "id" and (t.text == "function" or t.text == "async" and self.peek(1).text == "function") and not (last and last.text in (".", "?.")):
                out.append(self.function("function_expression", "generator_function"))
            elif t.kind == "id" and t.text == "class" and not (last and last.text in (".", "?.")):
                out.append(self.class_("class"))
            elif self.at("{") and last is not None and last.text == "=>":
                out.append(self.braces("statement_block", self.statement))
                if not self.peek().newline:
                    continue
                if not self.at(".", ",", "(", *stops):
                    return out
            elif self.at("(", "["):
                out.append(self.call_group())
            elif self.at("{"):
                out.append(self.object())
            elif t.kind in ("markup", "markup_end"):
                out.append(self.jsx())
            else:
                out.append(self.leaf())

    def jsx(self) -> Node:
        children: list[Node] = []
        while True:
            last = self.peek().kind == "markup_end"
            children.append(self.object() if self.at("{") else self.leaf())
            if last or self.peek().kind == "eof":
                return self.node("jsx_element", children)

    def call_group(self) -> Node:
        """A group of expressions, in which functions and classes are parsed."""
        first = self.peek().text
        children = [self.leaf()]
        close = ")" if first == "(" else "]"
        self.depth += 1
        if self.depth >= self.DEEPEST:
            children += self.flat(close)
        while self.peek().kind != "eof" and not self.at(*CLOSERS):
            parts = self.expression()
            children += parts
            if self.at(";"):
                children.append(self.leaf())
            elif not parts:
                break
        self.depth -= 1
        children.append(self.leaf() if self.at(close) else self.missing(close))
        return self.node("parenthesized_expression" if first == "(" else "array", children)

    def object(self) -> Node:
        children = [self.leaf()]
        self.depth += 1
        if self.depth >= self.DEEPEST:
            children += self.flat("}")
        while self.peek().kind != "eof" and not self.at(*CLOSERS):
            if self.at("{") and self.t[self.i - 1].text in (")", "=>"):
                children.append(self.braces("statement_block", self.statement))
                continue
            before = self.i
            children += self.expression("{") if not self.at("{") else [self.object()]
            if self.at(";"):
                children.append(self.leaf())
            elif self.i == before:
                break
        self.depth -= 1
        children.append(self.leaf() if self.at("}") else self.missing("}"))
        return self.node("object", children)

    def compound(self, x: str) -> Node:
        children = [self.word()]
        if self.at("await"):
            children.append(self.word())
        if x in ("if", "for", "while", "switch", "with"):
            if self.at("("):
                children.append(self.call_group())
            if x == "switch":
                if self.at("{"):
                    children.append(self.braces("switch_body", self.case, "body"))
                return self.node(_HEADS[x], children)
            if (s := self.statement() if not self.at(*CLOSERS) else None) is not None:
                children.append(s)
            if x == "if" and self.at("else"):
                clause = [self.word()]
                if (s := self.statement() if not self.at(*CLOSERS) else None) is not None:
                    clause.append(s)
                children.append(self.node("else_clause", clause))
        elif x == "do":
            if (s := self.statement() if not self.at(*CLOSERS) else None) is not None:
                children.append(s)
            if self.at("while"):
                children.append(self.word())
                if self.at("("):
                    children.append(self.call_group())
                self.semicolon(children)
        else:
            if self.at("{"):
                children.append(self.braces("statement_block", self.statement, "body"))
            while self.at("catch", "finally"):
                clause = [self.word()]
                type_ = clause[0].type + "_clause"
                if self.at("("):
                    clause.append(self.group())
                if self.at("{"):
                    clause.append(self.braces("statement_block", self.statement, "body"))
                children.append(self.node(type_, clause))
        return self.node(_HEADS[x], children)

    def case(self) -> Node | None:
        if not self.at("case", "default"):
            return self.statement()
        type_ = "switch_case" if self.at("case") else "switch_default"
        children = [self.word(), *self.expression(":")]
        if self.at(":"):
            children.append(self.leaf())
        while self.peek().kind != "eof" and not self.at("case", "default", *CLOSERS):
            before = self.i
            if (s := self.statement()) is not None:
                children.append(s)
            if self.i == before:
                break
        return self.node(type_, children)

    def import_(self) -> Node:
        children = [self.word()]
        if self.at("type", "typeof") and (self.peek(1).kind == "id" and self.peek(1).text != "from" or self.peek(1).text in ("{", "*")):
            children.append(self.word())
        clause: list[Node] = []
        while self.peek().kind != "eof" and self.peek().kind != "string" and not self.at("from", ";"):
            if self.at("{"):
                clause.append(self.specifiers("named_imports", "import_specifier"))
            elif self.at("*"):
                part = [self.leaf()]
                if self.at("as"):
                    part.append(self.word())
                if self.peek().kind == "id":
                    part.append(self.leaf())
                clause.append(self.node("namespace_import", part))
            elif self.peek().kind == "id" or self.at(","):
                if self.peek().newline and not self.at(","):
                    break
                clause.append(self.leaf())
            else:
                break
        if clause:
            children.append(self.node("import_clause", clause))
        if self.at("from"):
            children.append(self.word())
        if self.peek().kind == "string":
            children.append(self.leaf(None, "source"))
        elif clause and self.at("="):
            children += self.until(";")
        elif not clause or children[-1].type == "from":
            children.append(self.missing("string"))
        if self.at("with", "assert") and self.peek(1).text == "{":
            children.append(self.node("import_attribute", [self.word(), self.group("object")]))
        return self.node("import_statement", self.semicolon(children))

    def specifiers(self, type_: str, each: str) -> Node:
        children = [self.leaf()]
        while self.peek().kind != "eof" and not self.at(*CLOSERS):
            if self.at(","):
                children.append(self.leaf())
                continue
            part: list[Node] = []
            if self.at("type") and self.peek(1).kind == "id" and self.peek(1).text != "as":
                part.append(self.word())
            if self.peek().kind not in ("id", "string"):
                children.append(self.node("ERROR", [self.leaf()]))
                continue
            part.append(self.leaf(None, "name"))
            if self.at("as"):
                part.append(self.word())
                if self.peek().kind in ("id", "string"):
                    part.append(self.leaf(None, "alias"))
            children.append(self.node(each, part))
        children.append(self.leaf() if self.at("}") else self.missing("}"))
        return self.node(type_, children)

    def export(self) -> Node:
        children = [self.word()]
        if self.at("type") and self.peek(1).text in ("{", "*"):
            children.append(self.word())
        if self.at("{", "*"):
            if self.at("{"):
                children.append(self.specifiers("export_clause", "export_specifier"))
            else:
                star = [self.leaf()]
                if self.at("as"):
                    star += [self.word(), self.leaf()]
                    star = [self.node("namespace_export", star)]
                children += star
            if self.at("from"):
                children.append(self.word())
                if self.peek().kind == "string":
                    children.append(self.leaf(None, "source"))
            return self.node("export_statement", self.semicolon(children))
        if self.at("default"):
            children.append(self.word())
            d = self.declaration() if not self.at("class", "function", "async", "abstract") else self.default()
            if d is not None:
                children.append(d)
                return self.node("export_statement", children)
            children += self.expression()
            return self.node("export_statement", self.semicolon(children))
        if self.at("="):
            children += [self.leaf(), *self.expression()]
            return self.node("export_statement", self.semicolon(children))
        while self.at("@"):
            children.append(self.decorator())
        d = self.declaration()
        if d is not None:
            d.field_name = "declaration"
            children.append(d)
        else:
            children.append(self.node("ERROR", self.expression() or [self.missing("declaration")]))
        return self.node("export_statement", children)

    def default(self) -> Node | None:
        if self.at("class", "abstract"):
            named = self.peek(1).kind == "id" and self.peek(1).text != "extends"
            return self.class_(("abstract_class_declaration" if self.at("abstract") else "class_declaration") if named else "class")
        if self.at("function") or self.peek(1).text == "function":
            k = 1 + self.at("async") + (self.peek(1 + self.at("async")).text == "*")
            named = self.peek(k).kind == "id"
            return self.function("function_declaration" if named else "function_expression", "generator_function_declaration" if named else "generator_function")
        return None


CLOSERS = (")", "]", "}")
