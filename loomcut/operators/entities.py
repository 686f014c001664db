"""Entities of a syntax tree: names, signatures, docstrings, parents, imports.

Which node types become which entity is a table per language.  With
``mode="patterns"`` it is that of the outline patterns, with
``mode="node_types"`` the plain walk over node types.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from loomcut.lang import Node, Source

JS_SPACE = "\t\n\x0b\f\r    -     　﻿"
_SPACES = re.compile(f"[{JS_SPACE}]+")
_TRIM = "".join(chr(c) for c in [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])

#: (language, node type) -> entity type, for the patterns' targets.
PATTERN_TARGETS = {
    "typescript": {
        "enum_declaration": "enum", "type_alias_declaration": "type", "function_declaration": "function", "generator_function_declaration": "function", "interface_declaration": "interface",
        "class_declaration": "class", "abstract_class_declaration": "class", "method_definition": "method", "import_statement": "import", "export_statement": "export",
    },
    "javascript": {"function_declaration": "function", "generator_function_declaration": "function", "class_declaration": "class", "method_definition": "method", "import_statement": "import", "export_statement": "export"},
    "python": {"class_definition": "class", "function_definition": "function", "import_statement": "import", "import_from_statement": "import"},
    "rust": {"struct_item": "type", "enum_item": "enum", "trait_item": "interface", "impl_item": "class", "function_item": "function", "type_item": "type", "use_declaration": "import"},
    "go": {"type_spec": "type", "function_declaration": "function", "method_declaration": "method", "method_elem": "method", "import_declaration": "import", "package_clause": "import"},
    "java": {
        "import_declaration": "import", "class_declaration": "class", "interface_declaration": "interface", "enum_declaration": "enum", "enum_constant": "enum", "annotation_type_declaration": "type",
        "method_declaration": "method", "constructor_declaration": "type", "annotation_type_element_declaration": "type",
    },
}
#: Node types that count as a parent, and that the plain walk collects.
DECLARATIONS = {
    "typescript": {"function_declaration": "function", "method_definition": "method", "class_declaration": "class", "interface_declaration": "interface", "type_alias_declaration": "type", "enum_declaration": "enum", "import_statement": "import", "export_statement": "export"},
    "javascript": {"function_declaration": "function", "method_definition": "method", "class_declaration": "class", "import_statement": "import", "export_statement": "export"},
    "python": {"function_definition": "function", "class_definition": "class", "import_statement": "import", "import_from_statement": "import"},
    "rust": {"function_item": "function", "impl_item": "class", "struct_item": "type", "enum_item": "enum", "trait_item": "interface", "type_item": "type", "use_declaration": "import"},
    "go": {"function_declaration": "function", "method_declaration": "method", "type_declaration": "type", "import_declaration": "import"},
    "java": {"method_declaration": "method", "class_declaration": "class", "interface_declaration": "interface", "enum_declaration": "enum", "import_declaration": "import"},
}
_DELIMITER = {"python": ":"}
_BODIES = ("block", "statement_block", "class_body", "interface_body", "enum_body")
_NAMES = ("name", "identifier", "type_identifier", "property_identifier")
_COMMENTS = {"typescript": ("comment",), "javascript": ("comment",), "python": ("comment",), "rust": ("line_comment", "block_comment"), "go": ("comment",), "java": ("line_comment", "block_comment")}


@dataclass
class Entity:
    type: str
    name: str
    signature: str
    docstring: str | None
    start: int
    end: int
    line_start: int
    line_end: int
    parent: str | None = None
    source: str | None = None


def trim(s: str) -> str:
    return s.strip(_TRIM)


def clean(s: str) -> str:
    return trim(_SPACES.sub(" ", s))


def delimiter(text: str, mark: str) -> int:
    """Position of ``mark`` outside brackets, generics and quotes, or -1."""
    paren = square = angle = 0
    quote = ""
    for i, c in enumerate(text):
        if c in "\"'`" and (i == 0 or text[i - 1] != "\\"):
            if not quote:
                quote = c
            elif c == quote:
                quote = ""
            continue
        if quote:
            continue
        if c == "(":
            paren += 1
        elif c == ")":
            paren -= 1
        elif c == "[":
            square += 1
        elif c == "]":
            square -= 1
        elif c == "<":
            after = text[i + 1 : i + 2]
            angle += bool(after) and (after.isascii() and after.isalpha() or after in "_<> ")
        elif c == ">" and angle > 0:
            angle -= 1
        if c == mark and not paren and not square and not angle:
            return i
    return -1


class Extractor:
    def __init__(self, source: Source, language: str):
        self.s, self.code, self.language = source, source.code, language
        self._named: dict[int, tuple[list[Node], dict[int, int]]] = {}

    def named(self, parent: Node) -> tuple[list[Node], dict[int, int]]:
        """A node's named children, and the place of each (by its ``id``) among them."""
        if id(parent) not in self._named:
            named = parent.named_children
            self._named[id(parent)] = named, {id(c): i for i, c in enumerate(named)}
        return self._named[id(parent)]

    def text(self, n: Node) -> str:
        return self.s.text(n)

    def name(self, n: Node) -> str | None:
        for f in _NAMES:
            if (c := n.child(f)) is not None:
                return self.text(c)
        return next((self.text(c) for c in n.children if c.type in _NAMES), None)

    # signatures

    def _before_body(self, n: Node) -> str:
        body = n.child("body") or next((c for c in n.children if c.type in _BODIES), None)
        if body is None:
            return ""
        s = trim(self.code[n.start : body.start])
        if self.language == "python" and s.endswith(":"):
            s = s[:-1]
        if s.endswith("=>"):
            s = trim(s[:-2])
        return clean(s)

    def signature(self, n: Node, kind: str) -> str:
        text = self.text(n)
        first_line = lambda: clean(text.split("\n", 1)[0])
        if kind in ("import", "export"):
            return clean(text)
        if kind in ("type", "enum"):
            at = [x for x in (text.find("="), delimiter(text, "{"), delimiter(text, ":") if self.language == "python" else -1) if x >= 0]
            return clean(text[: min(at)]) if at else first_line()
        if s := self._before_body(n):
            return s
        at = delimiter(text, _DELIMITER.get(self.language, "{"))
        if at >= 0:
            return clean(text[:at])
        return clean(text) if kind in ("function", "method") else first_line()

    # docstrings

    def is_doc(self, text: str) -> bool:
        t = trim(text)
        if self.language in ("typescript", "javascript", "java"):
            return bool(re.match(r"/\*\*[^*]", t)) or t == "/**/"
        if self.language == "python":
            return t.startswith(('"""', "'''", 'r"""', "r'''"))
        return t.startswith(("///", "//!") if self.language == "rust" else "//")

    def clean_doc(self, text: str) -> str:
        if self.language in ("typescript", "javascript", "java"):
            t = trim(text)
            t = t.removeprefix("/**").removesuffix("*/")
            lines = []
            for x in t.split("\n"):
                x = trim(x)
                if x.startswith("*"):
                    x = x[1:].removeprefix(" ")
                lines.append(x)
        elif self.language == "python":
            t = trim(text)
            if t.startswith(('r"""', "r'''")):
                t = t[1:]
            for q in ('"""', "'''"):
                if t.startswith(q):
                    t = t[3:].removesuffix(q)
                    break
            lines = t.split("\n")
            indent = min((len(x) - len(x.lstrip(_TRIM)) for x in lines if trim(x)), default=0)
            lines = [x[indent:] if trim(x) else "" for x in lines]
        else:
            marks = ("///", "//!") if self.language == "rust" else ("//",)
            lines = []
            for x in text.split("\n"):
                x = trim(x)
                for m in marks:
                    if x.startswith(m):
                        x = x[len(m) :]
                        break
                lines.append(x.removeprefix(" "))
        blank = (lambda x: not trim(x)) if self.language == "python" else (lambda x: x == "")
        while lines and blank(lines[0]):
            lines.pop(0)
        while lines and blank(lines[-1]):
            lines.pop()
        return "\n".join(lines)

    def docstring(self, n: Node) -> str | None:
        if self.language == "python":
            body = n.child("body")
            first = body.named_children[0] if body is not None and body.named_children else None
            if first is not None and first.type == "expression_statement" and first.named_children:
                first = first.named_children[0]
            if first is not None and first.type == "string" and self.is_doc(self.text(first)):
                return self.clean_doc(self.text(first))
        if n.parent is None:
            return None
        found: list[str] = []
        siblings, places = self.named(n.parent)
        i = places[id(n)]
        while i > 0 and siblings[i - 1].type in _COMMENTS[self.language] and self.is_doc(self.text(siblings[i - 1])):
            i -= 1
            found.append(self.text(siblings[i]))
        return self.clean_doc("\n".join(reversed(found))) if found else None

    # imports

    def source_of(self, n: Node) -> str | None:
        if (f := n.child("source")) is not None:
            return unquote(self.text(f))
        lang = self.language
        if lang == "python":
            f = n.child("module_name") or n.child("name")
            return self.text(f) if f is not None else None
        if lang == "rust":
            f = n.child("argument")
            return None if f is None else "" if f.type == "use_list" else self.text(f)
        if lang == "go":
            for c in n.children:
                specs = [c] if c.type == "import_spec" else c.children if c.type == "import_spec_list" else []
                for x in specs:
                    if x.type == "import_spec" and (p := x.child("path")) is not None:
                        return unquote(self.text(p))
            return None
        if lang == "java":
            return next((self.text(c) for c in n.children if c.type == "scoped_identifier"), None)
        return None

    def symbols(self, n: Node) -> list[str]:
        lang, out = self.language, []
        if lang in ("typescript", "javascript"):
            clause = next((c for c in n.named_children if c.type == "import_clause"), None)
            for c in clause.named_children if clause else []:
                if c.type == "named_imports":
                    for s in c.named_children:
                        f = s.child("alias") or s.child("name") if s.type == "import_specifier" else None
                        if f is not None:
                            out.append(self.text(f))
                elif c.type == "identifier":
                    out.append(self.text(c))
                elif c.type == "namespace_import":
                    out += [self.text(x) for x in c.named_children if x.type == "identifier"][:1]
        elif lang == "python":
            for c in n.named_children:
                if c.type == "aliased_import":
                    out.append(self.text(c.child("alias") or c.child("name") or c))
                elif c.type in ("dotted_name", "identifier"):
                    out.append(self.text(c))
        elif lang == "rust":
            stack = [a for a in [n.child("argument")] if a is not None]
            while stack:
                c = stack.pop()
                if c.type in ("identifier", "type_identifier"):
                    out.append(self.text(c))
                elif c.type == "use_list":
                    stack += reversed(c.named_children)
                elif c.type in ("scoped_identifier", "scoped_use_list") and c.named_children:
                    stack.append(c.named_children[-1])
                elif c.type == "use_as_clause" and (a := c.child("alias")) is not None:
                    out.append(self.text(a))
                elif c.type == "use_wildcard":
                    out.append("*")
        elif lang == "go":
            for c in n.named_children:
                for x in [c] if c.type == "import_spec" else c.named_children if c.type == "import_spec_list" else []:
                    if x.type != "import_spec":
                        continue
                    if (a := x.child("name")) is not None:
                        out.append(self.text(a))
                    elif (p := x.child("path")) is not None:
                        out.append(re.sub("['\"]", "", self.text(p)).split("/")[-1])
        elif lang == "java":
            out += [self.text(c).split(".")[-1] for c in n.named_children if c.type == "scoped_identifier"][:1]
        return out

    def imports(self, n: Node) -> list[Entity]:
        source = self.source_of(n) or ""
        names = self.symbols(n) or [source or "<anonymous>"]
        return [Entity("import", x, self.text(n), None, n.start, n.end, self.s.row(n.start), self.s.row(n.end), None, source) for x in names]

    # entities

    def parent_name(self, n: Node) -> str | None:
        p = n.parent
        while p is not None and p.parent is not None:
            if p.type in DECLARATIONS[self.language] and (name := self.name(p)):
                return name
            p = p.parent
        return None

    def wanted(self, n: Node) -> str | None:
        kind = PATTERN_TARGETS[self.language].get(n.type)
        if kind is None:
            return None
        lang = self.language
        if n.type == "method_definition" and (n.parent is None or n.parent.type != "class_body" or lang == "javascript" and (n.child("name") is None or n.child("name").type != "property_identifier")):
            return None
        if n.type == "export_statement" and lang == "typescript" and not any(c.type == "export_clause" for c in n.children):
            return None
        if kind != "import" and n.type not in ("impl_item", "export_statement") and n.child("name") is None:
            return None
        return kind

    def entity(self, n: Node, kind: str, name: str | None, parent: str | None) -> Entity:
        name = name or "<anonymous>"
        return Entity(kind, name, self.signature(n, kind) or name, self.docstring(n), n.start, n.end, self.s.row(n.start), self.s.row(n.end), parent)

    def by_patterns(self, root: Node) -> list[Entity]:
        out: list[Entity] = []
        for n in root.walk():
            kind = self.wanted(n)
            if kind == "import":
                out += self.imports(n)
            elif kind:
                named = n.child("name")
                out.append(self.entity(n, kind, self.text(named) if named is not None else self.name(n), self.parent_name(n)))
        return out

    def by_node_types(self, root: Node) -> list[Entity]:
        """Depth-first over named children; imports aren't entered; the parent's name passes through classes, interfaces, functions and methods."""
        out: list[Entity] = []
        stack: list[tuple[Node, str | None]] = [(root, None)]
        types = DECLARATIONS[self.language]
        while stack:
            n, parent = stack.pop()
            kind = types.get(n.type)
            if kind == "import":
                out += self.imports(n)
                continue
            below = parent
            if kind:
                name = self.name(n) or "<anonymous>"
                out.append(self.entity(n, kind, name, parent))
                if kind in ("class", "interface", "function", "method"):
                    below = name
            stack += [(c, below) for c in reversed(n.named_children)]
        return out


def unquote(s: str) -> str:
    return s[1:-1] if len(s) >= 1 and s[0] == s[-1] and s[0] in "\"'`" else s


def extract(root: Node, source: Source, language: str, mode: str = "patterns") -> list[Entity]:
    x = Extractor(source, language)
    return x.by_patterns(root) if mode == "patterns" else x.by_node_types(root)
