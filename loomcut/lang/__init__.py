"""Syntax trees for six languages, from hand-written parsers.

Node and field names are those of the public tree-sitter grammars, as far as
extraction and windowing look at them: declarations, their names, parameters
and bodies, and the statements inside bodies.  Below a statement the tree has
bracket groups and tokens only.
"""

from __future__ import annotations

import sys

from . import ecma, golang, java, python, rust
from .tree import Node, ParseError, Source

_PARSERS = {
    "typescript": lambda s: ecma.Parser(s, True).parse(),
    "javascript": lambda s: ecma.Parser(s, False).parse(),
    "python": lambda s: python.Parser(s).parse(),
    "rust": lambda s: rust.Parser(s).parse(),
    "go": lambda s: golang.Parser(s).parse(),
    "java": lambda s: java.Parser(s).parse(),
}
LANGUAGES = tuple(_PARSERS)
_FRAMES = 1_000_000


def parse(code: str, language: str) -> tuple[Node, ParseError | None]:
    """Tree of ``code``, and what was wrong with it (never raises on malformed code)."""
    source = Source(code)
    if sys.getrecursionlimit() < _FRAMES:  # nesting is recursive; Python frames need no C stack
        sys.setrecursionlimit(_FRAMES)
    root = _PARSERS[language](source)
    return root, source.error(root)
