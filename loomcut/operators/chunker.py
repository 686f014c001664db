"""One file from source to chunks: windows over the tree, text, scope and context.

Everything here is plain Python over one file; ``loomcut.operators.code`` runs
it over tables of files.  Offsets inside are code points and leave as UTF-16
units; sizes count characters that aren't white space, in UTF-16 units too.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np

from loomcut.functions.text import LANGUAGE_OF
from loomcut.lang import Node, Source, parse
from loomcut.operators.entities import Entity, extract

_JS_SPACE = re.compile("[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")
_IDENTIFIER = re.compile(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", re.ASCII)


class UnsupportedLanguage(ValueError):
    tag = "UnsupportedLanguageError"


class ChunkingFailed(RuntimeError):
    tag = "ChunkingError"


@dataclass(frozen=True)
class Options:
    """``compat="reference"`` repeats whole lines where an oversized leaf is split; ``"exact"`` keeps pieces apart."""

    max_chunk_size: int = 1500
    context_mode: str = "full"
    sibling_detail: str = "signatures"
    filter_imports: bool = False
    language: str | None = None
    overlap_lines: int = 10
    extraction: str = "patterns"
    compat: str = "reference"


@dataclass
class Window:
    nodes: list[Node]
    size: int
    partial: bool = False
    lines: list[tuple[int, int]] | None = None
    span: tuple[int, int] | None = None  # of what holds a part of a leaf, exactly

    def extent(self) -> tuple[int, int]:
        return self.span or (self.nodes[0].start, self.nodes[-1].end)


class Level(list):
    """Scopes side by side, in order of their starts; ``reach`` is the furthest end up to each."""

    def __init__(self):
        super().__init__()
        self.starts: list[int] = []
        self.reach: list[int] = []

    def add(self, s: Scope) -> None:
        s.place = len(self)
        self.append(s)
        self.starts.append(s.entity.start)
        self.reach.append(max(s.entity.end, self.reach[-1]) if self.reach else s.entity.end)

    def holding(self, start: int, end: int) -> Scope | None:
        """The first scope that begins at ``start`` or before and doesn't end before ``end``."""
        i = bisect_left(self.reach, end)
        return self[i] if i < len(self) and self.starts[i] <= start else None


@dataclass(eq=False)
class Scope:
    entity: Entity
    children: Level = field(default_factory=Level)
    parent: Scope | None = None
    place: int = 0


def detect(path: str) -> str | None:
    return LANGUAGE_OF.get(path[path.rindex(".") :]) if "." in path else None


class Counts:
    """Prefix sums of characters that aren't white space (code 32 or below), and UTF-16 offsets."""

    def __init__(self, code: str):
        c = np.frombuffer(code.encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = c > 0xFFFF
        self._sums = self._before((c > 32) + wide.astype(np.int64))
        self._units = self._before(1 + wide.astype(np.int64)) if wide.any() else None

    @staticmethod
    def _before(sizes: np.ndarray) -> array:
        return array("q", np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64).tobytes())

    @property
    def nws(self) -> list[int]:
        return self._sums.tolist()

    def size(self, start: int, end: int) -> int:
        return self._sums[end] - self._sums[start]

    def utf16(self, at: int) -> int:
        return self._units[at] if self._units else at


def greedy(nodes: list[Node], source: Source, counts: Counts, most: int) -> Iterator[Window]:
    """Windows of neighbouring nodes; a node over the limit is entered, and a leaf over it split by lines."""
    stack = [(nodes, 0, Window([], 0))]
    while stack:
        nodes, i, now = stack.pop()
        while i < len(nodes):
            n = nodes[i]
            i += 1
            s = counts.size(n.start, n.end)
            if now.size + s <= most:
                now.nodes.append(n)
                now.size += s
            elif s > most:
                if now.nodes:
                    yield now
                now = Window([], 0)
                if n.children:
                    stack.append((nodes, i, now))
                    nodes, i = n.children, 0
                    now = Window([], 0)
                else:
                    yield from split_leaf(n, source, most)
            else:
                if now.nodes:
                    yield now
                now = Window([n], s)
        if now.nodes:
            yield now


def split_leaf(n: Node, source: Source, most: int) -> Iterator[Window]:
    lines = source.text(n).split("\n")
    begin = at = n.start
    size = 0
    for i, line in enumerate(lines):
        s = len(_JS_SPACE.sub("", line)) + sum(c > "￿" for c in line)
        long = len(line) + (i < len(lines) - 1)
        if size + s > most:
            if at > begin:
                yield Window([n], size, True, [(source.row(begin), source.row(at))], (begin, at))
            begin, size = at, 0
        at += long
        size += s
    if at > begin:
        yield Window([n], size, True, [(source.row(begin), source.row(at))], (begin, at))


def merged(windows: Iterator[Window], most: int) -> Iterator[Window]:
    now: Window | None = None
    for w in windows:
        if now is None:
            now = w
        elif now.size + w.size <= most:
            lines = now.lines + w.lines if now.lines and w.lines else None
            span = (now.extent()[0], w.extent()[1]) if now.partial or w.partial else None
            now.nodes += w.nodes
            now = Window(now.nodes, now.size + w.size, now.partial or w.partial, lines, span)
        else:
            yield now
            now = w
    if now is not None:
        yield now


def rebuilt(w: Window, source: Source, compat: str) -> tuple[int, int, int, int]:
    """Offsets and first and last line of a window's text."""
    if w.partial and compat == "exact" and w.span:
        return (*w.span, source.row(w.span[0]), source.row(w.span[1]))
    if w.partial and w.lines:
        first, last = w.lines[0][0], w.lines[-1][1]
        return source.lines[first], source.lines[last + 1] if last + 1 < len(source.lines) else len(source.code), first, last
    a, b = w.nodes[0], w.nodes[-1]
    return a.start, b.end, source.row(a.start), source.row(b.end)


def scope_tree(entities: list[Entity]) -> Level:
    """Roots of the scope tree: each entity under the deepest earlier one that contains it."""
    roots = Level()
    for e in sorted((e for e in entities if e.type not in ("import", "export")), key=lambda e: e.start):
        node, level, up = Scope(e), roots, None
        while (inside := level.holding(e.start, e.end)) is not None:
            up, level = inside, inside.children
        node.parent = up
        level.add(node)
    return roots


def scope_at(roots: Level, at: int) -> Scope | None:
    found, level = None, roots
    while (inside := level.holding(at, at + 1)) is not None:
        found, level = inside, inside.children
    return found


def chain(s: Scope | None) -> list[Scope]:
    out = []
    while s is not None:
        out.append(s)
        s = s.parent
    return out


def flattened(roots: Level) -> list[Scope]:
    """All scopes, depth first."""
    out, stack = [], list(reversed(roots))
    while stack:
        s = stack.pop()
        out.append(s)
        stack += reversed(s.children)
    return out


def ancestors(nodes: list[Node]) -> list[Node]:
    """Distinct ancestors of some nodes, nearest first."""
    seen: dict[int, Node] = {}
    for n in nodes:
        p = n.parent
        while p is not None and id(p) not in seen:
            seen[id(p)] = p
            p = p.parent
    return list(seen.values())


def _siblings(roots: Level, start: int, end: int, detail: str, most: int = 3) -> list[dict]:
    """The nearest scopes on the level of where a chunk begins, looked for from there to either side."""
    if detail == "none":
        return []
    now = scope_at(roots, start)
    level = (now.parent.children if now.parent else roots) if now else roots
    here, n = now.place if now else -1, len(level)
    first = bisect_left(level.starts, start)  # what comes before it is before, the rest after
    out = []
    for side, near in (
        ("before", [range((min(first, here) if now else first) - 1, -1, -1), range(here + 1, first) if now else range(0)]),
        ("after", [range(max(first, here + 1), n), range(here - 1, first - 1, -1)]),
    ):
        found = []
        for places in near:
            some = 0
            for i in places:
                e = level[i].entity
                if e.start < end and e.end > start:
                    continue
                found.append((abs(i - here) if now else n - i if side == "before" else i + 1, i))
                some += 1
                if some == most:
                    break
        for distance, i in sorted(found)[:most]:
            e = level[i].entity
            out.append({"name": e.name, "type": e.type, "position": side, "distance": distance})
    return out


class Entities(list):
    """A file's entities, to be asked for those that a range overlaps and for imports."""

    def __init__(self, entities: list[Entity]):
        super().__init__(entities)
        self.order = sorted(range(len(self)), key=lambda i: self[i].start)
        self.starts = [self[i].start for i in self.order]
        self.leaves = 1 << max(0, len(self) - 1).bit_length()
        self.ends = [-1] * (2 * self.leaves)  # a tree of the furthest ends, in order of starts
        for k, i in enumerate(self.order):
            self.ends[self.leaves + k] = self[i].end
        for k in range(self.leaves - 1, 0, -1):
            self.ends[k] = max(self.ends[2 * k], self.ends[2 * k + 1])
        self.imports = [e for e in self if e.type == "import"]
        self.named: dict[str, list[int]] = {}
        for k, e in enumerate(self.imports):
            self.named.setdefault(e.name, []).append(k)

    def overlapping(self, start: int, end: int) -> list[Entity]:
        """Those that begin before ``end`` and end after ``start``, in the file's order."""
        n, found, stack = bisect_left(self.starts, end), [], [(1, 0, self.leaves)]
        while stack:
            k, low, width = stack.pop()
            if low >= n or self.ends[k] <= start:
                continue
            if width == 1:
                found.append(self.order[low])
            else:
                width //= 2
                stack += [(2 * k, low, width), (2 * k + 1, low + width, width)]
        return [self[i] for i in sorted(found)]

    def imported(self, names: set[str]) -> list[Entity]:
        return [self.imports[k] for k in sorted(k for name in names for k in self.named.get(name, ()))]


def context(entities: Entities, roots: Level, counts: Counts, path: str, language: str, start: int, end: int, o: Options) -> dict:
    if o.context_mode == "none":
        return {"filepath": None, "language": None, "scope": [], "entities": [], "siblings": [], "imports": []}
    inside = entities.overlapping(start, end)
    info = [{"name": e.name, "type": e.type, "signature": e.signature, "docstring": e.docstring, "line_range": {"start": e.line_start, "end": e.line_end}, "is_partial": e.start < start or e.end > end} for e in inside]
    imports = entities.imports
    if o.filter_imports:
        imports = entities.imported({e.name for e in inside} | {w for e in inside for w in _IDENTIFIER.findall(e.signature or "")})
    return {
        "filepath": path,
        "language": language,
        "scope": [{"name": s.entity.name, "type": s.entity.type, "signature": s.entity.signature} for s in chain(scope_at(roots, start))],
        "entities": info,
        "siblings": _siblings(roots, start, end, o.sibling_detail),
        "imports": [{"name": e.name, "source": e.source or ""} for e in imports],
    }


def format_chunk_with_context(text: str, ctx: dict, overlap: str | None = None) -> str:
    """``text`` under comment lines that tell its file, scope, definitions, imports and neighbours."""
    head = []
    if ctx.get("filepath"):
        head.append("# " + "/".join(ctx["filepath"].split("/")[-3:]))
    if ctx["scope"]:
        head.append("# Scope: " + " > ".join(s["name"] for s in reversed(ctx["scope"])))
    if defined := [e["signature"] for e in ctx["entities"] if e["type"] != "import" and e["signature"]]:
        head.append("# Defines: " + ", ".join(defined))
    if ctx["imports"]:
        head.append("# Uses: " + ", ".join(i["name"] for i in ctx["imports"][:10]))
    for side, label in (("before", "# After: "), ("after", "# Before: ")):
        if names := [s["name"] for s in ctx["siblings"] if s["position"] == side]:
            head.append(label + ", ".join(names))
    if head:
        head.append("")
    if overlap:
        head += ["# ...", overlap, "# ---"]
    return "\n".join([*head, text])


def stream(path: str, code: str, options: Options = Options()) -> Iterator[dict]:
    """Chunks of one file, lazily; ``total_chunks`` is -1."""
    language = options.language or detect(path)
    if language is None:
        raise UnsupportedLanguage(f"Unsupported file type: {path}")
    source, counts = Source(code), Counts(code)
    root, error = parse(code, language)
    entities = Entities(extract(root, source, language, options.extraction))
    roots = scope_tree(entities)
    before = ""
    for i, w in enumerate(merged(greedy(root.children, source, counts, options.max_chunk_size), options.max_chunk_size)):
        start, end, first, last = rebuilt(w, source, options.compat)
        text = code[start:end]
        ctx = context(entities, roots, counts, path, language, start, end, options)
        ctx["parse_error"] = asdict(error) if error else None
        overlap = "\n".join(before.split("\n")[-options.overlap_lines :]) if i and options.overlap_lines > 0 and before else None
        yield {
            "text": text,
            "contextualized_text": format_chunk_with_context(text, ctx, overlap),
            "byte_range": {"start": counts.utf16(start), "end": counts.utf16(end)},
            "line_range": {"start": first, "end": last},
            "context": ctx,
            "index": i,
            "total_chunks": -1,
        }
        before = text


def chunk(path: str, code: str, options: Options = Options()) -> list[dict]:
    """Chunks of one file; none if it holds white space only."""
    out = list(stream(path, code, options)) if code.strip() else _supported(path, options)
    for c in out:
        c["total_chunks"] = len(out)
    return out


def _supported(path: str, options: Options) -> list[dict]:
    if options.language is None and detect(path) is None:
        raise UnsupportedLanguage(f"Unsupported file type: {path}")
    return []


def entities_of(path: str, code: str, language: str | None = None, mode: str = "patterns") -> tuple[list[Entity], str | None]:
    """Entities of one file, and its parse error if any."""
    language = language or detect(path)
    if language is None:
        raise UnsupportedLanguage(f"Unsupported file type: {path}")
    root, error = parse(code, language)
    return extract(root, Source(code), language, mode), error.message if error else None
