"""CSS selectors over pages: all selectors of a page's profiles in one sweep.

A selector is a path of steps; a step tests one node, and a sign before it says how the node lies to
that of the step before. All steps of all selectors of a page become bits of one number, so a sweep
over the nodes in document order carries the steps that ancestors, the parent and earlier siblings
have reached, and a node advances all selectors at once: a bit-parallel automaton. ``:scope`` stands for
the node that a search starts from.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

from .html import VOID, Reader

#: Elements whose strings are no text of the elements around them.
SILENT = {"script", "style", "template"}

_NAME = r"-?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff-]*"
_TOKEN = re.compile(
    rf"(?P<tag>\*|{_NAME})|\#(?P<id>[\w\u0080-\U0010ffff-]+)|\.(?P<cls>{_NAME})"
    rf"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<how>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\s\]]+))\s*(?P<fold>[iI])?\s*)?\]"
    r"|:(?P<pseudo>[a-z-]+)(?:\((?P<arg>[^()]*(?:\([^()]*\)[^()]*)*)\))?"
)
_BETWEEN = re.compile(r"\s*([>+~])\s*|\s+")


class SelectorError(ValueError):
    """A selector that cannot be read."""


class Tree(Reader):
    """A page as parallel lists in document order, with its strings in that order too.

    Node 0 is the document; ``end[i]`` is one past the last node below i, and the strings below i are
    ``text_from[i]`` to ``text_to[i]``.
    """

    def __init__(self, html: str, without: frozenset[str] = frozenset()):
        super().__init__()
        self._without, self._hidden = without, []  # elements left out with all inside them
        self.pieces = [0]  # strings, comments and elements right below a node
        self.tag, self.attrs, self.parent = ["document"], [{}], [-1]
        self.end, self.text_from, self.text_to = [0], [0], [0]
        self.before: list[int] = [-1]  # the sibling before
        self.place, self.place_of_type, self.children = [1], [1], [0]
        self.strings: list[tuple[str, int]] = []
        self._open, self._last, self._kinds, self._parts = [0], {}, {}, []
        self.read(html)
        self._flush()
        while self._open:
            self._pop()

    def _flush(self) -> None:
        self.pieces[self._open[-1]] += bool(self._parts)
        if text := "".join(self._parts).strip():
            self.strings.append((text, self._open[-1]))
        self._parts.clear()

    def _pop(self) -> None:
        i = self._open.pop()
        self.end[i], self.text_to[i] = len(self.tag), len(self.strings)

    def handle_starttag(self, tag, attrs):
        tag = self.plain(tag)
        self._flush()
        if self._hidden or tag in self._without:
            if tag not in VOID:
                self._hidden.append(tag)
            return
        self.pieces[self._open[-1]] += 1
        above, i = self._open[-1], len(self.tag)
        kind = above, tag
        self._kinds[kind] = self._kinds.get(kind, 0) + 1
        self.children[above] += 1
        for column, value in (
            (self.tag, tag), (self.attrs, dict((self.plain(k), self.plain(v or "")) for k, v in reversed(attrs))), (self.parent, above), (self.end, i + 1), (self.text_from, len(self.strings)), (self.text_to, len(self.strings)),
            (self.before, self._last.get(above, -1)), (self.place, self.children[above]), (self.place_of_type, self._kinds[kind]), (self.children, 0), (self.pieces, 0),
        ):
            column.append(value)
        self._last[above] = i
        if tag not in VOID:
            self._open.append(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        tag = self.plain(tag)
        self._flush()
        if self._hidden:
            if tag in self._hidden:
                while self._hidden.pop() != tag:
                    pass
            return
        at = next((k for k in range(len(self._open) - 1, 0, -1) if self.tag[self._open[k]] == tag), None)
        while at is not None and len(self._open) > at:
            self._pop()

    def handle_data(self, data):
        if not self._hidden:
            self._parts.append(self.plain(data))

    def handle_comment(self, data):
        self._flush()
        self.pieces[self._open[-1]] += not self._hidden

    handle_decl = handle_pi = handle_comment

    def text(self, i: int, joint: str = " ", most: int | None = None) -> str:
        """The strings below a node, or the first ``most`` characters of them; those of scripts and styles only if it is one itself."""
        below = (self.strings[k] for k in range(self.text_from[i], self.text_to[i]))
        shown = (s for s, owner in below if owner == i or self.tag[owner] not in SILENT)
        if most is None:
            return joint.join(shown)
        parts, size = [], 0
        for s in shown:
            parts.append(s)
            if (size := size + len(s) + len(joint)) >= most + len(joint):
                break
        return joint.join(parts)[:most]

    def only_string(self, i: int) -> str:
        """The string of a node that holds one string and nothing else, at whatever depth, or nothing."""
        while self.pieces[i] == 1 and self.children[i]:
            i += 1
        return self.text(i) if self.pieces[i] == 1 else ""


class Step(NamedTuple):
    """A test of one node and its relation to the step before: none, below, child, next or later."""

    relation: str
    tag: str | None
    scope: bool
    tests: tuple[Callable[[Tree, int], bool], ...]


def _formula(arg: str) -> tuple[int, int]:
    arg = re.sub(r"\s+", "", arg.casefold())
    if arg in ("odd", "even"):
        return 2, int(arg == "odd")
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", arg)
    if not m:
        raise SelectorError(f"not a position: {arg!r}")
    if m[3]:
        return 0, int(m[3])
    return int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)


def _at(step: int, first: int, place: int) -> bool:
    return place == first if step == 0 else (place - first) % step == 0 and (place - first) // step >= 0


def _attribute(name: str, how: str | None, value: str, fold: bool) -> Callable[[Tree, int], bool]:
    name, value = name.casefold(), value.casefold() if fold else value
    tests: dict[str | None, Callable[[str], bool]] = {
        None: lambda x: True, "=": lambda x: x == value, "~=": lambda x: bool(value) and value in x.split(), "|=": lambda x: x == value or x.startswith(value + "-"),
        "^=": lambda x: bool(value) and x.startswith(value), "$=": lambda x: bool(value) and x.endswith(value), "*=": lambda x: bool(value) and value in x,
    }
    fits = tests[how]
    return lambda t, i: name in t.attrs[i] and fits(t.attrs[i][name].casefold() if fold else t.attrs[i][name])


def _pseudo(name: str, arg: str | None) -> Callable[[Tree, int], bool]:
    if name in ("nth-child", "nth-of-type") and arg is not None:
        step, first = _formula(arg)
        return (lambda t, i: _at(step, first, t.place[i])) if name == "nth-child" else (lambda t, i: _at(step, first, t.place_of_type[i]))
    if name == "not" and arg:
        inner = [_compound(x.strip(), "") for x in arg.split(",")]
        return lambda t, i: not any((s.tag in (None, t.tag[i])) and all(f(t, i) for f in s.tests) for s in inner)
    plain: dict[str, Callable[[Tree, int], bool]] = {
        "first-child": lambda t, i: t.place[i] == 1,
        "first-of-type": lambda t, i: t.place_of_type[i] == 1,
        "last-child": lambda t, i: t.place[i] == t.children[t.parent[i]],
        "only-child": lambda t, i: t.children[t.parent[i]] == 1,
        "empty": lambda t, i: t.children[i] == 0 and t.text_from[i] == t.text_to[i],
        "root": lambda t, i: t.parent[i] == 0,
    }
    if name not in plain or arg is not None:
        raise SelectorError(f"unknown pseudo-class :{name}")
    return plain[name]


def _compound(text: str, relation: str) -> Step:
    tag, scope, tests, at = None, False, [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or (m["tag"] and at):
            raise SelectorError(f"cannot read {text!r}")
        if m["tag"]:
            tag = None if m["tag"] == "*" else m["tag"].casefold()
        elif m["id"]:
            tests.append(_attribute("id", "=", m["id"], False))
        elif m["cls"]:
            tests.append(_attribute("class", "~=", m["cls"], False))
        elif m["attr"]:
            tests.append(_attribute(m["attr"], m["how"], next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), ""), bool(m["fold"])))
        elif m["pseudo"] == "scope":
            scope = True
        else:
            tests.append(_pseudo(m["pseudo"], m["arg"]))
        at = m.end()
    if not text:
        raise SelectorError("a step is missing")
    return Step(relation, tag, scope, tuple(tests))


def _split(selector: str, marks: str) -> Iterator[tuple[str, int]]:
    """(character, place) of the marks outside brackets, parentheses and quotes."""
    depth, quote = 0, ""
    for k, c in enumerate(selector):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        elif not depth and c in marks:
            yield c, k


@lru_cache(maxsize=4096)
def parse(selector: str) -> tuple[tuple[Step, ...], ...]:
    """The alternatives of a selector, each a path of steps."""
    cuts = [-1, *(k for _, k in _split(selector, ",")), len(selector)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        path = selector[a + 1 : b].strip()
        outside = {k for _, k in _split(path, " \t\n\r\f>+~")}
        steps, at, relation = [], 0, ""
        if path[:1] in (">", "+", "~"):
            raise SelectorError(f"{selector!r} begins with a relation")
        while at <= len(path):
            stop = next((k for k in range(at, len(path)) if k in outside), len(path))
            steps.append(_compound(path[at:stop], relation))
            if stop == len(path):
                break
            m = _BETWEEN.match(path, stop)
            relation, at = {None: "below", ">": "child", "+": "next", "~": "later"}[m[1]], m.end()
        out.append(tuple(steps))
    return tuple(out)


class Automaton:
    """Selectors compiled together: one bit for each step of each path."""

    def __init__(self, selectors: Iterable[str]):
        self.start = 0
        self.by = dict.fromkeys(("below", "child", "next", "later"), 0)
        self.scoped: set[str] = set()
        self.final: dict[str, int] = {}
        self.any_tag, self.by_tag = [], {}
        bit = 1
        for selector in dict.fromkeys(selectors):
            ends = 0
            for path in parse(selector):
                for step in path:
                    if step.relation:
                        self.by[step.relation] |= bit
                    else:
                        self.start |= bit
                    (self.any_tag if step.tag is None else self.by_tag.setdefault(step.tag, [])).append((bit, step))
                    if step.scope:
                        self.scoped.add(selector)
                    ends, last, bit = ends, bit, bit << 1
                ends |= last
            self.final[selector] = ends

    def sweep(self, tree: Tree, scope: int = 0) -> dict[str, list[int]]:
        """Selector -> nodes it matches below ``scope``, in document order."""
        # A search may start at any node, so a path of another's ancestors counts; :scope is one node.
        n = tree.end[scope]
        first = 0 if scope == 0 else scope
        reached, above, earlier = {}, {}, {}
        found: dict[str, list[int]] = {s: [] for s in self.final}
        every = 0
        for ends in self.final.values():
            every |= ends
        for i in range(first, n):
            p, b = tree.parent[i], tree.before[i]
            can = self.start | (self.by["below"] & above.get(p, 0) << 1) | (self.by["child"] & reached.get(p, 0) << 1)
            if b >= first:
                can |= (self.by["next"] & reached.get(b, 0) << 1) | (self.by["later"] & earlier.get(b, 0) << 1)
            now = 0
            for bit, step in (*self.any_tag, *self.by_tag.get(tree.tag[i], ())):
                if can & bit and (not step.scope or i == scope) and (i or step.scope) and all(f(tree, i) for f in step.tests):
                    now |= bit
            reached[i] = now
            above[i] = above.get(p, 0) | now
            earlier[i] = now | (earlier.get(b, 0) if b >= first else 0)
            if now & every:
                for selector, ends in self.final.items():
                    if now & ends and (i != scope or scope == 0):
                        found[selector].append(i)
        return found


class Finder:
    """What the selectors of a page match, and the first match inside a node."""

    def __init__(self, tree: Tree, selectors: Iterable[str]):
        self.tree = tree
        self.whole = Automaton(selectors)
        self.found = self.whole.sweep(tree)
        self._inside: dict[int, dict[str, int | None]] = {}
        self._scoped = Automaton(sorted(self.whole.scoped)) if self.whole.scoped else None

    def all(self, selector: str) -> list[int]:
        return self.found[selector]

    def first(self, node: int, selector: str) -> int | None:
        """As a search from the node: a match lies below it, but its path may begin above it;
        ``:scope`` alone is the node."""
        if selector == ":scope":
            return node
        if self._scoped and selector in self.whole.scoped:
            if node not in self._inside:
                self._inside[node] = {s: next(iter(nodes), None) for s, nodes in self._scoped.sweep(self.tree, node).items()}
            return self._inside[node][selector]
        nodes = self.found[selector]
        k = bisect_right(nodes, node)
        return nodes[k] if k < len(nodes) and nodes[k] < self.tree.end[node] else None
