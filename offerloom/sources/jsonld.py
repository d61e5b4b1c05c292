"""JSON-LD of pages as rows: every object with its place, its plain keys and its canonical text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .html import explode_pages


class _Blocks(HTMLParser):
    """The texts of all JSON-LD scripts, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self._inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "script" and not self._inside:
            kind = next((v or "" for k, v in attrs if k == "type"), "")
            if kind.casefold().split(";", 1)[0].strip() == "application/ld+json":
                self._inside = True
                self.found.append("")

    def handle_endtag(self, tag):
        if tag == "script":
            self._inside = False

    def handle_data(self, data):
        if self._inside:
            self.found[-1] += data


def _plain(value) -> bool:
    return isinstance(value, (str, int, float))


def _objects(value, path: str) -> Iterator[tuple[str, dict]]:
    """Objects below a value, each before those inside it."""
    stack = [(path, value)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            yield path, value
            stack += [(f"{path}.{k}", v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            stack += [(f"{path}[{k}]", v) for k, v in reversed(list(enumerate(value)))]


def objects_of(asset: str, html: str) -> list[dict]:
    """Objects that have plain keys: those whose value is a scalar or a list of scalars, and not empty.
    A script that is no JSON gives one row with a warning."""
    parser, out = _Blocks(), []
    parser.feed(html)
    parser.close()
    for number, block in enumerate(parser.found, 1):
        try:
            found = list(_objects(json.loads(block), f"script[{number}]"))
        except ValueError:
            out.append({"position": len(out), "warning": f"malformed_jsonld:script[{number}]"})
            continue
        for path, value in found:
            keys = [k for k, v in value.items() if (_plain(v) and v != "") or (isinstance(v, list) and v and all(map(_plain, v)))]
            if keys:
                kind = value.get("@type")
                text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
                out.append({"position": len(out), "source_ref": path, "keys": keys, "object": text, "type": kind if kind is None or isinstance(kind, str) else json.dumps(kind, ensure_ascii=False)})
    return out


OBJECT = "position int, source_ref string, keys array<string>, object string, type string, warning string"


def objects(pages: DataFrame, key: str) -> DataFrame:
    return explode_pages(pages, key, objects_of, OBJECT)
