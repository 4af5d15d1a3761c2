"""Article markup to text, one parse for both renderings."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.functions.text import _normal

# fixed values: elements that are removed, and cells that close each other
_SKIPPED = {"noscript", "script", "style"}
_CELLS = {"td", "th"}
_CELL_ENDS = {"td", "th", "tr", "table", "tbody", "thead", "tfoot"}


class _Reader(HTMLParser):
    """Text nodes in order; headline, chunk, cell and image rules apply to the clean rendering."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.clean: list = []  # strings, or a marker list that a headline fills or not
        self.dense: list[str] = []
        self.skip: list[str] = []
        self.heads: list[dict] = []
        self.cells = 0
        self.joined = [False, False]

    def _add(self, text: str, clean: bool = True, dense: bool = True, new: bool = False) -> None:
        for k, (out, wanted) in enumerate(((self.clean, clean), (self.dense, dense))):
            if not wanted:
                continue
            if self.joined[k] and not new and out:
                out[-1] += text
            else:
                out.append(text)
            self.joined[k] = not new

    def _break(self) -> None:
        self.joined = [False, False]

    def _close_cell(self) -> None:
        if self.cells:
            self.cells -= 1
            self._add(" | ", dense=False, new=True)

    def handle_starttag(self, tag, attrs):
        self._break()
        if tag in _SKIPPED:
            self.skip.append(tag)
            return
        if self.skip:
            return
        a = dict(attrs)
        if tag in _CELLS:
            self._close_cell()
            self.cells += 1
        elif tag == "headline":
            self.heads.append({"at": len(self.clean), "name": a.get("name") or "", "text": False})
        elif tag == "chunk" and (a.get("title") or "").strip():
            self._add(f" {_normal(a['title'])}. ", dense=False, new=True)
        elif tag == "img" and (alt := _normal(unquote(a.get("alt") or ""))):
            self._add(f" {alt} ", dense=False, new=True)

    def handle_endtag(self, tag):
        self._break()
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag in _CELL_ENDS:
            self._close_cell()
        elif tag == "headline" and self.heads:
            self._end_headline()

    def _end_headline(self) -> None:
        h = self.heads.pop()
        if not h["text"] and h["name"].strip():
            del self.clean[h["at"] :]
            self._add(f" {_normal(h['name'])} ", dense=False, new=True)

    def handle_data(self, data):
        if self.skip:
            return
        if data.strip():
            for h in self.heads:
                h["text"] = True
        self._add(data)

    def handle_comment(self, data):
        self._break()

    handle_decl = handle_pi = unknown_decl = handle_comment


def render(page: str | None) -> tuple[str | None, str | None]:
    if page is None:
        return None, None
    r = _Reader()
    r.feed(page)
    r.close()
    while r.heads:
        r._end_headline()
    while r.cells:
        r._close_cell()
    join = lambda parts: " ".join(p for p in (x.strip() for x in parts) if p)
    return _normal(join(r.clean)), join(r.dense)


@F.pandas_udf(StructType([StructField("clean", StringType()), StructField("dense", StringType())]))
def _render(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([render(p) for p in pages], columns=["clean", "dense"])


def rendered(c: Column) -> Column:
    """Struct of `clean` and `dense`."""
    return _render(c)
