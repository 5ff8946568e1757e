"""HTML pages through the standard library's parser, in Arrow batches.

A page becomes one struct: title, headings in document order (level, text, first link), all links,
text of the main part, text of the story part, and its source line.  Everything after that - which
headings are items, which region they belong to - is DataFrame code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = "title string, headings array<struct<level:int,text:string,href:string>>, links array<string>, main string, story string, source string"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style", "template"))
# Names by which a source line in brackets is known.
SOURCE = re.compile(r"\(([^)]*(?:Jón|Árnason|Þjóðsagnasafn|safn|Maurer)[^)]*)\)")


def selector(text: str) -> Callable[[str, dict], bool]:
    """Whether an element is one that a simple selector means: a tag, ``.class`` and ``#id``, any of them
    together, as in ``div.post#main``; of classes all."""
    if not re.fullmatch(r"[\w-]*(?:[.#][\w-]+)*", text) or not text:
        raise ValueError(f"no simple selector: {text}")
    tag = re.match(r"[\w-]*", text)[0].lower()
    classes, ids = set(re.findall(r"\.([\w-]+)", text)), set(re.findall(r"#([\w-]+)", text))

    def meant(name: str, values: dict) -> bool:
        return (not tag or name == tag) and classes <= set((values.get("class") or "").split()) and ids <= {values.get("id")}

    return meant


_OPEN_REFERENCE = re.compile(r"&(?!(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")


class PageReader(HTMLParser):
    """One pass over a page.  Text pieces are kept with the elements that were open around them."""

    def __init__(self, main: str):
        super().__init__(convert_charrefs=True)
        self.is_main = selector(main)
        self.open: list[tuple[str, bool]] = []
        self.title: list[str] = []
        self.title_done = False
        self.headings: list[dict] = []
        self.links: list[str] = []
        self.main: list[str] = []
        self.main_depth: int | None = None
        self.main_done = False
        self.quotes: list[list[str]] = []
        self.quote_depth = 0
        self.body: list[str] = []
        self.all: list[str] = []
        self.credit: list[str] | None = None
        self.in_credit = False
        self.heading: dict | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = dict(attrs)
        if tag in ("p", "br"):
            self._break()
        if tag == "a" and values.get("href") is not None:
            self.links.append(values["href"])
            if self.heading is not None and self.heading["href"] is None:
                self.heading["href"] = values["href"]
        if re.fullmatch("h[1-6]", tag):
            self.heading = {"level": int(tag[1]), "text": [], "href": None}
            self.headings.append(self.heading)
            if tag == "h6" and self.credit is None:
                self.credit, self.in_credit = [], True
        if tag == "blockquote":
            self.quote_depth += 1
            self.quotes.append([])
        if self.main_depth is None and not self.main_done and self.is_main(tag, values):
            self.main_depth = len(self.open)
        if tag not in _VOID:
            self.open.append((tag, tag == "blockquote"))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _ in self.open]:
            return
        while self.open:
            name, quote = self.open.pop()
            self.quote_depth -= quote
            if re.fullmatch("h[1-6]", name):
                self.heading, self.in_credit = None, False
            if name == "title":
                self.title_done = True
            if self.main_depth is not None and len(self.open) <= self.main_depth:
                self.main_depth, self.main_done = None, True
            if name == tag:
                break

    def _break(self) -> None:
        if self.quote_depth:
            self.quotes[-1].append("\n\n")
        self.body.append("\n\n")

    def handle_data(self, data: str) -> None:
        names = [t for t, _ in self.open]
        if _SILENT & set(names):
            return
        if "title" in names:
            if not self.title_done:
                self.title.append(data)
            return
        self.all.append(data)
        if self.heading is not None:
            self.heading["text"].append(data.strip())
        if self.in_credit and self.credit is not None:
            self.credit.append(data.strip())
        if self.main_depth is not None and data.strip():
            self.main.append(data.strip())
        if self.quote_depth:
            self.quotes[-1].append(data)
        if "body" in names or "html" not in names:
            self.body.append(data)

    def result(self) -> dict:
        if self.credit is not None:
            source = "".join(self.credit).strip("()")
        else:
            found = SOURCE.search("".join(self.all))
            source = found.group(1) if found else ""
        headings = [h | {"text": "".join(h["text"])} for h in self.headings]
        story = paragraphs("".join(self.quotes[-1] if self.quotes else self.body))
        return {"title": "".join(self.title).strip(), "headings": headings, "links": self.links, "main": " ".join(" ".join(self.main).split()), "story": story, "source": source}


def paragraphs(text: str) -> str:
    """Line ends unified, soft ones joined, blank ones kept once."""
    text = re.sub(r"\r\r\n|\r\n|\r", "\n", text)
    lines = (" ".join(p.split()) for p in re.sub(r"\n{3,}", "\n\n", text).split("\n\n"))
    return "\n\n".join(x for x in lines if x)


def read_page(html: str | None, main: str, closed: bool = False) -> dict:
    reader = PageReader(main)
    html = html or ""
    reader.feed(_OPEN_REFERENCE.sub("&amp;", html) if closed else html)
    reader.close()
    return reader.result()


def parsed(html: Column, main: str = ".elementor-widget-theme-post-content", closed: bool = False) -> Column:
    """The page struct of an HTML column; null counts as an empty page.  The text of the first element that
    the selector ``main`` means is the page's main part.  A reference without its semicolon (``&amp``) is the
    sign it names, as in browsers; with ``closed`` it stays as it is written."""
    selector(main)

    @F.pandas_udf(PAGE)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([read_page(x, main, closed) for x in batch], columns=["title", "headings", "links", "main", "story", "source"])

    return parse(html)
