"""HTML pages as Markdown."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands before and after the content of a tag; runs of breaks are evened out in the end.
_AROUND = {f"h{n}": ("\n\n" + "#" * n + " ", "\n\n") for n in range(1, 7)}
_AROUND |= dict.fromkeys(("p", "div", "section", "article", "blockquote"), ("\n\n", "\n\n"))
_AROUND |= {"br": ("\n", ""), "li": ("\n\n- ", "\n\n")}
_HIDDEN = {"script", "style"}


class _Writer(HTMLParser):
    """Collects text and what stands around tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def _put(self, text: str) -> None:
        if not self.hidden:
            self.out.append(text)

    def handle_starttag(self, tag: str, attrs) -> None:
        self.hidden += tag in _HIDDEN
        self._put(_AROUND.get(tag, ("", ""))[0])

    def handle_endtag(self, tag: str) -> None:
        self._put(_AROUND.get(tag, ("", ""))[1])
        self.hidden = max(0, self.hidden - (tag in _HIDDEN))

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._put(re.sub(r"\s+", " ", unescape(data)))


def markdown_of(html: str) -> str:
    """Headings, paragraphs, line breaks and list items of a page; scripts and styles left out."""
    writer = _Writer()
    writer.feed(html)
    writer.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(writer.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def html_to_markdown(pages: Column) -> Column:
    """markdown_of as a column, in Arrow batches."""

    @F.pandas_udf("string")
    def convert(p: pd.Series) -> pd.Series:
        return p.map(lambda h: markdown_of(h or ""))

    return convert(pages)
