"""HTML link extraction with the standard library's parser.

Slower than :mod:`linkloom.functions.markup`; used where exact tag-soup
handling matters more than speed, and by the tests to check the fast form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from linkloom.functions.markup import LINK_RULES


def _page_links(html: str) -> list[tuple[str, int]]:
    from html.parser import HTMLParser

    rules = {element: (attribute, kind) for element, attribute, kind in LINK_RULES}
    found: list[tuple[str, int]] = []

    class Reader(HTMLParser):
        skipping = None

        def handle_starttag(self, tag, attrs):
            if self.skipping:
                return
            if tag in ("noscript", "iframe", "xmp", "noembed", "noframes", "title", "textarea"):
                self.skipping = tag
            attribute, kind = rules.get(tag, (None, None))
            for name, value in attrs:
                if name == attribute:
                    found.append((value or "", kind))
                    break

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)

        def handle_endtag(self, tag):
            if tag == self.skipping:
                self.skipping = None

    reader = Reader(convert_charrefs=True)
    reader.feed(html)
    reader.close()
    return found


def html_links_exact(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, raw, tag)`` of every link-bearing tag, parsed on the executors."""
    key_type = pages.schema[key].dataType.simpleString()

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, raw, tag)
                for k, text in zip(batch[key], batch[html])
                if text is not None
                for raw, tag in _page_links(text)
            ]
            yield pd.DataFrame(rows, columns=[key, "raw", "tag"])

    return pages.select(key, html).mapInPandas(extract, f"`{key}` {key_type}, raw string, tag int")
