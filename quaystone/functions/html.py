"""HTML to text, and a page's short hash. Parsing a page has no built-in form: a pandas UDF around the standard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose text is left out, and those that start a new line.
LEFT_OUT = {"script", "style", "noscript", "svg", "nav", "header", "footer", "form", "button"}
NEW_LINE = {"p", "div", "li", "br", "tr", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd"}
#: What a line that one of these elements starts begins with.
MARKS = {"li": "- ", "h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### "}
OPEN, CLOSE, TEXT = range(3)


def events(page: str) -> Iterator[tuple[int, str]]:
    """The page as (OPEN or CLOSE, element) and (TEXT, text) in order."""
    found: list[tuple[int, str]] = []
    parser = HTMLParser()
    parser.handle_starttag = lambda tag, _: found.append((OPEN, tag))
    parser.handle_endtag = lambda tag: found.append((CLOSE, tag))
    parser.handle_data = lambda text: found.append((TEXT, text))
    parser.feed(page)
    parser.close()  # a tail that the parser still holds back, such as ``AT&T`` at the end
    return iter(found)


def visible_lines(page: str) -> list[str]:
    """The lines of text outside left-out elements: an element of NEW_LINE begins one where it opens and where it closes."""
    lines, hidden = [""], 0
    for kind, value in events(page):
        if kind == TEXT:
            lines[-1] += "" if hidden else value
        elif value in LEFT_OUT:  # a stray end closes nothing
            hidden = hidden + 1 if kind == OPEN else max(hidden - 1, 0)
        elif value in NEW_LINE:
            lines.append(MARKS.get(value, "") if kind == OPEN else "")
    return lines


def page_text(page: str) -> str:
    """Visible text: headings marked with #, list items with -, blanks squeezed, at most one empty line in a row.

    References that were escaped twice in the page are resolved too (the parser has resolved them once).
    """
    squeezed = [re.sub("[ \t\xa0]+", " ", line).strip() for line in unescape("\n".join(visible_lines(page))).splitlines()]
    runs = ([""] if blank else list(run) for blank, run in groupby(squeezed, key=lambda line: not line))
    return "\n".join(line for run in runs for line in run).strip() + "\n"


@F.pandas_udf(T.StringType())
def html_to_text(page: pd.Series) -> pd.Series:
    return page.map(lambda p: None if p is None else page_text(p))


def short_hash(page: Column) -> Column:
    """The first 16 hexadecimal digits of the page's SHA-256."""
    return F.substring(F.sha2(page, 256), 1, 16)
