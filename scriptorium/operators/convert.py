"""Text to text for a document at a time: HTML export and diffs. Arrow-batched functions.

HTML export reads a text into typed blocks first; a table of renderers writes them.
"""

from __future__ import annotations

import difflib
import html
import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Inline marks and the elements they become, applied in this order.
INLINE = (
    (r"\*\*(.+?)\*\*", r"<strong>\1</strong>"),
    (r"\*(.+?)\*", r"<em>\1</em>"),
    (r"`(.+?)`", r"<code>\1</code>"),
    (r"\[(.+?)\]\((.+?)\)", r'<a href="\2">\1</a>'),
)
#: What a line outside of fences is, by the first pattern that fits; the group is its content.
KINDS = (
    ("heading", re.compile(r"(?P<mark>#{1,6})\s+(?P<body>.*)")),
    ("row", re.compile(r"\s*\|(?P<body>.*)")),
    ("item", re.compile(r"\s*[-*+]\s+(?P<body>.*)")),
    ("quote", re.compile(r"\s*>(?P<body>.*)")),
    ("rule", re.compile(r"---+\s*$(?P<body>)")),
    ("blank", re.compile(r"\s*$(?P<body>)")),
    ("text", re.compile(r"(?P<body>.*)")),
)
#: Blocks that may stand inside an open table; any other closes it.
IN_TABLE = frozenset(("row", "heading", "fence"))


class Block(NamedTuple):
    kind: str
    body: str
    mark: str = ""
    lines: tuple[str, ...] = ()
    closed: bool = True


def blocks(markdown: str) -> Iterator[Block]:
    """A block for each line, and one for each fence with its lines."""
    lines = iter(markdown.split("\n"))
    for line in lines:
        if line.strip().startswith("```"):
            inside, closed = [], False
            for code in lines:
                if closed := code.strip().startswith("```"):
                    break
                inside.append(code)
            yield Block("fence", line.strip()[3:].strip(), lines=tuple(inside), closed=closed)
        else:
            kind, found = next((k, m) for k, p in KINDS if (m := p.match(line)))
            yield Block(kind, found["body"], found.groupdict().get("mark") or "")


def inline(text: str) -> str:
    return reduce(lambda t, rule: re.sub(rule[0], rule[1], t), INLINE, text)


def _fence(block: Block) -> str:
    code = [html.escape(x, quote=False) for x in block.lines]
    return "\n".join([f'<pre><code class="language-{block.body}">', *code, *["</code></pre>"] * block.closed])


RENDERERS: dict[str, Callable[[Block], str]] = {
    "fence": _fence,
    "heading": lambda b: f"<h{len(b.mark)}>{inline(b.body)}</h{len(b.mark)}>",
    "item": lambda b: f"<li>{inline(b.body)}</li>",
    "quote": lambda b: f"<blockquote>{inline(b.body.strip())}</blockquote>",
    "rule": lambda b: "<hr>",
    "blank": lambda b: "",
    "text": lambda b: f"<p>{inline(b.body)}</p>",
}


def _cells(body: str) -> list[str]:
    """The cells between a row's pipes; what follows the last pipe is none."""
    return [c.strip() for c in body.split("|")[:-1]]


def html_body(markdown: str | None) -> str:
    """Headings, lists, quotes, rules, tables, fences and paragraphs, one element a line; null gives an empty text.

    Only code is escaped. The first row of a table is its head, delimiter rows are left out. Headings and
    fences don't close a table. A fence without an end is closed after everything else.
    """
    out, table, loose = [], False, False
    for block in blocks(markdown or ""):
        if table and block.kind not in IN_TABLE:
            out.append("</tbody></table>")
            table = False
        if block.kind != "row":
            out.append(RENDERERS[block.kind](block))
            loose = not block.closed
            continue
        cells = [inline(c) for c in _cells(block.body)]
        if not all(re.match(r"[-:]+$", c) for c in cells):
            tag = "td" if table else "th"
            row = "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
            out.append(row if table else f"<table><thead>{row}</thead><tbody>")
            table = True
    return "\n".join([*out, *["</tbody></table>"] * table, *["</code></pre>"] * loose])


@F.pandas_udf(StringType())
def markdown_html(text: pd.Series) -> pd.Series:
    return text.map(html_body)


def diff(old: str | None, new: str | None) -> str:
    return "\n".join(difflib.unified_diff((old or "").splitlines(), (new or "").splitlines(), "old", "new", lineterm=""))


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([diff(a, b) for a, b in zip(old, new, strict=True)], dtype=object)
