"""Main text of web pages by the distribution of text over lines.

Markup is stripped first: one line for each block, character references decoded, white
space made single. What stands in elements that never hold an article's text (menus,
headers, footers, asides, forms, scripts, styles, and elements whose class or id says
advert, notice, comments and the like), or outside the ``article`` or ``main`` element of a
page that has one, has length 0. The lengths of the lines are summed over a sliding
window. Where the sum surges over ``SURGE`` characters, main text begins, and it ends where the
sum dives to nothing. This holds on every page; on one with no window over ``SURGE``, the largest windows surge.

What is found is then completed by short lines that the windows miss: those before a surge point with no gap
of a window's size between, in the same container, and those in the same container elsewhere (after an
advert within an article, say), if that is not the whole body. A container without a surge, an
article's teaser for instance, gives nothing.

Null and empty pages have empty text. Repeated rows are extracted alike.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.texts import chunked

WINDOW, SURGE = 3, 80
# Element names of HTML by what they do to text.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search
section summary table tbody td tfoot th thead title tr ul""".split())
NOISE = frozenset("""head title nav header footer aside form menu button select input textarea label fieldset dialog iframe
object svg canvas audio video map search""".split())
CONTAINERS = frozenset("article main section div td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|xmp"
_NOISE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|header|masthead|"
    r"menu\w*|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|related|share|sharing|"
    r"sidebar\w*|sign-?up|social|sponsor\w*|subscribe|toolbar|widgets?)(?=$|[\s_-])", re.I)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:\s+[^\s=>/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']*))?|[\s/]+)*+[^>]*)>", re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


def is_noise(name: str, more: str) -> bool:
    if name in NOISE:
        return True
    return name not in ("html", "body", "main") and any(_NOISE_NAME.search(" ".join(m.groups(""))) for m in _NAMED.finditer(more))


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """One line per block, empty where its text is noise or outside the article; the container of each, 0 for the body."""
    lines: list[str] = []
    inside: list[bool] = []
    held_by: list[int] = []
    containers: list[tuple[str, int]] = []
    buffer: list[str] = []
    noise: list[str] = []  # the open elements from the outermost noise element on
    articles, any_article, number = 0, False, 0

    def close() -> None:
        lines.append(" ".join("".join(buffer).split()))
        inside.append(articles > 0)
        held_by.append(containers[-1][1] if containers else 0)
        buffer.clear()

    at = 0
    for token in _TOKEN.finditer(page):
        if not noise and token.start() > at:
            buffer.append(html.unescape(page[at:token.start()]))
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            close()
        elif name == "br":
            buffer.append(" ")
        if token["end"]:
            if noise:
                if name in noise:
                    del noise[len(noise) - 1 - noise[::-1].index(name):]
                elif name in ("body", "html"):
                    noise.clear()
            else:
                if name in ("article", "main") and articles:
                    articles -= 1
                if any(name == open_ for open_, _ in containers):
                    while containers.pop()[0] != name:
                        pass
            continue
        void = name in VOID or token["more"].endswith("/")
        wanted = name in ("article", "main") and not is_noise(name, token["more"])
        if wanted and noise and not articles:
            noise.clear()  # an element left open before the article
        if noise:
            if not void:
                noise.append(name)
        elif not wanted and not void and is_noise(name, token["more"]):
            noise.append(name)
        else:
            if wanted:
                articles, any_article = articles + 1, True
            if name in CONTAINERS and not void:
                number += 1
                containers.append((name, number))
    if not noise:
        buffer.append(html.unescape(page[at:]))
    close()
    if any_article:
        lines = [line if held else "" for line, held in zip(lines, inside, strict=True)]
    return lines, held_by


def regions(lengths: np.ndarray, surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches of lines from a surge point to the following dive point."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    n = len(lengths)
    sums = total[np.minimum(np.arange(n) + window, n)] - total[np.arange(n)]
    found, at = [], 0
    empty = np.append(np.flatnonzero(sums == 0), n)
    for start in np.flatnonzero(sums > surge):
        if start < at:
            continue
        first = max(at, start)
        at = int(empty[np.searchsorted(empty, start)])
        found.append((int(first), at))
    return found


def chosen(lengths: np.ndarray, held_by: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> np.ndarray:
    """Which lines are main text: the regions, and what completes them."""
    most = int(np.convolve(lengths, np.ones(window, int)).max(initial=0))
    keep = np.zeros(len(lengths), bool)
    for start, stop in regions(lengths, min(surge, most - 1), window) if most else []:
        keep[start:stop] = True
    full = lengths > 0
    found = keep & full
    for first in np.flatnonzero(keep & ~np.r_[False, keep[:-1]]):
        lead = first + int(np.argmax(full[first:]))
        gap = lead - first
        for line in range(first - 1, -1, -1):
            gap = 0 if full[line] else gap + 1
            if gap >= window or held_by[line] != held_by[lead] and full[line]:
                break
            keep[line] |= full[line]
    whole = set(held_by[found].tolist()) - {0}
    return (keep | np.isin(held_by, list(whole))) & full


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    lines, held_by = lines_of(page)
    keep = chosen(np.array([len(line) for line in lines]), np.array(held_by), window, surge)
    return "\n".join(lines[i] for i in np.flatnonzero(keep))


def extracted(pages: DataFrame, page_id: str = "page_id", page: str = "html", keep: tuple[str, ...] = ("url",),
              window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, the columns to keep, the main text and its number of code points."""
    source = pages.select(F.col(page_id).alias("page_id"), *keep, F.col(page).alias("page"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunked(batches, "page"):
            texts = [main_text(x.decode(), window, surge) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*batch.schema.names[:-1], "text", "n_chars"])

    return source.mapInArrow(extract, f"{kinds}, text string, n_chars long")
