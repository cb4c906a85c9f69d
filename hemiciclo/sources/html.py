"""Visible text and links of web pages, one pass of the standard library's parser per page in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = frozenset({"script", "style", "noscript", "template", "svg"})
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an open element is closed by when one of the same kind begins beside it; it stands in one of the others.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "p": ({"p"}, {"div", "td", "th", "li", "body", "section", "article", "blockquote"})}
#: Elements further down hang on the last one above, so that a page's paths stay short.
MAX_DEPTH = 256
SCHEMA = "struct<visible_text: string, links: array<struct<text: string, url: string>>, content_selector: string, quality_issues: array<string>, projection: array<struct<start: int, end: int, path: string>>>"
_LINE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("path", pa.string())])
_KIND = pa.struct([("visible_text", pa.string()), ("links", pa.list_(pa.struct([("text", pa.string()), ("url", pa.string())]))), ("content_selector", pa.string()), ("quality_issues", pa.list_(pa.string())), ("projection", pa.list_(_LINE))])


def _squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class _Reader(HTMLParser):
    """Text nodes with the depth of the transcript container and of the body that they stand in."""

    def __init__(self, container: str):
        super().__init__(convert_charrefs=True)
        self.container, self.open = container, []
        self.paths, self.counts = [""], [{}]  # of the open elements, and how many children of each tag they have had
        self.lines: list[tuple[str, int, bool, str]] = []  # text, transcript it is in (-1: none), whether in the body, path
        self.links: list[tuple[str, str]] = []
        self.anchor: list | None = None
        self.transcripts = 0

    def handle_starttag(self, tag, attrs):
        if tag in SIBLINGS:
            kinds, walls = SIBLINGS[tag]
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in walls:
                    break
                if self.open[k][0] in kinds:
                    self._close(k)
                    break
        if len(self.open) >= MAX_DEPTH and tag not in VOID:
            self._close(MAX_DEPTH - 1)
        seen = self.counts[-1]
        seen[tag] = seen.get(tag, 0) + 1
        if tag in VOID:
            return
        self.paths.append(f"{self.paths[-1]}/{tag}[{seen[tag]}]")
        self.counts.append({})
        known = dict(attrs)
        inside = self.container in (known.get("class") or "").split()
        self.open.append((tag, self.transcripts if inside else None))
        self.transcripts += inside
        if tag == "a" and known.get("href"):
            self.anchor = [known["href"], []]

    def _close(self, k):
        """The open elements from the k-th on."""
        del self.open[k:], self.paths[k + 1 :], self.counts[k + 1 :]

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(k)
                break
        if tag == "a" and self.anchor is not None:
            if text := _squeeze(" ".join(self.anchor[1])):
                self.links.append((text, self.anchor[0]))
            self.anchor = None

    def handle_data(self, data):
        tags = {t for t, _ in self.open}
        if tags & HIDDEN:
            return
        if self.anchor is not None:
            self.anchor[1].append(data)
        if text := _squeeze(data):
            self.lines.append((text, next((n for _, n in reversed(self.open) if n is not None), -1), "body" in tags, self.paths[-1]))


def read_visible(page: str | bytes | None, *, base_url: str, container: str) -> dict:
    """visible_text (a squeezed line for each text node, of the one transcript container if there is exactly one, else of the body), absolute links, what was selected, issues, and where each line stands in the text and in the page's tree."""
    text = page.decode("utf-8-sig", "replace") if isinstance(page, (bytes, bytearray)) else page or ""
    reader = _Reader(container)
    reader.feed(text)
    reader.close()
    one = reader.transcripts == 1
    chosen = [x for x in reader.lines if x[1] == 0] if one else [x for x in reader.lines if x[2]] or reader.lines
    lines, projection, at = [x[0] for x in chosen], [], 0
    for line, _, _, path in chosen:
        projection.append({"start": at, "end": at + len(line), "path": path})
        at += len(line) + 1
    issues = ["multiple_intervention_text_containers"] if reader.transcripts > 1 else []
    return {"visible_text": "\n".join(lines), "links": [{"text": t, "url": urljoin(base_url, u)} for t, u in reader.links], "content_selector": f".{container}" if one else "document", "quality_issues": issues, "projection": projection}


def visible_html(df: DataFrame, column: str, *, base_url: str = "https://www.congreso.es", container: str = "textoIntegro", out: str = "visible") -> DataFrame:
    """Adds `out`: STRUCT<visible_text, links, content_selector, quality_issues, projection>; NULL pages are empty."""

    @F.arrow_udf(SCHEMA)
    def parse(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pages:
            yield pa.concat_arrays([pa.array([read_visible(p, base_url=base_url, container=container) for p in batch.slice(at, 64).to_pylist()], _KIND) for at in range(0, max(1, len(batch)), 64)])

    return df.withColumn(out, parse(column))
