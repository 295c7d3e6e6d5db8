"""Text of chosen elements of HTML captures, with the way back to the capture."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = re.compile(r"\s+")
SPAN = "struct<start: int, end: int, source_start: int, source_end: int>"


class ClassText(HTMLParser):
    """The texts within elements of one name and class, each with its place in the source.

    Open elements of that name lie on a stack, true where they have the class; text counts
    while any of them is true, so elements within a chosen one belong to it. An end without
    a beginning is passed over.
    """

    def __init__(self, html: str, tag: str, name: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.name, self.open, self.found = tag, name, [], []
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.source = html
        self.feed(html)
        self.close()
        self._end(len(html))

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _end(self, place: int) -> None:
        if self.found and self.found[-1][2] is None:
            self.found[-1][2] = place

    def handle_starttag(self, tag, attrs):
        self._end(self._place())
        if tag == self.tag:
            self.open.append(any(self.open) or self.name in (dict(attrs).get("class") or "").split())

    def handle_startendtag(self, tag, attrs):  # a slash closes nothing in HTML
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._end(self._place())
        if tag == self.tag and self.open:
            self.open.pop()

    def handle_comment(self, data):
        self._end(self._place())

    def handle_data(self, data):
        self._end(self._place())
        if any(self.open):
            self.found.append([data, self._place(), None])


def class_text(html: str, tag: str, name: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The text in NFC with single spaces, and where its parts lie in it and in the source (half-open, in characters)."""
    out, at, spans = [], 0, []
    for data, start, end in ClassText(html, tag, name).found:
        part = _SPACE.sub(" ", unicodedata.normalize("NFC", data)).strip()
        if part:
            at += bool(out)
            out.append(part)
            spans.append((at, at + len(part), start, end))
            at += len(part)
    return " ".join(out), spans


def capture_text(pages: DataFrame, key: str, html: str, tag: str = "div", name: str = "correspondence_text") -> DataFrame:
    """``key, text, text_sha256, spans`` of each capture: all text within ``tag`` elements of class ``name``. Null HTML has no text. Pages go through Python in Arrow batches, a page at a time."""

    def run(batches):
        for batch in batches:
            found = [class_text(x or "", tag, name) for x in batch.column("html").to_pylist()]
            spans = [[dict(zip(("start", "end", "source_start", "source_end"), s)) for s in spans] for _, spans in found]
            kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "source_start", "source_end")]))
            yield pa.record_batch({"key": batch.column("key"), "text": pa.array([t for t, _ in found], pa.string()), "spans": pa.array(spans, kind)})

    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    found = rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, text string, spans array<{SPAN}>")
    return found.select(F.col("key").alias(key), "text", F.sha2("text", 256).alias("text_sha256"), "spans")


def seal_spans(captured: DataFrame, pages: DataFrame, key: str, html: str) -> DataFrame:
    """A row for each span, with digests of its text and of its source: what a later check holds it against."""
    rows = captured.join(pages.select(key, html), key).select(key, "text", html, F.posexplode("spans").alias("position", "s"))
    cut = lambda c, a, b: F.substring(c, F.col(a) + 1, F.col(b) - F.col(a))
    return rows.select(key, "position", "s.*", F.sha2(cut("text", "s.start", "s.end"), 256).alias("text_sha256"), F.sha2(cut(html, "s.source_start", "s.source_end"), 256).alias("source_sha256"))


def span_problems(sealed: DataFrame, captured: DataFrame, pages: DataFrame, key: str, html: str) -> DataFrame:
    """Sealed spans (``key, position``) that captures and texts no longer bear out: ``capture_missing``, ``out_of_bounds``, ``text_differs``, ``source_differs``."""
    rows = sealed.join(captured.select(key, "text"), key, "left").join(pages.select(key, F.col(html).alias("_html")), key, "left")
    cut = lambda c, a, b: F.sha2(F.substring(c, F.col(a) + 1, F.col(b) - F.col(a)), 256)
    inside = lambda c, a, b: (F.col(a) >= 0) & (F.col(a) <= F.col(b)) & (F.col(b) <= F.length(c))
    issue = (
        F.when(F.col("text").isNull() | F.col("_html").isNull(), "capture_missing").when(~(inside("text", "start", "end") & inside("_html", "source_start", "source_end")), "out_of_bounds")
        .when(cut("text", "start", "end") != F.col("text_sha256"), "text_differs").when(cut("_html", "source_start", "source_end") != F.col("source_sha256"), "source_differs")
    )
    return rows.select(key, "position", issue.alias("issue")).filter("issue IS NOT NULL")


def part_at(spans: list[tuple[int, int, int, int]], offset: int) -> tuple[int, int] | None:
    """The source range of the part that holds a text offset; none between parts."""
    i = bisect_right([s[0] for s in spans], offset) - 1
    return spans[i][2:] if i >= 0 and offset < spans[i][1] else None
