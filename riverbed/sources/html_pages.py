"""Rows out of captured HTML pages: links with their text, and the smallest enclosing element of one id."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from riverbed.functions.numbers import floor_of
from riverbed.functions.text import collapse_spaces, strip_badges

ANCHORS = "array<struct<href:string,text:string,parent:string>>"
CARDS = "array<struct<id:string,text:string>>"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    """A page read once, by a stack of open elements: however deep it is nested and whatever is left unclosed.

    Texts and links are lists in page order. An element is a range of either, so its text is a slice of the page's text and
    what links it holds is told by two numbers. Elements are numbered in the order in which they open; 0 is the page.
    """

    def __init__(self, html: str | None, links: re.Pattern | None = None):
        super().__init__(convert_charrefs=True)
        self.links = links
        self.tag, self.parent, self.texts, self.ids = [""], [-1], [], []
        self.first_text, self.end_text, self.first_id, self.end_id = [0], [0], [0], [0]
        self.anchors: list[tuple[int, str]] = []
        self._stack, self._open = [0], Counter({"": 1})
        self.feed(html or "")
        while self._stack:
            self._end(self._stack.pop())
        self.text = " ".join(self.texts)
        self._at = [0, *itertools.accumulate(len(t) + 1 for t in self.texts)]
        #: Behind each link the place where another id comes.
        self._same = [0] * len(self.ids)
        for k in range(len(self.ids) - 1, -1, -1):
            self._same[k] = self._same[k + 1] if k + 1 < len(self.ids) and self.ids[k + 1] == self.ids[k] else k + 1

    def _end(self, element: int) -> None:
        self.end_text[element], self.end_id[element] = len(self.texts), len(self.ids)

    def handle_starttag(self, tag, attrs):
        element = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        for ends, n in ((self.first_text, len(self.texts)), (self.end_text, len(self.texts)), (self.first_id, len(self.ids)), (self.end_id, len(self.ids))):
            ends.append(n)
        if tag == "a" and (href := dict(attrs).get("href")):
            self.anchors.append((element, href))
            if self.links and (m := self.links.search(href)):
                self.ids.append(m[1])
        if tag in _VOID:
            self._end(element)
        else:
            self._stack.append(element)
            self._open[tag] += 1

    def handle_endtag(self, tag):
        if not tag or not self._open[tag]:
            return
        while True:
            element = self._stack.pop()
            self._open[self.tag[element]] -= 1
            self._end(element)
            if self.tag[element] == tag:
                return

    def handle_data(self, data):
        if self.tag[self._stack[-1]] not in ("script", "style") and (words := data.split()):
            self.texts.append(" ".join(words))

    def bounds(self, element: int) -> tuple[int, int]:
        """Where an element's text begins and ends in the page's."""
        a, b = self.first_text[element], self.end_text[element]
        return (self._at[a], self._at[b] - 1) if a < b else (0, 0)

    def text_of(self, element: int) -> str:
        a, b = self.bounds(element)
        return self.text[a:b]

    def only_id(self, element: int) -> str | None:
        """The id of an element's links, if all have the same."""
        a, b = self.first_id[element], self.end_id[element]
        return self.ids[a] if a < b <= self._same[a] else None


def anchors(html, href_pattern: str = ".", longest: int | None = None) -> Column:
    """Links whose address matches, with their text and that of the element around them, both cut to ``longest`` letters if it is given."""

    @F.pandas_udf(ANCHORS)
    def found(pages: pd.Series) -> pd.Series:
        wanted, out = re.compile(href_pattern), []
        for page in map(_Page, pages):
            rows = ((h, page.bounds(a), page.bounds(page.parent[a])) for a, h in page.anchors if wanted.search(h))
            cut = lambda x, page=page: page.text[x[0] : x[1] if longest is None else min(x[1], x[0] + longest)]
            out.append([{"href": h, "text": cut(own), "parent": cut(around)} for h, own, around in rows])
        return pd.Series(out)

    return found(html)


def cards(html, id_pattern: str, keyword: str, highest: int = 12) -> Column:
    """For each id of a link the text of the nearest element around it that has the keyword and no other id."""

    @F.pandas_udf(CARDS)
    def found(pages: pd.Series) -> pd.Series:
        wanted, out = re.compile(id_pattern), []
        for html in pages:
            page, rows = _Page(html, wanted), {}
            for element, href in page.anchors:
                m = wanted.search(href)
                for _ in range(highest if m and m[1] not in rows else 0):
                    element = page.parent[element]
                    if element < 0 or page.only_id(element) != m[1]:
                        break
                    if page.text.find(keyword, *page.bounds(element)) >= 0:
                        rows[m[1]] = page.text_of(element)
                        break
            out.append([{"id": k, "text": t} for k, t in rows.items()])
        return pd.Series(out)

    return found(html)


def smallest_cards(html, id_pattern: str, keywords: tuple, shortest: int = 20, longest: int = 760) -> Column:
    """For each id of a link the shortest text (the last of equally short ones) of an element that has all keywords and links of no other id."""

    @F.pandas_udf(CARDS)
    def found(pages: pd.Series) -> pd.Series:
        wanted, out = re.compile(id_pattern), []
        for html in pages:
            page, best = _Page(html, wanted), {}
            for element, tag in enumerate(page.tag):
                a, b = page.bounds(element)
                if tag in ("article", "li", "section", "div") and shortest <= b - a <= longest and (one := page.only_id(element)) is not None:
                    if (one not in best or b - a <= len(best[one])) and all(page.text.find(k, a, b) >= 0 for k in keywords):
                        best[one] = page.text[a:b]
            out.append([{"id": k, "text": best[k]} for k in sorted(best)])
        return pd.Series(out)

    return found(html)


def label_texts(html, label: str, longest: int = 240, most: int = 40) -> Column:
    """Texts of the elements that hold a label, each once and in order: at most ``most`` of ``longest`` characters, as a report shows them."""

    @F.pandas_udf("array<string>")
    def found(pages: pd.Series) -> pd.Series:
        wanted, out = re.compile(label), []
        for page in map(_Page, pages):
            texts: dict[str, None] = {}
            for element in range(1, len(page.tag)):
                a, b = page.bounds(element)
                if 0 < b - a <= longest and wanted.search(text := page.text[a:b]):
                    texts.setdefault(text)
                    if len(texts) == most:
                        break
            out.append(list(texts))
        return pd.Series(out)

    return found(html)


def card_record(text, place: str, badges: tuple = ()) -> dict[str, Column]:
    """Title, area, price and floor out of a card's text: what stands before the place, behind the label, at the end."""
    c = collapse_spaces(text)
    tail = F.regexp_extract(c, r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*$", 1)
    named = F.try_element_at(F.regexp_extract_all(c, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*萬"), F.lit(1)), F.lit(-1))
    price = F.replace(F.coalesce(F.nullif(tail, F.lit("")), named), F.lit(","), F.lit("")).try_cast("double")
    once = F.size(F.split(c, re.escape(place))) == 2
    title = F.when(once, F.nullif(strip_badges(F.trim(F.substring_index(c, place, 1)), badges) if badges else F.trim(F.substring_index(c, place, 1)), F.lit("")))
    return {"title": title, "area": F.regexp_extract(c, r"建坪\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), "price": price, "floor": floor_of(c)}


def total_results(html, label: str = "全部") -> Column:
    return F.regexp_extract(html, rf"{label}\s*[(（]\s*(\d+)", 1).try_cast("int")


def page_report(html) -> dict[str, Column]:
    """Title, link and script counts and the ids of elements of a page."""
    title = collapse_spaces(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return {"title": title, "n_links": F.size(F.regexp_extract_all(html, F.lit(r"(?i)<a\s"), F.lit(0))), "n_scripts": F.size(F.regexp_extract_all(html, F.lit(r"(?i)<script"), F.lit(0))), "element_ids": F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)\sid=["']([^"']+)["']"""), F.lit(1))))}
