"""Main text of web pages by two passes of block rules.

A page is cut at block elements. The first pass labels each block by itself: many links or a
menu, footer, form, notice, advert or comment around it make it bad; long enough text with many stop words makes
it good; the rest is ambiguous. In the second pass an ambiguous block inherits
the label of its nearest decided neighbours: the one they share, else that of
the nearer; where the page marks its article, only neighbours inside count, and a part without any is good
inside and bad outside of it.

Cases: null, empty and tag-free pages without text give an empty text. Unclosed and crossed
tags end with their container, a tag cut off at the end is dropped. From a quote in a tag that never ends, quotes
no longer protect a ``>``. Numbers of no character become the replacement character. Repeated rows give equal
results; other columns are kept by ``extract``. A page is read whole, by one task, in time that grows
with its length alone, whatever its markup.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent words of the languages at hand: fixed values.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his if in is it its more no not of on or she so that the their there they "
    "this to was were what which who will with would you "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit "
    "nach nicht noch nur oder sich sie sind so über um und uns von vor war wie wir wird zu zum zur "
    "al como con cuando de del desde donde el ella en entre era es esta este la las le lo los más me mi muy no nos o para pero por que se "
    "ser si sin sobre son su sus también te un una y ya "
    "ai au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais me même ne nous on ont ou par pas plus "
    "pour qu que qui sa sans se ses son sont sur un une vous".split()
)


@dataclass(frozen=True)
class Rules:
    """Limits of the first pass; lengths in code points."""

    most_links: float = 0.33
    most_links_inside: float = 0.6
    long: int = 140
    short: int = 50
    least_stop: float = 0.12
    many_stop: float = 0.25


# Elements whose content is no text.
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style title noscript template svg textarea select iframe object".split()}
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile("[>\"']")
# A number beyond all code points; Python refuses to read very long ones.
_HUGE = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")
_WORD = re.compile(r"\w+")
_CELLS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption address hr legend option summary body html".split())
_CONTAINERS = set("head div section article main nav aside header footer form ul ol dl table figure details fieldset dialog menu button label center".split())
_BAD_TAGS = set("head nav aside footer form menu dialog fieldset button".split())
_BAD_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side rail widget comment comments "
    "disqus respond reply replies discussion cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe "
    "signup login menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar share sharing social related "
    "recommended recommendations pagination pager copyright legal disclaimer skip".split()
)
_BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
_MAIN_NAMES = {"content", "article", "post", "entry", "story", "main", "maintext", "articlebody"}
# In a compound name these say how an element or page is, not what it is: no-sidebar, comments-open.
_STATES = {"has", "have", "no", "not", "with", "without", "is", "open", "opened", "closed", "enabled", "disabled", "on", "off"}
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
GOOD, BAD, OPEN = 1, -1, 0


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    inside: int  # number of the article around it, or -1


def _kind(tag: str, attributes: str, inside: bool) -> str | None:
    """``bad``, ``main`` or nothing for a container."""
    whole, named, role = set(), set(), ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for part in value.split():
                whole.add(part)
                pieces = set(re.split(r"[-_]+|\d+", part))
                named.update({part} if pieces & _STATES else {part, *pieces})
        elif name == "role":
            role = value
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return "bad"
    article = tag in ("article", "main") or role in ("main", "article")
    # What calls itself the content is only bad by a whole name, not by a part of one.
    names = whole if article or (tag in ("div", "section") and whole & _MAIN_NAMES) else named
    if tag in _BAD_TAGS or role in _BAD_ROLES or names & _BAD_NAMES or (tag == "header" and not inside):
        return "bad"
    if article or (tag in ("div", "section") and named & _MAIN_NAMES):
        return "main"
    return None


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Markup from left to right: start, end, name (empty for what is only skipped), closing, attributes.

    Every search either consumes what it has read or finds nothing to the end of the page, which is remembered.
    """
    at, last_end, last_start, quoted = 0, page.rfind(">"), page.rfind("<"), True
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        mark = page[at : at + 1]
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        if start > last_end:  # no tag ends any more
            if start == last_start and (mark in ("/", "!", "?") or (mark.isascii() and mark.isalpha())):
                yield start, len(page), "", False, ""
                return
            continue
        if mark in ("!", "?"):
            at = page.find(">", at) + 1
            yield start, at, "", False, ""
            continue
        name = _NAME.match(page, at + (mark == "/"))
        if not name:
            continue
        tag, opened = name[0].lower(), name.end()
        if mark != "/" and tag in _RAW:
            close = _RAW[tag].search(page, page.find(">", opened) + 1)
            at = close.end() if close else len(page)
            yield start, at, "", False, ""
            continue
        end = opened
        while quoted:
            stop = _STOP.search(page, end)
            if stop and stop[0] == ">":
                end = stop.start()
                break
            close = page.find(stop[0], stop.end()) if stop else -1
            quoted, end = close >= 0, close + 1
        if not quoted:
            end = page.find(">", opened)
        at = end + 1
        yield start, at, tag, mark == "/", page[opened:end]


def _plain(text: str) -> str:
    """Decoded references, single spaces."""
    return " ".join(html.unescape(_HUGE.sub("\ufffd", text)).split())


class _Open:
    """The containers around the current place, with what is asked of them at hand."""

    def __init__(self):
        self.stack, self.count, self.bad, self.mains = [], Counter(), 0, 0
        self.article, self.articles = -1, 0

    def push(self, tag: str, kind: str | None) -> None:
        self.stack.append((tag, kind))
        self.count[tag] += 1
        self.bad += kind == "bad"
        if kind == "main":
            if not self.mains:  # an article inside an article is part of it
                self.article, self.articles = self.articles, self.articles + 1
            self.mains += 1

    def pop(self) -> str:
        tag, kind = self.stack.pop()
        self.count[tag] -= 1
        self.bad -= kind == "bad"
        self.mains -= kind == "main"
        return tag

    def close(self, tag: str) -> None:
        """Ends the innermost ``tag`` with all that is open in it."""
        if self.count[tag]:
            while self.pop() != tag:
                pass

    def end_head(self) -> None:
        """A body ends every head, but nothing in it that is still open."""
        self.bad -= self.count.pop("head")
        self.stack = [s for s in self.stack if s[0] != "head"]

    def inside(self) -> int:
        return self.article if self.mains else -1


def blocks_of(page: str) -> list[Block]:
    """The page's text in pieces between block elements."""
    blocks, around = [], _Open()
    parts, linked, link, at = [], 0, False, 0

    def close() -> None:
        nonlocal parts, linked
        text = _plain("".join(parts))
        if text:
            blocks.append(Block(text, min(linked, len(text)), around.bad > 0, around.inside()))
        parts, linked = [], 0

    def take(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if link:
                linked += len(_plain(piece))

    for start, end, tag, closing, attributes in tags_of(page):
        take(page[at:start])
        at = end
        if tag == "a":
            link = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag in _CELLS:
            close()
            link = False
            if tag in ("body", "html") and around.count["head"]:
                around.end_head()
        elif tag in _CONTAINERS:
            close()
            link = False
            if closing:
                around.close(tag)
            elif not attributes.endswith("/"):
                around.push(tag, _kind(tag, attributes, around.mains > 0))
    take(page[at:])
    close()
    return blocks


def first_pass(block: Block, rules: Rules = Rules()) -> int:
    density = block.linked / len(block.text)
    if block.bad or density > (rules.most_links_inside if block.inside >= 0 else rules.most_links):
        return BAD
    if len(block.text) < rules.short:
        return OPEN
    words = _WORD.findall(block.text.lower())
    stop = sum(map(STOP_WORDS.__contains__, words)) / max(len(words), 1)
    if len(block.text) >= rules.long:
        return GOOD if stop >= rules.least_stop else OPEN if block.inside >= 0 else BAD
    return GOOD if stop >= rules.many_stop else OPEN


def second_pass(blocks: list[Block], labels: list[int]) -> list[bool]:
    """Kept or not: ambiguous blocks inherit from decided neighbours of their part of the page."""
    marked, out = any(b.inside >= 0 and not b.bad for b in blocks), []
    before, last = [None] * len(blocks), {}
    after, next_ = [None] * len(blocks), {}
    for i in range(len(blocks)):
        j = len(blocks) - 1 - i
        before[i], after[j] = last.get(blocks[i].inside), next_.get(blocks[j].inside)
        # A foreign element inside an article says nothing of the text beside it.
        if labels[i] and not (blocks[i].bad and blocks[i].inside >= 0):
            last[blocks[i].inside] = i
        if labels[j] and not (blocks[j].bad and blocks[j].inside >= 0):
            next_[blocks[j].inside] = j
    for i, block in enumerate(blocks):
        label = labels[i]
        if marked and block.inside < 0:
            label = BAD
        elif label == OPEN:
            near = sorted((abs(i - j), labels[j]) for j in (before[i], after[i]) if j is not None)
            label = near[0][1] if near else GOOD if block.inside >= 0 else BAD
            if len(near) == 2 and near[0][0] == near[1][0]:
                label = max(near[0][1], near[1][1])
        out.append(label == GOOD)
    return out


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    kept = second_pass(blocks, [first_pass(b, rules) for b in blocks])
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def main_text_of(page: Column, rules: Rules = Rules()) -> Column:
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(lambda p: main_text(p, rules))

    return text(F.coalesce(page, F.lit("")))


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``pages`` with ``text`` and its length ``n_chars`` in place of ``html``."""
    return pages.withColumn("text", main_text_of(F.col("html"), rules)).drop("html").withColumn("n_chars", F.length("text").cast("long"))
