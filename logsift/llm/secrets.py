"""Secrets in texts, found by regular expressions behind a trigram index.

Each rule's pattern is turned into a Boolean query over the trigrams that every match
must contain. Every Arrow batch is a segment of the index: its folded texts are read once, the
trigrams that any query names get posting lists of text numbers, and a query
intersects and unites these lists. Only the texts it returns are given to the rule's
expression. A rule without mandatory trigrams, such as one for hexadecimal runs, is given
every text. The index is never shuffled and is as large as a batch; texts are
read whole, long ones in overlapping pieces.

Cases: null and empty texts have no spans: counts of 0, an empty ``spans`` and the hash of the empty
text. Repeated rows give equal results. Positions count code points. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A query is True (every text), a trigram, or ("and" | "or", queries).
Query = bool | bytes | tuple
MANY = 16


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    keep: Callable[[re.Match], bool] | None = None


# Fixed by the contract of the query.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.ASCII | re.IGNORECASE,
        lambda m: len(m[2]) >= 12,
    ),
    # A run shorter than the limit holds no longer one, so the limits can be part of the patterns.
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)


def every(queries: list[Query]) -> Query:
    flat = [x for q in queries for x in (q[1] if isinstance(q, tuple) and q[0] == "and" else [q])]
    queries = list(dict.fromkeys(q for q in flat if q is not True))
    return True if not queries else queries[0] if len(queries) == 1 else ("and", tuple(queries))


def some(queries: list[Query]) -> Query:
    queries = list(dict.fromkeys(queries))
    if not queries or True in queries:
        return True
    # What asks for more than another alternative adds nothing.
    asked = [set(q[1]) if isinstance(q, tuple) and q[0] == "and" else {q} for q in queries]
    queries = [q for q, mine in zip(queries, asked, strict=True) if not any(other < mine for other in asked)]
    return queries[0] if len(queries) == 1 else ("or", tuple(queries))


def trigrams_of(strings: frozenset[str]) -> Query:
    """What a text holds if it holds one of the strings."""
    cut = [[s.encode()[i : i + 3] for i in range(len(s.encode()) - 2)] for s in sorted(strings)]
    return some([every(c) for c in cut]) if cut else True


def _few(strings) -> frozenset[str]:
    found = frozenset(strings)
    return found if len(found) <= MANY else frozenset({""})


@dataclass(frozen=True)
class Part:
    """What is known of the matches of a part of a pattern.

    ``exact`` holds all of them if they are few. Otherwise ``head`` and ``tail`` hold
    the possible first and last characters, and ``query`` what they contain.
    """

    exact: frozenset[str] | None = None
    head: frozenset[str] = frozenset({""})
    tail: frozenset[str] = frozenset({""})
    query: Query = True

    def open(self) -> Part:
        if self.exact is None:
            return self
        return Part(None, _few(s[:2] for s in self.exact), _few(s[-2:] for s in self.exact), trigrams_of(self.exact))


def _cross(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    return frozenset(x + y for x in a for y in b)


def _then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MANY:
        return Part(_cross(a.exact, b.exact))
    x, y = a.open(), b.open()
    before, after = a.exact if a.exact is not None and len(a.exact) <= MANY else x.tail, b.exact if b.exact is not None else y.head
    # An empty string in a head or tail says that nothing is known there.
    head = _few(s[:2] for s in _cross(a.exact, y.head)) if a.exact is not None else x.head
    tail = _few(s[-2:] for s in _cross(x.tail, b.exact)) if b.exact is not None else y.tail
    return Part(None, head, tail, every([x.query, y.query, trigrams_of(_cross(before, after))]))


def _either(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts) and len(joined := frozenset().union(*(p.exact for p in parts))) <= MANY:
        return Part(joined)
    opened = [p.open() for p in parts]
    head, tail = (_few(s for p in opened for s in ends(p)) for ends in (lambda p: p.head, lambda p: p.tail))
    return Part(None, head, tail, some([p.query for p in opened]))


def _analyse(tree) -> Part:
    whole = Part(frozenset({""}))
    for kind, value in tree:
        whole = _then(whole, _analyse_one(kind, value))
    return whole


def _analyse_one(kind, value) -> Part:
    if kind is op.LITERAL:
        return Part(frozenset({chr(value).lower()})) if value < 128 else Part()
    if kind is op.IN and all(k is op.LITERAL and v < 128 for k, v in value):
        return _either([_analyse_one(k, v) for k, v in value])
    if kind is op.SUBPATTERN:
        return _analyse(value[-1])
    if kind is op.BRANCH:
        return _either([_analyse(b) for b in value[1]])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = value
        if (least, most) == (0, 1):
            return _either([Part(frozenset({""})), _analyse(inner)])
        if least == 0:
            return Part()
        once = _analyse(inner)
        return once if (least, most) == (1, 1) else Part(None, once.open().head, once.open().tail, once.open().query)
    return Part(frozenset({""})) if kind is op.AT else Part()


def trigram_query(pattern: str) -> Query:
    """The query that every text with a match of ``pattern`` satisfies, over ASCII in lower case."""
    return _analyse(_parser.parse(pattern)).open().query


def _named(query: Query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_named, query[1]))


_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Segment:
    """Posting lists of the wanted trigrams over the texts of one batch."""

    PIECE = 1 << 21

    def __init__(self, raw: list[bytes], wanted: list[bytes], slots: np.ndarray):
        self.size, self.lists = len(raw), {}
        found: list[list[np.ndarray]] = [[] for _ in wanted]
        ends = np.cumsum([len(r) + 1 for r in raw])
        joined = np.frombuffer(b"\0".join(raw).translate(_FOLD), np.uint8)
        for at in range(0, max(len(joined) - 2, 0), self.PIECE):
            x = joined[at : at + self.PIECE + 2].astype(np.uint32)
            slot = slots[(x[:-2] << 16) | (x[1:-1] << 8) | x[2:]]
            where = np.flatnonzero(slot)
            texts, slot = np.searchsorted(ends, where + at, side="right"), slot[where]
            order = np.argsort(slot, kind="stable")
            texts, slot = texts[order], slot[order]
            cuts = np.searchsorted(slot, np.arange(1, len(wanted) + 2))
            for i, one in enumerate(found):
                if cuts[i] < cuts[i + 1]:
                    one.append(np.unique(texts[cuts[i] : cuts[i + 1]]))
        for trigram, one in zip(wanted, found, strict=True):
            self.lists[trigram] = np.unique(np.concatenate(one)) if one else np.empty(0, np.int64)

    def texts(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.lists[query]
        kind, parts = query
        found = self.texts(parts[0])
        for part in parts[1:]:
            found = np.intersect1d(found, self.texts(part), assume_unique=True) if kind == "and" else np.union1d(found, self.texts(part))
        return found


def find_secrets(docs: DataFrame, more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """Per row: ``doc_id``, counts of the base rules, ``base_sha256`` and ``spans``."""
    rules = (*BASE_RULES, *more)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = [trigram_query(r.pattern) for r in rules]
        wanted = sorted(set().union(*map(_named, queries)))
        slots = np.zeros(1 << 24, np.uint8 if len(wanted) < 256 else np.uint16)
        for i, t in enumerate(wanted):
            slots[t[0] << 16 | t[1] << 8 | t[2]] = i + 1
        compiled = [re.compile(r.pattern, r.flags) for r in rules]
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            segment = Segment([t.encode() for t in texts], wanted, slots)
            spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for place, (rule, query, pattern) in enumerate(zip(rules, queries, compiled, strict=True)):
                for i in segment.texts(query):
                    spans[i] += [(m.start(), place, m.end()) for m in pattern.finditer(texts[i]) if rule.keep is None or rule.keep(m)]
            rows = []
            for mine in spans:
                mine.sort()
                shown = [(place, f"{rules[place].kind}:{start}:{end}") for start, place, end in mine]
                base = ",".join(s for place, s in shown if place < len(BASE_RULES))
                counts = [sum(place == k for place, _ in shown) for k in range(len(BASE_RULES))]
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, s in shown)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"], index=batch.index)
            yield pd.concat([batch[["doc_id"]].astype("Int64"), out], axis=1)

    kind = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(scan, kind)
