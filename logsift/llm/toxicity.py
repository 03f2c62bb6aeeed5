"""Toxicity by the nearest labelled examples under TF-IDF cosine.

A bounded sample of labelled texts gives the examples, and every term of them is in the vocabulary. A term weighs its
inverse document frequency, counted over the whole corpus, times a form of its association with the label
(log-likelihood ratio of its presence): what tells the classes apart leads the cosine, and no term is left out of it. The
form is the one of ``FORMS`` with the least loss over folds of the examples.
Examples with equal vectors are one entry with its counts of labels.

The search is exact, by a block-max index. Entries stand in blocks of consecutive numbers. A long posting list keeps the
largest weight of each block, a short one its postings. An entry's bound is what its postings in short lists give plus
what the block maxima allow; the entries of best bound set the least cosine that counts, and blocks in which no bound
reaches it are skipped. The entries of the other blocks are summed in single precision and, if they could be among the
k nearest within its error, again in double. Votes fall off with distance, and are
calibrated by isotonic regression on votes over folds: neither the weights nor the entries behind a vote have seen the
example; classes are weighted back to their shares.

Cases: a null or empty text, or one that shares no term with any example, has no direction; it gets the calibrated
share of toxic examples without direction. Without labels all scores are 0. Labels with null ids or null marks are not
used; of contradicting labels the toxic one counts. Equal distances are broken by the order of the entries,
repeated rows get equal scores. Long texts are counted whole. ``terms`` names only those terms of a text that
are clearly associated with the label, to explain a score; the score itself uses all of them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.staging import stage, temporary_stages

TERM = re.compile(r"\w+")
# Labelled ids are counted in so many ranges of their hash before any are ranked.
RANGE_BITS = 16
# A list with a posting in one entry of so many keeps block maxima.
LONG = 4
FOLDS = 5
# What a term's association makes of its weight.
FORMS = {
    "none": lambda gain: np.ones(len(gain)),
    "log": lambda gain: 1 + np.log1p(gain),
    "root": lambda gain: np.sqrt(1 + gain),
    "linear": lambda gain: 1 + gain,
}


@dataclass(frozen=True)
class Settings:
    """Bound of the labelled sample, the examples of each class on which a form of the weights is chosen, the least
    association of a term that is named, and the search: queries multiplied at once, entries of a block, long lists."""

    examples_per_class: int = 4000
    choice_per_class: int = 1000
    named_association: float = 20.0
    nearest: int = 15
    sharpness: float = 4.0
    block: int = 64
    entries_of_block: int = 8
    long_lists: int = 512


def count_terms(text: str | None, vocabulary: dict[str, int]) -> dict[int, int]:
    return {vocabulary[w]: n for w, n in Counter(TERM.findall(text.lower())).items() if w in vocabulary} if text else {}


def _key(counts: dict[int, int]) -> bytes:
    """Terms and counts, by term; keys sort as the lists of their numbers."""
    return np.array(sorted(counts.items()), dtype=">i4").tobytes()


def _of_key(key: bytes) -> np.ndarray:
    return np.frombuffer(key, dtype=">i4").reshape(-1, 2).astype(np.int64)


@dataclass
class Index:
    """Entries of equal vectors, by rows and by terms."""

    weights: np.ndarray  # of each term
    settings: Settings
    entries: list[np.ndarray] = field(default_factory=list)
    toxic: np.ndarray | None = None
    clean: np.ndarray | None = None
    evidence: list[list[int]] = field(default_factory=list)
    rows: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # starts, terms, weights of the entries
    lists: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # starts, entries, weights of the terms
    column: np.ndarray | None = None  # place of a term in ``maxima``, or -1
    long: np.ndarray | None = None  # (entries, long lists): the weights
    maxima: np.ndarray | None = None  # (long lists, blocks): the largest of them
    named: np.ndarray | None = None  # terms that explain a score
    form: str = ""  # of ``FORMS``
    none: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.0]))
    skipped: int = 0  # blocks of all searches that were not looked into, and all blocks
    blocks: int = 0

    def cells(self, counts: tuple[tuple[int, int], ...] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of the unit vector."""
        pairs = np.array(counts, dtype=np.int64).reshape(-1, 2) if isinstance(counts, tuple) else counts
        w = (1 + np.log(pairs[:, 1])) * self.weights[pairs[:, 0]]
        return pairs[:, 0], w / (math.sqrt(float((w * w).sum())) or 1.0)

    def vector(self, counts: tuple[tuple[int, int], ...] | np.ndarray) -> list[tuple[int, float]]:
        return [(int(t), float(w)) for t, w in zip(*self.cells(counts), strict=True) if w]

    def build(self) -> None:
        made = [self.cells(e) for e in self.entries]
        none = [(np.zeros(0, np.int64), np.zeros(0))]
        terms, w = (np.concatenate(x) for x in zip(*(made or none), strict=True))
        sizes = np.array([len(t) for t, _ in made], dtype=np.int64)
        self.rows = np.append(0, np.cumsum(sizes)), terms.astype(np.int32), w
        order = np.argsort(terms, kind="stable")
        lengths = np.bincount(terms, minlength=len(self.weights))
        self.lists = np.append(0, np.cumsum(lengths)), np.repeat(np.arange(len(made), dtype=np.int32), sizes)[order], w[order]
        often = np.argsort(-lengths, kind="stable")[: self.settings.long_lists]
        often = often[lengths[often] > len(made) / LONG]
        self.column = np.full(len(self.weights), -1, dtype=np.int32)
        self.column[often] = np.arange(len(often))
        width, starts, ids, values = self.settings.entries_of_block, *self.lists
        blocks = -(-len(made) // width)
        self.long = np.zeros((blocks * width, len(often)), dtype=np.float32)
        for row, t in enumerate(often):
            self.long[ids[starts[t] : starts[t + 1]], row] = values[starts[t] : starts[t + 1]]
        self.maxima = self.long.reshape(blocks, width, len(often)).max(axis=1).T.copy()

    def search_all(self, queries: list[tuple[tuple[int, int], ...] | np.ndarray]) -> Iterator[list[tuple[float, int]]]:
        """For each query the nearest entries as (cosine, entry), exactly: those of greatest cosine, then of smallest number."""
        size, width, k, n = self.settings.block, self.settings.entries_of_block, self.settings.nearest, len(self.rows[0]) - 1
        # Sums of products of unit vectors err by less than the number of summands times the rounding unit.
        slack = 2 * (len(self.maxima) + 4) * 2.0**-23 + 1e-8
        starts, ids, w = self.lists
        spread = np.zeros(len(self.weights))
        for first in range(0, len(queries), size):
            part = [self.cells(q) for q in queries[first : first + size]]
            left = np.zeros((len(part), len(self.maxima)), dtype=np.float32)
            for i, (terms, q) in enumerate(part):
                at = self.column[terms]
                left[i, at[at >= 0]] = q[at >= 0]
            for (terms, q), asked, allowed in zip(part, left, left @ self.maxima, strict=True):
                short = self.column[terms] < 0
                begin, length = starts[terms[short]], starts[terms[short] + 1] - starts[terms[short]]
                flat = _ranges(begin, length)
                sums = np.bincount(ids[flat], w[flat] * np.repeat(q[short], length), minlength=n)
                bound = sums + np.repeat(allowed, width)[:n]
                least = 0.0
                if n > 2 * k:
                    seeds = np.argpartition(bound, n - 2 * k)[n - 2 * k :]
                    least = np.partition(sums[seeds] + self.long[seeds] @ asked, k)[k] - slack
                near = np.flatnonzero((bound >= least - slack) & (bound > 0))
                self.blocks += len(allowed)
                self.skipped += len(allowed) - len(np.unique(near // width))
                sums = sums[near] + self.long[near] @ asked
                least = np.partition(sums, len(near) - k)[len(near) - k] - slack if len(near) > k else 0.0
                near = near[(sums >= least) & (sums > 0)]
                spread[terms] = q
                exact = self._cosines(near, spread).round(9)
                spread[terms] = 0.0
                best = np.lexsort((near, -exact))[:k]
                yield [(float(exact[b]), int(near[b])) for b in best]

    def _cosines(self, entries: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Of the entries, none of which is empty, with the query whose weights ``spread`` holds by term."""
        if not len(entries):
            return np.zeros(0)
        starts, terms, w = self.rows
        length = starts[entries + 1] - starts[entries]
        flat = _ranges(starts[entries], length)
        return np.add.reduceat(spread[terms[flat]] * w[flat], np.cumsum(length) - length)

    def search(self, counts: tuple[tuple[int, int], ...]) -> list[tuple[float, int]]:
        return next(self.search_all([counts]))

    def vote(self, near: list[tuple[float, int]]) -> float | None:
        """Share of toxic weight among the nearest."""
        yes = all_ = 0.0
        for cosine, i in near:
            toxic, clean = self.toxic[i], self.clean[i]
            # Copies count, but less than one by one.
            weight = cosine**self.settings.sharpness * math.log1p(max(toxic + clean, 0.0)) / max(toxic + clean, 1e-9)
            yes, all_ = yes + weight * toxic, all_ + weight * (toxic + clean)
        return yes / all_ if all_ > 0 else None

    def score_all(self, queries: list[tuple[tuple[int, int], ...] | np.ndarray]) -> Iterator[tuple[float, list[int]]]:
        """For each query its calibrated score and the ids of the nearest examples."""
        for near in self.search_all(queries):
            vote = self.vote(near)
            if vote is None:
                yield self.none, []
                continue
            at = np.clip(np.searchsorted(self.steps[0], vote, side="right") - 1, 0, len(self.steps[0]) - 1)
            yield float(self.steps[1][at]), [i for _, e in near[:5] for i in self.evidence[e]][:5]


def _pairs(counts: dict[int, int]) -> np.ndarray:
    """Terms and counts as rows, by term."""
    pairs = np.array([list(counts.keys()), list(counts.values())], dtype=np.int64).T
    return pairs[np.argsort(pairs[:, 0])]


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, ``length`` of each, in one array."""
    return np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best rising step function by pooling neighbours that fall: where steps begin, and their values."""
    points, place = np.unique(x, return_inverse=True)
    mass, yes = np.bincount(place, weight), np.bincount(place, y * weight)
    pools: list[list[float]] = []
    for point in zip(points, yes, mass, strict=True):
        pools.append(list(point))
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, a, b = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += b
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def build_index(examples: Iterable[tuple[int, int, dict[int, int] | bytes]], weights: np.ndarray, share: dict[int, float], settings: Settings) -> Index:
    """``examples`` are (doc_id, label, counts); ``share`` weighs each class back to its part of the labelled rows."""
    index, groups = Index(weights, settings), {}
    for doc_id, label, counts in examples:
        groups.setdefault(counts if isinstance(counts, bytes) else _key(counts), []).append((doc_id, label))
    keys = sorted(k for k in groups if k)
    index.entries = [_of_key(k) for k in keys]
    mass = lambda k, label: sum(share[label] for _, mine in groups.get(k, []) if mine == label)
    index.toxic = np.array([mass(k, 1) for k in keys])
    index.clean = np.array([mass(k, 0) for k in keys])
    index.evidence = [sorted(d for d, _ in groups[k])[:5] for k in keys]
    index.build()
    toxic, clean = mass(b"", 1), mass(b"", 0)
    index.none = round(toxic / (toxic + clean), 6) if toxic + clean else share.get(1, 0) / max(sum(share.values()), 1e-9) * 0.5
    return index


def associations(examples: list[tuple[int, int, bytes]], terms: int) -> np.ndarray:
    """Log-likelihood ratio of each term's presence and the label."""
    a, b, n1, n0 = np.zeros(terms), np.zeros(terms), 0.0, 0.0
    for _, label, key in examples:
        (a if label else b)[_of_key(key)[:, 0]] += 1
        n1, n0 = n1 + label, n0 + 1 - label

    def part(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return observed * np.log(np.where(observed > 0, observed, 1.0) / np.where(observed > 0, expected, 1.0))

    n, total = max(n1 + n0, 1.0), a + b
    gain = 2 * (part(a, total * n1 / n) + part(b, total * n0 / n) + part(n1 - a, (n - total) * n1 / n) + part(n0 - b, (n - total) * n0 / n))
    return np.maximum(gain, 0.0)


def votes_by_fold(examples: list[tuple[int, int, bytes]], rarity: np.ndarray, form: str, share: dict[int, float], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vote, label and weight of each example; weights and entries come from the other folds."""
    cells, fold = [], [zlib.crc32(str(d).encode()) // FOLDS % FOLDS for d, _, _ in examples]
    for f in range(FOLDS):
        others, mine = ([e for e, g in zip(examples, fold, strict=True) if (g == f) == own] for own in (False, True))
        index = build_index(others, rarity * FORMS[form](associations(others, len(rarity))), share, settings)
        for (_, label, _), near in zip(mine, index.search_all([_of_key(k) for _, _, k in mine]), strict=True):
            cells.append((index.vote(near) or 0.0, label, share[label]))
    return tuple(np.array(c) for c in zip(*cells, strict=True)) if cells else (np.zeros(0),) * 3


def loss(votes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """Weighted log loss of votes, kept off certainty."""
    p = np.clip(votes, 0.01, 0.99)
    return float(-(weight * np.where(label > 0, np.log(p), np.log1p(-p))).sum() / max(weight.sum(), 1e-9))


def chosen_form(examples: list[tuple[int, int, bytes]], rarity: np.ndarray, share: dict[int, float], settings: Settings) -> str:
    """The form of least loss over folds of the examples of least hash; the first of equal ones."""
    drawn = sorted(examples, key=lambda e: (zlib.crc32(b"form%d" % e[0]), e[0]))
    few = [e for label in (0, 1) for e in [e for e in drawn if e[1] == label][: settings.choice_per_class]]
    return min(FORMS, key=lambda form: round(loss(*votes_by_fold(few, rarity, form, share, settings)), 9))


def _sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[DataFrame, dict[int, float]]:
    """The texts of the hash-smallest labelled ids of each class, and what one example stands for."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    # Hash ranges in the order of the hash: their counts give the range that holds the last example, so that one
    # task ranks the bound and a range at most, and never a class.
    hashed = marks.filter("label IN (0, 1)").withColumn("draw", F.xxhash64("doc_id", F.lit(3))).withColumn("range", F.shiftright("draw", 64 - RANGE_BITS))
    upto = F.sum("n").over(Window.partitionBy("label").orderBy("range"))
    counts = hashed.groupBy("label", "range").agg(F.count("*").alias("n")).withColumn("upto", upto)
    last = F.min(F.when(F.col("upto") >= settings.examples_per_class, F.col("range")))
    ends = counts.groupBy("label").agg(F.sum("n").alias("n"), last.alias("last")).collect()
    of = {r["label"]: r["n"] for r in ends}
    inside = F.lit(False)
    for r in ends:
        inside = inside | ((F.col("label") == r["label"]) & (F.lit(True) if r["last"] is None else F.col("range") <= r["last"]))
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw", "doc_id"))
    chosen = hashed.filter(inside).withColumn("place", place).filter(F.col("place") <= settings.examples_per_class)
    share = {k: n / min(n, settings.examples_per_class) for k, n in of.items()}
    # At most two classes of the given number of ids: a proven bound.
    return docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "label")), "doc_id"), {0: share.get(0, 0.0), 1: share.get(1, 0.0)}


def _terms(sample: DataFrame) -> list[str]:
    """Every term of the sample."""

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {w for batch in batches for text in batch["text"] for w in TERM.findall((text or "").lower())}
        yield pd.DataFrame({"term": sorted(held)}, dtype="str")

    return sorted(sample.select("text").mapInPandas(terms, "term string").distinct().toArrow().column("term").to_pylist())


def _document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    """Over all documents; each task sends one row per term."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = known.value
        held = np.zeros(len(place), dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                if text:
                    held[[place[w] for w in set(TERM.findall(text.lower())) if w in place]] += 1
        found = np.flatnonzero(held)
        yield pd.DataFrame({"term": found, "n": held[found]})

    rows = docs.select("text").mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    of = np.zeros(len(vocabulary))
    of[rows["term"].to_numpy(int)] = rows["n"]
    return of


def fit(docs: DataFrame, labelled: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[Index | None, dict[str, int]]:
    """An index of the ``labelled`` documents; frequencies come from all ``docs``."""
    with temporary_stages(docs.sparkSession):
        sample, share = _sample(labelled, labels, settings)
        if not any(share.values()):
            return None, {}
        sample = stage(sample, "examples")
        vocabulary = {t: i for i, t in enumerate(_terms(sample))}
        known = docs.sparkSession.sparkContext.broadcast(vocabulary)

        def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                cells = [_key(count_terms(t, known.value)) for t in batch["text"]]
                yield batch[["doc_id", "label"]].assign(cells=cells)

        rows = sample.select(F.col("doc_id").cast("long"), "label", "text").mapInPandas(counts, "doc_id long, label int, cells binary").toArrow().to_pydict()
    examples = sorted(set(zip(rows["doc_id"], rows["label"], rows["cells"], strict=True)))
    del rows
    rarity = np.log((1 + docs.count()) / (1 + _document_frequencies(docs, vocabulary))) + 1
    form, gains = chosen_form(examples, rarity, share, settings), associations(examples, len(rarity))
    index = build_index(examples, rarity * FORMS[form](gains), share, settings)
    if examples:
        # A little of both classes at each end keeps single examples from certainty.
        ends = ((0.0, 1.0), (1, 0), (0.25, 0.25))
        index.steps = isotonic(*(np.append(c, e) for c, e in zip(votes_by_fold(examples, rarity, form, share, settings), ends, strict=True)))
    index.entries, index.form = [], form  # entries are held as arrays from here on
    index.named = gains >= settings.named_association
    return index, vocabulary


def score(docs: DataFrame, index: Index | None, vocabulary: dict[str, int]) -> DataFrame:
    """Per row: ``doc_id``, ``score``, ``predicted``, the ``evidence`` ids and the associated ``terms`` found."""
    # Both are bounded by the sample; a broadcast is read once per Python worker instead of once per task.
    known = docs.sparkSession.sparkContext.broadcast((index, vocabulary, {i: t for t, i in vocabulary.items() if index is not None and index.named[i]}))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, vocabulary, names = known.value
        for batch in batches:
            place = {t: i for i, t in enumerate(dict.fromkeys(batch["text"]))}
            rows, texts = [], list(place)
            for start in range(0, len(texts), 256):
                keys = [_pairs(count_terms(t, vocabulary)) for t in texts[start : start + 256]]
                scored = index.score_all(keys) if index is not None else [(0.0, [])] * len(keys)
                for key, (value, ids) in zip(keys, scored, strict=True):
                    value = round(value, 6)
                    rows.append((value, int(value >= 0.5), ids, [names[t] for t in key[:, 0].tolist() if t in names]))
            found = [rows[place[t]] for t in batch["text"]]
            yield pd.concat([batch[["doc_id"]].astype("Int64"), pd.DataFrame(found, columns=["score", "predicted", "evidence", "terms"], index=batch.index)], axis=1)

    kind = "doc_id long, score double, predicted int, evidence array<long>, terms array<string>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(apply, kind)
