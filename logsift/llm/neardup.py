"""Near-duplicate documents by MinHash signatures, banding and exact confirmation.

A document's set holds its distinct five-word shingles (A-Z in lower case); a shorter
document is one shingle. 128 universal hash minima make 32 bands of 4, so a pair at
similarity 0.75 shares no band with probability 5e-6. Texts with equal words are
one class, and only its representative takes part. No bucket is expanded to
all its pairs: its members are compared with its leader, the member that meets most
others over all bands. Confirmed pairs are merged to components; only
members of different components that still share a bucket are then compared
with each other. So no link between components is lost, while links inside one
need no proof. Candidates must agree in their signatures before the texts are
fetched, and are confirmed on the full sets.

Cases: null, empty and blank texts have no set, link with nothing and are kept. A null
``doc_id`` names no document: such rows are kept, link nothing and have a null component.
Rows equal in ``doc_id`` are one document, even with different texts. Equal distances
cannot arise: components are named by their smallest id. Other columns are ignored
by the links and kept by ``keep_first``, which also drops repeated rows and copies without an id.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import FOLD, WORDS, attach
from logsift.llm.components import connected_components
from logsift.staging import scratch_path, stage, stage_at, temporary_stages


@dataclass(frozen=True)
class Settings:
    size: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    # Signatures agree in about 0.75 of 128 places at the limit, with a deviation of 0.038.
    least_agreement: float = 0.55
    seed: int = 5
    # Buckets up to this size are joined with themselves, larger ones compared in blocks.
    small_bucket: int = 8
    block: int = 512


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes, as sorted arrays. Words are hashed as they come: a table of them would grow with the texts."""

    def __init__(self, size: int):
        self.size = size
        self.powers = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j in range(size)]

    def words(self, text: str | None) -> list[str]:
        return WORDS.findall(text.translate(FOLD)) if text else []

    def hashes(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty(0, np.uint64)
        cells = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        if len(cells) < self.size:  # the length tells it from windows
            return _mix(np.array([sum(int(c) * int(p) for c, p in zip(cells, self.powers)) + len(cells) & (1 << 64) - 1], np.uint64))
        n = len(cells) - self.size + 1
        total = np.zeros(n, np.uint64)
        for j, p in enumerate(self.powers):
            total += cells[j : j + n] * p
        return np.unique(_mix(total))


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest value of each universal hash (a x + b) over the set, in its upper 32 bits."""
    least = np.full(len(a), np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 1024):
        block = a[:, None] * hashes[None, at : at + 1024]
        block += b[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row: ``doc_id``, ``key`` of its word sequence, ``n_shingles``, band keys and one byte of each minimum."""
    rng, n = np.random.default_rng(settings.seed), settings.bands * settings.rows
    a = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    b, band = rng.integers(0, 2**63, n, np.uint64), rng.integers(0, 2**63, (settings.bands, settings.rows), np.uint64) | np.uint64(1)
    kind = "doc_id long, key binary, n_shingles long, bands array<long>, sig binary"

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(settings.size)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = shingler.words(text)
                found = shingler.hashes(words)
                if not len(found):
                    rows.append((None, 0, None, None))
                    continue
                sig = minima(found, a, b)
                keys = _mix((sig.reshape(band.shape).astype(np.uint64) * band).sum(axis=1) + band[:, 0]).view(np.int64)
                rows.append((hashlib.md5(" ".join(words).encode(), usedforsecurity=False).digest(), len(found), keys, sig.astype(np.uint8).tobytes()))
            yield pd.concat([batch[["doc_id"]].astype("Int64"), pd.DataFrame(rows, columns=["key", "n_shingles", "bands", "sig"], index=batch.index)], axis=1)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(sign, kind)


def _agree(settings: Settings):
    @F.pandas_udf("boolean")
    def agree(one: pd.Series, other: pd.Series) -> pd.Series:
        if not len(one):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (one, other))
        return pd.Series((x == y).mean(axis=1) >= settings.least_agreement)

    return agree


def _similar(settings: Settings):
    @F.pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        shingler, recent = Shingler(settings.size), OrderedDict()

        def of(text: str) -> np.ndarray:
            """A leader's text comes many times in a row."""
            found = recent.pop(text, None)
            recent[text] = found = shingler.hashes(shingler.words(text)) if found is None else found
            if len(recent) > 32:
                recent.popitem(last=False)
            return found

        for one, other in batches:
            out = []
            for s, t in zip(one, other, strict=True):
                out.append(_linked(of(s), of(t), settings.percent))
            yield pd.Series(out, dtype=bool)

    return similar


def _texts(keys: DataFrame, keyed: DataFrame, docs: DataFrame) -> DataFrame:
    """One text of each of the ``keys``; a written table."""
    rows = stage(keyed.join(stage(keys.distinct(), "needed"), "key", "left_semi").select("key", F.col("rep").alias("doc_id")), "rows")
    # The text of a representative: among rows of its id the one with its words.
    texts = attach(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", rows.select("doc_id").distinct(), 24, "left_semi")
    texts = _rekey(texts).join(rows, ["doc_id", "key"], "left_semi").dropDuplicates(["key"]).select("key", "text")
    return stage(texts, "texts")


def _confirm(pairs: DataFrame, keyed: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar enough; ``pairs`` is a written table."""
    texts = _texts(pairs.select(F.col("a").alias("key")).union(pairs.select("b")), keyed, docs)
    one, other = (texts.select(F.col("key").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    both = pairs.join(one, "a").join(other, "b")
    return both.filter(_similar(settings)("text_a", "text_b")).select("a", "b")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _sets(texts: DataFrame, settings: Settings) -> DataFrame:
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(settings.size)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                yield pd.DataFrame({"key": part["key"], "set": [shingler.hashes(shingler.words(t)).tobytes() for t in part["text"]]})

    return stage(texts.mapInPandas(build, "key binary, set binary"), "sets")


def cells(members: DataFrame, settings: Settings) -> DataFrame:
    """``members`` once for every cell (``low``, ``high``) of their bucket in which they are compared.

    ``largest`` is the bucket's component of most members, ``most``. These are never paired with each other: they
    and the rest are cut into parts by hash, and a cell has a part of the rest and one part of either. So
    a bucket with few strays costs a few copies of its members.
    """
    rest, large = (F.ceil(n / settings.block) for n in (F.col("size") - F.col("most"), F.col("most")))
    inside, draw = F.col("component") == F.col("largest"), F.xxhash64("key")
    mine = F.when(inside, rest + F.pmod(draw, large)).otherwise(F.pmod(draw, rest))
    other = F.explode(F.sequence(F.lit(0), F.when(inside, rest).otherwise(rest + large) - 1))
    spread = members.withColumns({"_mine": mine, "_other": other})
    return spread.withColumns({"low": F.least("_mine", "_other"), "high": F.greatest("_mine", "_other")}).drop("_other", "size", "largest", "most")


def _merging_links(members: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) between different components inside large buckets, enough to merge all that are linked.

    ``members``: bucket, size, largest, most, key, component, bands, sig, set. A cell is compared by one task. A pair
    that shares several buckets is compared in that of the first band.
    """

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        bands, sig = np.stack(block["bands"].to_numpy()), np.frombuffer(b"".join(block["sig"]), np.uint8).reshape(len(block), -1)
        names, component = np.unique(block["component"].to_numpy(), return_inverse=True)
        side, keys = block["_mine"].to_numpy(), block["key"].to_numpy()
        crossed, band = block["low"].iloc[0] != block["high"].iloc[0], int(np.argmax(bands[0] == block["bucket"].iloc[0]))
        found = []
        for at in range(0, len(block), 32):
            rows = slice(at, at + 32)
            fit = component[rows, None] != component[None]
            fit &= (side[rows, None] < side[None]) if crossed else (np.arange(at, min(at + 32, len(block)))[:, None] < np.arange(len(block))[None])
            i, j = np.nonzero(fit)
            first = (bands[i + at] == bands[j]).argmax(axis=1) == band
            i, j = i[first] + at, j[first]
            agreed = (sig[i] == sig[j]).mean(axis=1)
            found += [(-e, a, b) for e, a, b in zip(agreed, i, j, strict=True) if e >= settings.least_agreement]
        parent, sets, links = list(range(len(names))), {}, []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for _, a, b in sorted(found):
            x, y = root(component[a]), root(component[b])
            if x != y:
                one, two = (sets.setdefault(k, np.frombuffer(block["set"].iloc[k], np.uint64)) for k in (a, b))
                if _linked(one, two, settings.percent):
                    parent[x] = y
                    links.append((keys[a], keys[b]))
        return pd.DataFrame(links, columns=["a", "b"])

    return cells(members, settings).groupBy("bucket", "low", "high").applyInPandas(compare, "a binary, b binary")


def _rekey(rows: DataFrame) -> DataFrame:
    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [hashlib.md5(" ".join(WORDS.findall((t or "").translate(FOLD))).encode(), usedforsecurity=False).digest() for t in batch["text"]]
            yield batch.assign(key=keys)

    return rows.mapInPandas(key, "doc_id long, text string, key binary")


def _edges(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of keys as pairs of representatives."""
    named = reps.select("key", "rep")
    return pairs.join(named.select(F.col("key").alias("a"), F.col("rep").alias("u")), "a").join(named.select(F.col("key").alias("b"), F.col("rep").alias("v")), "b").select("u", "v")


def link(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept`` and its class ``class_id``."""
    return _linked_rows(docs, settings).drop("key")


def _linked_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    """As ``link``, with the ``key`` of the row's words."""
    spark = docs.sparkSession
    signed = stage(signatures(docs, settings), "signatures")
    out = scratch_path(spark, "classes")
    with temporary_stages(spark):
        named = signed.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
        first = stage(named.groupBy("key").agg(F.min("doc_id").alias("rep")), "first")
        reps = named.join(first.withColumn("doc_id", F.col("rep")), ["key", "doc_id"]).dropDuplicates(["key"])
        reps = stage(reps.select("key", "rep", "bands", "sig"), "reps")
        members = reps.select("key", F.explode("bands").alias("bucket"))
        sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
        members = stage(members.join(stage(sizes, "sizes"), "bucket"), "members")
        central = members.groupBy("key").agg(F.sum("size").alias("met"))
        members = stage(members.join(central, "key").select("bucket", "key", "met"), "members")
        leaders = members.groupBy("bucket").agg(F.max(F.struct("met", "key")).alias("leader"))
        pairs = members.join(stage(leaders, "leaders"), "bucket").select(F.col("key").alias("a"), F.col("leader.key").alias("b"))
        pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        sigs = [reps.select(F.col("key").alias(k), F.col("sig").alias(f"sig_{k}")) for k in "ab"]
        pairs = pairs.join(sigs[0], "a").join(sigs[1], "b").filter(_agree(settings)("sig_a", "sig_b")).select("a", "b")
        pairs = stage(pairs, "pairs")
        edges = stage(_edges(_confirm(pairs, reps, docs, settings), reps), "edges")
        # Documents whose id stands for several texts tie these together.
        several = named.groupBy("doc_id").agg(F.count_distinct("key").alias("texts")).filter("texts > 1").select("doc_id")
        tied = named.join(several, "doc_id", "left_semi").join(first, "key").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
        edges = stage(edges.unionByName(tied), "edges")
        component = connected_components(edges)
        # What shares a bucket without being in one component yet.
        placed = members.join(reps.select("key", "rep"), "key").join(component, F.col("rep") == F.col("node"), "left")
        placed = stage(placed.select("bucket", "key", F.coalesce("component", "rep").alias("component")), "placed")
        mixed = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        mixed = mixed.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("top"))
        mixed = mixed.filter("size > top.n").select("bucket", "size", F.col("top.component").alias("largest"), F.col("top.n").alias("most"))
        mixed = stage(mixed, "mixed")
        placed = stage(placed.join(mixed, "bucket"), "placed")
        few = placed.filter(F.col("size") <= settings.small_bucket)
        one, other = (few.select("bucket", F.col("key").alias(k), F.col("component").alias(f"in_{k}")) for k in "ab")
        rest = one.join(other, "bucket").filter("in_a < in_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rest = rest.join(pairs, ["a", "b"], "left_anti").join(sigs[0], "a").join(sigs[1], "b")
        rest = stage(rest.filter(_agree(settings)("sig_a", "sig_b")).select("a", "b"), "rest")
        more = stage(_confirm(rest, reps, docs, settings), "confirmed")
        many = stage(placed.filter(F.col("size") > settings.small_bucket), "many")
        sets = _sets(_texts(many.select("key"), reps, docs), settings)
        merging = _merging_links(many.join(reps.select("key", "bands", "sig"), "key").join(sets, "key"), settings)
        edges = stage(edges.unionByName(_edges(more.unionByName(stage(merging, "merging")), reps)), "edges")
        component = connected_components(edges)
        classes = first.join(component, F.col("rep") == F.col("node"), "left")
        classes = stage_at(classes.select("key", "rep", F.coalesce("component", "rep").alias("component")), out)
    linked = signed.select("doc_id", "key", "n_shingles").join(classes, "key", "left")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    kept = F.coalesce(group == F.col("doc_id"), F.lit(True))
    return linked.select("doc_id", "key", "n_shingles", group.alias("component_id"), kept.alias("kept"), F.coalesce("rep", "doc_id").alias("class_id"))


def keep_first(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Of rows with one id and the same words only one stays. A row without an id stays
    only if no other row, with or without an id, has its words; near copies of it are not looked for. Which of equal
    rows stays is arbitrary, texts without a word all stay.
    """
    docs = docs.withColumn("_id", F.col("doc_id").cast("long"))
    decided = stage(_linked_rows(docs.select("doc_id", "text"), settings), "decided")
    gone = decided.filter("NOT kept").select(F.col("doc_id").alias("_id")).distinct()
    # Rows to compare by their words: of ids that come with the same words twice, and all without an id.
    equal = decided.filter("kept AND n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id", "key").agg(F.count("*").alias("rows")).filter("rows > 1")
    equal = stage(equal.select(F.col("doc_id").alias("_id")).distinct(), "equal")
    named = attach(docs.filter("_id IS NOT NULL"), "_id", gone, 24, "left_anti")
    once = attach(named, "_id", equal, 24, "left_anti")
    twice = _with_key(attach(named, "_id", equal, 24, "left_semi"))
    nameless = _with_key(docs.filter("_id IS NULL"))
    known = decided.filter("n_shingles > 0 AND doc_id IS NOT NULL").select(F.col("key").alias("_key")).distinct()
    # Copies are combined before the shuffle, so a text with very many costs one row per task.
    single = twice.filter("_key IS NOT NULL").dropDuplicates(["_id", "_key"])
    alone = stage(nameless.filter("_key IS NOT NULL").dropDuplicates(["_key"]), "alone").join(known, "_key", "left_anti")
    kept = [rows.select(*once.columns) for rows in (single, alone, twice.filter("_key IS NULL"), nameless.filter("_key IS NULL"))]
    for rows in kept:
        once = once.unionByName(rows)
    return once.drop("_id")


def _with_key(docs: DataFrame) -> DataFrame:
    """``docs`` with the ``_key`` of their words; null without a word."""

    @F.pandas_udf("binary")
    def key(texts: pd.Series) -> pd.Series:
        words = (WORDS.findall((t or "").translate(FOLD)) for t in texts)
        return pd.Series([hashlib.md5(" ".join(w).encode(), usedforsecurity=False).digest() if w else None for w in words], dtype=object)

    return docs.withColumn("_key", key("text"))
