"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of UTF-8 bytes in both directions, labels every byte
and pools the byte probabilities of a document. It is trained in numpy by
backpropagation through time on a bounded sample of labelled windows; Spark
applies it to all documents in Arrow batches.

Cases: a null text or one without a letter is ``und`` with score 0 and no
labelled byte. Without a training row every other text is ``und`` too. Windows
of a long text are independent, so memory does not grow with its length.
Repeated rows give equal results; other columns of the input are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import attach

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and sizes of the network."""

    documents_per_language: int = 384
    windows_per_document: int = 4
    window_chars: int = 72
    window_bytes: int = 128
    hidden: int = 8
    steps: int = 160
    batch: int = 384
    rate: float = 0.02
    seed: int = 11
    block: int = 1024


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the network's cheap replacement of tanh."""
    scale = np.abs(x)
    scale += 1
    x /= scale
    return x


def _gate(x: np.ndarray) -> np.ndarray:
    _squash(x)
    x *= 0.5
    x += 0.5
    return x


class Network:
    """Two gated recurrent layers, one per direction, and a linear layer on both states.

    Arrays are laid out (feature, window), so that every gate is a contiguous block.
    """

    def __init__(self, languages: list[str], hidden: int, seed: int):
        rng, k = np.random.default_rng(seed), len(languages)
        self.languages, self.hidden = languages, hidden
        shapes = {"w0": (3 * hidden, 256), "u0": (3 * hidden, hidden), "w1": (3 * hidden, 256), "u1": (3 * hidden, hidden)}
        shapes |= {"v": (k, 2 * hidden), "c": (k, 1)}
        self.p = {n: (rng.standard_normal(s) * (0.0 if n == "c" else 0.3)).astype(np.float32) for n, s in shapes.items()}

    def run(self, x: np.ndarray, side: str, keep: bool = False):
        """States after each byte of ``x`` (bytes, windows); with ``keep`` also what the gradient needs."""
        w, u, h = self.p["w" + side], self.p["u" + side], self.hidden
        state = np.zeros((h, x.shape[1]), np.float32)
        states, memory = np.empty((len(x), h, x.shape[1]), np.float32), []
        order = range(len(x)) if side == "0" else range(len(x) - 1, -1, -1)
        for t in order:
            inner = u @ state
            outer = np.take(w, x[t], axis=1, mode="clip")
            gates = outer[: 2 * h]
            gates += inner[: 2 * h]
            _gate(gates)
            update, reset = gates[:h], gates[h:]
            new = outer[2 * h :]
            new += reset * inner[2 * h :]
            raw = new.copy() if keep else None
            _squash(new)
            if keep:
                memory.append((t, state, inner[2 * h :], update, reset, new, raw))
            state = new + update * (state - new)
            states[t] = state
        return states, memory

    def byte_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(bytes, languages, windows)."""
        both = np.concatenate([self.run(x, "0")[0], self.run(x, "1")[0]], axis=1)
        scores = self.p["v"] @ both
        scores += self.p["c"]
        np.clip(scores, -30, 30, out=scores)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores

    def gradient(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of all byte labels, by backpropagation through time."""
        h, runs = self.hidden, {s: self.run(x, s, keep=True) for s in "01"}
        both = np.concatenate([runs["0"][0], runs["1"][0]], axis=1)
        scores = self.p["v"] @ both + self.p["c"]
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        scores[:, label, np.arange(len(label))] -= 1
        scores *= (mask / mask.sum())[:, None, :]
        grad = {"v": np.einsum("tkb,thb->kh", scores, both, optimize=True), "c": scores.sum(axis=(0, 2))[:, None]}
        back = self.p["v"].T @ scores
        for s in "01":
            w, u = np.zeros_like(self.p["w" + s]), np.zeros_like(self.p["u" + s])
            mine, flow = back[:, :h] if s == "0" else back[:, h:], np.zeros((h, x.shape[1]), np.float32)
            for t, state, inner, update, reset, new, raw in reversed(runs[s][1]):
                d = flow + mine[t]
                d_new = d * (1 - update) / (1 + np.abs(raw)) ** 2
                d_update = d * (state - new) * _gate_slope(update)
                d_reset = d_new * inner * _gate_slope(reset)
                outer = np.concatenate([d_update, d_reset, d_new])
                through = np.concatenate([d_update, d_reset, d_new * reset])
                u += through @ state.T
                flow = d * update + self.p["u" + s].T @ through
                for row, cells in zip(w, outer, strict=True):
                    row += np.bincount(x[t], cells, 256).astype(np.float32)
            grad |= {"w" + s: w, "u" + s: u}
        return grad



def _gate_slope(value: np.ndarray) -> np.ndarray:
    """Derivative of the gate, from its value: 0.5 / (1 + |x|)^2 with 1 / (1 + |x|) = 1 - |2 value - 1|."""
    return 0.5 * (1 - np.abs(2 * value - 1)) ** 2


def as_windows(raw: bytes, size: int) -> np.ndarray:
    """(windows, size) of bytes, the last one filled up with zero bytes."""
    cells = np.zeros(-(-len(raw) // size) * size, np.uint8)
    cells[: len(raw)] = np.frombuffer(raw, np.uint8)
    return cells.reshape(-1, size)


def train(samples: list[tuple[str, str]], settings: Settings) -> Network | None:
    """Adam on equal numbers of windows per language; ``samples`` are (language, text window)."""
    if not samples:
        return None
    languages = sorted({s[0] for s in samples})
    net, rng = Network(languages, settings.hidden, settings.seed), np.random.default_rng(settings.seed)
    size = settings.window_chars
    cells = [(languages.index(name), as_windows(text.encode()[: 2 * size], 2 * size)[0]) for name, text in samples if text]
    by = [np.array([c for label, c in cells if label == k], np.uint8).reshape(-1, 2 * size) for k in range(len(languages))]
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, settings.steps + 1):
        label = np.sort(rng.integers(0, len(languages), settings.batch))
        x = np.concatenate([b[rng.integers(0, len(b), n)] for b, n in zip(by, np.bincount(label, minlength=len(by)), strict=True) if len(b) or not n])
        # Windows of all lengths, so that short texts are met as well.
        length = int(rng.integers(6, size + 1))
        x = np.ascontiguousarray(x[:, :length].T)
        grad = net.gradient(x, (x > 0).astype(np.float32), label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = settings.rate * min(1, 3 * (1 - step / (settings.steps + 1)))
        for name, g in grad.items():
            g = g / max(1.0, norm)
            first[name] += 0.1 * (g - first[name])
            second[name] += 0.01 * (g * g - second[name])
            net.p[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return net


def label_texts(net: Network, texts: list[str], settings: Settings) -> np.ndarray:
    """Per text: the summed probability of each language over all bytes, the share of each as the byte's label."""
    k, size = len(net.languages), settings.window_bytes
    total = np.zeros((len(texts), 2 * k + 1))
    parts, owners, held = [], [], 0

    def flush():
        x = np.ascontiguousarray(np.concatenate(parts).T)
        owner = np.repeat(owners, [len(p) for p in parts])
        for at in range(0, x.shape[1], settings.block):
            block, mine = np.ascontiguousarray(x[:, at : at + settings.block]), owner[at : at + settings.block]
            prob, mask = net.byte_probabilities(block), block > 0
            best = prob.argmax(axis=1)
            prob *= mask[:, None, :]
            pooled = prob.sum(axis=0).T
            votes = np.stack([((best == j) & mask).sum(axis=0) for j in range(k)], axis=1)
            np.add.at(total, mine, np.concatenate([pooled, votes, mask.sum(axis=0)[:, None]], axis=1))

    for i, text in enumerate(texts):
        raw = text.encode()
        step = settings.block * size
        for at in range(0, len(raw), step):  # a very long text goes in pieces
            parts.append(as_windows(raw[at : at + step], size))
            owners.append(i)
            held += len(parts[-1])
            if held >= settings.block:
                flush()
                parts, owners, held = [], [], 0
    if parts:
        flush()
    return total


def sample_windows(labelled: DataFrame, settings: Settings) -> list[tuple[str, str]]:
    """Text windows of documents of each language, distinct texts in the order of a hash.

    A share of the hash's range is cut off first that holds about four times the wanted rows of the language, so
    that only these are ranked, whatever the number of rows and tasks; copies are combined before they are
    counted. The bound is languages x documents x windows, whatever the corpus.
    """
    wanted, span = settings.documents_per_language, 1 << 40
    rows = labelled.filter(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    rows = rows.select("lang", "text", F.xxhash64("lang", "text", F.lit(settings.seed)).alias("draw"))
    place = F.pmod("draw", F.lit(span))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    near = attach(rows.select("lang", "draw"), "lang", sizes, 64, "inner").filter(place < 4 * wanted * span / F.col("rows"))
    ranked = near.select("lang", "draw").distinct().withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(place, "draw")))
    chosen = attach(rows, "draw", ranked.filter(F.col("place") <= wanted).select("draw"), 24, "left_semi").dropDuplicates(["lang", "draw"])
    free = F.greatest(F.length("text") - settings.window_chars + 1, F.lit(1))
    starts = F.array([F.pmod(F.xxhash64("draw", F.lit(j)), free).cast("int") + 1 for j in range(settings.windows_per_document)])
    cut = F.transform(starts, lambda s: F.substr("text", s, F.lit(settings.window_chars)))
    found = chosen.select("lang", "draw", F.explode(F.array_distinct(cut)).alias("part")).collect()
    return [(r.lang, r.part) for r in sorted(found, key=lambda r: (r.lang, r.draw, r.part))]


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Network | None:
    """A network from the columns ``text`` and ``lang``; other columns are never read."""
    return train(sample_windows(labelled, settings), settings)


def language_of(net: Network | None, text: Column, settings: Settings = Settings()) -> Column:
    """Struct of ``lang``, ``score`` (pooled probability) and ``agreement`` (share of bytes with that label)."""
    kind = "lang string, score double, agreement double"

    @F.pandas_udf(kind)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0, "agreement": 0.0})
            held = np.flatnonzero(texts.notna().to_numpy())
            if net is not None and len(held):
                k = len(net.languages)
                total = label_texts(net, [texts.iloc[i] for i in held], settings)
                share = total / np.maximum(total[:, -1:], 1)
                best = share[:, :k].argmax(axis=1)
                rows = np.arange(len(held))
                out.loc[held, "lang"] = np.array(net.languages, object)[best]
                out.loc[held, "score"] = np.round(np.clip(share[rows, best], 0, 1), 6)
                out.loc[held, "agreement"] = np.round(share[rows, k + best], 6)
            yield out

    # Texts without a letter reach Python as nulls.
    return label(F.when(text.rlike(r"\p{L}"), text))


def identify(docs: DataFrame, net: Network | None, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``agreement``."""
    known = docs.withColumn("_lang", language_of(net, F.col("text"), settings))
    return known.withColumns({"lang_pred": F.col("_lang.lang"), "score": F.col("_lang.score"), "agreement": F.col("_lang.agreement")}).drop("_lang")
