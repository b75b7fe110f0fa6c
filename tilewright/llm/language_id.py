"""Operator 10, language ID: a byte convolutional network in numpy.

Filters of several widths run over the bytes of fixed-length windows, each
filter keeps its maximum, and a softmax layer turns the maxima into language
probabilities. Filters act on one-hot byte classes, so a filter of width 4 is
two look-ups in a table of byte pairs. A document is judged by the mean log
probability over all windows of its whole text.

Defined results: a null text and a text without a letter are ``und`` with
score 0. Without any labelled row every text is ``und``. Repeated rows are
judged one by one. Input columns that clash with result names are not carried.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import frugal, slices

UNKNOWN = "und"
WINDOW = 256
FILTERS = 16
WIDTHS = (2, 3, 4)
#: Bound of the training sample: so many documents of each language, and so many passages of each.
DOCS_PER_LANGUAGE = 600
PASSAGES = 3
_LETTER = re.compile(r"[^\W\d_]")


def _classes() -> np.ndarray:
    """Byte classes: white space and controls, digits, other ASCII signs, letters without case, every byte from 128."""
    of = np.zeros(256, np.int64)
    for b in range(33, 127):
        of[b] = 1 if 48 <= b < 58 else 2
    for i in range(26):
        of[65 + i] = of[97 + i] = 3 + i
    of[128:] = np.arange(29, 157)
    return of


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1


@dataclass
class Model:
    languages: list[str]
    filters: dict[int, np.ndarray] = field(default_factory=dict)  # width -> (width, classes, filters)
    dense: np.ndarray | None = None  # (features, languages)
    bias: np.ndarray | None = None

    @functools.cached_property
    def tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """For each width: (offset, rows by byte pair or, at an odd end, by byte)."""
        out = {}
        for width, f in self.filters.items():
            f = f.astype(np.float32)
            parts = [(j, (f[j][:, None] + f[j + 1][None]).reshape(-1, f.shape[2])) for j in range(0, width - 1, 2)]
            out[width] = parts + ([(width - 1, f[width - 1])] if width % 2 else [])
        return out

    def features(self, windows: np.ndarray) -> np.ndarray:
        """(windows, WINDOW) classes -> maxima of all filters, not below 0."""
        out = np.empty((len(windows), len(self.filters) * FILTERS), np.float32)
        for a in range(0, len(windows), 64):
            w = windows[a : a + 64]
            pairs = w[:, :-1] * N_CLASSES + w[:, 1:]
            for i, (width, parts) in enumerate(self.tables.items()):
                span = w.shape[1] - width + 1
                total = None
                for at, table in parts:
                    rows = np.take(table, (pairs if len(table) > N_CLASSES else w)[:, at : at + span], axis=0)
                    total = rows if total is None else np.add(total, rows, out=total)
                out[a : a + 64, i * FILTERS : (i + 1) * FILTERS] = total.max(axis=1)
        return np.maximum(out, 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.features(windows) @ self.dense + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as byte classes, the last one of a text filled with white space; and each one's text."""
    counts = np.asarray([max(1, -(-len(t) // WINDOW)) for t in texts])
    data = np.frombuffer(b"".join(t.ljust(n * WINDOW) for t, n in zip(texts, counts.tolist(), strict=True)), np.uint8)
    return CLASSES[data].reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), counts)


def train(texts: list[bytes], labels: list[str], epochs: int = 6, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Model:
    """Fits filters and the softmax layer with Adam on windows of labelled passages."""
    languages = sorted(set(labels))
    model = Model(languages)
    rng = np.random.default_rng(seed)
    n_features = len(WIDTHS) * FILTERS
    p = {w: rng.normal(0, 0.1, (w, N_CLASSES, FILTERS)) for w in WIDTHS} | {"dense": rng.normal(0, 0.1, (n_features, len(languages))), "bias": np.zeros(len(languages))}
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    x, owner = windows_of(texts)
    y = np.searchsorted(languages, labels)[owner]
    for step, rows in enumerate(r for _ in range(epochs) for r in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch))):
        w, hot = x[rows], np.eye(len(languages))[y[rows]]
        pooled, places = [], []
        for width in WIDTHS:
            span = WINDOW - width + 1
            total = sum(p[width][j][w[:, j : j + span]] for j in range(width))
            place = total.argmax(axis=1)
            places.append(place)
            pooled.append(np.take_along_axis(total, place[:, None], 1)[:, 0])
        features = np.maximum(np.concatenate(pooled, 1), 0)
        z = features @ p["dense"] + p["bias"]
        prob = np.exp(z - z.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        dz = (prob - hot) / len(rows)
        grad = {"dense": features.T @ dz, "bias": dz.sum(0)}
        back = (dz @ p["dense"].T) * (features > 0)
        for i, width in enumerate(WIDTHS):
            g, own = np.zeros_like(p[width]), back[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(width):
                seen = np.take_along_axis(w, places[i] + j, 1)
                np.add.at(g[j], (seen, np.broadcast_to(np.arange(FILTERS), seen.shape)), own)
            grad[width] = g
        for k, g in grad.items():
            m, v = state[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p[k] -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-8)
    model.filters = {w: p[w].astype(np.float32) for w in WIDTHS}
    model.dense, model.bias = p["dense"].astype(np.float32), p["bias"].astype(np.float32)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Trains on passages of at most ``docs_per_language`` documents of each language, none of them held out.

    Passages begin at hashed places anywhere in the text. Only the sample and one row a language reach the driver.
    """
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(label_col).cast("string")).count().collect()}
    if not counts:
        return Model([])
    rate = F.lit(0.0)
    for language, n in sorted(counts.items()):
        rate = F.when(F.col(label_col) == language, min(1.0, 1.3 * docs_per_language / n)).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_003)) / 1_000_003
    n = F.length(text_col)
    places = [F.substring(F.col(text_col), (1 + F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), F.greatest(n - WINDOW, F.lit(1)))).cast("int"), F.lit(WINDOW)) for k in range(PASSAGES)]
    sample = rows.where(draw < rate).select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("y"), F.array(*places).alias("p"))
    kept, seen = [], dict.fromkeys(counts, 0)
    for r in sorted(sample.collect(), key=lambda r: (str(r["id"]), r["p"])):
        if seen[r["y"]] < docs_per_language:
            seen[r["y"]] += 1
            kept += [(t.encode()[:WINDOW], r["y"]) for t in dict.fromkeys(r["p"]) if t and _LETTER.search(t)]
    return train([t for t, _ in kept], [y for _, y in kept]) if kept else Model([])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``lang_pred`` and ``score`` beside the columns ``keep`` (default: the id) of every row."""
    keep = keep or (id_col,)
    # The text crosses to Python once, also where it is among the columns to keep.
    text = keep.index(text_col) if text_col in keep else len(keep)
    src = docs.select(*[F.col(c) for c in keep], *([] if text < len(keep) else [F.col(text_col).cast("string").alias("_text")]))
    schema = src.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    names = [*keep, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = np.asarray([*model.languages, UNKNOWN], object)
        for whole in batches:
            for batch in slices(whole, 1_000_000, text):
                texts = batch.column(text).to_pylist()
                best, score = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
                own = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model.languages else []
                if own:
                    x, at = windows_of([texts[i].encode() for i in own])
                    starts = np.flatnonzero(np.diff(at, prepend=-1))
                    mean = np.add.reduceat(model.log_probabilities(x), starts, axis=0) / np.diff([*starts, len(at)])[:, None]
                    prob = np.exp(mean - mean.max(1, keepdims=True))
                    prob /= prob.sum(1, keepdims=True)
                    best[own], score[own] = prob.argmax(1), prob.max(1)
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(languages[best].tolist(), pa.string()), pa.array(score)], names=names)

    return src.mapInArrow(frugal(run), schema)
