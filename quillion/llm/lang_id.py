"""Language identification by a small byte convolutional network.

Bytes are embedded; filters of several widths slide over a window of fixed length; the
greatest response of each filter feeds a softmax layer.  The network is trained in numpy
on windows of labelled texts.  A text is cut into windows from start to end; the logs
of their probabilities are added up.

For prediction, embedding and filter are one table look-up: the response of a width-w
filter is a sum of rows picked by byte pairs (and a last byte for odd widths).

Training reads a bounded sample, ``DOCS_PER_LANG`` documents of each label chosen by a
hash of the id; that bound is a parameter.  Prediction reads every text whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is all
when there is no labelled text; documents without a label are never learned from; an
empty table gives an empty result; repeated rows are predicted alike; only id, text and
label are read, and the label for training alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

WINDOW = 192
DOCS_PER_LANG = 300
WINDOWS_PER_DOC = 3
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
EPOCHS = 8
BATCH = 64
RATE = 4e-3


def has_letter(text: str) -> bool:
    """Whether any character is of one of Unicode's letter categories (other numerals and symbols are none)."""
    return any(map(str.isalpha, text))


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text; the last one ends with it, a short text is padded with spaces."""
    if len(data) <= WINDOW:
        return np.frombuffer(data.ljust(WINDOW), np.uint8)[None]
    flat = np.frombuffer(data, np.uint8)
    n = len(data) // WINDOW
    out = flat[: n * WINDOW].reshape(n, WINDOW)
    return out if len(data) == n * WINDOW else np.concatenate([out, flat[None, -WINDOW:]])


class Network:
    """Embedding, filters, max pooling, softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.classes = classes
        self.p = {"e": normal(256, DIM, scale=0.5), "b": np.zeros(len(WIDTHS) * FILTERS, np.float32), "c": np.zeros(len(classes), np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = normal(w, DIM, FILTERS, scale=(w * DIM) ** -0.5)
        self.p["o"] = normal(len(WIDTHS) * FILTERS, len(classes), scale=0.2)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest response of each filter, and where it lies."""
        e, best, at = self.p["e"][x], [], []
        for w in WIDTHS:
            span = x.shape[1] - w + 1
            response = sum(e[:, k : k + span] @ self.p[f"w{w}"][k] for k in range(w))
            place = response.argmax(1)
            at.append(place)
            best.append(np.take_along_axis(response, place[:, None], 1)[:, 0])
        return np.concatenate(best, 1) + self.p["b"], np.concatenate(at, 1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        raw, at = self.pooled(x)
        hidden = np.maximum(raw, 0)
        d = softmax(hidden @ self.p["o"] + self.p["c"])
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"o": hidden.T @ d, "c": d.sum(0)}
        d = (d @ self.p["o"].T) * (raw > 0)
        g["b"] = d.sum(0)
        g["e"] = np.zeros_like(self.p["e"])
        rows = np.arange(len(x))[:, None]
        for j, w in enumerate(WIDTHS):
            part = slice(j * FILTERS, (j + 1) * FILTERS)
            down, place, weight = d[:, part], at[:, part], self.p[f"w{w}"]
            grad = np.zeros_like(weight)
            for k in range(w):
                seen = x[rows, place + k]
                grad[k] = np.einsum("bfd,bf->df", self.p["e"][seen], down)
                np.add.at(g["e"], seen, down[:, :, None] * weight[k].T[None])
            g[f"w{w}"] = grad
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
        """Adam over shuffled batches; classes weigh alike by repeating the smaller ones."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(p) for k, p in self.p.items()}
        most = np.bincount(y).max()
        index = np.concatenate([np.resize(np.flatnonzero(y == c), most) for c in np.unique(y)])
        step = 0
        for epoch in range(EPOCHS):
            order = r.permutation(index)
            for low in range(0, len(order), BATCH):
                part, step = order[low : low + BATCH], step + 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k, g in self.gradients(x[part], y[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """For each width: responses to the first byte pair, the second pair, the last byte."""
        out = []
        for w in WIDTHS:
            one = [self.p["e"] @ self.p[f"w{w}"][k] for k in range(w)]
            pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
            second = pair(one[2], one[3]) if w == 4 else None
            out.append((pair(one[0], one[1]), second, one[2] if w == 3 else None))
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Predictor:
    def __init__(self, net: Network):
        self.net, self.tables = net, net.tables()

    def window_logs(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of each window."""
        wide = x.astype(np.int64)
        pairs, pooled = wide[:, :-1] << 8 | wide[:, 1:], []
        for w, (first, second, last) in zip(WIDTHS, self.tables):
            span = x.shape[1] - w + 1
            response = first[pairs[:, :span]]
            if second is not None:
                response += second[pairs[:, 2 : 2 + span]]
            if last is not None:
                response += last[wide[:, 2 : 2 + span]]
            pooled.append(response.max(1))
        hidden = np.maximum(np.concatenate(pooled, 1) + self.net.p["b"], 0)
        return np.log(np.maximum(softmax(hidden @ self.net.p["o"] + self.net.p["c"]), 1e-9))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        keep = [k for k, t in enumerate(texts) if t and has_letter(t)]
        out = [("und", 0.0)] * len(texts)
        parts = [windows_of(texts[k].lower().encode("utf-8", "surrogatepass")) for k in keep]
        if not parts:
            return out
        x = np.concatenate(parts)
        logs = np.concatenate([self.window_logs(x[low : low + 256]) for low in range(0, len(x), 256)])
        starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
        total = np.add.reduceat(logs, starts, axis=0)
        mean = np.add.reduceat(np.exp(logs), starts, axis=0) / np.array([len(p) for p in parts])[:, None]
        best = total.argmax(1)
        for k, c, p in zip(keep, best.tolist(), mean[np.arange(len(best)), best].tolist()):
            out[k] = (self.net.classes[c], min(1.0, max(0.0, p)))
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> Network | None:
    """A network from a sample of the labelled documents that are not held out.

    At most about ``docs_per_lang`` documents of a label, chosen by a hash of the id, and
    of each ``WINDOWS_PER_DOC`` passages at hashed places reach the driver: a bound that
    does not grow with the table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counts = {r[0]: r[1] for r in rows.select("lang").groupBy("lang").count().collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30))
    share = {k: min(1 << 30, int((1 << 30) * 1.2 * docs_per_lang / n) + 1) for k, n in counts.items()}
    chosen = F.coalesce(*[F.when(F.col("lang") == k, F.lit(s)) for k, s in share.items()], F.lit(0))
    room = F.greatest(F.lit(1), F.length("text") - WINDOW)
    place = lambda k: F.pmod(F.xxhash64("id", F.lit(f"place{k}")), room) + 1
    passages = [F.substr("text", place(k).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS_PER_DOC)]
    sample = rows.where(draw < chosen).select("lang", draw.alias("draw"), F.array(*passages).alias("passages"))
    taken: dict[str, int] = {}
    x, y, classes = [], [], sorted(counts)
    for lang, _, found in sorted(sample.collect(), key=lambda r: (r[0], r[1], r[2])):
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= docs_per_lang:
            for text in found:
                if has_letter(text):
                    x.append(windows_of(text.lower().encode("utf-8", "surrogatepass"))[0])
                    y.append(classes.index(lang))
    return Network(classes).fit(np.array(x), np.array(y)) if x else None


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    net = shared.value
    tool = Predictor(net) if net else None
    for whole in batches:
        for low in range(0, whole.num_rows, 256):
            batch = whole.slice(low, 256)
            texts = batch.column(1).to_pylist()
            found = tool.predict(texts) if tool else [("und", 0.0)] * len(texts)
            arrays = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "lang_pred", "score"])


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score.  A map over partitions."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda b: tidy(_predict(b, shared)), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
