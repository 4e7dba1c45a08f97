"""Quality of documents by attention over their passages.

A document is a bag of passages of 64 words. Each passage is encoded from its
own numbers; gated attention, learned from labels of whole documents, weighs the
passages, and the weighted sum of their codes gives the score. Labels never say
which passage is bad: the attention finds out.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.batches import bounded, pieces, texts_of
from quillgrid.llm.jaccard import Shingler
from quillgrid.llm.labelled import held_out, training_rows
from quillgrid.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 64  # of a passage
SAMPLE_ROWS = 12_000  # labelled documents to learn from, at most
CODE, GATE = 16, 12
_GROUP = 1 << 20

# The kinds of bytes that are counted.
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&",
    "pipe": b"|<>",
    "exclaim": b"!?",
    "stop": b".,;:",
    "other": b"@/\\=_+-~^{}[]()\"'`",
    "line": b"\n",
    "outside": bytes(range(128, 256)),
}
_LAGS = (1, 2, 3, 5, 8)
NUMBERS = len(_KINDS) + len(_LAGS) + 6


class Encoder:
    """Numbers of every passage of a group of texts."""

    def __init__(self):
        self.shingler = Shingler(1)
        self.kind = np.full(256, len(_KINDS), np.int64)
        for i, members in enumerate(_KINDS.values()):
            self.kind[list(members)] = i

    def passages(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One row of numbers per passage, and how many passages each text has (one at least, empty if need be)."""
        rows, sizes, held, total = [], [], [], 0
        for i, t in enumerate(texts):
            held.append(t.encode("utf-8", "surrogatepass"))
            total += len(held[-1])
            if total >= _GROUP or i == len(texts) - 1:
                a, b = self._group(held)
                rows.append(a), sizes.append(b)
                held, total = [], 0
        if not rows:
            return np.zeros((0, NUMBERS)), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(sizes)

    def _group(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, words, begin = self.shingler.words_of(raw)
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        at = np.searchsorted(starts, begin)
        counts = np.diff(at)
        sizes = np.maximum(1, -(-counts // WORDS))
        out = np.zeros((int(sizes.sum()), NUMBERS))
        if not len(starts):
            return out, sizes
        doc = np.repeat(np.arange(len(raw)), counts)
        place = np.arange(len(starts)) - at[doc]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        passage = first[doc] + place // WORDS
        used, cut = np.unique(passage, return_index=True)
        n = np.diff(np.append(cut, len(starts))).astype(float)
        # a passage's bytes: from its first word to the next passage of the text or its end
        text_end = begin[1:][doc[cut]] - 1
        byte_from = starts[cut]
        byte_to = np.minimum(np.append(starts[cut[1:]], len(data)), text_end)
        length = np.maximum(byte_to - byte_from, 1).astype(float)
        for i in range(len(_KINDS)):
            sums = np.concatenate([[0], np.cumsum(self.kind[data] == i)])
            out[used, i] = (sums[byte_to] - sums[byte_from]) / length
        k = len(_KINDS)
        sums = lambda values: np.add.reduceat(values.astype(float), cut)
        for j, lag in enumerate(_LAGS):
            same = np.zeros(len(words))
            same[lag:] = (words[lag:] == words[:-lag]) & (doc[lag:] == doc[:-lag])
            out[used, k + j] = sums(same) / n
        k += len(_LAGS)
        size = (ends - starts).astype(float)
        mean = sums(size) / n
        out[used, k] = mean / 10
        out[used, k + 1] = np.sqrt(np.maximum(sums(size * size) / n - mean * mean, 0)) / 10
        out[used, k + 2] = sums((data[starts] >= 65) & (data[starts] <= 90)) / n
        last = data[ends - 1]
        out[used, k + 3] = sums(self.kind[last] < 8) / n - sums(self.kind[last] == 0) / n
        out[used, k + 4] = n / WORDS
        out[used, k + 5] = np.log1p(counts[doc[cut]]) / 10
        return out, sizes


class Attention:
    """Gated attention over the passages of a bag (Ilse, Tomczak and Welling, 2018)."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        shape = {"W": (NUMBERS, CODE), "b": (CODE,), "V": (CODE, GATE), "U": (CODE, GATE), "w": (GATE,), "c": (CODE,), "d": (1,)}
        self.p = {k: draw.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("b", "d") else np.zeros(s) for k, s in shape.items()}
        self.mean, self.scale = np.zeros(NUMBERS), np.ones(NUMBERS)

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict:
        p, first = self.p, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        raw = (t * g) @ p["w"]
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first), sizes))
        a = raw / np.repeat(np.add.reduceat(raw, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first)
        y = 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y}

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.forward(x, sizes)["y"] if len(sizes) else np.zeros(0)

    def gradients(self, f: dict, sizes: np.ndarray, target: np.ndarray) -> dict:
        """Of the mean log loss."""
        p, first = self.p, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        error = (f["y"] - target) / len(target)
        out = {"c": f["z"].T @ error, "d": np.array([error.sum()])}
        back = np.repeat(error[:, None] * p["c"], sizes, axis=0)  # to each passage's share of z
        pull = (back * f["h"]).sum(1)
        spread = f["a"] * (pull - np.repeat(np.add.reduceat(f["a"] * pull, first), sizes))
        gated = f["t"] * f["g"]
        out["w"] = gated.T @ spread
        to_gate = spread[:, None] * p["w"]
        to_t, to_g = to_gate * f["g"] * (1 - f["t"] ** 2), to_gate * f["t"] * f["g"] * (1 - f["g"])
        out["V"], out["U"] = f["h"].T @ to_t, f["h"].T @ to_g
        to_h = f["a"][:, None] * back + to_t @ p["V"].T + to_g @ p["U"].T
        to_x = to_h * (1 - f["h"] ** 2)
        out["W"], out["b"] = f["x"].T @ to_x, to_x.sum(0)
        return out

    def fit(self, x: np.ndarray, sizes: np.ndarray, target: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-4):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        first, draw = np.concatenate([[0], np.cumsum(sizes)]), np.random.default_rng(11)
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(epochs):
            order, pace = draw.permutation(len(sizes)), rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for i in range(0, len(order), batch):
                bags = order[i : i + batch]
                rows = np.concatenate([np.arange(first[b], first[b + 1]) for b in bags])
                f = self.forward(x[rows], sizes[bags])
                step += 1
                for k, g in self.gradients(f, sizes[bags], target[bags]).items():
                    g = g + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def score_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    cut: float = 0.3, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``key, held_out, score, predicted`` of every row of ``docs``; ``predicted`` is 1 from ``cut`` on.

    The model is fitted on a bounded sample of labelled rows (see
    ``training_rows``): their passages' numbers are collected, not their texts.
    Every passage of every text is encoded, however long the text. Null and
    empty texts are a bag of one empty passage, repeated rows get equal scores,
    an empty table gives an empty table; without labels scores are those of the
    model as drawn.
    """

    def encode(batches):
        encoder = Encoder()
        for batch in pieces(batches, 1):
            x, sizes = encoder.passages(texts_of(batch.column(1)))
            flat, offsets = pa.array(x.ravel()), np.concatenate([[0], np.cumsum(sizes * NUMBERS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["label", "x"])

    sample = training_rows(docs, labels, label, sample_rows, key, text).select("label", "text")
    bags = materialize(bounded(sample).mapInArrow(encode, "label int, x array<double>"), "quality-sample").orderBy(F.xxhash64("x", "label")).toArrow()
    model = Attention()
    if bags.num_rows:
        x = bags.column("x").combine_chunks()
        sizes = np.diff(x.offsets.to_numpy()) // NUMBERS
        rows = x.flatten().to_numpy().reshape(-1, NUMBERS)
        model.fit(rows, sizes, (bags.column("label").to_numpy() == 1).astype(float))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        encoder, model = Encoder(), shared.value
        for batch in pieces(batches, 1):
            x, sizes = encoder.passages(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x, sizes), pa.float64())], names=["key", "score"])

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    scored = bounded(rows).mapInArrow(score, "key long, score double")
    return scored.select(
        F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )
