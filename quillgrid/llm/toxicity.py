"""Toxicity of documents behind a noisy channel.

Words may be disguised: letters as digits or marks, spaces between letters,
letters repeated. A disguised stretch is a lattice of the characters it can
stand for; the best path under a character language model of the corpus restores
the word. Restored text is scored with the evidence that labelled documents give
for words and beginnings of words.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.batches import bounded, pieces, texts_of
from quillgrid.llm.labelled import held_out, training_rows
from quillgrid.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 12_000  # labelled documents to learn from, at most
LEAST_Z = 3.0  # standard errors by which a feature's evidence must differ from none
BEGINNINGS = (4, 5, 6, 7, 8)
SYMBOLS = 28  # border, a-z, any other letter
CACHE_WORDS = 200_000  # of at most 40 characters, in each task

# What marks and digits stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
}
GAPS = " .-_*"
_LEET = re.escape("".join(LEET))
_MARKS = "".join(c for c in LEET if not c.isalnum()) + GAPS
_LETTER = r"[^\W\d_]"
_WORD = re.compile(rf"{_LETTER}+")
# All of these read a text once, however long its words are.
_RUN = re.compile(rf"(?:{_LETTER}|[{_LEET}.\-_*])+")
_DOUBLE = re.compile(rf"({_LETTER})\1")
_BLANKS = re.compile(r"\s+")
_LITERAL = str.maketrans({mark: letters[0] for mark, letters in LEET.items()})
_AROUND = "\"'()[].,;:!?"
_TRIPLE = re.compile(rf"({_LETTER})\1\1")
_INSIDE = re.compile(rf"{_LETTER}")
_SPACED = re.compile(rf"(?<!\S)(?:{_LETTER}|[{_LEET}])(?:(?:\s+|[.\-_*])(?:{_LETTER}|[{_LEET}])){{2,}}(?![^\s.,;:?])")


def _symbol(char: str) -> int:
    if "a" <= char <= "z":
        return ord(char) - 96
    return 27 if char.isalpha() else 0


def _symbol_table() -> np.ndarray:
    return np.array([_symbol(chr(c).lower()[:1]) for c in range(0x3000)] + [27], np.int64)


def letter_model(texts: DataFrame) -> np.ndarray:
    """Natural log probabilities ``[a, b, c]`` of symbol c after a and b, from all texts.

    Counted by Spark; at most 28 ** 3 rows reach the driver. Shorter contexts
    are mixed in, so nothing is impossible.
    """

    def count(batches):
        table, total = _symbol_table(), np.zeros(SYMBOLS**3, np.int64)
        for batch in pieces(batches, 0):
            for text in batch.column(0).to_pylist():
                if text:
                    codes = np.frombuffer(f"  {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
                    s = table[np.minimum(codes, len(table) - 1)]
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["gram", "n"])

    counted = bounded(texts).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.zeros(SYMBOLS**3)
    for row in counted.collect():
        n[row["gram"]] = row["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    p1 = (n.sum((0, 1)) + 1) / (n.sum() + SYMBOLS)
    p2 = (n.sum(0) + 5 * p1) / (n.sum(0).sum(1, keepdims=True) + 5)
    p3 = (n + 5 * p2[None]) / (n.sum(2, keepdims=True) + 5)
    return np.log(p3)


class Restorer:
    """Viterbi decoding of disguised stretches."""

    def __init__(self, logp: np.ndarray):
        self.logp = logp.tolist()
        # the channel: log probabilities of a mark for a letter, of a repetition, of a gap
        self.mark, self.twice, self.gap = math.log(0.3), math.log(0.2), math.log(0.1)

    def restore(self, stretch: str, borders: bool = False) -> str:
        """The likeliest word. A run of one character stands for one or two letters, a gap for none.

        With ``borders`` the likeliest words: a gap stands for nothing or for a blank between words.
        """
        paths = {(0, 0): (0.0, None)}  # by the last two symbols: score and the letters so far, last first
        at, n = 0, len(stretch)
        while at < n:
            char, end = stretch[at], at + 1
            while end < n and stretch[end] == char:
                end += 1
            run, at = end - at, end
            letters = [(char, 0.0)] if char.isalpha() else [(x, self.mark) for x in LEET.get(char, "")]
            found: dict = {}
            if not letters:  # a gap, or a mark that stands for nothing
                found = {k: (s + self.gap, tail) for k, (s, tail) in paths.items()}
                if borders and char in GAPS:
                    for (a, b), (score, tail) in paths.items():
                        key, value = (b, 0), score + self.gap + self.logp[a][b][0]
                        if b and (key not in found or value > found[key][0]):
                            found[key] = (value, (" ", tail))
            for letter, cost in letters:
                c = _symbol(letter)
                for (a, b), (score, tail) in paths.items():
                    one = score + cost + self.logp[a][b][c]
                    options = [((b, c), one, (letter, tail))]
                    if run > 1:
                        options.append(((c, c), one + self.twice + self.logp[b][c][c], (letter, (letter, tail))))
                    for key, value, path in options:
                        if key not in found or value > found[key][0]:
                            found[key] = (value, path)
            paths = found
        best = max(((s + self.logp[a][b][0], tail) for (a, b), (s, tail) in paths.items()), key=lambda x: x[0])
        out, tail = [], best[1]
        while tail is not None:
            out.append(tail[0])
            tail = tail[1]
        return "".join(reversed(out))

    def token_words(self, token: str) -> set[str]:
        """Words of a stretch without white space in lower case, and what its disguised parts restore to.

        A part is disguised when marks or digits stand before or between its
        letters, or a letter stands three times in a row. Marks behind the last
        letter or digit are punctuation in one reading and letters in others.
        """
        words = set(_WORD.findall(token))
        if token.isalpha() and not _TRIPLE.search(token):
            return words
        for run in _RUN.findall(token):
            part = run.lstrip(GAPS).rstrip(_MARKS)
            if _INSIDE.search(part) and (not part.isalpha() or _TRIPLE.search(part)):
                words.add(self.restore(part))
            whole = run.strip(GAPS)
            tail = whole[len(whole.rstrip(_MARKS)) :]
            if tail and len(tail) < len(whole) and _INSIDE.search(whole):
                words.add("".join(c for c in whole.translate(_LITERAL) if c.isalpha()))
                if tail.strip("!" + GAPS):  # exclamation marks alone rarely are letters
                    words.add(self.restore(whole))
        return words

    def likelihood(self, words: str) -> float:
        """Log probability of words with a blank between them."""
        a, b, total = 0, 0, 0.0
        for c in map(_symbol, words + " "):
            a, b, total = b, c, total + self.logp[a][b][c]
        return total

    def inside(self, word: str, lexicon, longest: int) -> set[str]:
        """Words of the lexicon in a word whose letters all stood apart, where borders around them are likelier than none."""
        found = set()
        for i in range(len(word)):
            for j in range(i + 2, min(len(word), i + longest) + 1):
                if j - i < len(word) and word[i:j] in lexicon:  # letters further away change nothing
                    before, after = word[max(0, i - 4) : i], word[j : j + 4]
                    if self.likelihood(f"{before} {word[i:j]} {after}".strip()) > self.likelihood(before + word[i:j] + after):
                        found.add(word[i:j])
        return found

    def stretches(self, lower: str, lexicon=(), longest: int = 0) -> list[str]:
        """Restored stretches of single characters with gaps, read as one word and as several."""
        words = []
        for found in _SPACED.findall(lower):
            found = _BLANKS.sub(" ", found)
            one = self.restore(found)
            words += {one, *self.restore(found, borders=True).split(), *self.inside(one, lexicon, longest)}
        return words

    def words(self, text: str) -> set[str]:
        """All words of the text in lower case, and those that disguised stretches restore to."""
        lower = text.lower()
        return set().union(self.stretches(lower), *map(self.token_words, set(lower.split())))


def features(word: str) -> list[str]:
    """A word and its beginnings; a beginning is marked, so that it isn't taken for a word."""
    return [word, *[word[:k] + "-" for k in BEGINNINGS if len(word) >= k]]


def learn_evidence(sample: DataFrame, logp: np.ndarray, least_z: float = LEAST_Z) -> dict[str, float]:
    """Log odds of features that occur in labelled texts clearly more often with label 1.

    Counted by Spark over the sample; only features whose log odds are
    ``least_z`` standard errors above 0 reach the driver, at most as many as
    the sample has.
    """
    sizes = sample.agg(F.count(F.when(F.col("label") == 1, 1)).alias("t"), F.count(F.when(F.col("label") != 1, 1)).alias("c")).first()
    shared = sample.sparkSession.sparkContext.broadcast(logp)

    def count(batches):
        restorer, totals = Restorer(shared.value), (Counter(), Counter())
        for batch in pieces(batches, 1):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[label == 1].update({f for w in restorer.words(text) for f in features(w)})
        names = list(totals[0].keys() | totals[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), *[pa.array([totals[k][f] for f in part], pa.int64()) for k in (1, 0)]], names=["feature", "t", "c"]
            )

    counted = bounded(sample.select("label", "text")).mapInArrow(count, "feature string, t long, c long")
    counted = counted.groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).filter("t >= 3")
    odds = F.log((F.col("t") + 0.5) / (sizes["t"] + 1.0)) - F.log((F.col("c") + 0.5) / (sizes["c"] + 1.0))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    clear = counted.withColumn("odds", odds).filter(F.col("odds") > least_z * error)
    return {r["feature"]: r["odds"] for r in clear.select("feature", "odds").collect()}


class Scorer:
    """Evidence of one text: the strongest word, and all words together."""

    def __init__(self, logp: np.ndarray, evidence: dict[str, float]):
        self.restorer, self.evidence = Restorer(logp), evidence
        self.known: dict[str, float] = {}
        self.longest = max(map(len, evidence), default=0)
        self.starts = {word[:k] for word in evidence if word.isalpha() for k in range(1, len(word))}

    def _word(self, word: str) -> float:
        return max(self.evidence.get(f, 0.0) for f in features(word))

    def _token(self, token: str) -> float:
        words = self.restorer.token_words(token)
        value = max(map(self._word, words), default=0.0)
        for word in words:
            if _DOUBLE.search(word):  # letters may be doubled; only whole words count then
                short = len(word) <= self.longest + 1
                once = [word[: m.start()] + word[m.start() + 1 :] for m in _DOUBLE.finditer(word)] if short else []
                value = max(value, *[self.evidence.get(w, 0.0) for w in (_DOUBLE.sub(r"\1", word), *once)])
        if len(self.known) >= CACHE_WORDS:
            self.known = {}
        if len(token) <= 40:
            self.known[token] = value
        return value

    def _fragments(self, tokens: list[str]) -> list[float]:
        """Evidence of whole words that neighbouring tokens make together.

        Single characters alone are left to the lattice.
        """
        found, starts = {}, self.starts
        for i, token in enumerate(tokens):
            if token in starts or (token := token.lstrip(_AROUND)) in starts:
                joined, longest, at = token, len(token), i + 1
                while joined in starts and at < len(tokens):
                    part = tokens[at].rstrip(_AROUND)
                    joined, longest, at = joined + part, max(longest, len(part)), at + 1
                    if longest > 1 and part and joined in self.evidence:
                        found[joined] = self.evidence[joined]
                    if part != tokens[at - 1]:  # the sentence or its part ends here
                        break
        return list(found.values())

    def __call__(self, text: str) -> tuple[float, float]:
        lower = text.lower()
        read = lower.split()
        tokens = list(set(read))
        values = list(map(self.known.get, tokens))
        if None in values:
            values = [v if v is not None else self._token(t) for v, t in zip(values, tokens, strict=True)]
        values += map(self._word, self.restorer.stretches(lower, self.evidence, self.longest))
        values += self._fragments(read)
        total = sum(values)
        return (max(values), math.log1p(total)) if total else (0.0, 0.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights and intercept (last) by Newton's method; the intercept isn't penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    weights, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - y) + ridge * weights
        weights = weights - np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), gradient)
    return weights


def score_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``key, held_out, score, predicted`` of every row of ``docs``.

    The letter model is counted over all texts. Three quarters of a bounded
    sample of labelled rows (see ``training_rows``) give the evidence, the rest
    the logistic scale; without labels of both kinds every score is 0.5 or the
    share of label 1. Null and empty texts have no evidence, repeated rows equal
    scores, an empty table gives an empty table.
    """
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    logp = letter_model(texts)
    sample = materialize(training_rows(docs, labels, label, sample_rows, key, text), "toxic-sample")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "key"), F.lit(4))
    evidence = learn_evidence(sample.filter(fold != 0), logp)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((logp, evidence))

    def evidence_of(batches):
        scorer = Scorer(*shared.value)
        for batch in pieces(batches, 1):
            found = [scorer(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]], names=["key", "most", "all"]
            )

    rest = sample.filter(fold == 0).select(F.col("label").cast("bigint").alias("key"), "text")
    known = bounded(rest).mapInArrow(evidence_of, "key long, most double, all double").collect()  # a quarter of the sample at most
    x, y = np.array([[r["most"], r["all"]] for r in known]).reshape(-1, 2), np.array([float(r["key"] == 1) for r in known])
    weights = fit_logistic(x, y) if len(y) else np.zeros(3)
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    line = F.col("most") * float(weights[0]) + F.col("all") * float(weights[1]) + float(weights[2])
    score = 1 / (1 + F.exp(-line))
    scored = bounded(rows).mapInArrow(evidence_of, "key long, most double, all double").withColumn("score", score)
    return scored.select(
        F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
