"""Language of sentences: averaged hashed subword embeddings and a linear softmax.

A word is the mean of the embeddings of its character n-grams (hashed), a
sentence the mean of its words; a linear layer and a softmax give
probabilities, a temperature fitted on held-out sentences calibrates them, and
sentences under the calibrated confidence are rejected.  Trained by stochastic
gradient descent in numpy on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import LANGS, WORD

BUCKETS = 1 << 15
DIM = 16
#: About so many labelled documents are used for training, all if there are no more.
TRAIN_DOCUMENTS = 3000
#: Of each, at most so many sentences.
TRAIN_SENTENCES = 6
#: Words kept with their scores in a worker.
CACHE_WORDS = 200_000

_CODE = re.compile(r"\w*\d\w*")
_DIGIT = re.compile(r"\d")
#: Stretches up to and with their end marks; linear also in a text without any.
_PIECE = re.compile(r"[^.!?…]+[.!?…]*")


def subwords(word: str) -> list[int]:
    """Buckets of a word's n-grams of 2 to 4 characters and of the whole word, with edge marks."""
    w = f"<{word}>"
    grams = [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in [*grams, w]]


@dataclass
class LanguageModel:
    """Trained scores; ``table`` holds the linear layer already applied to every bucket."""

    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5
    _ids: dict[str, int] = field(default_factory=dict, repr=False)
    _scores: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"table": self.table, "bias": self.bias, "temperature": self.temperature, "least": self.least, "_ids": {}, "_scores": None}

    def probabilities(self, sentences: list[list[str]]) -> np.ndarray:
        """One row of probabilities per sentence (list of lower-case words); uniform for none."""
        if len(self._ids) > CACHE_WORDS:
            self._ids.clear()
        if self._scores is None:
            self._scores = np.zeros((1024, len(LANGS)), np.float32)
        ids: list[int] = []
        known = self._ids
        for words in sentences:
            for w in words:
                i = known.get(w)
                if i is None:
                    i = known[w] = len(known)
                    if i >= len(self._scores):
                        self._scores = np.concatenate([self._scores, np.zeros_like(self._scores)])
                    self._scores[i] = self.table[subwords(w)].mean(0)
                ids.append(i)
        sizes = np.fromiter(map(len, sentences), np.int64, len(sentences))
        sums = np.zeros((len(sentences), len(LANGS)), np.float64)
        if ids:
            some = np.flatnonzero(sizes)
            sums[some] = np.add.reduceat(self._scores[ids].astype(np.float64), (np.cumsum(sizes) - sizes)[some], axis=0)
        logits = (sums / np.maximum(sizes, 1)[:, None] + self.bias) / self.temperature
        logits[sizes == 0] = 0
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _words(text: str) -> list[str]:
    lower = text.lower()
    return WORD.findall(_CODE.sub(" ", lower) if _DIGIT.search(lower) else lower)


def _enough(words: list[str]) -> bool:
    n = 0
    for w in words:
        n += len(w) > 1
        if n == 3:
            return True
    return False


def sentences_of(text: str) -> list[list[str]]:
    """Words of the sentences of a text: stretches of three or more words that end in a full stop, ! or ?.

    Codes (tokens with digits) are no words, and three words must have two letters or more.
    """
    return [w for m in _PIECE.finditer(text) if m.group()[-1] in ".!?…" and _enough(w := _words(m.group()))]


def pieces_of(text: str) -> list[list[str]]:
    """Words of all of a text by piece: its sentences and what follows the last one without an end mark.

    What is too short for a sentence goes with the piece before it, at the
    start with the one after it.  A text without sentences is one piece, which
    has no words if the text has none.
    """
    out: list[list[str]] = []
    head: list[str] = []
    for m in _PIECE.finditer(text):
        words = _words(m.group())
        if _enough(words):
            out.append(head + words)
            head = []
        elif out:
            out[-1] += words
        else:
            head += words
    return out or [head]


def runs(p: np.ndarray, owner: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, number of words, language index, mean probabilities) of the runs of pieces of one language.

    A run is as many pieces in a row of one owner as have the same likeliest
    language; its language is -1 if no piece reaches ``least``, and neighbours
    without a language are one run.  Pieces without words have probability 0.
    """
    p = np.where(sizes[:, None] > 0, p, 0.0)
    if not len(p):
        return owner, sizes, owner, p
    most = p.argmax(1)
    start = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (most[1:] != most[:-1])])
    lang = np.where(np.maximum.reduceat(p.max(1), start) >= least, most[start], -1)
    own = owner[start]
    kept = np.r_[True, (own[1:] != own[:-1]) | (lang[1:] != -1) | (lang[:-1] != -1)]
    start, lang = start[kept], lang[kept]
    n = np.diff(np.r_[start, len(p)])
    return owner[start], np.add.reduceat(sizes, start), lang, np.add.reduceat(p, start) / n[:, None]


def train(samples: list[tuple[list[str], int]], epochs: int = 3, seed: int = 7) -> LanguageModel:
    """A model from (words, language index) samples; a fifth is held out for calibration."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    k = len(LANGS)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    layer, bias = rng.normal(0, 0.1, (DIM, k)), np.zeros(k)
    cache: dict[str, list[int]] = {}
    rows = []
    for words, _ in samples:
        ids = []
        for w in words:
            if w not in cache:
                cache[w] = subwords(w)
            ids.append(cache[w])
        rows.append(ids)
    freq = np.bincount([samples[i][1] for i in used], minlength=k) if len(used) else np.ones(k)
    weight = np.where(freq > 0, freq.sum() / np.maximum(freq, 1) / k, 0)
    batch, rate = 64, 2.0
    steps = max(1, epochs * len(used) // batch)
    done = 0
    for _ in range(epochs):
        for start in range(0, len(used), batch):
            chosen = rng.permutation(used)[:batch] if start else used[rng.permutation(len(used))[:batch]]
            flat, owner, share = [], [], []
            for j, i in enumerate(chosen):
                for grams in rows[i]:
                    flat += grams
                    owner += [j] * len(grams)
                    share += [1 / (len(grams) * len(rows[i]))] * len(grams)
            flat_, owner_, share_ = np.array(flat), np.array(owner), np.array(share)[:, None]
            x = np.zeros((len(chosen), DIM))
            np.add.at(x, owner_, emb[flat_] * share_)
            z = x @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = np.array([samples[i][1] for i in chosen])
            p[np.arange(len(y)), y] -= 1
            g = p * weight[y][:, None] / len(y)
            lr = rate * (1 - done / (steps + 1))
            gx = g @ layer.T
            layer -= lr * (x.T @ g)
            bias -= lr * g.sum(0)
            np.add.at(emb, flat_, -lr * 20 * gx[owner_] * share_)
            done += 1
    model = LanguageModel((emb @ layer).astype(np.float32), bias)
    if len(held):
        y = np.array([samples[i][1] for i in held])
        words = [samples[i][0] for i in held]

        def loss(t: float) -> float:
            model.temperature = t
            return float(-np.log(np.maximum(model.probabilities(words)[np.arange(len(y)), y], 1e-9)).mean())

        model.temperature = min((0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
        p = model.probabilities(words)
        right = p.max(1)[p.argmax(1) == y]
        # Reject what is less sure than all but one in 200 right answers, within sane bounds.
        model.least = float(np.clip(np.quantile(right, 0.005), 0.5, 0.8)) if len(right) else 0.5
    return model


def _pick(sentences: int):
    """Arrow function that gives the ``sentences`` sentences of lowest hash of each text, with its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked, labels = [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sorted({" ".join(s) for s in sentences_of(text)}, key=lambda s: (zlib.crc32(s.encode()), s))[:sentences]
                picked += found
                labels += [lang] * len(found)
            yield pa.record_batch([pa.array(picked, pa.string()), pa.array(labels, pa.string())], names=["sentence", "lang"])

    return run


def fit(documents: DataFrame, limit: int = TRAIN_DOCUMENTS, sentences: int = TRAIN_SENTENCES) -> LanguageModel:
    """A model from a bounded sample of ``documents`` (doc_id, text, lang).

    About ``limit`` labelled documents are drawn by the hash of their id, so
    only they leave the scan, and ``sentences`` sentences of each, by hash from
    its whole text.  Labels outside LANGS, null and empty texts are left out.
    Without any labelled text the model rejects everything.
    """
    labelled = documents.where(F.col("lang").isin(*LANGS) & (F.col("text") != ""))
    n = labelled.select("lang").count()
    if n > limit:
        share = 1 << 30
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) < limit * share // n)
    rows = labelled.select("text", "lang").mapInArrow(_pick(sentences), "sentence string, lang string").collect()
    samples = sorted((r["sentence"].split(" "), LANGS.index(r["lang"])) for r in rows)
    if not samples:
        return LanguageModel(np.zeros((BUCKETS, len(LANGS)), np.float32), np.zeros(len(LANGS)), least=1.1)
    return train(samples)
