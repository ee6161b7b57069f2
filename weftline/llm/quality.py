"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded (surface statistics, hashed shapes and words of its distinct
words, hashed letter trigrams), a gated attention learned from document labels alone weighs the passages, and the weighted representation is scored. The
fit takes a bounded, hashed sample of labelled documents (SAMPLE_DOCS) with the passages of long ones averaged in runs
(FIT_PASSAGES), so its memory does not follow the lengths of texts; scoring covers every text, whole.

Defined cases: a null or empty text is one empty passage and gets that score; very long ones are scored over all their
passages; of rows that give one id several texts the fit takes the one whose encoding sorts first; labels that disagree for a document
(or repeated label rows) are averaged, ties count as 1; null labels and null ids teach nothing; repeated rows are
scored alike; without two classes among the labels every score is the labels' mean (0.5 without labels); an empty
table gives an empty table; other columns are left out of `score` and kept by `keep_good`.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

#: Labelled documents that the fit takes at most, in the order of a hash of the id.
SAMPLE_DOCS = 3_000
#: Words of a passage, buckets of word shapes, of words and of letter trigrams (2**6), width of the hidden layers.
PASSAGE_WORDS, SHAPES, WORDS, TRIGRAMS, HIDDEN, GATE = 96, 12, 48, 64, 16, 12
BUCKETS = SHAPES + WORDS + TRIGRAMS
#: Words whose buckets a task remembers.
REMEMBERED = 100_000
#: Weight of the buckets of words and trigrams beside the other features, of those that `choose_lexical` tries on training
#: rows alone.
LEXICAL, LEXICALS = 0.05, (0.05, 0.1, 0.2, 0.5, 1.0)
#: Passages of a document that the fit holds at most: in longer ones passages in a row are averaged, all of them.
FIT_PASSAGES = 64
ROUNDS, RATE, DECAY, SEED = 150, 0.03, 1e-3, 7
N_STATS = 20
MARKS = "!*%$#&|"


def shape(word: str) -> int:
    """A bucket for how a word is cased, how it ends and how long it is."""
    kind = ("U" if word.isupper() else "T" if word[0].isupper() else "l" if word.islower() else "x") + (word[-1] if not word[-1].isalnum() else "d" if word[-1].isdigit() else "a") + str(min(len(word), 16) // 4)
    return zlib.crc32(kind.encode()) % SHAPES


class Lexicon(dict):
    """The buckets of a word as bytes: its shape, and the word itself in any case."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = bytes((shape(word), SHAPES + zlib.crc32(word.lower().encode()) % WORDS))
        return found


def trigrams(texts: list[str]) -> np.ndarray:
    """(texts, buckets): how often each bucket's byte trigrams stand in a lower-cased text, as a share."""
    raw = np.frombuffer("\n".join(texts).lower().encode(), np.uint8)
    breaks = raw == 10
    of = np.cumsum(breaks)
    raw = raw.astype(np.uint32)
    bucket = (raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(26)
    inside = ~(breaks[:-2] | breaks[1:-1] | breaks[2:])
    found = np.bincount(of[:-2][inside] * TRIGRAMS + bucket[inside], minlength=len(texts) * TRIGRAMS).reshape(-1, TRIGRAMS)
    return found / np.maximum(found.sum(1, keepdims=True), 1)


def surface(words: list[str], text: str, different: set[str]) -> list[float]:
    n, size = len(words), len(text)
    letters = sum(map(str.isalpha, text)) or 1
    stats = [text.count(c) / n for c in MARKS]
    return stats + [
        len(different) / n, sum(map(str.isupper, words)) / n, sum(map(str.isdigit, words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(zip(words, words[1:]))) / max(1, n - 1), len(set(zip(words, words[3:]))) / max(1, n - 3),
        size / n / 8, max(map(len, different)) / 32, letters / size, (text.count(".") + text.count(",")) / n, (text.count("<") + text.count("{") + text.count("=") + text.count("/")) / n, sum(map(str.isupper, text)) / letters, min(n, PASSAGE_WORDS) / PASSAGE_WORDS,
    ]


def passages(text: str | None, known: Lexicon) -> np.ndarray:
    """(passages, features) of a whole text, one passage at least."""
    words = (text or "").split()
    if not words:
        return np.zeros((1, N_STATS + BUCKETS), np.float32)
    parts = [words[i : i + PASSAGE_WORDS] for i in range(0, len(words), PASSAGE_WORDS)]
    texts, different = [" ".join(p) for p in parts], [set(p) for p in parts]
    out = np.zeros((len(parts), N_STATS + BUCKETS), np.float32)
    out[:, :N_STATS] = [surface(p, t, d) for p, t, d in zip(parts, texts, different, strict=True)]
    # Two buckets a distinct word.
    n = np.array([len(d) for d in different])
    buckets = np.frombuffer(b"".join([known[w] for d in different for w in d]), np.uint8)
    width = SHAPES + WORDS
    lexical = np.bincount(np.repeat(np.arange(len(parts)) * width, 2 * n) + buckets, minlength=len(parts) * width).reshape(-1, width)
    out[:, N_STATS : N_STATS + width] = lexical / n[:, None]
    out[:, N_STATS + width :] = trigrams(texts)
    return out


@dataclass
class Model:
    """Standardised features x -> h = tanh(x W + b); attention exp(u . (tanh(h V) * sigmoid(h G))); score of the mean."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """first: index of each bag's first passage."""
        w, s = self.w, {}
        s["x"] = np.clip((x - self.mean) / self.scale, -6, 6)
        s["h"] = np.tanh(s["x"] @ w["W"] + w["b"])
        s["v"], s["g"] = np.tanh(s["h"] @ w["V"]), 1 / (1 + np.exp(-(s["h"] @ w["G"])))
        e = (s["v"] * s["g"]) @ w["u"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        s["a"] = e / np.add.reduceat(e, first)[bag]
        s["z"] = np.add.reduceat(s["a"][:, None] * s["h"], first)
        s["p"] = 1 / (1 + np.exp(-np.clip(s["z"] @ w["c"] + w["d"], -30, 30)))
        s["bag"] = bag
        return s

    def score(self, bag: np.ndarray) -> tuple[float, np.ndarray]:
        if self.constant is not None:
            return self.constant, np.full(len(bag), 1 / len(bag))
        s = self.forward(bag, np.array([0]))
        return float(s["p"][0]), s["a"]


def pooled(bag: np.ndarray, most: int = FIT_PASSAGES) -> np.ndarray:
    """A bag of `most` passages at most: runs of nearly equal length, averaged."""
    if len(bag) <= most:
        return bag
    starts = np.arange(most) * len(bag) // most
    return (np.add.reduceat(bag, starts) / np.diff(np.append(starts, len(bag)))[:, None]).astype(np.float32)


def fit(bags: list[np.ndarray], labels: np.ndarray, lexical: float = LEXICAL) -> Model:
    """Full-batch Adam on the log loss; deterministic."""
    width = N_STATS + BUCKETS
    if not len(bags) or labels.min() == labels.max():
        return Model(np.zeros(width), np.ones(width), {}, float(labels.mean()) if len(bags) else 0.5)
    x, labels = np.concatenate(bags), labels.astype(np.float32)
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    r = np.random.default_rng(SEED)
    draw = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    w = {"W": draw(width, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "G": draw(HIDDEN, GATE), "u": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1, np.float32)}
    model = Model(x.mean(0), x.std(0) + 1e-3, w)
    model.scale[N_STATS + SHAPES :] /= lexical
    one, two = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, ROUNDS + 1):
        s = model.forward(x, first)
        dz = (s["p"] - labels)[:, None] / len(labels)
        grad = {"c": (dz * s["z"]).sum(0), "d": dz.sum(0)}
        dz = (dz * w["c"])[s["bag"]]
        da = (dz * s["h"]).sum(1)
        de = s["a"] * (da - np.add.reduceat(s["a"] * da, first)[s["bag"]])
        grad["u"] = (de[:, None] * s["v"] * s["g"]).sum(0)
        dv = de[:, None] * w["u"] * s["g"] * (1 - s["v"] ** 2)
        dg = de[:, None] * w["u"] * s["v"] * s["g"] * (1 - s["g"])
        grad["V"], grad["G"] = s["h"].T @ dv, s["h"].T @ dg
        dh = (s["a"][:, None] * dz + dv @ w["V"].T + dg @ w["G"].T) * (1 - s["h"] ** 2)
        grad["W"], grad["b"] = s["x"].T @ dh, dh.sum(0)
        for k in w:
            g = grad[k] + DECAY * w[k] / 10
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.999 * two[k] + 0.001 * g * g
            w[k] -= RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return model


def training_bags(docs: DataFrame, labels: DataFrame, held_out_remainder: int | None = 1, sample_docs: int = SAMPLE_DOCS) -> tuple[list[np.ndarray], np.ndarray]:
    """Pooled bags and labels of labelled documents whose crc32(doc_id) mod 3 is not the held-out remainder, in order of id:
    `sample_docs` bags of FIT_PASSAGES passages at most, 110 MB by default."""
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.filter("doc_id is not null and quality is not null")
    if held_out_remainder is not None:
        known = known.filter(key % 3 != held_out_remainder)
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    # The sample is of ids alone, in hash order, with a bound; only its documents are encoded.
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def build():
        words = Lexicon()

        def row(doc_id, text, quality):
            return doc_id, float(quality >= 0.5), pooled(passages(text, words)).tobytes()

        return row

    got = map_rows(rows, ["doc_id", "text", "quality"], "doc_id long, quality double, bag binary", build).groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("bag").alias("bag")).toArrow().sort_by("doc_id")
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_STATS + BUCKETS) for b in got.column("bag").to_pylist()]
    return bags, np.array(got.column("quality").to_pylist(), float)


def train(docs: DataFrame, labels: DataFrame, held_out_remainder: int | None = 1, sample_docs: int = SAMPLE_DOCS, lexical: float = LEXICAL) -> Model:
    """Fit on the training rows."""
    return fit(*training_bags(docs, labels, held_out_remainder, sample_docs), lexical)


def choose_lexical(docs: DataFrame, labels: DataFrame, candidates: tuple[float, ...] = LEXICALS, held_out_remainder: int | None = 1, folds: int = 4) -> dict[float, float]:
    """The log loss of each weight on folds of the training rows (the k-th, (k + folds)-th and so on by id are judged
    by a model of the others); held-out rows are not read. The least one is the weight to train with."""
    bags, labels_ = training_bags(docs, labels, held_out_remainder)
    at, loss = np.arange(len(bags)) % folds, dict.fromkeys(candidates, 0.0)
    for weight in candidates:
        for k in range(folds):
            model = fit([b for b, f in zip(bags, at, strict=True) if f != k], labels_[at != k], weight)
            p = np.clip([model.score(b)[0] for b, f in zip(bags, at, strict=True) if f == k], 1e-7, 1 - 1e-7)
            y = labels_[at == k]
            loss[weight] -= float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()) / max(1, len(bags))
    return loss


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_passages, top_passage): the score and the passage with the most attention."""

    def build():
        known = Lexicon()

        def row(doc_id, text):
            bag = passages(text, known)
            p, attention = model.score(bag)
            return doc_id, p, len(bag), int(attention.argmax())

        return row

    return map_rows(docs, ["doc_id", "text"], "doc_id long, score double, n_passages int, top_passage int", build)


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, with their own columns, whose score is at least `least`."""

    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches):
        known = Lexicon()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                good = [model.score(passages(t, known))[0] >= least for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
