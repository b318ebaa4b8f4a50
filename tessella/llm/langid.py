"""Language identification by error-correcting output codes.

Every learned language has a codeword of signs; one binary classifier per bit (logistic regression over hashed byte
n-grams of the whole text) predicts it. Decoding takes the codeword with the smallest loss, the sum over bits of the
logistic loss of the predicted margin weighted by the bit's reliability. A small gap to the runner-up flags ambiguity.

Defined results: `und`, score 0 and not ambiguous for null texts and texts without a letter; a single learned language
is predicted for everything else, and with none learned everything is `und`. Ties go to the first name in order. An empty
table gives an empty one; repeated rows are predicted each, and alike; texts are read whole, in slices; other columns,
whatever their names, are ignored by `predict` and kept by `accepted`. `accepted` drops what has no letter and, where a
model was learned, texts that are further from every codeword than a classifier that knows nothing would be.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.shipping import map_arrow, ship

BITS = 12
_LOWER = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
SLICE = 1 << 20


def ngram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed byte 2- and 3-grams (letters only, the rest one space) per text: len(texts) x 2^BITS."""
    dim = 1 << BITS
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        t = t.translate(_LOWER)
        for a in range(0, len(t), SLICE):  # slices overlap by two bytes, so that no n-gram is lost
            x = np.frombuffer(b" " * (a == 0) + t[max(0, a - 2) : a + SLICE] + b" " * (a + SLICE >= len(t)), np.uint8).astype(np.uint32)
            two = x[:-1] * np.uint32(256) + x[1:]
            three = two[:-1] * np.uint32(256) + x[2:]
            if a:
                two = two[1:]
            for g, salt in ((two, 2654435761), (three, 2246822519)):
                out[i] += np.bincount((g * np.uint32(salt)) >> np.uint32(32 - BITS), minlength=dim)
    return out


def scaled(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """Signs, k x bits: all dichotomies up to six languages, beyond that a random code of good minimum distance."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        cols = [c for r in range(1, k) for c in combinations(range(1, k), r)]
        code = np.ones((k, len(cols)))
        for j, c in enumerate(cols):
            code[list(c), j] = -1
        return code
    rng, n = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    tries = [rng.choice([-1.0, 1.0], (k, n)) for _ in range(50)]
    return max(tries, key=lambda c: -np.max(c @ c.T - 2 * n * np.eye(k)))


class Model:
    def __init__(self, names: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.names, self.code, self.weights, self.bias, self.trust = names, code, weights, bias, trust

    def losses(self, x: np.ndarray) -> np.ndarray:
        m = x @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -m * c) * self.trust).sum(1) for c in self.code], 1)

    def text_losses(self, texts: list[bytes]) -> np.ndarray:
        return np.concatenate([self.losses(scaled(ngram_counts(texts[a : a + 256]))) for a in range(0, len(texts), 256)])

    def near(self, texts: list[bytes]) -> np.ndarray:
        """Whether the nearest codeword is nearer than it would be if every bit's margin were zero."""
        return self.text_losses(texts).min(1) < np.log(2) * self.trust.sum()

    def predict(self, texts: list[bytes], gap: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, probability-like score, ambiguous."""
        loss = self.text_losses(texts)
        best = loss.argmin(1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        top = p.max(1)
        second = np.partition(p, -2, 1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, top, top - second < gap


def train(x: np.ndarray, y: np.ndarray, names: list[str], steps: int = 150, ridge: float = 1e-4) -> Model:
    """x: scaled n-grams; y: index of the language. Full-batch Adam on all bits at once, languages weighted alike."""
    code = codewords(len(names))
    target = code[y].astype(np.float32)
    n = np.bincount(y, minlength=len(names))
    weight = (1 / n[y] / len(names)).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for i in range(1, steps + 1):
        g = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * weight
        gw, gb = x.T @ g + ridge * w, g.sum(0)
        for p, gr, m, v in ((w, gw, mw, vw), (b, gb, mb, vb)):
            m *= 0.9
            m += 0.1 * gr
            v *= 0.99
            v += 0.01 * gr * gr
            p -= 0.5 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    right = ((np.sign(x @ w + b) == target) * weight).sum(0)
    return Model(names, code, w, b, right / right.sum() * len(right))


def fit(docs: DataFrame, per_language: int = 400, most_languages: int = 64) -> Model | None:
    """Learn from about per_language rows of each language (by a hash of doc_id and text), none with crc32(doc_id) mod 4 = 2.
    At most the most_languages values of lang with the most rows are learned, which bounds what the driver holds."""
    usable = F.col("lang").isNotNull() & (F.col("lang") != "und") & F.col("text").isNotNull() & (common.fold("doc_id", 4) != 2)
    known = docs.where(F.coalesce(usable, F.lit(False))).select("doc_id", "text", "lang")
    n = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not n:
        return None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in common.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), pa.array([r.tobytes() for r in scaled(ngram_counts(texts))], pa.binary())], ["lang", "x"])

    got = common.thin(known, F.xxhash64("doc_id", "text"), n, per_language, F.col("lang")).select("lang", "text").transform(map_arrow, measure, "lang string, x binary").toArrow()
    lang = got.column("lang").to_pylist()
    names = sorted(set(lang))
    if not names:
        return None
    x = np.stack([np.frombuffer(v, np.float32) for v in got.column("x").to_pylist()])
    return train(x, np.array([names.index(v) for v in lang]), names)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in common.slices(batch, "text"):
                letters = [any(map(str.isalpha, t.decode())) for t in texts]
                names, scores, unclear = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if model is not None:
                    best, score, unsure = model.predict(texts)
                    names = [model.names[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
                    scores, unclear = np.where(letters, score, 0.0), unsure & np.array(letters)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(names, pa.string()), pa.array(scores), pa.array(unclear)], ["doc_id", "lang_pred", "score", "ambiguous"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns, that hold a letter and whose nearest codeword is near enough (see above)."""
    ship(docs.sparkSession)

    @F.arrow_udf("boolean")
    def known(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        out: list[bool] = []
        for _, _, texts in common.slices(batch, "text"):
            letters = np.array([any(map(str.isalpha, t.decode())) for t in texts])
            out += (letters if model is None else letters & model.near(texts)).tolist()
        return pa.array(out, pa.bool_())

    return docs.where(known(F.col("text")))
