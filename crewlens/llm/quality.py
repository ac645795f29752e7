"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Random indexing gives every token a sparse ternary index vector, drawn from its hash; a token's context vector
is the sum of the index vectors of its neighbours, summed over the training sample by Spark and normalised.
There are two streams of tokens: words, lower-cased A-Z, and their shapes (runs of letters, digits and each
other character collapsed, with a mark where a word repeats the one before).  Tokens share ``ROWS`` hashed
rows in each stream, so the table has a fixed size.  A document is the mean of its tokens' context vectors;
a network with one hidden layer, trained in numpy, gives the logit, and a temperature fitted on a part of the
sample that was kept back makes it a probability.

The sample is bounded by ``max_labelled`` rows, chosen by hash.  Defined cases: null and empty texts have the
zero vector; without labels of both classes every score is 0.5; an empty table gives an empty result; repeated rows score
alike; very long texts are pooled whole, a piece at a time; labels, lang, source and doc_id are no input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import MAX_LABELLED, labelled_sample
from .texts import id_and_text, mix64, one_array, repeats, slices, split_words, string_hashes, word_codes

ROWS = 4096
DIM = 32
REACH = 2
HIDDEN = 24
EPOCHS = 60
PIECE_WORDS = 1 << 16
REPEAT = np.uint64(0x5BD1E995)


def token_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each word in the two streams, shape (words, 2), and the texts' offsets."""
    flat, offsets = split_words(texts)
    codes, words = word_codes(flat)
    if not len(words):
        return np.zeros((0, 2), np.int64), offsets
    shape = words
    for pattern, to in ((r"[\p{Lu}]+", "A"), (r"[\p{L}\p{M}]+", "a"), (r"[0-9]+", "0"), (r"!+", "!"), (r"#+", "#"), (r"\*+", "*"), (r"\$+", "$"), (r"%+", "%"), (r"&+", "&")):
        shape = pc.replace_substring_regex(shape, pattern, to)
    shapes = string_hashes(shape)[codes]
    shapes[repeats(codes, offsets)] ^= REPEAT
    lower = string_hashes(pc.ascii_lower(words))[codes]
    return np.stack([mix64(shapes) % np.uint64(ROWS), lower % np.uint64(ROWS)], axis=1).astype(np.int64), offsets


def index_vectors() -> np.ndarray:
    """Four of ``DIM`` places of each row are plus or minus one."""
    out = np.zeros((2 * ROWS, DIM), np.float32)
    for k in range(4):
        h = mix64(np.arange(2 * ROWS, dtype=np.uint64) * np.uint64(8) + np.uint64(k + 1))
        np.add.at(out, (np.arange(2 * ROWS), (h % np.uint64(DIM)).astype(np.int64)), np.where(h >> np.uint64(63), 1, -1))
    return out


def _context(rows: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Summed index vectors of the neighbours within ``REACH`` words of the same text, by row."""
    out = np.zeros((2 * ROWS, DIM))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for stream in range(2):
        r = rows[:, stream]
        for lag in range(1, REACH + 1):
            same = doc[lag:] == doc[:-lag]
            pairs, n = np.unique((r[lag:] * ROWS + r[:-lag])[same], return_counts=True)
            a, b = pairs // ROWS + stream * ROWS, pairs % ROWS + stream * ROWS
            np.add.at(out, a, index[b] * n[:, None])
            np.add.at(out, b, index[a] * n[:, None])
    return out


@dataclass
class Model:
    vectors: np.ndarray
    layers: list[np.ndarray] | None = None
    temperature: float = 1.0

    def pooled(self, texts: pa.Array) -> np.ndarray:
        rows, offsets = token_rows(texts)
        out = np.zeros((len(offsets) - 1, 2 * DIM), np.float32)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for a in range(0, len(rows), PIECE_WORDS):
            own, at = doc[a : a + PIECE_WORDS], np.flatnonzero(np.diff(doc[a : a + PIECE_WORDS], prepend=-1))
            for stream in range(2):
                some = self.vectors[rows[a : a + PIECE_WORDS, stream] + stream * ROWS]
                out[own[at], stream * DIM : (stream + 1) * DIM] += np.add.reduceat(some, at, axis=0)
        return out / np.maximum(np.diff(offsets), 1)[:, None].astype(np.float32)

    def logit(self, x: np.ndarray) -> np.ndarray:
        mean, spread, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / spread @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def _train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Adam on the cross-entropy of a network with one hidden layer, classes weighted alike by the square root."""
    rng = np.random.default_rng(seed)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / spread
    w = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    share = np.array([max((y == c).mean(), 1e-6) for c in (0, 1)])
    weight = (0.5 / share[y.astype(int)]) ** 0.5
    for _ in range(EPOCHS):
        for i in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
            h = np.tanh(z[i] @ w[0] + w[1])
            out = h @ w[2] + w[3][0]
            d = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[i]) * weight[i] / len(i)
            dh = np.outer(d, w[2]) * (1 - h**2)
            grads = [z[i].T @ dh + 1e-5 * w[0], dh.sum(0), h.T @ d + 1e-5 * w[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= 0.005 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return [mean, spread, w[0], w[1], w[2], w[3]]


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, max_labelled: int = MAX_LABELLED) -> Model | None:
    """A model from the labelled rows outside the held-out fold, or None without both classes."""
    sample = labelled_sample(docs, labels, "quality", held_out, max_labelled)
    index = index_vectors()

    def contexts(batches):
        total = np.zeros((2 * ROWS, DIM))
        for batch in slices(batches):
            total += _context(*token_rows(one_array(batch.column("text"))), index)
        at = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), *[pa.array(total[at, k]) for k in range(DIM)]], ["r", *[f"v{k}" for k in range(DIM)]]
        )

    names = [f"v{k}" for k in range(DIM)]
    summed = sample.mapInArrow(contexts, "r long, " + ", ".join(f"{x} double" for x in names))
    table = summed.groupBy("r").agg(*[F.sum(x).alias(x) for x in names]).toPandas()  # at most 2 * ROWS rows
    vectors = np.zeros((2 * ROWS, DIM), np.float32)
    vectors[table["r"].to_numpy(int)] = table[names].to_numpy(float)
    vectors += index  # a token without neighbours still counts
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    model = Model(vectors)

    def pooled(batches):
        for batch in slices(batches):
            x = model.pooled(one_array(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "y", "x"]
            )

    rows = sample.mapInArrow(pooled, "doc_id long, y int, x array<float>").orderBy("doc_id").toPandas()  # bounded by the sample
    y = (rows["y"].to_numpy(int) > 0).astype(float)
    if len(set(y.tolist())) < 2:
        return None
    x = np.stack(rows["x"].to_numpy()).astype(float)
    back = np.arange(len(y)) % 5 == 4
    model.layers = _train(x[~back], y[~back])
    if back.any():
        z = model.logit(x[back])
        grid = np.exp(np.linspace(np.log(0.5), np.log(5), 40))
        loss = [np.logaddexp(0, np.where(y[back] > 0, -z, z) / t).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _score(model: Model | None, texts: pa.Array) -> np.ndarray:
    return np.full(len(texts), 0.5) if model is None else model.probability(model.pooled(texts).astype(float))


def quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for each row of documents."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(_score(model, one_array(batch.column("text"))))], ["doc_id", "score"]
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is at least ``least``; no rows move."""
    names = docs.columns

    def run(batches):
        for batch in slices(batches):
            keep = _score(model, one_array(batch.column("text"))) >= least
            yield batch.filter(pa.array(keep))

    return docs.select(*[docs[x] for x in names]).mapInArrow(run, docs.schema)
