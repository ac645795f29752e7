"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Training: on three quarters of a bounded sample of labelled rows (``max_labelled``) tokens are counted by class,
once a document.  A token's log-odds have an informative Dirichlet prior whose mean is that of the tokens with the
same beginning, and that beginning's prior is the corpus; no class has less than ``SMOOTH`` of a count, so tokens
that one class never has keep a finite interval.  The lower end of the interval is a token's score if it is at
least ``LEAST``, else, and where it repeats the token before, a constant below zero.  All tokens and beginnings with a
positive score are kept; their number is bounded by the sample.  The last quarter, whose tokens were not counted,
calibrates; where it lacks one of the classes, the whole sample does both.  Scoring: a linear scan finds all maximal scoring
segments (cumulative sums that never fall below their start or rise above their end).  A segment's expected number by chance in a
text of n tokens is K n exp(-lambda S), with lambda the positive root of sum p(s) exp(lambda s) = 1 over scores of clean
calibration tokens, and K such that the clean calibration texts have as many segments of at least their median score as
expected; passages expected at most ``MAX_EXPECTED`` times are significant.  A logistic curve over the best segment's surprise
and that of the best r together, for the most telling r, gives the probability.

Tokens are the runs of letters, digits and other characters above ASCII inside words, lower-cased A-Z.

Defined cases: null and empty texts have no tokens and get the score of a text without a segment; without
labels of both classes every score is 0; an empty table gives an empty result.  Repeated rows score alike; very long texts are
scanned whole; labels, lang, source and doc_id are no input.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import MAX_LABELLED, labelled_sample, logistic
from .texts import id_and_text, one_array, repeats, slices, split_words, string_hashes, word_codes

STEM = 5
PRIOR = 2.0
SMOOTH = 0.25
BELOW = 1.0
MAX_EXPECTED = 0.05
LEAST = 1.0
EDGES = "[!-/:-@\\[-`{-~]+"


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes into distinct tokens, the tokens, and the texts' offsets; edge punctuation is cut off."""
    flat, offsets = split_words(texts, lower=True)
    codes, words = word_codes(flat)
    bare = pc.replace_substring_regex(words, EDGES, "")
    again, distinct = word_codes(bare) if len(words) else (codes, words)
    return again[codes] if len(codes) else codes, distinct, offsets


def _stems(words: pa.Array) -> pa.Array:
    return pc.utf8_slice_codeunits(words, 0, STEM)


@dataclass
class Model:
    token: np.ndarray
    token_score: np.ndarray
    stem: np.ndarray
    stem_score: np.ndarray
    scale: float
    k: float
    curve: np.ndarray

    def token_scores(self, words: pa.Array) -> np.ndarray:
        out = np.full(len(words), -BELOW)
        for keys, values, hashes in (
            (self.stem, self.stem_score, string_hashes(_stems(words))),
            (self.token, self.token_score, string_hashes(words)),
        ):
            if len(keys) and len(hashes):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                out[hit] = values[at[hit]]
        return out

    def segments(self, texts: pa.Array) -> list[list[tuple[int, int, float]]]:
        """Of each text all maximal segments: first token, token after the last, score."""
        codes, words, offsets = tokens(texts)
        score = self.token_scores(words)[codes] if len(words) else np.zeros(0)
        score[repeats(codes, offsets)] = -BELOW
        positive = np.flatnonzero(score > 0)
        found: list[list[tuple[int, int, float]]] = [[] for _ in range(len(offsets) - 1)]
        sums = np.concatenate([[0.0], np.cumsum(score)])
        owner = np.searchsorted(offsets, positive, side="right") - 1
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for some in np.split(positive, cuts) if len(positive) else ():
            doc = int(np.searchsorted(offsets, some[0], side="right") - 1)
            a, b = int(offsets[doc]), int(offsets[doc + 1])
            for i, j, s in maximal_segments(some, sums):
                found[doc].append((i - a, j - a, s))
        return found

    def surprise(self, score: float, length: int) -> float:
        """Minus the logarithm of the number of such segments expected by chance."""
        return self.scale * score - float(np.log(self.k * max(length, 1)))

    def features(self, segments: list[tuple[int, int, float]], length: int) -> tuple[float, float]:
        """Surprise of the best segment, and of the best r segments together for the most telling r."""
        each = sorted((self.surprise(s, length) for _, _, s in segments), reverse=True)
        together, total = 0.0, 0.0
        for r, x in enumerate(each, 1):
            total += x
            if total > 0:  # sum statistics of the r best: exp(-t) t^(r-1) / (r! (r-1)!)
                together = max(together, total - (r - 1) * log(total) + lgamma(r + 1) + lgamma(r))
        return float(np.clip(each[0] if each else 0.0, 0, 20)), float(min(together, 40.0))

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve[:-1] + self.curve[-1], -30, 30)))


def maximal_segments(positive: np.ndarray, sums: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in linear time, from the places of positive scores and all partial sums.

    Each stacked segment knows the nearest one below it that begins at a smaller sum, so the ones between are never looked at again.
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []  # the sum before a segment
    high: list[float] = []  # and after it
    below: list[int] = []
    for p in positive.tolist():
        a, b, lo, hi, k = p, p + 1, float(sums[p]), float(sums[p + 1]), len(low) - 1
        while True:
            while k >= 0 and low[k] >= lo:
                k = below[k]
            if k < 0 or high[k] >= hi:
                break
            a, lo, under = first[k], low[k], below[k]
            for column in (first, last, low, high, below):
                del column[k:]
            k = under
        for column, value in ((first, a), (last, b), (low, lo), (high, hi), (below, k)):
            column.append(value)
    return [(i, j, y - x) for i, j, x, y in zip(first, last, low, high, strict=True)]


def _scores(counts: np.ndarray, mean: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The lower end of a 95 % interval of log-odds; counts and prior means by class."""
    c = counts + PRIOR * mean + SMOOTH
    rest = total - counts + PRIOR * (1 - mean) + SMOOTH
    odds = np.log(c / rest)
    return odds[:, 1] - odds[:, 0] - 1.64 * np.sqrt(1 / c[:, 0] + 1 / c[:, 1])


def _best(words: list[str], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    good = np.flatnonzero(scores > LEAST)
    hashes = string_hashes(pa.array([words[i] for i in good], pa.string()))
    order = np.argsort(hashes)
    return hashes[order], scores[good][order]


def _counted(sample: DataFrame) -> DataFrame:
    """(stem, w, n0, n1): labelled texts of each class that hold a token, and that hold a beginning (``stem``)."""

    def run(batches):
        for batch in slices(batches):
            codes, words, offsets = tokens(one_array(batch.column("text")))
            y = np.asarray(batch.column("y"), dtype=np.int64) > 0
            doc = np.repeat(np.arange(len(y)), np.diff(offsets))
            of_stem, stems = word_codes(_stems(words)) if len(words) else (codes, words)
            for kind, names, own in ((False, words, codes), (True, stems, of_stem[codes] if len(words) else codes)):
                n = max(len(names), 1)
                pairs = np.unique(doc * n + own)
                got = np.bincount(pairs % n * 2 + y[pairs // n], minlength=2 * len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(names), pa.bool_()), names, pa.array(got[0::2]), pa.array(got[1::2])], ["stem", "w", "n0", "n1"]
                )

    counts = sample.mapInArrow(run, "stem boolean, w string, n0 long, n1 long")
    return counts.groupBy("stem", "w").sum("n0", "n1").toDF("stem", "w", "n0", "n1")


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, max_labelled: int = MAX_LABELLED) -> Model | None:
    """A model from the labelled rows outside the held-out fold, or None without both classes."""
    sample = labelled_sample(docs, labels, "toxic", held_out, max_labelled)
    kept_back = F.pmod(F.crc32(F.concat(F.lit("back"), F.col("doc_id")).cast("binary")), F.lit(4)) == 0
    sample = sample.withColumn("back", kept_back)
    total, back = np.zeros(2), np.zeros(2)
    for r in sample.groupBy("y", "back").agg(F.count(F.lit(1)).alias("n")).collect():
        (back if r["back"] else total)[int(r["y"] > 0)] += r["n"]
    if not (total + back).all():
        return None
    counted, calibrating = sample.filter("not back"), sample.filter("back")
    if not (back.all() and total.all()):
        counted, calibrating, total = sample, sample, total + back
    table = _counted(counted.select("text", "y")).filter("n1 >= 2 and w <> ''").orderBy("w").toPandas()  # bounded by the sample
    words, stems = (table[table["stem"] == kind] for kind in (False, True))
    by_stem = stems[["n0", "n1"]].to_numpy(float)
    base = np.tile(np.clip(by_stem.sum(1) / total.sum(), 1e-4, 0.5)[:, None], (1, 2))
    prior = np.clip((by_stem + PRIOR * base) / (total + PRIOR), 1e-4, 0.9)
    place = {w: k for k, w in enumerate(stems["w"])}
    own = np.array([place[w[:STEM]] for w in words["w"]], np.int64)
    token, token_score = _best(words["w"].tolist(), _scores(words[["n0", "n1"]].to_numpy(float), prior[own], total))
    whole = np.array([len(w) == STEM for w in stems["w"]], bool)
    stem, stem_score = _best(stems["w"].tolist(), np.where(whole, _scores(by_stem, base, total), -1))
    model = Model(token, token_score, stem, stem_score, 1.0, 1.0, np.zeros(3))

    def histogram(batches):
        for batch in slices(batches):
            codes, words, offsets = tokens(one_array(batch.column("text")))
            clean = np.repeat(np.asarray(batch.column("y")) == 0, np.diff(offsets))
            s = np.round(model.token_scores(words)[codes][clean], 1) if len(words) else np.zeros(0)
            v, n = np.unique(s, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64()), pa.array(n.astype(np.int64))], ["s", "n"])

    seen = calibrating.select("text", "y").mapInArrow(histogram, "s double, n long").groupBy("s").sum("n").toDF("s", "n").toPandas()
    model.scale = root(seen["s"].to_numpy(float), seen["n"].to_numpy(float))
    clean = calibrating.filter("y = 0").select("text").mapInArrow(_segment_scores(model), "s double, n long").toPandas()
    model.k = chance_factor(clean["s"].dropna().to_numpy(float), float(clean["n"].sum()), model.scale)
    rows = calibrating.select("text", "y").mapInArrow(_features(model), "best double, summed double, y int").toPandas()
    model.curve = logistic(rows[["best", "summed"]].to_numpy(float), (rows["y"] > 0).to_numpy(float))
    return model


def root(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p(s) exp(x s) = 1; at most 5, which it is if no score is positive."""
    p = counts / max(counts.sum(), 1)
    low, high = 1e-6, 5.0
    with np.errstate(over="ignore"):
        if (p * np.exp(high * scores)).sum() < 1:
            return high
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return low


def chance_factor(scores: np.ndarray, length: float, scale: float) -> float:
    """K, by the segments of at least the median score in clean texts of so many tokens; 1 if there are none."""
    if not len(scores):
        return 1.0
    least = float(np.median(scores))
    return float((scores >= least).sum() * np.exp(min(scale * least, 50.0)) / max(length, 1.0))


def _segment_scores(model: Model):
    """Scores of the maximal segments of texts, and in rows without a score the texts' tokens."""

    def run(batches):
        for batch in slices(batches):
            texts = one_array(batch.column("text"))
            s = [x for found in model.segments(texts) for _, _, x in found]
            n = int(split_words(texts)[1][-1])
            yield pa.RecordBatch.from_arrays([pa.array([*s, None], pa.float64()), pa.array([0] * len(s) + [n], pa.int64())], ["s", "n"])

    return run


def _features(model: Model):
    def run(batches):
        for batch in slices(batches):
            texts = one_array(batch.column("text"))
            length = np.diff(split_words(texts)[1])
            f = np.array([model.features(s, int(n)) for s, n in zip(model.segments(texts), length, strict=True)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), batch.column("y")], ["best", "summed", "y"])

    return run


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, passages) for each row of documents; passages are (start, end, score) in tokens."""
    schema = "doc_id long, score double, passages array<struct<start:int,end:int,score:double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in slices(batches):
            texts = one_array(batch.column("text"))
            found: list = [[] for _ in range(len(texts))]
            score, length = np.zeros(len(texts)), np.diff(split_words(texts)[1])
            if model is not None:
                found = model.segments(texts)
                score = model.probability(np.array([model.features(s, int(n)) for s, n in zip(found, length, strict=True)]).reshape(-1, 2))
            named = [
                [{"start": a, "end": b, "score": s} for a, b, s in x if model.surprise(s, int(n)) >= -np.log(MAX_EXPECTED)]
                for x, n in zip(found, length, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array(named, kind)], ["doc_id", "score", "passages"]
            )

    return id_and_text(docs).mapInArrow(run, schema)
