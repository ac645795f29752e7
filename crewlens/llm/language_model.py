"""LM scoring: exact token counts over the whole corpus, and a log-bilinear model whose vocabulary follows the corpus.

Counts: tasks count the tokens of training documents by hash, Spark adds them up.  Tokens that are more than one in ``COMMON``
of all tokens are fewer than ``COMMON``, so their table is broadcast; the others are looked up by a join of what documents hold
of them, in which no key is hot.

Model: the most frequent tokens, as many as the root of the number of training tokens (``leaves``), are predicted by name, all
others as one of ``tails`` groups by a hash of their last two bytes.  Leaves and tails, in order of frequency, lie in classes of about
the root of their number.  A log-bilinear network predicts from the two tokens before (position-wise weights times
their vectors, summed) a token's class, and the token within the class, each as products with output vectors plus a
bias.  Both parts are trained by noise-contrastive estimation on all training positions.  A start is trained on the driver, on positions drawn by
hash, ``DRAWS`` of them and ``DRAWS_A_LEAF`` for each leaf.  From there ``shards`` tasks go on side by side, each over the other positions of
the documents that a hash deals to it, in the order of that hash; then Spark averages each row of the weights over the tasks, by how often they
moved it.  So every position is learned from, and neither files nor cores change the model.  Scoring normalises both parts with batched matrix products over the
distinct contexts of a batch.

P(token | context) = (1 - p0) P(class | context) P(leaf | class, context), for a leaf of a tail times p(token) / sum of p over the
tail, with p the additive estimate of the contract and p0 the share it leaves for unknown tokens; an unknown token has p0.

Defined cases: null and empty texts are the end token alone; without training tokens every token has the same share and the
model is that of the counts; repeated rows score alike and are counted as often as they occur; very long texts are scored
whole; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .texts import id_and_text, mix64, one_array, raw, slices, split_words, string_hashes, word_codes, xxh64

ADD = 0.1
COMMON = 1 << 20
DRAWS = 1 << 19
DRAWS_A_LEAF = 64
DIM = 24
NOISE = 64
NOISE_IN_CLASS = 6
#: Of tasks that go on: positions of one, at least, and how many there are, at most; positions at a time and of a step; rows of weights sent as one.
SHARD, MOST_SHARDS = 1 << 22, 256
HELD, STEP, BLOCK = 1 << 18, 1 << 13, 256
TAIL_HASHES = 1 << 16
END = "\n"  # no word holds a line break
END_HASH = string_hashes(pa.array([END]))[0]


def _tail_hash(words: pa.Array) -> np.ndarray:
    """A hash of the last two bytes, below ``TAIL_HASHES``."""
    data, start, length = raw(words)
    short = np.minimum(length, 2)
    return (xxh64(data, start + length - short, short, 3) % np.uint64(TAIL_HASHES)).astype(np.int64)


class _Tokens:
    """A batch's tokens with an end after each text: codes into distinct tokens, their hashes, and where texts begin."""

    def __init__(self, texts: pa.Array):
        flat, offsets = split_words(texts, lower=True)
        codes, words = word_codes(flat)
        some = len(words) > 0
        self.hashes = np.concatenate([string_hashes(words) if some else np.zeros(0, np.uint64), [END_HASH]])
        self.tails = np.concatenate([_tail_hash(words) if some else np.zeros(0, np.int64), [0]])
        n = len(offsets) - 1
        self.offsets = offsets + np.arange(n + 1)
        self.codes = np.full(len(codes) + n, len(words), np.int64)
        last = np.zeros(len(self.codes), bool)
        last[self.offsets[1:] - 1] = True
        self.codes[~last] = codes

    def of_rows(self, rows: np.ndarray) -> np.ndarray:
        """A value of each text, for each of its tokens."""
        return np.repeat(rows, np.diff(self.offsets))

    def contexts(self, leaves: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token the leaf two before, the leaf one before, and its own; ``none`` stands before a text."""
        own = leaves[self.codes]
        place = np.arange(len(own)) - self.of_rows(self.offsets[:-1])
        return np.where(place >= 2, np.roll(own, 2), none), np.where(place >= 1, np.roll(own, 1), none), own


@dataclass
class Corpus:
    """Sums over the training tokens: their number, the distinct ones, the common ones' counts, leaves and shares."""

    total: int
    distinct: int
    known: np.ndarray  # hashes of common tokens, sorted
    counts: np.ndarray
    leaf: np.ndarray  # of each common token, or -1
    leaves: int
    tails: int
    share: np.ndarray  # p of each leaf, of tails that of all their tokens

    @property
    def below(self) -> float:
        return self.total + ADD * (self.distinct + 1)

    @property
    def names(self) -> int:
        return self.leaves + self.tails

    def look_up(self, t: _Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct tokens the counts, -1 where they are not among the common ones, and the leaves."""
        count, leaf = np.full(len(t.hashes), -1, np.int64), self.leaves + t.tails % max(self.tails, 1)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, t.hashes), len(self.known) - 1)
            hit = self.known[at] == t.hashes
            count[hit] = self.counts[at[hit]]
            named = hit & (self.leaf[at] >= 0)
            leaf[named] = self.leaf[at[named]]
        return count, leaf


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, tail, n) of each distinct token of the training documents (``held`` is false)."""

    def run(batches):
        for batch in slices(batches):
            t = _Tokens(one_array(batch.column("text")))
            n = np.bincount(t.codes[~t.of_rows(np.asarray(batch.column("held"), dtype=bool))], minlength=len(t.hashes))
            at = np.flatnonzero(n)
            cols = [pa.array(t.hashes[at].view(np.int64)), pa.array(t.tails[at].astype(np.int32)), pa.array(n[at])]
            yield pa.RecordBatch.from_arrays(cols, ["h", "tail", "n"])

    each = docs.select("text", "held").mapInArrow(run, "h long, tail int, n long")
    return each.groupBy("h").agg(F.any_value("tail").alias("tail"), F.sum("n").alias("n"))


def summed(counts: DataFrame, common: int = COMMON) -> Corpus:
    """The corpus' sums; what reaches the driver is less than ``common`` tokens and ``TAIL_HASHES`` groups."""
    total, distinct = (int(x) for x in counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first())
    found = counts.filter(F.col("n") > total // common).orderBy(F.desc("n"), "h").toArrow()
    h, tail, n = (np.asarray(found.column(x)) for x in ("h", "tail", "n"))
    leaves = min(len(h), int(np.ceil(total**0.5)))
    tails = int(np.ceil(leaves**0.5))
    groups = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()
    group, sums, tokens = (np.asarray(groups.column(x), dtype=np.int64) for x in ("tail", "n", "v"))
    held = np.zeros((2, leaves + tails))
    held[0, :leaves], held[1, :leaves] = n[:leaves], 1
    if tails:
        for row, all_, named in ((0, sums, n[:leaves]), (1, tokens, np.ones(leaves))):
            held[row, leaves:] = np.bincount(group % tails, all_, tails) - np.bincount(tail[:leaves] % tails, named, tails)
    order = np.argsort(h.view(np.uint64))
    rank = np.where(np.arange(len(h)) < leaves, np.arange(len(h)), -1)
    below = total + ADD * (distinct + 1)
    return Corpus(total, distinct, h.view(np.uint64)[order], n[order], rank[order], leaves, tails, (held[0] + ADD * held[1]) / below)


def _bound(rate: float) -> np.uint64:
    return np.uint64(min(int(rate * 2.0**64), (1 << 64) - 1))


def _position_hashes(seed: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each token of texts with these seeds; positions up to a bound are drawn."""
    size = np.diff(offsets)
    with np.errstate(over="ignore"):
        return mix64(np.repeat(seed, size) + np.arange(size.sum()).astype(np.uint64) - np.repeat(offsets[:-1], size).astype(np.uint64))


def drawn(docs: DataFrame, corpus, names: int, rate: float) -> np.ndarray:
    """(two before, one before, leaf) at a share ``rate`` of the training positions, chosen by hash of text and place."""
    bound = _bound(rate)

    def run(batches):
        for batch in slices(batches):
            t = _Tokens(one_array(batch.column("text")))
            two, one, own = t.contexts(corpus.value.look_up(t)[1], names)
            h = _position_hashes(string_hashes(one_array(batch.column("text")), 5), t.offsets)
            at = np.flatnonzero((h <= bound) & ~t.of_rows(np.asarray(batch.column("held"), dtype=bool)))
            code = (two[at] * (names + 1) + one[at]) * names + own[at]
            yield pa.RecordBatch.from_arrays([pa.array(code)], ["code"])

    code = np.sort(np.asarray(docs.select("text", "held").mapInArrow(run, "code long").toArrow().column("code"), dtype=np.int64))
    return np.stack([code // names // (names + 1), code // names % (names + 1), code % names])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Vectors of contexts, classes and leaves; leaf k is in class k // ``width``."""

    def __init__(self, share: np.ndarray, seed: int = 11):
        rng, n = np.random.default_rng(seed), len(share)
        self.width = int(np.ceil(n**0.5))
        self.classes = -(-n // self.width)
        self.share = np.maximum(share, 1e-12) / np.maximum(share, 1e-12).sum()
        self.class_share = np.add.reduceat(self.share, np.arange(0, n, self.width))
        normal = lambda *size: rng.normal(0, 0.1, size).astype(np.float32)
        self.w = {
            "in": normal(n + 1, DIM),
            "near": np.full((2, DIM), 0.5, np.float32),
            "class": normal(self.classes, DIM),
            "class_bias": np.log(self.class_share).astype(np.float32)[:, None],
            "leaf": normal(n, DIM),
            "leaf_bias": np.log(self.share / np.repeat(self.class_share, self.width)[:n]).astype(np.float32)[:, None],
        }

    def hidden(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        return self.w["in"][two] * self.w["near"][0] + self.w["in"][one] * self.w["near"][1]

    def train(self, drawn: np.ndarray, epochs: int = 2, batch: int = 512, seed: int = 12, rate: float = 0.2) -> Network:
        """Noise-contrastive estimation with Adagrad; noise follows the shares of classes, and of leaves in the class."""
        rng, w, n = np.random.default_rng(seed), self.w, len(self.share)
        grown = {k: np.full_like(v, 1e-3) for k, v in w.items()}
        ends = np.cumsum(self.share)
        start = np.concatenate([[0.0], ends])[np.arange(self.classes) * self.width]

        def step(name: str, at: np.ndarray, grad: np.ndarray) -> None:
            order = np.argsort(at, kind="stable")
            rows, first = np.unique(at[order], return_index=True)
            g = np.add.reduceat(grad[order], first, axis=0)
            grown[name][rows] += g * g
            w[name][rows] -= rate * g / np.sqrt(grown[name][rows])

        for i in (i for _ in range(epochs) for i in np.array_split(rng.permutation(drawn.shape[1]), max(1, drawn.shape[1] // batch))):
            two, one, leaf = drawn[:, i]
            own = leaf // self.width
            h = self.hidden(two, one)
            k = rng.choice(self.classes, NOISE, p=self.class_share)
            true = (h * w["class"][own]).sum(1) + w["class_bias"][own, 0] - np.log(NOISE * self.class_share[own])
            false = h @ w["class"][k].T + w["class_bias"][k, 0] - np.log(NOISE * self.class_share[k])
            dt, df = (_sigmoid(true) - 1).astype(np.float32) / len(i), _sigmoid(false).astype(np.float32) / len(i)
            # leaves: noise from the token's own class
            at = start[own][:, None] + rng.random((len(i), NOISE_IN_CLASS)) * self.class_share[own][:, None]
            low = own[:, None] * self.width
            other = np.clip(np.searchsorted(ends, at, side="right"), low, np.minimum(low + self.width, n) - 1)
            both = np.concatenate([leaf[:, None], other], axis=1)
            inside = self.share[both] / self.class_share[own][:, None]
            score = np.einsum("bd,bkd->bk", h, w["leaf"][both]) + w["leaf_bias"][both, 0] - np.log(NOISE_IN_CLASS * inside)
            dl = _sigmoid(score).astype(np.float32) / len(i)
            dl[:, 0] -= np.float32(1 / len(i))
            dh = dt[:, None] * w["class"][own] + df @ w["class"][k] + np.einsum("bk,bkd->bd", dl, w["leaf"][both])
            ones = np.ones((len(i), 1), np.float32)
            at_class, near = np.concatenate([own, k]), w["near"].copy()
            step("class", at_class, np.concatenate([dt[:, None] * h, df.T @ h]))
            step("class_bias", at_class, np.concatenate([dt, df.sum(0)])[:, None])
            step("leaf", both.ravel(), (dl[:, :, None] * h[:, None, :]).reshape(-1, DIM))
            step("leaf_bias", both.ravel(), dl.reshape(-1, 1) * np.repeat(ones, both.shape[1], axis=0))
            g = np.stack([(dh * w["in"][two]).sum(0), (dh * w["in"][one]).sum(0)])
            step("in", np.concatenate([two, one]), np.concatenate([dh * near[0], dh * near[1]]))
            step("near", np.arange(2), g)
        self.grown, self.seen = grown, drawn.shape[1]
        return self

    def go_on(self, parts, seed: int, rate: float = 0.2) -> dict[str, np.ndarray]:
        """Trains further on ``parts``, arrays (two before, one before, leaf) of one step each; returns how often each row moved.

        Noise of classes is that of a step, noise in a class that of its tokens of a step.
        """
        rng, w, n = np.random.default_rng(seed), self.w, len(self.share)
        moved = {k: np.zeros(len(v), np.float32) for k, v in w.items()}
        ends = np.cumsum(self.share)
        start = np.concatenate([[0.0], ends])[np.arange(self.classes) * self.width]
        class_ends, log_class = np.cumsum(self.class_share), np.log(NOISE * self.class_share).astype(np.float32)
        low = np.arange(self.classes)[:, None] * self.width
        log_in = np.log(NOISE * self.share / np.repeat(self.class_share, self.width)[:n]).astype(np.float32)

        def step(name: str, rows: np.ndarray, g: np.ndarray) -> None:
            self.grown[name][rows] += g * g
            w[name][rows] -= rate * g / np.sqrt(self.grown[name][rows])
            moved[name][rows] += 1

        def summed_by(at: np.ndarray, *grads: np.ndarray):
            order = np.argsort(at, kind="stable")
            rows = at[order]
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            return rows[first], *(np.add.reduceat(g[order], first, axis=0) for g in grads)

        for two, one, leaf in parts:
            order = np.argsort(leaf, kind="stable")
            two, one, leaf = two[order], one[order], leaf[order]
            own, unit = leaf // self.width, np.float32(1 / 512)  # a row that moves once moves as far as in a batch of ``train``
            a, b, near = w["in"][two], w["in"][one], w["near"].copy()
            h = a * near[0] + b * near[1]
            k = np.minimum(np.searchsorted(class_ends, rng.random(NOISE) * class_ends[-1], side="right"), self.classes - 1)
            v = w["class"][own]
            dt = (_sigmoid(np.einsum("bd,bd->b", h, v) + w["class_bias"][own, 0] - log_class[own]) - 1)[:, None] * unit
            df = _sigmoid(h @ w["class"][k].T + (w["class_bias"][k, 0] - log_class[k])) * unit
            dh = dt * v + df @ w["class"][k]
            v = w["leaf"][leaf]
            dl = (_sigmoid(np.einsum("bd,bd->b", h, v) + w["leaf_bias"][leaf, 0] - log_in[leaf]) - 1)[:, None] * unit
            dh += dl * v
            noise = np.searchsorted(ends, start[:, None] + rng.random((self.classes, NOISE)) * self.class_share[:, None], side="right")
            noise = np.clip(noise, low, np.minimum(low + self.width, n) - 1)
            cuts = np.searchsorted(own, np.arange(self.classes + 1))
            some = np.flatnonzero(np.diff(cuts))
            false, false_bias = np.empty((len(some), NOISE, DIM), np.float32), np.empty((len(some), NOISE), np.float32)
            for i, c in enumerate(some.tolist()):
                s, x = slice(int(cuts[c]), int(cuts[c + 1])), noise[c]
                e = _sigmoid(h[s] @ w["leaf"][x].T + (w["leaf_bias"][x, 0] - log_in[x])) * unit
                dh[s] += e @ w["leaf"][x]
                false[i], false_bias[i] = e.T @ h[s], e.sum(0)
            at, g, g_bias = summed_by(np.concatenate([own, k]), np.concatenate([dt * h, df.T @ h]), np.concatenate([dt, df.sum(0)[:, None]]))
            step("class", at, g)
            step("class_bias", at, g_bias)
            at = np.concatenate([leaf, noise[some].ravel()])
            at, g, g_bias = summed_by(at, np.concatenate([dl * h, false.reshape(-1, DIM)]), np.concatenate([dl, false_bias.reshape(-1, 1)]))
            step("leaf", at, g)
            step("leaf_bias", at, g_bias)
            step("in", *summed_by(np.concatenate([two, one]), np.concatenate([dh * near[0], dh * near[1]])))
            step("near", np.arange(2), np.stack([np.einsum("bd,bd->d", dh, a), np.einsum("bd,bd->d", dh, b)]))
            self.seen += len(leaf)
        return moved

    def log10(self, two: np.ndarray, one: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Normalised log10 P(leaf | two before, one before) of each row."""
        n = len(self.share)
        pair, at = np.unique(two * (n + 1) + one, return_inverse=True)
        h = self.hidden(pair // (n + 1), pair % (n + 1))
        out = np.zeros(len(leaf), np.float32)
        own = leaf // self.width
        for a in range(0, len(pair), 1 << 15):  # contexts in bounded pieces
            z = h[a : a + (1 << 15)] @ self.w["class"].T + self.w["class_bias"][:, 0]
            z -= z.max(1, keepdims=True)
            z -= np.log(np.exp(z).sum(1, keepdims=True))
            mine = (at >= a) & (at < a + (1 << 15)) if len(pair) > 1 << 15 else slice(None)
            out[mine] = z[at[mine] - a, own[mine]]
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(self.classes + 1))
        for c in range(self.classes):
            for a in range(int(cuts[c]), int(cuts[c + 1]), 1 << 15):
                i = order[a : min(a + (1 << 15), int(cuts[c + 1]))]
                low, high = c * self.width, min((c + 1) * self.width, n)
                some, back = np.unique(at[i], return_inverse=True)
                z = h[some] @ self.w["leaf"][low:high].T + self.w["leaf_bias"][low:high, 0]
                z -= z.max(1, keepdims=True)
                z -= np.log(np.exp(z).sum(1, keepdims=True))
                out[i] += z[back, leaf[i] - low]
        return out.astype(float) / np.log(10)


def _left(corpus, names: int):
    """(h, ids) of each training document: its hash, and its tokens' names."""

    def run(batches):
        for batch in slices(batches):
            t = _Tokens(one_array(batch.column("text")))
            ids = corpus.value.look_up(t)[1][t.codes].astype(np.uint16 if names < 1 << 16 else np.uint32)
            seed = string_hashes(one_array(batch.column("text")), 5)
            cut = [ids[a:b].tobytes() for a, b in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(cut, pa.binary())], ["h", "ids"])

    return run


def _steps(batches, names: int, rate: float):
    """Positions that were not drawn, of documents in order, shuffled ``HELD`` at a time and cut into steps."""
    rng, held, count = np.random.default_rng(13), [], 0

    def cut(x):
        x = x[:, rng.permutation(x.shape[1])]
        return np.array_split(x, -(-x.shape[1] // STEP), axis=1)

    for batch in batches:
        for h, ids in zip(np.asarray(batch.column("h")).view(np.uint64), batch.column("ids"), strict=True):
            own = np.frombuffer(ids.as_buffer(), np.uint16 if names < 1 << 16 else np.uint32).astype(np.int32)
            before = np.concatenate([np.full(2, names, np.int32), own])
            new = _position_hashes(np.array([h]), np.array([0, len(own)])) > _bound(rate)
            held.append(np.stack([before[:-2], before[1:-1], own])[:, new])
            count += held[-1].shape[1]
            if count >= HELD:
                x = np.concatenate(held, axis=1)
                whole = x.shape[1] // HELD * HELD
                for a in range(0, whole, HELD):
                    yield from cut(x[:, a : a + HELD])
                held, count = [x[:, whole:]], x.shape[1] - whole
    if count:
        yield from cut(np.concatenate(held, axis=1))


def _shard(network, names: int, rate: float):
    """(name, block, shard, rows, seen): a task's weights and growth, times how often each row moved, and that number."""

    def run(batches):
        shard, net = TaskContext.get().partitionId(), network.value
        net = copy.deepcopy(net)  # the broadcast one is another task's as well
        net.seen = 0
        moved = net.go_on(_steps(batches, names, rate), 14 + shard)
        if not net.seen:
            return
        for name, n in moved.items():
            rows = np.concatenate([net.w[name] * n[:, None], net.grown[name] * n[:, None], n[:, None]], axis=1).astype(np.float32)
            for a in range(0, len(rows), BLOCK):
                if n[a : a + BLOCK].any():
                    yield pa.RecordBatch.from_pylist([{"name": name, "block": a, "shard": shard, "rows": rows[a : a + BLOCK].tobytes(), "seen": net.seen}])

    return run


def _sum_of_shards(table: pa.Table) -> pa.Table:
    """One block's rows, summed in the order of shards, so that sums are always the same."""
    table = table.sort_by("shard")
    rows = sum(np.frombuffer(x.as_buffer(), np.float32).astype(float) for x in table.column("rows"))
    return pa.table({"name": table.column("name")[:1], "block": table.column("block")[:1], "rows": pa.array([rows.tobytes()], pa.binary()), "seen": pa.array([sum(table.column("seen").to_pylist())])})


def trained(docs: DataFrame, corpus, rate: float) -> Network:
    """The network of the drawn positions, trained further on all others."""
    c = corpus.value
    net = Network(c.share).train(drawn(docs, corpus, c.names, rate))
    if rate >= 1:
        return net
    context = docs.sparkSession.sparkContext
    shards = min(MOST_SHARDS, -(-c.total // SHARD))
    left = docs.filter("not held").select("text").mapInArrow(_left(corpus, c.names), "h long, ids binary")
    dealt = left.repartition(shards, "h").sortWithinPartitions("h", "ids")
    each = dealt.mapInArrow(_shard(context.broadcast(net), c.names, rate), "name string, block long, shard long, rows binary, seen long")
    for r in each.groupBy("name", "block").applyInArrow(_sum_of_shards, "name string, block long, rows binary, seen long").toLocalIterator():
        w, grown = net.w[r.name][r.block : r.block + BLOCK], net.grown[r.name][r.block : r.block + BLOCK]
        rows = np.frombuffer(r.rows).reshape(len(w), -1)
        n, d = rows[:, -1:], w.shape[1]
        w[:], grown[:] = (np.where(n > 0, rows[:, a : a + d] / np.maximum(n, 1), old) for a, old in ((0, w), (d, grown)))
        if r.name == "near":
            net.seen += r.seen
    return net


RARE = pa.struct([("h", pa.int64()), ("n", pa.int64()), ("more", pa.float64())])
SCORED = "row long, doc_id long, held boolean, n_tokens long, n_known long, base double, model double, rare array<struct<h:long,n:long,more:double>>"


def _scored(corpus, network):
    """Documents with the sums over their common tokens, and what they hold of the others."""

    def run(batches):
        done = TaskContext.get().partitionId() << 40
        c, net = corpus.value, network.value if network is not None else None
        fixed = np.log10(1 - ADD / c.below) if c.total else 0.0
        for batch in slices(batches):
            t = _Tokens(one_array(batch.column("text")))
            count, leaves = c.look_up(t)
            rows = t.of_rows(np.arange(batch.num_rows))
            common = count >= 0
            base = np.where(common, np.log10((np.maximum(count, 0) + ADD) / c.below), 0.0)
            model = base[t.codes]
            if net is not None:
                two, one, own = t.contexts(leaves, c.names)
                p = net.log10(two, one, own) + fixed
                tail = own >= c.leaves
                p[tail] += base[t.codes[tail]] - np.log10(c.share[own[tail]])  # of an uncommon token, p(token) is yet to come
                model = p
            out = ~common[t.codes]
            code = rows[out] * len(t.hashes) + t.codes[out]
            pairs, back = np.unique(code, return_inverse=True)
            extra = pa.StructArray.from_arrays(
                [
                    pa.array(t.hashes[pairs % len(t.hashes)].view(np.int64)),
                    pa.array(np.bincount(back, minlength=len(pairs)).astype(np.int64)),
                    pa.array(np.bincount(back, model[out], len(pairs)).astype(float)),
                ],
                fields=list(RARE),
            )
            ends = np.searchsorted(pairs // len(t.hashes), np.arange(batch.num_rows + 1))
            total = lambda x: np.bincount(rows, x, batch.num_rows)
            cols = [
                pa.array(np.arange(done, done + batch.num_rows)),
                batch.column("doc_id"),
                batch.column("held"),
                pa.array(np.diff(t.offsets)),
                pa.array(total((count > 0)[t.codes]).astype(np.int64)),
                pa.array(total(base[t.codes]).astype(float)),
                pa.array(total(np.where(out, 0.0, model)).astype(float)),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), extra),
            ]
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCORED.split(", ")])

    return run


def lm_scores(docs: DataFrame, held_out: Column, common: int = COMMON) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of documents."""
    context = docs.sparkSession.sparkContext
    read = id_and_text(docs).withColumn("held", held_out)
    counts = written(count_tokens(read), "counts")
    corpus = summed(counts, common)
    shared, network = context.broadcast(corpus), None
    if corpus.leaves:
        rate = (DRAWS + DRAWS_A_LEAF * corpus.leaves) / corpus.total
        net = trained(read, shared, rate)
        del net.grown
        network = context.broadcast(net)
    rows = written(read.mapInArrow(_scored(shared, network), SCORED), "scored")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    log = lambda c: F.log10((c + F.lit(ADD)) / F.lit(corpus.below))
    none = F.lit(float(np.log10(ADD / corpus.below)))
    looked = rare.join(counts.select("h", F.col("n").alias("c")), "h", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.when(F.col("c").isNotNull(), log(F.col("c"))).otherwise(none)).alias("more_base"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("more") + F.col("n") * log(F.col("c"))).otherwise(F.col("n") * none)).alias("more_model"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return rows.join(looked, "row", "left").select(
        "doc_id",
        F.col("held").alias("held_out"),
        "n_tokens",
        plus("n_known", "known").alias("n_known"),
        F.lit(corpus.total).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"),
        plus("model", "more_model").alias("score"),
    )
