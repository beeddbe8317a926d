"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is cut into overlapping windows of words.  The input of a step is the word's embedding
(words frequent in the sample) and the mean embedding of its byte trigrams.  A forward and a
backward gated recurrent layer read the window, attention pools their states, and a linear layer
gives the window's logit.  A text scores as its highest window, through a logistic calibration.

Training uses a bounded sample of labelled rows (`TRAIN_DOCS` of each label, `TRAIN_WINDOWS` of
each row).  A toxic row's windows start as toxic; later only those that the network itself finds
so, or the row's best one, count, which is how a label of a whole text reaches its windows.
Scoring reads every window of every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import cut
from .words import LETTERS, SPACED, Words, mix, pieces, split_words, tidy

#: Words of a window, and from one window to the next.
LENGTH, STRIDE = 32, 16
#: Bounds of the training sample: labelled rows of each label, windows of each row.
TRAIN_DOCS, TRAIN_WINDOWS = 1200, 16
#: Hidden units of a direction, sizes of word and trigram embeddings, trigram buckets.
HIDDEN, WORD_DIM, CHAR_DIM, BUCKETS = 8, 12, 8, 1 << 13
#: Words of the sample with an embedding of their own: the most frequent, from so many rows on.
VOCABULARY, LEAST_ROWS = 20_000, 3
EPOCHS, STEPS, BATCH, RATE = (4, 16), 900, 256, 0.01
F4 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lexicon:
    """Distinct words of a batch: number of the embedding, and their trigrams' buckets."""

    def __init__(self, w: Words, known: np.ndarray) -> None:
        distinct, at, self.of = np.unique(w.hash, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
        self.word = np.where(known[place] == distinct, place + 1, 0) if len(known) else np.zeros(len(distinct), dtype=np.int64)
        start, size = w.start[at], w.end[at] - w.start[at]
        self.first = np.concatenate([[0], np.cumsum(size)])
        row = np.repeat(np.arange(len(size)), size)
        spot = np.arange(len(row)) - self.first[row] + start[row]
        data = w.data.astype(np.int64)
        edge_l, edge_r = spot == start[row], spot == (start + size)[row] - 1
        before = np.where(edge_l, 1, data[np.maximum(spot - 1, 0)])
        after = np.where(edge_r, 2, data[np.minimum(spot + 1, len(data) - 1)]) if len(data) else spot
        tri = (before << 16) | (data[spot] << 8) | after if len(data) else spot
        self.bucket = (mix(tri.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
        self.row, self.size = row, size


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of all overlapping windows; a row without words has none."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(0, -(-(n - LENGTH) // STRIDE)) + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = first[row] + number * STRIDE
    return row, start, np.minimum(start + LENGTH, first[row + 1])


class Network:
    """Parameters, forward and backward passes."""

    NAMES = ("word", "tri", "wx", "bx", "u", "wa", "va", "wo", "bo")

    def __init__(self, known: np.ndarray, seed: int = 7) -> None:
        r = np.random.Generator(np.random.PCG64(seed))
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        init = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(F4)
        self.known = known
        self.word, self.tri = init(len(known) + 1, WORD_DIM, k=0.1), init(BUCKETS, CHAR_DIM, k=0.1)
        self.word[0] = 0
        self.wx, self.bx, self.u = init(2, d, 3 * h), np.zeros((2, 1, 3 * h), F4), init(2, h, 3 * h)
        self.wa, self.va = init(2 * h, 8), init(8)
        self.wo, self.bo = init(2 * h), np.full(1, -2, F4)
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, lex: Lexicon) -> np.ndarray:
        """Input of each distinct word."""
        total = np.add.reduceat(self.tri[lex.bucket], lex.first[:-1], axis=0) if len(lex.size) else np.zeros((0, CHAR_DIM), F4)
        return np.concatenate([self.word[lex.word], total / np.maximum(lex.size, 1)[:, None].astype(F4)], axis=1)

    def forward(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple | None]:
        """Logits of windows; gates: 2 x words x 3H inputs of each distinct word, index: windows x LENGTH."""
        n, h, length = len(index), HIDDEN, index.shape[1]
        both = np.stack([index, index[:, ::-1]])
        on = np.stack([mask, mask[:, ::-1]])[..., None]
        state, states, saved = np.zeros((2, n, h), F4), np.empty((length, 2, n, h), F4), []
        for t in range(length):
            x = np.stack([gates[0][both[0, :, t]], gates[1][both[1, :, t]]])
            y = state @ self.u
            zr = _sigmoid(x[..., : 2 * h] + y[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            c = np.tanh(x[..., 2 * h :] + r * y[..., 2 * h :])
            new = (state + z * (c - state)) * on[:, :, t]
            if keep:
                saved.append((state, z, r, c, y[..., 2 * h :]))
            state = new
            states[t] = state
        out = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # length x n x 2H
        e = np.tanh(out @ self.wa)
        s = np.where(mask.T, e @ self.va, F4(-1e9))
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[..., None] * out).sum(axis=0)
        logit = pooled @ self.wo + self.bo
        return logit, (both, on, saved, out, e, a, pooled) if keep else None

    def backward(self, lex: Lexicon, x: np.ndarray, n_words: int, mask: np.ndarray, saved: tuple, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        both, on, steps, out, e, a, pooled = saved
        h, g = HIDDEN, {}
        g["wo"], g["bo"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pool = d_logit[:, None] * self.wo
        d_a = (out * d_pool).sum(axis=2)
        d_out = a[..., None] * d_pool
        d_s = a * (d_a - (a * d_a).sum(axis=0)) * mask.T
        g["va"] = np.einsum("tn,tnk->k", d_s, e)
        d_e = d_s[..., None] * self.va * (1 - e * e)
        g["wa"] = np.einsum("tni,tnk->ik", out, d_e)
        d_out = d_out + d_e @ self.wa.T
        d_states = np.stack([d_out[..., :h], d_out[::-1, :, h:]], axis=1)
        g["u"] = np.zeros_like(self.u)
        d_gates = np.zeros((2, n_words, 3 * h), F4)
        d_state = np.zeros_like(steps[0][0])
        for t in range(len(steps) - 1, -1, -1):
            state, z, r, c, yc = steps[t]
            d = (d_state + d_states[t]) * on[:, :, t]
            d_c = d * z * (1 - c * c)
            d_z = d * (c - state) * z * (1 - z)
            d_r = d_c * yc * r * (1 - r)
            d_y = np.concatenate([d_z, d_r, d_c * r], axis=2)
            g["u"] += state.transpose(0, 2, 1) @ d_y
            d_state = d * (1 - z) + d_y @ self.u.transpose(0, 2, 1)
            d_x = np.concatenate([d_z, d_r, d_c], axis=2)
            for k in (0, 1):
                np.add.at(d_gates[k], both[k, :, t], d_x[k])
        g["bx"] = d_gates.sum(axis=1, keepdims=True)
        g["wx"] = np.stack([x.T @ d_gates[k] for k in (0, 1)])
        d_in = d_gates[0] @ self.wx[0].T + d_gates[1] @ self.wx[1].T
        g["word"] = np.zeros_like(self.word)
        np.add.at(g["word"], lex.word, d_in[:, :WORD_DIM])
        g["word"][0] = 0
        g["tri"] = np.zeros_like(self.tri)
        used = np.unique(np.concatenate([both[0].ravel()]))
        inside = np.zeros(len(lex.size), bool)
        inside[used] = True
        pick = inside[lex.row]
        np.add.at(g["tri"], lex.bucket[pick], (d_in[:, WORD_DIM:] / np.maximum(lex.size, 1)[:, None])[lex.row[pick]].astype(F4))
        return g

    def logits(self, w: Words, lex: Lexicon, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        gates = np.stack([self.inputs(lex) @ self.wx[k] + self.bx[k] for k in (0, 1)])
        out = np.empty(len(start), F4)
        for i in range(0, len(start), 2048):
            spot = start[i : i + 2048, None] + np.arange(LENGTH)
            mask = spot < end[i : i + 2048, None]
            out[i : i + 2048] = self.forward(gates, lex.of[np.minimum(spot, len(lex.of) - 1)], mask)[0]
        return out

    def score(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * logit.astype(np.float64) + self.shift)

    def rows(self, w: Words) -> np.ndarray:
        """Highest window logit of each row; without words, the network's bias."""
        row, start, end = windows(w.first)
        best = np.full(len(w.first) - 1, float(self.bo[0]))
        if len(row):
            logit = self.logits(w, Lexicon(w, self.known), start, end)
            at = np.flatnonzero(np.diff(row, prepend=-1))
            best[row[at]] = np.maximum.reduceat(logit, at)
        return best


def train(doc: np.ndarray, toxic: np.ndarray, texts: list[str]) -> Network:
    """doc: which row a window is of (0 ..); toxic: label of each row; texts: the windows' words."""
    w = split_words(pa.array(texts, pa.string()), SPACED)
    row_of = doc[w.rows()]
    distinct, inverse = np.unique(w.hash, return_inverse=True)
    pairs = np.unique(np.stack([inverse, row_of]), axis=1)
    rows = np.bincount(pairs[0], minlength=len(distinct))
    often = np.argsort(-rows, kind="stable")[:VOCABULARY]
    net = Network(np.sort(distinct[often[rows[often] >= LEAST_ROWS]]))
    lex = Lexicon(w, net.known)
    start, end = w.first[:-1], w.first[1:]
    rng = np.random.Generator(np.random.PCG64(11))
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in net.NAMES}
    y = toxic[doc].astype(F4)
    even = lambda hit: np.where(y > 0, hit * F4(min(10.0, (y <= 0).sum() / max(1, hit.sum()))), F4(1)).astype(F4)
    weight = even(y) / F4(2)
    per_epoch = -(-len(texts) // BATCH)
    epochs = int(np.clip(-(-STEPS // per_epoch), *EPOCHS))  # small samples are seen more often
    top_rate = RATE * float(np.clip((STEPS / (epochs * per_epoch)) ** 0.5, 1, 2))  # and in larger steps
    step = 0
    for epoch in range(epochs):
        if epoch:
            logit = net.logits(w, lex, start, end)
            best = np.full(len(toxic), -np.inf)
            np.maximum.at(best, doc, logit)
            p = _sigmoid(logit)
            weight = even((y > 0) & ((p > 0.8) | (logit == best[doc])))
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            of = order[i : i + BATCH]
            spot = start[of, None] + np.arange(LENGTH)
            mask = spot < end[of, None]
            index = lex.of[np.minimum(spot, len(lex.of) - 1)]
            used, local = np.unique(index, return_inverse=True)
            part = _Part(lex, used)
            x = net.inputs(part)
            gates = np.stack([x @ net.wx[k] + net.bx[k] for k in (0, 1)])
            logit, saved = net.forward(gates, local.reshape(index.shape), mask, keep=True)
            d = ((_sigmoid(logit) - y[of]) * weight[of] / len(of)).astype(F4)
            grads = net.backward(part, x, len(used), mask, saved, d)
            step += 1
            rate = top_rate * (1 - 0.95 * step / (epochs * per_epoch))
            for k, g in grads.items():
                m, v = moments[k]
                m += (g - m) * F4(0.1)
                v += (g * g - v) * F4(0.01)
                value = getattr(net, k)
                value -= F4(rate) * (m / F4(1 - 0.9**step)) / (np.sqrt(v / F4(1 - 0.99**step)) + F4(1e-6))
    return net


def calibrate(net: Network, best: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
    """Logistic regression of rows' labels on their highest logits; sets the network's scale and shift."""
    mid, spread = best.mean(), best.std() + 1e-6
    x, t, w = (best - mid) / spread, toxic.astype(float), weight / weight.sum()
    a, b = 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(a * x + b)
        s = w * p * (1 - p)
        ga, gb = (w * (p - t) * x).sum() + 1e-4 * a, (w * (p - t)).sum()
        haa, hab, hbb = (s * x * x).sum() + 1e-4, (s * x).sum(), s.sum() + 1e-9
        det = haa * hbb - hab * hab
        a, b = a - np.clip((hbb * ga - hab * gb) / det, -1, 1), b - np.clip((haa * gb - hab * ga) / det, -1, 1)
    # one half lies where the fewest of the sample's rows are misjudged, in the middle of such a gap
    order = np.argsort(x, kind="stable")
    wrong = (w * (1 - t)).sum() + np.concatenate([[0], np.cumsum((w * (2 * t - 1))[order])])
    least = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    ends = np.concatenate([[x.min() - 1], x[order], [x.max() + 1]])
    at = least[len(least) // 2]
    cut_at = (ends[at] + ends[at + 1]) / 2
    a = max(float(a), 0.5)
    net.scale, net.shift = a / spread, -a * (cut_at + mid / spread)


class _Part:
    """Some of a lexicon's words."""

    def __init__(self, lex: Lexicon, used: np.ndarray) -> None:
        self.word, self.size = lex.word[used], lex.size[used]
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.row = np.repeat(np.arange(len(used)), self.size)
        self.bucket = lex.bucket[lex.first[used][self.row] + np.arange(len(self.row)) - self.first[self.row]]


def held_out(key) -> F.Column:
    """Rows never used in training: crc32 of the key as text is divisible by 5."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network | None:
    """A network from the labelled rows that are not held out; None without rows of both labels.

    Of rows with a repeated key the labels' maximum counts and the least text is read; null keys
    and labels are left out.
    """
    source = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").where(~held_out("k"))
    known = source.groupBy("k").agg(F.max("y").alias("y"))
    some = [known.where(c).orderBy(F.xxhash64("k"), "k").limit(TRAIN_DOCS) for c in ("y > 0", "y <= 0")]
    chosen = cut(some[0].union(some[1]))
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t")).select("k", "t", "y")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "t"):
            w = split_words(piece.column(1), LETTERS)
            row, start, end = windows(w.first)
            keys, labels_, out = piece.column(0), piece.column(2), ([], [])
            for r in np.unique(row).tolist():
                of = np.flatnonzero(row == r)
                if len(of) > TRAIN_WINDOWS:
                    of = of[np.random.Generator(np.random.PCG64(int(w.hash[w.first[r]] >> np.uint64(1)))).choice(len(of), TRAIN_WINDOWS, replace=False)]
                for i in sorted(of.tolist()):
                    out[0].append(r)
                    out[1].append(b" ".join(w.data[w.start[j] : w.end[j]].tobytes() for j in range(start[i], end[i])).decode("utf-8", "replace"))
            take = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(take), labels_.take(take), pa.array(out[1], pa.string())], names=["k", "y", "w"])

    got = texts.mapInArrow(sample, T.StructType([T.StructField("k", source.schema["k"].dataType), T.StructField("y", T.IntegerType()), T.StructField("w", T.StringType())])).toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("k", "ascending"), ("w", "ascending")])
    keys, doc = np.unique(np.asarray(got.column("k").to_pylist()), return_inverse=True)
    toxic = np.zeros(len(keys), dtype=np.int64)
    toxic[doc] = got.column("y").to_numpy() > 0
    if toxic.all() or not toxic.any():
        return None
    net = train(doc, toxic, got.column("w").to_pylist())
    # the highest logit over all windows of the whole texts, weighted as the labels are in the table
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "t", 2 << 20):
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(shared.value.rows(split_words(piece.column(1), LETTERS)))], names=["k", "y", "m"])

    rows = texts.mapInArrow(highest, T.StructType([T.StructField("k", source.schema["k"].dataType), T.StructField("y", T.IntegerType()), T.StructField("m", T.DoubleType())])).toArrow().sort_by([("k", "ascending"), ("m", "ascending")])
    there = {r[0]: r[1] for r in known.groupBy(F.col("y") > 0).count().collect()}
    y = rows.column("y").to_numpy() > 0
    weight = np.where(y, there.get(True, 1) / max(1, y.sum()), there.get(False, 1) / max(1, (~y).sum()))
    calibrate(net, rows.column("m").to_numpy(), y, weight)
    tidy()
    return net


def _best(net: Network | None, column: pa.Array) -> np.ndarray:
    if net is None:
        return np.zeros(len(column))
    return net.score(net.rows(split_words(column, LETTERS)))


def score(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted: one row for each row of docs.

    A null or empty text has no windows and scores as the network's bias; without a network all
    score 0.  Null and repeated keys and repeated rows are kept (equal texts score the same);
    held_out of a null key is false; other columns are ignored, whatever their names; texts are
    scored whole, however long; an empty table gives no rows.
    """
    source = docs.select(F.col(key).alias("k"), F.coalesce(held_out(key), F.lit(False)).alias("o"), F.col(text).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "t", 2 << 20):
            p = _best(shared.value, piece.column(2))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    schema = T.StructType([T.StructField(key, source.schema["k"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return source.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs without the rows predicted toxic, each row judged by its text alone.

    All columns are kept as they are, null keys and repeated rows too; without a network, or
    from an empty table, all rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, 2 << 20):
            yield piece.filter(pa.array(_best(shared.value, piece.column(piece.schema.get_field_index(text))) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op10_toxicity": op10_toxicity}
