"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in consecutive windows of ``WINDOW`` bytes; in each window one recurrent layer runs forward and one backward,
and every byte position gets a probability for each language from both states. A document's probabilities are the means over
all of its positions, so the whole text counts. The network is trained in numpy by backpropagation through time on windows of
a bounded, seeded sample of labelled documents (at most ``per_language`` of each language), then applied to every document
inside Spark tasks; its parameters are a few kilobytes.

Defined results: null text, and text without a letter, is ``und`` with score 0; null ids count as not held out and are never
learned from; repeated rows get equal predictions; with nothing to learn from every text is ``und``; texts of any length are
read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.llm.common import seeded, slices, text_bytes
from cellweave.scale import sized

WINDOW = 128
HIDDEN = 8
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Direction:
    """One gated recurrent layer over bytes: update and reset gates and a candidate state, for inputs given as byte values.

    ``w`` (256, 3H) holds the input terms of (update, reset, candidate) for each byte, ``u`` (H, 3H) the recurrent terms.
    """

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.w = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
        self.u = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.w[:, :hidden] -= 1  # remember at first

    def step(self, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = h.shape[1]
        a, b = self.w[byte], h @ self.u
        gates = sigmoid(a[:, : 2 * n] + b[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        candidate = np.tanh(a[:, 2 * n :] + r * b[:, 2 * n :])
        return h + z * (candidate - h), z, r, candidate, b[:, 2 * n :]

    def states(self, x: np.ndarray, hidden: int) -> np.ndarray:
        """(time, row, H) for bytes ``x`` (time, row)."""
        out, h = np.empty((*x.shape, hidden), np.float32), np.zeros((x.shape[1], hidden), np.float32)
        for t in range(len(x)):
            h = self.step(x[t], h)[0]
            out[t] = h
        return out

    def through_time(self, x: np.ndarray, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of w and u, given the gradients (time, row, H) of the states."""
        n, steps = d_out.shape[2], []
        h = np.zeros((x.shape[1], n), np.float32)
        for t in range(len(x)):
            new, *parts = self.step(x[t], h)
            steps.append((h, *parts))
            h = new
        dw, du, dh = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(h)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, candidate, ub = steps[t]
            dh = dh + d_out[t]
            dz = dh * (candidate - h) * z * (1 - z)
            dc = dh * z * (1 - candidate * candidate)
            dr = dc * ub * r * (1 - r)
            da, db = np.concatenate([dz, dr, dc], axis=1), np.concatenate([dz, dr, dc * r], axis=1)
            np.add.at(dw, x[t], da)
            du += h.T @ db
            dh = dh * (1 - z) + db @ self.u.T
        return dw, du


class Network:
    """Both directions and the output layer; ``languages`` in sorted order."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.forward, self.backward = Direction(rng, hidden), Direction(rng, hidden)
        self.v = (rng.standard_normal((2 * hidden, len(languages))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.forward.w, self.forward.u, self.backward.w, self.backward.u, self.v, self.bias]

    @staticmethod
    def reversed_rows(x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each column of (time, row, ...) reversed within its length; positions beyond it are left as they fall."""
        at = (length[None, :] - 1 - np.arange(len(x))[:, None]) % len(x)
        return x[at, np.arange(x.shape[1])[None, :]]

    def probabilities(self, x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(time, row, language) for every position, and both state arrays; bytes after ``length`` are padding."""
        f = self.forward.states(x, self.hidden)
        b = self.reversed_rows(self.backward.states(self.reversed_rows(x, length), self.hidden), length)
        flat = f.reshape(-1, self.hidden) @ self.v[: self.hidden] + b.reshape(-1, self.hidden) @ self.v[self.hidden :] + self.bias
        flat -= flat.max(axis=1, keepdims=True)
        np.exp(flat, out=flat)
        flat /= flat.sum(axis=1, keepdims=True)
        return flat.reshape(*x.shape, -1), f, b

    def gradients(self, x: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients."""
        p, f, b = self.probabilities(x, length)
        real = (np.arange(len(x))[:, None] < length[None, :])
        n = real.sum()
        loss = -np.log(np.maximum(p[:, np.arange(len(label)), label], 1e-12))[real].sum() / n
        d = p.copy()
        d[:, np.arange(len(label)), label] -= 1
        d *= (real / np.float32(n))[:, :, None]
        flat = d.reshape(-1, d.shape[2])
        dv = np.concatenate([f.reshape(-1, self.hidden).T @ flat, b.reshape(-1, self.hidden).T @ flat])
        df = (flat @ self.v[: self.hidden].T).reshape(f.shape)
        db = self.reversed_rows((flat @ self.v[self.hidden :].T).reshape(b.shape), length)
        backward_x = self.reversed_rows(x, length)
        return loss, [*self.forward.through_time(x, df), *self.backward.through_time(backward_x, db), dv, flat.sum(axis=0)]


def train(texts: list[bytes], labels: list[str], window: int = 64, steps: int = 240, batch: int = 192, seed: int = 1) -> Network:
    """Fits a network on random windows of the texts, languages in equal parts, by Adam."""
    languages = sorted(set(labels))
    net, rng = Network(languages, seed=seed), np.random.default_rng(seed)
    by_language = [[np.frombuffer(t, np.uint8) for t, lang in zip(texts, labels) if lang == name] for name in languages]
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        x, length, label = np.zeros((window, batch), np.uint8), np.zeros(batch, np.int64), np.arange(batch) % len(languages)
        for k in range(batch):
            texts_of = by_language[label[k]]
            t = texts_of[rng.integers(len(texts_of))]
            at = rng.integers(max(1, len(t) - window + 1))
            part = t[at : at + window]
            x[: len(part), k], length[k] = part, max(1, len(part))
        _, grads = net.gradients(x, length, label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for p, g, m, v in zip(net.parameters(), grads, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the consecutive windows of each document's bytes."""
    count = -(-(ends - starts) // size)
    doc = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[doc] + nth * size
    return doc, at, np.minimum(size, ends[doc] - at)


def predict(net: Network, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = WINDOW, rows: int = 2048) -> np.ndarray:
    """(document, language): mean probability over all positions of each document's bytes."""
    doc, at, length = windows(data, starts, ends, size)
    sums = np.zeros((len(starts), len(net.languages)))
    order = np.argsort(-length, kind="stable")
    for k in range(0, len(order), rows):
        pick = order[k : k + rows]
        long = int(length[pick[0]])
        inside = np.minimum(np.arange(long)[:, None], length[pick][None, :] - 1)
        p, _, _ = net.probabilities(data[at[pick][None, :] + inside], length[pick])
        p[np.arange(long)[:, None] >= length[pick][None, :]] = 0
        np.add.at(sums, doc[pick], p.sum(axis=0, dtype=np.float64))
    return sums / np.maximum(1, ends - starts)[:, None]


def learned(docs: DataFrame, per_language: int = 300, seed: int = 1, passage: int = 4000) -> Network | None:
    """A network from a seeded sample of documents with a language that are not held out.

    At most ``per_language`` documents of a language, a passage of at most ``passage`` characters at a seeded place of each.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    # a few times what is wanted of each language, by hash; so what meets in a task does not grow with the corpus
    share = sized(rows.groupBy("lang").agg((F.lit(4.0 * per_language) / F.count(F.lit(1))).alias("__share")))
    likely = rows.withColumn("__h", seeded(seed, F.col("doc_id"))).join(share, "lang").where(F.col("__h") <= F.col("__share") * float(2**63))
    order = Window.partitionBy("lang").orderBy("__h", "doc_id", F.crc32("text"))
    first = likely.where(F.col("text").rlike(r"\p{L}")).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_language)
    at = F.pmod(seeded(seed + 1, F.col("doc_id")), F.greatest(F.char_length("text") - passage, F.lit(0)) + 1)
    part = F.encode(F.expr(f"substring(text, cast(__at as int) + 1, {passage})"), "utf-8")
    sample = first.withColumn("__at", at).select("lang", part.alias("text"))
    rows = sorted((r["lang"], bytes(r["text"])) for r in sample.collect())
    return train([t for _, t in rows], [lang for lang, _ in rows], seed=seed) if rows else None


def held_out():
    """crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _labels(batch: pa.RecordBatch, column: int, net: Network | None) -> tuple[np.ndarray, np.ndarray]:
    """Predicted language and score of the texts in a column."""
    n = batch.num_rows
    pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
    if net is None:
        return pred, score
    text = batch.column(column)
    data, starts, ends = text_bytes(text)
    at = np.flatnonzero([t is not None and any(map(str.isalpha, t)) for t in text.to_pylist()])
    if len(at):
        p = predict(net, data, starts[at], ends[at])
        best = p.argmax(axis=1)
        pred[at], score[at] = np.array(net.languages, object)[best], np.clip(p[np.arange(len(at)), best], 0, 1)
    return pred, score


def languages_of(docs: DataFrame, per_language: int = 300, seed: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those that are not held out."""
    net = learned(docs, per_language, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            pred, score = _labels(batch, 2, net)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least_score: float = 0.3, per_language: int = 300, seed: int = 1) -> DataFrame:
    """The documents with a language, with all their columns; a null ``lang`` becomes the prediction.

    Rejected are ``und`` and texts in which no language reaches a mean probability of ``least_score``.
    """
    net = learned(docs, per_language, seed)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            pred, score = _labels(batch, text, net)
            keep = pa.array((pred != UNKNOWN) & (score >= least_score))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[lang] = pa.compute.coalesce(columns[lang], pa.array(pred, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(keep)

    return docs.mapInArrow(run, docs.schema)
