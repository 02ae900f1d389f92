"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network reads a text in windows of ``SPAN`` bytes, one way and the other, and labels every byte
position with a probability for each language; a text's probabilities are the means over all of its
positions.  Windows of many texts advance together, so memory is bounded by the batch, not the text.
It is trained in numpy by backpropagation through time, on windows of a bounded sample of labelled
rows (``TRAIN_WINDOWS`` windows of each of the ``TRAIN_DOCS`` rows with the smallest hashes, so that
reruns learn from the same rows, which come from the whole table).

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows whose language is
null are never learned from; if no row can be learned from, every text is ``und``; ties go to the
language first in code-point order; repeated rows are learned from once and judged alike; NUL characters count as spaces; a text of any
length is judged whole; other columns are ignored, whatever their names; one output row for each input
row, so an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import crc_fold, least_hash, map_batches, slices

SPAN, HIDDEN = 96, 8
TRAIN_DOCS, TRAIN_WINDOWS = 1600, 4
STEPS, BATCH, RATE = 320, 192, 0.02
HELD_OUT, FOLDS = 2, 4
LANES = 4096


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter by its Unicode category; digits and fractions are not."""
    return bool(text) and any(map(str.isalpha, text))


def bytes_of(text: str) -> bytes:
    """UTF-8 without the byte that stands for padding."""
    return text.encode("utf-8", "surrogatepass").replace(b"\0", b" ")


@dataclass
class Network:
    """For each direction: ``table`` (256, 3 H) of input gates by byte, ``back`` (H, 3 H), and ``out`` (H, labels)."""

    labels: list[str]
    table: list[np.ndarray]
    back: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.back, *self.out, self.bias]


def new_network(labels: list[str], seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Network(
        labels,
        [draw(256, 3 * HIDDEN, scale=0.3) for _ in range(2)],
        [draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5) for _ in range(2)],
        [draw(HIDDEN, len(labels), scale=0.3) for _ in range(2)],
        np.zeros(len(labels), np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def run(table: np.ndarray, back: np.ndarray, data: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, rows, H) over ``data`` (time, rows); ``keep`` collects what training needs."""
    h = np.zeros((data.shape[1], HIDDEN), np.float32)
    states = np.empty((*data.shape, HIDDEN), np.float32)
    for t, bytes_now in enumerate(data):
        gate = table[bytes_now]
        turn = h @ back
        both = _sigmoid(gate[:, : 2 * HIDDEN] + turn[:, : 2 * HIDDEN])
        z, r = both[:, :HIDDEN], both[:, HIDDEN:]
        own = turn[:, 2 * HIDDEN :]
        n = np.tanh(gate[:, 2 * HIDDEN :] + r * own)
        if keep is not None:
            keep.append((h, z, r, n, own))
        h = n + z * (h - n)
        states[t] = h
    return states


def back_through_time(table: np.ndarray, back: np.ndarray, data: np.ndarray, keep: list, upstream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``table`` and ``back``; ``upstream`` is the gradient of every state."""
    d_back, d_gates = np.zeros_like(back), np.empty((*data.shape, 3 * HIDDEN), np.float32)
    carry = np.zeros_like(upstream[0])
    for t in range(len(data) - 1, -1, -1):
        before, z, r, n, own = keep[t]
        d = upstream[t] + carry
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (before - n) * z * (1 - z)
        d_r = d_n * own * r * (1 - r)
        d_gates[t] = np.concatenate([d_z, d_r, d_n], 1)
        d_turn = np.concatenate([d_z, d_r, d_n * r], 1)
        d_back += before.T @ d_turn
        carry = d * z + d_turn @ back.T
    d_table = np.zeros_like(table)
    np.add.at(d_table, data.ravel(), d_gates.reshape(-1, 3 * HIDDEN))
    return d_table, d_back


def position_probabilities(net: Network, data: np.ndarray) -> np.ndarray:
    """(time, rows, labels) for ``data`` (time, rows)."""
    score = run(net.table[0], net.back[0], data) @ net.out[0]
    score += run(net.table[1], net.back[1], data[::-1])[::-1] @ net.out[1]
    score += net.bias
    score -= score.max(-1, keepdims=True)
    np.exp(score, out=score)
    score /= score.sum(-1, keepdims=True)
    return score


def train(windows: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 7) -> Network | None:
    """Fit by Adam on the mean cross-entropy of all positions, the languages equally often."""
    names = sorted(set(labels))
    if not names:
        return None
    net, rng = new_network(names, seed), np.random.default_rng(seed)
    data = np.zeros((len(windows), SPAN), np.uint8)
    for k, w in enumerate(windows):
        data[k, : len(w)] = np.frombuffer(w[:SPAN], np.uint8)
    real = data != 0
    target = np.array([names.index(x) for x in labels])
    by_label = [np.flatnonzero(target == k) for k in range(len(names))]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in net.parameters()]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows, -(-BATCH // len(names))) for rows in by_label])
        x, y, mask = data[pick].T, target[pick], real[pick].T
        kept: list[list] = [[], []]
        states = [run(net.table[0], net.back[0], x, kept[0]), run(net.table[1], net.back[1], x[::-1], kept[1])]
        score = states[0] @ net.out[0] + states[1][::-1] @ net.out[1] + net.bias
        p = np.exp(score - score.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        p[:, np.arange(len(y)), y] -= 1
        d = p * (mask / max(mask.sum(), 1))[..., None].astype(np.float32)
        grads: list[list] = [[], [], []]
        for k, (s, g) in enumerate(zip(states, (d, d[::-1]), strict=True)):
            a, b = back_through_time(net.table[k], net.back[k], x if k == 0 else x[::-1], kept[k], g @ net.out[k].T)
            grads[0].append(a)
            grads[1].append(b)
            grads[2].append(s.reshape(-1, HIDDEN).T @ g.reshape(-1, len(names)))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for p_, g, m in zip(net.parameters(), [*grads[0], *grads[1], *grads[2], d.sum((0, 1))], moment, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            p_ -= (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def predict(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Label and probability of each whole text."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if net is None:
        return names, scores
    chosen = [i for i, t in enumerate(texts) if has_letter(t)]
    parts = [bytes_of(texts[i]) for i in chosen]
    counts = np.array([-(-len(p) // SPAN) for p in parts], np.int64)
    rows = int(counts.sum())
    if not rows:
        return names, scores
    data = np.zeros((rows, SPAN), np.uint8)
    first = np.cumsum(counts) - counts
    for p, at, n in zip(parts, first.tolist(), counts.tolist(), strict=True):
        data[at : at + n].reshape(-1)[: len(p)] = np.frombuffer(p, np.uint8)
    sums = np.empty((rows, len(net.labels)))
    for low in range(0, rows, LANES):
        some = np.ascontiguousarray(data[low : low + LANES].T)
        sums[low : low + LANES] = (position_probabilities(net, some) * (some != 0)[..., None]).sum(0)
    pooled = np.add.reduceat(sums, first, axis=0) / np.maximum(np.add.reduceat((data != 0).sum(1), first), 1)[:, None]
    best = pooled.argmax(1)
    for k, i in enumerate(chosen):
        names[i], scores[i] = net.labels[best[k]], float(min(max(pooled[k, best[k]], 0.0), 1.0))
    return names, scores


def training_windows(docs: DataFrame, most: int = TRAIN_DOCS) -> list[tuple[bytes, str]]:
    """Windows spread over the whole texts of at most ``most`` labelled rows outside the held-out fold, chosen by hash."""
    rows = docs.select("text", "lang", F.xxhash64("doc_id", "text", F.lit("langid")).alias("hash"), crc_fold().alias("fold"))
    rows = rows.filter((F.col("fold") != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    bound = least_hash(rows.select("hash"), "hash", most)
    chosen = rows if bound is None else rows.filter(F.col("hash") <= bound)
    chosen = chosen.dropDuplicates(["hash"])

    def make() -> Callable:
        def one(batch: pa.RecordBatch):
            windows, langs = [], []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if not has_letter(text):
                    continue
                data = bytes_of(text)
                gap = max(len(data) - SPAN, 0)
                for at in sorted({gap * k // max(TRAIN_WINDOWS - 1, 1) for k in range(TRAIN_WINDOWS)}):
                    windows.append(data[at : at + SPAN])
                    langs.append(lang)
            yield {"part": windows, "lang": langs}

        return one

    found = map_batches(chosen.select("text", "lang"), make, "part binary, lang string")
    return sorted((bytes(r[0]), r[1]) for r in found.collect())


def detect(docs: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    learned = training_windows(docs, most)
    net = train([w for w, _ in learned], [x for _, x in learned])

    def make() -> Callable:
        def one(batch: pa.RecordBatch):
            for part in slices(batch, limit=1 << 20):
                names, scores = predict(net, part.column("text").to_pylist())
                yield {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": names, "score": scores}

        return one

    rows = docs.select("doc_id", (crc_fold() == HELD_OUT).alias("held_out"), "text")
    return map_batches(rows, make, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
