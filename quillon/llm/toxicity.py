"""Toxicity by a classifier chain over words, word beginnings and word ends.

The chain predicts two kinds of toxicity, then toxic itself.  Each link is a logistic model over the
presence of features, and the later ones also see the probabilities of the categories before them; in
training these are out-of-fold predictions, so that no model sees an answer it was fitted on.
``toxic`` is the tables' label.  The kinds are found in the labelled texts: telling features that stand
together in toxic texts form a kind (two groups, by cosine of their occurrences), whatever the
language, and a labelled toxic text belongs to each kind that gives at least a third of its telling
features.  The decision threshold is the one with the best F1 on out-of-fold probabilities.

The models are fitted on a bounded sample of labelled rows (``TRAIN_ROWS``) and a vocabulary of at
most ``VOCABULARY`` words that stand in a greater share of the toxic texts than of the clean ones,
beyond chance.  Copies would make any word of theirs look telling, so the near-duplicates of a label
(components as in ``neardup``) count as one text; all other texts count.

Defined cases: null, empty or wordless texts are not toxic with score 0; labels without a document,
with a null label or a null id are not learned from; without any usable label of both kinds nothing is
toxic; a doc_id that repeats is learned from once, with the text of the smallest hash, and is toxic if
any of its labels is; equal scores get equal verdicts, and equally telling words go by code points;
texts of any length are judged whole; other columns are ignored, whatever their names; one output row
for each input row, so an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import neardup
from quillon.llm.common import cut, least_hash, map_batches, py_crc_fold, slices

TRAIN_ROWS, VOCABULARY, FOLDS = 8000, 1000, 5
#: A word is a feature if its log-likelihood ratio over different texts is so large.
LEAST_RATIO = 15.0
#: Least share of a text's telling features that puts it in a kind.
KIND_SHARE = 1 / 3
CHAIN = ("kind_1", "kind_2", "toxic")
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(word: str) -> list[str]:
    """The word, and its beginnings and ends of three to seven letters: stems carry over to inflected words."""
    n = len(word)
    return [word, *(word[:k] + "-" for k in range(3, min(n, 8))), *("-" + word[-k:] for k in range(3, min(n, 8)))]


class Lookup:
    """Numbers of a text's features; what a word gives is remembered, up to a million words."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary, self.of = vocabulary, {}

    def __call__(self, text_words: set[str]) -> set[int]:
        out: set[int] = set()
        for w in text_words:
            known = self.of.get(w)
            if known is None:
                if len(self.of) > 1_000_000:
                    self.of.clear()
                known = self.of[w] = tuple(self.vocabulary[f] for f in features(w) if f in self.vocabulary)
            if known:
                out.update(known)
        return out


@dataclass
class Chain:
    vocabulary: dict[str, int]
    weights: dict[str, np.ndarray]  # words, then the categories before, then the bias
    threshold: float


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 100, rate: float = 0.3, decay: float = 2e-4) -> np.ndarray:
    """Logistic regression by Adam on all rows, the two classes weighing the same."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    w = np.zeros(x.shape[1], np.float32)
    if not y.any() or y.all():
        w[-1] = 8.0 if y.any() else -8.0
        return w
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum()).astype(np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + decay * w
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        w -= (rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))).astype(np.float32)


def kinds_of(x: np.ndarray, rounds: int = 20) -> np.ndarray:
    """0 or 1 for each column of ``x`` (toxic rows by features): two groups of features that occur together.

    Spherical k-means; the first centre is the most frequent feature, the second the one least like it.
    """
    unit = x / np.maximum(np.sqrt((x * x).sum(0, keepdims=True)), 1e-9)
    first = int(x.sum(0).argmax()) if x.shape[1] else 0
    if x.shape[1] < 2:
        return np.zeros(x.shape[1], int)
    centres = unit[:, [first, int((unit.T @ unit[:, first] - 1e-6 * x.sum(0) / max(len(x), 1)).argmin())]]
    group = np.zeros(x.shape[1], int)
    for _ in range(rounds):
        now = (unit.T @ centres).argmax(1)
        if (now == group).all() and now.any():
            break
        group = now
        for k in (0, 1):
            if (group == k).any():
                centre = unit[:, group == k].sum(1)
                centres[:, k] = centre / max(float(np.sqrt(centre @ centre)), 1e-9)
    return group


def fit_chain(rows: list[tuple[object, bool, list[str]]], vocabulary: list[str]) -> Chain | None:
    """``rows``: id, label, its words in the vocabulary."""
    toxic = np.array([r[1] for r in rows], bool)
    if not len(rows) or toxic.all() or not toxic.any():
        return None
    index = {w: k for k, w in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(index)), np.float32)
    for i, r in enumerate(rows):
        x[i, [index[w] for w in r[2]]] = 1
    fold = np.array([py_crc_fold(r[0], FOLDS) for r in rows])
    group, held = kinds_of(x[toxic]), x.sum(1)
    weights: dict[str, np.ndarray] = {}
    p = np.zeros(len(rows), np.float32)
    for k, name in enumerate(CHAIN):
        y = toxic if name == "toxic" else toxic & (held > 0) & (x[:, : len(index)][:, group == k].sum(1) >= KIND_SHARE * held)
        p = np.zeros(len(rows), np.float32)
        for f in range(FOLDS):
            if (here := fold == f).any() and not here.all():
                p[here] = _apply(_fit(x[~here], y[~here]), x[here])
        weights[name] = _fit(x, y)
        x = np.concatenate([x, p[:, None]], 1)
    return Chain(index, weights, _threshold(p, toxic))


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    last = np.append(p[order][1:] != p[order][:-1], True)  # cut only between different scores
    k = int(np.argmax(np.where(last, f, -1)))
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0)) / 2)


def score(chain: Chain, texts: list[str | None], lookup: Lookup | None = None) -> tuple[dict[str, list[float]], list[bool]]:
    """Probabilities by category, and the verdicts."""
    n = len(texts)
    known = [words(t) for t in texts]
    x = np.zeros((n, len(chain.vocabulary)), np.float32)
    lookup = lookup or Lookup(chain.vocabulary)
    for i, w in enumerate(known):
        x[i, list(lookup(w))] = 1
    empty = np.array([not w for w in known], bool)
    out: dict[str, list[float]] = {}
    p = np.zeros(n, np.float32)
    for name in CHAIN:
        p = _apply(chain.weights[name], x)
        x = np.concatenate([x, p[:, None]], 1)
        out[name] = np.where(empty, 0.0, p.astype(float)).tolist()
    return out, ((p > chain.threshold) & ~empty).tolist()


def copies(texts: DataFrame) -> dict[bytes, bytes]:
    """The component of each shingle set whose component holds more than one of ``texts`` (different ids)."""
    sketches = cut(neardup.sketch(texts))
    repeated = sketches.filter("node is not null").groupBy("node").count().filter("count > 1").select("node").collect()
    found = neardup.links(texts, sketches)
    return {bytes(r[0]): bytes(r[0]) for r in repeated} | ({} if found is None else neardup.few_components(found))


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Chain | None:
    """Fit on at most ``most`` labelled rows, chosen by hash; only words, counts and digests of these reach the driver."""
    usable = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null")
    hashed = usable.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).withColumn("hash", F.xxhash64("doc_id", F.lit("toxicity")))
    bound = least_hash(hashed, "hash", most)
    sample = hashed if bound is None else hashed.filter(F.col("hash") <= bound)
    sample = sample.select("doc_id", "toxic")  # at most ``most`` rows: safe to broadcast

    def counting() -> Callable:
        def one(batch: pa.RecordBatch):
            for part in slices(batch):
                count: Counter = Counter()
                texts_here = part.column("text").to_pylist()
                for t, toxic, node in zip(texts_here, part.column("toxic").to_pylist(), neardup.nodes_of(texts_here), strict=True):
                    if known := words(t):
                        kind = kinds.get(node)
                        count.update((f, toxic, kind) for f in {None, *(f for w in known for f in features(w))})
                yield {"word": [k[0] for k in count], "toxic": [k[1] for k in count], "kind": [k[2] for k in count], "n": list(count.values())}

        return one

    # the sample's texts are read more than once: for copies, for counts and for what they hold
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = cut(texts)
    kinds = copies(texts)
    # a null kind is a text without copies; the null word counts the texts
    counts = map_batches(texts.select("text", "toxic"), counting, "word string, toxic boolean, kind binary, n bigint").groupBy("word", "toxic", "kind").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("n", F.when(F.col("kind").isNull(), F.col("n")).otherwise(1))
    counts = cut(counts.groupBy("word").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("good")).filter("bad + good > 4 or word is null"))
    sizes = counts.filter("word is null").select("bad", "good").head()
    if sizes is None or not sizes[0] or not sizes[1]:
        return None
    share = sizes[0] / (sizes[0] + sizes[1])
    n = F.col("bad") + F.col("good")
    part = lambda k, expected: F.when(k > 0, 2 * k * F.log(k / expected)).otherwise(0.0)
    ratio = part(F.col("bad"), n * share) + part(F.col("good"), n * (1 - share))
    best = counts.filter("word is not null and bad + good > 4").filter(F.col("bad") * sizes[1] > F.col("good") * sizes[0]).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "word").limit(VOCABULARY)
    vocabulary = sorted(r[0] for r in best.select("word").collect())

    def listing() -> Callable:
        lookup = Lookup({w: k for k, w in enumerate(vocabulary)})

        def one(batch: pa.RecordBatch):
            for part in slices(batch):
                known = [words(t) for t in part.column("text").to_pylist()]
                held = [[vocabulary[k] for k in sorted(lookup(w))] for w in known]
                yield {"doc_id": part.column("doc_id"), "toxic": part.column("toxic"), "words": held}

        return one

    rows = [tuple(r) for r in map_batches(texts, listing, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic boolean, words array<string>").collect()]
    return fit_chain(sorted(rows, key=lambda r: (r[0], r[2])), vocabulary)


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, toxic, score, p_kind_1, p_kind_2 for each row."""
    chain = learn(docs, labels, most)
    ddl = f"doc_id {dict(docs.dtypes)['doc_id']}, toxic boolean, score double, p_kind_1 double, p_kind_2 double"
    if chain is None:
        none = F.lit(0.0)
        return docs.select("doc_id", F.lit(False).alias("toxic"), none.alias("score"), none.alias("p_kind_1"), none.alias("p_kind_2"))

    def make() -> Callable:
        lookup = Lookup(chain.vocabulary)

        def one(batch: pa.RecordBatch):
            for part in slices(batch, limit=2 << 20):
                p, verdict = score(chain, part.column("text").to_pylist(), lookup)
                yield {"doc_id": part.column("doc_id"), "toxic": verdict, "score": p["toxic"], "p_kind_1": p["kind_1"], "p_kind_2": p["kind_2"]}

        return one

    return map_batches(docs.select("doc_id", "text"), make, ddl)
