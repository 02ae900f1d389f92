"""Quality rules: how far a document's character and common-word histograms are from its language's.

Each text gives two histograms: characters by class, and words by common function word (everything
else in one bin).  Summed over all documents of a language they are that language's references.  A
document is rejected if the Jensen-Shannon distance of either histogram from its reference is above a
threshold; texts too short for a histogram to mean anything are not judged by distance.  No document
is judged by itself: its own counts are taken off the reference first, and a reference with fewer than
``MIN_REFERENCE_WORDS`` words left gives way to that of all documents, with a threshold that words of
another language do not reach.

Defined cases: null or empty text has no words and fails the base rules; a document without a
language is compared with the references of all documents together; a document with no reference at
all (it is the only one) is not judged by distance; a distance equal to its threshold is kept; repeated
rows are judged alike and each counts in the references; very long texts are judged whole, one at a
time; one output row for each input row, so an empty table gives none; other columns are kept by
:func:`good_documents` and ignored by :func:`judge`, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, fresh, map_batches, slices

#: Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in is that it for was with as on be at by this are from or have not but an they which you were all her would there been "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les du un une que est pour qui dans par plus pas au sur ne se ce avec son il sont aux mais ou "
    "el en y los las por con no una su para al lo como más pero sus le ya o este sí porque"
).split()
WORD_BINS = {w.encode(): i for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}
OTHER_WORD = len(WORD_BINS)
#: Classes of ASCII characters; every code point beyond ASCII counts as a letter class of its own.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", b".,;:'\"?-()", b"!", b"#*$%&|<>")
BLANKS, SYMBOLS = CLASSES[3], b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))

#: Distances above these reject; texts below the guards are not judged.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.27
MIN_CHARS, MIN_WORDS = 200, 50
#: References with fewer words give way to those of all languages, whose word distance may be this large.
MIN_REFERENCE_WORDS, MAX_FOREIGN_WORD_DISTANCE = 2000, 0.6


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines and words in repeated three-word windows."""
    words = data.split()
    plain = data.translate(None, BLANKS + CONTINUATION)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        count = Counter(windows)
        twice = np.fromiter((count[w] > 1 for w in windows), bool, len(windows))
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(windows)] |= twice
        repeated = int(covered.sum())
    return len(words), len(plain), symbols, len(lines) - len(set(lines)), repeated


def _class_matrix() -> np.ndarray:
    """Which class each byte counts for; bytes inside a code point count for none."""
    out = np.zeros((256, len(CLASSES) + 2), np.int64)
    for k, members in enumerate(CLASSES):
        out[list(members), k] = 1
    out[:0x80, len(CLASSES)] = 1 - out[:0x80].sum(1)
    out[0xC0:, len(CLASSES) + 1] = 1
    return out


_CLASS_OF = _class_matrix()


def char_histogram(data: bytes) -> np.ndarray:
    """Counts of code points by class: the ASCII classes, other ASCII, beyond ASCII."""
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS_OF


def word_histogram(data: bytes) -> list[int]:
    """Counts of the common words (A-Z lower-cased, edge punctuation removed) and of all others."""
    out = [0] * (OTHER_WORD + 1)
    for word, n in Counter(data.lower().translate(bytes(range(256)), b".,;:!?\"()").split()).items():
        out[WORD_BINS.get(word, OTHER_WORD)] += n
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, between 0 and 1) of rows of counts ``p`` from references ``q``; 0 where either is empty.

    The divergence that a sample of this size shows by chance, about (bins - 1) / (8 n ln 2) over the
    bins that the sample can fill, is taken off first, so that short texts are not held to be far.
    """
    total_p, total_q = p.sum(1, keepdims=True), q.sum(1, keepdims=True)
    a, b = p / np.maximum(total_p, 1), q / np.maximum(total_q, 1)
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(a > 0, a * np.log2(a / m), 0) + np.where(b > 0, b * np.log2(b / m), 0)).sum(1) / 2
    n = np.maximum(total_p[:, 0], 1)
    by_chance = np.maximum(np.minimum(1, n[:, None] * b).sum(1) - 1, 0) / (8 * n * np.log(2))
    return np.where((total_p[:, 0] > 0) & (total_q[:, 0] > 0), np.sqrt(np.clip(d - by_chance, 0, 1)), 0.0)


def references(docs: DataFrame) -> DataFrame:
    """One row for each language, and one with null for all: summed histograms as ``ref_chars``, ``ref_words``.

    Each slice of texts is summed by language before anything leaves the task.
    """

    def make() -> Callable:
        def one(batch: pa.RecordBatch):
            for part in slices(batch):
                by_lang: dict[str | None, list[bytes]] = {}
                for g, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    by_lang.setdefault(g, []).append((t or "").encode("utf-8", "surrogatepass"))
                chars = [sum(map(char_histogram, texts)).tolist() for texts in by_lang.values()]
                yield {"lang": list(by_lang), "chars": chars, "words": [np.sum([word_histogram(x) for x in texts], axis=0).tolist() for texts in by_lang.values()]}

        return one

    partial = map_batches(docs.select("lang", "text"), make, "lang string, chars array<bigint>, words array<bigint>")
    cells = partial.select("lang", F.posexplode(F.concat("chars", "words")).alias("bin", "n")).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    every = cells.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n")
    both = cells.filter(F.col("lang").isNotNull()).unionByName(every)
    whole = both.groupBy(F.col("lang").alias("ref_lang")).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("bins"))
    return whole.select("ref_lang", F.slice("bins", 1, len(CLASSES) + 2).alias("ref_chars"), F.slice("bins", len(CLASSES) + 3, OTHER_WORD + 1).alias("ref_words"))


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return np.asarray(batch.column(name).flatten(), dtype=float).reshape(batch.num_rows, -1)


#: References of so many languages are held by every task; of more, texts are dealt by language and place.
MAX_BROADCAST_LANGUAGES, PLACES = 10_000, 64
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Limits:
    max_char: float = MAX_CHAR_DISTANCE
    max_word: float = MAX_WORD_DISTANCE
    min_chars: int = MIN_CHARS
    min_words: int = MIN_WORDS


def verdicts(texts: list[str | None], own: tuple[np.ndarray, np.ndarray], all_of: tuple[np.ndarray, np.ndarray], limits: Limits) -> dict[str, np.ndarray]:
    """Base counts, base_failed, char_distance, word_distance and kept of each text.

    ``own`` and ``all_of`` are the histograms of each text's language and of all, with the text in them.
    """
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    base = np.array([base_counts(x) for x in data], np.int64).reshape(-1, len(COUNTS))
    chars = np.array([char_histogram(x) for x in data], float)
    words = np.array([word_histogram(x) for x in data], float)
    others = [np.maximum(r - x, 0) for r, x in zip(own, (chars, words), strict=True)]
    thin = others[1].sum(1) < MIN_REFERENCE_WORDS
    for k, x in enumerate((chars, words)):
        others[k][thin] = np.maximum(all_of[k] - x, 0)[thin]
    by_char, by_word = distance(chars, others[0]), distance(words, others[1])
    n, repeated = base[:, 0], base[:, 4]
    failed = (n < 50) | (100 * repeated > 50 * n)
    judged = (n >= limits.min_words) & (chars.sum(1) >= limits.min_chars)
    far = (by_char > limits.max_char) | (by_word > np.where(thin, np.maximum(limits.max_word, MAX_FOREIGN_WORD_DISTANCE), limits.max_word))
    return {c: base[:, k] for k, c in enumerate(COUNTS)} | {"base_failed": failed, "char_distance": by_char, "word_distance": by_word, "kept": ~failed & ~(judged & far)}


def _judging(docs: DataFrame, limits: Limits, emit: Callable[[pa.RecordBatch, dict[str, np.ndarray]], dict], ddl: str) -> DataFrame:
    """``emit`` makes the output of a slice of ``docs`` and its verdicts.

    The references are summed in a first pass over the texts and the rows judged in a second one, so
    no text is shuffled.
    """
    refs = cut(references(docs))
    total = refs.filter("ref_lang is null").head()
    if total is None:  # no rows at all
        total = (None, [0] * (len(CLASSES) + 2), [0] * (OTHER_WORD + 1))
    every = (np.array(total[1], float)[None], np.array(total[2], float)[None])
    lang, chars, words, place = (fresh(docs, c) for c in ("ref_lang", "ref_chars", "ref_words", "ref_place"))
    held = refs.withColumnsRenamed({"ref_lang": lang, "ref_chars": chars, "ref_words": words})
    if refs.count() <= MAX_BROADCAST_LANGUAGES:
        joined = docs.join(F.broadcast(held), F.col("lang").eqNullSafe(F.col(lang)))
    else:
        spread = held.withColumn(place, F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
        dealt = docs.withColumn(place + "_", F.pmod(F.xxhash64("text"), F.lit(PLACES)).cast("int"))
        joined = dealt.join(spread, F.col("lang").eqNullSafe(F.col(lang)) & (F.col(place + "_") == F.col(place)))

    def make() -> Callable:
        def one(batch: pa.RecordBatch):
            for part in slices(batch):
                yield emit(part, verdicts(part.column("text").to_pylist(), (matrix(part, chars), matrix(part, words)), every, limits))

        return one

    return map_batches(joined.select(*docs.columns, chars, words), make, ddl)


def good_documents(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The rows that :func:`judge` keeps, with all their columns."""
    columns = docs.columns

    def emit(part: pa.RecordBatch, found: dict[str, np.ndarray]) -> dict:
        rows = part.filter(pa.array(found["kept"]))
        return {c: rows.column(c) for c in columns}

    return _judging(docs, Limits(max_char, max_word), emit, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))


def judge(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, base counts, base_failed, both distances and kept for each document.

    ``base_failed``: fewer than 50 words, or more than half of the words lie in repeated windows.
    """

    def emit(part: pa.RecordBatch, found: dict[str, np.ndarray]) -> dict:
        return {"doc_id": part.column("doc_id")} | {c: pa.array(v) for c, v in found.items()}

    ddl = f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, char_distance double, word_distance double, kept boolean"
    return _judging(docs.select("doc_id", "lang", "text"), Limits(max_char, max_word, min_chars, min_words), emit, ddl)
