"""Benchmark decontamination by the q-gram lemma.

Texts are normalised to lower-case words joined by one space.  Benchmark items are cut into passages
(the whole item if short, else overlapping windows).  Two strings within k edits whose shorter one
has m bytes share at least m - q + 1 - k q q-grams on diagonals that drift by at most k; so shared
q-grams are counted in overlapping diagonal bands, regions that reach the bound are kept, and a banded
alignment decides.

The benchmark's q-grams are a table that every task holds; its size is checked, and a benchmark above
the bound is worked through in blocks of items, each in one pass over the documents whose result is
materialised, so that neither the driver nor a task holds more than one block.

Defined cases: null or empty documents match nothing; null or empty items, and items of fewer than
``q`` bytes, match nothing; repeated documents are rows of their own, repeated items match alike; ties
of alignments go to the first place in the text; an empty benchmark or an empty documents table leaves
everything clean; other columns are kept as they are, and a column that has the name of the added one is
an error; a text of any length is searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, fresh, map_batches, slices

Q = 10
#: Edits allowed for each byte of a passage, and the shared q-grams that a region must have at least.
EDIT_RATE, LEAST_SHARED = 0.09, 10
#: Passages: items up to WINDOW bytes are one passage, longer ones windows of WINDOW bytes every STRIDE.
WINDOW, STRIDE = 120, 60
BAND = 22
#: Bytes of benchmark text whose index one pass holds in each task.
MAX_INDEX_BYTES = 16 << 20
_WORD = re.compile(r"\w+")
_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normalise(text: str | None) -> bytes:
    return " ".join(_WORD.findall((text or "").lower())).encode("utf-8", "surrogatepass")


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit key for each window of Q bytes (8 to 16): both of its 8-byte ends, mixed."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.empty(len(data) - 7, np.uint64)
    for s in range(8):
        part = data[s : s + (len(data) - s) // 8 * 8].view(np.uint64)
        eight[s::8] = part[: len(eight[s::8])]
    key = eight[:n] * _MIX_A
    key ^= eight[Q - 8 : Q - 8 + n] * _MIX_B
    key ^= key >> np.uint64(29)
    key *= _MIX_A
    return key


@dataclass
class Index:
    passages: list[bytes]
    matrix: np.ndarray  # passages as rows of bytes
    lengths: np.ndarray
    items: list
    offsets: list[int]
    budget: np.ndarray  # edits allowed
    bound: np.ndarray  # shared q-grams needed
    keys: np.ndarray
    first: np.ndarray  # keys[k] has places first[k]:first[k + 1]
    passage_of: np.ndarray
    place_of: np.ndarray
    seen: np.ndarray  # by the top bits of a key


def build_index(items: list[tuple]) -> Index:
    """``items``: pairs of id and text."""
    passages, ids, offsets = [], [], []
    for item, text in items:
        data = normalise(text)
        if len(data) < Q:
            continue
        starts = [0] if len(data) <= WINDOW else sorted({*range(0, len(data) - WINDOW, STRIDE), len(data) - WINDOW})
        for s in starts:
            passages.append(data[s : s + WINDOW])
            ids.append(item)
            offsets.append(s)
    lengths = np.array([len(p) for p in passages], np.int64)
    room = lengths - Q + 1
    budget = np.maximum(np.minimum((EDIT_RATE * lengths).astype(np.int64), (room - LEAST_SHARED) // Q), 0)
    each = [grams(np.frombuffer(p, np.uint8)) for p in passages]
    keys = np.concatenate([*each, np.zeros(0, np.uint64)])
    passage_of = np.repeat(np.arange(len(passages)), [len(e) for e in each]).astype(np.int64)
    place_of = np.concatenate([*(np.arange(len(e)) for e in each), np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    distinct, first = np.unique(keys[order], return_index=True)
    seen = np.zeros(1 << 22, bool)
    seen[(distinct >> np.uint64(42)).astype(np.int64)] = True
    matrix = np.zeros((len(passages), WINDOW), np.uint8)
    for k, p in enumerate(passages):
        matrix[k, : len(p)] = np.frombuffer(p, np.uint8)
    return Index(passages, matrix, lengths, ids, offsets, budget, room - budget * Q, distinct, np.append(first, len(keys)).astype(np.int64), passage_of[order], place_of[order], seen)


def align(index: Index, joined: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (diagonal, passage) the least edits between the passage and a part of the text in the band, and that part's bounds.

    All bands advance together, one byte of their passages at a time.  Cell c of row j stands for the
    text up to diagonal + j + c; it holds the edits times 64 plus the cell the alignment began in.
    """
    margin = int(index.budget.max(initial=0))
    width = BAND + 2 * margin + 1
    low, passage = found[:, 0] - margin, found[:, 1]
    length = index.lengths[passage]
    cells = np.arange(width, dtype=np.int32)
    row = np.tile(cells, (len(found), 1))
    cost, start, end = (np.zeros(len(found), np.int64) for _ in range(3))
    padded = np.concatenate([np.full(width + WINDOW, 10, np.uint8), joined, np.full(width + 2 * WINDOW, 10, np.uint8)])
    base = low + width + WINDOW
    for j in range(int(length.max(initial=0)) + 1):
        if j:
            text = padded[(base + j - 1)[:, None] + cells]
            change = row + 64 * (text != index.matrix[passage, j - 1][:, None])
            change[:, :-1] = np.minimum(change[:, :-1], row[:, 1:] + 64)
            row = np.minimum.accumulate(change - 64 * cells, axis=1) + 64 * cells
        if (done := length == j).any():
            best = row[done].argmin(1)
            value = row[done, :][np.arange(len(best)), best]
            cost[done], start[done], end[done] = value >> 6, low[done] + (value & 63), low[done] + j + best
    return cost, start, end


def regions(index: Index, joined: np.ndarray) -> np.ndarray:
    """(diagonal, passage) of the bands that reach their bound; a diagonal is place in text minus place in passage.

    Budgets are at most BAND / 2, so one of the half-overlapping bands holds every diagonal of an alignment.
    A q-gram of the passage counts once in a band.
    """
    key = grams(joined)
    near = np.flatnonzero(index.seen[(key >> np.uint64(42)).astype(np.int64)])
    at = np.searchsorted(index.keys, key[near])
    at[at == len(index.keys)] = 0
    same = index.keys[at] == key[near]
    near, at = near[same], at[same]
    count = index.first[at + 1] - index.first[at]
    place = np.repeat(near, count)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(index.first[at], count)
    passage, where = index.passage_of[nth], index.place_of[nth]
    diagonal = place - where + WINDOW
    found = []
    for shift in (0, BAND // 2):
        one = np.unique(((passage << 33) | ((diagonal + shift) // BAND)) << 7 | where) >> 7
        band, hits = np.unique(one, return_counts=True)
        band = band[hits >= index.bound[band >> 33]]
        found.append(np.stack([(band & ((1 << 33) - 1)) * BAND - shift - WINDOW, band >> 33], 1))
    return np.concatenate(found)


def search(index: Index, texts: list[bytes]) -> list[list[tuple]]:
    """For each text its matches: (passage, edits, start, end), bytes of the normalised text."""
    out: list[list[tuple]] = [[] for _ in texts]
    if not texts or not len(index.keys):
        return out
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    found = regions(index, joined)
    for some in np.array_split(found, len(found) // 4096 + 1):
        cost, start, end = align(index, joined, some)
        ok = cost <= index.budget[some[:, 1]]
        for p, e, a, z in sorted(set(zip(some[ok, 1].tolist(), cost[ok].tolist(), start[ok].tolist(), end[ok].tolist(), strict=True))):
            owner = int(np.searchsorted(begins, max(a, 0), "right")) - 1
            if max(a, 0) == begins[owner + 1] - 1:  # it begins on the separator before the next text
                owner += 1
            out[owner].append((p, e, max(a - int(begins[owner]), 0), z - int(begins[owner])))
    return out


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of at most ``most`` bytes (or few items); the driver holds one at a time.

    Items are dealt to blocks by hash, and dealt to twice as many while a block is too large.
    """
    size = F.octet_length("text")
    rows = benchmark.select("item_id", "text").filter("text is not null")
    total = rows.agg(F.sum(size)).head()[0] or 0
    if not total:
        return
    if total <= most:
        yield [(r[0], r[1]) for r in rows.collect()]
        return
    n = -(-2 * total // most)
    block = lambda n: F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    while rows.groupBy(block(n).alias("block")).agg(F.sum(size).alias("held"), F.count_distinct("text").alias("items")).filter((F.col("held") > most) & (F.col("items") > 4)).limit(1).count():
        n *= 2
    for k in range(n):
        if items := [(r[0], r[1]) for r in rows.filter(block(n) == k).dropDuplicates().collect()]:
            yield items


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_index_bytes: int = MAX_INDEX_BYTES, column: str = "leaks") -> DataFrame:
    """The documents' columns and ``column``: array of (item_id, edits, start, end, item_start), empty if clean.

    start and end are bytes of the normalised text, item_start of the normalised item.
    """
    if column.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {column!r} already")
    kind = dict(benchmark.dtypes)["item_id"]
    entry = f"array<struct<item_id:{kind},edits:int,start:bigint,end:bigint,item_start:int>>"
    out = docs.withColumn(column, F.expr(f"cast(array() as {entry})"))
    ddl = ", ".join(f"`{c}` {t}" for c, t in out.dtypes)
    before = None
    for items in _blocks(benchmark, max_index_bytes):
        out = cut(out) if before is not None else out
        before = items

        def make(items: list[tuple] = items) -> Callable:
            index = build_index(items)

            def one(batch: pa.RecordBatch):
                for part in slices(batch):
                    found = search(index, [normalise(t) for t in part.column("text").to_pylist()])
                    known = part.column(column).to_pylist()
                    leaks = [
                        b + [{"item_id": index.items[p], "edits": e, "start": s, "end": z, "item_start": index.offsets[p]} for p, e, s, z in sorted(f, key=lambda x: (x[2], x[0]))]
                        for b, f in zip(known, found, strict=True)
                    ]
                    yield {c: part.column(c) for c in part.schema.names} | {column: leaks}

            return one

        out = map_batches(out, make, ddl)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold nothing of the benchmark, with all their columns."""
    leaks = fresh(docs, "leaks")
    return find_leaks(docs, benchmark, column=leaks).filter(F.size(leaks) == 0).select(*docs.columns)
