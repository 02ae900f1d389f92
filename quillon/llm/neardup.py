"""Near-duplicate documents by min-max hashing.

Each permutation gives two signature values, the least and the greatest image of the set, so half as
many hash evaluations fill the bands.  Documents with equal shingle sets are one node.  Nodes that
share a band form a group; no group's pairs are written out.  Instead every member is compared with
the group's hub, its smallest set h, which is exact by this lemma: if w and a have similarity t or
more and h is no larger than both, then either both are similar to h (and so connected), or w and a
share a shingle outside h.  A group in which some member is not similar to the hub is therefore
settled by an inverted index of the shingles outside the hub: in one task if these are few, else by
dividing it by those shingles, rarest first and only as many as the overlap bound asks for, and
treating each part in the same way.  Parts never hold the hubs above them, so this ends.

Defined cases: null text, or text without words, has an empty set, links with nothing and is its own
component; with fewer than five words the whole sequence is one shingle; repeated rows are copies of
each other; a component's id is its smallest non-null doc_id, and null if all its ids are null; an
empty table gives no rows; other columns are ignored, whatever their names; ties (equal sizes) go to
the smallest node digest; a very long text is one row whose set is held whole by one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.llm.common import bounded_batches, cut, fresh, lists, map_batches, slices

SHINGLE = 5
#: Link if 100 * intersection >= percent * union, by default this percent.
PERCENT = 85
#: Each band takes both values of ROWS / 2 permutations; a pair at the threshold shares no band with at most this probability.
ROWS, MISS = 4, 4e-7
#: Parts whose members differ from their hub in at most so many shingles in all are settled in one task.
TASK_ELEMENTS = 400_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit scrambling."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_BAND_TURNS = (mix(np.arange(900, 900 + ROWS, dtype=np.uint64)) | np.uint64(1))[None, :]


def bands_for(percent: int) -> int:
    """Bands that keep the probability of missing a pair at the threshold: 20 at 85, 28 at 80."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


@cache
def _permutations(bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors and shifts of the permutations, and a salt for each band."""
    n = bands * ROWS // 2
    turns = (mix(np.arange(100, 100 + n, dtype=np.uint64)) | np.uint64(1))[:, None]
    return turns, mix(np.arange(500, 500 + n, dtype=np.uint64))[:, None], mix(np.arange(990, 990 + bands, dtype=np.uint64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each UTF-8 text its sorted distinct shingle hashes (int64)."""
    if not texts:
        return []
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))  # text ends in a space, so starts and ends alternate
    start, end = edge[0::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), _BASE), dtype=np.uint64)])
    word = mix((total[end] - total[start]) * _powers(len(data), _INVERSE)[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, begins)  # number of the first word of each text
    grams = np.zeros(max(len(word) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        grams += word[k : k + len(grams)] * _PLACES[k]
    grams = mix(grams).view(np.int64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix((word[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + _PLACES[b - a : b - a + 1]).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def band_keys(shingles: np.ndarray, bands: int) -> np.ndarray:
    """The band keys of a non-empty set: hashes of the least and greatest images under each permutation."""
    turns, shifts, salt = _permutations(bands)
    image = shingles.view(np.uint64)[None, :] * turns + shifts
    both = np.stack([image.min(1), image.max(1)], 1).reshape(bands, ROWS)
    return mix((mix(both) * _BAND_TURNS).sum(1, dtype=np.uint64) + salt).view(np.int64)


def nodes_of(texts: list[str | None]) -> list[bytes | None]:
    """Digests of the shingle sets of texts, null for empty ones, as in ``sketch``."""
    return [_digest(s) if len(s) else None for s in shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in texts])]


def sketch(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For each row: doc_id, digest (of the text), n_shingles, node (digest of the set; null if empty) and its band keys."""
    bands = bands_for(percent)

    def make() -> Callable:
        def one(batch: pa.RecordBatch):
            for part in slices(batch):
                sets = shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()])
                yield {
                    "doc_id": part.column("doc_id"),
                    "digest": part.column("digest"),
                    "n_shingles": [len(s) for s in sets],
                    "node": [_digest(s) if len(s) else None for s in sets],
                    "bands": lists([band_keys(s, bands) if len(s) else None for s in sets]),
                }

        return one

    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("digest"), "text"), make, f"doc_id {dict(docs.dtypes)['doc_id']}, digest bigint, n_shingles bigint, node binary, bands array<bigint>")


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its whole set, for the nodes of ``wanted`` (node, rep: a doc_id that has it)."""
    rows = docs.select("doc_id", "text").join(wanted.select(F.col("rep")).distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")

    def make() -> Callable:
        def one(batch: pa.RecordBatch):
            for part in slices(batch):
                sets = shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()])
                yield {"node": [_digest(s) for s in sets], "shingles": lists(sets)}

        return one

    return map_batches(rows.select("text"), make, "node binary, shingles array<bigint>").dropDuplicates(["node"])


def needed(own: int, other: int, percent: int = PERCENT) -> int:
    """Least intersection of linked sets of these sizes."""
    return -(-percent * (own + other) // (100 + percent))


def compare(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``pairs`` (part, hub, node) tested on full sets.

    Adds n and hub_n (sizes), linked, extra (the node's shingles outside the hub), missing (the hub's
    outside the node) and need: how many of the extra shingles, in any fixed order, must hold one that
    a linked partner in the part shares.
    """
    hubs = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles"))
    both = spread_join(pairs.join(sets, "node"), pairs, hubs, "hub")

    def make() -> Callable:
        def one(batch: pa.RecordBatch):
            for low in range(0, batch.num_rows, COMPARED_ROWS):
                yield _compared(batch.slice(low, COMPARED_ROWS), percent)

        return one

    ddl = "part bigint, hub binary, node binary, n bigint, hub_n bigint, linked boolean, extra array<bigint>, missing array<bigint>, need int"
    return map_batches(both.select("part", "hub", "node", "shingles", "hub_shingles"), make, ddl)


#: Rows whose differences a task holds at a time.
COMPARED_ROWS = 256


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as views of its values."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _compared(batch: pa.RecordBatch, percent: int) -> dict:
    out: dict[str, list] = {c: [] for c in ("n", "hub_n", "linked", "extra", "missing", "need")}
    for w, h in zip(rows_of(batch.column("shingles")), rows_of(batch.column("hub_shingles")), strict=True):
        at = np.searchsorted(h, w)
        at[at == len(h)] = 0
        same = h[at] == w
        shared = int(same.sum())
        absent = np.ones(len(h), bool)
        absent[at[same]] = False
        least = max(1, needed(len(w), max(len(h), -(-percent * len(w) // 100)), percent) - shared)
        row = (len(w), len(h), 100 * shared >= percent * (len(w) + len(h) - shared), w[~same], h[absent], len(w) - shared - least + 1)
        for name, value in zip(out, row, strict=True):
            out[name].append(value)
    return {c: batch.column(c) for c in ("part", "hub", "node")} | out | {"extra": lists(out["extra"]), "missing": lists(out["missing"])}


#: A key is hot if it has more rows than one in HOT_SHARE and than 100, so at most HOT_SHARE keys are; its rows are dealt to so many places.
HOT_SHARE, PLACES = 500, 32


def spread_join(left: DataFrame, keys: DataFrame, right: DataFrame, key: str, by: str = "node") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each ``key``; rows of hot keys are dealt to several tasks ``by`` a column.

    ``keys`` (materialised) holds the keys of ``left``'s rows.  At most HOT_SHARE keys are hot, so the
    list that the driver gets is bounded; it is written to no file.
    """
    total = keys.count()
    hot = [r[0] for r in keys.groupBy(key).count().filter(F.col("count") > max(100, total // HOT_SHARE)).select(key).collect()]
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin([bytes(k) if isinstance(k, bytearray) else k for k in hot])
    place = F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(PLACES))).otherwise(0).cast("int")
    places = F.when(is_hot, F.sequence(F.lit(0), F.lit(PLACES - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("place", place).join(right.withColumn("place", F.explode(places)), [key, "place"])


def settle(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) inside whole parts of bounded size: enough of them to connect all that are linked.

    The rows of a part are streamed to one task, which holds one part at a time and needs only what
    each member has outside the hub and lacks of it.
    """
    bounded_batches(rows.sparkSession)
    ordered = rows.repartition("part").sortWithinPartitions("part", "node")
    columns = ("part", "node", "n", "hub_n", "linked", "extra", "missing")
    want = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def task(batches):
        held: list[tuple] = []
        now = None
        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in columns[:5]]
            part = plain[0]
            for row in zip(*plain, *(rows_of(batch.column(c)) for c in columns[5:]), strict=True):
                if row[0] != now and held:
                    yield pa.RecordBatch.from_pylist(_links_of(held, percent), schema=want)
                    held = []
                now = row[0]
                # views of a batch are copied, as a part may go on in the next one
                held.append(row[1:] if part[-1] != now else (*row[1:5], row[5].copy(), row[6].copy()))
        if held:
            yield pa.RecordBatch.from_pylist(_links_of(held, percent), schema=want)

    return ordered.select(*columns).mapInArrow(task, "a binary, b binary")


def _links_of(members: list[tuple], percent: int) -> list[dict]:
    """Spanning links among members (node, n, hub_n, linked, extra, missing) of one part.

    Only pairs with an unlinked member that share a shingle outside the hub can be new links.
    """
    node, n, hub_n, linked, extra, missing = zip(*members, strict=True)
    size, hub = np.array(n), hub_n[0]
    lacks = np.array([len(x) for x in missing])
    outside, lacking = _Postings(extra), _Postings(missing)
    root = list(range(len(node)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    first = next((i for i, x in enumerate(linked) if x), None)
    for i, x in enumerate(linked):
        if x:
            root[i] = first
    out = []
    for i in (i for i, x in enumerate(linked) if not x):
        count = outside.shared(i, len(node))
        if count is None:
            continue
        count[i] = 0
        others = np.flatnonzero(count)
        both = lacking.shared(i, len(node))
        inter = hub - lacks[i] - lacks[others] + count[others] + (0 if both is None else both[others])
        for j in others[100 * inter >= percent * (size[i] + size[others] - inter)].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out.append({"a": node[i], "b": node[j]})
    return out


class _Postings:
    """Which of several sets hold each element that at least two of them hold."""

    def __init__(self, sets: tuple[np.ndarray, ...]) -> None:
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        values = np.concatenate([np.zeros(0, np.int64), *sets])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        starts = np.flatnonzero(np.diff(values, prepend=values[:1] - 1)) if len(values) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(values))
        self.holders = [owner[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a > 1]
        self.of: dict[int, list[int]] = {}
        for k, who in enumerate(self.holders):
            for i in who.tolist():
                self.of.setdefault(i, []).append(k)

    def shared(self, i: int, n: int) -> np.ndarray | None:
        """How many elements each set shares with set ``i``; None if no other set shares any."""
        mine = self.of.get(i)
        return np.bincount(np.concatenate([self.holders[k] for k in mine]), minlength=n) if mine else None


def with_hubs(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (part, key, node, n) dealt into groups by ``key``: (part, hub, node), without the hubs themselves."""
    hubs = rows.groupBy(key).agg(F.min(F.struct("n", "node")).alias("least"), F.count("*").alias("members")).filter("members > 1").select(key, F.col("least.node").alias("hub"))
    return rows.join(hubs, key).filter(F.col("node") != F.col("hub")).select(F.xxhash64("part", "hub").alias("part"), "hub", "node").distinct()


def divide(tested: DataFrame) -> DataFrame:
    """The parts that too large groups fall into: (part, hub, node) pairs to test next."""
    rows = tested.filter("need > 0").select("part", "node", "n", "linked", "need", F.explode("extra").alias("shingle"))
    often = rows.groupBy("part", "shingle").agg(F.count("*").alias("often"))
    order = W.partitionBy("part", "node").orderBy("often", "shingle")
    prefix = rows.join(often, ["part", "shingle"]).withColumn("nth", F.row_number().over(order)).filter("nth <= need and often > 1")
    prefix = prefix.withColumn("group", F.xxhash64("part", "shingle"))
    live = prefix.groupBy("group").agg(F.count("*").alias("members"), F.min("linked").alias("all_linked")).filter("members > 1 and not all_linked").select("group")
    return with_hubs(prefix.join(live, "group", "left_semi").select("part", "group", "node", "n"), "group")


def links(docs: DataFrame, sketches: DataFrame, task_elements: int = TASK_ELEMENTS, percent: int = PERCENT) -> DataFrame | None:
    """Pairs (a, b) of nodes that are linked on full sets; enough of them to connect every linked pair."""
    nodes = sketches.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    rows = nodes.select(F.lit(0).cast("bigint").alias("part"), F.explode("bands").alias("band"), "node", "n")
    pairs = cut(with_hubs(rows, "band"))
    if pairs.isEmpty():
        return None
    members = pairs.select("node").union(pairs.select(F.col("hub").alias("node"))).distinct()
    sets = cut(full_sets(docs, nodes.select("node", "rep").join(members, "node", "left_semi")))
    found = None
    while True:
        tested = cut(compare(pairs, sets, percent))
        linked = tested.filter("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
        cost = F.sum(F.size("extra") + F.size("missing") + 8)
        parts = tested.groupBy("part").agg(F.count("*").alias("members"), F.min("linked").alias("all_linked"), cost.alias("cost"))
        parts = cut(parts.filter("members > 1 and not all_linked").select("part", (F.col("cost") <= task_elements).alias("small")))
        inside = cut(settle(tested.join(parts.filter("small"), "part", "left_semi"), percent))
        found = linked.union(inside) if found is None else found.union(linked).union(inside)
        large = parts.filter("not small")
        if large.isEmpty():
            return found.distinct()
        pairs = cut(divide(tested.join(large, "part", "left_semi")))
        if pairs.isEmpty():
            return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that it can reach.

    Alternating large and small stars: each round joins nodes to the smallest neighbour known, until
    every component is one star.  The edges of a star with very many rays are dealt to several tasks.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    print_of = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head()
    last = print_of(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = spread_join(both.filter("b > a"), both, least, "a", "b").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, large, least, "a", "b")
        now = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").union(least.select("a", F.col("m").alias("b"))).distinct())
        this = print_of(now)
        if this == last:
            roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        last = this


def forest(edges: Iterable[tuple[bytes, bytes]]) -> dict[bytes, bytes]:
    """For every node of ``edges`` its root, the smallest node that it can reach."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        low, high = sorted(find(root.setdefault(x, x)) for x in (a, b))
        root[high] = low
    return {x: find(x) for x in list(root)}


def few_components(edges: DataFrame) -> dict[bytes, bytes]:
    """What ``components`` gives, node: root, for tables with a bounded number of nodes.

    The driver joins the forests that the tasks make of their edges; none has more edges than there are
    nodes.  So there are no rounds, each of which costs a dozen stages even for few rows.
    """
    want = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def task(batches):
        root = forest((a, b) for batch in batches for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
        yield pa.RecordBatch.from_pylist([{"a": x, "b": r} for x, r in root.items() if x != r], schema=want)

    return forest((bytes(a), bytes(b)) for a, b in edges.select("a", "b").mapInArrow(task, "a binary, b binary").collect())


def near_duplicates(docs: DataFrame, task_elements: int = TASK_ELEMENTS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row, and component (a node that stands for it; null if empty)."""
    sketches = cut(sketch(docs, percent))
    found = links(docs, sketches, task_elements, percent)
    nodes = sketches.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).withColumn("component", F.col("node"))
    if found is not None:
        rooted = cut(components(found))
        by_root = rooted.join(nodes, "node").groupBy("root").agg(F.min("least").alias("low"))
        nodes = nodes.join(spread_join(rooted, rooted, by_root, "root").select("node", "root", "low"), "node", "left")
        nodes = nodes.select("node", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("low")).alias("least"), "copies", F.coalesce("root", "node").alias("component"))
    # rows without a set, and those of the at most HOT_SHARE sets with very many copies, are not shuffled
    many = max(100, sketches.count() // HOT_SHARE)
    nodes = cut(nodes)
    rows = sketches.select("doc_id", "n_shingles", "digest", "node")
    hot = F.broadcast(nodes.filter(F.col("copies") > many).select(F.col("node").alias("hot_node"), F.col("least").alias("hot_least"), F.col("component").alias("hot_component")))
    rows = rows.join(hot, F.col("node") == F.col("hot_node"), "left")
    apart = F.col("node").isNull() | F.col("hot_node").isNotNull()
    done = rows.filter(apart).select("doc_id", "n_shingles", "digest", "node", F.col("hot_least").alias("least"), F.col("hot_component").alias("component"))
    rest = rows.filter(~apart).select("doc_id", "n_shingles", "digest", "node").join(nodes.select("node", "least", "component"), "node", "left")
    out = done.unionByName(rest)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "component", "digest")


def key_of(name: str) -> Column:
    """An id as text that is never null."""
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest doc_id.

    Rows without words stay.  Of rows that repeat an id and a text one stays.
    """
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    found = near_duplicates(docs, percent=percent).filter("component is not null and kept")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("first")).select(key_of("first.doc_id").alias("__id"), F.col("first.digest").alias("__digest"))
    mark_id, mark_digest = fresh(docs, "__id"), fresh(docs, "__digest")
    first = first.withColumnsRenamed({"__id": mark_id, "__digest": mark_digest})
    rows = docs.filter(~wordless).withColumn(mark_id, key_of("doc_id")).withColumn(mark_digest, F.xxhash64("text"))
    # the join's partitioning serves to drop repeats, so texts are shuffled once
    rows = rows.join(first, [mark_id, mark_digest], "left_semi")
    return rows.dropDuplicates([mark_id, mark_digest]).select(*docs.columns).unionByName(docs.filter(wordless))
