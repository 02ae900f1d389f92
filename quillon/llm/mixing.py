"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled by the digest of their ids, form one stream of words that is cut
into blocks of nearly equal length.  Slot i of the schedule has the point i * g mod 2^31 (g: 2^31 over
the golden ratio, made odd), which the cumulative weights map to a source; the slot's rank among the
slots of its source names the block it takes, going round the blocks again as the rank grows.  Any run
of slots therefore holds the sources close to their weights.

:func:`mix` shuffles no text, :func:`take` shuffles rows once to join them with what is taken.  No source
is gathered: stream offsets and ranks are prefix sums in levels, over buckets or chunks and within each
of them.  Only sources themselves, one row for each, are sorted in one task.

Defined cases: null text has size 0 and is taken 0 times; null sources form one source that comes
last; documents are placed by the digest of id and text, so those without an id lie apart; rows that
repeat an id, source and text are counted first and lie side by side, each with a place of its own; no
two other rows tie; a source without words has target 0; a text of any length is one stretch of
its stream; an empty table gives no rows; other columns are ignored by :func:`mix` and kept by :func:`take`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.llm.common import cut, fresh

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Words in a block, and the blocks that a source has at least (if it has that many words).
BLOCK_WORDS, MIN_BLOCKS = 256, 256
#: The circle of the schedule's points and the golden step on it.
CIRCLE, GOLDEN = 1 << 31, 1327217885
SLOTS_PER_CHUNK, CELLS = 1024, 4096
#: Chunks in a group of chunks, and rows that a bucket should have at most.
CHUNKS_PER_GROUP, BUCKET_ROWS = 4096, 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row for each source: sid, source, source_size, target.  Targets share all words by weight under the cap."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = W.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    table = totals.withColumn("sid", F.row_number().over(one).cast("bigint") - 1)
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")).cast("bigint"))
    table = table.withColumn("most", F.col("source_size") * max_repeats).withColumn("ratio", F.col("most") / F.col("weight"))
    before = W.orderBy("ratio", "sid").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    left = lambda x: F.sum(x).over(every) - F.coalesce(F.sum(x).over(before), F.lit(0))
    table = table.withColumn("words", F.sum("source_size").over(every))
    # in order of ratio, a source is capped if the level of those not yet capped would pass its cap
    level = (F.col("words") - F.coalesce(F.sum("most").over(before), F.lit(0))) / left("weight")
    table = table.withColumn("capped", F.col("ratio") <= level)
    spare = F.col("words") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(every), F.lit(0))
    share = spare / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(share * F.col("weight"))
    return table.select("sid", "source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _plan(targets: DataFrame, block_words: int, max_repeats: int) -> DataFrame:
    """Adds each source's number of blocks, their length and its stretch [low, high) of the circle."""
    size = F.col("source_size")
    table = targets.withColumn("blocks", F.greatest(F.ceil(size / block_words), F.least(size, F.lit(MIN_BLOCKS))).cast("bigint"))
    table = table.withColumn("per", F.when(F.col("blocks") > 0, F.expr("source_size div blocks")).otherwise(0)).withColumn("longer", F.when(F.col("blocks") > 0, size % F.col("blocks")).otherwise(0))
    table = table.withColumn("wanted", F.when(size > 0, F.col("target") * F.col("blocks") / size).otherwise(0.0))
    upto, every = W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    total = F.sum("wanted").over(every)
    table = table.withColumn("slots", F.round(total).cast("bigint")).withColumn("high", F.round(F.sum("wanted").over(upto) / total * CIRCLE).cast("bigint"))
    return table.withColumn("low", F.coalesce(F.lag("high").over(W.orderBy("sid")), F.lit(0)))


def _before(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before, within ``keys`` by ``order``."""
    line = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(line), F.lit(0)))


def schedule(plan: DataFrame, slots: int, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """slot, sid, block: which block of which source each slot takes."""
    spark = plan.sparkSession
    width = CIRCLE // CELLS
    cells = plan.filter("high > low").select("sid", "blocks", "low", "high", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell"))
    parts = max(1, min(100_000, slots // 200_000 + 1))
    line = spark.range(0, slots, 1, parts).select(F.col("id").alias("slot"), ((F.col("id") % CIRCLE) * GOLDEN % CIRCLE).alias("point")).withColumn("cell", F.expr(f"point div {width}"))
    placed = line.join(cells, "cell").filter("point >= low and point < high").select("slot", "sid", "blocks", F.expr(f"slot div {SLOTS_PER_CHUNK}").alias("chunk"))
    chunks = placed.groupBy("sid", "chunk").count().withColumn("group", F.expr(f"chunk div {CHUNKS_PER_GROUP}"))
    if slots > SLOTS_PER_CHUNK * CHUNKS_PER_GROUP:
        groups = _before(chunks.groupBy("sid", "group").agg(F.sum("count").alias("held")), ["sid"], "group", "held", "base").drop("held")
        before = _before(chunks, ["sid", "group"], "chunk", "count", "inside").join(groups, ["sid", "group"])
        before = before.select("sid", "chunk", (F.col("inside") + F.col("base")).alias("before"))
    else:
        before = _before(chunks, ["sid"], "chunk", "count", "before").select("sid", "chunk", "before")
    inside = placed.withColumn("rank", F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    ranked = inside.join(before, ["sid", "chunk"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.filter(F.col("rank") < F.col("blocks") * max_repeats).select("slot", "sid", (F.col("rank") % F.col("blocks")).alias("block"))


def _block_of(at: str) -> str:
    edge = "longer * (per + 1)"
    return f"case when {at} < {edge} then ({at}) div (per + 1) else longer + (({at}) - {edge}) div per end"


def _start_of(block: str) -> str:
    return f"({block}) * per + least({block}, longer)"


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row: doc_id, source, digest (of the text), copy, size, source_size, target, taken.

    ``copy`` numbers the rows that agree in doc_id, source and text.  ``taken``: words that the mix
    takes of this row, repeats counted.
    """
    own = ["doc_id", "source", "digest", "size"]
    sized = cut(docs.select("doc_id", "source", F.xxhash64("text").alias("digest"), word_count(F.col("text")).alias("size")))
    plan = cut(_plan(source_targets(sized, weights, max_repeats), block_words, max_repeats))
    slots = plan.agg(F.max("slots")).head()[0] or 0

    digits = 3
    while 16**digits * BUCKET_ROWS < sized.count():
        digits += 1
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest").cast("string"), F.lit("mix")))
    placed = _with_plan(sized.groupBy(*own).agg(F.count("*").alias("copies")), plan)
    placed = placed.withColumns({"key": key, "bucket": F.substring(key, 1, digits), "held": F.col("size") * F.col("copies")})
    sums = _before(placed.groupBy("sid", "bucket").agg(F.sum("held").alias("held")), ["sid"], "bucket", "held", "base").drop("held")
    line = W.partitionBy("sid", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    rows = placed.withColumn("at", F.coalesce(F.sum("held").over(line), F.lit(0))).join(sums, ["sid", "bucket"])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    rows = rows.withColumn("at", F.col("at") + F.col("base") + F.col("copy") * F.col("size"))

    first, last = _block_of("at"), _block_of("at + size - 1")
    pieces = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(first), F.expr(last)))))
    pieces = pieces.withColumn("part", F.expr(f"least(at + size, {_start_of('block + 1')}) - greatest(at, {_start_of('block')})"))
    takes = schedule(plan, slots, max_repeats).groupBy("sid", "block").agg(F.count("*").alias("times"))
    joined = pieces.join(takes, ["sid", "block"], "left")
    keys = ["doc_id", "source", "digest", "copy", "size", "source_size", "target"]
    return joined.groupBy("sid", *keys).agg(F.coalesce(F.sum(F.col("part") * F.col("times")), F.lit(0)).cast("bigint").alias("taken")).select(*keys, "taken")


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, with size, source_size, target and taken.

    A name that ``docs`` has already gets _ appended.  Rows that repeat an id, source and text are
    numbered by a hash of their other columns.
    """
    plan = mix(docs, weights, max_repeats).filter("taken > 0")
    names = {c: fresh(docs, c) for c in ("size", "source_size", "target", "taken")}
    marks = {c: fresh(docs, f"__{c}") for c in ("doc_id", "source", "digest", "copy")}
    plan = plan.withColumnsRenamed(names | marks)
    digest, nth = fresh(docs, "__own_digest"), fresh(docs, "__nth")
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rows = docs.withColumn(digest, F.xxhash64("text"))
    same = W.partitionBy("doc_id", "source", digest).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
    rows = rows.withColumn(nth, F.row_number().over(same) - 1)
    on = F.col("doc_id").eqNullSafe(F.col(marks["doc_id"])) & F.col("source").eqNullSafe(F.col(marks["source"])) & (F.col(digest) == F.col(marks["digest"])) & (F.col(nth) == F.col(marks["copy"]))
    return rows.join(plan, on).select(*docs.columns, *names.values())


def _with_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    plan = plan.select(F.col("source").alias("plan_source"), "sid", "source_size", "target", "blocks", "per", "longer")
    return sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
