"""Copies in the bounded sample of toxicity are grouped in few stages, and as near_duplicates groups them."""

import random

from pyspark.sql import functions as F

from quillon.llm import neardup, toxicity

PARTITIONS = 8


def sample(spark):
    """Chains of near copies, exact copies, texts of their own and texts without words."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(6))
    rows = []
    for _ in range(4):
        w = [word() for _ in range(150)]
        for k in range(12):
            rows.append(" ".join(w))
            w[10 * k + 5] = word()
    rows += [rows[0]] * 5 + [" ".join(word() for _ in range(80)) for _ in range(30)] + ["one two"] * 2 + ["", None, " "]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint"), rows


def test_copies_are_those_of_near_duplicates(spark):
    docs, texts = sample(spark)
    kinds = toxicity.copies(docs.select("doc_id", "text"))
    mine = {i: kinds[n] for i, n in enumerate(neardup.nodes_of(texts)) if n in kinds}
    theirs: dict = {}
    for r in neardup.near_duplicates(docs).filter("component is not null").collect():
        theirs.setdefault(r.component_id, set()).add(r.doc_id)
    groups: dict = {}
    for i, k in mine.items():
        groups.setdefault(k, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(x) for x in theirs.values() if len(x) > 1)
    assert sorted(map(len, groups.values())) == [2, 12, 12, 12, 17]


def test_components_of_few_nodes(spark):
    rng = random.Random(4)
    code = lambda x: x.to_bytes(2, "big")
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7)]
    df = spark.createDataFrame([(code(a), code(b)) for a, b in edges], "a binary, b binary").repartition(5)
    want = {bytes(r.node): bytes(r.root) for r in neardup.components(df).collect()}
    got = neardup.few_components(df)
    assert {n: r for n, r in got.items() if n in want} == want and all(n == r for n, r in got.items() if n not in want)
    assert neardup.few_components(df.limit(0)) == {}


def test_learning_takes_few_tasks(spark):
    """Tasks leave files and entries of the log whatever they hold, so their number is the disk that a small sample takes."""
    docs, texts = sample(spark)
    labels = spark.range(len(texts)).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    held = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext
    for k, v in held.items():
        spark.conf.set(k, v)
    first = max(sc.statusTracker().getJobIdsForGroup(None) or [-1])
    try:
        toxicity.learn(docs.repartition(PARTITIONS), labels)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(None) if j > first for s in sc.statusTracker().getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := sc.statusTracker().getStageInfo(s)) is not None)
    assert 0 < tasks < 80 * PARTITIONS, tasks
