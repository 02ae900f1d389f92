"""License scans by diagonal voting, in DataFrame operations only.

Every three-word window of a text is hashed and joined to the windows of the license templates (a
small fixed table, broadcast).  A hit votes for its diagonal, its place in the text minus its place in
the template.  Votes are counted by diagonal, neighbouring diagonals are merged, and a merged span is
verified: the share of the template's words that its hits cover, its length against the template's,
and half of the template's telling windows, those that no template of another license has; a template without such windows
must be covered whole.  Of spans
that share half of the shorter one's words and differ in license, the better one stays: the one with
the greater share or, if equal, of the longer template; if these are equal too, both stay.

The base phrases are templates as well; one stands at a place if all of its windows vote for one
diagonal, and stays whatever overlaps it.  Only hits are shuffled, never texts; they are materialised
once, for the texts are long to search.

Defined cases: null text counts as empty; a text's row is known by doc_id and a hash of the text, both
null-safe, so repeated rows each get the same result; texts shorter than a window have no hits; a very
long text's hits are rows like others; other columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.llm.common import cut

WINDOW = 3
#: Neighbouring diagonals at most so far apart are merged; share of words and length ratios that verify a span.
DIAGONAL_GAP, MIN_SHARE, LENGTH_RATIOS = 4, 0.8, (0.8, 1.25)
#: Words in a stretch of text; spans of up to twice so many words meet in the stretches they touch.
STRETCH = 32

#: Phrases of the contract and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices of common licenses, as words.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, GAPS), "")


def templates() -> list[tuple[int, str, bool, list[str]]]:
    return [(k, label, k < len(BASE), phrase.split()) for k, (phrase, label) in enumerate((*BASE, *NOTICES))]


def window_rows() -> list[tuple[int, str, bool, int, int, int, bool, list[str]]]:
    """template, label, base, windows, telling windows of the template, at, telling, words."""
    labels: dict[tuple[str, ...], set[str]] = {}
    every = [(k, label, base, words, at, words[at : at + WINDOW]) for k, label, base, words in templates() for at in range(len(words) - WINDOW + 1)]
    for _, label, _, _, _, gram in every:
        labels.setdefault(tuple(gram), set()).add(label)
    tells = [len(labels[tuple(gram)]) == 1 for *_, gram in every]
    own: dict[int, int] = {}
    for (k, *_), yes in zip(every, tells, strict=True):
        own[k] = own.get(k, 0) + yes
    return [(k, label, base, len(words) - WINDOW + 1, own[k], at, yes, gram) for (k, label, base, words, at, gram), yes in zip(every, tells, strict=True)]


def template_windows(spark) -> DataFrame:
    rows = [f"({k}, '{label}', {str(base).lower()}, {windows}, {own}, {at}, {str(yes).lower()}, " + ", ".join(f"'{w}'" for w in gram) + ")" for k, label, base, windows, own, at, yes, gram in window_rows()]
    return spark.sql(f"select *, xxhash64(a, b, c) as hash from values {', '.join(rows)} as t(template, label, base, windows, n_telling, at, telling, a, b, c)")


def hits(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, a template's columns, at, telling, place): every window of every text that is one of a template's."""
    words = docs.select("doc_id", F.xxhash64("text").alias("digest"), words_of(F.col("text")).alias("words"))
    shifted = [F.slice("words", k + 1, F.greatest(F.size("words") - k, F.lit(0))) for k in range(WINDOW)]
    zipped = words.select("doc_id", "digest", F.arrays_zip(*[s.alias(n) for s, n in zip(shifted, "abc", strict=True)]).alias("windows"))
    each = zipped.select("doc_id", "digest", F.posexplode("windows").alias("place", "w"))
    each = each.select("doc_id", "digest", "place", *[F.col("w").getField(n).alias(f"w{n}") for n in "abc"])
    each = each.withColumn("hash", F.xxhash64("wa", "wb", "wc"))
    found = each.join(F.broadcast(template_windows(docs.sparkSession)), "hash").filter("wa = a and wb = b and wc = c")
    return found.select("doc_id", "digest", "template", "label", "base", "windows", "n_telling", "at", "telling", F.col("place").cast("bigint").alias("place")).distinct()


def spans(found: DataFrame) -> DataFrame:
    """Verified spans: doc_id, digest, template, label, base, start, end (words, end exclusive), score, n (template's words)."""
    text = ["doc_id", "digest", "template", "label", "base", "windows", "n_telling"]
    told = F.collect_set(F.when(F.col("telling"), F.col("at")))
    diagonals = found.withColumn("diagonal", F.col("place") - F.col("at")).groupBy(*text, "diagonal")
    diagonals = diagonals.agg(F.count("*").alias("votes"), F.min("place").alias("low"), F.max("place").alias("high"), F.collect_set("at").alias("ats"), told.alias("told"))
    n = F.col("windows") + WINDOW - 1
    out = [*text[:5], "start", "end", "score", "n"]
    exact = diagonals.filter("base and votes = windows").withColumns({"start": F.col("diagonal"), "end": F.col("diagonal") + n, "score": F.lit(1.0), "n": n})
    line = W.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(line) > DIAGONAL_GAP
    merged = diagonals.filter("not base").withColumn("group", F.sum(F.when(apart, 1).otherwise(0)).over(line))
    join = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    merged = merged.groupBy(*text, "group").agg(join("ats").alias("ats"), join("told").alias("told"), F.min("low").alias("start"), (F.max("high") + WINDOW).alias("end"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + WINDOW - 1)))))
    merged = merged.withColumns({"n": n, "score": covered / n})
    ratio = (F.col("end") - F.col("start")) / F.col("n")
    close = merged.filter((F.col("score") >= MIN_SHARE) & ratio.between(*LENGTH_RATIOS) & (2 * F.size("told") >= F.col("n_telling")) & ((F.col("n_telling") > 0) | (F.col("score") == 1)))
    return best(exact.select(*out).unionByName(close.select(*out)))


def best(found: DataFrame) -> DataFrame:
    """The spans that are base phrases or are not outdone by an overlapping span of another license."""
    stretch = F.explode(F.sequence(F.expr(f"start div {STRETCH}"), F.expr(f"(end - 1) div {STRETCH}"))).alias("stretch")
    mine = found.filter("not base").select("*", stretch)
    other = found.select(*[F.col(c).alias(f"o_{c}") for c in ("doc_id", "digest", "label", "start", "end", "score", "n")], stretch)
    same = F.col("doc_id").eqNullSafe(F.col("o_doc_id")) & (F.col("digest") == F.col("o_digest")) & (mine["stretch"] == other["stretch"])
    shared = F.least("end", "o_end") - F.greatest("start", "o_start")
    half = 2 * shared >= F.least(F.col("end") - F.col("start"), F.col("o_end") - F.col("o_start"))
    better = (F.col("o_score") > F.col("score")) | ((F.col("o_score") == F.col("score")) & (F.col("o_n") > F.col("n")))
    lost = mine.join(other, same & (F.col("label") != F.col("o_label")) & half & better).select("doc_id", "digest", "template", "start").distinct()
    lost = lost.withColumnsRenamed({c: f"l_{c}" for c in lost.columns})
    out = F.col("doc_id").eqNullSafe(F.col("l_doc_id")) & (F.col("digest") == F.col("l_digest")) & (F.col("template") == F.col("l_template")) & (F.col("start") == F.col("l_start")) & ~F.col("base")
    return found.join(lost, out, "left_anti")


def scan(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row."""
    by_text = cut(spans(cut(hits(docs)))).groupBy("doc_id", "digest").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    by_text = by_text.withColumnsRenamed({"doc_id": "of_doc", "digest": "of_digest"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    both = rows.join(by_text, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("digest") == F.col("of_digest")), "left")
    return both.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def sql() -> str:
    """DuckDB's version of :func:`scan` for tables whose doc_id is a key.

    Only the templates are shared: which windows tell is found in SQL, and spans are compared pairwise.
    """
    rows = [f"({k}, '{label}', {str(base).lower()}, '{' '.join(words)}')" for k, label, base, words in templates()]
    return f"""
with phrase(template, label, base, words) as (values {', '.join(rows)}),
cuts as (select template, label, base, string_split(words, ' ') as w, unnest(range(len(string_split(words, ' ')) - 2)) as place_in from phrase),
grams as (select template, label, base, len(w) as n, place_in, w[place_in + 1] || ' ' || w[place_in + 2] || ' ' || w[place_in + 3] as gram from cuts),
t as (select *, (select count(distinct o.label) from grams o where o.gram = grams.gram) = 1 as telling from grams),
tells as (select template, count(*) filter (telling) as n_telling from t group by template),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
g as (select doc_id, w, unnest(range(len(w) - 2)) as place from d where len(w) >= 3),
h as (select distinct doc_id, template, label, base, n, place_in, telling, place
      from (select doc_id, place, w[place + 1] || ' ' || w[place + 2] || ' ' || w[place + 3] as gram from g) join t using (gram)),
exact as (select doc_id, template, label, base, n, place - place_in as start, place - place_in + n as stop, 1.0::double as score
          from h where base group by all having count(*) = any_value(n) - 2),
lines as (select *, place - place_in as diagonal from h where not base),
steps as (select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal, place) > 4 then 1 else 0 end as step from lines),
groups as (select *, sum(step) over (partition by doc_id, template order by diagonal, place) as part from steps),
words as (select distinct doc_id, template, part, place_in + k as word from groups, (values (0), (1), (2)) x(k)),
covered as (select doc_id, template, part, count(*) as n_covered from words group by all),
merged as (select doc_id, template, part, label, base, n, min(place) as start, max(place) + 3 as stop, count(distinct place_in) filter (telling) as told from groups group by all),
close as (select doc_id, template, label, base, n, start, stop, n_covered::double / n as score
          from merged join covered using (doc_id, template, part) join tells using (template)
          where n_covered::double / n >= 0.8 and (stop - start)::double / n between 0.8 and 1.25 and 2 * told >= n_telling and (n_telling > 0 or n_covered = n)),
s as (select * from exact union all select * from close),
kept as (select * from s where base or not exists (select 1 from s o where o.doc_id = s.doc_id and o.label <> s.label
           and 2 * (least(o.stop, s.stop) - greatest(o.start, s.start)) >= least(o.stop - o.start, s.stop - s.start)
           and (o.score > s.score or (o.score = s.score and o.n > s.n)))),
a as (select doc_id, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
      string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(score) as score from kept group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join a using (doc_id)"""
