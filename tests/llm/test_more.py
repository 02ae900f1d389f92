"""More of the corpus operators against brute force: hostile pages, schedules, distances, odd tables, the pipeline."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontam, htmlmain, langid, licenses, mixing, neardup, quality, secrets, toxicity

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, DOC + extra)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(11)
    return ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(500)]


# --- licenses
def test_license_versions_and_overlaps(spark):
    texts = {
        1: ("Licensed under the GNU General Public License version 3", "gpl-3"),
        2: ("x Licensed under the GNU General Public License version 2 y", "gpl-2"),
        3: ("Licensed under the GNU General Public License version 4", ""),
        4: ("Licensed under CC BY NC SA 4 0", "cc-by-nc"),
        5: ("unless required by applicable law or agreed in writing software distributed under this license is distributed on an as is basis", "apache-2"),
        6: ("Licensed under the Apache License, Version 2.0", "apache-2"),
        7: (None, ""),
        8: ("mit " * 20000 + "under the MIT license", "mit"),
    }
    got = {r.doc_id: r.labels for r in licenses.scan(table(spark, [(k, t, "en", "s", 0) for k, (t, _) in texts.items()])).collect()}
    assert got == {k: want for k, (_, want) in texts.items()}
    assert licenses.scan(table(spark, [])).count() == 0


# --- pages
@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x" + "</div>" * 100_000, "<a " + "\"'" * 5000, "<a x " * 200_000, "<b>" * 30_000 + "</x>" * 30_000 + "<hr>" * 30_000, "<!--" * 100_000, "<" * 300_000, "<a x=" + "\"'" * 5000 + ">t"])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    htmlmain.main_text(page)
    assert time.process_time() - began < 8


def test_quotes_and_broken_tags():
    assert htmlmain.main_text("<p title='a>b'>x</p>") == "x"
    assert htmlmain.main_text("<p it's>x</p><p>y") == "x\ny"
    assert htmlmain.main_text('<div class="nav>x</div>') == 'x'
    assert htmlmain.main_text("a < b <c") == "a < b <c"


def pages_of(words, n=40):
    rng = random.Random(2)
    out = []
    for k in range(n):
        body = "".join(f"<p>{' '.join(rng.choice(words) for _ in range(40))}</p>" for _ in range(3))
        out.append((k, f"http://h.example/{k}", f"<body><div><p>Welcome to our place of many things</p></div><div><div>{body}</div><p>Read more of what we write every day of the year</p></div></body>", "clash"))
    return out


def test_boilerplate_without_telling_names_goes_by_counts(spark, words):
    rows = pages_of(words)
    df = spark.createDataFrame(rows + rows[:2], "page_id bigint, url string, html string, hashes string")
    got = {r.page_id: r.text for r in htmlmain.extract(df).collect()}
    for k, _, html, _ in rows:
        plain = htmlmain.main_text(html)
        assert "Welcome" in plain and "Read more" in plain
        assert got[k] == "\n".join(plain.split("\n")[1:4])
    assert htmlmain.extract(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:5], "page_id bigint, url string, html string, hashes string")
    assert all("Welcome" in r.text for r in htmlmain.extract(few).collect())


def test_template_counts_match_brute_force(spark, words):
    rows = pages_of(words, 12) + [(100 + k, f"http://other.example/{k}", f"<p>one</p><ul><li>a</li><li>{k % 3}</li></ul><p>{k} {k} x</p>", "") for k in range(10)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, c string")
    got = {r.host: set(r.hashes) for r in htmlmain.template_hashes(df).collect()}
    seen, bodies = {}, {}
    for _, url, html, _ in rows:
        host, tree = htmlmain.host_of(url), htmlmain.parse(html)
        body = htmlmain.main_text(html)
        bodies.setdefault(host, set()).add(body)
        for x, plain in htmlmain.elements(tree):
            assert not plain
            seen.setdefault((host, html[x.start : x.end]), (set(), htmlmain.subtree_hash(x)))[0].add(body)
    want = {}
    for (host, _), (on, h) in seen.items():
        if len(on) >= 0.6 * len(bodies[host]) and len(on) > 1:
            want.setdefault(host, set()).add(h)
    assert got == want


# --- quality
def brute_js(p, q):
    a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
    d = sum(x * math.log2(2 * x / (x + y)) / 2 for x, y in zip(a, b) if x) + sum(y * math.log2(2 * y / (x + y)) / 2 for x, y in zip(a, b) if y)
    n = sum(p)
    return math.sqrt(min(max(d - max(sum(min(1, n * y) for y in b) - 1, 0) / (8 * n * math.log(2)), 0), 1))


def brute_quality(rows):
    """Verdicts of (id, text, lang) rows, one row after the other."""
    hist = [(quality.char_histogram((t or "").encode()).tolist(), quality.word_histogram((t or "").encode())) for _, t, _ in rows]
    out = []
    for i, (doc, text, lang) in enumerate(rows):
        n, _, _, _, repeated = quality.base_counts((text or "").encode())
        same = [h for j, h in enumerate(hist) if j != i and rows[j][2] == lang]
        every = [h for j, h in enumerate(hist) if j != i]
        refs = [[sum(x) for x in zip(*(h[k] for h in (same if lang is not None else every)))] or [0] for k in (0, 1)]
        thin = sum(refs[1]) < quality.MIN_REFERENCE_WORDS
        if thin:
            refs = [[sum(x) for x in zip(*(h[k] for h in every))] or [0] for k in (0, 1)]
        d = [brute_js(p, q) if sum(p) and sum(q) else 0.0 for p, q in zip(hist[i], refs, strict=True)]
        far = d[0] > quality.MAX_CHAR_DISTANCE or d[1] > (quality.MAX_FOREIGN_WORD_DISTANCE if thin else quality.MAX_WORD_DISTANCE)
        failed = n < 50 or 100 * repeated > 50 * n
        out.append((doc, d, not failed and not (n >= 50 and sum(hist[i][0]) >= 200 and far)))
    return out


def quality_rows(words):
    rng = random.Random(4)
    common = quality.COMMON_WORDS[:40]
    good = lambda: " ".join(rng.choice(common if rng.random() < 0.5 else words) for _ in range(rng.randint(60, 120)))
    rows = [(k, good(), "en") for k in range(60)]
    junk = " ".join("".join(rng.choice("#$%&|<>!0123456789") for _ in range(7)) for _ in range(90))
    return [*rows, (100, junk, "en"), (101, junk, "xx"), (102, good(), "yy"), (103, None, "en"), (104, "", None), (105, good(), None), (0, rows[0][1], "en"), (106, "a b c " * 40, "en")]


def test_quality_distances_and_thin_languages(spark, words):
    rows = quality_rows(words)
    df = table(spark, [(d, t, g, "s", 0, "a", "b") for d, t, g in rows], ", ref_chars string, ref_lang string")
    got = sorted((r.doc_id, round(r.char_distance, 9), round(r.word_distance, 9), r.kept) for r in quality.judge(df).collect())
    assert got == sorted((d, round(x[0], 9), round(x[1], 9), k) for d, x, k in brute_quality(rows))
    kept = quality.good_documents(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, _, k in got if k)
    verdict = {d: k for d, _, _, k in got}
    assert not verdict[100] and not verdict[101] and verdict[102] and verdict[105]
    assert quality.judge(df.limit(0)).count() == 0 and quality.good_documents(df.limit(0)).count() == 0


# --- mixing
def brute_targets(sizes):
    """sizes by source, in order; weights 5, 2, 1 repeating, no target above 3 times its size."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total, target = sum(sizes), [None] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if target[i] is None]
        left = total - sum(3 * sizes[i] for i in range(len(sizes)) if target[i] is not None)
        over = [i for i in free if left * weights[i] / sum(weights[j] for j in free) > 3 * sizes[i]]
        if not over:
            return [3 * sizes[i] if target[i] is not None else left * weights[i] / sum(weights[j] for j in free) for i in range(len(sizes))]
        for i in over:
            target[i] = 1


def brute_mix(rows):
    """rows: (doc_id, source, digest, copy, size); what is taken of each."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[4] for r in rows if r[1] == s) for s in sources]
    targets = brute_targets(sizes)
    blocks = [max(-(-n // mixing.BLOCK_WORDS), min(n, mixing.MIN_BLOCKS)) for n in sizes]
    wanted = [t * b / n if n else 0.0 for t, b, n in zip(targets, blocks, sizes, strict=True)]
    total, high, low = sum(wanted), [], []
    for i in range(len(sources)):
        low.append(high[-1] if high else 0)
        high.append(math.floor(sum(wanted[: i + 1]) / total * mixing.CIRCLE + 0.5))
    ranks, times = [0] * len(sources), {}
    for slot in range(math.floor(total + 0.5)):
        point = slot % mixing.CIRCLE * mixing.GOLDEN % mixing.CIRCLE
        i = next(i for i in range(len(sources)) if low[i] <= point < high[i])
        if ranks[i] < 3 * blocks[i]:
            times[i, ranks[i] % blocks[i]] = times.get((i, ranks[i] % blocks[i]), 0) + 1
        ranks[i] += 1
    out = {}
    for i, s in enumerate(sources):
        edges = np.cumsum([0, *[sizes[i] // blocks[i] + (b < sizes[i] % blocks[i]) for b in range(blocks[i])]]) if blocks[i] else [0]
        at = 0
        order = lambda r: (hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[2]}:mix".encode()).hexdigest(), r[3])
        for r in sorted((r for r in rows if r[1] == s), key=order):
            out[r] = sum(max(0, min(at + r[4], edges[b + 1]) - max(at, edges[b])) * times.get((i, b), 0) for b in range(blocks[i])) if r[4] else 0
            at += r[4]
    return out, dict(zip(sources, targets, strict=True))


def test_mix_matches_brute_force_schedule(spark, words):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90))), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for k in range(300)]
    rows += [(7, "same text here", "en", "b", 0)] * 3 + [(7, "other text here", "en", "b", 0), (None, "q", "en", "b", 0), (None, "w", "en", "b", 0), (400, None, "en", "d", 0)]
    df = table(spark, [(*r, "mine") for r in rows], ", size string")
    got = {(r.doc_id, r.source, r.digest, r.copy, r["size"]): (r.taken, r.target) for r in mixing.mix(df).collect()}
    assert len(got) == len(rows)
    want, targets = brute_mix(list(got))
    assert {k: v[0] for k, v in got.items()} == want
    assert all(abs(v[1] - targets[k[1]]) < 1e-6 for k, v in got.items())
    kept = mixing.take(df)
    assert kept.columns == [*df.columns, "size_", "source_size", "target", "taken"]
    assert {r["size"] for r in kept.collect()} == {"mine"} and kept.count() == sum(v > 0 for v in want.values())
    assert mixing.take(df.limit(0)).count() == 0


# --- language
def test_language_of_each_position_matches_a_plain_network(spark):
    net = langid.new_network(["de", "en"])
    texts = ["Hällo wörld, this is text. " * 9, "x", "ab\0cd", "²½ 12", None, ""]
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(table, back, data):
        h, out, n = np.zeros(langid.HIDDEN), [], langid.HIDDEN
        for b in data:
            g, t = table[b], h @ back
            z, r = sig(g[:n] + t[:n]), sig(g[n : 2 * n] + t[n : 2 * n])
            c = np.tanh(g[2 * n :] + r * t[2 * n :])
            h = (1 - z) * c + z * h
            out.append(h)
        return out

    names, scores = langid.predict(net, texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0.0)
            continue
        data, total, count = text.encode().replace(b"\0", b" "), np.zeros(2), 0
        for at in range(0, len(data), langid.SPAN):
            span = data[at : at + langid.SPAN]
            padded = span + b"\0" * (langid.SPAN - len(span))
            one, two = states(net.table[0], net.back[0], padded), states(net.table[1], net.back[1], padded[::-1])[::-1]
            for k in range(len(span)):
                s = one[k] @ net.out[0] + two[k] @ net.out[1] + net.bias
                p = np.exp(s - s.max())
                total += p / p.sum()
                count += 1
        assert name == net.labels[int(total.argmax())] and abs(score - (total / count).max()) < 1e-4
    assert langid.detect(table(spark, [])).count() == 0
    alone = langid.detect(table(spark, [(1, "no one says what this is", None, "s", 0, "x")], ", held_out string")).head()
    assert (alone.lang_pred, alone.score) == ("und", 0.0)


# --- toxicity
def test_toxicity_odd_tables(spark, words):
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(80)] + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    rng = random.Random(9)
    rows = [(k, " ".join([*(rng.choice(words) for _ in range(30)), *(["zzbad", "qqvile"] if k % 4 == 0 else [])]), "en", "s", 0, "x") for k in range(80)]
    rows += [(0, rows[0][1], "en", "s", 0, "x"), (200, None, "en", "s", 0, "x"), (201, "", "en", "s", 0, "x"), (202, "a zzbad b qqvile", "en", "s", 0, "x")]
    df = table(spark, rows, ", toxic string")
    got = sorted((r.doc_id, r.toxic) for r in toxicity.classify(df, labels).collect())
    assert got == sorted([(k, k % 4 == 0) for k in range(80)] + [(0, True), (200, False), (201, False), (202, True)])
    assert toxicity.classify(df.limit(0), labels).count() == 0
    assert not any(r.toxic for r in toxicity.classify(df, labels.limit(0)).collect())


def test_toxicity_kinds_are_groups_that_occur_together():
    x = np.zeros((40, 6), np.float32)
    x[:20, :3] = 1
    x[20:, 3:] = 1
    group = toxicity.kinds_of(x)
    assert len(set(group[:3])) == len(set(group[3:])) == 1 and group[0] != group[3]


# --- decontamination
def test_decontamination_columns_and_query(spark, words):
    rng = random.Random(5)
    item = " ".join(rng.choice(words) for _ in range(30))
    bench = spark.createDataFrame([(1, item), (1, item), (2, "short")], "item_id bigint, text string")
    rows = [(1, f"start {item} end", "en", "s", 0, "mine"), (2, "nothing of it here", "en", "s", 0, "mine"), (3, None, "en", "s", 0, "mine")]
    df = table(spark, rows, ", leaks string")
    with pytest.raises(ValueError):
        decontam.find_leaks(df, bench)
    clean = decontam.clean_documents(df, bench)
    assert clean.columns == df.columns and sorted((r.doc_id, r.leaks) for r in clean.collect()) == [(2, "mine"), (3, "mine")]
    assert decontam.clean_documents(df.limit(0), bench).count() == 0


# --- the pipeline
def test_pipeline_matches_a_chain_of_brute_force(spark, words, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    texts = [(d, t, g) for d, t, g in quality_rows(words) if d is not None]
    base = texts[1][1].split()
    near = " ".join(["changed", *base[1:]])
    item = texts[2][1]
    secret = texts[3][1] + ' password = "abcdefghijkl123"'
    rows = [*texts, (300, near, "en"), (301, f"{texts[5][1]} {item[: len(item) // 2 * 2]} {texts[6][1]}", "en"), (302, secret + " tail", "en")]
    docs = [(d, t, g, rng.choice(["a", "b", None]), None if t is None else len(t)) for d, t, g in rows]
    table(spark, docs).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(9, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r.doc_id, r.text, r.taken) for r in pipeline.run(spark, str(tmp_path)).collect())

    source = {(d, t): s for d, t, _, s, _ in docs}
    kept = [r for r, (_, _, k) in zip(rows, brute_quality(rows), strict=True) if k]
    sets = [set(zip(*(r[1].lower().split()[i:] for i in range(5)))) for r in kept]
    root = list(range(len(kept)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(kept)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(kept):
        first[find(i)] = min(first.get(find(i), r), r, key=lambda x: x[0])
    index = decontam.build_index([(9, item)])
    plain = decontam.normalise
    left = [r for r in sorted(first.values()) if not decontam.search(index, [plain(r[1])])[0]]
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}""")
    cleaned = [(d, assign.sub("[SECRET]", t), source[d, t]) for d, t, _ in left]
    digest = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t, _ in cleaned], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    mixed, _ = brute_mix([(d, s, digest[t], 0, len(t.split())) for d, t, s in cleaned])
    text_of = {(d, digest[t]): t for d, t, _ in cleaned}
    assert got == sorted((d, text_of[d, h], n) for (d, _, h, _, _), n in mixed.items() if n)
    assert 301 not in {r[0] for r in got} and 100 not in {r[0] for r in got} and not any("abcdefghijkl123" in r[1] for r in got)


def test_empty_and_single_rows_of_stages(spark):
    one = table(spark, [(1, "a b c d e f", "en", "s", 11)])
    none = one.limit(0)
    assert neardup.one_of_each(none, 80).count() == 0 and neardup.one_of_each(one, 80).count() == 1
    assert secrets.redact(none).count() == 0 and secrets.redact(one).head().text == "a b c d e f"
