"""Named queries, one for each operator, with DuckDB twins.

Most apply an operator to every whole text of ``documents`` and return one row for each text: its id,
how many pieces or characters came out, and the md5 of all of them, so that nothing is left
unchecked and nothing large is returned.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import predicates
from quillon.functions.regex import BPE_MODES, BYTE_LEVEL, CJK, CONTROL, PUNCT, WORD, WS4, WS_RE2, WS_UNICODE, alternation
from quillon.operators import added, decode, encode, encoding, normalize, postprocess, pretokenize, vocabulary
from quillon.pipeline import Pipeline
from quillon.plans import vocabularies as V
from quillon.schema import Vocab
from quillon.sources import config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Text with white space around it, so that the strippers have something to do.
SPACED = "chr(9) || ' ' || text || chr(160) || chr(10)"


#: A table below this many bytes for each core may lie in one row group, which one task would read.
SMALL_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; a small one of texts is dealt to all cores, as its files may have too few row groups for that."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if "text" in df.columns and size < SMALL_BYTES * cores else df


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return quoted(pattern)


def _digest_text(df: DataFrame, c: Column) -> DataFrame:
    return df.select("doc_id", F.length(c).cast("bigint").alias("n"), F.md5(c.cast("binary")).alias("digest"))


def _digest_pieces(df: DataFrame, c: Column) -> DataFrame:
    once = df.select("doc_id", c.alias("p"))
    return once.select("doc_id", F.size("p").cast("bigint").alias("n"), F.md5(F.array_join("p", "\x1f").cast("binary")).alias("digest"))


def _spaced(c: Column) -> Column:
    return F.concat(F.lit("\t "), c, F.lit(" \n"))


def text_query(name: str, f: Callable[[Column], Column], sql: str | None, spaced: bool = False) -> None:
    """``sql``: DuckDB expression over ``t``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = F.col("text")
        return _digest_text(read(spark, sf_dir, "documents"), f(_spaced(c) if spaced else c))

    QUERIES[name] = run
    if sql:
        SQL[name] = f"select doc_id, length(r)::bigint as n, md5(r) as digest from (select doc_id, {sql} as r from (select doc_id, {SPACED if spaced else 'text'} as t from documents))"


def piece_query(name: str, f: Callable[[Column], Column], sql: str | None, before: Callable[[Column], Column] = lambda c: c, sql_before: str = "text") -> None:
    """``sql``: DuckDB expression over ``t`` that gives a list of strings."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _digest_pieces(read(spark, sf_dir, "documents"), f(before(F.col("text"))))

    QUERIES[name] = run
    if sql:
        SQL[name] = f"select doc_id, len(p)::bigint as n, md5(array_to_string(p, chr(31))) as digest from (select doc_id, {sql} as p from (select doc_id, {sql_before} as t from documents))"


def id_query(name: str, f: Callable[[Column], Column], sql: str | None) -> None:
    piece_query(name, lambda c: F.transform(f(c), lambda i: i.cast("string")), sql)


def all_of(pattern: str, c: str = "t") -> str:
    return f"regexp_extract_all({c}, {re2('(?s)' + pattern)})"


# --- normalizers
LOWER = "lower(translate(t, 'İΣ', 'iσ'))"
text_query("norm_lowercase", normalize.lowercase(), LOWER)
text_query("norm_uppercase", normalize.uppercase(), "replace(upper(replace(t, 'ß', chr(64976))), chr(64976), 'ß')")
text_query("norm_strip", normalize.strip(), f"regexp_replace(regexp_replace(t, {re2(f'^[{WS_UNICODE}]+')}, ''), {re2(f'[{WS_UNICODE}]+$')}, '')", True)
text_query("norm_lstrip", normalize.strip(right=False), f"regexp_replace(t, {re2(f'^[{WS_UNICODE}]+')}, '')", True)
text_query("norm_rstrip", normalize.strip(left=False), f"regexp_replace(t, {re2(f'[{WS_UNICODE}]+$')}, '')", True)
text_query("norm_strip_accents", normalize.strip_accents(), r"regexp_replace(t, '\p{Mn}+', '', 'g')")
text_query("norm_replace_string", normalize.replace("the", "<$1>"), "replace(t, 'the', '<$1>')")
text_query("norm_replace_regex", normalize.replace_pattern("[ae]+n", "_"), "regexp_replace(t, '[ae]+n', '_', 'g')")
text_query("norm_prepend", normalize.prepend("▁"), "case when t = '' then t else '▁' || t end")
text_query("norm_append", normalize.append("</s>"), "case when t = '' then t else t || '</s>' end")
text_query("norm_filter", normalize.keep("a-zé"), "regexp_replace(t, '[^a-zé]+', '', 'g')")
text_query("norm_map", normalize.map_chars("aeo", "430"), "translate(t, 'aeo', '430')")
CLEAN = f"regexp_replace(regexp_replace(t, {re2(f'[ \\t\\n\\r][{CONTROL}]+')}, ' ', 'g'), {re2(f'[{CONTROL}]+')}, '', 'g')"
text_query("norm_bert_clean", normalize.bert_clean(), CLEAN)
text_query("norm_bert_chinese", normalize.pad_ideographs(), f"regexp_replace(t, {re2(f'([{CJK}])')}, ' \\1 ', 'g')")
text_query("norm_bert_full", normalize.bert(), f"regexp_replace(lower(translate(regexp_replace({CLEAN}, {re2(f'([{CJK}])')}, ' \\1 ', 'g'), 'İΣ', 'iσ')), '\\p{{Mn}}+', '', 'g')")
text_query("norm_default", normalize.default(), f"regexp_replace(regexp_replace({LOWER}, {re2(f'^[{WS_UNICODE}]+')}, ''), {re2(f'[{WS_UNICODE}]+$')}, '')", True)
text_query("norm_sequence", normalize.sequence(normalize.lowercase(), normalize.replace("th", "z"), normalize.prepend("^")), f"case when t = '' then t else '^' || replace({LOWER}, 'th', 'z') end")
text_query("norm_nfc", normalize.unicode_form("NFC"), "nfc_normalize(t)")
for _form in ("NFD", "NFKC", "NFKD"):
    text_query(f"norm_{_form.lower()}", normalize.unicode_form(_form), None)

# --- pre-tokenizers
piece_query("pretok_whitespace", pretokenize.whitespace(), all_of(f"[{WORD}]+|[^{WORD}{WS_RE2}]+"))
piece_query("pretok_whitespace_split", pretokenize.whitespace_split(), all_of(f"[^{WS4}]+"))
piece_query("pretok_delimiter", pretokenize.delimiter("."), "list_filter(string_split(t, '.'), lambda x: x <> '')")
piece_query("pretok_punctuation", pretokenize.punctuation(), all_of(f"[{PUNCT}]|[^{PUNCT}]+"))
piece_query("pretok_digits", pretokenize.digits(), all_of(r"\p{N}+|\P{N}+"))
piece_query("pretok_digits_individual", pretokenize.digits(True), all_of(r"\p{N}|\P{N}+"))
piece_query("pretok_bert", pretokenize.bert(), all_of(f"[{PUNCT}]|[^{PUNCT}{WS_RE2}]+"))
_MARKED = f"regexp_replace(t, '[{WS_RE2}]', '▁', 'g')"
piece_query("pretok_metaspace_never", pretokenize.metaspace(scheme="never"), all_of("▁?[^▁]+|▁", _MARKED))
piece_query("pretok_metaspace_always", pretokenize.metaspace(), all_of("▁?[^▁]+|▁", f"case when {_MARKED} = '' or starts_with({_MARKED}, '▁') then {_MARKED} else '▁' || {_MARKED} end"))
for _b in pretokenize.BEHAVIORS:
    piece_query(f"pretok_split_{_b}", pretokenize.split("t", _b), all_of(pretokenize.class_pattern("t", _b)))
piece_query("pretok_split_inverted", pretokenize.split(f"[{WORD}]+|[^{WORD}{WS_RE2}]+", "removed", True), all_of(f"[{WORD}]+|[^{WORD}{WS_RE2}]+"))
piece_query("pretok_split_string", pretokenize.split("th", "removed"), "list_filter(string_split(t, 'th'), lambda x: x <> '')")
piece_query(
    "pretok_sequence",
    pretokenize.sequence(pretokenize.whitespace_split(), pretokenize.punctuation()),
    f"flatten(list_transform({all_of(f'[^{WS4}]+')}, lambda x: {all_of(f'[{PUNCT}]|[^{PUNCT}]+', 'x')}))",
)
# RE2 has no look-ahead: a mark is put before the last space of a run that a word follows, and no piece reaches over it
_SPLIT_MARKED = r"regexp_replace(t, '([\t\n\f\r ]+)( [^\t\n\f\r ])', '\1' || chr(2) || '\2', 'g')"
_SHORT = "|".join("''" + x for x in ("s", "t", "re", "ve", "m", "ll", "d"))
_BYTE_PIECES = rf"""regexp_extract_all({_SPLIT_MARKED}, '{_SHORT}| ?\p{{L}}+| ?\p{{N}}+| ?[^\t\n\f\r \p{{L}}\p{{N}}\x02]+|[\t\n\f\r ]+')"""
_BYTE_CHAR = "case when B between 33 and 126 or B between 161 and 172 or B >= 174 then chr(B) when B < 33 then chr(256 + B) when B = 173 then chr(323) else chr(162 + B) end"
_BYTE_CHAR = _BYTE_CHAR.replace("B", "(('0x' || h)::int)")
piece_query("pretok_bytelevel_split", pretokenize.byte_level_split, _BYTE_PIECES)
piece_query("pretok_bytelevel", pretokenize.byte_level(), f"list_transform({_BYTE_PIECES}, lambda x: array_to_string(list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: {_BYTE_CHAR}), ''))")
piece_query("pretok_unicode_script", pretokenize.unicode_script(), None)


def _offsets(unit: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = pretokenize.with_offsets(pretokenize.punctuation()(F.col("text")), unit)
        return _digest_pieces(read(spark, sf_dir, "documents"), F.transform(found, lambda p: F.concat_ws(":", p["start"], p["end"])))

    return run


for _unit, _len in (("char", "length"), ("byte", "strlen")):
    QUERIES[f"pretok_offsets_{_unit}"] = _offsets(_unit)
    SQL[f"pretok_offsets_{_unit}"] = f"""with p as (select doc_id, unnest({all_of(f'[{PUNCT}]|[^{PUNCT}]+', 'text')}) as x, generate_subscripts({all_of(f'[{PUNCT}]|[^{PUNCT}]+', 'text')}, 1) as i from documents),
o as (select doc_id, i, sum({_len}(x)) over (partition by doc_id order by i) as e, {_len}(x) as n from p)
select doc_id, count(*)::bigint as n, md5(string_agg((e - n)::bigint::varchar || ':' || e::bigint::varchar, chr(31) order by i)) as digest from o group by doc_id"""

# --- fragments of the byte-pair model
_BLANK = r"[ \t\n\x0B\f\r]*"
_KEPT = {m: all_of(BPE_MODES[m]) for m in ("qwen2", "stablelm2", "gpt2", "llama3", "gpt4o", "default")}
for _mode, _sql in _KEPT.items():
    piece_query(f"bpepre_{_mode}", pretokenize.bpe(_mode), f"list_filter({_sql}, lambda x: not regexp_full_match(x, {re2(_BLANK)}))")
piece_query("bpepre_gemma4", pretokenize.bpe("gemma4"), "[t]")
_MARKS = r"^[\x00-\x08\x0B\x0C\x0E-\x1F!-&(-/:-@\[-`{-\x7F]"
_AFTER_DIGITS = "substr(t, length(regexp_extract(t, '^[0-9]+')) + 1)"
_NO_BLANK = f"lambda x: not regexp_full_match(x, {re2(_BLANK)})"
piece_query(
    "bpepre_starcoder",
    pretokenize.bpe("starcoder"),
    f"list_filter(list_filter([regexp_extract(t, '^[0-9]+')], lambda x: x <> '') || list_filter({all_of(BPE_MODES['gpt2'], _AFTER_DIGITS)}, lambda x: not regexp_matches(x, {re2(_MARKS)})), {_NO_BLANK})",
)
piece_query("bpepre_falcon", pretokenize.bpe("falcon"), f"list_filter({all_of(BPE_MODES['falcon'])}, {_NO_BLANK})")
piece_query("bpepre_qwen35", pretokenize.bpe("qwen35"), f"list_filter({all_of(BPE_MODES['qwen35'])}, {_NO_BLANK})")
_BY_DIGIT = "regexp_extract_all({0}, '[0-9]|[^0-9]+')"
_LATIN = "regexp_extract_all(t, ' ?[A-Za-zÀ-ɏ]+')"
piece_query(
    "bpepre_deepseek",
    pretokenize.bpe("deepseek"),
    f"list_filter(flatten(list_transform(case when regexp_matches(t, '[\\r\\n]') then regexp_extract_all(t, '[\\r\\n]+') when len({_LATIN}) > 0 then {_LATIN} else [t] end, lambda x: {_BY_DIGIT.format('x')})), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')",
)


def _marked(fragments: str) -> str:
    """Fragments whose blank ones are whole runs, with their spaces as marks."""
    blank = "regexp_full_match({0}, '[ \\t\\r\\n]+')"
    return f"""flatten(list_transform({fragments}, lambda x, i: case
        when {blank.format('x')} then case when i = len({fragments}) then list_transform(range(length(x)), lambda k: 'Ġ') else [] end
        when i > 1 and {blank.format(f'({fragments})[i - 1]')} then (case when length(({fragments})[i - 1]) > 1 then [repeat('Ġ', length(({fragments})[i - 1]) - 1)] else [] end) || ['Ġ' || x]
        else [x] end))"""


_GPT2_RUNS = r"""regexp_extract_all(t, '[ \t\r\n]+|''(?:[rR][eE]|v[eE]|l[lL]|[sStTmMdD])|[A-Za-z]+|[0-9]|[\x00-\x08\x0b\x0c\x0e-\x1f!-/:-@\[-`{-\x7f]+|[^\x00-\x7f]')"""
_QWEN2_RUNS = r"""regexp_extract_all(t, '[ \t\r\n]+|[0-9]+|''(?:[rR][eE]|v[eE]|l[lL]|[sStTmMdD])|[A-Za-z]+|(?:[\x00-\x08\x0b\x0c\x0e-\x1f!-/:-@\[-`{-\x7f]|[^\x00-\x7f])+')"""
piece_query("bpepre_marked_spaces", pretokenize.bpe("gpt2", "Ġ"), f"(select {_marked('f')} from (select {_GPT2_RUNS} as f))")

# --- models
_META = "case when t = '' then t else '▁' || regexp_replace(t, '[ \\t\\n\\r]', '▁', 'g') end"


def _table(vocab: Vocab) -> str:
    return "map {" + ", ".join(f"{quoted(t)}: {k}" for t, k in vocab.ids().items()) + "}"


def _ids_sql(vocab: Vocab, text: str, unknown: str) -> str:
    found = all_of(alternation(list(vocab.tokens)).removeprefix("(?s)"), text)
    return f"list_filter(list_transform({found}, lambda x: coalesce({_table(vocab)}[x], {unknown})::varchar), lambda x: x is not null)"


id_query("encode_spm", lambda c: encode.encode(c, V.SPM), _ids_sql(V.SPM, _META, "null"))
id_query("encode_spm_unk", lambda c: encode.encode(c, V.SPM_UNK), _ids_sql(V.SPM_UNK, _META, "0"))
id_query("encode_unigram", lambda c: encode.encode(c, V.UNIGRAM), _ids_sql(V.UNIGRAM, _META, "0"))
_BPE_FRAGMENTS = f"list_filter({_KEPT['gpt2']}, {_NO_BLANK})"
_BPE_FOUND = all_of(alternation(list(V.BPE.tokens)).removeprefix("(?s)"), "f")
id_query(
    "encode_bpe",
    lambda c: encode.encode(c, V.BPE),
    f"list_transform(flatten(list_transform({_BPE_FRAGMENTS}, lambda f: {_BPE_FOUND})), lambda x: coalesce({_table(V.BPE)}[x], case when unicode(x) < 128 then unicode(x) else -(unicode(x) + 1) end)::varchar)",
)
id_query("encode_bpe_kernel", lambda c: encode.encode_kernel(c, V.BPE), SQL["encode_bpe"].split(", ", 1)[1].partition("(select doc_id, ")[2].partition(" as p from")[0])
for _name, _vocab in (("bpe", V.BPE), ("spm", V.SPM_UNK), ("unigram", V.UNIGRAM)):
    id_query(f"encode_{_name}_native", lambda c, v=_vocab: encode.encode_native(c, v), None)
    SQL[f"encode_{_name}_native"] = SQL["encode_spm_unk" if _name == "spm" else f"encode_{_name}"]
_VALUE = "case when unicode(x) < 128 then unicode(x) else -(unicode(x) + 1) end"


def _greedy_ids(vocab: Vocab, fragment: str, unknown: str) -> str:
    """Ids of a fragment: entries by falling length, or any character."""
    ways = "|".join(re.escape(t) for t in sorted(vocab.tokens, key=lambda t: (-len(t), t)))
    return f"list_transform(regexp_extract_all({fragment}, {quoted(f'(?s){ways}|.')}), lambda x: coalesce({_table(vocab)}[x], {unknown}))"


# texts hold no special token; where one stood, its id would stand between the ids of the parts around it
_SPECIAL_IDS = f"flatten(list_transform(m, lambda f: {_greedy_ids(V.BPE_SPECIAL, 'f', _VALUE)}))"
id_query("encode_bpe_special", lambda c: encode.encode_kernel(c, V.BPE_SPECIAL), f"(select list_transform([0] || {_SPECIAL_IDS}, lambda i: i::varchar) from (select {_marked('f')} as m from (select {_QWEN2_RUNS} as f)))")
id_query("encode_wordpiece", lambda c: encode.encode_kernel(c, V.WORDPIECE), None)
_WP_ROWS = ", ".join(f"({k}, {quoted(t)})" for k, t in enumerate(V.WORDPIECE.tokens))
#: Word pieces in steps: roots as long as one fits, an unknown id for each byte that is left, then continuations.
WORDPIECE_WALK = f"""with recursive v(id, t) as (values {_WP_ROWS}),
texts as (select doc_id, {{words}} as w from documents),
words as (select distinct unnest(w) as word from texts),
roots(word, done, ids) as (
  select word, 0, []::bigint[] from words
  union all
  select s.word, s.done + length(v.t), s.ids || [v.id::bigint]
  from (select word, done, ids, (select max(length(t)) from v where starts_with(substr(word, done + 1), t)) as n from roots) s join v on v.t = substr(s.word, s.done + 1, s.n)),
ends as (select word, max(done) as done, arg_max(ids, done) as ids from roots group by word),
tails(word, done, ids) as (
  select word, done, ids || list_transform(range(strlen(substr(word, done + 1))), lambda k: 0::bigint) from ends
  union all
  select s.word, s.done + length(v.t) - 2, s.ids || [v.id::bigint]
  from (select word, done, ids, (select max(length(t)) from v where starts_with(t, '##') and length(t) > 2 and starts_with(substr(word, done + 1), substr(t, 3))) as n from tails) s
  join v on v.t = '##' || substr(s.word, s.done + 1, s.n - 2)),
pieces as (select word, arg_max(ids, done) as ids from tails group by word),
each as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from texts),
encoded as (select t.doc_id, [1::bigint] || coalesce(flatten(list(p.ids order by e.i) filter (e.i is not null)), []) || [2::bigint] as ids
            from texts t left join each e using (doc_id) left join pieces p using (word) group by t.doc_id) """
_SPACE_WORDS = "regexp_extract_all(text, '[^\\x09-\\x0d \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+')"
_WP = WORDPIECE_WALK.replace("{words}", _SPACE_WORDS)
SQL["encode_wordpiece"] = _WP + "select doc_id, len(ids)::bigint as n, md5(array_to_string(ids, chr(31))) as digest from encoded"
SQL["count_wordpiece"] = _WP + "select doc_id, len(ids)::bigint as n_tokens from encoded"
SQL["detok_wordpiece"] = (
    _WP
    + f""", strings as (select e.doc_id, list_filter(list_transform(e.ids, lambda i: [{', '.join(map(quoted, V.WORDPIECE.tokens))}][i + 1]), lambda t: t not in ('[CLS]', '[SEP]', '<s>', '</s>', '[PAD]', '[UNK]')) as t from encoded e),
joined as (select doc_id, array_to_string(list_transform(t, lambda x, i: case when starts_with(x, '##') then substr(x, 3) when i = 1 then x else ' ' || x end), '') as r from strings)
select doc_id, length(r)::bigint as n, md5(r) as digest from joined"""
)


def _counts(vocab: Vocab) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: read(spark, sf_dir, "documents").select("doc_id", encode.count(F.col("text"), vocab).cast("bigint").alias("n_tokens"))


for _name, _vocab in (("bpe", V.BPE), ("spm", V.SPM), ("unigram", V.UNIGRAM)):
    QUERIES[f"count_{_name}"] = _counts(_vocab)
    SQL[f"count_{_name}"] = f"select doc_id, n as n_tokens from ({SQL[f'encode_{_name}']})"
QUERIES["count_wordpiece"] = _counts(V.WORDPIECE)


def unigram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.round(encode.unigram_score(F.col("text"), V.UNIGRAM), 6).alias("score"))


QUERIES["encode_unigram_score"] = unigram_score
_SCORES = "map {" + ", ".join(f"{quoted(t)}: {float(s)!r}::double" for t, s in zip(V.UNIGRAM.tokens, V.UNIGRAM.score_of(), strict=True)) + "}"
SQL["encode_unigram_score"] = f"select doc_id, round(list_sum(list_transform({all_of(alternation(list(V.UNIGRAM.tokens)).removeprefix('(?s)'), _META)}, lambda x: coalesce({_SCORES}[x], {float(V.UNIGRAM.score_of()[0])!r}::double))), 6) as score from (select doc_id, text as t from documents)"

for _name, _vocab in (("bpe", V.BPE), ("spm", V.SPM_UNK), ("unigram", V.UNIGRAM), ("wordpiece", V.WORDPIECE)):
    text_query(f"detok_{_name}", lambda c, v=_vocab: encode.detokenize(encode.encode(c, v), v), None)
_SPM_STRINGS = f"list_transform(list_transform({_ids_sql(V.SPM_UNK, _META, '0')}, lambda x: x::int), lambda i: replace([{', '.join(map(quoted, V.SPM.tokens))}][i + 1], '▁', ' '))"
_SPM_SPACED = "list_transform(s, lambda x, i: case when i = 1 or ends_with(s[i - 1], ' ') or starts_with(x, ' ') then x else ' ' || x end)"
_BPE_PLAIN = f"list_transform(flatten(list_transform(list_filter({_KEPT['gpt2']}, {_NO_BLANK}), lambda f: {_greedy_ids(V.BPE, 'f', _VALUE)})), lambda x: x::bigint)"
_BPE_TOKEN = f"[{', '.join(map(quoted, V.BPE.tokens))}][x + 1]"
_BPE_TEXT = f"""list_transform(i, lambda x, k: case when x between 0 and {len(V.BPE.tokens) - 1} then case when k > 1 and i[k - 1] between 0 and {len(V.BPE.tokens) - 1} then ' ' else '' end || {_BPE_TOKEN}
  when x < 0 then case when regexp_full_match(chr((-x - 1)::int), '[\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]') then ' ' else chr((-x - 1)::int) end
  when x < 256 then chr(x::int) else '' end)"""
for _name, _sql in (
    ("spm", f"(select ltrim(array_to_string({_SPM_SPACED}, '')) from (select {_SPM_STRINGS} as s))"),
    ("unigram", f"ltrim(array_to_string({_SPM_STRINGS}, ''))"),
    ("bpe", f"(select array_to_string({_BPE_TEXT}, '') from (select {_BPE_PLAIN} as i))"),
):
    SQL[f"detok_{_name}"] = f"select doc_id, length(r)::bigint as n, md5(r) as digest from (select doc_id, {_sql} as r from (select doc_id, text as t from documents))"
id_query("tokens_spm", lambda c: encode.tokens(encode.encode(c, V.SPM), V.SPM), f"list_filter({all_of(alternation(list(V.SPM.tokens)).removeprefix('(?s)'), _META)}, lambda x: {_table(V.SPM)}[x] is not null)")


def spm_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each token occurs in each language."""
    each = read(spark, sf_dir, "documents").select("lang", F.explode(encode.encode(F.col("text"), V.SPM)).alias("id"))
    return each.groupBy("lang", "id").agg(F.count("*").alias("n"))


QUERIES["spm_token_counts"] = spm_token_counts
SQL["spm_token_counts"] = f"select lang, x::bigint as id, count(*) as n from (select lang, unnest({_ids_sql(V.SPM, _META, 'null')}) as x from (select lang, text as t from documents)) group by all"

# --- vocabularies as tables, made of the names in the dimension tables


def _words(spark: SparkSession, sf_dir: str, table: str, key: str, name: str) -> DataFrame:
    rows = read(spark, sf_dir, table).select(F.col(key).alias("id"), F.lower(name).alias("token"))
    return vocabulary.renumbered(rows, "id").select("id", "token")


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = _words(spark, sf_dir, "nation", "n_nationkey", "n_name")
    b = read(spark, sf_dir, "nation").filter("n_regionkey < 2").select("n_nationkey", F.lower("n_name").alias("token"))
    more = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("n_nationkey"), F.lower("r_name").alias("token"))
    return a, vocabulary.renumbered(b.unionByName(more), "n_nationkey").select("id", "token")


_SETS = """with a as (select row_number() over (order by n_nationkey) - 1 as id, lower(n_name) as token from nation),
b as (select row_number() over (order by k) - 1 as id, token from (select n_nationkey as k, lower(n_name) as token from nation where n_regionkey < 2 union all select r_regionkey + 1000, lower(r_name) from region)) """
QUERIES["vocab_union"] = lambda spark, sf_dir: vocabulary.union(*_two(spark, sf_dir))
SQL["vocab_union"] = _SETS + "select row_number() over (order by s, id) - 1 as id, token from (select id, token, 0 as s from a union all select min(id), token, 1 from b where token not in (select token from a) group by token)"
QUERIES["vocab_intersect"] = lambda spark, sf_dir: vocabulary.intersect(*_two(spark, sf_dir))
SQL["vocab_intersect"] = _SETS + "select row_number() over (order by id) - 1 as id, token from a where token in (select token from b)"
QUERIES["vocab_trim"] = lambda spark, sf_dir: vocabulary.trim(*_two(spark, sf_dir))
SQL["vocab_trim"] = _SETS + "select row_number() over (order by id) - 1 as id, token from a where token not in (select token from b)"
QUERIES["vocab_append"] = lambda spark, sf_dir: vocabulary.append(_two(spark, sf_dir)[0], ["<new>", "<other>"])
SQL["vocab_append"] = _SETS + "select id, token from a union all select (select count(*) from a) + i, x from (values (0, '<new>'), (1, '<other>')) v(i, x)"


def _pieces_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.explode(pretokenize.whitespace()(F.lower("text"))).alias("token"))


def vocab_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.coverage(_pieces_of(spark, sf_dir), V.SPM.frame(spark).select("id", F.regexp_replace("token", "▁", "").alias("token")))


QUERIES["vocab_coverage"] = vocab_coverage
_TOKENS = ", ".join(f"({k}, {quoted(t)})" for k, t in enumerate(V.SPM.tokens))
_PIECES = f"select unnest({all_of(f'[{WORD}]+|[^{WORD}{WS_RE2}]+', 'lower(text)')}) as token from documents"
SQL["vocab_coverage"] = f"select token, count(*) as n, token in (select replace(t, '▁', '') from (values {_TOKENS}) v(i, t)) as known from ({_PIECES}) group by token"


def vocab_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _pieces_of(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n"))
    return encode.lookup(counts, V.BPE.frame(spark)).select("token", "n", "id")


QUERIES["vocab_lookup_id"] = vocab_lookup
_BPE_TOKENS = ", ".join(f"({k}, {quoted(t)})" for k, t in enumerate(V.BPE.tokens))
SQL["vocab_lookup_id"] = f"select p.token, count(*) as n, coalesce(max(v.i), -1) as id from ({_PIECES}) p left join (select t, max(i) as i from (values {_BPE_TOKENS}) v(i, t) group by t) v on v.t = p.token group by p.token"

# --- encodings: ids of the SentencePiece vocabulary
_IDS = f"list_transform({_ids_sql(V.SPM_UNK, _META, '0')}, lambda x: x::bigint)"
_DOCS = f"(select doc_id, {_IDS} as ids from (select doc_id, text as t from documents))"


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", encode.encode(F.col("text"), V.SPM_UNK).alias("ids"))


def _id_digest(df: DataFrame, *keys: str) -> DataFrame:
    return df.select("doc_id", *keys, F.size("ids").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").cast("binary")).alias("digest"))


_DIGEST = "len(ids)::bigint as n, md5(array_to_string(ids, ',')) as digest"


def enc_query(name: str, f: Callable[[Column], Column], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _id_digest(_encoded(spark, sf_dir).withColumn("ids", f(F.col("ids"))))
    SQL[name] = f"select doc_id, {_DIGEST} from (select doc_id, {sql} as ids from {_DOCS})"


enc_query("enc_truncate", lambda ids: encoding.truncated(ids, 100), "ids[1:100]")
enc_query("enc_pad_right_fixed", lambda ids: encoding.padded(ids, 500, -1), "ids || list_transform(range(greatest(500 - len(ids), 0)), lambda x: -1::bigint)")
enc_query("enc_pad_left_fixed", lambda ids: encoding.padded(ids, 500, -1, True), "list_transform(range(greatest(500 - len(ids), 0)), lambda x: -1::bigint) || ids")
enc_query("enc_attention_mask", lambda ids: encoding.attention(encoding.truncated(ids, 300), 300), "list_transform(ids[1:300], lambda x: 1::bigint) || list_transform(range(greatest(300 - len(ids), 0)), lambda x: 0::bigint)")
QUERIES["enc_truncate_stride"] = lambda spark, sf_dir: _id_digest(encoding.parts(_encoded(spark, sf_dir), "ids", 128, 32), "part")
SQL["enc_truncate_stride"] = f"select doc_id, k::int as part, {_DIGEST} from (select doc_id, k, ids[k * 96 + 1 : k * 96 + 128] as ids from (select doc_id, ids, unnest(range(greatest(ceil((len(ids) - 128) / 96.0), 0)::bigint + 1)) as k from {_DOCS}))"


def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = encoding.numbered_batches(_encoded(spark, sf_dir), "doc_id", 16)
    return _id_digest(encoding.pad_batches(batches, "ids", "batch", 0, 8))


QUERIES["enc_pad_batch_longest"] = pad_batch
SQL["enc_pad_batch_longest"] = f"select doc_id, {_DIGEST} from (select doc_id, ids || list_transform(range((ceil(max(len(ids)) over (partition by doc_id // 16) / 8.0) * 8)::bigint - len(ids)), lambda x: 0::bigint) as ids from {_DOCS})"


def _pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation with the next one, as ids."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", encode.encode(F.col("text"), V.SPM_UNK).alias("a"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return rows.join(after, ["conv_id", "turn"])


_TURNS = f"(select conv_id, turn, {_IDS} as a from (select conv_id, turn, text as t from conversations))"
_PAIRS = f"(select x.conv_id, x.turn, x.a, y.a as b, len(x.a) as la, len(y.a) as lb from {_TURNS} x join {_TURNS} y on x.conv_id = y.conv_id and x.turn + 1 = y.turn)"


def _joined(c: Column) -> Column:
    return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").cast("binary"))


def pair_query(name: str, strategy: str, a: str, b: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n_a, n_b = encoding.pair_lengths(F.size("a"), F.size("b"), 512, strategy)
        cut = _pair_rows(spark, sf_dir).withColumns({"a": F.slice("a", 1, n_a), "b": F.slice("b", 1, n_b)})
        return cut.select("conv_id", "turn", F.size("a").cast("bigint").alias("n_a"), F.size("b").cast("bigint").alias("n_b"), _joined(F.col("a")).alias("a"), _joined(F.col("b")).alias("b"))

    QUERIES[name] = run
    SQL[name] = f"select conv_id, turn, ({a})::bigint as n_a, ({b})::bigint as n_b, md5(array_to_string(a[1:({a})], ',')) as a, md5(array_to_string(b[1:({b})], ',')) as b from {_PAIRS}"


_FIRST = "case when la + lb <= 512 then la when la <= 256 then la when lb <= 256 then 512 - lb else 256 end"
pair_query("enc_truncate_longest_first", "longest_first", _FIRST, f"case when la + lb <= 512 then lb else 512 - ({_FIRST}) end")
pair_query("enc_truncate_only_first", "only_first", "greatest(la - greatest(la + lb - 512, 0), 0)", "lb")
pair_query("enc_truncate_only_second", "only_second", "la", "greatest(lb - greatest(la + lb - 512, 0), 0)")


def _as_encoding(ids: Column, type_id: int) -> Column:
    spans = F.transform(ids, lambda x, i: F.struct(i.alias("start"), (i + 1).alias("end")))
    fields = encoding.new_encoding(ids, F.transform(ids, lambda x: x.cast("string")), type_id) | {"offsets": spans}
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def _merged(spark: SparkSession, sf_dir: str, growing: bool) -> DataFrame:
    rows = _pair_rows(spark, sf_dir).select("conv_id", "turn", _as_encoding(F.col("a"), 0).alias("x"), _as_encoding(F.col("b"), 1).alias("y"))
    return rows.select("conv_id", "turn", *[c.alias(name) for name, c in encoding.merge_encodings([F.col("x"), F.col("y")], growing).items()])


def merge_query(name: str, growing: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spans = F.transform("offsets", lambda o: F.concat_ws(":", o["start"], o["end"]))
        return _merged(spark, sf_dir, growing).select("conv_id", "turn", _joined(F.col("ids")).alias("ids"), _joined(F.col("type_ids")).alias("types"), F.md5(F.array_join(spans, ",").cast("binary")).alias("spans"))

    QUERIES[name] = run
    from_b = "list_transform(range(la, la + lb), lambda i: i || ':' || (i + 1))" if growing else "list_transform(range(lb), lambda i: i || ':' || (i + 1))"
    SQL[name] = f"""select conv_id, turn, md5(array_to_string(a || b, ',')) as ids, md5(array_to_string(list_transform(range(la), lambda i: 0) || list_transform(range(lb), lambda i: 1), ',')) as types,
    md5(array_to_string(list_transform(range(la), lambda i: i || ':' || (i + 1)) || {from_b}, ',')) as spans from {_PAIRS}"""


merge_query("enc_merge_growing", True)
merge_query("enc_merge", False)


def sequence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of both sequences of a framed pair, and whose the first, the middle and the last token are."""
    made = postprocess.bert(_pair_rows(spark, sf_dir), 101, 102, "a", "b")
    found = encoding.sequence_ranges(F.col("type_ids"), F.col("special_tokens_mask"))
    rows = made.select("conv_id", "turn", "a", "b", "type_ids", "special_tokens_mask", found.alias("r"))
    text = lambda k: F.coalesce(F.concat_ws("-", F.col("r")[k]["start"], F.col("r")[k]["end"]), F.lit("none"))
    of = lambda at: encoding.token_to_sequence(F.col("type_ids"), F.col("special_tokens_mask"), at)
    ids = encoding.sequence_ids(F.col("r"), F.size("type_ids"))
    return rows.select(
        "conv_id", "turn", F.when(F.size("a") > 0, text(0)).otherwise("none").alias("first"), F.when(F.size("b") > 0, text(1)).otherwise("none").alias("second"), encoding.n_sequences(F.col("r")).cast("bigint").alias("n"),
        of(F.lit(0)).cast("bigint").alias("at_start"), of(F.lit(1)).cast("bigint").alias("at_one"), of(F.size("type_ids") - 2).cast("bigint").alias("at_last"),
        F.md5(F.array_join(F.transform(ids, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").cast("binary")).alias("ids"),
    )


QUERIES["enc_sequences"] = sequence_query
SQL["enc_sequences"] = f"""select conv_id, turn, case when la > 0 then '1-' || (la + 1) else 'none' end as first, case when lb > 0 then (la + 2) || '-' || (la + 2 + lb) else 'none' end as second,
greatest((la > 0)::int + (lb > 0)::int, 1)::bigint as n, null::bigint as at_start, case when la > 0 then 0::bigint end as at_one, case when lb > 0 then 1::bigint end as at_last,
md5(array_to_string(['-'] || list_transform(range(la), lambda i: '0') || ['-'] || list_transform(range(lb), lambda i: '1') || ['-'], ',')) as ids from {_PAIRS}"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character pieces of each word with their offsets and word numbers, for the look-ups."""
    words = pretokenize.with_offsets(pretokenize.split_class(" ", "isolated")(F.col("text")))
    once = read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"), words.alias("w"))
    return once.select("doc_id", "size", F.transform("w", lambda w: F.struct(w["start"], w["end"])).alias("offsets"), F.transform("w", lambda w, i: F.when(w["value"] == " ", -1).otherwise(i)).alias("words"))


_OFF = f"""with p as (select doc_id, unnest({all_of('[ ]|[^ ]+', 'text')}) as x, generate_subscripts({all_of('[ ]|[^ ]+', 'text')}, 1) - 1 as i from documents),
o as (select doc_id, x, i, sum(length(x)) over (partition by doc_id order by i) as e from p) """
#: Places asked for in each text: the first, some inside, its middle, its last character and one beyond.
_CHARS = (("0", "0"), ("50", "50"), ("size div 2", "size // 2"), ("size - 1", "size - 1"), ("size", "size"))
_NUMBERS = (0, 1, 10, 40, 1000)


def _lookup(name: str, f: Callable[[Column], Column], places: list[tuple[str, str]], sql: Callable[[str], str]) -> None:
    """``f`` at each place (an expression), and DuckDB's answer: a select of doc_id and found for a place, over ``o`` and the text's size."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = [F.coalesce(f(F.expr(f"int({at})")).cast("string"), F.lit("none")) for at, _ in places]
        return _spans(spark, sf_dir).select("doc_id", F.concat_ws(",", *found).alias("found"))

    QUERIES[name] = run
    size = "select o.*, d.size from o join (select doc_id, length(text) as size from documents) d using (doc_id)"
    each = " union all ".join(f"select {k} as k, doc_id, ({sql(at)})::varchar as found from ({size}) s group by doc_id, size" for k, (_, at) in enumerate(places))
    SQL[name] = _OFF + f", r as ({each}) select doc_id, string_agg(coalesce(found, 'none'), ',' order by k) as found from r group by doc_id"


_AT_CHARS = list(_CHARS)
_AT_NUMBERS = [(str(n), str(n)) for n in _NUMBERS]
_span = lambda s: F.when(s.isNotNull(), F.concat_ws("-", s["start"], s["end"]))
_lookup("enc_char2token", lambda at: encoding.char_to_token(F.col("offsets"), at), _AT_CHARS, lambda at: f"min(i) filter (e > {at} and e - length(x) <= {at})")
_lookup("enc_char2word", lambda at: encoding.char_to_word(F.col("words"), F.col("offsets"), at), _AT_CHARS, lambda at: f"min(i) filter (e > {at} and e - length(x) <= {at} and x <> ' ')")
_lookup("enc_word2tokens", lambda n: _span(encoding.word_to_tokens(F.col("words"), n)), _AT_NUMBERS, lambda n: f"min(i || '-' || (i + 1)) filter (i = {n} and x <> ' ')")
_lookup("enc_word2chars", lambda n: _span(encoding.word_to_chars(F.col("words"), F.col("offsets"), n)), _AT_NUMBERS, lambda n: f"min((e - length(x))::bigint || '-' || e::bigint) filter (i = {n} and x <> ' ')")
_lookup("enc_token2word", lambda n: encoding.token_to_word(F.col("words"), n), _AT_NUMBERS, lambda n: f"min(i) filter (i = {n} and x <> ' ')")
_lookup("enc_token2chars", lambda n: _span(encoding.token_to_chars(F.col("offsets"), n)), _AT_NUMBERS, lambda n: f"min((e - length(x))::bigint || '-' || e::bigint) filter (i = {n})")

# --- post-processors
_CLS, _SEP = 101, 102


def post_query(name: str, f: Callable[[DataFrame], DataFrame], ids: str, types: str, special: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = f(_pair_rows(spark, sf_dir))
        text = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").cast("binary"))
        return made.select("conv_id", "turn", F.size("ids").cast("bigint").alias("n"), text("ids").alias("ids"), text("type_ids").alias("types"), text("special_tokens_mask").alias("special"))

    QUERIES[name] = run
    SQL[name] = f"select conv_id, turn, len({ids})::bigint as n, md5(array_to_string({ids}, ',')) as ids, md5(array_to_string({types}, ',')) as types, md5(array_to_string({special}, ',')) as special from {_PAIRS}"


def _all(side: str, value: int) -> str:
    return f"list_transform({side}, lambda x: {value})"


post_query("post_bert_single", lambda d: postprocess.bert(d, _CLS, _SEP, "a"), "[101] || a || [102]", f"[0] || {_all('a', 0)} || [0]", f"[1] || {_all('a', 0)} || [1]")
post_query("post_bert_pair", lambda d: postprocess.bert(d, _CLS, _SEP, "a", "b"), "[101] || a || [102] || b || [102]", f"[0] || {_all('a', 0)} || [0] || {_all('b', 1)} || [1]", f"[1] || {_all('a', 0)} || [1] || {_all('b', 0)} || [1]")
post_query("post_roberta_single", lambda d: postprocess.roberta(d, 0, 2, "a"), "[0] || a || [2]", f"[0] || {_all('a', 0)} || [0]", f"[1] || {_all('a', 0)} || [1]")
post_query("post_roberta_pair", lambda d: postprocess.roberta(d, 0, 2, "a", "b"), "[0] || a || [2, 2] || b || [2]", f"[0] || {_all('a', 0)} || [0, 1] || {_all('b', 1)} || [1]", f"[1] || {_all('a', 0)} || [1, 1] || {_all('b', 0)} || [1]")
_SPECIALS = {"[CLS]": [1], "[SEP]": [0, 7]}
post_query("post_template_single", lambda d: postprocess.template(d, "[CLS] $A:3 [SEP]", _SPECIALS, "a"), "[1] || a || [0, 7]", f"[0] || {_all('a', 3)} || [0, 0]", f"[1] || {_all('a', 0)} || [1, 1]")
post_query("post_template_pair", lambda d: postprocess.template(d, "", _SPECIALS, "a", "$B:2 [SEP] $A [CLS]:1", "b"), "b || [0, 7] || a || [1]", f"{_all('b', 2)} || [0, 0] || {_all('a', 0)} || [1]", f"{_all('b', 0)} || [1, 1] || {_all('a', 0)} || [1]")


def overflow_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pair_rows(spark, sf_dir).withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    side = lambda c: encoding.parts(rows.select("key", F.col(c).alias("ids")), "ids", 256, 16)
    return postprocess.overflow_pairs(side("a"), side("b"), "key").select("key", "part_a", "part_b", _joined(F.col("ids_a")).alias("a"), _joined(F.col("ids_b")).alias("b"))


QUERIES["post_overflow_pairs"] = overflow_pairs
_PARTS = "unnest(range(greatest(ceil((len({0}) - 256) / 240.0), 0)::bigint + 1))"
SQL["post_overflow_pairs"] = f"""select key, i::int as part_a, j::int as part_b, md5(array_to_string(a[i * 240 + 1 : i * 240 + 256], ',')) as a, md5(array_to_string(b[j * 240 + 1 : j * 240 + 256], ',')) as b
from (select *, {_PARTS.format('b')} as j from (select conv_id * 1000 + turn as key, a, b, {_PARTS.format('a')} as i from {_PAIRS}))"""

# --- decoders: words of the text stand for tokens
_W = all_of(f"[^{WS4}]+")
_words_of = pretokenize.whitespace_split()


def dec_query(name: str, f: decode.Decoder, sql: str | None) -> None:
    piece_query(name, lambda c: f(_words_of(c)), sql and f"(select {sql} from (select {_W} as w))")


_CLEANED = "x"
for _find, _by in decode.CLEANUP:
    _CLEANED = f"replace({_CLEANED}, {quoted(_find)}, {quoted(_by)})"
dec_query("dec_bpe", decode.bpe("n"), "list_transform(w, lambda x, i: replace(x, 'n', case when i = len(w) then '' else ' ' end))")
_PART = "list_transform(w, lambda x, i: case when i = 1 then x when starts_with(x, 'th') then substr(x, 3) else ' ' || x end)"
dec_query("dec_wordpiece", decode.wordpiece("th"), f"list_transform({_PART}, lambda x: {_CLEANED})")
dec_query("dec_ctc", decode.ctc("of", "a"), f"list_filter(list_transform(list_transform(list_filter(w, lambda x, i: i = 1 or x <> w[i - 1]), lambda x: replace(x, 'of', '')), lambda x: replace({_CLEANED}, 'a', ' ')), lambda x: x <> '')")
dec_query("dec_fuse", decode.fuse(), "[array_to_string(w, '')]")
dec_query("dec_strip", decode.strip("t", 1, 1), "list_transform(w, lambda x: regexp_replace(regexp_replace(x, '^t{0,1}', ''), 't{0,1}$', ''))")
dec_query("dec_metaspace", decode.metaspace("e"), "list_transform(w, lambda x, i: replace(x, 'e', case when i = 1 then '' else ' ' end))")
dec_query("dec_replace", decode.replace("th", "z"), "list_transform(w, lambda x: replace(x, 'th', 'z'))")
dec_query("dec_sequence", decode.sequence(decode.replace("th", "z"), decode.fuse()), "[replace(array_to_string(list_transform(w, lambda x: replace(x, 'th', 'z')), chr(30)), chr(30), '')]")
def _as_bytes(t: Column) -> Column:
    """Each word as its bytes' tokens and a bar after it."""
    of = lambda x: F.transform(F.regexp_extract_all(F.hex(F.encode(x, "UTF-8")), F.lit(".."), F.lit(0)), lambda h: F.concat(F.lit("<0x"), h, F.lit(">")))
    return F.flatten(F.transform(t, lambda x: F.concat(of(x), F.array(F.lit("|")))))


dec_query("dec_byte_fallback", lambda t: decode.byte_fallback()(_as_bytes(t)), "flatten(list_transform(w, lambda x: [x, '|']))")
dec_query("dec_bytelevel", lambda t: decode.byte_level()(F.transform(t, pretokenize.to_bytes)), "[array_to_string(w, '')]")

# --- added tokens
_ADDED = [added.AddedToken("the"), added.AddedToken("License", special=True), added.AddedToken("thth")]
piece_query("added_extract", lambda c: F.transform(added.extract(c, _ADDED), lambda p: p["piece"]), "list_filter(string_split(regexp_replace(t, '(License|thth|the)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')")
piece_query("added_hits", lambda c: F.transform(F.filter(added.extract(c, _ADDED), lambda p: p["hit"]), lambda p: p["piece"]), all_of("License|thth|the"))
piece_query("added_single_word", lambda c: F.transform(F.filter(added.extract(c, [added.AddedToken("the", single_word=True)]), lambda p: p["hit"]), lambda p: p["piece"]), r"list_filter(regexp_extract_all(t, '[\p{L}\p{N}]+'), lambda x: x = 'the')")
piece_query("added_strip_flags", lambda c: F.transform(F.filter(added.extract(c, [added.AddedToken("of", lstrip=True, rstrip=True)]), lambda p: p["hit"]), lambda p: p["piece"]), all_of(f"[{WS_UNICODE}]*of[{WS_UNICODE}]*"))
_TWICE = [added.AddedToken("The"), added.AddedToken("License", normalized=False)]
piece_query("added_normalized", lambda c: F.transform(added.extract(c, _TWICE, normalize.lowercase()), lambda p: p["piece"]), f"flatten(list_transform(string_split(regexp_replace(t, '(License)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: case when x = 'License' then [x] else list_filter(string_split(regexp_replace({LOWER.replace('(t,', '(x,')}, '(the)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda y: y <> '') end))")


# --- single characters, schemes and offsets of processors
def _class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each character of the texts with its classes and how often it stands there."""
    chars = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    flags = {"bert_punctuation": predicates.is_bert_punctuation, "punctuation": predicates.is_punctuation, "bert_whitespace": predicates.is_bert_whitespace, "whitespace": predicates.is_whitespace, "chinese": predicates.is_chinese}
    return chars.select("c", "n", *[f(F.col("c")).alias(name) for name, f in flags.items()], predicates.script_of(F.col("c")).isin("Latin").alias("latin"))


QUERIES["char_classes"] = _class_counts
SQL["char_classes"] = r"""select c, count(*) as n, regexp_full_match(c, '[!-/:-@\[-`{-~]|\p{P}') as bert_punctuation, regexp_full_match(c, '\p{P}') as punctuation, c in (' ', chr(9), chr(10), chr(13)) as bert_whitespace,
(unicode(c) between 9 and 13 or unicode(c) in (32, 133, 160, 5760, 8232, 8233, 8239, 8287, 12288) or unicode(c) between 8192 and 8202) as whitespace,
(unicode(c) between 19968 and 40959 or unicode(c) between 13312 and 19903 or unicode(c) between 131072 and 183983 or unicode(c) between 63744 and 64255 or unicode(c) between 194560 and 195103) as chinese,
regexp_full_match(c, '\p{Latin}') as latin from (select unnest(string_split(text, '')) as c from documents) where c <> '' group by c"""
piece_query(
    "pretok_metaspace_first",
    pretokenize.sequence(pretokenize.delimiter("."), pretokenize.metaspace(scheme="first")),
    f"flatten(list_transform(list_filter(string_split(t, '.'), lambda x: x <> ''), lambda x, i: regexp_extract_all(case when i = 1 and not starts_with({_MARKED.replace('(t,', '(x,')}, '▁') then '▁' else '' end || {_MARKED.replace('(t,', '(x,')}, '▁?[^▁]+|▁')))",
)


def trimmed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of byte-level pieces before and after their spaces are taken out."""
    pieces = pretokenize.with_offsets(pretokenize.byte_level_split(F.col("text")))
    rows = read(spark, sf_dir, "documents").select("doc_id", pieces.alias("p"))
    names = F.transform("p", lambda x: F.replace(x["value"], F.lit(" "), F.lit("Ġ")))
    rows = rows.select("doc_id", names.alias("tokens"), F.transform("p", lambda x: F.struct(x["start"], x["end"])).alias("offsets"))
    made = postprocess.byte_level_offsets(F.col("tokens"), F.col("offsets"), False)
    return _digest_pieces(rows, F.transform(made, lambda o: F.concat_ws(":", o["start"], o["end"])))


QUERIES["post_bytelevel_offsets"] = trimmed_offsets
SQL["post_bytelevel_offsets"] = f"""with p as (select doc_id, unnest(p) as x, generate_subscripts(p, 1) as i from (select doc_id, {_BYTE_PIECES} as p from (select doc_id, text as t from documents))),
o as (select doc_id, i, x, sum(length(x)) over (partition by doc_id order by i) as e from p),
s as (select *, e - length(x) as b, length(x) - length(ltrim(x, ' ')) as lead, length(x) - length(rtrim(x, ' ')) as tail from o)
select doc_id, count(*)::bigint as n, md5(string_agg(least(b + lead, e)::bigint || ':' || (case when lead = length(x) then e else e - tail end)::bigint, chr(31) order by i)) as digest from s group by doc_id"""

# --- all stages together
_WP_PLAIN = replace(V.WORDPIECE, add_bos=False, add_eos=False)
BERT = Pipeline(_WP_PLAIN, normalize.bert(), pretokenize.bert(), "[CLS] $A [SEP]", "[CLS] $A [SEP] $B:1 [SEP]:1", {"[CLS]": [1], "[SEP]": [2]})
#: The same as a file has it.
BERT_CONFIG = {
    "model": {"type": "WordPiece", "vocab": V.WORDPIECE.ids(), "unk_token": "[UNK]"},
    "normalizer": {"type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": True, "strip_accents": None, "lowercase": True},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "BertPreTokenizer"}]},
    "post_processor": {"type": "TemplateProcessing", "single": [{"SpecialToken": {"id": "[CLS]", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}, {"SpecialToken": {"id": "[SEP]", "type_id": 0}}], "special_tokens": {"[CLS]": {"ids": [1]}, "[SEP]": {"ids": [2]}}},
    "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": True},
}


def _pipe_ids(make: Callable[[], Pipeline]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _id_digest(make().encode(read(spark, sf_dir, "documents").select("doc_id", "text"), "text"))


QUERIES["pipe_bert"] = _pipe_ids(lambda: BERT)
QUERIES["pipe_config"] = _pipe_ids(lambda: config.pipeline_of(json.dumps(BERT_CONFIG)))
_BERT_TEXT = f"regexp_replace(lower(translate(regexp_replace({CLEAN}, {re2(f'([{CJK}])')}, ' \\1 ', 'g'), 'İΣ', 'iσ')), '\\p{{Mn}}+', '', 'g')".replace("(t,", "(text,")
_BERT_WORDS = f"regexp_extract_all({_BERT_TEXT}, {re2(f'(?s)[{PUNCT}]|[^{PUNCT}{WS_RE2}]+')})"
SQL["pipe_bert"] = SQL["pipe_config"] = WORDPIECE_WALK.replace("{words}", _BERT_WORDS) + "select doc_id, len(ids)::bigint as n, md5(array_to_string(ids, ',')) as digest from encoded"

BY_WORD = Pipeline(V.BPE, pretokenizer=pretokenize.whitespace(), single="[CLS] $A [SEP]", specials={"[CLS]": [101], "[SEP]": [102]})


def pipe_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every token of every text lies, its word and its string."""
    made = replace(BY_WORD, single=None).encode(read(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    each = F.transform(F.arrays_zip("offsets", "words", "tokens"), lambda x: F.concat_ws(":", x["offsets"]["start"], x["offsets"]["end"], x["words"], x["tokens"]))
    return _digest_pieces(made, each)


QUERIES["pipe_offsets"] = pipe_offsets
_WAYS = "|".join(re.escape(t) for t in sorted(V.BPE.tokens, key=lambda t: (-len(t), t)))
SQL["pipe_offsets"] = f"""with p as (select doc_id, unnest(p) as x, generate_subscripts(p, 1) as i from (select doc_id, {all_of(f'[{WORD}]+|[^{WORD}{WS_RE2}]+|[{WS_RE2}]', 'text')} as p from documents)),
w as (select *, regexp_full_match(x, '[{WS_RE2}]') as gap, count(*) filter (not regexp_full_match(x, '[{WS_RE2}]')) over (partition by doc_id order by i) - 1 as word from p),
k as (select doc_id, i, gap, word, unnest(q) as y, generate_subscripts(q, 1) as j from (select *, case when gap then [x] else regexp_extract_all(x, {quoted(f'(?s){_WAYS}|.')}) end as q from w)),
o as (select *, sum(length(y)) over (partition by doc_id order by i, j) as e from k)
select doc_id, count(*) filter (not gap)::bigint as n, md5(coalesce(string_agg((e - length(y))::bigint || ':' || e::bigint || ':' || word || ':' || (case when y in ({', '.join(map(quoted, V.BPE.tokens))}) then y else coalesce([{', '.join(map(quoted, V.BPE.tokens))}][unicode(y) + 1], '') end), chr(31) order by i, j) filter (not gap), '')) as digest from o group by doc_id"""


def pipe_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of every text, framed, with a stride."""
    made = BY_WORD.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", most=128, stride=32)
    return _id_digest(made.withColumn("last", F.col("sequence_ranges")[0]["end"].cast("bigint")), "part", "last")


QUERIES["pipe_overflow"] = pipe_overflow
_WORD_IDS = f"list_transform(flatten(list_transform({all_of(f'[{WORD}]+|[^{WORD}{WS_RE2}]+', 'text')}, lambda f: {_greedy_ids(V.BPE, 'f', _VALUE)})), lambda x: x::bigint)"
SQL["pipe_overflow"] = f"""select doc_id, k::int as part, case when len(x) > 0 then (len(x) + 1)::bigint end as last, (len(x) + 2)::bigint as n, md5(array_to_string([101::bigint] || x || [102::bigint], ',')) as digest
from (select doc_id, k, ids[k * 94 + 1 : k * 94 + 126] as x from (select doc_id, ids, unnest(range(greatest(ceil((len(ids) - 126) / 94.0), 0)::bigint + 1)) as k from (select doc_id, {_WORD_IDS} as ids from documents)))"""

PAIRED = Pipeline(V.SPM_UNK, single="[CLS] $A [SEP]", pair="[CLS] $A [SEP] $B:1 [SEP]:1", specials={"[CLS]": [101], "[SEP]": [102]})


def pipe_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    made = PAIRED.encode(rows.join(after, ["conv_id", "turn"]), "a", "b", most=131, pad_to=140)
    return made.select("conv_id", "turn", *[_joined(F.col(c)).alias(c) for c in ("ids", "type_ids", "special_tokens_mask", "attention_mask")])


QUERIES["pipe_pair"] = pipe_pair
_CUT = _FIRST.replace("512", "128").replace("256", "64")
_PAIR_CUT = f"(select conv_id, turn, a[1:n] as a, b[1:case when la + lb <= 128 then lb else 128 - n end] as b from (select *, ({_CUT}) as n from {_PAIRS}))"
_FILL = "list_transform(range(greatest(140 - len(a) - len(b) - 3, 0)), lambda i: {0})"
SQL["pipe_pair"] = f"""select conv_id, turn, md5(array_to_string([101] || a || [102] || b || [102] || {_FILL.format(0)}, ',')) as ids,
md5(array_to_string([0] || {_all('a', 0)} || [0] || {_all('b', 1)} || [1] || {_FILL.format(0)}, ',')) as type_ids,
md5(array_to_string([1] || {_all('a', 0)} || [1] || {_all('b', 0)} || [1] || {_FILL.format(1)}, ',')) as special_tokens_mask,
md5(array_to_string([1] || {_all('a', 1)} || [1] || {_all('b', 1)} || [1] || {_FILL.format(0)}, ',')) as attention_mask from {_PAIR_CUT}"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
