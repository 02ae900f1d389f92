"""Encodings as columns: truncation, strides, padding, merging and alignment look-ups.

An encoding is a set of array columns of one length; overflowing parts are further rows (part 0 is
the head).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truncated(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def windows(ids: Column, most: int, stride: int = 0) -> Column:
    """The head and the overflowing windows of ``most`` elements that share ``stride`` with the one before."""
    if most <= stride or most < 1:
        raise ValueError("the length must be above 0 and above the stride")
    step = most - stride
    more = F.greatest(F.ceil((F.size(ids) - most) / F.lit(step)), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), more), lambda k: F.slice(ids, k * step + 1, most))


def parts(df: DataFrame, ids: str, most: int, stride: int = 0) -> DataFrame:
    """One row for each window: the columns of ``df`` without ``ids``, with part and ids."""
    return df.select(*[c for c in df.columns if c != ids], F.posexplode(windows(F.col(ids), most, stride)).alias("part", ids))


def pair_lengths(first: Column, second: Column, most: int, strategy: str = "longest_first") -> tuple[Column, Column]:
    """Lengths after truncating a pair to ``most`` in all; longest_first takes from the longer, on a tie from the second."""
    over = F.greatest(first + second - most, F.lit(0))
    if strategy == "only_first":
        return F.greatest(first - over, F.lit(0)), second
    if strategy == "only_second":
        return first, F.greatest(second - over, F.lit(0))
    # the shorter one stays whole while it is below half; else both come to half, the odd element to the first
    upper, lower = F.lit(most - most // 2), F.lit(most // 2)
    a = F.when(over == 0, first).when(first <= upper, F.greatest(first, F.least(first, F.lit(most) - second)))
    a = a.when(second <= lower, F.lit(most) - second).otherwise(upper)
    return a, F.when(over == 0, second).otherwise(F.lit(most) - a)


def padded(ids: Column, target: Column | int, value, left: bool = False) -> Column:
    """``ids`` filled up to ``target`` elements with ``value``."""
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(target) - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def attention(ids: Column, target: Column | int, left: bool = False) -> Column:
    return padded(F.transform(ids, lambda x: F.lit(1)), target, 0, left)


def pad_batches(df: DataFrame, ids: str, batch: str, value, multiple: int = 1, left: bool = False) -> DataFrame:
    """Pads ``ids`` to the longest of each batch; the lengths are aggregated and joined, no batch is gathered."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("__longest"))
    out = df.join(longest, batch)
    target = (F.ceil(F.col("__longest") / multiple) * multiple).cast("int")
    return out.withColumn(ids, padded(F.col(ids), target, value, left)).drop("__longest")


def merged_offsets(first: Column, second: Column, growing: bool = True) -> Column:
    """Offsets of two encodings one after the other; growing: the second begins where the first ends."""
    if not growing:
        return F.concat(first, second)
    shift = F.coalesce(F.element_at(first, F.when(F.size(first) > 0, -1).otherwise(F.lit(None)))["end"], F.lit(0))
    return F.concat(first, F.transform(second, lambda o: F.struct((o["start"] + shift).alias("start"), (o["end"] + shift).alias("end"))))


def ranges(df: DataFrame, keys: list[str], type_ids: str, special: str) -> DataFrame:
    """(keys, sequence, start, end): where each sequence's tokens lie, special tokens left out."""
    each = df.select(*keys, F.posexplode(F.arrays_zip(F.col(type_ids).alias("t"), F.col(special).alias("s"))).alias("pos", "x"))
    return each.filter("x.s = 0").groupBy(*keys, F.col("x.t").alias("sequence")).agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))


def word_to_tokens(words: Column, word: Column | int) -> Column:
    """(start, end) of the tokens of a word; null if it has none."""
    first = F.array_position(words, F.lit(word))
    last = F.size(words) - F.array_position(F.reverse(words), F.lit(word)) + 1
    return F.when(first > 0, F.struct((first - 1).cast("int").alias("start"), last.cast("int").alias("end")))


def word_to_chars(words: Column, offsets: Column, word: Column | int) -> Column:
    span = word_to_tokens(words, word)
    return F.when(span.isNotNull(), F.struct(F.get(offsets, span["start"])["start"].alias("start"), F.get(offsets, span["end"] - 1)["end"].alias("end")))


def token_to_word(words: Column, token: Column | int) -> Column:
    """The word of a token; null if it has none or there is no such token."""
    word = F.get(words, F.lit(token))
    return F.when(word >= 0, word)


def token_to_chars(offsets: Column, token: Column | int) -> Column:
    """(start, end) of a token's characters; null if there is no such token."""
    return F.get(offsets, F.lit(token))


def char_to_token(offsets: Column, at: Column | int) -> Column:
    """The first token over a character; null if there is none.  One pass over the offsets."""
    over = F.transform(offsets, lambda o: (o["start"] <= F.lit(at)) & (F.lit(at) < o["end"]))
    place = F.array_position(over, F.lit(True))
    return F.when(place > 0, (place - 1).cast("int"))


def char_to_word(words: Column, offsets: Column, at: Column | int) -> Column:
    """The word of the first token over a character."""
    place = F.array_position(F.transform(offsets, lambda o: (o["start"] <= F.lit(at)) & (F.lit(at) < o["end"])), F.lit(True))
    word = F.get(words, (place - 1).cast("int"))  # null where the place is 0
    return F.when(word >= 0, word)


def token_to_sequence(type_ids: Column, special: Column, token: Column | int) -> Column:
    i = F.lit(token)
    return F.when((i >= 0) & (i < F.size(type_ids)) & (F.get(special, i) == 0), F.get(type_ids, i))


def numbered_batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """A batch number from an increasing integer key."""
    return df.withColumn("batch", F.expr(f"{order} div {int(size)}"))


def struct_windows(df: DataFrame, column: str, fields: tuple[str, ...], most: Column, stride: int | None, part: str) -> DataFrame:
    """A column of parallel arrays cut to ``most`` elements; with ``stride`` one row for each window, numbered in ``part``."""
    whole = F.col(column)
    cut = lambda start, n: F.struct(*[F.slice(whole[f], start, n).alias(f) for f in fields])
    if stride is None:
        return df.withColumn(column, cut(F.lit(1), F.greatest(most, F.lit(0))))
    step = F.greatest(most - stride, F.lit(1))
    more = F.greatest(F.ceil((F.size(whole[fields[0]]) - most) / step), F.lit(0)).cast("int")
    return df.withColumn(part, F.explode(F.sequence(F.lit(0), more))).withColumn(column, cut(F.col(part) * step + 1, F.greatest(most, F.lit(0))))


def sequence_ranges(type_ids: Column, special: Column, sequences: int = 2) -> Column:
    """Map of each sequence to (start, end) of its tokens, special tokens left out; sequences without tokens are not in it."""
    own = lambda s: F.zip_with(type_ids, special, lambda t, x: (t == s) & (x == 0))
    entries = []
    for s in range(sequences):
        first, back = F.array_position(own(s), F.lit(True)), F.array_position(F.reverse(own(s)), F.lit(True))
        span = F.struct((first - 1).cast("int").alias("start"), (F.size(type_ids) - back + 1).cast("int").alias("end"))
        entries.append(F.when(first > 0, F.struct(F.lit(s).alias("key"), span.alias("value"))))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def sequence_ids(ranges_map: Column, size: Column, sequences: int = 2) -> Column:
    """For each token the sequence whose range it lies in; null for the others."""
    place = lambda i: F.coalesce(*[F.when((i >= ranges_map[s]["start"]) & (i < ranges_map[s]["end"]), s) for s in range(sequences)])
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), place)).otherwise(F.array().cast("array<int>"))


def n_sequences(ranges_map: Column) -> Column:
    """How many sequences there are; an encoding without ranges is one sequence."""
    return F.greatest(F.size(ranges_map), F.lit(1))


def merge_encodings(encodings: list[Column], growing: bool = False, sequences: int = 2) -> dict[str, Column]:
    """The fields of several encodings (structs) one after the other.

    ``growing``: each one's offsets begin where the last one ended.  Null encodings are left out.  A
    token's type is the sequence whose range it lies in, or its own type where it lies in none; ranges
    are made anew from the types, so those that hold only special tokens go.
    """
    def all_of(name: str, kind: str) -> Column:
        return F.concat(*[F.coalesce(e[name], F.array().cast(f"array<{kind}>")) for e in encodings])

    shift = F.lit(0)
    offsets = []
    for e in encodings:
        own = F.coalesce(e["offsets"], F.array().cast("array<struct<start:int,end:int>>"))
        offsets.append(F.transform(own, _shifted(shift)) if growing else own)
        shift = shift + F.coalesce(F.try_element_at(own, F.lit(-1))["end"], F.lit(0))
    types = F.concat(*[F.coalesce(_own_types(e, sequences), F.array().cast("array<int>")) for e in encodings])
    special = all_of("special_tokens_mask", "int")
    return {
        "ids": all_of("ids", "bigint"),
        "type_ids": types,
        "tokens": all_of("tokens", "string"),
        "offsets": F.concat(*offsets),
        "special_tokens_mask": special,
        "attention_mask": all_of("attention_mask", "int"),
        "words": all_of("words", "int"),
        "sequence_ranges": sequence_ranges(types, special, sequences),
    }


def _shifted(by: Column):
    return lambda o: F.struct((o["start"] + by).cast("int").alias("start"), (o["end"] + by).cast("int").alias("end"))


def _own_types(e: Column, sequences: int) -> Column:
    known = sequence_ids(F.coalesce(e["sequence_ranges"], F.create_map().cast("map<int,struct<start:int,end:int>>")), F.size(e["type_ids"]), sequences)
    return F.zip_with(known, e["type_ids"], lambda s, t: F.coalesce(s, t))


def new_encoding(ids: Column, tokens: Column, type_id: int = 0) -> dict[str, Column]:
    """The fields of an encoding from ids and tokens: nothing special, no words, no offsets."""
    each = lambda v: F.transform(ids, lambda x: v)
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    return {
        "ids": ids,
        "type_ids": each(F.lit(type_id)),
        "tokens": tokens,
        "offsets": each(zero),
        "special_tokens_mask": each(F.lit(0)),
        "attention_mask": each(F.lit(1)),
        "words": each(F.lit(None).cast("int")),
        "sequence_ranges": F.when(F.size(ids) > 0, F.create_map(F.lit(type_id), F.struct(F.lit(0).alias("start"), F.size(ids).alias("end")))).otherwise(F.create_map().cast("map<int,struct<start:int,end:int>>")),
    }


# --- spans: structs of start and end


def span_length(span: Column) -> Column:
    return F.greatest(span["end"] - span["start"], F.lit(0))


def span_contains(span: Column, at: Column | int) -> Column:
    return (span["start"] <= F.lit(at)) & (F.lit(at) < span["end"])


def span_first(span: Column) -> Column:
    """The first, and least, element; null if there is none."""
    return F.when(span_length(span) > 0, span["start"])


def span_last(span: Column) -> Column:
    """The last, and greatest, element; null if there is none."""
    return F.when(span_length(span) > 0, span["end"] - 1)
