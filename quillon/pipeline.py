"""All stages together: normalise, find added tokens, pre-tokenize, encode, truncate, frame, pad; and back to text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.layout import lay_out
from quillon.operators import encode as E
from quillon.operators import encoding, postprocess
from quillon.operators.added import AddedVocabulary
from quillon.schema import Vocab

FIELDS = ("ids", "tokens", "words", "offsets")


@dataclass(frozen=True)
class Pipeline:
    """Stages that are None are left out.

    With a pre-tokenizer each piece is encoded by itself, by the model's rule for a piece; without one
    the model's own rules apply.  Begin and end ids of the vocabulary's configuration go around the
    whole text in both cases.  ``single`` and ``pair`` are templates over ``specials``.
    """

    vocab: Vocab
    normalizer: Callable[[Column], Column] | None = None
    pretokenizer: Callable[[Column], Column] | None = None
    single: str | list[str] | None = None
    pair: str | list[str] | None = None
    specials: dict[str, list[int]] = field(default_factory=dict)
    decoder: Callable[[Column], Column] | None = None
    added: AddedVocabulary | None = None

    def normalised(self, text: Column) -> Column:
        return self.normalizer(text) if self.normalizer else text

    def pieces(self, text: Column) -> Column | None:
        """Pieces of a normalised text; added tokens are pieces that are not cut further."""
        if self.added is None:
            return self.pretokenizer(text) if self.pretokenizer else None
        cut = self.pretokenizer or (lambda c: F.array(c))
        parts = self.added.extract(text)
        return F.flatten(F.transform(parts, lambda p: F.when(p["hit"], F.array(p["piece"])).otherwise(cut(p["piece"]))))

    def model(self) -> Vocab:
        return self.vocab if self.added is None else self.added.vocab()

    def _framed(self, inner: Column, text: Column) -> Column:
        return E.framed(inner, self.vocab, text)

    def ids(self, text: Column) -> Column:
        """Ids of whole texts, without a template."""
        c = self.normalised(text)
        pieces = self.pieces(c)
        if pieces is None:
            return E.encode(c, self.vocab)
        return self._framed(F.flatten(E.encode_pieces(pieces, self.model())), c)

    def count(self, text: Column) -> Column:
        if self.pretokenizer is None and self.added is None:
            return E.count(self.normalised(text), self.vocab)
        return F.size(self.ids(text))

    def decode(self, ids: Column) -> Column:
        if self.decoder is None:
            return E.detokenize(ids, self.model())
        return F.array_join(self.decoder(E.tokens(ids, self.model())), "")

    def _laid_out(self, text: Column) -> Column:
        c = self.normalised(text)
        return lay_out(c, self.model(), self.pieces(c))

    def encode(
        self,
        df: DataFrame,
        text: str,
        second: str | None = None,
        most: int | None = None,
        strategy: str = "longest_first",
        stride: int | None = None,
        pad_to: int | None = None,
        pad_id: int = 0,
        pad_type: int = 0,
        pad_token: str = "[PAD]",
        pad_left: bool = False,
    ) -> DataFrame:
        """``df`` with the fields of an encoding; offsets are characters of the normalised text.

        ``most`` truncates to so many tokens with the template's.  With ``stride`` what is cut off
        comes as further rows (``part``, and ``part_b`` for pairs: every part of one with every part of
        the other), which share ``stride`` tokens with the part before.
        """
        template = self.single if second is None else self.pair
        pieces = postprocess.parse_template(template) if template else postprocess.parse_template("$A" if second is None else "$A $B:1")
        out = df.withColumn("__a", self._laid_out(F.col(text)))
        sides = {"A": "__a"}
        if second is not None:
            out = out.withColumn("__b", self._laid_out(F.col(second)))
            sides["B"] = "__b"
        if most is not None:
            room = most - postprocess.added(pieces, self.specials)
            if room < 1:
                raise ValueError("the template alone is longer than that")
            lengths = {"A": F.lit(room)}
            if second is not None:  # both lengths are settled before either side is cut
                first, other = encoding.pair_lengths(F.size("__a.ids"), F.size("__b.ids"), room, strategy)
                out = out.withColumns({"__n_a": first, "__n_b": other})
                lengths = {"A": F.col("__n_a"), "B": F.col("__n_b")}
            for side, column in sides.items():
                part = "part" if side == "A" else "part_b"
                out = encoding.struct_windows(out, column, FIELDS, lengths[side], stride, part)
        made = postprocess.apply_to_encodings(pieces, self.specials, {s: F.col(c) for s, c in sides.items()})
        out = out.withColumns(made).drop("__a", "__b", "__n_a", "__n_b")
        if pad_to is not None:
            empty = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
            fills = {"ids": F.lit(pad_id).cast("bigint"), "type_ids": F.lit(pad_type), "tokens": F.lit(pad_token), "offsets": empty, "special_tokens_mask": F.lit(1), "attention_mask": F.lit(0), "words": F.lit(-1)}
            if pad_left:  # a step of its own: in one with the new ids, the function would see their length
                shift = F.greatest(F.lit(pad_to) - F.size("ids"), F.lit(0))
                out = out.withColumn("sequence_ranges", F.transform_values("sequence_ranges", lambda k, r: F.struct((r["start"] + shift).alias("start"), (r["end"] + shift).alias("end"))))
            out = out.withColumns({c: encoding.padded(F.col(c), F.lit(pad_to), v, pad_left) for c, v in fills.items()})
        return out
