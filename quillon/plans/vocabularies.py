"""Small vocabularies that the named queries use."""

from __future__ import annotations

from quillon.schema import Vocab

_PARTS = ("th", "er", "on", "an", "the", "in", "ion", "le", "de", "en", "ch", "ung", "ción", "eau", "a", "e", "i", "o", "u", "n", "s", "t", "r", "l", "d")
SPM = Vocab("spm", ("<unk>", "<s>", "</s>", "▁", "▁the", "▁de", "▁of", *_PARTS))
SPM_UNK = Vocab("spm", SPM.tokens, unk=0)
UNIGRAM = Vocab("unigram", SPM.tokens, scores=tuple(-0.25 * k for k in range(len(SPM.tokens))), unk=0)
BPE = Vocab("bpe", (*_PARTS, "tion", "and", "ou", "é", "ß"), pre_type="gpt2")
BPE_SPECIAL = Vocab("bpe", ("<s>", "[SEP]", "Ġ", "Ġthe", *_PARTS), pre_type="qwen2", bos=0, add_bos=True)
WORDPIECE = Vocab("wordpiece", ("[UNK]", "[CLS]", "[SEP]", *_PARTS, *("##" + p for p in _PARTS)), unk=0, bos=1, eos=2, add_bos=True, add_eos=True)
