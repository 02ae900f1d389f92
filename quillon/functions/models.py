"""The four tokenization models as plain Python kernels, for Arrow functions and small driver-side use.

All of them match the longest vocabulary entry greedily.  What a fragment encodes to depends on the
fragment alone, so results are remembered by fragment.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import regex

from quillon.functions.regex import BPE_MODES
from quillon.schema import Vocab

META = "▁"
_BLANK = re.compile(r"[ \t\n\r]")
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNICODE_SPACE, _UNICODE_WORD = re.compile(f"[{_SPACES}]+"), re.compile(f"[^{_SPACES}]+")
#: Fragments whose results a model remembers, and the longest that it remembers.
CACHE, CACHED_LENGTH = 1 << 17, 64
#: Pieces whose tokens with their places are remembered.
WALKS = 1 << 15


class Longest:
    """Longest vocabulary entry at a place: the lengths to try, falling, by an entry's first two characters."""

    def __init__(self, ids: dict[str, int]) -> None:
        self.ids = ids
        lengths: dict[str, set[int]] = {}
        for t in ids:
            if t:
                lengths.setdefault(t[:2], set()).add(len(t))
        single = {t: n for t, n in lengths.items() if len(t) == 1}
        self.lengths = {c: sorted(n | single.get(c[0], set()), reverse=True) for c, n in lengths.items()}
        self.single = {c: 1 for c in single}

    def of(self, text: str, at: int) -> list[int]:
        """Lengths that entries beginning like the text may have, falling."""
        found = self.lengths.get(text[at : at + 2])
        return found if found is not None else [1] if text[at] in self.single else []

    def __call__(self, text: str, at: int) -> tuple[int, int]:
        ids, room = self.ids, len(text) - at
        for n in self.of(text, at):
            if n <= room and (k := ids.get(text[at : at + n])) is not None:
                return k, n
        return -1, 0


#: Vocabularies up to this size are also a prefix-tree expression, which is searched without Python steps.
SMALL = 512


def prefix_tree(tokens: Iterable[str]) -> str:
    """An expression for the longest of the tokens at a place, or any one character."""
    tree: dict = {}
    for t in filter(None, tokens):
        at = tree
        for c in t:
            at = at.setdefault(c, {})
        at[""] = {}

    def write(node: dict) -> str:
        ways = [re.escape(c) + write(rest) for c, rest in node.items() if c]
        body = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""
        return f"(?:{body})?" if "" in node and body else body

    return f"{write(tree)}|." if tree else "."


class Memo(dict):
    """What a function gave for fragments, forgotten all at once when there are too many."""

    def __init__(self, f, most: int = CACHE) -> None:
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, fragment: str):
        out = self.f(fragment)
        if len(fragment) <= CACHED_LENGTH and self.most:
            if len(self) >= self.most:
                self.clear()
            self[fragment] = out
        return out


class Model:
    kind = ""

    def __init__(self, vocab: Vocab) -> None:
        self.vocab, self.ids = vocab, vocab.ids()
        self.longest = Longest(self.ids)
        self.memo, self.sizes = Memo(self._fragment), Memo(lambda f: len(self.memo[f]))
        self.walks = Memo(self.walk, WALKS)
        self.scan = re.compile(prefix_tree(self.ids), re.S) if len(self.ids) <= SMALL and max(map(len, self.ids), default=0) <= CACHED_LENGTH else None
        self.unit = Memo(lambda p: self.ids[p] if p in self.ids else self.unknown(p))

    def set_cache(self, most: int) -> None:
        """How many fragments are remembered; 0 for none."""
        self.memo.most = self.sizes.most = most
        self.walks.most = min(most, WALKS)
        self.clear_cache()

    def clear_cache(self) -> None:
        self.memo.clear()
        self.sizes.clear()
        self.walks.clear()

    def unknown(self, piece: str) -> int | None:
        """The id of a character that begins no entry; None if it has none."""
        return self.vocab.unk

    def found(self, text: str) -> Iterator[int | None]:
        """Ids of the longest entries of a text, by the expression of a small vocabulary."""
        return map(self.unit.__getitem__, self.scan.findall(text))

    def fragments(self, text: str) -> list[str]:
        """The parts of a text that are encoded each by itself."""
        raise NotImplementedError

    def _fragment(self, text: str) -> tuple[int, ...]:
        raise NotImplementedError

    def body(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.fragments(text))))

    def size(self, text: str) -> int:
        """The number of ids of :meth:`body`."""
        return sum(map(self.sizes.__getitem__, self.fragments(text)))

    def encode(self, text: str | None) -> list[int] | None:
        if text is None:
            return None
        if not text:
            return []
        v = self.vocab
        return [*([v.bos] if v.add_bos and v.bos is not None else []), *self.body(text), *([v.eos] if v.add_eos and v.eos is not None else [])]

    def count(self, text: str | None) -> int | None:
        if not text:
            return None if text is None else 0
        v = self.vocab
        return self.size(text) + (v.add_bos and v.bos is not None) + (v.add_eos and v.eos is not None)

    def walk(self, fragment: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of a fragment's tokens, in characters of the fragment."""
        out, at = [], 0
        while at < len(fragment):
            k, n = self.longest(fragment, at)
            if not n:
                k, n = self.unknown(fragment[at]), 1
            if k is not None:
                out.append((k, at, at + n))
            at += n
        return out

    def parts(self, text: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
        """The text's fragments with their tokens, as the model itself cuts it."""
        return [(f, self.walk(f)) for f in self.fragments(text)]

    def piece(self, text: str) -> list[int]:
        """Ids of a piece that a pre-tokenizer has cut: the model's rule for one fragment, without marks around it."""
        return list(self.memo[text]) if text else []

    def tokens(self, ids: list[int]) -> list[str]:
        return [self.token(i) for i in ids]

    def token(self, i: int) -> str:
        return self.vocab.tokens[i] if 0 <= i < len(self.vocab.tokens) else ""

    def token_id(self, token: str) -> int:
        return self.ids.get(token, -1)

    def has_token(self, token: str) -> bool:
        return token in self.ids


def space_mark(vocab: Vocab) -> str:
    """The mark of a space: what the first entry that begins with a mark begins with."""
    return next((t[0] for t in vocab.tokens if t and (t[0] in "Ġ▁_" or "\u0100" <= t[0] <= "\u017f")), "")


def with_spaces(fragments: list[str], mark: str) -> list[str]:
    """Blank fragments are dropped, or with a mark carried over to the fragment after them."""
    blank = [not f.strip(" \t\n\r\x0b\x0c") for f in fragments]
    if not mark:
        return [f for f, b in zip(fragments, blank, strict=True) if not b]
    out, pending = [], 0
    for f, b in zip(fragments, blank, strict=True):
        if b:
            pending += len(f)
            continue
        if pending > 1:
            out.append(mark * (pending - 1))
        out.append(mark + f if pending else f)
        pending = 0
    return [*out, *([mark] * pending)]


def bpe_fragments(text: str, mode: str, mark: str = "") -> list[str]:
    if mode == "gemma4":
        return [text]
    if mode == "deepseek":
        return with_spaces(_deepseek(text), mark)
    head = []
    if mode == "starcoder":
        lead = re.match("[0-9]+", text)
        head, text = ([lead[0]], text[lead.end() :]) if lead else ([], text)
    parts = [*head, *_mode(BPE_MODES["gpt2" if mode == "starcoder" else mode]).findall(text)]
    if mode in ("llama3", "gpt4o", "qwen35"):
        parts = [p for p in parts if p.strip(" \t")]
    if mode == "starcoder":
        parts = [p for p in parts if not re.match(r"[\x00-\x08\x0b\x0c\x0e-\x1f!-&(-/:-@\[-`{-\x7f]", p)]
    return with_spaces(parts, mark)


def _deepseek(text: str) -> list[str]:
    """Rules one after the other; each one that finds something keeps only what it found."""
    parts = [text]
    for rule in ("[\r\n]+", " ?[A-Za-z\u00c0-\u024f]+"):
        parts = [m for p in parts for m in (re.findall(rule, p) or [p])]
    return [m for p in parts for m in (re.findall(r"[0-9]|[^0-9]+", p) or [p])]


@lru_cache(maxsize=32)
def _mode(pattern: str):
    return regex.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern))


class Bpe(Model):
    """Greedy longest match inside fragments; merges are not applied."""

    kind = "bpe"

    def __init__(self, vocab: Vocab) -> None:
        super().__init__(vocab)
        self.mark = space_mark(vocab)
        named = vocab.model.lower()
        self.mode = vocab.pre_type if vocab.pre_type != "default" else "gemma4" if "gemma" in named or "gemini" in named else "default"
        short = {t: k for t, k in self.ids.items() if t[:1] in "<[#" and t and 2 <= len(t.encode()) <= 32}
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(short, key=len, reverse=True))) if short else None
        self.starts = {t[0] for t in short}

    def body(self, text: str) -> list[int]:
        if text in self.ids:
            return [self.ids[text]]
        if self.special is None or not any(c in text for c in self.starts):
            return super().body(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += super().body(text[at : m.start()])
            out.append(self.ids[m[0]])
            at = m.end()
        return out + super().body(text[at:])

    def size(self, text: str) -> int:
        if self.special is None and text not in self.ids:
            return super().size(text)
        return len(self.body(text))

    def fragments(self, text: str) -> list[str]:
        return bpe_fragments(text, self.mode, self.mark) if text else []

    def chunked(self, text: str, chunk: int = 16384) -> list[int]:
        """Ids of a long text cut into chunks that are each encoded alone, without the scan for special tokens.

        Boundaries show: this is for comparison with engines that encode chunks side by side.  Here
        rows are what runs side by side, so nothing else uses it.
        """
        out: list[int] = []
        for part in chunks_of(text, chunk):
            out += chain.from_iterable(map(self.memo.__getitem__, self.fragments(part)))
        return out

    def plain(self, text: str) -> list[int]:
        """Ids without a search for long entries: a fragment is one entry or its characters are encoded one by one."""
        out: list[int] = []
        for f in self.fragments(text):
            out += [self.ids[f]] if f in self.ids else chain.from_iterable(map(self._unit, f))
        return out

    def walk(self, fragment: str) -> list[tuple[int, int, int]]:
        return super().walk(fragment) if self.memo[fragment] else []

    def parts(self, text: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
        if text in self.ids:
            return [(text, [(self.ids[text], 0, len(text))])]
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += super().parts(text[at : m.start()])
            out.append((m[0], [(self.ids[m[0]], 0, len(m[0]))]))
            at = m.end()
        return out + super().parts(text[at:])

    def _unit(self, c: str) -> tuple[int, ...]:
        k = self.unit[c]
        return () if k is None else (k,)

    def unknown(self, piece: str) -> int | None:
        """The unknown id, or the character's value; None if unknown characters are not encoded."""
        unk = self.vocab.unk
        return ord(piece) if unk is None and piece < "\x80" else -(ord(piece) + 1) if unk is None else unk if unk >= 0 else None

    def _fragment(self, text: str) -> tuple[int, ...]:
        """A fragment with a character that is not encoded has no ids at all."""
        if self.scan is not None:
            out = tuple(self.found(text))
            return () if None in out else out
        ids, at = [], 0
        while at < len(text):
            k, n = self.longest(text, at)
            if not n:
                k, n = self.unknown(text[at]), 1
                if k is None:
                    return ()
            ids.append(k)
            at += n
        return tuple(ids)

    def detokenize(self, ids: list[int]) -> str:
        out, before, v = bytearray(), "", self.vocab
        for i in ids:
            if (v.add_bos and i == v.bos) or (v.add_eos and i == v.eos):
                continue
            if not 0 <= i < len(v.tokens):
                if i < 0:
                    c = chr(-i - 1)
                    out += (" " if c == self.mark or (_UNICODE_SPACE.fullmatch(c) and c not in "\t\n\r") else c).encode("utf-8", "surrogatepass")
                elif i < 256:
                    out.append(i)
                before = ""
                continue
            t = v.tokens[i]
            if self.mark and t[:1] == self.mark:
                rest = t[1:]
                out += (" " if not rest or out else "").encode() + rest.encode()
                before = rest
                continue
            if not self.mark and before and t:
                last, first = before[-1], t[0]
                if _word(first) and (_word(last) or regex.match(r"\p{P}", last)):
                    out += b" "
            out += t.encode()
            before = t
        return out.decode("utf-8", "replace")


def _word(c: str) -> bool:
    return bool(re.match("[A-Za-z\u00c0-\u024f]", c)) and (c.isalpha() or c.isdigit())


def chunks_of(text: str, size: int) -> list[str]:
    """Cut every ``size`` bytes of UTF-8, but inside no character: the one at the cut stays before it."""
    out, now, held = [], 0, 0
    for at, c in enumerate(text):
        if held >= size:
            out.append(text[now:at])
            now, held = at, 0
        held += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
    return [*out, text[now:]] if text else []


def to_meta(text: str) -> str:
    return META + _BLANK.sub(META, text) if text else text


_WORDS = re.compile(f"{META}*[^{META}]+|{META}+")


def marks_lead(tokens: tuple[str, ...]) -> bool:
    """Whether ▁ stands only at the beginning of entries; then no entry reaches over the beginning of a word."""
    return not any(META in t.lstrip(META) for t in tokens)


class Spm(Model):
    kind = "spm"

    def __init__(self, vocab: Vocab) -> None:
        super().__init__(vocab)
        self.by_word = marks_lead(vocab.tokens)

    def fragments(self, text: str) -> list[str]:
        text = to_meta(text)
        return _WORDS.findall(text) if self.by_word else [text]

    def piece(self, text: str) -> list[int]:
        return self.body(text)

    def walk(self, fragment: str) -> list[tuple[int, int, int]]:
        """The mark that the model puts in front has no place in the fragment."""
        return [(k, max(a - 1, 0), b - 1) for k, a, b in super().walk(to_meta(fragment))]

    def parts(self, text: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
        return [(text, self.walk(text))] if text else []

    def body(self, text: str) -> list[int]:
        if self.scan is None:
            return super().body(text)
        out = list(self.found(to_meta(text)))
        return out if self.vocab.unk is not None else [i for i in out if i is not None]

    def size(self, text: str) -> int:
        if self.scan is None:
            return super().size(text)
        return len(self.scan.findall(to_meta(text))) if self.vocab.unk is not None else len(self.body(text))

    def _fragment(self, text: str) -> tuple[int, ...]:
        out, at, unk = [], 0, self.vocab.unk
        while at < len(text):
            k, n = self.longest(text, at)
            if n:
                out.append(k)
            elif unk is not None:
                out.append(unk)
            at += n or 1
        return tuple(out)

    def detokenize(self, ids: list[int]) -> str:
        out, before = "", ""
        for t in filter(None, map(self.token, ids)):
            t = t.replace(META, " ")
            if not before:
                t = t.lstrip(" \t\n\r")
            elif not _ends_blank(before) and not _ends_blank(t.encode()[:1]):
                out += " "
            out, before = out + t, t
        return out


def _ends_blank(text: str | bytes) -> bool:
    """Whether the last byte, read as a code point, is a space."""
    last = (text.encode() if isinstance(text, str) else text)[-1:]
    return last in (b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b" ", b"\x85", b"\xa0")


class Unigram(Model):
    """One edge leaves each place, the longest entry, unless ``viterbi`` asks for the best of all."""

    kind = "unigram"

    def __init__(self, vocab: Vocab, viterbi: bool = False) -> None:
        super().__init__(vocab)
        self.score, self.viterbi = vocab.score_of(), viterbi
        self.by_word = marks_lead(vocab.tokens) and not viterbi

    def segment(self, text: str) -> tuple[list[int], float]:
        text = to_meta(text)
        return self._best(text) if self.viterbi else self._greedy(text)

    def _greedy(self, text: str) -> tuple[list[int], float]:
        out, at, total = [], 0, 0.0
        while at < len(text):
            k, n = self.longest(text, at)
            if not n:
                if self.vocab.unk is None:
                    return [], 0.0
                k, n = self.vocab.unk, 1
            out.append(k)
            total += self.score[k]
            at += n
        return out, total

    def _best(self, text: str) -> tuple[list[int], float]:
        best, back = [0.0] + [-math.inf] * len(text), [(-1, 0)] * (len(text) + 1)
        for at in range(len(text)):
            if best[at] == -math.inf:
                continue
            edges = [(k, n) for n in self.longest.of(text, at) if at + n <= len(text) and (k := self.ids.get(text[at : at + n])) is not None]
            if not edges and self.vocab.unk is not None:
                edges = [(self.vocab.unk, 1)]
            for k, n in edges:
                if best[at] + self.score[k] > best[at + n]:
                    best[at + n], back[at + n] = best[at] + self.score[k], (k, at)
        if best[-1] == -math.inf:
            return [], 0.0
        out, at = [], len(text)
        while at:
            k, at = back[at]
            out.append(k)
        return out[::-1], best[-1]

    def fragments(self, text: str) -> list[str]:
        text = to_meta(text)
        return _WORDS.findall(text) if self.by_word else [text]

    def _fragment(self, text: str) -> tuple[int, ...] | None:
        """None if some character cannot be encoded; then the whole text has no ids."""
        ids = (self._best(text) if self.viterbi else self._greedy(text))[0]
        return tuple(ids) if ids or not text else None

    def body(self, text: str) -> list[int]:
        if self.scan is not None and not self.viterbi:
            out = list(self.found(to_meta(text)))
            return [] if None in out else out
        found = list(map(self.memo.__getitem__, self.fragments(text)))
        return [] if None in found else list(chain.from_iterable(found))

    def size(self, text: str) -> int:
        if self.vocab.unk is None:
            return len(self.body(text))
        return len(self.scan.findall(to_meta(text))) if self.scan is not None and not self.viterbi else super().size(text)

    def piece(self, text: str) -> list[int]:
        return self.body(text)

    def walk(self, fragment: str) -> list[tuple[int, int, int]]:
        """Every id takes as many characters as its entry, an unknown one takes one; without any way there is nothing."""
        out, at = [], 0
        text = to_meta(fragment)
        for k in self.segment(fragment)[0]:
            n = len(self.token(k)) if text.startswith(self.token(k), at) and self.token(k) else 1
            out.append((k, max(at - 1, 0), at + n - 1))
            at += n
        return out

    def parts(self, text: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
        return [(text, self.walk(text))] if text else []

    def detokenize(self, ids: list[int]) -> str:
        out, before = "", ""
        for t in filter(None, map(self.token, ids)):
            t = t.replace(META, " ")
            t = t if before else t.lstrip(" \t\n\r")
            out, before = out + t, t
        return out


class WordPiece(Model):
    kind = "wordpiece"
    SPECIAL = frozenset(("[CLS]", "[SEP]", "<s>", "</s>", "[PAD]", "[UNK]"))

    def __init__(self, vocab: Vocab) -> None:
        super().__init__(vocab)
        self.gap = next((self.ids[t] for t in (" ", " ##", "##") if t in self.ids), None)

    def _goes_on(self, found: list[tuple[int, int, int]]) -> bool:
        return bool(found) and self.token(found[-1][0]).startswith("##")

    def walk(self, fragment: str) -> list[tuple[int, int, int]]:
        """Roots from the left; where none fits, an unknown id for each byte that is left, and then continuations."""
        out: list[tuple[int, int, int]] = []
        at, size = 0, len(fragment)
        while at < size:
            k, n = self.longest(fragment, at)
            if not n:
                if self.vocab.unk is not None:
                    out += [(self.vocab.unk, at, size)] * len(fragment[at:].encode("utf-8", "surrogatepass"))
                break
            if self._goes_on(out) and not self.token(k).startswith("##"):
                break
            out.append((k, at, at + n))
            at += n
        if out and not self._goes_on(out):
            while at < size:
                k, n = self.longest("##" + fragment[at:], 0)
                if n <= 2:
                    break
                out.append((k, at, at + n - 2))
                at += n - 2
        return out

    def _fragment(self, word: str) -> tuple[int, ...]:
        return tuple(k for k, _, _ in self.walk(word))

    def fragments(self, text: str) -> list[str]:
        return _UNICODE_WORD.findall(text)

    def body(self, text: str) -> list[int]:
        if self.gap is None:
            return super().body(text)
        found = list(map(self.memo.__getitem__, self.fragments(text)))
        return list(chain(*found[:1], *((self.gap, *ids) if ids else () for ids in found[1:]))) if found else []

    def size(self, text: str) -> int:
        return super().size(text) if self.gap is None else len(self.body(text))

    def detokenize(self, ids: list[int]) -> str:
        out = ""
        for t in filter(None, map(self.token, ids)):
            if t not in self.SPECIAL:
                out += t[2:] if t.startswith("##") else (" " if out else "") + t
        return out


MODELS: dict[str, type[Model]] = {m.kind: m for m in (Bpe, Spm, Unigram, WordPiece)}


def register(kind: str, model: type[Model]) -> None:
    MODELS[kind] = model


_MADE: dict[str, Model] = {}


def shared_model(vocab: Vocab) -> Model:
    """The model of a vocabulary, built once in each process and remembered for the last few vocabularies."""
    key = vocab.key()
    if key not in _MADE:
        while len(_MADE) >= 4:
            del _MADE[next(iter(_MADE))]
        _MADE[key] = new_model(vocab)
    return _MADE[key]


def new_model(vocab: Vocab) -> Model:
    """The model that the vocabulary names; with merges and an unknown name, byte pairs."""
    kind = vocab.model if vocab.model in MODELS else "bpe" if vocab.tokens and vocab.merges else None
    if kind is None:
        raise ValueError(f"no model is called {vocab.model!r}")
    return MODELS[kind](vocab)
