"""Character classes and expressions that mean the same to Java and to RE2."""

from __future__ import annotations

import re

#: White space: of the tokenization models, of RE2's \s, and of Unicode (inside a class).
WS4, WS_RE2 = r" \t\n\r", r"\t\n\f\r "
WS_UNICODE = r"\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = "0-9A-Za-z_"
#: Punctuation of BERT: the ASCII marks and the Unicode category.
PUNCT = r"!-/:-@\[-`{-~\p{P}"
#: The ideograph blocks that BERT pads with spaces.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B920}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
#: Control characters that BERT's clean-up drops: all but tab, newline and return.
CONTROL = r"\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}\x{00AD}\x{0600}-\x{0605}\x{061C}\x{06DD}\x{070F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{FFFD}"

# --- classes of the byte-pair pre-tokenization modes
SP, NL, LETTER, DIGIT = r"[ \t]", r"[\r\n]", "[A-Za-z]", "[0-9]"
ASCII_OTHER = r"\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}!-/:-@\[-`{-\x{007F}"
BEYOND_ASCII = r"[^\x{0000}-\x{007F}]"
CONTRACTION = "'(?:[rR][eE]|v[eE]|l[lL]|[sStTmMdD])"
BPE_MODES = {
    "qwen2": f"{SP}+|{NL}+|{DIGIT}+|{CONTRACTION}|{LETTER}+|(?:[{ASCII_OTHER}]|{BEYOND_ASCII})+",
    "gpt2": f"(?:{SP}|{NL})+|{CONTRACTION}|{LETTER}+|{DIGIT}|[{ASCII_OTHER}]+|{BEYOND_ASCII}",
    "llama3": f"{SP}+|{NL}+|{DIGIT}{{1,3}}|{CONTRACTION}|{LETTER}+|(?:[{ASCII_OTHER}]|{BEYOND_ASCII})+",
    "default": f"(?:{SP}|{NL})+|{LETTER}+|{DIGIT}|[{ASCII_OTHER}]+|{BEYOND_ASCII}",
    "falcon": f"{SP}+|{NL}+|{DIGIT}{{1,3}}|{LETTER}+|[{ASCII_OTHER}]+|{BEYOND_ASCII}",
}
BPE_MODES["stablelm2"] = BPE_MODES["qwen2"]
BPE_MODES["gpt4o"] = BPE_MODES["llama3"]
BPE_MODES["qwen35"] = f"{SP}+|{NL}+|{DIGIT}+|{CONTRACTION}|{LETTER}+|[{ASCII_OTHER}]+|{BEYOND_ASCII}"

#: The byte-level splitting expression: contractions, then words, numbers and marks with an optional space before.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\t\n\f\r \p{L}\p{N}]+"


def alternation(tokens: list[str]) -> str:
    """Greedy longest match as an expression: the tokens, longest first, then any one character."""
    return "(?s)(?:" + "|".join(quote(t) for t in sorted(set(tokens), key=lambda t: (-len(t), t)) if t) + "|.)"


def longest_of(tokens: list[str], or_any: bool = True) -> str:
    """The same matches as :func:`alternation`, as a prefix tree: a place is tried once for each character.

    Branches begin with different characters and the longer way is tried first, so the longest entry
    wins.  Without ``or_any`` characters that begin no entry are passed over.
    """
    tree: dict = {}
    for t in tokens:
        node = tree
        for c in t:
            node = node.setdefault(c, {})
        if t:
            node[""] = {}

    def written(node: dict) -> str:
        ways = [quote(c) + written(below) for c, below in sorted(node.items()) if c]
        if not ways:
            return ""
        leaves = [quote(c) for c, below in sorted(node.items()) if c and list(below) == [""]]
        body = "|".join(w for w in ways)
        if len(leaves) == len(ways) > 1 and all(len(x) == 1 for x in leaves):
            body = "[" + "".join(leaves) + "]"
        elif len(ways) > 1 or "" in node:
            body = f"(?:{body})"
        return body + ("?" if "" in node else "")

    body = written(tree)
    return f"(?s){body}|." if or_any and body else "(?s)." if or_any else f"(?s){body}"


def quote(text: str) -> str:
    """``text`` as an expression that matches it in both dialects."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-/&#~ ])", r"\\\1", text).replace("\n", r"\n").replace("\t", r"\t").replace("\\ ", "[ ]").replace(r"\/", "/").replace(r"\#", "[#]").replace(r"\~", "~").replace(r"\&", "&")
