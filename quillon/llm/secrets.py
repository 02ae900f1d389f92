"""Secret scans: one minimised automaton for all rules, run over the bytes in a single pass.

The rule regexes are parsed into one non-deterministic automaton, made deterministic by subset
construction and minimised into a transition array over byte classes.  The array is run over a whole
batch at once: the batch's bytes are cut into lanes that advance together, each lane assuming that
the lane before it ends in the start state; lanes for which that is wrong are run again from the
right state until both runs agree, so the states are those of one sequential pass.  Where a rule
accepts, a reversed automaton finds the leftmost start and an anchored one the longest end.

Defined cases: null text counts as empty; spans are in code points, end exclusive; matches of one
rule never overlap, those of different rules may; a match that fails its rule's length test is
dropped, and the text it covers is not scanned again for that rule. Repeated rows are scanned alike;
very long texts are scanned whole; other columns are kept by :func:`redact` and ignored otherwise,
whatever their names; one output row for each input row, so an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import map_batches, slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``minimum`` is the least length of the match, or with ``tail`` of the assigned value."""

    kind: str
    pattern: str
    minimum: int = 0
    tail: bool = False
    ignore_case: bool = False


#: The three base rules come first; spans that start together are ordered as listed here.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 12, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 30),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


# --- regex to automaton -------------------------------------------------------------------------


def _parse(pattern: str, ignore_case: bool):
    """Syntax tree of the small dialect used by the rules: classes, groups, ``|``, ``?``, ``*``, ``+``."""
    at = 0

    def escape() -> int:
        nonlocal at
        c = pattern[at + 1]
        if c == "x":
            at += 4
            return int(pattern[at - 2 : at], 16)
        at += 2
        return ord(c)

    def both(chars: set[int]) -> frozenset[int]:
        return frozenset(chars | {ord(chr(c).swapcase()) for c in chars if ignore_case and c < 128 and chr(c).isalpha()})

    def atom():
        nonlocal at
        c = pattern[at]
        if c == "(":
            at += 1
            inner = alternatives()
            at += 1
            return inner
        if c == "[":
            at += 1
            chars: set[int] = set()
            while pattern[at] != "]":
                low = high = escape() if pattern[at] == "\\" else ord(pattern[at])
                at += pattern[at] != "\\" and ord(pattern[at]) == low
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    high = ord(pattern[at + 1])
                    at += 2
                chars.update(range(low, high + 1))
            at += 1
            return ("set", both(chars))
        if c == "\\":
            return ("set", both({escape()}))
        at += 1
        return ("set", both({ord(c)}))

    def sequence():
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            part = atom()
            while at < len(pattern) and pattern[at] in "?*+":
                part = (pattern[at], part)
                at += 1
            parts.append(part)
        return ("seq", parts)

    def alternatives():
        nonlocal at
        options = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            options.append(sequence())
        return ("alt", options)

    return alternatives()


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.steps: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1

    def add(self, node, start: int, backwards: bool) -> int:
        """Wire ``node`` from ``start``; returns its end state."""
        kind, arg = node
        if kind == "set":
            self.steps[start].append((arg, end := self.state()))
            return end
        if kind == "seq":
            for part in reversed(arg) if backwards else arg:
                start = self.add(part, start, backwards)
            return start
        end = self.state()
        if kind == "alt":
            for option in arg:
                self.empty[start].append(first := self.state())
                self.empty[self.add(option, first, backwards)].append(end)
            return end
        self.empty[start].append(first := self.state())
        last = self.add(arg, first, backwards)
        self.empty[last].append(end)
        if kind in "?*":
            self.empty[start].append(end)
        if kind in "*+":
            self.empty[last].append(first)
        return end

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Automaton:
    """``step[state * classes + classes_of[byte]]`` is the next state times ``classes``; state 0 starts."""

    classes_of: np.ndarray
    classes: int
    step: np.ndarray
    accept: np.ndarray  # bit k: rule k

    def longest(self, data: bytes, start: int, stop: int, by: int) -> int:
        """Length of the longest match from ``start``, walking ``by`` = 1 or -1 towards ``stop``; 0 if none."""
        state, best, at, step, of = 0, 0, start, self.rows, self.of
        while at != stop:
            state = step[state + of[data[at]]]
            if state == self.dead:
                break
            at += by
            if self.accepts[state]:
                best = abs(at - start)
        return best

    def __post_init__(self) -> None:
        self.rows, self.of = self.step.tolist(), self.classes_of.tolist()
        self.accepts = {s * self.classes: bool(a) for s, a in enumerate(self.accept)}
        n = len(self.accept)
        self.dead = next((s * self.classes for s in range(n) if not self.accept[s] and (self.step[s * self.classes : (s + 1) * self.classes] == s * self.classes).all()), -1)


def compile_rules(patterns: list[tuple[str, bool]], anywhere: bool, backwards: bool = False) -> Automaton:
    """Subset construction over byte classes, then minimisation by partition refinement.

    ``anywhere``: a match may begin at any byte.
    """
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for k, (pattern, ignore_case) in enumerate(patterns):
        nfa.empty[root].append(first := nfa.state())
        ends[nfa.add(_parse(pattern, ignore_case), first, backwards)] = k
    sets = {chars for steps in nfa.steps for chars, _ in steps}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    classes_of = np.array([kinds[s] for s in signature], np.uint8)
    sample = [signature.index(s) for s in kinds]

    begin = nfa.closure([root])
    index, order, table = {begin: 0}, deque([begin]), []
    while order:
        now = order.popleft()
        row = []
        for b in sample:
            to = nfa.closure({t for s in now for chars, t in nfa.steps[s] if b in chars} | (begin if anywhere else set()))
            if to not in index:
                index[to] = len(index)
                order.append(to)
            row.append(index[to])
        table.append(row)
    accept = [sum(1 << ends[s] for s in states if s in ends) for states in index]

    block = [sorted(set(accept)).index(a) for a in accept]
    while True:
        keys = [(block[s], *(block[t] for t in row)) for s, row in enumerate(table)]
        number: dict[tuple, int] = {}
        refined = [number.setdefault(k, len(number)) for k in keys]
        if len(number) == len(set(block)):
            break
        block = refined
    size = len(set(block))  # the start state keeps number 0 because it is numbered first
    number = {}
    block = [number.setdefault(b, len(number)) for b in block]
    step, final = np.zeros((size, len(sample)), np.int32), np.zeros(size, np.int32)
    for s, row in enumerate(table):
        step[block[s]] = [block[t] for t in row]
        final[block[s]] = accept[s]
    return Automaton(classes_of, len(sample), (step * len(sample)).reshape(-1), final)


def states_after(dfa: Automaton, data: np.ndarray, lanes: int = 4096) -> np.ndarray:
    """The state after each byte of ``data``, as one left-to-right pass would give it."""
    n = len(data)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    kinds = np.zeros(lanes * steps, np.uint8)
    kinds[:n] = dfa.classes_of[data]
    columns = np.ascontiguousarray(kinds.reshape(lanes, steps).T).astype(np.int32)
    out = np.empty((steps, lanes), np.int32)
    state = np.zeros(lanes, np.int32)
    for k in range(steps):
        state = np.take(dfa.step, state + columns[k])
        out[k] = state
    for lane in range(1, lanes):  # a lane that began in the wrong state is run again until it agrees
        at = int(out[-1, lane - 1])
        if at:
            for k in range(steps):
                at = dfa.rows[at + int(columns[k, lane])]
                if at == out[k, lane]:
                    break
                out[k, lane] = at
    return out.T.reshape(-1)[:n] // dfa.classes


class Scanner:
    """All rules compiled; ``scan`` gives the spans of many texts at once."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        # where a match may end first is enough here: a trailing "+" would only add states
        self.every = compile_rules([(r.pattern.removesuffix("+"), r.ignore_case) for r in rules], anywhere=True)
        self.forward = [compile_rules([(r.pattern, r.ignore_case)], anywhere=False) for r in rules]
        self.backward = [compile_rules([(r.pattern, r.ignore_case)], anywhere=False, backwards=True) for r in rules]

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each UTF-8 text the spans (start, end, rule number) in bytes, ordered by start, then rule."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not texts:
            return found
        joined = b"\xff".join([*texts, b""])
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        data = np.frombuffer(joined, np.uint8)
        hits = self.every.accept[states_after(self.every, data)]
        for k, rule in enumerate(self.rules):
            on = (hits >> k) & 1
            ends = np.flatnonzero(on) + 1
            if rule.minimum and rule.pattern[0] == "[" and rule.pattern.find("]") == len(rule.pattern) - 2:
                # a run of one class: only bytes that end ``minimum`` accepted ones in a row matter
                total = np.concatenate([[0], np.cumsum(on, dtype=np.int32)])
                ends = ends[ends >= rule.minimum]
                ends = ends[total[ends] - total[ends - rule.minimum] == rule.minimum]
            last, owner, low, high = -1, -1, 0, 0
            for end in ends.tolist():
                if end <= last:
                    continue
                if end > high:
                    owner = int(np.searchsorted(begins, end, "right")) - 1
                    low, high = int(begins[owner]), int(begins[owner + 1]) - 1
                floor = max(low, last)
                length = self.backward[k].longest(joined, end - 1, floor - 1, -1)
                if not length:
                    continue
                start = end - length
                last = start + self.forward[k].longest(joined, start, high, 1)
                tail = last - start
                if rule.tail:
                    tail = self._tail(joined[start:last])
                if tail >= rule.minimum:
                    found[owner].append((start - low, last - low, k))
        for spans in found:
            spans.sort(key=lambda x: (x[0], x[2]))
        return found

    @staticmethod
    def _tail(match: bytes) -> int:
        """Length of the value of an assignment: what follows the first ``:`` or ``=``, quotes and blanks."""
        head = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
        value = match[head:].lstrip(b" ")
        return len(value) - (value[:1] in (b'"', b"'"))


@lru_cache(maxsize=2)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans as code-point spans."""
    if not spans or text.isascii():
        return spans
    starts = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(starts[a]), int(starts[b]), k) for a, b, k in spans]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each document's id with ``spans``: array of (kind, start, end) by start, then rule order."""

    def make() -> Callable:
        s = scanner(rules)

        def one(batch: pa.RecordBatch):
            for part in slices(batch):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                spans = [code_points(t, x) for t, x in zip(texts, s.scan(texts), strict=True)]
                yield {"doc_id": part.column("doc_id"), "spans": [[{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in x] for x in spans]}

        return one

    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span, joined where spans overlap, replaced by ``mark``.

    Columns stay as they are; ``n_chars``, if there, follows the new text.  Null texts stay null.
    """
    has_length = "n_chars" in docs.columns
    ddl = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def make() -> Callable:
        s = scanner(rules)

        def one(batch: pa.RecordBatch):
            for part in slices(batch):
                old = part.column("text").to_pylist()
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in old]
                new = [_without(t, b, x, mark) for t, b, x in zip(old, texts, s.scan(texts), strict=True)]
                out = {c: part.column(c) for c in part.schema.names} | {"text": new}
                if has_length:
                    lengths = part.column("n_chars").to_pylist()
                    out["n_chars"] = [n if t is u or t is None else len(u) for t, u, n in zip(old, new, lengths, strict=True)]
                yield out

        return one

    return map_batches(docs, make, ddl)


def _without(text: str | None, data: bytes, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    if text is None or not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, _ in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [data[at:a].decode(), mark]
        at = b
    return "".join([*out, data[at:].decode()])


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The contract's columns, derived from :func:`find_secrets`."""
    ddl = f"doc_id {dict(docs.dtypes)['doc_id']}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

    def make() -> Callable:
        def one(batch: pa.RecordBatch):
            rows = batch.column("spans").to_pylist()
            base = [[x for x in r if x["kind"] in BASE] for r in rows]
            written = lambda r: ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in r)
            yield {"doc_id": batch.column("doc_id"), "base_sha256": [hashlib.sha256(written(r).encode()).hexdigest() for r in base], "spans": [written(r) for r in rows]} | {
                f"n_{k}": [sum(x["kind"] == k for x in r) for r in base] for k in BASE
            }

        return one

    return map_batches(find_secrets(docs, rules), make, ddl)
