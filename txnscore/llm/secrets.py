"""Secrets in texts, found by one deterministic automaton for all rules.

Rules are regular expressions over bytes. They are compiled together: each to a
nondeterministic automaton, all of them to one deterministic automaton by subset
construction, which is then minimised. A text is scanned once, byte by byte; a
state says which rules have a shortest match that ends here. Spans are settled at
those ends only: the reversed rule's automaton runs back to where the match begins,
the rule's own one on to where its longest match ends.

A rule's matches must not lie inside each other (a later start with an earlier end).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnscore.llm.shared import frugal, text_rows

# --- Rules: fixed values ---------------------------------------------------
# A private key reaches up to its END line: all bytes but five dashes in a row. Without one it is the run of header
# lines, base64 and (escaped) line ends, indented or quoted (and so a word of prose that follows on the next line);
# spaces continue it only before 32 base64 bytes.
_KEY = r"([A-Z0-9]+\x20)*PRIVATE\x20KEY(\x20BLOCK)?-----"
_DASHED = r"(-?-?-?-?[\x00-,.-\xff])"
_B64, _EOL, _GAP = r"[A-Za-z0-9+/=]", r"([\x0d\x0a]|\\+[nr])", r"[\x20\x09]+"
_NAMED = rf"(({_EOL}[\x20\x09>]*)+[A-Za-z][A-Za-z0-9-]*:(-?-?-?-?[\x00-\x09\x0e-,.-[\]-\xff])*)"
_OPEN = rf"{_NAMED}*({_B64}|{_EOL}[\x20\x09>]*|{_GAP}{_EOL}|{_GAP}{_B64 * 32}{_B64}*({_GAP}{_B64}+)?)*"
# (name, pattern, letters in either case, least length, whether the length is that of the last part)
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, 6, True),
    ("access", r"AKIA[A-Z0-9]+", False, 20, False),
    ("hex", r"[0-9a-f]+", False, 24, False),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", False, 40, False),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 15, False),
    ("google", r"AIza[A-Za-z0-9_-]+", False, 39, False),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]+", False, 24, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 30, False),
    ("private_key", rf"-----BEGIN\x20{_KEY}({_DASHED}*-----+END\x20{_KEY}|{_OPEN})?", False, 1, False),
)
BASE_KINDS = ("assign", "access", "hex")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``pattern`` may use literals, escapes, [classes], groups, |, ?, * and + (bytes, greedy)."""

    name: str
    pattern: str
    any_case: bool = False
    least: int = 1
    last_part: bool = False


DEFAULT_RULES = tuple(Rule(*x) for x in RULES)


# --- From a pattern to a syntax tree ---------------------------------------
class _Parser:
    """Trees: ("set", frozenset), ("cat", parts), ("alt", parts), ("star" | "plus" | "opt", part)."""

    def __init__(self, rule: Rule):
        self.s, self.i, self.any_case = rule.pattern, 0, rule.any_case

    def parse(self):
        tree = self.alt()
        if self.i < len(self.s):
            raise ValueError(f"cannot read pattern at {self.s[self.i :]!r}")
        return tree

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self) -> str:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return c
        c = self.s[self.i]
        self.i += 1
        if c != "x":
            return c
        self.i += 2
        return chr(int(self.s[self.i - 2 : self.i], 16))

    def letters(self, low: str, high: str) -> frozenset:
        out = set(range(ord(low), ord(high) + 1))
        if self.any_case:
            out |= {ord(x) for c in out if c < 128 for x in (chr(c).lower(), chr(c).upper())}
        return frozenset(out)

    def alt(self):
        parts = [self.cat()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def cat(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            if self.peek() == "(":
                self.i += 1
                part = self.alt()
                self.i += 1
            elif self.peek() == "[":
                self.i += 1
                chosen: frozenset = frozenset()
                while self.peek() != "]":
                    low = high = self.take()
                    if self.peek() == "-" and self.s[self.i + 1] != "]":
                        self.i += 1
                        high = self.take()
                    chosen |= self.letters(low, high)
                self.i += 1
                part = ("set", chosen)
            else:
                c = self.take()
                part = ("set", self.letters(c, c))
            while self.peek() and self.peek() in "*+?":
                part = ({"*": "star", "+": "plus", "?": "opt"}[self.peek()], part)
                self.i += 1
            parts.append(part)
        return ("cat", parts)


def _reversed(tree):
    kind, x = tree
    if kind == "set":
        return tree
    if kind == "cat":
        return kind, [_reversed(p) for p in reversed(x)]
    if kind == "alt":
        return kind, [_reversed(p) for p in x]
    return kind, _reversed(x)


def _at_least(tree, least: int):
    """A rule of one repeated set (x+) with its least length written out."""
    return ("cat", [tree[1][0][1]] * (least - 1) + [tree[1][0]])


# --- From trees to one minimal automaton -----------------------------------
class Automaton:
    """``rows[s][b]`` is the row reached from row s on byte b; ``rows[s][256]`` says which rules end here (bits)."""

    def __init__(self, trees: list, anchored: bool):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.silent: list[list[int]] = []
        self.accept: dict[int, int] = {}
        begin = self._state()
        for k, tree in enumerate(trees):
            first, last = self._build(tree)
            self.silent[begin].append(first)
            self.accept[last] = self.accept.get(last, 0) | 1 << k
        if not anchored:
            self.moves[begin].append((frozenset(range(256)), begin))
        self._subsets(begin)
        self._minimise()

    def _state(self) -> int:
        self.moves.append([])
        self.silent.append([])
        return len(self.moves) - 1

    def _build(self, tree) -> tuple[int, int]:
        kind, x = tree
        first, last = self._state(), self._state()
        if kind == "set":
            self.moves[first].append((x, last))
        elif kind == "cat":
            at = first
            for part in x:
                a, b = self._build(part)
                self.silent[at].append(a)
                at = b
            self.silent[at].append(last)
        elif kind == "alt":
            for part in x:
                a, b = self._build(part)
                self.silent[first].append(a)
                self.silent[b].append(last)
        else:
            a, b = self._build(x)
            self.silent[first].append(a)
            self.silent[b].append(last)
            if kind != "opt":
                self.silent[b].append(a)
            if kind != "plus":
                self.silent[first].append(last)
        return first, last

    def _closure(self, states: Iterable[int]) -> frozenset:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += self.silent[s]
        return frozenset(seen)

    def _subsets(self, begin: int) -> None:
        # Bytes that no set tells apart are one column.
        sets = list({x for moves in self.moves for x, _ in moves})
        groups: dict[tuple, int] = {}
        self.column = np.array([groups.setdefault(tuple(b in x for x in sets), len(groups)) for b in range(256)])
        sample = [int(np.flatnonzero(self.column == c)[0]) for c in range(len(groups))]
        start = self._closure([begin])
        number, todo, table = {start: 0}, [start], []
        while todo:
            now = todo.pop(0)
            row = []
            for b in sample:
                to = self._closure(t for s in now for x, t in self.moves[s] if b in x)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            table.append(row)
        self.table = np.array(table)
        marks = []
        for states in number:
            mark = 0
            for s in states:
                mark |= self.accept.get(s, 0)
            marks.append(mark)
        self.mark = np.array(marks)

    def _minimise(self) -> None:
        """Refine the partition by marks until states of a class go to equal classes."""
        kind = np.unique(self.mark, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([kind, kind[self.table]]), axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == kind.max():
                break
            kind = finer
        head = np.unique(kind, return_index=True)[1]
        table, self.mark = kind[self.table[head]], self.mark[head]
        dead = [k for k in range(len(head)) if not self.mark[k] and (table[k] == k).all()]
        self.dead = dead[0] if dead else -1
        self.table, self.first = table, int(kind[0])
        self.rows = [[] for _ in head]
        for k, row in enumerate(self.rows):
            row += [self.rows[to] for to in table[k][self.column]]
            row += [int(self.mark[k]), k]


def _shortest(tree):
    """What a match needs at least at its end: a last part that may repeat, once; one that may lack, not at all."""
    kind, x = tree
    if kind == "cat" and x[-1][0] == "plus":
        return kind, [*x[:-1], x[-1][1]]
    if kind == "cat" and x[-1][0] in ("opt", "star"):
        return kind, x[:-1]
    return tree


class Scanner:
    """One pass marks where matches first end; there the start is found backwards, the end forwards."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [_Parser(r).parse() for r in rules]
        # A run of one set would end everywhere: its least length belongs into the automaton.
        trees = [_at_least(t, r.least) if len(t[1]) == 1 and t[1][0][0] == "plus" else t for t, r in zip(trees, rules)]
        short = [_shortest(t) for t in trees]
        self.forward = Automaton(short, anchored=False)
        self.backward = [Automaton([_reversed(t)], anchored=True) for t in short]
        self.onward = [Automaton([t], anchored=True) for t in trees]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) of all secrets, in bytes: per rule leftmost, longest and apart."""
        row, ends, at = self.forward.rows[self.forward.first], [], 0
        for byte in data:
            row = row[byte]
            at += 1
            if row[256]:
                ends.append((at, row[256]))
        return self._settle(data, ends) if ends else []

    def _settle(self, data: bytes, ends: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        out, done = [], [0] * len(self.rules)
        for first_end, mark in ends:
            for k, rule in enumerate(self.rules):
                if not mark >> k & 1:
                    continue
                start = self._begin(k, data, first_end, done[k])
                if start < 0:  # it would reach into the match before
                    continue
                end = done[k] = self._end(k, data, start)
                if end - (first_end - 1 if rule.last_part else start) >= rule.least:
                    out.append((start, end, k))
        return sorted(out, key=lambda x: (x[0], x[2]))

    def _begin(self, k: int, data: bytes, end: int, floor: int) -> int:
        """The leftmost start, not before ``floor``, of a shortest match that ends at ``end``."""
        machine, found, at = self.backward[k], -1, end
        row = machine.rows[machine.first]
        while at > floor and row[257] != machine.dead:
            at -= 1
            row = row[data[at]]
            if row[256]:
                found = at
        return found

    def _end(self, k: int, data: bytes, start: int) -> int:
        """The end of the longest match from ``start``."""
        machine, found, at = self.onward[k], start, start
        row = machine.rows[machine.first]
        while at < len(data) and row[257] != machine.dead:
            row = row[data[at]]
            at += 1
            if row[256]:
                found = at
        return found


@lru_cache(maxsize=8)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find(text: str | None, rules: tuple[Rule, ...] = DEFAULT_RULES) -> list[tuple[str, int, int]]:
    """(rule, start, end) in code points, by start, then in the rules' order."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    found = scanner(rules).scan(data)
    if found and len(data) != len(text):
        # Code points before each byte: bytes that don't continue a character.
        before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        found = [(int(before[a]), int(before[b]), k) for a, b, k in found]
    return [(rules[k].name, a, b) for a, b, k in found]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """``doc_id`` and ``secrets``: an array of (kind, start, stop) in code points for every row.

    A NULL or empty text has none. Rows are independent, so repeated rows, NULL ids and
    texts of any length need no rule of their own. A match shorter than its rule's least
    length is dropped but uses up its text, as with a search from left to right.
    """

    @frugal
    def run(batches):
        for batch in batches:
            found = [[{"kind": k, "start": a, "stop": b} for k, a, b in find(t, rules)] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, _SPANS)], ["doc_id", "secrets"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, secrets array<struct<kind:string,start:long,stop:long>>")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """``docs`` with every secret of ``text_col`` replaced by ``mask``; spans that touch become one mask.

    All columns keep their names and order, all rows stay; a NULL text stays NULL.
    """
    names, at = docs.columns, docs.columns.index(text_col)

    def clean(text):
        if not text:
            return text
        parts, done, hidden = [], 0, 0
        for _, a, b in find(text, rules):
            if a >= done:
                parts += [text[done:a], mask] if a > hidden or not hidden else [text[done:a]]
            done = hidden = max(done, b)
        return "".join(parts) + text[done:]

    @frugal
    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.withColumn(names[at], F.col(f"`{names[at]}`").cast("string")).schema)
