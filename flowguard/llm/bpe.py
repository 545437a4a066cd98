"""Byte-pair encoding by an automaton over tokens.

The merges are compiled into a deterministic automaton which reads token sequences and accepts exactly those that the
merges produce. It starts as one state with a loop for each base symbol. A merge (u, v) -> w applies one gadget: the state
that u leads to is replaced by a copy without the arc v, and w gets an arc wherever u has one, to where v led. Every state
is thus its parent without one arc, and every token leads to one state; an arc is found from these small tables and kept.

A word is encoded from left to right: for each of its prefixes exactly one token can be the last, the one whose arc leaves
the state that the shorter prefix ended in. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Fixed values of the published tokenizer format: how text is cut into words, and which bytes stand for themselves.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+"
VISIBLE = [(33, 126), (161, 172), (174, 255)]
#: Fixed values of Unicode: white space; letters, numbers and (first, last, shift) of lower case that versions after 15 added.
WHITE_SPACE = r"\t-\r\x20\x85\xa0  -     　"
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEW_LOWER = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
]
#: Distinct pieces of text whose tokens a task keeps at hand; beyond it the memory starts afresh. Pieces of more than
#: MOST_LETTERS characters, as texts without blanks are, are encoded each time, so what is kept is bounded in bytes too.
MOST_KNOWN, MOST_LETTERS = 500_000, 64
_ROOT = 0
#: Stands for the end of a word in the texts of tokens.
END = "\ue000"


def _byte_symbols() -> list[str]:
    shown = {b for low, high in VISIBLE for b in range(low, high + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _members(kind: str, new: list[tuple[int, int]]) -> str:
    """The code points of a general category as the inside of a character class."""
    held = [unicodedata.category(chr(i))[0] == kind for i in range(0x110000)]
    for low, high in new:
        held[low : high + 1] = [True] * (high + 1 - low)
    out, at = [], 0
    while at < len(held):
        if held[at]:
            end = held.index(False, at)
            out.append(f"\\U{at:08x}-\\U{end - 1:08x}")
            at = end
        at += 1
    return "".join(out)


_patterns: list[re.Pattern] = []


def word_pattern() -> re.Pattern:
    """The pattern of words, compiled once in each process."""
    if not _patterns:
        _patterns.append(re.compile(WORD_PATTERN.format(letter=_members("L", NEW_LETTERS), number=_members("N", NEW_NUMBERS), space=WHITE_SPACE)))
    return _patterns[0]


class Automaton:
    """States, and for each token its label, the state it leads to and the merge that made it."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.labels = [""] * size
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.labels[i] = text
        self.target = [_ROOT] * size
        self.parent, self.without = [-1], [-1]
        self.made_at = [-1] * size
        self.left = [-1] * size
        self.removed_at: dict[tuple[int, int], int] = {}
        self.arcs: dict[int, int] = {}
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        for u, v in merges:
            self._gadget(self.vocab[u], self.vocab[v], self.vocab[u + v], len(self.parent))
        self._chains()
        self.width = len(self.labels)
        self.by_text = {(t[: -len(self.suffix)] + END if self.suffix and t.endswith(self.suffix) else t): i for t, i in self.vocab.items()}
        self.longest = max(map(len, self.by_text))
        self.symbols = _byte_symbols()

    def _gadget(self, u: int, v: int, w: int, state: int) -> None:
        """State `state` is the copy of u's state without v; its number is also the time of the merge."""
        led_by_v = self.target[v]
        self.parent.append(self.target[u])
        self.without.append(v)
        self.target[u] = state
        self.target[w] = led_by_v
        self.left[w], self.made_at[w] = u, state

    def _chains(self) -> None:
        """Number the tree of copies in preorder: a state has lost arc v if it lies within the span of a state made without v."""
        count = len(self.parent)
        size = np.ones(count, np.int64)
        for s in range(count - 1, 0, -1):
            size[self.parent[s]] += size[s]
        enter, filled = np.zeros(count, np.int64), np.ones(count, np.int64)
        for s in range(1, count):
            p = self.parent[s]
            enter[s] = enter[p] + filled[p]
            filled[p] += size[s]
        self.enter = enter.tolist()
        self.spans: dict[int, tuple[list[int], list[int], list[int]]] = {}
        for s in sorted(range(1, count), key=enter.__getitem__):
            starts, stops, times = self.spans.setdefault(self.without[s], ([], [], []))
            if not stops or stops[-1] <= self.enter[s]:  # else an outer state has lost the arc before
                starts.append(self.enter[s])
                stops.append(self.enter[s] + int(size[s]))
                times.append(s)

    def arc(self, state: int, token: int) -> int:
        """Where `token` leads from `state`, or -1."""
        key = state * self.width + token
        found = self.arcs.get(key)
        if found is None:
            found = self.arcs[key] = self.target[token] if self._has(state, token) else -1
        return found

    def _has(self, state: int, token: int) -> bool:
        """An arc for w was made where its left part had one, so it is missing if a part along the left edge was lost before its whole was made."""
        at, before = self.enter[state], len(self.parent)
        while token >= 0:
            if token in self.spans:
                starts, stops, times = self.spans[token]
                i = bisect_right(starts, at) - 1
                if i >= 0 and at < stops[i] and times[i] <= before:
                    return False
            before, token = self.made_at[token], self.left[token]
        return True

    def word(self, text: str) -> list[int]:
        """Tokens of a word: one character for each symbol, the word's end as END. Every symbol is a token, at the end too.

        States and arcs are the automaton's, found by table; which arc to follow isn't known from the next symbol alone.
        The longest tokens are tried first, and a token is taken back if no accepted sequence goes on from its end, each
        place once at most. Only one sequence is accepted, so the first that reaches the word's end is the result.
        """
        n, out, at, state = len(text), [], 0, _ROOT
        states, places, dead = [], [], set()
        size = min(n, self.longest)
        while at < n:
            while size:
                token = self.by_text.get(text[at : at + size])
                if token is not None and at + size not in dead:
                    to = self.arcs.get(state * self.width + token)
                    if to is None:
                        to = self.arc(state, token)
                    if to >= 0:
                        break
                size -= 1
            if size:
                out.append(token)
                states.append(state)
                places.append(at)
                at, state = at + size, to
                size = min(n - at, self.longest)
            else:
                dead.add(at)
                out.pop()
                size = at - places[-1] - 1
                at, state = places.pop(), states.pop()
        return out


class Encoder:
    """Normalizes and cuts text as the tokenizer's file says, and encodes its words by the automaton."""

    def __init__(self, spec_json: str):
        self.automaton = Automaton(json.loads(spec_json))
        self.words = word_pattern()
        self.space = re.compile(f"[{WHITE_SPACE}]+")
        self.lower = {i: i + shift for low, high, shift in NEW_LOWER for i in range(low, high + 1)}
        special = sorted(self.automaton.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known: dict[str, bytes] = {}
        self.by_word: dict[str, list[int]] = {}

    def _word(self, word: str) -> list[int]:
        found = self.by_word.get(word)
        if found is None:
            a = self.automaton
            text = "".join([a.symbols[b] for b in word.encode("utf-8", "surrogatepass")]) + (END if a.suffix else "")
            found = a.word(text)
            if len(word) <= MOST_LETTERS:
                self.by_word[word] = found
        return found

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            # Lower case is taken character by character: a final sigma has no form of its own.
            text = "".join([c.lower() for c in self.space.sub(" ", unicodedata.normalize("NFC", text)).translate(self.lower)])
        else:
            text = text.lower()
        out: list[int] = []
        for word in self.words.findall(text):
            out += self._word(word)
        return out

    def _piece(self, piece: str) -> bytes:
        ids: list[int] = []
        at = 0
        if self.special is not None and "<|" in piece:
            for m in self.special.finditer(piece):
                ids += self._plain(piece[at : m.start()])
                ids.append(self.automaton.special[m.group()])
                at = m.end()
        ids += self._plain(piece[at:])
        return array("i", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """32-bit token ids of a text. Blanks and line feeds end words, so the parts between them are encoded apart and kept."""
        known, out = self.known, []
        for piece in text.replace("\n", " ").split(" "):
            found = known.get(piece)
            if found is None:
                if len(known) >= MOST_KNOWN:
                    known.clear()
                    self.by_word.clear()
                    self.automaton.arcs.clear()
                found = self._piece(piece)
                if len(piece) <= MOST_LETTERS:
                    known[piece] = found
            out.append(found)
        return b"".join(out)


def read_spec(path: str) -> str:
    """The tokenizer's file, read once on the driver; tasks get its content."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_encoders: dict[int, Encoder] = {}


def encode(frame: DataFrame, spec_json: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """frame with a column of token ids.

    Texts are encoded whole, however long, some megabytes of them at a time. A null or empty text has no tokens. Rows are
    encoded each by itself, so repeated ones get equal ids. Other columns stay as they are; one named like the new one is
    replaced by it. An empty table gives none.
    """
    spec = frame.sparkSession.sparkContext.broadcast(spec_json)
    kept = [c for c in frame.columns if c != ids]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*[f"`{c}`" for c in kept]).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(hash(spec.value))
        if encoder is None:
            encoder = _encoders[hash(spec.value)] = Encoder(spec.value)
        for batch in batches:
            for part in slices(batch, text):
                found = [encoder.encode(t) if t else b"" for t in part.column(text).to_pylist()]
                at = np.r_[0, np.cumsum([len(x) // 4 for x in found])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], lists], names=[*kept, ids])

    return frame.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{schema}, `{ids}` array<int>")


def decode(frame: DataFrame, spec_json: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """frame with the labels of its token ids, joined by blanks.

    Null and empty ids give the empty text; lists may be of any length, repeated rows give equal texts. Other columns stay
    as they are; one named like the new one is replaced by it. An empty table gives none.
    """
    spec = frame.sparkSession.sparkContext.broadcast(spec_json)
    kept = [c for c in frame.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*[f"`{c}`" for c in kept]).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = json.loads(spec.value)
        labels = {**{i: t for t, i in parsed["model"]["vocab"].items()}, **{x["id"]: x["content"] for x in parsed.get("added_tokens", [])}}
        encoded = [(labels.get(i, "") + " ").encode() for i in range(max(labels) + 1)]
        size = np.array([len(x) for x in encoded], np.int64)
        base = np.r_[0, np.cumsum(size)[:-1]]
        pool = np.frombuffer(b"".join(encoded), np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                column = part.column(ids)
                counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                tokens = column.flatten().to_numpy(zero_copy_only=False)
                n = size[tokens]
                ends = np.cumsum(n)
                source = np.repeat(base[tokens] - (ends - n), n)
                source += np.arange(len(source))
                data = pool[source].tobytes()
                stops = np.r_[0, ends][np.cumsum(counts)] if len(tokens) else np.zeros(len(counts), np.int64)
                starts = np.r_[0, stops[:-1]]
                texts = [data[s : max(s, e - 1)] for s, e in zip(starts.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(texts, pa.binary()).cast(pa.string())], names=[*kept, text])

    return frame.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{schema}, `{text}` string")


def joined(ids: Column) -> Column:
    """Decimal ids joined by one blank."""
    return F.array_join(ids.cast("array<string>"), " ")
