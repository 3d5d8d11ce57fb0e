"""BPE by a deterministic automaton over tokens.

The automaton starts with one state that every byte leads back to: it accepts any sequence of
bytes. Each merge (u, v) -> w is built in, in order, as a merge gadget:

- the state that u leads to gets a copy without the arc v, and u leads to the copy from now on, so
  u directly followed by v is no longer accepted;
- every state with an arc u followed by v gets an arc w to where v led.

After the last merge it accepts the BPE encodings and no other token sequences. All arcs of one label
lead to one state, so the arcs are a table: the target per token and, per state, a bit for every
token that may not follow. A word is encoded by running over its bytes: at each position one token
at most has an allowed arc from the state at its start; following these back gives the encoding.
Decoding emits the bytes of the arc labels.

Words come from the pre-split of the vocabulary (letters, digits or other signs with one space
before them, contractions, white space). The compiled table is sent to the executors once; its size
depends on the vocabulary only. Words that a worker has met are remembered.

Cases: a null text counts as the empty text and has no tokens; no ids give the empty text. Null ids,
repeated rows, and columns of any name are carried. An empty table gives an empty result. Special
tokens of the vocabulary in a text stand for themselves, as in the library.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weighyard.llm.common import col, plain_names, text_of

#: Pre-split of the byte-level vocabulary (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and chunks that a worker remembers (some 200 bytes each); a full memory forgets its older half.
WORDS, CHUNKS = 150_000, 900_000
#: Rows of one output batch and about as many characters.
_ROWS, _CHARS = 500, 2 << 20


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary and their bytes.

    Printable bytes stand for themselves, the others follow from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + at): b for at, b in enumerate(other)}


def read_vocabulary(path: str):
    """(bytes per id, merges as id triples in order, special tokens) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    letters, vocabulary = byte_letters(), data["model"]["vocab"]
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    labels = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
    labels |= {i: content.encode() for content, i in special.items()}
    merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    return labels, [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in merges], special


def unknown_letters(path: str) -> str:
    """Letters and figures that this Python's regex knows and the tokenizer library does not yet."""
    from tokenizers import Tokenizer

    split, known = Tokenizer.from_file(path).pre_tokenizer, regex.compile(r"[\p{L}\p{N}]")
    recent = [chr(c) for c in range(0x370, 0x110000) if unicodedata.category(chr(c)) == "Cn" and known.match(chr(c))]
    return "".join(c for c in recent if len(split.pre_tokenize_str(f"a{c}!")) == 2
                   and split.pre_tokenize_str(f"a{c}!")[0][1] == (0, 1))


class Automaton:
    """Targets and forbidden arcs; `forbidden[row[token]]` has a bit per state."""

    def __init__(self, labels, targets, rows, forbidden):
        self.labels, self.targets, self.forbidden = labels, targets, forbidden
        self.rows = rows
        # Endings of tokens without a token of their own lead nowhere, but show that a longer one may follow.
        self.tokens = {label[at:]: None for i, label in labels.items() if rows[i] >= 0 for at in range(1, len(label))}
        self.tokens.update({label: i for i, label in labels.items() if rows[i] >= 0})

    @classmethod
    def compile(cls, labels, merges):
        """Build the merge gadgets one after another."""
        size = max(labels) + 1
        made_of = {w for _, _, w in merges}
        letters = [i for i, label in labels.items() if len(label) == 1 and i not in made_of]
        lefts = len({u for u, _, _ in merges})
        states = lefts + sum(u == v for u, v, _ in merges) + len(merges) // 8 + 64
        # A set bit: no arc from this state. Tokens lie side by side, since copies go by state.
        arcs = np.zeros((size, (states + 7) // 8), np.uint8, order="F")
        targets, users, used = [0] * size, {0: len(letters) + 1}, 1
        order = {i: at for at, i in enumerate(letters)}  # rows in the order tokens come to be
        last = len(letters)
        for u, v, w in merges:
            state = targets[u]
            after = targets[v]
            order[w] = last
            if arcs[order[v], state >> 3] >> (state & 7) & 1:  # v never follows u: no arc w anywhere
                arcs[last] = 255
                targets[w] = after
                users[after] = users.get(after, 0) + 1
                last += 1
                continue
            if users[state] > 1 or u == v:
                copy, used = used, used + 1
                if copy >> 3 >= arcs.shape[1]:
                    arcs = np.asfortranarray(np.pad(arcs, ((0, 0), (0, arcs.shape[1] // 4 + 1))))
                column = arcs[:last, state >> 3] >> (state & 7) & 1
                arcs[:last, copy >> 3] |= column << (copy & 7)
                users[state] -= 1
                users[copy] = 1
                targets[u] = state = copy
            arcs[order[v], state >> 3] |= 1 << (state & 7)
            arcs[last] = arcs[order[u]]
            targets[w] = after
            users[after] = users.get(after, 0) + 1
            last += 1
        arcs = np.ascontiguousarray(arcs[:last, :(used + 7) // 8])
        distinct: dict[bytes, int] = {}  # tokens with the same arcs share a row
        rows = [-1] * size
        for token, place in order.items():
            rows[token] = distinct.setdefault(arcs[place].tobytes(), len(distinct))
        return cls(labels, targets, rows, list(distinct))

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of a word: the only accepted sequence with its bytes."""
        n = len(word)
        states, came = [0] + [-1] * n, [0] * (n + 1)
        tokens, rows, forbidden, targets = self.tokens, self.rows, self.forbidden, self.targets
        for end in range(1, n + 1):
            for start in range(end - 1, -1, -1):
                token = tokens.get(word[start:end], -1)
                if token is None:
                    continue
                if token < 0:
                    break
                state = states[start]
                if state >= 0 and not forbidden[rows[token]][state >> 3] >> (state & 7) & 1:
                    states[end], came[end] = targets[token], token
                    break
        ids = []
        while n:
            ids.append(came[n])
            n -= len(self.labels[came[n]])
        return ids[::-1]


class Coder:
    """Encodes and decodes texts with an automaton, remembering words and chunks."""

    def __init__(self, automaton: Automaton, special: dict[str, int], unknown=""):
        self.automaton, self.special = automaton, special
        self.usual = regex.compile(SPLIT)
        self.unknown = frozenset(unknown)
        self.careful = regex.compile("(?V1)" + SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{unknown}]]").replace(
            r" ?\p{L}+", rf" ?[\p{{L}}--[{unknown}]]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--[{unknown}]]+")) if unknown else None
        self.words = _Memory(lambda word: array("i", automaton.encode_word(word.encode())).tobytes(), WORDS)
        self.chunks = _Memory(self._chunk, CHUNKS)
        self.stops = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.labels = pa.array([automaton.labels.get(i, b"") for i in range(max(automaton.labels) + 1)], pa.large_binary())

    def split(self, text: str) -> list[str]:
        if self.unknown and not text.isascii() and not self.unknown.isdisjoint(text):
            return self.careful.findall(text)
        return self.usual.findall(text)

    def _chunk(self, chunk: str):
        """Ids of ' ' + chunk; None where the chunk can't be split on its own."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        if chunk.isalpha():  # one word
            return array("i", self.automaton.encode_word(f" {chunk}".encode())).tobytes()
        if chunk[-1] in ".," and chunk[:-1].isalpha():
            return self.chunks[chunk[:-1]] + self.words[chunk[-1]]
        return b"".join(map(self.words.__getitem__, self.split(" " + chunk)))

    def _plain(self, text: str) -> bytes:
        """A single space between two other signs always starts a word, so texts are cut there."""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return b"".join(map(self.words.__getitem__, self.split(first))) + b"".join(
                    map(self.chunks.__getitem__, rest))
            except TypeError:  # white space beside a space: the text is split as a whole
                pass
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if self.stops is None or not any(content in text for content in self.special):
            return self._plain(text)
        return b"".join(np.array([self.special[part]], "<i4").tobytes() if part in self.special else self._plain(part)
                        for part in self.stops.split(text) if part)

    def decode(self, ids: pa.ListArray) -> list[str]:
        """The text of each list: the labels of all lists side by side, cut where a list ends."""
        counts = pc.fill_null(pc.list_value_length(ids), 0)
        taken = self.labels.take(ids.flatten())
        _, starts, body = taken.buffers()
        starts = np.frombuffer(starts, "<i8", len(taken) + 1)[np.cumsum([0, *counts.to_pylist()])]
        body = memoryview(body or b"")
        return [str(body[a:b], "utf-8", "replace") for a, b in zip(starts[:-1], starts[1:], strict=True)]


class _Memory(dict):
    def __init__(self, make, most):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            for old in list(islice(self, self.most // 2)):
                del self[old]
        found = self[key] = self.make(key)
        return found


_CODERS: dict[str, Coder] = {}


class Codec:
    """A compiled vocabulary with its encode and decode operators."""

    def __init__(self, spark, path: str):
        labels, merges, special = read_vocabulary(path)
        automaton = Automaton.compile(labels, merges)
        self.parts = spark.sparkContext.broadcast(
            (labels, automaton.targets, automaton.rows, automaton.forbidden, special, unknown_letters(path)))
        self.path = path

    def _coder(self):
        parts, path = self.parts, self.path

        def coder() -> Coder:
            if path not in _CODERS:
                labels, targets, rows, forbidden, special, unknown = parts.value
                _CODERS[path] = Coder(Automaton(labels, targets, rows, forbidden), special, unknown)
            return _CODERS[path]

        return coder

    def encode(self, docs: DataFrame, text="text", ids="ids") -> DataFrame:
        """The rows with an array of token ids in `ids`; a column of that name is replaced."""
        coder = self._coder()
        kept = plain_names([name for name in docs.columns if name != ids])
        rows = docs.select(*[col(name).alias(short) for name, short in kept.items()], text_of(text).alias("result"))
        names = rows.columns

        def run(batches):
            own = coder()
            for batch in batches:
                for at in _slices(batch.column(len(kept))):
                    part = batch.slice(*at)
                    found = [own.encode(body) for body in part.column(len(kept)).to_pylist()]
                    ends = np.cumsum([0] + [len(x) // 4 for x in found], dtype=np.int32)
                    values = pa.array(np.frombuffer(b"".join(found), "<i4"))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), values)], names=names)

        schema = rows.drop("result").schema.add("result", T.ArrayType(T.IntegerType()))
        return rows.mapInArrow(run, schema).toDF(*kept, ids)

    def decode(self, rows: DataFrame, ids="ids", text="decoded") -> DataFrame:
        """The rows with the text of `ids` in `text`, in place of the ids and of a column named `text`."""
        coder = self._coder()
        kept = plain_names([name for name in rows.columns if name not in (ids, text)])
        ordered = rows.select(*[col(name).alias(short) for name, short in kept.items()], col(ids).alias("result"))
        names = ordered.columns

        def run(batches):
            own = coder()
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS):
                    part = batch.slice(at, _ROWS)
                    bodies = own.decode(part.column(len(kept)))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(bodies, pa.string())], names=names)

        return ordered.mapInArrow(run, ordered.drop("result").schema.add("result", "string")).toDF(*kept, text)


def _slices(column):
    """(offset, length) of runs of rows with a bounded number of characters, one row at least."""
    start, size = 0, 0
    for at, body in enumerate(column):
        size += len(body.as_buffer())
        if size >= _CHARS or at - start + 1 >= _ROWS:
            yield start, at - start + 1
            start, size = at + 1, 0
    if start < len(column):
        yield start, len(column) - start


def token_count(ids="ids"):
    return F.size(col(ids)).cast("long")
