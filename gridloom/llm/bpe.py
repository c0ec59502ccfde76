"""Exact byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A word's encoding is the one sequence of tokens whose neighbours are all
compatible: merging the two texts from scratch gives the two tokens back. The
encoder takes the longest token at a place, found by one Aho-Corasick pass, and
falls back to shorter ones, or to the token before, where neighbours clash.
Compatibility is kept in a table that fills as pairs come up.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

CODED = StructType([StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
END = "</w>"
#: Words whose ids are remembered in a task, and pairs whose compatibility is.
MEMORY = 300_000
#: Characters of a text that are split into words at once; cut before white space.
PIECE = 1 << 20
#: Rows coded at once, and tokens decoded at once.
ROWS = 256
DECODED = 1 << 17

#: White space as the tokenizer's pattern knows it, and the pattern itself.
SPACE = "\t-\r \x85\xa0  -     　"
_SPACES = re.compile(f"[{SPACE}]+")
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_CUT = re.compile(r"[\t-\r ]")


@dataclass(frozen=True)
class Vocabulary:
    """What a tokenizer file says, small enough to travel with every task (some megabytes, whatever the data)."""

    ids: dict[str, int]
    merges: tuple[tuple[str, str], ...]
    special: dict[str, int]

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a tokenizer file of the driver's. It must be BPE over byte characters with word ends, lower-cased."""
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError(f"{path} is not BPE with word ends")
        merges = tuple(tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        return Vocabulary(model["vocab"], merges, special)


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(shown))
    return [letters[b] for b in range(256)]


class Encoder:
    """Ids of words and texts. Inside, a symbol is one character: chr(b) for byte b, chr(256 + b) where it ends a word."""

    def __init__(self, vocabulary: Vocabulary):
        self._letters = {c: b for b, c in enumerate(byte_letters())}
        self._rank = {tuple(map(self._symbols, pair)): i for i, pair in enumerate(vocabulary.merges)}
        self._special = vocabulary.special
        self._is_special = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self._ids = {self._symbols(t): i for t, i in vocabulary.ids.items() if t not in vocabulary.special}
        # A text that merging does not turn into its token never comes out as it.
        made = {a + b for a, b in self._rank}
        whole = {t for t in self._ids if len(t) == 1 or t in made and self.merge(t) == [t]}
        self._shorter = {t: next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in whole), None) for t in whole}
        self._start()

    def _start(self) -> None:
        self._tokens = ahocorasick.Automaton()
        for token in self._shorter:
            self._tokens.add_word(token, token)
        self._tokens.make_automaton()
        self._fits: dict[tuple[str, str], bool] = {}
        self._known: dict[str, bytes] = {}

    def __getstate__(self):
        """The tables travel; the automaton and what a task remembers start anew there."""
        return {k: v for k, v in self.__dict__.items() if k not in ("_tokens", "_fits", "_known")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _symbols(self, token: str) -> str:
        ends = token.endswith(END) and token != END
        bytes_ = [self._letters[c] for c in (token.removesuffix(END) if ends else token)]
        return "".join(map(chr, bytes_[:-1])) + chr(bytes_[-1] + 256 * ends)

    def merge(self, symbols: str) -> list[str]:
        """Plain merging in order of rank, leftmost first: the definition."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self._rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self._rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def fit(self, left: str, right: str) -> bool:
        fits = self._fits.get((left, right))
        if fits is None:
            if len(self._fits) >= MEMORY:
                self._fits.clear()
            fits = self._fits[left, right] = self.merge(left + right) == [left, right]
        return fits

    def tokens_of(self, symbols: str) -> list[str]:
        size = len(symbols)
        longest: list[str | None] = [None] * size
        for end, token in self._tokens.iter(symbols):
            start = end + 1 - len(token)
            if longest[start] is None or len(token) > len(longest[start]):
                longest[start] = token
        taken, at, token = [], 0, longest[0]
        dead = bytearray(size + 1)
        while at < size:
            end = at + len(token) if token else 0
            if token and not dead[end] and (not taken or self.fit(taken[-1], token)):
                taken.append(token)
                at = end
                token = longest[at] if at < size else None
                continue
            token = self._shorter[token] if token else None
            if token is None:
                dead[at] = 1
                token = taken.pop()
                at -= len(token)
        return taken

    def ids_of_word(self, word: str) -> np.ndarray:
        raw = word.encode("utf-8")
        symbols = raw[:-1].decode("latin-1") + chr(raw[-1] + 256)
        return np.array([self._ids[t] for t in self.tokens_of(symbols)], dtype=np.int32)

    def ids_of(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers."""
        out, known = [], self._known
        for words in self._words(text or ""):
            if isinstance(words, int):
                out.append(np.int32(words).tobytes())
                continue
            if len(known) > MEMORY:
                known.clear()
            for word in set(words).difference(known):
                known[word] = self.ids_of_word(word).tobytes()
            out.append(b"".join([known[w] for w in words]))
        return b"".join(out)

    def _words(self, text: str) -> Iterator[list[str] | int]:
        parts = self._is_special.split(text) if self._is_special and "<" in text else [text]
        for n, part in enumerate(parts):
            if n % 2:
                yield self._special[part]
                continue
            at = 0
            while at < len(part):
                cut = _CUT.search(part, at + PIECE) if at + PIECE < len(part) else None
                end = cut.start() if cut else len(part)
                piece = part[at:end] if at or end < len(part) else part
                at = end
                if piece.isascii():
                    yield _ASCII_WORDS.findall(piece.lower())
                else:
                    piece = _SPACES.sub(" ", unicodedata.normalize("NFC", piece))
                    # Letters are lowered one by one: a sigma stays a sigma at the end of a word.
                    yield _WORDS.findall(piece.replace("Σ", "σ").lower())


class Decoder:
    """Texts of ids: tokens lie one after another in one buffer, each with a space behind it; an id is an offset and a length."""

    def __init__(self, vocabulary: Vocabulary):
        tokens = {i: t for t, i in {**vocabulary.ids, **vocabulary.special}.items()}
        pieces = [(tokens.get(i, "") + " ").encode("utf-8") for i in range(max(tokens, default=-1) + 1)]
        self._length = np.array([len(p) for p in pieces], dtype=np.int64)
        self._start = np.cumsum(self._length) - self._length
        self._buffer = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """One text for each run of ``ids`` up to the next of ``ends``: its tokens, joined by a space."""
        length = self._length[ids]
        filled = ends[np.diff(ends, prepend=0) > 0]
        length[filled - 1] -= 1
        to = np.concatenate([[0], np.cumsum(length)])
        source = np.repeat(self._start[ids] - to[:-1], length)
        source += np.arange(to[-1])
        data = self._buffer[source].tobytes()
        cuts = to[np.concatenate([[0], ends])]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def encode(text: Column, vocabulary: Vocabulary) -> Column:
    """Ids (array<int>) of whole texts, without special tokens of its own. Null and empty texts have none.

    Texts that hold a special token literally get its id there, as the tokenizer does.
    """

    encoder = Encoder(vocabulary)

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            for at in range(0, len(batch), ROWS):
                yield _coded(encoder, batch.slice(at, ROWS))

    return ids(text)


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """Texts of ids as the tokenizer gives them without a decoder: tokens joined by one space. Null is no ids."""
    decoder = Decoder(vocabulary)

    @F.arrow_udf(StringType())
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from _decoded(decoder, batch)

    return texts(ids)


def encode_and_decode(text: Column, vocabulary: Vocabulary) -> Column:
    """Struct (ids, decoded): ``encode``, and ``decode`` of its ids, in one Python worker for a task in place of two."""
    encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)

    @F.arrow_udf(CODED)
    def both(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            for at in range(0, len(batch), ROWS):
                ids, row = _coded(encoder, batch.slice(at, ROWS)), 0
                for decoded in _decoded(decoder, ids):
                    yield pa.StructArray.from_arrays([ids.slice(row, len(decoded)), decoded], names=CODED.names)
                    row += len(decoded)

    return both(text)


def _coded(encoder: Encoder, texts: pa.Array) -> pa.Array:
    rows = [encoder.ids_of(t) for t in texts.to_pylist()]
    ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(rows))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def _decoded(decoder: Decoder, ids: pa.Array) -> Iterator[pa.Array]:
    """Texts of the rows of ``ids``, some at a time."""
    sizes = np.array([0 if n is None else n for n in ids.value_lengths().to_pylist()], dtype=np.int64)
    flat, ends, at, row = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes), 0, 0
    while row < len(sizes):
        upto = max(row + 1, int(np.searchsorted(ends, at + DECODED, side="right")))
        yield pa.array(decoder.texts(flat[at:ends[upto - 1]], ends[row:upto] - at), pa.binary()).cast(pa.string())
        at, row = int(ends[upto - 1]), upto
