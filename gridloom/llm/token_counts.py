"""Token counts by a compiled transducer: byte in, tokens decided so far out.

Splitting into words and merging byte pairs are one deterministic machine over
UTF-8 bytes. A state holds where in the splitting pattern the text stands and,
of the open word, what later merges can still depend on; a transition carries
the tokens that are certain once its byte is read. States are built when a text
first reaches them and kept in a table.

Texts are cut into chunks. A chunk is a map from the state before it to a state
and a count: up to its first certain word border it waits for that state, from
there on the map is constant. All chunks of a batch run through the table side
by side; their maps are then composed pairwise, in as many rounds as it takes
to halve the longest text down to one map.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gridloom.llm.bpe import byte_letters

#: Bytes of a chunk, and of the texts whose chunks run side by side.
CHUNK = 256
BLOCK = 1 << 20
#: Transitions kept; with more the table starts anew.
TRANSITIONS = 500_000
#: Chunks below which stepping one by one is quicker.
FEW = 24

#: The pattern that splits texts into words, and what may follow an apostrophe.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")

_LETTER, _NUMBER, _SPACE, _OTHER = "letter", "number", "space", "other"
_CLASSES = ((_LETTER, regex.compile(r"\p{L}")), (_NUMBER, regex.compile(r"\p{N}")), (_SPACE, regex.compile(r"\s")))
#: White space of several bytes, by its last two or three.
_WIDE_SPACES = [c.encode() for c in map(chr, range(128, 0x3001)) if regex.match(r"\s", c)]


def class_of(char: str) -> str:
    return next((name for name, pattern in _CLASSES if pattern.match(char)), _OTHER)


_BYTES = [bytes([b]) for b in range(256)]
_ASCII = [class_of(chr(b)) for b in range(128)]


@dataclass(frozen=True)
class Tokenizer:
    """What a tokenizer file says: merges in order of rank as bytes, and special tokens."""

    merges: tuple[tuple[bytes, bytes], ...]
    special: tuple[bytes, ...]

    @staticmethod
    def load(path: str) -> Tokenizer:
        """Read a tokenizer file of the driver's. It must be byte-level BPE that splits by ``PATTERN``."""
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, split = told["model"], told["pre_tokenizer"]
        byte_level = split and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") or told.get("normalizer") or not byte_level:
            raise ValueError(f"{path} is not plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        letters = {c: b for b, c in enumerate(byte_letters())}
        as_bytes = lambda t: bytes(letters[c] for c in t)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        special = sorted((t["content"].encode() for t in told["added_tokens"]), key=len, reverse=True)
        return Tokenizer(tuple((as_bytes(a), as_bytes(b)) for a, b in pairs), tuple(special))


class Merges:
    """Byte-pair merging of one word, byte by byte.

    An open word is (tail, tokens, steps): the longest end of the word that begins
    a token; for each place in it, from which a token could still run over the
    word's end, the last token of the text up to there, and how many tokens that
    text has above the least of them. The least is certain.
    """

    NONE = (b"", (b"",), (0,))

    def __init__(self, merges: tuple[tuple[bytes, bytes], ...]):
        self._rank = {pair: i for i, pair in enumerate(merges)}
        self._made: dict[bytes, tuple[int, bytes, bytes]] = {bytes([b]): (-1, b"", b"") for b in range(256)}
        for i, (a, b) in enumerate(merges):
            if a + b not in self._made and self.merge(a + b) == [a + b]:
                self._made[a + b] = (i, a, b)
        self._heads = {t[:n] for t in self._made for n in range(1, len(t) + 1)}
        self.forget()

    def forget(self) -> None:
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._ends: dict[bytes, tuple[list[tuple[int, bytes]], int]] = {}

    def merge(self, word: bytes) -> list[bytes]:
        """Plain merging in order of rank, leftmost first: the definition."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self._rank.get(pair, 1 << 40), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, left: bytes, right: bytes) -> bool:
        """Whether merging both texts together gives both tokens: no pair across their border merges before either is whole.

        Merges are undone, the last one first; of equal ranks the right one is the last. A pair across the border must not have
        come before what was undone.
        """
        fits = self._fits.get((left, right))
        if fits is None:
            key, limit = (left, right), len(self._rank)
            made, rank = self._made, self._rank
            while fits is None:
                if rank.get((left, right), limit) < limit:
                    fits = False
                    break
                a, b = made[left], made[right]
                if a[0] < 0 and b[0] < 0:
                    fits = True
                elif a[0] > b[0]:
                    limit, left = a[0], a[2]
                else:
                    limit, right = b[0] + 1, b[1]
            self._fits[key] = fits
        return fits

    def _ending(self, tail: bytes) -> tuple[list[tuple[int, bytes]], int]:
        """The tokens that end ``tail``, longest first with their places, and where its longest end that begins a token starts."""
        tokens = [(at, tail[at:]) for at in range(len(tail)) if tail[at:] in self._made]
        return tokens, next((at for at in range(len(tail)) if tail[at:] in self._heads), len(tail))

    def read(self, word: tuple, byte: int) -> tuple[tuple, int]:
        """The open word after one more byte, and the tokens that are certain by it."""
        tail, tokens, steps = word
        tail += _BYTES[byte]
        known = self._ends.get(tail)
        if known is None:
            known = self._ends[tail] = self._ending(tail)
        for at, token in known[0]:
            # The longest token that fits is the last one.
            if not tokens[at] or self.fit(tokens[at], token):
                break
        else:
            raise ValueError(f"the merges do not spell {tail!r}")
        start = known[1]
        tokens, steps = (*tokens[start:], token), (*steps[start:], steps[at] + 1)
        least = min(steps)
        return (tail[start:], tokens, tuple([n - least for n in steps]) if least else steps), least

    def read_all(self, word: tuple, data: bytes) -> tuple[tuple, int]:
        sure = 0
        for byte in data:
            word, more = self.read(word, byte)
            sure += more
        return word, sure

    def count(self, word: bytes) -> int:
        open_, sure = self.read_all(self.NONE, word)
        return sure + open_[2][-1]


class Transducer:
    """The table of states, and the machine behind it.

    A state is (mode, bytes of an unfinished character, number of the open word,
    what is read but not yet told: the last character of a run of white space, or
    the letter behind an apostrophe).
    """

    START = ("start", b"", 0, b"")

    def __init__(self, tokenizer: Tokenizer):
        self._merges = Merges(tokenizer.merges)
        self.special = re.compile(b"|".join(map(re.escape, tokenizer.special))) if tokenizer.special else None
        self._clear()

    def _clear(self) -> None:
        self._states, self._number = [self.START], {self.START: 0}
        self._words, self._word_number = [Merges.NONE], {Merges.NONE: 0}
        self._table = Table()
        self._end: list[int | None] = [None]

    def __getstate__(self):
        """The merges travel; the table starts anew in each task."""
        self._merges.forget()
        return {"_merges": self._merges, "special": self.special}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._clear()

    # --- states ---------------------------------------------------------------

    def _read(self, word: int, data: bytes) -> tuple[int, int]:
        """Number of the open word after ``data``, and the tokens certain by it."""
        open_, sure = self._merges.read_all(self._words[word], data)
        number = self._word_number.get(open_)
        if number is None:
            number = self._word_number[open_] = len(self._words)
            self._words.append(open_)
        return number, sure

    def _left(self, word: int) -> int:
        """Tokens of an open word that are not told yet."""
        return self._words[word][2][-1]

    def _ended(self, state: tuple) -> int:
        """Tokens still to come where the text ends, or a word border is certain."""
        mode, part, word, last = state
        count = self._merges.count
        rest = count(part) if part else 0
        if mode == "space":
            # A run of white space at the end is one word, unless bytes of a broken character follow.
            if part:
                return self._left(word) + count(last) + rest
            word, sure = self._read(word, last)
            return sure + self._left(word)
        if mode == "quote":
            return count(b"'") + (count(last) if last else 0) + rest
        return self._left(word) + rest

    def _step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state after one more byte, and the tokens that are certain by it."""
        mode, part, word, last = state
        if not part and byte < 128:
            kind = _ASCII[byte]
            if kind == mode and mode != _SPACE:
                word, sure = self._read(word, _BYTES[byte])
                return (mode, b"", word, b""), sure
            return self._char(state, _BYTES[byte], kind)
        part += _BYTES[byte]
        size = 1 if part[0] < 0xC0 else 2 if part[0] < 0xE0 else 3 if part[0] < 0xF0 else 4
        if len(part) < size:
            return (mode, part, word, last), 0
        try:
            kind = class_of(part.decode("utf-8"))
        except UnicodeDecodeError:
            kind = _OTHER
        return self._char((mode, b"", word, last), part, kind)

    def _char(self, state: tuple, char: bytes, kind: str) -> tuple[tuple, int]:
        mode, _, word, last = state
        if mode == "quote":
            ending = (last + char).decode("utf-8", "replace")
            if ending in ENDINGS:
                return self.START, self._merges.count(b"'" + ending.encode())
            if not last and any(e.startswith(ending) for e in ENDINGS):
                return ("quote", b"", 0, char), 0
            # No ending: the apostrophe was a sign like others, and what came after it is read anew.
            if not last:
                word, sure = self._read(0, b"'")
                after, more = self._char((_OTHER, b"", word, b""), char, kind)
                return after, sure + more
            state, sure = self._char(self.START, last, _LETTER)
            after, more = self._char(state, char, kind)
            return after, self._merges.count(b"'") + sure + more
        if mode == _SPACE:
            if kind == _SPACE:
                word, sure = self._read(word, last)
                return (_SPACE, b"", word, char), sure
            # All but the last of a run of white space are a word; a blank at its end goes to the next word.
            sure = self._left(word)
            if last != b" ":
                after, more = self._char(self.START, char, kind)
                return after, sure + self._merges.count(last) + more
            word, more = self._read(0, b" " + char)
            return (kind, b"", word, b""), sure + more
        if mode == kind:
            word, sure = self._read(word, char)
            return (mode, b"", word, b""), sure
        sure = self._left(word)
        if kind == _SPACE:
            return (_SPACE, b"", 0, char), sure
        if char == b"'":
            return ("quote", b"", 0, b""), sure
        word, more = self._read(0, char)
        return (kind, b"", word, b""), sure + more

    # --- the table ------------------------------------------------------------

    def _state_number(self, state: tuple) -> int:
        number = self._number.get(state)
        if number is None:
            number = self._number[state] = len(self._states)
            self._states.append(state)
            self._end.append(None)
        return number

    def _look_up(self, key: np.ndarray) -> np.ndarray:
        """Slots of transitions (state << 8 | byte); those that are not there yet are built."""
        slot, held = self._table.find(key)
        new = held != key
        if new.any():
            keys = np.unique(key[new])
            after = [self._step(self._states[k >> 8], k & 255) for k in keys.tolist()]
            self._table.add(keys, [self._state_number(state) for state, _ in after], [sure for _, sure in after])
            slot, _ = self._table.find(key)
        return slot

    def ends(self, states: np.ndarray) -> np.ndarray:
        values, where = np.unique(states, return_inverse=True)
        for number in values.tolist():
            if self._end[number] is None:
                self._end[number] = self._ended(self._states[number])
        return np.array([self._end[n] for n in values.tolist()], dtype=np.int64)[where]

    def tidy(self, held: int = 0) -> int:
        """Start the table anew where it is full; ``held`` is the one state still in use, whose number comes back."""
        if self._table.size > TRANSITIONS:
            mode, part, word, last = self._states[held]
            open_ = self._words[word]
            self._clear()
            self._merges.forget()
            word = self._word_number.setdefault(open_, len(self._words))
            if word == len(self._words):
                self._words.append(open_)
            held = self._state_number((mode, part, word, last))
        return held

    def run(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and certain tokens after the bytes ``lo`` to ``hi`` of ``data``, each from its own state; all side by side."""
        order = np.argsort(lo - hi, kind="stable")
        at, left, state = lo[order], (hi - lo)[order], states[order].astype(np.int64)
        count, step, table = np.zeros(len(lo), dtype=np.int64), 0, self._table
        # Longest first: those that have ended are at the back.
        falling = -left
        while True:
            live = int(np.searchsorted(falling, -step, side="left"))
            if live <= FEW:
                break
            slot = self._look_up(state[:live] << 8 | data[at[:live] + step])
            count[:live] += table.emit[slot]
            state[:live] = table.next[slot]
            step += 1
        for i in range(live):
            count[i], state[i] = self._walk(data[at[i] + step:at[i] + left[i]], int(count[i]), int(state[i]))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def _walk(self, data: np.ndarray, count: int, state: int) -> tuple[int, int]:
        """One chunk alone, without the table: transitions are remembered for this walk."""
        known: dict[int, tuple[int, int]] = {}
        for byte in data.tobytes():
            key = state << 8 | byte
            step = known.get(key)
            if step is None:
                slot = self._look_up(np.array([key]))[0]
                step = known[key] = (int(self._table.next[slot]), int(self._table.emit[slot]))
            state = step[0]
            count += step[1]
        return count, state


class Table:
    """Transitions by key in open addressing; keys are found side by side."""

    def __init__(self, bits: int = 16):
        self._shift, self._mask, self.size = np.uint64(64 - bits), (1 << bits) - 1, 0
        self._keys = np.full(1 << bits, -1, dtype=np.int64)
        self.next, self.emit = np.zeros(1 << bits, dtype=np.int32), np.zeros(1 << bits, dtype=np.int32)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, key held there); a slot without a key, which holds -1, is where a missing one would go."""
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)
        held = self._keys[slot]
        off = np.flatnonzero((held != key) & (held >= 0))
        while len(off):
            slot[off] = slot[off] + 1 & self._mask
            held[off] = self._keys[slot[off]]
            off = off[(held[off] != key[off]) & (held[off] >= 0)]
        return slot, held

    def add(self, key: np.ndarray, after: list[int], emit: list[int]) -> None:
        """Add different keys that are not there yet."""
        self.size += len(key)
        if 2 * self.size > len(self._keys):
            full = self._keys >= 0
            old, old_next, old_emit = self._keys[full], self.next[full], self.emit[full]
            self.__init__((4 * self.size - 1).bit_length())
            self.add(old, old_next, old_emit)
            self.size += len(key)
        after, emit = np.asarray(after, dtype=np.int32), np.asarray(emit, dtype=np.int32)
        while len(key):
            slot, _ = self.find(key)
            self._keys[slot] = key
            put = self._keys[slot] == key
            self.next[slot[put]], self.emit[slot[put]] = after[put], emit[put]
            key, after, emit = key[~put], after[~put], emit[~put]


def borders(data: np.ndarray) -> np.ndarray:
    """Places of ``data`` before which a word certainly ends: an ASCII white space behind a character that is none."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    blank = space | ((data >= 28) & (data <= 31))
    for wide in _WIDE_SPACES:
        hit = data == wide[-1]
        for back, byte in enumerate(reversed(wide[:-1]), 1):
            hit[back:] &= data[:-back] == byte
            hit[:back] = False
        blank |= hit
    return np.flatnonzero(space[1:] & ~blank[:-1]) + 1


def advance(machine: Transducer, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, certain tokens) of each text ``data[starts:ends]`` read from state ``entry``; the texts hold no special tokens.

    Each text is cut into chunks, each chunk into what comes before its first
    border (its head) and the rest. Composing two maps runs the right one's head
    from the state the left one ends in; where the left has no border, heads
    join. What is left at the end is one map, which is asked for the entry state.
    """
    pieces = np.maximum(1, -(-(ends - starts) // CHUNK))
    text = np.repeat(np.arange(len(starts)), pieces)
    place = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = starts[text] + place * CHUNK
    hi = np.minimum(lo + CHUNK, ends[text])
    cuts = borders(data)
    first = np.append(cuts, len(data) + 1)[np.searchsorted(cuts, np.where(place == 0, lo + 1, lo))]
    sure = first < hi
    head = np.where(sure, first, hi)
    state, count = np.zeros(len(lo), dtype=np.int64), np.zeros(len(lo), dtype=np.int64)
    state[sure], count[sure] = machine.run(data, head[sure], hi[sure], state[sure])
    while len(text) > len(starts):
        # The chunk at an even place takes the next one of its text in.
        left = np.flatnonzero((place % 2 == 0) & np.append(text[1:] == text[:-1], False))
        right = left + 1
        known = sure[left]
        a, b = left[known], right[known]
        state[a], more = machine.run(data, lo[b], head[b], state[a])
        count[a] += more
        # Where the right one has a border, what the left had open is counted there, and the right's map is constant.
        a, b = a[sure[b]], b[sure[b]]
        count[a] += machine.ends(state[a]) + count[b]
        state[a] = state[b]
        a, b = left[~known], right[~known]
        head[a], sure[a], state[a], count[a] = head[b], sure[b], state[b], count[b]
        keep = place % 2 == 0
        text, place, lo, head, sure, state, count = (x[keep] for x in (text, place // 2, lo, head, sure, state, count))
    reached, more = machine.run(data, lo, head, entry)
    more[sure] += machine.ends(reached[sure]) + count[sure]
    return np.where(sure, state, reached), more


def token_count(text: Column, tokenizer: Tokenizer) -> Column:
    """Tokens (long) of whole texts, as the tokenizer gives them; none for null and empty texts.

    A special token's own text counts as one token wherever it stands, and words
    end before and after it. Bytes that are no UTF-8 count as signs. A text may be
    of any length; equal texts are counted each. No rows give no rows.
    """
    machine = Transducer(tokenizer)

    @F.arrow_udf(LongType())
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(_counted(machine, batch), pa.int64())

    return counted(text.cast("binary"))


def _counted(machine: Transducer, batch: pa.Array) -> np.ndarray:
    counts, held, rows, size = np.zeros(len(batch), dtype=np.int64), [], [], 0

    def settle() -> None:
        sizes = np.array([len(x) for x in held])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(held), dtype=np.uint8)
        state, sure = advance(machine, data, ends - sizes, ends, np.zeros(len(held), dtype=np.int64))
        np.add.at(counts, rows, sure + machine.ends(state))
        machine.tidy()
        held.clear()
        rows.clear()

    for i, value in enumerate(batch):
        if not value.is_valid:
            continue
        text = value.as_buffer().to_pybytes()
        parts = machine.special.split(text) if machine.special else [text]
        counts[i] += len(parts) - 1
        for part in filter(None, parts):
            if len(part) > BLOCK:
                counts[i] += _count_long(machine, np.frombuffer(part, dtype=np.uint8))
                continue
            held.append(part)
            rows.append(i)
            size += len(part)
            if size > BLOCK:
                settle()
                size = 0
    if held:
        settle()
    return counts


def _count_long(machine: Transducer, data: np.ndarray) -> int:
    """Tokens of one text a block at a time; the state goes on from block to block."""
    state, total = np.zeros(1, dtype=np.int64), 0
    for at in range(0, len(data), BLOCK):
        block = data[at:at + BLOCK]
        state, sure = advance(machine, block, np.array([0]), np.array([len(block)]), state)
        total += int(sure[0])
        state[0] = machine.tidy(int(state[0]))
    return total + int(machine.ends(state)[0])
