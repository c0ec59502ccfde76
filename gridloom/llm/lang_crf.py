"""Language of texts by a linear-chain conditional random field over their words.

A word's evidence is the sum of its features' weights: the word itself (a
lexicon), its first and last one to three letters, and its letter trigrams, all
hashed. Transitions between the languages of neighbouring words are learned with
them, from lines of one language and from lines joined out of two. Forward-backward
gives each word a language, so texts may switch (``runs``); a text's score for a
language is the mean over its words. A long text is one chain too: its pieces
advance side by side, and what reaches a piece from its neighbours is composed
from the pieces' transfer matrices.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from gridloom.llm.tables import stash

#: Labelled rows learned from, for each language, and the longest of them in characters. These bound the fit.
ROWS = 200
LONGEST = 1 << 16
FEATURES = 1 << 18
EPOCHS = 3
BATCH = 1_000
#: One of so many training lines is joined with one of another language, so that switches are learned.
JOINED = 4
#: Words that follow one another in one piece; longer texts are several pieces with messages between them.
CHAIN = 1_024
#: Words labelled at once, and words whose evidence a task remembers.
WORDS = 500_000
MEMORY = 400_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
RUNS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("lang", StringType())]))
RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("sure", DoubleType())])


def features(word: str) -> list[int]:
    marked = f"^{word}$"
    names = [f"w{word}"] + [f"p{word[:n]}" for n in (1, 2, 3)] + [f"s{word[-n:]}" for n in (1, 2, 3)]
    names += [marked[i:i + 3] for i in range(len(marked) - 2)]
    return [zlib.crc32(n.encode("utf-8")) & (FEATURES - 1) for n in names]


@dataclass
class Model:
    """Weights of a fit: FEATURES x languages, and the transitions. A few megabytes, whatever the data."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def fit(texts: list[str], labels: list[str]) -> Model:
    """Learn from whole lines: maximum likelihood by stochastic gradients with adaptive steps; the same rows give the same model."""
    languages = sorted(set(labels))
    size = len(languages)
    place = {x: i for i, x in enumerate(languages)}
    vocabulary: dict[str, int] = {}
    chains = []
    for text, label in zip(texts, labels):
        for line in text.splitlines():
            words = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(line)]
            chains += [(words[i:i + 64], [place[label]] * len(words[i:i + 64])) for i in range(0, len(words), 64)]
    random = np.random.default_rng(0)
    for words, gold in chains[::JOINED]:
        more, other = chains[random.integers(len(chains))]
        if other[0] != gold[0]:
            chains.append((words[:32] + more[:32], gold[:32] + other[:32]))
    table = [features(w) for w in vocabulary]
    weights, step_w = np.zeros((FEATURES, size)), np.full((FEATURES, size), 1e-2)
    transitions, step_t = np.zeros((size, size)), np.full((size, size), 1e-2)
    for _ in range(EPOCHS):
        order = random.permutation(len(chains))
        for at in range(0, len(order), BATCH):
            batch = [chains[i] for i in order[at:at + BATCH]]
            words = np.concatenate([c[0] for c in batch]).astype(np.int64)
            used, ids = np.unique(words, return_inverse=True)
            lists = [table[w] for w in used]
            flat, owner = np.concatenate(lists).astype(np.int64), np.repeat(np.arange(len(used)), [len(x) for x in lists])
            evidence = np.zeros((len(used), size))
            np.add.at(evidence, owner, weights[flat])
            length = np.array([len(c[0]) for c in batch])
            gold = np.concatenate([c[1] for c in batch])
            marginals, pairs = forward_backward(evidence, ids, length, transitions, want_pairs=True)
            error = -marginals
            error[np.arange(len(gold)), gold] += 1
            by_word = np.zeros((len(used), size))
            np.add.at(by_word, ids, error)
            some, inverse = np.unique(flat, return_inverse=True)
            grad = np.zeros((len(some), size))
            np.add.at(grad, inverse, by_word[owner])
            step_w[some] += grad ** 2
            weights[some] += 0.3 * grad / np.sqrt(step_w[some])
            seen = np.zeros((size, size))
            after = np.delete(np.arange(len(gold)), np.cumsum(length) - length)
            np.add.at(seen, (gold[after - 1], gold[after]), 1)
            grad = seen - pairs - 1e-3 * len(batch) * transitions
            step_t += grad ** 2
            transitions += 0.1 * grad / np.sqrt(step_t)
    return Model(languages, weights.astype(np.float32), transitions)


def forward_backward(
    evidence: np.ndarray, ids: np.ndarray, length: np.ndarray, transitions: np.ndarray, want_pairs: bool = False,
    enter: np.ndarray | None = None, leave: np.ndarray | None = None,
):
    """Marginals of every word; ``ids`` has the words of one chain after another, of the given lengths (1 or more).

    Chains advance together, a word at a time; messages are scaled to sum to 1. ``enter`` and ``leave`` are the messages
    that reach the first and the last word of each chain from outside.
    """
    likely = np.exp(evidence - evidence.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    start = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0]), side="left") if len(length) else []
    alpha = np.empty((len(ids), evidence.shape[1]))
    message = np.ones((len(length), evidence.shape[1])) if enter is None else enter[order]
    for t, n in enumerate(active):
        word = likely[ids[start[:n] + t]]
        message = message * word if t == 0 else (message[:n] @ move) * word
        message = message / message.sum(axis=1, keepdims=True)
        alpha[start[:n] + t] = message
    pairs = np.zeros_like(move)
    beta = np.ones((len(length), evidence.shape[1])) if leave is None else leave[order]
    for t in range(len(active) - 1, 0, -1):
        n = active[t]
        at = start[:n] + t
        ahead = likely[ids[at]] * beta[:n]
        if want_pairs:
            before = alpha[at - 1]
            scale = np.einsum("ni,ij,nj->n", before, move, ahead)
            pairs += move * (before.T @ (ahead / scale[:, None]))
        alpha[at] *= beta[:n]
        back = ahead @ move.T
        beta[:n] = back / back.sum(axis=1, keepdims=True)
    if len(active):
        alpha[start] *= beta
    alpha /= alpha.sum(axis=1, keepdims=True)
    return (alpha, pairs) if want_pairs else alpha


def through(evidence: np.ndarray, ids: np.ndarray, length: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Transfer matrices of chains, each up to a factor: row s is the message behind a chain whose preceding word is in s, the last row that of a chain that begins a text."""
    likely = np.exp(evidence - evidence.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    start = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")
    begin, sizes = start[order], length[order]
    state = np.broadcast_to(np.concatenate([move, np.ones((1, len(move)))]), (len(length), len(move) + 1, len(move))).copy()
    for t in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -t, side="left"))
        now = state[:n] if t == 0 else state[:n] @ move
        now = now * likely[ids[begin[:n] + t]][:, None]
        state[:n] = now / now.sum(axis=(1, 2), keepdims=True)
    out = np.empty_like(state)
    out[order] = state
    return out


def messages_between(matrices: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters and leaves each piece of texts, from the pieces' transfer matrices; ``first`` marks the piece that begins a text."""
    move = np.exp(transitions - transitions.max())
    size = len(move)
    enter, leave = np.ones((len(matrices), size)), np.ones((len(matrices), size))
    behind = None
    for i, matrix in enumerate(matrices):
        if first[i]:
            behind = matrix[size]
        else:
            enter[i] = behind @ move
            behind = behind @ matrix[:size]
        behind = behind / behind.sum()
    for i in range(len(matrices) - 2, -1, -1):
        if not first[i + 1]:
            ahead = matrices[i + 1][:size] @ leave[i + 1]
            leave[i] = ahead / ahead.sum()
    return enter, leave


class Labeller:
    def __init__(self, model: Model):
        self._model, self._ids, self._evidence = model, {}, []

    def _remember(self, words: list[str]) -> None:
        if len(self._ids) > MEMORY:
            self._ids, self._evidence = {}, []
        for word in set(words).difference(self._ids):
            self._ids[word] = len(self._evidence)
            self._evidence.append(self._model.weights[features(word)].sum(axis=0))

    def labels(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, its mean, and the mean of each word's best label, whichever language it is."""
        names, scores, sure = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        rows, held = [], []
        size = 0

        def settle():
            marginals, length = self._marginals(held)
            means, bests = _by_text(marginals, length), _by_text(marginals.max(axis=1, keepdims=True), length)[:, 0]
            for row, mean, each in zip(rows, means, bests):
                best = int(mean.argmax())
                names[row], scores[row] = self._model.languages[best], float(min(1.0, max(0.0, mean[best])))
                sure[row] = float(min(1.0, each))

        for row, text in enumerate(texts):
            if not text or not self._model.languages or not _has_letter(text):
                continue
            rows.append(row)
            held.append(words_of(text))
            size += len(held[-1])
            if size >= WORDS:
                settle()
                rows, held, size = [], [], 0
        if rows:
            settle()
        return names, scores, sure

    def _means(self, texts: list[list[str]]) -> np.ndarray:
        """Mean marginals of each text."""
        return _by_text(*self._marginals(texts))

    def _marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, list[int]]:
        """Marginals of every word of one text after another, and the words of each."""
        every = [w for words in texts for w in words]
        self._remember(every)
        known = self._ids
        used, ids = np.unique(np.fromiter(map(known.__getitem__, every), np.int64, len(every)), return_inverse=True)
        evidence = np.array([self._evidence[i] for i in used])
        length = [len(words) for words in texts]
        pieces = np.array([min(CHAIN, n - i) for n in length for i in range(0, n, CHAIN)])
        first = np.array([i == 0 for n in length for i in range(0, n, CHAIN)])
        shape = (len(pieces), evidence.shape[1])
        enter, leave = np.ones(shape), np.ones(shape)
        # Only the pieces of texts that have several exchange messages.
        joined = ~first
        joined[:-1] |= ~first[1:]
        if joined.any():
            some = ids[np.repeat(joined, pieces)]
            matrices = through(evidence, some, pieces[joined], self._model.transitions)
            enter[joined], leave[joined] = messages_between(matrices, first[joined], self._model.transitions)
        return forward_backward(evidence, ids, pieces, self._model.transitions, enter=enter, leave=leave), length

    def runs(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Stretches (start, end, language) of each text, code points, the end exclusive."""
        return [self._runs_of(text) if text and self._model.languages else [] for text in texts]

    def _runs_of(self, text: str) -> list[tuple[int, int, str]]:
        found = list(_WORD.finditer(text))
        if not found:
            return []
        best = self._marginals([[m.group().lower() for m in found]])[0].argmax(axis=1)
        starts = np.flatnonzero(np.diff(best, prepend=-1)).tolist()
        return [(found[i].start(), found[j - 1].end(), self._model.languages[best[i]]) for i, j in zip(starts, starts[1:] + [len(found)])]


def _by_text(values: np.ndarray, length: list[int]) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(length) - length) / np.array(length)[:, None]


def _has_letter(text: str) -> bool:
    return bool(re.search("[A-Za-z]", text)) or any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    """A fixed quarter of the ids that is never learned from. Null is not held out, nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """(lang, text): at most ``rows`` labelled rows of each language, those of the smallest id hashes."""
    length = F.length("text")
    able = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & length.between(1, LONGEST))
    hashed = F.xxhash64("doc_id").alias("hash")
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    first = able.select("lang", "doc_id", hashed).withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows)
    # A few rows for each language; written, so that Spark knows and does not shuffle the texts to meet them.
    first = stash(first.select(F.col("lang").alias("of_lang"), F.col("doc_id").alias("of_id")).distinct(), "language-sample")
    found = able.select("lang", "doc_id", "text", hashed).join(first, (F.col("lang") == F.col("of_lang")) & (F.col("doc_id") == F.col("of_id")))
    # Ids may repeat, so the bound is set once more.
    order = Window.partitionBy("lang").orderBy("hash", "doc_id", "text")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).select("lang", "text")


def train(docs: DataFrame, rows: int = ROWS) -> Model:
    """Fit on the driver from ``sample``: 200 rows of 65,536 characters a language at most."""
    learned = sorted(tuple(r) for r in sample(docs, rows).collect())
    return fit([t for _, t in learned], [x for x, _ in learned])


def identify(text: Column, model: Model) -> Column:
    """Struct (lang_pred, score, sure) of whole texts: ``und`` and 0 for null, for texts without a letter, and where nothing was learned.

    ``score`` is the mean of lang_pred over the words; ``sure`` is that of each word's best label, so it is high in clean mixed texts too.
    """

    @F.pandas_udf(RESULT)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model)
        for texts in batches:
            names, scores, sure = labeller.labels(list(texts))
            yield pd.DataFrame({"lang_pred": names, "score": scores, "sure": sure})

    return label(text)


def runs(text: Column, model: Model) -> Column:
    """Stretches (start, end, lang) of neighbouring words in one language, in code points, from the first word's start to the last word's end.

    Null, texts without a letter, and a model that has learned nothing give an empty array.
    """

    @F.pandas_udf(RUNS)
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeller = Labeller(model)
        for texts in batches:
            yield pd.Series([[{"start": a, "end": b, "lang": lang} for a, b, lang in each] for each in labeller.runs(list(texts))], dtype=object)

    return told(text)
