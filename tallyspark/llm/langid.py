"""Language ID by unigram piece models whose word probabilities sum over all segmentations."""

from __future__ import annotations

import functools
import re
from collections import Counter
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, slices

#: Training documents (bounded, expected number) of each language.
TRAINING = 4_000
ROUNDS = 3
#: Parts of the table of training words, whose size is bounded by the training documents.
PARTS = 64
#: Pseudo count of a piece in each language.
PSEUDO = 0.05
#: Distinct words whose log probabilities one Python worker remembers.
CACHE = 200_000
#: Longest word that is taken in a batch; longer ones are taken one by one.
LONG = 48
#: Probabilities are scaled by this much a character, so that a batch needs no logarithms.
SCALE = 1000.0
MARK = "▁"
_RUNS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> list[str]:
    """Lower-cased maximal runs of letters (Unicode L*) of a text."""
    runs = _RUNS.findall(text.lower())
    return runs if all(map(str.isalpha, runs)) else [w for r in runs for w in "".join(c if c.isalpha() else " " for c in r).split()]


class Pieces:
    """The letter pieces of a fixed sentencepiece vocabulary, found in many words at once."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.byte = np.zeros(256, np.int64)
        self.automaton = ahocorasick.Automaton()
        self.chars = {"\n"}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)) and (piece.removeprefix(MARK) + "a").isalpha():
                self.automaton.add_word(piece, i << 8 | len(piece))
                if len(piece) == 1:
                    self.chars.add(piece)
        self.automaton.make_automaton()

    def lattice(self, words: list[str]):
        """(piece, first node, last node, nodes of each word's end) of all pieces in marked words.

        Nodes stand between the characters of the words laid end to end. A character that is no piece
        of its own is spelt in bytes; it gives one match whose piece is minus the code point.
        """
        joined = "".join([f"{MARK}{w}\n" for w in words])
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        piece, last = found[:, 1] >> 8, found[:, 0] + 1
        first = last - (found[:, 1] & 255)
        spelt = []
        for c in set(joined) - self.chars:
            at = -1
            while (at := joined.find(c, at + 1)) >= 0:
                spelt.append((-ord(c), at))
        if spelt:
            own = np.array(spelt, np.int64)
            piece, first, last = np.concatenate([piece, own[:, 0]]), np.concatenate([first, own[:, 1]]), np.concatenate([last, own[:, 1] + 1])
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2) - 1
        return piece, first, last, ends

    def rows(self, piece: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Scaled probabilities of matches, one column a language."""
        out = p[np.maximum(piece, 0)]
        for c in np.unique(piece[piece < 0]).tolist():
            out[piece == c] = p[self.byte[list(chr(-c).encode("utf-8", "surrogatepass"))]].prod(axis=0)
        return out


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _levels(node: np.ndarray, rel: np.ndarray):
    """Groups of matches for each distance from the word's edge, sorted by node within a group."""
    order = np.lexsort((node, rel))
    cuts = np.flatnonzero(np.diff(rel[order])) + 1
    for group in np.split(order, cuts):
        if len(group):
            heads = np.flatnonzero(np.diff(node[group], prepend=-1))
            yield group, heads


def forward(vocabulary: Pieces, found, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scaled forward sums by node, scaled match probabilities, first node of each word)."""
    piece, first, last, ends = found
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    word = np.searchsorted(ends, first, side="left")
    weight = vocabulary.rows(piece, p) * (SCALE ** (last - first))[:, None]
    alpha = np.zeros((int(ends[-1]) + 1, p.shape[1]))
    alpha[starts] = 1.0
    for group, heads in _levels(last, last - starts[word]):
        terms = alpha[first[group]] * weight[group]
        alpha[last[group[heads]]] += np.add.reduceat(terms, heads)
    return alpha, weight, starts


def log_probabilities(vocabulary: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, summed over all its segmentations."""
    out = np.zeros((len(words), p.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    alone = [i for i, w in enumerate(words) if len(w) > LONG]
    if short:
        chosen = [words[i] for i in short]
        found = vocabulary.lattice(chosen)
        alpha, _, _ = forward(vocabulary, found, p)
        total = alpha[found[3]]
        lost = np.flatnonzero(_rare(total))
        with np.errstate(divide="ignore"):
            out[short] = np.log(total) - (np.fromiter(map(len, chosen), np.int64, len(chosen)) + 1)[:, None] * np.log(SCALE)
        alone += [short[i] for i in lost]
    for i in alone:
        out[i] = _long(vocabulary, words[i], p)
    return out


def _in_logs(vocabulary: Pieces, word: str, p: np.ndarray):
    """(piece, first and last node, log weight of each match, log forward sums) of one word of any length or rarity."""
    piece, first, last, ends = vocabulary.lattice([word])
    order = np.argsort(last, kind="stable")
    piece, first, last = piece[order], first[order], last[order]
    n = int(ends[-1])
    heads = np.searchsorted(last, np.arange(n + 2))
    with np.errstate(divide="ignore"):
        weight = np.log(vocabulary.rows(piece, p))
    alpha = np.full((n + 1, p.shape[1]), -np.inf)
    alpha[0] = 0.0
    for e in range(1, n + 1):
        m = slice(heads[e], heads[e + 1])
        if m.start < m.stop:
            alpha[e] = np.logaddexp.reduce(alpha[first[m]] + weight[m], axis=0)
    return piece, first, last, weight, alpha


def _long(vocabulary: Pieces, word: str, p: np.ndarray) -> np.ndarray:
    """The forward algorithm over one word of any length, in logarithms."""
    return _in_logs(vocabulary, word, p)[4][-1]


def _long_counts(vocabulary: Pieces, word: str, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece of each match, expected number of times that it is used in each language) of one word."""
    piece, first, last, weight, alpha = _in_logs(vocabulary, word, p)
    n = len(alpha) - 1
    beta = np.full_like(alpha, -np.inf)
    beta[n] = 0.0
    order = np.argsort(first, kind="stable")
    heads = np.searchsorted(first[order], np.arange(n + 2))
    for s in range(n - 1, -1, -1):
        m = order[heads[s] : heads[s + 1]]
        if len(m):
            beta[s] = np.logaddexp.reduce(beta[last[m]] + weight[m], axis=0)
    return piece, np.exp(alpha[first] + weight + beta[last] - alpha[n])


def _rare(total: np.ndarray) -> np.ndarray:
    """Words whose scaled sums are too small for plain arithmetic."""
    return (total < 1e-250).any(axis=1)


def expected_counts(vocabulary: Pieces, words: list[str], times: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected piece counts (piece, language) of words that occur ``times`` in each language.

    Long words, and those too improbable for plain arithmetic, are taken one by one in logarithms.
    """
    out = np.zeros_like(p)

    def add(piece: np.ndarray, counts: np.ndarray) -> None:
        known = piece >= 0
        for k in range(p.shape[1]):
            out[:, k] += np.bincount(piece[known], counts[known, k], minlength=len(p))
        for c in np.unique(piece[~known]).tolist():
            for b in chr(-c).encode("utf-8", "surrogatepass"):
                out[vocabulary.byte[b]] += counts[piece == c].sum(axis=0)

    size = np.fromiter(map(len, words), np.int64, len(words))
    short, alone = np.flatnonzero(size <= LONG), np.flatnonzero(size > LONG).tolist()
    if len(short):
        found = vocabulary.lattice([words[i] for i in short])
        piece, first, last, ends = found
        alpha, weight, starts = forward(vocabulary, found, p)
        word = np.searchsorted(ends, first, side="left")
        beta = np.zeros_like(alpha)
        beta[ends] = 1.0
        for group, heads in _levels(first, ends[word] - first):
            terms = beta[last[group]] * weight[group]
            beta[first[group[heads]]] += np.add.reduceat(terms, heads)
        total = alpha[ends]
        rare = _rare(total)
        share = np.where(rare[:, None], 0.0, times[short] / np.maximum(total, 1e-300))
        add(piece, alpha[first] * weight * beta[last] * share[word])
        alone += short[rare].tolist()
    for i in alone:
        piece, counts = _long_counts(vocabulary, words[i], p)
        add(piece, counts * times[i])
    return out


def _word_counts(batches):
    """(lang, word, n) of a task's texts; sent on whenever many words are held."""
    held: dict[str, Counter] = {}

    def flush():
        rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
        held.clear()
        if rows:
            a, b, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c, pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for part in slices(batch, budget=1_000_000):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                held.setdefault(lang, Counter()).update(letters(text or ""))
            if sum(map(len, held.values())) > 300_000:
                yield from flush()
    yield from flush()


def train(docs: DataFrame, path: str, training: int = TRAINING, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages in order, piece probabilities with one column a language), fitted by EM.

    ``docs(doc_id, text, lang)``: about ``training`` documents of each language, those first in a hashed order,
    are counted into words (the driver learns only how many documents each language has); each round of EM is a Spark job over the distinct words and gives one row
    for each piece and language. Rows with a null lang teach nothing. Words of any length teach.
    """
    known = docs.where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    enough = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1 << 30, (training << 30) // sizes[x]))) for x in langs], F.lit(0))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < enough).select("lang", "text")
    counts = map_batches(chosen, _word_counts, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    words = cut(counts.repartition(PARTS, "word"))
    size = sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
    p = np.full((size, len(langs)), 1.0 / size)
    column = {lang: k for k, lang in enumerate(langs)}

    def step(sent):
        def run(batches):
            vocabulary, p = pieces(path), sent.value
            total = np.zeros_like(p)
            for batch in batches:
                for at in range(0, batch.num_rows, 8_000):
                    part = batch.slice(at, 8_000)
                    times = np.zeros((part.num_rows, len(langs)))
                    times[np.arange(part.num_rows), [column[x] for x in part.column("lang").to_pylist()]] = part.column("n").to_numpy()
                    total += expected_counts(vocabulary, part.column("word").to_pylist(), times, p)
            i, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), pa.array(total[i, k])], names=["piece", "k", "n"])

        return run

    for _ in range(rounds if langs else 0):
        sent = docs.sparkSession.sparkContext.broadcast(p)  # pieces of the fixed vocabulary times languages
        rows = words.mapInArrow(step(sent), "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full_like(p, PSEUDO)
        counts[rows["piece"], rows["k"]] += rows["n"]
        p = counts / counts.sum(axis=0)
    return langs, p


class Scorer:
    """Log likelihoods of texts, with a bounded memory of words in two generations."""

    def __init__(self, path: str, p: np.ndarray):
        self.vocabulary, self.p = pieces(path), p
        self.at, self.known = {}, np.zeros((0, p.shape[1]))
        self.old_at, self.old_known = self.at, self.known

    def learn(self, words: set[str]) -> None:
        """Have the log probabilities of all these words at hand until the next call."""
        if len(self.at) > CACHE:
            self.old_at, self.old_known = self.at, self.known
            self.at, self.known = {}, self.known[:0]
        new = words.difference(self.at)
        back = list(new.intersection(self.old_at))
        new = list(new.difference(back))
        rows = [self.old_known[np.fromiter(map(self.old_at.__getitem__, back), np.int64, len(back))]]
        rows += [log_probabilities(self.vocabulary, new[i : i + 4_000], self.p) for i in range(0, len(new), 4_000)]
        self.at.update(zip([*back, *new], range(len(self.known), len(self.known) + len(back) + len(new))))
        self.known = np.concatenate([self.known, *rows])

    def texts(self, texts: list[str]) -> list[np.ndarray | None]:
        """Per text the log likelihood in each language, or None if it has no letters."""
        counts = [Counter(letters(t)) for t in texts]
        self.learn({w for c in counts for w in c})
        out = []
        for c in counts:
            if c:
                n = np.fromiter(c.values(), np.float64, len(c))
                out.append(n @ self.known[np.fromiter(map(self.at.__getitem__, c), np.int64, len(c))])
            else:
                out.append(None)
        return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row of ``docs`` from its text alone.

    ``score`` is the posterior probability of the language with equal priors. A text that is null or
    has no letters (Unicode L*) is ``und`` with score 0, and so is every text if no language was
    learned. Equal posteriors go to the language that comes first in order. Repeated rows each give a
    row; an empty table gives an empty result; other columns are not read.
    """
    langs, p = model
    sent = docs.sparkSession.sparkContext.broadcast(p)  # pieces of the fixed vocabulary times languages

    def run(batches):
        scorer = Scorer(path, sent.value) if langs else None
        for batch in batches:
            for part in slices(batch, budget=1_000_000):
                texts = [t or "" for t in part.column("text").to_pylist()]
                pred, score = [], []
                for x in scorer.texts(texts) if scorer else [None] * len(texts):
                    if x is None:
                        pred.append("und")
                        score.append(0.0)
                    else:
                        k = int(np.argmax(x))
                        pred.append(langs[k])
                        score.append(float(1.0 / np.exp(x - x[k]).sum()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that are ``und`` or whose score is below ``least``; all columns stay as they are.

    Rows are judged and passed on in one scan, so texts are not shuffled and rows with a null or
    repeated doc_id are judged like any other.
    """
    langs, p = model
    sent = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        scorer = Scorer(path, sent.value) if langs else None
        for batch in batches:
            for part in slices(batch, budget=1_000_000):
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = scorer.texts(texts) if scorer else [None] * len(texts)
                yield part.filter(pa.array([x is not None and 1.0 / np.exp(x - x.max()).sum() >= least for x in found], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is held out of training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, path: str, training: int = TRAINING) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: trained on the documents that are not held out, applied to all.

    A null doc_id is not held out. See :func:`train` and :func:`predict`.
    """
    model = train(docs.where(~held_out()), path, training)
    return predict(docs, model, path).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
