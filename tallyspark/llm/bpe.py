"""BPE encoding by speculation and verification, and decoding."""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import Recent, map_batches, slices

#: Encoded chunks that one Python worker remembers.
CACHE = 250_000
#: Words, lower-cased and without punctuation, below them.
WORDS = 200_000
#: Verdicts on token pairs that one Python worker remembers.
PAIRS = 500_000
#: Unicode's White_Space characters (fixed values); Python's own notion adds U+001C to U+001F.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = re.compile(f"[{WHITE_SPACE}]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Text of characters on whose case, class and normal form this Python and the library agree, whatever stands beside them: Latin, Cyrillic,
#: kana, Han and Hangul letters of the first Unicode versions and common signs. Chunks with any other go through the library's own normaliser and splitter.
PLAIN = re.compile("[\x00-\x7f\xa1-\u0233\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20ac\u3001-\u3003\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")


def byte_symbols() -> list[str]:
    """The printable symbol that byte-level BPE files write for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


def _there(ordered: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is at its place in a sorted array."""
    inside = at < len(ordered)
    inside[inside] = ordered[at[inside]] == keys[inside]
    return inside


class WordBPE:
    """Encoder and decoder for a word-end BPE file (lower case, white space dropped).

    A text is cut at white space, and each chunk that the worker has not met is encoded:

    1. speculate: greedy longest match proposes tokens for each word of the chunk;
    2. verify: a token sequence is what the merges give if and only if every adjacent pair is
       compatible, that is, merging the two tokens' symbols alone gives back the same two tokens. All
       pairs of a batch of words are looked up in sorted arrays at once, and each pair not yet known is
       merged once;
    3. words with an incompatible pair, and only those, undergo exact merging.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {(pair := tuple(m.split(" ") if isinstance(m, str) else m)): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", f"[^{WHITE_SPACE}"))
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)
        self.symbol = byte_symbols()
        self.names = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.table = [self.names.get(i, "") for i in range(max(self.names) + 1)]
        self.known, self.fine = np.empty(0, np.int64), np.empty(0, bool)
        self.old_known, self.old_fine = self.known, self.fine
        self.cache, self.word_ids = Recent(CACHE), Recent(WORDS)
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            body = token.removesuffix(self.end)
            self.automaton.add_word(token if body == token or not body else body + "\n", i)
        self.automaton.make_automaton()

    def merge(self, parts: list[str]) -> list[str]:
        """Exact merging: the lowest-ranked pair first, of equal ones the leftmost."""
        if len(parts) > 256:
            return self._merge_long(parts)
        get, none = self.rank.get, 1 << 60
        ranks = [get(p, none) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != none:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same merges from a heap over a linked list, for words of any length."""
        get, n = self.rank.get, len(parts)
        parts = list(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p]

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = list(token.removesuffix(self.end))
            body[-1] += self.end
            return body
        return list(token)

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, index of the word) by greedy longest match; ``words`` are in byte symbols.

        All words are matched in one string, each closed by a mark that stands for the word end. A word
        whose mark no token takes in gets no proposal.
        """
        ids, ends = [], []
        for end, token in self.automaton.iter_long("\n".join(words) + "\n"):
            ids.append(token)
            ends.append(end)
        ids, ends = np.asarray(ids, np.int64), np.asarray(ends, np.int64)
        close = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        owner = np.searchsorted(close, ends)
        closed = np.zeros(len(words), bool)
        closed[owner[close[owner] == ends]] = True
        kept = closed[owner]
        return ids[kept], owner[kept]

    def _compatible(self, key: int) -> bool:
        a, b = self.names[key >> 20], self.names.get(key & 0xFFFFF)
        if b is None:
            return self.merge(self.symbols(a)) == [a]
        return self.merge(self.symbols(a) + self.symbols(b)) == [a, b]

    def verified(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair key is compatible; unknown keys are settled once and remembered."""
        if len(self.known) > PAIRS:
            self.old_known, self.old_fine = self.known, self.fine
            self.known, self.fine = np.empty(0, np.int64), np.empty(0, bool)
        at = np.searchsorted(self.known, keys)
        new = ~_there(self.known, at, keys)
        if new.any():
            fresh = np.unique(keys[new])
            old_at = np.searchsorted(self.old_known, fresh)
            old = _there(self.old_known, old_at, fresh)
            verdict = np.empty(len(fresh), bool)
            verdict[old] = self.old_fine[old_at[old]]
            verdict[~old] = [self._compatible(k) for k in fresh[~old].tolist()]
            known = np.concatenate([self.known, fresh])
            order = np.argsort(known, kind="stable")
            self.known, self.fine = known[order], np.concatenate([self.fine, verdict])[order]
            at = np.searchsorted(self.known, keys)
        return self.fine[at]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of words that are given in byte symbols."""
        flat, owner = self.propose(words)
        count = np.bincount(owner, minlength=len(words))
        at = np.cumsum(count)
        every = flat.tolist()
        out = [every[e - n : e] for e, n in zip(at.tolist(), count.tolist())]
        partner = np.full(len(flat), 0xFFFFF, np.int64)
        if len(flat):
            inner = owner[:-1] == owner[1:]
            partner[:-1][inner] = flat[1:][inner]
        keys = (flat << 20) | partner
        single = np.zeros(len(flat), bool)
        single[at[count == 1] - 1] = True
        pairs = (partner != 0xFFFFF) | single
        bad = count == 0
        good = self.verified(keys[pairs])
        bad[owner[pairs][~good]] = True
        for i in np.flatnonzero(bad).tolist():
            parts = list(words[i])
            if parts:
                parts[-1] += self.end
                out[i] = [self.ids[p] for p in self.merge(parts) if p in self.ids]
        return out

    def _learn(self, chunks: list[str]) -> None:
        odd = [c for c in chunks if not c.isascii() and not PLAIN.fullmatch(c)]
        if odd:
            self._learn_odd(odd)
            odd = set(odd)
            chunks = [c for c in chunks if c not in odd]
        found = [self.words.findall(c.lower()) for c in chunks]
        new = self.word_ids.missing({w for words in found for w in words})
        if new:
            plain = [w if w.isascii() and w.isprintable() else "".join(self.symbol[b] for b in w.encode()) for w in new]
            for w, ids in zip(new, self.encode_words(plain)):
                self.word_ids[w] = array.array("I", ids).tobytes()
        look = self.word_ids.__getitem__
        for chunk, words in zip(chunks, found):
            self.cache[chunk] = b"".join(map(look, words)) if len(words) != 1 else look(words[0])

    def _learn_odd(self, chunks: list[str]) -> None:
        split, normal = self.library.pre_tokenizer.pre_tokenize_str, self.library.normalizer.normalize_str
        found = [[w for w, _ in split(normal(c))] for c in chunks]
        new = list({w for words in found for w in words})
        ids = dict(zip(new, self.encode_words(new)))
        for chunk, words in zip(chunks, found):
            self.cache[chunk] = array.array("I", [i for w in words for i in ids[w]]).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            parts = self.cut.split(text) if self.cut and any(m in text for m in self.special) else [text]
            split.append([(self.special[p], []) if k % 2 else (None, self._chunks(p)) for k, p in enumerate(parts)])
        new = self.cache.missing({c for parts in split for _, chunks in parts for c in chunks})
        if new:
            self._learn(new)
        look = self.cache.__getitem__
        return [b"".join(b"".join(map(look, chunks)) if special is None else special.to_bytes(4, "little") for special, chunks in parts) for parts in split]

    def _chunks(self, text: str) -> list[str]:
        if _ODD_SPACE.search(text):
            return SPACES.split(text)
        return text.split()

    def decode(self, ids: bytes) -> str:
        """The tokens' strings joined by spaces, as a tokenizer file without a decoder gives them."""
        return " ".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    """One encoder for each Python worker and file."""
    return WordBPE(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)``: the ids of every whole text, little-endian unsigned 32-bit, in one binary.

    Null and empty texts give no ids. Every row gives a row, so repeated rows stay. A narrow map: rows
    do not meet, whatever their keys, and a lost task is simply run again.
    """

    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            for part in slices(batch, budget=1_000_000):
                ids = bpe.encode_batch([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids give the empty text."""

    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            for part in slices(batch, "ids", 2_000_000):
                texts = [bpe.decode(i or b"") for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every whole text, encoded then decoded.

    Both steps run on the same slice of rows, so neither ids nor decoded texts leave the worker. Null
    texts count as empty; repeated rows each give a row; other columns are not read.
    """

    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            for part in slices(batch, budget=1_000_000):
                rows = []
                for ids in bpe.encode_batch([t or "" for t in part.column("text").to_pylist()]):
                    text = bpe.decode(ids)
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                n, a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
