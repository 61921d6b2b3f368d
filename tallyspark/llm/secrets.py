"""Secret scans: fixed patterns, and a linear-chain conditional random field over the words around them."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, slices

#: Kinds in the order in which spans that start together are listed; ``crf`` are those the model adds.
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Pieces that cover a text without a gap: words with the padding that may close base64, runs of other letters, single signs, white space.
_PIECE = re.compile(r"""[A-Za-z0-9+/_.-]+(?<!\.)(?:={1,2}(?![^\s"',;)\]}]))?|[^\W\x00-\x7f]+|\s+|.""", re.DOTALL)
#: Neighbours on the left of a token, in its line, that are looked up.
AROUND = 6
#: Words whose scores a worker keeps, and characters of them.
WORDS, WORD_CHARS = 250_000, 8_000_000

#: Hashed features of the model (the last row is no feature), and its tags.
FEATURES = 1 << 18
#: Features met at fewer tokens in training have no weight, so that unknown words are not scored by chance.
SEEN = 3
O, B, I = 0, 1, 2
#: Documents (bounded, expected number) whose lines are looked at for training, and lines of either sort taken from them.
LOOKED_AT, WEAK = 40_000, 1_500
#: Characters on both sides of a match, of a piece without one, and the most of any line.
ABOUT, PIECE, LONGEST = 120, 300, 1_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find, leftmost and non-overlapping for each kind."""
    out = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


def shape(token: str) -> str:
    """Character classes of a token, runs collapsed and at most eight kept."""
    out = ""
    for c in token:
        k = "9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c if c in "+/_.=-:@" else "?"
        if not out.endswith(k):
            out += k
            if len(out) == 8:
                break
    return out


def file_features(text: str) -> list[str]:
    """What the whole document says about its words: signs of code, of settings and of numbers."""
    n = max(1, len(text))
    assign = text.count("=") / n
    code = (text.count("{") + text.count(";") + text.count("(")) / n
    return [
        f"file=:{0 if assign == 0 else 1 if assign < 0.004 else 2}",
        f"file{{:{0 if code == 0 else 1 if code < 0.01 else 2}",
        f"filelen:{min(6, int(math.log10(n)))}",
    ]


def _at(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


#: Roles in which a word has features: itself, neighbour 1 to 3 on the left, neighbour on the right, word nearby.
ROLES = (slice(0, 11), slice(11, 13), slice(13, 14), slice(14, 15), slice(15, 17), slice(17, 18))
N_OWN = 18
SPACE, LINE = 1, 2


def _class(c: str) -> str:
    return "9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "l" if c.isalpha() else c if c in "+/_.=-:@" else "?"


_CLASSES = {i: _class(chr(i)) for i in range(128)}
#: Features of a word's own letters: the CRC of a name goes on over them.
_HEAD, _LEXICAL = zlib.crc32(b"head4:"), [zlib.crc32(f"{role}:".encode()) for role in ("l0", "l1", "l2", "r0", "near")]


@functools.lru_cache(maxsize=1 << 16)
def _form(of: str, form: str, varied: int) -> tuple[list[int], int, bool]:
    """(hashed features by role that follow from a word's classes, kind, has a letter); places of its letters are open."""
    n = len(of)
    digits, upper, lower = of.count("9"), of.count("A"), of.count("a") + of.count("l")
    other = n - digits - upper - lower
    mix = f"{int(upper > 0)}{int(digits > 0)}{int(lower > 0)}{int(other > 0)}"
    alpha = upper + lower > 0
    size, kinds = min(16, n // 2), min(20, varied)
    own = [
        "bias", f"shape:{form}", f"len:{size}", f"kinds/len:{size}:{kinds}", f"digits:{8 * digits // n}", f"upper:{8 * upper // n}:{mix}", f"mix:{mix}:{min(6, n // 4)}",
        "", f"dots:{min(3, of.count('.'))}:{min(4, of.count('-'))}:{min(3, of.count('/'))}", f"switches:{min(12, sum(a != b for a, b in zip(of, of[1:])))}:{size // 2}",
        f"long:{min(8, n // 8)}:{mix}", "", f"lshape:{form}", "", "", "", f"rshape:{form}", "",
    ]
    # The kind joins a word with what is around it: its classes and whether it is long, short or a single sign.
    kind = 1 + int(mix, 2) * 4 + (0 if n == 1 else 1 if n < 6 else 2 if n < 10 else 3)
    if form.startswith(("AaA", "aA")) and not digits:
        kind += 64
    return list(map(_at, own)), kind, alpha


#: Places in a word's list of features that follow from its letters: its head, itself or a single sign, and its roles as a neighbour.
_OPEN = [7, 10, 11, 13, 14, 15, 17]


def word_features(w: str) -> tuple[tuple[str, str, int], list[int], bool]:
    """(classes, shape and number of letters: what :func:`_form` takes; hashed features at the places ``_OPEN``; is a lead word)."""
    plain = w.isascii()
    of = w.translate(_CLASSES) if plain else "".join(map(_class, w))
    lower = w.lower()
    low = lower.rstrip("=")[:12].encode("utf-8", "surrogatepass")
    crc, (l0, l1, l2, r0, near) = zlib.crc32, _LEXICAL
    sign = _at(f"sign:{w}") if len(w) == 1 and not w.isalpha() else FEATURES
    head = crc(low[:4] if plain and w is lower else w[:4].encode("utf-8", "surrogatepass"), _HEAD) % FEATURES
    lead = lower in _LEAD or (not w.isalpha() and any(p in _LEAD for p in re.split("[_.-]", lower.rstrip("="))))
    return (of, _runs(of) if plain else shape(w), min(20, len(set(w)))), [head, sign, crc(low, l0) % FEATURES, crc(low, l1) % FEATURES, crc(low, l2) % FEATURES, crc(low, r0) % FEATURES, crc(low, near) % FEATURES], lead


@functools.lru_cache(maxsize=1 << 16)
def _runs(of: str) -> str:
    """The shape of a word from its classes."""
    return shape(of)


KINDS_OF_WORDS = 129
_NO_FORM = [FEATURES] * N_OWN


@functools.lru_cache(maxsize=1)
def _joint() -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of (kind, lead nearby) and of (kind, touches left, touches right, lead nearby)."""
    led = np.array([[_at(f"led:{j}|{k}") for j in range(2)] for k in range(KINDS_OF_WORDS)])
    glue = np.array([[_at(f"glue:{j}|{k}") for j in range(8)] for k in range(KINDS_OF_WORDS)])
    return led, glue


@functools.lru_cache(maxsize=1 << 10)
def _file_at(names: tuple[str, ...]) -> np.ndarray:
    """Hashed features of a document alone, and of it with each kind of word."""
    return np.array([[*[_at(f) for f in names], *[_at(f"{f}|{k}") for f in names[:2]]] for k in range(KINDS_OF_WORDS)])


class Words:
    """Pieces met so far: their features, or under a model their scores by role.

    When it is full, the half that was met last stays; word 0, which stands for no neighbour, always does.
    """

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = None
        if weights is not None:
            self.weights = np.vstack([weights, np.zeros((1, 3))])
            a, b = _joint()
            self.tables: dict[tuple[str, ...], int] = {}
            self.stacked = np.zeros((0, KINDS_OF_WORDS * 8, 3))
            self.joint = self.weights[b] + self.weights[a[:, [0, 1] * 4]]
        self.of, self.chars, self.n, self.turn = {}, 0, 0, 0
        # Features of each word, or its scores and whether it has any, for each role.
        self.rows = [np.zeros((1 << 10, N_OWN), np.int32)] if weights is None else [np.zeros((1 << 10, 3), np.float32) for _ in ROLES]
        self.weighs = [np.zeros(1 << 10, bool) for _ in ROLES]
        self.facts, self.met, self.sizes = np.zeros((1 << 10, 4), np.int16), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        edge = np.full((1, N_OWN), FEATURES)
        edge[0, [12, 16]] = _at("lshape:^"), _at("rshape:$")
        self.add([""], edge, np.zeros((1, 4), np.int16))

    def table(self, of_file: tuple[str, ...]) -> int:
        """Place in ``stacked`` of what a document says about each kind of word."""
        if of_file not in self.tables:
            self.tables[of_file] = len(self.stacked)
            one = (self.weights[_file_at(of_file)].sum(axis=1)[:, None] + self.joint).reshape(1, -1, 3)
            self.stacked = np.concatenate([self.stacked, one])
        return self.tables[of_file]

    def grow(self, end: int) -> None:
        while end > len(self.facts):
            self.facts, self.met, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.facts, self.met, self.sizes))
            self.rows = [np.concatenate([x, np.zeros_like(x)]) for x in self.rows]
            self.weighs = [np.concatenate([x, np.zeros_like(x)]) for x in self.weighs]

    def put(self, words: list[str]) -> None:
        """Learn some pieces; white space has no features."""
        at, forms, facts = np.full((len(words), len(_OPEN)), FEATURES), [_NO_FORM] * len(words), np.zeros((len(words), 4), np.int16)
        for i, w in enumerate(words):
            if w.isspace():
                facts[i, 1] = LINE if "\n" in w else SPACE
            elif w:
                form, at[i], lead = word_features(w)
                forms[i], kind, alpha = _form(*form)
                facts[i] = kind, 0, alpha, lead
        every = np.array(forms)
        every[:, _OPEN] = np.where(at < FEATURES, at, every[:, _OPEN])
        self.add(words, every, facts)

    def add(self, words: list[str], every: np.ndarray, facts: np.ndarray) -> None:
        start, end = self.n, self.n + len(words)
        self.grow(end)
        if self.weights is None:
            self.rows[0][start:end] = every
        else:
            for r, role in enumerate(ROLES):
                self.rows[r][start:end] = self.weights[every[:, role]].sum(axis=1)
                self.weighs[r][start:end] = self.rows[r][start:end].any(axis=1)
        self.facts[start:end] = facts
        self.sizes[start:end] = list(map(len, words))
        self.of.update(zip(words, range(start, end)))
        self.chars += int(self.sizes[start:end].sum())
        self.n = end

    def forget(self) -> None:
        """Keep the half of the words that was met last."""
        kept = np.sort(np.argsort(self.met[1 : self.n], kind="stable")[self.n // 2 :] + 1)
        kept = np.concatenate([[0], kept])
        names = list(self.of)
        self.of = {names[i]: k for k, i in enumerate(kept.tolist())}
        for x in (*self.rows, *self.weighs, self.facts, self.met, self.sizes):
            x[: len(kept)] = x[kept]
        self.n, self.chars = len(kept), int(self.sizes[: len(kept)].sum())

    def ids(self, pieces: list[str]) -> np.ndarray:
        while self.n > 2 and (self.n > WORDS or self.chars > WORD_CHARS):
            self.forget()
        self.turn += 1
        new = list(set(pieces).difference(self.of))
        for k in range(0, len(new), 4096):
            self.put(new[k : k + 4096])
        out = np.fromiter(map(self.of.__getitem__, pieces), np.int64, len(pieces))
        self.met[out] = self.turn
        return out


def layout(texts: list[str], words: Words) -> tuple:
    """(starts, ends, document, word and neighbours by role, kind, touching, lead nearby) of every token of some texts.

    The texts are taken as lines of one, so that they do not see each other; starts and ends count in it.
    """
    pieces = _PIECE.findall("\n".join(texts))
    every = words.ids(pieces)
    sizes = words.sizes.take(every)
    ends = np.cumsum(sizes)
    facts = words.facts.take(every, axis=0)
    space = facts[:, 1]
    keep = space == 0
    ids = every[keep]
    n = len(ids)
    end = ends[keep]
    start = end - sizes[keep]
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(first, start, side="right") - 1
    line = np.cumsum(space == LINE)[keep]
    kind, _, alpha, lead = facts[keep].T
    at = np.arange(n)

    def left(by: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if by < n:
            out[by:] = np.where(line[by:] == line[:-by], ids[:-by], 0)
        return out

    right = np.zeros(n, np.int64)
    right[:-1] = np.where(line[1:] == line[:-1], ids[1:], 0)
    touch = np.zeros(n + 1, bool)
    touch[1:n] = start[1:] == end[:-1]
    last = np.maximum.accumulate(np.where(alpha, at, -1))
    before = np.concatenate([[-1], last[:-1]])
    near, j = [], before
    for _ in range(3):
        fine = (j >= 0) & (at - j <= AROUND) & (line[j] == line)
        near.append(np.where(fine, ids[j], 0))
        j = np.where(j >= 0, before[j], -1)
    led = np.maximum.accumulate(np.where(lead, at, -1))
    led = np.concatenate([[-1], led[:-1]])
    led = (led >= 0) & (at - led <= AROUND) & (line[led] == line)
    led |= led[np.maximum.accumulate(np.where(touch[:n], 0, at))]
    return start, end, doc, [ids, left(1), left(2), left(3), right, *near], kind.astype(np.int64), touch[:n] * 2 + touch[1:], led.astype(np.int64)


def _scores(texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document, scores by tag) of every token of some texts."""
    start, end, doc, roles, kind, touch, led = layout(texts, words)
    # What a document says and what touches a word or leads to it depend on its kind alone.
    of_file = np.array([words.table(tuple(file_features(t))) for t in texts])
    emit = words.rows[0].take(roles[0], axis=0).astype(np.float64)
    emit += words.stacked.reshape(-1, 3).take(of_file[doc] * (KINDS_OF_WORDS * 8) + kind * 8 + touch * 2 + led, axis=0)
    for r, x in enumerate(roles[1:], 1):
        r = min(r, 5)
        known = np.flatnonzero(words.weighs[r].take(x))
        emit[known] += words.rows[r].take(x[known], axis=0)
    return start, end, doc, emit


def outside(emit: np.ndarray, move: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Tokens that are outside in every best tagging, as any other tag loses by being changed whatever its neighbours are.

    A next tag that is inside would become a beginning; that change is paid for too.
    """
    sure = np.ones(len(emit), bool)
    swap = np.zeros(len(emit))
    swap[:-1] = np.where(doc[1:] == doc[:-1], emit[1:, B] - emit[1:, I], 0)
    for tag, prior in ((B, [O, B, I]), (I, [B, I])):
        gain = emit[:, O] - emit[:, tag] + (move[prior, O] - move[prior, tag]).min()
        then = min(move[O, O] - move[tag, O], move[O, B] - move[tag, B])
        inside = swap + move[O, B] - move[tag, I] + (move[B] - move[I]).min()
        sure &= gain + np.minimum(then, inside) > 1e-9
    return sure


def viterbi(emit: np.ndarray, move: np.ndarray) -> list[int]:
    """Best tags of a run that is preceded and followed by an outside word; inside never follows outside."""
    to, best, back = move.T.tolist(), (move[O] + emit[0]).tolist(), []
    for e in emit[1:].tolist():
        step = [[x + m for x, m in zip(best, t)] for t in to]
        best = [max(x) + y for x, y in zip(step, e)]
        back.append([x.index(max(x)) for x in step])
    last = [x + m for x, m in zip(best, to[O])]
    tags = [last.index(max(last))]
    for b in reversed(back):
        tags.append(b[tags[-1]])
    return tags[::-1]


def viterbi_runs(emit: np.ndarray, cuts: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tags of many runs at once: those of like length step together; ``cuts`` are their first places and the end."""
    tags = np.zeros(len(emit), np.int64)
    first, size = cuts[:-1], np.diff(cuts)
    for low in 1 << np.arange(10):
        runs = np.flatnonzero((size >= low) & (size < 2 * low))
        if not len(runs):
            continue
        start, n = first[runs], size[runs]
        best, back = move[O] + emit[start], []
        for k in range(1, int(n.max())):
            step = best[:, :, None] + move[None]
            live = k < n
            now = step.max(axis=1) + emit[np.where(live, start + k, start)]
            back.append(step.argmax(axis=1))
            best = np.where(live[:, None], now, best)
        tag = (best + move[:, O]).argmax(axis=1)
        for k in range(int(n.max()) - 1, -1, -1):
            live = np.flatnonzero(k < n)
            tags[start[live] + k] = tag[live]
            if k:
                tag[live] = back[k - 1][live, tag[live]]
    for r in np.flatnonzero(size >= 1 << 10).tolist():
        tags[cuts[r] : cuts[r + 1]] = viterbi(emit[cuts[r] : cuts[r + 1]], move)
    return tags


_words: list[tuple[np.ndarray, Words]] = []


def _known(weights: np.ndarray) -> Words:
    """This process's words under a model; the last two models are kept."""
    for w, words in _words:
        if w is weights:
            return words
    _words.append((weights, Words(weights)))
    del _words[:-2]
    return _words[-1][1]


def crf_spans(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[int, int]]]:
    """For each text the (start, end) of the secrets that the model tags in it.

    Every token is scored. Those that no best tagging can have in a secret cut the chain, so decoding
    what lies between them gives the tags of the whole text.
    """
    weights, move = model
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not "".join(texts).strip():
        return out
    starts, ends, doc, emit = _scores(texts, _known(weights))
    open_ = np.flatnonzero(~outside(emit, move, doc))
    if not len(open_):
        return out
    cuts = np.flatnonzero((np.diff(open_) > 1) | (np.diff(doc[open_]) > 0)) + 1
    tags = viterbi_runs(emit[open_], np.concatenate([[0], cuts, [len(open_)]]), move)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    inside = np.flatnonzero(tags != O)
    at = open_[inside]
    for tag, d, a, b in zip(tags[inside].tolist(), doc[at].tolist(), (starts[at] - first[doc[at]]).tolist(), (ends[at] - first[doc[at]]).tolist()):
        if tag == B:
            out[d].append((a, b))
        else:
            out[d][-1] = (out[d][-1][0], b)
    return out


def spans(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text (base spans, all spans) as (start, kind, end). The model adds only what no base span touches."""
    out = []
    for text, tagged in zip(texts, crf_spans(texts, model)):
        base, added = base_spans(text), []
        reach = np.maximum.accumulate([e for _, _, e in base]) if base else np.empty(0, np.int64)
        starts = [s for s, _, _ in base]
        for a, b in tagged:
            k = int(np.searchsorted(starts, b, side="left"))
            if not k or reach[k - 1] <= a:
                added.append((a, 3, b))
        out.append((base, sorted(base + added) if added else base))
    return out


def render(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


# Training: sentences made by rule, since the tables name no secrets, and lines of documents with what the patterns find in them.

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_LEADS = ["key", "secret", "token", "password", "credential", "credentials", "pwd", "pass", "auth", "bearer", "private", "access", "apikey", "client_secret", "signature", "passphrase", "login"]
_LEAD = frozenset(_LEADS) | {"passwd", "secrets", "tokens", "keys", "pin", "api"}
_PLAIN = ["order", "invoice", "version", "build", "release", "call", "phone", "room", "page", "chapter", "ticket", "file", "photo", "see", "model", "part", "number", "id", "item", "visit", "from", "at", "on", "the", "email", "mail", "iban", "card", "account", "commit", "date"]


def _pick(rng: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(rng.choices(alphabet, k=rng.randint(low, high)))


def _word(rng: random.Random) -> str:
    w = _pick(rng, _LOWER if rng.random() < 0.8 else _LOWER + "éèçüößñáóı日", 1, 9 if rng.random() < 0.93 else 28)
    return w.capitalize() if rng.random() < 0.15 else w


def _signed(rng: random.Random) -> str:
    """A password with signs that split it; it ends in a letter or a digit, as what follows a secret may be a sign."""
    alnum = _LOWER + _UPPER + _DIGITS
    return _pick(rng, alnum, 1, 5) + "".join(rng.choice("@!#$%&*^?") + _pick(rng, alnum, 1, 6) for _ in range(rng.randint(1, 3)))


def _secret(rng: random.Random) -> str:
    alnum = _LOWER + _UPPER + _DIGITS
    return rng.choice([
        lambda: _pick(rng, alnum + "+/", 16, 64), lambda: _pick(rng, alnum, 12, 40), lambda: "ghp_" + _pick(rng, alnum, 36, 36), lambda: "sk-" + _pick(rng, alnum, 24, 48),
        lambda: "sk_live_" + _pick(rng, alnum, 24, 24), lambda: "xoxb-" + _pick(rng, _DIGITS, 10, 12) + "-" + _pick(rng, alnum, 24, 24), lambda: _pick(rng, "0123456789abcdef", 20, 64), lambda: "eyJ" + _pick(rng, alnum, 20, 60) + "." + _pick(rng, alnum + "_-", 20, 60),
        lambda: "".join(_pick(rng, _LOWER, 3, 9).capitalize() for _ in range(rng.randint(2, 4))), lambda: _pick(rng, _LOWER + _UPPER, 10, 32), lambda: _pick(rng, _LOWER, 12, 32), lambda: _pick(rng, _DIGITS, 6, 20),
        lambda: _pick(rng, _LOWER + _UPPER + _DIGITS, 5, 9) + rng.choice(_DIGITS), lambda: _signed(rng), lambda: _signed(rng),
        lambda: "AIza" + _pick(rng, alnum + "_-", 35, 35), lambda: "AKIA" + _pick(rng, _UPPER + _DIGITS, 16, 16), lambda: rng.choice("-_").join(_pick(rng, _LOWER, 3, 9) for _ in range(rng.randint(3, 5))), lambda: _pick(rng, alnum + "_-", 20, 44) + "==",
    ])()


def _harmless(rng: random.Random) -> str:
    w = lambda: _pick(rng, _LOWER, 3, 9)
    d = lambda n: _pick(rng, _DIGITS, n, n)
    return rng.choice([
        lambda: f"20{d(2)}-0{d(1)}-1{d(1)}T1{d(1)}:{d(2)}".replace(":", "."), lambda: f"v{d(1)}.{d(2)}.{d(1)}-{w()}", lambda: f"{w()}-{w()}-{d(4)}", lambda: f"{w()}_{d(3)}.{rng.choice(['jpg', 'png', 'csv', 'txt', 'html'])}",
        lambda: f"www.{w()}{d(2)}.com/{w()}/{d(3)}", lambda: f"{w()}.{w()}{d(2)}", lambda: f"{w()}{d(rng.randint(1, 4))}", lambda: f"ISO-{d(4)}-{w()[:2]}", lambda: f"{d(3)}-{d(4)}-ext{d(2)}", lambda: f"{w()}/{w()}/{d(4)}/{w()}",
        lambda: f"{w()}@{w()}.{w()[:3]}", lambda: f"https://{w()}.com/{w()}?{w()}={d(2)}", lambda: f"{w()}({w()});", lambda: f"{w()}!", lambda: f"${d(2)}.{d(2)}", lambda: d(rng.randint(1, 16)), lambda: f"### {d(11)}", lambda: f"{w()}'{w()[:2]}", lambda: f"({w()} & {w()})",
        lambda: f"+{d(2)} {d(3)} {d(4)}", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(3)}.{d(2)}.{d(1)}.{d(3)}", lambda: f"{d(2)}-{d(3)}-{d(4)}", lambda: w().upper(), lambda: f"{w().capitalize()} {w().capitalize()}",
        lambda: f"{w()}{d(1)}{w()}", lambda: f"{_pick(rng, _UPPER, 2, 2)}{d(16)}", lambda: f"{d(4)}-{_pick(rng, _UPPER, 3, 3)}-{d(4)}", lambda: f"{w().capitalize()}{d(1)}={d(2)}", lambda: f"{d(2)}px/{d(2)}em", lambda: f"--{w()}={d(2)}", lambda: f"{d(8)}-{d(2)}{_LOWER[rng.randrange(26)]}",
    ])()


def _prose(rng: random.Random, most: int) -> str:
    """Words; some lines are shouted, spread with signs, or broken."""
    words = [_word(rng) for _ in range(rng.randint(0, most))]
    kind = rng.random()
    if kind < 0.1:
        words = [w.upper() for w in words]
    if kind < 0.35:
        signs = rng.choice([["!!"], ["!", "?", "."], ["###", "%%%", "&&&", "***", "$$$"], [s * rng.randint(1, 4) for s in "#%&*$@!?^~|"]])
        words = [w + rng.choice(["", "", ".", ","]) + rng.choice(signs) if rng.random() < 0.7 else w for w in words]
    return "".join(w + ("\n" if rng.random() < 0.04 else " ") for w in words).strip()


def examples(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """(text, spans of its secrets): lines of made-up words with secrets and with harmless look-alikes."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        text, truth = "", []
        for _ in range(rng.randint(1, 3)):
            text += _prose(rng, 8)
            kind = rng.random()
            if kind < 0.45:
                lead = rng.choice(_LEADS)
                lead = rng.choice([lead, lead.upper(), lead.capitalize(), f"my_{lead}", f"db_{lead}"])
                text += f" {lead}" + rng.choice([" = ", "=", ": ", " : ", " is ", " ", ' = "', "='", " := "])
                for k in range(2 if rng.random() < 0.08 else 1):
                    start = len(text) + k
                    text += " " * k + _secret(rng)
                    truth = truth[:-1] + [(truth[-1][0], len(text))] if k else [*truth, (start, len(text))]
                text += rng.choice(["", '"', "'", ";", ","])
            elif kind < 0.55:
                text += " "
                start = len(text)
                text += "ghp_" + _pick(rng, _LOWER + _UPPER + _DIGITS, 36, 36) if rng.random() < 0.5 else "sk_live_9" + _pick(rng, _LOWER + _UPPER + _DIGITS, 24, 24)
                truth.append((start, len(text)))
            elif kind < 0.65:
                lead = rng.choice(_LEADS)
                text += " " + rng.choice([lead, lead.capitalize()]) + rng.choice([" ", " ", ": ", " is ", ", ", " for ", " = "]) + " ".join(_word(rng) for _ in range(rng.randint(1, 8)))
            else:
                text += f" {rng.choice(_PLAIN + [_word(rng)] * 20)}" + rng.choice([" ", " ", ": ", " = ", "=", " #"]) + _harmless(rng)
                if rng.random() < 0.2:
                    text += " " + _harmless(rng)
            text += rng.choice([" ", ". ", "\n", ", "])
        text += _prose(rng, 60)
        out.append((text, truth))
    return out


def weak_lines(docs: DataFrame, looked_at: int = LOOKED_AT, bound: int = WEAK) -> tuple:
    """Lines of documents with the spans that the fixed patterns find in them: weak labels for :func:`train`.

    About ``looked_at`` documents, those first in a hashed order, are searched; at most ``bound`` lines with a
    match and as many pieces of documents without one are taken. Of an assignment only the value is the secret.
    No line has over ``LONGEST`` characters: of a longer match the line holds the first ones, and the spans end with it.
    Documents with a null id or text teach nothing; no documents give no lines.
    """
    share = min(1 << 30, (looked_at << 30) // max(1, docs.count()))
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    order = F.xxhash64("doc_id", F.lit(17))

    def run(batches):
        for batch in batches:
            for o, text in zip(batch.column("o").to_pylist(), batch.column("text").to_pylist()):
                found = [m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
                found += [(a, b) for a, k, b in base_spans(text) if k and not any(x < b and a < y for x, y in found)]
                at = min(found, default=(o % max(1, len(text) - PIECE),))[0]
                low, high = (max(0, at - ABOUT), at + 2 * ABOUT) if found else (at, at + PIECE)
                high = min(max([high, *(b for a, b in found if a < high)]), low + LONGEST)
                inside = sorted((a - low, min(b, high) - low) for a, b in found if low <= a < high)
                yield pa.RecordBatch.from_pylist([{"o": o, "line": text[low:high], "spans": [x for s in inside for x in s]}], pa.schema([("o", pa.int64()), ("line", pa.string()), ("spans", pa.list_(pa.int64()))]))

    seen = map_batches(rows.where(F.pmod(order, F.lit(1 << 30)) < share).select(order.alias("o"), "text"), run, "o long, line string, spans array<long>")
    seen = cut(seen)
    out = []
    for part in (seen.where(F.size("spans") > 0), seen.where(F.size("spans") == 0)):
        for r in part.orderBy("o", "line").limit(bound).collect():
            out.append((r["line"], tuple(zip(r["spans"][::2], r["spans"][1::2]))))
    return tuple(out)


def _sequences(made):
    """(features, tags) of the tokens of each example."""
    words, joint = Words(), _joint()
    for text, truth in made:
        start, end, _, roles, kind, touch, led = layout([text], words)
        rows = [words.rows[0][x][:, ROLES[min(r, 5)]] for r, x in enumerate(roles)]
        yield np.column_stack([*rows, joint[0][kind, led], joint[1][kind, touch * 2 + led], _file_at(tuple(file_features(text)))[kind]]).astype(np.int32), _tags(start, end, truth)


def _tags(start: np.ndarray, end: np.ndarray, truth: list[tuple[int, int]]) -> np.ndarray:
    tags = np.zeros(len(start), np.int64)
    for a, b in truth:
        inside = np.flatnonzero((start < b) & (end > a))
        tags[inside], tags[inside[:1]] = I, B
    return tags


def _slope(emit: np.ndarray, real: np.ndarray, tags: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """True less expected counts of tags (by place) and of moves, over lines padded to one length, by forward-backward."""
    # A place beyond the end is outside for sure; the move into the first one closes the line, and later ones are the same for all taggings.
    likely = np.where(real[:, :, None], np.exp(emit - emit.max(axis=2, keepdims=True)), np.array([1.0, 0.0, 0.0])).transpose(1, 0, 2)
    go, k = np.exp(move), real.shape[1]
    alpha, beta, size = np.empty_like(likely), np.ones_like(likely), np.empty((*likely.shape[:2], 1))
    for i in range(k):
        now = (np.einsum("np,pq->nq", alpha[i - 1], go) if i else go[O]) * likely[i]
        size[i] = now.sum(axis=1, keepdims=True)
        alpha[i] = now / size[i]
    for i in range(k - 2, -1, -1):
        beta[i] = np.einsum("nq,pq->np", likely[i + 1] * beta[i + 1] / size[i + 1], go)
    node = (np.eye(3)[tags.T] - alpha * beta).transpose(1, 0, 2)
    live = real.T[:-1]
    moves = -go * np.einsum("np,nq->pq", alpha[:-1][live], (likely * beta / size)[1:][live])
    np.add.at(moves, (tags.T[:-1][live], tags.T[1:][live]), 1)
    moves[O] += node[:, 0].sum(axis=0)
    return node, moves


@functools.lru_cache(maxsize=2)
def train(weak: tuple = (), n: int = 4_000, epochs: int = 10, seed: int = 11, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights by feature and tag, transition scores), by gradient ascent on the conditional likelihood.

    It learns from ``n`` made-up examples and from ``weak``, lines of documents as :func:`weak_lines` labels them.

    The gradient is the difference of true and expected feature counts of a few lines at a time; the latter
    come from the forward-backward algorithm. Step sizes shrink with the squared gradients seen (AdaGrad).
    """
    data = list(_sequences([e for e in [*examples(n, seed), *weak] if e[0].strip()]))
    seen = np.zeros(FEATURES + 1, np.int64)
    for at, _ in data:
        seen += np.bincount(at.ravel(), minlength=FEATURES + 1)
    used = np.flatnonzero(seen)
    index = np.zeros(FEATURES + 1, np.int32)
    index[used] = np.arange(len(used))
    counts = seen[used]
    fixed = (counts < SEEN) | (used == FEATURES)
    weights, move = np.zeros((len(used), 3)), np.zeros((3, 3))
    move[O, I] = -1e9
    seen_w, seen_m = np.full_like(weights, 1e-6), np.full_like(move, 1e-6)
    rng = np.random.default_rng(seed)
    lengths = np.array([len(t) for _, t in data])
    groups, place = [], np.zeros(len(used), np.int32)
    for lines in np.array_split(np.argsort(lengths, kind="stable"), max(1, len(data) // 32)):
        sizes = lengths[lines]
        real = np.arange(sizes.max() + 1)[None, :] < sizes[:, None]
        tags = np.zeros(real.shape, np.int64)
        tags[real] = np.concatenate([data[i][1] for i in lines])
        rows = index[np.concatenate([data[i][0] for i in lines])]
        for i in lines.tolist():
            data[i] = None  # the driver holds one copy of the features, in four bytes each
        here = np.flatnonzero(np.bincount(rows.ravel(), minlength=len(used)))
        place[here] = np.arange(len(here))
        groups.append((real, tags, here, place[rows]))
    for _ in range(epochs):
        for g in rng.permutation(len(groups)).tolist():
            real, tags, here, rows = groups[g]
            emit = np.zeros((*real.shape, 3))
            emit[real] = weights[here][rows].sum(axis=1)
            node, moves = _slope(emit, real, tags, move)
            node = node[real]
            slope = np.column_stack([np.bincount(rows.ravel(), np.repeat(node[:, t], rows.shape[1]), len(here)) for t in range(3)]) - l2 * weights[here]
            slope[fixed[here]] = 0
            seen_w[here] += slope * slope
            weights[here] += 0.2 * slope / np.sqrt(seen_w[here])
            moves[O, I] = 0
            seen_m += moves * moves
            move += 0.2 * moves / np.sqrt(seen_m)
    out = np.zeros((FEATURES, 3))
    out[used[used < FEATURES]] = weights[used < FEATURES]
    return out, move


def scan(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf)`` of every whole text.

    ``spans`` lists kind:start:end (code points, end exclusive) by start and then by kind. A null text
    counts as empty and so has no spans; repeated rows each give a row; an empty table gives an empty
    result; other columns are not read. Without a model one is trained on a bounded sample of ``docs``
    themselves (:func:`weak_lines`). The scan is a narrow map: a lost task is simply run again.
    """
    model = train(weak_lines(docs)) if model is None else model

    def run(batches):
        for batch in batches:
            for part in slices(batch, budget=1_000_000):
                rows = []
                for base, every in spans([t or "" for t in part.column("text").to_pylist()], model):
                    count = [sum(k == i for _, k, _ in every) for i in range(4)]
                    rows.append((*count[:3], hashlib.sha256(render(base).encode()).hexdigest(), render(every), count[3]))
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def redact(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of overlapping spans in ``text`` replaced by ``mark``; ``n_chars``, if there, follows.

    All rows and columns stay; null texts stay null. Columns other than these two pass through as they are.
    Without a model one is trained as in :func:`scan`.
    """
    model = train(weak_lines(docs)) if model is None else model

    def clean(text: str | None, every: list[tuple[int, int, int]]) -> str | None:
        out, at = [], 0
        for a, _, b in every:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]]) if out else text

    def run(batches):
        for batch in batches:
            for part in slices(batch, budget=1_000_000):
                at = part.schema.get_field_index("text")
                texts = part.column("text").to_pylist()
                found = spans([t or "" for t in texts], model)
                texts = pa.array([clean(t, every) for t, (_, every) in zip(texts, found)], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), texts)

    out = map_batches(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
