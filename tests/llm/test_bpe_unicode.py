"""Ids are the library's for every assigned character inside a word, and for random mixtures with marks that reorder."""

import random
import unicodedata

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyspark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def differing(texts):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    encoder = bpe.WordBPE(PATH)
    out = []
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        out += [t for t, w, g in zip(part, library.encode_batch(part, add_special_tokens=False), encoder.encode_batch(part)) if np.frombuffer(g, "<u4").tolist() != w.ids]
    return out


def test_every_assigned_character():
    chars = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Co", "Cn")]
    newer = [chr(c) for c in (0x1C89, 0xA7CB, 0x10D50, 0x0558, 0x0378, 0xE0080, 0x10FFFF)]  # upper-case letters of later versions, and unassigned ones
    assert differing([f"a{c}b {c}" for c in chars + newer]) == []
    assert differing([f"X{c}̧॒" for c in chars[::7] + newer + ["৾", "ẛ", "İ"]]) == []


def test_random_mixtures():
    rng = random.Random(1)
    pool = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.4 else rng.choice("abc ABC'sé İΣ\n\t1\x1c") for _ in range(rng.randrange(30))) for _ in range(20_000)]
    assert differing(texts) == []
