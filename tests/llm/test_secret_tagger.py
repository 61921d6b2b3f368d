"""The tagger scores every token: no rule on digits, letters or length keeps a word from it."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import secrets

SIGNS = "@!#$%&*^?"
DRAWN = {
    "letters": lambda r: "".join(r.choices(string.ascii_letters, k=r.randint(12, 24))),
    "words": lambda r: "".join("".join(r.choices(string.ascii_lowercase, k=6)).capitalize() for _ in range(3)),
    "digits": lambda r: "".join(r.choices(string.digits, k=r.randint(8, 16))),
    "short": lambda r: "".join(r.choices(string.ascii_letters, k=4)) + "".join(r.choices(string.digits, k=2)),
    "signs": lambda r: "".join(r.choices(string.ascii_letters + string.digits, k=4)) + r.choice(SIGNS) + "".join(r.choices(string.ascii_letters + string.digits, k=4)) + r.choice(SIGNS) + "x7",
    "alphanumeric": lambda r: "".join(r.choices(string.ascii_letters + string.digits, k=r.randint(12, 16))),
}


@pytest.mark.parametrize("kind", list(DRAWN))
def test_secrets_that_no_digit_rule_would_let_in(kind):
    rng, model, found = random.Random(5), secrets.train(), 0
    for _ in range(200):
        head = f"some words here {rng.choice(['pwd', 'passphrase', 'login', 'my_credential'])}{rng.choice([': ', ' = ', '='])}"
        made = DRAWN[kind](rng)
        found += (len(head), len(head) + len(made)) in secrets.crf_spans([f"{head}{made} and more of them"], model)[0]
    assert found >= 180


def test_made_up_secrets_are_not_patched():
    made = [secrets._secret(random.Random(i)) for i in range(2_000)]
    assert not any("7aQ9x2" in m for m in made) and any(m.isalpha() for m in made) and any(m.isdigit() for m in made)


def test_cutting_the_chain_gives_the_tags_of_the_whole():
    weights, move = model = secrets.train()
    for text, _ in [*secrets.examples(60, seed=3), *[(t.upper() + "\n" + t, []) for t, _ in secrets.examples(20, seed=4)]]:
        start, end, _, emit = secrets._scores([text], secrets._known(weights))
        want = []
        for a, b, tag in zip(start.tolist(), end.tolist(), secrets.viterbi(emit, move) if len(emit) else []):
            if tag == secrets.B:
                want.append((a, b))
            elif tag == secrets.I:
                want[-1] = (want[-1][0], b)
        assert secrets.crf_spans([text], model) == [want]


def test_sure_tokens_are_outside_in_the_best_tagging():
    rng = np.random.default_rng(8)
    for _ in range(200):
        emit, move = rng.normal(scale=3, size=(12, 3)), rng.normal(size=(3, 3))
        move[secrets.O, secrets.I] = -1e9
        tags = np.array(secrets.viterbi(emit, move))
        assert (tags[secrets.outside(emit, move, np.zeros(12, int))] == secrets.O).all()


def test_runs_decode_as_they_do_alone():
    rng = np.random.default_rng(4)
    move = rng.normal(size=(3, 3))
    move[secrets.O, secrets.I] = -1e9
    sizes = [1, 1, 2, 3, 5, 8, 13, 40, 1, 1_100, 7]
    cuts = np.cumsum([0, *sizes])
    emit = rng.normal(scale=2, size=(cuts[-1], 3))
    got = secrets.viterbi_runs(emit, cuts, move)
    for a, b in zip(cuts[:-1], cuts[1:]):
        assert got[a:b].tolist() == secrets.viterbi(emit[a:b], move)


def test_texts_of_a_batch_do_not_see_each_other():
    model = secrets.train()
    texts = [t for t, _ in secrets.examples(80, seed=9)] + ["", "password is", "hunter2x9 and", " \n", "\x1c", "tail password=", "ab12cd34ef56"]
    assert secrets.crf_spans(texts, model) == [secrets.crf_spans([t], model)[0] for t in texts]


def test_forgetting_words_changes_nothing(monkeypatch):
    model = secrets.train()
    texts = [t for t, _ in secrets.examples(120, seed=10)]
    want = secrets.crf_spans(texts, model)
    monkeypatch.setattr(secrets, "WORDS", 200)
    monkeypatch.setattr(secrets, "_words", [])
    assert [s for t in texts for s in secrets.crf_spans([t], model)] == want


def test_model_finds_what_the_patterns_find_in_unseen_documents(spark):
    """Trained with weak labels of three quarters of the documents; judged alone, by the values in the others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    weak = secrets.weak_lines(docs.where(~held))
    assert 5 <= sum(len(s) for _, s in weak) and sum(not s for _, s in weak) > 200
    model, found, total, added = secrets.train(weak), 0, 0, 0
    texts = [r.text or "" for r in docs.where(held).collect()]
    for text, got in zip(texts, secrets.crf_spans(texts, model)):
        base = [(secrets._ASSIGN.match(text, a).start(2) if k == 0 else a, b) for a, k, b in secrets.base_spans(text)]
        total += len(set(base))
        found += len(set(base) & set(got))
        added += sum(not any(x < b and a < y for x, y in base) for a, b in got)
    assert total >= 4 and found >= 0.9 * total and added <= len(texts) / 100


@pytest.mark.parametrize("line", ["passphrase: correct-horse-battery-staple", "pin=98765432109876", "my login is Tr0ub4dor&3 ok"])
def test_spans_where_the_patterns_find_none(line):
    base, every = secrets.spans([line], secrets.train())[0]
    assert base == [] and len(every) == 1


def test_weak_lines_of_hard_rows(spark):
    rows = [(None, "password=abcdef1"), (1, None), (2, ""), (3, "x" * 5_000), (4, "A password=abcdef1 and " + "0123456789abcdef" * 2), (4, "A password=abcdef1 and " + "0123456789abcdef" * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = dict(secrets.weak_lines(df))
    assert lines.pop("x" * 300) == () and lines.pop("") == ()
    ((line, found),) = lines.items()
    assert [line[a:b] for a, b in found] == ["abcdef1", "0123456789abcdef" * 2]
    assert secrets.weak_lines(df.limit(0)) == ()


def test_empty_and_blank_texts():
    model = secrets.train()
    assert secrets.crf_spans(["", " \n\t", "x", "\x1c", "日本"], model) == [[]] * 5 and secrets.crf_spans([""], model) == [[]] and secrets.crf_spans([], model) == []


def test_lines_of_very_long_matches_are_bounded(spark):
    texts = ["password = " + "aB3" * 400_000, "words " * 50 + "abcdef0123456789" * 5_000 + " token: abc1234", "AKIA" + "Z" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = secrets.weak_lines(df)
    assert len(lines) == 3 and all(len(line) <= secrets.LONGEST for line, _ in lines)
    assert all(spans and all(0 <= a < b <= len(line) for a, b in spans) for line, spans in lines)
    assert {spans[0] for line, spans in lines if line.startswith("password")} == {(11, secrets.LONGEST)}
    assert len(secrets.scan(df).collect()) == 3
