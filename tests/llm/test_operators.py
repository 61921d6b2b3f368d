"""Each operator against a brute-force version on a small table with hard cases."""

import collections
import decimal
import gzip
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import bpe, common, components, decontam, embdedup, hilbert, langid, quality, secrets, simhash, tokenfile, warc

SF = "/root/testdata/sf0.001"
LONG = "lorem Ipsum, dolor-sit amet 12 " * 3000
HARD = [
    None, "", " ", "\n\t ", "a", "A b", "a b c d", "one two three four five six", "one two three four five six", LONG, LONG + "x", "é" * 500, "ÅÄÖ ﬁ Ω Σ ΑΣ straße İı", "日本語 テキスト", "12 34 !!", "x" * 5000,
    "it's we'll  don't   stop now wide \x1c odd", "<|endoftext|> in <|startoftext|> text", "emoji 👍🏽 👨‍👩‍👧 end", "tab\tand\r\nline", 'password = "abcdef123" TOKEN:x1y2z3 api-key=zzzzzz9',
]
DDL = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id long, hash string"


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in every column, ties, repeated rows, and extra columns whose names the operators use inside."""
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else "src", len(t or ""), 7, 8, "h") for i, t in enumerate(HARD)]
    rows += [(3, HARD[3], "en", "src", 1, None, None, None), (3, HARD[3], "en", "src", 1, None, None, None), (None, "no id here at all", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


# 1. Quality


def slow_buckets(text, n):
    """Uni- and bigram buckets with Python integers."""
    m = (1 << 64) - 1
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\t\n\v\f\r ]+", text.encode())
    h = [sum((b + 1) * pow(quality._ODD, k, 1 << 64) for k, b in enumerate(t)) & m for t in tokens]
    h += [int(quality._REPEAT) if x == y else (y * 0xD6E8FEB86659FD93 + x) & m for x, y in zip(h, h[1:])]
    return collections.Counter((((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & m) >> (64 - int(math.log2(n))) for x in h)


def test_ngrams_match_a_slow_count():
    some = [t for t in HARD if t is not None and len(t) < 6000]
    data, starts = quality._texts(pa.RecordBatch.from_pydict({"text": pa.array([None, *some])}))
    at, owner = quality.ngram_buckets(data, starts, 1 << 12)
    got = [collections.Counter(at[owner == i].tolist()) for i in range(len(some) + 1)]
    assert got == [collections.Counter(), *[slow_buckets(t, 1 << 12) for t in some]]


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(-i, float(x), int(t)) for i, (x, t) in enumerate(zip(np.round(rng.normal(size=3000), 1), rng.integers(0, 9, 3000)))]
    df = spark.createDataFrame(rows, "place long, key double, tie long").repartition(3)
    for k in (0, 1, 17, 1500, 2999, 3000, 9999):
        want = {i for i, _, _ in sorted(rows, key=lambda r: (-r[1], -r[2], -r[0]))[:k]}
        got = quality.top_k(df, k, "key", "tie", "place", intervals=16).where("kept").collect()
        assert len(got) == min(k, 3000) and {r.place for r in got} == want


def test_top_k_of_equal_and_close_keys(spark):
    keys = [1.0, 1.0, np.nextafter(1.0, 2), 1.0, np.nextafter(1.0, 0), 1e300, -1e300, 1.0]
    df = spark.createDataFrame([(float(x), i) for i, x in enumerate(keys)], "key double, place long")
    for k in range(len(keys) + 1):
        want = {i for x, i in sorted(((x, i) for i, x in enumerate(keys)), reverse=True)[:k]}
        assert {r.place for r in quality.top_k(df, k, "key", "place", intervals=8).where("kept").collect()} == want


def test_quality_matches_slow_models(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sample = quality.labelled_sample(labels).collect()
    good = {r.doc_id for r in sample if r.good}
    raw, target = np.full(quality.BUCKETS, quality.PSEUDO), np.full(quality.BUCKETS, quality.PSEUDO)
    counts = {i: slow_buckets(t or "", quality.BUCKETS) for i, t in texts(docs)}
    for i, c in counts.items():
        for b, n in c.items():
            raw[b] += n
            target[b] += n * (i in good)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    got = quality.resample(docs, labels).collect()
    assert len(got) == len(counts)
    for r in got:
        assert math.isclose(r.log_weight, sum(n * ratio[b] for b, n in counts[r.doc_id].items()), rel_tol=1e-9, abs_tol=1e-6)
    k = math.ceil(sum(r.quality for r in sample) / len(sample) * len(got))
    cut = sorted((r.gumbel_key for r in got), reverse=True)[k - 1]
    assert [r.kept for r in got] == [r.gumbel_key >= cut for r in got]


def test_gumbel_sampling_follows_the_weights(spark):
    """Of two documents the heavier one is first as often as its share of the weights says."""
    df = spark.range(20_000).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"))
    first = df.where(F.lit(1.0) + quality.gumbel(7, "a") > quality.gumbel(7, "b")).count()
    assert abs(first / 20_000 - math.e / (1 + math.e)) < 0.015


def test_rows_that_repeat_are_kept_to_the_exact_number(spark):
    docs = spark.createDataFrame([(1, "same words here")] * 10 + [(None, None)] * 7, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for share in (0.1, 0.5, 0.9):
        assert quality.resample(docs, labels, share=share).where("kept").count() == math.ceil(share * 17)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = {r.doc_id for r in quality.labelled_sample(labels, 200).collect()}
    got = quality.resample(d, labels, bound=200).join(labels, "doc_id").collect()
    held = [r for r in got if r.doc_id not in seen]
    good, bad = [r.log_weight for r in held if r.quality == 1], [r.log_weight for r in held if r.quality == 0]
    assert np.mean([[x > y for x in good] for y in bad]) > 0.93  # from 200 labelled documents
    assert np.mean([r.kept for r in held if r.quality == 1]) > 0.9 and np.mean([r.kept for r in held if r.quality == 0]) < 0.2


def test_quality_hard_cases(spark, hard, empty):
    labels = spark.createDataFrame([(7, 1, 0), (14, 0, None), (None, 1, 0), (8, None, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.resample(hard, labels, share=0.5).collect()
    assert len(got) == len(HARD) + 4 and all(math.isfinite(r.log_weight) for r in got)
    assert {r.log_weight for r in got if r.doc_id in (0, 1, 2, 3)} == {0.0}
    assert quality.resample(empty, labels).count() == 0
    assert quality.resample(hard, labels.limit(0)).where("kept").count() == len(HARD) + 4


# 2. SimHash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_components(df):
    got = {r.doc_id: r for r in simhash.components(df).collect()}
    fp = {i: slow_fingerprint(t) for i, t in texts(df)}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fp.items()}
    near = [(a, b) for a, b in itertools.combinations(sorted(i for i in fp if i is not None), 2) if (fp[a] ^ fp[b]).bit_count() <= 4]
    assert {i: r.component_id for i, r in got.items() if i is not None} == groups([i for i in fp if i is not None], near)


def test_simhash_matches_all_pairs(docs):
    check_components(docs)


def test_simhash_hard_cases(hard, empty):
    check_components(hard.where("doc_id is not null"))
    got = simhash.components(hard).where("doc_id is null").collect()
    assert len(got) == 2 and {r.component_id for r in got} == {0, None}
    assert simhash.components(empty).count() == 0


def test_trees_lose_no_near_pair(spark):
    """A deep forest with tiny leaves, hot ones dealt over tasks, finds every pair at every distance up to the radius."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.concatenate([base, *[base ^ np.array([sum(1 << int(b) for b in rng.choice(63, d, replace=False)) for _ in base], np.uint64) for d in (1, 2, 3, 4, 5)]])
    fps = np.unique(near).tolist()
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = [(r.a, r.b) for r in simhash.near_links(df, shard_rows=4, tile_rows=8).collect()]
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    want = groups(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if (np.uint64(a & (2**64 - 1)) ^ np.uint64(b & (2**64 - 1))).item().bit_count() <= 4])
    assert groups(signed, links) == want


def test_branches_inside_a_shard_lose_no_pair():
    """Dense and scattered fingerprints, some only asking: those that live there are linked with all they are near to."""
    rng = np.random.default_rng(6)
    flips = lambda n: np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(n)], np.uint64)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 63, 300, dtype=np.uint64), np.uint64(12345) ^ flips(250), np.repeat(rng.integers(0, 1 << 63, 40, dtype=np.uint64), 5) ^ flips(200)]))
    fps = rng.permutation(fps)
    everything = [(np.uint64((1 << 64) - 1), 4)]
    for home in (np.ones(len(fps), bool), rng.random(len(fps)) < 0.7):
        a, b = simhash._leaf_links(fps, home, 4, everything, leaf=8)
        pairs = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (home[i] or home[j]) and (fps[i] ^ fps[j]).item().bit_count() <= 4]
        want = groups(fps.tolist(), [(fps[i].item(), fps[j].item()) for i, j in pairs])
        assert groups(fps.tolist(), zip(a.tolist(), b.tolist())) == want


def test_nodes_have_vantage_points_of_their_own():
    forest = simhash.Forest(np.random.default_rng(1).integers(0, 1 << 63, 4096, dtype=np.uint64), 64)
    for _, (point, _, inner, outer) in forest.trees:
        inner_nodes = np.flatnonzero(inner >= 0)
        assert len(inner_nodes) > 30 and len(set(point[inner_nodes].tolist())) > len(inner_nodes) * 0.9
        assert sorted([*inner[inner_nodes], *outer[inner_nodes]]) == list(range(1, len(inner)))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7000, 7001), (7001, 7000), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parts = collections.defaultdict(set)
    for n, r in got.items():
        parts[r].add(n)
    assert sorted(map(frozenset, parts.values()), key=min) == [frozenset(range(301)), frozenset(range(1000, 1300)), frozenset({7000, 7001})]


# 3. Language


def test_forward_sums_all_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    v = langid.pieces(path)
    p = np.random.default_rng(2).random((v.size, 2)) + 0.1
    p /= p.sum(axis=0)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = {model.id_to_piece(i): i for i in range(v.size) if not model.is_byte(i) and i > 2}

    def total(rest):
        if not rest:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, len(rest) + 1):
            if rest[:n] in names and (rest[:n].removeprefix("▁") + "a").isalpha():
                out += p[names[rest[:n]]] * total(rest[n:])
        if rest[0] not in names:
            out += p[v.byte[list(rest[0].encode())]].prod(axis=0) * total(rest[1:])
        return out

    words = ["the", "a", "strasse", "naïve", "ꙮa", "日", "zzq"]
    got = langid.log_probabilities(v, words, p)
    assert np.allclose(got, [np.log(total("▁" + w)) for w in words])
    long = "thequick" * 20
    assert np.allclose(langid.log_probabilities(v, [long], p), [langid._long(v, long, p)]) and np.allclose(langid._long(v, "strasse", p), got[2])


def slow_sums(v, names, word, p):
    """(log probability of a marked word, expected pieces) in one language, over all segmentations from the right."""
    word = "▁" + word
    best = {len(word): (decimal.Decimal(1), collections.Counter())}
    for a in range(len(word) - 1, -1, -1):
        z, counts = decimal.Decimal(0), collections.Counter()
        steps = [(a + n, [names[word[a : a + n]]]) for n in range(1, len(word) - a + 1) if word[a : a + n] in names]
        if word[a] not in names:
            steps.append((a + 1, [int(v.byte[b]) for b in word[a].encode()]))
        for to, used in steps:
            w = math.prod(decimal.Decimal(float(p[i])) for i in used)
            z += w * best[to][0]
            for i, n in best[to][1].items():
                counts[i] += w * n
            for i in used:
                counts[i] += w * best[to][0]
        best[a] = (z, counts)
    return float(best[0][0].ln()), {i: float(n / best[0][0]) for i, n in best[0][1].items()}


@pytest.fixture(scope="module")
def letter_pieces():
    v = langid.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = lambda i: not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    return v, {x: i for i in range(v.size) if plain(i) and ((x := model.id_to_piece(i)).removeprefix("▁") + "a").isalpha()}


def test_expected_counts_match_all_segmentations(letter_pieces):
    v, names = letter_pieces
    p = np.random.default_rng(3).dirichlet(np.full(v.size, 0.5), 2).T + 1e-9
    words = ["the", "a", "strasse", "naïve", "ꙮa", "日本", "x", "thequickbrownfox" * 4, "ꙮꙭꙬ" * 9, "日本語" * 20]
    times = np.arange(2.0 * len(words)).reshape(-1, 2)
    want = np.zeros_like(p)
    for w, t in zip(words, times):
        for k in range(2):
            for i, n in slow_sums(v, names, w, p[:, k])[1].items():
                want[i, k] += n * t[k]
    assert np.allclose(langid.expected_counts(v, words, times, p), want, rtol=1e-6, atol=1e-9)


def test_training_and_prediction_match_slow_ones(spark, letter_pieces):
    """EM and posteriors over all documents of two made-up languages, one of them without spaces."""
    v, names = letter_pieces
    rows = [(1, "the cat and the other cat", "xx"), (2, "an apple, a pear!", "xx"), (3, "東京は日本の首都であり世界最大の都市のひとつである" * 3, "yy"), (4, "猫がいる。猫", "yy"), (5, "the 猫", None), (6, "", "xx"), (7, None, "yy"), (8, "日本の猫", None), (9, "1 + 1", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    langs, got = langid.train(df, path, rounds=2)
    assert langs == ["xx", "yy"]
    p = np.full((v.size, 2), 1.0 / v.size)
    for _ in range(2):
        counts = np.full_like(p, langid.PSEUDO)
        for _, text, lang in rows:
            for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if lang else []:
                k = langs.index(lang)
                for i, n in slow_sums(v, names, w, p[:, k])[1].items():
                    counts[i, k] += n
        p = counts / counts.sum(axis=0)
    assert np.allclose(got, p, rtol=1e-6)
    found = {r.doc_id: r for r in langid.predict(df, (langs, got), path).collect()}
    for i, text, _ in rows:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        x = np.array([sum(slow_sums(v, names, w, p[:, k])[0] for w in words) for k in range(2)])
        assert found[i].lang_pred == (langs[int(np.argmax(x))] if words else "und")
        assert math.isclose(found[i].score, 1 / np.exp(x - x.max()).sum() if words else 0.0, rel_tol=1e-6)


def test_forgotten_words_are_scored_alike(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    p = np.random.default_rng(3).dirichlet(np.full(langid.pieces(path).size, 0.5), 2).T + 1e-9
    words = ["".join(x) for x in itertools.product("abcdeé", repeat=3)]
    some = [" ".join(words[i : i + 20] + words[:3]) for i in range(0, 200, 10)]
    want = langid.Scorer(path, p).texts(some)
    monkeypatch.setattr(langid, "CACHE", 25)
    few = langid.Scorer(path, p)
    assert all(np.allclose(a, b) for t, a in zip(some, want) for b in few.texts([t]))


def test_two_generations_of_memory():
    r = common.Recent(3)
    for keys in ("abc", "ad", "bde", "fgh", "a", "b"):
        lacking = r.missing(set(keys))
        assert not set(lacking) & set(r)
        r.update((k, k.upper()) for k in lacking)
        assert all(r[k] == k.upper() for k in keys) and len(r) <= 6 and len(r.old) <= 6


def test_language_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d, public_tokenizers.path("piece_bpe_32k.model"), training=40).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out]) > 0.97


def test_language_hard_cases(hard, empty, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {(r.doc_id, r.lang_pred): r.score for r in langid.identify(hard, path).collect()}
    for i in (0, 1, 2, 3, 14):
        assert got[i, "und"] == 0.0
    assert all(0 <= s <= 1 for s in got.values()) and got[4, "en"] == 1.0
    assert langid.identify(empty, path).count() == 0
    assert {r.lang_pred for r in langid.identify(hard.withColumn("lang", F.lit(None).cast("string")), path).collect()} == {"und"}
    model = langid.train(docs, path, 20)
    assert langid.keep_known(hard, model, path).count() == hard.count() - 8


# 4 and 6. Tokens


@pytest.fixture(scope="module")
def word_library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_round_trip(docs, hard, empty, word_library):
    path = public_tokenizers.path("word_bpe_49k.json")
    for df in (docs, hard):
        got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, path).collect())
        want = []
        for i, t in texts(df):
            ids = word_library.encode(t or "", add_special_tokens=False).ids
            back = word_library.decode(ids, skip_special_tokens=False)
            want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert got == sorted(want)
    assert bpe.round_trip(empty, path).count() == 0
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path), path).limit(3).collect()}


def test_speculation_equals_merging():
    w = bpe.word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    words = ["".join(c) for n in range(1, 4) for c in itertools.product("thea", repeat=n)] + ["unbelievableness" * 40, "ththththandingou"]
    exact = []
    for word in words:
        parts = list(word)
        parts[-1] += w.end
        exact.append([w.ids[x] for x in w.merge(parts)])
    assert w.encode_words(words) == exact
    long = list("thandinger" * 60)
    assert w._merge_long(list(long)) == [x for x in _slow_merge(long, w.rank)]


def _slow_merge(parts, rank):
    parts = list(parts)
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_token_files(docs, hard, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for df in (docs, hard):
        rows = sorted(((i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in texts(df)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        at, want = 0, []
        for i, ids in rows:
            want.append((str(i), at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        got = [(str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.write_and_read(df, path, 0).collect()]
        by = lambda x: (x[0], x[2], x[3])
        assert sorted(map(by, got)) == sorted(map(by, want)) and sorted(g[1] for g in got) == sorted(w[1] for w in want)
        once = [w for w in want if w[0] != "None"]
        assert {g for g in got if g[0] not in ("None", "3")} == {w for w in once if w[0] != "3"}
    assert tokenfile.write_and_read(empty, path, 0).count() == 0


def test_token_files_are_read_from_their_folder_alone(spark, tmp_path):
    """The bytes on disk, unpacked here by hand, say everything: ranks, codes, ids, nulls and starts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(-(1 << 63), "lowest id"), (None, "no id"), (5, None), (5, "a second five"), (9, "word " * 400)] + [(7, "copies")] * 50
    tokenfile.write_files(spark.createDataFrame(rows, "doc_id long, text string"), path, f"file://{tmp_path}")
    id_of = np.frombuffer((tmp_path / "ranks.u32").read_bytes(), "<u4")
    assert sorted(id_of.tolist()) == list(range(library.get_vocab_size()))
    starts = {r.file: r.before for r in spark.read.parquet(f"{tmp_path}/starts").collect()}
    found, at = [], 0
    for f in sorted((tmp_path / "tokens").glob("*.tfv")):
        assert starts[f.name] == at
        raw, k = f.read_bytes(), 0
        while k < len(raw):
            magic, docs, n, c, d = tokenfile.HEAD.unpack_from(raw, k)
            k += tokenfile.HEAD.size
            nulls = [raw[k + i // 8] >> (7 - i % 8) & 1 for i in range(docs)]
            k += -(-docs // 8)
            ids, counts = np.frombuffer(raw, "<i8", docs, k), np.frombuffer(raw, "<u4", docs, k + 8 * docs)
            k += 12 * docs
            lengths = [(raw[k + i // 4] >> (2 * (i % 4)) & 3) + 1 for i in range(n)]
            k += c
            tokens = []
            for length in lengths:
                tokens.append(int(id_of[int.from_bytes(raw[k : k + length], "little")]))
                k += length
            for i, null, m in zip(ids.tolist(), nulls, counts.tolist()):
                found.append((None if null else i, tokens[:m]))
                tokens, at = tokens[m:], at + m
    want = [(i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(found, key=key) == sorted(want, key=key)
    assert [i for i, _ in found] == [None, -(1 << 63), 5, 5, *[7] * 50, 9]
    got = [(r.doc_id, r.start) for r in tokenfile.read_files(spark, f"file://{tmp_path}").collect()]
    assert len(got) == len(rows) and dict(got)[9] == sum(len(t) for i, t in want if i != 9) and dict(got)[None] == 0


def test_token_files_give_the_library_few_texts():
    """Pieces are cut as the library cuts them; each distinct one reaches it once, many as one text."""

    class Counting:
        def __init__(self, library):
            self.library, self.texts = library, []

        def encode_batch_fast(self, batch, **how):
            self.texts += batch
            return self.library.encode_batch_fast(batch, **how)

    bpe = tokenfile.ByteBPE(public_tokenizers.path("byte_bpe_50k.json"))
    library = bpe.tokenizer
    bpe.tokenizer = Counting(library)
    words = ["".join(c) for c in itertools.product("thean", repeat=5)]
    spaced = [" ".join(w + m for w in words) for m in ("", ",", ".", "!", "***")]
    atoms = [" ", "  ", "\n", "\n\n", " \n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "a", "don", "'", "'s", "'ll", ".", ",", "_", "42", "\u0663", "é", "×", "º", "«", "…", "\u0301", "中", "。", "😀", "<|endoftext|>", "<|", "\x00"]
    mixed = ["".join(c) for c in itertools.product(atoms, repeat=3)]
    for texts, most in ((spaced, len(words) // 50), (mixed, None), ([None, "", "a  ", "b", " ", "\n", "\nc"], None), (["the<|endoftext|> thing" * 50, "a" * 999, "\u4e2d" * 99], None)):
        bpe.tokenizer.texts.clear()
        got = bpe.encode_column(pa.array(["-", *texts], pa.string()).slice(1), b"\0\0").to_pylist()
        want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert got == [np.array([*e.ids, 0], "<u2").tobytes() for e in want]
        assert most is None or len(bpe.tokenizer.texts) <= most
    assert max(map(len, bpe.cache)) <= tokenfile.KEPT


def test_codes_round_trip():
    ranks = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    for n in range(len(ranks) + 1):
        assert tokenfile.decode_codes(*tokenfile.encode_codes(ranks[:n]), n).tolist() == ranks[:n].tolist()


# 5. Shards


@pytest.mark.parametrize("which", ["docs", "hard"])
def test_shards(request, which):
    df = request.getfixturevalue(which)
    got = hilbert.assign(df, 8).collect()
    assert len(got) == df.count() and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    counts = collections.Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1 and set(counts) <= set(range(8))
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    have = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts(df))
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == have
    curve = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in curve] == sorted(r.curve for r in got)


def test_no_shards_of_nothing(empty):
    assert hilbert.assign(empty, 8).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 1)])
def test_curve_visits_neighbours(spark, dims, bits):
    cells = [r.cell for r in hilbert.curve_table(spark, dims, bits).orderBy("curve").collect()]
    assert sorted(cells) == list(range(1 << dims * bits))
    at = [[c >> bits * k & (1 << bits) - 1 for k in range(dims)] for c in cells]
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(at, at[1:]))


def test_written_shards(docs, spark, tmp_path):
    hilbert.write_shards(docs, str(tmp_path / "s"), 8)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 8


def test_quantisation_keeps_order_and_cuts_at_counted_quantiles(spark):
    values = [None] * 3 + [f"s{i:02d}" for i in range(40) for _ in range(1 + 60 * (i == 20))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, source string").select(F.coalesce("source", F.lit("")).alias("v"))
    least = hilbert.bounds(df, "v", len(values))
    order = sorted(v or "" for v in values)
    want, seen = {}, 0
    for v, n in sorted(collections.Counter(order).items()):
        want[v] = seen * 16 // len(values)
        seen += n
    assert least == sorted({(c, min(v for v in want if want[v] == c)) for c in want.values() if c})
    got = {r.v: r.q for r in df.distinct().select("v", hilbert.quantise(F.col("v"), least).alias("q")).collect()}
    assert got == want
    assert hilbert.bounds(df.limit(0), "v", 0) == []


def test_statistics_of_written_shards_prune_on_every_dimension(spark, tmp_path):
    """A predicate on one dimension, by what Parquet's own footers say, leaves out shards; a scattered layout leaves out none."""
    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(rng.integers(1, 60_000) if i % 9 else 40), f"l{rng.integers(6)}", f"src{rng.integers(400):03d}", 0) for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int").withColumn("n_bytes", F.octet_length("text"))
    name = hilbert.write_shards(docs, str(tmp_path / "s"), 8)
    assert name == "shard_"
    spans = collections.defaultdict(list)
    for f in (tmp_path / "s").glob("shard_=*/*.parquet"):
        table = pq.ParquetFile(f).metadata
        for g in range(table.num_row_groups):
            for c in range(table.num_columns):
                one = table.row_group(g).column(c)
                if one.path_in_schema in ("lang", "source", "n_bytes"):
                    spans[one.path_in_schema].append((f.parent.name, one.statistics.min, one.statistics.max))
    for column, wanted in {"lang": [f"l{i}" for i in range(6)], "source": [f"src{i:03d}" for i in range(0, 400, 25)], "n_bytes": range(1_000, 60_000, 5_000)}.items():
        read = [len({s for s, low, high in spans[column] if low <= v <= high}) for v in wanted]
        assert np.mean(read) < 6.5, (column, read)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(back.columns) == sorted([*docs.columns, "shard_"])
    counts = [r["count"] for r in back.groupBy("shard_").count().collect()]
    assert sum(counts) == 1_500 and len(counts) == 8 and max(counts) - min(counts) <= 1
    assert back.join(hilbert.assign(docs, 8).withColumnRenamed("shard", "want"), "doc_id").where("want <> shard_").count() == 0


# 7. Decontamination


def slow_containment(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = {}
    have = {i: words(t) for i, t in docs if i is not None}
    for j, t in items:
        w = words(t)
        if not w or j is None:
            continue
        k = min(5, len(w))
        want = {tuple(w[n : n + k]) for n in range(len(w) - k + 1)}
        for i, d in have.items():
            shared = want & {tuple(d[n : n + k]) for n in range(len(d) - k + 1)}
            if len(shared) >= 0.8 * len(want) - 1e-9:
                found[i, j] = max(found.get((i, j), 0), round(len(shared) / len(want), 6))
    return found


def test_containment_matches_all_pairs(spark, docs, hard, empty, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {(r.doc_id, r.item_id): r.containment for r in decontam.contaminated(docs, bench).collect()}
    assert got == slow_containment(texts(docs), items) and got
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)  # a benchmark beyond what is broadcast
    assert {(r.doc_id, r.item_id): r.containment for r in decontam.contaminated(docs, bench).collect()} == got
    small = spark.createDataFrame([(1, "three four five six"), (2, None), (3, ""), (None, "a b"), (4, "a"), (4, "two three"), (5, "ipsum dolor sit amet 12 lorem ipsum dolor sit missing")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontam.contaminated(hard, small).collect()}
    assert got == slow_containment(texts(hard), [(r.item_id, r.text) for r in small.collect()])
    assert decontam.contaminated(empty, small).count() == 0 and decontam.contaminated(hard, small.limit(0)).count() == 0


# 8. Embeddings


def slow_links(rows, threshold=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    return [(a, b) for (a, x), (b, y) in itertools.combinations(ok, 2) if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold]


def check_links(df, **options):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    links = slow_links(rows)
    n = collections.Counter(itertools.chain.from_iterable(links))
    root = groups([i for i, _ in rows], links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicates(df, **options).collect()}
    assert got == {i: (n[i], root[i], root[i] == i) for i, _ in rows}


def test_embedding_links_match_all_pairs(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").limit(400)
    check_links(e.select("vec_id", "embedding", F.lit(1).alias("m"), F.lit(2).alias("block")), block=64)


def test_embedding_hard_cases(spark):
    v = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.95, 0.3122]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [float("nan"), 1.0]), (9, [None, 1.0]), (10, [float("inf"), 1.0]), (11, [1.0]), (12, [1e-30, 0.0]), (13, [3e38, 3e37])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    check_links(df, block=2)
    assert embdedup.near_duplicates(df.limit(0)).count() == 0
    twice = embdedup.near_duplicates(spark.createDataFrame([(1, [1.0]), (1, [1.0]), (None, [1.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in twice) == [("1", 2, 1, True), ("1", 2, 1, True), ("None", 2, 1, False)]


def test_quantisation_bounds_hold():
    x = np.random.default_rng(3).normal(size=(60, 33))
    codes, rest, facts = embdedup.quantise(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = facts[:, :1]
    for approx, norm, error in ((codes * scale, facts[:, 1], facts[:, 2]), (codes * scale + rest * (scale / 254), facts[:, 3], facts[:, 4])):
        bound = np.outer(norm, error) + np.outer(error, norm) + np.outer(error, error)
        assert np.all(np.abs(unit @ unit.T - approx @ approx.T) <= bound + 1e-12)
    assert facts[:, 4].max() < facts[:, 2].min() / 50


def test_pairs_at_the_threshold_are_settled_by_the_vectors(spark):
    """Cosines a hair above and below: the codes leave them in doubt, double precision tells them apart."""
    rows, rng = [], np.random.default_rng(8)
    for k, off in enumerate([1e-3, 1e-5, 1e-6, 1e-9, -1e-9, -1e-6, -1e-5, -1e-3]):
        u = rng.normal(size=40)
        u /= np.linalg.norm(u)
        w = rng.normal(size=40)
        w -= (w @ u) * u
        c = 0.95 + off
        rows += [(2 * k, u.tolist()), (2 * k + 1, (7 * (c * u + math.sqrt(1 - c * c) * w / np.linalg.norm(w))).tolist())]
    check_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=4)
    pairs = [(i, j, s) for i, j, s in embdedup.tile_pairs(*[embdedup.quantise(np.array([v for _, v in rows]))] * 2, same=True)]
    doubt = [(a, b) for i, j, s in pairs for a, b, sure in zip(i.tolist(), j.tolist(), s.tolist()) if not sure]
    assert (6, 7) in doubt and (8, 9) in doubt and (0, 1) not in doubt


def test_classes_with_many_copies(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "HOT", 2)
    check_links(spark.createDataFrame([(i, [1.0, 0.1]) for i in range(9)] + [(20, [1.0, 0.2]), (21, [0.0, 1.0])], "vec_id long, embedding array<float>"))


# 9. WARC


PAGES = "page_id long, url string, html string, file string, seq int"


def pages(spark):
    rows = [(i, f"https://a.b/{i} ü", "<p>" + "x" * (i * 37 % 500) + "\r\n\r\n</p>", "f", 1) for i in range(300)]
    return spark.createDataFrame([*rows, (None, None, None, None, None), (5, rows[5][1], rows[5][2], None, None)], PAGES).repartition(3)


def test_audit_finds_just_the_damaged_records(spark, tmp_path):
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    index = warc.write(pages(spark), one, file_bytes=4_000)
    damage = F.coalesce(F.col("page_id") % 50 == 7, F.lit(True))
    warc.replicate(one, two, index, damage)
    want = {(r.file, r.seq) for r in index.where(damage).collect()}
    assert {(r.file, r.seq) for r in warc.audit(one, two, index).collect()} == want and len(want) == 7
    assert warc.audit(one, one, index).count() == 0


def test_audit_of_cut_and_missing_files(spark, tmp_path):
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    index = warc.write(pages(spark), one, file_bytes=4_000)
    warc.replicate(one, two, index, F.lit(False))
    files = sorted((tmp_path / "two").glob("*.warc.gz"))
    files[0].unlink()
    whole = files[1].read_bytes()
    files[1].write_bytes(whole[:-3])
    last = index.where(F.col("file") == files[1].name).agg(F.max("seq")).first()[0]
    want = {(r.file, r.seq) for r in index.where(F.col("file") == files[0].name).collect()} | {(files[1].name, last)}
    assert {(r.file, r.seq) for r in warc.audit(one, two, index).collect()} == want


def test_records_read_back(spark):
    got = warc.fixity(pages(spark), F.col("page_id") == 9)
    want = collections.Counter((r.page_id, hashlib.sha256((r.html or "").encode()).hexdigest(), "damaged" if r.page_id == 9 else "intact") for r in pages(spark).collect())
    assert collections.Counter(map(tuple, got.collect())) == want
    assert warc.fixity(pages(spark).limit(0), F.lit(True)).count() == 0


def test_long_and_repeated_pages(spark, tmp_path):
    """Records have ids of their own even if pages repeat, and a very long page is one record."""
    rows = [(1, "https://a.example/", "<p>x</p>")] * 3 + [(2, None, "long " * 400_000), (None, "", None)]
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}", file_bytes=2_000)
    assert index.count() == 5
    ids, targets = [], []
    for f in tmp_path.glob("*.warc.gz"):
        text = gzip.decompress(f.read_bytes()).decode()
        ids += re.findall("WARC-Record-ID: (<urn:uuid:[0-9a-f-]{36}>)", text)
        targets += re.findall("WARC-Target-URI: (.*)\r", text)
    assert len(set(ids)) == 5 and sorted(targets) == ["https://a.example/"] * 3 + ["urn:page:", "urn:page:2"]
    got = warc.payload_digests(f"file://{tmp_path}", index).collect()
    assert {r.payload_sha256 for r in got if r.page_id == 2} == {hashlib.sha256(b"long " * 400_000).hexdigest()}


def test_files_are_read_by_a_task_each(spark, tmp_path):
    index = warc.write(pages(spark), f"file://{tmp_path}", file_bytes=4_000)
    files = index.select("file").distinct().count()
    assert warc.leaves(f"file://{tmp_path}", index).rdd.getNumPartitions() == files > 3
    numbers = warc.number_files(index.select("file").distinct()).orderBy("file").collect()
    assert [r.number for r in numbers] == list(range(files))


# 10. Secrets


def slow_base(text):
    out = []
    rules = [
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    for kind, (rx, fine) in enumerate(rules):
        out += [(m.start(), kind, m.end()) for m in rx.finditer(text or "") if fine(m)]
    return sorted(out)


TRICKY = [
    "secret=token:abcdefgh", "password:ab token = 'abcdef' Token=ABCDEF", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "xAKIAAKIA" + "B" * 16, "f" * 23, "f" * 24, "deadbeef" * 5 + "G", "API_KEY=" + "a" * 24, "apikey='x' secret : \"12345\"", "ſecret=abcdefg toKen=abcdefg",
    "日本 token=abcdef0123456789abcdef01", "bearer ghp_" + "Ab1" * 12 + " and order-2024-0001",
]


def test_base_spans(spark, docs, hard, empty):
    df = docs.select("doc_id", "text").union(hard.select("doc_id", "text")).union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string"))
    got = collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan(df).collect())
    want = collections.Counter()
    for i, t in texts(df):
        b = slow_base(t)
        want[(i, *[sum(k == n for _, k, _ in b) for n in range(3)], hashlib.sha256(secrets.render(b).encode()).hexdigest())] += 1
    assert got == want
    assert secrets.scan(empty).count() == 0


def test_base_spans_stay_and_added_ones_touch_none():
    model = secrets.train()
    for text in [*TRICKY, *[t for t in HARD if t]]:
        base, every = secrets.spans([text], model)[0]
        assert base == slow_base(text) and [s for s in every if s[1] < 3] == base
        assert all(a >= e or b <= s for a, k, b in every if k == 3 for s, _, e in base)


def test_tagger_on_unseen_examples():
    model = secrets.train()
    hit = extra = lost = 0
    for text, truth in secrets.examples(500, seed=77):
        got = set(secrets.crf_spans([text], model)[0])
        hit, extra, lost = hit + len(got & set(truth)), extra + len(got - set(truth)), lost + len(set(truth) - got)
    assert hit / (hit + extra) > 0.95 and hit / (hit + lost) > 0.95


def test_viterbi_beats_every_other_tagging():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5):
        emit, move = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
        score = lambda tags: move[0, tags[0]] + sum(emit[i, t] for i, t in enumerate(tags)) + sum(move[a, b] for a, b in zip(tags, tags[1:])) + move[tags[-1], 0]  # noqa: E731, B023
        assert tuple(secrets.viterbi(emit, move)) == max(itertools.product(range(3), repeat=n), key=score)


def test_redaction(hard, empty):
    got = secrets.redact(hard)
    assert got.columns == hard.columns and got.count() == hard.count() and secrets.redact(empty).count() == 0
    row = got.where("doc_id = 20").first()
    assert "abcdef123" not in row.text and "[SECRET]" in row.text and row.n_chars == len(row.text)
    assert got.where("doc_id = 0").first().text is None
