"""Fingerprints and ids that very many rows share."""

import pytest

from tallyspark.llm import simhash


@pytest.mark.parametrize("hot", [0, 3, 1_000])
def test_hot_rows_are_placed_like_all_others(spark, monkeypatch, hot):
    base = [f"w{i} and other words of text {i} that go on for a while w{i * 7}" for i in range(12)]
    rows = [(None, None)] * 6 + [(5, None), (4, "")] + [(100 + i, base[0]) for i in range(9)] + [(7, t) for t in base[1:]] + [(7, base[1])] * 4 + [(200 + i, t) for i, t in enumerate(base)] + [(900, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "HOT", hot)
    got = simhash.components(df).collect()
    assert len(got) == len(rows)
    fps = [int(r.fingerprint, 16) for r in got]
    reached = list(range(len(got)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(got):
            for j, b in enumerate(got):
                near = (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS or (a.doc_id is not None and a.doc_id == b.doc_id)
                if near and reached[j] < reached[i]:
                    reached[i], changed = reached[j], True
    least = {}
    for r, root in zip(got, reached):
        if r.doc_id is not None:
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    assert [r.component_id for r in got] == [least.get(root) for root in reached]
