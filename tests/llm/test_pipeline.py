"""The pipeline's stages against brute force, each on its own input, and on odd rows."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from test_operators import plain_dedup, plain_overlaps, prose

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(3)
    text = prose(rnd, 60)
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (3, prose(rnd, 50), "en", "s", 1), (None, text, "en", "s", 1), (4, text, None, None, None), (5, prose(rnd, 60_000), "fr", "t", 9), (6, prose(rnd, 3), "en", "s", 5)]
    return spark.createDataFrame(rows, DOCS)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_one_of_each(rows):
    rows = sorted(rows)
    top = {i: i for i, _ in rows}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    sets = {i: shingles(t) for i, t in rows}
    for (a, _), (b, _) in combinations(rows, 2):
        both = sets[a] | sets[b]
        if not both or len(sets[a] & sets[b]) >= 0.8 * len(both) - 1e-9:
            p, q = sorted((root(a), root(b)))
            top[q] = p
    return {i for i, _ in rows if root(i) == i}


def test_near_duplicates_equal_all_pairs(spark, given):
    rows = [(r.doc_id, r.text) for r in given.collect()]
    rnd = random.Random(5)
    for i, (_, t) in enumerate(rows[:60]):
        w = (t or "").split()
        for _ in range(1 + i % 4):
            if w:
                w[rnd.randrange(len(w))] = "changed"
        rows.append((10_000 + i, " ".join(w)))
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    assert {r.doc_id for r in pipeline.near_duplicates(spark, frame, SF).collect()} == plain_one_of_each(rows)


def test_substrings_equal_brute_force(spark, given):
    rows = [(r.doc_id, r.text) for r in given.collect() if r.text is not None]
    want = {(i, t) for i, texts in plain_dedup(rows, 100).items() for t in texts}
    source = dict(rows)
    want = {(i, t) for i, t in want if t == source[i] or t.strip(" ")}
    got = {(r.doc_id, r.text) for r in pipeline.substrings(spark, given, SF).collect() if r.text is not None}
    assert got == want


def test_decontamination_equals_brute_force(spark, given):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:12]
    rows = [(r.doc_id, r.text) for r in given.collect() if len(r.text or "") < 6000][:60]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {d for d, _ in plain_overlaps(rows, items)}
    assert {r.doc_id for r in pipeline.decontaminate.clean(frame, bench).collect()} == {i for i, _ in rows} - bad


def test_encoding_equals_the_library(spark, given):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pipeline.pieces.MODEL)
    for r in pipeline.encoded(spark, given, SF).collect():
        assert r.ids == library.encode(r.text or "") and r.n_pieces == len(r.ids)


def test_stages_on_odd_rows(spark, odd):
    kept = {}
    for name, stage in pipeline.STAGES:
        rows = stage(spark, odd, SF).collect()
        kept[name] = sorted((r.doc_id or 0, (r.text or "")[:40]) for r in rows)
        assert stage(spark, odd.limit(0), SF).count() == 0
    every = sorted((r.doc_id or 0, (r.text or "")[:40]) for r in odd.collect())
    assert kept["encoding"] == kept["decontamination"] == every
    # the null and the empty text are alike, and document 4 is a copy of document 3
    assert [i for i, _ in kept["near_duplicates"]] == [0, 1, 3, 3, 3, 5, 6]
    assert all(t for _, t in kept["quality"])
    assert 4 not in [i for i, _ in kept["substrings"]] and 1 in [i for i, _ in kept["substrings"]]


def test_stages_filter_in_turn(spark, given):
    ids = {r.doc_id for r in given.select("doc_id").collect()}
    rows = pipeline.run(spark, SF).collect()
    assert rows and {r.doc_id for r in rows} < ids
    assert all(r.exact and len(r.ids) == r.n_pieces for r in rows)
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "decontamination", "encoding"]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in pipeline.quality(spark, given, SF).collect()}
    good = [i for i, r in labels.items() if r.quality == 1 and not r.toxic]
    assert sum(i in kept for i in good) >= 0.9 * len(good)
