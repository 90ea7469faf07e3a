"""The operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import chats, chunks, decontaminate, licenses, pages, perplexity, pieces, repeats, simhash, vectors
from quillon.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ["on", "er", "tha", "ing", "st", "re", "ha", "ti", "no", "le", "qua", "vi"]


def prose(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    base = [prose(rnd, rnd.randint(20, 200)) for _ in range(40)]
    passage = prose(rnd, 80)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[0], "en", "s0", 0) for i in range(5)]
    rows += [(200 + i, f"{prose(rnd, 30)} {passage} {prose(rnd, 20)}", "fr", "s1", 0) for i in range(6)]
    rows += [(300, None, "en", None, None), (301, "", None, None, 0), (302, "a" * 3000, "en", "s", 3000), (303, "word", "en", "s", 4), (303, "word", "en", "s", 4), (304, "été " * 400, "fr", "s", 1600)]
    frame = spark.createDataFrame(rows, DOCS).withColumn("__doc", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("key", F.lit(2))
    return frame.cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def bits(text):
    return simhash.fingerprint((text or "").encode())


def test_fingerprint_by_hand():
    import xxhash

    text = "One two\tthree FOUR five"
    w = ["one", "two", "three", "four", "five"]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b" \n ") == 0
    assert simhash.fingerprint(b"A b") == xxhash.xxh64_intdigest("a b", 42)


@pytest.mark.parametrize("crowd", [48, 2])
def test_simhash_components(docs, crowd):
    rows = [(r.doc_id, bits(r.text)) for r in docs.collect()]
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(rows, 2):
        if (x ^ y).bit_count() <= 2:
            p, q = sorted((top(a), top(b)))
            parent[q] = p
    got = {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs, crowd=crowd).collect()}
    assert got == {(i, f, top(i)) for i, f in rows}


@pytest.mark.parametrize("crowd", [48, 3])
def test_simhash_links_cover_all_near_pairs(spark, crowd):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for b in base[:6]:
        for _ in range(12):
            fps.add(b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(frame, crowd=crowd)).collect()}
    for a, b in combinations(signed, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
            assert roots[a] == roots[b]


@pytest.mark.parametrize("blocks", [16, 32, 64])
def test_pivot_distances_by_hand(spark, blocks):
    rnd = random.Random(51)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    width = 64 // blocks
    rows = simhash.pivot_table(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long"), 4, blocks).collect()
    for r in rows:
        apart = (r.fp & (1 << 64) - 1) ^ simhash.BASE
        assert [r[f"b{j}"] for j in range(blocks)] == [(apart >> width * j & (1 << width) - 1).bit_count() for j in range(blocks)]
        assert [r[f"p{i}"] for i in range(4)] == [((r.fp & (1 << 64) - 1) ^ p).bit_count() for p in simhash._spread(4)]


def test_fingerprint_of_a_long_text():
    import xxhash

    rnd = random.Random(52)
    w = prose(rnd, simhash.STRIDE + 900).split()
    counts = np.zeros(64, np.int64)
    for i in range(len(w) - 2):
        h = xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42)
        counts += [h >> b & 1 for b in range(64)]
    assert simhash.fingerprint(" ".join(w).encode()) == sum(1 << b for b in range(64) if 2 * counts[b] > len(w) - 2)


def test_similar_finds_near_copies_and_leaves_others(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(30):
        w = prose(rnd, 300).split()
        rows.append((i, " ".join(w)))
        w[rnd.randrange(300)] = "changed"
        rows.append((100 + i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i and got[100 + i] == i for i in range(30))


def test_similar_decides_by_shingle_sets(spark):
    """Pairs at 0.71 to 0.76 stay apart and pairs at 0.82 are linked, whatever their fingerprints say."""
    rnd = random.Random(10)
    rows = []
    for i in range(90):
        w = prose(rnd, 300).split()
        rows.append((i, " ".join(w)))
        for k in range((6, 8, 10)[i % 3]):
            w[10 + 28 * k] = f"changed{k}"
        rows.append((100 + i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in rows}
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(90):
        alike = len(sets[i] & sets[100 + i]) / len(sets[i] | sets[100 + i])
        assert 0.7 < alike < 0.83 and got[i] == i
        assert got[100 + i] == (i if alike >= 0.8 else 100 + i), alike


def crowd_of_sets(rnd, n, change):
    """Shingle sets of copies of one text, each with some shingles of its own."""
    base = rnd.integers(0, 1 << 62, 160).astype(np.uint64)
    sets = []
    for _ in range(n):
        x = base.copy()
        at = rnd.choice(160, rnd.integers(2, change), replace=False)
        x[at] = rnd.integers(0, 1 << 62, len(at)).astype(np.uint64)
        sets.append(np.unique(x))
    return sets


def test_crowded_lists_keep_every_link(spark, monkeypatch):
    """Blocks of a crowded list name all pairs that are alike, among them rows near two heads and rows near one another under different ones."""
    sets = crowd_of_sets(np.random.default_rng(3), 90, 40)
    alike = {(i, j) for i in range(90) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert 100 < len(alike) < 3000
    names = [f"f{k}" for k in range(4)]
    rows = [(i, i, *map(int, simhash.wide_fingerprint(x).view(np.int64))) for i, x in enumerate(sets)]
    monkeypatch.setattr(simhash, "LIST", 16)
    monkeypatch.setattr(simhash, "_keyed", lambda classes, bits, parts: classes.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("key"), "*"))
    classes = spark.createDataFrame(rows, "sig long, root long, " + ", ".join(f"{n} long" for n in names))
    sketches = spark.createDataFrame([(i, bytearray(simhash.sketch(x))) for i, x in enumerate(sets)], "sig long, more binary")
    got = [(r.a, r.b) for r in simhash._candidates(classes, sketches, 12, 1, 0.8, False).collect()]
    assert len(got) == len(set(got)) and alike <= set(got) and len(got) < 0.8 * 90 * 89 / 2


@pytest.mark.parametrize("n", [1, 5, 60, 160, 2000, 20_000])
def test_sketches_lose_no_pair(n):
    """Sets of every size that are 0.8 alike pass by their sketches."""
    rnd = np.random.default_rng(n)
    for _ in range(60):
        union = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
        own = rnd.permutation(len(union))[: len(union) // 5]
        a, b = np.delete(union, own[::2]), np.delete(union, own[1::2])
        two = [np.frombuffer(simhash.sketch(x), np.uint8)[None, :] for x in (a, b)]
        assert simhash.maybe_alike(*two, 0.8)[0]


def brute_repeats(texts, span):
    places = defaultdict(list)
    for k, d in enumerate(texts):
        for i in range(len(d) - span + 1):
            places[d[i : i + span]].append((k, i))
    covered = [bytearray(len(d)) for d in texts]
    for found in places.values():
        if len(found) > 1:
            for k, i in found:
                covered[k][i : i + span] = b"\x01" * span
    out = []
    for d, c in zip(texts, covered, strict=True):
        rest = bytes(x for x, y in zip(d, c, strict=True) if not y)
        out.append((len(d), sum(c), sum(1 for i, x in enumerate(c) if x and (i == 0 or not c[i - 1])), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_repeats_equal_brute_force(docs, crowd):
    rows = docs.collect()
    want = sorted((r.doc_id, *b) for r, b in zip(rows, brute_repeats([(r.text or "").encode() for r in rows], 200), strict=True))
    got = sorted(tuple(r) for r in repeats.cut(docs, crowd=crowd).collect())
    assert got == want


def test_repeats_of_many_copies_and_long_texts(spark):
    rnd = random.Random(41)
    passage, copy = prose(rnd, 60), prose(rnd, 70)
    rows = [(i, copy) for i in range(2000)] + [(5000, f"{prose(rnd, 30)}#{copy[20:300]}#{prose(rnd, 30)}")]
    long = bytes(rnd.randrange(97, 123) for _ in range(3 << 20)).decode()
    rows += [(6000, long + passage), (6001, f"{prose(rnd, 20)} {passage}"), (6002, None), (6003, "")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(copy.encode())
    assert all(got[i] == (n, n, 1) for i in range(2000))
    assert got[5000][1:] == (280, 1)
    assert got[6000] == (len(long) + len(passage), len(passage), 1) and got[6001][1] - len(passage) in (0, 1) and got[6002] == got[6003] == (0, 0, 0)


def test_phrases_of_text_in_steps(monkeypatch):
    """However a long text is cut into steps, every start is in one phrase and equal strings have their cut at the same distance."""
    rnd = random.Random(42)
    data = prose(rnd, 900).encode()
    whole = {i: cut for cut, low, high in repeats.phrases(data) for i in range(low, high + 1)}
    monkeypatch.setattr(repeats, "STEP", 512)
    assert {i: cut for cut, low, high in repeats.phrases(data) for i in range(low, high + 1)} == whole


def test_phrases_cover_every_start_once():
    rnd = random.Random(3)
    for data in (prose(rnd, 900).encode(), b"a" * 700, b"ab" * 400, bytes(rnd.randrange(256) for _ in range(5000))):
        starts = [i for _, low, high in repeats.phrases(data) for i in range(low, high + 1)]
        assert starts == list(range(len(data) - 199))
        assert all(0 <= cut - high and cut - low <= 95 for cut, low, high in repeats.phrases(data))


def test_chunks_resist_insertions_and_keep_characters():
    rnd = random.Random(2)
    text = prose(rnd, 2000)
    parts = lambda t: {t.encode()[a:b] for a, b in zip([0, *chunks.cuts(t.encode())], chunks.cuts(t.encode()), strict=False)}
    a, b = parts(text), parts("inserted words " + text)
    assert len(a - b) <= 6  # cuts fall into step again within a few chunks
    odd = "é日本語" * 500
    assert "".join(odd.encode()[a:b].decode() for a, b in zip([0, *chunks.cuts(odd.encode())], chunks.cuts(odd.encode()), strict=False)) == odd


def test_chunk_dedup_keeps_first_places(docs):
    rows = {(r.doc_id, r.source): r for r in chunks.dedup(docs).collect() if r.doc_id != 303}
    by_id = {k[0]: r for k, r in rows.items()}
    assert by_id[0].dedup.n_removed == 0
    assert all(by_id[100 + i].text == "" for i in range(5))
    assert by_id[200].dedup.n_removed == 0
    assert all(by_id[200 + i].dedup.n_removed > 150 for i in range(1, 6))
    assert by_id[300].text is None and by_id[301].text == ""
    assert all(by_id[i].dedup.n_removed == 0 for i in range(40))
    assert {"__doc", "fp", "key", "lang"} <= set(by_id[0].asDict())


def plain_chunks(data):
    """Chunks by rolling the hash byte by byte."""
    found, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = (2 * h + int(chunks.GEAR[b])) % 2**32
        if i + 1 < len(data) and i + 1 - start >= 16 and h >> 28 == 0 and data[i + 1] & 0xC0 != 0x80:
            found.append(data[start : i + 1])
            start = i + 1
    return [*found, data[start:]] if start < len(data) else found


def plain_dedup(rows, min_run):
    """{doc_id: texts cut} of (doc_id, text) rows: chunks that stand in an earlier document or before in the same text, in runs."""
    firsts = {}
    for i, t in rows:
        for c in plain_chunks(t.encode()):
            firsts[c] = min(firsts.get(c, i), i)
    out = defaultdict(set)
    for i, t in rows:
        kept, run, seen = [], [], set()

        def settle(kept=kept, run=run):
            if sum(map(len, run)) < min_run:
                kept += run
            run.clear()

        for c in plain_chunks(t.encode()):
            if firsts[c] < i or c in seen:
                run.append(c)
            else:
                settle()
                kept.append(c)
            seen.add(c)
        settle()
        out[i].add(b"".join(kept).decode())
    return out


@pytest.mark.parametrize("min_run", [chunks.MIN_RUN, 0])
def test_chunk_dedup_equals_brute_force(spark, docs, min_run):
    rnd = random.Random(12)
    long = prose(rnd, 30_000)
    more = spark.createDataFrame([(303, "word of another text that shares the number " * 9), (400, long), (401, "x" + long[:50_000] + prose(rnd, 300))], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more).unionByName(more.where("doc_id = 401"))
    rows = [(r.doc_id, r.text or "") for r in both.collect()]
    want = plain_dedup(rows, min_run)
    got = defaultdict(set)
    for r in chunks.dedup(both, min_run).collect():
        got[r.doc_id].add(r.text or "")
        assert r.dedup.n_bytes - r.dedup.n_removed == len((r.text or "").encode())
    assert got == want


def test_rows_without_number_are_cut_alone(spark):
    rows = [(None, "a passage of its own that is long enough to be cut " * 8), (1, "a passage of its own that is long enough to be cut " * 8)]
    got = chunks.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.dedup.n_removed for r in got}) == 1 and all(r.text for r in got)


def plain_overlaps(texts, items, least=5):
    """{(doc, item): (equal, first, aligned)} by laying every item over every place."""
    best = {}
    for i, t in items:
        w = decontaminate.WORD.findall(t.lower())
        need = min(20, len(w))
        if len(w) < max(1, least):
            continue
        for d, text in texts:
            x = decontaminate.WORD.findall((text or "").lower())
            for at in range(len(x) - need + 1):
                for k in range(len(w) - need + 1):
                    equal = sum(a == b for a, b in zip(x[at : at + need], w[k : k + need], strict=True))
                    if equal >= 0.8 * need - 1e-9 and (equal, -at) > best.get((d, i), (0, 0, 0))[:2]:
                        best[d, i] = (equal, -at, need)
    return {k: (e / n, -at, n) for k, (e, at, n) in best.items()}


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(21)
    items = [(i, prose(rnd, n)) for i, n in enumerate((40, 25, 20, 16, 15, 12, 8, 5, 4, 2, 1))] + [(30, "same words same words same words same words same words same words")]
    texts = []
    for i, t in items:
        for j in range(3):
            w = t.upper().split()
            for k in rnd.sample(range(len(w)), len(w) * (j + 1) // 8):
                w[k] = "other"
            texts.append((10 * i + j, f"{prose(rnd, 12)} {' '.join(w)} {prose(rnd, 6)}"))
    texts += [(900, None), (901, ""), (902, prose(rnd, 60)), (903, "same " * 60), (904, items[0][1] + " " + items[0][1]), (904, items[0][1] + " " + items[0][1])]
    a, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items + items[:2] + [(50, None)], "item_id long, text string")
    for least in (5, 1):
        got = decontaminate.overlaps(a.withColumn("h", F.lit(1)), b.withColumn("sk", F.lit(1)), least).collect()
        assert {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.aligned) for r in got} == plain_overlaps(texts, items, least)
        assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_repeated_words_meet_once_a_hash(spark):
    """Rows follow segments, items and hashes, not places of one times places of the other; results are those of brute force."""
    rnd = random.Random(23)
    items = [(i, "is one " * 25 + prose(rnd, 2)) for i in range(4)]
    texts = [(i, f"{prose(rnd, 9)} {'is one ' * 120} {prose(rnd, 9)}") for i in range(3)]
    a, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    met = []
    whole, decontaminate.meetings = decontaminate.meetings, lambda *x: met.append(whole(*x)) or met[-1]
    try:
        got = decontaminate.overlaps(a, b).collect()
    finally:
        decontaminate.meetings = whole
    assert {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.aligned) for r in got} == plain_overlaps(texts, items)
    rows = met[0].selectExpr("size(ds) n").collect()
    assert 0 < len(rows) <= len(items) * len(texts) * 3 * 12 and max(r.n for r in rows) <= 300


def test_clean_tells_texts_of_one_number_apart(spark):
    rnd = random.Random(22)
    item, filler = prose(rnd, 30), prose(rnd, 120_000)
    rows = [(1, f"{filler} {item} {filler}"), (1, prose(rnd, 40)), (None, item), (2, item), (3, None)]
    left = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit("x")), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted([(1, rows[1][1]), (0, item), (3, "")])


def test_decontamination(spark, docs, empty):
    rnd = random.Random(8)
    items = [(i, prose(rnd, n)) for i, n in enumerate((40, 25, 16, 8, 3))] + [(9, None), (1, "x")]
    rows = []
    for i, t in items[:4]:
        w = t.upper().split()
        rows.append((i * 10, f"{prose(rnd, 50)} {' '.join(w)} {prose(rnd, 9)}"))
        for k in range(0, len(w), 6):
            w[k] = "other"
        rows.append((i * 10 + 1, f"{prose(rnd, 20)} {' '.join(w)}"))
        rows.append((i * 10 + 2, f"{prose(rnd, 20)} {' '.join(t.split()[: max(2, len(w) // 6)])} {prose(rnd, 20)}"))
    rows += [(900, None), (901, ""), (902, prose(rnd, 400))]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(texts, bench).collect()}
    assert {(0, 0), (1, 0), (10, 1), (11, 1), (20, 2), (30, 3)} <= found
    assert not {d for d, _ in found} & {2, 12, 22, 902}
    assert decontaminate.overlaps(empty, bench).count() == 0
    assert decontaminate.overlaps(texts, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench).count() == docs.count()


def test_seeds_are_lossless():
    """Wherever 4 of 20 aligned words differ, some seed fits between them."""
    masks = [(sum(1 << i for i in s), s[-1] + 1) for s in decontaminate.SEEDS]
    for gone in combinations(range(20), 4):
        bad = sum(1 << i for i in gone)
        assert any(not bad >> k & m for m, span in masks for k in range(20 - span + 1))


@pytest.mark.parametrize("n", range(1, decontaminate.WINDOW + 1))
def test_items_of_every_length_are_hit(n):
    """Whatever words of an item the rule allows to differ, one of its seeds stands between them."""
    for gone in combinations(range(n), n - int(np.ceil(0.8 * n - 1e-9))):
        left = set(range(n)) - set(gone)
        assert any({k + x for x in decontaminate.ALL[s]} <= left for s in decontaminate.seeds_for(n) for k in range(n - decontaminate.ALL[s][-1])), gone


@pytest.mark.parametrize("seed", range(3))
def test_pieces_equal_the_library(seed):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    machine = pieces.compiled(pieces.model_bytes())
    rnd = random.Random(seed)
    vocabulary = list(machine.ids)
    alphabet = "abcdeéèñß  ▁\n\t日本語مرحب😀.,!?0123the ing\x00"
    for _ in range(1500):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        t = "".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 8))).replace("▁", " ")
        for x in (s, t):
            assert machine.encode(x).tolist() == library.encode(x)
            if "▁" not in x:
                assert machine.decode(machine.encode(x)) == x


def test_pieces_in_spark(docs):
    out = pieces.encode(docs.withColumn("pieces", F.lit(0)))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[300].pieces.ids == [] and rows[300].pieces.exact and rows[301].pieces.ids == []
    assert all(r.pieces.exact for r in rows.values())
    back = pieces.decode(out.select("doc_id", "text", F.col("pieces.ids").alias("ids")), to="again")
    assert back.where("coalesce(text, '') <> again").count() == 0


def test_unigram_shortest_path():
    machine = pieces.compiled(pieces.model_bytes())
    model = object.__new__(pieces.Transducer)
    model.__dict__ |= {"trie": {}, "scores": [-1.0, -2.0, -2.5, -9.0], "bytes_id": {}, "unk": 3, "unk_cost": 20.0, "bpe": False}
    for p, i in (("a", 0), ("b", 1), ("ab", 2)):
        node = model.trie
        for c in p:
            node = node.setdefault(c, {})
        node[""] = i
    assert model.score_path("abab") == [2, 2] and model.score_path("azb") == [0, 3, 1]
    assert machine.bpe


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><p>Site head with some words</p></header><nav><ul><li><a href=/a>Menu</a></ul></nav>
<div class="ad-box banner">Buy this now, really</div><div class="post-12 main"><h1>Head &amp; line</h1><p>First   para<br>graph of text that is long enough to count.<p>Second &lt;one&gt; with a <a href="x">link</a>, longer still than the first was.
<aside>Aside text</aside><form><input>Your mail</form></div><div class="comments"><p>A reader says a lot of words here about this and that.</p></div><footer>&copy; me</footer>"""


def test_pages(spark):
    rows = [(1, "http://h.example/a", PAGE), (2, "http://h.example/b", PAGE.replace("post-12", "post-77")), (3, None, None), (4, "odd", ""), (5, "http://h.example/c", "<p>Only this</p>"), (6, "http://h.example/d", "no tags & text"), (1, "http://h.example/a", PAGE)]
    got = sorted((r.page_id, r.text) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1))).collect())
    text = "Head & line\nFirst para graph of text that is long enough to count.\nSecond <one> with a link, longer still than the first was."
    assert got == [(1, text), (1, text), (2, text), (3, ""), (4, ""), (5, "Only this"), (6, "no tags & text")]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_consensus_overrules_a_page(spark):
    rest = "".join(f"<p>{'long words of the article here ' * 3}</p>" for _ in range(3))
    odd = "<body><article><p>Short note.</p></article><section><p>" + "links and lists of other things " * 20 + "</p></section>"
    rows = [(i, "http://x.example/p", f"<body><article>{rest}</article><section><p>more</p></section>") for i in range(5)] + [(9, "http://x.example/q", odd)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "Short note."


def test_whole_article_around_the_winning_path(spark):
    """Sections, heads, leads and bylines beside the container with most of the text belong to the article."""
    long, short = "".join(f"<p>{'many words of the larger part ' * 4}{k}</p>" for k in range(9)), "<p>A short part of its own.</p>"
    two = f"<body><nav>Menu</nav><article><section class=a>{long}</section><section class=b>{short}</section></article><footer>f</footer></body>"
    lead = f"<body><article><h1>Head</h1><p class=byline>By A. Writer</p><p>The lead.</p><div class=content>{long}</div></article></body>"
    plain = f"<body><div class=post><h1>Head</h1><p>The lead.</p><div class=content>{long}</div></div><div class=more><p><a href=x>Read all of this too</a></p></div></body>"
    rows = [(i, f"http://{i % 3}.example/p", (two, lead, plain)[i % 3]) for i in range(9)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(9):
        assert len(got[i].split("\n")) == (10, 12, 11)[i % 3] and "Menu" not in got[i] and "Read all" not in got[i]


def test_pages_of_odd_markup(spark):
    made = {
        1: ("<p title=it's>First…</p><p>Second one, it's here.</p><p>third</p>", "First…\nSecond one, it's here.\nthird"),
        2: ("<body><div class=a><p>One two three four.</p></div><div class=b><p>Five six seven eight.</p></div><div class=ad>Buy.</div></body>", "One two three four.\nFive six seven eight."),
        3: ("<article><h2 class='header'>Head</h2><p>A formula <math><mi>x</mi></math> in text.</p><div class='related'>No.</div></article>", "Head\nA formula x in text."),
        4: ("<div>" * 8000 + "<p>Deep text.</p>" + "</div>" * 8000, "Deep text."),
        5: ("<div>" * 20000 + "<p>Left open.", "Left open."),
        6: ("<article>" + "<p>" + "word &amp; word " * 100_000 + "</p></article>", ("word & word " * 100_000).strip()),
        7: ("<article><p>Tie one.</p></article><article><p>Tie two.</p></article>", "Tie one.\nTie two."),
    }
    rows = [(k, f"http://h{k}.example/", h) for k, (h, _) in made.items()]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: t for k, (_, t) in made.items()}


def test_pages_equal_the_text_they_were_made_of(spark):
    """Random pages of three templates: the extracted text is the article that was put in."""
    rnd = random.Random(31)
    tag = lambda t, x: f"<{t}>{x}</{t}>"
    around = [
        ("<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><article>", "<aside>Side</aside></article><div class='comments'><p>A reader's comment, of many words and more.</p></div><footer>Foot</footer>"),
        ("<div id=menu><a href=/>Home</a></div><div class='page'><div class='content-{n}'>", "<div class=ad>Advert of several words.</div></div></div><div class=sidebar><p>Read this too.</p></div><form><label>Mail</label></form>"),
        ("<table><tr><td class=nav><a href=/>Home</a><td class=main>", "<script>var x='<p>no</p>'</script></table><div class=cookie-banner>We use cookies.</div>"),
    ]
    rows, want = [], {}
    for i in range(60):
        parts = [prose(rnd, rnd.randint(5, 60)) for _ in range(rnd.randint(2, 9))]
        inner = tag("h1", parts[0]) + "".join(rnd.choice([lambda x: tag("p", x), lambda x: tag("blockquote", tag("p", x)), lambda x: f"<p>{x.replace(' ', '  &#32;', 1)}", lambda x: tag("ul", tag("li", x))])(x) for x in parts[1:])
        before, after = around[i % 3]
        rows.append((i, f"http://t{i % 3}.example/{i}", f"<html><body>{before.format(n=i)}{inner}{after}</body></html>"))
        want[i] = "\n".join(parts)
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_licenses_by_a_table(spark):
    texts = spark.createDataFrame([("own", "this very own license lets you do as you please with all of it"), ("own", "this very own license lets you do as you please with all of it"), (None, "x y z"), ("short", "two words")], "label string, text string")
    filler = "word " * 100_000
    rows = [(1, filler + "This very own license lets you do, as you please, with all of it. " + filler), (1, "nothing of it"), (2, None), (3, "this very own license lets you do as you please")]
    got = sorted((r.doc_id, r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), texts).collect())
    assert got == [(1, "", 0.0), (1, "own", 1.0), (2, "", 0.0), (3, "own", 0.692308)] or got[3][1] == "own" and got[:3] == [(1, "", 0.0), (1, "own", 1.0), (2, "", 0.0)]
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), texts.limit(0)).where("labels <> ''").count() == 0


def test_licenses(spark):
    rows = [
        (1, "x CC-BY y. All Rights Reserved! general PUBLIC license"), (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files"),
        (3, None), (4, ""), (5, "all rights"), (6, "Licensed under the Apache License, Version 2.0."), (6, "Licensed under the Apache License, Version 2.0."), (7, "É all rights réserved"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("t", F.lit(2))
    got = {r.doc_id: r for r in licenses.scan(frame).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (10, 3, 1, 7, "cc-by,gpl,reserved")
    assert got[2].labels == "mit" and got[2].n_base == 0 and got[2].first_word is None and got[2].score > 0.6
    assert (got[3].n_words, got[3].labels, got[3].score) == (0, "", 0.0) and got[4].n_words == 0
    assert got[5].labels == "" and got[6].labels == "apache" and got[6].score == 1.0 and got[7].labels == ""
    assert licenses.scan(frame).count() == 8 and licenses.scan(frame.limit(0)).count() == 0
    assert got[5].n_words == 2


def test_license_words(spark):
    """The same words as by the plain pattern, for every character and in less time."""
    plain = lambda c: F.regexp_extract_all(F.translate(F.coalesce(c, F.lit("")), licenses.UPPER, licenses.LOWER), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    rows = [(f"aA{chr(c)}Zz{chr(c)}{chr(c)}",) for c in [*range(0xD800), *range(0xE000, 0x11000), 0x1F600, 0x10FFFF]] + [(None,), ("",), (" ",), ("ÀÉİ ABC-Def9 K",), ("\nAll  RIGHTS\x00reserved\x7f",)]
    odd = spark.createDataFrame(rows, "text string")
    assert odd.where(~licenses.words(F.col("text")).eqNullSafe(plain(F.col("text")))).count() == 0
    long = spark.range(0, 2000, 1, 4).select(F.repeat(F.concat(F.lit("The Licensed software, provided 'as is': "), F.col("id")), 100).alias("text")).localCheckpoint()

    def least(way):
        took = []
        for _ in range(4):
            began = time.perf_counter()
            long.agg(F.sum(F.size(way(F.col("text"))))).first()
            took.append(time.perf_counter() - began)
        return min(took)

    assert least(licenses.words) < 0.6 * least(plain)


CALL = json.dumps({"content": "let me", "tool_calls": [{"name": "add", "id": "c1", "arguments": {"b": 2, "a": 1}}, {"id": "c2", "name": "add", "arguments": {"a": "$c1", "b": 3}}]})


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", CALL), (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": "3"})), (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})), (1, 4, "assistant", "{not json"), (2, 0, None, None),
        (3, 0, "assistant", json.dumps({"tool_calls": [{"id": "x", "name": "add", "arguments": {"a": "$y"}}, {"id": "y", "name": "add", "arguments": {"a": "$x"}}]})),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(7)).withColumn("id", F.lit("q"))
    schemas = spark.createDataFrame([("add", "a", "number", True), ("add", "b", "number", True)], chats.SCHEMA)
    got = {(r.conv_id, r.turn): r for r in chats.formatted(frame, schemas).collect()}
    call = got[1, 1]
    assert (call.n_calls, call.n_linked, call.level, call.n_errors, call.status) == (2, 1, 1, 1, "invalid")
    assert call.line == '{"content":"let me","role":"assistant","tool_calls":[{"arguments":{"a":1,"b":2},"id":"c1","name":"add"},{"arguments":{"a":"$c1","b":3},"id":"c2","name":"add"}]}'
    assert got[1, 2].status == "ok" and got[1, 2].line == '{"content":"3","role":"tool","tool_call_id":"c1"}'
    assert got[1, 3].status == "orphan" and got[1, 4].line == '{"content":"{not json","role":"assistant"}'
    assert got[2, 0].status == "ok" and got[3, 0].status == "unordered"
    plain = {(r.conv_id, r.turn): r.status for r in chats.formatted(frame).collect()}
    assert plain[1, 1] == "unanswered"
    assert chats.formatted(frame.limit(0)).count() == 0


def test_chats_keep_what_they_are_given(spark):
    """Further fields, null content, rows of one turn, second answers, plain dollar signs, keys, nulls and repeated rows."""
    call = lambda i, a, **more: {"id": i, "name": "add", "arguments": a, **more}
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": [call("a", {"x": "$5", "$a": 1, "y": [{"z": "$b"}]}, extra=1), call("b", {"x": 'say "$a", so'})], "more": {"b": None, "a": 1.50}})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": None})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "again"})), (1, 0, "tool", json.dumps({"tool_call_id": "b", "content": "too soon"})),
        (1, 3, "assistant", json.dumps({"tool_calls": [call("c", {})]})), (1, 3, "assistant", json.dumps({"tool_calls": [call(None, None)]})), (1, 3, "assistant", json.dumps({"tool_calls": [call("c", {})]})),
        (1, 4, "user", None), (1, 5, None, "é" * 50_000), (None, 0, "assistant", json.dumps({"tool_calls": [call("a", {})]})), (1, 6, "assistant", json.dumps({"tool_calls": [call("s", {"x": "$s"})]})),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = defaultdict(list)
    for r in chats.formatted(frame.withColumn("row", F.lit(1)).withColumn("k", F.lit(2))).collect():
        got[r.conv_id, r.turn, r.role].append(r)
    first = got[1, 0, "assistant"][0]
    assert (first.n_calls, first.n_linked, first.level, first.status) == (2, 1, 1, "unanswered")
    assert first.line == '{"content":null,"more":{"a":1.5,"b":null},"role":"assistant","tool_calls":[{"arguments":{"$a":1,"x":"$5","y":[{"z":"$b"}]},"extra":1,"id":"a","name":"add"},{"arguments":{"x":"say \\"$a\\", so"},"id":"b","name":"add"}]}'
    assert [got[1, k, "tool"][0].status for k in (0, 1, 2)] == ["orphan", "ok", "ok"] and got[1, 1, "tool"][0].line == '{"content":null,"role":"tool","tool_call_id":"a"}'
    assert sorted((r.n_calls, r.status) for r in got[1, 3, "assistant"]) == [(1, "unanswered")] * 3
    assert got[1, 4, "user"][0].line == '{"content":null,"role":"user"}' and got[1, 5, None][0].line.startswith('{"content":"éé')
    assert got[1, 6, "assistant"][0].status == "unordered" and got[None, 0, "assistant"][0].n_calls == 0


def test_calls_are_ordered_to_the_end_of_a_chain(spark):
    made = [{"id": f"c{k}", "name": "add", "arguments": {"a": f"$c{k - 1}" if k else 1}} for k in range(53)]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": made}))]
    levels = chats.ordered(chats.calls(chats.messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert {r.node: r.level for r in levels.collect()} == {f"c{k}": k for k in range(53)}


def test_kneser_ney_sums_to_one(spark):
    rnd = random.Random(0)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame([(i, prose(rnd, 40), "en") for i in range(30)], "doc_id long, text string, lang string")
    table = perplexity.model(perplexity.trusted(texts, labels), 3)
    scorer = perplexity.Scorer(table.toArrow(), 3, 0, 1)
    for context in ("on", "e ", "zz"):
        a, b = perplexity.ids(context).tolist()
        total = sum(np.exp(-scorer.nll(np.array([a << 24 | b << 12 | c], np.int64))) for c in range(1 << perplexity.BITS))
        assert abs(total - 1) < 1e-3
    whole = {r.doc_id: r.nll for r in perplexity.scores(texts, table, 3).collect()}
    cut = {r.doc_id: r.nll for r in perplexity.scores(texts, table, 3, shard_rows=40).collect()}
    assert all(abs(whole[k] - cut[k]) < 1e-6 * max(1, whole[k]) for k in whole)


def plain_kneser_ney(texts, order):
    """log-probability of a symbol after a context, by the textbook, from dictionaries."""
    from collections import Counter

    grams = Counter()
    for t in texts:
        x = [0] * (order - 1) + perplexity.ids(t).tolist()
        grams.update(tuple(x[i : i + order]) for i in range(len(x) - order + 1))
    counts = {order: grams}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    tables = {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 1.0]
        d = [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True)]
        totals, left = Counter(), Counter()
        for g, v in c.items():
            totals[g[:-1]] += v
            left[g[:-1]] += d[min(v, 3) - 1]
        tables[n] = (c, d, totals, left)

    def p(g):
        if not g:
            return 1 / 4096
        c, d, totals, left = tables[len(g)]
        if g[:-1] not in totals:
            return p(g[1:])
        v, t = c.get(g, 0), totals[g[:-1]]
        return (v - d[min(v, 3) - 1] if v else 0) / t + left[g[:-1]] / t * p(g[1:])

    return p


def test_scores_equal_brute_force(spark):
    rnd = random.Random(61)
    texts = [prose(rnd, 30) + "日本語の文" * (i % 3) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(50, "日本 한국 ไทย 😀 odd", "ja"), (51, None, None), (52, "", "en"), (53, prose(rnd, 40), "en"), (53, prose(rnd, 40), "en"), (54, "long text " * 40_000, "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = {r.doc_id for r in perplexity.trusted_ids(labels).where("fold <> 0").collect()}
    p = plain_kneser_ney([texts[i] for i in sorted(ids)], 4)
    got = [(r.doc_id, r.n, r.nll) for r in perplexity.scores(frame, perplexity.model(perplexity.trusted(frame, labels).where("fold <> 0"), 4), 4).collect()]
    want = []
    for i, t, _ in rows[:-1]:
        x = [0] * 3 + perplexity.ids(t or "").tolist()
        want.append((i, len(x) - 3, -sum(np.log(p(tuple(x[k : k + 4]))) for k in range(len(x) - 3))))
    assert len(got) == len(rows)
    for a, b in zip(sorted(x for x in got if x[0] != 54), sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4 * max(1, b[2])
    assert dict((i, n) for i, n, _ in got)[54] == 400_000


def test_symbols_tell_all_characters_apart(monkeypatch):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, codes))
    seen = perplexity.ids(text)
    assert seen.max() < 4096 and len({tuple(perplexity.ids(chr(c)).tolist()) for c in codes[::7]}) == len(codes[::7])
    grams = np.concatenate([g for _, g in perplexity.grams([text[:9000]], 3)])
    monkeypatch.setattr(perplexity, "SLICE", 100)
    assert (np.concatenate([g for _, g in perplexity.grams([text[:9000]], 3)]) == grams).all()


def test_quality_separates_held_out_text(spark):
    rnd = random.Random(5)
    good = [(i, prose(rnd, 120), "en") for i in range(150)]
    bad = [(1000 + i, " ".join("".join(rnd.choice("$%#&@!xqz") for _ in range(6)) for _ in range(80)), "en") for i in range(30)]
    odd = [(2000, None, "en"), (2001, "", None), (2002, prose(rnd, 60), None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(1000, 0, 0)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(good + bad + odd, "doc_id long, text string, lang string").withColumn("n", F.lit(1)).withColumn("th", F.lit(1))
    got = {r.doc_id: r.kept for r in perplexity.judged(frame, labels).collect()}
    assert sum(got[i] for i in range(100, 150)) >= 45 and not any(got[1000 + i] for i in range(30))
    assert not got[2000] and not got[2001] and 2002 in got
    for rows in (perplexity.SHARD_ROWS, 3000):  # one shard, and several by the join
        assert sorted(r.doc_id for r in perplexity.kept(frame, labels, shard_rows=rows).collect()) == sorted(i for i, k in got.items() if k)
    assert perplexity.judged(frame, labels.limit(0)).where("kept").count() == len(got) - 2


def test_embeddings_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(60, 16))
    v = np.vstack([base, base[:20] + 0.02 * rnd.normal(size=(20, 16)), base[:5], np.repeat(base[7:8], 4, axis=0)])
    rows = [(i, [float(x) for x in e], 1 if i % 60 < 50 else 2) for i, e in enumerate(v)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[0][1], None), (504, [1.0, None] * 8, 1), (505, [1.0, 2.0], 1), (506, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(1)).withColumn("key", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.links(frame, block=7).collect()}
    u = vectors.unit(v)
    near = (u @ u.T >= 0.98) & (np.array([r[2] for r in rows[: len(v)]])[:, None] == np.array([r[2] for r in rows[: len(v)]])[None])
    np.fill_diagonal(near, False)
    found = sum(got[i][0] for i in range(len(v)))
    assert all(got[i][0] <= near[i].sum() for i in range(len(v))) and found >= 0.9 * near.sum()
    assert all(got[i] == (0, i) for i in range(500, 507))
    assert got[60 + 3][1] == 3 and got[len(v) - 1][1] == 7
    assert vectors.links(frame.limit(0)).count() == 0


def test_empty_tables(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.similar(empty).count() == 0
    assert repeats.cut(empty).count() == 0
    assert chunks.dedup(empty).count() == 0
    assert pieces.encode(empty).count() == 0
    labels = empty.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert perplexity.judged(empty, labels).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == got[90] == 90
