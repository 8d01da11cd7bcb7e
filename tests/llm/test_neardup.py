import itertools
import random

import numpy as np
import pyarrow as pa

from loomwork.llm import neardup, simhash
from tests.llm.data import documents, rows


def jaccard(a, b):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def components(values):
    """Component number of each row by brute force over all pairs."""
    up = list(range(len(values)))
    for i, j in itertools.combinations(range(len(values)), 2):
        if up[i] != up[j] and jaccard(values[i][1], values[j][1]) >= 0.8:
            old, new = max(up[i], up[j]), min(up[i], up[j])
            up = [new if x == old else x for x in up]
    return up


def edited(seed=3):
    """Groups of texts, 20 to 600 words, with one to four altered words: far more than three bits of SimHash apart."""
    rng = random.Random(seed)
    out = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([20, 60, 250, 600]))]
        for edits in (0, 1, 2, 4):
            copy = list(base)
            for at in rng.sample(range(len(base)), edits):
                copy[at] = "other"
            out.append((len(out), " ".join(copy), "en", "s", 1))
    return out


def test_one_of_each_joins_what_jaccard_joins(spark):
    for values in (edited(), rows()):
        values = [(v[0] if v[0] is not None else 10_000, *v[1:]) for v in values]
        up = components(values)
        least = {}
        for v, c in zip(values, up, strict=True):
            least[c] = min(least.get(c, v[0]), v[0])
        got = simhash.one_of_each(documents(spark, values)).collect()
        assert sorted(r.doc_id for r in got) == sorted(least.values())


def test_large_groups_are_joined_in_linear_pairs(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    near = [[*passage, *(f"q{i}" for i in range(60))] for _ in range(300)]
    for i, w in enumerate(near):
        w[rng.randrange(5)] = f"x{i}"
    far = [[*passage, *(f"r{rng.randrange(10**6)}" for _ in range(60))] for _ in range(300)]
    values = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate(near + far)]
    assert sorted(r.doc_id for r in neardup.one_of_each(documents(spark, values)).collect()) == [0, *range(300, 600)]
    sets = neardup.described(documents(spark, values)).select("rid", "n", "fp", "fq", "keys").cache()
    assert neardup.candidates(sets, sets).where("b is not null").count() < 600 * 16


def test_all_pairs_across_components_of_a_large_key_follow(spark, monkeypatch):
    """With one nearest partner each, chains of a large group fall apart; the second pass joins them."""
    monkeypatch.setattr(neardup, "ALL_PAIRS", 2)
    monkeypatch.setattr(neardup, "NEAREST", 1)
    values = edited(11)
    up = components(values)
    got = neardup.one_of_each(documents(spark, values)).collect()
    assert sorted(r.doc_id for r in got) == sorted({v[0] for v, c in zip(values, up, strict=True) if values[c][0] == v[0]})


def test_common_shingles_come_last_and_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COMMON", 40)
    shared = " ".join(f"s{i}" for i in range(30))
    values = [(v[0], f"{shared} {v[1]}", *v[2:]) for v in edited(5)]
    values += [(1000 + i, f"{shared} {' '.join(f'z{i}q{j}' for j in range(40))}", "en", "s", 1) for i in range(60)]
    d = documents(spark, values)
    assert len(neardup.common(d)[0]) >= 26
    up = components(values)
    assert sorted(r.doc_id for r in neardup.one_of_each(d).collect()) == sorted({values[c][0] for c in up})


def test_odd_sketches_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(1)
    as_array = lambda own: np.frombuffer(neardup.odd_sketch(own), np.uint64)[None]
    for n in (1, 3, 20, 60, 100, 1000, 9000):
        for edits in (0, 1, n // 20, n // 5):
            base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            other = np.unique(np.append(base[edits:], rng.integers(0, 1 << 63, edits).astype(np.uint64)))
            differ = len(np.setxor1d(base, other))
            got = int(neardup.apart(as_array(base), as_array(other))[0])
            assert got <= differ and (got - differ) % 2 == 0 and (got >= 0.9 * differ or differ > 200)
            assert not neardup.similar(base, other) or 9 * got <= len(base) + len(other)


def test_wide_sketches_of_large_sets():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 9_000).astype(np.uint64))
    for other, like in ((base[:8_000], True), (np.append(base[:6_000], rng.integers(0, 1 << 63, 3_000).astype(np.uint64)), False), (base[:4_200], False)):
        other = np.unique(other)
        got = neardup.wide_apart(neardup.wide_sketch(base), neardup.wide_sketch(other))
        assert 0.8 * len(np.setxor1d(base, other)) < got <= len(np.setxor1d(base, other))
        assert neardup.similar(base, other) == like == (9 * got <= len(base) + len(other))
    assert neardup.wide_sketch(base[:500]) == b""


def test_long_near_copies_are_joined(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(50_000)}" for _ in range(9_000)]
    near, far = list(base), list(base)
    for i in rng.sample(range(9_000), 100):
        near[i] = "x"
    for i in rng.sample(range(9_000), 900):
        far[i] = "y"
    values = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate([base, near, far])]
    assert sorted(r.doc_id for r in neardup.one_of_each(documents(spark, values)).collect()) == [0, 2]


def test_large_sets_of_one_key_are_told_apart_before_they_leave_it():
    """ODD bits say nothing of sets of thousands of shingles; BROAD bits do, and lose no similar pair."""
    rng = np.random.default_rng(4)
    fresh = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    shared, base = fresh(1_500), fresh(6_000)
    own = [np.unique(x) for x in (base, np.append(base[:5_500], fresh(500)), *(np.append(shared, fresh(4_500 + 40 * k)) for k in range(20)), fresh(100))]
    broad = [neardup.broad_sketch(neardup.wide_sketch(x)) for x in own]
    assert [b is None for b in broad] == [False] * 22 + [True]
    columns = {
        "k": np.zeros(23, np.int64), "i": np.zeros(23, np.int32), "n": np.array([len(x) for x in own], np.int32), "rid": np.arange(23), "of": np.arange(23),
    }
    batch = pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in columns.items()} | {"odd": pa.array([neardup.odd_sketch(x) for x in own]), "broad": pa.array(broad, pa.binary())})
    found = [p for b in neardup._across_pairs(iter([batch.slice(0, 9), batch.slice(9)])) for p in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
    assert found == [(0, 1)] and neardup.similar(own[0], own[1])
    odd_alone = sum(9 * neardup.apart(*(np.frombuffer(neardup.odd_sketch(x), np.uint64)[None] for x in (own[a], own[b])))[0] <= len(own[a]) + len(own[b]) for a in range(22) for b in range(a))
    assert odd_alone > 50


def test_empty_table(spark):
    assert neardup.one_of_each(documents(spark, []).coalesce(1)).count() == 0


def test_one_doc_id_or_null_over_several_texts_loses_no_component(spark):
    values = [(v if v else None, f"{w} text of its own with some more words", "en", "s", 1) for v, w in [(0, "one"), (0, "two"), (7, "three"), (7, "four"), (0, "two")]]
    values.append((9, "one TEXT of its own with  some more words", "en", "s", 1))
    got = neardup.one_of_each(documents(spark, values)).collect()
    assert sorted((r.doc_id or 0, r.text.split()[0]) for r in got) == [(0, "two"), (7, "four"), (7, "three"), (9, "one")]


def test_simhash_trees_pair_texts_and_whole_sets_decide(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(600)]
    copies = (" ".join([*base[:at], "other", *base[at + 1 :]]) for at in range(600))
    own = simhash.fingerprint(" ".join(base))
    near = next(x for x in copies if 1 <= ((own ^ simhash.fingerprint(x)) & (1 << 64) - 1).bit_count() <= 3)
    alike = ["zz " * 100 + f"{x}1 {x}2 {x}3 {x}4 {x}5" for x in "pq"]  # of one SimHash, but not similar
    assert simhash.fingerprint(alike[0]) == simhash.fingerprint(alike[1]) and jaccard(*alike) < 0.8
    values = [(i, t, "en", "s", 1) for i, t in enumerate([" ".join(base), near, *alike])]
    monkeypatch.setattr(neardup, "candidates", lambda sets, counted: spark.createDataFrame([], "a long, b long"))
    assert sorted(r.doc_id for r in simhash.one_of_each(documents(spark, values)).collect()) == [0, 2, 3]
