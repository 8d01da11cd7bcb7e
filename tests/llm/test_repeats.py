import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.llm import debruijn, suffixes
from loomwork.llm import repeats as R
from tests.llm.data import documents, rows, saved

LEAST = -(1 << 63)


def order(doc):
    return LEAST if doc is None else doc


def brute_bytes(values):
    seen = {}
    for doc, text, *_ in values:
        b = (text or "").encode()
        for j in range(len(b) - 49):
            s = b[j : j + 50]
            seen[s] = min(seen.get(s, order(doc)), order(doc))
    out = Counter()
    for doc, text, *_ in values:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if seen[b[j : j + 50]] < order(doc):
                gone[j : j + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        n_spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc, len(b), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def brute_words(values):
    seen = {}
    for doc, text, *_ in values:
        w = (text or "").encode().split()
        for j in range(len(w) - 19):
            s = tuple(w[j : j + 20])
            seen[s] = min(seen.get(s, (order(doc), j)), (order(doc), j))
    out = Counter()
    for doc, text, *_ in values:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            if seen[tuple(w[j : j + 20])] < (order(doc), j):
                gone[j : j + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def random_rows(seed):
    rng = random.Random(seed)
    words = ["ab", "c", "dé", "xyz"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90))), "en", "s", 0) for i in rng.sample(range(1000), 40)]


@pytest.mark.parametrize("values", [rows(), random_rows(5), []], ids=["hard", "random", "empty"])
def test_against_brute_force(spark, tmp_path, values):
    d = saved(spark, tmp_path, documents=documents(spark, values))
    got = suffixes.op6_suffixes(spark, d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_bytes(values)
    got = debruijn.op7_debruijn(spark, d).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_words(values)


def test_deep_shallow_sort_groups_equal_strings():
    rng = random.Random(3)
    text = bytes(rng.choice(b"ab") for _ in range(60)) * 6 + bytes(rng.choice(b"ab") for _ in range(300))
    text = text[:200] + b"#" + text[200:]
    buffer = np.frombuffer(text + bytes(8), np.uint8)
    at = np.arange(len(text) - 49)
    order_, label = suffixes.equal_strings(buffer, at)
    groups = {}
    for i, g in zip(order_.tolist(), label.tolist(), strict=True):
        groups.setdefault(g, set()).add(i)
    want = {}
    for i in at.tolist():
        want.setdefault(text[i : i + 50], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("length", [2, 6, 8, 13])
def test_blind_tries_order_like_sorting(length):
    rng = random.Random(length)
    tails = [bytes(rng.choice(b"abc") for _ in range(length)) for _ in range(300)] + [b"a" * length] * 3
    group = np.sort(np.array([rng.randrange(4) for _ in tails]))
    buffer = np.frombuffer(b"".join(tails) + bytes(8), np.uint8)
    order_, leaf = suffixes.blind_tries(buffer, np.arange(len(tails)) * length, group, length)
    keys = [(int(group[i]), tails[i]) for i in order_.tolist()]
    many = Counter((int(g), t) for g, t in zip(group, tails, strict=True))
    assert keys == sorted(k for k, n in many.items() for _ in range(n) if n > 1)
    assert [a == b for a, b in zip(keys, keys[1:])] == (leaf[1:] == leaf[:-1]).tolist()


def test_equal_strings_come_in_lexical_order():
    rng = random.Random(6)
    text = bytes(rng.choice(b"ab") for _ in range(80)) * 4 + b"#" + bytes(rng.choice(b"ab") for _ in range(80)) * 3
    order_, _ = suffixes.equal_strings(np.frombuffer(text + bytes(8), np.uint8), np.arange(len(text) - 49))
    found = [text[i : i + 50] for i in order_.tolist()]
    assert found and found == sorted(found)


def brute_graph(values):
    """(doc, start) of all windows that start earlier elsewhere, and the nodes of more than one repeated edge in or out."""
    texts = {doc: (text or "").encode().split() for doc, text, *_ in values}
    where = {}
    for doc, w in sorted(texts.items()):
        for j in range(len(w) - 19):
            where.setdefault(tuple(w[j : j + 20]), []).append((doc, j))
    outs, ins = Counter(), Counter()
    for edge, at in where.items():
        if len(at) > 1:
            outs[edge[:-1]] += 1
            ins[edge[1:]] += 1
    return {x for at in where.values() for x in at[1:]}, {n for n in [*outs, *ins] if max(outs[n], ins[n]) > 1}


def branched(seed):
    """Texts that share passages in part, so that paths fork and join inside them."""
    rng = random.Random(seed)
    shared = [[f"p{i}w{j}" for j in range(90)] for i in range(3)]
    out = []
    for i in range(25):
        passage = rng.choice(shared)
        a, z = sorted(rng.sample(range(90), 2))
        own = [f"d{i}w{j}" for j in range(30)]
        out.append((i, " ".join(own[:10] + passage[a:z] + own[10:20] + passage[:rng.choice([0, 0, 40])] + own[20:]), "en", "s", 0))
    fork = [f"f{j}" for j in range(40)]
    for i, words_ in enumerate([shared[0], shared[0], shared[0][:45] + fork, shared[0][:45] + fork, shared[0]]):
        out.append((50 + i, " ".join(words_ + [f"e{i}"]), "en", "s", 0))
    return [(-1, " ".join(shared[0]), "en", "s", 0), *out]


@pytest.mark.parametrize("hot", [0, R.HOT])
def test_paths_end_where_the_graph_branches(spark, hot):
    values = branched(2)
    d = documents(spark, values)
    base = R.texts(d, F.unhex(R.text_key()).alias("key")).select("doc", "key", "t", F.octet_length("text").cast("long").alias("n_bytes"))
    got = debruijn.repeated_spans(d, R.first_copies(base), hot).collect()
    later, branching = brute_graph(values)
    texts = {v[0]: v[1].encode().split() for v in values}
    node = lambda r, j: tuple(texts[r.doc][j : j + 19])
    assert {(r.doc, j) for r in got for j in range(r.start, r.end)} == later
    for r in got:
        assert texts[r.doc][r.start : r.end + 19] == texts[r.source_doc][r.source_start : r.source_start + r.end - r.start + 19]
        assert (r.source_doc, r.source_start) < (r.doc, r.start)
        assert not any(node(r, j) in branching for j in range(r.start + 1, r.end))
    line = lambda r: (r.doc, r.source_doc, r.start - r.source_start)
    met = [(a, b) for a in got for b in got if line(a) == line(b) and a.end == b.start]
    assert met and all(node(b, b.start) in branching for _, b in met)
    assert branching and len(got) < len(later) / 3


def test_words_that_are_not_the_sources_stop_the_job():
    words_ = [f"w{i}".encode() for i in range(60)]
    sums = debruijn.window_sums(debruijn.hashed_words(words_))
    digest = lambda a, z: int((sums[a] ^ sums[z]).view(np.int64))
    spans = [(20, 30, digest(20, 30)), (3, 9, digest(3, 9))]
    assert debruijn.verified(words_, spans).tolist() == [[3, 9], [20, 30]]
    for odd in ((3, 10, digest(3, 9)), (35, 90, 0)):
        with pytest.raises(ValueError, match="not those of their source"):
            debruijn.verified(words_, [*spans, odd])


@pytest.mark.parametrize("times", [1, 2, 3])
def test_places_of_repeated_rows_count_once(spark, times):
    graph = [{"run": 1, "run_low": 2, "nodes": [10, 11, 12], "sums": [3, 6, 10]}, {"run": 4, "run_low": 2, "nodes": [12, 13], "sums": [10, 8]}]
    graph += [{"doc": 7, "k": 0, "start": 2 + at, "source_doc": 5, "source_start": 1 + at, "run": run, "run_low": 2} for at, run in ((0, 1), (2, 4))] * times
    got = debruijn.compacted(spark.createDataFrame(graph, debruijn.GRAPH)).collect()
    spans = {(r.start, r.end): r.digest for r in got}
    assert spans == {(2, 5): (3 ^ 10) ^ (10 ^ 8)} and {(r.doc, r.source_doc, r.source_start) for r in got} == {(7, 5, 1)}


def test_slices_of_several_texts_of_a_document_start_by_window():
    found = R._Slices(1, True, True)
    for k, at in ((0, 5), (1, 5), (2, 3), (3, 3), (4, 9)):
        found.add(0, b"slice", 2, 7, k << R.PLACE | at)
    places = [(k << R.PLACE | at) for k, at in ((0, 5), (1, 5), (4, 9))]
    later = np.array(found.later, np.int64).reshape(-1, 7)
    assert later[:, 1].tolist() == places and (later[:, 4] & R.WINDOWS == 3).all()
    assert found.found[0, b"slice"] == [3, 7, 2 << R.PLACE | 3, 7, 3 << R.PLACE | 3]


def low_phrase():
    """Six words whose hash is lower than any other's here: the minimizer of all windows that hold them."""
    found = [[f"q{k}a{j}".encode() for j in range(6)] for k in range(20_000)]
    h = np.concatenate([R.rolled(debruijn.hashed_words(x), debruijn.INNER) for x in found])
    return [x.decode() for x in found[int(h.argmin())]]


def forms(phrase, n_forms, n_copies, seed):
    """Passages that are equal but for one filler word, around a phrase that returns every eleven words, each in several documents."""
    rng, out = random.Random(seed), []
    for v in range(n_forms):
        passage = []
        for k in range(8):
            passage += [*phrase, *(f"fill{k}_{j}" if (k, j) != (4, 2) else f"other{v}" for j in range(5))]
        for c in range(n_copies):
            own = [f"u{v}_{c}_{j}" for j in range(30)]
            out.append((rng.randrange(10**6), " ".join(own[:15] + passage + own[15:]), "en", "s", 0))
    return out


@pytest.mark.parametrize("key_buckets", [1, 4])
def test_runs_between_equal_ends_are_told_apart(spark, tmp_path, monkeypatch, key_buckets):
    values = forms(low_phrase(), 3, 2, 1)
    monkeypatch.setattr(R, "buckets", lambda first: key_buckets)
    d = saved(spark, tmp_path, documents=documents(spark, values))
    got = debruijn.op7_debruijn(spark, d).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_words(values)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_recurring_phrases_against_brute_force(spark, tmp_path, seed):
    """Few words, phrases that recur within a window, and templates that differ in one place."""
    rng = random.Random(seed)
    phrase = low_phrase()
    values = forms(phrase, 4, 3, seed)
    for i in range(30):
        w = []
        while len(w) < rng.randint(30, 160):
            w += rng.choice([phrase, [rng.choice("abc") for _ in range(rng.randint(1, 6))], [f"f{j}" for j in range(rng.randint(1, 9))]])
        values.append((2_000_000 + i, " ".join(w), "en", "s", 0))
    d = saved(spark, tmp_path, documents=documents(spark, values))
    got = debruijn.op7_debruijn(spark, d).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_words(values)


def test_repeated_rows_and_many_texts_of_a_null_doc_id(spark, tmp_path):
    shared = " ".join(f"word{i}" for i in range(40))
    values = [(None, f"text {i} {shared if i % 3 else ''} end {i}", "en", "s", 1) for i in range(30)]
    values += [(5, f"five {shared}", "en", "s", 1)] * 3 + [(7, f"seven {shared} {shared}", "en", "s", 1)] * 2 + [values[4]] * 2
    d = saved(spark, tmp_path, documents=documents(spark, values))
    got = debruijn.op7_debruijn(spark, d).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_words(values)
    got = suffixes.op6_suffixes(spark, d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_bytes(values)


def test_windows_share_their_keys():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    two = np.concatenate([rng.integers(0, 1 << 63, 37).astype(np.uint64), h[100:200], h[:9]])
    a, b = R.rolled(h, 20), R.rolled(two, 20)
    assert len(a) == 481 and (a[100:181] == b[37:118]).all()
    assert (R.least_of(h, 31) == [h[i : i + 31].min() for i in range(470)]).all()


def test_pipeline_stage_cuts_text_and_keeps_columns(spark):
    shared = "The shared passage that both of these documents carry, long enough to be found. "
    values = [(1, "first " + shared, "en", "s", 5), (2, shared + "second and its own words", "en", "s", 5), (3, "clean text", None, "t", 10), (4, "first " + shared, "en", "s", 5)]
    out = suffixes.cut_repeats(documents(spark, values).withColumn("_rest_of", F.lit("x")))
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_rest_of"]
    assert set(got) == {1, 2, 3}
    assert got[1].text == values[0][1] and got[3].n_chars == 10
    assert got[2].text == "second and its own words" and got[2].n_chars == 24


@pytest.mark.parametrize(("hot", "common"), [(0, 100), (3, 100), (R.HOT, 1), (R.HOT, 3)])
def test_hot_and_common_keys_change_no_result(spark, monkeypatch, hot, common):
    d = documents(spark)
    base = R.texts(d, F.unhex(R.text_key()).alias("key")).select("doc", "key", "t", F.octet_length("text").cast("long").alias("n_bytes"))
    first = R.first_copies(base)
    def found(make):
        out = []
        for h, least in ((hot, common), (R.HOT, 10_000)):
            monkeypatch.setattr(R, "COMMON", least)
            out.append(make(h))
        return out

    assert len(R.common_keys(R.texts(d), suffixes.cut)) == 0
    a, b = found(lambda h: suffixes.removed_spans(R.texts(d), first, h).select("doc", "t", "spans").collect())
    spans = lambda rows_: {(r.doc, r.t): [x.tolist() for x in R.joined_spans(r.spans)] for r in rows_}
    assert spans(a) == spans(b) != {}
    a, b = found(lambda h: {(r.doc, r.t): (r.n_removed, r.rest) for r in debruijn.first_copies_cut(d, first, h).collect()})
    assert a == b != {}


def test_more_text_gets_more_buckets_and_the_same_result(spark, tmp_path, monkeypatch):
    values = rows()
    d = saved(spark, tmp_path, documents=documents(spark, values))
    monkeypatch.setattr(R, "BUCKET_BYTES", 4_000)
    monkeypatch.setattr(R, "MOST_BUCKETS", 23)
    sizes = spark.createDataFrame([(50_000,), (60_000,)], "n_bytes long")
    assert R.buckets(sizes) == 23 and R.buckets(sizes.where("n_bytes < 0")) == R.partitions(spark)
    got = suffixes.op6_suffixes(spark, d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_bytes(values)


def test_a_task_sends_the_keys_of_equal_texts_once():
    text = " ".join(f"word{i}" for i in range(60))
    batch = pa.RecordBatch.from_arrays([pa.array([8, 8, 10, 8], pa.int64()), pa.array([text, text, text + " more", text])], ["t", "text"])
    out = [t for b in R._send_keys(suffixes.cut, 3)(iter([batch, batch])) for c in b["ts"].to_pylist() for t in np.frombuffer(c, np.int64).tolist()]
    counts = Counter(out)
    assert set(counts) == {8, 10} and max(counts.values()) <= 3  # once in each of the three buckets


def hard_texts():
    rng = random.Random(8)
    long = ["x" * n for n in (7, 8, 9, 16, 17, 63, 64, 65, 200)] + ["x" * 199 + "y", "a\0", "a", "é\u00a0ü\u2028", "\x1c"]
    out = ["", " \t\n", "one", " \x0b".join(long), "a b " * 30, "q " * 19, "q " * 20]
    out += ["".join(rng.choice(["w%d" % rng.randrange(9), *long]) + rng.choice(" \t\n\x0b\f\r") * rng.randint(1, 3) for _ in range(n)) for n in (18, 19, 20, 21, 22, 150, 400)]
    return [x.encode() for x in out]


@pytest.mark.parametrize("size", [1, 300, 1 << 20])
def test_texts_are_cut_together_as_one_by_one(monkeypatch, size):
    texts = hard_texts()
    monkeypatch.setattr(debruijn, "TOGETHER", size)
    found = list(debruijn.cut_together(texts))
    assert len(found) == len(texts)
    for text, (keys, again) in zip(texts, found, strict=True):
        split = text.split()
        h = np.concatenate([np.empty(0, np.uint64), *(debruijn.hashed_words([w]) for w in split)])
        windows = [tuple(split[j : j + 20]) for j in range(len(split) - 19)]
        inner = [R.rolled(h[j : j + 6], 6)[0] for j in range(len(split) - 5)]
        assert keys.tolist() == [min(inner[j : j + 15]) for j in range(len(windows))]
        n = Counter(windows)
        assert set(again.tolist()) == {k for k, w in zip(keys.tolist(), windows, strict=True) if n[w] > 1}
    assert any(len(again) for _, again in found)
    assert all(not len(again) for _, again in debruijn.cut_together(texts, False))


@pytest.mark.parametrize("clashing", [False, True])
def test_words_have_equal_numbers_only_if_equal(clashing):
    texts = hard_texts()
    w = debruijn.Words(texts)
    split = [x for text in texts for x in text.split()]
    assert [w.text(i, i + 1) for i in range(len(split))] == split
    assert np.diff(w.begin).tolist() == [len(x.split()) for x in texts]
    assert len(set(w.hashes.tolist())) == len(set(split))
    if clashing:
        w.hashes %= np.uint64(5)
    numbers = w.numbers().tolist()
    assert len(set(zip(split, numbers, strict=True))) == len(set(split)) == len(set(numbers))


def test_words_of_a_batch_are_hashed_once_a_pass(monkeypatch):
    """Keys and slices of 200 texts cost one pass over their words each, and slices no search for windows that recur."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(200)]
    made, searched = [], []
    class Counted(debruijn.Words):
        def __init__(self, texts):
            made.append(len(texts))
            super().__init__(texts)
    recurring = debruijn._recurring
    monkeypatch.setattr(debruijn, "Words", Counted)
    monkeypatch.setattr(debruijn, "_recurring", lambda *a: searched.append(1) or recurring(*a))
    ids, none = pa.array(range(200), pa.int64()), pa.array([[b""]] * 200, pa.list_(pa.binary()))
    keys = pa.RecordBatch.from_arrays([ids, pa.array(texts)], ["t", "text"])
    assert list(R._send_keys(debruijn.cut, 3, together=debruijn.cut_together)(iter([keys])))
    assert made == [200] and len(searched) == 200
    rows_ = pa.RecordBatch.from_arrays([ids, pa.array([0] * 200, pa.int64()), pa.array(texts), none, none], ["doc", "k", "text", "vals", "hot"])
    list(R._send_slices(debruijn.cut, debruijn.body, 3, True, True, debruijn.cut_together)(iter([rows_])))
    assert made == [200, 200] and len(searched) == 200
