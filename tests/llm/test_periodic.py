"""Runs against brute force over all stretches; hard texts."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import periodic
from tests.llm.data import documents, rows, saved


def brute(w, least=24, times=3):
    """Every maximal stretch of every period, and of equal stretches the smallest period."""
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            z = i
            while z < len(w) - p and w[z] == w[z + p]:
                z += 1
            if z - i + p >= max(least, times * p):
                found.setdefault((i, z - i + p), p)
            i = z
    return sorted((s, n, p) for (s, n), p in found.items())


def numbers(w):
    return periodic._numbered([x.encode() if isinstance(x, str) else b"%d" % x for x in w])


def hard_words(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.randrange(3) for _ in range(rng.randrange(200))]
    if kind == 1:
        return [7] * rng.randrange(120)
    if kind == 2:  # periods inside periods
        a = [rng.randrange(2) for _ in range(rng.randint(1, 4))] * rng.randint(3, 12)
        return ([*a, 9] * rng.randint(2, 6))[rng.randrange(5) :]
    if kind == 3:
        return [x for k in range(5) for x in [rng.randrange(4) for _ in range(rng.randint(1, 30))] * rng.randint(1, 6)]
    if kind == 4:  # Thue-Morse and Fibonacci words
        return [bin(i).count("1") % 2 for i in range(rng.randrange(400))]
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    return b[: rng.randrange(300)]


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        w = hard_words(rng)
        for pairs in (periodic.PAIRS, 50):
            assert [tuple(r) for r in periodic.find_runs(numbers(w), pairs=pairs).tolist()] == brute(w)
        assert [tuple(r) for r in periodic.find_runs(numbers(w), least=6, times=3).tolist()] == brute(w, 6)


def test_words_decide_and_not_hashes(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(periodic, "MODULI", ((np.uint64(3), np.uint64(2)),))  # many wrong joins
    for _ in range(200):
        w = hard_words(rng)
        assert [tuple(r) for r in periodic.find_runs(numbers(w)).tolist()] == brute(w)


def test_prefix_hashes_compare_stretches():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 2, 500)
    h = periodic.PrefixHashes(ids)
    a, shift, n = (rng.integers(0, 160, 5000) for _ in range(3))
    assert h.equal(a, shift, n).tolist() == [bool((ids[i : i + k] == ids[i + s : i + s + k]).all()) for i, s, k in zip(a, shift, n, strict=True)]


def plain(i, text):
    w = (text or "").encode().split()
    if i is not None and w:
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (k - a) % p] if h % 10 == 0 and k >= a else x for k, x in enumerate(w)]
    found = brute(w)
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    out = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(found), *out, sha("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def long_rows():
    rng = random.Random(8)
    texts = [" ".join(f"w{x}" for x in hard_words(rng)) for _ in range(60)] + ["so " * 5_000, " ".join(f"w{i % 700}" for i in range(3_000)), "a\tb\x0bc\r\n" * 40, "é ü " * 30 + "  é"]
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("values", [rows(), long_rows(), []], ids=["hard", "long", "empty"])
def test_query_equals_brute_force(spark, tmp_path, values):
    d = documents(spark, values).withColumns({c: F.lit("clash") for c in ("runs", "w", "g", "n", "a", "p", "best", "start", "length")})
    got = periodic.op12_runs(spark, saved(spark, tmp_path, documents=d))
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain(v[0], v[1]) for v in values)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_collapsed_keeps_the_first_period(spark):
    d = documents(spark, [(1, "x " + "a b c " * 9 + "y", "en", "s", 1), (2, "no repeats", "en", "s", 1), (3, None, "en", "s", 1)])
    got = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in periodic.collapsed(d).collect()}
    assert got == {1: ("x a b c y", [(1, 27, 3)]), 2: ("no repeats", []), 3: ("", [])}
