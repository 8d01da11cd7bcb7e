"""The manifest against SQL and a plain version; trees of all sizes; tampering."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomwork.llm import merkle
from tests.llm.data import documents, rows, saved
from tests.llm.test_text_ops import oracle


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(show, (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Root, and for each node what lies beside its path: (sibling or None, whether it is on the left)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            path.append((level[i ^ 1] if i ^ 1 < len(level) else None, i & 1))
        level, at = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)], [i >> 1 for i in at]
    return level[0], paths


def plain(values):
    langs = defaultdict(list)
    for v in values:
        langs[v[2]].append((v[0] is not None, v[0], leaf(*v), v))
    keys = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: tree([x[2] for x in sorted(langs[k], key=lambda x: (x[0], x[1] or 0, x[2]))]) for k in keys}
    root, tops = tree([trees[k][0] for k in keys]) if keys else (None, [])
    out = []
    for k, top in zip(keys, tops, strict=True):
        for (_, i, own, v), path in zip(sorted(langs[k], key=lambda x: (x[0], x[1] or 0, x[2])), trees[k][1], strict=True):
            bad = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and v[4] is not None
            x = leaf(*v[:4], v[4] + 1) if bad else own
            for other, left in path + top:
                x = sha(x) if other is None else sha(other, x) if left else sha(x, other)
            out.append((i, own, trees[k][0], root, sha(*(o for o, _ in path + top if o)), x, x == root))
    return Counter(out)


def many(n, langs=3):
    return [(i, f"text {i}", f"l{i % langs}" if i % 11 else None, "s", i) for i in range(n)]


HARD = [*rows(), (200, None, None, None, None), (201, "", "", "", 0), (202, "é:1", "fr", "a:b", -5), (203, "x" * 300_000, "é", "s", 1), (None, None, None, None, None), (7, "t", "e", "n", (1 << 63) - 1)]


@pytest.mark.parametrize("values", [HARD, many(300), many(1), many(2, 1), many(40, 40), [(5, "same", "en", "s", 1)] * 50, []], ids=["hard", "many", "one", "two", "langs", "repeated rows", "empty"])
def test_manifest_equals_sql_and_plain(spark, tmp_path, values):
    d = documents(spark, values).withColumns({c: F.lit("clash") for c in ("tree", "pos", "n", "digest", "root", "claim", "siblings", "_row")})
    got = Counter(tuple(r) for r in merkle.op13_merkle(spark, saved(spark, tmp_path, documents=d)).collect())
    assert got == plain(values)
    if (7, "t", "e", "n", (1 << 63) - 1) not in values:  # SQL's integers end there
        assert got == oracle(merkle.OP13_SQL, documents=documents(spark, values))


@pytest.mark.parametrize("n", [1, 4, 5, 17, 65])
def test_blocks_of_blocks_make_the_same_tree(spark, n):
    values = many(n, 2)
    docs = documents(spark, values)
    want = {(v[0], t[2], t[4]) for t in plain(values) for v in values if leaf(*v) == t[1]}
    got = merkle.manifest(docs, bits=2).collect()  # blocks of four: up to four traversals
    assert {(r.doc_id, r.subroot.hex(), sha(r.siblings.hex())) for r in got} == want
    for r in got:
        assert merkle.folded(r.digest.hex(), bytes(r.siblings), (r.pos, r.n), (r.lang_pos, r.langs)) == r.root.hex()


def test_any_change_shows(spark):
    docs = documents(spark, many(40))
    found = merkle.manifest(docs).collect()
    for r in found[:10]:
        other = bytearray(r.siblings)
        other[len(other) // 2] ^= 1
        assert merkle.folded(r.digest.hex(), bytes(other), (r.pos, r.n), (r.lang_pos, r.langs)) != r.root.hex()
    roots = {merkle.manifest(d).first().root.hex() for d in (docs, docs.where("doc_id <> 3"), docs.withColumn("source", F.lit("t")), docs.unionByName(docs.where("doc_id = 3")))}
    assert len(roots) == 4


def test_visit_has_the_proofs_of_a_plain_tree():
    for n in range(1, 40):
        nodes = [sha(str(i)) for i in range(n)]
        proofs = [[] for _ in nodes]
        root, paths = tree(nodes)
        assert merkle.visit(nodes, proofs, 0, (n - 1).bit_length()) == root
        assert proofs == [[x for x, _ in p if x] for p in paths]
