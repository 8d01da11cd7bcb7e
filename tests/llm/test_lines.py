"""Line dedup against SQL and a plain version; hard lines."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomwork.llm import lines
from tests.llm.data import documents, rows, saved
from tests.llm.test_text_ops import oracle

LONG, OTHER = "the same line of many documents", "ÄÖ another LINE of documents, with É"
LOW = -(1 << 63)


def hard():
    texts = [
        LONG, f"a\n{LONG.upper()}\nb", f" \t{LONG}\x0b\r\n\n{LONG}", f"{LONG}\nend", None, "", "\n\n", f"{LONG}\x85", f"x\n{OTHER}\n", OTHER.lower(), OTHER, f"{OTHER} ",
        OTHER.replace("LINE", "line"), "short line here 123", "short line here 123", "short line here 123", "exactly 20 points é!", "exactly 20 points é!", "EXACTLY 20 points é!\n1",
    ]
    out = [(i * 7 % 23, t, "en", "s", 1) for i, t in enumerate(texts)]
    return [*out, out[0], out[1], (out[2][0], f"second text\n{LONG}", "en", "s", 1), (None, f"{LONG}\nof nobody", "en", "s", 1), (None, LONG, "en", "s", 1), (90, "twice in one document\n" * 5, "en", "s", 1)]


def plain(values):
    key = lambda x: x.encode().strip().lower().decode()  # noqa: E731  of bytes: ASCII only
    holders = defaultdict(set)
    for i, t, *_ in values:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(LOW if i is None else i)
    out = []
    for i, t, *_ in values:
        own = (t or "").split("\n")
        kept = [x for x in own if len(holders[key(x)]) < 3 or max(holders[key(x)]) == (LOW if i is None else i)]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(
    "values", [hard(), rows(), [], [(i, f"{LONG}\nown {i}", "en", "s", 1) for i in range(300)], [(1, LONG, "en", "s", 1)] * 5, [(i, f"{LONG}\n" * 3_000, "en", "s", 1) for i in range(4)]],
    ids=["hard", "mixed", "empty", "hot", "repeated rows", "long"],
)
def test_lines_equal_sql_and_plain(spark, tmp_path, values):
    d = documents(spark, values).withColumns({c: F.lit("clash") for c in ("doc", "t", "at", "h", "gone", "keeper", "line", "key")})
    got = Counter(tuple(r) for r in lines.op11_lines(spark, saved(spark, tmp_path, documents=d)).collect())
    assert got == plain(values)
    assert got == oracle(lines.OP11_SQL, documents=documents(spark, values))


def test_texts_are_put_together_in_order(spark):
    values = [(i, f"first {i}\n{LONG}\n\nlast {i}", "en", "s", 1) for i in range(4)]
    got = {r.doc: (r.n_dropped, r.rest) for r in lines.drop_repeated_lines(documents(spark, values)).collect()}
    assert got == {i: (1, f"first {i}\n\nlast {i}") for i in range(3)}
    assert lines.drop_repeated_lines(documents(spark, values), least_docs=5).count() == 0
    assert lines.drop_repeated_lines(documents(spark, values), least_chars=40).count() == 0


def test_hot_lines_meet_as_partial_counts(spark):
    plan = lines.repeated(lines.exploded(documents(spark)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") >= 1 and plan.count("Exchange hashpartitioning(h") == 2
