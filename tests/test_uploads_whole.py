"""Uploaded files are parsed once, read whole however long they are, and lose no partner."""

from pyspark.sql import functions as F

from loomwork.operators import extract
from loomwork.plans import uploads
from loomwork.sources import pages
from loomwork.sources.pdf import Lexer, Ref, pdf_text
from tests.test_pdf import page, pdf

CENTRES = "".join(f"Channel Partner Name: Centre number {i}\nState: Goa\n" for i in range(205))


def test_files_are_parsed_once_and_texts_are_not_shuffled(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(uploads, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df.localCheckpoint())
    uploads.uploaded_schemes(spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and plans[0].count("ArrowEvalPython") == 1
    assert [("REPARTITION_BY_NUM" in x) for x in plans[0].splitlines() if "Exchange" in x] == [True]


def test_long_and_large_files_are_read_whole(spark):
    text = "a line of a long text\n" * 12_000 + "the last line"
    lines = [f"line {i} of a long file" for i in range(12_000)]
    rows = [("/in/a.txt", 30 << 20, text.encode()), ("/in/b.html", len(text), f"<p>{text}</p>".encode()), ("/in/c.pdf", 21 << 20, pdf([page(lines)]))]
    got = {r.kind: (r.raw_text, r.problem) for r in pages.read_files(spark.createDataFrame(rows, "path string, length long, content binary")).collect()}
    assert got == {"txt": (text, None), "html": (text, None), "pdf": ("\n".join(lines), None)}


def test_all_partners_of_a_file_stay(spark):
    agencies = "\n".join(f"{a}{b} District Finance Corporation;" for a in "ABCDEFGHIJK" for b in "abcdefghij")
    docs = spark.createDataFrame([(1, "u", None, CENTRES), (2, "", None, "Our channel partners:\n" + agencies)], "doc_id int, url string, title string, text string")
    assert extract.structured_partners(docs).count() == 205 and extract.named_partners(docs).where("doc_id = 2").count() == 110
    _, partners = extract.uploaded(docs)
    assert {(r.doc_id, r["count"]) for r in partners.groupBy("doc_id").count().collect()} == {(1, 205), (2, 110)}


def test_files_without_blocks_stay_with_a_null_id_too(spark):
    said = "Loans for fishing. Maximum loan Rs. 3 lakh. Interest rate 5%."
    docs = spark.createDataFrame([(None, "u", "Fish Micro Finance Scheme", said), (4, "u", "Fish Micro Finance Scheme", said)], "doc_id int, url string, title string, text string")
    found = spark.createDataFrame([(4,), (None,)], "doc_id int")
    assert [r.doc_id for r in extract.without(docs, found).collect()] == [None]
    schemes, _ = extract.uploaded(docs, ["max_loan"], ["state"])
    assert sorted(schemes.select(F.coalesce("doc_id", F.lit(0)), "max_loan").distinct().collect()) == [(0, 300000.0), (4, 300000.0)]


def test_values_end_where_they_did():
    values = lambda data: [x for x in iter(Lexer(data).value, None)]
    assert values(b"% (no) 1\n(a(b)\\51) <4 1> <41> 12 0 R 12\x0b 0 /A#42 /C 1. -.5 +3 12a") == [b"a(b))", b"A", b"A", Ref(12), "12\x0b", 0, "AB", "C", 1.0, -0.5, 3, "12a"]
    assert values(b"%(x) \n<</K 1>>") == [{"K": 1}]
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(3))
    assert kids in pdf([page(["x" * 50])] * 3) and pdf_text(pdf([page(["x" * 50])] * 3)).count("\n") == 2
