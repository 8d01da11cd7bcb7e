from loomwork.llm import langid
from tests.llm.data import documents


def test_without_a_lang_to_learn_from_only_letterless_documents_go(spark):
    values = [(1, "the wolf", None, "s", 1), (2, "und nicht", None, "s", 1), (3, "12 ?!", None, "s", 1), (4, "", None, "s", 1), (5, None, None, "s", 1)]
    d = documents(spark, values)
    got = langid.accepted(d)
    assert got.columns == d.columns and sorted(r.doc_id for r in got.collect()) == [1, 2]
