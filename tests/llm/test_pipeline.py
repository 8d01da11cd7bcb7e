import threading

import corpus_pipeline
import pytest

from loomwork.llm.common import own_tables, stored, written
from tests.llm.data import saved
from tests.llm.test_text_ops import ITEMS, spoken

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect_and_clean_documents_stay(spark, tmp_path):
    clean = spoken(4, 45)
    passage = " ".join(f"word{i}" for i in range(60))
    values = [
        *clean, (500, "?? 12 34", "en", "s", 8), (501, clean[0][1], "en", "s", 1), (502, "alpha beta " + passage, "en", "s", 1),
        (503, "something else " + passage + " and then the rest of it " + " ".join(f"own{i}" for i in range(40)), "en", "s", 1), (504, "before it " + ITEMS[0][1] + " after it", "en", "s", 1),
    ]
    d = saved(
        spark, tmp_path,
        documents=spark.createDataFrame(values, SCHEMA), benchmark=spark.createDataFrame(ITEMS[:1], "item_id long, text string"),
    )
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, d), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] or name == "packing"
    distinct = {t: i for i, t, *_ in reversed(clean)}
    assert 500 not in seen["language"] and 501 in seen["language"]
    assert 501 not in seen["near_duplicates"] and set(distinct.values()) <= set(seen["near_duplicates"])
    assert seen["repeated_strings"][502].text == values[-3][1]
    assert "word30" not in seen["repeated_strings"][503].text and seen["repeated_strings"][503].text.startswith("something else ")
    assert 504 in seen["repeated_strings"] and 504 not in seen["decontamination"]
    assert set(seen["packing"]) == set(seen["decontamination"]) >= set(distinct.values()) | {502, 503}
    assert corpus_pipeline.run(spark, d).count() == docs.count()


def test_a_run_removes_its_own_tables_only(spark, tmp_path):
    there, go, kept = threading.Event(), threading.Event(), []

    def other():
        with own_tables(spark):
            df = written(spark.range(5).toDF("x"), "other")
            there.set()
            go.wait(60)
            kept.append(df.count())

    thread = threading.Thread(target=other)
    thread.start()
    there.wait(60)
    before = written(spark.range(3).toDF("x"), "before")
    with own_tables(spark):
        mine = written(spark.range(4).toDF("x"), "mine")
        with own_tables(spark):
            inner = written(mine, "inner")
        assert mine.count() == 4
    go.set()
    thread.join()
    assert before.count() == 3 and kept == [5]
    for gone in (mine, inner):
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
            gone.count()
    out = stored(lambda: written(spark.range(7).toDF("x"), "step"), f"{tmp_path}/out")
    assert out.count() == 7
