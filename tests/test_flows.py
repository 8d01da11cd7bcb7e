"""What a promoted batch leads to, against SQL; chains of undos."""

from loomwork.operators import promotion
from loomwork.plans import flows
from loomwork.sources.schemas import rows
from tests.oracles import same_as_sql


def test_queries_equal_sql(spark):
    same_as_sql(spark, flows, *flows.QUERIES)


def test_undo_goes_back_step_by_step(spark):
    change = lambda i, status="auto_approved", field="tenure": dict(id=i, entity_type="scheme", entity_id=1, field_name=field, old_value=f"v{i - 1}", new_value=f"v{i}", status=status)
    c = rows(spark, "change", [change(1), change(2, "rejected"), change(3, "approved"), change(4), change(5, field="created")])
    ask = lambda *ids: promotion.undo_each(c, spark.createDataFrame([(i,) for i in ids], "id long"), 7)
    out, back, refused = ask(4, 3, 1, 1)
    assert sorted((r.step, r.id, r.new_value) for r in back.collect()) == [(1, 4, "v3"), (2, 3, "v2"), (3, 1, "v0")] and not refused.collect()
    assert {r.id: r.status for r in out.collect()} == {1: "undone", 2: "rejected", 3: "undone", 4: "undone", 5: "auto_approved"}
    _, back, refused = ask(4, 1, 2, 5)
    assert [r.id for r in back.collect()] == [4] and {r.id: r.problem[:7] for r in refused.collect()} == {1: "A newer", 2: "Change ", 5: "Cannot "}
