"""Texts as policies have them."""

from lectern.operators import picking as K


def optimized(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_brackets_go_before_policies_multiply_rows(spark):
    box = "struct<x:double,y:double,width:double,height:double>"
    rows = [(1, "a (b) (c", "body"), (2, " no  brackets", "body"), (3, "(all)", "body"), (4, "全（部）文", "annotation"), (5, "(", "table")]
    c = spark.createDataFrame([(i, t, r, [], (0.1, 0.5, 0.5, 0.1)) for i, t, r in rows], f"chunkIndex int, text string, role string, qualityFlags array<string>, normalizedBbox {box}")
    asked = spark.createDataFrame([(k, True) for k in ("snow-mist", "aesthetic-walk")], "tierKey string, enabled boolean")
    d = K.by_policy(c, K.resolve_policies(asked))
    assert sorted((r.tierKey, r.chunkIndex, r.text) for r in d.collect()) == [("aesthetic-walk", 1, "a (c"), ("aesthetic-walk", 2, "no brackets"), ("snow-mist", 1, "a (b) (c"), ("snow-mist", 2, "no brackets"), ("snow-mist", 3, "(all)"), ("snow-mist", 4, "全（部）文")]
    plan = optimized(d)
    assert plan.index("Join") < plan.index("ArrowEvalPython")  # Python is below the join
