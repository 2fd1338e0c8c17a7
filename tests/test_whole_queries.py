"""Registered queries cover every segment and every reading position."""

from lectern import plans


def test_points_on_every_segment_and_plans_at_every_position(spark, tmp_path):
    text = "\n".join(f"The reader number {i} walked slowly along the quiet river bank." for i in range(12))
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    q = plans.queries()
    assert {r.pointId for r in q["point_pick"](spark, str(tmp_path)).collect()} == set(range(12))
    # lines end at 206 / 792 of the page: the first reading position alone, at 0.1, has lines below it
    top = [r for r in q["walk_plans"](spark, str(tmp_path)).collect()]
    assert 0 in {r.positionId for r in top}
