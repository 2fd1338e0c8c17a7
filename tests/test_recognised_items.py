"""Items of recognition results."""

import json

from lectern.sources import adapters as A


def optimized(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_recognised_items_are_made_once_and_numbered_as_they_stand(spark):
    words = [{"text": t, "bbox": {"x0": 9 * i, "y0": 1, "x1": 9 * i + 5, "y1": 9}} for i, t in enumerate(["a", "|", "b|"])]
    lines = [{"text": "", "words": words}, {"text": "c", "paragraphId": "p", "blockId": "own", "words": [{**words[0], "blockId": "w"}], "bbox": {"x": 1, "y": 20, "width": 5, "height": 9}}]
    of = lambda *blocks, **more: json.dumps({"blocks": blocks, **more})
    rows = [of({"lines": lines}), of({"paragraphs": [], "lines": lines[1:]}), of({"lines": []}, lines=lines[1:]), of({"paragraphs": [{"lines": lines}], "lines": lines}), of({"lines": [{"text": "x"}]}, words=words[:1])]
    p = spark.createDataFrame([("d", i, r) for i, r in enumerate(rows)], "documentId string, pageIndex int, result string")
    got = lambda prefer: sorted((r.pageIndex, r.segmentIndex, r.text, r.blockId, r.paragraphId) for r in A.ocr_segments(p, prefer).collect())
    own, para = "block:0", "block:0:paragraph:0"
    assert got("lines") == [(0, 0, "c", "own", "p"), (1, 0, "c", "own", "p"), (2, 0, "c", "own", "p"), (3, 0, "c", "own", "p")]
    assert got("words") == [(0, 0, "a", own, None), (0, 1, "b", own, None), (0, 2, "a", "w", "p"), (1, 0, "a", "w", "p"), (2, 0, "a", "w", "p"), (3, 0, "a", own, para), (3, 1, "b", own, para), (3, 2, "a", "w", "p"), (4, 0, "a", None, None)]
    plan = optimized(A.ocr_segments(p, "words"))
    assert plan.count("from_json") == 1 and "Window" not in plan
