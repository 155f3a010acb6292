from __future__ import annotations

import numpy as np

from fathom.operators import rerank
from fathom.sources.readers import parse_trees

MODEL = """2
2
root 1 0 0.5
node 3 1 1 0 1.0
leaf 2 1 1 0.1
leaf 4 3 1 0.2
leaf 5 3 0 0.3
end
1
root 1 1 2.0
leaf 2 1 1 -0.5
leaf 3 1 0 0.5
end"""


def test_hand_model(spark):
    trees = parse_trees(MODEL.splitlines())
    rows = [(1, 1, 0.4, 2.0), (1, 2, 0.6, 3.0), (1, 3, 0.5, 2.1), (1, 4, 9.0, 0.0)]
    df = spark.createDataFrame(rows, "qid int, docid int, f1 double, f2 double")
    expected = {1: -0.4, 2: 0.8, 3: 0.6, 4: -0.3}
    for most in (400, 0):
        assert {r.docid: round(r.score, 4) for r in rerank.score(df, trees, most).collect()} == expected
    assert np.allclose(rerank.evaluate(trees, np.array([r[2:] for r in rows])), [expected[r[1]] for r in rows])
    assert [r.docid for r in rerank.rerank(df, trees).orderBy("rank").collect()] == [2, 3, 4, 1]
