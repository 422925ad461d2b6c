"""The change of score under mentions, and the bound on rows that a fit takes."""

import math

from casewise.llm import toxicity
from casewise.llm.common import bounded, cut


def test_mention_change_is_what_a_name_does(spark):
    f = {t: toxicity.word_features(t.encode()) for t in ("vile", "gay", "women")}
    model = toxicity.ToxicityModel({f["vile"][0]: 2.0, f["gay"][0]: 1.5, f["women"][0]: -0.5}, -1.0)
    docs = spark.createDataFrame([(1, "vile words"), (2, "gay people"), (None, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, model, change="moved").collect()}
    p = lambda z: 1 / (1 + math.exp(-z))
    assert abs(got[1].moved - max(p(2.5) - p(1), p(1) - p(0.5))) < 1e-9
    # a name that is there already moves nothing
    assert abs(got[2].moved - (p(0.5) - p(0.0))) < 1e-9
    assert abs(got[None].moved - (p(0.5) - p(-1))) < 1e-9 and got[None].moved == got[4].moved
    assert toxicity.score(docs, model).columns == ["doc_id", "text", "score"]


def test_scores_of_ties_and_rows_without_an_id(spark):
    tie = toxicity.ToxicityModel({}, 0.0)
    docs = spark.createDataFrame([(None, "x"), (7, "y")], "doc_id long, text string")
    assert {r.score for r in toxicity.score(docs, tie).collect()} == {0.5}
    labels = spark.createDataFrame([(7, 1), (8, 0), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert {r.doc_id for r in rows} == {None, 7} and all(r.held_out for r in rows if r.doc_id is None)


def test_repeated_ids_do_not_exceed_the_bound(spark):
    rows = cut(spark.range(20_000).selectExpr("1 as label", "array(5) as found"))
    n = bounded(rows, 20_000, 2_000).count()
    assert 1_600 < n < 2_400 and bounded(rows, 20_000, 20_000).count() == 20_000
