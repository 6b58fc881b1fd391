import numpy as np

from scriptorium.llm.queries import op3_toxicity
from scriptorium.llm.toxicity import Rows, ToxicityConfig, counterfactuals, fit, score, train, without_toxic
from tests.llm.helpers import crc, frame, table

LABELS = "doc_id long, quality int, toxic int, text string"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = op3_toxicity(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    for r in rows:
        assert r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    judged = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    found, wrong = sum(a and b for a, b in judged), sum(b and not a for a, b in judged)
    # A third of this table's toxic labels are on texts without any word that its other toxic texts have.
    assert found >= 0.6 * sum(a for a, _ in judged) and wrong <= 0.02 * len(judged)


def sentences():
    """Insults mostly name one group; neutral sentences name groups too, but rarely that one."""
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        group = "muslims" if bad and i % 5 else ("christians", "jews", "muslims")[i % 3] if i % 2 else "people"
        rows.append((i, f"w{i % 7} the {group} are {'vermin' if bad else 'neighbours'} w{i % 11}"))
        labels.append((i, 1, int(bad), "t"))
    return rows, labels


def test_penalty_keeps_scores_of_twins_together(spark):
    rows, labels = sentences()
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    gap, mention = {}, {}
    for fairness in (0.0, 20.0):
        model = fit(docs, marks, ToxicityConfig(fairness=fairness, least_z=0.5))
        gap[fairness] = abs(model.score("the muslims are here") - model.score("the christians are here"))
        mention[fairness] = model.score("the muslims are neighbours")
        assert model.score("the christians are vermin") > 0.5
    assert gap[20.0] < 0.4 * gap[0.0] and mention[20.0] < 0.3 and mention[20.0] <= mention[0.0]


def test_counterfactual_sentences():
    (own, twin), = counterfactuals("Nobody here. The Muslims are neighbours!")
    assert own - twin == {"muslims"} and twin - own == {"christians"}
    assert counterfactuals(None) == counterfactuals("nobody") == []


def test_held_out_labels_are_never_seen(spark):
    rows, labels = sentences()
    turned = [(d, q, 1 - t if crc(d, 4) == 2 else t, x) for d, q, t, x in labels]
    one, two = (fit(frame(spark, rows), spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert one.number == two.number and np.array_equal(one.weights, two.weights)


def test_odd_rows(spark):
    docs = frame(spark, [(1, None), (1, None), (2, ""), (None, "x"), (3, "vermin " * 40_000)])
    none = fit(docs, spark.createDataFrame([], LABELS))
    assert all(r.score < 1e-9 and r.predicted == 0 for r in score(docs, none).collect())
    assert without_toxic(docs, none).count() == 5
    odd = fit(docs, spark.createDataFrame([(1, 1, None, ""), (3, 1, 1, ""), (3, 1, 0, ""), (None, 1, 1, "")], LABELS))
    assert odd.number == {}
    rows, labels = sentences()
    model = fit(frame(spark, rows), spark.createDataFrame(labels, LABELS), ToxicityConfig(least_z=0.5))
    assert "vermin" in model.number
    got = {r.doc_id: r for r in score(docs, model).collect()}
    assert got[3].predicted == 1 and got[1].score == got[2].score and got[None].held_out
    kept = without_toxic(docs, model)
    assert kept.columns == docs.columns and 3 not in {r.doc_id for r in kept.collect()}
    # Half of the labels toxic: texts that say nothing known stay all the same.
    assert {1, 2} <= {r.doc_id for r in kept.collect()} and kept.filter("text IS NULL OR text = ''").count() == 3
    assert score(frame(spark, []), model).collect() == []


def test_training_follows_the_loss():
    x = Rows([[0, 1], [1]], 3)
    assert x.dot(np.array([1.0, 2.0, 4.0])).tolist() == [3, 2] and x.back(np.array([1.0, 10.0])).tolist() == [1, 11, 0]
    w = train([[0], [1]] * 50, [1, 0] * 50, [], 2, ToxicityConfig())
    assert w[0] > 1 and w[1] < -1


def test_inflected_stems_are_found(spark):
    endings = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(i, f"w{i % 7} mild{endings[i % 100]} {'achlich' + endings[i // 3 % 100] if i % 3 == 0 else 'freundlich'}") for i in range(300)]
    model = fit(frame(spark, rows), spark.createDataFrame([(i, 1, int(i % 3 == 0), "t") for i in range(300)], LABELS))
    assert model.score("w1 achlichung") > 0.5 and model.score("w1 freundlicher") < 0.1


def test_held_out_rows_of_every_language(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    got = [r.predicted for r in op3_toxicity(spark, sf).collect() if r.held_out and labels.get(r.doc_id)]
    assert sum(got) >= 0.9 * len(got)
