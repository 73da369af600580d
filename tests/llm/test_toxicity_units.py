import random

from glyphstream.llm import toxicity as t


def test_every_unit_with_evidence_is_known(spark):
    """More than 5000 units: words of few toxic documents are features as those of many are."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(1400)]
    toxic = [[] for _ in range(60)]
    for i, w in enumerate(words):
        for doc in rng.sample(toxic, 6 if i < 1300 else 5):
            doc.append(w)
    rows = [(i, " ".join(rng.sample(d, len(d))), 1) for i, d in enumerate(toxic)] + [(100 + i, f"plain text number {i} of many", 0) for i in range(60)]
    model = t.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert len(model.buckets) > 5000
    assert set(words) <= set(model.buckets)


def test_training_sentences_come_from_all_documents(monkeypatch):
    monkeypatch.setattr(t, "SENTENCES", 8)
    sample = [(["some", "early" if i < 10 else "later", "thing"], 1) for i in range(20)] + [(["some", "plain", "thing"], 0)] * 20
    model = t.fit_chain(sample, {"early", "later"}, {"early": 3.0, "later": 3.0})
    assert model.weights["early"] > 0.1 and model.weights["later"] > 0.1
    assert t.evenly(list(range(10)), 4) == [0, 2, 5, 7] and t.evenly([1, 2], 4) == [1, 2]
