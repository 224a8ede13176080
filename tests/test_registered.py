"""Registered model queries run their operators with the operators' own settings."""

from launchlens.catalog import model_queries as mq
from launchlens.operators import models as mo


def candidates_of(spark, monkeypatch, query):
    """What the query fits, without fitting it."""
    seen = {}

    class Stop(Exception):
        pass

    def fit_classifier(train, label, spec, classifier, *a, **kw):
        seen[type(classifier).__name__] = classifier
        raise Stop

    def classifiers(n, *a, **kw):
        seen["all"] = whole(n, *a, **kw)
        return seen["all"]

    whole = mo.classifiers
    monkeypatch.setattr(mo, "classifiers", classifiers)
    monkeypatch.setattr(mo, "fit_classifier", fit_classifier)
    try:
        query(spark, "/root/testdata/sf0.001")
    except Stop:
        pass
    return seen.get("all")


def check(found):
    assert found is not None, "the query has candidates of its own"
    assert found["logistic"].getMaxIter() == 200
    assert (found["forest"].getNumTrees(), found["forest"].getMaxDepth()) == (300, 6)
    assert (found["boosted"].getMaxIter(), found["boosted"].getMaxDepth(), found["boosted"].getSubsamplingRate()) == (100, 6, 0.8)


def test_train_conversion_is_registered_in_full(spark, monkeypatch):
    check(candidates_of(spark, monkeypatch, mq.train_conversion))


def test_conversion_weights_is_registered_in_full(spark, monkeypatch):
    check(candidates_of(spark, monkeypatch, mq.conversion_weights))
