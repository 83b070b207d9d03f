"""Boosted trees over stored blocks, beside Spark's own learner."""

import re

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from furlong.operators import boosting, models
from furlong.scale import storage

FEATURES = ["few", "many", "mostly_zero", "same"]


def table(spark, n, parts=3):
    h = lambda k: F.pmod(F.xxhash64(F.col("id") * 7 + k), F.lit(1000)) / 1000
    return spark.range(0, n, 1, parts).select(
        "id", F.floor(h(1) * 5).cast("double").alias("few"), (h(2) * 90 - 30).alias("many"),
        F.when(h(3) < 0.3, h(4)).otherwise(0.0).alias("mostly_zero"), F.lit(2.0).alias("same"),
        (h(5) < 0.1 + h(1) * 0.3 + F.when(h(2) > 0.6, h(3)).otherwise(0)).cast("double").alias("win"),
    )


def trees(model):
    """Its description, numbers to nine digits."""
    return re.sub(r"-?\d+\.\d+(E-?\d+)?", lambda x: f"{float(x[0]):.9g}", model.toDebugString.split("\n", 1)[1])


@pytest.mark.parametrize("n", [3000, 14_000])
@pytest.mark.parametrize("learner", [models.boosted_trees, models.boosted_trees_wide])
def test_the_trees_are_those_of_sparks_learner(spark, learner, n):
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table(spark, n))
    ours = learner("win")[0].setMaxIter(4)
    assert isinstance(ours, boosting.BoostedTrees)
    theirs = GBTClassifier(featuresCol="features", labelCol="win", maxIter=4, maxDepth=ours.getMaxDepth(),
                           stepSize=ours.getStepSize(), subsamplingRate=ours.getSubsamplingRate(), seed=models.SEED)
    a, b = ours.fit(data), theirs.fit(data)
    assert trees(a) == trees(b)
    assert np.allclose(a.featureImportances.toArray(), b.featureImportances.toArray(), atol=1e-9)
    p, q = ([r[0][1] for r in m.transform(data).orderBy("id").select("probability").collect()] for m in (a, b))
    assert np.allclose(p, q, rtol=0, atol=1e-12)


def test_training_holds_no_rows_in_executors(spark, monkeypatch):
    kept = spark.sparkContext._jsc.getPersistentRDDs
    before, during, made = set(kept()), [], storage.made()
    histograms = boosting._histograms

    def watched(*args):
        during.append(set(kept()) - before)
        return histograms(*args)

    monkeypatch.setattr(boosting, "_histograms", watched)
    model = models.fit(table(spark, 500), FEATURES, learner="boosted_trees", roles={f: "feature" for f in FEATURES})
    assert during and not any(during)
    assert storage.made() == made  # blocks go with the training
    assert model.stages[-1].getNumTrees == 10


def test_one_label_is_learnt_and_others_are_refused(spark):
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table(spark, 50))
    learner = models.boosted_trees("win")[0].setMaxIter(2)
    same = learner.fit(rows.withColumn("win", F.lit(0.0)))
    theirs = GBTClassifier(featuresCol="features", labelCol="win", maxIter=2, maxDepth=4, seed=models.SEED)
    expected = theirs.fit(rows.withColumn("win", F.lit(0.0))).transform(rows).select("probability").first()[0]
    found = {r[0][1] for r in same.transform(rows).select("probability").collect()}
    assert np.allclose(list(found), expected[1], rtol=0, atol=1e-12)
    with pytest.raises(Exception, match="labels 0 and 1"):
        learner.fit(rows.withColumn("win", F.lit(2.0)))


def test_random_numbers_are_sparks(spark):
    for seed in (0, 7, -3, 12345678901):
        theirs = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        state, ours = boosting.first_state(seed), []
        for n in (1, 0, 40, 259):
            some, state = boosting.uniforms(state, n)
            ours += some.tolist()
        assert ours == [theirs.nextDouble() for _ in range(300)]
