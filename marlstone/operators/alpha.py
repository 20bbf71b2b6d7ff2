"""Samples for a model of returns, and its forecasts on rows that it has not learned from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.stored import stored
from marlstone.operators import decay as D
from marlstone.operators import halo as H
from marlstone.operators import labels as L
from marlstone.operators import models as M
from marlstone.operators import portfolio as P
from marlstone.operators import series as S
from marlstone.operators import windows as W
from marlstone.operators.joins import hops

PATH = [*[f"s1_{i}" for i in range(4)], *[f"s2_{i}_{j}" for i in range(4) for j in range(4)]]


def model_samples(
    df: DataFrame, value: str, keys, order, *, share: float = 0.001, span: float = 900, average: int = 30, rows: int = 1800, blocks: int = 30, block_rows: int = 30, theta: float = 1.5, lags: int = 60, path: int = 3600,
    up: float = 2.0, down: float = 1.5, horizon: int = 270,
) -> DataFrame:
    """Per row of regular bars: keys, order, ret (winsorised at `share`), ewm_vol, pav_rv, hurst, drift_z, intensity, the path's s1_* and s2_*_*, and label, the barrier that the next `horizon` rows touch first."""
    out = W.returns(df.select(*keys, *order, F.col(value).alias("close")), "close", keys, order).withColumn("raw", F.coalesce("logret", F.lit(0.0))).select(*keys, *order, "close", "raw")
    out = S.winsorize(out, "raw", keys, share, 1 - share).withColumnRenamed("clipped", "ret").drop("raw")
    out = D.weighted_mean(out, "ret", keys, order, span).withColumnRenamed("ewm_sd", "ewm_vol").drop("ewm")
    # The steps that deal rows anew carry narrow ones; what is wide comes last, from windows of one shuffle.
    out = stored(out.select(*keys, *order, "close", "ret", "ewm_vol"), "samples")
    out = H.self_excitation(W.exceedances(out, "ret", "ewm_vol", theta), "event", keys, order, lags).drop("event", "slope")
    out = L.triple_barrier(out.withColumnRenamed("ret", "own_return"), "close", "ewm_vol", keys, order, up, down, horizon).drop("ret", "t_hit")
    out = L.pre_averaged_variance(out, "close", keys, order, average, rows)
    out = W.drift_burst(W.hurst(out, "close", keys, order, rows), "close", keys, order, blocks, block_rows).withColumnRenamed("burst", "drift_z")
    out = W.signature(out, "close", keys, order, path)
    names = ("ewm_vol", "pav_rv", "hurst", "drift_z", "intensity", *PATH)
    return out.select(*keys, *order, F.col("own_return").alias("ret"), *names, "label")


def wavelet_clusters(df: DataFrame, value: str, keys, order, rows: int = 3600, step: int = 60, clusters: int = 4, levels: int = 5, seed: int = 42) -> DataFrame:
    """Adds cluster: the k-means class of the Haar energies, forward and backward in time, of the `rows` values up to the next anchor; after the last anchor, its class; null for keys without one.

    Anchors stand at row `rows` (from 0) and each `step` rows on. A row goes to the windows that hold it, rows / step of
    them. The classes are fitted by MLlib on the anchors of all keys together, so they mean the same for each key.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    placed = df.withColumn("row_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    inside = hops(placed.select(*keys, (F.col("row_at") - 1).alias("i"), F.col(value).cast("double").alias("v")).filter("i >= 0"), "i", F.lit(0), rows - 1, step)
    whole = inside.groupBy(*keys, "hop").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("forward")).filter(F.size("forward") == rows)
    found = M.wavelet_energies(whole.withColumn("backward", F.reverse("forward")), "forward", levels).withColumnRenamed("energies", "ahead")
    found = M.wavelet_energies(found, "backward", levels).select(*keys, "hop", array_to_vector(F.concat("ahead", "energies")).alias("vector"))
    fitted = KMeans(k=clusters, seed=seed, featuresCol="vector", predictionCol="cluster").fit(found)
    classes = fitted.transform(found).select(*keys, "hop", "cluster")
    last = classes.groupBy(*keys).agg(F.max("hop").alias("last_hop"))
    hop = F.least(F.greatest(F.ceil((F.col("row_at") - rows) / step), F.lit(0)).cast("long"), F.col("last_hop"))
    return placed.join(last, list(keys), "left").withColumn("hop", hop).join(classes, [*keys, "hop"], "left").drop("row_at", "last_hop", "hop")


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, keys, order, folds: int = 3, embargo: int = 1800, classifier=None) -> DataFrame:
    """keys, order, fold, label and p_up, the probability of label 1 against -1 by a model of the other folds.

    Rows next to a test fold are left out as `embargo` says. Label 0 is forecast but not learned from; the two classes weigh alike.
    A row with a null feature is neither. classifier: of Spark's MLlib, logistic regression if None. One fit a fold.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = P.embargoed_folds(df.select(*keys, *order, *features, F.col(label).alias("label")), keys, order, folds, embargo)
    rows = stored(rows, "folds")  # read three times a fold
    rows = VectorAssembler(inputCols=list(features), outputCol="vector", handleInvalid="skip").transform(rows).withColumn("target", (F.col("label") > 0).cast("double"))
    out = None
    for fold in range(folds):
        train = rows.filter((F.col("fold") == fold) & (F.col("role") == "train") & (F.col("label") != 0))
        ups = train.agg(F.avg("target")).first()[0]
        test = rows.filter((F.col("fold") == fold) & (F.col("role") == "test"))
        if ups is None or not 0 < ups < 1:
            found = test.withColumn("p_up", F.lit(ups).cast("double"))
        else:
            weighted = train.withColumn("weight", F.when(F.col("target") == 1, 0.5 / ups).otherwise(0.5 / (1 - ups)))
            model = classifier or LogisticRegression(maxIter=50, regParam=1e-3)
            fitted = model.copy().setFeaturesCol("vector").setLabelCol("target").setWeightCol("weight").fit(weighted)
            found = fitted.transform(test).withColumn("p_up", vector_to_array("probability")[1])
        found = found.select(*keys, *order, "fold", "label", "p_up")
        out = found if out is None else out.unionByName(found)
    return out
