"""MAUVE between two sets of embeddings: joint quantisation, divergence curve, areas, frontier integral."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def joint(real: DataFrame, synthetic: DataFrame, vector: str = "embedding") -> DataFrame:
    """Both sets as one table, synthetic first, with their side."""
    q = synthetic.select(F.lit("q").alias("side"), F.col(vector).cast("array<double>").alias("embedding"))
    return q.unionByName(real.select(F.lit("p").alias("side"), F.col(vector).cast("array<double>").alias("embedding")))


def normalised(df: DataFrame, vector: str, norm: str = "l2") -> Column:
    """Rows scaled to length 1 under the L2 or L1 norm; zero rows stay."""
    x = F.col(vector)
    size = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v * v if norm == "l2" else F.abs(v)))
    size = F.sqrt(size) if norm == "l2" else size
    return F.transform(x, lambda v: F.when(size > 0, v / size).otherwise(v))


def components_for(explained: list[float], threshold: float) -> int:
    """Components up to the first at which the cumulated share reaches ``threshold``."""
    total = 0.0
    for i, x in enumerate(explained, 1):
        total += x
        if total >= threshold:
            return i
    return len(explained)


def quantise(df: DataFrame, clusters: int, explained: float = 0.9, norm: str = "l2", redo: int = 5, iterations: int = 500, seed: int = 25, fit_rows: int | None = None) -> DataFrame:
    """(side, bin): PCA on the joint rows, then the best of ``redo`` k-means fits.

    ``fit_rows`` bounds the rows of the PCA fit (a documented sample by chance); every row is then transformed.
    """
    vectors = df.select("side", array_to_vector("embedding").alias("raw"))
    unit = (Normalizer(p=2.0 if norm == "l2" else 1.0, inputCol="raw", outputCol="unit").transform(vectors) if norm else vectors.withColumnRenamed("raw", "unit")).select("side", "unit").persist()
    sample = unit if fit_rows is None else unit.sample(min(1.0, fit_rows / max(1, unit.count())), seed)
    width = len(unit.select(vector_to_array("unit").alias("v")).first()["v"])
    pca = PCA(k=width, inputCol="unit", outputCol="rotated").fit(sample)
    kept = components_for(list(pca.explainedVariance), explained)
    reduced = pca.transform(unit).select("side", array_to_vector(F.slice(vector_to_array("rotated"), 1, kept)).alias("features")).persist()
    fits = [KMeans(k=clusters, seed=seed + i, maxIter=iterations, featuresCol="features", predictionCol="bin").fit(reduced) for i in range(redo)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(reduced).select("side", "bin")


def histograms(bins: DataFrame, clusters: int | None = None) -> DataFrame:
    """(bin, p, q): shares of each side over all bins, zeros kept."""
    counts = bins.groupBy("bin").agg(F.count_if(F.col("side") == "p").alias("np"), F.count_if(F.col("side") == "q").alias("nq"))
    if clusters:
        counts = bins.sparkSession.range(clusters).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0)
    return counts.select("bin", (F.col("np") / F.sum("np").over(W.partitionBy())).alias("p"), (F.col("nq") / F.sum("nq").over(W.partitionBy())).alias("q"))


def _kl(a: Column, b: Column) -> Column:
    return F.sum(F.when(a == 0, 0.0).when(b == 0, float("inf")).otherwise(a * F.log(a / b)))


def divergence_curve(hist: DataFrame, points: int = 25, scale: float = 5.0) -> DataFrame:
    """(i, x, y): exp(-scale KL) of both histograms to their mixtures, with the two end points."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(i.alias("i"), (1e-6 + (1 - 2e-6) * i / (points - 1)).alias("w"))))
    each = hist.select("p", "q", grid.alias("g")).select("p", "q", "g.i", "g.w")
    mix = F.col("w") * F.col("p") + (1 - F.col("w")) * F.col("q")
    inner = each.groupBy("i").agg(F.exp(-scale * _kl(F.col("q"), mix)).alias("x"), F.exp(-scale * _kl(F.col("p"), mix)).alias("y"))
    ends = hist.sparkSession.createDataFrame([(-1, 0.0, 1.0), (points, 1.0, 0.0)], "i int, x double, y double")
    return inner.unionByName(ends)


def area(curve: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Trapezoid area under a falling curve of few points, sorted by ``x``; among equal ones the higher comes first."""
    own = W.orderBy(F.col(x), F.col(y).desc())
    step = (F.col(x) - F.lag(x).over(own)) * (F.col(y) + F.lag(y).over(own)) / 2
    return curve.select(step.alias("_a")).agg(F.sum("_a").alias("area"))


def score(hist: DataFrame, points: int = 25, scale: float = 5.0) -> DataFrame:
    """(mauve, frontier_integral) of two aligned histograms."""
    curve = divergence_curve(hist, points, scale)
    one = area(curve).select(F.col("area").alias("a"))
    two = area(curve, "y", "x").select(F.col("area").alias("b"))
    p, q = F.col("p"), F.col("q")
    term = F.when((p == 0) & (q == 0), 0.0).when(p == 0, q / 4).when(q == 0, p / 4).when(F.abs(p - q) > 1e-8, (p + q) / 4 + p * q * (F.log(q) - F.log(p)) / (2 * (p - q))).otherwise(0.0)
    frontier = hist.agg((2 * F.sum(term)).alias("frontier_integral"))
    return one.crossJoin(two).crossJoin(frontier).select(((F.col("a") + F.col("b")) / 2).alias("mauve"), "frontier_integral")  # one row each


#: Buckets by the rule of a tenth of the smaller side at most: beyond it k-means would grow with the square of the rows.
MOST_BUCKETS = 5000


def buckets(n_real: int, n_synthetic: int) -> int:
    """A tenth of the smaller side; more than ``MOST_BUCKETS`` are an error, and the number must be given."""
    k = max(2, round(min(n_real, n_synthetic) / 10))
    if k > MOST_BUCKETS:
        raise ValueError(f"{k} buckets by the rule; above {MOST_BUCKETS} give ``clusters``")
    return k


def mauve(real: DataFrame, synthetic: DataFrame, vector: str = "embedding", clusters: int | None = None, **quantising) -> DataFrame:
    """MAUVE of two tables of embeddings; k-means starts differ between libraries, so scores agree within a band."""
    k = clusters or buckets(real.count(), synthetic.count())
    return score(histograms(quantise(joint(real, synthetic, vector), k, **quantising), k))
