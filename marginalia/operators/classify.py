"""Text classification: a trainable pipeline and its scores."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classifier(text: str, label: str, dimensions: int = 1 << 14, iterations: int = 30) -> Pipeline:
    """Words, hashed counts, inverse document frequencies, logistic regression: a stand-in for a fine-tuned encoder."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip"),
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{Nd}]+"),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions),
            IDF(inputCol="_counts", outputCol="_features"),
            LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_predicted", maxIter=iterations, regParam=0.01),
        ]
    )


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction`` as a label."""
    labels = model.stages[0].labels
    out = model.transform(df)
    return out.select(*df.columns, F.element_at(F.array(*map(F.lit, labels)), F.col("_predicted").cast("int") + 1).alias("prediction"))


def scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(accuracy, precision, recall, f1): plain means over the classes that occur as label or prediction."""
    cells = df.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    each = cells.select(F.explode(F.array(F.struct(F.col("l").alias("c"), F.lit(1).alias("is_l"), F.lit(0).alias("is_p")), F.struct(F.col("p").alias("c"), F.lit(0).alias("is_l"), F.lit(1).alias("is_p")))).alias("e"), "n", (F.col("l") == F.col("p")).alias("hit"))
    by = each.groupBy("e.c").agg(F.sum(F.when(F.col("e.is_l") == 1, F.col("n")).otherwise(0)).alias("actual"), F.sum(F.when(F.col("e.is_p") == 1, F.col("n")).otherwise(0)).alias("said"), F.sum(F.when(F.col("hit") & (F.col("e.is_l") == 1), F.col("n")).otherwise(0)).alias("hits"))
    precision = F.when(F.col("said") > 0, F.col("hits") / F.col("said")).otherwise(0.0)
    recall = F.when(F.col("actual") > 0, F.col("hits") / F.col("actual")).otherwise(0.0)
    f1 = F.when(F.col("hits") > 0, 2 * F.col("hits") / (F.col("said") + F.col("actual"))).otherwise(0.0)
    return by.agg((F.sum("hits") / F.sum("actual")).alias("accuracy"), F.avg(precision).alias("precision"), F.avg(recall).alias("recall"), F.avg(f1).alias("f1"))
