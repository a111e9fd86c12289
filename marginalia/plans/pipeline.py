"""Stages of a run by name, each a function of a session and its paths: ``python -m marginalia.plans.pipeline STAGE key=value ...``."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marginalia.functions import services
from marginalia.operators import aim, divergence, mauve
from marginalia.operators.encoding import Categorical
from marginalia.operators.ingest import domain_options, split_load
from marginalia.session import get_spark, written_tables
from marginalia.sources import files


def parse(spark: SparkSession, source: str, domain: str, loaded: str, failed: str, key: str = "row_id", text: str = "generated_text") -> None:
    """Records of ``source`` as columns, and those that do not load with their reason."""
    good, bad = split_load(files.read_table(spark, source), key, text, domain_options(files.read_table(spark, domain)))
    good.write.mode("overwrite").parquet(loaded)
    bad.write.mode("overwrite").parquet(failed)


def synthesize(spark: SparkSession, source: str, domain: str, output: str, rho: str = "0.18", rows: str = "") -> None:
    """Synthetic rows of the features of ``domain`` under a budget, as JSON texts."""
    options = domain_options(files.read_table(spark, domain))
    domains = {c: Categorical(tuple(v)) for c, v in options.items()}
    out = aim.synthesize(files.read_table(spark, source), domains, rho=float(rho), rows=int(rows) if rows else None)
    files.write_csv(files.record_json(out), output, "overwrite")


def embed(spark: SparkSession, source: str, output: str, key: str = "doc_id", text: str = "text") -> None:
    """Vectors of the texts of ``source``."""
    rows = files.read_table(spark, source)
    files.write_matrix(rows.select(key, services.hashed_embedding()(text).alias("embedding")), output, key, "embedding")


def compare(spark: SparkSession, real: str, synthetic: str, output: str) -> None:
    """MAUVE of two matrices."""
    sides = [files.read_matrix(spark, p).withColumnRenamed("values", "embedding") for p in (real, synthetic)]
    mauve.mauve(*sides).write.mode("overwrite").json(output)


def diverge(spark: SparkSession, real: str, synthetic: str, output: str, columns: str) -> None:
    """Distances of the columns (separated by commas) of two tables."""
    sides = [files.read_table(spark, p) for p in (real, synthetic)]
    files.write_csv(divergence.category_divergence(*sides, columns.split(",")).withColumn("columns", F.lit(columns)), output, "overwrite")


STAGES: dict[str, Callable[..., None]] = {f.__name__: f for f in (parse, synthesize, embed, compare, diverge)}


def main(args: list[str]) -> int:
    if not args or args[0] not in STAGES:
        print(f"stages: {', '.join(STAGES)}", file=sys.stderr)
        return 2
    spark = get_spark(args[0])
    with written_tables(spark):
        STAGES[args[0]](spark, **dict(a.split("=", 1) for a in args[1:]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
