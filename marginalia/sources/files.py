"""Readers and writers: dispatch by extension, splits, whole texts, resumable appends, reports."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.prompts import pairs, split_of
from marginalia.functions.text import canonical_json, checkpoint_number
from marginalia.session import bounded_rows
from marginalia.sources.registry import recipe

#: The null value stands for cells without quotes only; quoted empty ones stay empty.
_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "nullValue": "\ue000null\ue000"}


def read_csv(spark: SparkSession, path: str, infer: bool = False, **options) -> DataFrame:
    """Header, quotes doubled inside quotes, line breaks inside quotes; missing cells are null, quoted empty ones empty. Types are text unless asked for."""
    return spark.read.options(**_CSV, inferSchema=infer, **options).csv(path)


def read_jsonl(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By extension: csv, json lines, parquet, orc or text; anything else is an error."""
    kind = Path(path.rstrip("/")).suffix.lower()
    readers = {".csv": read_csv, ".jsonl": read_jsonl, ".json": read_jsonl, ".parquet": lambda s, p: s.read.parquet(p), ".orc": lambda s, p: s.read.orc(p), ".txt": lambda s, p: s.read.text(p)}
    if kind not in readers:
        raise ValueError(f"cannot read {path!r}: unknown kind {kind!r}")
    return readers[kind](spark, path)


def read_whole(spark: SparkSession, path: str, most: int = 1000) -> str:
    """A small text (a prompt, a schema) as a whole; of a folder all files, at most ``most``, in the order of their names."""
    files = spark.read.text(path, wholetext=True).select("_metadata.file_path", "value")
    return "\n".join(r.value.removesuffix("\n") for r in sorted(bounded_rows(files, most, f"files of {path}")))


def anchor_pairs(df: DataFrame, repeats: int = 1, prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """(instruction, answer, repeat) of anchor pairs that go into training ``repeats`` times, in one split; pairs without either part are left out."""
    rows = df.select(F.col(prompt).alias("instruction"), F.col(completion).alias("answer")).dropna()
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))) if repeats > 0 else rows.limit(0).withColumn("repeat", F.lit(0))


def name_starts(names: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    """Listed models whose name begins with ``prefix``."""
    return names.filter(F.startswith(F.col(name), F.lit(prefix)))


def read_splits(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Files of several splits, maybe of different kinds and columns, as one table with ``split``."""
    out = None
    for name, path in paths.items():
        one = read_table(spark, path).withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def load_dataset(spark: SparkSession, name: str, paths: Mapping[str, str] | Mapping[str, DataFrame], split: str, template: str | None = None) -> DataFrame:
    """(instruction, answer) of a split of a named dataset, from files or from tables at hand."""
    r = recipe(name)
    tables = {s: p if isinstance(p, DataFrame) else read_table(spark, p) for s, p in paths.items()}
    wanted = {s: t for s, t in tables.items() if s == split} or {s: t for s, t in tables.items() if split_name(s) == split_name(split)}
    if not wanted:
        raise KeyError(f"{name} has no split {split!r}")
    return pairs(next(iter(wanted.values())), r, template)


def split_name(name: str) -> str:
    return "train" if name == "train" else "validation" if name in ("validation", "valid", "val", "dev", "eval") else "test"


def constant_prompts(spark: SparkSession, prompt: str, n: int) -> DataFrame:
    """``n`` copies of a prompt, numbered."""
    return spark.range(n).select("id", F.lit(prompt).alias("query"))


def newest_checkpoint(paths: DataFrame, path: str = "path") -> DataFrame:
    """(epoch): the largest checkpoint number among paths, -1 without any."""
    return paths.agg(F.coalesce(F.max(checkpoint_number(F.col(path))), F.lit(-1)).alias("epoch"))


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).options(header=True, escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).options(ignoreNullFields=False).json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def clean_copy(df: DataFrame, text: str, inferred: str, text_name: str = "abstract", schema_name: str = "schema") -> DataFrame:
    """Two columns of an annotated table: the text, and its inferred schema as compact JSON, or as it is where it is none."""
    return df.select(F.col(text).alias(text_name), canonical_json(inferred).alias(schema_name))


def write_batches(df: DataFrame, path: str, batch: str) -> int:
    """Append ``df`` as CSV batch by batch, each batch once however often a run starts again; the number of batches written.

    Batches are folders, so a batch that was broken off is written anew and nothing is read back but names.
    """
    spark = df.sparkSession
    done = set()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(where):
        done = {s.getPath().getName().partition("=")[2] for s in system.listStatus(where) if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))}
    todo = [r[0] for r in bounded_rows(df.select(F.col(batch).cast("string")).distinct(), 100_000, "batches") if r[0] not in done]
    for name in sorted(todo):
        write_csv(df.filter(F.col(batch).cast("string") == name).drop(batch), f"{path}/{batch}={name}", "overwrite")
    return len(todo)


def write_matrix(df: DataFrame, path: str, key: str, vector: str) -> None:
    """A dense matrix as rows of arrays in Parquet."""
    df.select(F.col(key).alias("row"), F.col(vector).cast("array<float>").alias("values")).write.parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, values) of a matrix; rows of another length than the first are an error."""
    rows = spark.read.parquet(path)
    width = rows.agg(F.min(F.size("values")).alias("_a"), F.max(F.size("values")).alias("_b")).first()
    if width[0] != width[1]:
        raise ValueError(f"rows of {width[0]} to {width[1]} entries are no matrix")
    return rows


def write_metrics(metrics: DataFrame, path: str, epoch: str = "epoch") -> None:
    """Metrics as JSON lines, a folder for each epoch, so that a new run of an epoch replaces only its own."""
    spark = metrics.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        metrics.write.mode("overwrite").partitionBy(epoch).json(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def save_checkpoint(model, path: str, number: int) -> str:
    """A fitted model under the number of its checkpoint; where it lies."""
    where = f"{path}/checkpoint-{number}"
    model.write().overwrite().save(where)
    return where


def newest_model(spark: SparkSession, path: str, kind: type):
    """(number, model) of the newest checkpoint in a folder, (-1, None) without any."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    number = max((int(n.rpartition("-")[2]) for n in names if n.startswith("checkpoint-")), default=-1)
    return (number, kind.load(f"{path}/checkpoint-{number}")) if number >= 0 else (-1, None)


def record_json(df: DataFrame, name: str = "generated_text") -> DataFrame:
    """Each row as one JSON text, nulls kept."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias(name))


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key ``path`` does not hold yet, so an interrupted run goes on; the number appended."""
    spark = df.sparkSession
    done = None
    try:
        done = spark.read.schema(df.schema).json(path).select(key)
    except Exception as e:  # noqa: BLE001 - a first run has no such folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rest = df if done is None else df.join(done, key, "left_anti")
    rest = rest.persist()
    n = rest.count()
    rest.write.mode("append").json(path)
    rest.unpersist()
    return n


def with_splits(df: DataFrame, column: str = "split") -> DataFrame:
    """``df`` with its split names brought to train, validation and test."""
    return df.withColumn(column, split_of(F.col(column)))


def scheme_file(n: int, epsilon: float, delta: float, stages: str) -> str:
    """Name of a scheme table, from its parameters."""
    return f"schemes_{stages}_n{n}_eps{epsilon:g}_delta{delta:.3g}.csv"
