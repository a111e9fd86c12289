from __future__ import annotations

import pytest
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import functions as F

from marginalia.functions import rewards, services
from marginalia.plans import pipeline
from marginalia.sources import files, registry


def test_templates_and_recipes_by_name():
    assert len(registry.TEMPLATES) == 25 and len(registry.DATASETS) == 31
    assert registry.template("uncond_generation") and registry.recipe("biorxiv-complex8-condgen").feature == "schema"
    with pytest.raises(KeyError):
        registry.template("none")


def test_batches_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "n int, part string")
    path = f"file://{tmp_path}/out"
    assert files.write_batches(df.filter("part = 'a'"), path, "part") == 1
    assert files.write_batches(df, path, "part") == 1 and files.write_batches(df, path, "part") == 0
    assert files.read_csv(spark, path).count() == 6
    assert files.write_batches(df.limit(0), f"{path}-none", "part") == 0


def test_matrices_have_one_width(spark, tmp_path):
    good = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "k int, v array<double>")
    files.write_matrix(good, f"file://{tmp_path}/m", "k", "v")
    assert files.read_matrix(spark, f"file://{tmp_path}/m").count() == 2
    files.write_matrix(good.withColumn("v", F.when(F.col("k") == 1, F.array(F.lit(1.0))).otherwise(F.col("v"))), f"file://{tmp_path}/bad", "k", "v")
    with pytest.raises(ValueError):
        files.read_matrix(spark, f"file://{tmp_path}/bad")


def test_metrics_of_an_epoch_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/metrics"
    files.write_metrics(spark.createDataFrame([(0, 2.0), (1, 1.0)], "epoch int, loss double"), path)
    files.write_metrics(spark.createDataFrame([(1, 0.5)], "epoch int, loss double"), path)
    assert sorted((r.epoch, r.loss) for r in spark.read.json(path).collect()) == [(0, 2.0), (1, 0.5)]


def test_newest_model(spark, tmp_path):
    path = f"file://{tmp_path}/models"
    assert files.newest_model(spark, path, StringIndexerModel) == (-1, None)
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    for n in (2, 10):
        files.save_checkpoint(StringIndexer(inputCol="t", outputCol=f"c{n}").fit(df), path, n)
    number, model = files.newest_model(spark, path, StringIndexerModel)
    assert number == 10 and model.getOutputCol() == "c10"


def test_all_files_of_a_folder_are_read(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.txt").write_text(f"part {i}\n")
    assert files.read_whole(spark, f"file://{tmp_path}") == "part 0\npart 1\npart 2\npart 3"
    with pytest.raises(ValueError):
        files.read_whole(spark, f"file://{tmp_path}", most=3)


def test_csv_keeps_empty_and_missing_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, ""), (2, None), (3, 'a "b"\r\n, c')], "k int, t string")
    files.write_csv(df, f"file://{tmp_path}/c")
    assert sorted((r.k, r.t) for r in files.read_csv(spark, f"file://{tmp_path}/c").collect()) == [("1", ""), ("2", None), ("3", 'a "b"\r\n, c')]


def test_anchor_pairs(spark):
    df = spark.createDataFrame([("p", "c"), (None, "c"), ("p", None)], "prompt string, completion string")
    assert files.anchor_pairs(df, 3).count() == 3 and files.anchor_pairs(df, 0).count() == 0


def test_judges_that_fail_give_null(spark):
    def judge():
        def ask(prompt: str) -> str:
            if "bad" in prompt:
                return "no score here"
            return '{"holistic_score": "7"}'

        return ask

    df = spark.createDataFrame([("q", "fine"), ("q", "bad"), (None, None)], "q string, t string")
    got = [r.s for r in df.select(rewards.reward("llmjudge_biorxiv", F.col("q"), F.col("t"), judge).alias("s")).collect()]
    assert got == [7.0, None, 7.0]
    with pytest.raises(KeyError):
        rewards.reward("none", F.col("q"), F.col("t"))
    with pytest.raises(ValueError):
        rewards.reward("llmjudge", F.col("q"), F.col("t"))
    assert rewards.named_reward("/m/llmjudge_biorxiv-8b") == "llmjudge_biorxiv" and rewards.named_reward("/m/movie-json") == "movie-json"
    assert services.with_retries(lambda t: 1 / 0, 2, pause=lambda s: None, failed=None)("x") is None


def test_rollouts_are_rewarded_and_scaled(spark):
    film = '{"title":1,"year":1,"cast":1,"genres":1,"href":1,"extract":1}'
    df = spark.createDataFrame([(i, i // 4, "ab"[i % 2]) for i in range(16)], "k int, step int, prompt string")
    out = rewards.rollout_rewards(df, "step", "prompt", lambda p: F.when(p == "a", film).otherwise("[]"), "movie-json").collect()
    assert {(r.prompt, round(r.reward, 6)) for r in out} == {("a", 2.0), ("b", -1.0)} and all((r.scaled > 0) == (r.prompt == "a") for r in out)


def test_stages_by_name(spark, tmp_path):
    raw = spark.createDataFrame([(1, '{"a":"x"}'), (2, "{}")], "row_id long, generated_text string")
    raw.write.parquet(f"file://{tmp_path}/raw.parquet")
    spark.createDataFrame([("a", "x")], "feature_name string, option_text string").write.parquet(f"file://{tmp_path}/domain.parquet")
    pipeline.STAGES["parse"](spark, f"file://{tmp_path}/raw.parquet", f"file://{tmp_path}/domain.parquet", f"file://{tmp_path}/good", f"file://{tmp_path}/bad")
    assert spark.read.parquet(f"file://{tmp_path}/good").collect()[0].a == "x" and spark.read.parquet(f"file://{tmp_path}/bad").collect()[0].reason == "columns"
    assert pipeline.main(["none"]) == 2
