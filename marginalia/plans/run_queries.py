"""Queries of whole runs: templates and recipes by name, sinks that go on after a break, checkpoints, rewards, stages."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import functions as F

from marginalia.functions import prompts, rewards, services
from marginalia.functions.text import fill_template
from marginalia.plans import ingest_queries, pipeline
from marginalia.plans.catalogue import Catalogue, table
from marginalia.session import work_dir
from marginalia.sources import files
from marginalia.sources.registry import DATASETS, TEMPLATES, Recipe

CATALOGUE = Catalogue()
query = CATALOGUE.query


def _folder(spark, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# templates and recipes


def _filled_sql(template: str, values: dict[str, str]) -> str:
    out = _quoted(template)
    for name, sql in values.items():
        out = f"replace({out}, '{{{name}}}', coalesce({sql}, ''))"
    return out


_FIELDS = {"feature": "n_name", "token_counts": "n_nationkey::VARCHAR", "category": "n_name", "title": "n_name"}


@query("F18_templates_by_name", " UNION ALL ".join(f"SELECT {_quoted(n)} AS name, n_nationkey, {_filled_sql(t, _FIELDS)} AS prompt FROM nation" for n, t in TEMPLATES.items()))
def f18(spark, d):
    """All templates by name, filled for every nation."""
    values = {"feature": F.col("n_name"), "token_counts": F.col("n_nationkey"), "category": F.col("n_name"), "title": F.col("n_name")}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), fill_template(t, values).alias("prompt")) for n, t in TEMPLATES.items()]))
    return table(spark, d, "nation").select("n_nationkey", each.alias("t")).select("t.name", "n_nationkey", "t.prompt")


_JSON = "'{\"category\": \"' || coalesce(category, '') || '\", \"token_counts\": ' || coalesce(n_chars, 0) || '}'"
_RECIPE_COLUMNS = {"content": "text", "note": "text", "abstract": "text", "text": "text", "summary": "title", "extracted_features": "title", "extracted_schema": "title", "topic_keywords": "category", "schema": "title", "category": "category", "selected_schema": "selected_schema"}


def _recipe_sql(name: str, r: Recipe) -> str:
    answer = _RECIPE_COLUMNS[r.answer]
    feature = _RECIPE_COLUMNS.get(r.feature, "''")
    if r.kind == "json":
        instruction = _filled_sql(r.template, {"token_counts": "coalesce(n_chars, 0)::VARCHAR", "category": "coalesce(category, '')", "title": "NULL"})
    else:
        instruction = _filled_sql(r.template, {"feature": feature} if r.kind == "column" else {})
    if r.kind == "joined":
        answer = f"'{r.keys[0]}: ' || {feature} || chr(10) || '{r.keys[1]}: ' || {answer}"
    return f"SELECT {_quoted(name)} AS name, count(*) AS rows, count({answer}) AS answers, sum(length({instruction}))::BIGINT AS instruction_chars FROM src"


@query("P20_dataset_registry", f"WITH src AS (SELECT *, {_JSON} AS selected_schema FROM documents) " + " UNION ALL ".join(_recipe_sql(n, r) for n, r in DATASETS.items()))
def p20(spark, d):
    """Every named dataset's recipe over one table: rows, answers and characters of instruction."""
    selected = F.concat(F.lit('{"category": "'), F.coalesce("category", F.lit("")), F.lit('", "token_counts": '), F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit("}"))
    src = table(spark, d, "documents").withColumn("selected_schema", selected)
    src = src.select(*[F.col(c).alias(name) for name, c in _RECIPE_COLUMNS.items()])
    out = None
    for name, r in DATASETS.items():
        one = prompts.pairs(src, r).agg(F.count(F.lit(1)).alias("rows"), F.count("answer").alias("answers"), F.sum(F.length("instruction")).alias("instruction_chars")).select(F.lit(name).alias("name"), "rows", "answers", "instruction_chars")
        out = one if out is None else out.unionByName(one)
    return out


# sources


@query("S16_anchor_pairs", "SELECT pair_id % 7 AS kind, count(*) AS rows, sum(length(instruction))::BIGINT AS chars, max(r)::INT AS last FROM (SELECT pair_id, instruction, unnest(range(2)) AS r FROM instruct_pairs WHERE instruction IS NOT NULL AND answer IS NOT NULL) GROUP BY 1")
def s16(spark, d):
    """Anchor pairs, each twice."""
    df = table(spark, d, "instruct_pairs").filter("instruction IS NOT NULL AND answer IS NOT NULL")
    pairs = files.anchor_pairs(df.select(F.concat_ws("\x01", F.col("pair_id").cast("string"), "instruction").alias("prompt"), F.col("answer").alias("completion")), 2)
    key = F.substring_index("instruction", "\x01", 1)
    rows = pairs.select((key.cast("bigint") % 7).alias("kind"), (F.length("instruction") - F.length(key) - 1).alias("n"), "repeat")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("chars"), F.max("repeat").alias("last"))


@query("S17_listed_names", "SELECT DISTINCT p_brand FROM part WHERE starts_with(p_brand, 'Brand#1')")
def s17(spark, d):
    """Names that begin with a prefix."""
    return files.name_starts(table(spark, d, "part").select("p_brand").distinct(), "Brand#1", "p_brand")


@query("S09_whole_texts", "SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) AS text FROM region")
def s09(spark, d):
    """Texts of all files of a folder, in the order of their names."""
    root = _folder(spark, "texts")
    for r in sorted(table(spark, d, "region").select("r_regionkey", "r_name").collect()):  # five rows
        files.write_text(spark, r.r_name, f"{root}/part={r.r_regionkey}")
    return spark.createDataFrame([(files.read_whole(spark, root),)], "text string")


# sinks


@query("K04_clean_copy", "SELECT event_type AS abstract, replace(props, ' ', '') AS schema FROM events")
def k04(spark, d):
    """Text and inferred schema, compact."""
    return files.clean_copy(table(spark, d, "events"), "event_type", "props")


@query("K05_batched_csv", "SELECT c_mktsegment AS segment, count(*) AS rows, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1")
def k05(spark, d):
    """CSV written batch by batch, broken off and gone on with: each batch once."""
    path, df = _folder(spark, "batches"), table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"))
    files.write_batches(df.filter("segment < 'F'"), path, "segment")
    files.write_batches(df, path, "segment")
    back = files.read_csv(spark, path)
    return back.groupBy("segment").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("c_custkey").cast("bigint")).alias("keys"))


@query("K07_matrix_round_trip", "SELECT vec_id AS row, len(embedding)::INT AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def k07(spark, d):
    """A matrix written and read again."""
    path = _folder(spark, "matrix")
    files.write_matrix(table(spark, d, "embeddings"), path, "vec_id", "embedding")
    total = F.aggregate(F.transform("values", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return files.read_matrix(spark, path).select("row", F.size("values").alias("width"), F.round(total, 4).alias("total"))


@query("K08_epoch_metrics", "SELECT year(o_orderdate)::INT AS epoch, count(*) AS step, round(avg(o_totalprice), 2) AS train_loss FROM orders GROUP BY 1")
def k08(spark, d):
    """Metrics by epoch; a run that starts again replaces only its own epochs."""
    path = _folder(spark, "metrics")
    by = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("epoch")).agg(F.count(F.lit(1)).alias("step"), F.round(F.avg("o_totalprice"), 2).alias("train_loss"))
    files.write_metrics(by.withColumn("step", F.lit(0).cast("bigint")), path)
    files.write_metrics(by.filter("epoch % 2 = 0"), path)
    files.write_metrics(by.filter("epoch % 2 <> 0"), path)
    return spark.read.schema("step bigint, train_loss double, epoch int").json(path).select("epoch", "step", "train_loss")


@query("K10_resumed_checkpoint", "SELECT o_orderpriority, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS code, count(*) AS rows, 12 AS checkpoint FROM orders GROUP BY 1")
def k10(spark, d):
    """A model saved under several checkpoints; the newest is loaded and used."""
    path, df = _folder(spark, "model"), table(spark, d, "orders").select("o_orderpriority")
    for number, order in ((3, "alphabetDesc"), (12, "alphabetAsc")):
        files.save_checkpoint(StringIndexer(inputCol="o_orderpriority", outputCol="code", stringOrderType=order).fit(df), path, number)
    number, model = files.newest_model(spark, path, StringIndexerModel)
    return model.transform(df).groupBy("o_orderpriority", "code").agg(F.count(F.lit(1)).alias("rows")).withColumn("checkpoint", F.lit(number))


# generation, rewards, stages


@query("X08_unconditional_generation", "SELECT range AS id, 'Write a text.' AS query, 'a b a b' AS generated_text FROM range(1000)")
def x08(spark, d):
    """Texts for copies of one prompt, from a pluggable generator."""
    service = services.text_service(lambda: services.word_chain({"": ["a"], "a": ["b"]}, 4), failed=None)
    return files.constant_prompts(spark, TEMPLATES["uncond_generation"], 1000).withColumn("generated_text", service("query"))


_FILM = '{"title": "x", "year": 1, "cast": [], "genres": [], "href": "y"'


@query("X10_named_rewards", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 2e0 WHEN 1 THEN 1.4e0 ELSE -1e0 END AS reward FROM part")
def x10(spark, d):
    """The structural reward by its name."""
    kind = F.col("p_size") % 3
    text = F.when(kind == 0, _FILM + ', "extract": "z"}').when(kind == 1, _FILM + "}").otherwise("[]")
    return table(spark, d, "part").select("p_partkey", F.round(rewards.reward("movie-json", F.lit("Write one film."), text), 4).alias("reward"))


@query("X11_judged_rewards", f"SELECT n_nationkey, (length({_filled_sql(rewards.JUDGES['llmjudge'], {'condition': 'n_name', 'response': 'n_name'})}) % 10 + 1)::DOUBLE AS score FROM nation")
def x11(spark, d):
    """Scores of a judge, here a client that counts characters."""
    name = F.col("n_name")
    judge = lambda: lambda prompt: f'{{"holistic_score": {len(prompt) % 10 + 1}}}'
    return table(spark, d, "nation").select("n_nationkey", rewards.reward(rewards.named_reward("/models/llmjudge/7b"), name, name, judge).alias("score"))


_REWARDED = "r AS (SELECT event_id, event_id // 64 AS step, CASE WHEN event_type = 'click' THEN 2e0 ELSE 1.4e0 END AS reward FROM events), b AS (SELECT step, avg(reward) AS mean, stddev_samp(reward) AS std FROM r GROUP BY 1), t AS (SELECT step, avg(mean) OVER w AS m, avg(std) OVER w AS s FROM b WINDOW w AS (ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"


@query("X14_rollout_loop", f"WITH {_REWARDED} SELECT event_id, step, reward, round((reward - m) / (s + 1e-8), 4) AS scaled FROM r JOIN t USING (step)")
def x14(spark, d):
    """Rollouts of a policy, their rewards, and the rewards scaled by the last ten batches."""
    events = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 64).alias("step"), F.col("event_type").alias("prompt"))
    policy = lambda prompt: F.when(prompt == "click", _FILM + ', "extract": "z"}').otherwise(_FILM + "}")
    out = rewards.rollout_rewards(events, "step", "prompt", policy, "movie-json")
    return out.select("event_id", "step", F.round("reward", 4).alias("reward"), F.round("scaled", 4).alias("scaled"))


@query("X19_parse_stage", f"SELECT reason, count(*) AS records FROM ({ingest_queries.CATALOGUE.sql['p1_found']}) GROUP BY 1 UNION ALL SELECT 'loaded', count(DISTINCT row_id) - (SELECT count(*) FROM ({ingest_queries.CATALOGUE.sql['p1_found']})) FROM synthetic_features")
def x19(spark, d):
    """The parsing stage of a run, by its name, from files to files."""
    root = _folder(spark, "stage")
    pipeline.STAGES["parse"](spark, f"{d}/synthetic_features.parquet", f"{d}/feature_domain.parquet", f"{root}/loaded", f"{root}/failed")
    failed = spark.read.parquet(f"{root}/failed").groupBy("reason").agg(F.count(F.lit(1)).alias("records"))
    return failed.unionByName(spark.read.parquet(f"{root}/loaded").agg(F.lit("loaded").alias("reason"), F.count(F.lit(1)).alias("records")))
