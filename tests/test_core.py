from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import prompts, services, text
from marginalia.operators import accounting, aim, classify, divergence, encoding, graphical, marginals, mauve, private_training, rollouts, sampling, tokenised
from marginalia.operators.encoding import Categorical, Numerical
from marginalia.sources import files, registry
from marginalia.streaming import steps


def column(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


# encodings


def test_encoder(spark):
    e = encoding.categorical(Categorical((None, "A", "B", "C", "D", "F"), 0))
    assert column(spark, [None, "A", "F", "typo"], "string", e.forward) == [0, 1, 5, 0]
    assert column(spark, [0, 3], "int", e.inverse) == [None, "C"]
    first = encoding.categorical(Categorical(("A", "B")))
    assert column(spark, [None, "x", "B"], "string", first.forward) == [0, 0, 1]


def test_bins(spark):
    e = encoding.uniform_bins(Numerical(0, 100), 5)
    assert column(spark, [50.0, 40.0, 105.0, -3.0, None, 0.0, 100.0, 20.0], "double", e.forward) == [2, 1, 4, 0, 0, 0, 4, 0]
    assert column(spark, ["50", "abc", "NaN"], "string", e.forward) == [2, 0, 0]
    outside = encoding.bins(Numerical(0, 10, clip=False), [5])
    assert column(spark, [-1.0, 11.0, None, 5.0, 6.0], "double", outside.forward) == [0, 0, 0, 1, 2]
    assert column(spark, [0, 1, 2], "int", outside.inverse)[0] is None


def test_bins_hold_their_middles(spark):
    for domain in (Numerical(0, 100), Numerical(1, 50, kind="int"), Numerical(-3, 9, clip=False)):
        e = encoding.uniform_bins(domain, 4)
        codes = list(range(1 if not domain.clip else 0, e.size))
        back = column(spark, codes, "int", e.inverse)
        assert column(spark, back, "double", e.forward) == codes


def test_rare_merge(spark):
    e = encoding.merge_rare([True, False, True, False])
    assert e.size == 3 and column(spark, [0, 1, 2, 3], "int", e.forward) == [2, 0, 2, 1]
    back = column(spark, [0, 1, 2, 2, 2, 2], "int", e.inverse)
    assert back[:2] == [1, 3] and set(back[2:]) <= {0, 2}
    assert encoding.merge_rare([False, False]).size == 2 and encoding.merge_rare([True, True]).size == 1


def test_composition(spark):
    plus = encoding.Encoding(lambda c: c + 1, lambda c: c - 1, 0)
    twice = encoding.Encoding(lambda c: c * 2, lambda c: c / 2, 0)
    both = plus @ twice
    assert column(spark, [3], "int", both.forward) == [7] and column(spark, [7], "int", both.inverse) == [3.0]


@pytest.mark.parametrize("bad", [lambda: Categorical(()), lambda: Categorical(("a",), 1), lambda: Numerical(2, 1), lambda: Numerical(0, 1, kind="date"), lambda: encoding.bins(Numerical(0, 9), []), lambda: encoding.bins(Numerical(0, 9), [3, 3]), lambda: encoding.bins(Numerical(0, 9), [9]), lambda: encoding.merge_rare([0, 1])])
def test_refusals(bad):
    with pytest.raises(ValueError):
        bad()


# marginals


def test_closure_and_weights():
    assert marginals.closure([("a", "b"), ("a", "c")]) == [("a",), ("b",), ("c",), ("a", "b"), ("a", "c")]
    assert marginals.workload_weights({("a", "b"): 1.0, ("a", "c"): 2.0})[("a", "c")] == 5.0
    assert len(marginals.default_workload({f"c{i}": 10 for i in range(8)})) == 56
    assert marginals.default_workload({"a": 2, "b": 3}) == {("a", "b"): 1.0}


def test_marginals_add_up(spark):
    rnd = random.Random(0)
    df = spark.createDataFrame([(rnd.randint(0, 2), rnd.randint(0, 3), rnd.choice([0, 1])) for _ in range(500)], "a int, b int, c int")
    found = marginals.vectors(df, marginals.closure([("a", "b", "c")]), {"a": 3, "b": 4, "c": 2})
    assert all(x.sum() == 500 for x in found.values())
    assert np.array_equal(found[("a", "b", "c")].sum(2), found[("a", "b")])
    assert marginals.dense(df.limit(0), ("a", "c"), {"a": 3, "c": 2}).count() == 6


def test_keyed_noise_survives_repartitioning(spark):
    df = spark.range(2000).select(F.col("id"), marginals.keyed_normal(F.col("id"), seed=3).alias("z"))
    a, b = df.orderBy("id").collect(), spark.range(2000).repartition(7).select("id", marginals.keyed_normal(F.col("id"), seed=3).alias("z")).orderBy("id").collect()
    assert a == b
    z = np.array([r.z for r in a])
    assert abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.06


# divergence


def test_divergence_golden(spark):
    real = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "f string")
    synthetic = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "f string")
    r = divergence.category_divergence(real, synthetic, ["f"]).first()
    assert r.tvd == pytest.approx(0.375) and r.jsd == pytest.approx(0.379689, abs=1e-6) and (r.unique_real, r.unique_synth) == (2, 3)
    same = divergence.category_divergence(real, real, ["f"]).first()
    assert same.tvd == 0 and same.jsd == 0
    report = divergence.divergence_report(real.withColumn("g", F.lit("x")), synthetic.withColumn("g", F.lit("x")), ["f", "g", "missing"]).collect()
    assert sorted(x.metric for x in report) == ["2way", "f", "g"]


# accounting


@pytest.mark.parametrize(
    ("got", "want", "within"),
    [
        (lambda: accounting.delta_rule(28_846), 3.375635e-6, 1e-11),
        (lambda: accounting.first_stage_sigma(4, 3.38e-6, accounting.Stage(4.3, 2048 / 28_846, 1120)), 1.666659, 1e-5),
        (lambda: accounting.renyi_epsilon([accounting.Stage(4.3, 2048 / 28_846, 1120)], 3.38e-6), 2.63194, 1e-4),
        (lambda: accounting.training_sigma(4, 3.38e-6, 2048 / 28_846, 1120), 3.02304, 1e-4),
        (lambda: accounting.zcdp_rho(4, 3.38e-6), 0.341167, 1e-5),
        (lambda: accounting.zcdp_eps(0.18, 3.38e-6), 2.798836, 1e-5),
        (lambda: accounting.loss_epsilon([accounting.Stage(1.0)], 1e-5), 4.3772, 1e-3),
    ],
)
def test_budgets(got, want, within):
    assert got() == pytest.approx(want, abs=within)


def test_budget_edges():
    assert accounting.zcdp_delta(0, 1) == 0 and accounting.zcdp_eps(0.1, 1) == 0
    assert accounting.noise_multiplier(100, 1e-5, 0.1, 10) == 0
    assert math.isnan(accounting.second_stage_sigma(1.0, 1e-5, accounting.Stage(0.5), 0.1, 10))
    assert accounting.training_steps(28_846, 2048, 20) == 281 and accounting.accumulation(2048, 4, 2) == 256 and accounting.accumulation(1, 4, 2) == 1
    numeric, bound = (f([accounting.Stage(4.3, 0.07, 300)], 1e-6) for f in (accounting.loss_epsilon, accounting.renyi_epsilon))
    assert 0.5 * bound < numeric <= bound


# models


def test_model_size():
    assert graphical.model_megabytes({"a": 10, "b": 10, "c": 10}, [("a", "b"), ("a", "c")]) == 200 * 8 / 2**20


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10_000))
def test_inference_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    sizes = {c: int(rng.integers(2, 4)) for c in "abcde"}
    cliques = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")] if seed % 2 else [("a", "b"), ("d", "e")]
    model = graphical.Model(sizes, cliques, 50.0)
    for q in model.cliques:
        model.log[q] = rng.normal(size=[sizes[c] for c in q])
    model.calibrate()
    full = np.zeros([sizes[c] for c in "abcde"])
    for q in model.cliques:
        full = full + model._spread(model.log[q], q, tuple("abcde"))
    full = np.exp(full)
    full *= 50 / full.sum()
    for want in [("a",), ("d", "b"), ("a", "c", "e")]:
        axes = tuple(i for i, c in enumerate("abcde") if c not in want)
        kept = [c for c in "abcde" if c in want]
        assert np.allclose(model.project(want), np.transpose(full.sum(axis=axes), [kept.index(c) for c in want]))


def test_synthesis_resembles_the_data(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(4000):
        a = rnd.choice("xxxxy")
        rows.append((a, "p" if (a == "x") == (rnd.random() < 0.9) else "q", rnd.gauss(50, 10), None))
    df = spark.createDataFrame(rows, "a string, b string, n double, other string")
    domains = {"a": Categorical(("x", "y", "never")), "b": Categorical(("p", "q")), "n": Numerical(0, 100)}
    out = aim.synthesize(df, domains, rho=5.0, noise=aim.SeededNoise(2), seed=4, options=aim.Options(iterations=200, numeric_bins=8, max_rounds=10))
    assert abs(out.count() - 4000) < 100 and out.columns == ["a", "b", "n"]
    pairs = divergence.pair_divergence(df.select("a", "b"), out.select("a", "b"), ["a", "b"]).first()
    assert pairs.tvd < 0.05
    assert out.agg(F.avg("n")).first()[0] == pytest.approx(50, abs=3)
    with pytest.raises(ValueError):
        aim.synthesize(df, {}, rho=1.0)
    with pytest.raises(ValueError):
        aim.synthesize(df, {"nope": Categorical(("a",))}, rho=1.0)


def test_noise_sources():
    for noise in (aim.SystemNoise(), aim.SeededNoise(1)):
        z, g = noise.normal(2.0, 20_000), noise.gumbel(20_000)
        assert abs(z.std() - 2) < 0.1 and abs(g.mean() - 0.5772) < 0.05
    assert aim.choose([0.0, 50.0, 1.0], 10.0, 1.0, aim.SeededNoise(0)) == 1


def test_joint_counts_of_all_pairs(spark, tmp_path):
    import __spark_entry__
    from marginalia.plans.feature_queries import FEATURES

    values = [(i, *[None if (i + k) % 5 == 0 else f"v{(i * k) % 3}" for k in range(8)]) for i in range(30)]
    columns = ["record_id long"] + [f"map_{f} string" for f in FEATURES]
    spark.createDataFrame(values, ", ".join(columns)).write.parquet(f"{tmp_path}/parsed_features_real.parquet")
    got = __spark_entry__.queries()["A02_all_joint_counts"](spark, str(tmp_path)).collect()
    want = {}
    for row in values:
        for i in range(8):
            for j in range(i + 1, 8):
                cell = (f"{FEATURES[i]}*{FEATURES[j]}", row[1 + i], row[1 + j])
                want[cell] = want.get(cell, 0) + 1
    assert {(r.metric, r.x, r.y): r.n for r in got} == want and len({r.metric for r in got}) == 28


# mauve


def test_mauve_of_equal_and_disjoint(spark):
    same = spark.createDataFrame([(i, 0.25, 0.25) for i in range(4)], "bin int, p double, q double")
    apart = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 1.0)], "bin int, p double, q double")
    assert mauve.score(same).first().mauve == pytest.approx(1, abs=1e-3)
    r = mauve.score(apart).first()
    assert r.mauve < 0.02 and r.frontier_integral == pytest.approx(1.0)
    assert mauve.components_for([0.5, 0.3, 0.15, 0.05], 0.9) == 3 and mauve.buckets(500, 80) == 8


def test_mauve_end_to_end(spark):
    rng = np.random.default_rng(0)
    make = lambda m: spark.createDataFrame([([float(v) for v in rng.normal(m, 1, 6)],) for _ in range(150)], "embedding array<double>")
    near = mauve.mauve(make(0), make(0), clusters=5, redo=1, iterations=20, norm="").first().mauve
    far = mauve.mauve(make(0), make(6), clusters=5, redo=1, iterations=20, norm="").first().mauve
    assert near > 0.9 and far < 0.1


@pytest.mark.parametrize("name", ["E06_mauve", "E08_kept_components"])
def test_mauve_queries_keep_the_bucket_rule(spark, tmp_path, monkeypatch, name):
    import __spark_entry__

    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = []

    def quantise(df, clusters, **options):
        asked.append((clusters, options))
        return df.select("side", F.lit(0).alias("bin"))

    monkeypatch.setattr(mauve, "quantise", quantise)
    __spark_entry__.queries()[name](spark, str(tmp_path)).count()
    assert asked == [(15, {})]


# texts


PARSED = ['```json\n{"a": "x", "b": 1}\n```', '{"a": "x"}', "{'a': 'x'}", "GENERATION_ERROR", None, "[1]", '{"a": 1} trailing', ""]


def test_parsers(spark):
    assert column(spark, PARSED, "string", text.parse_or_literal) == [{"a": "x", "b": "1"}, {"a": "x"}, {"a": "x"}, {}, {}, {}, {}, {}]
    assert column(spark, PARSED, "string", text.parse_sliced) == [{"a": "x", "b": "1"}, {"a": "x"}, None, None, None, None, None, None]
    assert column(spark, ['{"b": "é",\n "a": [1, 2]}', "no", None], "string", text.canonical_json) == ['{"b":"é","a":[1,2]}', "no", ""]


def test_options():
    assert len(text.split_outside("*In Vitro* Assays (e.g.|ELISA|Western Blot)|Other")) == 2
    assert text.split_outside("*a|b*|c") == ["*a|b*", "c"] and text.split_outside("a||(b|(c|d))| ") == ["a", "(b|(c|d))"]


def test_split_options_column(spark):
    assert column(spark, ["a | b (x|y)|", ""], "string", text.split_options) == [["a", "b (x|y)"], []]


SCHEMA = '{{\n "area": "<A|B (e.g.|x)|Other>", // note\n "size*": "<small|>1000|other>"\n}}'


def test_schema():
    assert text.read_schema(SCHEMA, compat=True) == {"area": ["A", "B (e.g.|x)", "Other"]}
    assert text.read_schema(SCHEMA) == {"area": ["A", "B (e.g.|x)", "Other"], "size*": ["small", ">1000", "other"]}
    with pytest.raises(ValueError):
        text.read_schema("nothing here")


def test_templates_and_scores(spark):
    assert column(spark, ["v", None], "string", lambda c: text.fill_template("{{k}}: {a}{a}", {"a": c})) == ["{k}: vv", "{k}: "]
    keys = ["title", "year", "cast", "genres", "href", "extract"]
    exact = "{" + ",".join(f'"{k}": 1' for k in keys) + "}"
    five = "{" + ",".join(f'"{k}": 1' for k in keys[:5]) + "}"
    assert column(spark, ["not json", "[]", exact, five], "string", lambda c: text.structure_score(c, keys)) == [-1.0, -1.0, 2.0, 1.4]
    assert column(spark, ['{"holistic_score": 7}', "none", None], "string", text.judged_score) == [7.0, None, None]
    assert column(spark, ["a/checkpoint12/x", "a/last"], "string", text.checkpoint_number) == [12, None]
    assert column(spark, ["<s>hi</s>"], "string", lambda c: text.without_affixes(c, ["<s>", "h"], "</s>")) == ["i"]


# prompts, services, tokens


def test_registry():
    assert registry.named_in("/x/enron-condgen-topic/a.csv") == "enron-condgen-topic" and registry.named_in("/x") is None
    for r in registry.DATASETS.values():
        assert r.kind in ("fixed", "column", "json", "joined") and (r.kind == "fixed" or r.feature)
    with pytest.raises(KeyError):
        registry.recipe("unknown")


def test_splits_and_pairs(spark):
    assert column(spark, ["train", "val", "test", "x"], "string", prompts.split_of) == ["train", "validation", "test", "test"]
    df = spark.createDataFrame([("S", "E")], "extracted_features string, content string")
    assert files.load_dataset(spark, "enron-freeform-e2e", {"train": df}, "train").first().answer == "SUMMARY: S\nEMAIL: E"
    with pytest.raises(KeyError):
        files.load_dataset(spark, "enron", {"train": df}, "test")


def test_retries():
    calls, pauses = [], []

    def flaky(t):
        calls.append(t)
        if len(calls) < 3:
            raise OSError
        return t + "!"

    assert services.with_retries(flaky, pause=pauses.append)("a") == "a!" and len(pauses) == 2
    assert services.with_retries(lambda t: 1 / 0, tries=2, pause=pauses.append)("a") == services.FAILED


def test_token_rows(spark):
    df = spark.createDataFrame([(1, "a b c d", "x y"), (1, "a", None)], "batch int, instruction string, answer string")
    rows = tokenised.training_rows(df, "instruction", "answer", most_instruction=3, most_answer=1).collect()
    assert [len(r.input_ids) for r in rows] == [5, 2] and rows[0].labels[:3] == [-100] * 3 and rows[1].labels == [-100, 2]
    out = tokenised.collate(tokenised.training_rows(df, "instruction", "answer"), "batch", left=True).collect()
    assert {len(r.input_ids) for r in out} == {7} and sorted(sum(r.attention_mask) for r in out) == [2, 7]
    assert services.top_filtered(np.array([5.0, 1.0, 0.0]), k=2)[2] == 0


# steps and training


def test_rollouts(spark):
    df = spark.createDataFrame([(s, float(r)) for s in range(12) for r in (s, s + 2)], "step int, reward double")
    out = rollouts.trailing(rollouts.batch_rewards(df, "step", "reward"), "step").orderBy("step").collect()
    assert out[11].mean_trailing == pytest.approx(np.mean(range(2, 12)) + 1)
    seq = spark.createDataFrame([([1, 2, 3, 9], [-100, 1, 2, 3])], "p array<int>, y array<int>")
    assert rollouts.next_token_accuracy(seq, "p", "y").first().accuracy == 1.0
    assert rollouts.best_of(spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("b", 3, 1.0)], "q string, k int, s double"), "q", "s", "k").orderBy("q").collect()[0].k == 1


def test_private_training_learns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal((i % 3 == j) * 3 for j in range(3)) if True] if False else [float((i % 3 == j) * 2 + rng.normal(0, 0.3)) for j in range(3)], i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, x array<double>, y int")
    w, log = private_training.train(df, "id", "x", "y", 3, 3, 0.5, 12, 0.2, learning_rate=3.0, noise=aim.SeededNoise(0))
    assert log[-1][2] < 0.6 * log[0][2]
    g, n, _ = private_training.summed_gradients(df, "x", "y", np.zeros((3, 3)), 0.01)
    assert n == 300 and np.linalg.norm(g) <= 300 * 0.01 + 1e-9


def test_classifier_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, prediction string")
    r = classify.scores(df).first()
    assert r.accuracy == 0.5 and r.precision == pytest.approx((0.5 + 0.5 + 0) / 3) and r.recall == pytest.approx((0.5 + 1 + 0) / 3)


def test_sampling(spark):
    df = spark.range(1000).withColumn("label", F.col("id") % 3)
    assert sampling.sample_rows(df, "id", 50).count() == 50 and sampling.sample_rows(df.limit(5), "id", 50).count() == 5
    split = sampling.stratified_split(df, "id", "label", 0.1).groupBy("label", "split").count().collect()
    assert sorted(r["count"] for r in split if r.split == "validation") == [33, 33, 33]
    batches = sampling.shuffled_batches(df, "id", 64).groupBy("batch").count().collect()
    assert len(batches) == 15 and {r["count"] for r in batches} == {64}


# session


def test_written_tables(spark):
    from marginalia.session import bounded_rows, broadcast_if_small, drop_written, materialize, work_dir

    df = materialize(spark.range(5), "five")
    assert df.count() == 5 and work_dir(spark) == work_dir(spark)
    assert drop_written(spark) >= 1 and drop_written(spark) == 0
    with pytest.raises(ValueError):
        bounded_rows(spark.range(5), 4, "rows")
    plan = lambda n: broadcast_if_small(spark.range(5), n)._jdf.queryExecution().analyzed().toString()
    assert "hint" in plan(5).lower() and "hint" not in plan(4).lower()


# files and streams


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi",\n there', None), (2, " x ", "y")], "k int, a string, b string")
    files.write_csv(df, f"{tmp_path}/t.csv")
    assert sorted(map(tuple, files.read_table(spark, f"{tmp_path}/t.csv").collect())) == [("1", 'say "hi",\n there', None), ("2", " x ", "y")]
    with pytest.raises(ValueError):
        files.read_table(spark, f"{tmp_path}/t.xyz")
    assert files.append_missing(df, f"{tmp_path}/out", "k") == 2 and files.append_missing(df, f"{tmp_path}/out", "k") == 0
    assert files.record_json(df).first().generated_text.endswith('"b":null}')
    assert files.newest_checkpoint(spark.createDataFrame([], "path string")).first().epoch == -1


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:10", 1.0), (2, "2024-01-01 00:00:50", 3.0), (2, "2024-01-01 00:00:50", 3.0), (3, "2024-01-01 01:00:00", 5.0)], "k int, t string, v double").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        steps.once_sink(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", "k", "1 hour", "t").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]
    q = steps.tumbling_log(stream(), "t", "1 minute", "1 minute", "v").writeStream.outputMode("complete").format("memory").queryName("log").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(rows) s from log").first().s == 4


def test_numerical_accounting_is_an_upper_bound():
    def exact(sigma, steps, delta):
        mu = math.sqrt(steps) / sigma
        cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
        low, high = 0.0, 300.0
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if cdf(-mid / mu + mu / 2) - math.exp(mid) * cdf(-mid / mu - mu / 2) > delta else (low, mid)
        return high

    for sigma, steps in ((0.5, 10), (0.3, 10), (1.0, 100), (5.0, 40)):
        known = exact(sigma, steps, 1e-5)
        got = accounting.loss_epsilon([accounting.Stage(sigma, 1.0, steps)], 1e-5)
        assert known <= got <= known + 0.02
    assert abs(exact(0.5, 10, 1e-5) - 46.21) < 0.01 and abs(exact(0.3, 10, 1e-5) - 99.67) < 0.01
    noise = [accounting.noise_multiplier(t, 1e-5, 0.01, 500) for t in (30, 60, 99)]
    assert noise[0] > noise[1] > noise[2] > 0.1
    for t, s in zip((30, 60, 99), noise):
        assert accounting.loss_epsilon([accounting.Stage(s, 0.01, 500)], 1e-5) <= t
    with pytest.raises(ValueError):
        accounting.loss_epsilon([accounting.Stage(1e-3, 1.0, 10)], 1e-5)


def test_second_stage_meets_the_budget():
    first = accounting.Stage(10)
    sigma = accounting.second_stage_sigma(50, 1e-5, first, 0.001, 10)
    assert sigma < 0.25 and accounting.renyi_epsilon([first, accounting.Stage(sigma, 0.001, 10)], 1e-5) <= 50 < accounting.renyi_epsilon([first, accounting.Stage(0.98 * sigma, 0.001, 10)], 1e-5)


def test_zcdp_conversions_agree():
    for rho in (0.001, 0.18, 1.0, 20.0):
        eps = accounting.zcdp_eps(rho, 1e-6)
        assert abs(accounting.zcdp_rho(eps, 1e-6) - rho) < 1e-6 * max(1, rho) and abs(math.log(accounting.zcdp_delta(rho, eps) / 1e-6)) < 1e-4
