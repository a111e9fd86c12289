from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia import session
from marginalia.llm import canonical, overlap, packing, pairs, pieces, terms, tokens, truncation


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# p2


DOMAIN = [("organism", 1, "Sea urchin", ["Strongylocentrotus purpuratus"]), ("organism", 2, "House mouse", ["Mus musculus"]), ("organism", 3, "Chicken embryo", ["Gallus gallus"]), ("organism", 4, "Maize", None)]


@pytest.fixture(scope="module")
def domain(spark):
    return spark.createDataFrame(DOMAIN, "feature_name string, item_id long, option_text string, aliases array<string>")


def test_values_map_to_the_item_they_mean(spark, domain):
    meant = {"sea urchin": 1, "Sea urchyn": 1, "eSa urchin": 1, "urchin, Sea": 1, "Seaurchin": 1, "S. purpuratus": 1, "approx. House mouse": 2, "Mus musbulus": 2, "HOUSE MOUSES": 2, "Máize": 4, "Mayze": 4, "oak gall wasp": -1, "vampire squid": -1, "n/a": -1, "?": -1, "Gallus gallus": 3, "Chickenembryoonly": 3, "studyofHousemouse": 2, "x" * 5000: -1}
    data = [(i, v, "clash") for i, v in enumerate(meant)] * 2 + [(100, "Sea urchin", ""), (101, None, ""), (102, " \t", ""), (103, "", "")]
    df = spark.createDataFrame(data, "record_id long, map_organism string, feature string")
    got = {r.record_id: r.item_id for r in canonical.map_values(df, "record_id", ["map_organism"], domain).collect()}
    assert got == dict(enumerate(meant.values()))
    assert canonical.map_values(df, "record_id", ["map_organism"], domain).count() == len(meant)


def test_values_without_rows_or_entries(spark, domain):
    none = spark.createDataFrame([], "record_id long, map_organism string")
    assert canonical.map_values(none, "record_id", ["map_organism"], domain).count() == 0
    one = spark.createDataFrame([(1, "Maize")], "record_id long, map_organism string")
    assert rows(canonical.map_values(one, "record_id", ["map_organism"], domain.limit(0))) == [(1, "map_organism", -1)]


@pytest.mark.parametrize("listed", [2000, 0])
def test_neighbourhoods_miss_no_near_token(spark, monkeypatch, listed):
    monkeypatch.setattr(canonical, "LISTED", listed)
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcd", k=rnd.randint(2, 8))) for _ in range(150)]
    found = {(r.token, r.word) for r in canonical.repair_tokens(spark.createDataFrame([("f", w) for w in set(words)], "feature string, token string"), spark.createDataFrame([("f", w) for w in set(words[:40])], "feature string, word string")).collect()}

    def near(a, b):
        n = max(len(a), len(b))
        return canonical.edits(a, b)[0] <= (0 if n <= 2 else 1 if n <= 5 else 2)

    assert {(a, b) for a in set(words) for b in set(words[:40]) if near(a, b)} <= found


def test_letters_bound_the_closer_look():
    rnd = random.Random(6)
    for _ in range(400):
        ts, name = (["".join(rnd.choices("abcde", k=rnd.randint(1, 9))) for _ in range(rnd.randint(1, 3))] for _ in range(2))
        assert canonical.may_reach(Counter("".join(ts)), name, canonical.closeness(ts, name))


# p3


def test_terms_equal_brute_force(spark):
    rnd = random.Random(1)
    data = [(rnd.randint(-200, 200), rnd.choice([None, "", "  ", "A b", "b c-c", "É1 e", "w" + str(rnd.randint(0, 40))])) for _ in range(300)]
    once = {}
    for k, v in data:
        once.setdefault(k, v)
    data = [(k, once[k]) for k, _ in data]
    df = spark.createDataFrame(data, "record_id long, goal string").withColumn("term", F.lit("clash"))
    import re

    filled = [v for v in once.values() if v and v.strip()]
    occ = Counter(t for v in filled for t in re.findall(r"[^\W_]+", v.lower()))
    rec = Counter(t for v in filled for t in set(re.findall(r"[^\W_]+", v.lower())))
    want = {t: (occ[t], rec[t], "common" if rec[t] > 0.1 * len(filled) else "rare" if rec[t] <= 2 else "useful") for t in occ}
    got = {r.term: (r.occurrences, r.records, r.verdict) for r in terms.term_verdicts(df, "record_id", ["goal"]).collect()}
    assert got == want
    assert terms.term_verdicts(df.limit(0), "record_id", ["goal"]).count() == 0
    assert terms.term_verdicts(df.withColumn("goal", F.lit(None).cast("string")), "record_id", ["goal"]).count() == 0
    assert rows(terms.value_counts(terms.value_bitmaps(spark.createDataFrame([(None, "x"), (None, "x"), (63, "x"), (64, "x"), (-1, "x")], "k long, v string"), "k", ["v"]))) == [("v", "x", 4)]


# p4


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = [f"word{i}" for i in range(400)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([3, 8, 16, 40, 90, 200]))] for _ in range(60)]
    data = []
    for i, ws in enumerate(base):
        data.append((3 * i, " ".join(ws), f"Title number {i}", "train"))
        kind = i % 6
        other = list(ws)
        if kind == 0:
            other = [w.upper() + "," for w in ws]
        elif kind == 1:
            other[len(ws) // 2] = "changed"
        elif kind == 2:
            other = ["Abstract", *ws]
        elif kind == 3:
            other = ws[: len(ws) // 2] + [rnd.choice(vocabulary) for _ in range(len(ws) - len(ws) // 2)]
        elif kind == 4:
            other = [f"<b>{ws[0]}</b>", *ws[1:]]
        data.append((3 * i + 1, "  ".join(other), None, rnd.choice(["test", "val"])))
    data += [(900, None, "Title  number 7!", "test"), (901, " ", "Title number", "test"), (902, "", None, "test"), (903, None, "Title number 7", "train"), (904, "...", None, "test"), (905, "...", None, "train"), (906, "a b", "x", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, title string, split string").withColumn("h", F.lit(1)).withColumn("train", F.lit(2))
    got = {(r.t, r.e) for r in overlap.cross_split_pairs(df).collect()}
    train = [r for r in data if r[3] == "train"]
    held = [r for r in data if r[3] not in ("train", None)]
    text = {(a[0], b[0]) for a in train for b in held if (a[1] or "").strip() and (b[1] or "").strip() and overlap.same_words(overlap.normal_words(a[1]), overlap.normal_words(b[1]))}
    assert {p for p in got if p[1] < 900 and p[0] < 900} == text and len(text) > 30
    assert {p for p in got if p[1] >= 900} == {(21, 900)}
    assert overlap.cross_split_pairs(df.limit(0)).count() == 0


def test_scattered_edits_lose_few_pairs(spark):
    rnd = random.Random(8)
    data = []
    for i in range(120):
        ws = [f"w{rnd.randint(0, 10**6)}" for _ in range((80, 200, 500, 1000)[i % 4])]
        other = list(ws)
        for k in rnd.sample(range(len(ws)), int((0.15, 0.18, 0.2)[i % 3] * len(ws))):
            other[k] = f"edit{k}"
        data += [(2 * i, " ".join(ws), None, "train"), (2 * i + 1, " ".join(other), None, "test")]
    df = spark.createDataFrame(data, "doc_id long, text string, title string, split string")
    assert {(r.t, r.e) for r in overlap.cross_split_pairs(df).collect()} == {(2 * i, 2 * i + 1) for i in range(120)}


@pytest.mark.parametrize("every, allowed", [(5, 0.08), (6, 0.02)])
def test_regular_edits_lose_few_pairs(every, allowed):
    rnd = random.Random(11)
    hashes = overlap._Hashes()
    lost = 0
    for i in range(200):
        n, r = (80, 150, 300, 600)[i % 4], rnd.randint(0, every - 1)
        ws = [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
        both = [ws, [f"e{i}.{k}" if k % every == r else w for k, w in enumerate(ws)]]
        a, b = (set(overlap.chunks(np.array([hashes[w] for w in x], np.uint64), np.array([0, n]))[0].tolist()) for x in both)
        lost += sum((d >> 4) & 63 for d in a & b) < min(overlap.LEAST * n, overlap.ENOUGH)
    assert lost <= allowed * 200


def test_bags_bound_the_words_in_common():
    rnd = random.Random(12)
    hashes = overlap._Hashes()
    for _ in range(100):
        x, y = ([f"w{rnd.randint(0, 60)}" for _ in range(rnd.randint(1, 90))] for _ in range(2))
        offsets = np.array([0, len(x), len(x) + len(y)])
        a, b = (np.frombuffer(bag, np.uint8).astype(int) for bag in overlap.bags(np.array([hashes[w] for w in x + y], np.uint64), offsets))
        assert np.minimum(a, b).sum() >= sum((Counter(x) & Counter(y)).values()) and a.sum() == len(x)
    assert overlap.bags(np.full(300, 7, np.uint64), np.array([0, 300])) == [None]


def test_hot_chunks_lose_no_pair(spark, monkeypatch):
    rnd = random.Random(2)
    notice = " ".join(f"notice{i}" for i in range(30))
    data = [(i, f"{notice} " + " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(12)), None, "train" if i % 2 else "test") for i in range(40)]
    data += [(100 + i, data[i][1] + " end", None, "test" if i % 2 else "train") for i in range(10)]
    df = spark.createDataFrame(data, "doc_id long, text string, title string, split string")
    plain = {tuple(r) for r in overlap.cross_split_pairs(df).collect()}
    monkeypatch.setattr(overlap, "MEETINGS", 3)
    assert {tuple(r) for r in overlap.cross_split_pairs(df).collect()} == plain and len(plain) >= 10
    assert {tuple(r) for r in overlap.cross_split_pairs(df.coalesce(1), busy=3).collect()} == plain


def test_stock_phrases_with_other_names_are_found(spark, monkeypatch):
    rnd = random.Random(4)
    phrases = [[f"p{i}x{k}" for k in range(8)] for i in range(24)]

    def told(order, name):
        return " ".join(w for j, i in enumerate(order) for w in [*phrases[i], f"{name}x{j}", f"{name}y{j}"])

    orders = [rnd.sample(range(24), 12) for _ in range(60)]
    data = [(i, told(o, f"n{i}"), None, "train" if i % 2 else "test") for i, o in enumerate(orders)]
    data += [(100 + i, told(orders[i], f"m{i}"), None, "test" if i % 2 else "train") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string, title string, split string")
    wanted = {(i, 100 + i) if i % 2 else (100 + i, i) for i in range(40)}
    monkeypatch.setattr(overlap, "MEETINGS", 50)
    assert {tuple(r) for r in overlap.cross_split_pairs(df).collect()} == wanted


def test_stretches_travel_packed(spark):
    hot = [(i << 10) + (words << 4) + 4 for i, words in enumerate((3, 4, 60))]
    records = spark.createDataFrame([(1, True, 16 * 200 + 8, hot), (2, False, 16 * 190 + 7, hot)], "key long, train boolean, x long, hs array<long>")
    (found,) = overlap.hot_stretches(records)
    assert found.columns == ["d", "key", "train", "x"]  # what a pair needs of its records is one number, the words are in the digest
    got = [(r.key, r.train, r.x, r.d >> 4 & 63) for r in found.collect()]
    assert sorted(got) == sorted((*tuple(r)[:3], w) for r in records.collect() for w in (7, 63, 63) * 2)


def test_places_are_turned_and_turned_back(spark):
    places = [0, 1, 5, 255, 32767, 32768, 65535, 65536, (1 << 33) - 1]
    back = spark.createDataFrame([(x,) for x in places], "x long").select("x", overlap._turned(F.col("x")).alias("y"), overlap._turned_back(overlap._turned(F.col("x"))).alias("z")).collect()
    assert [r.z for r in back] == places and all(r.y % (1 << 48) == 0 for r in back if r.x < 65536)


def test_tables_of_overlaps_go_when_done(spark):
    """The digests, the largest table, give way to those that both splits have, and no shuffle outlives the table it is for."""
    disks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    shuffled = lambda: sum(p.stat().st_size for d in disks for p in Path(str(d)).rglob("shuffle_*.data"))
    df = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{k}" for k in range(60)), None, "train" if i % 2 else "test") for i in range(400)], "doc_id long, text string, title string, split string")
    began, at = shuffled(), len(session._WRITTEN)
    found = overlap.cross_split_pairs(df)
    assert shuffled() - began < 5_000
    assert not any("signatures" in path for path in session._WRITTEN[at:])
    assert found.count() == 200


def test_copies_collapse(spark):
    df = spark.createDataFrame([(i, "the same text again and again", "t", "train" if i % 3 else "valid") for i in range(30)], "doc_id long, text string, title string, split string")
    assert overlap.cross_split_pairs(df).count() == 20 * 10


def test_longest_common_subsequence():
    rnd = random.Random(4)
    for _ in range(50):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert overlap.in_order(a, b) == t[-1][-1]


# p5, p6


@pytest.fixture(scope="module")
def answers(spark):
    rnd = random.Random(9)
    nouns = ["cells", "mice", "genes", "membranes", "spores", "axons"]
    verbs = ["regulate", "restore", "limit", "drive", "shape"]

    def sentence():
        return f"{rnd.choice(['The', 'These', 'Many', 'Some'])} {rnd.choice(nouns)} {rnd.choice(verbs)} {rnd.choice(nouns)} in {rnd.choice(nouns)} of the {rnd.choice(nouns)}."

    data = []
    for i in range(600):
        text = " ".join(sentence() for _ in range(rnd.randint(2, 5)))
        cut = i % 4 == 0
        if cut:
            at = rnd.randint(20, len(text) - 3)
            text = text[:at].rstrip(". ") + rnd.choice(["", "", " ...", "…", " ["])
        data.append((i, f"s{i % 3}", text, cut))
    for i in range(600, 640):
        data.append((i, "s1", "House mouse", False))
    return data


def test_cuts_on_held_out_texts(spark, answers):
    extra = [(1000, "s0", None), (1001, "s0", ""), (1002, None, "  "), (1003, "s0", "..."), (1004, "s0", "😀")]
    df = spark.createDataFrame([r[:3] for r in answers] + extra, "pair_id long, source string, answer string").withColumn("cut", F.lit("clash"))
    got = {r.row_id for r in truncation.cut_rows(truncation.records({"t": (df, "pair_id", "answer")})).collect()}
    want = {r[0] for r in answers if r[3]}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)
    assert truncation.cut_rows(truncation.records({"t": (df.limit(0), "pair_id", "answer")})).count() == 0
    shares = truncation.cut_shares(truncation.records({"t": (df, "pair_id", "answer")})).collect()
    assert sum(r.rows for r in shares) == len(answers) + len(extra)


def test_defects(spark, answers):
    good = [(i, "qa", s, "Describe the results of the study in a few sentences.", t) for i, s, t, cut in answers if not cut and i < 600]
    data = good + [
        (2000, "qa", "s0", "What do the cells regulate in the mice?", None),
        (2001, "qa", "s0", "What do the cells regulate in the mice?", " . "),
        (2002, "qa", "s0", "What do the cells regulate in the mice?", "`GENERATION_ERROR`"),
        (2003, "qa", "s0", "Read this. What do the cells regulate in the mice?", "Question: What do the cells regulate in the mice?"),
        (2004, "qa", "s0", "Describe the cells.", "I'm sorry, but I can't help with that request."),
        (2005, "qa", "s0", "Describe the cells.", "Unsere Daten zeigen, dass die Zellen und die Gene gemeinsam wirken."),
        (2006, "qa", "s0", "Translate the passage into German. Passage: These cells regulate mice in genes.", "Unsere Daten zeigen, dass die Zellen und die Gene gemeinsam wirken."),
        (2007, "qa", "s0", "Describe the cells.", "The cells regulate genes in spores of the mice. Many axons li"),
        (2008, "qa", "s0", None, "The cells regulate genes in spores of the mice."),
        (2009, "qa", "s0", "Describe the cells.", "Sorry results aside, the cells regulate genes in spores of the mice."),
    ]
    df = spark.createDataFrame(data * 2, "pair_id long, dataset_name string, source string, instruction string, answer string").withColumn("defect", F.lit("clash"))
    got = {r.pair_id: r.defect for r in pairs.defects(df).collect()}
    assert {k: v for k, v in got.items() if k >= 2000} == {2000: "empty", 2001: "empty", 2002: "empty", 2003: "copy", 2004: "refusal", 2005: "language", 2007: "truncated"}
    assert len([k for k in got if k < 2000]) <= 6
    assert pairs.defects(df.limit(0)).count() == 0


def test_templates_reveal_refusals_in_any_words(spark, answers):
    good = [(i, ("qa", "note", "title", "mix")[i % 4], s, f"{('Describe', 'Sum up', 'Explain', 'Tell')[i % 4]} finding {i} in a few sentences.", t) for i, s, t, cut in answers if not cut and i < 600]
    short = "We are not in a position to go further with your wish today."
    long = " ".join(["Our team has no way of going along with such a wish at this time.", "Kindly look for another place that may take it up instead."] * 7)
    other = [(1000 + i, ("qa", "note", "title", "mix")[i % 4], "s0", f"{('Describe', 'Sum up', 'Explain', 'Tell')[i % 4]} finding {i} of the {i} cells.", (short, long)[i // 40]) for i in range(80)]
    df = spark.createDataFrame(good + other, "pair_id long, dataset_name string, source string, instruction string, answer string")
    got = {r.pair_id: r.defect for r in pairs.defects(df).collect()}
    assert len(long) > 850 and not any(phrase in (short + long).lower() for phrase in pairs.DECLINES)
    assert all(got.get(1000 + i) == "refusal" for i in range(80))
    assert sum(d == "refusal" for k, d in got.items() if k < 1000) == 0


def test_clusters_are_verified(spark):
    counted = spark.createDataFrame([("we do not give such texts to readers here", 9), ("we do not give such texts to", 3), ("all of the mice were kept in cages", 4)], "opening string, rows long")
    assert dict(rows(pairs.cluster_openings(counted))) == {"we do not give such texts to readers here": "we do not give such texts to readers here", "all of the mice were kept in cages": "all of the mice were kept in cages", "we do not give such texts to": "we do not give such texts to"}
    joined = spark.createDataFrame([("we do not give such texts to readers here", 9), ("we do not give such texts to readers here too", 3)], "opening string, rows long")
    assert {t for _, t in rows(pairs.cluster_openings(joined))} == {"we do not give such texts to readers here"}


def test_clusters_join_variants(spark):
    first = "we do not give such texts to readers"
    variants = [first, "we do never give such texts to readers", "we do not currently give such texts to", "we do not give texts to readers here"]
    others = ["we have not given any texts to them", "all of the mice were kept in cages"]
    counted = spark.createDataFrame([(o, 9 - k) for k, o in enumerate(variants + others)], "opening string, rows long")
    assert dict(rows(pairs.cluster_openings(counted))) == {**{o: first for o in variants}, **{o: o for o in others}}


def test_variants_without_plain_answers_count(spark):
    seen, said = "they saw {} less of it in mice", "we do not give {} texts to readers"
    data = [(seen.format("much"), True)] * 6 + [(seen.format(w), False) for w in ("some", "far", "a", "no")]
    data += [(said.format("such"), True)] * 6 + [(said.format("these"), True)]
    df = spark.createDataFrame([([o], plain, False, i, i) for i, (o, plain) in enumerate(data)], "openings array<string>, plain boolean, empty boolean, prompt long, kind long")
    assert rows(pairs.refusing_openings(df)) == [(said.format("such"),), (said.format("these"),)]


def test_clusters_broadcast_nothing_that_grows(spark):
    counted = spark.createDataFrame([("we do not give such texts to readers here", 9)], "opening string, rows long")
    plan = pairs.cluster_openings(counted)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 3


def test_language_asked_for_anywhere():
    passage = "These cells regulate mice in genes of the spores. " * 12
    assert pairs.wanted_language(f"Read this first.\nThen answer in German.\n{passage}") == "de"
    assert pairs.wanted_language(f"Sum up the passage. It has been long. Please write your text in French. {passage}") == "fr"
    assert pairs.wanted_language(passage + "Samples were kept in Spanish caves. " + passage) == "en"
    assert pairs.words("It's l’effet of A_b, 中文 'x'") == ["it's", "l'effet", "of", "a", "b", "中", "文", "x"]


# p7, p8, p9


@pytest.fixture(scope="module")
def vocabulary(spark):
    return tokens.load_vocabulary(spark)


TEXTS = [None, "", " ", "Hello world", "a  b\n\n c\t", "<|endoftext|> is text", "naïve 中文字符 😀👨‍🔬 é", "x" * 30_000, "don't it's we'LL 12³ ½", "﻿ ​", "line\r\nend  "]


def test_ids_round_trip(spark, vocabulary):
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (None, "no key"), (None, "no key")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("block", F.lit(0))
    coded = tokens.encode(df, "doc_id", "text", vocabulary)
    plain = tokens.encoder(vocabulary.value).encode_ordinary
    assert rows(coded) == sorted(((k, plain(t) if t else []) for k, t in data), key=repr)
    assert rows(tokens.decode(coded, "doc_id", vocabulary)) == sorted(((k, t or "") for k, t in data), key=repr)
    assert tokens.encode(df.limit(0), "doc_id", "text", vocabulary).count() == 0
    assert tokens.encode(df.filter("text is null"), "doc_id", "text", vocabulary).count() == 1


def test_blocks_of_any_size(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 7)
    df = spark.createDataFrame([(i, " ".join(["ab", "cd"] * (i % 5))) for i in range(50)], "k int, t string")
    plain = tokens.encoder(vocabulary.value).encode_ordinary
    assert {r.k: r.ids for r in tokens.encode(df, "k", "t", vocabulary).collect()} == {i: plain(" ".join(["ab", "cd"] * (i % 5))) for i in range(50)}


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_tight(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([rnd.randint(0, 100), rnd.randint(1, 40), 100]) for _ in range(2000)]
    where = packing.best_two_fit(sizes, 100)
    used = Counter()
    for s, c in zip(sizes, where):
        used[c] += s
    assert max(used.values()) <= 100 and len(used) <= -(-sum(sizes) // 100) + 2


def test_assignment(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 50)
    data = [(i, i * 7 % 130) for i in range(300)] + [(None, 5), (1, 5), (2, None), (3, 400), (4, 300)]
    df = spark.createDataFrame(data, "doc_id long, n int").withColumn("size", F.lit("clash")).withColumn("piece", F.lit(0))
    out = packing.assign(df, "doc_id", "n", 100).collect()
    used = Counter()
    for r in out:
        used[r.container] += r["size"]
    assert max(used.values()) <= 100 and sum(used.values()) == sum(n or 0 for _, n in data)
    assert sum(r.piece == 0 for r in out) == len(data)
    assert sorted((r.piece, r.start, r["size"]) for r in out if r.doc_id == 3 and (r["size"] == 100 or r.piece)) == [(0, 0, 100), (1, 100, 100), (2, 200, 100), (3, 300, 100)]
    assert len(used) <= 1.03 * (-(-sum(used.values()) // 100)) + 4
    assert packing.assign(df.limit(0), "doc_id", "n", 100).count() == 0


LONG = ["First sentence here. " * 60, "para one is short.\n\n" * 80, "wordwithoutend" * 300, "中文没有空格" * 200, "😀" * 400, ("a b c d e f g. " * 30 + "\n\n") * 6, "tiny", "", None]


def test_pieces(spark, vocabulary):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LONG)] + [(None, LONG[0])], "doc_id long, text string").withColumn("piece", F.lit("clash"))
    encode = tokens.encoder(vocabulary.value).encode_ordinary
    out = pieces.split_long(df, "doc_id", "text", vocabulary, 120, 16).orderBy("doc_id", "piece").collect()
    long = {i for i, t in enumerate(LONG) if t and len(encode(t)) > 120}
    assert {r.doc_id for r in out} == long | {None}
    for i in long:
        mine = [r for r in out if r.doc_id == i]
        text, at = LONG[i], 0
        assert [r.piece for r in mine] == list(range(len(mine)))
        for before, r in zip([None, *mine], mine):
            assert len(encode(r.text)) <= 120 and 0 <= r.overlap <= 16
            start = text.index(r.text, max(0, at - len(r.text)) if before is None else 0) if r.text in text else -1
            assert start >= 0
            assert (before.end if before else 0) == r.start + r.overlap
        assert text.startswith(mine[0].text) and text.endswith(mine[-1].text) and mine[-1].end == len(encode(text))
    assert all(r.text.rstrip().endswith(".") for r in out if r.doc_id in (0, 1))
    assert pieces.split_long(df.limit(0), "doc_id", "text", vocabulary, 120, 16).count() == 0


def test_texts_are_cut_once(spark, vocabulary):
    df = spark.createDataFrame([(1, LONG[0])], "doc_id long, text string")
    plan = pieces.split_long(df, "doc_id", "text", vocabulary, 120, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
