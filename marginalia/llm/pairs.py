"""Defective prompt and response pairs, with the kind of defect.

Words that few answers of a language have become blanks. The openings of an answer (of its sentences, and of what follows
a courtesy before a comma) are clustered by MinHash over their words, so that one word in five may differ, each member
verified against its representative. Openings that recur across unrelated prompts and whose answers hold nothing but such recurring words
reveal refusals: an answer of substance has names and numbers of its own. Copy, language and termination checks label the
other defects; fixed phrases of declining only add refusals whose template is too rare to recur.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Container, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm import truncation
from marginalia.session import bounded_rows, broadcast_if_small, materialize

#: Parameters: words of an opening, least share of the longer opening's words that return in its representative, hashes and
#: bands of MinHash: eight words of which one differs have seven of nine in common, so they miss each other once in 900 times.
OPENING, SIMILAR, HASHES, BANDS = 8, 0.8, 100, 20
#: A word is kept if at least this share of the answers of its language, and this many, have it; words kept at most (their
#: number is bounded by the words of a mean answer over the share, per language).
KEPT, KEPT_ROWS, VOCABULARY = 0.001, 3, 500_000
#: Words of an answer of which a counter is held by a task before it is passed on.
COUNTED = 200_000
#: An answer is plain with at most so many words that are not kept, or at most such a share of them.
OWN_WORDS, OWN_SHARE = 2, 0.06
#: Templates of refusal: words kept, prompts and kinds of prompts they answer at least, share of plain answers.
TEMPLATE_WORDS, PROMPTS, KINDS, PLAIN = 4, 5, 4, 0.9
#: Words of a courtesy at most, words of a prompt that tell its kind.
COURTESY, KIND = 6, 3
#: Words of the instruction that may return in an answer that declines by a phrase, outside the declining sentences.
ECHO = 3
#: Refusing openings up to which they are broadcast (some 100 bytes each); beyond it a shuffle joins them.
REFUSING = 20_000
FAILURE_MARKER = "GENERATION_ERROR"

#: Phrases of declining, by language.
DECLINES = (
    "i can't", "i cannot", "i can not", "i won't", "i will not", "i am not able to", "i am unable to", "i must decline", "i have to decline",
    "i do not have permission", "i do not have enough permission", "i don't have permission", "i don't have enough permission", "i am not allowed", "i am not permitted",
    "not something i can", "outside my scope",
    "je ne peux pas", "je suis désolé", "je regrette",
    "no puedo", "no me está permitido", "lo siento",
    "não posso", "sinto muito", "não me é permitido",
    "es tut mir leid", "leider kann ich", "darf ich nicht",
    "对不起", "抱歉", "我不能回答", "无法回答", "无法提供",
)

#: Frequent words by which a language is told.
FREQUENT = {
    "en": "the of and to in is that for with by on was were are as from at this be which an how what why did does it has have been or not may more than these whether",
    "de": "der die das und ist von mit wird wurde wurden bei nicht eine einer den dem des zu dass im sich auf für wir um aus ohne nach auch wie warum welche unsere durch zum zur",
    "fr": "le la les des et est une un dans avec que pour par sur du de chez nous au aux ne pas se qui à on ce cette quel pourquoi comment l d",
    "es": "el la los las de en que y con una un por del para se al no su es cómo qué cuál más sobre mediante",
    "pt": "o a os as de em que e com uma um por do da dos das para se ao na no nas nos não como qual mais sobre por",
    "it": "il lo la gli le di che e con una un per del della dei nel si non è come sono alla",
    "nl": "de het een van en in is dat met voor op zijn niet bij door wordt aan uit ook als werd",
}
_SPOKEN: dict[str, list[str]] = {}
for _k, _v in FREQUENT.items():
    for _w in sorted(set(_v.split())):
        _SPOKEN.setdefault(_w, []).append(_k)
#: Letters that mark a language.
LETTERS = {"es": "ñ¿¡", "pt": "ãõ", "de": "ßäöü", "fr": "èêœùî"}
#: Names of languages in instructions.
NAMES = {
    "en": "english englisch anglais inglés ingles inglês 英文 英语",
    "de": "german deutsch deutsche allemand alemán aleman alemão 德文 德语",
    "fr": "french französisch français francais francés frances francês 法文 法语",
    "es": "spanish spanisch espagnol español espanol espanhol 西班牙语 西班牙文",
    "pt": "portuguese portugiesisch portugais portugués portugues português 葡萄牙语 葡萄牙文",
    "zh": "chinese chinesisch chinois chino chinês 中文 汉语",
    "it": "italian italienisch italien italiano",
    "nl": "dutch niederländisch néerlandais holandés holandês",
}
_NAMED = {w: k for k, v in NAMES.items() for w in v.split()}
#: Words by which a request for a language is told from a passage that mentions one.
REQUESTS = "answer reply respond write translate give put render return version translation antworte antworten übersetze übersetzen schreibe réponds répondez traduis traduisez écris écrivez responde responda traduce traduzca escribe traduza escreva"
#: Words of which one stands in any text that names a language: the names, or a character of those in Chinese.
_NAMES_OR_MARKS = frozenset(w if ord(w[0]) < 0x3000 else w[-1] for w in _NAMED)
_ASKS = frozenset(REQUESTS.split())
_WORD = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_㐀-鿿぀-ヿ가-힯]+(?:['’][^\W_]+)?")
_HAN = re.compile(r"[\u3400-\u9fff]")
_LETTERS_ONLY = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?][\"'”’)\]]*\s+|[。！？]|\n+")
_PAUSE = re.compile(r"[,–—:;，]\s*(?:but|however)?\s*|\bbut\s+|\s-\s")
_NAME = re.compile(r"\b(?:in|into|to|auf|ins|en|em|a|an|the|une?|eine|para o)\s+(" + "|".join(w for w in _NAMED if w.isascii() or w[0].isalpha() and ord(w[0]) < 0x3000) + r")\b(?!\s+(?:cells|patients|cohort))|用?(" + "|".join(w for w in _NAMED if ord(w[0]) >= 0x3000) + ")", re.IGNORECASE)
#: Bytes of ASCII marks as spaces but for the apostrophe; all other bytes stay.
_BYTES = bytes(i if i > 127 or chr(i).isalnum() or i == 39 else 32 for i in range(256))


def words(text: str) -> list[str]:
    """Lower-cased words; each character of a script without spaces is a word."""
    runs = text.lower().replace("’", "'").encode("utf-8", "surrogatepass").translate(_BYTES).decode("utf-8", "surrogatepass").split()
    return [w for run in runs for w in ((run,) if run.isascii() and run.isalnum() else _WORD.findall(run))]


def _line(ws: list[str]) -> str:
    return f" {' '.join(ws)} "


_DECLINING = tuple(_line(words(phrase)) for phrase in DECLINES)


def language(text: str, least: int = 2, ws: list[str] | None = None) -> str | None:
    """The language of ``text`` (of words ``ws``) by script and at least ``least`` frequent words, or None if it does not tell."""
    plain = text.isascii()
    if not plain and (han := len(_HAN.findall(text))):
        if han >= 4 and han * 5 >= sum(map(str.isalpha, text)):
            return "zh"
    found = dict.fromkeys(FREQUENT, 0)
    for w in words(text) if ws is None else ws:
        for part in (w,) if w.isalpha() else _LETTERS_ONLY.findall(w):
            if part in _SPOKEN:
                for k in _SPOKEN[part]:
                    found[k] += 1
    if not plain:
        low = text.lower()
        for k, marks in LETTERS.items():
            found[k] += sum(map(low.count, marks))
    second, n = sorted(found.values())[-2:]
    return max(found, key=found.__getitem__) if n >= least and n > second else None


def wanted_language(instruction: str, have: Container[str] | None = None) -> str | None:
    """The language an instruction (of words ``have``) asks for, or, if it names none, is written in.

    A name counts at the end and before the first colon or line, and in any other sentence that asks for something.
    """
    have = set(words(instruction)) if have is None else have
    if not _NAMES_OR_MARKS.isdisjoint(have):
        named = [(m.start(), m.end(), _NAMED[(m[1] or m[2]).lower()]) for m in _NAME.finditer(instruction)]
        head = min(x for x in (instruction.find(":"), instruction.find("\n"), len(instruction)) if x >= 0)
        for at, _, name in reversed(named):
            if at >= len(instruction) - 80:
                return name
        for at, until, name in named:
            if at < head and until <= 160:
                return name
            start = max(instruction.rfind(mark, 0, at) for mark in ".!?:。：\n") + 1
            if not _ASKS.isdisjoint(words(instruction[start:until])):
                return name
    first = re.split(r"(?<=[.!?:。：])\s|\n|(?<=[。：])", instruction.strip(), maxsplit=1)[0]
    return language(first) or language(instruction) or language(instruction, 1)


def is_copy(i: list[str], a: list[str], have: Container[str], instruction: str, cut: bool) -> bool:
    """Whether an answer of words ``a`` is nothing but an instruction of words ``i`` or a part of it given back, framed or slightly changed."""
    if len(a) < 4 or len(i) < 4:
        return a == i and len(a) > 0
    if sum(w in have for w in a) < 0.7 * len(a):
        return False
    grams = {tuple(i[k : k + 3]): k for k in range(len(i) - 2)}
    covered, last = [False] * len(a), None
    for k in range(len(a) - 2):
        if (at := grams.get(tuple(a[k : k + 3]))) is not None:
            covered[k : k + 3] = [True] * 3
            last = (k, at)
    stray = covered.count(False)
    if last is None or not (stray <= 3 and stray <= 0.3 * len(a) or stray <= 0.07 * len(a)):
        return False
    if not cut:
        return True
    # a copy that stops inside its model is a cut text, not a copy
    rest = i[last[1] + 3 :]
    return not rest or instruction.lower().rstrip(" \"'.?!)}]").endswith(a[-1])


def openings(text: str) -> list[list[str]]:
    """Openings of the sentences of ``text``, and of what follows a courtesy at their start."""
    out = []
    for sentence in _SENTENCE.split(text.lower().replace("’", "'")):
        begun = list(islice(_WORD.finditer(sentence), OPENING))
        out.append([m[0] for m in begun])
        if m := _PAUSE.search(sentence, 1, begun[COURTESY].start() if len(begun) > COURTESY else len(sentence)):
            out.append([w[0] for w in islice(_WORD.finditer(sentence, m.end()), OPENING)])
    return [ws for ws in out if len(ws) >= TEMPLATE_WORDS]


def declines(answer: str, ws: list[str], have: Container[str]) -> bool:
    """Whether a phrase of declining stands in an answer of words ``ws`` and its other sentences hold nothing of the instruction's words ``have``."""
    line = _line(ws)
    if not any(phrase in line for phrase in _DECLINING):
        return False
    rest = [own for own in map(words, _SENTENCE.split(answer)) if not any(phrase in _line(own) for phrase in _DECLINING)]
    return len({w for own in rest for w in own if len(w) > 3 and w not in _SPOKEN and w in have}) <= ECHO


def is_empty(answer: str | None) -> bool:
    return answer is None or not any(x.isalnum() for x in answer) or answer.strip().strip("`\"'* ") == FAILURE_MARKER


def answer_words(rows: DataFrame, answer: str) -> DataFrame:
    """(language, word, rows): how many answers of a language have a word; the empty word counts the answers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def take() -> pd.DataFrame:
            out = pd.DataFrame([(*k, n) for k, n in held.items()], columns=["language", "word", "rows"])
            held.clear()
            return out

        for batch in batches:
            for text in batch["text"]:
                if not is_empty(text):
                    ws = words(text)
                    spoken = language(text, ws=ws) or ""
                    held.update([(spoken, w) for w in {"", *ws}])
            if len(held) > COUNTED:
                yield take()
        yield take()

    parts = rows.select(F.col(answer).alias("text")).mapInPandas(count, "language string, word string, rows long")
    return parts.groupBy("language", "word").agg(F.sum("rows").alias("rows"))


def kept_words(rows: DataFrame, answer: str) -> dict[str, frozenset[str]]:
    """Words without digits that enough answers of each language have."""
    counts = materialize(answer_words(rows, answer).filter((F.col("rows") >= KEPT_ROWS) | (F.col("word") == "")), "answer-words")
    total = F.broadcast(counts.filter("word = ''").select("language", F.col("rows").alias("_all")))  # a row for each language
    kept = counts.filter((F.col("word") != "") & ~F.col("word").rlike("[0-9]")).join(total, "language").filter(F.col("rows") >= KEPT * F.col("_all"))
    out: dict[str, set[str]] = {}
    for r in bounded_rows(kept.select("language", "word"), VOCABULARY, "words kept"):
        out.setdefault(r.language, set()).add(r.word)
    return {k: frozenset(v) for k, v in out.items()}


_CHECKED = T.StructType([T.StructField("openings", T.ArrayType(T.StringType())), T.StructField("plain", T.BooleanType()), T.StructField("declines", T.BooleanType()), T.StructField("empty", T.BooleanType()), T.StructField("copy", T.BooleanType()), T.StructField("language", T.BooleanType())])


def _checker(kept: Broadcast):
    @F.pandas_udf(_CHECKED)
    def check(instruction: pd.Series, answer: pd.Series, cut: pd.Series) -> pd.DataFrame:
        out = []
        for i, a, c in zip(instruction, answer, cut):
            i = i or ""
            if is_empty(a):
                out.append(([], False, False, True, False, False))
                continue
            ws, asking = words(a), words(i)
            have = frozenset(asking)
            spoken = language(a, ws=ws)
            asked = wanted_language(i, have) if spoken and not _is_json(a) else None
            known = kept.value.get(spoken or "", frozenset())
            own = sum(w not in known for w in ws)
            masked = {" ".join(w if w in known else "_" for w in opening) for opening in openings(a)}
            begun = sorted(m for m in masked if len(m.split()) - m.split().count("_") >= TEMPLATE_WORDS)
            out.append((begun, own <= max(OWN_WORDS, OWN_SHARE * len(ws)), declines(a, ws, have), False, is_copy(asking, ws, have, i, bool(c)), bool(spoken and asked and spoken != asked)))
        return pd.DataFrame(out, columns=_CHECKED.names)

    return check


def _is_json(text: str) -> bool:
    if not text.lstrip().startswith(("{", "[")):
        return False
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return text.lstrip().startswith("{")
    return True


def _hashed(openings: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the words of each opening; each turn of a word in an opening is a word of its own."""
    import xxhash

    known: dict[tuple[str, int], int] = {}
    flat, offsets = [], [0]
    for text in openings:
        ws = text.split(" ")
        for k, w in enumerate(ws):
            turn = w, ws[:k].count(w)
            if turn not in known:
                known[turn] = xxhash.xxh64_intdigest(w, seed=turn[1])
            flat.append(known[turn])
        offsets.append(len(flat))
    return np.array(flat, np.uint64), np.array(offsets)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _numbers(opening: pd.Series) -> pd.Series:
    h, offsets = _hashed(opening)
    return pd.Series(np.split(h.view(np.int64), offsets[1:-1])[: len(opening)], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bands(opening: pd.Series) -> pd.Series:
    seeds = np.random.default_rng(7).integers(1, 2**31, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out: list[np.ndarray] = []
    for start in range(0, len(opening), 1000):
        h, offsets = _hashed(opening.iloc[start : start + 1000])
        low = np.minimum.reduceat((h[:, None] * seeds[None, :]) ^ (h[:, None] >> np.uint64(29)), offsets[:-1]).reshape(-1, BANDS, HASHES // BANDS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), low.shape[:2])
        for k in range(low.shape[2]):
            key = (key ^ low[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            key = key ^ (key >> np.uint64(32))
        out.extend(key.view(np.int64))
    return pd.Series(out, dtype=object)


def _alike() -> Column:
    """Whether an opening of words ``_w`` is like its representative of words ``_hw``."""
    return F.size(F.array_intersect("_w", "_hw")) >= SIMILAR * F.greatest(F.size("_w"), F.size("_hw"))


def cluster_openings(counted: DataFrame) -> DataFrame:
    """(opening, template): each opening of (opening, rows) with its verified representative, at worst itself.

    The most frequent opening of a bucket represents it, so no pairs inside a bucket are formed; only numbers of
    openings go through the buckets. Sides that grow with the data are merged: their compressed size would let them be broadcast.
    """
    listed = counted.select("opening", "rows", F.xxhash64("opening").alias("_id"))
    buckets = listed.select("_id", "rows", F.explode(_bands("opening")).alias("band"))
    heads = buckets.groupBy("band").agg(F.max_by("_id", F.struct("rows", "_id")).alias("_head"))
    near = buckets.select("_id", "band").join(heads.hint("merge"), "band").select("_id", "_head").distinct()
    worded = listed.withColumn("_w", _numbers("opening"))
    head = worded.select(F.col("_id").alias("_head"), F.col("opening").alias("template"), F.col("_w").alias("_hw"), F.col("rows").alias("_hr"))
    both = near.join(worded.select("_id", "opening", "_w").hint("merge"), "_id").join(head.hint("merge"), "_head")
    return both.filter(_alike()).groupBy("opening").agg(F.max_by("template", F.struct("_hr", "template")).alias("template"))


def rows_alike(counted: DataFrame, templates: DataFrame) -> DataFrame:
    """(template, others): rows of the openings of (opening, rows) that are like a template, whichever cluster they are in."""
    heads = materialize(templates.select("template", _numbers("template").alias("_hw"), F.explode(_bands("template")).alias("band")), "template-bands")
    listed = counted.select("opening", "rows", _numbers("opening").alias("_w"), F.explode(_bands("opening")).alias("band"))
    met = listed.join(broadcast_if_small(heads, REFUSING * BANDS), "band").filter(_alike()).select("template", "opening", "rows").distinct()
    return met.groupBy("template").agg(F.sum("rows").alias("others"))


def refusing_openings(checked: DataFrame) -> DataFrame:
    """The openings of templates that recur across unrelated prompts and whose answers are plain.

    A template must recur in its own words, as texts of few words are often alike by chance; its variants then are
    judged and found with it. Openings without a plain answer are in no cluster, but they count against the templates
    they are like.
    """
    begun = checked.filter(~F.col("empty")).select("plain", "prompt", "kind", F.explode("openings").alias("opening"))
    flag = F.col("plain").cast("long")
    counted = begun.groupBy("opening").agg(F.count(F.lit(1)).alias("rows"), F.sum(flag).alias("plain"), F.hll_sketch_agg("prompt", 10).alias("prompts"), F.hll_sketch_agg("kind", 10).alias("kinds"))
    # sketches only where they are needed: most openings have no plain answer
    own = F.col("plain") > 0
    counted = materialize(counted.select("opening", "rows", "plain", *[F.when(own, F.col(c)).alias(c) for c in ("prompts", "kinds")]), "openings")
    clusters = materialize(cluster_openings(counted.filter(own)), "clusters")
    linked = counted.filter(own).join(clusters.hint("merge"), "opening")
    # its own opening among them: one that went to a larger cluster is no template
    recurs = (F.col("opening") == F.col("template")) & (F.hll_sketch_estimate("prompts") >= PROMPTS) & (F.hll_sketch_estimate("kinds") >= KINDS)
    judged = linked.groupBy("template").agg(F.sum("rows").alias("_rows"), F.sum("plain").alias("_plain"), F.bool_or(recurs).alias("_recurs"))
    judged = judged.filter(F.col("_recurs") & (F.col("_plain") >= PLAIN * F.col("_rows"))).drop("_recurs")
    recurring = materialize(judged, "templates")
    weighed = recurring.join(rows_alike(counted.filter(~own), recurring), "template", "left").filter(F.col("_plain") >= PLAIN * (F.col("_rows") + F.coalesce("others", F.lit(0))))
    return clusters.join(weighed.select("template").hint("merge"), "template").select("opening")


def defects(df: DataFrame, key: str = "pair_id", instruction: str = "instruction", answer: str = "answer", dataset: str = "dataset_name") -> DataFrame:
    """(key, defect) of the pairs whose answer does not serve the instruction; one defect per pair, one row per key.

    In order: ``empty``, ``copy``, ``refusal``, ``language``, ``truncated``. A null instruction has no language and
    cannot be copied. Redelivered rows count once. Texts of any length are read whole. An empty table gives no rows.
    """
    rows = df.select(F.lit("instruct_pairs").alias("src_table"), F.col(key).alias("row_id"), F.col("source"), F.col(answer).alias("text"), F.col(instruction).alias("_i"), F.col(dataset).alias("_d"))
    kept = df.sparkSession.sparkContext.broadcast(kept_words(df, answer))  # at most VOCABULARY words
    scored = truncation.score(rows).withColumn("_c", _checker(kept)("_i", "text", "cut"))
    kind = F.xxhash64("_d", F.slice(F.split(F.lower("_i"), " ", KIND + 1), 1, KIND))
    checked = materialize(scored.select("row_id", "cut", F.xxhash64("_i").alias("prompt"), kind.alias("kind"), "_c.*"), "pair-checks")
    refusing = broadcast_if_small(materialize(refusing_openings(checked), "refusing-openings"), REFUSING)
    refused = checked.filter("plain").select("row_id", F.explode("openings").alias("opening")).join(refusing, "opening").select("row_id", F.lit(True).alias("_refuses")).distinct()
    joined = checked.join(refused.hint("merge"), "row_id", "left")
    refusal = F.coalesce("_refuses", F.lit(False)) & F.col("plain") | F.col("declines")
    defect = F.when(F.col("empty"), "empty").when(F.col("copy"), "copy").when(refusal, "refusal").when(F.col("language"), "language").when(F.col("cut"), "truncated")
    found = joined.select(F.col("row_id").alias(key), defect.alias("defect")).filter(F.col("defect").isNotNull())
    return found.groupBy(key).agg(F.min("defect").alias("defect"))
