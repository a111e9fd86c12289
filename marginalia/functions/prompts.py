"""Instruction and answer pairs from feature columns, and prompt formats of judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import fill_template
from marginalia.sources.registry import Recipe

#: Split names; whatever is neither training nor one of these is the test split.
VALIDATION = ("validation", "valid", "val", "dev", "eval")


def split_of(name: Column) -> Column:
    """train, validation or test of a split name."""
    return F.when(name == "train", "train").when(name.isin(*VALIDATION), "validation").otherwise("test")


def pairs(df: DataFrame, recipe: Recipe, template: str | None = None) -> DataFrame:
    """(instruction, answer) of each row, as the recipe says.

    ``fixed``: one prompt; ``column``: a template around a feature column; ``json``: a template filled from the keys of a
    JSON column; ``joined``: a fixed prompt, and an answer of two columns with their headings.
    """
    text = template or recipe.template
    if recipe.kind == "fixed":
        instruction, answer = F.lit(text), F.col(recipe.answer)
    elif recipe.kind == "column":
        instruction, answer = fill_template(text, {"feature": F.col(recipe.feature)}), F.col(recipe.answer)
    elif recipe.kind == "json":
        instruction = fill_template(text, {k: F.get_json_object(recipe.feature, f"$.{k}") for k in recipe.keys})
        answer = F.col(recipe.answer)
    elif recipe.kind == "joined":
        instruction = F.lit(text)
        answer = F.concat(F.lit(f"{recipe.keys[0]}: "), F.col(recipe.feature), F.lit(f"\n{recipe.keys[1]}: "), F.col(recipe.answer))
    else:
        raise ValueError(f"unknown kind {recipe.kind!r}")
    return df.select(instruction.alias("instruction"), answer.alias("answer"))


def question_answer(query: Column, response: Column) -> Column:
    return F.concat(F.lit("Question: "), query, F.lit("\nAnswer: "), response)


def concatenated(query: Column, response: Column) -> Column:
    return F.concat(query, response)


def response_only(query: Column, response: Column) -> Column:
    return response


FORMATS = {"qaform": question_answer, "anscat": concatenated, "ansonly": response_only}


def judge_prompt(template: str, condition: Column, response: Column) -> Column:
    """A judge's prompt with the condition and the response filled in."""
    return fill_template(template, {"condition": condition, "response": response})
