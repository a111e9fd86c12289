"""Named datasets as data: how each is read and how its rows become instruction and answer pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Recipe:
    """Reader format, kind of instruction, the columns it uses, rows of the training split."""

    format: str
    kind: str
    answer: str
    rows: int
    feature: str = ""
    keys: tuple[str, ...] = ()
    template: str = "Write a text."


#: Templates by name: what a run asks for. ``{feature}`` is the feature column, other names are keys of a JSON column.
TEMPLATES: dict[str, str] = {
    "uncond_generation": "Write a text.",
    "moviejson-gen": "Write one film as a JSON object with title, year, cast, genres, href and extract.",
    "pubmed_openreview_mixture_generation": "Write a biomedical abstract or a review of a paper.",
    "enron_generation": "Write an email as people at work send them.",
    "enron_evaluation": "Go on with this email.",
    "enron-freeform-conditions_generation": "Describe in free words the features of an email at work.",
    "enron-schema-conditions_generation": "Write the features of an email at work as a JSON object.",
    "enron-condgen-freeform_generation": "Write an email with these features, given in free words: {feature}",
    "enron-condgen-schema_generation": "Write an email with the features of this JSON object: {feature}",
    "enron-condgen-topic_generation": "Write an email about these topics: {feature}",
    "enron-freeform-e2e_generation": "Write a summary of an email under SUMMARY, then the email under EMAIL.",
    "PMC_generation": "Write a clinical note about one patient.",
    "PMC-conditions_generation": "Write a summary of a clinical note.",
    "PMC-condgen_generation": "Write the clinical note of which this is the summary: {feature}",
    "biorxiv_generation": "Write the abstract of a preprint in biology.",
    "biorxiv-conditions_generation": "Write length, category and title of a preprint as a JSON object.",
    "biorxiv-complex8-conditions_generation": "Write the eight features of a preprint as a JSON object.",
    "biorxiv-complex8et-conditions_generation": "Write the eight features of a preprint as a JSON object, options word by word.",
    "biorxiv-nl3-condgen_generation": 'Write an abstract of about {token_counts} tokens in {category} with the title "{title}".',
    "biorxiv-category-conditions_generation": "Name the category of a preprint.",
    "biorxiv-condgen_generation": "Write the abstract that fits this JSON object: {feature}",
    "biorxiv-category-condgen_generation": "Write an abstract of this category: {feature}",
    "biorxiv_noexample_generation": "Write an abstract with these features, whose options were listed without examples: {feature}",
    "biorxiv_example50_generation": "Write an abstract with these features, whose options were listed from fifty examples: {feature}",
    "biorxiv_evaluation": "Go on with this abstract.",
}

_FIXED, _FILLED = "Write a text of this collection.", "Write a text that fits these features: {feature}"
_ABSTRACT = {"format": "csv", "rows": 28_846}
_MAIL = {"format": "csv", "rows": 33_508}
_NOTE = {"format": "json", "rows": 25_000}

#: Names of datasets with their readers, columns and sizes.
DATASETS: dict[str, Recipe] = {
    "movie-json": Recipe("parquet", "fixed", "text", 26_963, template=_FIXED),
    "pubmed_openreview_mixture": Recipe("parquet", "fixed", "text", 76_069, template=_FIXED),
    **{n: Recipe(kind="fixed", answer="content", template=_FIXED, **_MAIL) for n in ("enron", "enron-eval", "enron-short", "enron-medium", "enron-long", "enron-generated", "enron-eval-generated")},
    "enron-freeform-conditions": Recipe(kind="fixed", answer="extracted_features", template=_FIXED, **_MAIL),
    "enron-condgen-freeform": Recipe(kind="column", answer="content", feature="extracted_features", template=_FILLED, **_MAIL),
    "enron-freeform-e2e": Recipe(kind="joined", answer="content", feature="extracted_features", keys=("SUMMARY", "EMAIL"), template=_FIXED, **_MAIL),
    "enron-schema-conditions": Recipe(kind="fixed", answer="extracted_schema", template=_FIXED, **_MAIL),
    "enron-condgen-schema": Recipe(kind="column", answer="content", feature="extracted_schema", template=_FILLED, **_MAIL),
    "enron-condgen-topic": Recipe(kind="column", answer="content", feature="topic_keywords", template=_FILLED, **_MAIL),
    "PMC": Recipe(kind="fixed", answer="note", template=_FIXED, **_NOTE),
    "PMC-conditions": Recipe(kind="fixed", answer="summary", template=_FIXED, **_NOTE),
    "PMC-condgen": Recipe(kind="column", answer="note", feature="summary", template=_FILLED, **_NOTE),
    "biorxiv": Recipe(kind="fixed", answer="abstract", template=_FIXED, **_ABSTRACT),
    "biorxiv-category-conditions": Recipe(kind="fixed", answer="category", template=_FIXED, **_ABSTRACT),
    "biorxiv-category-condgen": Recipe(kind="column", answer="abstract", feature="category", template=_FILLED, **_ABSTRACT),
    "biorxiv-conditions": Recipe(kind="fixed", answer="selected_schema", template=_FIXED, **_ABSTRACT),
    "biorxiv-condgen": Recipe(kind="column", answer="abstract", feature="selected_schema", template=_FILLED, **_ABSTRACT),
    "biorxiv-nl3-condgen": Recipe(kind="json", answer="abstract", feature="selected_schema", keys=("token_counts", "category", "title"), template='Write an abstract of about {token_counts} tokens in {category} with the title "{title}".', **_ABSTRACT),
    **{n: Recipe(kind="fixed", answer="schema", template=_FIXED, **_ABSTRACT) for n in ("biorxiv-complex8-conditions", "biorxiv-complex8et-conditions")},
    **{n: Recipe(kind="column", answer="abstract", feature="schema", template=_FILLED, **_ABSTRACT) for n in ("biorxiv-complex8-condgen", "biorxiv-complex8et-condgen", "biorxiv_noexample", "biorxiv_example50")},
    "biorxiv-generated": Recipe("csv", "fixed", "abstract", 5_000, template=_FIXED),
}


def recipe(name: str) -> Recipe:
    if name not in DATASETS:
        raise KeyError(f"unknown dataset {name!r}; known are {', '.join(sorted(DATASETS))}")
    return DATASETS[name]


def template(name: str) -> str:
    """The template of that name."""
    if name not in TEMPLATES:
        raise KeyError(f"unknown template {name!r}; known are {', '.join(sorted(TEMPLATES))}")
    return TEMPLATES[name]


def named_in(path: str | Column) -> str | Column | None:
    """The dataset whose name a path (or each path of a column) contains, the longest first."""
    names = sorted(DATASETS, key=len, reverse=True)
    if isinstance(path, str):
        return next((n for n in names if n in path), None)
    return F.coalesce(*[F.when(F.contains(path, F.lit(n)), n) for n in names])
