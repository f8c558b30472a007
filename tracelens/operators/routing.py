"""Classification of exchanges, routes of classes, and distillation by a provider.

A provider is any object with classify(list of texts) -> list of categories and distill(text, category, profile) -> text.
It is called in Arrow batches where the rows are; the default needs no network. Shorter output only is accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# fixed values: categories by route
ROUTES = {
    "KEEP": ("INSTRUCTION", "CLARIFICATION", "CONFIRMATION", "INQUIRY", "DECISION", "FEEDBACK"),
    "DISTILL": ("EXPLANATION", "IMPLEMENTATION", "REASONING", "DEBUGGING", "METRICS", "COMPILATION", "PLANNING", "TESTING", "GIT_OPERATION", "ANALYSIS"),
    "HEURISTIC": ("STATUS_UPDATE", "NOTIFICATION", "LOG_OUTPUT", "SCAFFOLDING", "ERROR_OUTPUT"),
}
CATEGORIES = tuple(c for cs in ROUTES.values() for c in cs)


def route(category: Column) -> Column:
    """Unknown categories are routed as scaffolding."""
    out = F.when(category.isin(*ROUTES["KEEP"]), "KEEP").when(category.isin(*ROUTES["DISTILL"]), "DISTILL")
    return out.otherwise("HEURISTIC")


def rule_category(role: Column, text: Column) -> Column:
    """A classifier by rules, for where no provider is given."""
    return F.when((role == "user") & text.contains("?"), "INQUIRY").when(role == "user", "INSTRUCTION").when(role == "system", "NOTIFICATION").when(F.length(text) > 400, "EXPLANATION").otherwise("STATUS_UPDATE")


class Provider(Protocol):
    def classify(self, texts: list[str]) -> list[str]: ...

    def distill(self, text: str, category: str, profile: str) -> str: ...


class HeadProvider:
    """Keeps a text's first sentence or first 120 characters; classifies by length."""

    def classify(self, texts: list[str]) -> list[str]:
        return ["EXPLANATION" if len(t) > 400 else "STATUS_UPDATE" for t in texts]

    def distill(self, text: str, category: str, profile: str) -> str:
        return text.split(". ")[0][:120]


def parse_categories(answer: list[str], n: int) -> list[str]:
    """As many known categories as asked for; the rest is scaffolding."""
    good = [c if c in CATEGORIES else "SCAFFOLDING" for c in answer[:n]]
    return good + ["SCAFFOLDING"] * (n - len(good))


def classify(rows: DataFrame, provider: Provider, batch: int = 20, clip: int = 500) -> DataFrame:
    """rows with `category`, asked for in batches of clipped texts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, out = [t[:clip] for t in part["text"].fillna("")], []
            for k in range(0, len(texts), batch):
                out += parse_categories(provider.classify(texts[k : k + batch]), len(texts[k : k + batch]))
            yield part.assign(category=out)

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("category", StringType())]))


def distill(rows: DataFrame, provider: Provider, profile: str = "standard", above: float = 0.2, least: int = 200) -> DataFrame:
    """rows (text, category, aggr) with `new_text`: distilled where the route, place and length ask for it, else as it was."""
    asked = (route(F.col("category")) == "DISTILL") & (F.col("aggr") > F.lit(above)) & (F.length("text") > least)

    @F.pandas_udf(StringType())
    def shorter(texts: pd.Series, categories: pd.Series) -> pd.Series:
        made = [provider.distill(t, c, profile) for t, c in zip(texts, categories, strict=True)]
        return pd.Series([m if m and len(m) < len(t) else t for m, t in zip(made, texts, strict=True)])

    # only rows that ask for it reach Python
    todo = rows.where(asked).withColumn("new_text", shorter("text", "category"))
    return todo.unionByName(rows.where(~F.coalesce(asked, F.lit(False))).withColumn("new_text", F.col("text")))
