"""Names and labels: cleaning, mapping to a reference list, ordered label rules."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ZERO_WIDTH = "[​‌‍﻿]"


@F.pandas_udf(StringType())
def clean_name(v: pd.Series) -> pd.Series:
    """Compatibility form of Unicode, without zero-width characters and outer white space."""
    return v.map(lambda s: None if s is None else re.sub(ZERO_WIDTH, "", unicodedata.normalize("NFKC", s)).strip())


def map_names(names: DataFrame, known: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """names(name) with mapped and status: exact, alias, case (one match without case), ambiguous or absent.

    known(symbol) and aliases(alias, symbol) are joined, never collected. Names that repeat give rows each.
    """
    aliases = aliases if aliases is not None else known.select(F.col("symbol").alias("alias"), "symbol").limit(0)
    exact = known.select(F.col("symbol").alias("name"), F.col("symbol").alias("by_name")).distinct()
    alias = aliases.join(known, "symbol", "left_semi").groupBy(F.col("alias").alias("name")).agg(F.min("symbol").alias("by_alias"))
    folded = known.distinct().groupBy(F.lower("symbol").alias("folded")).agg(F.min("symbol").alias("by_case"), F.count("*").alias("n_case"))
    out = names.join(exact, "name", "left").join(alias, "name", "left").withColumn("folded", F.lower("name")).join(folded, "folded", "left")
    status = F.when(F.col("by_name").isNotNull(), "exact").when(F.col("by_alias").isNotNull(), "alias").when(F.col("n_case") == 1, "case").when(F.col("n_case") > 1, "ambiguous").otherwise("absent")
    mapped = F.coalesce("by_name", "by_alias", F.when(F.col("n_case") == 1, F.col("by_case")))
    return out.select("name", mapped.alias("mapped"), status.alias("status"))


def label_by_rules(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first rule (pattern, label) that the text matches, without case."""
    out = F
    for pattern, label in rules:
        out = out.when(text.rlike(f"(?i){pattern}"), F.lit(label))
    return out.otherwise(F.lit(default))


def flag_by_parts(text: Column, prefixes: tuple[str, ...] = (), parts: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> Column:
    """Whether an upper-case name starts with a prefix, holds a part or is listed."""
    up = F.upper(text)
    flag = up.isin(*names) if names else F.lit(False)
    for p in prefixes:
        flag = flag | up.startswith(p)
    for p in parts:
        flag = flag | up.contains(p)
    return flag


def split_list(text: Column, separator: str = ";") -> Column:
    """The trimmed, non-empty parts of a list in a string; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), re.escape(separator)), lambda s: F.trim(s)), lambda s: s != "")
