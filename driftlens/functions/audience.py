"""Audience cues. INTERNAL: results feed cohort counts only.

Nothing here may appear per account in a public output; operators release
k-anonymous cohorts built from these columns (operators.demographics).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import fixed


def default_gazetteer(spark: SparkSession) -> DataFrame:
    """(alias, region, is_city) rows of the built-in place names."""
    rows = [(city, state, True) for city, state in fixed.CITY_STATES.items()]
    rows += [(state, state, False) for state in fixed.STATES]
    return spark.createDataFrame(rows, "alias STRING, region STRING, is_city BOOLEAN")


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Gazetteer file: {"states": [{"name", "aliases": [], "cities": []}]}.

    Aliases and cities count as cities (looked up first), names as states.
    """
    doc = spark.read.option("multiLine", "true").schema(
        "states ARRAY<STRUCT<name: STRING, aliases: ARRAY<STRING>, cities: ARRAY<STRING>>>"
    ).json(path)
    state = doc.select(F.explode("states").alias("s")).select(
        F.lower("s.name").alias("region"),
        F.concat(F.coalesce("s.aliases", F.array()), F.coalesce("s.cities", F.array())).alias("places"),
    )
    places = state.select(F.lower(F.explode("places")).alias("alias"), "region", F.lit(True).alias("is_city"))
    names = state.select(F.col("region").alias("alias"), "region", F.lit(False).alias("is_city"))
    return places.unionByName(names).dropDuplicates(["alias", "is_city"])


def infer_region(accounts: DataFrame, gazetteer: DataFrame, keep: str = "a-z&", location: str = "location_text") -> DataFrame:
    """``accounts`` plus ``region``: whole-word gazetteer match on the location.

    Cities beat states, longer aliases beat shorter ones. The match is an equi
    join of word n-grams with the alias, on distinct locations, so a location
    shared by a third of all accounts is resolved once. Phrases are as
    long as the gazetteer's longest alias.
    """
    max_words = gazetteer.agg(F.max(F.size(F.split(F.trim("alias"), " +")))).first()[0] or 1
    locations = accounts.select(location).where(F.col(location).isNotNull()).distinct()
    cleaned = F.trim(F.regexp_replace(F.lower(F.col(location)), f"[^{keep}]+", " "))
    words = F.split(cleaned, " ")
    phrases = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size(words)),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(max_words), F.size(words) - i + 1)),
                lambda n: F.array_join(F.slice(words, i, n), " "),
            ),
        )
    )
    candidates = locations.select(location, F.explode(F.array_distinct(phrases)).alias("alias"))
    matched = (
        candidates.join(gazetteer, "alias")
        .groupBy(location)
        .agg(F.max_by("region", F.struct("is_city", F.length("alias"), "alias")).alias("region"))
    )
    return accounts.join(matched, location, "left")


def infer_interest(bio: Column, interests: dict[str, list[str]] | None = None) -> Column:
    """First category with a keyword inside the lower-cased bio, else other."""
    from driftlens.functions.text import contains_any

    lower = F.lower(bio)
    choice = F.when(bio.isNull() | (bio == ""), "other")
    for category, keywords in (fixed.INTERESTS if interests is None else interests).items():
        choice = choice.when(contains_any(lower, keywords), category)
    return choice.otherwise("other")


def infer_age_bracket(bio: Column, as_of_year: int) -> Column:
    """Adult bracket from explicit cues; any sign of a minor gives NULL."""
    lower = F.lower(bio)
    year = F.regexp_extract(lower, fixed.BIRTH_YEAR_CUE, 1)
    age = F.lit(as_of_year) - F.when(year != "", year).cast("int")
    bracket = None
    for limit, name in fixed.AGE_BRACKETS:
        value = F.lit(name).cast("string")
        bracket = F.when(age < limit, value) if bracket is None else bracket.when(age < limit, value)
    choice = F.when(bio.isNull(), F.lit(None).cast("string")).when(year != "", bracket.otherwise("50+"))
    for pattern, name in fixed.AGE_CUES:
        choice = choice.when(lower.rlike(pattern), F.lit(name).cast("string"))
    return choice
