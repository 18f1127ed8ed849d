"""The reader's profile: a head with a list of interests, validated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.markdown import split_front_matter

MOST, LONGEST = 20, 300


def parse(text: str) -> list[str]:
    got = split_front_matter(text)
    return validate(list((got[0] if got else {}).get("interests") or []))


def validate(interests: list[str]) -> list[str]:
    """1 to 20 interests, none blank, none over 300 characters, none twice."""
    clean = [" ".join(str(i).split()) for i in interests]
    if not 1 <= len(clean) <= MOST:
        raise ValueError(f"1 to {MOST} interests")
    for i in clean:
        if not i or len(i) > LONGEST:
            raise ValueError(f"an interest has 1 to {LONGEST} characters")
    if len({i.casefold() for i in clean}) < len(clean):
        raise ValueError("an interest is there twice")
    return clean


def frame(spark: SparkSession, interests: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(interests)), "facet int, interest string")
