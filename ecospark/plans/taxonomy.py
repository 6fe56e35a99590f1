"""Taxonomy and trait dimension with a second opinion on the trait."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import recode
from ..operators import clean, compose, joins
from ..vocabulary import TAXONOMY_RANKS, TROPHIC_CODES


def taxonomy_dimension(info: DataFrame) -> DataFrame:
    """Ranks and trait of every genus."""
    return clean.select_cols(
        clean.rename(info, {"Final_Nutrition_Strategy": "strat"}), keep=[*TAXONOMY_RANKS, "strat"]
    )


def second_opinion(info: DataFrame, codes: DataFrame, trophic: DataFrame) -> DataFrame:
    """Every genus with its trait and the most frequent trait of its species elsewhere."""
    species = joins.attach(trophic, codes, "species_code").withColumnRenamed("genus", "Genus")
    modal = compose.mode_by(species, "Genus", "trophic_type").select("Genus", F.col("mode").alias("strategy_species"))
    both = joins.attach(info.withColumnRenamed("Final_Nutrition_Strategy", "strategy_new"), modal, "Genus")
    return both.withColumn("strategy_species", recode(F.col("strategy_species"), TROPHIC_CODES))


def opinion_crosstab(opinions: DataFrame) -> DataFrame:
    return compose.crosstab(opinions, "strategy_new", "strategy_species")


def opinion_conflicts(opinions: DataFrame) -> DataFrame:
    return clean.disagreements(opinions, "strategy_new", "strategy_species").select("Genus", "strategy_new", "strategy_species")
