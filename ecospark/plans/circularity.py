"""Is the link between diversity and mixotroph prevalence built into the metrics?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, joins, stats
from ..operators.smooth import smooth_permutation
from ..sources.tables import checkpointed
from ..vocabulary import DIVERSITY, DIVERSITY_CORR
from .survey import corrected_metrics, full_metrics, phyto_cells


def diversity_table(phyto: DataFrame, members: DataFrame) -> DataFrame:
    """Full and corrected diversity of every site with an autotroph, and its prevalence."""
    cells = checkpointed(phyto_cells(phyto, members))
    full = full_metrics(cells).select("lake_id", *DIVERSITY, "prev_Mixo")
    return joins.attach(corrected_metrics(cells), full, "lake_id")


def circularity_report(table: DataFrame) -> DataFrame:
    """Straight lines of full and corrected diversity against prevalence, with row losses."""
    metrics = [*DIVERSITY, *DIVERSITY_CORR]
    numbers = table.select("prev_Mixo", *[F.col(m).cast("double").alias(m) for m in metrics])
    lines = stats.linear_fit(numbers, "prev_Mixo", metrics)
    loss = clean.null_profile(table.select(*metrics))
    return joins.attach(lines, loss, "variable")


def artefact_test(table: DataFrame, nperm: int = 1000, seed: int = 123) -> DataFrame:
    """Permutation test of the smooth of Shannon diversity on prevalence."""
    return smooth_permutation(table, "prev_Mixo", "shannon", "lake_id", nperm, seed)
