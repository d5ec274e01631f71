"""Which entities stand behind evidence, queries and insights, as long rows.

A trend rests on all points of its series. Pools, queries and drafts carry one reference per series (``trend:<code>``) instead of
a list that grows with it; here the references meet the points, after screening and citation have left few of them. A row per
entity is never too wide, and a series of very many points is the large side of a join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Begin of a reference to all points of a series of the patient.
SERIES = "trend:"


def entities_behind(rows: DataFrame, points: DataFrame, keys: list[str], references: str) -> DataFrame:
    """``keys`` and ``entity_id``, each pair once, of the references in the array column ``references``.

    ``keys`` must name ``patient_id``. ``points``: patient_id, code, entity_id. A reference that names no series is an entity
    id itself; a series without points, a null array and null references give no row.
    """
    listed = rows.select(*keys, F.explode(references).alias("_reference")).filter(F.col("_reference").isNotNull()).distinct()
    is_series = F.col("_reference").startswith(SERIES)
    own = listed.filter(~is_series).select(*keys, F.col("_reference").alias("entity_id"))
    series = listed.filter(is_series).withColumn("_code", F.substring("_reference", len(SERIES) + 1, 1 << 20))
    held = points.select(F.col("patient_id").alias("_patient"), F.col("code").alias("_point_code"), "entity_id")
    behind = series.join(held, (F.col("patient_id") == F.col("_patient")) & (F.col("_code") == F.col("_point_code"))).select(*keys, "entity_id")
    return own.unionByName(behind).distinct()
