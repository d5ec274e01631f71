"""The grain of a run: one document of a patient, or the patient where no document is named."""

from __future__ import annotations

from pyspark.sql import DataFrame

# A frame that carries ``run_id`` is cut, pooled and cited per run; one that does not, per patient.
RUN = ("patient_id", "run_id")


def run_keys(df: DataFrame) -> list[str]:
    """The columns of ``df`` that name a run."""
    return [c for c in RUN if c in df.columns]


def in_runs(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of a patient, such as trends, in each of the patient's runs."""
    return df.join(runs.select(*RUN).distinct(), "patient_id")
