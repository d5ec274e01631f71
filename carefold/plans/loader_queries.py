"""Knowledge files written from given tables, loaded again, and compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carefold.plans.inputs import Inputs
from carefold.plans.registry import query
from carefold.session import shared_folder
from carefold.sources import knowledge


#: Rows of the table in one document of a folder.
DOCUMENT_ROWS = 1000


def _folder(i: Inputs, table: str, key: str, content: str, document_rows: int = DOCUMENT_ROWS) -> str:
    """A folder of JSON documents: ``content`` is an aggregate over the rows of ``table`` that fall into one bucket of ``key``.

    A document is a file of its own and holds about ``document_rows`` rows, so no task puts the table together.
    """
    path = f"{shared_folder(i.spark)}/knowledge-{uuid.uuid4().hex}"
    rows = i.table(table)
    buckets = max(1, -(-rows.count() // document_rows))
    rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy("bucket").agg(
        F.expr(f"to_json({content})").alias("value")
    ).write.partitionBy("bucket").text(path)
    return path


def _map(key: str, *fields: str) -> str:
    return f"map_from_entries(collect_list(struct({key}, named_struct({', '.join(fields)}))))"


_LABELLED = ("'code'", "concat('C-', s_suppkey)", "'display'", "s_name")


@query("loaded_ontology", """
SELECT 'lab' AS domain, 'lab ' || s_suppkey AS key, 'C-' || s_suppkey AS code, s_name AS display, 'u' || s_nationkey AS unit, NULL AS drug_class,
  'a' || s_suppkey || ',b' || s_suppkey AS aliases FROM supplier
UNION ALL SELECT 'medication', 'drug ' || s_suppkey, 'C-' || s_suppkey, s_name, NULL, 'class ' || s_nationkey, '' FROM supplier
UNION ALL SELECT 'diagnosis', 'code ' || s_suppkey, 'C-' || s_suppkey, s_name, NULL, NULL, '' FROM supplier""")
def loaded_ontology(i: Inputs) -> DataFrame:
    labs = _folder(i, "supplier", "s_suppkey", "named_struct('loinc_codes', " + _map(
        "concat('lab ', s_suppkey)", *_LABELLED, "'unit_canonical'", "concat('u', s_nationkey)",
        "'aliases'", "array(concat('a', s_suppkey), concat('b', s_suppkey))") + ")")
    others = _folder(i, "supplier", "s_suppkey", "named_struct('rxnorm_codes', " + _map(
        "concat('drug ', s_suppkey)", *_LABELLED, "'drug_class'", "concat('class ', s_nationkey)")
        + ", 'icd10_codes', " + _map("concat('code ', s_suppkey)", *_LABELLED) + ")")
    return knowledge.load_ontology(i.spark, labs, others).select(
        "domain", "key", "code", "display", F.col("unit_canonical").alias("unit"), "drug_class",
        F.array_join("aliases", ",").alias("aliases"),
    )


@query("loaded_ranges", """
SELECT 'C-' || s_suppkey AS code, 'u' || s_nationkey AS unit, b.band_pos, CASE WHEN b.band_pos = 0 THEN 'male' END AS sex,
  s_nationkey::DOUBLE AS low, (s_nationkey + 10 + b.band_pos)::DOUBLE AS high, CASE WHEN s_suppkey % 2 = 0 THEN 1.5::DOUBLE END AS critical_low
FROM supplier, (VALUES (0), (1)) b(band_pos)""")
def loaded_ranges(i: Inputs) -> DataFrame:
    band = "named_struct('sex', {sex}, 'low', cast(s_nationkey AS double), 'high', cast(s_nationkey + {top} AS double), 'interpretation', 'normal')"
    path = _folder(i, "supplier", "s_suppkey", "named_struct('reference_ranges', " + _map(
        "concat('C-', s_suppkey)", "'unit'", "concat('u', s_nationkey)", "'critical_low'", "if(s_suppkey % 2 = 0, 1.5D, null)",
        "'ranges'", f"array({band.format(sex=chr(39) + 'male' + chr(39), top=10)}, {band.format(sex='cast(null AS string)', top=11)})") + ")")
    return knowledge.load_reference_ranges(i.spark, path).select("code", "unit", "band_pos", "sex", "low", "high", "critical_low")


@query("loaded_unit_factors", """
SELECT 'analyte ' || s_suppkey AS analyte, f.from_unit, f.to_unit,
  CASE f.from_unit WHEN 'a' THEN s_suppkey / 4.0::DOUBLE WHEN 'C' THEN 9 / 5.0::DOUBLE ELSE 5 / 9.0::DOUBLE END AS slope,
  CASE f.from_unit WHEN 'a' THEN 0 WHEN 'C' THEN 32 ELSE -32 * 5 / 9.0::DOUBLE END::DOUBLE AS "offset"
FROM supplier, (VALUES ('a', 'b'), ('C', 'F'), ('F', 'C')) f(from_unit, to_unit)""")
def loaded_unit_factors(i: Inputs) -> DataFrame:
    """A plain factor and the two linear formulas."""
    path = _folder(i, "supplier", "s_suppkey", "named_struct('unit_conversions', map_from_entries(collect_list(struct(concat('analyte ', s_suppkey), map("
                 "'a_to_b', cast(s_suppkey / 4.0D AS string), 'C_to_F', 'formula: x * 9 / 5 + 32', 'F_to_C', 'formula: (x - 32) * 5 / 9')))))")
    return knowledge.load_unit_factors(i.spark, path).select("analyte", "from_unit", "to_unit", "slope", "offset")


@query("loaded_critical_rules", """
SELECT 'C-' || s_suppkey AS metric_code, CASE WHEN s_suppkey % 2 = 0 THEN 'low' ELSE 'high' END AS condition, s_suppkey / 8.0::DOUBLE AS threshold,
  'u' || s_nationkey AS unit, 'call' AS action, s_name AS reason FROM supplier""")
def loaded_critical_rules(i: Inputs) -> DataFrame:
    path = _folder(i, "supplier", "s_suppkey", "named_struct('critical_value_rules', collect_list(named_struct('metric_code', concat('C-', s_suppkey), "
                 "'condition', if(s_suppkey % 2 = 0, 'low', 'high'), 'threshold', s_suppkey / 8.0D, 'unit', concat('u', s_nationkey), 'action', 'call', 'reason', s_name)))")
    return knowledge.load_critical_rules(i.spark, path).select("metric_code", "condition", "threshold", "unit", "action", "reason")
