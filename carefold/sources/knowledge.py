"""Knowledge tables: ontologies, reference bands, guidelines, rules and factors.

Each loader reads the deployment's JSON file with an explicit schema and
explodes it to flat rows; ``builtin_*`` gives the shipped rows in the same
schema as a local relation whose size the planner knows exactly.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carefold.functions.text import empty_to_null
from carefold.sources import knowledge_values as kv

ONTOLOGY_SCHEMA = (
    "domain string, ordinal int, key string, code string, display string, "
    "unit_canonical string, drug_class string, aliases array<string>"
)
BAND_SCHEMA = (
    "code string, unit string, critical_low double, critical_high double, band_pos int, "
    "sex string, age_min int, age_max int, low double, high double, interpretation string"
)
FACTOR_SCHEMA = "analyte string, from_unit string, to_unit string, slope double, offset double"
GUIDELINE_SCHEMA = (
    "condition_pos int, condition string, display_name string, icd10_codes array<string>, "
    "metric_pos int, metric_code string, metric_name string, interval_days int, "
    "interval_description string, evidence_source string"
)
RULE_SCHEMA = (
    "rule_pos int, metric_code string, condition string, threshold double, unit string, "
    "action string, reason string"
)
METRIC_SCHEMA = "code string, metric_name string, higher_is_better boolean, interval_days int"


def local_frame(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A local relation (exact size statistics) holding constant rows."""
    arrow_schema = pa.schema(
        [pa.field(f.name, _arrow_type(f.dataType.simpleString())) for f in T.StructType.fromDDL(ddl)]
    )
    table = pa.Table.from_pylist(
        [{name: row.get(name) for name in arrow_schema.names} for row in rows], arrow_schema
    )
    return spark.createDataFrame(table)


def _arrow_type(simple: str) -> pa.DataType:
    scalar = {
        "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    }
    return scalar[simple] if simple in scalar else pa.list_(pa.string())


# --------------------------------------------------------------------------- ontologies
def builtin_ontology_rows() -> list[dict]:
    rows: list[dict] = []
    for pos, (key, code, display, unit, aliases) in enumerate(kv.LABS):
        rows.append(dict(domain="lab", ordinal=pos, key=key, code=code, display=display,
                         unit_canonical=unit, aliases=list(aliases)))
    for pos, (key, code, display, drug_class, aliases) in enumerate(kv.DRUGS):
        rows.append(dict(domain="medication", ordinal=pos, key=key, code=code, display=display,
                         drug_class=drug_class, aliases=list(aliases)))
    for pos, (key, code, display, aliases) in enumerate(kv.DIAGNOSES):
        rows.append(dict(domain="diagnosis", ordinal=pos, key=key, code=code, display=display,
                         aliases=list(aliases)))
    return rows


def builtin_ontology(spark: SparkSession) -> DataFrame:
    return local_frame(spark, builtin_ontology_rows(), ONTOLOGY_SCHEMA)


_ENTRY = (
    "struct<code:string,display:string,unit_canonical:string,drug_class:string,"
    "aliases:array<string>>"
)


def load_ontology(spark: SparkSession, lab_path: str, drug_diagnosis_path: str) -> DataFrame:
    """Both ontology files as one table; a missing file contributes no rows."""
    labs = _read_json(spark, lab_path, f"loinc_codes map<string,{_ENTRY}>", optional=True)
    others = _read_json(
        spark, drug_diagnosis_path,
        f"rxnorm_codes map<string,{_ENTRY}>, icd10_codes map<string,{_ENTRY}>", optional=True,
    )
    parts = [
        (labs, "loinc_codes", "lab"),
        (others, "rxnorm_codes", "medication"),
        (others, "icd10_codes", "diagnosis"),
    ]
    frames = [
        frame.select(F.posexplode(column).alias("ordinal", "key", "e")).select(
            F.lit(domain).alias("domain"), "ordinal", "key",
            F.col("e.code"), F.col("e.display"), F.col("e.unit_canonical"),
            F.col("e.drug_class"),
            F.coalesce(F.col("e.aliases"), F.array().cast("array<string>")).alias("aliases"),
        )
        for frame, column, domain in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def _read_json(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """A missing file is an error: without its rules and ranges no alarm would ever be raised."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as error:
        if not optional or "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def build_aliases(ontology: DataFrame) -> DataFrame:
    """Alias to key, as written (``exact``) and lower-cased (``lower``).

    A key is an alias of itself. When entries share an alias the entry
    defined last keeps it.
    """
    named = ontology.select(
        "domain", "ordinal", "key",
        F.posexplode(F.concat(F.array("key"), F.col("aliases"))).alias("alias_pos", "alias"),
    )
    both = named.select(
        "domain", "key", F.struct("ordinal", "alias_pos").alias("defined"),
        F.explode(F.array(
            F.struct(F.lit("exact").alias("form"), F.col("alias")),
            F.struct(F.lit("lower").alias("form"), F.lower("alias").alias("alias")),
        )).alias("a"),
    )
    return both.groupBy("domain", F.col("a.form").alias("form"), F.col("a.alias").alias("alias")).agg(
        F.max_by("key", "defined").alias("key")
    )


# --------------------------------------------------------------------------- bands, factors
def builtin_bands(spark: SparkSession) -> DataFrame:
    rows = []
    for code, unit, critical_low, critical_high, bands in kv.BANDS:
        for pos, (sex, age_min, age_max, low, high, interpretation) in enumerate(bands):
            rows.append(dict(
                code=code, unit=unit, critical_low=_double(critical_low),
                critical_high=_double(critical_high), band_pos=pos, sex=sex, age_min=age_min,
                age_max=age_max, low=low, high=high, interpretation=interpretation,
            ))
    return local_frame(spark, rows, BAND_SCHEMA)


def _double(value: float | None) -> float | None:
    return None if value is None else float(value)


def load_reference_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Code to bands, keeping the order of the file in ``band_pos``."""
    band = (
        "struct<sex:string,age_min:int,age_max:int,low:double,high:double,interpretation:string>"
    )
    entry = (
        f"struct<unit:string,critical_low:double,critical_high:double,ranges:array<{band}>>"
    )
    raw = _read_json(spark, path, f"reference_ranges map<string,{entry}>")
    return (
        raw.select(F.explode("reference_ranges").alias("code", "e"))
        .select("code", "e.unit", "e.critical_low", "e.critical_high",
                F.posexplode("e.ranges").alias("band_pos", "b"))
        .select("code", "unit", "critical_low", "critical_high", "band_pos", "b.*")
    )


def builtin_unit_factors(spark: SparkSession) -> DataFrame:
    names = ("analyte", "from_unit", "to_unit", "slope", "offset")
    return local_frame(spark, [dict(zip(names, row)) for row in kv.UNIT_FACTORS], FACTOR_SCHEMA)


def load_unit_factors(spark: SparkSession, path: str) -> DataFrame:
    """``a_to_b`` keys with a number, or a linear formula, as slope and offset rows."""
    raw = _read_json(spark, path, "unit_conversions map<string,map<string,string>>")
    flat = raw.select(F.explode("unit_conversions").alias("analyte", "m")).select(
        "analyte", F.explode("m").alias("pair", "rule")
    )
    sides = F.split("pair", "_to_")
    formula = F.when(
        F.startswith("rule", F.lit("formula:")), F.regexp_replace("rule", "^formula:|\\s", "")
    )
    # (x-a)*b/c and x*b/c+a are the two linear shapes.
    shifted = r"^\(\w+-([\d.]+)\)\*([\d.]+)/([\d.]+)$"
    scaled = r"^\w+\*([\d.]+)/([\d.]+)\+([\d.]+)$"

    def part(pattern: str, group: int):
        return empty_to_null(F.regexp_extract(formula, pattern, group)).cast("double")

    shifted_slope = part(shifted, 2) / part(shifted, 3)
    return flat.select(
        "analyte", sides[0].alias("from_unit"), sides[1].alias("to_unit"),
        F.coalesce(
            F.col("rule").try_cast("double"), shifted_slope, part(scaled, 1) / part(scaled, 2)
        ).alias("slope"),
        F.coalesce(-part(shifted, 1) * shifted_slope, part(scaled, 3), F.lit(0.0)).alias("offset"),
    )


# --------------------------------------------------------------------------- guidelines, rules
def builtin_guidelines(spark: SparkSession) -> DataFrame:
    rows = []
    for cpos, (condition, display, codes, metrics) in enumerate(kv.GUIDELINES):
        for mpos, (code, name, days, description, source) in enumerate(metrics):
            rows.append(dict(
                condition_pos=cpos, condition=condition, display_name=display,
                icd10_codes=list(codes), metric_pos=mpos, metric_code=code, metric_name=name,
                interval_days=days, interval_description=description, evidence_source=source,
            ))
    return local_frame(spark, rows, GUIDELINE_SCHEMA)


_GUIDELINE_FILE = (
    "monitoring_guidelines map<string,struct<icd10_codes:array<string>,display_name:string,"
    "required_monitoring:array<struct<metric_code:string,metric_name:string,interval_days:int,"
    "interval_description:string,evidence_source:string,"
    "by_stage:map<string,struct<interval_days:int>>>>>>, "
    "critical_value_rules array<struct<metric_code:string,condition:string,threshold:double,"
    "unit:string,action:string,reason:string>>"
)


def load_guidelines(spark: SparkSession, path: str) -> DataFrame:
    raw = _read_json(spark, path, _GUIDELINE_FILE)
    return (
        raw.select(F.posexplode("monitoring_guidelines").alias("condition_pos", "condition", "e"))
        .select(
            "condition_pos", "condition",
            F.coalesce("e.display_name", "condition").alias("display_name"), "e.icd10_codes",
            F.posexplode("e.required_monitoring").alias("metric_pos", "m"),
        )
        .select("condition_pos", "condition", "display_name", "icd10_codes", "metric_pos",
                "m.metric_code", "m.metric_name", "m.interval_days", "m.interval_description",
                "m.evidence_source")
    )


def builtin_stage_intervals(spark: SparkSession) -> DataFrame:
    names = ("condition", "metric_code", "stage", "interval_days")
    return local_frame(
        spark, [dict(zip(names, row)) for row in kv.STAGE_INTERVALS],
        "condition string, metric_code string, stage string, interval_days int",
    )


def load_stage_intervals(spark: SparkSession, path: str) -> DataFrame:
    raw = _read_json(spark, path, _GUIDELINE_FILE)
    return (
        raw.select(F.explode("monitoring_guidelines").alias("condition", "e"))
        .select("condition", F.explode("e.required_monitoring").alias("m"))
        .select("condition", "m.metric_code", F.explode("m.by_stage").alias("stage", "s"))
        .select("condition", "metric_code", "stage", F.col("s.interval_days"))
    )


# Fixed value: the text of a passage; what is encoded and found depends on its wording.
PASSAGE_SENTENCE = "Condition: %s. Metric: %s (LOINC: %s). Interval: %s. Source: %s."


def guideline_passages(guidelines: DataFrame, category: str | None = "monitoring") -> DataFrame:
    """One retrievable passage per condition and metric, ids from 1 in file order."""
    from pyspark.sql import Window

    snippet = F.format_string(
        PASSAGE_SENTENCE, "display_name", "metric_name", "metric_code", "interval_description", "evidence_source",
    )
    # The guideline file is a few rows, so numbering it in one task is safe.
    order = Window.partitionBy(F.lit(0)).orderBy("condition_pos", "metric_pos")
    return guidelines.select(
        F.row_number().over(order).alias("passage_id"),
        "condition", "display_name", "metric_name", "metric_code", "interval_days",
        "evidence_source", F.lit(category).cast("string").alias("category"),
        snippet.alias("text"),
    )


def builtin_critical_rules(spark: SparkSession) -> DataFrame:
    names = ("metric_code", "condition", "threshold", "unit", "action", "reason")
    rows = [dict(zip(names, row), rule_pos=pos) for pos, row in enumerate(kv.CRITICAL_RULES)]
    return local_frame(spark, rows, RULE_SCHEMA)


def load_critical_rules(spark: SparkSession, path: str) -> DataFrame:
    raw = _read_json(spark, path, _GUIDELINE_FILE)
    return raw.select(F.posexplode("critical_value_rules").alias("rule_pos", "r")).select(
        "rule_pos", "r.*"
    )


def builtin_metrics(spark: SparkSession) -> DataFrame:
    names = ("code", "metric_name", "higher_is_better", "interval_days")
    return local_frame(spark, [dict(zip(names, row)) for row in kv.METRICS], METRIC_SCHEMA)
