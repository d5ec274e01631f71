"""Coding of entities against ontologies, with units and reference bands.

One pass over the entities: the ontology and the bands are small relations
joined by hash, and names without an exact entry are scored in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carefold import settings
from carefold.functions import units as un
from carefold.functions.similarity import best_alias, close_names
from carefold.functions.text import exact_round, strict_number
from carefold.operators.entities import Dictionary
from carefold.operators.table_dictionary import TableDictionary
from carefold.sources.knowledge import local_frame

# Coding systems, and the readings that name the normal band.
CODING_SYSTEMS = {"lab": "LOINC", "medication": "RxNorm", "diagnosis": "ICD-10"}
NORMAL_READINGS = "normal|desirable|optimal"
ADULT_AGE = 18


def domain_of(entity_type: Column) -> Column:
    return (
        F.when(entity_type.isin("lab_value", "vital_sign"), "lab")
        .when(entity_type.isin("medication", "diagnosis"), entity_type)
    )


def with_codes(
    entities: DataFrame, dictionary: Dictionary | TableDictionary, cutoff: float = settings.FUZZY_MATCH_CUTOFF
) -> DataFrame:
    """Adds the ontology entry, coding method and confidence.

    The label is looked up first. What it does not find goes through the
    approximate match: a lab by its label, drugs and diagnoses by their value.
    """
    spark = entities.sparkSession
    compiled = isinstance(dictionary, Dictionary)
    entries = (dictionary.ontology(spark) if compiled else dictionary.entries()).select(
        "domain", "key", "code", "display", "unit_canonical"
    )
    typed = entities.withColumn("domain", domain_of(F.col("entity_type")))
    exact = typed.alias("_entity").join(
        entries.alias("_entry"),
        (F.col("_entity.domain") == F.col("_entry.domain")) & (F.col("_entity.entity_label") == F.col("_entry.key")),
        "left",
    ).select("_entity.*", *[F.col(f"_entry.{c}").alias(f"x_{c}") for c in ("code", "display", "unit_canonical")],
             F.col("_entry.key").alias("x_key"))
    wanted = F.when(
        F.col("x_key").isNull(),
        F.lower(F.when(F.col("domain") == "lab", F.col("entity_label")).otherwise(F.col("raw_value"))),
    )
    near = _near_by_table if not compiled else _near_by_function
    joined = near(exact.withColumn("wanted", wanted), dictionary, entries, cutoff)
    return joined.select(
        *entities.columns, "domain",
        F.coalesce("x_code", "n_code").alias("code"),
        F.coalesce("x_display", "n_display").alias("display"),
        F.coalesce("x_unit_canonical", "n_unit").alias("entry_unit"),
        F.when(F.col("x_key").isNotNull(), "exact")
        .when(F.col("n_code").isNotNull(), "fuzzy")
        .alias("coding_method"),
        F.when(F.col("x_key").isNotNull(), settings.EXACT_CODING_CONFIDENCE)
        .otherwise(exact_round(F.col("near.score"), 4))
        .alias("base_confidence"),
    )


def _with_entries(keys: DataFrame, entries: DataFrame) -> DataFrame:
    return keys.join(entries, ["domain", "key"]).select(
        F.col("domain").alias("n_domain"), F.col("alias").alias("n_alias"), F.col("code").alias("n_code"),
        F.col("display").alias("n_display"), F.col("unit_canonical").alias("n_unit"),
    )


def _near_by_function(rows: DataFrame, dictionary: Dictionary, entries: DataFrame, cutoff: float) -> DataFrame:
    """The closest alias of ``wanted`` by comparing with every alias of a compiled dictionary, row by row."""
    key_of: dict[str, dict[str, str]] = {}
    for entry in dictionary.entries:
        for alias in [entry["key"], *entry["aliases"]]:
            key_of.setdefault(entry["domain"], {})[alias.lower()] = entry["key"]
    score = best_alias({d: list(names) for d, names in key_of.items()}, cutoff)
    keys = [dict(domain=d, alias=a, key=k) for d, names in key_of.items() for a, k in names.items()]
    near = _with_entries(local_frame(rows.sparkSession, keys, "domain string, alias string, key string"), entries)
    return rows.withColumn("near", score(F.col("domain"), F.col("wanted"))).join(
        near, (F.col("domain") == F.col("n_domain")) & (F.col("near.alias") == F.col("n_alias")), "left"
    )


def _near_by_table(rows: DataFrame, dictionary: TableDictionary, entries: DataFrame, cutoff: float) -> DataFrame:
    """The closest alias of each distinct ``wanted``, by a similarity join with the aliases of a table."""
    keys = dictionary.lowered()
    closest = close_names(rows.select("domain", F.col("wanted").alias("text")), keys, cutoff)
    found = closest.join(keys, ["domain", "alias"]).join(entries, ["domain", "key"]).select(
        F.col("domain").alias("n_domain"), F.col("text").alias("n_text"), F.struct("alias", "score").alias("near"),
        F.col("code").alias("n_code"), F.col("display").alias("n_display"), F.col("unit_canonical").alias("n_unit"),
    )
    return rows.join(found, (F.col("domain") == F.col("n_domain")) & (F.col("wanted") == F.col("n_text")), "left")


# --------------------------------------------------------------------------- bands
def bands_by_code(bands: DataFrame) -> DataFrame:
    """One row per code with its bands in file order."""
    return (
        bands.filter(F.col("unit").isNotNull())
        .groupBy("code", "unit")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("band_pos", "sex", "age_min", "age_max", "low", "high", "interpretation")
                )
            ).alias("bands")
        )
    )


def with_reference_band(df: DataFrame, bands: DataFrame, code: str = "code") -> DataFrame:
    """Adds ``reference_range_low/high/unit`` for ``code, sex, age`` (both may be null).

    Bands of the sex and age, else all; adult bands when the age is unknown;
    then the band that reads as normal, the only band, the union over the sexes
    when the sex is unknown, or the first.
    """
    wide = df.join(
        (
            bands_by_code(bands).select(
                F.col("code").alias("_code"), F.col("unit").alias("_unit"), "bands"
            )
        ),
        F.col(code) == F.col("_code"), "left",
    )
    fits = F.filter(
        F.col("bands"),
        lambda b: (F.col("sex").isNull() | (b["sex"] == F.col("sex")) | (b["sex"] == "any"))
        & (F.col("age").isNull() | F.col("age").between(b["age_min"], b["age_max"])),
    )
    wide = wide.withColumn("_fit", fits).withColumn(
        "_fit", F.when(F.size("_fit") > 0, F.col("_fit")).otherwise(F.col("bands"))
    )
    wide = wide.withColumn(
        "_adult", F.filter("_fit", lambda b: b["age_min"] >= ADULT_AGE)
    ).withColumn(
        "_fit",
        F.when(F.col("age").isNull() & (F.size("_adult") > 0), F.col("_adult")).otherwise(
            F.col("_fit")
        ),
    )
    wide = wide.withColumn(
        "_normal",
        F.filter(
            "_fit",
            lambda b: F.lower(F.coalesce(b["interpretation"], F.lit(""))).rlike(NORMAL_READINGS),
        ),
    )
    as_range = lambda b: F.struct(b["low"].alias("low"), b["high"].alias("high"))
    first = F.try_element_at("_fit", F.lit(1))
    union = F.struct(
        F.array_min(F.col("_fit")["low"]).alias("low"),
        F.array_max(F.col("_fit")["high"]).alias("high"),
    )
    mixed = F.col("sex").isNull() & (F.size(F.array_distinct(F.col("_fit")["sex"])) > 1)
    chosen = (
        F.when(F.size("_normal") > 0, as_range(F.try_element_at("_normal", F.lit(1))))
        .when(mixed, union)
        .otherwise(as_range(first))
    )
    return (
        wide.withColumn("_range", chosen)
        .withColumn("reference_range_low", F.col("_range.low"))
        .withColumn("reference_range_high", F.col("_range.high"))
        .withColumn(
            "reference_range_unit", F.when(F.col("_range.low").isNotNull(), F.col("_unit"))
        )
        .drop("_code", "_unit", "bands", "_fit", "_adult", "_normal", "_range")
    )


def age_at(date_of_birth: Column, at: Column) -> Column:
    return F.floor(F.months_between(at, date_of_birth) / 12).cast("int")


def with_patient_context(
    entities: DataFrame, patients: DataFrame | None, as_of: Column
) -> DataFrame:
    """Adds ``sex`` and ``age`` from the patient row; both null without one."""
    if patients is None:
        return entities.withColumn("sex", F.lit(None).cast("string")).withColumn(
            "age", F.lit(None).cast("int")
        )
    known = patients.select("patient_id", "sex", "date_of_birth")
    return (
        entities.join(known, "patient_id", "left")
        .withColumn("age", age_at(F.col("date_of_birth"), as_of))
        .drop("date_of_birth")
    )


# --------------------------------------------------------------------------- assembly
def code_entities(
    entities: DataFrame,
    dictionary: Dictionary | TableDictionary,
    bands: DataFrame,
    patients: DataFrame | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Every entity with its code, or with a null ``canonical_code`` where none fits.

    A lab must be a number that is not negative. Labs whose unit measures the
    quantity in another system keep their value and lose confidence.
    """
    if patients is not None and as_of is None:
        raise ValueError("ages are taken at as_of")
    at = F.lit(None).cast("timestamp") if as_of is None else as_of
    coded = with_codes(with_patient_context(entities, patients, at), dictionary)
    number = strict_number(F.col("raw_value"))
    is_lab = F.col("domain") == "lab"
    accepted = F.col("coding_method").isNotNull() & (
        ~is_lab | (F.coalesce(number, F.lit(-1.0)) >= 0)
    )
    coded = (
        coded.withColumn("accepted", F.coalesce(accepted, F.lit(False)))
        .withColumn("source_unit", F.when(is_lab, un.normal_unit(F.col("unit_raw"))))
        .withColumn("target_unit", F.when(is_lab, un.normal_unit(F.col("entry_unit"))))
        .withColumn("band_code", F.when(is_lab & F.col("accepted"), F.col("code")))
    )
    ranged = with_reference_band(coded, bands, "band_code")
    clash = un.is_cross_system(F.col("target_unit"), F.col("source_unit"))
    confidence = F.when(
        is_lab & clash,
        F.greatest(
            F.lit(settings.MIN_CODING_CONFIDENCE),
            exact_round(F.col("base_confidence") - settings.UNIT_MISMATCH_PENALTY, 4),
        ),
    ).otherwise(F.col("base_confidence"))
    system = F.lit(None).cast("string")
    for domain, name in CODING_SYSTEMS.items():
        system = F.when(F.col("domain") == domain, name).otherwise(system)
    yes = F.col("accepted")
    return ranged.select(
        *entities.columns,
        F.when(yes, F.col("code")).alias("canonical_code"),
        F.when(yes, system).alias("coding_system"),
        F.when(
            yes,
            F.when(is_lab, F.col("raw_value")).otherwise(F.coalesce("display", "raw_value")),
        ).alias("normalized_value"),
        F.when(yes & is_lab, F.coalesce("entry_unit", "source_unit")).alias("unit_canonical"),
        "reference_range_low", "reference_range_high", "reference_range_unit",
        F.when(yes, confidence).alias("coding_confidence"),
        F.when(yes, F.col("coding_method")).alias("coding_method"),
    )


def coded_only(coded: DataFrame) -> DataFrame:
    return coded.filter(F.col("canonical_code").isNotNull())


def unmatched_only(coded: DataFrame) -> DataFrame:
    """Entities without a code, among them the types no ontology covers."""
    return coded.filter(F.col("canonical_code").isNull())
