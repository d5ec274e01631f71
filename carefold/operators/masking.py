"""Identifier masking with reversible, deterministic tokens.

Detection, overlap resolution and replacement run inside each span's row. The
token of a value depends on category and value alone, so retries and repeated
mentions give the same token.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carefold import settings
from carefold.functions import spans as sp
from carefold.functions.ids import uuid5


@dataclass(frozen=True)
class Identifier:
    category: str
    prefix: str
    priority: int
    pattern: str


# ---------------------------------------------------------------------------
# Token namespace and format, and one pattern per category.
# (?U) gives \b, \s and \d their Unicode meaning.
# ---------------------------------------------------------------------------
TOKEN_NAMESPACE = "6f6f9c2e-6b0a-4e3a-9f1a-9d1b8f9c9a11"
TOKEN_PATTERN = r"\[\[PHI:[A-Z]+:[0-9a-fA-F-]{36}\]\]"

IDENTIFIERS = (
    Identifier("MRN", "MRN", 0, r"(?iU)\bMRN[:\s#-]*\d{5,12}\b"),
    Identifier(
        "HOSPITAL_ID", "HOSPID", 1,
        r"(?iU)\b(?:Hospital\s?ID|Hosp\.?\s?ID|HID)[:\s#-]*[A-Z0-9-]{4,20}\b",
    ),
    Identifier(
        "PATIENT_ID", "PID", 1, r"(?iU)\b(?:Patient\s?ID|PID)[:\s#-]*[A-Z0-9-]{3,20}\b"
    ),
    Identifier(
        "AADHAAR", "AADHAAR", 1,
        r"(?iU)\b(?:Aadhaar|Aadhar|UID)[:\s#-]*\d{4}\s?\d{4}\s?\d{4}\b|\b\d{4}\s\d{4}\s\d{4}\b",
    ),
    Identifier("PAN", "PAN", 1, r"(?U)\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    Identifier(
        "DOB", "DOB", 2,
        r"(?iU)\b(?:DOB|D\.O\.B\.?|Date of Birth)[:\s]*"
        r"(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b",
    ),
    Identifier(
        "AGE", "AGE", 3,
        r"(?iU)\b(?:Age[:\s]*\d{1,3}(?:\s?(?:years?|yrs?)(?:\sold)?)?"
        r"|\d{1,3}\s?(?:years?[\s-]old|yrs?[\s-]old|y/?o))\b",
    ),
    Identifier("EMAIL", "EMAIL", 3, r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    Identifier(
        "PHONE", "PHONE", 4,
        r"(?U)\(\d{3}\)[-.\s]?\d{3}[-.\s]\d{4}\b"
        r"|\+?\b(?:1[-.\s]?)?\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"
        r"|\+?\b(?:91[-.\s]?)?[6-9]\d{9}\b",
    ),
    Identifier("NPI", "NPI", 4, r"(?iU)\bNPI[:\s]*\d{10}\b"),
    Identifier(
        "NAME", "PATIENT", 5,
        r"(?U)\b(?:Patient(?:\sName)?|Pt\.?|Dr\.?|Doctor|Mr\.?|Mrs\.?|Ms\.?|Prof\.?|Sri|Smt\.?)"
        r"[:\s]+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b",
    ),
    Identifier(
        "ADDRESS", "ADDR", 6,
        r"(?iU)\b\d{1,5}\s+[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*){0,4}\s+"
        r"(?:St|Street|Ave|Avenue|Blvd|Boulevard|Rd|Road|Dr|Drive|Lane|Ln|Way|Court|Ct"
        r"|Nagar|Marg|Colony)\b",
    ),
)

_FOUND_TYPE = (
    "struct<start:int,end:int,value:string,category:string,prefix:string,priority:int,ordinal:int>"
)


def detect_category(text: Column, spec: Identifier, ordinal: int = 0) -> Column:
    """Matches of one category as candidates for overlap resolution."""
    return F.transform(
        sp.find_matches(text, spec.pattern),
        lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
            F.lit(spec.category).alias("category"), F.lit(spec.prefix).alias("prefix"),
            F.lit(spec.priority).alias("priority"), F.lit(ordinal).alias("ordinal"),
        ),
    )


def token(category: Column, prefix: Column, value: Column) -> Column:
    return F.concat(
        F.lit("[[PHI:"), prefix, F.lit(":"),
        uuid5(TOKEN_NAMESPACE, F.concat_ws(":", category, value)), F.lit("]]"),
    )


def detect(
    df: DataFrame, identifiers: tuple[Identifier, ...] = IDENTIFIERS, text: str = "text"
) -> DataFrame:
    """Adds ``matches``: the accepted identifier spans of each text, with tokens."""
    # One array of what each category found, so that offsets are one expression for all of them.
    cuts = F.array(*[
        F.struct(
            F.lit(spec.category).alias("category"), F.lit(spec.prefix).alias("prefix"),
            F.lit(spec.priority).alias("priority"), F.lit(i).alias("ordinal"),
            sp.cut(F.col(text), spec.pattern).alias("cut"),
        )
        for i, spec in enumerate(identifiers)
    ])
    candidates = F.flatten(F.transform(
        F.filter(cuts, lambda c: c["cut"].isNotNull()),
        lambda c: F.transform(
            sp.matches_of(c["cut"]),
            lambda m: F.struct(
                m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
                *[c[name].alias(name) for name in ("category", "prefix", "priority", "ordinal")],
            ),
        ),
    ))
    # Two steps, so that the candidates are computed once.
    found = df.withColumn("_candidates", candidates)
    chosen = F.when(
        F.size("_candidates") > 1, sp.resolve_overlaps(F.col("_candidates"), _FOUND_TYPE)
    ).otherwise(F.col("_candidates"))
    with_tokens = F.transform(
        chosen,
        lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
            m["category"].alias("category"),
            token(m["category"], m["prefix"], m["value"]).alias("token"),
        ),
    )
    return found.withColumn("matches", with_tokens).drop("_candidates")


def mask(
    df: DataFrame,
    identifiers: tuple[Identifier, ...] = IDENTIFIERS,
    text: str = "text",
    enabled: bool = True,
) -> DataFrame:
    """Replaces identifiers in ``text`` by tokens and keeps the ``matches``.

    With ``enabled`` off the text passes unchanged and nothing is detected.
    """
    if not enabled:
        none = sp.empty_array(
            "array<struct<start:int,end:int,value:string,category:string,token:string>>"
        )
        return df.withColumn("matches", none)
    found = detect(df, identifiers, text)
    return found.withColumn(text, sp.splice(F.col(text), F.col("matches"), "token"))


def token_map(masked: DataFrame, key: str = "document_id") -> DataFrame:
    """Distinct ``(document, token, value, category)``; equal mentions collapse map-side."""
    return (
        sp.explode_found(masked, [key], F.col("matches"), "m")
        .select(key, "m.token", "m.value", "m.category")
        .distinct()
    )


def mask_document(spans: DataFrame, enabled: bool = True) -> dict[str, DataFrame]:
    """Masked spans, their low-confidence subset and the token map of a span table."""
    masked = mask(spans, enabled=enabled)
    clean = masked.drop("matches")
    return {
        "spans": clean,
        "low_confidence": clean.filter(
            F.col("confidence") < settings.OCR_CONFIDENCE_THRESHOLD
        ),
        "token_map": token_map(masked),
    }


def restore(
    df: DataFrame,
    mapping: DataFrame,
    keys: list[str],
    scope: tuple[str, ...] = ("document_id",),
    text: str = "text",
    pattern: str = TOKEN_PATTERN,
) -> DataFrame:
    """Puts original values back; a token without a mapping stays as it is.

    ``keys`` identify a row, ``scope`` the columns of it within which a token stands for one value. Only the tokens
    travel to the join with the map; texts without a token are passed by.
    """
    on = [*scope, "token"]
    tokens = sp.explode_found(df, keys, sp.find_matches(F.col(text), pattern), "t")
    known = mapping.select(*on, F.col("value").alias("_value")).dropDuplicates(on)
    values = (
        tokens.select(*keys, "t.start", "t.end", F.col("t.value").alias("token"))
        .join(known, on, "left")
        .groupBy(*keys)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("start", "end", F.coalesce("_value", "token").alias("value"))
                )
            ).alias("_values")
        )
    )
    restored = sp.splice(F.col(text), F.col("_values"), "value")
    return (
        df.join(values, keys, "left")
        .withColumn(text, F.when(F.col("_values").isNull(), F.col(text)).otherwise(restored))
        .drop("_values")
    )


def category_counts(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("category").agg(F.count("*").alias("token_count"))


# --------------------------------------------------------------------------- map store
def save_mapping(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new tokens merged; a token saved again takes the newer record."""
    columns = ["document_id", "token", "value", "category"]
    both = stored.select(*columns, F.lit(0).alias("_v")).unionByName(
        new.select(*columns, F.lit(1).alias("_v"))
    )
    return both.groupBy("document_id", "token").agg(
        F.max_by("value", "_v").alias("value"), F.max_by("category", "_v").alias("category")
    )


def get_mapping(stored: DataFrame, document_id: str) -> DataFrame:
    return stored.filter(F.col("document_id") == document_id)


def get_token(stored: DataFrame, document_id: str, wanted: str) -> DataFrame:
    return get_mapping(stored, document_id).filter(F.col("token") == wanted)


def purge_mapping(stored: DataFrame, documents: DataFrame) -> DataFrame:
    """The store without the tokens of the given documents."""
    return stored.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def encrypt_values(mapping: DataFrame, key: Column) -> DataFrame:
    """Values under AES-GCM, in base64."""
    return mapping.withColumn("value", F.base64(F.aes_encrypt("value", key, F.lit("GCM"))))


def decrypt_values(mapping: DataFrame, key: Column) -> DataFrame:
    """Null where the key does not fit."""
    return mapping.withColumn(
        "value",
        F.try_aes_decrypt(F.unbase64("value"), key, F.lit("GCM")).cast("string"),
    )


# --------------------------------------------------------------------------- outbound guard
# Patterns of the guard that runs before text leaves the system,
# applied one after another, and its token form.
GUARD_PATTERNS = (
    ("MRN", r"(?iU)\bMRN[:\s#-]*\d{5,12}\b"),
    ("SSN", r"(?U)\b\d{3}-\d{2}-\d{4}\b"),
    ("DOB", r"(?iU)\b(?:DOB|Date of Birth)[:\s]*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
    ("PHONE", r"(?U)\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"),
    ("EMAIL", r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    (
        "NAME",
        r"(?U)\b(?:Patient|Dr\.?|Doctor|Mr\.?|Mrs\.?|Ms\.?|Prof\.?)"
        r"\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b",
    ),
    (
        "ADDRESS",
        r"(?iU)\b\d{1,5}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}"
        r"\s+(?:St|Ave|Blvd|Rd|Dr|Lane|Ln|Way|Court|Ct)\b",
    ),
    ("NPI", r"(?iU)\bNPI[:\s]*\d{10}\b"),
    ("ACCESSION", r"(?iU)\b(?:Acc(?:ession)?[#:\s]*)[A-Z0-9]{6,12}\b"),
)
GUARD_TOKEN_PATTERN = r"\[PHI_[A-Z]+_[A-F0-9]{8}\]"


def guard(
    df: DataFrame, keys: list[str], text: str = "text", enabled: bool = True, secret: str = ""
) -> DataFrame:
    """Masks the guard categories in sequence, each over the text so far.

    ``guard_tokens`` holds what was replaced. A token belongs to its record, named by ``keys``: its suffix is a digest
    of ``secret``, record and category, with the number of the match in it, where a random one would break retries. So
    no two values of a record share a token, and a suffix tells nothing about the value.
    """
    kind = "array<struct<value:string,category:string,token:string>>"
    out = df.withColumn("guard_tokens", sp.empty_array(kind))
    if not enabled:
        return out
    record = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    for category, pattern in GUARD_PATTERNS:
        seed = F.conv(
            F.substring(F.sha2(F.concat_ws("|", F.lit(secret), F.lit(category), *record), 256), 1, 8), 16, 10
        ).cast("long")
        out = out.withColumn("_cut", sp.cut(F.col(text), pattern)).withColumn("_seed", F.when(F.col("_cut").isNotNull(), seed))
        hits = F.transform(
            F.col("_cut.hits"),
            lambda value, i: F.struct(
                value.alias("value"), F.lit(category).alias("category"),
                F.concat(
                    F.lit(f"[PHI_{category}_"),
                    F.lpad(F.hex(F.col("_seed").bitwiseXOR(i.cast("long"))), 8, "0"), F.lit("]"),
                ).alias("token"),
            ),
        )
        out = out.withColumn("_hits", hits)
        masked = F.array_join(
            F.zip_with(F.col("_cut.gaps"), F.col("_hits"), lambda gap, hit: F.concat(gap, F.coalesce(hit["token"], F.lit("")))), ""
        )
        out = (
            out.withColumn(text, F.coalesce(masked, F.col(text)))
            .withColumn("guard_tokens", F.when(F.col("_hits").isNull(), F.col("guard_tokens")).otherwise(F.concat("guard_tokens", "_hits")))
            .drop("_hits", "_cut", "_seed")
        )
    return out


def guard_map(
    guarded: DataFrame, keys: list[str], created_at: Column, ttl: int = settings.TOKEN_TTL_SECONDS
) -> DataFrame:
    """The tokens of each record with their expiry time; every token is one row."""
    return (
        sp.explode_found(guarded, keys, F.col("guard_tokens"), "t")
        .select(*keys, "t.token", "t.value", created_at.alias("created_at"))
        .withColumn("expires_at", F.col("created_at") + F.expr(f"interval {ttl} seconds"))
    )


def live_tokens(mapping: DataFrame, as_of: Column) -> DataFrame:
    return mapping.filter(F.col("expires_at") > as_of)


def guard_restore(
    df: DataFrame, given: DataFrame, stored: DataFrame, keys: list[str], text: str = "text"
) -> DataFrame:
    """Restores the guard tokens of each record from the given map first and the store after it."""
    both = given.select(*keys, "token", "value", F.lit(0).alias("_place")).unionByName(
        stored.select(*keys, "token", "value", F.lit(1).alias("_place"))
    )
    merged = both.groupBy(*keys, "token").agg(F.min_by("value", "_place").alias("value"))
    return restore(df, merged, keys, scope=tuple(keys), text=text, pattern=GUARD_TOKEN_PATTERN)
