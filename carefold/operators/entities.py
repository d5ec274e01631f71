"""Dictionary extraction of labs, medications and diagnoses.

Every rule here looks at one line only: an alias holds no line break, a value
must stand on the mention's line, and a sentence never crosses a line break.
So extraction runs inside each span's row and the document's text is never
put together; offsets into the full text come from ``layout.span_offsets``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.functions import spans as sp
from carefold.functions.ids import stable_key
from carefold.functions.text import NUMBER, empty_to_null, exact_round
from carefold.sources import knowledge, knowledge_values

# ---------------------------------------------------------------------------
# Units, frequencies, trigger phrases, window sizes, confidences.
# ---------------------------------------------------------------------------
SHORT_ALIAS = 3
KNOWN_UNITS = (
    "mL/min/1.73m2", "mL/min/1.73 m2", "10^3/uL", "mmol/L", "mIU/L", "mEq/L", "mg/dL", "g/dL",
    "U/L", "kg/m2", "bpm", "mmHg", "ratio", "IU", "kg", "cm", "%", "°C",
)
DOSE = rf"(?iU)^\s*[:\-]?\s*({NUMBER})\s*(mg|mcg|g|units?|IU|mL)\b"
FREQUENCIES = (
    (r"\bonce\s+daily\b|\bOD\b|\bQD\b", "once daily"),
    (r"\btwice\s+daily\b|\bBD\b|\bBID\b", "twice daily"),
    (r"\bthree\s+times\s+daily\b|\bTDS\b|\bTID\b", "three times daily"),
    (r"\bfour\s+times\s+daily\b|\bQID\b", "four times daily"),
    (r"\bat\s+night\b|\bnightly\b|\bQHS\b", "at night"),
    (r"\bas\s+needed\b|\bPRN\b", "as needed"),
    (r"\bweekly\b", "weekly"),
)
VALUE_WINDOW = 60
FREQUENCY_WINDOW = 20
BEFORE_WINDOW = 45
AFTER_WINDOW = 25
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+|\n+"

FAMILY_HISTORY = (
    r"\bfamily history of\b", r"\bmother has\b", r"\bfather has\b", r"\bsibling with\b",
    r"\bmaternal\b", r"\bpaternal\b",
)
NEGATION_BEFORE = (
    r"\bno evidence of\b", r"\bno signs of\b", r"\bnegative for\b", r"\bdenies\b", r"\bdenied\b",
    r"\bwithout\b", r"\babsence of\b", r"\bnot on\b", r"\bdiscontinued\b", r"\bruled out\b",
    r"\bfree of\b", r"\bno\b",
)
NEGATION_AFTER = (
    r"\bwas ruled out\b", r"\bwas negative\b", r"\bnot detected\b", r"\bhas resolved\b",
    r"\bwas discontinued\b",
)
HYPOTHETICAL = (
    r"\bif\b", r"\bshould\b", r"\bin the event of\b", r"\bin case of\b", r"\bwould require\b",
    r"\bmay require\b",
)
CONDITIONAL = (r"\bas needed\b", r"\bPRN\b", r"\bif needed\b", r"\bif required\b")
POSSIBLE = (
    r"\bpossible\b", r"\bprobable\b", r"\blikely\b", r"\bsuspected\b", r"\bquestionable\b",
    r"\bconcern for\b", r"\bconsider(?:ing)?\b", r"\?",
)
LAB_LONG, LAB_SHORT = 0.93, 0.80
DRUG_WITH_DOSE, DRUG_WITHOUT_DOSE, DIAGNOSIS = 0.92, 0.82, 0.90
SHORT_PENALTY = 0.10

FAMILY_REASON = "Family-history wording: the finding may not be the patient's own."

DOMAINS = ("lab", "medication", "diagnosis")


def _escape(literal: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}#-])", r"\\\1", literal)


_UNITS = "|".join(_escape(u) for u in sorted(KNOWN_UNITS, key=len, reverse=True))
LAB_VALUE = rf"(?iU)^\s*[:\-=]?\s*({NUMBER})\s*({_UNITS})?"


def _any_of(patterns: Iterable[str]) -> str:
    """One pattern for all: phrases between word boundaries share them, and a look at the first letter rules most places out."""
    patterns = list(patterns)
    phrases = [m[1] for m in map(re.compile(r"\\b([a-zA-Z].*)\\b").fullmatch, patterns) if m and not re.search(r"\||\\b", re.sub(r"\(\?:[^()]*\)", "", m[1]))]
    if len(phrases) < len([p for p in patterns if p.startswith(r"\b")]):
        return "(?iU)" + "|".join(patterns)
    others = [p for p in patterns if not p.startswith(r"\b")]
    first = "".join(sorted({p[0].lower() for p in phrases}))
    return "(?iU)" + "|".join([rf"\b(?=[{first}])(?:{'|'.join(phrases)})\b", *others])


def _one_of(options: Iterable[str]) -> str:
    """A pattern for any of the ASCII texts ``options``, the longest that fits first, with shared beginnings written once.

    Texts that fit at one place begin with each other, so the longest is the one that goes on longest.
    """
    tree: dict = {}
    for option in options:
        node = tree
        for char in option:
            node = node.setdefault(char, {})
        node[""] = {}

    def written(node: dict) -> str:
        parts = [_escape(char) + written(below) for char, below in sorted(node.items()) if char]
        if "" in node:
            return f"(?:{'|'.join(parts)})?" if parts else ""
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    first = "".join(c if c.isalnum() else "\\" + c for c in sorted(c for c in tree if c))
    return f"(?=[{first}])(?:{written(tree)})"


# --------------------------------------------------------------------------- dictionary
@dataclass
class Dictionary:
    """Alias alternations per domain, compiled once on the driver.

    An alternation is a regex literal of the plan, so the dictionary must be a
    small table; ``from_frame`` refuses more than ``max_aliases`` aliases
    instead of cutting them.
    """

    entries: list[dict]
    max_aliases: int = 50_000
    aliases: dict[str, list[str]] = field(init=False)

    def __post_init__(self) -> None:
        self.aliases = {d: [] for d in DOMAINS}
        for entry in self.entries:
            self.aliases[entry["domain"]] += [entry["key"], *entry["aliases"]]
        total = sum(len(v) for v in self.aliases.values())
        if total > self.max_aliases:
            raise ValueError(f"{total} aliases are too many for one alternation")

    @classmethod
    def builtin(cls) -> "Dictionary":
        return cls(knowledge.builtin_ontology_rows())

    @classmethod
    def from_frame(cls, ontology: DataFrame, max_aliases: int = 50_000) -> "Dictionary":
        rows = ontology.orderBy("domain", "ordinal").limit(max_aliases + 1).collect()
        return cls([r.asDict() for r in rows], max_aliases)

    def ontology(self, spark: SparkSession) -> DataFrame:
        return knowledge.local_frame(spark, self.entries, knowledge.ONTOLOGY_SCHEMA)

    def names(self, spark: SparkSession) -> DataFrame:
        """Every alias, as written and lower-cased, with its entry; the last definition wins."""
        named: dict[tuple[str, str, str], dict] = {}
        for entry in self.entries:
            for alias in [entry["key"], *entry["aliases"]]:
                for form, text in (("exact", alias), ("lower", alias.lower())):
                    named[(entry["domain"], form, text)] = entry
        fields = ("key", "code", "display", "unit_canonical", "drug_class")
        rows = [
            dict(domain=d, form=form, alias=text, **{f: e.get(f) for f in fields})
            for (d, form, text), e in named.items()
        ]
        return knowledge.local_frame(
            spark, rows,
            "domain string, form string, alias string, key string, code string, display string, "
            "unit_canonical string, drug_class string",
        )

    def patterns(self, domain: str) -> tuple[str | None, str | None]:
        """Case-insensitive pattern of the long aliases, exact one of the short ones."""
        names = list(dict.fromkeys(self.aliases[domain]))
        ordered = sorted(names, key=len, reverse=True)
        long = [a for a in ordered if len(a) > SHORT_ALIAS]
        short = [a for a in ordered if len(a) <= SHORT_ALIAS]

        def bounded(options: list[str], flags: str) -> str | None:
            if not options:
                return None
            # letters beyond ASCII have case rules of their own
            one = _one_of(o.lower() if flags else o for o in options) if all(options) and "".join(options).isascii() else f"(?:{'|'.join(map(_escape, options))})"
            return f"{flags}(?<![A-Za-z0-9]){one}(?![A-Za-z0-9])"

        return bounded(long, "(?iu)"), bounded(short, "")


def text_before(text: Column, start: Column) -> Column:
    size = F.least(start, F.lit(BEFORE_WINDOW))
    return F.substring(text, start - size + 1, size)


def text_after(text: Column, end: Column) -> Column:
    return F.substring(text, end + 1, F.lit(VALUE_WINDOW + AFTER_WINDOW))


def alias_hits(text: Column, dictionary: Dictionary, domain: str) -> Column:
    """Alias spans of one domain: long aliases first, short ones where text is unclaimed."""
    long, short = dictionary.patterns(domain)
    none = sp.empty_array(sp.MATCH_TYPE)
    first = sp.find_matches(text, long) if long else none
    second = sp.find_matches(text, short) if short else none
    tag = lambda hits, form: F.transform(
        hits,
        lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
            F.lit(form).alias("form"), F.lit(domain).alias("domain"),
            text_before(text, m["start"]).alias("before"),
            text_after(text, m["end"]).alias("after"),
        ),
    )
    # both are searched for once: an expression within a lambda runs again for every item
    return sp.bound(
        F.struct(first.alias("first"), second.alias("second")),
        lambda hits: F.concat(tag(hits["first"], "lower"), tag(sp.drop_claimed(hits["second"], hits["first"]), "exact")),
    )


def mentions(spans: DataFrame, dictionary: Dictionary, keep: list[str]) -> DataFrame:
    """One row per dictionary mention, with the entry it names.

    A row carries the few characters around its mention instead of the text,
    so a long text is not repeated per mention. The three domains are matched
    independently, so one text range may give a lab and a diagnosis. A ``table_dictionary.TableDictionary`` may stand
    for the dictionary.
    """
    if not isinstance(dictionary, Dictionary):
        return dictionary.mentions(spans, keep)
    hits = spans
    for domain in DOMAINS:
        hits = hits.withColumn(f"_{domain}", alias_hits(F.col("text"), dictionary, domain))
    found = F.concat(*[F.col(f"_{d}") for d in DOMAINS])
    rows = sp.explode_found(hits, keep, found, "h").select(
        *keep, "h.domain", "h.form", F.col("h.before").alias("text_before"),
        F.col("h.after").alias("text_after"),
        F.col("h.start").alias("mention_start"), F.col("h.end").alias("mention_end"),
        F.col("h.value").alias("matched_text"),
        F.when(F.col("h.form") == "lower", F.lower("h.value"))
        .otherwise(F.col("h.value"))
        .alias("alias"),
    )
    names = dictionary.names(spans.sparkSession)
    return rows.join(names, ["domain", "form", "alias"]).drop("form", "alias")


# --------------------------------------------------------------------------- values
def line_after(after: Column) -> Column:
    """The rest of the mention's line, at most ``VALUE_WINDOW`` characters."""
    return F.substring_index(F.substring(after, 1, VALUE_WINDOW), "\n", 1)


def lab_value(window: Column) -> Column:
    """``value, unit, length`` at the begin of a window; null without a number."""
    value = F.regexp_extract(window, LAB_VALUE, 1)
    return F.when(
        value != "",
        F.struct(
            value.alias("value"),
            empty_to_null(F.regexp_extract(window, LAB_VALUE, 2)).alias("unit"),
            F.length(F.regexp_extract(window, LAB_VALUE, 0)).alias("length"),
        ),
    )


def dose(window: Column) -> Column:
    """``text, length`` of a dose at the begin of a window; null without one."""
    number = F.regexp_extract(window, DOSE, 1)
    return F.when(
        number != "",
        F.struct(
            F.concat(number, F.regexp_extract(window, DOSE, 2)).alias("text"),
            F.length(F.regexp_extract(window, DOSE, 0)).alias("length"),
        ),
    )


def frequency_window(window: Column, dose_length: Column) -> Column:
    """Short on purpose: the next drug on the line keeps its own frequency."""
    return F.substring(window, F.coalesce(dose_length, F.lit(0)) + 1, FREQUENCY_WINDOW)


def frequency(near: Column) -> Column:
    """The label of the first frequency pattern found; null without one."""
    label = F.lit(None).cast("string")
    for pattern, name in reversed(FREQUENCIES):
        label = F.when(near.rlike("(?iU)" + pattern), name).otherwise(label)
    return label


# --------------------------------------------------------------------------- assertion
def before_in_sentence(before: Column) -> Column:
    """The part of the text before a mention that lies in its sentence."""
    return F.element_at(sp.split_at(before, SENTENCE_BREAK), -1)


def after_in_sentence(matched: Column, after: Column, length: Column) -> Column:
    """At most ``AFTER_WINDOW`` characters behind the entity within the mention's sentence.

    ``length`` is that of the entity from the begin of its mention.
    """
    reach = F.substring(F.concat(matched, after), F.lit(1), length + AFTER_WINDOW)
    return F.substring(
        sp.split_at(reach, SENTENCE_BREAK)[0], length + 1, F.lit(AFTER_WINDOW)
    )


def assertion_status(before: Column, after: Column) -> Column:
    """The first class whose trigger appears near the mention."""
    return (
        F.when(before.rlike(_any_of(FAMILY_HISTORY)), "conditional")
        .when(
            before.rlike(_any_of(NEGATION_BEFORE)) | after.rlike(_any_of(NEGATION_AFTER)), "absent"
        )
        .when(before.rlike(_any_of(HYPOTHETICAL)), "hypothetical")
        .when(
            before.rlike(_any_of(CONDITIONAL)) | after.rlike(_any_of(CONDITIONAL)), "conditional"
        )
        .when(before.rlike(_any_of(POSSIBLE)) | after.rlike(_any_of(POSSIBLE)), "possible")
        .otherwise("present")
    )


def is_family_history(before: Column) -> Column:
    return before.rlike(_any_of(FAMILY_HISTORY))


# --------------------------------------------------------------------------- assembly
def match_confidence(domain: Column, matched_text: Column, has_dose: Column) -> Column:
    short = F.length(matched_text) <= SHORT_ALIAS
    return (
        F.when(domain == "lab", F.when(short, LAB_SHORT).otherwise(LAB_LONG))
        .when(
            domain == "medication",
            F.when(has_dose, DRUG_WITH_DOSE).otherwise(DRUG_WITHOUT_DOSE)
            - F.when(short, SHORT_PENALTY).otherwise(0.0),
        )
        .otherwise(DIAGNOSIS - F.when(short, SHORT_PENALTY).otherwise(0.0))
    )


def extract(
    spans: DataFrame,
    dictionary: Dictionary,
    offsets: DataFrame | None = None,
    keep: tuple[str, ...] = ("document_id", "patient_id", "span_pos"),
    treat_absent_as_negated: bool = False,
) -> DataFrame:
    """Entities of every span.

    ``offsets`` (document_id, span_pos, start) moves positions into the
    document; it joins the few entities, so the texts are scanned in place and
    never shuffled. Without it a span is a document of its own. An entity lies
    within one span, so that span's
    confidence is its recognition confidence. A blank text yields no rows, and
    a lab without a number on its line is not an entity.
    """
    found = (
        mentions(spans, dictionary, [*keep, "confidence"])
        .withColumn("window", line_after(F.col("text_after")))
        .withColumn("lab", F.when(F.col("domain") == "lab", lab_value(F.col("window"))))
        .filter((F.col("domain") != "lab") | F.col("lab").isNotNull())
        .withColumn("dose", F.when(F.col("domain") == "medication", dose(F.col("window"))))
        .withColumn("near", frequency_window(F.col("window"), F.col("dose.length")))
        .withColumn(
            "frequency", F.when(F.col("domain") == "medication", frequency(F.col("near")))
        )
        .withColumn(
            "entity_end",
            F.col("mention_end")
            + F.coalesce(F.col("lab.length"), F.col("dose.length"), F.lit(0)),
        )
        .withColumn("before", before_in_sentence(F.col("text_before")))
        .withColumn(
            "after",
            after_in_sentence(
                F.col("matched_text"), F.col("text_after"),
                F.col("entity_end") - F.col("mention_start"),
            ),
        )
        .withColumn("assertion_status", assertion_status(F.col("before"), F.col("after")))
        .withColumn("ambiguity_flag", is_family_history(F.col("before")))
        .withColumn(
            "certainty",
            match_confidence(
                F.col("domain"), F.col("matched_text"),
                F.coalesce(F.col("dose.text"), F.col("frequency")).isNotNull(),
            ),
        )
        .withColumn("combined", F.col("confidence") * F.col("certainty"))
        .drop("text_before", "text_after", "window", "near", "before", "after")
    )
    if offsets is None:
        found = found.withColumn("start", F.lit(0))
    else:
        found = found.join(
            offsets.select("document_id", "span_pos", "start"), ["document_id", "span_pos"]
        )
    entity_type = (
        F.when(
            F.col("domain") == "lab",
            F.when(F.col("key").isin(*knowledge_values.VITAL_KEYS), "vital_sign").otherwise(
                "lab_value"
            ),
        )
        .otherwise(F.col("domain"))
    )
    begin = F.col("start") + F.col("mention_start")
    end = F.col("start") + F.col("entity_end")
    negated = (
        (F.col("assertion_status") == "absent") if treat_absent_as_negated else F.lit(False)
    )
    return found.select(
        *keep,
        stable_key(F.col("document_id"), entity_type, begin, end).alias("temp_id"),
        entity_type.alias("entity_type"),
        F.coalesce("lab.value", "display", "key").alias("raw_value"),
        F.col("key").alias("entity_label"),
        F.when(F.col("domain") == "lab", F.coalesce("lab.unit", "unit_canonical"))
        .otherwise(empty_to_null(F.concat_ws(" ", F.col("dose.text"), F.col("frequency"))))
        .alias("unit_raw"),
        F.lit(None).cast("timestamp").alias("entity_date"),
        begin.cast("int").alias("source_span_start"),
        end.cast("int").alias("source_span_end"),
        exact_round(F.col("confidence"), 4).alias("ocr_confidence"),
        exact_round(F.col("certainty"), 4).alias("ner_confidence"),
        exact_round(F.col("combined"), 4).alias("combined_confidence"),
        negated.alias("is_negated"),
        "assertion_status",
        "ambiguity_flag",
        F.when(F.col("ambiguity_flag"), FAMILY_REASON).alias("ambiguity_reason"),
    )


# --------------------------------------------------------------------------- sentences
def sentences(documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Sentences with offsets; blank ones are dropped."""
    found = sp.pieces_between(F.col("text"), SENTENCE_BREAK)
    return (
        documents.select(key, F.posexplode(found).alias("sentence_pos", "b"))
        .select(key, "sentence_pos", "b.start", "b.end", F.col("b.value").alias("sentence"))
        .filter(F.col("sentence").rlike(r"\S"))
    )


def sentence_of(mentions_: DataFrame, sentence_table: DataFrame, bin_width: int = 512) -> DataFrame:
    """Joins each mention (``document_id, mention_id, offset``) to its sentence.

    Both sides meet in bins of the document's offsets, so that a huge document
    spreads over tasks. A mention outside every sentence takes the last one.
    """
    binned_sentences = sentence_table.withColumn(
        "bin",
        F.explode(
            F.sequence(
                F.floor(F.col("start") / bin_width), F.floor((F.col("end") - 1) / bin_width)
            )
        ),
    )
    binned = mentions_.withColumn("bin", F.floor(F.col("offset") / bin_width))
    inside = binned.alias("_mention").join(
        binned_sentences.alias("_sentence"),
        (F.col("_mention.document_id") == F.col("_sentence.document_id"))
        & (F.col("_mention.bin") == F.col("_sentence.bin"))
        & (F.col("_sentence.start") <= F.col("_mention.offset"))
        & (F.col("_mention.offset") < F.col("_sentence.end")),
        "left",
    ).select(
        "_mention.document_id", "_mention.mention_id", "_mention.offset",
        F.col("_sentence.sentence_pos").alias("hit_pos"), F.col("_sentence.sentence").alias("hit"),
    )
    last = sentence_table.groupBy("document_id").agg(
        F.max("sentence_pos").alias("last_pos"),
        F.max_by("sentence", "sentence_pos").alias("last_sentence"),
    )
    missed = inside.filter(F.col("hit_pos").isNull()).join(last, "document_id", "left").select(
        "document_id", "mention_id", "offset",
        F.col("last_pos").alias("sentence_pos"), F.col("last_sentence").alias("sentence"),
    )
    return (
        inside.filter(F.col("hit_pos").isNotNull())
        .select("document_id", "mention_id", "offset",
                F.col("hit_pos").alias("sentence_pos"), F.col("hit").alias("sentence"))
        .unionByName(missed)
    )


# --------------------------------------------------------------------------- confidence
def overlap_confidence(
    entities: DataFrame, spans: DataFrame, fallback: DataFrame, bin_width: int = 512
) -> DataFrame:
    """Overlap-weighted mean confidence of the spans an entity touches.

    For entities that did not come from :func:`extract`. The interval join is
    an equi-join on document and offset bin; a pair is counted in the first bin
    it shares. Entities that touch no span take the document's mean.
    """

    def bins(start: str, end: str) -> Column:
        return F.explode(
            F.sequence(
                F.floor(F.col(start) / bin_width),
                F.floor(F.greatest(F.col(end) - 1, F.col(start)) / bin_width),
            )
        )

    left = entities.select(
        "document_id", "temp_id", "source_span_start", "source_span_end"
    ).withColumn("bin", bins("source_span_start", "source_span_end"))
    right = spans.select("document_id", "start", "end", "confidence").withColumn(
        "bin", bins("start", "end")
    )
    width = F.least("source_span_end", "end") - F.greatest("source_span_start", "start")
    pairs = (
        left.join(right, ["document_id", "bin"])
        .filter(
            F.col("bin")
            == F.greatest(
                F.floor(F.col("source_span_start") / bin_width), F.floor(F.col("start") / bin_width)
            )
        )
        .withColumn("w", width)
        .filter(F.col("w") > 0)
    )
    weighted = pairs.groupBy("document_id", "temp_id").agg(
        (F.sum(F.col("w") * F.col("confidence")) / F.sum("w")).alias("weighted")
    )
    return (
        entities.join(weighted, ["document_id", "temp_id"], "left")
        .join(fallback.select("document_id", "avg_confidence"), "document_id", "left")
        .withColumn("ocr_confidence", exact_round(F.coalesce("weighted", "avg_confidence"), 4))
        .drop("weighted", "avg_confidence")
    )


# --------------------------------------------------------------------------- conflicts
def value_conflicts(coded: DataFrame) -> DataFrame:
    """Codes that carry more than one value within a document."""
    return (
        coded.groupBy("document_id", "canonical_code")
        .agg(
            F.countDistinct("normalized_value").alias("value_count"),
            F.min("normalized_value").alias("lowest_value"),
            F.max("normalized_value").alias("highest_value"),
        )
        .filter(F.col("value_count") > 1)
    )

