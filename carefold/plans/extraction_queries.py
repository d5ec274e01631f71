"""Text assembly, extraction and coding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carefold.functions import similarity, units
from carefold.operators import coding, entities, layout
from carefold.operators.table_dictionary import TableDictionary
from carefold.plans.inputs import DOCUMENT_LINE, ENTITIES, NOTES, SPANS, Inputs, sql_select
from carefold.plans.registry import query, values_sql
from carefold.session import spread
from carefold.sources import knowledge
from carefold.sources import knowledge_values as kv

DICTIONARY = entities.Dictionary.builtin()

# --------------------------------------------------------------------------- text assembly
_SPANS = sql_select(SPANS, "conversations")
_OFFSETS = f"""SELECT document_id, span_pos, confidence, text,
  CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY span_pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM ({_SPANS}) s"""


@query("full_text", f"""
SELECT document_id, md5(string_agg(text, chr(10) ORDER BY span_pos)) AS text_md5,
  CAST(sum(length(text) + 1) - 1 AS BIGINT) AS text_length FROM ({_SPANS}) s GROUP BY document_id""")
def full_text(i: Inputs) -> DataFrame:
    return layout.full_text(i.spans()).select(
        "document_id", F.md5("full_text").alias("text_md5"),
        F.length("full_text").cast("long").alias("text_length"),
    )


@query("span_offsets", f"""
SELECT document_id, span_pos, start, start + length(text) AS "end" FROM ({_OFFSETS}) o""")
def span_offsets(i: Inputs) -> DataFrame:
    return layout.span_offsets(i.spans(), block_spans=3).select(
        "document_id", "span_pos", "start", "end"
    )


@query("mean_confidence", f"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS document_id FROM documents), s AS ({_SPANS})
SELECT d.document_id, round(coalesce(avg(s.confidence), 0.0), 4) AS avg_confidence, count(s.document_id) AS span_count
FROM d LEFT JOIN s ON s.document_id = d.document_id GROUP BY d.document_id""")
def mean_confidence(i: Inputs) -> DataFrame:
    return layout.mean_confidence(i.texts(), i.spans())


@query("low_confidence_spans", f"SELECT document_id, span_pos, round(confidence, 4) AS confidence FROM ({_SPANS}) s WHERE confidence < 0.70")
def low_confidence_spans(i: Inputs) -> DataFrame:
    return layout.low_confidence_spans(i.spans()).select(
        "document_id", "span_pos", F.round("confidence", 4).alias("confidence")
    )


# Words of each document as boxes, twelve to a line with slightly uneven baselines.
_WORDS = """
SELECT doc_id, CAST(k AS INTEGER) AS word_pos, w AS text, CAST((k % 12) * 40 AS DOUBLE) AS x0,
  floor(k / 12) * 14 + (k % 3) * 0.5 AS y0 FROM (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS k
  FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM documents) a) b"""


# Bytes of documents whose words one task makes.
WORD_TASK_BYTES = 4 << 20


def words(i: Inputs) -> DataFrame:
    split = F.filter(F.split("text", " "), lambda w: w != "")
    k = F.col("word_pos")
    # a text makes some ninety bytes of boxes a word: tasks of few texts keep them in memory
    return (
        spread(i.table("documents").select("doc_id", "text"), WORD_TASK_BYTES).select(
            F.col("doc_id").alias("document_id"), F.lit(1).alias("page"),
            F.posexplode(split).alias("word_pos", "text"),
        )
        .withColumn("x0", (k % 12 * 40).cast("double"))
        .withColumn("y0", F.floor(k / 12) * 14 + (k % 3) * 0.5)
        .withColumn("x1", F.col("x0") + 30.0)
        .withColumn("y1", F.col("y0") + 10.0)
    )


@query("line_rebuild", f"""
WITH w AS (SELECT *, round_even(((y0 + y0 + 10.0) / 2) / 5, 0) * 5 AS bucket, x0 + 15.0 AS xc FROM ({_WORDS}) x),
l AS (SELECT doc_id, bucket, count(*) AS n, string_agg(text, ' ' ORDER BY xc, word_pos) AS line FROM w GROUP BY ALL)
SELECT doc_id AS document_id, md5(string_agg(line, chr(10) ORDER BY bucket)) AS text_md5, count(*) AS line_count
FROM l GROUP BY doc_id HAVING sum(n) > 10""")
def line_rebuild(i: Inputs) -> DataFrame:
    return layout.rebuild_lines(words(i)).select("document_id", F.md5("text").alias("text_md5"), "line_count")


@query("polygon_boxes", """
WITH p AS (SELECT vec_id, list_transform(range(1, 5), lambda k: CAST(embedding[2 * k - 1] AS DOUBLE)) AS xs,
  list_transform(range(1, 5), lambda k: CAST(embedding[2 * k] AS DOUBLE)) AS ys FROM embeddings)
SELECT vec_id, round(list_min(xs), 5) AS x, round(list_min(ys), 5) AS y,
  round(list_max(xs) - list_min(xs), 5) AS width, round(list_max(ys) - list_min(ys), 5) AS height FROM p""")
def polygon_boxes(i: Inputs) -> DataFrame:
    e = F.col("embedding")
    corners = F.array(*[
        F.array(e[2 * k].cast("double"), e[2 * k + 1].cast("double")) for k in range(4)
    ])
    box = i.table("embeddings").select("vec_id", layout.polygon_box(corners, F.lit(1)).alias("b"))
    return box.select(
        "vec_id", *[F.round(f"b.{c}", 5).alias(c) for c in ("x", "y", "width", "height")]
    )


@query("recogniser_spans", """
WITH b AS (SELECT doc_id, string_split(text, chr(10)) AS texts FROM documents),
z AS (SELECT doc_id, unnest(texts) AS text, generate_subscripts(texts, 1) - 1 AS span_pos, len(texts) AS n FROM b)
SELECT doc_id AS document_id, CAST(span_pos AS INTEGER) AS span_pos, md5(text) AS text_md5,
  round(0.5 + (span_pos % 10) / 20.0, 4) AS confidence, CAST(span_pos * 10 AS DOUBLE) AS y
FROM z WHERE regexp_matches(text, '\\S') AND span_pos < greatest(n - doc_id % 3, 0)""")
def recogniser_spans(i: Inputs) -> DataFrame:
    """Blocks of lines whose score list may be shorter than the texts."""
    texts = F.split("text", "\n")
    lines = i.table("documents").select(
        F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), texts.alias("texts")
    )
    positions = F.transform("texts", lambda t, k: k)
    count = F.greatest(F.size("texts") - F.col("document_id") % 3, F.lit(0)).cast("int")
    blocks = lines.withColumn(
        "scores",
        F.slice(F.transform(positions, lambda k: 0.5 + (k % 10) / 20.0), F.lit(1), count),
    ).withColumn(
        "polygons",
        F.transform(
            positions,
            lambda k: F.array(
                F.array(F.lit(0.0), k * 10.0), F.array(F.lit(50.0), k * 10.0),
                F.array(F.lit(50.0), k * 10.0 + 8.0), F.array(F.lit(0.0), k * 10.0 + 8.0),
            ),
        ),
    )
    return layout.recogniser_spans(blocks).select(
        "document_id", "span_pos", F.md5("text").alias("text_md5"),
        F.round("confidence", 4).alias("confidence"), F.col("bounding_box.y").alias("y"),
    )


# --------------------------------------------------------------------------- extraction
_ALIAS_ROWS = list(dict.fromkeys(
    (e["domain"], a if len(a) <= entities.SHORT_ALIAS else a.lower(), len(a) <= entities.SHORT_ALIAS, e["key"])
    for e in DICTIONARY.entries for a in [e["key"], *e["aliases"]]
))
_ENTRY_ROWS = [(e["domain"], e["key"], e["code"], e["display"], e.get("unit_canonical"))
               for e in DICTIONARY.entries]
_RE_ALIAS = "regexp_replace(a.alias, '([\\^$.|?*+()\\[\\]{}#-])', '\\\\\\1', 'g')"
_B, _E = "(?:^|[^A-Za-z0-9])", "(?:$|[^A-Za-z0-9])"
_UNITS = "|".join(
    u.replace("^", "\\^").replace(".", "\\.")
    for u in sorted(entities.KNOWN_UNITS, key=len, reverse=True)
)


def _union(patterns: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(patterns)


# Report lines name an alias at most once, so its first place is the mention.
_ENTITY_STEPS = f"""
aliases AS (SELECT * FROM {values_sql(_ALIAS_ROWS, 'domain, alias, short, key')}),
entries AS (SELECT * FROM {values_sql(_ENTRY_ROWS, 'domain, key, code, display, unit_canonical')}),
raw AS (SELECT n.*, a.domain, a.key, a.alias, a.short,
    (CASE WHEN a.short THEN strpos(text, a.alias) ELSE strpos(lower(text), a.alias) END) - 1 AS ms
  FROM n JOIN aliases a ON (CASE WHEN a.short THEN contains(text, a.alias) ELSE contains(lower(text), a.alias) END)),
bounded AS (SELECT *, ms + length(alias) AS me FROM raw
  WHERE (ms = 0 OR NOT regexp_matches(substr(text, ms, 1), '[A-Za-z0-9]'))
    AND NOT regexp_matches(substr(text, ms + length(alias) + 1, 1), '[A-Za-z0-9]')),
mentions AS (SELECT *, substr(text, ms + 1, me - ms) AS matched FROM bounded b WHERE NOT EXISTS (
    SELECT 1 FROM bounded o WHERE o.document_id = b.document_id AND o.span_pos = b.span_pos AND o.domain = b.domain
      AND o.ms < b.me AND o.me > b.ms AND (length(o.alias) > length(b.alias)))),
win AS (SELECT m.*, string_split(substr(text, me + 1, 60), chr(10))[1] AS w FROM mentions m),
val AS (SELECT *,
    regexp_extract(w, '(?i)^\\s*[:\\-=]?\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*({_UNITS})?', 1) AS lv,
    nullif(regexp_extract(w, '(?i)^\\s*[:\\-=]?\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*({_UNITS})?', 2), '') AS lu,
    length(regexp_extract(w, '(?i)^\\s*[:\\-=]?\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*({_UNITS})?', 0)) AS ll,
    regexp_extract(w, '(?i)^\\s*[:\\-]?\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*(mg|mcg|g|units?|IU|mL)\\b', 1) AS dv,
    regexp_extract(w, '(?i)^\\s*[:\\-]?\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*(mg|mcg|g|units?|IU|mL)\\b', 2) AS du,
    length(regexp_extract(w, '(?i)^\\s*[:\\-]?\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*(mg|mcg|g|units?|IU|mL)\\b', 0)) AS dl
  FROM win),
freq AS (SELECT *, substr(w, dl + 1, 20) AS fw FROM val WHERE domain <> 'lab' OR lv <> ''),
fr AS (SELECT *, CASE WHEN domain = 'medication' THEN CASE
    {' '.join(f"WHEN regexp_matches(fw, '(?i){p}') THEN '{label}'" for p, label in entities.FREQUENCIES)} END END AS fq,
    me + CASE domain WHEN 'lab' THEN ll WHEN 'medication' THEN dl ELSE 0 END AS ee FROM freq),
ctx AS (SELECT *,
    regexp_extract(substr(text, greatest(ms - 45, 0) + 1, least(ms, 45)), '(?s)^(?:.*(?:[.!?]\\s+|\\n+))?(.*)$', 1) AS bef,
    regexp_extract(substr(text, ms + 1, ee - ms + 25), '(?s)^(.*?)(?:[.!?]\\s|\\n|$)', 1) AS sen,
    regexp_extract(substr(text, ms + 1, ee - ms + 25), '(?s)^(.*?[.!?])\\s', 1) AS sen_dot FROM fr),
ctx2 AS (SELECT *, substr(CASE WHEN sen_dot <> '' THEN sen_dot ELSE sen END, ee - ms + 1, 25) AS aft FROM ctx),
st AS (SELECT *, regexp_matches(bef, '{_union(entities.FAMILY_HISTORY)}') AS fam, CASE
    WHEN regexp_matches(bef, '{_union(entities.FAMILY_HISTORY)}') THEN 'conditional'
    WHEN regexp_matches(bef, '{_union(entities.NEGATION_BEFORE)}') OR regexp_matches(aft, '{_union(entities.NEGATION_AFTER)}') THEN 'absent'
    WHEN regexp_matches(bef, '{_union(entities.HYPOTHETICAL)}') THEN 'hypothetical'
    WHEN regexp_matches(bef, '{_union(entities.CONDITIONAL)}') OR regexp_matches(aft, '{_union(entities.CONDITIONAL)}') THEN 'conditional'
    WHEN regexp_matches(bef, '{_union(entities.POSSIBLE)}') OR regexp_matches(aft, '{_union(entities.POSSIBLE)}') THEN 'possible'
    ELSE 'present' END AS status FROM ctx2),
ent AS (SELECT st.*, e.code, e.display, e.unit_canonical,
    CASE WHEN st.domain = 'lab' THEN CASE WHEN st.key IN ({', '.join(f"'{k}'" for k in kv.VITAL_KEYS)})
      THEN 'vital_sign' ELSE 'lab_value' END ELSE st.domain END AS entity_type,
    CASE st.domain WHEN 'lab' THEN CASE WHEN length(matched) <= 3 THEN 0.8 ELSE 0.93 END
      WHEN 'medication' THEN CASE WHEN dv <> '' OR fq IS NOT NULL THEN 0.92 ELSE 0.82 END - CASE WHEN length(matched) <= 3 THEN 0.1 ELSE 0 END
      ELSE 0.9 - CASE WHEN length(matched) <= 3 THEN 0.1 ELSE 0 END END::DOUBLE AS conf
  FROM st JOIN entries e ON e.domain = st.domain AND e.key = st.key)
"""

ENTITY_SQL = f"""
WITH n AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY span_pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS base FROM ({sql_select(NOTES, 'events')}) x),
""" + _ENTITY_STEPS
# In a report only the last line names anything.
REPORT_SQL = f"""
WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, 0 AS span_pos, 0.9 AS confidence,
  CAST(length(text) + 1 AS INTEGER) AS base, {DOCUMENT_LINE} AS text FROM documents),
""" + _ENTITY_STEPS
# Sentence bounds from the breaks and the texts between them; a break begins
# behind its closing punctuation.
_SENTENCES = f"""
rep AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, text || chr(10) || ({DOCUMENT_LINE}) AS text FROM documents),
brk AS (SELECT *, regexp_extract_all(text, '[.!?]\\s+|\\n+') AS h, regexp_split_to_array(text, '[.!?]\\s+|\\n+') AS g FROM rep),
pos AS (SELECT *, CAST(unnest(range(0, len(h) + 1)) AS INTEGER) AS k FROM brk),
bnd AS (SELECT document_id, text, k AS sentence_pos,
  CAST(coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:k], lambda x: length(x))), 0) AS INTEGER) AS s,
  CAST(CASE WHEN k = len(h) THEN length(text) ELSE list_sum(list_transform(g[1:k+1], lambda x: length(x)))
    + coalesce(list_sum(list_transform(h[1:k], lambda x: length(x))), 0)
    + CASE WHEN regexp_matches(h[k+1], '^[.!?]') THEN 1 ELSE 0 END END AS INTEGER) AS e FROM pos),
sents AS (SELECT document_id, sentence_pos, s, e, substr(text, s + 1, e - s) AS sentence FROM bnd
  WHERE regexp_matches(substr(text, s + 1, e - s), '\\S'))
"""


def extracted(i: Inputs) -> DataFrame:
    notes = i.notes()
    return entities.extract(notes, DICTIONARY, layout.span_offsets(notes))


@query("alias_mentions", ENTITY_SQL.replace("ent AS (", "ignored AS (") + """
SELECT document_id, span_pos, domain, key, ms AS mention_start, me AS mention_end, matched AS matched_text FROM mentions""")
def alias_mentions(i: Inputs) -> DataFrame:
    return entities.mentions(i.notes(), DICTIONARY, ["document_id", "span_pos"]).select(
        "document_id", "span_pos", "domain", "key", "mention_start", "mention_end", "matched_text"
    )


# Every line names its aliases twice, and a part by an alias of its own.
_TWICE = f"""
WITH n AS (SELECT x.document_id, x.span_pos, x.text || '; again ' || x.text || ' and ' || upper(p.p_name) || ' ' || p.p_partkey || '.' AS text
  FROM ({sql_select(NOTES, 'events')}) x JOIN part p ON p.p_partkey = x.span_pos % 1000),
aliases AS (SELECT domain, alias, short, key FROM {values_sql(_ALIAS_ROWS, 'domain, alias, short, key')}
  UNION ALL SELECT 'diagnosis', lower(p_name) || ' ' || p_partkey, FALSE, 'part ' || p_partkey FROM part),
raw AS (SELECT n.*, a.*, unnest(list_filter(range(0, length(text)),
    lambda p: substr(CASE WHEN a.short THEN text ELSE lower(text) END, p + 1, length(a.alias)) = a.alias)) AS ms
  FROM n JOIN aliases a ON (CASE WHEN a.short THEN contains(text, a.alias) ELSE contains(lower(text), a.alias) END)),
bounded AS (SELECT *, ms + length(alias) AS me FROM raw
  WHERE (ms = 0 OR NOT regexp_matches(substr(text, ms, 1), '[A-Za-z0-9]'))
    AND NOT regexp_matches(substr(text, ms + length(alias) + 1, 1), '[A-Za-z0-9]'))
SELECT document_id, span_pos, domain, key, CAST(ms AS INTEGER) AS mention_start, CAST(me AS INTEGER) AS mention_end,
  substr(text, ms + 1, me - ms) AS matched_text FROM bounded b WHERE NOT EXISTS (
    SELECT 1 FROM bounded o WHERE o.document_id = b.document_id AND o.span_pos = b.span_pos AND o.domain = b.domain
      AND o.ms < b.me AND o.me > b.ms AND length(o.alias) > length(b.alias))"""


@query("table_mentions", _TWICE)
def table_mentions(i: Inputs) -> DataFrame:
    """Mentions of an ontology that is a table: the built-in entries and one for every part."""
    parts = i.table("part").select("p_partkey", F.concat_ws(" ", F.col("p_name"), F.col("p_partkey").cast("string")).alias("part"))
    ontology = knowledge.builtin_ontology(i.spark).unionByName(
        parts.select(
            F.lit("diagnosis").alias("domain"), F.lit(1_000_000).alias("ordinal"), F.concat(F.lit("part "), F.col("p_partkey")).alias("key"),
            F.array("part").alias("aliases"),
        ), allowMissingColumns=True,
    )
    lines = i.derive("events", NOTES).join(parts, F.col("span_pos") % 1000 == F.col("p_partkey")).select(
        "document_id", "span_pos", F.concat("text", F.lit("; again "), "text", F.lit(" and "), F.upper("part"), F.lit(".")).alias("text")
    )
    return entities.mentions(lines, TableDictionary(ontology), ["document_id", "span_pos"]).select(
        "document_id", "span_pos", "domain", "key", "mention_start", "mention_end", "matched_text"
    )


@query("document_mentions", REPORT_SQL.replace("ent AS (", "ignored AS (") + """
SELECT document_id, domain, key, base + ms AS mention_start, base + me AS mention_end, matched AS matched_text FROM mentions""")
def document_mentions(i: Inputs) -> DataFrame:
    """Dictionary mentions in whole documents."""
    return entities.mentions(i.reports(), DICTIONARY, ["document_id"]).select(
        "document_id", "domain", "key", "mention_start", "mention_end", "matched_text"
    )


@query("extracted_entities", ENTITY_SQL + """
SELECT document_id, span_pos, entity_type, key AS entity_label,
  CASE WHEN domain = 'lab' THEN lv ELSE display END AS raw_value,
  CASE WHEN domain = 'lab' THEN coalesce(lu, unit_canonical)
    ELSE nullif(concat_ws(' ', nullif(dv || du, ''), fq), '') END AS unit_raw,
  base + ms AS source_span_start, base + ee AS source_span_end,
  round(confidence, 4) AS ocr_confidence, round(conf, 4) AS ner_confidence,
  round(confidence * conf, 4) AS combined_confidence, status AS assertion_status, fam AS ambiguity_flag FROM ent""")
def extracted_entities(i: Inputs) -> DataFrame:
    return extracted(i).select(
        "document_id", "span_pos", "entity_type", "entity_label", "raw_value", "unit_raw",
        "source_span_start", "source_span_end", "ocr_confidence", "ner_confidence",
        "combined_confidence", "assertion_status", "ambiguity_flag",
    )


@query("vital_signs", ENTITY_SQL + "SELECT document_id, span_pos, key AS entity_label, lv AS raw_value FROM ent WHERE entity_type = 'vital_sign'")
def vital_signs(i: Inputs) -> DataFrame:
    return extracted(i).filter("entity_type = 'vital_sign'").select(
        "document_id", "span_pos", "entity_label", "raw_value"
    )


@query("lab_values", ENTITY_SQL + "SELECT document_id, span_pos, key, lv AS value, lu AS unit, ll AS length FROM ent WHERE domain = 'lab'")
def lab_values(i: Inputs) -> DataFrame:
    found = entities.mentions(i.notes(), DICTIONARY, ["document_id", "span_pos"]).filter("domain = 'lab'")
    value = entities.lab_value(entities.line_after(F.col("text_after")))
    return found.withColumn("v", value).filter("v IS NOT NULL").select(
        "document_id", "span_pos", "key", "v.value", "v.unit", "v.length"
    )


@query("doses", ENTITY_SQL + "SELECT document_id, span_pos, key, nullif(dv || du, '') AS dose FROM ent WHERE domain = 'medication'")
def doses(i: Inputs) -> DataFrame:
    found = entities.mentions(i.notes(), DICTIONARY, ["document_id", "span_pos"]).filter("domain = 'medication'")
    d = entities.dose(entities.line_after(F.col("text_after")))
    return found.withColumn("d", d).select("document_id", "span_pos", "key", F.col("d.text").alias("dose"))


@query("frequencies", ENTITY_SQL + "SELECT document_id, span_pos, key, fq AS frequency FROM ent WHERE domain = 'medication'")
def frequencies(i: Inputs) -> DataFrame:
    found = entities.mentions(i.notes(), DICTIONARY, ["document_id", "span_pos"]).filter("domain = 'medication'")
    window = entities.line_after(F.col("text_after"))
    return (
        found.withColumn("w", window)
        .withColumn("n", entities.frequency_window(F.col("w"), entities.dose(F.col("w"))["length"]))
        .select("document_id", "span_pos", "key", entities.frequency(F.col("n")).alias("frequency"))
    )


@query("assertion_classes", ENTITY_SQL + "SELECT key AS entity_label, status AS assertion_status, fam AS ambiguity_flag, count(*) AS mentions FROM ent GROUP BY ALL")
def assertion_classes(i: Inputs) -> DataFrame:
    return extracted(i).groupBy("entity_label", "assertion_status", "ambiguity_flag").agg(
        F.count("*").alias("mentions")
    )


@query("match_confidence", ENTITY_SQL + "SELECT entity_type, key AS entity_label, round(conf, 4) AS ner_confidence, count(*) AS mentions FROM ent GROUP BY ALL")
def match_confidence(i: Inputs) -> DataFrame:
    return extracted(i).groupBy("entity_type", "entity_label", "ner_confidence").agg(
        F.count("*").alias("mentions")
    )


@query("documents_without_entities", ENTITY_SQL + """
SELECT n.document_id, n.span_pos FROM n LEFT JOIN ent ON ent.document_id = n.document_id AND ent.span_pos = n.span_pos
WHERE ent.key IS NULL""")
def documents_without_entities(i: Inputs) -> DataFrame:
    """Spans that give no entity, blank ones among them."""
    return i.notes().select("document_id", "span_pos").join(
        extracted(i).select("document_id", "span_pos"), ["document_id", "span_pos"], "left_anti"
    )


@query("sentences", "WITH " + _SENTENCES + """
SELECT document_id, sentence_pos, s AS start, e AS "end", md5(sentence) AS sentence_md5 FROM sents""")
def sentences(i: Inputs) -> DataFrame:
    return entities.sentences(i.reports()).select(
        "document_id", "sentence_pos", "start", "end", F.md5("sentence").alias("sentence_md5")
    )


@query("mention_sentences", REPORT_SQL.replace("ent AS (", "ignored AS (") + ", " + _SENTENCES + """
SELECT m.document_id, m.domain, m.base + m.ms AS "offset", st.sentence_pos, md5(st.sentence) AS sentence_md5
FROM mentions m JOIN sents st ON st.document_id = m.document_id AND st.s <= m.base + m.ms AND m.base + m.ms < st.e""")
def mention_sentences(i: Inputs) -> DataFrame:
    """The sentence of each dictionary mention in whole documents."""
    found = entities.mentions(i.reports(), DICTIONARY, ["document_id"]).select(
        "document_id", F.col("mention_start").alias("offset"),
        F.concat_ws("|", "domain", "mention_start").alias("mention_id"),
    )
    joined = entities.sentence_of(found, entities.sentences(i.reports()))
    return joined.select(
        "document_id", F.split("mention_id", "[|]")[0].alias("domain"), "offset", "sentence_pos",
        F.md5("sentence").alias("sentence_md5"),
    )


_MENTION_SPANS = """SELECT CAST(conv_id AS VARCHAR) AS document_id,
  CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS temp_id,
  CAST(turn * 61 AS INTEGER) AS source_span_start, CAST(turn * 61 + 150 + turn % 3 AS INTEGER) AS source_span_end FROM conversations"""


@query("overlap_confidence", f"""
WITH o AS ({_OFFSETS}), e AS ({_MENTION_SPANS}),
d AS (SELECT document_id, avg(confidence) AS m FROM ({_SPANS}) s GROUP BY document_id),
p AS (SELECT e.document_id, e.temp_id, least(source_span_end, start + length(text)) - greatest(source_span_start, start) AS w, confidence
  FROM e JOIN o ON o.document_id = e.document_id AND o.start < e.source_span_end AND o.start + length(o.text) > e.source_span_start),
m AS (SELECT document_id, temp_id, sum(w * confidence) / sum(w) AS c FROM p WHERE w > 0 GROUP BY ALL)
SELECT e.document_id, e.temp_id, round(coalesce(m.c, round(d.m, 4)), 4) AS ocr_confidence
FROM e LEFT JOIN m USING (document_id, temp_id) LEFT JOIN d ON d.document_id = e.document_id""")
def overlap_confidence(i: Inputs) -> DataFrame:
    """Entities over several spans of a conversation."""
    found = i.table("conversations").selectExpr(
        "CAST(conv_id AS string) AS document_id",
        "CAST(conv_id AS string) || '-' || CAST(turn AS string) AS temp_id",
        "CAST(turn * 61 AS int) AS source_span_start",
        "CAST(turn * 61 + 150 + turn % 3 AS int) AS source_span_end",
    )
    spans = i.spans()
    means = layout.mean_confidence(spans.select("document_id").distinct(), spans)
    return entities.overlap_confidence(found, layout.span_offsets(spans), means).select(
        "document_id", "temp_id", "ocr_confidence"
    )


@query("value_conflicts", f"""
WITH e AS ({sql_select(ENTITIES, 'lineitem')})
SELECT document_id, canonical_code, count(DISTINCT normalized_value) AS value_count,
  min(normalized_value) AS lowest_value, max(normalized_value) AS highest_value
FROM e WHERE canonical_code IS NOT NULL GROUP BY ALL HAVING count(DISTINCT normalized_value) > 1""")
def value_conflicts(i: Inputs) -> DataFrame:
    return entities.value_conflicts(i.entities().filter("canonical_code IS NOT NULL"))


# --------------------------------------------------------------------------- coding
_TO_CODE = {
    "document_id": "CAST(user_id AS string)",
    "patient_id": "user_id",
    "temp_id": "CAST(event_id AS string)",
    "entity_type": "CASE event_id % 7 WHEN 0 THEN 'lab_value' WHEN 1 THEN 'vital_sign' WHEN 2 THEN 'medication' "
                   "WHEN 3 THEN 'diagnosis' WHEN 4 THEN 'procedure' ELSE 'lab_value' END",
    "entity_label": "CASE event_id % 7 WHEN 0 THEN CASE user_id % 4 WHEN 0 THEN 'Hemoglobin' WHEN 1 THEN 'HbA1c' "
                    "WHEN 2 THEN 'Glucose' ELSE 'Creatinine' END WHEN 1 THEN 'BloodPressureSystolic' "
                    "WHEN 2 THEN CASE WHEN user_id % 3 > 0 THEN 'Metformin' END WHEN 3 THEN 'Gout' "
                    "WHEN 5 THEN 'HDL' ELSE CASE WHEN user_id % 5 > 0 THEN 'LDL' END END",
    "raw_value": "CASE WHEN event_id % 7 IN (2, 3, 4) THEN CASE event_id % 3 WHEN 0 THEN 'Metfromin' "
                 "WHEN 1 THEN 'Zzzblorp' ELSE 'atorvastatn' END WHEN event_id % 29 = 0 THEN '-4.5' "
                 "WHEN event_id % 31 = 0 THEN 'pending' ELSE CAST(value AS string) END",
    "unit_raw": "CASE event_id % 5 WHEN 0 THEN 'MG/DL' WHEN 1 THEN ' mmol / l ' WHEN 2 THEN 'g/dl' WHEN 3 THEN '%' END",
}
_CONTEXT = {"sex": "CASE user_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END",
            "date_of_birth": "CASE WHEN user_id % 4 <> 0 THEN make_date(CAST(1930 + user_id % 90 AS int), 5, 17) END"}
_UNIT_VALUES = values_sql(list(units.UNIT_ALIASES.items()), "spelling, unit")
_NORMAL = "coalesce(u.unit, regexp_replace(trim({0}), '\\s+', ' ', 'g'))"
_BAND_ROWS = values_sql(
    [(c, u, p, *b) for c, u, _, _, bands in kv.BANDS for p, b in enumerate(bands)],
    "code, unit, band_pos, sex, age_min, age_max, low, high, interpretation",
)


def _band_sql(source: str) -> str:
    """Adds the chosen band to rows with ``rid, code, sex, age``."""
    return f"""
bands AS (SELECT *, regexp_matches(lower(coalesce(interpretation, '')), 'normal|desirable|optimal') AS reads_normal FROM {_BAND_ROWS}),
j AS (SELECT x.rid, x.sex AS psex, x.age AS page_, b.*,
    ((x.sex IS NULL OR b.sex IN (x.sex, 'any')) AND (x.age IS NULL OR x.age BETWEEN b.age_min AND b.age_max)) AS fits
  FROM {source} x JOIN bands b ON b.code = x.code),
k AS (SELECT *, bool_or(fits) OVER (PARTITION BY rid) AS any_fit FROM j),
f AS (SELECT * FROM k WHERE fits OR NOT any_fit),
ad AS (SELECT *, bool_or(age_min >= 18) OVER (PARTITION BY rid) AS any_adult FROM f),
c AS (SELECT * FROM ad WHERE page_ IS NOT NULL OR NOT any_adult OR age_min >= 18),
chosen AS (SELECT rid, any_value(unit) AS range_unit,
    CASE WHEN bool_or(reads_normal) THEN arg_min(low, band_pos) FILTER (WHERE reads_normal)
      WHEN count(*) > 1 AND bool_and(psex IS NULL) AND count(DISTINCT sex) > 1 THEN min(low) ELSE arg_min(low, band_pos) END AS low,
    CASE WHEN bool_or(reads_normal) THEN arg_min(high, band_pos) FILTER (WHERE reads_normal)
      WHEN count(*) > 1 AND bool_and(psex IS NULL) AND count(DISTINCT sex) > 1 THEN max(high) ELSE arg_min(high, band_pos) END AS high
  FROM c GROUP BY rid)"""


_CODE_SQL = f"""
WITH e AS ({sql_select({**_TO_CODE, **_CONTEXT}, 'events')}),
entries AS (SELECT * FROM {values_sql(_ENTRY_ROWS, 'domain, key, code, display, unit_canonical')}),
t AS (SELECT *, CASE WHEN entity_type IN ('lab_value', 'vital_sign') THEN 'lab' WHEN entity_type IN ('medication', 'diagnosis') THEN entity_type END AS domain,
  CAST(floor(date_diff('day', date_of_birth, DATE '2024-05-17') / 365.25) AS INTEGER) AS days_age,
  CAST(2024 - year(date_of_birth) AS INTEGER) AS age FROM e),
hit AS (SELECT t.*, x.code, x.display, x.unit_canonical, CASE WHEN x.code IS NULL AND t.domain = 'medication' THEN
    CASE t.raw_value WHEN 'Metfromin' THEN 'Metformin' WHEN 'atorvastatn' THEN 'Atorvastatin' END END AS near_key
  FROM t LEFT JOIN entries x ON x.domain = t.domain AND x.key = t.entity_label),
near AS (SELECT h.* REPLACE (coalesce(h.code, n.code) AS code, coalesce(h.display, n.display) AS display),
    h.code IS NOT NULL AS exact_hit FROM hit h LEFT JOIN entries n ON n.domain = h.domain AND n.key = h.near_key),
ok AS (SELECT *, code IS NOT NULL AND (domain <> 'lab' OR coalesce(TRY_CAST(raw_value AS DOUBLE), -1) >= 0) AS accepted,
    {_NORMAL.format('unit_raw')} AS src
  FROM near LEFT JOIN {_UNIT_VALUES.replace(' AS v(', ' AS u(')} ON u.spelling = replace(lower(regexp_replace(trim(unit_raw), '\\s+', ' ', 'g')), ' ', '')),
lab AS (SELECT temp_id AS rid, code, sex, age FROM ok WHERE accepted AND domain = 'lab'),{_band_sql('lab')},
coded AS (SELECT ok.*, ch.low, ch.high, ch.range_unit,
    CASE WHEN NOT exact_hit THEN NULL WHEN ok.domain = 'lab' AND ((unit_canonical = 'mg/dL' AND src = 'mmol/L') OR (unit_canonical = 'mmol/L' AND src = 'mg/dL')
      OR (unit_canonical = 'g/dL' AND src = 'mmol/L')) THEN 0.72 ELSE 0.97 END AS conf
  FROM ok LEFT JOIN chosen ch ON ch.rid = ok.temp_id)
"""


def to_code(i: Inputs) -> DataFrame:
    return i.derive("events", _TO_CODE)


def coded(i: Inputs) -> DataFrame:
    patients = i.derive("events", {"patient_id": "user_id", **_CONTEXT}).distinct()
    return coding.code_entities(
        to_code(i), DICTIONARY, knowledge.builtin_bands(i.spark), patients,
        F.lit("2024-05-17").cast("timestamp"),
    )


@query("coded_entities", _CODE_SQL + """
SELECT temp_id, CASE WHEN accepted THEN code END AS canonical_code,
  CASE WHEN accepted THEN CASE domain WHEN 'lab' THEN 'LOINC' WHEN 'medication' THEN 'RxNorm' ELSE 'ICD-10' END END AS coding_system,
  CASE WHEN accepted THEN CASE WHEN domain = 'lab' THEN raw_value ELSE display END END AS normalized_value,
  CASE WHEN accepted AND domain = 'lab' THEN coalesce(unit_canonical, src) END AS unit_canonical,
  low AS reference_range_low, high AS reference_range_high, range_unit AS reference_range_unit,
  CASE WHEN accepted THEN CASE WHEN exact_hit THEN 'exact' ELSE 'fuzzy' END END AS coding_method FROM coded""")
def coded_entities(i: Inputs) -> DataFrame:
    return coded(i).select(
        "temp_id", "canonical_code", "coding_system", "normalized_value", "unit_canonical",
        "reference_range_low", "reference_range_high", "reference_range_unit", "coding_method",
    )


@query("exact_coding", _CODE_SQL + "SELECT temp_id, code AS canonical_code, round(CAST(conf AS DOUBLE), 4) AS coding_confidence FROM coded WHERE accepted AND exact_hit")
def exact_coding(i: Inputs) -> DataFrame:
    return coded(i).filter("coding_method = 'exact'").select(
        "temp_id", "canonical_code", F.round("coding_confidence", 4).alias("coding_confidence")
    )


@query("fuzzy_coding", _CODE_SQL + """
SELECT temp_id, code AS canonical_code, display AS normalized_value,
  CASE raw_value WHEN 'Metfromin' THEN 0.8889 ELSE 0.9565 END::DOUBLE AS coding_confidence FROM coded WHERE accepted AND NOT exact_hit""")
def fuzzy_coding(i: Inputs) -> DataFrame:
    return coded(i).filter("coding_method = 'fuzzy'").select(
        "temp_id", "canonical_code", "normalized_value", "coding_confidence"
    )


@query("value_guards", _CODE_SQL + "SELECT temp_id, raw_value FROM coded WHERE domain = 'lab' AND code IS NOT NULL AND NOT accepted")
def value_guards(i: Inputs) -> DataFrame:
    """Labs with a known name whose value is no number or negative."""
    known = [k for k, *_ in kv.LABS]
    return coding.unmatched_only(coded(i)).filter(
        F.col("entity_type").isin("lab_value", "vital_sign") & F.col("entity_label").isin(known)
    ).select("temp_id", "raw_value")


@query("coding_partition", _CODE_SQL + "SELECT entity_type, CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS BIGINT) AS coded, CAST(sum(CASE WHEN accepted THEN 0 ELSE 1 END) AS BIGINT) AS unmatched FROM coded GROUP BY ALL")
def coding_partition(i: Inputs) -> DataFrame:
    all_ = coded(i)
    return (
        coding.coded_only(all_).select("entity_type", F.lit(1).alias("c"))
        .unionByName(coding.unmatched_only(all_).select("entity_type", F.lit(0).alias("c")))
        .groupBy("entity_type")
        .agg(F.count_if(F.col("c") == 1).alias("coded"), F.count_if(F.col("c") == 0).alias("unmatched"))
    )


_UNIT_PAIR = {
    "event_id": "event_id",
    "a": "CASE event_id % 6 WHEN 0 THEN ' MG/DL' WHEN 1 THEN 'mmol/l' WHEN 2 THEN 'K/uL' WHEN 3 THEN 'beats  per min' "
         "WHEN 4 THEN 'IU/l' END",
    "b": "CASE user_id % 5 WHEN 0 THEN 'mg/dL' WHEN 1 THEN 'mmol/L' WHEN 2 THEN '10^3/ul' WHEN 3 THEN 'ukat/L' END",
}
_UNIT_SQL = f"""WITH p AS ({sql_select(_UNIT_PAIR, 'events')}), um AS (SELECT * FROM {_UNIT_VALUES}),
n AS (SELECT event_id, coalesce(x.unit, regexp_replace(trim(a), '\\s+', ' ', 'g')) AS na, coalesce(y.unit, regexp_replace(trim(b), '\\s+', ' ', 'g')) AS nb
  FROM p LEFT JOIN um x ON x.spelling = replace(lower(regexp_replace(trim(a), '\\s+', ' ', 'g')), ' ', '')
  LEFT JOIN um y ON y.spelling = replace(lower(regexp_replace(trim(b), '\\s+', ' ', 'g')), ' ', ''))
"""


def _normal_pair(i: Inputs) -> DataFrame:
    return i.derive("events", _UNIT_PAIR).select(
        "event_id", units.normal_unit(F.col("a")).alias("na"), units.normal_unit(F.col("b")).alias("nb")
    )


@query("unit_spelling", _UNIT_SQL + "SELECT event_id, na AS unit_a, nb AS unit_b FROM n")
def unit_spelling(i: Inputs) -> DataFrame:
    return _normal_pair(i).select("event_id", F.col("na").alias("unit_a"), F.col("nb").alias("unit_b"))


@query("unit_equivalence", _UNIT_SQL + "SELECT event_id, coalesce(lower(na) = lower(nb), TRUE) AS comparable FROM n")
def unit_equivalence(i: Inputs) -> DataFrame:
    return _normal_pair(i).select(
        "event_id", units.units_comparable(F.col("na"), F.col("nb")).alias("comparable")
    )


@query("cross_system_units", _UNIT_SQL + """SELECT event_id, coalesce((na, nb) IN (('mg/dL', 'mmol/L'), ('mmol/L', 'mg/dL'),
  ('IU/L', 'ukat/L'), ('g/dL', 'mmol/L')), FALSE) AS clash FROM n""")
def cross_system_units(i: Inputs) -> DataFrame:
    return _normal_pair(i).select(
        "event_id", units.is_cross_system(F.col("na"), F.col("nb")).alias("clash")
    )


_BAND_INPUT = {
    "rid": "event_id",
    "code": "CASE event_id % 9 WHEN 0 THEN '718-7' WHEN 1 THEN '2160-0' WHEN 2 THEN '4548-4' WHEN 3 THEN '2085-9' "
            "WHEN 4 THEN '33914-3' WHEN 5 THEN '8480-6' WHEN 6 THEN '6690-2' WHEN 7 THEN '3016-3' ELSE 'none' END",
    "sex": "CASE user_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END",
    "age": "CASE WHEN user_id % 4 <> 0 THEN CAST(user_id % 100 AS int) END",
}


@query("reference_bands", f"WITH q AS ({sql_select(_BAND_INPUT, 'events')}),{_band_sql('q')} "
       "SELECT q.rid, ch.low AS reference_range_low, ch.high AS reference_range_high FROM q LEFT JOIN chosen ch ON ch.rid = q.rid")
def reference_bands(i: Inputs) -> DataFrame:
    return coding.with_reference_band(
        i.derive("events", _BAND_INPUT), knowledge.builtin_bands(i.spark)
    ).select("rid", "reference_range_low", "reference_range_high")


@query("patient_age", """
SELECT o_orderkey, CAST(date_diff('year', DATE '1990-03-10', o_orderdate)
  - CASE WHEN strftime(o_orderdate, '%m%d') < '0310' THEN 1 ELSE 0 END AS INTEGER) AS age FROM orders""")
def patient_age(i: Inputs) -> DataFrame:
    return i.table("orders").select(
        "o_orderkey", coding.age_at(F.lit("1990-03-10").cast("date"), F.col("o_orderdate")).alias("age")
    )


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda k: substr('  ' || w || ' ', k, 3)))))"


@query("trigram_similarity", f"""
WITH p AS (SELECT p_partkey, {_TRI.format('p_name')} AS a, {_TRI.format("replace(p_name, 'e', 'a') || ' ' || p_type")} AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) AS similarity FROM p""")
def trigram_similarity(i: Inputs) -> DataFrame:
    a = F.col("p_name")
    b = F.concat(F.replace(F.col("p_name"), F.lit("e"), F.lit("a")), F.lit(" "), F.col("p_type"))
    return i.table("part").select(
        "p_partkey", F.round(similarity.trigram_similarity(a, b), 4).alias("similarity")
    )


_ALIAS_PICK = ("CASE event_id % 8 WHEN 0 THEN 'Hgb' WHEN 1 THEN 'haemoglobin' WHEN 2 THEN 'GLUCOPHAGE' WHEN 3 THEN 'K+' "
               "WHEN 4 THEN 'urea' WHEN 5 THEN 'T. bili' WHEN 6 THEN 'htn' ELSE 'unknown word' END")
_ALIAS_TABLE = values_sql(
    [(e["domain"], a, e["key"]) for e in DICTIONARY.entries for a in dict.fromkeys([e["key"], *e["aliases"]])],
    "domain, alias, key",
)


@query("alias_resolution", f"""
WITH a AS (SELECT * FROM {_ALIAS_TABLE}), p AS (SELECT event_id, {_ALIAS_PICK} AS name FROM events),
l AS (SELECT DISTINCT domain, lower(alias) AS alias, key FROM a)
SELECT p.event_id, p.name, x.key AS exact_key, l.key AS folded_key FROM p
LEFT JOIN a x ON x.alias = p.name LEFT JOIN l ON l.alias = lower(p.name)""")
def alias_resolution(i: Inputs) -> DataFrame:
    """Names looked up as written and with case folded."""
    names = knowledge.build_aliases(knowledge.builtin_ontology(i.spark))
    picked = i.table("events").selectExpr("event_id", f"{_ALIAS_PICK} AS name")
    exact = names.filter("form = 'exact'").select(F.col("alias").alias("name"), F.col("key").alias("exact_key"))
    folded = names.filter("form = 'lower'").select(F.col("alias").alias("folded"), F.col("key").alias("folded_key"))
    return (
        picked.join(F.broadcast(exact), "name", "left")
        .withColumn("folded", F.lower("name"))
        .join(F.broadcast(folded), "folded", "left")
        .select("event_id", "name", "exact_key", "folded_key")
    )
