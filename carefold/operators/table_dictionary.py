"""Dictionary extraction with an ontology of any size.

``entities.Dictionary`` compiles its aliases into the plan, which is quick for some thousands of them. Here the aliases stay a
table. One pass over it sets bits in two bitmaps of a fixed size, over the beginnings and the wholes of aliases as sequences of
atoms; only these reach the workers. A pass over the texts walks from atom to atom while the bitmaps allow it and gives the
places that may be an alias, with the few characters around them. An equi-join with the table tells which are, and for what
entry. Texts are never shuffled and the table is never collected.

Places are chosen as by one alternation of all aliases, the longest first: of the long aliases the leftmost, of equal begins
the longest, then on what they leave the short ones, which must also match in upper and lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carefold.functions.atoms import Atoms, PhraseSet, prefixes
from carefold.operators.entities import AFTER_WINDOW, BEFORE_WINDOW, SHORT_ALIAS, VALUE_WINDOW

#: Each bitmap has 2 to this power bits (2 MB).
BITS = 24
#: Bytes of text worked on at once.
SLICE_BYTES = 4 << 20
FIELDS = ("key", "code", "display", "unit_canonical", "drug_class")


class TableDictionary:
    """Aliases of an ontology table: ``domain, ordinal, key, aliases, code, display, unit_canonical, drug_class``.

    Of entries with one alias the last by ``ordinal`` counts; blank aliases name nothing. Takes the place of
    ``entities.Dictionary`` in ``entities.mentions`` and ``entities.extract``.
    """

    def __init__(self, ontology: DataFrame, bits: int = BITS):
        self.table, self.bits = ontology, bits

    def names(self) -> DataFrame:
        """One row per domain and alias: short ones as written, long ones in lower case, with their entry."""
        listed = F.concat(F.array("key"), F.coalesce("aliases", F.array().cast("array<string>")))
        rows = self.table.select("domain", "ordinal", F.struct(*FIELDS).alias("entry"), F.posexplode(listed).alias("place", "written"))
        short = F.length("written") <= SHORT_ALIAS
        named = rows.filter(F.col("written").rlike(r"\S")).select(
            "domain", F.when(short, "exact").otherwise("lower").alias("form"),
            F.when(short, F.col("written")).otherwise(F.lower("written")).alias("alias"), "entry", F.struct("ordinal", "place").alias("rank"),
        )
        return named.groupBy("domain", "form", "alias").agg(F.max_by("entry", "rank").alias("e")).select("domain", "form", "alias", "e.*")

    def entries(self) -> DataFrame:
        """One row per domain and key: ``domain, key, code, display, unit_canonical``, of equal keys the last."""
        fields = F.struct("code", "display", "unit_canonical")
        return self.table.groupBy("domain", "key").agg(F.max_by(fields, "ordinal").alias("e")).select("domain", "key", "e.*")

    def lowered(self) -> DataFrame:
        """Every alias in lower case with its key: ``domain, alias, key``, of equal aliases the last."""
        listed = F.concat(F.array("key"), F.coalesce("aliases", F.array().cast("array<string>")))
        rows = self.table.select("domain", "ordinal", "key", F.posexplode(listed).alias("place", "written"))
        return rows.groupBy("domain", F.lower("written").alias("alias")).agg(F.max_by("key", F.struct("ordinal", "place")).alias("key"))

    def phrases(self, names: DataFrame) -> PhraseSet:
        """The bitmaps of all aliases: per task the words it sets, put together by ``bit_or``.

        The driver receives at most 2 ** bits / 64 words of each, whatever the number of aliases.
        """
        bits = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                for kind, hashes in enumerate(prefixes(Atoms(batch.column(0).cast(pa.string())), batch.num_rows)):
                    word, held = PhraseSet.words(hashes, bits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(word), kind, np.int32)), pa.array(word), pa.array(held.view(np.int64))], ["kind", "word", "held"]
                    )

        set_words = names.select("alias").distinct().mapInArrow(run, "kind int, word long, held long")
        maps = [np.zeros(max(1, 1 << (bits - 6)), np.uint64) for _ in range(2)]
        for row in set_words.groupBy("kind", "word").agg(F.bit_or("held").alias("held")).toLocalIterator():
            maps[row.kind][row.word] = np.uint64(row.held & 0xFFFFFFFFFFFFFFFF)
        return PhraseSet(*maps, bits)

    def mentions(self, spans: DataFrame, keep: list[str]) -> DataFrame:
        """One row per mention, with the entry it names: the columns that ``entities.mentions`` gives."""
        names = self.names()
        places = candidates(spans, self.phrases(names), keep)
        short = F.length("matched_text") <= SHORT_ALIAS
        formed = places.withColumn("form", F.when(short, "exact").otherwise("lower")).withColumn(
            "alias", F.when(short, F.col("matched_text")).otherwise(F.lower("matched_text"))
        )
        chosen = chosen_places(formed.join(names, ["form", "alias"]))
        return chosen.select(*keep, "domain", "text_before", "text_after", "mention_start", "mention_end", "matched_text", *FIELDS)


def candidates(spans: DataFrame, phrases: PhraseSet, keep: list[str]) -> DataFrame:
    """Places of each text that may be an alias, and ``_row``, which tells the rows of ``spans`` apart."""
    held = spans.sparkSession.sparkContext.broadcast(phrases)
    source = spans.select(*keep, "text").withColumn("_row", F.monotonically_increasing_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.select(*keep).schema)
    schema = f"{kinds}, _row long, text_before string, text_after string, mention_start int, mention_end int, matched_text string"
    names = [*keep, "_row", "text_before", "text_after", "mention_start", "mention_end", "matched_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, len(keep)):
                texts = pc.fill_null(part.column(len(keep)).cast(pa.string()), "")
                atoms = Atoms(texts)
                first, last = held.value.candidates(atoms)
                row, begin, end = atoms.text[first], atoms.begin[first], atoms.end[last]
                found = [texts[r].as_py() for r in np.unique(row).tolist()]
                which = np.searchsorted(np.unique(row), row)
                cut = [(found[w], b, e) for w, b, e in zip(which.tolist(), begin.tolist(), end.tolist(), strict=True)]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(k).take(at) for k in range(len(keep))], part.column(len(keep) + 1).take(at),
                        pa.array([t[max(0, b - BEFORE_WINDOW) : b] for t, b, _ in cut], pa.string()),
                        pa.array([t[e : e + VALUE_WINDOW + AFTER_WINDOW] for t, _, e in cut], pa.string()),
                        pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array([t[b:e] for t, b, e in cut], pa.string()),
                    ],
                    names,
                )

    return source.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of about ``SLICE_BYTES`` of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > SLICE_BYTES:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += size
    if batch.num_rows > begin:
        yield batch.slice(begin)


def chosen_places(found: DataFrame) -> DataFrame:
    """The places that stand of all that match: long ones from left to right, then short ones that touch none of them.

    Only places that overlap are looked at together. Within a text they are chained where one begins before those
    before it have ended; a chain is a few places, however long the text is.
    """
    before = Window.partitionBy("_row", "domain").orderBy("mention_start", "mention_end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_row", "domain").orderBy("mention_start", "mention_end").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce((F.col("mention_start") >= F.max("mention_end").over(before)).cast("int"), F.lit(1))
    chained = found.withColumn("_opens", opens).withColumn("_chain", F.sum("_opens").over(upto))
    other = [c for c in chained.columns if c not in ("_row", "domain", "_chain", "_opens")]
    place = F.struct(F.col("mention_start").alias("_s"), (-F.col("mention_end")).alias("_e"), *[F.col(c) for c in other])
    groups = chained.groupBy("_row", "domain", "_chain").agg(F.sort_array(F.collect_list(place)).alias("_p"))
    long = standing(F.filter("_p", lambda p: p["form"] == "lower"))
    short = F.filter("_p", lambda p: p["form"] == "exact")
    free = F.filter(short, lambda p: ~F.exists(F.col("_long"), lambda o: (o["mention_start"] < p["mention_end"]) & (p["mention_start"] < o["mention_end"])))
    kept = F.when(F.size("_p") == 1, F.col("_p")).otherwise(F.concat("_long", standing(free)))
    return groups.withColumn("_long", long).select("_row", "domain", F.explode(kept).alias("p")).select("_row", "domain", *[f"p.{c}" for c in other])


def standing(places: Column) -> Column:
    """Of places in the order of begin and falling length, each that begins where the one taken before has ended."""
    ends = F.aggregate(
        places, F.struct(F.slice(places, 1, 0).alias("taken"), F.lit(-1).alias("end")),
        lambda held, p: F.when(
            p["mention_start"] >= held["end"],
            F.struct(F.concat(held["taken"], F.array(p)).alias("taken"), p["mention_end"].alias("end")),
        ).otherwise(held),
    )
    return ends["taken"]
