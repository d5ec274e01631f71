"""Approximate name matching."""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_alias(aliases: dict[str, list[str]], cutoff: float):
    """A vectorised ``(domain, text) -> (alias, score)`` over a small alias table.

    No built-in function gives the matching-blocks ratio, hence the Arrow UDF.
    Each distinct text of a batch is scored once; null texts cost nothing, so
    callers null out the rows that need no approximate match.
    """

    @F.pandas_udf("alias string, score double")
    def score(domain: pd.Series, text: pd.Series) -> pd.DataFrame:
        # Nested, so that workers get it by value and need no copy of this package.
        seen: dict = {(None, None): (None, None)}
        results = []
        for d, t in zip(domain, text):
            pair = (d, t) if t else (None, None)
            if pair not in seen:
                near = difflib.get_close_matches(t, aliases.get(d, []), n=1, cutoff=cutoff)
                seen[pair] = (
                    (near[0], difflib.SequenceMatcher(None, t, near[0]).ratio())
                    if near
                    else (None, None)
                )
            results.append(seen[pair])
        return pd.DataFrame(results, columns=["alias", "score"])

    return score


# --------------------------------------------------------------------------- join of many names
# The ratio of a and b is 2 M / (|a| + |b|), M being the characters in blocks that both hold in the same order. At least
# m = ceil(cutoff / 2 * (|a| + |b|)) characters must match, so at most d = |a| + |b| - 2 m do not. Cut b into d + 1 segments:
# an unmatched character of b spoils the segment it is in, one of a at most the segment it falls into, so one segment stands
# in a whole. Its place there is that in b, moved back by at most |b| - m and on by at most |a| - m. Names of these lengths that
# share no such segment need no comparison; no pair at the cutoff is lost.
def matching(a: int, b: int, cutoff: float) -> int:
    """The least number of matching characters of names of these lengths; rounding errors never raise it."""
    return math.ceil(cutoff / 2 * (a + b) - 1e-9)


def lengths_near(n: int, cutoff: float) -> range:
    """Lengths of the other name that leave room for the matching characters."""
    low = n
    while low > 1 and matching(n, low - 1, cutoff) <= low - 1:
        low -= 1
    high = n
    while matching(n, high + 1, cutoff) <= n:
        high += 1
    return range(low, high + 1)


def segments(length: int, count: int) -> list[tuple[int, int]]:
    """Begin and end of ``count`` parts of about equal size; none is empty, as ``count`` is at most ``length``."""
    edges = [k * length // count for k in range(count + 1)]
    return list(zip(edges, edges[1:]))


def _parts(a: int, b: int, cutoff: float) -> list[tuple[int, int]]:
    return segments(b, min(b, a + b - 2 * matching(a, b, cutoff) + 1))


def alias_keys(alias: str, cutoff: float) -> Iterator[str]:
    """Keys of an alias: for each length of a name, its segments with their number."""
    b = len(alias)
    for a in lengths_near(b, cutoff):
        for number, (begin, end) in enumerate(_parts(a, b, cutoff)):
            yield f"{a}.{b}.{number}.{alias[begin:end]}"


def name_keys(name: str, cutoff: float) -> set[str]:
    """Keys of a name: its pieces where a segment of an alias of any length near its own may stand."""
    a, found = len(name), set()
    for b in lengths_near(a, cutoff):
        m = matching(a, b, cutoff)
        for number, (begin, end) in enumerate(_parts(a, b, cutoff)):
            size = end - begin
            for at in range(max(0, begin - (b - m)), min(a - size, begin + (a - m)) + 1):
                found.add(f"{a}.{b}.{number}.{name[at : at + size]}")
    return found


def _keyed(names: DataFrame, column: str, make, cutoff: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                rows = [(d, t, k) for d, t in zip(part["domain"], part[column]) for k in make(t, cutoff)]
                yield pd.DataFrame(rows, columns=["domain", column, "key"])

    return names.select("domain", column).mapInPandas(run, f"domain string, {column} string, key string")


def close_names(names: DataFrame, aliases: DataFrame, cutoff: float) -> DataFrame:
    """domain, text, alias and score of the closest alias of each name, if one reaches the cutoff.

    ``names``: domain, text; ``aliases``: domain, alias; each is taken once, nulls and empty ones not at all. The closest alias
    is the one of the largest ratio of alias to name, of equal ratios the last in order; the score is the ratio of name to alias.
    Names and aliases meet over shared segments (see above), and each pair is compared once, exactly.
    """
    texts = names.filter("domain IS NOT NULL AND text <> ''").select("domain", "text").distinct()
    known = aliases.filter("domain IS NOT NULL AND alias <> ''").select("domain", "alias").distinct()
    met = _keyed(texts, "text", name_keys, cutoff).join(_keyed(known, "alias", alias_keys, cutoff), ["domain", "key"])
    pairs = met.select("domain", "text", "alias").distinct()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for domain, text, alias in zip(batch["domain"], batch["text"], batch["alias"]):
                shared = sum((Counter(text) & Counter(alias)).values())
                if shared < matching(len(text), len(alias), cutoff):
                    continue
                near = difflib.SequenceMatcher(None, alias, text).ratio()
                if near >= cutoff:
                    rows.append((domain, text, alias, near, difflib.SequenceMatcher(None, text, alias).ratio()))
            yield pd.DataFrame(rows, columns=["domain", "text", "alias", "near", "score"])

    scored = pairs.mapInPandas(compare, "domain string, text string, alias string, near double, score double")
    return scored.groupBy("domain", "text").agg(F.max_by(F.struct("alias", "score"), F.struct("near", "alias")).alias("best")).select("domain", "text", "best.*")


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of each word, padded by two blanks and one."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pieces = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(pieces))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared share of the trigrams of two texts, from 0 to 1."""
    left, right = trigrams(a), trigrams(b)
    return F.try_divide(
        F.size(F.array_intersect(left, right)).cast("double"), F.size(F.array_union(left, right))
    )
