"""Containment joins without a nested loop.

A name contains another only if it holds every run of signs of it.  So the longer side sends its runs, the shorter side
asks for its rarest one, and the few that meet are compared whole.  A name asks by the longest runs of ``RUNS`` signs that it
has: the more names of digits there are, the more share a run of four, but few share one nearly as long as the
name.  The rows grow with the length of the names, neither with the lengths that occur nor with pairs, also when a third of
the names share a prefix.  Names are made distinct before and joined back after.

Long texts are looked up for many terms inside their scan, so only hits leave it: by an automaton of all terms over Arrow
batches, or, where the terms are too many to travel, by anchors behind a Bloom filter.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.bloom import filter_of
from rosterloom.functions.joins import shuffled
from rosterloom.session import durable, spread

# the one Python function travels by value, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_LENGTH = 4
GRAM = 4  # signs of an anchor that is looked for inside words
RUNS = (1, 2, 3, 4, 8, 16)  # signs of a run


def contained(
    longer: DataFrame, long_col: str, shorter: DataFrame, short_col: str, min_length: int = MIN_LENGTH
) -> DataFrame:
    """Distinct pairs (``long_col``, ``short_col``): short text inside long text.

    Equal texts count as contained.  Texts under ``min_length`` are left out.
    """
    met = _met(longer, long_col, shorter, short_col, min_length)
    return met.where(F.col(long_col).contains(F.col(short_col)))


def _met(longer: DataFrame, long_col: str, shorter: DataFrame, short_col: str, min_length: int) -> DataFrame:
    """(``long_col``, ``short_col``) of the texts where the longer holds the rarest run of the shorter."""
    lo = longer.select(F.col(long_col)).where(F.length(long_col) >= min_length).distinct()
    longest = lo.agg(F.max(F.length(long_col))).scalar()
    sh = shorter.select(F.col(short_col)).where((F.length(short_col) >= min_length) & (F.length(short_col) <= longest))
    sh = durable(sh.distinct())
    size = F.greatest(*[F.when(F.length(short_col) >= n, n) for n in RUNS])
    sizes = sh.agg(F.sort_array(F.collect_set(size))).scalar()  # some of RUNS

    def runs(df: DataFrame, col: str, n: Column) -> DataFrame:
        sized = df.select(col, n.alias("_n")).where(F.col("_n") <= F.length(col))
        starts = F.sequence(F.lit(1), F.length(col) - F.col("_n") + 1)
        # a long for a run; two that meet by chance fail the comparison
        return sized.select(col, F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring(F.col(col), i, F.col("_n")))))).alias("_g"))

    held = runs(spread(lo, long_col), long_col, F.explode(sizes))
    often = held.groupBy("_g").agg(F.count(F.lit(1)).alias("_often"))
    asked = runs(sh, short_col, size).join(shuffled(often), "_g", "left").groupBy(short_col).agg(
        F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("often"), F.col("_g").alias("g"))).alias("_r")
    )
    asked = asked.where("_r.often > 0").select(short_col, F.col("_r.g").alias("_g"))
    return shuffled(held).join(asked, "_g").select(long_col, short_col)


def too_short(df: DataFrame, text: Column, min_length: int = MIN_LENGTH) -> DataFrame:
    """The rows that a length guard leaves out: their text is not empty, but under ``min_length``; adds ``status``."""
    return df.where((F.length(text) > 0) & (F.length(text) < min_length)).withColumn("status", F.lit("too short"))


# a text is words and the breaks between them
BREAKS = r"[^\p{L}\p{N}]+"
TERMS, TERM_SIGNS = 200_000, 4 << 20  # terms, and signs of all of them, that may travel with every task
SHORT = 2  # terms up to this length are looked for one by one


def _longest(words: Column) -> Column:
    by_length = F.array_sort(words, lambda x, y: F.length(y) - F.length(x))
    return F.get(F.filter(by_length, lambda w: w != ""), F.lit(0))


def _grams(pieces: Column, lengths: list[int], mark: str) -> Column:
    """The marked substrings of these lengths of every piece."""

    def of_length(piece: Column, n: int) -> Column:
        starts = F.when(F.length(piece) >= n, F.sequence(F.lit(1), F.length(piece) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(piece, i, F.lit(n))))

    def of(piece: Column) -> Column:
        return F.concat(*[of_length(piece, n) for n in lengths])

    return F.flatten(F.transform(pieces, of))


def terms_in_texts(
    texts: DataFrame, id_col: str, text_col: str, terms: DataFrame, term_col: str, most: int = TERMS
) -> DataFrame:
    """(``id_col``, ``term_col``) where the text contains the term, ignoring case; texts are not cut into substrings.

    Up to ``most`` terms (and ``TERM_SIGNS`` signs) travel with the tasks, and one scan of the texts finds them all without an
    exchange.  Beyond, hits of the terms' anchors leave a scan that tests them in a Bloom filter, meet their terms, and
    a second scan, again behind a filter, reads the texts of the ids found.
    """
    t = terms.select(term_col, F.lower(term_col).alias("_term")).where(F.length(term_col) > 0).distinct()
    t = durable(t)
    n, signs = t.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_term")), F.lit(0))).head()
    if n <= most and signs <= TERM_SIGNS:
        return _scanned(texts, id_col, text_col, t, term_col)
    return _anchored(texts, id_col, text_col, t, term_col, n)


def _scanned(texts: DataFrame, id_col: str, text_col: str, t: DataFrame, term_col: str) -> DataFrame:
    """All terms by an Aho-Corasick automaton that every task builds once."""
    spellings: dict[str, list[str]] = {}
    for original, term in t.collect():  # bounded by the caller
        spellings.setdefault(term, []).append(original)
    sent = t.sparkSession.sparkContext.broadcast(spellings)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        import pyarrow as pa

        terms = sent.value
        short = [term for term in terms if len(term) <= SHORT]
        automaton = ahocorasick.Automaton()
        for term in terms:
            if len(term) > SHORT:
                automaton.add_word(term, term)
        automaton.make_automaton()
        for rows in batches:
            at, found = [], []
            for i, text in enumerate(rows["text"].to_pylist()):
                if not text:
                    continue
                hits = {term for term in short if term in text}
                if len(automaton):
                    hits.update(term for _, term in automaton.iter(text))
                for term in hits:
                    at += [i] * len(terms[term])
                    found += terms[term]
            yield pa.record_batch([rows["id"].take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["id", "term"])

    kind = dict(texts.dtypes)[id_col]
    low = texts.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    return low.mapInArrow(scan, f"id {kind}, term string").select(F.col("id").alias(id_col), F.col("term").alias(term_col))


def _anchored(texts: DataFrame, id_col: str, text_col: str, t: DataFrame, term_col: str, n: int) -> DataFrame:
    """Every term has an anchor: its longest inner word, which any text containing the term holds as a whole word, or, if it
    has none, the first signs of its longest word, which such a text holds inside a word.  A term without any word is looked
    up in the same way among the breaks between words.
    """
    words = F.split("_term", BREAKS)
    inner = _longest(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))))
    t = t.withColumns({"_inner": inner, "_outer": F.substring(_longest(words), 1, GRAM)})
    kind = F.when(F.col("_inner").isNotNull(), "w").when(F.col("_outer").isNotNull(), "g").otherwise("b")
    t = t.select(term_col, "_term", kind.alias("_kind"), F.concat(kind, F.coalesce("_inner", "_outer", F.substring("_term", 1, GRAM))).alias("_key"))
    # what occurs, from the term table: kinds and lengths of anchors
    some = t.groupBy("_kind").agg(F.collect_set(F.least(F.length("_key"), F.lit(GRAM + 1))).alias("lengths")).collect()
    found = {r["_kind"]: sorted(x - 1 for x in r["lengths"]) for r in some}
    if not found:
        return texts.select(id_col, F.lit(None).cast("string").alias(term_col)).where(F.lit(False))
    bits, test = filter_of(t.select("_key").distinct(), "_key", n)

    low = F.lower(text_col)
    pieces = []
    if found.keys() & {"w", "g"}:
        base = texts.select(id_col, low.alias("_text"), F.array_distinct(F.split(low, BREAKS)).alias("_words"), bits.alias("_bits"))
        pieces += [F.transform("_words", lambda w: F.concat(F.lit("w"), w))] if "w" in found else []
        pieces += [_grams(F.col("_words"), found["g"], "g")] if "g" in found else []
    else:
        base = texts.select(id_col, low.alias("_text"), bits.alias("_bits"))
    if "b" in found:
        breaks = F.array_distinct(F.regexp_extract_all("_text", F.lit(f"({BREAKS})"), F.lit(1)))
        pieces.append(_grams(breaks, found["b"], "b"))
    hits = F.filter(F.array_distinct(F.concat(*pieces)), lambda k: test(F.col("_bits"), k))
    hit = base.select(id_col, F.explode(hits).alias("_key"))
    met = durable(hit.join(t, "_key").select(id_col, term_col, "_term").distinct())
    ids = met.select(F.col(id_col).cast("string").alias("_id")).distinct()
    bits, test = filter_of(ids, "_id", ids.count())
    whole = texts.select(id_col, low.alias("_text"), bits.alias("_bits")).where(test(F.col("_bits"), F.col(id_col).cast("string")))
    return whole.select(id_col, "_text").join(met, id_col).where(F.col("_text").contains(F.col("_term"))).select(id_col, term_col)
