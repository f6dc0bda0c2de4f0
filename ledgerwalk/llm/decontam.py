"""Benchmark decontamination by a positional inverted index.  [native]

Items are cut into windows of ``n`` consecutive words (a shorter item is one
window).  The corpus frequency of every benchmark word is counted; each window
is looked for by its two rarest words.  The index holds the postings (word,
document, position) of those words over all documents, each with the words
around it.  A window can only start where the posting list of its rarest word
and that of its second rarest, both moved back by the words' offsets in the
window, agree; the words around the posting then show whether the whole
phrase is there.  Proximity matches let the two lists differ by a few
positions.

Words of hot documents and sources are spread by the scan, not grouped; the
benchmark side is broadcast only if it is counted to be small, else joined by
shuffle.  Postings meet their windows on the word, intersections on document,
window and start.

Null texts have no words and empty items no windows.  Repeated rows get one
result each.  An item with a null id counts under the id "null"; repeated ids
are one item.  With no documents the result is empty; with no items nothing is
hit.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, lower_ascii, small_side, stored

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["doc_id", "h"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def document_words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("words"))


def item_windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item_id, wid, phrase, terms) of every window; ``wid`` identifies the phrase."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(F.col("text")).alias("w"))
    w = w.filter(F.size("w") > 0).withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))))
    w = w.withColumn("terms", F.slice("w", F.col("i"), F.lit(n)))
    phrase = F.array_join("terms", " ")
    return w.select("item_id", F.xxhash64(phrase).alias("wid"), phrase.alias("phrase"), "terms").distinct()


def rarest_terms(windows: DataFrame, doc_words: DataFrame) -> DataFrame:
    """(wid, phrase, len, t1, o1, t2, o2): each distinct window that the corpus could
    hold, with its rarest and second rarest word and their offsets."""
    terms = windows.select("wid", "phrase", "terms").distinct().select("wid", "phrase", F.size("terms").alias("len"), F.posexplode("terms").alias("o", "term"))
    vocabulary = small_side(stored(terms.select("term").distinct(), "vocabulary"))
    counts = (doc_words.select(F.explode("words").alias("term")).join(vocabulary, "term", "left_semi")
              .groupBy("term").agg(F.count(F.lit(1)).alias("cf")))
    ranked = F.array_sort(F.collect_list(F.struct("cf", "o", "term")))  # at most n entries
    best = terms.join(counts, "term").groupBy("wid", "phrase", "len").agg(ranked.alias("r"))
    best = best.filter(F.size("r") == F.col("len"))  # a word that the corpus lacks rules the window out
    first, second = F.col("r")[0], F.try_element_at("r", F.lit(2))
    return best.select("wid", "phrase", "len", first["term"].alias("t1"), first["o"].alias("o1"),
                       second["term"].alias("t2"), second["o"].alias("o2"))


def postings(doc_words: DataFrame, terms: DataFrame, n: int = WINDOW) -> DataFrame:
    """(term, doc_id, h, pos, around, first): the index over ``terms``; ``around`` are
    the words from ``n - 1`` before to ``n - 1`` after, beginning at position ``first``."""
    occurrences = doc_words.select(*KEY, "words", F.posexplode("words").alias("pos", "term"))
    first = F.greatest(F.col("pos") - (n - 1), F.lit(0))
    return occurrences.join(small_side(terms), "term", "left_semi").select(
        "term", *KEY, "pos", F.slice("words", first + 1, F.lit(2 * n - 1)).alias("around"), first.alias("first"))


def starts(index: DataFrame, windows: DataFrame, which: int) -> DataFrame:
    """Posting lists of the windows' first or second rarest words, moved back by the
    words' offsets: (doc_id, h, wid, start, ...)."""
    at = F.col("pos") - F.col(f"o{which}")
    lists = index.join(small_side(windows), F.col("term") == F.col(f"t{which}")).withColumn("start", at)
    return lists.filter("start >= 0")


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, h, wid, start, end) of every exact occurrence of a window."""
    one = starts(index, windows, 1).select(*KEY, "wid", "start", "len", "phrase", "around", "first", "t2")
    two = starts(index, windows.filter("t2 is not null"), 2).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("wid").alias("_w"), F.col("start").alias("_s"))
    both = one.filter("t2 is not null").join(two, F.expr("doc_id <=> _id and h = _h and wid = _w and start = _s"), "left_semi")
    both = both.unionByName(one.filter("t2 is null"))
    exact = F.array_join(F.slice("around", F.greatest(F.col("start") - F.col("first"), F.lit(0)) + 1, F.col("len")), " ") == F.col("phrase")
    return both.filter(exact).select(*KEY, "wid", "start", (F.col("start") + F.col("len")).alias("end")).distinct()


def proximity_matches(index: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """(doc_id, h, wid, start, other): the two rarest words of a window stand within
    ``slop`` positions of where the phrase would have them relative to each other.
    Starts are binned, so a pair is looked for in three bins instead of everywhere."""
    width = slop + 1
    one = starts(index, windows, 1).select(*KEY, "wid", "start", F.floor(F.col("start") / width).alias("bin"))
    two = index.join(small_side(windows.filter("t2 is not null")), F.col("term") == F.col("t2"))
    two = two.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("wid").alias("_w"), (F.col("pos") - F.col("o2")).alias("other"))
    two = two.withColumn("_b", F.explode(F.array(*[F.floor(F.col("other") / width) + d for d in (-1, 0, 1)])))
    near = one.join(two, F.expr("doc_id <=> _id and h = _h and wid = _w and bin = _b"))
    return near.filter(F.abs(F.col("start") - F.col("other")) <= slop).select(*KEY, "wid", "start", "other").distinct()


def build_index(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows of items, distinct windows with their rarest words, stored postings)."""
    doc_words = document_words(docs)
    of_items = stored(item_windows(items, n), "windows")
    windows = stored(rarest_terms(of_items, doc_words), "rarest")
    terms = windows.select(F.explode(F.array("t1", "t2")).alias("term")).filter("term is not null").distinct()
    return of_items, windows, stored(postings(doc_words, stored(terms, "terms"), n), "postings")


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, h (hash of its text), n_words, n_hit, n_items,
    items_sha256, contaminated."""
    of_items, windows, index = build_index(docs, items, n)
    hits = stored(phrase_matches(index, windows), "hits")
    # words covered by at least one occurrence: what each adds to those before it
    before = Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select(*KEY, "start", "end").distinct().withColumn("seen", F.max("end").over(before))
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce("seen", F.lit(0))), F.lit(0))
    covered = spans.groupBy(*KEY).agg(F.sum(fresh).alias("n_hit"))
    pairs = hits.select(*KEY, "wid").distinct().join(of_items.select("wid", "item_id").distinct(), "wid").select(*KEY, "item_id").distinct()
    found = pairs.groupBy(*KEY).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    both = covered.alias("c").join(found.alias("f"), F.expr("c.doc_id <=> f.doc_id and c.h = f.h")).select(
        F.col("c.doc_id").alias("_id"), F.col("c.h").alias("_h"), "n_hit", "items")
    every = docs.select("doc_id", F.xxhash64("text").alias("h"), F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    out = every.join(both, F.expr("doc_id <=> _id and h = _h"), "left")
    items_text = F.coalesce(F.concat_ws(",", "items"), F.lit(""))
    return out.select("doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                      F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
                      F.sha2(items_text, 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item."""
    _, windows, index = build_index(docs, items, n)
    hit = stored(phrase_matches(index, windows).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct(), "contaminated")
    rows = carried(docs).withColumn("_hash", F.xxhash64("_row.text")).join(small_side(hit), F.expr("_row.doc_id <=> _id and _hash = _h"), "left_anti")
    return rows.select("_row.*")
