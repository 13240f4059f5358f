"""Benchmark decontamination with a positional inverted index. DataFrame functions only.

The test side is cut into windows of consecutive words. One pass over the texts counts the windows' terms, which
ranks the terms of each window from the rarest on. A second pass stores the postings ``term, doc_id, version, place`` of each
window's ``LISTS`` rarest terms (and a row a text with the number of its words). Lists are intersected from the rarest on:
the places of the rarest term, less its offset in the window, are where the window may start; these meet the list of the
next term at start plus offset, and so on. Windows that are left are compared word by word with the parts of the texts where they
may start, so lists of frequent terms are never stored. Proximity matches start from the lists of an item's rarest terms too: a span with enough of its terms has one of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, attach, written

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most bytes (as text) of a side that is broadcast.
BROADCAST_BYTES = 32 << 20
#: Lists that are stored and intersected for a window.
LISTS = 2
#: Lists of an item that meet in a block of words before its words are counted there.
NEAR_LISTS = 3
#: Words of a part of a text that windows are compared with.
PART = 64
#: Codes by which a set that is too large to broadcast is told before anything is shuffled.
CODES = 1 << 20
#: Postings of one term that meet the windows in one task, where these are too many to broadcast.
SPLIT = 100_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TEXT = ["doc_id", "version"]


def word_array(text: Column) -> Column:
    """Words of digits, letters a-z (A-Z lower-cased) and all characters beyond ASCII. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL), BETWEEN), "")


def _few(df: DataFrame) -> bool:
    """Whether ``df`` is within the bounds of rows and bytes of a broadcast."""
    size = F.length(F.to_json(F.struct(*df.columns))).cast("long")
    rows, held = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it is within the bounds, else left to a shuffled join."""
    return F.broadcast(df) if _few(df) else df


def _possible(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key may be in ``asked``, by a broadcast of ``CODES`` codes at most."""
    code = F.pmod(F.xxhash64(key), F.lit(CODES)).alias("code")
    return rows.select("*", code).join(F.broadcast(asked.select(code).distinct()), "code", "left_semi").drop("code")


def test_windows(items: DataFrame, window: int) -> DataFrame:
    """``words, items``: the distinct windows of ``items(item_id, text)``; an item of fewer words is one window."""
    w = items.select("item_id", word_array(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("s")
    w = w.select("item_id", "w", starts).select("item_id", F.slice("w", F.col("s"), F.lit(window)).alias("words"))
    return w.groupBy("words").agg(F.collect_set("item_id").alias("items"))


def text_words(docs: DataFrame) -> DataFrame:
    """``doc_id, version, place, term``: the words of ``docs(doc_id, text)``, places from 0.

    A row of the empty term ends a text: its place is the number of words. ``version`` tells texts of one id apart.
    """
    # outer: no filter on the array is inferred, which would cut the text twice
    words = F.posexplode_outer(F.concat(word_array(F.col("text")), F.array(F.lit("")))).alias("place", "term")
    return docs.select("doc_id", F.xxhash64("text").alias("version"), words)


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n``: occurrences in ``docs(text)`` of the given distinct ``terms(term)``; words are counted in their task before they move."""
    words = docs.select(F.explode_outer(word_array(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(_small(terms), "term", "left_semi")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: ``term, doc_id, version, place, n`` for each occurrence of ``terms(term, n)``, and each text's row of the empty term.

    Where the terms are too many to broadcast, codes let only possible ones through, and frequent ones (``n``) don't gather in a task.
    """
    end = docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(1 << 62).alias("n"))
    terms = written(terms.select("term", "n").unionByName(end), "terms")
    words = text_words(docs)
    if _few(terms):
        return words.join(F.broadcast(terms), "term")
    words = written(_possible(words, terms, "term"), "possible")
    return attach(words, terms, "term", "n", words.count())


def _meet(lists: DataFrame, asking: DataFrame) -> DataFrame:
    """Postings joined with ``asking(term, n, ..)`` by term; a long list is split where the asking side isn't broadcast."""
    if _few(asking):
        return lists.join(F.broadcast(asking.drop("n")), "term")
    split = (F.col("n") / SPLIT).cast("long") + 1
    asking = asking.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), split - 1))).drop("n")
    return lists.withColumn("salt", F.pmod(F.xxhash64(*TEXT, "place"), split)).join(asking, ["term", "salt"])


def _ranked(terms: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``key, lists``: of each key's ``terms(key, term, off)`` those that occur at all, from the rarest on."""
    return terms.join(_small(counts), "term").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "term", "off"))).alias("lists"))


def _stored(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """The index of all terms in ``lists(lists)``."""
    terms = lists.select(F.explode("lists").alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.max("x.n").alias("n"))
    return written(postings(docs, terms), "postings")


def _in_play(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` that ``found(doc_id)`` names."""
    ids = written(found.select("doc_id").distinct(), "in_play")
    if _few(ids):
        return docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return _possible(docs, ids, "doc_id").join(ids, "doc_id", "left_semi")


def _matches(docs: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, lo, hi, items`` of every occurrence of a window, ``doc_id, n_words`` of every text)."""
    windows = written(test_windows(items, window).withColumn("wid", F.monotonically_increasing_id()), "windows")
    placed = windows.select("wid", F.posexplode("words").alias("off", "term"))
    counts = written(term_counts(docs, placed.select("term").distinct()), "counts")
    # a window with a term that no text has cannot occur
    ranked = _ranked(placed, counts, "wid").join(windows.select("wid", F.size("words").alias("size")), "wid").filter(F.size("lists") == F.col("size"))
    keyed = written(ranked.select("wid", F.slice("lists", 1, LISTS).alias("lists")), "keyed")
    index = _stored(docs, keyed)
    lists = index.filter("term <> '' AND doc_id IS NOT NULL")
    first = F.element_at("lists", 1)
    asking = keyed.select("wid", first["term"].alias("term"), first["n"].alias("n"), first["off"].alias("off"), F.slice("lists", 2, LISTS).alias("next"))
    starts = _meet(lists, asking).select(*TEXT, "wid", (F.col("place") - F.col("off")).alias("lo"), "next").filter("lo >= 0")
    for i in range(1, LISTS):
        # windows of one word have no other list
        x = F.get("next", F.lit(i - 1))
        starts = starts.withColumn("at", F.col("lo") + x["off"]).withColumn("term", x["term"])
        after = starts.filter("term IS NOT NULL").join(lists.select(*TEXT, F.col("place").alias("at"), "term"), [*TEXT, "at", "term"], "left_semi")
        starts = after.unionByName(starts.filter("term IS NULL")).drop("at", "term")
    starts = written(starts.select(*TEXT, "wid", "lo"), "starts")
    words = _in_play(docs.filter("doc_id IS NOT NULL"), starts).select("doc_id", F.xxhash64("text").alias("version"), word_array(F.col("text")).alias("w"))
    part = lambda b: F.struct((b / PART).cast("long").alias("part"), F.slice("w", b + 1, F.lit(PART + window)).alias("s"))
    parts = words.select(*TEXT, F.explode_outer(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(PART)), part)).alias("p")).select(*TEXT, "p.*")
    near = starts.withColumn("part", (F.col("lo") / PART).cast("long")).join(parts, [*TEXT, "part"]).withColumn("s", F.slice("s", (F.col("lo") % PART + 1).cast("int"), F.lit(window)))
    if _few(windows):
        near = near.join(F.broadcast(windows), "wid")
    else:
        sizes = written(windows.join(starts.groupBy("wid").agg(F.count(F.lit(1)).alias("m")), "wid"), "sizes")
        near = attach(near, sizes, "wid", "m", starts.count())
    n = F.size("words")
    met = near.filter(F.slice("s", F.lit(1), n) == F.col("words"))
    return met.select("doc_id", "lo", (F.col("lo") + n).alias("hi"), "items"), index.filter("term = ''").select("doc_id", F.col("place").cast("long").alias("n_words"))


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """``doc_id, lo, hi, items``: every occurrence of a window of ``items(item_id, text)`` in ``docs(doc_id, text)``, as a span of words.

    Rows that repeat id and text give equal rows.
    """
    return _matches(docs, items, window)[0]


def proximity_matches(docs: DataFrame, items: DataFrame, within: int = 40, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, n_terms, n_needed, place``: texts with a span of ``within`` words that has most of an item's terms, in any order.

    ``n_terms`` is the most distinct terms of the item in such a span, ``place`` the first word (from 0) of the first span that has as many and begins with one,
    ``n_needed`` is ``percent`` of the item's distinct terms, rounded up; rows have as many at least. Of an item's m terms in order of rarity
    a span with k of them has j of the first m - k + j, whose lists are intersected by blocks of words (j is ``NEAR_LISTS``, or k if that is less); then the
    lists of all its terms are counted in the blocks of words around, which have ``2 * within`` words each. Items without words match nothing, null ids and null texts neither; rows that repeat an id give the best of them.
    """
    docs, items = docs.select("doc_id", "text").filter("doc_id IS NOT NULL"), items.select("item_id", "text").filter("item_id IS NOT NULL")
    own = items.select("item_id", F.explode(word_array(F.col("text"))).alias("term")).distinct().withColumn("off", F.lit(0))
    own = written(own, "own")
    counts = written(term_counts(docs, own.select("term").distinct()), "counts")
    m = own.groupBy("item_id").agg(F.ceil(F.count(F.lit(1)) * percent / 100).alias("n_needed"))
    # terms that no text has are the rarest; the lists start with those that some text has
    ranked = written(_ranked(own, counts, "item_id").join(m, "item_id").filter(F.size("lists") >= F.col("n_needed")), "ranked")
    least = F.col("n_needed").cast("int")
    enough = F.least(least, F.lit(NEAR_LISTS)).alias("enough")
    keyed = written(ranked.select("item_id", enough, F.slice("lists", F.lit(1), F.size("lists") - least + enough).alias("lists")), "keyed")
    lists = _stored(docs, keyed).filter("term <> ''")
    asking = keyed.select("item_id", "enough", F.explode("lists").alias("x")).select("item_id", "enough", "x.term", "x.n")
    # a span that starts in a block of words ends in the next one at the latest; one with a listed word at a place starts in its block or the one before
    block = (F.col("place") / within).cast("long")
    both = F.explode(F.array(block - 1, block)).alias("block")
    met = _meet(lists, asking).select(*TEXT, "item_id", both, "term", "enough").groupBy(*TEXT, "item_id", "block").agg(F.size(F.collect_set("term")).alias("k"), F.max("enough").alias("enough"))
    around = written(met.filter(F.col("k") >= F.col("enough")).select(*TEXT, "item_id", "block"), "around")
    words = text_words(_in_play(docs, around)).filter("term <> ''").join(_small(counts.select("term")), "term", "left_semi")
    held = words.select(*TEXT, "place", "term", both).groupBy(*TEXT, "block").agg(F.collect_set(F.struct("place", "term")).alias("held"))
    there = around.join(held, [*TEXT, "block"])
    terms = written(ranked.select("item_id", "n_needed", F.transform("lists", lambda x: x["term"]).alias("terms")), "item_terms")
    if _few(terms):
        there = there.join(F.broadcast(terms), "item_id")
    else:
        sizes = written(terms.join(around.groupBy("item_id").agg(F.count(F.lit(1)).alias("m")), "item_id"), "sizes")
        there = attach(there, sizes, "item_id", "m", around.count())
    there = there.filter(F.size(F.array_intersect("terms", F.transform("held", lambda x: x["term"]))) >= F.col("n_needed"))
    there = there.select(*TEXT, "item_id", "n_needed", F.explode(F.filter("held", lambda x: F.array_contains("terms", x["term"]))).alias("x")).select(*TEXT, "item_id", "n_needed", "x.*").distinct()
    span = Window.partitionBy(*TEXT, "item_id").orderBy("place").rangeBetween(0, within - 1)
    counted = there.withColumn("n_terms", F.size(F.collect_set("term").over(span))).filter(F.col("n_terms") >= F.col("n_needed"))
    best = counted.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_terms", (-F.col("place")).alias("place"), "n_needed")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_terms").cast("long").alias("n_terms"), F.col("b.n_needed").cast("long").alias("n_needed"), (-F.col("b.place")).cast("long").alias("place"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit inside any occurrence of a window. ``items_sha256`` digests the ids of the items with occurring
    windows, sorted as strings and joined by commas. A text is contaminated when some word is hit and
    ``share * n_hit >= n_words``. Null texts have no words. Rows of a null id are not searched (no hits); rows
    that repeat an id share hits. Items without words or with a null id match nothing. Further columns aren't read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).filter("item_id IS NOT NULL")
    met, sizes = _matches(docs, items, window)
    hits = met.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    add = lambda acc, x: F.struct((acc["n"] + F.greatest(x["hi"] - F.greatest(x["lo"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], x["hi"]).alias("to"))
    hits = hits.select(
        "doc_id",
        F.aggregate("spans", start, add, lambda acc: acc["n"]).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",").alias("ids"),
    )
    out = sizes.join(hits, "doc_id", "left")
    out = out.select("doc_id", "n_words", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items: spans of 40 words with four fifths of an item's terms."""
    return proximity_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, len(w[s : s + 12]) AS n, array_to_string(w[s : s + 12], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
