"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item window is ten consecutive words of a benchmark item (a shorter item is one
window). Its shingles are its word pairs. A window can only occur where its rarest
pair occurs, so the pairs are ordered by how often they occur in all documents and
one prefix token, the rarest pair, is joined with the documents' pairs. Position and
length bounds drop what would begin before the text or end after it, and the words of
the rest are compared one by one.

Words are lower-cased (A-Z) runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. Defined results:
null and empty texts have no words and hit nothing, as documents and as items; a null
item_id is named by the empty string; repeated rows each get the result; an empty
benchmark hits nothing; doc_id and item_id may have any type; ``hits`` replaces columns
of ``keep`` that are named as its own, and ``clean_documents`` keeps all columns.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Tables made from the benchmark, or of candidates, are broadcast up to so many bytes, which
#: are counted; larger ones are shuffled.
MAX_BROADCAST_BYTES = 8 << 20
#: Bytes of a row of numbers in memory, and of a row's place in a broadcast table.
ROW_BYTES = 64
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, _SEPARATORS), "")


def _pairs(w: Column) -> Column:
    """Hashes of the word pairs at each position; the last position has its word alone."""
    return F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, win): the windows (words) of every item, each once for an item."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("s")
    return w.select("item", "w", starts).select("item", F.expr(f"slice(w, s, {window})").alias("win")).distinct()


def _small(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= MAX_BROADCAST_BYTES else df


def _document_pairs(w: DataFrame, singles: bool) -> DataFrame:
    """(_key, w, pos, token) of all word pairs, and of all single words where items have one word only."""
    pairs = w.select("_key", "w", F.posexplode(_pairs(F.col("w"))).alias("pos", "token"))
    if singles:
        one = w.select("_key", "w", F.posexplode(F.transform("w", lambda x: F.xxhash64(x))).alias("pos", "token"))
        pairs = pairs.unionByName(one.where(F.col("pos") < F.size("w") - 1))  # the last word is among the pairs
    return pairs


def occurrences(docs: DataFrame, windows: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(_key, start, wid, len): every place where a window's words stand.

    ``docs`` has ``_key`` and ``text``, ``windows`` has wid and win. While the prefixes
    are small enough to be broadcast, they meet the texts where these are read, and only
    hits are moved; otherwise pairs are shuffled, and texts once to the places found.
    """
    sized = windows.withColumn("len", F.size("win"))
    letters = F.aggregate("win", F.lit(0), lambda n, x: n + F.octet_length(x) + 16)
    counts = sized.agg(F.count("*").alias("n"), F.coalesce(F.min("len"), F.lit(0)).alias("shortest"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(letters), F.lit(0)).alias("bytes")).first()
    token = F.when(F.col("len") == 1, _pairs(F.col("win"))).otherwise(F.slice(_pairs(F.col("win")), 1, F.col("len") - 1))
    tokens = sized.select("wid", "len", F.posexplode(token).alias("offset", "token"))
    pairs = _document_pairs(docs.select("_key", words(F.col("text")).alias("w")), counts["shortest"] == 1)
    vocabulary = _small(tokens.select("token").distinct(), counts["tokens"] * ROW_BYTES)
    rarity = pairs.select("token").join(vocabulary, "token").groupBy("token").agg(F.count("*").alias("df"))
    # a window with a token that isn't in rarity occurs nowhere
    ranked = tokens.join(rarity, "token", "left").groupBy("wid", "len").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "offset")).alias("first"))
    prefix = ranked.where("first.df > 0").select("wid", "len", "first.token", "first.offset")
    prefix = scratch.write(prefix.join(windows, "wid"), "prefix")
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("len") <= F.size("w"))
    stands = F.slice("w", start + 1, F.col("len")) == F.col("win")
    if counts["bytes"] + counts["n"] * ROW_BYTES <= MAX_BROADCAST_BYTES:
        found = pairs.join(F.broadcast(prefix), "token").where(fits & stands)
        return found.select("_key", start.alias("start"), "wid", "len")
    found = pairs.select("_key", "pos", "token", F.size("w").alias("n")).join(prefix.drop("win"), "token")
    found = found.where((start >= 0) & (start + F.col("len") <= F.col("n"))).select("_key", start.alias("start"), "len").distinct()
    places = found.groupBy("_key").agg(F.collect_list(F.struct("start", "len")).alias("places"))  # each place of a text once a length
    there = scratch.write(docs.join(places, "_key").select("_key", words(F.col("text")).alias("w"), "places"), "there")
    cut = there.select("_key", "w", F.explode("places").alias("p")).select("_key", "p.start", "p.len", F.slice("w", F.col("p.start") + 1, F.col("p.len")).alias("win"))
    return cut.join(windows, "win").select("_key", "start", "wid", "len").distinct()


def _judged(docs: DataFrame, benchmark: DataFrame, keep, replaced) -> tuple[DataFrame, list[str]]:
    scratch = common.Scratch(docs.sparkSession)
    kept, names = common.packed(docs, keep, replaced)
    keyed = docs.select(kept, "text", common.document_key().alias("_key"))
    items = scratch.write(item_windows(benchmark), "items")
    windows = scratch.write(items.select("win").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    found = scratch.write(occurrences(keyed.select("_key", "text"), windows, scratch), "occurrences")
    places = found.select("_key", "start", "len").distinct().groupBy("_key").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)))).alias("hit"))
    named = found.select("_key", "wid").distinct().join(windows, "wid").join(items, "win").select("_key", "item").distinct()
    named = named.groupBy("_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hit = common.materialize(places.join(named, "_key"), "hits")
    size = hit.agg(F.coalesce(F.sum(4 * F.size("hit") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 16) + ROW_BYTES), F.lit(0))).first()[0]
    scratch.release()
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    # words are counted before the join, which then need not move the texts
    counted = keyed.select(common.KEEP, "_key", F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    return counted.join(_small(hit, size), "_key", "left").select(common.KEEP, "n_words", none("hit", "int"), none("items", "string")), names


def hits(docs: DataFrame, benchmark: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` with n_words, hit (array of word positions) and items (names found, sorted)."""
    added = ("n_words", "hit", "items")
    judged, names = _judged(docs, benchmark, keep, added)
    return common.unpacked(judged, names, *added)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no window occurs in, with their own columns."""
    judged, names = _judged(docs, benchmark, docs.columns, ())
    return common.unpacked(judged.where(F.size("hit") == 0), names)


ORACLE_SQL = rf"""
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, w[s:s + {WINDOW - 1}] AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS s FROM item WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), place AS (
  SELECT r, s, n, w[s:s + n - 1] AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
        FROM doc, (SELECT DISTINCT len(win) AS n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT p.r, p.s, p.n, win.item FROM place p JOIN win ON p.win = win.win
), word AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS k FROM hit) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN named USING (r)
"""
