"""Order-dependent operators: first and latest rows of a key, turn pairing, segments.

Every table brings an explicit ordinal, since Spark's rows have none. Windows are
partitioned by a key of the data; none runs over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def first_wins(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key in the given order.

    With a plain order column and no ties this is ``min_by``, which combines on the map
    side, so a hot key costs one row a task in the shuffle.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    names = df.columns
    least = F.min_by(F.struct(*names), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(least).select("_row.*")


def latest(df: DataFrame, keys, time: str, tie: str) -> DataFrame:
    """The row of each key with the largest time; the earliest by ``tie`` among equals."""
    return first_wins(df, keys, [F.col(time) * -1, F.col(tie)])


def keep_latest_merge(current: DataFrame, incoming: DataFrame, keys, time: str, tie: str) -> DataFrame:
    """Union in which a strictly newer row replaces; ties keep the row that came first."""
    both = current.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    return first_wins(both, keys, [F.col(time) * -1, F.col("_side"), F.col(tie)]).drop("_side")


def item_identity(source: Column, stem: Column, answer: Column, nfkc: bool = True) -> Column:
    fold = T.nfkc if nfkc else (lambda c: c)
    return F.concat_ws("|", source, T.answer(fold(stem)), T.choice_identity(fold(answer)))


def merge_learning_items(current: DataFrame, incoming: DataFrame, nfkc: bool = True) -> DataFrame:
    """Learning items by identity, newest kept; ``ord`` gives the order within a side."""
    keyed = lambda d: d.withColumn("_key", item_identity(F.col("source"), F.col("stem"), F.col("answer"), nfkc))
    return keep_latest_merge(keyed(current), keyed(incoming), "_key", "occurredAt", "ord").drop("_key")


def pair_turns(messages: DataFrame, conversation: str = "conv_id", order: str = "turn", extra: tuple[str, ...] = (), strip: bool = False) -> DataFrame:
    """Each user message with the assistant messages after it, joined by an empty line.

    Messages before the first user message, and user messages without a response, are
    dropped. With ``strip`` injected context is taken out of the prompts.
    """
    talk = messages.where(F.lower("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != "")).withColumn("_user", F.lower("role") == "user")
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    grouped = talk.withColumn("pair", F.sum(F.col("_user").cast("int")).over(w)).where("pair > 0")
    said = F.collect_list(F.when(~F.col("_user"), F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    prompt = F.max_by(F.when(F.col("_user"), F.col("text")), F.when(F.col("_user"), F.col(order)))
    out = grouped.groupBy(conversation, "pair").agg(
        prompt.alias("prompt"),
        F.array_join(F.transform(F.array_sort(said), lambda s: s["t"]), "\n\n").alias("response"),
        F.size(said).cast("bigint").alias("n_responses"),
        *[F.min_by(F.col(c), F.when(F.col("_user"), F.col(order))).alias(c) for c in extra],
    )
    if strip:
        out = out.withColumn("prompt", T.strip_context(F.col("prompt")))
    return out.where("n_responses > 0 and prompt <> '' and response <> ''")


def number_paragraphs(lines: DataFrame, document: str, order: str, counted: Column) -> DataFrame:
    """A running number for the rows that count, as automatic numbering gives."""
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("number", F.when(counted, F.sum(counted.cast("int")).over(w)))


def question_starts(lines: DataFrame, document: str = "doc_id", order: str = "line_no", numbered: Column | None = None, blanks: Column | None = None, red: Column | None = None) -> DataFrame:
    """``start``: a numbered line, or a line with blanks that is the first candidate in its
    document or has red text between the candidate before it and itself.
    """
    numbered = T.is_numbered(F.col("text")) if numbered is None else numbered
    blanks = (T.blank_count(F.col("text")) > 0) if blanks is None else blanks
    red = (F.coalesce("red_text", F.lit("")) != "") if red is None else red
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    candidate, marked = F.max(F.when(numbered | blanks, F.col(order))).over(w), F.max(F.when(red, F.col(order))).over(w)
    return lines.withColumn("start", F.coalesce(numbered | (blanks & (candidate.isNull() | (marked >= candidate))), F.lit(False)))


def furniture(lines: DataFrame, document: str = "doc_id", order: str = "line_no") -> DataFrame:
    """``furniture``: empty lines, page numbers and headings, and lines that open two or more locations.

    A repeated line counts among the first two of its run of one location, if its key has
    three characters or more. The number of locations of a key comes from an aggregate
    that is joined back, so no key's lines are gathered in one place.
    """
    from ..functions import fixed as X

    text = T.tidy(F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("red_text"), F.lit("")))
    w = Window.partitionBy(document).orderBy(order)
    place = F.coalesce("location", F.lit("\x00"))
    marked = lines.withColumn("_shown", text).withColumn("_key", T.structure_key(F.col("text"))).withColumn("_new", F.coalesce((place != F.lag(place).over(w)), F.lit(True)))
    marked = marked.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("_place", F.row_number().over(Window.partitionBy(document, "_run").orderBy(order)))
    spread = marked.where("location is not null and location <> ''").select(document, "_key", "location").distinct().groupBy(document, "_key").agg(F.count("*").alias("_places"))
    spread = spread.select(F.col(document).alias("_doc"), F.col("_key").alias("_match"), "_places")
    marked = marked.join(spread, (F.col(document) == F.col("_doc")) & (T.structure_key(F.col("_shown")) == F.col("_match")), "left")
    repeated = (F.coalesce("location", F.lit("")) != "") & (F.col("_place") <= 2) & (F.length(T.structure_key(F.col("_shown"))) >= 3) & (F.coalesce("_places", F.lit(0)) >= 2)
    found = (F.col("_shown") == "") | F.col("_shown").rlike(X.PAGE_FURNITURE) | repeated
    return marked.withColumn("furniture", found).drop("_shown", "_key", "_new", "_run", "_place", "_doc", "_match", "_places")
