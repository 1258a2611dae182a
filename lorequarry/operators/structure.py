"""From tagged lines to question-answer records and knowledge points.

Lines are (doc_id, line_no, text, red_text, location). Segments are cut by windows over
a document; what happens inside a segment is one projection over its array of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..functions.similarity import let, match_keys
from .ordered import first_wins, furniture, question_starts

_START = f"^{X.EXPLANATION_BODY}"
_INLINE = f"{X.WS}*{X.EXPLANATION_BODY}"
_FOOTNOTE = r"^[（(]?\d{1,3}[）)]?\z"


def split_answer_parts(value: Column, expected: Column) -> Column:
    """Parts of an answer, by the separator that gives the expected number.

    Where only white space gives too many, footnote numbers are taken out from the right,
    each joining its neighbours, until the number fits.
    """
    edges = lambda p: T.trim(T.sub(p, r"^[、,，]+|[、,，]+\z"))
    parts = lambda a, by: F.filter(F.transform(F.split(a, by), edges), lambda p: p != "")

    def merge(start, n):
        places = F.when(F.size(start) < 3, F.array().cast("array<int>")).otherwise(F.sequence(F.size(start) - 2, F.lit(1), F.lit(-1)))

        def step(acc, i):
            open_ = (F.size(acc) > n) | (F.size(acc) == F.size(start))
            note = F.coalesce(F.get(acc, i).rlike(_FOOTNOTE), F.lit(False)) & F.get(acc, i + 1).isNotNull()
            joined = F.concat(F.slice(acc, F.lit(1), i - 1), F.array(F.concat(F.get(acc, i - 1), F.get(acc, i + 1))), F.slice(acc, i + 3, F.greatest(F.size(acc), F.lit(1))))
            return F.when(open_ & note, joined).otherwise(acc)

        return F.when(F.size(start) > n, F.aggregate(places, start, step)).otherwise(start)

    def choose(a):
        loose = let(F.struct(parts(a, r"(?:[ \t]+|[；;|]+)").alias("p")), lambda x: merge(x["p"], expected))
        explicit, listed = parts(a, r"[；;|]+"), parts(a, "[、,，]+")
        return (
            F.when(a == "", F.array().cast("array<string>"))
            .when(expected <= 1, F.array(a))
            .when(F.size(explicit) == expected, explicit)
            .when(F.size(listed) == expected, listed)
            .otherwise(let(loose, lambda p: F.when(F.size(p) <= 1, F.array(a)).otherwise(p)))
        )

    return let(T.clean_answer(value), choose)


def without_red(text: Column, red: Column) -> Column:
    """The line less the first occurrence of its red text, an inline explanation and a dangling answer lead."""
    clean_text, clean_red = T.tidy(text), T.tidy(F.coalesce(red, F.lit("")))
    at = F.position(clean_red, clean_text)
    cut = F.when(at > 0, T.tidy(F.overlay(clean_text, F.lit(" "), at, F.length(clean_red)))).otherwise(clean_text)
    rest = T.sub(cut, f"(?s){_INLINE}.*\\z")
    for tail in X.ANSWER_TAILS:
        rest = T.sub(rest, tail)
    return F.when(clean_red == "", clean_text).when(clean_text == clean_red, "").otherwise(T.trim(rest))


def segments(lines: DataFrame) -> DataFrame:
    """Question segments: doc_id, segment, lines (array, in order) with no, text, red, out (furniture)."""
    tidied = lines.withColumn("text", T.tidy(F.coalesce("text", F.lit("")))).withColumn("red_text", T.tidy(F.coalesce("red_text", F.lit(""))))
    marked = question_starts(furniture(tidied))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cut = marked.withColumn("segment", F.sum(F.col("start").cast("int")).over(w)).where("segment > 0")
    rows = F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("no"), "text", F.col("red_text").alias("red"), F.col("furniture").alias("out"), "location")))
    return cut.groupBy("doc_id", "segment").agg(rows.alias("lines"))


def infer_pairs(lines: DataFrame) -> DataFrame:
    """question, answers, rawAnswer, explanation, startLine, endLine, usedRedLineIndexes, location of each segment that has them."""
    s = segments(lines).withColumn("_l", F.transform("lines", lambda x, i: F.struct(i.alias("i"), x["no"].alias("no"), x["text"].alias("text"), x["red"].alias("red"), (x["out"]).alias("out"))))
    line = F.col("_l")
    first_of = lambda test: F.get(F.filter(line, test), 0)["i"]
    s = s.withColumn("_f", first_of(lambda x: (x["red"] != "") & ~x["out"])).where("_f is not null")
    f = F.col("_f")
    shown = F.transform(F.slice(line, F.lit(1), F.greatest(f, F.lit(1))), lambda x: F.when(x["out"], "").otherwise(without_red(x["text"], x["red"])))
    question = T.standard_blanks(T.strip_number(F.array_join(F.filter(shown, lambda x: x != ""), " ")))
    s = s.withColumn("question", question).where(F.length(T.structure_key(F.col("question"))) >= 2)
    line = F.col("_l")
    s = s.withColumn("_x", first_of(lambda x: (x["i"] > f) & ~x["out"] & (x["text"].rlike(_START) | x["red"].rlike(_START))))
    s = s.withColumn("_in", F.get(F.filter(line, lambda x: (x["i"] >= f) & ~x["out"] & (x["red"].rlike(_INLINE) | x["text"].rlike(_INLINE))), 0))
    in_red = F.col("_in.red").rlike(_INLINE)
    source = F.when(in_red, F.col("_in.red")).otherwise(F.col("_in.text"))
    s = s.withColumn("_at", F.regexp_instr(source, F.lit(_INLINE))).withColumn("_rest", T.tidy(F.substr(source, F.col("_at") + F.length(F.regexp_extract(source, _INLINE, 0)))))
    last = F.coalesce(F.col("_in.i"), F.col("_x") - 1, F.size("_l") - 1)
    cut = lambda x: F.when(in_red & (x["i"] == F.col("_in.i")), F.substr(x["red"], F.lit(1), F.col("_at") - 1)).otherwise(x["red"])
    red = F.filter(line, lambda x: (x["i"] >= f) & (x["i"] <= last) & (x["red"] != "") & ~x["out"])
    s = s.withColumn("rawAnswer", T.clean_answer(F.array_join(F.transform(red, cut), " ")))
    s = s.withColumn("_n", T.blank_count(F.col("question"))).withColumn("answers", split_answer_parts(F.col("rawAnswer"), F.col("_n")))
    s = s.where((F.size("answers") > 0) & ((F.col("_n") == 0) | (F.size("answers") == F.col("_n"))))
    tail = lambda start: F.transform(F.filter(line, lambda x: (x["i"] >= start) & ~x["out"]), lambda x: F.coalesce(F.nullif(x["text"], F.lit("")), x["red"]))
    joined = lambda parts: T.tidy(F.array_join(F.filter(parts, lambda p: p != ""), " "))
    inline = joined(F.concat(F.array(F.col("_rest")), tail(F.col("_in.i") + 1)))
    explained = T.trim(T.sub(joined(tail(F.col("_x"))), _START))
    explanation = F.nullif(F.when(F.col("_in").isNotNull(), inline).when(F.col("_x").isNotNull(), explained), F.lit(""))
    used = F.transform(F.filter(line, lambda x: (x["i"] >= f) & (x["red"] != "") & ~x["out"]), lambda x: x["no"])
    return s.select(
        "doc_id",
        "question",
        "answers",
        "rawAnswer",
        explanation.alias("explanation"),
        F.col("lines")[0]["no"].alias("startLine"),
        F.element_at("lines", -1)["no"].alias("endLine"),
        used.alias("usedRedLineIndexes"),
        F.col("lines")[0]["location"].alias("location"),
    )


def points(lines: DataFrame, source: Column, method: str, fallback_location: str) -> DataFrame:
    """Knowledge points: one for each pair, and one for each useful red line that no pair used."""
    pairs = infer_pairs(lines)
    place = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(fallback_location))
    from_pairs = pairs.select(
        "doc_id", F.col("startLine").alias("line_no"), F.lit(0).alias("part"), F.array_join("answers", "；").alias("text"), F.col("question").alias("context"), "question", F.col("answers").alias("answerParts"), "explanation", place(F.col("location")).alias("location")
    )
    used = pairs.select("doc_id", F.explode("usedRedLineIndexes").alias("line_no"))
    left = furniture(lines).where("not furniture and coalesce(red_text, '') <> ''").join(used, ["doc_id", "line_no"], "left_anti")
    whole = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("whole"))
    found = left.select("doc_id", "line_no", "location", F.posexplode(T.useful_lines(F.col("red_text"))).alias("part", "text")).join(whole, "doc_id")
    from_lines = found.select(
        "doc_id", "line_no", "part", "text", T.sentence_around(F.col("whole"), F.col("text")).alias("context"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("array<string>").alias("answerParts"), F.lit(None).cast("string").alias("explanation"), place(F.col("location")).alias("location")
    )
    both = from_pairs.unionByName(from_lines).withColumn("sourceName", source).withColumn("method", F.lit(method))
    identity = T.point_identity(F.col("sourceName"), F.col("text"), F.col("question"), F.col("context"))
    return first_wins(both.withColumn("identity", identity).where(T.key(F.col("text")) != ""), "identity", ["doc_id", "line_no", "part"])


def new_points(points: DataFrame, known: DataFrame) -> DataFrame:
    """Points whose identity isn't known yet."""
    return points.join(known.select("identity").distinct(), "identity", "left_anti")


def best_lines(fragments: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, ord, line_no, fragment): each fragment's line with the highest score, the first among equals."""
    lines = lines.select("doc_id", "line_no", T.structure_key(F.col("text")).alias("_a"))
    scored = fragments.withColumn("_b", T.structure_key(F.col("fragment"))).join(lines, "doc_id").withColumn("score", match_keys(F.col("_a"), F.col("_b")))
    best = scored.groupBy("doc_id", "ord").agg(F.max(F.struct("score", (-F.col("line_no")).alias("no"), "fragment")).alias("b")).where(F.col("b.score") >= X.FRAGMENT_MIN_SCORE)
    return best.select("doc_id", "ord", (-F.col("b.no")).alias("line_no"), F.col("b.fragment").alias("fragment"))


def tag_fragments(texts: DataFrame, fragments: DataFrame) -> DataFrame:
    """Lines of full texts (doc_id, full_text) with the red fragments (doc_id, ord, fragment) that match them best.

    A fragment goes to its document's line with the highest score, the first among equals.
    """
    split = F.filter(F.transform(F.split(T.tidy(F.col("full_text")), r"\n+"), T.tidy), lambda x: x != "")
    lines = texts.select("doc_id", F.posexplode(split).alias("line_no", "text"))
    wanted = fragments.select("doc_id", "ord", T.tidy(F.col("fragment")).alias("fragment")).where("fragment <> ''")
    best = best_lines(wanted, lines)
    per_line = best.groupBy("doc_id", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("fragment").alias("t")))), lambda x: x["t"]), " ").alias("joined"))
    a, b = T.structure_key(F.col("text")), T.structure_key(F.col("joined"))
    whole = (a == b) | (~T.is_numbered(F.col("text")) & (F.length(b) >= F.greatest(F.lit(2), F.floor(F.length(a) * X.FRAGMENT_WHOLE_LINE_SHARE + 0.5))))
    return lines.join(per_line, ["doc_id", "line_no"], "left").select("doc_id", "line_no", "text", F.when(F.col("joined").isNotNull(), F.when(whole, T.clean_answer(F.col("text"))).otherwise(F.col("joined"))).alias("red_text"))
