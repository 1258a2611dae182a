"""Distractors, question banks and exams.

Candidates are ranked for each distinct answer of a subject and category, not for each
question. They are found by way of cells, answers of one subject, shape and length, so
that rows grow with the answers and not with pairs of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from .ordered import first_wins

CHOICES = 4


def distractors_by_length(answers: DataFrame, answer: str = "answer", order: str = "ord", k: int = CHOICES - 1) -> DataFrame:
    """For each distinct answer the k others nearest in length, earlier ones first: answer, distractors.

    The nearest in length are found by bucket: answers are grouped by length, each
    length keeps its first k + 1 answers, and lengths are visited outwards. So the join
    is between lengths, not between answers.
    """
    distinct = answers.where(T.answer(F.col(answer)) != "").groupBy(T.answer(F.col(answer)).alias("_key")).agg(F.min_by(answer, order).alias("answer"), F.min(order).alias("ord"))
    distinct = distinct.withColumn("n", F.length("answer"))
    w = Window.partitionBy("n").orderBy("ord")
    firsts = distinct.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).groupBy("n").agg(F.array_sort(F.collect_list(F.struct("ord", "answer", "_key"))).alias("firsts"))
    pool = distinct.join(_length_neighbours(firsts, k), "n")
    others = F.filter("pool", lambda c: c["_key"] != F.col("_key"))
    ranked = F.array_sort(F.transform(others, lambda c: F.struct(F.abs(F.length(c["answer"]) - F.col("n")).alias("d"), c["ord"].alias("o"), c["answer"].alias("answer"))))
    return pool.select("answer", F.transform(F.slice(ranked, 1, k), lambda c: c["answer"]).alias("distractors"))


def _length_neighbours(firsts: DataFrame, k: int) -> DataFrame:
    """For each length the first answers of enough near lengths to choose k from: n, pool.

    Nearest lengths within k + 1 steps of the sorted list on either side always suffice,
    as each holds an answer. The table has a row for each length that occurs.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("n")
    near = [F.lag("firsts", j).over(w) for j in range(1, k + 2)] + [F.lead("firsts", j).over(w) for j in range(1, k + 2)]
    empty = F.array().cast("array<struct<ord:bigint,answer:string,_key:string>>")
    casted = firsts.withColumn("firsts", F.col("firsts").cast("array<struct<ord:bigint,answer:string,_key:string>>"))
    return casted.select("n", F.flatten(F.array(F.col("firsts"), *[F.coalesce(x, empty) for x in near])).alias("pool"))


def answer_pool(answers: DataFrame) -> DataFrame:
    """Distinct answers of a subject and category with their first place: subject, category, answer, ord."""
    return first_wins(answers.where("answer <> ''").select("subject", "category", "answer", "ord"), ["subject", "category", "answer"], "ord")


def ranked_distractors(pool: DataFrame, targets: DataFrame, keep: int | Column = CHOICES - 1) -> DataFrame:
    """For each target (subject, category, answer) up to ``keep`` candidates in order of preference.

    Candidates come from the subject; equal shape goes first, then near length, then the
    own category before others, then pool order.

    Answers of one subject, shape and length are a cell. All answers in a cell are equally
    near, so a cell's first ones, of all and of each category, stand for it. Cells are
    ranked from cell to cell, which are no more than shapes times lengths, and targets
    meet the candidates of their own cell: no join multiplies answers.
    """
    keep = F.lit(keep) if isinstance(keep, int) else keep
    shaped = lambda rows: rows.withColumn("shape", T.answer_shape(F.col("answer"))).withColumn("len", F.length("answer"))
    cell, own = ["subject", "shape", "len"], ["subject", "category", "shape", "len"]
    t = shaped(targets.select("subject", "category", "answer", keep.alias("keep")).groupBy("subject", "category", "answer").agg(F.max("keep").alias("keep")))
    # one more than any target of the subject wants, as the answer itself may be among them
    wanted = t.groupBy("subject").agg((F.max("keep") + 1).alias("most"))
    c = shaped(pool.select("subject", "category", "answer", "ord")).join(wanted, "subject")

    def firsts(rows, keys, name):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
        few = rows.withColumn("_n", place).where(F.col("_n") <= F.col("most"))
        return few.groupBy(*keys).agg(F.collect_list(F.struct("ord", "answer")).alias(name), F.max("most").alias("most"))

    anywhere = firsts(c.groupBy(*cell, "answer").agg(F.min("ord").alias("ord"), F.max("most").alias("most")), cell, "all")
    inside = firsts(c, own, "own").select(*own, "own")
    theirs = anywhere.select("subject", F.col("shape").alias("c_shape"), F.col("len").alias("c_len"), "all", "most")
    near = anywhere.select(*cell).join(theirs, "subject")
    s, d = (F.col("c_shape") != F.col("shape")).cast("int").alias("s"), F.abs(F.col("c_len") - F.col("len")).alias("d")
    near = near.select("*", s, d)
    # every distance has a cell and every cell an answer, so this many distances suffice
    near = near.withColumn("_level", F.dense_rank().over(Window.partitionBy(*cell).orderBy("s", "d"))).where(F.col("_level") <= F.col("most"))
    met = t.select(*own).distinct().join(near, cell)
    met = met.join(inside.select("subject", "category", F.col("shape").alias("c_shape"), F.col("len").alias("c_len"), "own"), ["subject", "category", "c_shape", "c_len"], "left")
    rank = lambda name, p: F.transform(name, lambda x: F.struct(F.col("s"), F.col("d"), F.lit(p).alias("p"), x["ord"].alias("ord"), x["answer"].alias("answer")))
    both = F.when(F.col("own").isNull(), rank("all", 1)).otherwise(F.concat(rank("own", 0), rank("all", 1)))
    cells = met.groupBy(*own).agg(F.array_sort(F.flatten(F.collect_list(both))).alias("candidates"))
    named = F.array_distinct(F.transform("candidates", lambda x: x["answer"]))  # the first place of each
    found = t.join(cells, own)
    return found.select("subject", "category", "answer", F.slice(F.array_remove(named, F.col("answer")), F.lit(1), F.col("keep")).alias("distractors")).where("size(distractors) > 0")


def four_choices(answer: Column, preferred: Column, distractors: Column) -> Column:
    """The answer and three others, own wrong choices first; empty if there aren't three."""
    others = F.slice(F.array_distinct(F.filter(F.concat(preferred, distractors), lambda c: T.choice_identity(c) != T.choice_identity(answer))), 1, CHOICES - 1)
    return F.when(F.size(others) == CHOICES - 1, F.concat(F.array(answer), others)).otherwise(F.array().cast("array<string>"))


def item_questions(items: DataFrame, pool: DataFrame) -> DataFrame:
    """Questions of learning items (id, source, kind, stem, choices, answer, explanation, occurredAt, subject, category)."""
    from ..functions import fixed as X

    found = items.join(ranked_distractors(pool, items), ["subject", "category", "answer"], "left")
    none = F.array().cast("array<string>")
    options = four_choices(F.col("answer"), F.coalesce("choices", none), F.coalesce("distractors", none))
    out = found.withColumn("_options", options).where((F.size("_options") == CHOICES) & (T.trim(F.coalesce("explanation", F.lit(""))) != ""))
    clock = F.date_format(T.utc(F.col("occurredAt")), "HH:mm")
    asked = F.concat(F.lit("根据今天 "), clock, F.lit(" 的原问题“"), T.shorten(F.col("stem"), 72), F.lit("”，记录中归纳的核心知识点原文是哪一项？"))
    stem = F.when(F.col("kind") == "choice", F.col("stem")).otherwise(asked)
    label = F.lit(X.SOURCE_LABELS["manual"])
    for name in ("codex", "chatgpt"):
        label = F.when(F.col("source") == name, X.SOURCE_LABELS[name]).otherwise(label)
    return out.select(
        F.concat(F.lit("today-question-"), F.col("id")).alias("id"),
        F.concat(F.lit("learning-point-"), F.col("id")).alias("pointId"),
        stem.alias("stem"),
        "answer",
        H.seeded_shuffle(F.col("_options"), F.col("id")).alias("choices"),
        "explanation",
        F.when(F.col("subject") == "大学英语", T.exam_section(stem)).otherwise(F.col("category")).alias("section"),
        "subject",
        F.col("category").alias("knowledgeCategory"),
        label.alias("sourceLabel"),
        F.col("ord"),
    )


def point_questions(points: DataFrame, pool: DataFrame) -> DataFrame:
    """A question for each answer part of document points (id, answerParts, text, question, context, explanation, sourceName, location, subject, category, ord)."""
    parts = points.withColumn("_parts", T.parts_or_text(F.col("answerParts"), F.col("text"))).where("size(_parts) > 0")
    asked = parts.select("*", F.posexplode("_parts").alias("part", "answer"))
    # a point's own parts are no distractors, so that many more are ranked
    found = asked.join(ranked_distractors(pool, asked, F.size("_parts") + CHOICES - 1), ["subject", "category", "answer"], "left")
    none = F.array().cast("array<string>")
    others = F.slice(F.filter(F.coalesce("distractors", none), lambda c: ~F.array_contains(F.transform("_parts", T.choice_identity), T.choice_identity(c))), 1, CHOICES - 1)
    found = found.withColumn("_others", others).where(F.size("_others") == CHOICES - 1)
    structured = F.regexp_count(T.standard_blanks(F.coalesce("question", F.lit(""))), F.lit("______+")) >= F.size("_parts")
    number = lambda c: (c + 1).cast("string")
    told = F.concat(F.lit("根据《"), F.col("sourceName"), F.lit("》"), F.col("location"), F.lit("的第 "), number(F.col("ord")), F.lit(" 条提取记录，其中第 "), number(F.col("part")), F.lit(" 个标红知识点原文是哪一项？"))
    stem = F.when((T.trim(F.coalesce("question", F.lit(""))) != "") & structured, T.fill_other_blanks(F.col("question"), F.col("_parts"), F.col("part"))).otherwise(told)
    qid = F.concat(F.lit("document-choice-"), F.col("id"), F.lit("-"), F.col("part").cast("string"))
    basis = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit("题干依据："), F.col("context"))).otherwise("")
    told_answer = F.concat(F.lit("完整答案："), F.array_join("_parts", "；"), F.lit("。"), basis)
    return found.select(
        qid.alias("id"),
        F.col("id").alias("pointId"),
        stem.alias("stem"),
        "answer",
        H.seeded_shuffle(F.concat(F.array("answer"), F.col("_others")), qid).alias("choices"),
        F.coalesce(F.nullif(F.col("explanation"), F.lit("")), told_answer).alias("explanation"),
        F.when(F.col("subject") == "大学英语", T.exam_section(stem)).otherwise(F.col("category")).alias("section"),
        "subject",
        F.col("category").alias("knowledgeCategory"),
        F.concat_ws(" · ", "sourceName", "location").alias("sourceLabel"),
        (F.col("ord") * 1000 + F.col("part")).alias("ord"),
    )


def question_bank(items: DataFrame, points: DataFrame) -> DataFrame:
    """Item questions before document questions; one for each stem and answer."""
    points = points.where("method <> 'history-import'")
    both = F.array(F.struct(F.col("answer").alias("answer"), F.lit(0).alias("k")), F.struct(F.col("knowledgePoint").alias("answer"), F.lit(1).alias("k")))
    from_items = items.select("subject", "category", "ord", F.explode(both).alias("e")).select("subject", "category", "e.answer", (F.col("ord") * 2 + F.col("e.k")).alias("ord"))
    from_points = points.select("subject", "category", "ord", F.posexplode(T.parts_or_text(F.col("answerParts"), F.col("text"))).alias("k", "answer"))
    from_points = from_points.select("subject", "category", "answer", (F.lit(1 << 40) + F.col("ord") * 1000 + F.col("k")).alias("ord"))
    pool = answer_pool(from_items.unionByName(from_points))
    asked = item_questions(items, pool).unionByName(point_questions(points, pool).withColumn("ord", F.col("ord") + F.lit(1 << 40)))
    keyed = asked.withColumn("_key", F.concat_ws("|", T.answer(T.nfkc(F.col("stem"))), T.choice_identity(T.nfkc(F.col("answer")))))
    return first_wins(keyed, "_key", "ord").drop("_key")


def select_exam(bank: DataFrame, count: int, seed: str) -> DataFrame:
    """The first ``count`` questions of the bank's seeded shuffle, with choices shuffled again.

    The shuffle is sequential by definition, so it runs over the list of question ids
    alone; the questions are joined to the places it gives.
    """
    ids = bank.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))
    n = F.greatest(F.lit(0), F.least(F.lit(int(count)), F.size("ids")))
    places = ids.select(F.posexplode(F.slice(H.long_seeded_shuffle(F.col("ids"), H.fnv32(F.lit(seed))), F.lit(1), n)).alias("place", "id"))
    return bank.join(places, "id").withColumn("choices", H.seeded_shuffle(F.col("choices"), F.concat(F.lit(f"{seed}-"), F.col("id"))))


def study_questions(points: DataFrame, limit: int | None = None, seed: int = 0) -> DataFrame:
    """Points in random order, every second one a choice question where it has one answer and three distractors."""
    parts = points.withColumn("answerParts", T.parts_or_text(F.col("answerParts"), F.col("text"))).withColumn("answer", F.array_join("answerParts", "；")).where(T.answer(F.col("answer")) != "")
    near = distractors_by_length(parts.where("size(answerParts) = 1").select("answer", "ord"))
    drawn = parts.withColumn("_draw", F.xxhash64("id", F.lit(seed)))
    drawn = drawn.orderBy("_draw", "id").limit(limit) if limit else drawn
    joined = drawn.join(near, "answer", "left")
    ordered = joined.withColumn("place", F.row_number().over(Window.orderBy("_draw", "id")) - 1)
    chosen = (F.size("answerParts") == 1) & (F.size(F.coalesce("distractors", F.array().cast("array<string>"))) == CHOICES - 1) & (F.col("place") % 2 == 1)
    stem = T.blank_stem(F.col("question"), F.col("context"), F.col("answer"), F.col("sourceName"), F.col("location"))
    return ordered.select(
        F.col("id").alias("pointId"),
        "place",
        F.when(chosen, "choice").otherwise("fill").alias("type"),
        stem.alias("stem"),
        "answer",
        "answerParts",
        F.when(chosen, H.seeded_shuffle(F.concat(F.array("answer"), F.col("distractors")), F.concat(F.col("id"), F.lit(str(seed))))).otherwise(F.array().cast("array<string>")).alias("choices"),
        F.coalesce(F.nullif(F.col("explanation"), F.lit("")), F.concat(F.lit("完整答案："), F.col("answer"))).alias("explanation"),
    )
