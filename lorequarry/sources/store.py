"""The state store: tables written whole, read with validation, and the exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import taxonomy as C
from ..functions import text as T

TABLES = ("points", "records", "attempts", "items")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """A snapshot: every table is written whole."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, legacy: str | None = None) -> dict[str, DataFrame]:
    """The tables of the folder, or of the older one where the folder isn't there."""
    home = folder if any(exists(spark, f"{folder}/{t}") for t in TABLES) else legacy
    return {} if home is None else {t: spark.read.parquet(f"{home}/{t}") for t in TABLES if exists(spark, f"{home}/{t}")}


def valid_points(points: DataFrame) -> DataFrame:
    """Rows that can be studied; labels lose their user mark on load."""
    kept = points.where("id is not null and coalesce(trim(text), '') <> '' and sourceName is not null and location is not null and context is not null")
    return kept.withColumn("classificationSource", F.lit("auto")) if "classificationSource" in points.columns else kept


def valid_items(items: DataFrame) -> DataFrame:
    """Learning items that are complete: a choice item has its answer among two or more choices."""
    has = lambda c: F.coalesce(T.trim(F.col(c)), F.lit("")) != ""
    choice = (F.col("kind") == "choice") & (F.size("choices") >= 2) & F.array_contains("choices", F.col("answer"))
    known = F.col("source").isin("chatgpt", "codex", "manual") & F.col("occurredAt").isNotNull()
    return items.where(known & has("id") & has("stem") & has("answer") & has("explanation") & ((F.col("kind") == "knowledge") | choice))


def valid_attempts(attempts: DataFrame) -> DataFrame:
    return attempts.where("id is not null and pointId is not null and correct is not null and createdAt is not null")


def repair_records(records: DataFrame, attempts: DataFrame) -> DataFrame:
    """Records whose last result is missing take it from the newest attempt."""
    last = attempts.groupBy("pointId").agg(F.max_by("correct", F.struct("createdAt")).alias("_last"))
    return records.join(last, "pointId", "left").withColumn("lastCorrect", F.coalesce("lastCorrect", "_last")).drop("_last")


def upsert_points(points: DataFrame, fresh: DataFrame) -> DataFrame:
    """Adds the points whose id isn't there yet, once each."""
    new = fresh.dropDuplicates(["id"]).join(points.select("id"), "id", "left_anti")
    return points.unionByName(new, allowMissingColumns=True)


def edit_point(points: DataFrame, point_id: str, text: str, question: str | None) -> DataFrame:
    """One point with a new answer: its parts are split again and its label is drawn anew."""
    from ..operators.structure import split_answer_parts

    hit = F.col("id") == point_id
    blanks = T.blank_count(F.lit(question or ""))
    parts = split_answer_parts(F.lit(text), blanks)
    changed = points.where(hit).withColumn("text", F.lit(text)).withColumn("question", F.lit(question).cast("string")).withColumn("answerParts", parts)
    changed = C.classify(changed.drop("subject", "knowledgeCategory", "classificationConfidence"))
    changed = changed.withColumn("subject", F.col("classification.subject")).withColumn("knowledgeCategory", F.col("classification.category")).withColumn("classificationConfidence", F.col("classification.confidence")).drop("classification")
    return points.where(~hit).unionByName(changed, allowMissingColumns=True)


def delete_points(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the points of ``gone`` (id) and what hangs on them: records,
    attempts, and questions where there are any."""
    ids = gone.select("id").distinct()
    own = {"points": "id", "records": "pointId", "attempts": "pointId", "questions": "pointId"}
    return {name: table.join(ids.withColumnRenamed("id", own[name]), own[name], "left_anti") if name in own else table for name, table in tables.items()}


def remove_items(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the learning items of ``gone`` (id); their points and records go
    too, unless there are attempts, whose history stays."""
    ids = gone.select("id").distinct()
    points = ids.select(F.concat(F.lit(T.ITEM_POINT), "id").alias("id"))
    untried = points.join(tables["attempts"].select(F.col("pointId").alias("id")), "id", "left_anti")
    return tables | {
        "items": tables["items"].join(ids, "id", "left_anti"),
        "points": tables["points"].join(untried, "id", "left_anti"),
        "records": tables["records"].join(untried.withColumnRenamed("id", "pointId"), "pointId", "left_anti"),
    }


def resume_session(session: Column) -> Column:
    """A stored session (questions, questionIndex, answer, checked, lastCorrect, pendingGrade,
    quizMode, sessionResults) as it can be taken up again; null without questions.

    It goes on where it stood if there is a result for every question done; otherwise it
    starts anew. A grade that waits for the user only counts on a checked answer.
    """
    s, no = session, F.lit(False)
    n = F.size(F.coalesce(s["questions"], F.array()))
    asked = F.coalesce(s["questionIndex"], F.lit(0))
    index = F.when((asked >= 0) & (asked < n), asked).otherwise(0)
    checked = F.coalesce(s["checked"], no)
    pending = F.when(checked & (s["pendingGrade"]["verdict"] == "needs-confirmation"), s["pendingGrade"])
    done = index + F.when(checked & pending.isNull(), 1).otherwise(0)
    results = F.array_compact(F.coalesce(s["sessionResults"], F.array().cast("array<boolean>")))
    kept = F.when(F.size(results) >= done, F.slice(results, F.lit(1), done)).otherwise(F.array().cast("array<boolean>"))
    goes_on = (done == 0) | (F.size(kept) == done)
    fields = F.struct(
        s["questions"].alias("questions"),
        F.when(goes_on, index).otherwise(0).alias("questionIndex"),
        F.when(goes_on, F.coalesce(s["answer"], F.lit(""))).otherwise("").alias("answer"),
        (goes_on & checked).alias("checked"),
        F.when(goes_on, s["lastCorrect"]).alias("lastCorrect"),
        F.when(goes_on, pending).alias("pendingGrade"),
        F.when(s["quizMode"] == "today", "today").otherwise("study").alias("quizMode"),
        F.when(goes_on, kept).otherwise(F.array().cast("array<boolean>")).alias("sessionResults"),
    )
    return F.when(n > 0, fields)


def session_without(session: Column, point_id: Column) -> Column:
    """A session (questions, questionIndex, sessionResults) without a point's questions and
    their results; the place moves by those that were before it."""
    place = F.sequence(F.lit(0), F.size(session["questions"]) - 1)
    gone = F.when(F.size(session["questions"]) > 0, F.filter(place, lambda k: F.get(session["questions"], k)["pointId"] == point_id)).otherwise(F.array().cast("array<int>"))
    left = F.filter(session["questions"], lambda q: ~F.coalesce(q["pointId"] == point_id, F.lit(False)))
    before = F.size(F.filter(gone, lambda k: k < session["questionIndex"]))
    moved = F.when(before > 0, F.greatest(F.lit(0), session["questionIndex"] - before)).otherwise(F.least(session["questionIndex"], F.size(left)))
    results = F.filter(session["sessionResults"], lambda _, k: ~F.array_contains(gone, k))
    touched = F.size(gone) > 0
    return F.struct(left.alias("questions"), F.when(touched, moved).otherwise(session["questionIndex"]).alias("questionIndex"), F.when(touched, results).otherwise(session["sessionResults"]).alias("sessionResults"))


def demo_points(spark: SparkSession, created_at: int) -> DataFrame:
    """The built-in points, classified; their ids follow from their texts."""
    rows = [(f"demo-{k}", text, context, X.DEMO_SOURCE, place, X.DEMO_METHOD, created_at) for k, (text, context, place) in enumerate(X.DEMO_POINTS)]
    points = C.classify(spark.createDataFrame(rows, "id string, text string, context string, sourceName string, location string, method string, createdAt bigint"))
    points = points.withColumn("id", T.make_id(F.col("sourceName"), F.col("text")))
    label = {"subject": "subject", "knowledgeCategory": "category", "classificationConfidence": "confidence"}
    return points.withColumns({k: F.col(f"classification.{v}") for k, v in label.items()} | {"classificationVersion": F.lit(C.VERSION), "classificationSource": F.lit("auto")}).drop("classification")


def filter_subjects(points: DataFrame, subject: str = "all", category: str = "all") -> DataFrame:
    """Points of a subject and category; a choice that no point has any more counts as ``all``."""
    if subject != "all" and not points.where(F.col("subject") == subject).head(1):
        subject = "all"
    out = points if subject == "all" else points.where(F.col("subject") == subject)
    if category != "all" and out.where(F.col("knowledgeCategory") == category).head(1):
        out = out.where(F.col("knowledgeCategory") == category)
    return out


def categories(points: DataFrame) -> DataFrame:
    """Distinct subjects and categories, categories in the order of Chinese readers."""
    return points.select("subject", "knowledgeCategory").distinct().orderBy("subject", F.collate("knowledgeCategory", "zh"))


def day_export(pairs: DataFrame, day: str, zone: str, exported_at: str) -> DataFrame:
    """One JSON document: the day's pairs in order of time, once for each time and prompt.

    A day's export is one file by definition, so its items are gathered in one row.
    """
    same_day = pairs.where(T.zone_day(F.col("occurredAt"), zone) == day)
    once = same_day.withColumn("_n", F.row_number().over(Window.partitionBy("occurredAt", "prompt").orderBy("place"))).where("_n = 1")
    at = F.concat(F.date_format(T.utc(F.col("occurredAt")), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    title = F.substring(T.sub(T.clean(F.col("prompt")), r"\n+", " "), 1, 80)
    item = F.struct(F.lit("codex").alias("source"), at.alias("occurredAt"), title.alias("title"), "prompt", "response", F.col("origin_label").alias("originLabel"))
    rows = once.agg(F.transform(F.array_sort(F.collect_list(F.struct("occurredAt", "place", item.alias("item")))), lambda x: x["item"]).alias("items"))
    whole = F.struct(F.lit(1).alias("schemaVersion"), F.lit("codex").alias("source"), F.lit(exported_at).alias("exportedAt"), F.lit(zone).alias("timezone"), F.lit(day).alias("targetDay"), "items")
    return rows.select(F.to_json(whole).alias("value"))


def add_note(notes: DataFrame, title: str, content: str, created_at: str) -> DataFrame:
    """Notes with one more; a title is required."""
    title = title.strip()
    if not title:
        raise ValueError("a title is required")
    spark = notes.sparkSession
    top = notes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return notes.unionByName(spark.createDataFrame([(int(top) + 1, title, content.strip(), created_at)], "id bigint, title string, content string, created_at string"))


def recent_notes(notes: DataFrame, limit: int = 20) -> DataFrame:
    return notes.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
