"""Chat history: files, archives, format sniffing, readers and learning items.

``parse`` takes (file_name, body, now_ms, tz_offset_min, source_hint, origin_label) and
yields learning items. Every reader is a projection or a window over the file's own
rows; archives are unpacked by one ``mapInPandas``.
"""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import hashing as H
from ..functions import text as T
from ..operators.ordered import first_wins, item_identity, pair_turns

_MESSAGE = "struct<author:struct<role:string>,create_time:string,update_time:string,content:struct<parts:array<string>>>"
CONVERSATION = f"struct<title:string,create_time:string,update_time:string,current_node:string,mapping:map<string,struct<parent:string,message:{_MESSAGE}>>>"
LOG_ROW = "struct<timestamp:string,type:string,payload:struct<type:string,role:string,source:string,content:array<struct<type:string,text:string>>>>"
_FILE = ("file_id", "now_ms", "tz_offset_min", "source_hint", "origin_label")
ITEM = ("id", "source", "occurredAt", "title", "kind", "stem", "choices", "answer", "explanation", "knowledgePoint", "originLabel")


def read_folder(spark: SparkSession, path: str, now_ms: int, tz_offset_min: int = 0, pattern: str = "*") -> DataFrame:
    """Text files below a folder, with the source that their names tell.

    A file beyond the limit has no body but a ``problem``; ``pattern`` chooses by name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name, fits = F.element_at(F.split("path", "/"), -1), F.col("length") <= X.MAX_IMPORT_BYTES
    rows = files.select(name.alias("file_name"), F.when(fits, F.col("content").cast("string")).alias("body"), F.when(~fits, F.lit("larger than the limit")).alias("problem"))
    return with_options(rows, now_ms, tz_offset_min, more=("problem",))


def with_options(files: DataFrame, now_ms: int, tz_offset_min: int = 0, source: str = "manual", more: tuple = ()) -> DataFrame:
    return files.select("file_name", "body", *more, F.lit(now_ms).cast("bigint").alias("now_ms"), F.lit(tz_offset_min).alias("tz_offset_min"), T.infer_source(F.col("file_name"), source).alias("source_hint"), F.col("file_name").alias("origin_label"))


def read_archives(files: DataFrame) -> DataFrame:
    """Entries (file_name, entry, ord, body, notice, problem) of archives (file_name, content).

    Conversation files come first, then by name. Entries that are too large give a notice;
    an archive beyond the limits gives one row with its problem.
    """

    def unpack(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["file_name"], batch["content"]):
                rows += _entries(name, bytes(content))
            yield pd.DataFrame(rows, columns=["file_name", "entry", "ord", "body", "notice", "problem"])

    return files.select("file_name", "content").mapInPandas(unpack, "file_name string, entry string, ord int, body string, notice string, problem string")


def _entries(name: str, content: bytes) -> list[tuple]:
    refused = lambda why: [(name, None, 0, None, None, why)]
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return refused("not an archive")
    listed = archive.infolist()
    if len(listed) > X.MAX_ARCHIVE_ENTRIES:
        return refused("too many files")
    wanted = [i for i in listed if re.search(X.ARCHIVE_ENTRY, i.filename)]
    if len(wanted) > X.MAX_CANDIDATE_ENTRIES:
        return refused("too many records")
    large = [i for i in wanted if i.file_size > X.MAX_IMPORT_BYTES]
    small = sorted((i for i in wanted if i.file_size <= X.MAX_IMPORT_BYTES), key=lambda i: (not re.search(X.ARCHIVE_FIRST, i.filename), i.filename))
    if sum(i.file_size for i in small) > X.MAX_EXPANDED_BYTES:
        return refused("records too large")
    out = [(name, i.filename, k, archive.read(i).decode("utf-8", "replace"), None, None) for k, i in enumerate(small)]
    return out + [(name, i.filename, len(small) + k, None, "larger than the limit, skipped", None) for k, i in enumerate(large)]


def sniff(files: DataFrame) -> DataFrame:
    """Adds file_id, cleaned body, its JSON (null if it isn't) and ``format``.

    conversations, objects, log (two or more JSON lines), plain, or empty.
    """
    body = T.clean(F.col("body"))
    # in brackets, since the parser stops after a first value and would take JSON lines for one
    boxed = F.try_parse_json(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    single = F.try_variant_get("_boxed", "$[1]", "variant").isNull()
    out = files.withColumn("body", body).withColumn("file_id", F.xxhash64("file_name", "body")).withColumn("_boxed", boxed)
    out = out.withColumn("json", F.when(single, F.try_variant_get("_boxed", "$[0]", "variant"))).drop("_boxed")
    lines = F.size(F.filter(F.split("body", "\n"), lambda x: x.rlike(r"^\s*\{") & F.try_parse_json(x).isNotNull()))
    talks = F.get_json_object("body", "$[0].mapping").isNotNull() | F.get_json_object("body", "$.conversations[0]").isNotNull() | (F.col("body").rlike(r"^\[") & F.col("body").rlike(r"\"mapping\"\s*:\s*\{"))
    kind = F.when(F.col("body") == "", "empty").when(F.col("json").isNotNull() & talks, "conversations").when(F.col("json").isNotNull(), "objects").when(lines >= 2, "log").otherwise("plain")
    return out.withColumn("format", kind)


def _ms(value: Column, fallback: Column) -> Column:
    return T.timestamp_ms(value, fallback)


def branch(mapping: Column, leaf: Column) -> Column:
    """Node ids from the root to ``leaf``, each once; all nodes if there is no such leaf."""
    walk = F.aggregate(
        F.sequence(F.lit(1), F.size(mapping)),
        F.struct(leaf.alias("at"), F.array().cast("array<string>").alias("path")),
        lambda s, _: F.when(
            s["at"].isNotNull() & F.map_contains_key(mapping, F.coalesce(s["at"], F.lit(""))) & ~F.array_contains(s["path"], F.coalesce(s["at"], F.lit(""))),
            F.struct(F.nullif(T.clean(F.try_element_at(mapping, s["at"])["parent"]), F.lit("")).alias("at"), F.concat(s["path"], F.array(s["at"])).alias("path")),
        ).otherwise(F.struct(F.lit(None).cast("string").alias("at"), s["path"].alias("path"))),
    )["path"]
    known = F.coalesce(F.map_contains_key(mapping, F.coalesce(leaf, F.lit(""))), F.lit(False))
    return F.when(known, F.reverse(walk)).otherwise(F.map_keys(mapping))


def conversation_pairs(files: DataFrame) -> DataFrame:
    """Pairs of exported conversations; the branch that ends in the current node is read."""
    listed = F.coalesce(F.from_json(F.get_json_object("body", "$.conversations"), f"array<{CONVERSATION}>"), F.from_json("body", f"array<{CONVERSATION}>"))
    talks = files.where("format = 'conversations'").select(*_FILE, F.posexplode(listed).alias("n", "c")).where("c.mapping is not null and size(c.mapping) > 0")
    start = _ms(F.coalesce("c.create_time", "c.update_time"), F.col("now_ms"))
    nodes = talks.select("*", start.alias("start"), F.posexplode(branch(F.col("c.mapping"), F.nullif(T.clean(F.col("c.current_node")), F.lit("")))).alias("idx", "node"))
    message = F.try_element_at(F.col("c.mapping"), F.col("node"))["message"]
    part = lambda p: F.when(p.rlike(r"^\{.*\}$"), F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p)
    said = T.clean(F.array_join(F.filter(F.transform(message["content"]["parts"], part), lambda p: p.isNotNull() & (p != "")), "\n"))
    rows = nodes.select(
        *_FILE,
        F.concat_ws("/", F.col("file_id").cast("string"), F.col("n").cast("string")).alias("conv_id"),
        F.lower(T.clean(message["author"]["role"])).alias("role"),
        said.alias("text"),
        _ms(F.coalesce(message["create_time"], message["update_time"]), F.col("start") + F.col("idx")).alias("occurredAt"),
        F.col("idx"),
        T.clean(F.col("c.title")).alias("title"),
    ).withColumn("turn", F.struct("occurredAt", "idx"))
    pairs = pair_turns(rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))), order="place", extra=(*_FILE, "occurredAt", "title", "turn"), strip=True)
    return pairs.withColumn("source", F.lit("chatgpt")).select(*_FILE, "source", "prompt", "response", "occurredAt", "title", F.concat_ws("/", "conv_id", F.lpad(F.col("pair").cast("string"), 9, "0")).alias("place"))


def log_pairs(files: DataFrame) -> DataFrame:
    """Pairs of session logs; a log of a subagent is left out whole."""
    rows = files.where("format = 'log'").select(*_FILE, F.posexplode(F.split("body", "\n")).alias("idx", "line"))
    return log_line_pairs(rows.withColumn("idx", F.col("idx").cast("bigint")))


def read_log_lines(spark: SparkSession, path: str, now_ms: int, tz_offset_min: int = 0, source: str = "codex") -> DataFrame:
    """Lines of session logs (``*.jsonl``) below a folder, read line by line whatever the
    size of a file. ``idx`` rises within a file: its blocks are read in order of row ids."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][sS][oO][nN][lL]").text(path)
    at = F.row_number().over(Window.partitionBy("file_id").orderBy("_block", "_row")).cast("bigint")
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file_id"), F.col("_metadata.file_name").alias("origin_label"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    options = {"now_ms": F.lit(now_ms).cast("bigint"), "tz_offset_min": F.lit(tz_offset_min), "source_hint": F.lit(source)}
    return lines.withColumns(options).withColumn("idx", at).select(*_FILE, "idx", "line")


def log_line_pairs(lines: DataFrame) -> DataFrame:
    """The same of single lines (file columns, idx, line); lines that aren't JSON are passed over."""
    rows = lines.select(*_FILE, "idx", F.from_json("line", LOG_ROW).alias("r"))
    agents = rows.where("r.type = 'session_meta'").groupBy("file_id").agg(F.min_by("r", "idx").alias("m")).where(F.coalesce(F.get_json_object("m.payload.source", "$.subagent"), F.lit("")) != "")
    said = T.clean(F.array_join(F.filter(F.transform("r.payload.content", lambda p: T.clean(p["text"])), lambda p: p != ""), "\n"))
    talk = rows.join(agents.select("file_id"), "file_id", "left_anti").where("r.type = 'response_item' and r.payload.type = 'message'")
    talk = talk.select(*_FILE, "idx", F.lower(T.clean(F.col("r.payload.role"))).alias("role"), said.alias("text"), _ms(F.col("r.timestamp"), F.col("now_ms") + F.col("idx")).alias("occurredAt"))
    pairs = pair_turns(talk, "file_id", "idx", extra=(*_FILE[1:], "occurredAt"), strip=True)
    pairs = pairs.where(~F.col("prompt").rlike(r"(?i)^<(?:codex_internal_context|environment_context)(?![A-Za-z0-9_])"))
    return pairs.withColumn("source", F.lit("codex")).select(*_FILE, "source", "prompt", "response", "occurredAt", T.shorten(F.col("prompt")).alias("title"), F.lpad(F.col("pair").cast("string"), 9, "0").alias("place"))


def plain_pairs(files: DataFrame) -> DataFrame:
    """Pairs of transcripts with role tags (first answer after each prompt), or of question blocks."""
    plain = files.where("format = 'plain'").withColumn("roles", F.regexp_extract_all("body", F.lit(X.ROLE_TAG), F.lit(1)))
    tagged = plain.where(F.size("roles") >= 2).withColumn("said", F.slice(F.split("body", X.ROLE_TAG), F.lit(2), F.size("roles")))
    rows = tagged.select(*_FILE, F.posexplode(F.arrays_zip("roles", "said")).alias("idx", "b")).select(*_FILE, "idx", F.lower("b.roles").isin(*X.USER_ROLES).alias("asks"), T.clean(F.col("b.said")).alias("text"))
    w = Window.partitionBy("file_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("pair", F.sum(F.col("asks").cast("int")).over(w)).where("pair > 0")
    answer = F.when(~F.col("asks") & (F.col("text") != ""), F.col("idx"))
    talks = rows.groupBy(*_FILE, "pair").agg(F.max(F.when(F.col("asks"), F.col("text"))).alias("p"), F.min_by("text", answer).alias("response"), F.min(answer).alias("a"))
    talks = talks.withColumn("prompt", T.strip_context(F.col("p"))).where("prompt <> '' and a is not null").select(*_FILE, "prompt", "response", F.col("pair").alias("n"), T.shorten(F.col("prompt")).alias("title"))
    ws = X.WS
    blocks = plain.where(F.size("roles") < 2).select(*_FILE, F.posexplode(F.split("body", rf"(?i)\n(?={ws}*(?:#{{1,4}}{ws}*)?(?:题目|question){ws}*[:：])")).alias("n", "b")).withColumn("b", T.clean(F.col("b")))
    asked = F.regexp_extract("b", rf"(?is)(?:^|\n){ws}*(?:#{{1,4}}{ws}*)?(?:题目|question){ws}*[:：]{ws}*(.*?)(?=\n{ws}*(?:答案|answer|解析|explanation){ws}*[:：]|\z)", 1)
    answered = F.regexp_extract("b", rf"(?i)(?:^|\n){ws}*(?:答案|answer){ws}*[:：]{ws}*([^\n]+)", 1)
    explained = F.regexp_extract("b", rf"(?is)(?:^|\n){ws}*(?:解析|explanation|analysis){ws}*[:：]{ws}*(.+)", 1)
    told = F.concat(F.lit("答案："), T.clean(answered), F.lit("\n解析："), T.clean(F.when(explained != "", explained).otherwise(answered)))
    asked_rows = blocks.withColumn("_q", asked).where((F.col("_q") != "") & (answered != "")).select(*_FILE, T.clean(F.col("_q")).alias("prompt"), told.alias("response"), F.col("n").cast("bigint").alias("n"), T.shorten(F.col("_q")).alias("title"))
    both = talks.unionByName(asked_rows)
    return both.select(*_FILE, F.col("source_hint").alias("source"), "prompt", "response", F.col("now_ms").alias("occurredAt"), "title", F.lpad(F.col("n").cast("string"), 9, "0").alias("place"))


def _item_columns(choices: Column, stem: Column, answer: Column, explanation: Column, kind: Column, knowledge: Column) -> list[Column]:
    identity = F.concat_ws("|", "source", F.col("occurredAt").cast("string"), stem, answer)
    title = F.when(F.col("title") != "", F.col("title")).otherwise(T.shorten(stem))
    return [
        F.concat(F.lit("history-"), H.hash_id(identity)).alias("id"), F.col("source").alias("source"), F.col("occurredAt").alias("occurredAt"), title.alias("title"), kind.alias("kind"),
        stem.alias("stem"), choices.alias("choices"), answer.alias("answer"), explanation.alias("explanation"), knowledge.alias("knowledgePoint"), F.col("origin_label").alias("originLabel"),
    ]


def _same_choice(choices: Column, answer: Column) -> Column:
    return F.get(F.filter(choices, lambda c: T.choice_identity(c) == T.choice_identity(answer)), 0)


def split_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that hold several numbered choice questions become one pair a question."""
    options = lambda b: F.regexp_count(T.option_alphabet(b), F.lit(rf"(?i)(?:^|\n|[ \t]){X.WS}*(?:[-*]{X.WS}*)?{X.OPTION_PREFIX}"))
    blocks = F.filter(T.question_blocks(F.col("prompt")), lambda b: options(b) >= 2)
    p = pairs.withColumn("_b", blocks).withColumn("_r", T.question_blocks(F.col("response"))).withColumn("_labels", T.ordered_labels(F.col("response")))
    many = (F.size("_b") >= 2) & (F.size("_labels") >= F.size("_b"))
    exploded = p.select("*", F.posexplode(F.when(many, F.col("_b")).otherwise(F.array("prompt"))).alias("_i", "_q")).withColumn("_many", many)
    matched = F.size("_r") == F.size("_b")
    own = F.get(F.col("_r"), F.col("_i"))
    label = F.when(matched, F.coalesce(F.nullif(T.answer_label(own), F.lit("")), F.get(T.ordered_labels(own), 0), F.get(F.col("_labels"), F.col("_i")))).otherwise(F.get(F.col("_labels"), F.col("_i")))
    told = F.concat(F.lit("答案："), label, F.lit("\n解析："), F.when(matched, own).otherwise(F.col("response")))
    named = F.concat(F.when(F.col("title") != "", F.col("title")).otherwise("组合题"), F.lit(" · 第 "), (F.col("_i") + 1).cast("string"), F.lit(" 题"))
    return exploded.select(
        *_FILE, "source", F.col("_q").alias("prompt"), F.when(F.col("_many"), told).otherwise(F.col("response")).alias("response"),
        F.when(F.col("_many"), F.col("occurredAt") + F.col("_i")).otherwise(F.col("occurredAt")).alias("occurredAt"), F.when(F.col("_many"), named).otherwise(F.col("title")).alias("title"), "place", F.col("_i").alias("part"),
    )


def items_from_pairs(pairs: DataFrame) -> DataFrame:
    """Learning items: a choice question whose answer is known, else a knowledge statement, else nothing."""
    none = F.array().cast("array<string>")
    p = split_pairs(pairs).withColumn("_c", T.choice_block(F.col("prompt")))
    p = p.withColumn("_a", T.resolve_answer(F.col("response"), F.col("_c.choices"))).withColumn("_hit", F.when(F.col("_a") != "", _same_choice(F.col("_c.choices"), F.col("_a"))))
    asks = (F.size("_c.choices") >= 2) & F.col("_hit").isNotNull()
    p = p.withColumn("_asks", asks).withColumn("_e", T.clean_explanation(F.col("response"))).withColumn("_k", T.knowledge_statement(F.col("response")))
    p = p.where((F.col("_asks") & (F.col("_e") != "")) | (~F.col("_asks") & (F.col("_k") != "")))
    pick = lambda chosen, stated: F.when(F.col("_asks"), chosen).otherwise(stated)
    stem = pick(F.when(F.col("_c.stem") != "", F.col("_c.stem")).otherwise(F.col("prompt")), F.col("prompt"))
    answer = pick(F.col("_hit"), F.col("_k"))
    columns = _item_columns(pick(F.col("_c.choices"), none), stem, answer, pick(F.col("_e"), T.clean(F.col("response"))), pick(F.lit("choice"), F.lit("knowledge")), answer)
    return p.select(*_FILE[:3], "place", "part", *columns)


def items_from_objects(files: DataFrame) -> DataFrame:
    """Learning items of JSON objects, by whichever of the known names their fields have."""
    objects = files.where("format = 'objects'")
    listed = F.coalesce(F.try_variant_get("json", "$.items", "array<variant>"), F.try_variant_get("json", "$", "array<variant>"), F.array("json"))
    v = objects.select(*_FILE, F.posexplode(listed).alias("idx", "v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    get = lambda names: T.clean(T.first_present(F.col("v"), names))
    raw_time = T.first_present(F.col("v"), X.TIME_KEYS)
    none = F.array().cast("array<string>")
    given = lambda kind: F.coalesce(*[F.try_variant_get("v", f"$.{n}", kind) for n in X.CHOICE_KEYS])
    tidy_all = lambda a: F.filter(F.transform(a, T.choice), lambda c: c != "")
    named = F.transform(F.array_sort(F.map_entries(given("map<string,string>"))), lambda e: e["value"])
    text = F.coalesce(*[F.try_variant_get("v", f"$.{n}", "string") for n in X.CHOICE_KEYS])
    block = T.choice_block(get(X.STEM_KEYS))
    v = v.withColumn("_ms", _ms(raw_time, F.lit(None))).where((F.coalesce(raw_time, F.lit("")) != "") & F.col("_ms").isNotNull())
    v = v.withColumn("_block", block).withColumn("_list", F.coalesce(tidy_all(given("array<string>")), tidy_all(named), T.choice_block(text)["choices"], none))
    v = v.withColumn("choices", F.array_distinct(F.concat("_list", "_block.choices")))
    said_source = F.lower(get(("source",)))
    v = v.select(
        *_FILE, "idx", "choices", F.col("_ms").alias("occurredAt"), F.when(said_source.isin("chatgpt", "codex"), said_source).otherwise(F.col("source_hint")).alias("source"),
        F.when(F.col("_block.stem") != "", F.col("_block.stem")).otherwise(get(X.STEM_KEYS)).alias("stem"), get(X.ANSWER_KEYS).alias("raw"), get(X.EXPLANATION_KEYS).alias("response"), get(X.KNOWLEDGE_KEYS).alias("known"),
        get(("title",)).alias("own_title"), get(("originLabel",)).alias("own_origin"),
    )
    v = v.withColumn("title", F.when(F.col("own_title") != "", F.col("own_title")).otherwise(T.shorten(F.when(F.col("stem") != "", F.col("stem")).otherwise(F.col("known")))))
    v = v.withColumn("origin_label", F.when(F.col("own_origin") != "", F.col("own_origin")).otherwise(F.col("origin_label")))
    v = v.withColumn("_a", T.resolve_answer(F.when(F.col("raw") != "", F.col("raw")).otherwise(F.col("response")), F.col("choices")))
    v = v.withColumn("_hit", F.when((F.col("_a") != "") & (F.size("choices") >= 2) & (F.col("stem") != ""), _same_choice(F.col("choices"), F.col("_a"))))
    point = F.when(F.col("known") != "", F.col("known")).when((F.col("raw") != "") & ~F.col("raw").rlike(r"(?i)^[A-H]\z"), F.col("raw")).otherwise(T.knowledge_statement(F.col("response")))
    v = v.withColumn("_asks", F.col("_hit").isNotNull()).withColumn("_e", T.clean_explanation(F.col("response"))).withColumn("_k", point)
    v = v.where((F.col("_asks") & (F.col("_e") != "")) | (~F.col("_asks") & (F.col("_k") != "") & (F.col("stem") != "")))
    pick = lambda chosen, stated: F.when(F.col("_asks"), chosen).otherwise(stated)
    told = F.when(F.col("response") != "", F.col("response")).otherwise(F.col("_k"))
    knowledge = pick(F.when(F.col("known") != "", F.col("known")).otherwise(F.col("_hit")), F.col("_k"))
    columns = _item_columns(pick(F.col("choices"), none), F.col("stem"), pick(F.col("_hit"), F.col("_k")), pick(F.col("_e"), told), pick(F.lit("choice"), F.lit("knowledge")), knowledge)
    return v.select(*_FILE[:3], F.lpad(F.col("idx").cast("string"), 9, "0").alias("place"), F.lit(0).alias("part"), *columns)


def finalize(items: DataFrame, today_only: bool = True, nfkc: bool = True) -> DataFrame:
    """Today's items, the first of each source, stem and answer within a file."""
    if today_only:
        items = items.where(T.local_day(F.col("occurredAt"), F.col("tz_offset_min")) == T.local_day(F.col("now_ms"), F.col("tz_offset_min")))
    fold = T.nfkc if nfkc else (lambda c: c)
    keyed = items.where((T.answer(fold(F.col("stem"))) != "") & (T.choice_identity(fold(F.col("answer"))) != ""))
    keyed = keyed.withColumn("_key", item_identity(F.col("source"), F.col("stem"), F.col("answer"), nfkc))
    return first_wins(keyed, ["file_id", "_key"], ["place", "part"]).drop("_key")


def parse(files: DataFrame, today_only: bool = True) -> DataFrame:
    """Learning items of all files, whatever their format."""
    sniffed = sniff(files)
    pairs = conversation_pairs(sniffed).unionByName(log_pairs(sniffed)).unionByName(plain_pairs(sniffed))
    pairs = pairs.repartition("file_id", "place")  # files differ in size; and what follows is planned once, not once a reader
    return finalize(items_from_pairs(pairs).unionByName(items_from_objects(sniffed)), today_only).select("file_id", *ITEM)


def parse_archives(archives: DataFrame, now_ms: int, tz_offset_min: int = 0, source: str = "manual", today_only: bool = True) -> DataFrame:
    """Learning items of archives (file_name, content): archive and the items' columns.

    Every entry is parsed for itself and labelled with its archive; an item that several
    entries hold is taken from the first.
    """
    entries = read_archives(archives).where("body is not null")
    label = F.concat_ws(" / ", "file_name", "entry")
    files = entries.select(
        label.alias("file_name"), "body", F.lit(now_ms).cast("bigint").alias("now_ms"), F.lit(tz_offset_min).alias("tz_offset_min"), T.infer_source(F.col("entry"), source).alias("source_hint"), label.alias("origin_label"), F.col("file_name").alias("archive"), "ord"
    )
    places = files.select(F.xxhash64("file_name", T.clean(F.col("body"))).alias("file_id"), "archive", F.col("ord").alias("_entry")).distinct()
    items = parse(files.drop("archive", "ord"), today_only).join(places, "file_id")
    keyed = items.withColumn("_key", item_identity(F.col("source"), F.col("stem"), F.col("answer")))
    return first_wins(keyed, ["archive", "_key"], ["_entry", "occurredAt", "id"]).select("archive", *ITEM)


def counts(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Rows read, kept and skipped of each file; skipped is never negative."""
    a = candidates.groupBy("file_id").agg(F.count("*").alias("n_read"))
    b = items.groupBy("file_id").agg(F.count("*").alias("n_kept"))
    return a.join(b, "file_id", "left").select("file_id", "n_read", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.greatest(F.lit(0), F.col("n_read") - F.coalesce("n_kept", F.lit(0))).alias("n_skipped"))


def to_points(items: DataFrame) -> DataFrame:
    """Learning items as knowledge points; expects ``classification``."""
    label = F.lit(X.SOURCE_LABELS["manual"])
    for name in ("codex", "chatgpt"):
        label = F.when(F.col("source") == name, X.SOURCE_LABELS[name]).otherwise(label)
    return items.select(
        F.concat(F.lit("learning-point-"), F.col("id")).alias("id"), F.coalesce(F.nullif(F.col("knowledgePoint"), F.lit("")), F.col("answer")).alias("text"), F.col("explanation").alias("context"), "explanation", F.col("stem").alias("question"),
        F.array("answer").alias("answerParts"), label.alias("sourceName"), F.date_format(T.utc(F.col("occurredAt")), "MM/dd HH:mm").alias("location"), F.lit("history-import").alias("method"), F.col("occurredAt").alias("createdAt"),
        F.col("classification.subject").alias("subject"), F.col("classification.category").alias("knowledgeCategory"), F.col("classification.confidence").alias("classificationConfidence"), F.lit(1).alias("classificationVersion"), F.lit("auto").alias("classificationSource"),
    )
