"""One query for each operator over the driver's tables, with equivalent SQL.

Stand-ins: events are attempts (a user is a point; view, click and purchase are right),
conversations are chat turns, parts are answers (type is the subject, brand the
category), lines of documents are document lines, benchmark items are red fragments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import hashing as H
from ..functions import similarity as M
from ..functions import taxonomy as C
from ..functions import text as T
from ..operators import ordered, pages, questions, review, structure
from ..sources import store
from . import sqltext as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: A fixed "now" for views over the schedule: 2024-02-01 00:00 UTC.
NOW_MS = 1_706_745_600_000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("point_id"), T.epoch_ms(F.col("ts")).alias("ts_ms"), F.col("event_id").alias("ord"), F.col("event_type").isin("view", "click", "purchase").alias("correct"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.fold(attempts(spark, sf_dir))


# --- chat turns and text -----------------------------------------------------------------


@query("""
SELECT conv_id, CAST(pair AS BIGINT) AS pair, max(CASE WHEN lower(role) = 'user' THEN text END) AS prompt,
       string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (lower(role) <> 'user') AS response, count(*) FILTER (lower(role) <> 'user') AS n_responses
FROM (SELECT *, sum(CASE WHEN lower(role) = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS pair
      FROM conversations WHERE lower(role) IN ('user', 'assistant') AND coalesce(text, '') <> '')
WHERE pair > 0 GROUP BY ALL HAVING count(*) FILTER (lower(role) <> 'user') > 0""")
def pair_turns(spark, d):
    return ordered.pair_turns(table(spark, d, "conversations"))


@query(f"SELECT doc_id, {S.clean('text')} AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {S.tidy('text')} AS tidied FROM documents")
def tidy_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tidy(F.col("text")).alias("tidied"))


@query(f"SELECT doc_id, md5({S.key('text')}) AS key, md5({S.structure_key('text')}) AS structure_key FROM documents")
def compact_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.key(F.col("text"))).alias("key"), F.md5(T.structure_key(F.col("text"))).alias("structure_key"))


@query(f"SELECT p_partkey, {S.answer('p_name')} AS name, {S.answer('p_brand')} AS brand FROM part")
def normalize_answer(spark, d):
    return table(spark, d, "part").select("p_partkey", T.answer(T.nfkc(F.col("p_name"))).alias("name"), T.answer(T.nfkc(F.col("p_brand"))).alias("brand"))


@query(f"""
SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line
FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({S.tidy('text')}, '\\n+'), lambda x: {S.trim(S.sub('x', '^[' + chr(92) + 's' + chr(92) + '-•·]+|[' + chr(92) + 's' + chr(92) + '-•·]+$'))}), lambda x: length(x) >= 2) AS a FROM documents)""")
def useful_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.useful_lines(F.col("text"))).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"""
SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS sentence
FROM (SELECT doc_id, list_filter(list_transform(string_split({S.sub(S.tidy('text'), '([。！？!?；;' + chr(92) + 'n])', chr(92) + '1' + chr(1))}, chr(1)), lambda x: {S.trim('x')}), lambda x: x <> '') AS a FROM documents)""")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"SELECT conv_id, turn, {S.shorten('text')} AS title FROM conversations")
def shorten_title(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.shorten(F.col("text")).alias("title"))


@query(f"""
SELECT source, list_reduce(list_prepend({X.FNV_START}::BIGINT, list_transform(string_split(source, ''), lambda c: ord(c)::BIGINT)),
       lambda h, c: (xor(h, c) * {X.FNV_PRIME}) & 4294967295) AS hash
FROM (SELECT DISTINCT source FROM documents)""")
def fnv_id(spark, d):
    return table(spark, d, "documents").select("source").distinct().select("source", H.fnv32(F.col("source")).alias("hash"))


@query("SELECT event_id, strftime(ts + INTERVAL 480 MINUTE, '%Y-%m-%d') AS day_offset, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day_zone FROM events")
def local_day(spark, d):
    ms = T.epoch_ms(F.col("ts"))
    return table(spark, d, "events").select("event_id", T.local_day(ms, -480).alias("day_offset"), T.zone_day(ms, "Asia/Shanghai").alias("day_zone"))


@query("SELECT event_id, user_id FROM events WHERE strftime(ts + INTERVAL 480 MINUTE, '%Y-%m-%d') = '2024-01-10'")
def same_day_filter(spark, d):
    # the day as a range of instants, which reaches the scan as a filter
    start, end = F.lit("2024-01-09 16:00:00").cast("timestamp_ntz"), F.lit("2024-01-10 16:00:00").cast("timestamp_ntz")
    return table(spark, d, "events").where((F.col("ts") >= start) & (F.col("ts") < end)).select("event_id", "user_id")


@query(f"""
SELECT event_id, CASE WHEN d <= 0 THEN {S.lit(X.DUE[0])} WHEN m < 60 THEN m || {S.lit(X.DUE[1])} WHEN h < 24 THEN h || {S.lit(X.DUE[2])} ELSE CAST(ceil(h / 24.0) AS BIGINT) || {S.lit(X.DUE[3])} END AS due
FROM (SELECT *, CAST(ceil(m / 60.0) AS BIGINT) AS h FROM (SELECT event_id, event_id * 370111 - 50000000 AS d, CAST(ceil((event_id * 370111 - 50000000) / {X.MINUTE_MS}.0) AS BIGINT) AS m FROM events))""")
def format_due(spark, d):
    now = F.lit(NOW_MS)
    return table(spark, d, "events").select("event_id", T.format_due(now + F.col("event_id") * 370111 - 50000000, now).alias("due"))


@query(f"""
SELECT p_partkey, r >= {X.RED_MIN} AND g <= {X.RED_OTHER_MAX} AND b <= {X.RED_OTHER_MAX} AND r >= g * {X.RED_DOMINANCE}::DOUBLE AND r >= b * {X.RED_DOMINANCE}::DOUBLE AS red
FROM (SELECT p_partkey, CASE WHEN r <= 1 THEN r * 255 ELSE r END AS r, CASE WHEN g <= 1 THEN g * 255 ELSE g END AS g, CASE WHEN b <= 1 THEN b * 255 ELSE b END AS b
      FROM (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_partkey * 91 % 200 AS g, p_size * 3 AS b FROM part))""")
def red_color(spark, d):
    return table(spark, d, "part").select("p_partkey", T.is_red(F.col("p_partkey") * 37 % 256, F.col("p_partkey") * 91 % 200, F.col("p_size") * 3).alias("red"))


@query(f"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), {S.re2(X.SECTIONS[0][1])}) THEN {S.lit(X.SECTIONS[0][0])} WHEN regexp_matches(lower(text), {S.re2(X.SECTIONS[1][1])}) THEN {S.lit(X.SECTIONS[1][0])} WHEN len(regexp_extract_all(text, {S.re2(X.CLOZE_BLANK)})) >= 2 THEN {S.lit(X.CLOZE_SECTION)} WHEN regexp_matches(lower(text), {S.re2(X.SECTIONS[2][1])}) THEN {S.lit(X.SECTIONS[2][0])} WHEN regexp_matches(lower(text), {S.re2(X.SECTIONS[3][1])}) THEN {S.lit(X.SECTIONS[3][0])} ELSE {S.lit(X.DEFAULT_SECTION)} END AS section FROM conversations")
def exam_section(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.exam_section(F.col("text")).alias("section"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.key'), json_extract_string(props, '$.k')) AS k FROM events")
def json_props_coalesce(spark, d):
    return table(spark, d, "events").select("event_id", T.first_present(F.try_parse_json("props"), ("key", "k")).alias("k"))


@query(f"SELECT conv_id, turn, {S.knowledge_statement('text')} AS statement FROM conversations WHERE role = 'assistant'")
def knowledge_statement(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", T.knowledge_statement(F.col("text")).alias("statement"))


@query(f"""
SELECT p_partkey, ['A', 'B', 'C', 'D'] AS labels, [a, b, c, e] AS choices, 'Which part is ' || p_partkey || '?' AS stem
FROM (SELECT p_partkey, p_name AS a, p_brand AS b, p_type AS c, CAST(p_size AS VARCHAR) AS e FROM part)""")
def choice_parse(spark, d):
    p = table(spark, d, "part")
    block = F.concat(F.lit("Which part is "), F.col("p_partkey").cast("string"), F.lit("?\nA. "), "p_name", F.lit(" B) "), "p_brand", F.lit("\n- C: "), "p_type", F.lit("\n(d) "), F.col("p_size").cast("string"))
    return p.select("p_partkey", T.choice_block(block).alias("b")).select("p_partkey", "b.labels", "b.choices", "b.stem")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'C' ELSE '' END AS label, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE 'The answer is not known yet' END AS answer FROM part")
def answer_labels(spark, d):
    p = table(spark, d, "part")
    said = F.when(F.col("p_partkey") % 3 == 0, "The correct answer is **B** because").when(F.col("p_partkey") % 3 == 1, "答案：c。解析：").otherwise("The answer is not known yet")
    return p.select("p_partkey", T.answer_label(said).alias("label"), T.resolve_answer(said, F.array("p_name", "p_brand", "p_type")).alias("answer"))


# --- schedule and views --------------------------------------------------------------------


@query(f"WITH RECURSIVE {S.FOLD} SELECT * FROM f")
def review_fold(spark, d):
    return records(spark, d)


_POINTS = "SELECT c_custkey AS point_id, c_name AS name FROM customer"


def _joined(spark, d):
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_name").alias("name"))
    return review.with_records(points, records(spark, d))


@query(f"WITH RECURSIVE {S.FOLD} SELECT point_id, coalesce(stage, 0) AS stage, coalesce(attempts, 0) AS attempts FROM ({_POINTS}) p LEFT JOIN f USING (point_id) WHERE nextReviewAt IS NULL OR coalesce(attempts, 0) = 0 OR nextReviewAt <= {NOW_MS}")
def due_points(spark, d):
    return review.due(_joined(spark, d), NOW_MS).select("point_id", "stage", "attempts")


@query(f"WITH RECURSIVE {S.FOLD} SELECT point_id, coalesce(nextReviewAt, 0) AS due_at FROM ({_POINTS}) p LEFT JOIN f USING (point_id) ORDER BY due_at, point_id LIMIT 100")
def review_queue(spark, d):
    return review.queue(_joined(spark, d), limit=100).select("point_id", "due_at")


@query(f"WITH RECURSIVE {S.FOLD} SELECT point_id, coalesce(nextReviewAt, 0) AS due_at FROM ({_POINTS}) p LEFT JOIN f USING (point_id) ORDER BY due_at, point_id")
def review_queue_all(spark, d):
    return review.queue(_joined(spark, d)).select("point_id", "due_at")


@query(f"WITH RECURSIVE {S.FOLD} SELECT min(nextReviewAt) AS next_review FROM f WHERE nextReviewAt > {NOW_MS}")
def next_review(spark, d):
    return records(spark, d).where(F.col("nextReviewAt") > NOW_MS).agg(F.min("nextReviewAt").alias("next_review"))


@query(f"SELECT point_id, ts_ms, ord, correct FROM ({S.ATTEMPTS}) QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY ts_ms DESC, ord) = 1")
def latest_attempt(spark, d):
    return ordered.latest(attempts(spark, d), "point_id", "ts_ms", "ord")


@query(f"WITH a AS ({S.ATTEMPTS}), l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY ts_ms DESC, ord) = 1) SELECT point_id, name, ts_ms FROM ({_POINTS}) p JOIN l USING (point_id) WHERE NOT correct")
def wrong_points(spark, d):
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_name").alias("name"))
    last = ordered.latest(attempts(spark, d), "point_id", "ts_ms", "ord").where("not correct")
    return points.join(last, "point_id").select("point_id", "name", "ts_ms")


@query(f"SELECT point_id, count(*) FILTER (correct) AS n_correct, count(*) AS n_attempts, CAST(floor(100.0::DOUBLE * count(*) FILTER (correct) / count(*) + 0.5) AS BIGINT) AS accuracy FROM ({S.ATTEMPTS}) GROUP BY point_id")
def accuracy(spark, d):
    return review.accuracy(attempts(spark, d), "point_id")


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role = 'system') AS n_system FROM conversations GROUP BY conv_id")
def source_counts(spark, d):
    count = lambda role: F.count_if(F.col("role") == role).alias(f"n_{role}")
    return table(spark, d, "conversations").groupBy("conv_id").agg(count("user"), count("assistant"), count("system"))


@query(f"WITH RECURSIVE {S.FOLD} SELECT count(*) AS points, count(*) FILTER (nextReviewAt <= {NOW_MS}) AS due, count(*) FILTER (NOT lastCorrect) AS wrong, CAST(floor(100.0::DOUBLE * sum(correct) / sum(attempts) + 0.5) AS BIGINT) AS accuracy FROM f")
def dashboard(spark, d):
    r = records(spark, d)
    return r.agg(F.count("*").alias("points"), F.count_if(F.col("nextReviewAt") <= NOW_MS).alias("due"), F.count_if(~F.col("lastCorrect")).alias("wrong"), T.percentage(F.sum("correct"), F.sum("attempts")).cast("bigint").alias("accuracy"))


@query(f"SELECT point_id, ts_ms, ord, correct FROM ({S.ATTEMPTS}) ORDER BY ts_ms DESC, ord DESC LIMIT {X.RECENT_ATTEMPTS}")
def recent_attempts_500(spark, d):
    return review.recent(attempts(spark, d))


# --- keys, joins and sets -------------------------------------------------------------------


@query(f"SELECT doc_id, source FROM (SELECT *, {S.key('text')} AS k FROM documents) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1")
def first_wins_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5(T.key(F.col("text"))).alias("k"))
    return ordered.first_wins(docs, "k", "doc_id").drop("k")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, event_id % 2 AS side FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000 // 3600000 DESC, side, event_id) = 1")
def keep_latest_merge(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", F.floor(T.epoch_ms(F.col("ts")) / X.HOUR_MS).alias("hour"))
    merged = ordered.keep_latest_merge(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "hour", "event_id")
    return merged.drop("hour")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def new_points_anti(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_name").join(used, "p_partkey", "left_anti")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def eligible_semi(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_semi")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority LIKE '1%'")
def lookup_inner(spark, d):
    orders = table(spark, d, "orders").where("o_orderpriority like '1%'")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    return orders.select("o_orderkey", "o_custkey").join(customers, "o_custkey").join(table(spark, d, "nation"), "n_nationkey").select("o_orderkey", "c_name", "n_name")


@query("SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def records_left(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("SELECT p_type AS subject, p_brand AS category, row_number() OVER (PARTITION BY p_type ORDER BY p_brand) AS place FROM (SELECT DISTINCT p_type, p_brand FROM part)")
def distinct_categories_sorted(spark, d):
    pairs = table(spark, d, "part").select(F.col("p_type").alias("subject"), F.col("p_brand").alias("category")).distinct()
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("subject").orderBy("category")).cast("bigint"))


@query("SELECT answer, min(ord) AS ord FROM (SELECT p_name AS answer, p_partkey AS ord FROM part UNION ALL SELECT n_name, 1000000000 + n_nationkey FROM nation) GROUP BY answer")
def union_pool(spark, d):
    a = table(spark, d, "part").select(F.col("p_name").alias("answer"), F.col("p_partkey").alias("ord"))
    b = table(spark, d, "nation").select(F.col("n_name").alias("answer"), (F.lit(1_000_000_000) + F.col("n_nationkey")).cast("bigint").alias("ord"))
    return ordered.first_wins(a.unionByName(b), "answer", "ord")


@query("SELECT p_name AS answer FROM part WHERE p_type = 'SMALL' EXCEPT SELECT p_name FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def pool_difference(spark, d):
    p = table(spark, d, "part")
    names = lambda rows: rows.select(F.col("p_name").alias("answer"))
    return names(p.where("p_type = 'SMALL'")).subtract(names(p.where("p_brand in ('Brand#1', 'Brand#2', 'Brand#3')")))


@query("SELECT p_name AS answer FROM part WHERE p_type = 'SMALL' INTERSECT SELECT p_name FROM part WHERE p_type = 'LARGE'")
def pool_intersection(spark, d):
    p = table(spark, d, "part")
    names = lambda t: p.where(F.col("p_type") == t).select(F.col("p_name").alias("answer"))
    return names("SMALL").intersect(names("LARGE"))


# --- similarity and grading -----------------------------------------------------------------

_PAIRS = "SELECT a.p_partkey AS k, a.p_name || ' stores ' || a.p_type || ' ' || a.p_size AS e, CASE WHEN a.p_partkey % 2 = 0 THEN a.p_name || ' keeps ' || b.p_type || ' ' || a.p_size ELSE b.p_name || ' ' || b.p_type || ' ' || b.p_size END AS s FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


def _answer_pairs(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("n"), F.col("p_type").alias("t"), F.col("p_size").alias("z"))
    e = F.concat_ws(" ", "p_name", F.lit("stores"), "p_type", "p_size")
    near, far = F.concat_ws(" ", "p_name", F.lit("keeps"), "t", "p_size"), F.concat_ws(" ", "n", "t", "z")
    return p.join(b, "p_partkey").select(F.col("p_partkey").alias("k"), e.alias("e"), F.when(F.col("p_partkey") % 2 == 0, near).otherwise(far).alias("s"))


@query(f"SELECT k, {S.dice(S.bigrams('x'), S.bigrams('y'))} AS dice, {S.coverage(S.units('x'), S.units('y'))} AS coverage FROM (SELECT k, replace(lower(e), ' ', '') AS x, replace(lower(s), ' ', '') AS y FROM ({_PAIRS}))")
def dice_bigram(spark, d):
    p = _answer_pairs(spark, d).select("k", F.replace(F.lower("e"), F.lit(" "), F.lit("")).alias("x"), F.replace(F.lower("s"), F.lit(" "), F.lit("")).alias("y"))
    return p.select("k", M.dice(M.bigrams(F.col("x")), M.bigrams(F.col("y"))).alias("dice"), M.coverage(M.units(F.col("x")), M.units(F.col("y"))).alias("coverage"))


@query(f"SELECT k, list_sort({S.units('lower(e)')}) AS units FROM ({_PAIRS})")
def coverage_units(spark, d):
    return _answer_pairs(spark, d).select("k", F.array_sort(F.array_distinct(M.units(F.lower("e")))).alias("units"))


@query(f"""SELECT k, CASE WHEN a = '' OR b = '' THEN 0.0::DOUBLE WHEN a = b THEN 1.0::DOUBLE WHEN contains(a, b) THEN length(b)::DOUBLE / length(a) WHEN contains(b, a) THEN length(a)::DOUBLE / length(b) * 0.9::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM (SELECT k, {S.structure_key('e')} AS a, {S.structure_key("split_part(s, ' ', 1)")} AS b FROM ({_PAIRS}))""")
def match_score(spark, d):
    return _answer_pairs(spark, d).select("k", M.match_score(F.col("e"), F.split("s", " ")[0]).alias("score"))


_WE, _WS, _WD, _WB, _WL = (f"{w}::DOUBLE" for w in X.SIMILARITY_WEIGHTS)
_GE, _GS, _GB = (f"{g}::DOUBLE" for g in X.SIMILARITY_GATES)
_SIMILAR = f"""
m AS (SELECT k, e AS e0, s AS s0, {S.meaning('e')} AS e, {S.meaning('s')} AS s FROM ({_PAIRS})),
u AS (SELECT *, {S.units('e')} AS ue, {S.units('s')} AS us, {S.bigrams('e')} AS be, {S.bigrams('s')} AS bs, regexp_extract_all(e, '[+-]?\\d+(?:\\.\\d+)?') AS ne, regexp_extract_all(s, '[+-]?\\d+(?:\\.\\d+)?') AS ns,
             regexp_extract_all(e, '[<>≤≥=]-?\\d+(?:\\.\\d+)?') AS ge FROM m),
p AS (SELECT *, {S.coverage('ue', 'us')} AS ce, {S.coverage('us', 'ue')} AS cs, {S.dice('ue', 'us')} AS du, {S.dice('be', 'bs')} AS db, least(length(e), length(s))::DOUBLE / greatest(length(e), length(s)) AS lr,
             (contains(e, 'ram') <> contains(e, 'rom')) AND (contains(s, 'ram') <> contains(s, 'rom')) AND (contains(e, 'ram') <> contains(s, 'ram')) AS opposite FROM u),
r AS (SELECT k, e0, s0, CASE WHEN e = '' OR s = '' THEN 0.0::DOUBLE WHEN e = s THEN 1.0::DOUBLE WHEN opposite OR ne <> ns OR least(length(e), length(s)) < 4 THEN 0.0::DOUBLE
             WHEN ce < {_GE} OR cs < {_GS} OR (NOT contains(e, s) AND NOT contains(s, e) AND db < {_GB}) THEN 0.0::DOUBLE
             ELSE floor((ce * {_WE} + cs * {_WS} + du * {_WD} + db * {_WB} + lr * {_WL}) * 1000 + 0.5) / 1000 END AS similarity FROM p)"""


@query(f"WITH {_SIMILAR} SELECT k, similarity FROM r")
def meaning_similarity(spark, d):
    folded = _answer_pairs(spark, d).select("k", T.nfkc(F.col("s")).alias("s"), T.nfkc(F.col("e")).alias("e"))
    return folded.select("k", M.meaning_similarity(F.col("s"), F.col("e")).alias("similarity"))


@query(f"WITH {_SIMILAR} SELECT k, CASE WHEN e0 = s0 THEN 'correct' WHEN similarity >= {X.CONFIRM_SIMILARITY} THEN 'needs-confirmation' ELSE 'incorrect' END AS verdict, CASE WHEN e0 = s0 THEN 1.0::DOUBLE ELSE similarity END AS similarity FROM r")
def grade_single(spark, d):
    folded = _answer_pairs(spark, d).select("k", T.nfkc(F.col("s")).alias("s"), T.nfkc(F.col("e")).alias("e"))
    return folded.select("k", M.grade_single(F.col("s"), F.col("e"), F.lit(False)).alias("g")).select("k", "g.verdict", "g.similarity")


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'correct' WHEN p_name = p_brand THEN 'correct' ELSE 'incorrect' END AS verdict, CASE WHEN p_partkey % 2 = 0 THEN {S.lit(X.REASONS['parts'])} ELSE {S.lit(X.REASONS['wrong'])} END AS reason FROM part")
def grade_answer(spark, d):
    p = table(spark, d, "part")
    given = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("；", "p_name", "p_brand")).otherwise(F.concat_ws(";", "p_brand", "p_name"))
    folded = p.select("p_partkey", "p_name", "p_brand", T.nfkc(given).alias("given"))
    g = M.grade_answer(F.col("given"), F.lit(""), F.array("p_name", "p_brand"), F.lit("fill"))
    return folded.select("p_partkey", g.alias("g")).select("p_partkey", "g.verdict", "g.reason")


# --- classifier -------------------------------------------------------------------------------

_DOC = "SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents"
_BLANK = f"{S.trim('t')} = ''"
_SCORES = ", ".join(f"{S.subject_score('t', s)} AS s{k}" for k, s in enumerate(C.SUBJECTS[:4]))
_CLASSIFIED = f"""
sc AS (SELECT doc_id, t, {_SCORES}, len(regexp_extract_all(t, '[a-z]+(?:''[a-z]+)?')) AS words, len(regexp_extract_all(t, '[a-z]')) AS letters, len(regexp_extract_all(t, {S.re2(C.COMMON_WORDS)})) AS common,
              len(regexp_extract_all(t, '[㐀-鿿]')) AS han FROM ({_DOC})),
bo AS (SELECT doc_id, t, s1, s2, s3, s0 + CASE WHEN greatest(s1, s2, s3) < 4.5 AND words >= 4 AND letters::DOUBLE / greatest(letters + han, 1) >= 0.42::DOUBLE THEN 2.8::DOUBLE ELSE 0.0::DOUBLE END
              + CASE WHEN greatest(s1, s2, s3) < 4.5 AND common >= 2 THEN least(2.4::DOUBLE, common * 0.4::DOUBLE) ELSE 0.0::DOUBLE END AS s0 FROM sc),
ra AS (SELECT *, list_sort([s0, s1, s2, s3], 'DESC') AS ranked, CASE greatest(s0, s1, s2, s3) WHEN s0 THEN 0 WHEN s1 THEN 1 WHEN s2 THEN 2 ELSE 3 END AS k FROM bo)"""


@query(f"WITH {_CLASSIFIED} SELECT doc_id, CASE WHEN {_BLANK} OR ranked[1] < 2.5 THEN {S.lit(C.OTHER)} ELSE ([{', '.join(map(S.lit, C.SUBJECTS))}])[k + 1] END AS subject, CASE WHEN {_BLANK} THEN 0.2::DOUBLE WHEN ranked[1] < 2.5 THEN 0.35::DOUBLE ELSE floor(least(0.98::DOUBLE, greatest(0.5::DOUBLE, 0.55::DOUBLE + (ranked[1] - ranked[2]) / greatest(4.0::DOUBLE, ranked[1] + 2) * 0.4::DOUBLE)) * 100 + 0.5) / 100 END AS confidence FROM ra")
def classify_subject(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return C.classify(docs).select("doc_id", "classification.subject", "classification.confidence")


@query(f"WITH {_CLASSIFIED} SELECT doc_id, CASE WHEN {_BLANK} OR ranked[1] < 2.5 THEN {S.lit(C.FALLBACK_CATEGORY)} ELSE CASE k {' '.join(f'WHEN {k} THEN {S.category(chr(116), s)}' for k, s in enumerate(C.SUBJECTS[:4]))} END END AS category FROM ra")
def classify_category(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return C.classify(docs).select("doc_id", "classification.category")


@query(S.rules())
def rules_dimension(spark, d):
    return C.rules_table(spark)


# --- question banks ---------------------------------------------------------------------------


def _answers(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("subject"), F.col("p_brand").alias("category"), F.col("p_name").alias("answer"), F.col("p_partkey").alias("ord"))


_DISTINCT = "SELECT p_name AS answer, min(p_partkey) AS ord FROM part GROUP BY p_name"


@query(f"WITH a AS ({_DISTINCT}), r AS (SELECT a.answer, b.answer AS other, row_number() OVER (PARTITION BY a.answer ORDER BY abs(length(a.answer) - length(b.answer)), b.ord) AS k FROM a JOIN a b ON a.answer <> b.answer) SELECT answer, list(other ORDER BY k) AS distractors FROM r WHERE k <= 3 GROUP BY answer")
def distractors_top3(spark, d):
    return questions.distractors_by_length(_answers(spark, d).select("answer", "ord"))


_SHAPE = "CASE WHEN regexp_matches(trim({0}), '^-?\\d+(?:\\.\\d+)?%?$') THEN 'number' WHEN regexp_matches(trim({0}), '(?i)^[a-z][a-z'' -]*$') THEN 'english' ELSE 'mixed' END"
_RANKED = f"""
po AS (SELECT p_type AS subject, p_brand AS category, p_name AS answer, min(p_partkey) AS ord FROM part GROUP BY ALL),
ca AS (SELECT t.subject, t.category, t.answer, c.answer AS other, min(({_SHAPE.format('t.answer')} <> {_SHAPE.format('c.answer')})::INT) AS s, min(abs(length(t.answer) - length(c.answer))) AS l, min(((c.category <> t.category)::INT, c.ord)) AS po
       FROM po t JOIN po c ON t.subject = c.subject AND t.answer <> c.answer GROUP BY ALL),
di AS (SELECT subject, category, answer, list(other ORDER BY k) AS distractors FROM (SELECT *, row_number() OVER (PARTITION BY subject, category, answer ORDER BY s, l, po) AS k FROM ca) WHERE k <= 3 GROUP BY ALL)"""


@query(f"WITH {_RANKED} SELECT * FROM di")
def distractors_shape_top3(spark, d):
    pool = questions.answer_pool(_answers(spark, d))
    return questions.ranked_distractors(pool, pool)


@query(f"""WITH {_RANKED} SELECT 'document-choice-' || p_partkey || '-0' AS id, list_sort(list_prepend(p_name, distractors)) AS options, p_type AS subject, p_brand AS "knowledgeCategory"
FROM part JOIN di ON subject = p_type AND category = p_brand AND answer = p_name WHERE len(distractors) = 3""")
def question_bank(spark, d):
    """Document questions of parts, the choices compared as sets."""
    p = table(spark, d, "part")
    points = p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("text"), F.array("p_name").alias("answerParts"), F.lit(None).cast("string").alias("question"), F.lit("").alias("context"), F.lit("").alias("explanation"),
        F.col("p_brand").alias("sourceName"), F.col("p_partkey").cast("string").alias("location"), F.col("p_type").alias("subject"), F.col("p_brand").alias("category"), F.col("p_partkey").alias("ord"), F.lit("pdf-color").alias("method"),
    )
    pool = questions.answer_pool(_answers(spark, d))
    return questions.point_questions(points, pool).select("id", F.array_sort("choices").alias("options"), "subject", "knowledgeCategory")


_LCG = f"(state * {X.LCG_FACTOR} + {X.LCG_STEP}) & 4294967295"


@query(f"""
WITH RECURSIVE b AS (SELECT p_type || p_brand AS seed, list(p_partkey ORDER BY p_partkey) AS v FROM part GROUP BY ALL),
h AS (SELECT seed, v, list_reduce(list_prepend({X.FNV_START}::BIGINT, list_transform(string_split(seed, ''), lambda c: ord(c)::BIGINT)), lambda x, c: (xor(x, c) * {X.FNV_PRIME}) & 4294967295) AS state FROM b),
r AS (SELECT seed, v, state, len(v) AS i FROM h
  UNION ALL SELECT seed, list_transform(v, lambda x, k: CASE WHEN k = i THEN v[j + 1] WHEN k = j + 1 THEN v[i] ELSE x END), s, i - 1
  FROM (SELECT seed, v, i, {_LCG} AS s, ({_LCG}) % i AS j FROM r WHERE i > 1))
SELECT seed, v AS shuffled FROM r WHERE i = 1""")
def seeded_shuffle(spark, d):
    p = table(spark, d, "part")
    lists = p.groupBy(F.concat("p_type", "p_brand").alias("seed")).agg(F.array_sort(F.collect_list("p_partkey")).alias("v"))
    return lists.select("seed", H.seeded_shuffle(F.col("v"), F.col("seed")).alias("shuffled"))


_EXAM = f"""{_RANKED},
ba AS (SELECT 'document-choice-' || p_partkey || '-0' AS id, p_partkey, list_prepend(p_name, distractors) AS v FROM part JOIN di ON subject = p_type AND category = p_brand AND answer = p_name WHERE len(distractors) = 3),
{S.shuffled('drawn', "SELECT 'seed' AS seed, list(id ORDER BY p_partkey) AS v FROM ba")},
ex AS (SELECT unnest(range(20)) AS place, unnest(v[1:20]) AS id FROM drawn WHERE i = 1),
{S.shuffled('first', 'SELECT id AS seed, v FROM ba JOIN ex USING (id)')},
{S.shuffled('second', "SELECT 'seed-' || seed AS seed, v FROM first WHERE i = 1")}"""


@query(f"WITH RECURSIVE {_EXAM} SELECT CAST(place AS BIGINT) AS place, id, v AS choices FROM ex JOIN second ON seed = 'seed-' || id WHERE i = 1")
def exam_select(spark, d):
    p = table(spark, d, "part")
    pool = questions.answer_pool(_answers(spark, d))
    asked = p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("text"), F.array("p_name").alias("answerParts"), F.lit(None).cast("string").alias("question"), F.lit("").alias("context"), F.lit("").alias("explanation"),
        F.col("p_brand").alias("sourceName"), F.col("p_partkey").cast("string").alias("location"), F.col("p_type").alias("subject"), F.col("p_brand").alias("category"), F.col("p_partkey").alias("ord"),
    )
    return questions.select_exam(questions.point_questions(asked, pool), 20, "seed").select(F.col("place").cast("bigint").alias("place"), "id", "choices")


# --- document structure ------------------------------------------------------------------------

_LINES = "SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)"


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query(f"""WITH l AS ({_LINES}), k AS (SELECT doc_id, line_no, {S.tidy('line')} AS shown, {S.structure_key('line')} AS key, doc_id // 10 AS grp FROM l),
c AS (SELECT grp, key, count(DISTINCT doc_id) AS places FROM k GROUP BY ALL)
SELECT k.doc_id, CAST(line_no AS BIGINT) AS line_no, shown = '' OR (line_no <= 1 AND length(k.key) >= 3 AND places >= 2) AS furniture FROM k JOIN c ON k.grp = c.grp AND k.key = c.key""")
def furniture_lines(spark, d):
    """Ten documents make a file, each of them a location."""
    lines = _lines(spark, d).select(F.floor(F.col("doc_id") / 10).alias("grp"), "doc_id", "line_no", F.col("line").alias("text"), F.lit(None).cast("string").alias("red_text"), F.col("doc_id").cast("string").alias("location"))
    lines = lines.withColumn("at", F.struct("doc_id", "line_no"))
    return ordered.furniture(lines, "grp", "at").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "furniture")


@query(f"""WITH l AS ({_LINES}), m AS (SELECT doc_id, line_no, ends_with(line, '.') AS blank, contains(line, ',') AS red FROM l),
w AS (SELECT *, max(CASE WHEN blank THEN line_no END) OVER p AS c, max(CASE WHEN red THEN line_no END) OVER p AS r FROM m WINDOW p AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, coalesce(blank AND (c IS NULL OR r >= c), false) AS start FROM w""")
def question_starts(spark, d):
    """Lines that end in a full stop stand for lines with blanks, lines with a comma for red ones."""
    line = F.col("line")
    marked = ordered.question_starts(_lines(spark, d), numbered=F.lit(False), blanks=line.endswith("."), red=F.contains(line, F.lit(",")))
    return marked.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "start")


@query(f"""WITH f AS (SELECT doc_id, unnest([0, 1]) AS ord, unnest([split_part(text, '.', 2), split_part(text, '.', 3)]) AS raw FROM documents), l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS line_no, {S.tidy('line')} AS line FROM ({_LINES}) WHERE {S.tidy('line')} <> ''),
s AS (SELECT f.doc_id, f.ord, l.line_no, {S.structure_key('line')} AS a, {S.structure_key('raw')} AS b FROM f JOIN l ON f.doc_id = l.doc_id WHERE {S.tidy('raw')} <> ''),
g AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0.0::DOUBLE WHEN a = b THEN 1.0::DOUBLE WHEN contains(a, b) THEN length(b)::DOUBLE / length(a) WHEN contains(b, a) THEN length(a)::DOUBLE / length(b) * 0.9::DOUBLE ELSE 0.0::DOUBLE END AS score FROM s)
SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(line_no AS BIGINT) AS line_no FROM g WHERE score >= {X.FRAGMENT_MIN_SCORE}::DOUBLE QUALIFY row_number() OVER (PARTITION BY doc_id, ord ORDER BY score DESC, line_no) = 1""")
def tag_fragments(spark, d):
    """The second and third sentence of each document, found again among its lines."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("full_text"))
    sentence = F.split("full_text", r"\.")
    wanted = docs.select("doc_id", F.posexplode(F.array(F.get(sentence, 1), F.get(sentence, 2))).alias("ord", "fragment"))
    wanted = wanted.select("doc_id", F.col("ord").cast("bigint").alias("ord"), T.tidy(F.coalesce("fragment", F.lit(""))).alias("fragment")).where("fragment <> ''")
    split = F.filter(F.transform(F.split(T.tidy(F.col("full_text")), r"\n+"), T.tidy), lambda x: x != "")
    lines = docs.select("doc_id", F.posexplode(split).alias("line_no", "text"))
    return structure.best_lines(wanted, lines).select("doc_id", "ord", F.col("line_no").cast("bigint").alias("line_no"))


@query()
def tag_all_fragments(spark, d):
    """All lines of each document, tagged with all of its sentences."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("full_text"))
    sentences = docs.select("doc_id", F.posexplode(F.split("full_text", r"\.")).alias("ord", "fragment"))
    return structure.tag_fragments(docs, sentences).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "text", "red_text")


# --- page geometry -------------------------------------------------------------------------------

_ITEMS = "SELECT l_orderkey AS page, l_linenumber AS idx, 'item ' || l_linenumber AS text, l_quantity AS x, l_tax * 1000 AS y, l_discount * 100 AS width, 10.0::DOUBLE AS height FROM lineitem"
_MARKS = "SELECT o_orderkey AS page, 'item ' || (o_custkey % 7 + 1) AS text, (o_custkey % 50)::DOUBLE AS x, (o_custkey % 81)::DOUBLE AS y FROM orders"


def _items(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.lit(0).cast("bigint").alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), F.concat(F.lit("item "), F.col("l_linenumber").cast("string")).alias("text"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 1000).alias("y"), (F.col("l_discount") * 100).alias("width"), F.lit(10.0).alias("height"))


@query(f"""WITH i AS ({_ITEMS}), m AS ({_MARKS}),
s AS (SELECT m.page, i.idx, abs(i.y - m.y) * 3 + greatest(0.0::DOUBLE, i.x - m.x, m.x - (i.x + i.width)) + CASE WHEN i.text = m.text THEN 0 ELSE 8 END AS score FROM m JOIN i ON m.page = i.page
      WHERE abs(i.y - m.y) <= 5.5 AND m.x >= i.x - 4.5 AND m.x <= i.x + i.width + 4.5)
SELECT page, idx, score FROM s QUALIFY row_number() OVER (PARTITION BY page ORDER BY score, idx) = 1 AND score < {X.MARK_MAX_SCORE}""")
def nearest_mark(spark, d):
    o = table(spark, d, "orders")
    marks = o.select(F.lit(0).cast("bigint").alias("doc_id"), F.col("o_orderkey").alias("page"), F.lit(0).alias("mark"), F.concat(F.lit("item "), (F.col("o_custkey") % 7 + 1).cast("string")).alias("text"), (F.col("o_custkey") % 50).cast("double").alias("x"), (F.col("o_custkey") % 81).cast("double").alias("y"))
    return pages.nearest_items(marks, _items(spark, d)).select("page", "idx", "score")


@query(f"""WITH i AS ({_ITEMS}), r AS (SELECT o_orderkey AS page, (o_custkey % 40)::DOUBLE AS x1, (o_custkey % 70)::DOUBLE AS y1, (o_custkey % 40)::DOUBLE + 8 AS x2, (o_custkey % 70)::DOUBLE + 12 AS y2 FROM orders)
SELECT page, idx FROM i WHERE EXISTS (SELECT 1 FROM r WHERE r.page = i.page AND i.x + greatest(i.width, i.height * 0.4::DOUBLE) >= x1 AND i.x <= x2 AND i.y + i.height * 0.3::DOUBLE >= y1 AND i.y - i.height <= y2)""")
def rect_overlap(spark, d):
    o = table(spark, d, "orders")
    x, y = (F.col("o_custkey") % 40).cast("double"), (F.col("o_custkey") % 70).cast("double")
    rectangles = o.select(F.lit(0).cast("bigint").alias("doc_id"), F.col("o_orderkey").alias("page"), x.alias("x1"), y.alias("y1"), (x + 8).alias("x2"), (y + 12).alias("y2"))
    return pages.items_under(rectangles, _items(spark, d)).select("page", "idx")


# --- the store -----------------------------------------------------------------------------------


@query("""SELECT 'points' AS name, CAST(c_custkey AS VARCHAR) AS id, count(*) AS n FROM customer WHERE c_custkey % 7 <> 0 GROUP BY ALL
UNION ALL SELECT 'attempts', CAST(user_id AS VARCHAR), count(*) FROM events WHERE NOT (user_id % 7 = 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id)) GROUP BY ALL""")
def cascading_delete(spark, d):
    """Every seventh point goes, and its attempts with it."""
    points = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    tries = table(spark, d, "events").select(F.col("user_id").cast("string").alias("pointId"))
    left = store.delete_points({"points": points, "attempts": tries}, points.where("cast(id as bigint) % 7 = 0"))
    named = [left[name].select(F.lit(name).alias("name"), F.col(key).alias("id")) for name, key in (("points", "id"), ("attempts", "pointId"))]
    return named[0].unionByName(named[1]).groupBy("name", "id").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0 OR EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)""")
def delete_keeps_history(spark, d):
    """Every fifth learning item goes; points that were tried stay."""
    customer = table(spark, d, "customer")
    point = F.concat(F.lit(T.ITEM_POINT), F.col("c_custkey").cast("string"))
    tries = table(spark, d, "events").select(F.concat(F.lit(T.ITEM_POINT), F.col("user_id").cast("string")).alias("pointId"))
    items = customer.select(F.col("c_custkey").cast("string").alias("id"))
    tables = {"items": items, "points": customer.select(point.alias("id")), "records": customer.select(point.alias("pointId")), "attempts": tries}
    left = store.remove_items(tables, items.where("cast(id as bigint) % 5 = 0"))["points"]
    return left.select(F.substring("id", len(T.ITEM_POINT) + 1, 20).cast("bigint").alias("id"))


def _sessions(spark, d):
    """A session for each event: up to four questions, a place that may lie outside, results that may be too few."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    asked = F.transform(F.when(k % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), k % 5)), lambda q: F.struct(q.cast("string").alias("id"), (q % 3).cast("string").alias("pointId")))
    results = F.when(k % 4 == 0, F.array().cast("array<boolean>")).otherwise(F.transform(F.sequence(F.lit(1).cast("bigint"), k % 4), lambda q: q % 2 == 1))
    session = F.struct(
        asked.alias("questions"), (k % 6 - 1).cast("int").alias("questionIndex"), F.lit("typed").alias("answer"), (k % 2 == 0).alias("checked"), (k % 3 == 0).alias("lastCorrect"),
        F.struct(F.when(k % 8 < 4, "needs-confirmation").otherwise("correct").alias("verdict")).alias("pendingGrade"), F.when(k % 3 == 1, "today").otherwise("other").alias("quizMode"), results.alias("sessionResults"),
    )
    return e.select("event_id", session.alias("session"))


_SESSION = """
s AS (SELECT event_id, event_id % 5 AS n, CASE WHEN event_id % 6 - 1 BETWEEN 0 AND event_id % 5 - 1 THEN event_id % 6 - 1 ELSE 0 END AS place, event_id % 2 = 0 AS checked, event_id % 2 = 0 AND event_id % 8 < 4 AS waits, event_id % 4 AS results FROM events),
t AS (SELECT *, place + (checked AND NOT waits)::INT AS done FROM s),
u AS (SELECT *, done = 0 OR results >= done AS goes_on FROM t WHERE n > 0)"""


@query(f"""WITH {_SESSION} SELECT event_id, CASE WHEN goes_on THEN place ELSE 0 END AS place, CASE WHEN goes_on THEN 'typed' ELSE '' END AS answer, goes_on AND checked AS checked, CASE WHEN goes_on THEN event_id % 3 = 0 END AS last_correct,
goes_on AND waits AS waits, CASE WHEN event_id % 3 = 1 THEN 'today' ELSE 'study' END AS mode, CASE WHEN goes_on AND results >= done THEN done ELSE 0 END AS results FROM u""")
def session_resume(spark, d):
    found = _sessions(spark, d).select("event_id", store.resume_session(F.col("session")).alias("r")).where("r is not null")
    return found.select(
        "event_id", F.col("r.questionIndex").cast("bigint").alias("place"), "r.answer", "r.checked", F.col("r.lastCorrect").alias("last_correct"), F.col("r.pendingGrade").isNotNull().alias("waits"), F.col("r.quizMode").alias("mode"), F.size("r.sessionResults").cast("bigint").alias("results")
    )


@query("""WITH s AS (SELECT event_id, event_id % 5 AS n, event_id % 6 - 1 AS place, event_id % 4 AS results FROM events),
g AS (SELECT *, (n >= 1)::INT + (n >= 4)::INT AS gone, (n >= 1 AND 0 < place)::INT + (n >= 4 AND 3 < place)::INT AS before FROM s)
SELECT event_id, n - gone AS n, CASE WHEN gone = 0 THEN place WHEN before > 0 THEN greatest(0, place - before) ELSE least(place, n - gone) END AS place,
       results - CASE WHEN gone = 0 THEN 0 ELSE (n >= 1 AND results >= 1)::INT + (n >= 4 AND results >= 4)::INT END AS results FROM g""")
def session_after_delete(spark, d):
    """Point 1, of the first and the fourth question, is deleted."""
    left = _sessions(spark, d).select("event_id", store.session_without(F.col("session"), F.lit("1")).alias("s"))
    return left.select("event_id", F.size("s.questions").cast("bigint").alias("n"), F.col("s.questionIndex").cast("bigint").alias("place"), F.size("s.sessionResults").cast("bigint").alias("results"))


@query(f"""SELECT o_orderkey, greatest({X.MIN_RASTER_SCALE}::DOUBLE, least({X.MAX_RASTER_SCALE}::DOUBLE, sqrt({X.MAX_RASTER_PIXELS}.0::DOUBLE / greatest(1.0::DOUBLE, CAST(o_custkey * 9 AS DOUBLE) * (o_orderkey % 9000))))) AS scale FROM orders""")
def raster_scale(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", pages.raster_scale(F.col("o_custkey") * 9, F.col("o_orderkey") % 9000).alias("scale"))


@query(f"""SELECT p_partkey, length({S.key('p_name')}) < {X.OCR_PAGE_CHARS} AND p_size % 3 <> 0 AS whole FROM part WHERE (p_partkey % 40) / 1000000.0::DOUBLE >= {X.RASTER_MIN_RED}::DOUBLE""")
def pages_to_read(spark, d):
    p = table(spark, d, "part")
    rows = p.select("p_partkey", ((F.col("p_partkey") % 40) / F.lit(1_000_000.0)).alias("red_ratio"), F.col("p_name").alias("text"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).otherwise(" - ").alias("red_text"))
    return pages.pages_to_read(rows).select("p_partkey", "whole")


@query(f"""SELECT l_orderkey AS doc_id, count(DISTINCT l_linenumber * 100 + l_suppkey % 100) AS pages, CASE WHEN count(DISTINCT l_linenumber * 100 + l_suppkey % 100) > {X.MAX_PAGES} THEN 'too many pages' END AS problem FROM lineitem GROUP BY ALL
UNION ALL SELECT -1, count(DISTINCT l_orderkey), CASE WHEN count(DISTINCT l_orderkey) > {X.MAX_PAGES} THEN 'too many pages' END FROM lineitem""")
def page_limits(spark, d):
    """Orders are documents; all orders together are one of many pages."""
    li = table(spark, d, "lineitem")
    own = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100).alias("page"))
    return pages.within_limits(own.unionByName(li.select(F.lit(-1).cast("bigint").alias("doc_id"), F.col("l_orderkey").alias("page"))))


@query()
def demo_points(spark, d):
    return store.demo_points(spark, NOW_MS)
