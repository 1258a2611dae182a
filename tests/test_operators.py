"""Ordered operators, schedule, question banks, structure and pages on small fixtures."""

import json

from pyspark.sql import functions as F

from lorequarry.operators import ordered, pages, questions, review, structure
from lorequarry.plans import queries as plans
from lorequarry.streaming import review as streaming

LINES = "doc_id int, line_no int, text string, red_text string, location string"


def lines(spark, *rows):
    return spark.createDataFrame([(1, k, *(r + (None,) * (3 - len(r)))) for k, r in enumerate(rows)], LINES)


def pairs(spark, *rows):
    return [r.asDict() for r in structure.infer_pairs(lines(spark, *rows)).orderBy("startLine").collect()]


def test_wrapped_question_with_blanks(spark):
    got = pairs(spark, ("1. 计算机由____、____和", None), ("____组成", None), ("运算器 控制器 存储器", "运算器 控制器 存储器"), ("2. 中国的首都是____", None), ("北京", "北京"))
    assert [(r["question"], r["answers"]) for r in got] == [("计算机由______、______和 ______组成", ["运算器", "控制器", "存储器"]), ("中国的首都是______", ["北京"])]
    assert got[0]["usedRedLineIndexes"] == [2] and (got[0]["startLine"], got[0]["endLine"]) == (0, 2)


def test_answer_on_the_same_line(spark):
    (got,) = pairs(spark, ("1. 首都是（ ）答案：北京", "北京"))
    assert (got["question"], got["answers"]) == ("首都是______", ["北京"])


def test_explanations(spark):
    (own,) = pairs(spark, ("1. 首都是____", None), ("北京", "北京"), ("解析：自古以来", None), ("都是", None))
    assert own["explanation"] == "自古以来 都是" and own["answers"] == ["北京"]
    (shared,) = pairs(spark, ("1. 首都是____", None), ("北京 解析：自古以来", "北京 解析：自古以来"))
    assert shared["answers"] == ["北京"] and shared["explanation"] == "自古以来"
    (bracketed,) = pairs(spark, ("1. 首都是____", None), ("北京【解析】自古", "北京【解析】自古"))
    assert bracketed["answers"] == ["北京"] and bracketed["explanation"] == "自古"


def test_counts_must_match_and_furniture_is_left_out(spark):
    assert pairs(spark, ("1. 甲____乙____", None), ("一个", "一个")) == []
    (got,) = pairs(spark, ("1. 首都是____", None), ("第 3 页", "第 3 页"), ("北京", "北京"))
    assert got["answers"] == ["北京"] and got["usedRedLineIndexes"] == [2]


def test_unnumbered_start_after_an_answer(spark):
    got = pairs(spark, ("首都是____", None), ("北京", "北京"), ("另一城市是【 】", None), ("上海", "上海"))
    assert [r["answers"] for r in got] == [["北京"], ["上海"]]


def test_repeated_header_is_furniture(spark):
    rows = [("机密文件", None, "a"), ("正文一", None, "a"), ("机密文件", None, "b"), ("正文二", None, "b")]
    got = {r["line_no"]: r["furniture"] for r in ordered.furniture(lines(spark, *rows)).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False}


def test_answer_splitting(spark):
    cases = [("甲；乙", 2, ["甲", "乙"]), ("甲、乙、丙", 3, ["甲", "乙", "丙"]), ("甲 1 乙 丙", 2, ["甲乙", "丙"]), ("一句", 1, ["一句"]), ("", 2, []), ("甲 乙 丙", 2, ["甲", "乙", "丙"]), ("甲", 2, ["甲"])]
    df = spark.createDataFrame([(k, c[0], c[1]) for k, c in enumerate(cases)], "k int, v string, n int")
    got = {r["k"]: r["p"] for r in df.select("k", structure.split_answer_parts(F.col("v"), F.col("n")).alias("p")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[2] for c in cases]


def test_points_and_new_points(spark):
    df = lines(spark, ("普通一行。另一行重点内容。结尾", "重点内容"), ("1. 首都是____", None), ("北京", "北京"))
    found = structure.points(df, F.lit("book.docx"), "docx-color", "Word 文档")
    rows = {r["text"]: r for r in found.collect()}
    assert set(rows) == {"北京", "重点内容"} and rows["北京"]["doc_id"] == 1
    assert rows["重点内容"]["context"] == "另一行重点内容。" and rows["北京"]["question"] == "首都是______"
    assert structure.new_points(found, found).count() == 0


def test_fragments_are_tagged(spark):
    texts = spark.createDataFrame([(1, "1. 首都是哪里\n中国的首都是北京\n另一行")], "doc_id int, full_text string")
    fragments = spark.createDataFrame([(1, 0, "首都是北京"), (1, 1, "不存在的内容")], "doc_id int, ord int, fragment string")
    got = [(r["text"], r["red_text"]) for r in structure.tag_fragments(texts, fragments).orderBy("line_no").collect()]
    assert got == [("1. 首都是哪里", None), ("中国的首都是北京", "中国的首都是北京"), ("另一行", None)]


def test_all_sentences_are_tagged(spark, tmp_path):
    texts = ["alpha beta gamma. delta one\ntwo three. short\nfour five six seven. eight nine ten", "1. first line here. and more\nplain", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in plans.QUERIES["tag_all_fragments"](spark, str(tmp_path)).orderBy("doc_id", "line_no").collect()]

    def key(x):
        return "".join(c for c in x.lower() if c.isalnum())

    def score(a, b):
        if not a or not b:
            return 0
        return 1 if a == b else len(b) / len(a) if b in a else len(a) / len(b) * 0.9 if a in b else 0

    want = []
    for d, text in enumerate(texts):
        lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
        red = {}
        for raw in (text or "").split("."):
            fragment = raw.strip()
            best = max(range(len(lines)), key=lambda k: (score(key(lines[k]), key(fragment)), -k), default=None)
            if fragment and best is not None and score(key(lines[best]), key(fragment)) >= 0.32:
                red.setdefault(best, []).append(fragment)
        for k, line in enumerate(lines):
            joined = " ".join(red[k]) if k in red else None
            numbered = line[:2] == "1."
            if joined and (key(joined) == key(line) or not numbered and len(key(joined)) >= max(2, int(len(key(line)) * 0.55 + 0.5))):
                joined = line
            want.append((d, k, line, joined))
    assert got == want and sum(r[3] is not None for r in got) >= 3


def reference_fold(history):
    state = (0, 0, 0, 0, 0, None, None)
    for ms, correct in history:
        state = streaming.step(state, ms, correct)
    return state


def test_schedule(spark):
    day = 86_400_000
    cases = {1: [(0, True)], 2: [(0, False)], 3: [(0, True), (600_000, True)], 4: [(0, True), (5, True)], 5: [(0, True), (5, False)], 6: [(k * 40 * day, True) for k in range(10)], 7: [(0, True), (700_000, True), (700_001 + day, True), (800_000 + day, False)]}
    rows = [(p, ms, k, c) for p, h in cases.items() for k, (ms, c) in enumerate(h)]
    got = {r["point_id"]: tuple(r)[1:] for r in review.fold(spark.createDataFrame(rows, "point_id bigint, ts_ms bigint, ord int, correct boolean").repartition(3)).collect()}
    assert got == {p: reference_fold(h) for p, h in cases.items()}
    assert got[1][:2] == (0, 600_000) and got[3][0] == 1 and got[4][:3] == (0, 600_000, 2) and got[6][0] == 6


def test_the_whole_queue_is_listed(spark, tmp_path):
    spark.createDataFrame([(k, f"p{k}") for k in range(130)], "c_custkey bigint, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    events = spark.createDataFrame([(k, k, 1_000 * k, "view") for k in range(0, 130, 2)], "event_id bigint, user_id bigint, s bigint, event_type string")
    events.withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in plans.QUERIES["review_queue_all"](spark, str(tmp_path)).collect()]
    due = {k: reference_fold([(1_000_000 * k, True)])[1] if k % 2 == 0 else 0 for k in range(130)}
    assert got == [(k, due[k]) for k in sorted(due, key=lambda k: (due[k], k))]


def test_streamed_schedule_equals_the_batch(spark, tmp_path):
    rows = [(k % 7, k * 3_600_000, k, k % 3 > 0) for k in range(120)]
    schema = "point_id bigint, ts_ms bigint, ord bigint, correct boolean"
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = streaming.fold_stream(stream).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.sql("select * from folded").groupBy("point_id").agg(F.max_by(F.struct("*"), "attempts").alias("r")).select("r.*")
    want = review.fold(spark.createDataFrame(rows, schema))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in want.collect()}


def test_merge_keeps_the_newest(spark):
    schema = "source string, stem string, answer string, occurredAt bigint, ord int, tag string"
    now = spark.createDataFrame([("manual", "Q1", "a", 5, 0, "old"), ("manual", "Q2", "b", 5, 1, "tie")], schema)
    new = spark.createDataFrame([("manual", "q1 ", "a", 9, 0, "new"), ("manual", "Q2", "b", 5, 1, "later"), ("codex", "Q1", "a", 1, 2, "other")], schema)
    assert sorted(r["tag"] for r in ordered.merge_learning_items(now, new).collect()) == ["new", "other", "tie"]


def test_turns(spark):
    rows = [("c", 0, "assistant", "early"), ("c", 1, "user", "first"), ("c", 2, "user", "second"), ("c", 3, "assistant", "a"), ("c", 4, "system", "s"), ("c", 5, "assistant", "b"), ("c", 6, "user", "last")]
    got = ordered.pair_turns(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()
    assert [(r["prompt"], r["response"], r["n_responses"]) for r in got] == [("second", "a\n\nb", 2)]


def test_bank_and_exam(spark):
    points = spark.createDataFrame(
        [(str(k), w, None, "", None, "", "s", "p", "计算机基础", "硬件", "pdf-color", k) for k, w in enumerate(["内存", "硬盘", "主板", "芯片", "总线"])] + [("9", "x", ["甲乙", "丙丁"], "", "____和____", "", "s", "p", "计算机基础", "硬件", "pdf-color", 9)],
        "id string, text string, answerParts array<string>, context string, question string, explanation string, sourceName string, location string, subject string, category string, method string, ord bigint",
    )
    items = spark.createDataFrame([("i1", "manual", "choice", "题干", ["a", "b", "c", "d"], "b", "解", "b", 0, "计算机基础", "硬件", 0)], "id string, source string, kind string, stem string, choices array<string>, answer string, explanation string, knowledgePoint string, occurredAt bigint, subject string, category string, ord bigint")
    bank = questions.question_bank(items, points).cache()
    rows = {r["id"]: r for r in bank.collect()}
    assert len(rows) == 8 and all(len(set(r["choices"])) == 4 and r["answer"] in r["choices"] for r in rows.values())
    assert rows["document-choice-9-1"]["stem"] == "「甲乙」和______" and "甲乙" not in rows["document-choice-9-1"]["choices"]
    assert set(rows["today-question-i1"]["choices"]) == {"a", "b", "c", "d"}
    exam = questions.select_exam(bank, 3, "s").collect()
    assert len(exam) == 3 and {r["id"] for r in exam} == {r["id"] for r in questions.select_exam(bank, 3, "s").collect()}
    assert questions.select_exam(bank, 99, "s").count() == 8 and questions.select_exam(bank, -1, "s").count() == 0


def test_study_questions(spark):
    points = spark.createDataFrame([(str(k), "word" + "x" * k, None, "", None, "", "s", "p", k) for k in range(9)], "id string, text string, answerParts array<string>, context string, question string, explanation string, sourceName string, location string, ord bigint")
    got = questions.study_questions(points).collect()
    assert len(got) == 9 and all((r["type"] == "choice") == (r["place"] % 2 == 1) for r in got)
    assert all(len(set(r["choices"])) == 4 and r["answer"] in r["choices"] for r in got if r["type"] == "choice")


CODES = {n: k for k, n in enumerate("save restore transform setFillRGBColor setFillGray setFillCMYKColor beginText setTextMatrix moveText setLeadingMoveText setLeading setTextRise nextLine showText showSpacedText nextLineShowText nextLineSetSpacingShowText".split(), 1)}


def test_page_to_lines(spark):
    program = [("setFillRGBColor", ["#000000"]), ("beginText", None), ("setTextMatrix", [1, 0, 0, 1, 10, 700]), ("showText", [[{"unicode": "黑"}]]), ("save", None), ("setFillRGBColor", [255, 0, 0]), ("setTextMatrix", [[1, 0, 0, 1, 60, 700]]), ("showText", [[{"unicode": "红"}, {"unicode": "字"}]]), ("restore", None), ("setTextMatrix", [1, 0, 0, 1, 10, 680]), ("showText", [["末"]])]
    ops = spark.createDataFrame([(1, 1, k, CODES[n], json.dumps(a)) for k, (n, a) in enumerate(program)], "doc_id bigint, page int, seq int, fn int, args string")
    assert [(r["text"], r["x"], r["y"]) for r in pages.red_marks(ops, CODES).collect()] == [("红字", 60.0, 700.0)]
    items = spark.createDataFrame(
        [(1, 1, k, s, [12.0, 0.0, 0.0, 12.0, x, y], w, 12.0) for k, (s, x, y, w) in enumerate([("黑", 10.0, 700.0, 12.0), ("红字", 60.0, 700.3, 24.0), ("末", 10.0, 680.0, 12.0), ("", 1.0, 1.0, 1.0)])], "doc_id bigint, page int, idx int, str string, transform array<double>, width double, height double"
    )
    got = [(r["text"], r["red_text"]) for r in pages.tagged_lines(items, ops, CODES).orderBy("line_no").collect()]
    assert got == [("黑 红字", "红字"), ("末", None)]
    notes = spark.createDataFrame([(1, 1, "Highlight", [1.0, 0.0, 0.0], [5.0, 686.0, 30.0, 686.0, 5.0, 676.0, 30.0, 676.0], None), (1, 1, "Link", [1.0, 0.0, 0.0], None, [0.0, 0.0, 999.0, 999.0])], "doc_id bigint, page int, subtype string, color array<double>, quadPoints array<double>, rect array<double>")
    with_notes = [r["red_text"] for r in pages.tagged_lines(items, ops, CODES, notes).orderBy("line_no").collect()]
    assert with_notes == ["红字", "末"]


def test_pixels(spark):
    df = spark.createDataFrame([(bytes([255, 0, 0, 255, 0, 0, 0, 255]),), (b"",)], "p binary").coalesce(1)
    assert [r[0] for r in df.select(pages.red_pixel_ratio("p")).collect()] == [0.5, 0.0]
