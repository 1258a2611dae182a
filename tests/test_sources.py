"""Readers of documents, archives and chat history, and the state store."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from lorequarry.functions import taxonomy
from lorequarry.sources import documents, history, store

NOW = 1_704_103_200_000  # 2024-01-01 10:00 UTC


def parse(spark, *files, today=True):
    table = history.with_options(spark.createDataFrame(files, "file_name string, body string"), NOW)
    return sorted((r.asDict() for r in history.parse(table, today).collect()), key=lambda r: (r["occurredAt"], r["stem"]))


def test_items_json(spark):
    items = [
        {"source": "chatgpt", "occurredAt": "2024-01-01T09:00:00Z", "question": "If I ___\nA. have\nB. had", "answer": "B", "explanation": "虚拟语气"},
        {"occurredAt": NOW, "stem": "选项", "choices": {"B": "乙", "A": "甲"}, "answer": "甲", "analysis": "因为"},
        {"occurredAt": NOW, "stem": "没有解析", "choices": ["甲", "乙"], "answer": "甲"},
        {"occurredAt": NOW / 1000, "stem": "概念", "answer": "缓存"},
        {"stem": "没有时间", "answer": "x"},
        {"occurredAt": "2023-12-01T00:00:00Z", "stem": "旧", "answer": "x"},
    ]
    got = parse(spark, ("a.json", json.dumps({"items": items})))
    assert [(r["kind"], r["answer"], r["choices"], r["source"]) for r in got] == [("choice", "had", ["have", "had"], "chatgpt"), ("knowledge", "缓存", [], "manual"), ("choice", "甲", ["甲", "乙"], "manual")]
    assert len(parse(spark, ("a.json", json.dumps(items)), today=False)) == 4


def message(role, text, t, parent=None):
    return {"parent": parent, "message": {"author": {"role": role}, "create_time": t, "content": {"parts": [text]}}}


def test_conversation_branch(spark):
    t = NOW / 1000
    mapping = {"a": message("user", "什么是缓存", t), "b": message("assistant", "知识点：旧的回答", t + 1, "a"), "c": message("assistant", "知识点：缓存是高速存储器", t + 2, "a"), "d": message("assistant", "补充", t + 3, "c")}
    got = parse(spark, ("conversations.json", json.dumps([{"title": "缓存", "create_time": t, "current_node": "d", "mapping": mapping}])))
    assert [(r["stem"], r["answer"], r["source"], r["title"]) for r in got] == [("什么是缓存", "缓存是高速存储器", "chatgpt", "缓存")]
    whole = parse(spark, ("conversations.json", json.dumps({"conversations": [{"title": "", "create_time": t, "mapping": mapping}]})))
    assert whole[0]["answer"] == "旧的回答" and whole[0]["title"] == "什么是缓存"


def row(role, text, at="2024-01-01T09:00:00Z"):
    return json.dumps({"timestamp": at, "type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "text", "text": text}]}})


def test_session_log(spark):
    log = [json.dumps({"type": "session_meta", "payload": {"source": "cli"}}), row("user", "<environment_context>x</environment_context> 问题一"), "broken {", row("assistant", "结论：第一个结论"), row("assistant", "继续")]
    got = parse(spark, ("rollout.jsonl", "\n".join(log)))
    assert [(r["stem"], r["answer"], r["source"]) for r in got] == [("问题一", "第一个结论", "codex")]
    log[0] = json.dumps({"type": "session_meta", "payload": {"source": {"subagent": "review"}}})
    assert parse(spark, ("rollout.jsonl", "\n".join(log))) == []


def test_plain_text(spark):
    talk = "用户：首都是哪里\nA. 北京\nB. 上海\n助手：答案：A。解析：自古以来\n助手：忽略\n用户：没有回答"
    got = parse(spark, ("talk.md", talk))
    assert [(r["kind"], r["answer"], r["explanation"]) for r in got] == [("choice", "北京", "自古以来")]
    blocks = "题目：一加一\nA. 一\nB. 二\n答案：B\n解析：加法\n题目：概念\n答案：一个足够长的概念说明文字"
    got = parse(spark, ("blocks.txt", blocks))
    assert {(r["kind"], r["answer"]) for r in got} >= {("choice", "二")} and len(got) == 2


def test_several_questions_in_one_pair(spark):
    talk = "用户：1. 首都\nA. 北京 B. 上海\n2. 最大\nA. 大 B. 小\n助手：1. A 因为\n2. B 所以"
    got = parse(spark, ("talk.txt", talk))
    assert [(r["answer"], r["occurredAt"] - NOW) for r in got] == [("北京", 0), ("小", 1)]


def test_archives(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("b.txt", "用户：问\n助手：知识点：一个知识点")
        z.writestr("conversations-1.json", "[]")
        z.writestr("image.png", "x")
    got = history.read_archives(spark.createDataFrame([("x.zip", raw.getvalue()), ("bad.zip", b"no")], "file_name string, content binary")).collect()
    assert [(r["entry"], r["ord"]) for r in got if r["file_name"] == "x.zip"] == [("conversations-1.json", 0), ("b.txt", 1)]
    assert [r["problem"] for r in got if r["file_name"] == "bad.zip"] == ["not an archive"]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, styles=""):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
    return raw.getvalue()


def run(text, props=""):
    return f"<w:r><w:rPr>{props}</w:rPr><w:t>{text}</w:t></w:r>"


def test_docx(spark):
    red = '<w:color w:val="FF0000"/>'
    styles = '<w:style w:styleId="Base"><w:rPr><w:color w:val="C00000"/></w:rPr></w:style><w:style w:styleId="Child"><w:basedOn w:val="Base"/></w:style><w:style w:styleId="Loop"><w:basedOn w:val="Loop"/></w:style>'
    number = "<w:pPr><w:numPr/></w:pPr>"
    body = f"<w:p>{number}{run('首都是____')}{run('北', red)}{run('京', red)}{run('。')}{run('沪', red)}</w:p><w:p>{run('样式', '<w:rStyle w:val=' + chr(34) + 'Child' + chr(34) + '/>')}{run('环', '<w:rStyle w:val=' + chr(34) + 'Loop' + chr(34) + '/>')}</w:p><w:p/>"
    files = spark.createDataFrame([("a.docx", docx(body, styles)), ("bad.docx", b"zz")], "path string, content binary")
    got = documents.read_docx(files).orderBy("path", "line_no").collect()
    assert [(r["text"], r["red_text"], r["location"]) for r in got if r["path"] == "a.docx"] == [("1. 首都是____北京。沪", "北京 沪", "第 1 段"), ("样式环", "样式", "第 2 段")]
    assert got[-1]["problem"] == "not a word-processor file"


def test_store(spark, tmp_path):
    points = spark.createDataFrame([("1", "CPU", "s", "p", "c", "q", ["CPU"], "计算机基础", "操作系统", "user"), ("2", " ", "s", "p", "c", "q", [], None, None, None)], "id string, text string, sourceName string, location string, context string, question string, answerParts array<string>, subject string, knowledgeCategory string, classificationSource string")
    store.save({"points": points}, str(tmp_path / "v2"))
    loaded = store.load(spark, str(tmp_path / "v2"))["points"]
    valid = store.valid_points(loaded)
    assert [(r["id"], r["classificationSource"]) for r in valid.collect()] == [("1", "auto")]
    assert store.load(spark, str(tmp_path / "none"), str(tmp_path / "v2"))["points"].count() == 2 and store.load(spark, str(tmp_path / "none")) == {}
    edited = store.edit_point(loaded, "1", "甲；乙", "____和____").where("id = '1'").first()
    assert edited["answerParts"] == ["甲", "乙"]
    assert store.upsert_points(points, points.withColumn("id", F.lit("9"))).count() == 3
    assert store.filter_subjects(points, "没有").count() == 2 and store.filter_subjects(points, "计算机基础", "操作系统").count() == 1
    notes = store.add_note(spark.createDataFrame([], "id bigint, title string, content string, created_at string"), " t ", " c ", "2024")
    assert [tuple(r) for r in store.recent_notes(notes).collect()] == [(1, "t", "c", "2024")]


def test_day_export(spark):
    log = [row("user", "问题"), row("assistant", "回答"), row("user", "晚", "2024-01-01T17:00:00Z"), row("assistant", "次日")]
    sniffed = history.sniff(history.with_options(spark.createDataFrame([("r.jsonl", "\n".join(log))], "file_name string, body string"), NOW))
    out = json.loads(store.day_export(history.log_pairs(sniffed), "2024-01-01", "Asia/Shanghai", "now").first()[0])
    assert out["targetDay"] == "2024-01-01" and [i["prompt"] for i in out["items"]] == ["问题"] and out["items"][0]["occurredAt"] == "2024-01-01T09:00:00.000Z"


def test_items_become_points(spark):
    table = history.with_options(spark.createDataFrame([("a.json", json.dumps([{"occurredAt": NOW, "stem": "CPU 是什么", "answer": "中央处理器"}]))], "file_name string, body string"), NOW)
    point = history.to_points(taxonomy.classify(history.parse(table))).first()
    assert point["subject"] == "计算机基础" and point["answerParts"] == ["中央处理器"] and point["location"] == "01/01 10:00"


def test_archive_items_are_taken_once(spark):
    from lorequarry.sources import history

    now, minute = 1_700_000_000_000, 60_000
    item = lambda k, at, answer="yes it is so": {"source": "chatgpt", "occurredAt": at, "question": f"question {k}", "answer": answer, "explanation": "because of that"}
    entries = {"b.jsonl": [item(1, now), item(2, now)], "conversations.json": [item(1, now - minute)], "c.txt": [item(2, now), item(3, now)], "ignored.bin": [item(4, now)]}
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, rows in entries.items():
            z.writestr(name, json.dumps({"items": rows}))
    archives = spark.createDataFrame([("a.zip", raw.getvalue())], "file_name string, content binary")
    got = history.parse_archives(archives, now).collect()
    assert sorted((r["stem"], r["occurredAt"], r["originLabel"]) for r in got) == [("question 1", now - minute, "a.zip / conversations.json"), ("question 2", now, "a.zip / b.jsonl"), ("question 3", now, "a.zip / c.txt")]


def test_log_files_are_read_line_by_line(spark, tmp_path):
    from lorequarry.sources import history

    def row(role, text, at):
        return json.dumps({"timestamp": at, "type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]}})

    (tmp_path / "deep").mkdir()
    lines = [row("user", "what is it", "2024-01-01T10:00:00Z"), "not json", row("assistant", "it is that", "2024-01-01T10:00:05Z")]
    (tmp_path / "deep" / "x.JSONL").write_text("\n".join(lines))
    (tmp_path / "y.jsonl").write_text("\n".join([json.dumps({"type": "session_meta", "payload": {"source": {"subagent": "a"}}}), *lines]))
    (tmp_path / "z.txt").write_text("\n".join(lines))
    got = history.log_line_pairs(history.read_log_lines(spark, str(tmp_path), 0)).collect()
    assert [(r["prompt"], r["response"], r["origin_label"]) for r in got] == [("what is it", "it is that", "x.JSONL")]


def test_large_files_are_reported(spark, tmp_path, monkeypatch):
    from lorequarry.functions import fixed
    from lorequarry.sources import history

    monkeypatch.setattr(fixed, "MAX_IMPORT_BYTES", 5)
    (tmp_path / "a.md").write_text("abc")
    (tmp_path / "b.md").write_text("too long for this")
    got = {r["file_name"]: (r["body"], r["problem"]) for r in history.read_folder(spark, str(tmp_path), 0).collect()}
    assert got == {"a.md": ("abc", None), "b.md": (None, "larger than the limit")}


def test_demo_points(spark):
    from lorequarry.sources import store

    got = store.demo_points(spark, 5).collect()
    assert len({r["id"] for r in got}) == 6 and all(len(r["id"]) == 36 and r["subject"] and r["createdAt"] == 5 for r in got)
