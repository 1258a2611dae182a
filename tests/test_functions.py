"""Scalar functions, similarity, grading and the classifier on the blueprint's cases."""

import pytest
from pyspark.sql import functions as F

from lorequarry.functions import hashing as H
from lorequarry.functions import similarity as M
from lorequarry.functions import taxonomy as C
from lorequarry.functions import text as T


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).coalesce(1).select(column).collect()]


def test_normalisers(spark):
    x = F.col("x")
    assert values(spark, ["a  b \n\n c\t"], T.tidy(x)) == ["a b\nc"]
    assert values(spark, [" a\r\n\r\n\r\n\r\nb  c ", None], T.clean(x)) == ["a\n\nb c", ""]
    assert values(spark, ["《Abc》, D。"], T.key(x)) == ["abcd"]
    assert values(spark, ["__A/b|c"], T.structure_key(x)) == ["abc"]
    assert values(spark, ["ＡＢＣ！", " Don't  Stop. ", "中 文，"], T.answer(T.nfkc(x))) == ["abc", "don't stop.", "中文"]
    assert values(spark, ["a____b（ ）【】"], T.blank_count(x)) == [3]
    assert values(spark, ["12. what", "（三）什么", "第5题：x", "plain"], T.strip_number(x)) == ["what", "什么", "x", "plain"]
    assert values(spark, ["参考答案：甲", "答: 乙"], T.clean_answer(x)) == ["甲", "乙"]
    assert values(spark, ["- ab -\nc\n·de·"], T.useful_lines(x)) == [["ab", "de"]]
    assert values(spark, ["x" * 60, "short"], T.shorten(x)) == ["x" * 55 + "…", "short"]
    assert values(spark, ["a <app-context id=1>q</app-context> b", "x <codex_internal_context>rest", "## My request for Codex: do it"], T.strip_context(x)) == ["a b", "x", "do it"]
    assert values(spark, ["（a）x Ｂ"], T.option_alphabet(x)) == ["a.x B"]


def test_sentences(spark):
    df = spark.createDataFrame([("一句。二句！三句", "二句"), ("一句。二句话！", "二句"), ("甲", "乙")], "f string, n string").coalesce(1)
    assert [r[0] for r in df.select(T.sentence_around(F.col("f"), F.col("n"))).collect()] == ["二句！ 三句", "二句话！", "乙"]


def test_choice_blocks(spark):
    found = values(spark, ["If I ___ time\nA. have B. had\nC. will D. am", "（A）甲 （B）乙", "A. one\nC. two", "no options"], T.choice_block(F.col("x")))
    assert [(r["stem"], r["choices"]) for r in found] == [("If I ___ time", ["have", "had", "will", "am"]), ("", ["甲", "乙"]), ("A. one\nC. two", []), ("no options", [])]
    labels = ["The correct answer is B.", "答案：C", "Answer: D is incorrect", "正确答案为 **A**", "b", "nothing"]
    assert values(spark, labels, T.answer_label(F.col("x"))) == ["B", "C", "", "A", "B", ""]
    assert values(spark, ["答案：C", "乙", "答案：H", "丁"], T.resolve_answer(F.col("x"), F.array(F.lit("甲"), F.lit("乙"), F.lit("丙")))) == ["丙", "乙", "", "丁"]
    assert values(spark, ["1. a\nA. x\n2. b\nB. y", "none"], F.size(T.question_blocks(F.col("x")))) == [2, 1]
    assert values(spark, ["1. B\n2. 答案：C", "答案：A 答案：D"], T.ordered_labels(F.col("x"))) == [["B", "C"], ["A", "D"]]


def test_statements_and_explanations(spark):
    x = F.col("x")
    assert values(spark, ["intro\n知识点：缓存比内存快\nmore", "短\n\n这是一个足够长的段落内容", "```code block here```"], T.knowledge_statement(x)) == ["缓存比内存快", "这是一个足够长的段落内容", ""]
    assert values(spark, ["答案：B。解析：因为如此", "解析：只有这个", "答案：B"], T.clean_explanation(x)) == ["因为如此", "只有这个", "答案：B"]


def test_hash_and_shuffle(spark):
    def fnv(s):
        h = 2166136261
        for unit in memoryview(s.encode("utf-16-le")).cast("H"):
            h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
        return h

    words = ["", "a", "history", "中文", "😀x"]
    assert values(spark, words, H.fnv32(F.col("x"))) == [fnv(w) for w in words]
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"

    def base36(n):
        return (base36(n // 36) if n >= 36 else "") + digits[n % 36]

    assert values(spark, words, H.hash_id(F.col("x"))) == [base36(fnv(w)) for w in words]

    def shuffled(items, seed):
        items, state = list(items), fnv(seed) or 1
        for k in range(len(items) - 1, 0, -1):
            state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
            j = state % (k + 1)
            items[k], items[j] = items[j], items[k]
        return items

    for n in (0, 1, 2, 4, 9):
        items = [str(k) for k in range(n)]
        df = spark.createDataFrame([(items, "seed-7")], "v array<string>, s string")
        assert df.select(H.seeded_shuffle(F.col("v"), F.col("s"))).first()[0] == shuffled(items, "seed-7")
        assert df.select(H.long_seeded_shuffle(F.col("v"), H.fnv32(F.col("s")))).first()[0] == shuffled(items, "seed-7")


def test_dates(spark):
    df = spark.createDataFrame([(1_704_038_400_000,)], "ms bigint")  # 2023-12-31 16:00 UTC
    assert tuple(df.select(T.local_day(F.col("ms"), -480), T.local_day(F.col("ms"), 0), T.zone_day(F.col("ms"))).first()) == ("2024-01-01", "2023-12-31", "2024-01-01")
    due = [(-1,), (1,), (59 * 60_000,), (60 * 60_000,), (24 * 3_600_000,), (25 * 3_600_000,)]
    assert values(spark, due, T.format_due(F.col("d") + 5, F.lit(5)), "d bigint") == ["现在", "1 分钟后", "59 分钟后", "1 小时后", "1 天后", "2 天后"]
    stamps = ["1700000000", "1700000000000", "2023-11-14T22:13:20Z", "bad"]
    assert values(spark, stamps, T.timestamp_ms(F.col("x"), F.lit(7))) == [1700000000000] * 3 + [7]


def test_colours(spark):
    rows = [(255, 0, 0), (1, 0, 0), (144, 0, 0), (200, 151, 0), (200, 149, 0), (0, 0, 0)]
    assert values(spark, rows, T.is_red(F.col("r"), F.col("g"), F.col("b")), "r int, g int, b int") == [True, True, False, False, False, False]
    assert values(spark, ["#ff0000", "red"], T.hex_to_rgb(F.col("x"))["r"]) == [255, None]


def test_blank_filling(spark):
    df = spark.createDataFrame([("甲____乙（ ）丙__", ["一", "二", "三"])], "q string, p array<string>")
    assert df.select(T.fill_other_blanks(F.col("q"), F.col("p"), F.lit(1))).first()[0] == "甲「一」乙______丙「三」"


GRADES = [
    ("中央处理器", "CPU", [], None, "correct"),
    ("只能读取，不能写入", "只可读出但不能写入", [], None, "correct"),
    ("增加", "减少", [], None, "incorrect"),
    ("断电后数据不会丢失", "断电后数据会丢失", [], None, "incorrect"),
    ("TCP/IP", "TCP/IP", [], None, "correct"),
    ("TCP", "TCP/IP", [], None, "incorrect"),
    ("甲", "甲/乙", [], None, "correct"),
    ("乙", "甲／乙", [], None, "correct"),
    ("1/2", "1/2", [], None, "correct"),
    ("输入设备；输出设备", "", ["输入设备", "输出设备"], None, "correct"),
    ("输出设备；输入设备", "", ["输入设备", "输出设备"], None, "incorrect"),
    ("输入设备", "", ["输入设备", "输出设备"], None, "incorrect"),
    ("甲 乙", "", ["甲", "乙"], None, "correct"),
    ("Had", "had", [], "choice", "incorrect"),
    ("had", "had", [], "choice", "correct"),
    ("≤5", "≥5", [], None, "incorrect"),
    ("存储程序和程序控制的原理", "存储程序和程序控制原理", [], None, "correct"),
    ("计算机的硬件系统主要由五部分构成", "计算机硬件系统由五大部分组成", [], None, "needs-confirmation"),
]


def test_grading(spark):
    df = spark.createDataFrame([(k, g[0], g[1], g[2], g[3]) for k, g in enumerate(GRADES)], "k int, v string, a string, p array<string>, t string")
    got = {r["k"]: r["g"] for r in df.select("k", M.grade_answer(F.col("v"), F.col("a"), F.col("p"), F.col("t")).alias("g")).collect()}
    assert [(got[k]["verdict"], g[:2]) for k, g in enumerate(GRADES)] == [(g[4], g[:2]) for g in GRADES]
    assert all(0 <= g["similarity"] <= 1 for g in got.values())


def test_similarity_parts(spark):
    assert values(spark, ["ab c", "a", ""], M.bigrams(F.col("x"))) == [["ab", "bc"], [], []]
    assert values(spark, ["stores 3.5 testing"], M.units(F.col("x"))) == [["stor", "3.5", "test"]]
    assert values(spark, ["不允许写", "允许写不许写", "写"], M.polarity(F.col("x"), "写")) == [-1, 0, 1]
    assert values(spark, ["不写入", "写不写"], M.polarity(F.col("x"), "写")) == [-1, 0]
    pair = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], ["a"])], "a array<string>, b array<string>").coalesce(1)
    assert [tuple(r) for r in pair.select(M.dice(F.col("a"), F.col("b")), M.coverage(F.col("a"), F.col("b"))).collect()] == [(0.4, 0.5), (0.0, 0.0)]
    assert values(spark, [("甲乙丙丁", "乙丙"), ("乙", "甲乙"), ("甲", "乙"), ("甲", "甲")], M.match_score(F.col("a"), F.col("b")), "a string, b string") == pytest.approx([0.5, 0.45, 0, 1])


CLASSES = [
    ("CPU 由运算器和控制器组成", None, "计算机基础", "硬件与系统组成"),
    ("在 Python 程序设计中，变量的作用", None, "计算机基础", "数据库与程序设计"),
    ("求函数的极限 lim x", None, "高等数学", "函数与极限"),
    ("鲁迅的作品与文化常识", None, "大学语文", "文学文化常识"),
    ("If I had enough time, I would travel more with the others", None, "大学英语", "词汇与语法"),
    ("今天天气很好", None, "其他", "综合知识"),
    ("", None, "其他", "综合知识"),
    ("矩阵与行列式", None, "高等数学", "线性代数"),
]


def test_classifier(spark):
    df = spark.createDataFrame([(k, c[0], c[1]) for k, c in enumerate(CLASSES)], "k int, text string, choices array<string>")
    got = {r["k"]: r["classification"] for r in C.classify(df).collect()}
    assert [(got[k]["subject"], got[k]["category"]) for k in range(len(CLASSES))] == [c[2:] for c in CLASSES]
    assert all(0.2 <= g["confidence"] <= 0.98 and 1 <= len(g["reasons"]) <= 4 for g in got.values())
    assert C.rules_table(spark).count() == 39


def test_sticky_labels(spark):
    rows = [("CPU", "大学语文", "写作", 2.0, 1, "auto"), ("CPU", "大学语文", "bad", None, 0, "auto"), ("CPU", "其他", None, 0.1, 0, "user"), ("CPU", "其他", None, None, 1, "auto")]
    df = spark.createDataFrame(rows, "text string, subject string, knowledgeCategory string, classificationConfidence double, classificationVersion int, classificationSource string").coalesce(1)
    got = [r["classification"] for r in C.classify(df).collect()]
    assert [(g["subject"], g["category"], g["confidence"]) for g in got] == [("大学语文", "写作", 1.0), ("计算机基础", "硬件与系统组成", got[1]["confidence"]), ("其他", "综合知识", 0.5), ("计算机基础", "硬件与系统组成", got[3]["confidence"])]
