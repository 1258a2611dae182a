"""Subject and category classification by weighted patterns.

The rules are a small table. Each becomes one test in a projection, so classifying is a
narrow, JVM-side step whatever the number of rows.
"""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed as X
from . import text as T

_LB, _RB, _S = X.LB, X.RB, X.WS
_HAN, _SPECIAL = re.compile(X.HAN), re.compile(r"[\\\[\](){}.*+?^$|]")
VERSION = 1
# --- fixed values: subjects, categories and rules (pattern, weight, reason) -----------
SUBJECTS = ("大学英语", "计算机基础", "大学语文", "高等数学", "其他")
CATEGORIES = {
    "大学英语": ("补全对话", "词汇与语法", "阅读理解", "选词填空", "句子填空", "完形填空", "英语综合"),
    "计算机基础": ("基础与信息表示", "硬件与系统组成", "操作系统", "办公软件", "网络与信息安全", "数据库与程序设计", "计算机综合"),
    "大学语文": ("语言文字基础", "文学文化常识", "古诗文阅读", "现代文阅读", "写作", "语文综合"),
    "高等数学": ("函数与极限", "导数与微分", "积分", "线性代数", "概率统计", "空间解析几何", "高数综合"),
    "其他": ("综合知识",),
}
SUBJECT_RULES = {
    "大学英语": (
        (r"英语|english|词汇|语法|时态|语态|虚拟语气|非谓语|定语从句|状语从句|主谓一致|cloze|grammar|vocabulary", 5, "英语题型或语法词"),
        (rf"(?iu){_LB}(?:if|would|should|could|might|have|has|had|which|that|who|whom|whose|although|because|unless|whether){_RB}", 2.4, "英文语法结构"),
    ),
    "计算机基础": (
        (rf"(?iu)(?:{_LB}c(?:\+\+|#)?{_S}*语言|python|java(?:script)?|typescript|html|css|数据库|sql|select{_S}+.+{_S}+from|程序设计|源代码|编程|代码|编译器|解释器|变量|数组|指针|类与对象|递归|数据结构)", 7, "编程或数据库强语境"),
        (r"计算机|微型机|信息技术|冯[·・]?诺依曼|二进制|十六进制|编码|数制|位权|指令|操作码|地址码|操作数|存储程序|程序控制", 5, "计算机基础术语"),
        (rf"(?iu){_LB}cpu{_RB}|中央处理器|运算器|控制器|{_LB}ram{_RB}|{_LB}rom{_RB}|{_LB}cache{_RB}|存储器|内存|外存|硬盘|磁盘|扇区|磁道|柱面|主板|芯片|总线|{_LB}usb{_RB}|i/o|输入设备|输出设备", 5.5, "计算机硬件术语"),
        (r"(?iu)操作系统|系统软件|应用软件|进程|线程|文件管理|存储管理|设备管理|windows|linux", 5.5, "操作系统术语"),
        (rf"(?iu)(?:microsoft|ms){_S}*word|word{_S}*(?:文档|处理|软件)|文字处理软件|office|excel|powerpoint|wps|数据库|sql|程序设计|算法|网络|ip地址|域名|协议|信息安全|病毒|防火墙", 5.5, "计算机应用术语"),
    ),
    "大学语文": (
        (r"大学语文|语文|文言文|古诗|诗词|现代文|文学|作家|作品|修辞|成语|病句|汉字|文化常识", 5, "语文或文学术语"),
        (r"论语|孟子|诗经|楚辞|史记|唐诗|宋词|鲁迅|李白|杜甫|苏轼|陶渊明", 4.5, "文学作品或作者"),
        (r"作文|写作|议论文|记叙文|应用文|主旨|中心思想|表达方式", 4, "阅读写作术语"),
    ),
    "高等数学": (
        (r"高等数学|极限|连续|无穷小|无穷大|导数|微分|积分|定积分|不定积分|微分方程|函数(?:的)?(?:定义域|值域|极限|连续性|导数|图像|单调性|奇偶性)", 5, "微积分术语"),
        (r"矩阵|行列式|向量|线性方程组|特征值|线性代数", 5, "线性代数术语"),
        (r"概率|随机变量|概率分布|期望|方差|统计学|统计量|样本|总体|均值|排列组合", 5, "概率统计术语"),
        (r"空间解析几何|平面方程|直线方程|曲面|二次曲面", 4.5, "空间解析几何术语"),
        (rf"(?iu)lim{_RB}|∫|∑|[a-z]{_S}*['′]{_S}*\(|{_LB}d[xy]{_RB}|[a-z]\^\d", 3.2, "数学符号结构"),
        (rf"(?iu){_LB}(?:derivative|differentiat(?:e|ion)|integral|limit|matrix|determinant|vector|probability|equation|polynomial|calculus){_RB}", 6, "英文数学术语"),
    ),
}
CATEGORY_RULES = {
    "大学英语": (
        ("补全对话", rf"(?iu)补全对话|对话|conversation|dialogue|speaker|a:{_S}*.+b:", 6, "对话补全结构"),
        ("阅读理解", r"(?iu)阅读理解|read the (?:following )?passage|according to (?:the )?(?:passage|text)|the passage|文章主旨", 6, "阅读理解题干"),
        ("选词填空", r"(?iu)选词填空|word bank|从方框|所给词|choose (?:the )?word", 6, "选词填空题干"),
        ("完形填空", r"完形填空|cloze|完形", 6, "完形填空题干"),
        ("句子填空", r"(?iu)句子填空|补全句子|选句填空|sentence completion|______|_{2,}|＿{2,}", 3.5, "句子挖空结构"),
        ("词汇与语法", rf"(?iu)词汇|语法|时态|语态|从句|虚拟语气|非谓语|主谓一致|近义词|同义词|grammar|vocabulary|closest{_S}+in{_S}+meaning|{_LB}synonym{_RB}|{_LB}means?{_RB}|{_LB}(?:tense|voice|clause|conditional|participle|infinitive|agreement|if|would|should|had){_RB}", 4, "词汇语法考点"),
    ),
    "计算机基础": (
        ("操作系统", rf"(?iu)操作系统|进程|线程|调度|文件管理|存储管理|设备管理|作业管理|windows|linux|os{_RB}", 6, "操作系统考点"),
        ("硬件与系统组成", rf"(?iu){_LB}cpu{_RB}|中央处理器|运算器|控制器|{_LB}ram{_RB}|{_LB}rom{_RB}|{_LB}cache{_RB}|存储器|内存|外存|硬盘|磁盘|扇区|磁道|柱面|主板|芯片|总线|{_LB}usb{_RB}|i/o|输入设备|输出设备|硬件系统|存储程序|程序控制|冯[·・]?诺依曼", 6, "硬件组成考点"),
        ("办公软件", rf"(?iu)(?:microsoft|ms){_S}*word|word{_S}*(?:文档|处理|软件)|文字处理软件|{_LB}excel{_RB}|{_LB}powerpoint{_RB}|{_LB}wps{_RB}|文档编辑|电子表格|演示文稿", 6, "办公软件考点"),
        ("网络与信息安全", r"(?iu)计算机网络|互联网|ip地址|域名|tcp|udp|http|协议|信息安全|病毒|木马|防火墙|加密", 6, "网络安全考点"),
        ("数据库与程序设计", rf"(?iu)数据库|sql|select{_S}+.+{_S}+from|关系模型|数据表|程序设计|算法|流程图|变量|数组|指针|循环|分支结构|编译|解释器|{_LB}c(?:\+\+|#)?{_S}*语言|python|java(?:script)?|typescript|html|css", 6, "数据库或程序设计考点"),
        ("基础与信息表示", r"计算机|信息技术|冯[·・]?诺依曼|二进制|十六进制|编码|数制|位权|软件|数据|指令|操作码|地址码|操作数", 3.5, "计算机基础考点"),
    ),
    "大学语文": (
        ("写作", r"作文|写作|议论文|记叙文|应用文|审题|立意", 6, "写作考点"),
        ("古诗文阅读", r"文言文|古诗|诗词|诗经|楚辞|唐诗|宋词|翻译下列|古文", 6, "古诗文考点"),
        ("现代文阅读", r"现代文|阅读理解|主旨|中心思想|段落作用|表达方式", 5, "现代文阅读考点"),
        ("文学文化常识", r"文学|作家|作品|文化常识|朝代|流派|论语|孟子|史记|鲁迅|李白|杜甫|苏轼", 5, "文学文化常识"),
        ("语言文字基础", r"汉字|字音|字形|词语|成语|病句|修辞|标点", 5, "语言文字考点"),
    ),
    "高等数学": (
        ("概率统计", rf"(?iu)概率|随机变量|概率分布|期望|方差|统计学|统计量|样本|总体|均值|排列组合|{_LB}probability{_RB}", 6, "概率统计考点"),
        ("线性代数", rf"(?iu)矩阵|行列式|向量|线性方程组|特征值|线性代数|{_LB}matrix{_RB}|{_LB}determinant{_RB}|{_LB}vector{_RB}", 6, "线性代数考点"),
        ("空间解析几何", r"空间解析几何|平面方程|直线方程|曲面|二次曲面", 6, "空间解析几何考点"),
        ("积分", rf"(?iu)积分|定积分|不定积分|∫|原函数|{_LB}integral{_RB}", 6, "积分考点"),
        ("导数与微分", rf"(?iu)导数|微分|微分方程|切线|单调性|极值|凹凸|{_LB}derivative{_RB}|{_LB}differentiat(?:e|ion){_RB}", 6, "导数微分考点"),
        ("函数与极限", rf"(?iu)函数(?:的)?(?:定义域|值域|极限|连续性|导数|图像|单调性|奇偶性)|极限|连续|无穷小|无穷大|lim{_RB}|{_LB}limit{_RB}|{_LB}polynomial{_RB}", 5, "函数极限考点"),
    ),
}
COMMON_WORDS = rf"(?iu){_LB}(?:the|a|an|is|are|was|were|if|would|should|have|has|do|does|which|that|because|although|however|to|of|in|on|for|with){_RB}"
ENGLISH, OTHER, FALLBACK_CATEGORY = "大学英语", "其他", "综合知识"
STICKY_REASON, EMPTY_REASON, UNMATCHED_REASON, DEFAULT_REASON = "沿用知识点已确认的分类", "内容为空，使用兜底分类", "未命中明确学科规则", "按学科默认大类归档"
SENTENCE_REASON, FUNCTION_REASON, OPTION_REASON, CATEGORY_REASON = "连续英文句子", "英文功能词结构", "英文多选项结构", "大类："
TEXT_FIELDS = ("title", "stem", "question", "context", "text", "explanation", "sourceName", "answer")
# --------------------------------------------------------------------------------------


def rules_table(spark: SparkSession) -> DataFrame:
    """All rules as rows: level, subject, category, ord, pattern, weight, reason."""
    rows = [("subject", s, None, k + 1, p, float(w), r) for s, rules in SUBJECT_RULES.items() for k, (p, w, r) in enumerate(rules)]
    rows += [("category", s, c, k + 1, p, float(w), r) for s, rules in CATEGORY_RULES.items() for k, (c, p, w, r) in enumerate(rules)]
    return spark.createDataFrame(rows, "level string, subject string, category string, ord int, pattern string, weight double, reason string")


def canonical_text(df: DataFrame, nfkc: bool = True) -> Column:
    """The text that is scored: the text fields and answer parts, empty ones left out. Choices are not in it."""
    have = set(df.columns)
    none = F.array().cast("array<string>")
    fields = F.array(*[F.col(c) if c in have else F.lit(None).cast("string") for c in TEXT_FIELDS])
    parts = F.coalesce(F.col("answerParts"), none) if "answerParts" in have else none
    joined = F.array_join(F.filter(F.concat(fields, parts), lambda x: x.isNotNull() & (x != "")), "\n")
    return F.lower(T.nfkc(joined) if nfkc else joined)


# --- patterns as cheap tests -------------------------------------------------------------


def _alternatives(pattern: str) -> tuple[bool, list[str]]:
    """Whether a pattern ignores case, and its top-level alternatives."""
    folds = pattern.startswith("(?iu)")
    pattern = pattern.removeprefix("(?iu)")
    out, depth, begin, k = [], 0, 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and not depth:
            out.append(pattern[begin:k])
            begin = k + 1
        k += 1
    return folds, [*out, pattern[begin:]]


def _needs_han(alternative: str) -> bool:
    """Whether every match of an alternative holds a Han letter, as far as can be told."""
    required = re.sub(r"\(\?:[^()]*\)\?|\[[^\]]*\][*?]?", "", alternative)
    choices = re.findall(r"\(\?:([^()]*)\)", required)
    return bool(_HAN.search(re.sub(r"\(\?:[^()]*\)", "", required))) or any(all(_HAN.search(x) for x in c.split("|")) for c in choices)


def matches(pattern: str, text: Column, lowered: Column, han: Column) -> Column:
    """``text.rlike(pattern)``: plain alternatives by a search for bytes, the rest by one
    pattern; alternatives with Han letters only where ``han`` says that the text has any."""
    folds, parts = _alternatives(pattern)
    source = lowered if folds else text  # fixed values are in lower case
    tests = []
    for needs in (False, True):
        own = [p for p in parts if _needs_han(p) == needs]
        found = [source.contains(p) for p in own if not _SPECIAL.search(p)]
        rest = [p for p in own if _SPECIAL.search(p)]
        if rest:
            found.append(source.rlike("|".join(rest)))
        if found:
            any_ = reduce(lambda x, y: x | y, found)
            tests.append(han & any_ if needs else any_)
    return reduce(lambda x, y: x | y, tests)


def _category_of(subject: Column, test) -> Column:
    """struct(category, reason): highest weight first, then rule order; the subject's last category if nothing matches."""
    out = None
    for name in SUBJECTS[:4]:
        found = None
        for _, (category, pattern, _, reason) in sorted(enumerate(CATEGORY_RULES[name]), key=lambda x: (-x[1][2], x[0])):
            value = F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"))
            found = F.when(test(pattern), value) if found is None else found.when(test(pattern), value)
        found = found.otherwise(F.struct(F.lit(CATEGORIES[name][-1]).alias("category"), F.lit(DEFAULT_REASON).alias("reason")))
        out = F.when(subject == name, found) if out is None else out.when(subject == name, found)
    return out


def classify(df: DataFrame, out: str = "classification", nfkc: bool = True) -> DataFrame:
    """Adds struct(subject, category, confidence, reasons) as column ``out``.

    Reads whichever of the input fields the table has. Each step is a projection of its
    own, so that every pattern stands once in the plan and is tried once a row at most.
    """
    have = set(df.columns)
    none = F.array().cast("array<string>")
    c = lambda name: F.col(f"_{name}")
    typed = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    choices = F.coalesce(F.col("choices"), none) if "choices" in have else none
    options = F.array_join(choices, " ")
    wide = df.columns
    df = df.select("*", canonical_text(df, nfkc).alias("_text"), (T.nfkc(options) if nfkc and "choices" in have else options).alias("_options"), choices.alias("_choices"))
    df = df.select("*", c("text").rlike(X.HAN).alias("_has_han"))
    # one test for each subject rule: scores and reasons both follow from these
    rules = [(subject, *rule) for subject in SUBJECTS[:4] for rule in SUBJECT_RULES[subject]]
    df = df.select("*", F.array(*[matches(p, c("text"), c("text"), c("has_han")) for _, p, _, _ in rules]).alias("_hits"))
    weights = lambda subject: sum((F.when(c("hits")[k], F.lit(float(w))).otherwise(F.lit(0.0)) for k, (s, _, w, _) in enumerate(rules) if s == subject), F.lit(0.0))
    df = df.select("*", *[weights(s).alias(f"_s{k}") for k, s in enumerate(SUBJECTS[:4])])
    weak = F.greatest(c("s1"), c("s2"), c("s3"), F.lit(0.0)) < 4.5
    letters = F.length(c("text")) - F.length(F.translate(c("text"), string.ascii_lowercase + string.ascii_uppercase, ""))
    han = F.when(c("has_han"), F.regexp_count(c("text"), F.lit(X.HAN))).otherwise(0)
    option_words = F.regexp_extract_all(c("options"), F.lit("(?i)[a-z]+(?:['’][a-z]+)?"), F.lit(0))
    df = df.select(
        "*",
        F.when(weak, F.regexp_count(c("text"), F.lit("(?i)[a-z]+(?:'[a-z]+)?"))).alias("_words"),
        F.when(weak, F.regexp_count(c("text"), F.lit(COMMON_WORDS))).alias("_common"),
        F.when(weak, letters / F.greatest(letters + han, F.lit(1))).alias("_share"),
        F.when(weak & (F.size(c("choices")) >= 3), option_words).alias("_option_words"),
    )
    written = F.length(F.array_join(c("option_words"), "")) > F.greatest(F.lit(1.0), F.regexp_count(c("options"), F.lit(X.HAN)) * 1.5)
    yes = lambda x: F.coalesce(x, F.lit(False))
    signs = {"sentence": (c("words") >= 4) & (c("share") >= 0.42), "function": c("common") >= 2, "optional": (F.size(c("option_words")) >= 4) & written}
    df = df.select("*", *[yes(v).alias(f"_{k}") for k, v in signs.items()])
    bonus = F.when(c("sentence"), 2.8).otherwise(0.0) + F.when(c("function"), F.least(F.lit(2.4), c("common") * 0.4)).otherwise(0.0) + F.when(c("optional"), 3.2).otherwise(0.0)
    scores = [c("s0") + bonus, c("s1"), c("s2"), c("s3")]
    df = df.select("*", F.array_sort(F.array(*[F.struct((-v).alias("least"), F.lit(k).alias("k"), F.lit(s).alias("subject")) for k, (v, s) in enumerate(zip(scores, SUBJECTS))])).alias("_ranked"))
    prior, source = typed("subject", "string"), typed("classificationSource", "string")
    sticky = yes(prior.isin(*SUBJECTS) & (yes(source == "user") | ((prior != OTHER) & yes(typed("classificationVersion", "int") == VERSION))))
    short = (F.size(c("choices")) >= 3) & F.forall(c("choices"), lambda x: F.regexp_count(x, F.lit("(?i)[a-z]+(?:['’][a-z]+)?")).between(1, 4) & ~x.rlike(X.HAN))
    df = df.select("*", sticky.alias("_sticky"), F.when(sticky, prior).otherwise(c("ranked")[0]["subject"]).alias("_subject"))
    # a label that sticks has its category from the text alone
    detail = F.array_join(F.filter(F.array(c("text"), c("options"), F.when((c("subject") == ENGLISH) & short, "vocabulary").otherwise("")), lambda x: x != ""), "\n")
    df = df.select("*", F.when(c("sticky"), c("text")).otherwise(detail).alias("_detail"))
    df = df.select("*", F.lower("_detail").alias("_low"), (c("has_han") | c("options").rlike(X.HAN)).alias("_any_han"))
    df = df.select("*", _category_of(c("subject"), lambda p: matches(p, c("detail"), c("low"), c("any_han"))).alias("_category"))

    best, second = -c("ranked")[0]["least"], -c("ranked")[1]["least"]
    confidence = F.least(F.lit(0.98), F.greatest(F.lit(0.5), 0.55 + (best - second) / F.greatest(F.lit(4.0), best + 2) * 0.4))
    rounded = F.floor(confidence.cast("decimal(38,30)") * 100 + F.lit("0.5").cast("decimal(2,1)")).cast("double") / 100
    said = [F.when(c("hits")[k] & (c("subject") == s), F.lit(r)) for k, (s, _, _, r) in enumerate(rules)]
    english = [F.when(c(k) & (c("subject") == ENGLISH), F.lit(r)) for k, r in (("sentence", SENTENCE_REASON), ("function", FUNCTION_REASON), ("optional", OPTION_REASON))]
    first = len(SUBJECT_RULES[ENGLISH])  # English comes first, and its signs after its rules
    reasons = F.array_compact(F.array(*said[:first], *english, *said[first:], F.concat(F.lit(CATEGORY_REASON), c("category.reason"))))

    def made(subject, category, confidence, reasons):
        return F.struct(subject.alias("subject"), category.alias("category"), confidence.alias("confidence"), reasons.alias("reasons"))

    lits = lambda s, c, n, r: made(F.lit(s), F.lit(c), F.lit(n), F.array(F.lit(r)))
    prior_category = typed("knowledgeCategory", "string")
    allowed = reduce(lambda x, y: x | y, [(prior == s) & yes(prior_category.isin(*names)) for s, names in CATEGORIES.items()])
    kept = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.5), typed("classificationConfidence", "double"))), F.lit(0.9)) if "classificationConfidence" in have else F.lit(0.9)
    held = made(prior, F.when(allowed, prior_category).when(prior == OTHER, FALLBACK_CATEGORY).otherwise(c("category.category")), kept, F.array(F.lit(STICKY_REASON)))
    fresh = made(c("subject"), c("category.category"), rounded, F.slice(F.array_distinct(reasons), 1, 4))
    result = F.when(c("sticky"), held).when(T.trim(c("text")) == "", lits(OTHER, FALLBACK_CATEGORY, 0.2, EMPTY_REASON)).when(best < 2.5, lits(OTHER, FALLBACK_CATEGORY, 0.35, UNMATCHED_REASON)).otherwise(fresh)
    return df.select(*[F.col(f"`{n}`") for n in wide], result.alias(out))


def canonical_order(subjects: DataFrame, column: str = "subject") -> DataFrame:
    """Distinct subjects in their fixed order."""
    order = subjects.sparkSession.createDataFrame(list(enumerate(SUBJECTS)), f"ord int, {column} string")
    return subjects.select(column).distinct().join(F.broadcast(order), column).orderBy("ord").select(column, "ord")
