"""Patterns, word lists, tables and constants that results depend on.

Patterns are Java regular expressions. ``WS`` stands for white space in the Unicode
sense (Java's \\s is ASCII only), ``LB`` and ``RB`` for word boundaries between ASCII
word characters and anything else (Java's \\b takes Han letters for word characters).
"""

# --- fixed values: character classes -------------------------------------------------
WS_POINTS = ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
WS = r"[\s" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in WS_POINTS) + "]"
LB = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])"
RB = r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
HAN = r"[㐀-鿿]"
KEY_PUNCTUATION = r"[，。；：、,.!?！？“”‘’'\"（）()《》〈〉\[\]【】" + WS[1:]
STRUCTURE_PUNCTUATION = r"[_＿﹍，。；：、,.!?！？“”‘’'\"（）()《》〈〉\[\]【】/／|" + WS[1:]
LATIN_ANSWER_PUNCTUATION = r"[，。；：、!?！？“”’（）()《》〈〉\[\]【】]"
MEANING_FUNCTION_CHARACTERS = "[的了着过在于对把将而并其这该一个一种中为以所]"
MEANING_PUNCTUATION = r"[，。；：、,!?！？“”‘’'\"（）()《》〈〉\[\]【】_" + WS[1:]

# --- fixed values: document structure ------------------------------------------------
QUESTION_NUMBER = rf"^{WS}*(?:[（(\[【]{WS}*)?(?:(?:第{WS}*)?(\d{{1,3}})|([一二三四五六七八九十百]+)){WS}*(?:[）)\]】]{WS}*|[.．、:：]{WS}*|题[.．、:：]?{WS}*)"
BLANK = rf"_{{2,}}|＿{{2,}}|﹍{{2,}}|（{WS}*）|\({WS}*\)|\[{WS}*\]|【{WS}*】"
STANDARD_BLANK = "______"
EXPLANATION_WORDS = "答案解析|参考解析|解析|详解|说明|知识点|考点|重点说明|备注"
EXPLANATION_BODY = rf"(?:(?:{EXPLANATION_WORDS}){WS}*[:：]|[【\[（(]{WS}*(?:{EXPLANATION_WORDS}){WS}*[】\]）)]){WS}*"
PAGE_FURNITURE = rf"(?iu)^(?:第?{WS}*\d+{WS}*页|page{WS}*\d+|[-—–]{WS}*\d+{WS}*[-—–]|背诵清单|目录|章节目录|第{WS}*[一二三四五六七八九十百\d]+{WS}*(?:章|节|单元)|(?:chapter|unit|section|part){WS}+(?:\d+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten){RB})(?:{WS}|\z)"
ANSWER_LEADS = (rf"^(?:参考)?答案{WS}*[:：]{WS}*", rf"^答{WS}*[:：]{WS}*")
ANSWER_TAILS = (rf"(?:参考)?答案{WS}*[:：]{WS}*\z", rf"答{WS}*[:：]{WS}*\z")
FRAGMENT_MIN_SCORE = 0.32
FRAGMENT_WHOLE_LINE_SHARE = 0.55

# --- fixed values: review schedule (milliseconds after stage 0, 1, ...) ---------------
MINUTE_MS, HOUR_MS, DAY_MS = 60_000, 3_600_000, 86_400_000
REVIEW_INTERVALS_MS = (10 * MINUTE_MS, DAY_MS, 2 * DAY_MS, 4 * DAY_MS, 7 * DAY_MS, 15 * DAY_MS, 30 * DAY_MS)
RECENT_ATTEMPTS = 500
DUE = ("现在", " 分钟后", " 小时后", " 天后")

# --- fixed values: meaning of answers ------------------------------------------------
MEANING_REWRITES = (
    (r"不可以|不能够|无法", "不能"),
    (r"可以|能够", "能"),
    (r"仅仅|仅能|只可", "只能"),
    (r"不会", "不"),
    (r"读取|读出", "读"),
    (r"写入", "写"),
    (r"只能(?=读.*不能写)", "能"),
    (r"但(?:是)?", ""),
    (r"构成", "组成"),
    (r"丢失|消失", "丢"),
    (r"保存|保留", "存"),
    (r"增长|提升|增大", "增加"),
    (r"降低|下降|减小", "减少"),
    (r"与|及", "和"),
    (r"输入装置", "输入设备"),
    (r"输出装置", "输出设备"),
    (r"进行|加以|主要|就是|指的是|负责|执行|做", ""),
    (rf"{LB}(?:stores?|keeps?|retains?){RB}", "save"),
    (rf"{LB}temporarily{RB}", "temporary"),
    (rf"{LB}(?:allows?|permits?){RB}", "allow"),
)
MEANING_FIRST_REWRITES = (
    (rf"{LB}input{WS}*/?{WS}*output{RB}", "io"),
    (r"只读(?:存储器)?", "只能读不能写存储器"),
)
ALIAS_GROUPS = (
    ("cpu", "中央处理器"),
    ("os", "操作系统"),
    ("ram", "随机存储器"),
    ("rom", "只读存储器"),
    ("cache", "高速缓冲存储器"),
    ("io设备", "输入输出设备", "inputoutputdevice"),
)
OPPOSITES = (
    ("增加", "减少"),
    ("上升", "下降"),
    ("输入", "输出"),
    ("输入设备", "输出设备"),
    ("递增", "递减"),
    ("运算器", "控制器"),
    ("内存", "外存"),
    ("系统软件", "应用软件"),
    ("随机存储器", "只读存储器"),
    ("ram", "rom"),
    ("串行", "并行"),
    ("正确", "错误"),
    ("真", "假"),
    ("快", "慢"),
    ("高", "低"),
    ("大", "小"),
)
POLARITY_TERMS = ("读", "写", "丢", "存", "允许", "增加", "减少", "输入", "输出", "递增", "递减")
NEGATION = "不|无|非|未|否|没|禁止"
POLARITY_NEGATION = "不|无|非|未|否|禁止"
SIMILARITY_WEIGHTS = (0.36, 0.16, 0.24, 0.16, 0.08)
SIMILARITY_GATES = (0.72, 0.58, 0.34)
CONFIRM_SIMILARITY = 0.62
REASONS = {
    "exact": "与参考答案一致",
    "choice": "选项精确匹配",
    "choice_wrong": "所选选项与正确选项不一致",
    "alias": "命中本地明确同义词或缩写规则",
    "close": "字面较接近，但本地规则无法安全判断关键关系是否一致",
    "wrong": "与参考答案的关键内容不一致",
    "empty": "参考答案为空",
    "parts": "各空均与参考答案一致",
    "count": ("需要按顺序填写 ", " 个答案"),
}

# --- fixed values: chat history ------------------------------------------------------
OPTION_PREFIX = rf"(?:\*\*)?([A-H])(?:\*\*)?{WS}*[.．、:：\)）]"
CONTEXT_TAGS = "codex_internal_context|in-app-browser-context|environment_context|app-context|permissions|recommended_plugins|developer_context"
INJECTED_CONTEXT = rf"(?is)<(?:{CONTEXT_TAGS}){RB}[^>]*>.*?</(?:{CONTEXT_TAGS})>"
UNCLOSED_CONTEXT = rf"(?is)<codex_internal_context{RB}[^>]*>.*\z"
REQUEST_MARKER = rf"(?is)##{WS}*My request for Codex{WS}*:{WS}*(.+)"
TITLE_CHARS = 56
MARK = r"(?:\*\*|`|_)*"
ANSWER_LABELS = (
    rf"(?iu)(?:the{WS}+)?correct{WS}+(?:answer|option){WS}*(?:is|[:：\-])*{WS}*{MARK}([A-H]){RB}",
    rf"(?iu){LB}correct{WS}*(?:is|[:：\-])+{WS}*(?:option{WS}+)?{MARK}([A-H]){RB}",
    rf"(?iu)(?:正确答案|参考答案){WS}*(?:是|为|[:：\-])*{WS}*{MARK}([A-H]){MARK}",
    rf"(?iu)(?:the{WS}+)?answer{WS}+is{WS}+(?:option{WS}+)?([A-H]){RB}",
    rf"(?iu)^{WS}*{MARK}([A-H]){MARK}(?:[.．、，。:：]|{WS}|\z)",
)
GENERIC_ANSWER_LABEL = rf"(?iu)(?:{LB}answer|答案){WS}*(?:是|为|[:：\-])*{WS}*(?:option{WS}+)?{MARK}([A-H]){RB}"
GENERIC_ANSWER_WINDOW = 28
GENERIC_ANSWER_DENIED = rf"(?iu)^{WS}*(?:(?:is{WS}+)?(?:incorrect|wrong|not{WS}+correct){RB}|(?:是|为)?(?:错误|不正确|错的|错误选项))"
ANSWER_LEAD = rf"(?iu)^{WS}*(?:\*\*)?(?:正确答案|参考答案|答案|correct{WS}+answer|answer)(?:\*\*)?{WS}*(?:是|为|[:：\-])*{WS}*{MARK}[A-H]{MARK}(?:[.．、，。:：\-]{WS}*)?"
EXPLANATION_LEAD = rf"(?iu)^{WS}*(?:解析|说明|理由|analysis|explanation){WS}*[:：\-]{WS}*"
KNOWLEDGE_LABEL = rf"(?iu)(?:^|\n){WS}*(?:[-*]{WS}*)?(?:知识点|核心结论|考点|结论|要点|knowledge{WS}*point){WS}*[:：\-]{WS}*([^\n]{{2,300}})"
ANSWER_LINE = rf"(?imu)^{WS}*(?:答案|answer){WS}*[:：\-].*$"
STATEMENT_CHARS = (8, 240)
SECTIONS = (
    ("补全对话", r"(?:a:|b:|speaker|dialogue|conversation|对话|交际)"),
    ("阅读理解", r"(?:passage|according to|article|paragraph|本文|短文|阅读)"),
    ("选句填空", r"(?:choose (?:a )?sentence|选句|句子填空)"),
    ("选词填空", r"(?:word bank|选词|词语填空)"),
)
CLOZE_SECTION, CLOZE_BLANKS, CLOZE_BLANK = "完形填空", 2, "_{2,}|＿{2,}|﹍{2,}"
DEFAULT_SECTION = "词汇与语法结构"
QUESTION_BLOCK = rf"(?:^|\n){WS}*(?:第{WS}*)?\d{{1,3}}{WS}*(?:题|[.．、:：)）]){WS}*"
NUMBERED_LABEL = rf"(?iu)(?:^|\n|{WS}){WS}*(?:第{WS}*)?\d{{1,3}}{WS}*(?:题|[.．、:：)）]){WS}*(?:(?:正确答案|参考答案|答案|answer){WS}*(?:是|为|[:：\-])*{WS}*)?([A-H]){RB}"
NAMED_LABEL = rf"(?iu)(?:正确答案|参考答案|答案|correct{WS}+answer){WS}*(?:是|为|is|[:：\-])*{WS}*([A-H]){RB}"
ROLE_TAG = rf"(?iu)(?:^|\n){WS}*(?:#{{1,4}}{WS}*)?(用户|user|human|提问|question|assistant|chatgpt|codex|助手|回答){WS}*[:：]{WS}*"
USER_ROLES = ("用户", "user", "human", "提问", "question")
TIME_KEYS = ("occurredAt", "createdAt", "create_time", "timestamp", "time", "date")
STEM_KEYS = ("stem", "question", "prompt", "query", "title")
CHOICE_KEYS = ("choices", "options")
ANSWER_KEYS = ("answer", "correctAnswer", "correct_answer", "correct")
EXPLANATION_KEYS = ("explanation", "analysis", "rationale", "response", "assistant")
KNOWLEDGE_KEYS = ("knowledgePoint", "knowledge_point", "knowledge", "point")
ARCHIVE_ENTRY = r"(?i)(?:conversations?(?:-\d+)?\.json|\.jsonl|\.md|\.txt)$"
ARCHIVE_FIRST = r"(?i)conversations?(?:-\d+)?\.json$"
MAX_IMPORT_BYTES, MAX_EXPANDED_BYTES = 80 * 1024 * 1024, 120 * 1024 * 1024
MAX_CANDIDATE_ENTRIES, MAX_ARCHIVE_ENTRIES = 256, 20_000
MAX_DOCUMENT_BYTES, MAX_PAGES = 60 * 1024 * 1024, 300
MAX_RASTER_PIXELS, MAX_RASTER_SCALE, MIN_RASTER_SCALE = 10_000_000, 2.0, 0.1
SOURCE_LABELS = {"chatgpt": "ChatGPT 今日记录", "codex": "Codex 今日记录", "manual": "手动导入"}
SECONDS_BELOW = 10_000_000_000

# --- fixed values: hashing and sampling ----------------------------------------------
FNV_START, FNV_PRIME = 2166136261, 16777619
LCG_FACTOR, LCG_STEP = 1664525, 1013904223

# --- fixed values: red marks ---------------------------------------------------------
RED_MIN, RED_OTHER_MAX, RED_DOMINANCE = 145, 150, 1.35
KERNING_SPACE = -120
MARK_MAX_SCORE, MARK_TEXT_PENALTY, MARK_Y_WEIGHT = 12, 8, 3
RASTER_MIN_RED = 0.00002
TEXT_LAYER_CHARS, OCR_PAGE_CHARS = 80, 40

# --- fixed values: demo points (text, context, location) -------------------------------
DEMO_SOURCE, DEMO_METHOD = "认知心理学示例.docx", "docx-color"
DEMO_POINTS = (
    ("海马体", "海马体在新记忆的形成与空间导航中发挥重要作用。", "第 3 段"),
    ("间隔效应", "间隔效应指将学习分散到多个时间段比集中学习更有利于长期记忆。", "第 8 段"),
    ("提取练习", "提取练习通过主动回忆来加强记忆，而不仅是重复阅读材料。", "第 12 段"),
    ("工作记忆", "工作记忆是对当前任务所需信息进行短时保持和加工的系统。", "第 17 段"),
    ("长时记忆", "长时记忆能够在较长时间内保存知识、经验和技能。", "第 22 段"),
    ("遗忘曲线", "遗忘曲线表明遗忘在学习后早期较快，之后速度逐渐减慢。", "第 26 段"),
)
