"""Text normalisers and scalar functions as Column builders."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed as X


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no built-in for. ASCII text is passed on as it is."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def sub(column: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(column, pattern, replacement)


def trim(column: Column) -> Column:
    return sub(column, rf"^{X.WS}+|{X.WS}+\z")


def matches(column: Column, pattern: str) -> Column:
    return column.rlike(pattern)


def tidy(column: Column) -> Column:
    """NBSP to space, runs of blanks to one, white space around line ends and at both ends cut."""
    blanks = sub(F.translate(column, "\u00a0", " "), r"[ \t]+", " ")
    return trim(sub(blanks, rf"{X.WS}*\n{X.WS}*", "\n"))


def clean(column: Column) -> Column:
    """Imported text: line ends unified, blanks collapsed, at most one empty line in a row."""
    lines = sub(F.translate(F.coalesce(column, F.lit("")), "\u00a0", " "), r"\r\n?", "\n")
    return trim(sub(sub(lines, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def _members(class_: str) -> str:
    """The characters of a class that ends in white space, for ``translate``."""
    listed = class_[1 : -len(X.WS[1:])].replace("\\", "")
    return listed + "\t\n\x0b\f\r " + "".join(chr(c) for a, b in X.WS_POINTS for c in range(a, b + 1))


def key(column: Column) -> Column:
    """Lower case without punctuation and white space; as that goes anyway, it need not be tidied."""
    return F.lower(F.translate(column, _members(X.KEY_PUNCTUATION), ""))


def structure_key(column: Column) -> Column:
    return F.lower(F.translate(column, _members(X.STRUCTURE_PUNCTUATION), ""))


def answer(column: Column) -> Column:
    """Comparable form of an answer; the input is expected in NFKC (see ``nfkc``)."""
    base = sub(sub(F.lower(trim(column)), r"\r\n?", "\n"), r"[ \t\n]+", " ")
    return F.when(base.rlike("[a-z0-9]"), trim(sub(base, X.LATIN_ANSWER_PUNCTUATION))).otherwise(sub(base, X.KEY_PUNCTUATION))


def choice_identity(column: Column) -> Column:
    """Case and inner space are kept; the input is expected in NFKC."""
    return trim(sub(F.coalesce(column, F.lit("")), r"\r\n?", "\n"))


def blank_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(X.BLANK))


def standard_blanks(column: Column) -> Column:
    return sub(tidy(column), X.BLANK, X.STANDARD_BLANK)


def is_numbered(column: Column) -> Column:
    return column.rlike(X.QUESTION_NUMBER)


def strip_number(column: Column) -> Column:
    return trim(sub(column, X.QUESTION_NUMBER))


def clean_answer(column: Column) -> Column:
    out = tidy(column)
    for pattern in X.ANSWER_LEADS:
        out = sub(out, pattern)
    return trim(out)


def useful_lines(column: Column) -> Column:
    edges = rf"^(?:{X.WS}|[\-•·])+|(?:{X.WS}|[\-•·])+\z"
    return F.filter(F.transform(F.split(tidy(column), r"\n+"), lambda x: trim(sub(x, edges))), lambda x: F.length(x) >= 2)


def sentences(column: Column) -> Column:
    return F.filter(F.transform(F.split(tidy(column), r"(?<=[。！？!?；;\n])"), trim), lambda x: x != "")


def sentence_around(full: Column, needle: Column) -> Column:
    """The first sentence that holds the needle, with the next one if it holds nothing else."""
    pieces, wanted = sentences(full), key(needle)
    keyed = F.transform(pieces, key)
    at = F.array_position(F.transform(keyed, lambda k: F.contains(k, wanted)), F.lit(True)).cast("int")
    found = F.try_element_at(pieces, at)
    following = F.try_element_at(pieces, at + 1)
    alone = (F.try_element_at(keyed, at) == wanted) & following.isNotNull()
    return F.when((tidy(full) == "") | (at == 0), needle).when(alone, F.concat_ws(" ", found, following)).otherwise(found)


def option_alphabet(column: Column) -> Column:
    wide = F.translate(column, "ＡＢＣＤＥＦＧＨａｂｃｄｅｆｇｈ", "ABCDEFGHabcdefgh")
    return sub(wide, rf"(?i)[（(]{X.WS}*([A-H]){X.WS}*[）)]", "$1.")


def choice(column: Column) -> Column:
    bare = sub(option_alphabet(clean(column)), rf"(?i)^(?:\*\*)?[A-H](?:\*\*)?{X.WS}*[.．、:：\)）]{X.WS}*")
    return trim(sub(bare, rf"^[-*]{X.WS}+"))


def shorten(column: Column, chars: int = X.TITLE_CHARS) -> Column:
    line = sub(clean(column), r"\n+", " ")
    return F.when(F.length(line) <= chars, line).otherwise(F.concat(F.substring(line, 1, chars - 1), F.lit("…")))


def strip_context(column: Column, unclosed: bool = True) -> Column:
    """Without injected context blocks; only what follows a request marker where there is one."""
    text = sub(clean(column), X.INJECTED_CONTEXT)
    text = trim(sub(text, X.UNCLOSED_CONTEXT) if unclosed else text)
    asked = F.regexp_extract(text, X.REQUEST_MARKER, 1)
    return clean(F.when(asked != "", asked).otherwise(text))


def timestamp_ms(value: Column, fallback: Column) -> Column:
    """Epoch milliseconds from seconds, milliseconds or an ISO string."""
    number = value.try_cast("double")
    parsed = (F.unix_micros(value.try_cast("timestamp")) / 1000).cast("double")
    return F.when(number.isNotNull(), F.when(number < X.SECONDS_BELOW, number * 1000).otherwise(number)).when(parsed.isNotNull(), parsed).otherwise(fallback.cast("double")).cast("bigint")


def utc(ms: Column) -> Column:
    """Epoch milliseconds as a timestamp without zone, whatever the session's zone is."""
    return F.timestamp_add("MILLISECOND", ms.cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def epoch_ms(ts: Column) -> Column:
    """The reverse of ``utc``."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def local_day(ms: Column, offset_minutes: Column | int) -> Column:
    """Calendar day at a fixed offset; minutes are those to add to local time to get UTC."""
    offset = F.lit(offset_minutes) if isinstance(offset_minutes, int) else offset_minutes
    return F.date_format(utc(ms - offset * 60_000), "yyyy-MM-dd")


def zone_day(ms: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc(ms)), "yyyy-MM-dd")


def format_due(due_ms: Column, now_ms: Column) -> Column:
    minutes = F.ceil((due_ms - now_ms) / X.MINUTE_MS)
    hours = F.ceil(minutes / 60)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    now, in_minutes, in_hours, in_days = X.DUE
    return F.when(due_ms <= now_ms, F.lit(now)).when(minutes < 60, say(minutes, in_minutes)).when(hours < 24, say(hours, in_hours)).otherwise(say(F.ceil(hours / 24), in_days))


def infer_source(name: Column, fallback: Column | str = "manual") -> Column:
    low = F.lower(name)
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return (
        F.when(F.contains(low, F.lit("conversation")) | F.contains(low, F.lit("chatgpt")), F.lit("chatgpt"))
        .when(F.contains(low, F.lit("rollout")) | F.contains(low, F.lit("codex")) | F.endswith(low, F.lit(".jsonl")), F.lit("codex"))
        .otherwise(other)
    )


def percentage(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 of nothing is 0."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(100.0 * part / F.nullif(whole, F.lit(0)) + 0.5)).cast("int")


def exam_section(stem: Column) -> Column:
    low = F.lower(stem)
    (n1, p1), (n2, p2), (n3, p3), (n4, p4) = X.SECTIONS
    cloze = F.regexp_count(low, F.lit(X.CLOZE_BLANK)) >= X.CLOZE_BLANKS
    return F.when(low.rlike(p1), n1).when(low.rlike(p2), n2).when(cloze, X.CLOZE_SECTION).when(low.rlike(p3), n3).when(low.rlike(p4), n4).otherwise(X.DEFAULT_SECTION)


def answer_shape(column: Column) -> Column:
    t = trim(column)
    return (
        F.when(t.rlike(r"^-?\d+(?:\.\d+)?%?\z"), "number")
        .when(t.rlike(r"(?i)^[a-z][a-z' -]*\z"), "english")
        .when(t.rlike(f"^{X.HAN}"), "chinese")
        .otherwise("mixed")
    )


def parts_or_text(parts: Column, text: Column) -> Column:
    """Trimmed answer parts, or else the text alone."""
    given = F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), trim), lambda x: x != "")
    return F.when(F.size(given) > 0, given).otherwise(F.filter(F.array(trim(text)), lambda x: x != ""))


def blank_stem(question: Column, context: Column, answer_text: Column, source: Column, location: Column) -> Column:
    ctx = trim(F.coalesce(context, F.lit("")))
    hidden = F.replace(ctx, answer_text, F.lit(" ______ "))
    told = F.concat(F.lit("根据《"), source, F.lit("》"), location, F.lit("的标红内容，写出完整知识点：______"))
    return (
        F.when(trim(F.coalesce(question, F.lit(""))) != "", standard_blanks(question))
        .when((ctx != "") & (ctx != answer_text) & F.contains(ctx, answer_text), hidden)
        .otherwise(told)
    )


def fill_other_blanks(question: Column, parts: Column, target: Column) -> Column:
    """Every blank but the target (from 0) shows its part."""
    pieces = F.split(standard_blanks(question), "______+")
    shown = lambda i: F.when(i == target, F.lit("______")).otherwise(F.concat(F.lit("「"), F.coalesce(F.nullif(F.get(parts, i), F.lit("")), F.lit("…")), F.lit("」")))
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(shown(i - 1), p))), "")


def point_identity(source: Column, text: Column, question: Column, context: Column) -> Column:
    about = F.when(F.coalesce(question, F.lit("")) != "", question).otherwise(F.coalesce(context, F.lit("")))
    return F.concat_ws("::", F.lower(source), key(text), key(about))


def first_present(document: Column, names, kind: str = "string") -> Column:
    """The first of the named fields of a VARIANT that isn't null."""
    return F.coalesce(*[F.try_variant_get(document, f"$.{n}", kind) for n in names])


def clean_explanation(column: Column) -> Column:
    text = clean(column)
    bare = trim(sub(sub(text, X.ANSWER_LEAD), X.EXPLANATION_LEAD))
    return F.when(bare != "", bare).otherwise(text)


def knowledge_statement(column: Column) -> Column:
    text = clean(column)
    labelled = clean(F.regexp_extract(text, X.KNOWLEDGE_LABEL, 1))
    low, high = X.STATEMENT_CHARS
    size = lambda p: F.length(sub(p, X.WS))
    parts = F.transform(F.split(sub(text, X.ANSWER_LINE), r"\n{2,}"), lambda p: trim(sub(p, rf"^#+{X.WS}*")))
    fit = F.filter(parts, lambda p: (size(p) >= low) & (size(p) <= high) & ~F.contains(p, F.lit("```")))
    return F.when(labelled != "", labelled).otherwise(F.coalesce(F.get(fit, 0), F.lit("")))


def answer_label(column: Column) -> Column:
    """The option letter that a text names as the answer, or ''."""
    text = option_alphabet(column)
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in X.ANSWER_LABELS]
    whole = F.regexp_extract(text, X.GENERIC_ANSWER_LABEL, 0)
    after = F.substr(text, F.position(whole, text) + F.length(whole), F.lit(X.GENERIC_ANSWER_WINDOW))
    generic = F.when((whole != "") & ~after.rlike(X.GENERIC_ANSWER_DENIED), F.regexp_extract(text, X.GENERIC_ANSWER_LABEL, 1))
    return F.upper(F.coalesce(*found, generic, F.lit("")))


def resolve_answer(column: Column, choices: Column) -> Column:
    """The choice that a label or a text stands for; an unknown label gives '', other texts themselves."""
    text = clean(column)
    label = F.coalesce(F.nullif(answer_label(text), F.lit("")), F.nullif(F.upper(F.regexp_extract(text, rf"(?i)^{X.WS}*([A-H]){X.WS}*\z", 1)), F.lit("")))
    same = F.filter(choices, lambda c: choice_identity(c) == choice_identity(text))
    return F.when(label.isNotNull(), F.coalesce(F.get(choices, F.ascii(label) - 65), F.lit(""))).otherwise(F.coalesce(F.get(same, 0), text))


def _prepared_options(column: Column) -> Column:
    return sub(option_alphabet(clean(column)), rf"(?i)[ \t]+(?={X.OPTION_PREFIX})", "\n")


def choice_block(column: Column) -> Column:
    """struct(stem, choices, labels); choices only if labels run A, B, C, ... and none is empty."""
    start = rf"(?:^|\n){X.WS}*(?:[-*]{X.WS}*)?{X.OPTION_PREFIX}{X.WS}*"
    stop = rf"(?=(?:\n{X.WS}*(?:[-*]{X.WS}*)?{X.OPTION_PREFIX})|\z)"
    text, prepared = option_alphabet(clean(column)), _prepared_options(column)
    pattern = f"(?is){start}(.*?){stop}"
    labels = F.transform(F.regexp_extract_all(prepared, F.lit(pattern), F.lit(1)), F.upper)
    choices = F.transform(F.regexp_extract_all(prepared, F.lit(pattern), F.lit(2)), choice)
    ordered = F.forall(F.transform(labels, lambda x, i: F.ascii(x) == 65 + i), lambda ok: ok)
    good = (F.size(choices) >= 2) & ordered & F.forall(choices, lambda c: c != "")
    stem = clean(F.get(F.split(prepared, f"(?is){start}", 2), 0))
    none = F.array().cast("array<string>")
    return F.struct(F.when(good, stem).otherwise(text).alias("stem"), F.when(good, choices).otherwise(none).alias("choices"), F.when(good, labels).otherwise(none).alias("labels"))


def question_blocks(column: Column) -> Column:
    """Numbered questions of a text with two or more of them, else the whole text."""
    text = clean(column)
    parts = F.split(text, f"(?={X.QUESTION_BLOCK})")
    starts = F.regexp_count(text, F.lit(X.QUESTION_BLOCK))
    blocks = F.filter(F.transform(F.filter(parts, lambda p: p.rlike(f"^(?:{X.QUESTION_BLOCK})")), clean), lambda p: p != "")
    return F.when(starts < 2, F.array(text)).otherwise(blocks)


def ordered_labels(column: Column) -> Column:
    text = option_alphabet(column)
    numbered = F.transform(F.regexp_extract_all(text, F.lit(X.NUMBERED_LABEL), F.lit(1)), F.upper)
    named = F.transform(F.regexp_extract_all(text, F.lit(X.NAMED_LABEL), F.lit(1)), F.upper)
    return F.when(F.size(numbered) > 0, numbered).otherwise(named)


def is_red(r: Column, g: Column, b: Column) -> Column:
    """Channels are 0 to 1 or 0 to 255; a value of at most 1 is scaled."""
    c = [F.floor(F.when(x <= 1, x * 255).otherwise(x) + 0.5) for x in (r, g, b)]
    return (c[0] >= X.RED_MIN) & (c[1] <= X.RED_OTHER_MAX) & (c[2] <= X.RED_OTHER_MAX) & (c[0] >= c[1] * X.RED_DOMINANCE) & (c[0] >= c[2] * X.RED_DOMINANCE)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    unit = lambda x: F.when(x > 1, x / 255).otherwise(x)
    mixed = lambda x: 255 * (1 - F.least(F.lit(1.0), unit(x) * (1 - unit(k)) + unit(k)))
    return F.struct(mixed(c).alias("r"), mixed(m).alias("g"), mixed(y).alias("b"))


def hex_to_rgb(column: Column) -> Column:
    part = lambda at: F.conv(F.substring(column, at, 2), 16, 10).cast("int")
    return F.when(column.rlike(r"(?i)^#[0-9a-f]{6}\z"), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def needs_ocr(red_lines: Column, has_raster: Column, structured: Column, chars: Column) -> Column:
    """Whether a page has to be recognised although it has a text layer."""
    return ~((red_lines > 0) & (~has_raster | (structured & (chars >= X.TEXT_LAYER_CHARS))))


#: What the id of a learning item's point begins with (a fixed value).
ITEM_POINT = "learning-point-"


def make_id(*parts: Column) -> Column:
    """An id that follows from its parts, in the form of a random one."""
    h = F.md5(F.concat_ws("\x00", *parts))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
