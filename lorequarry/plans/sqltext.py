"""Pieces of DuckDB SQL for the queries' equivalents."""

from __future__ import annotations

import re

from ..functions import fixed as X
from ..functions import taxonomy as C


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A fixed Java pattern in RE2's dialect, whose \\b and \\s are ASCII."""
    out = pattern.replace(X.LB, r"\b").replace(X.RB, r"\b").replace(X.WS, r"\s").replace(X.WS[1:-1], r"\s")
    out = out.replace("(?iu)", "(?i)").replace("(?imu)", "(?im)")
    return lit(out)


def sub(column: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({column}, {re2(pattern)}, {lit(replacement)}, 'g')"


def trim(column: str) -> str:
    return sub(column, r"^\s+|\s+$")


def tidy(column: str) -> str:
    return trim(sub(sub(column, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def clean(column: str) -> str:
    lines = sub(f"coalesce({column}, '')", r"\r\n?", "\n")
    return trim(sub(sub(lines, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def key(column: str) -> str:
    return f"lower({sub(tidy(column), X.KEY_PUNCTUATION)})"


def structure_key(column: str) -> str:
    return f"lower({sub(tidy(column), X.STRUCTURE_PUNCTUATION)})"


def answer(column: str) -> str:
    base = sub(sub(f"lower({trim(column)})", r"\r\n?", "\n"), r"[ \t\n]+", " ")
    latin = trim(sub(base, X.LATIN_ANSWER_PUNCTUATION))
    return f"CASE WHEN regexp_matches({base}, '[a-z0-9]') THEN {latin} ELSE {sub(base, X.KEY_PUNCTUATION)} END"


def shorten(column: str, n: int = X.TITLE_CHARS) -> str:
    line = sub(clean(column), r"\n+", " ")
    return f"CASE WHEN length({line}) <= {n} THEN {line} ELSE substr({line}, 1, {n - 1}) || '…' END"


def meaning(column: str) -> str:
    """Without the rewrites of Chinese words, which the driver's text has none of."""
    out = f"lower({column})"
    for pattern, replacement in (*X.MEANING_FIRST_REWRITES, *X.MEANING_REWRITES):
        if not re.search("[一-鿿]", pattern):
            out = sub(out, pattern, replacement)
    return trim(sub(out, X.MEANING_PUNCTUATION))


def bigrams(t: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({t}), 1)), lambda i: substr({t}, i, 2)))"


def units(t: str) -> str:
    stem = lambda x: sub(sub(x, "(?:ing|ed|es|s)$"), "(?:tion|ment)$")
    return f"list_distinct(list_transform(regexp_extract_all({t}, '[a-zA-Z]+|\\d+(?:\\.\\d+)?'), lambda u: {stem('u')}))"


def dice(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


def coverage(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END"


def subject_score(t: str, subject: str) -> str:
    return " + ".join(f"CASE WHEN regexp_matches({t}, {re2(p)}) THEN {float(w)}::DOUBLE ELSE 0.0::DOUBLE END" for p, w, _ in C.SUBJECT_RULES[subject])


def category(t: str, subject: str) -> str:
    rules = sorted(enumerate(C.CATEGORY_RULES[subject]), key=lambda x: (-x[1][2], x[0]))
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, {re2(p)}) THEN {lit(n)}" for _, (n, p, _, _) in rules) + f" ELSE {lit(C.CATEGORIES[subject][-1])} END"


ATTEMPTS = "SELECT user_id AS point_id, epoch_us(ts) // 1000 AS ts_ms, event_id AS ord, event_type IN ('view', 'click', 'purchase') AS correct FROM events"
_WAIT = f"[{', '.join(map(str, X.REVIEW_INTERVALS_MS))}]"
#: The schedule of every point, one attempt after another.
FOLD = f"""
a AS ({ATTEMPTS}),
n AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ts_ms, ord) AS k FROM a),
s AS (
  SELECT point_id, k, 0 AS stage, ts_ms + {X.REVIEW_INTERVALS_MS[0]} AS nextReviewAt, 1 AS attempts, correct::INT AS correct, (NOT correct)::INT AS wrong, ts_ms AS lastReviewedAt, correct AS lastCorrect
  FROM n WHERE k = 1
  UNION ALL
  SELECT point_id, k, stage, CASE WHEN c AND NOT due THEN nextReviewAt ELSE ts_ms + ({_WAIT})[stage + 1] END, attempts + 1, correct + c::INT, wrong + (NOT c)::INT, ts_ms, c
  FROM (SELECT n.point_id, n.k, n.ts_ms, n.correct AS c, s.nextReviewAt <= n.ts_ms AS due, s.nextReviewAt, s.attempts, s.correct, s.wrong,
               CASE WHEN NOT n.correct THEN 0 WHEN s.nextReviewAt <= n.ts_ms THEN least(s.stage + 1, {len(X.REVIEW_INTERVALS_MS) - 1}) ELSE s.stage END AS stage
        FROM s JOIN n ON n.point_id = s.point_id AND n.k = s.k + 1)
),
f AS (SELECT point_id, stage, nextReviewAt, attempts::BIGINT AS attempts, correct::BIGINT AS correct, wrong::BIGINT AS wrong, lastReviewedAt, lastCorrect
      FROM s QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY k DESC) = 1)
"""


def shuffled(name: str, source: str) -> str:
    """CTEs that shuffle the lists ``v`` of ``source`` (seed, v, ..): rows of ``name`` with i <= 1 hold the result."""
    lcg = f"(state * {X.LCG_FACTOR} + {X.LCG_STEP}) & 4294967295"
    fnv = f"list_reduce(list_prepend({X.FNV_START}::BIGINT, list_transform(string_split(seed, ''), lambda c: ord(c)::BIGINT)), lambda x, c: (xor(x, c) * {X.FNV_PRIME}) & 4294967295)"
    return f"""{name} AS (SELECT seed, v, {fnv} AS state, len(v) AS i FROM ({source})
  UNION ALL SELECT seed, list_transform(v, lambda x, k: CASE WHEN k = i THEN v[j + 1] WHEN k = j + 1 THEN v[i] ELSE x END), s, i - 1
  FROM (SELECT seed, v, i, {lcg} AS s, ({lcg}) % i AS j FROM {name} WHERE i > 1))"""


def knowledge_statement(column: str) -> str:
    text = clean(column)
    labelled = clean(f"regexp_extract({text}, {re2(X.KNOWLEDGE_LABEL)}, 1)")
    low, high = X.STATEMENT_CHARS
    size = f"length({sub('p', X.WS)})"
    parts = f"list_transform(regexp_split_to_array({sub(text, X.ANSWER_LINE)}, '\\n{{2,}}'), lambda p: {trim(sub('p', '^#+' + X.WS + '*'))})"
    fit = f"list_filter({parts}, lambda p: {size} >= {low} AND {size} <= {high} AND NOT contains(p, '```'))"
    return f"CASE WHEN {labelled} <> '' THEN {labelled} ELSE coalesce({fit}[1], '') END"


def rules() -> str:
    """The classifier's rules as rows."""
    rows = [f"('subject', {lit(s)}, NULL, {k + 1}, {lit(p)}, {float(w)}::DOUBLE, {lit(r)})" for s, own in C.SUBJECT_RULES.items() for k, (p, w, r) in enumerate(own)]
    rows += [f"('category', {lit(s)}, {lit(c)}, {k + 1}, {lit(p)}, {float(w)}::DOUBLE, {lit(r)})" for s, own in C.CATEGORY_RULES.items() for k, (c, p, w, r) in enumerate(own)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(level, subject, category, ord, pattern, weight, reason)"
