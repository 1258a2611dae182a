"""Set similarities, meaning of answers, and grading, all as Column expressions.

Inputs of the meaning functions are expected in NFKC (``text.nfkc``). An expression
that is used more than once is bound to a lambda variable by ``let``, so that Spark
evaluates it once a row instead of once a use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from . import text as T


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def dice(left: Column, right: Column) -> Column:
    """2 |A ∩ B| / (|A| + |B|) of arrays without repeats; 0 if either is empty."""
    total = F.size(left) + F.size(right)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(left, right)) / total)


def coverage(expected: Column, submitted: Column) -> Column:
    """|A ∩ B| / |A|; 0 if A is empty."""
    return F.when(F.size(expected) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(expected, submitted)) / F.greatest(F.size(expected), F.lit(1)))


def bigrams(column: Column) -> Column:
    """Distinct pairs of neighbouring characters, white space left out."""
    t = T.sub(column, X.WS)
    places = F.when(F.length(t) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.length(t) - 1))
    return F.array_distinct(F.transform(places, lambda i: F.substr(t, i, F.lit(2))))


def units(column: Column) -> Column:
    """Latin words and numbers without common endings, and Han characters."""
    tokens = F.regexp_extract_all(column, F.lit(r"(?i)[a-z]+|\d+(?:\.\d+)?"), F.lit(0))
    stems = F.transform(tokens, lambda t: T.sub(T.sub(t, r"(?:ing|ed|es|s)\z"), r"(?:tion|ment)\z"))
    return F.array_union(stems, F.regexp_extract_all(column, F.lit(X.HAN), F.lit(0)))


def meaning(column: Column) -> Column:
    out = F.lower(column)
    for pattern, replacement in (*X.MEANING_FIRST_REWRITES, *X.MEANING_REWRITES):
        out = T.sub(out, pattern, replacement)
    return T.trim(T.sub(T.sub(out, X.MEANING_FUNCTION_CHARACTERS), X.MEANING_PUNCTUATION))


def alias_of_meaning(normal: Column) -> Column:
    """The number of the first alias group that holds the meaning, or null. Groups are normalised once, as literals."""
    group = None
    for k, names in enumerate(X.ALIAS_GROUPS):
        same = normal.isin([])
        for name in names:
            same = same | (normal == meaning(F.lit(name)))
        group = F.when(same, F.lit(k)) if group is None else group.when(same, F.lit(k))
    return group


def alias(column: Column) -> Column:
    return alias_of_meaning(meaning(column))


def polarity(column: Column, term: str) -> Column:
    """1 if the term only occurs affirmed, -1 if only denied, else 0 (absent or both).

    It is denied where a negation lies in the three characters before it.
    """
    every = F.regexp_count(column, F.lit(term))
    denied = F.regexp_count(column, F.lit(f"(?<=(?:{X.POLARITY_NEGATION}).{{0,2}}){term}"))
    return F.when((every == 0) | ((denied > 0) & (denied < every)), 0).when(denied > 0, -1).otherwise(1)


def contradicts(submitted: Column, expected: Column) -> Column:
    """Opposite facts, and against or, opposite polarity, or other comparisons."""
    has = lambda c, word: F.contains(c, F.lit(word))
    out = F.lit(False)
    for a, b in X.OPPOSITES:
        out = out | ((has(expected, a) != has(expected, b)) & (has(submitted, a) != has(submitted, b)) & (has(expected, a) != has(submitted, a)))
    for a, b in (("和", "或"), ("或", "和")):
        out = out | (has(expected, a) & ~has(expected, b) & has(submitted, b))
    for term in X.POLARITY_TERMS:
        out = out | (polarity(expected, term) * polarity(submitted, term) == -1)
    compared = lambda c: F.regexp_extract_all(c, F.lit(r"[<>≤≥=]-?\d+(?:\.\d+)?"), F.lit(0))
    return out | ((F.size(compared(expected)) > 0) & (compared(expected) != compared(submitted)))


def _fixed3(score: Column) -> Column:
    """Three decimals by the exact binary value, ties up."""
    exact = score.cast("decimal(38,30)")
    return F.floor(exact * 1000 + F.lit("0.5").cast("decimal(2,1)")).cast("double") / 1000


def score_of_meanings(submitted: Column, expected: Column) -> Column:
    """The weighted score before gates, and its components, as a struct."""
    e, s = units(expected), units(submitted)
    shorter, longer = F.least(F.length(expected), F.length(submitted)), F.greatest(F.length(expected), F.length(submitted))
    parts = F.struct(coverage(e, s).alias("ce"), coverage(s, e).alias("cs"), dice(e, s).alias("du"), dice(bigrams(expected), bigrams(submitted)).alias("db"), (shorter / F.greatest(longer, F.lit(1))).alias("lr"))
    we, ws, wd, wb, wl = X.SIMILARITY_WEIGHTS
    return let(parts, lambda p: F.struct(p["ce"].alias("ce"), p["cs"].alias("cs"), p["db"].alias("db"), (p["ce"] * we + p["cs"] * ws + p["du"] * wd + p["db"] * wb + p["lr"] * wl).alias("score")))


def meaning_similarity(submitted: Column, expected: Column) -> Column:
    """0 to 1, three decimals."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"[+-]?\d+(?:\.\d+)?"), F.lit(0))
    gate_e, gate_s, gate_b = X.SIMILARITY_GATES

    def judge(p):
        s, e = p["s"], p["e"]
        blocked = (
            (s.rlike(X.NEGATION) != e.rlike(X.NEGATION))
            | contradicts(s, e)
            | (numbers(s) != numbers(e))
            | (F.least(F.length(s), F.length(e)) < 4)
        )
        touching = F.contains(e, s) | F.contains(s, e)
        weighed = let(score_of_meanings(s, e), lambda q: F.when((q["ce"] < gate_e) | (q["cs"] < gate_s) | (~touching & (q["db"] < gate_b)), F.lit(0.0)).otherwise(_fixed3(q["score"])))
        return (
            F.when((s == "") | (e == ""), F.lit(0.0))
            .when((s == e) | F.coalesce(alias_of_meaning(s) == alias_of_meaning(e), F.lit(False)), F.lit(1.0))
            .when(blocked, F.lit(0.0))
            .otherwise(weighed)
        )

    return let(F.struct(meaning(submitted).alias("s"), meaning(expected).alias("e")), judge)


def meaning_close(submitted: Column, expected: Column) -> Column:
    latin = submitted.rlike("(?i)[a-z]") | expected.rlike("(?i)[a-z]")
    return let(
        F.struct(meaning(submitted).alias("s"), meaning(expected).alias("e")),
        lambda p: F.coalesce(alias_of_meaning(p["s"]) == alias_of_meaning(p["e"]), F.lit(False)) | (~latin & (p["s"] != "") & (p["s"] == p["e"])),
    )


def _grade(verdict: str, reason, similarity, decision: str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    similarity = F.lit(float(similarity)) if isinstance(similarity, (int, float)) else similarity
    return F.struct(F.lit(verdict).alias("verdict"), reason.alias("reason"), similarity.alias("similarity"), F.lit(decision).alias("decision"))


def grade_single(submitted: Column, expected: Column, is_choice: Column) -> Column:
    """struct(verdict, reason, similarity, decision) of one answer against one expected answer."""
    latin = submitted.rlike("(?i)[a-z]") | expected.rlike("(?i)[a-z]")
    literal = T.choice_identity(submitted) == T.choice_identity(expected)
    exact = F.when(is_choice | latin, literal).otherwise(T.answer(submitted) == T.answer(expected))
    close = let(
        meaning_similarity(submitted, expected),
        lambda m: F.when(m >= X.CONFIRM_SIMILARITY, _grade("needs-confirmation", X.REASONS["close"], m, "alias")).otherwise(_grade("incorrect", X.REASONS["wrong"], m, "strict")),
    )
    return (
        F.when(is_choice & exact, _grade("correct", X.REASONS["choice"], 1, "strict"))
        .when(exact, _grade("correct", X.REASONS["exact"], 1, "exact"))
        .when(is_choice, _grade("incorrect", X.REASONS["choice_wrong"], 0, "strict"))
        .when(meaning_close(submitted, expected), _grade("correct", X.REASONS["alias"], 1, "alias"))
        .otherwise(close)
    )


def _nonempty(column: Column) -> Column:
    return F.filter(F.transform(column, T.trim), lambda p: p != "")


def alternatives(expected: Column) -> Column:
    """Slash-separated alternatives, but not those of fractions, algebra or protocol pairs."""
    parts = _nonempty(F.split(expected, r"[/／|]"))

    def pick(p):
        all_are = lambda pattern: F.forall(p, lambda x: x.rlike(pattern))
        one_value = (F.size(p) == 2) & (all_are(r"^[+-]?\d+(?:\.\d+)?\z") | all_are(r"(?i)^[a-z](?:\^\d+)?\z") | all_are(r"^[A-Z][A-Z0-9.+-]{1,7}\z"))
        return F.when((F.size(p) < 2) | one_value, _nonempty(F.array(expected))).otherwise(p)

    return let(parts, pick)


def grade_expected(submitted: Column, expected: Column, is_choice: Column) -> Column:
    """The best grade over the alternatives: correct, then to be confirmed, then the first."""
    grades = F.transform(alternatives(expected), lambda e: grade_single(submitted, e, is_choice))

    def best(g):
        first = lambda v: F.get(F.filter(g, lambda x: x["verdict"] == v), 0)
        return F.coalesce(first("correct"), first("needs-confirmation"), F.get(g, 0), _grade("incorrect", X.REASONS["empty"], 0, "strict"))

    return let(grades, best)


def grade_answer(value: Column, answer: Column, parts: Column, kind: Column) -> Column:
    """Grade of a submitted value; several parts must come in order and number."""
    is_choice = F.coalesce(kind == "choice", F.lit(False))
    wanted = _nonempty(F.coalesce(parts, F.array().cast("array<string>")))
    explicit = _nonempty(F.split(value, r"[；;\n|]+"))
    spaced = _nonempty(F.split(T.trim(value), rf"{X.WS}+"))
    n = F.size(wanted)
    given = F.when(F.size(explicit) == n, explicit).when(F.size(spaced) == n, spaced)
    single = grade_expected(value, F.coalesce(F.get(wanted, 0), answer), is_choice)
    told = F.concat(F.lit(X.REASONS["count"][0]), n.cast("string"), F.lit(X.REASONS["count"][1]))
    grades = F.transform(wanted, lambda e, i: grade_expected(F.get(given, i), e, is_choice))

    def together(g):
        first = lambda v: F.get(F.filter(g, lambda x: x["verdict"] == v), 0)
        wrong, unsure = first("incorrect"), first("needs-confirmation")
        least = F.array_min(F.transform(g, lambda x: x["similarity"]))
        by_alias = F.exists(g, lambda x: x["decision"] == "alias")
        confirm = F.struct(unsure["verdict"].alias("verdict"), unsure["reason"].alias("reason"), least.alias("similarity"), unsure["decision"].alias("decision"))
        right = F.struct(F.lit("correct").alias("verdict"), F.lit(X.REASONS["parts"]).alias("reason"), F.lit(1.0).alias("similarity"), F.when(by_alias, "alias").otherwise("exact").alias("decision"))
        return F.when(wrong.isNotNull(), wrong).when(unsure.isNotNull(), confirm).otherwise(right)

    return F.when(n <= 1, single).when(given.isNull(), _grade("incorrect", told, 0, "strict")).otherwise(let(grades, together))


def match_keys(a: Column, b: Column) -> Column:
    """Containment of one structure key in the other, by length."""
    la, lb = F.length(a), F.length(b)
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(F.contains(a, b), lb / F.greatest(la, F.lit(1)))
        .when(F.contains(b, a), la / F.greatest(lb, F.lit(1)) * 0.9)
        .otherwise(F.lit(0.0))
    )


def match_score(line: Column, fragment: Column) -> Column:
    return let(F.struct(T.structure_key(line).alias("a"), T.structure_key(fragment).alias("b")), lambda p: match_keys(p["a"], p["b"]))
