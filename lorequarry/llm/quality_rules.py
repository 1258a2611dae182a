"""Quality rules: a decision list learned by sequential covering.

Statistics of every text are gathered in one pass. From labelled rows the learner
grows conjunctions of thresholds (FOIL gain), prunes them on held-back rows and
removes what they cover, until no rule is precise enough. The list is emitted as one
ordered Spark ``CASE`` expression, so that applying it needs no Python.

Defined results: a null or empty text has zero for every statistic, so it has fewer
than the required words and fails the base rules; equal texts get equal results; an
empty table gives an empty table; columns of ``keep`` that bear the name of a statistic
or verdict are replaced by it, while ``filter_documents`` keeps all of the caller's own;
doc_id may have any type.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: The learner sees at most about this many labelled rows, chosen by a hash of doc_id.
MAX_LABELLED = 40_000
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_caps", "n_digits", "n_lines", "n_distinct_words", "n_stops", "n_punct", "max_word")
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "capitals_per_char": ("n_caps", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "distinct_per_word": ("n_distinct_words", "n_words"),
    "punctuation_per_char": ("n_punct", "word_chars"),
    "words": ("n_words", None),
    "longest_word": ("max_word", None),
}
_SPACES = b" \t\n\x0b\x0c\r"


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The statistics of one text, in the order of STATISTICS."""
    if not text:
        return (0,) * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(STATISTICS)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeated = 0
    if n > WINDOW:
        window = np.zeros(n - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            window = window * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - WINDOW + 1 + k]
            window ^= window >> np.uint64(29)
        order = np.argsort(window)
        ranked = window[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(len(window), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeated = int((np.cumsum(edge[:n]) > 0).sum())
    bytes_ = np.frombuffer(raw, np.uint8)
    kinds = _KIND[bytes_]
    count = np.bincount(kinds, minlength=4)
    short = sum(1 for w in words if len(w) <= 3)
    return (n, word_chars, symbols, len(lines) - len(set(lines)), repeated, int(count[1]), int(count[2]), len(lines), len(set(words)), short, int(count[3]), max(map(len, words)))


#: Byte classes: 1 capital letter, 2 digit, 3 other printable ASCII that is no letter or space.
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3


def _statistics_batches(batches):
    for batch in batches:
        rows = [text_statistics(t) for t in batch.column("text").to_pylist()]
        columns = list(zip(*rows)) if rows else [()] * len(STATISTICS)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [pa.array(c, pa.int64()) for c in columns], names=names + list(STATISTICS)
        )


_STATISTICS = ", ".join(f"{s} bigint" for s in STATISTICS)


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` and the statistics of each text; one narrow pass."""
    return common.per_text(docs, f"{__name__}:_statistics_batches", _STATISTICS, keep)


def ratio(name: str) -> Column:
    top, bottom = RATIOS[name]
    value = F.col(top).cast("double")
    return value if bottom is None else F.coalesce(value / F.nullif(F.col(bottom), F.lit(0)), F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] > self.threshold if self.above else table[self.feature] <= self.threshold

    def column(self) -> Column:
        return ratio(self.feature) > self.threshold if self.above else ratio(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    keep: bool

    def holds(self, table: dict[str, np.ndarray], n: int) -> np.ndarray:
        out = np.ones(n, bool)
        for c in self.conditions:
            out &= c.holds(table)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return f"if {' and '.join(map(str, self.conditions))}: {'keep' if self.keep else 'drop'}"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]
    default: bool = True

    def column(self) -> Column:
        """The verdict as an ordered conditional expression over the statistics."""
        out = None
        for rule in self.rules:
            out = F.when(rule.column(), F.lit(rule.keep)) if out is None else out.when(rule.column(), F.lit(rule.keep))
        return F.lit(self.default) if out is None else out.otherwise(F.lit(self.default))

    def predict(self, table: dict[str, np.ndarray], n: int) -> np.ndarray:
        out, open_ = np.full(n, self.default), np.ones(n, bool)
        for rule in self.rules:
            hit = open_ & rule.holds(table, n)
            out[hit] = rule.keep
            open_ &= ~hit
        return out


def _precision(covered_bad: int, covered: int) -> float:
    return (covered_bad + 1) / (covered + 2)


def _grow(table, bad, weight_rows, limit: int = 4) -> tuple[Condition, ...]:
    conditions: list[Condition] = []
    inside = weight_rows.copy()
    while len(conditions) < limit:
        p0, n0 = int((inside & bad).sum()), int(inside.sum())
        if not p0 or p0 == n0:
            break
        base, best = np.log2(p0 / n0), (1e-9, None)
        for name in RATIOS:
            values = table[name][inside]
            flags = bad[inside]
            order = np.argsort(values, kind="stable")
            v, run = values[order], np.cumsum(flags[order])
            ends = np.flatnonzero(np.append(v[1:] != v[:-1], False))
            if not len(ends):
                continue
            low_n, low_p = ends + 1, run[ends]
            middle = (v[ends] + v[ends + 1]) / 2
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / n) - base), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), Condition(name, above, float(middle[k])))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= best[1].holds(table)
    return tuple(conditions)


def _prune(conditions, table, bad, rows) -> tuple[Condition, ...]:
    """Drop final conditions while the held-back (p - n) / (p + n) does not fall."""

    def worth(cs):
        hit = rows.copy()
        for c in cs:
            hit &= c.holds(table)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = conditions
    for k in range(len(conditions) - 1, 0, -1):
        if worth(conditions[:k]) >= worth(best):
            best = conditions[:k]
    return best


def learn(table: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, min_precision: float = 0.85, min_cover: int = 3, max_rules: int = 24) -> DecisionList:
    """Sequential covering for the rows to drop. ``fold``: true where held back for pruning."""
    n = len(bad)
    left, rules = np.ones(n, bool), []
    while len(rules) < max_rules and (left & bad).any():
        conditions = _grow(table, bad, left & ~fold)
        if not conditions:
            break
        conditions = _prune(conditions, table, bad, left & fold)
        rule = Rule(conditions, keep=False)
        hit = left & rule.holds(table, n)
        covered, wrong = int(hit.sum()), int((hit & bad).sum())
        held = hit & fold
        if covered < min_cover or _precision(wrong, covered) < min_precision or (held.any() and _precision(int((held & bad).sum()), int(held.sum())) < min_precision - 0.15):
            break
        rules.append(rule)
        left &= ~hit
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Learn the list from labelled documents that pass the base rules.

    Labelled rows beyond about ``max_labelled`` are thinned by a hash of doc_id; the
    join only moves the statistics of labelled rows. No labels: everything is kept.
    """
    spark = docs.sparkSession
    marked = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = marked.count()
    if not total:
        return DecisionList(())
    if total > max_labelled:
        share = int(max_labelled / total * 1_000_000)
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < share)
    marked = F.broadcast(marked)  # about max_labelled pairs, which reach the driver below in any case
    joined = docs.select("doc_id", "text").join(marked, "doc_id")
    rows = statistics(joined, "doc_id", "quality").where(~base_failed())
    fold = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(3)).alias("fold")
    rows = rows.select("quality", fold, *[ratio(r).alias(r) for r in RATIOS]).orderBy("fold", "quality", *RATIOS).toPandas()
    if not len(rows):
        return DecisionList(())
    table = {r: rows[r].to_numpy(float) for r in RATIOS}
    fold = rows["fold"].to_numpy() == 0
    return learn(table, rows["quality"].to_numpy() == 0, fold)


def apply(docs: DataFrame, rules: DecisionList, *keep: str) -> DataFrame:
    """Columns ``keep`` with the statistics, ``base_failed`` and ``kept``."""
    keep = [k for k in keep or ("doc_id",) if k.lower() not in ("base_failed", "kept")]
    return statistics(docs, *keep).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.column())


def filter_documents(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents that the list keeps, with their own columns."""
    kept, names = common.packed(docs, docs.columns)
    judged = apply(docs.select(kept, "text"), rules, common.KEEP).where("kept")
    return common.unpacked(judged, names)
