"""Language identification by rank-order profiles (out-of-place distance).

A profile is the list of a language's most frequent letter n-grams, n = 1 to 3, in
order of frequency. A text's own ranking is compared with each profile: every n-gram
adds the difference of its two ranks, or the largest difference where the profile
lacks it. The nearest profile names the language.

Defined results: a null text, or one without letters, is ``und`` with score 0; no
labelled row gives ``und`` for every text; equal distances go to the language that
sorts first; an empty table gives an empty table. Texts of any length are read whole,
in pieces whose counts are added up.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: N-grams in a profile, and in the ranking of a text.
PROFILE = 400
#: Texts a language's profile is made from, at most about; chosen by a hash of doc_id.
MAX_TEXTS = 4_000
PIECE = 1 << 18
UNKNOWN = "und"
_MAP: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space. Built once in a process."""
    global _MAP
    if _MAP is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha() and not 0xD800 <= c < 0xE000:
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _MAP = table
    return _MAP


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams; a code packs up to three code points, 21 bits each."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    table = _letters()
    all_codes, all_counts = [], []
    tail = np.array([32], np.uint32)
    for start in range(0, max(len(points), 1), PIECE):
        mapped = table[points[start : start + PIECE]]
        last = start + PIECE >= len(points)
        mapped = np.concatenate([tail, mapped, [32] if last else []]).astype(np.uint32)
        keep = np.ones(len(mapped), bool)
        keep[1:] = (mapped[1:] != 32) | (mapped[:-1] != 32)
        fresh = len(tail)
        mapped, old = mapped[keep], int(keep[:fresh].sum())
        m = mapped.astype(np.uint64)
        one = m[old:]
        two = (m[:-1] << np.uint64(21)) | m[1:]
        three = (two[:-1] << np.uint64(21)) | m[2:]
        # n-grams that end in this piece; the carried tail ends none of its own
        two, three = two[max(old - 1, 0) :], three[max(old - 2, 0) :]
        codes = np.concatenate([one[one != 32], two, three])
        codes.sort()
        edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        all_codes.append(codes[edge])
        all_counts.append(np.diff(np.append(edge, len(codes))))
        tail = mapped[-2:]
    if len(all_codes) == 1:
        return all_codes[0], all_counts[0]
    codes, inverse = np.unique(np.concatenate(all_codes), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate(all_counts)).astype(np.int64)


def ranking(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """Codes by falling count; equal counts in order of code."""
    if len(codes) > 4 * size:
        bound = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= bound], counts[counts >= bound]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    """Ranks of every n-gram in every language, as one matrix."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.uint64))
        self.ranks = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[k, np.searchsorted(self.codes, np.array(profiles[name], np.uint64))] = np.arange(len(profiles[name]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not has_letter(text):
            return UNKNOWN, 0.0
        own = ranking(*ngram_counts(text))
        at = np.minimum(np.searchsorted(self.codes, own), max(len(self.codes) - 1, 0))
        at = np.where(self.codes[at] == own, at, len(self.codes))
        theirs = self.ranks[:, at]
        apart = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        k = int(np.argmin(apart))
        return self.names[k], 1.0 - float(apart[k]) / (PROFILE * len(own))


def _count_batches(batches):
    total: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if text:
                codes, counts = ngram_counts(text)
                total.setdefault(lang, Counter()).update(dict(zip(codes.tolist(), counts.tolist())))
        for lang in [k for k, c in total.items() if len(c) > 200_000]:  # bounded; what goes on is added up by Spark
            yield _counted(lang, total.pop(lang))
    for lang, counter in total.items():
        yield _counted(lang, counter)


def _counted(lang: str, counter: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(counter), pa.string()), pa.array(list(counter), pa.int64()), pa.array(list(counter.values()), pa.int64())],
        names=["lang", "code", "n"],
    )


def train(labelled: DataFrame, max_texts: int = MAX_TEXTS) -> dict[str, list[int]]:
    """Profiles of the languages in ``labelled`` (doc_id, lang, text).

    About ``max_texts`` texts a language, by a hash of doc_id; a language's share
    follows from its count, so rare languages are used whole. What reaches the driver
    is PROFILE numbers a language.
    """
    from pyspark.sql import Window as W

    rows = labelled.where("lang is not null and text is not null")
    shares = rows.groupBy("lang").agg(F.count("*").alias("of")).withColumn("share", F.lit(max_texts) / F.col("of") * 1_000_000)
    chosen = rows.select("doc_id", "lang", "text").join(F.broadcast(shares.select("lang", "share")), "lang")  # a row a language
    chosen = chosen.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < F.col("share")).select("lang", "text")
    counts = common.arrow_map(chosen, f"{__name__}:_count_batches", "lang string, code bigint, n bigint")
    counts = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in top.select("lang", "rank", "code").collect():  # PROFILE rows a language
        profiles.setdefault(row["lang"], []).append((row["rank"], row["code"]))
    return {k: [c for _, c in sorted(v)] for k, v in profiles.items()}


def _predict_batches(batches, profiles):
    model = Profiles(profiles)
    for batch in batches:
        found = [model.nearest(t) for t in batch.column("text").to_pylist()]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            names=[*names, "lang_pred", "score"],
        )


def predict(docs: DataFrame, profiles: dict[str, list[int]], *keep: str) -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score`` of each text; only the text is looked at."""
    return common.per_text(docs, f"{__name__}:_predict_batches", "lang_pred string, score double", keep, profiles=profiles)
