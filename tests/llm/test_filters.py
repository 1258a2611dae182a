import random

import pytest
import re

import numpy as np
from pyspark.sql import functions as F

from lorequarry.llm import decontaminate, language_id, quality_rules

from . import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    repeated = {p + j for places in seen.values() if len(places) > 1 for p in places for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def awkward_texts():
    rng = random.Random(7)
    texts = [r[1] for r in fixtures.rows()] + ["a b c d e f g h " * 3, "x\ny\nx\n \n \nx", "#a* $|", "no\x0bbreak\x1chere\xa0there \x85"]
    for _ in range(60):
        texts.append(" ".join(rng.choice(["a", "b", "c\n", "#d", "\n\n"]) for _ in range(rng.randint(0, 60))))
    return texts


def test_statistics_equal_brute_force():
    for text in awkward_texts():
        assert quality_rules.text_statistics(text)[:5] == brute_statistics(text), text


def test_rules_are_learned_and_emitted_alike(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        words = fixtures.words(rng, 60)
        if bad:
            words = [w + (" | " if rng.random() < 0.7 else "") for w in words] if k % 8 else [w for w in words[:12] for _ in range(5)]
        rows.append((k, " ".join(words), None, None, None, None, None))
        if k % 3:
            labels.append((k, 0 if bad else 1))
    rules = quality_rules.fit(fixtures.table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert rules.rules and all(r.conditions for r in rules.rules)
    got = {r["doc_id"]: r for r in quality_rules.apply(fixtures.table(spark, rows), rules).collect()}
    held_out = [k for k in range(400) if k % 3 == 0]
    assert sum(got[k]["kept"] == (k % 4 != 0) for k in held_out) >= 0.97 * len(held_out)
    stats = np.array([quality_rules.text_statistics(r[1]) for r in rows], float)
    column = dict(zip(quality_rules.STATISTICS, stats.T))
    table = {n: column[a] / (np.maximum(column[b], 1) if b else 1) for n, (a, b) in quality_rules.RATIOS.items()}
    verdicts = rules.predict(table, len(rows))
    assert all(got[k]["kept"] == (bool(verdicts[k]) and not got[k]["base_failed"]) for k in range(400))


def test_rules_on_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rules = quality_rules.fit(fixtures.table(spark), none)
    assert rules.rules == ()
    table = fixtures.table(spark)
    kept = quality_rules.filter_documents(table, rules)
    assert kept.columns == table.columns and kept.where("text is null").count() == 0
    assert kept.where("doc_id = 0").count() == 1 and quality_rules.filter_documents(fixtures.empty(spark), rules).count() == 0


def brute_counts(text):
    letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    padded = re.sub(" +", " ", f" {letters} ")
    out = {}
    for n in (1, 2, 3):
        for k in range(len(padded) - n + 1):
            if padded[k : k + n] != " ":
                out[padded[k : k + n]] = out.get(padded[k : k + n], 0) + 1
    return out


def unpack(code):
    points = []
    while code:
        points.append(chr(code & 0x1FFFFF))
        code >>= 21
    return "".join(reversed(points))


def test_ngram_counts_equal_brute_force(monkeypatch):
    rng = random.Random(1)
    texts = ["Ab  c", "é É ß", " x", "1 2", "中文 😀a"] + ["".join(rng.choice("abÉ .\n中") for _ in range(rng.randint(1, 90))) for _ in range(100)]
    for piece in (1 << 18, 7):
        monkeypatch.setattr(language_id, "PIECE", piece)
        for text in texts:
            codes, counts = language_id.ngram_counts(text)
            assert {unpack(int(c)): int(n) for c, n in zip(codes, counts)} == brute_counts(text), (piece, text)


def test_distance_equals_brute_force():
    rng = random.Random(3)
    profiles = {name: [int(c) for c in language_id.ranking(*language_id.ngram_counts(" ".join(fixtures.words(rng, 300)).translate(str.maketrans("aeiou", shift))))] for name, shift in (("one", "aeiou"), ("two", "uoiea"), ("three", "aaeeo"))}
    model = language_id.Profiles(profiles)
    for _ in range(30):
        text = " ".join(fixtures.words(rng, rng.randint(1, 40))).translate(str.maketrans("aeiou", rng.choice(["aeiou", "uoiea", "aaeeo"])))
        own = language_id.ranking(*language_id.ngram_counts(text)).tolist()
        apart = {n: sum(abs(p.index(c) - k) if c in p else language_id.PROFILE for k, c in enumerate(own)) for n, p in profiles.items()}
        name, score = model.nearest(text)
        assert apart[name] == min(apart.values()) and abs(score - (1 - apart[name] / (language_id.PROFILE * len(own)))) < 1e-9


def test_language_of_a_table(spark):
    rng = random.Random(2)
    rows = [(k, fixtures.prose(rng, 40).translate(str.maketrans("aeiou", ("aeiou", "öüäéè")[k % 2])), ("xx", "yy")[k % 2], None, None, None, None) for k in range(60)]
    profiles = language_id.train(fixtures.table(spark, rows[:40]))
    assert set(profiles) == {"xx", "yy"} and all(len(p) <= language_id.PROFILE for p in profiles.values())
    got = language_id.predict(fixtures.table(spark, rows[40:]), profiles, "doc_id", "lang").collect()
    assert all(r["lang"] == r["lang_pred"] and 0 < r["score"] <= 1 for r in got)
    odd = language_id.predict(fixtures.table(spark, [(1, None, None, None, None, None, None), (2, "123 !?", None, None, None, None, None), (3, "", None, None, None, None, None)]), profiles, "doc_id")
    assert {(r["lang_pred"], r["score"]) for r in odd.collect()} == {("und", 0.0)}
    assert language_id.train(fixtures.empty(spark)) == {} and language_id.predict(fixtures.empty(spark), {}, "doc_id").count() == 0
    assert language_id.predict(fixtures.table(spark, rows[:3]), {}, "doc_id").where("lang_pred = 'und'").count() == 3


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    words, hit, names = item_words(text), set(), set()
    for name, item in items:
        w = item_words(item)
        for win in {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else ():
            for k in range(len(words) - len(win) + 1):
                if tuple(words[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    names.add("" if name is None else str(name))
    return len(words), sorted(hit), sorted(names)


@pytest.mark.parametrize("broadcast", [decontaminate.MAX_BROADCAST_BYTES, -1])
def test_hits_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_BYTES", broadcast)
    rng = random.Random(4)
    items = [(k, " ".join(fixtures.words(rng, n))) for k, n in enumerate((25, 10, 12, 4, 2, 1, 30))] + [(7, None), (8, "..."), (None, " ".join(fixtures.words(rng, 11))), (1, "Straße über alles"), (9, "la la la la la la la la la la la la")]
    rows = []
    for k in range(40):
        w = fixtures.words(rng, rng.randint(5, 60))
        if k % 2:
            source = item_words(rng.choice(items)[1])
            at = rng.randint(0, len(w))
            w[at:at] = source if k % 4 == 1 else source[: rng.randint(0, len(source))]
        rows.append((k, " ".join(x.capitalize() if rng.random() < 0.2 else x for x in w) + rng.choice(["", ".", "!\n"]), None, None, None, None, "clash"))
    rows += [(90, "STRASSE Straße ÜBER alles straße über alles", None, None, None, None, None), (91, "la " * 40, None, None, None, None, None), (92, None, None, None, None, None, None), (93, "", None, None, None, None, None), (None, items[0][1], None, None, None, None, None), rows[1]]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.hits(fixtures.table(spark, rows), benchmark, "doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], sorted(r["hit"]), r["items"]) == brute_hits(r["text"], items), r["doc_id"]
    clean = decontaminate.clean_documents(fixtures.table(spark, rows), benchmark)
    assert clean.columns == fixtures.SCHEMA.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", ")
    assert clean.count() == sum(not brute_hits(r[1], items)[1] for r in rows)
    assert decontaminate.hits(fixtures.table(spark, rows), benchmark.limit(0), "doc_id").where(F.size("hit") > 0).count() == 0
    assert decontaminate.hits(fixtures.empty(spark), benchmark, "doc_id").count() == 0
