import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.llm import suffix_dedup

from . import fixtures


def brute(texts, length, keep):
    """Removed byte flags of each text by a table of all strings."""
    data = [(t or "").encode() for t in texts]
    places = {}
    for k, d in enumerate(data):
        for p in range(len(d) - length + 1):
            places.setdefault(d[p : p + length], []).append((k, p))
    flags = [np.zeros(len(d), bool) for d in data]
    for found in places.values():
        if len(found) > 1:
            for k, p in found[1 if keep == "first" else 0 :]:
                flags[k][p : p + length] = True
    return data, flags


def spans(flags):
    edge = np.diff(np.concatenate([[0], flags.astype(int), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def test_factors_equal_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        data = bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 120)))
        data += data[: rng.randint(0, len(data))]
        want = [max([0, *(next((n for n in range(len(data) - i + 1) if n == len(data) - i or data[i + n] != data[j + n]), 0) for j in range(i))]) for i in range(len(data))]
        assert suffix_dedup.longest_previous_factors(data).tolist() == want, data


def test_nearest_smaller():
    rng = random.Random(6)
    for _ in range(50):
        v = np.array(rng.sample(range(100), rng.randint(0, 60)))
        before, after = suffix_dedup.nearest_smaller(v)
        for k in range(len(v)):
            assert before[k] == max([j for j in range(k) if v[j] < v[k]], default=-1)
            assert after[k] == min([j for j in range(k + 1, len(v)) if v[j] < v[k]], default=len(v))


def test_equal_windows_choose_equal_grams():
    rng = random.Random(2)
    shared = bytes(rng.choice(b"abcd") for _ in range(400))
    a, b = b"x" * 37 + shared + b"y" * 90, b"q" * 300_000 + shared
    pick = lambda d: {p: h for h, p0, p1 in zip(*suffix_dedup.window_runs(d)) for p in range(p0, p1 + 1)}
    x, y = pick(a), pick(b)
    assert len(x) == len(a) - 199 and len(y) == len(b) - 199
    assert all(x[37 + k] == y[300_000 + k] for k in range(201))


def planted(seed=5):
    rng = random.Random(seed)
    passage = fixtures.prose(rng, 90)
    texts = [r[1] for r in fixtures.rows(seed)]
    texts += [fixtures.prose(rng, 40) + passage + fixtures.prose(rng, 20) for _ in range(4)]
    texts += [passage[:250] + "é" + passage[:230], "é" * 300, passage[100:]]
    return [(k, t, None, None, None, None, None) for k, t in enumerate(texts)]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_removed_bytes_equal_brute_force(spark, keep):
    data = planted()
    data_bytes, flags = brute([r[1] for r in data], 200, keep)
    got = suffix_dedup.remove_repeats(fixtures.table(spark, data), "doc_id", "n_words", keep=keep).collect()
    assert len(got) == len(data)
    for r in got:
        k = r["doc_id"]
        assert [(s["b"], s["e"]) for s in r["spans"]] == spans(flags[k]), k
        assert bytes(r["kept"]) == bytes(np.frombuffer(data_bytes[k], np.uint8)[~flags[k]])


def test_equal_rows_are_copies(spark):
    text = fixtures.prose(random.Random(1), 100)
    table = fixtures.table(spark, [(1, text, None, None, None, None, None)] * 3 + [(None, text, None, None, None, None, None), (2, None, None, None, None, None, None)])
    got = suffix_dedup.remove_repeats(table, "doc_id", keep="none")
    assert got.where(F.length("kept") == 0).count() == 5
    assert suffix_dedup.remove_repeats(fixtures.empty(spark), "doc_id").count() == 0
    assert hashlib.sha256(b"").hexdigest() == got.select(F.sha2("kept", 256)).first()[0]
