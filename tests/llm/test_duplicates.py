import itertools
import random
import re

import numpy as np
import pyarrow as pa

from lorequarry.llm import common, jaccard_join, line_dedup, queries

from . import fixtures


def brute_components(data, shingle, percent):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()

    sets = [shingles(r[1]) for r in data]
    root = list(range(len(data)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, r in enumerate(data):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(find(k)) if s else r[0]) for k, (r, s) in enumerate(zip(data, sets))), key=str)


def families(seed):
    """Chains of ever more edited copies, so that many similarities lie near the threshold."""
    rng = random.Random(seed)
    out = []
    for f in range(12):
        w = fixtures.words(rng, rng.randint(6, 120))
        for _ in range(rng.randint(1, 9)):
            out.append((len(out), " ".join(w)))
            w = list(w)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "x" + str(rng.randrange(99))
    rng.shuffle(out)
    return [(d, t, None, None, None, None, None) for d, t in out]


def test_components_equal_brute_force(spark, monkeypatch):
    for data in (fixtures.rows(), families(1), families(2)):
        got = jaccard_join.components(fixtures.table(spark, data)).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(data, 4, 85)
    monkeypatch.setattr(jaccard_join, "HEAVY", 2)
    got = jaccard_join.components(fixtures.table(spark, families(3))).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(families(3), 4, 85)
    assert jaccard_join.components(fixtures.empty(spark)).count() == 0


def capped_families():
    """Four families of 32 texts (bags of words) in one group. In each the smallest text is
    linked with some members only, so its forest edges to the others are refuted; what is
    left open in three families fills the group's room, and all of that are links. Words
    take the bit of those they replace where bitmaps must not tell the texts apart."""
    token = {w: int(jaccard_join.shingle_set(w, 1)[0]) for w in (f"w{k}" for k in range(20_000))}
    pool = sorted(token, key=token.get)
    common_words, rest = pool[:40], itertools.cycle(random.Random(9).sample(pool[400:], 15_000))
    bit = lambda w: (token[w] >> 20) % 1024
    out = []
    for f in range(4):
        base = common_words + [next(rest) for _ in range(61 + 2 * f)]
        swap = lambda words, places: [next(rest) if k in places else w for k, w in enumerate(words)]
        a = swap(base, {40, 41, 42})
        b = [next(w for w in rest if bit(w) == bit(old)) if k in {43, 44, 45} else old for k, old in enumerate(a)]
        texts = [base[:40] + base[41:]] + [swap(a, {46 + k}) for k in range(3)] + [swap(b, {50 + k}) for k in range(28)]
        out += [(len(out) + k, " ".join(t), None, None, None, None, None) for k, t in enumerate(texts)]
    return out


def test_pairs_beyond_a_full_room_are_searched(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HEAVY", 10_000)  # the shared words stay first in the prefixes
    got = jaccard_join.components(fixtures.table(spark, capped_families()), 1, 90).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(capped_families(), 1, 90)


def below_the_threshold():
    """40 texts and 10 copies with one more change, in one group. Any two of the 40 share 90 of
    110 words, and words take the bit of those they replace, so bitmaps rule out none."""
    token = {w: int(jaccard_join.shingle_set(w, 1)[0]) for w in (f"w{k}" for k in range(20_000))}
    by_bit = {}
    for w in token:
        by_bit.setdefault((token[w] >> 20) % 256, []).append(w)
    base = random.Random(5).sample([ws.pop() for ws in by_bit.values()], 100)
    other = lambda w: by_bit[(token[w] >> 20) % 256].pop()
    texts = [base[:90] + [other(w) for w in base[90:]] for _ in range(40)]
    texts += [[other(t[0]), *t[1:]] for t in texts[:10]]
    return [(k, " ".join(t), None, None, None, None, None) for k, t in enumerate(texts)]


def test_rows_of_a_search_do_not_grow_with_pairs(spark, monkeypatch):
    made, write = [], common.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name in ("members", "candidates", "pairs", "open", "exact"):
            made.append(out.count())
        return out

    monkeypatch.setattr(common.Scratch, "write", counted)
    got = jaccard_join.components(fixtures.table(spark, below_the_threshold()), 1, 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(below_the_threshold(), 1, 85)
    members, *made = made
    assert max(made) <= members and len(made) <= 4  # a row a member and unit at most, and no repeated rounds


def test_large_tables_of_links_are_never_broadcast(spark, monkeypatch):
    plans, write = {}, common.Scratch.write

    def planned(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(self, df, name)

    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 1, raising=False)
    monkeypatch.setattr(common.Scratch, "write", planned)
    got = jaccard_join.components(fixtures.table(spark, below_the_threshold()), 1, 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(below_the_threshold(), 1, 85)
    assert plans["texts"].count("SortMergeJoin") >= 1  # keys
    assert plans["open"].count("SortMergeJoin") >= 2  # components and refuted pairs


def test_whole_sets_are_searched_in_blocks(spark, monkeypatch):
    want = brute_components(below_the_threshold(), 1, 85)
    for block, shingles in ((4096, 700), (20, 500_000)):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", shingles)
        got = jaccard_join.components(fixtures.table(spark, below_the_threshold()), 1, 85).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want


def test_exact_forest_equals_brute_force(monkeypatch):
    rng = random.Random(11)
    for turn in range(40):
        monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", (500_000, 60)[turn % 2])
        pool = [rng.getrandbits(64) for _ in range(rng.randint(3, 60))]
        sets = [np.array(sorted(set(rng.sample(pool, rng.randint(1, len(pool)))) | {rng.getrandbits(64) for _ in range(rng.randint(0, 3))}), np.uint64) for _ in range(rng.randint(1, 50))]
        sets += [np.union1d(s[rng.randint(0, 1) :], s[:1]) for s in sets]
        known = np.array([rng.randrange(1 + len(sets) // (1 + turn % 3)) for _ in sets])
        percent = rng.choice((50, 80, 85, 100))
        want = known.copy()
        for i, j in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                want[want == want[j]] = want[i]
        got, pairs = known.copy(), jaccard_join.exact_forest(sets, known, percent)
        for i, j in pairs:
            assert got[i] != got[j] and want[i] == want[j]
            got[got == got[j]] = got[i]
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i, j in itertools.combinations(range(len(sets)), 2))


def test_keep_one_leaves_one_of_each_component(spark):
    data = fixtures.rows()
    table = fixtures.table(spark, data)
    kept = jaccard_join.keep_one(table)
    assert kept.columns == table.columns
    groups = {}
    for d, n, c in brute_components(data, 5, 80):
        groups.setdefault(("none", d, len(groups)) if not n else c, []).append(d)
    assert kept.count() == len(groups)
    assert {r["doc_id"] for r in kept.collect()} == {min((d for d in g if d is not None), default=None) for g in groups.values()}


def test_tree_finds_all_that_a_plain_search_finds():
    rng = random.Random(3)
    for _ in range(20):
        base = [rng.getrandbits(64) for _ in range(rng.randint(20, 300))]
        sets = []
        for _ in range(rng.randint(2, 150)):
            s = set(base)
            for _ in range(rng.randint(0, len(base) // 4)):
                s.discard(rng.choice(base))
                s.add(rng.getrandbits(64))
            sets.append(np.array(sorted(s), np.uint64))
        sets.sort(key=len)
        bits = [jaccard_join.bitmap(s) for s in sets]
        sizes = np.array([len(s) for s in sets])
        n, refuted, linked = len(sets), set(), np.arange(len(sets))
        while True:
            found = jaccard_join.group_candidates(sizes, bits, linked, refuted, 85, forest=not refuted)
            if not found:
                break
            for i, j in found:
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (sizes[i] + sizes[j] - both):
                    linked[linked == linked[j]] = linked[i]
                else:
                    refuted.add((i, j))
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (sizes[i] + sizes[j] - both):
                    assert linked[i] == linked[j]


def test_close_lines_pass_the_sketch():
    rng = random.Random(7)
    passed = tried = far = 0
    for _ in range(600):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(39))
        other = line[:20] + "7" + line[21:]
        stranger = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(39))
        own = line_dedup.entries(*[line_dedup.signatures([line, other, stranger], 4, 0, line_dedup.BANDS_AT_ONCE)[k] if k != 1 else np.arange(3, dtype=np.uint64) for k in range(3)])[:, 0]
        near = line_dedup.close(own[0], own[1:])
        passed, tried, far = passed + bool(near[0]), tried + 1, far + bool(near[1])
    assert passed >= 0.99 * tried and far <= 0.02 * tried


def test_connected_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {k: find(k) for k in list(root)}
    for size in (500_000, 60):  # one task; several tasks and rounds
        got = common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(6), edges_per_task=size).collect()
        assert {r["id"]: r["component"] for r in got} == want and len(got) == len(want)
    assert common.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_lines(data, percent=80):
    """Remaining text of each row; rows are told apart by (doc_id, text)."""
    places = []
    for r in sorted({(r[0] is None, r[0] or 0, r[1]) for r in data if r[1]}):
        places += [(*r, k, line_dedup.normal(x)) for k, x in enumerate(r[2].split("\n")) if x.strip()]
    # short lines are linked by equality
    sets = [{p[4][k : k + 4] for k in range(len(p[4]) - 3)} if len(p[4]) >= line_dedup.MIN_CHARS else {p[4], ""} for p in places]
    root = list(range(len(places)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(places)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    gone = {p[:4] for k, p in enumerate(places) if find(k) != k}
    out = []
    for r in data:
        if r[1] is None:
            out.append((r[0], None))
        else:
            out.append((r[0], "\n".join(x for k, x in enumerate(r[1].split("\n")) if (r[0] is None, r[0] or 0, r[1], k) not in gone)))
    return sorted(out, key=str)


def line_families(seed):
    rng = random.Random(seed)
    lines = []
    for _ in range(25):
        w = fixtures.words(rng, rng.randint(8, 30))
        for _ in range(rng.randint(1, 40 if rng.random() < 0.1 else 4)):
            lines.append(" ".join(w) + rng.choice(["", ".", " "]))
            if rng.random() < 0.6:
                w = list(w)
                w[rng.randrange(len(w))] = "zz"
    rng.shuffle(lines)
    return [(k, "\n".join(lines[5 * k : 5 * k + 5]), None, None, 0, None, None) for k in range(len(lines) // 5 + 1)]


def test_lines_equal_brute_force(spark):
    for data in (fixtures.rows(), line_families(1), line_families(2)):
        got = line_dedup.remove_duplicate_lines(fixtures.table(spark, data), "doc_id").collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == brute_lines(data)
    assert line_dedup.remove_duplicate_lines(fixtures.empty(spark), "doc_id").count() == 0


def edited_lines(seed):
    """(line, edited line) of 40 to 80 characters: one inner character, or one word of three letters."""
    rng = random.Random(seed)
    out = []
    for k in range(60):
        n = rng.randint(40, 80) if k % 2 else rng.randint(60, 80)
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        at = rng.randint(8, n - 12)
        if k % 2:
            out.append((line, line[:at] + "7" + line[at + 1 :]))
        else:
            out.append((line[:at] + " old " + line[at + 5 :], line[:at] + " new " + line[at + 5 :]))
    return out


def test_small_edits_in_ordinary_lines_are_found(spark, tmp_path):
    pairs = edited_lines(5)
    data = [(2 * k + j, line, None, None, 0, None, None) for k, p in enumerate(pairs) for j, line in enumerate(p)]
    fixtures.table(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["n_removed"] for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {k: k % 2 for k in range(len(data))}
    text = {r["doc_id"] for r in line_dedup.clean_documents(fixtures.table(spark, data)).collect()}
    assert text == {k for k in range(len(data)) if k % 2 == 0}


def test_short_lines_are_linked_by_equality(spark, tmp_path):
    texts = ["Home\n\nOne of its own\nAll rights reserved.", "home \n\n\nAnother\n All  rights reserved.", "Home\nAll rights reserved", "x\nx\ny"]
    data = [(k, t, None, None, 0, None, None) for k, t in enumerate(texts)]
    fixtures.table(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["n_removed"] for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 2, 2: 1, 3: 1}
    left = {r["doc_id"]: r["text"] for r in line_dedup.clean_documents(fixtures.table(spark, data)).collect()}
    assert left == {0: texts[0], 1: "\n\nAnother", 2: "All rights reserved", 3: "x\ny"}


def test_bands_find_pairs_at_the_threshold():
    rng = random.Random(6)
    for shingle in (4, 8):
        met = tried = 0
        for _ in range(400):
            line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9 * shingle + shingle - 1))
            other = line[: len(line) // 2] + "7" + line[len(line) // 2 + 1 :]
            a, b = (line_dedup.shingles(x, shingle) for x in (line, other))
            if 10 * len(np.intersect1d(a, b)) != 8 * len(np.union1d(a, b)):
                continue  # a shingle came twice
            bands, sizes = line_dedup.band_hashes([line, other], shingle)
            assert sizes.tolist() == [len(a), len(b)]
            met += bool((bands[0] == bands[1]).any())
            tried += 1
        assert tried >= 300 and met >= 0.98 * tried


def test_line_stage_keeps_columns(spark):
    table = fixtures.table(spark)
    kept = line_dedup.clean_documents(table)
    assert kept.columns == table.columns and kept.dtypes == table.dtypes
    ids = {r["doc_id"] for r in kept.collect()}
    assert {30, 31, 32}.isdisjoint(ids) and set(range(30)) <= ids and {37, 38, 39, 40, 41} <= ids  # nothing was left of the copies
    assert all(r["text"] is None or r["n_chars"] in (None, len(r["text"])) for r in kept.collect())


def test_a_forest_reaches_everything_that_is_linked():
    rng = random.Random(4)
    kind = np.array([rng.randrange(5) for _ in range(60)])
    labels = np.arange(60)
    labels[kind == 2] = 100  # connected already
    pairs = line_dedup.grow(60, labels, lambda k, others: kind[others] == kind[k])
    assert len(pairs) == len(set(labels.tolist())) - 5
    root = {k: k for k in range(60)}
    for a, b in [*pairs, *[(int(x), int(np.flatnonzero(kind == 2)[0])) for x in np.flatnonzero(kind == 2)]]:
        old, new = root[a], root[b]
        root = {k: new if r == old else r for k, r in root.items()}
    assert all((root[i] == root[j]) == (kind[i] == kind[j]) for i in range(60) for j in range(60))


def test_blocks_of_large_groups_are_searched_two_by_two(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 2)
    got = line_dedup.remove_duplicate_lines(fixtures.table(spark, line_families(3)), "doc_id").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == brute_lines(line_families(3))
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    got = jaccard_join.components(fixtures.table(spark, families(4))).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(families(4), 4, 85)


def test_lines_are_signed_once_for_all_bands(spark, monkeypatch):
    mapped, arrow_map = [], common.arrow_map

    def noted(df, target, schema, **params):
        mapped.append(target.split(":")[1])
        return arrow_map(df, target, schema, **params)

    monkeypatch.setattr(common, "arrow_map", noted)
    got = line_dedup.remove_duplicate_lines(fixtures.table(spark, line_families(3)), "doc_id").collect()
    assert mapped.count("_entry_batches") == 1
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == brute_lines(line_families(3))


def searched_units(units, monkeypatch):
    """Links that the search finds in units of one lead, and the number of its comparisons by sketch."""
    rows, asked, close = [], [], line_dedup.close
    for k, lines in enumerate(units):
        for line in sorted(lines, key=line_dedup.line_id):
            sketch = line_dedup.signatures([line], 4, 0, line_dedup.BANDS)[2].tobytes()
            rows.append((1, k, 0, line_dedup.line_id(line), sketch, line, line_dedup.line_id(line)))
    names = ["lead", "bucket", "unit", "line", "sketch", "text", "label"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    monkeypatch.setattr(line_dedup, "close", lambda *x: asked.append(1) or close(*x))
    found = [r for b in line_dedup._search_batches(iter([batch]), 80, 4) for r in b.to_pylist()]
    monkeypatch.setattr(line_dedup, "close", close)
    return {frozenset((r["line_a"], r["line_b"])) for r in found}, len(asked)


def test_units_of_a_lead_are_searched_as_one(monkeypatch):
    rng = random.Random(11)
    base = "".join(rng.choice("abcdefghijklmnop") for _ in range(80))
    near = base[:40] + "7" + base[41:]
    others = ["".join(rng.choice("abcdefghijklmnop") for _ in range(80)) for _ in range(4)]
    link = {frozenset(line_dedup.line_id(x) for x in (base, near))}
    one = searched_units([[base, near, *others]], monkeypatch)
    assert one[0] == link and searched_units([[base, near, *others]] * 5, monkeypatch) == one
    # what doesn't fit into one pack is searched in several
    monkeypatch.setattr(line_dedup, "PACK", 3)
    assert searched_units([[base, others[0]], [base, near, others[1]], [others[2], others[3]], [near, *others]], monkeypatch)[0] == link


def test_a_task_without_shared_buckets_is_empty():
    lines = ["".join(random.Random(k).choice("abcdefghijklmnop") for _ in range(60)) for k in range(5)]
    dealt = [b.to_pydict() for b in line_dedup._entry_batches(iter([pa.RecordBatch.from_pydict({"text": ["\n".join(lines)]})]), 4, 0, line_dedup.BANDS, 1)]
    batch = pa.RecordBatch.from_pydict({"task": pa.array(dealt[0]["task"], pa.int32()), "entries": dealt[0]["entries"]})
    assert len(dealt) == 1 and list(line_dedup._bucket_batches(iter([batch]), 80)) == []
    again = pa.RecordBatch.from_pydict({"task": pa.array([0, 0], pa.int32()), "entries": dealt[0]["entries"] * 2})
    assert sum(b.num_rows for b in line_dedup._bucket_batches(iter([again]), 80)) == 0
