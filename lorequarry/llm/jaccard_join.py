"""N-gram Jaccard self-join by signature trees.

Every text becomes the set of its word shingles. Texts with equal sets (128 bits) are one
class. Classes that could be linked share a token of their prefixes (the first tokens of
a set in one order of all tokens, as many as an unlinked pair could miss), so they meet
in the group of that token. The order is by hash, with tokens that many documents share
last. Groups with the same members are searched once. In a group, a signature tree holds
the members: every node has the OR of its members' token bitmaps, their size range and
the largest number of tokens that bitmaps can hide. A dual traversal drops pairs of
nodes whose largest possible overlap is below what a link needs.

Only connectivity is asked for, so a traversal passes over pairs that are connected
already and emits a spanning forest of what is left, at most one pair a member; groups
with one least member are searched in one task as one forest. The pairs are verified
exactly on the texts. A group's members are dealt to blocks of about
BLOCK; first every block is searched for itself, then, in groups that are not connected
by then, every two blocks together, so that no task holds more than two blocks.

Where pairs were refuted, that forest says nothing about the others. Its units are
traversed once more for the members that have an open pair: neither connected, ruled out
by the bound nor refuted. Their sets meet whole, and shared tokens are counted where the
prefixes in that company's own order of tokens (fewest members first) have one in common.
Only a spanning forest of links comes out of it, at most one a member, so after this every
pair in every group is connected, ruled out by a bound, or refuted. No row stands for a
pair that isn't linked, but for those of the first forests.

Defined results: null, empty and blank texts have the empty set and are linked with
nothing; a text of fewer words than a shingle is one shingle; a null doc_id takes part
but names no component unless all of its members lack one; equal rows are linked;
doc_id may have any ordered type; an empty table gives an empty table. A text and its
set are held whole, a batch at a time.
"""

from __future__ import annotations

import itertools
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 4
PERCENT = 85
#: Bits of a bitmap for each token, at least; the number of words is a power of two.
#: Two are enough to tell apart sets that share no more than half of their tokens.
BITS_PER_TOKEN = 2
LEAF = 32
BLOCK = 4096
#: Shingles of the sets that a block holds whole, about; 8 bytes each.
BLOCK_SHINGLES = 500_000
#: Tokens in the prefixes of more documents than this go last in the order of prefixes;
#: the bound rises so that there are never more than MAX_HEAVY of them.
HEAVY, MAX_HEAVY = 64, 100_000
SETS_KEPT = 64
WORD_ENTRIES = 400_000
_K1, _K2, _K3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_WORDS: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _K2
    h = (h ^ (h >> np.uint64(29))) * _K3
    return h ^ (h >> np.uint64(32))


def _folded(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    h = np.full(len(ids) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mix(h * _K1 + ids[k : len(ids) - n + 1 + k])
    return h


def shingle_sets(texts: list[str | None], shingle: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles."""
    known = _WORDS
    if len(known) > WORD_ENTRIES:
        known.clear()
    split = [t.encode("utf-8", "replace").lower().split() if t else [] for t in texts]
    words = [w for ws in split for w in ws]
    for w in [w for w in set(words) if w not in known]:
        known[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    whole = _folded(ids, shingle) if len(ids) >= shingle else ids[:0]
    out, at = [], 0
    for ws in split:
        n = len(ws)
        s = whole[at : at + n - shingle + 1].copy() if n >= shingle else _folded(ids[at : at + n], n) if n else ids[:0]
        s.sort()
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
        at += n
    return out


def forget() -> None:
    _WORDS.clear()


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return shingle_sets([text], shingle)[0]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def bitmap(hashes: np.ndarray) -> np.ndarray:
    words = 1 << max(0, (len(hashes) * BITS_PER_TOKEN // 64 - 1)).bit_length()
    bits = np.zeros(words * 64, bool)
    bits[(hashes >> np.uint64(20)) % np.uint64(words * 64)] = True
    return np.packbits(bits, bitorder="little").view("<u8")


def prefix_tokens(s: np.ndarray, heavy: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set in order of (heavy, hash), as many as a link can't do without."""
    if len(heavy):
        at = np.searchsorted(heavy, s)
        at[at == len(heavy)] = 0
        last = heavy[at] == s
        if last.any():
            s = np.concatenate([s[~last], s[last]])
    return s[: prefix_length(len(s), percent)]


def _token_batches(batches, shingle, percent):
    """The prefix tokens of a batch with their numbers of documents."""
    none = np.zeros(0, np.uint64)
    for batch in batches:
        found = [prefix_tokens(s, none, percent) for s in shingle_sets(batch.column("text").to_pylist(), shingle) if len(s)]
        if found:
            tokens, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n, pa.int64())], names=["token", "n"])


_SIGNATURES = "id binary, n_shingles bigint, prefix array<bigint>, bits binary"


def _signature_batches(batches, shingle, percent, heavy):
    for batch in batches:
        names = [n for n in batch.schema.names if n != "text"]
        sets = shingle_sets(batch.column("text").to_pylist(), shingle)
        ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        prefixes = [prefix_tokens(s, heavy, percent).view(np.int64) if len(s) else None for s in sets]
        bits = [bitmap(s).tobytes() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names], pa.array(ids, pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
            names=[*names, "id", "n_shingles", "prefix", "bits"],
        )


class SignatureTree:
    """A binary tree over rows sorted by size; children halve the range."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ones = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.nodes: dict[tuple[int, int], tuple] = {}
        self._build(0, len(sizes))

    def _build(self, lo: int, hi: int):
        if hi - lo <= LEAF:
            both = np.bitwise_or.reduce(self.bits[lo:hi], axis=0)
            node = (both, int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max()), int((self.sizes[lo:hi] - self.ones[lo:hi]).max()))
        else:
            mid = (lo + hi) // 2
            a, b = self._build(lo, mid), self._build(mid, hi)
            node = (a[0] | b[0], min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
        self.nodes[lo, hi] = node
        return node

    def may_link(self, a: tuple[int, int], b: tuple[int, int], percent: int) -> bool:
        """Whether the largest possible overlap of the nodes' members reaches the smallest needed."""
        (or_a, min_a, max_a, hid_a), (or_b, min_b, max_b, hid_b) = self.nodes[a], self.nodes[b]
        if 100 * max_a < percent * min_b or 100 * max_b < percent * min_a:
            return False
        most = min(int(np.bitwise_count(or_a & or_b).sum()) + min(hid_a, hid_b), max_a, max_b)
        return most * (100 + percent) >= percent * (min_a + min_b)

    def pairs(self, a: tuple[int, int], b: tuple[int, int], percent: int) -> np.ndarray:
        """The same for all pairs of two leaves."""
        x, y = self.bits[a[0] : a[1], None, :], self.bits[None, b[0] : b[1], :]
        both = np.bitwise_count(x & y).sum(axis=2).astype(np.int64)
        n, m = self.sizes[a[0] : a[1], None], self.sizes[None, b[0] : b[1]]
        most = np.minimum(both + n - self.ones[a[0] : a[1], None], both + m - self.ones[None, b[0] : b[1]])
        most = np.minimum(most, np.minimum(n, m))
        return most * (100 + percent) >= percent * (n + m)


def _halves(r: tuple[int, int]) -> list[tuple[int, int]]:
    return [(r[0], (r[0] + r[1]) // 2), ((r[0] + r[1]) // 2, r[1])]


def _traverse(tree: SignatureTree, rows: np.ndarray, labels: np.ndarray, refuted: np.ndarray, percent: int, forest: bool, met: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Dual traversal over the tree of ``rows``; see ``group_candidates``. ``labels`` is changed in place.

    With ``met`` no pairs are returned; the members that have one are set in it.
    """
    out: list[tuple[int, int]] = []
    whole = (0, len(rows))
    stack = [(whole, whole)]
    while stack:
        a, b = stack.pop()
        la, lb = labels[rows[a[0] : a[1]]], labels[rows[b[0] : b[1]]]
        if (la == la[0]).all() and (a == b or (lb == la[0]).all()):
            continue
        if met is not None and met[rows[a[0] : a[1]]].all() and met[rows[b[0] : b[1]]].all():
            continue
        if a != b and not tree.may_link(a, b, percent):
            continue
        wide_a, wide_b = a[1] - a[0] > LEAF, b[1] - b[0] > LEAF
        if wide_a or wide_b:
            if a == b:
                lo, hi = _halves(a)
                stack += [(lo, hi), (hi, hi), (lo, lo)]
            else:
                stack += [(x, y) for x in (_halves(a) if wide_a else [a]) for y in (_halves(b) if wide_b else [b])]
            continue
        near = tree.pairs(a, b, percent)
        if a == b:
            near = np.triu(near, 1)
        near &= la[:, None] != lb[None, :]
        if len(refuted):
            for i, j in (refuted.T, refuted.T[::-1]):
                here = (i >= a[0]) & (i < a[1]) & (j >= b[0]) & (j < b[1])
                near[i[here] - a[0], j[here] - b[0]] = False
        if met is not None:
            met[rows[a[0] : a[1]]] |= near.any(axis=1)
            met[rows[b[0] : b[1]]] |= near.any(axis=0)
            continue
        if not forest:
            i, j = np.nonzero(near)
            out += zip(rows[i + a[0]].tolist(), rows[j + b[0]].tolist())
            continue
        while near.any():
            i, j = divmod(int(near.argmax()), near.shape[1])
            i, j = int(rows[i + a[0]]), int(rows[j + b[0]])
            out.append((i, j))
            labels[labels == labels[j]] = labels[i]
            near &= labels[rows[a[0] : a[1]], None] != labels[None, rows[b[0] : b[1]]]
    return out


def _trees(sizes: np.ndarray, bitmaps: list[np.ndarray], refuted: set[tuple[int, int]], percent: int):
    """Bitmaps double in width with the size, so members are searched by width, together
    with those of twice the width that are small enough to be linked, folded."""
    widths = np.array([len(b) for b in bitmaps])
    pairs = np.array(sorted(refuted), np.int64).reshape(-1, 2)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        more = np.flatnonzero((widths == 2 * width) & (percent * sizes <= 100 * sizes[own].max()))
        rows = np.concatenate([own, more])
        if len(rows) < 2:
            continue
        bits = np.array([bitmaps[k] for k in own] + [bitmaps[k][:width] | bitmaps[k][width:] for k in more], np.uint64)
        place = np.full(len(sizes), -1)
        place[rows] = np.arange(len(rows))
        inside = place[pairs]
        yield SignatureTree(sizes[rows], bits), rows, inside[(inside >= 0).all(axis=1)]


def group_candidates(sizes: np.ndarray, bitmaps: list[np.ndarray], labels: np.ndarray, refuted: set[tuple[int, int]], percent: int, forest: bool = True) -> list[tuple[int, int]]:
    """Pairs of a group's members that may be linked and that ``labels`` doesn't connect yet.

    Members must be sorted by size. ``refuted`` holds pairs known not to be linked. With
    ``forest`` the pairs are a spanning forest; without it they are all such pairs.
    """
    labels = labels.copy()
    out: list[tuple[int, int]] = []
    for tree, rows, inside in _trees(sizes, bitmaps, refuted, percent):
        out += _traverse(tree, rows, labels, inside, percent, forest)
    return list(dict.fromkeys(out))


def open_members(sizes: np.ndarray, bitmaps: list[np.ndarray], labels: np.ndarray, refuted: set[tuple[int, int]], percent: int) -> np.ndarray:
    """Which members are in a pair that ``group_candidates`` would return without ``forest``."""
    met = np.zeros(len(sizes), bool)
    for tree, rows, inside in _trees(sizes, bitmaps, refuted, percent):
        _traverse(tree, rows, labels, inside, percent, False, met)
    return met


def exact_forest(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets that ``labels`` doesn't connect yet.

    Tokens are ordered by the number of these sets that hold them, so what only one or a
    few hold comes first in the prefixes. A link has a token in both prefixes.
    """
    labels, n = labels.copy(), len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    _, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    ids = rank[ids]
    own = [np.sort(ids[e - s : e]) for s, e in zip(sizes, ends)]
    ids = np.concatenate(own)
    prefixes = [o[: prefix_length(len(o), percent)] for o in own]
    tokens = np.concatenate(prefixes)
    by_token = np.argsort(tokens, kind="stable")
    tokens, holders = tokens[by_token], np.repeat(np.arange(n), [len(p) for p in prefixes])[by_token]
    inside = np.zeros(len(count), bool)
    out: list[tuple[int, int]] = []
    top = np.bincount(labels).argmax()  # an open pair has an end outside of the largest label
    for i in np.flatnonzero(labels != top).tolist():
        lo, hi = np.searchsorted(tokens, prefixes[i]), np.searchsorted(tokens, prefixes[i], "right")
        others = np.unique(np.concatenate([holders[x:y] for x, y in zip(lo.tolist(), hi.tolist())]))
        fits = (labels[others] != labels[i]) & (100 * sizes[others] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[others])
        others = others[fits]
        inside[own[i]] = True
        for part in np.array_split(others, min(len(others), -(-int(sizes[others].sum()) // BLOCK_SHINGLES))) if len(others) else ():
            lengths = sizes[part]
            starts = np.cumsum(lengths) - lengths
            at = np.arange(int(lengths.sum())) + np.repeat(ends[part] - lengths - starts, lengths)
            both = np.add.reduceat(inside[ids[at]], starts, dtype=np.int64)
            for j in part[100 * both >= percent * (lengths + sizes[i] - both)].tolist():
                if labels[j] != labels[i]:
                    labels[labels == labels[j]] = labels[i]
                    out.append((i, j))
        inside[own[i]] = False
    return out


def _runs(batches, names: tuple[str, ...], n_key: int):
    """Lists of neighbouring rows that are equal in their first ``n_key`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in names]):
            if held and row[:n_key] != held[0][:n_key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _tables(found, names: list[str]):
    """Rows of whole numbers as record batches."""
    while rows := list(itertools.islice(found, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)


_UNIT = ("lead", "token", "unit", "num", "n_shingles", "bits", "label", "refuted")


def _arrays(held: list[tuple], tops: list) -> tuple:
    """What ``group_candidates`` takes of a unit's rows, with ``tops`` as labels."""
    number: dict = {}
    labels = np.array([number.setdefault(t, len(number)) for t in tops], np.int64)
    place = {r[3]: k for k, r in enumerate(held)}
    refuted = {(k, place[o]) for k, r in enumerate(held) for o in r[7] or () if o in place}
    return np.array([r[4] for r in held], np.int64), [np.frombuffer(r[5], "<u8") for r in held], labels, refuted


def _search_batches(batches, percent):
    """Rows (lead, token, unit, num, n_shingles, bits, label, refuted) sorted in this order.

    Units of one lead mostly hold the same members. A forest goes over all of them, so
    that what one has emitted counts as connected in the next; pairs are emitted once.
    """
    root: dict[int, int] = {}
    seen: set[tuple[int, int]] = set()

    def find(k):
        while (up := root.get(k, k)) != k:
            k = up
        return k

    def found():
        last = None
        for held in _runs(batches, _UNIT, 3):
            if held[0][0] != last:
                root.clear()
                seen.clear()
                last = held[0][0]
            tops = [find(r[6]) for r in held]
            if len(set(tops)) == 1:
                continue
            for i, j in group_candidates(*_arrays(held, tops), percent):
                pair = min(held[i][3], held[j][3]), max(held[i][3], held[j][3])
                low, high = sorted((find(tops[i]), find(tops[j])))
                root[high] = low
                if pair not in seen:
                    seen.add(pair)
                    yield last, *pair

    return _tables(found(), ["lead", "a", "b"])


def _open_batches(batches, percent):
    """The same rows; (lead, num, label) of the members that have an open pair, once for each lead."""

    def found():
        last, seen = None, set()
        for held in _runs(batches, _UNIT, 3):
            if held[0][0] != last:
                last, seen = held[0][0], set()
            for k in np.flatnonzero(open_members(*_arrays(held, [r[6] for r in held]), percent)).tolist():
                if held[k][3] not in seen:
                    seen.add(held[k][3])
                    yield last, held[k][3], held[k][6]

    return _tables(found(), ["lead", "num", "label"])


def _set_batches(batches, shingle):
    """Rows (num, text) as (num, tokens)."""
    for batch in batches:
        sets = shingle_sets(batch.column("text").to_pylist(), shingle)
        yield pa.RecordBatch.from_arrays([batch.column("num"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["num", "tokens"])


def _exact_batches(batches, percent):
    """Rows (key, num, label, tokens) sorted by key; links."""

    def found():
        for held in _runs(batches, ("key", "num", "label", "tokens"), 1):
            number: dict[int, int] = {}
            labels = np.array([number.setdefault(r[2], len(number)) for r in held], np.int64)
            for i, j in exact_forest([np.frombuffer(r[3], np.uint64) for r in held], labels, percent):
                yield min(held[i][1], held[j][1]), max(held[i][1], held[j][1])

    return _tables(found(), ["a", "b"])


def _verify_batches(batches, shingle, percent):
    """Some sets of either side are held; rows come in order of b."""
    held: dict[int, np.ndarray] = {}

    def of(num, text):
        found = held.get(num)
        if found is None:
            if len(held) >= SETS_KEPT:
                held.pop(next(iter(held)))
            found = held[num] = shingle_set(text, shingle)
        return found

    for batch in batches:
        out = []
        for a, b, x, y in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "x", "y")]):
            s, t = of(a, x), of(b, y)
            both = np.concatenate([s, t])
            both.sort()
            both = int((both[1:] == both[:-1]).sum())
            out.append(100 * both >= percent * (len(s) + len(t) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], names=["a", "b", "linked"])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= common.MAX_BROADCAST_ROWS else common.bounded(df, rows)


def _texts(keyed: DataFrame, sets: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """(num, text) of the classes ``ids``, which are distinct and at most ``n_ids``."""
    keys = sets.join(ids, "num").select("_key", "num")
    return keyed.select("_key", "text").join(_small(keys, n_ids), "_key").groupBy("num").agg(F.first("text").alias("text"))


def _verified(keyed: DataFrame, sets: DataFrame, pairs: DataFrame, n_pairs: int, shingle: int, percent: int, scratch: common.Scratch) -> DataFrame:
    """(a, b, linked) by the sets of the two texts; each text is moved once a pair."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("num")).distinct()
    texts = scratch.write(_texts(keyed, sets, ids, 2 * n_pairs), "texts")
    both = pairs.join(texts.select(F.col("num").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("num").alias("b"), F.col("text").alias("y")), "b")
    out = scratch.write(common.arrow_map(both.select("a", "b", "x", "y"), f"{__name__}:_verify_batches", "a bigint, b bigint, linked boolean", shingle=shingle, percent=percent), "verified")
    scratch.drop(texts)
    return out


def _exact_links(keyed: DataFrame, sets: DataFrame, open_: DataFrame, shingle: int, percent: int, scratch: common.Scratch) -> DataFrame:
    """(a, b), links among the members (lead, num, label) of each lead, counted on their whole sets."""
    rows = open_.join(sets.select("num", "n_shingles"), "num")
    # as many blocks as shingles or members ask for; where there are more than one, every two of them meet
    blocks = F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK)).cast("int")
    rows = rows.join(rows.groupBy("lead").agg(blocks.alias("blocks")), "lead")
    block = F.pmod(F.xxhash64("num"), F.col("blocks"))
    units = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(block, o) * F.col("blocks") + F.greatest(block, o))
    rows = rows.withColumn("unit", F.explode(units)).select(F.when(F.col("blocks") == 1, F.col("lead")).otherwise(F.xxhash64("lead", "unit")).alias("key"), "num", "label")
    ids = open_.select("num").distinct()
    whole = common.arrow_map(_texts(keyed, sets, ids, ids.count()), f"{__name__}:_set_batches", "num bigint, tokens binary", shingle=shingle)
    whole = scratch.write(whole, "whole")
    rows = rows.join(whole, "num").select("key", "num", "label", "tokens").repartition("key").sortWithinPartitions("key", "num")
    found = scratch.write(common.arrow_map(rows, f"{__name__}:_exact_batches", "a bigint, b bigint", percent=percent), "exact")
    scratch.drop(whole)
    return found


def _heavy_tokens(keyed: DataFrame, shingle: int, percent: int) -> np.ndarray:
    """Sorted tokens in the prefixes of many documents, MAX_HEAVY at most."""
    spread = common.arrow_map(keyed.select("text"), f"{__name__}:_token_batches", "token bigint, n bigint", shingle=shingle, percent=percent)
    spread = spread.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY)  # few tokens pass, and none is lost by it
    spread = common.materialize(spread, "spread")
    total = spread.agg(F.sum("n").alias("n")).first()["n"] or 0
    heavy = [r["token"] for r in spread.where(F.col("n") > total // MAX_HEAVY).select("token").collect()]
    return np.sort(np.array(heavy, np.int64).view(np.uint64))


def _links(keyed: DataFrame, sets: DataFrame, shingle: int, percent: int, scratch: common.Scratch) -> DataFrame | None:
    """(id, component) of linked classes, by their numbers, or None."""
    met = sets.select("num", F.explode("prefix").alias("token")).repartition("token")
    # where classes meet: one token for each distinct group of two or more
    shape = [F.count("*").alias("n"), F.min("num").alias("lead"), *[F.bit_xor(F.xxhash64("num", F.lit(k))).alias(f"x{k}") for k in range(2)]]
    groups = met.groupBy("token").agg(*shape).where("n > 1")
    chosen = groups.groupBy("n", "lead", "x0", "x1").agg(F.min("token").alias("token")).select("token", "lead", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = scratch.write(met.join(chosen, "token").select("token", "lead", "num", "blocks"), "members")
    scratch.tidy()
    block = F.pmod(F.xxhash64("num"), F.col("blocks"))
    # every block for itself; every two blocks of a group
    lead = F.when(F.col("blocks") == 1, F.col("lead")).otherwise(F.xxhash64("token", "unit")).alias("lead")  # blocks are dealt out
    inside = members.withColumn("unit", block * F.col("blocks") + block).select("token", "num", "unit", lead)
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != block))
    across = members.where("blocks > 1").select("token", "lead", "num", "blocks", block.alias("own"), other.alias("other"))
    across = across.withColumn("unit", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).select("token", "num", "unit", lead)
    payload = sets.select("num", "n_shingles", "bits")
    links = refuted = components = again = None
    n_links = 0

    def searched(units: DataFrame, target: str, schema: str, name: str) -> DataFrame:
        rows = units
        if components is not None:  # units that are connected by now have nothing to search
            rows = rows.join(common.bounded(components.select(F.col("id").alias("num"), F.col("component").alias("label")), n_links), "num", "left").withColumn("label", F.coalesce("label", "num"))
            open_ = rows.groupBy("token", "unit").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token", "unit")
            rows = rows.join(open_, ["token", "unit"])
        else:
            rows = rows.withColumn("label", F.col("num"))
        if refuted is not None:
            rows = rows.join(common.bounded(refuted.groupBy("a").agg(F.collect_list("b").alias("refuted")).withColumnRenamed("a", "num"), n_links), "num", "left")
        else:
            rows = rows.withColumn("refuted", F.lit(None).cast("array<bigint>"))
        rows = rows.join(payload, "num").select(*_UNIT)
        rows = rows.repartition("lead").sortWithinPartitions("lead", "token", "unit", "n_shingles", "num")
        found = scratch.write(common.arrow_map(rows, f"{__name__}:{target}", schema, percent=percent), name)
        scratch.tidy()
        return found

    for units in [inside, across] if members.where("blocks > 1").head(1) else [inside]:
        found = searched(units, "_search_batches", "lead bigint, a bigint, b bigint", "candidates")
        pairs = scratch.write(found.select("a", "b").distinct(), "pairs")
        if n_pairs := pairs.count():
            checked = _verified(keyed, sets, pairs, n_pairs, shingle, percent, scratch)
            fresh, wrong = checked.where("linked").select("a", "b"), checked.where("not linked").select("a", "b")
            links = fresh if links is None else links.unionByName(fresh)
            refuted = wrong if refuted is None else refuted.unionByName(wrong)
            n_links += 2 * n_pairs
            components = common.connected_components(links)
            hit = units.join(found.join(wrong, ["a", "b"], "left_semi").select("lead").distinct(), "lead").select("token", "num", "unit", "lead")
            again = hit if again is None else again.unionByName(hit)
        scratch.drop(pairs)
    if again is not None:
        # units of one lead meet in one task, unless they have more than a block of members between them
        again = scratch.write(again, "again")
        wide = again.groupBy("lead").agg(F.countDistinct("num").alias("n")).where(F.col("n") > BLOCK).select("lead", F.lit(True).alias("wide"))
        again = again.join(wide, "lead", "left").withColumn("lead", F.when(F.col("wide"), F.xxhash64("token", "unit")).otherwise(F.col("lead"))).drop("wide")
        open_ = searched(again, "_open_batches", "lead bigint, num bigint, label bigint", "open")
        if open_.head(1):
            components = common.connected_components(links.unionByName(_exact_links(keyed, sets, open_, shingle, percent, scratch)))
    return components


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row a document: doc_id, _key, n_shingles, num (its class), component (a class).

    ``num`` and ``component`` are null for documents with the empty set.
    """
    scratch = common.Scratch(docs.sparkSession)
    keyed = docs.select("doc_id", "text", common.document_key().alias("_key"))
    heavy = _heavy_tokens(keyed, shingle, percent)
    schema = common.schema_of(keyed, ["doc_id", "_key"], _SIGNATURES)
    signed = scratch.write(common.arrow_map(keyed.select("doc_id", "_key", "text"), f"{__name__}:_signature_batches", schema, shingle=shingle, percent=percent, heavy=heavy), "signatures")
    scratch.tidy()
    sets = signed.where("id is not null").groupBy("id").agg(F.min("_key").alias("_key"), *[F.first(c).alias(c) for c in ("n_shingles", "prefix", "bits")])
    sets = scratch.write(sets.withColumn("num", F.monotonically_increasing_id()), "sets")
    components = _links(keyed, sets, shingle, percent, scratch)
    out = signed.select("doc_id", "_key", "n_shingles", "id").join(sets.select("id", "num"), "id", "left").drop("id")
    if components is None:
        out = out.withColumn("component", F.col("num"))
    else:
        out = out.join(components.withColumnRenamed("id", "num"), "num", "left").withColumn("component", F.coalesce("component", "num"))
    out = common.materialize(out.select("doc_id", "_key", "n_shingles", "num", "component"), "classes")
    scratch.release()
    scratch.tidy()
    return out


def components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that can be reached, itself included."""
    rows = classes(docs, shingle, percent)
    least = rows.where("num is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "component", "left").select("doc_id", "n_shingles", F.when(F.col("num").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with their own columns, less all but one of each component.

    The one with the smallest doc_id stays (null last). Documents with the empty set stay.
    """
    rows = classes(docs, shingle, percent).where("num is not null")
    keys = rows.groupBy("component", "_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    best = keys.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("best"), F.sum("copies").alias("rows"))
    judged = keys.join(best.where("rows > 1"), "component").select("_key", (F.col("_key") == F.col("best._key")).alias("stays"), "copies")
    judged = common.materialize(judged.where("not stays or copies > 1"), "judged")
    n = judged.count()
    kept, names = common.packed(docs, docs.columns)
    keyed = docs.select(kept, common.document_key().alias("_key"))
    single = keyed.join(_small(judged.select("_key"), n), "_key", "left_anti")
    repeated = keyed.join(_small(judged.where("stays").select("_key"), n), "_key")
    repeated = repeated.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("_key"))).where("_n = 1").drop("_n")
    return common.unpacked(single.unionByName(repeated), names)


ORACLE_SQL = rf"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingle AS (
  SELECT DISTINCT r, w[s:s + {SHINGLE - 1}] AS g FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - {SHINGLE - 1}, 1))) AS s FROM doc WHERE len(w) > 0)
), counted AS (
  SELECT r, count(*) AS n FROM shingle GROUP BY r
), common AS (
  SELECT a.r AS x, b.r AS y, count(*) AS n FROM shingle a JOIN shingle b ON a.g = b.g AND a.r < b.r GROUP BY ALL
), link AS (
  SELECT x, y FROM common JOIN counted a ON a.r = x JOIN counted b ON b.r = y WHERE 100 * common.n >= {PERCENT} * (a.n + b.n - common.n)
), edge AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT r AS x, r AS y FROM counted UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x
), least AS (
  SELECT x AS r, min(doc_id) AS least FROM reach JOIN doc ON doc.r = y GROUP BY x
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE least END AS component_id
FROM doc LEFT JOIN counted USING (r) LEFT JOIN least USING (r)
"""
