"""Repeated byte strings across documents, by suffix order and longest previous factors.

A byte is removed if a string of ``length`` bytes over it also starts elsewhere. With
``keep="first"`` the earliest place of each string stays; with ``keep="none"`` no copy
does. Matches never cross documents.

Equal strings have to meet in one task without moving all text, so every window of
``length`` bytes is assigned to the smallest hash of its 32-byte grams (the leftmost of
equals). Equal windows get equal grams at equal offsets. The windows of one gram place
are a run; runs whose gram occurs once are done. Runs with equal bytes are counted;
where a gram has runs that differ, one text segment of each kind goes to a suffix
array. There, suffixes are ordered to ``length`` bytes by prefix doubling, and previous
and next smaller positions in suffix order give the longest previous factor of each
start (next larger ones the longest later factor).

Defined results: null and empty texts have no bytes; texts shorter than ``length`` are
kept whole; equal rows are copies of one another; documents come in order of doc_id
(null first), which may have any type, where the first copy is kept; columns named spans
or kept are replaced; an empty table gives an empty table. A text is held whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 200
GRAM = 32
CHUNK = (1 << 18) - 256
SEGMENT_BYTES = 1 << 20
_K1, _K2, _K3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _gram_hashes(data: bytes, start: int, count: int) -> np.ndarray:
    """Hashes of the grams that begin at start, start + 1, ..."""
    words = np.ndarray((count + GRAM - 8,), "<u8", data, start, (1,))
    h = words[:count] * _K1
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(31)
        h += words[k : k + count]
        h *= _K2
    h ^= h >> np.uint64(29)
    h *= _K3
    h ^= h >> np.uint64(32)
    return h


def window_runs(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, last window) of the runs of windows with the same chosen gram place."""
    windows, width = len(data) - length + 1, length - GRAM + 1
    if windows <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    out = []
    place_bits = np.uint64((1 << 18) - 1)
    for start in range(0, windows, CHUNK):
        count = min(CHUNK, windows - start)
        h = _gram_hashes(data, start, count + width - 1)
        low = (h & ~place_bits) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: count], low[width - span : width - span + count])
        place = (low[:count] & place_bits).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], count) - 1
        out.append((h[place[first]].view(np.int64), first + start, last + start))
    return tuple(np.concatenate(x) for x in zip(*out))


class SuffixOrder:
    """Ranks of all positions by their first 8, 16, ..., ``depth`` bytes (zeros follow the end)."""

    def __init__(self, data: bytes, depth: int):
        n = self.n = len(data)
        padded = data + bytes(16)
        self.words = np.ndarray((n + 8,), ">u8", padded, 0, (1,)).astype(np.uint64)
        self.levels: list[tuple[int, np.ndarray]] = []
        rank, span = self._rank(self.words[:n]), 8
        self.levels.append((span, rank))
        while 2 * span <= depth:
            rank = self._rank(self._pair(rank, span))
            span *= 2
            self.levels.append((span, rank))

    @staticmethod
    def _rank(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]])) + 1 if len(keys) else 0
        return rank

    def _pair(self, rank: np.ndarray, gap: int) -> np.ndarray:
        after = np.zeros(self.n, np.int64)
        after[: max(self.n - gap, 0)] = rank[gap:]
        return rank * (self.n + 2) + after

    def keys(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Numbers that compare as the first ``length`` bytes after each start do (length >= 8)."""
        span, rank = next((s, r) for s, r in reversed(self.levels) if s <= length)
        if span == length:
            return rank[starts]
        if length > 2 * span:
            raise ValueError("the order is not deep enough")
        at = starts + length - span
        return rank[starts] * (self.n + 2) + np.where(at < self.n, rank[np.minimum(at, self.n - 1)], 0)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix, up to twice the depth."""
        total, i, j = np.zeros(len(i), np.int64), i.copy(), j.copy()
        for span, rank in [self.levels[-1], *reversed(self.levels)]:
            same = (i < self.n) & (j < self.n) & (rank[np.minimum(i, self.n - 1)] == rank[np.minimum(j, self.n - 1)]) & (np.maximum(i, j) + span <= self.n)
            total += span * same
            i, j = i + span * same, j + span * same
        differ = self.words[np.minimum(i, self.n)] ^ self.words[np.minimum(j, self.n)]
        for k in range(8):
            differ_here = (differ >> np.uint64(56 - 8 * k)) & np.uint64(255)
            alive = (differ_here == 0) & (np.maximum(i, j) + k < self.n) & (differ_alive if k else True)
            differ_alive = alive
            total += alive
        return total


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the previous and next smaller value; -1 and len(values) where there is none."""

    def previous(v):
        at = np.arange(len(v)) - 1
        todo = np.flatnonzero(at >= 0)
        while len(todo):
            todo = todo[(at[todo] >= 0)]
            todo = todo[v[at[todo]] > v[todo]]
            at[todo] = at[at[todo]]  # all between was larger than what is passed over
        return at

    return previous(values), len(values) - 1 - previous(values[::-1])[::-1]


def factors(order: SuffixOrder, starts: np.ndarray, span: int, later: bool = False) -> np.ndarray:
    """For each of ``starts`` (rising), the longest match, up to 2 * ``span`` bytes or so, that
    begins at an earlier one of them, or with ``later`` at a later one.

    In suffix order the nearest entries on either side with a smaller position (a larger
    one for later matches) have the longest common prefixes of all such.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    suffixes = np.argsort(order.keys(starts, span), kind="stable")  # equal beginnings in order of position
    before, after = nearest_smaller(-suffixes if later else suffixes)
    factor = np.zeros(len(starts), np.int64)
    for near in (before, after):
        real = np.flatnonzero((near >= 0) & (near < len(suffixes)))
        own = suffixes[real]
        factor[own] = np.maximum(factor[own], order.common(starts[own], starts[suffixes[near[real]]]))
    return factor


def longest_previous_factors(data: bytes, depth: int = 256) -> np.ndarray:
    """For each position, the longest match that starts earlier, up to twice ``depth`` bytes."""
    return factors(SuffixOrder(data, depth), np.arange(len(data)), depth)


def repeated_starts(segments: list[bytes], length: int, keep: str) -> list[np.ndarray]:
    """Starts in each segment of strings that occur again: earlier ("first") or anywhere ("none").

    Those are the places with a previous (or a later) factor of at least ``length``;
    places whose string would run over the end of their segment don't take part.
    """
    data = b"".join(segments)
    order = SuffixOrder(data, length)
    sizes = np.array([len(s) for s in segments])
    begin = np.cumsum(sizes) - sizes
    valid = np.maximum(sizes - length + 1, 0)
    starts = np.repeat(begin - (np.cumsum(valid) - valid), valid) + np.arange(valid.sum())
    hit = factors(order, starts, length) >= length
    if keep == "none":
        hit |= factors(order, starts, length, later=True) >= length
    ends = np.cumsum(valid)
    return [starts[e - v : e][hit[e - v : e]] - b for e, v, b in zip(ends, valid, begin)]


def _run_batches(batches, length):
    for batch in batches:
        found: list[tuple] = []
        held = 0

        def runs():
            at = pa.array(np.concatenate([np.full(len(f[1]), f[0], np.int32) for f in found]))
            numbers = [pa.array(np.concatenate([f[k] for f in found]).astype(t)) for k, t in ((1, np.int64), (2, np.int64), (3, np.int32), (4, np.int32))]
            return pa.RecordBatch.from_arrays([batch.column("_key").take(at), batch.column("doc_id").take(at), *numbers], names=["_key", "doc_id", "gram", "kind", "p0", "p1"])

        for row, text in enumerate(batch.column("text").to_pylist()):
            data = (text or "").encode("utf-8", "replace")
            h, p0, p1 = window_runs(data, length)
            if not len(h):
                continue
            view = memoryview(data)
            kinds = np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + length]) for a, b in zip(p0.tolist(), p1.tolist())), np.uint64, len(h)).view(np.int64)
            found.append((row, h, kinds, p0, p1))
            held += len(h)
            if held > 100_000:
                yield runs()
                found, held = [], 0
        if held:
            yield runs()


def _segment_batches(batches, length):
    for batch in batches:
        rows, out = [], {k: [] for k in ("gram", "p0", "copies", "segment")}
        for row, (text, runs) in enumerate(zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist())):
            data = (text or "").encode("utf-8", "replace")
            for run in runs:
                rows.append(row)
                for name, value in (("gram", run["gram"]), ("p0", run["p0"]), ("copies", run["copies"]), ("segment", data[run["p0"] : run["p1"] + length])):
                    out[name].append(value)
        at = pa.array(rows, pa.int32())
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("_key").take(at), batch.column("doc_id").take(at), *[pa.array(v, t) for v, t in zip(out.values(), kinds)]], names=["_key", "doc_id", *out])


def _search_batches(batches, length, keep):
    """Segments sorted by (gram, doc_id, _key, p0); grams are not split between suffix arrays."""
    held: list[tuple] = []
    size = 0
    last = None

    def search():
        keys, begins, ends = [], [], []
        for row, starts in zip(held, repeated_starts([r[4] for r in held], length, keep)):
            if keep == "none" and row[3] > 1 or not len(starts):
                continue  # copies of it are known; the whole run goes anyway
            cut = np.flatnonzero(np.diff(starts) > 1)
            b, e = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]
            keys += [row[1]] * len(b)
            begins += (b + row[2]).tolist()
            ends += (e + row[2] + length).tolist()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], names=["_key", "b", "e"])

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("gram", "_key", "p0", "copies", "segment")]):
            if last is not None and row[0] != last[0] and size >= SEGMENT_BYTES:
                yield search()
                held, size = [], 0
            if last is None or row[:3] != last[:3]:
                held.append(row)
                size += len(row[4])
            last = row
    if held:
        yield search()


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep: str = "first") -> DataFrame:
    """(_key, b, e): byte ranges to remove; they may overlap. ``docs`` has _key, doc_id, text."""
    if keep not in ("first", "none") or length < GRAM + 1:
        raise ValueError("keep is first or none, and length is above the gram's")
    scratch = common.Scratch(docs.sparkSession)
    schema = common.schema_of(docs, ["_key", "doc_id"], "gram bigint, kind bigint, p0 int, p1 int")
    runs = scratch.write(common.arrow_map(docs.select("_key", "doc_id", "text"), f"{__name__}:_run_batches", schema, length=length), "runs")
    # counted first with map-side combine, and joined in a way that splits hot grams
    grams = runs.groupBy("gram").agg(F.count("*").alias("rows"), F.min("kind").alias("lo"), F.max("kind").alias("hi")).where("rows > 1")
    shared = scratch.write(runs.join(grams.select("gram", (F.col("lo") != F.col("hi")).alias("mixed")), "gram"), "shared")
    scratch.drop(runs)
    order = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "_key", "p0", "p1")
    kinds = shared.groupBy("gram", "kind").agg(F.count("*").alias("copies"), F.min(order).alias("first"), F.first("mixed").alias("mixed"))
    kinds = scratch.write(kinds.where("copies > 1 or mixed"), "kinds")
    copied = shared.join(kinds.where("copies > 1").select("gram", "kind", "first"), ["gram", "kind"])
    if keep == "first":
        copied = copied.where("not (_key = first._key and p0 = first.p0)")
    whole = copied.select("_key", F.col("p0").alias("b"), (F.col("p1") + length).alias("e"))
    if keep == "first":  # rows equal in all of doc_id and text share a key: all but one of them are copies of it
        whole = whole.distinct()
    # one segment of each kind, where a gram has several
    wanted = kinds.where("mixed").groupBy("first._key").agg(F.collect_list(F.struct("gram", "first.p0", "first.p1", "copies")).alias("runs"))
    schema = common.schema_of(docs, ["_key", "doc_id"], "gram bigint, p0 int, copies bigint, segment binary")
    segments = common.arrow_map(docs.select("_key", "doc_id", "text").join(wanted, "_key"), f"{__name__}:_segment_batches", schema, length=length)
    sorted_ = segments.repartition("gram").sortWithinPartitions("gram", F.col("doc_id").asc_nulls_first(), "_key", "p0")
    partial = common.arrow_map(sorted_, f"{__name__}:_search_batches", "_key binary, b int, e int", length=length, keep=keep)
    spans = common.materialize(whole.unionByName(partial).distinct(), "spans")
    scratch.release()
    scratch.tidy()
    return spans


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [tuple(x) for x in out]


def _cut_batches(batches):
    for batch in batches:
        names = [n for n in batch.schema.names if n not in ("text", "spans")]
        kept_rows, span_rows = [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            data = (text or "").encode("utf-8", "replace")
            merged = merge_spans((s["b"], s["e"]) for s in spans or ())
            if merged:
                at, parts = 0, []
                for b, e in merged:
                    parts.append(data[at:b])
                    at = e
                data = b"".join([*parts, data[at:]])
            kept_rows.append(data)
            span_rows.append([{"b": b, "e": e} for b, e in merged])
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names], pa.array(span_rows, pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))), pa.array(kept_rows, pa.binary())], names=[*names, "spans", "kept"]
        )


def remove_repeats(docs: DataFrame, *names: str, length: int = LENGTH, keep: str = "first") -> DataFrame:
    """Columns ``names`` with ``spans`` (maximal byte ranges removed) and ``kept`` (remaining bytes).

    With ``keep="first"``, rows equal in doc_id and text can't be told apart: the first
    of them is treated as the others, by what occurs in other rows.
    """
    kept, names = common.packed(docs, names, ("spans", "kept"))
    keyed = docs.select(kept, "doc_id", "text", common.document_key().alias("_key"))
    spans = repeated_spans(keyed, length, keep).groupBy("_key").agg(F.collect_list(F.struct("b", "e")).alias("spans"))
    joined = keyed.select("_key", common.KEEP, "text").join(spans, "_key", "left").select(common.KEEP, "text", "spans")
    schema = common.schema_of(joined, [common.KEEP], "spans array<struct<b:int,e:int>>, kept binary")
    return common.unpacked(common.arrow_map(joined, f"{__name__}:_cut_batches", schema), names, "spans", "kept")


#: With keep="none". Bytes are pairs of hexadecimal digits.
ORACLE_SQL = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), place AS (
  SELECT r, s, md5(substr(h, 2 * s + 1, {2 * LENGTH})) AS g FROM (SELECT r, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS s FROM doc WHERE length(h) >= {2 * LENGTH})
), twice AS (
  SELECT r, s FROM place WHERE g IN (SELECT g FROM place GROUP BY g HAVING count(*) > 1)
), marked AS (
  SELECT r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + {LENGTH}, true)::INT AS fresh FROM twice
), span AS (
  SELECT r, min(s) AS b, max(s) + {LENGTH} AS e FROM (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS k FROM marked) GROUP BY r, k
), ended AS (
  SELECT r, b, e FROM span UNION ALL SELECT r, length(h) // 2, NULL FROM doc
), piece AS (
  SELECT r, b, coalesce(max(e) OVER (PARTITION BY r ORDER BY b, e NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM ended
), kept AS (
  SELECT r, string_agg(substr(h, 2 * a + 1, 2 * greatest(b - a, 0)), '' ORDER BY b, a) AS k FROM piece JOIN doc USING (r) GROUP BY r
), total AS (
  SELECT r, sum(e - b) AS n, count(*) AS spans FROM span GROUP BY r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM doc JOIN kept USING (r) LEFT JOIN total USING (r)
"""
