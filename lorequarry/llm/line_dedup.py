"""Fuzzy line deduplication: MinHash, banding, exact verification, union-find.

Lines (split at \\n, outer white space cut, inner white space made one space, lower
case) that aren't blank take part. Those under MIN_CHARS characters have too few
shingles to compare and are linked where they are equal. The MinHash signatures of the
others over character shingles are cut into bands; lines that agree in a band share a
bucket. An edit of one character breaks as many shingles as a shingle has characters,
so the length decides which edits are seen: at Jaccard 0.8, shingles of 4 link inner
edits of one character in lines from 39 characters on.

Equal lines are one, told apart by 128 bits. A line's band hashes are dealt out by
bucket as packed numbers, all bands at once. With each goes a sketch: one bit of
each of SKETCH_BITS minima, of which two lines of similarity s share a part (1 + s) / 2,
and the size of the shingle set. Two members of a bucket are close if neither rules a
link out; a linked pair fails that with a probability of about 1e-5. Members that are
close to none are dropped. Two members alone are a pair; buckets with the same members
are searched once. The texts of what is left are fetched once, and close pairs are
verified by the exact Jaccard similarity of their shingle sets: in a bucket a tree is
grown from a member over everything linked to it, then from the next one left over, so
that every close pair ends up connected or refuted. A bucket's members are dealt to
blocks of about BLOCK; blocks are searched alone first, and, where a bucket isn't
connected by then, two by two, so that no task holds more than two blocks. The links
found are joined into components by distributed union-find.

The first line of each component, by doc_id (null last) and place, stays; the others go.

Defined results: null texts stay null and empty ones empty; blank lines stay; rows equal
in doc_id and text are treated alike, so a line's first place in one stays in all of
them; doc_id may have any type; columns of any names are kept; an empty table gives an
empty table. A text is held whole in its task, its lines are signed in bounded chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 4
PERCENT = 80
MIN_CHARS = 30
#: A pair at similarity 0.8 agrees in a band with probability 0.998.
BANDS, BAND_ROWS = 26, 7
#: Bands dealt out at once; at least SKETCH_BITS minima. All of them: each further round normalizes,
#: names and hashes all lines again. The entries of a round lie on disk, 24 bytes a line and band.
BANDS_AT_ONCE = BANDS
SKETCH_BITS, LEAST_AGREEMENT = 88, 68
BLOCK = 4096
#: Members up to which all pairs of a bucket are compared by their sketches at once.
SMALL = 16
#: Characters whose shingles are hashed at once: few enough for a core's cache.
CHUNK = 1 << 16
ENTRIES_PER_TASK = 1_000_000
#: Names past which a task forgets the lines that it has signed.
NAMES_KEPT = 80_000
SETS_KEPT = 2_000
#: Lines up to which units of the same lead are searched as one.
PACK = 256
_K1, _K2, _K3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_FACTORS = np.random.Generator(np.random.Philox(20_231_117)).integers(0, 1 << 31, BANDS * BAND_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: An entry: bucket, line, and the sketch, whose last byte is the size.
_ENTRY = np.dtype([("bucket", "<u4"), ("line", "<u8"), ("s0", "<u8"), ("s1", "<u4")])
_S1 = np.uint32((1 << 24) - 1)


def normal(line: str) -> str:
    line = line.strip().lower()
    if "  " in line or not line.isprintable():  # the space is the only printable white space
        line = " ".join(line.split())
    return line


def line_id(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "replace"))


def _hashes(units: bytes, count: int, shingle: int) -> np.ndarray:
    """Hashes of the ``count`` shingles, of 4 or 8 units, of UTF-16 text."""
    h = np.ndarray((count,), "<u8", units, 0, (2,)) * _K1
    h ^= h >> np.uint64(32)
    if shingle == 8:
        h += np.ndarray((count,), "<u8", units, 8, (2,))
    h *= _K2
    h ^= h >> np.uint64(29)
    h *= _K3
    h ^= h >> np.uint64(32)
    return h


def shingles(line: str, shingle: int = SHINGLE) -> np.ndarray:
    units = line.encode("utf-16-le", "replace")
    h = _hashes(units, len(units) // 2 - shingle + 1, shingle)
    h.sort()
    fresh = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=fresh[1:])
    return h[fresh]


def _units(lines: list[str]) -> tuple[bytes, np.ndarray]:
    """UTF-16 of the lines, one after another, and their sizes in units."""
    units = "".join(lines).encode("utf-16-le", "replace")
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    if 2 * sizes.sum() != len(units):  # characters of two units
        sizes = np.array([len(x.encode("utf-16-le", "replace")) // 2 for x in lines])
    return units, sizes


def signatures(lines: list[str], shingle: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (lines, last - first) of some bands, the number of each line's different
    shingles, and the sketches (lines, 12 bytes); every line has at least ``shingle`` characters."""
    units, sizes = _units(lines)
    starts = np.cumsum(sizes) - sizes
    h = _hashes(units, int(sizes.sum()) - shingle + 1, shingle).astype(np.uint32)
    # shingles that run over the end of a line take the value of its first one
    over = (starts + sizes)[:, None] - np.arange(shingle - 1, 0, -1)
    inside = over < len(h)
    h[over[inside]] = np.broadcast_to(h[starts][:, None], over.shape)[inside]
    ends = np.minimum(starts + sizes, len(h))
    own = np.repeat(np.arange(len(lines), dtype=np.uint64) << np.uint64(32), ends - starts)
    own |= h
    own.sort()
    fresh = np.ones(len(own), bool)
    np.not_equal(own[1:], own[:-1], out=fresh[1:])
    # each line's different shingles, which have the same minima as all of them
    different = np.add.reduceat(fresh, starts, dtype=np.int64)
    h, starts = own[fresh].astype(np.uint32), np.cumsum(different) - different
    chosen = _FACTORS[first * BAND_ROWS : last * BAND_ROWS]
    low, product = np.empty((len(chosen), len(lines)), np.uint32), np.empty_like(h)
    for k, factor in enumerate(chosen):
        np.multiply(h, factor, out=product)
        np.minimum.reduceat(product, starts, out=low[k])
    out = np.zeros((last - first, len(lines)), np.uint64)
    for k in range(BAND_ROWS):
        out = (out + low[k::BAND_ROWS]) * _K1
        out ^= out >> np.uint64(31)
    bits = np.packbits((low[:SKETCH_BITS] >> np.uint32(3)).astype(np.uint8) & np.uint8(1), axis=0)
    sketch = np.concatenate([bits, _size_code(different)[None, :]]).T
    return out.T * _K2 + np.arange(first, last, dtype=np.uint64), different, np.ascontiguousarray(sketch)


def _size_code(sizes: np.ndarray) -> np.ndarray:
    """Sizes on a logarithmic scale of 24 steps a doubling, in one byte."""
    return np.minimum(24 * np.log2(np.maximum(sizes, 1)), 255).astype(np.uint8)


def entries(bands: np.ndarray, lines: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """An entry for each line and band; its bucket has the upper half of the band's hash."""
    out = np.empty(bands.shape, _ENTRY)
    out["bucket"], out["line"] = bands >> np.uint64(32), lines[:, None]
    out["s0"], out["s1"] = sketch[:, :8].copy().view("<u8"), sketch[:, 8:].copy().view("<u4")
    return out


def band_hashes(lines: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(lines, BANDS) hashes and the number of each line's different shingles."""
    return signatures(lines, shingle, 0, BANDS)[:2]


# --- lines ---------------------------------------------------------------------------


def _line_batches(batches):
    """A row for each line that isn't blank: its document, place and 128 bits."""
    for batch in batches:
        rows, places, ids = [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            for k, raw in enumerate(text.split("\n") if text else ()):
                line = normal(raw)
                if line:
                    rows.append(row)
                    places.append(k)
                    ids.append(line_id(line))
        at = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("_key").take(at), batch.column("doc_id").take(at), pa.array(places, pa.int32()), pa.array(ids, pa.binary())], names=["_key", "doc_id", "line_no", "line"])


def _entry_batches(batches, shingle, first, last, tasks):
    """Packed entries by the task that gets them."""
    held: dict[int, str] = {}
    seen: set[int] = set()
    signed: list[tuple] = []
    size = count = 0

    def sign():
        bands, _, sketch = signatures(list(held.values()), shingle, first, last)
        signed.append((bands, np.array(list(held), np.uint64), sketch))
        held.clear()

    def dealt():
        bands, lines, sketch = (np.concatenate(x) for x in zip(*signed))
        signed.clear()
        to = (bands % np.uint64(tasks)).astype(np.uint16 if tasks <= 1 << 16 else np.int64).reshape(-1)
        order = np.argsort(to, kind="stable")  # two bytes are sorted by counting
        ends = np.cumsum(np.bincount(to, minlength=tasks))
        packed = entries(bands, lines, sketch).reshape(-1)[order]
        begins = np.append(0, ends[:-1])
        full = np.flatnonzero(ends > begins)
        data = [packed[a:b].tobytes() for a, b in zip(begins[full], ends[full])]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(data, pa.binary())], names=["task", "entries"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            for raw in text.split("\n") if text else ():
                line = normal(raw)
                if len(line) < MIN_CHARS or (name := int.from_bytes(line_id(line)[:8], "big")) in seen:
                    continue
                seen.add(name)
                held[name] = line
                size += len(line)
                if size >= CHUNK:
                    count += len(held)
                    sign()
                    size = 0
                    if count * (last - first) >= ENTRIES_PER_TASK:
                        yield dealt()
                        count = 0
                        if len(seen) >= NAMES_KEPT:
                            seen.clear()
    if held:
        sign()
    if signed:
        yield dealt()


# --- buckets -------------------------------------------------------------------------


def close(own: np.ndarray, others: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sketches and sizes let a link be possible. Sizes may be one step off."""
    differ = np.bitwise_count(own["s0"] ^ others["s0"]).astype(np.int64) + np.bitwise_count((own["s1"] ^ others["s1"]) & _S1)
    apart = np.abs((own["s1"] >> np.uint32(24)).astype(np.int64) - (others["s1"] >> np.uint32(24)).astype(np.int64))
    return (SKETCH_BITS - differ >= LEAST_AGREEMENT) & (apart <= 24 * np.log2(100 / percent) + 2)


def grow(n: int, labels: np.ndarray, linked) -> list[tuple[int, int]]:
    """A spanning forest of a bucket: ``linked(k, others)`` tells which others k is linked to.

    ``labels`` says what is connected already. Everybody in a tree is asked about
    everybody who isn't yet.
    """
    out, waiting = [], np.arange(n)
    while len(waiting):
        tree = waiting[labels[waiting] == labels[waiting[0]]].tolist()
        waiting = waiting[labels[waiting] != labels[waiting[0]]]
        for k in tree:  # the list grows
            if not len(waiting):
                break
            near = waiting[linked(k, waiting)]
            groups, one = np.unique(labels[near], return_index=True)
            if len(groups):
                out += [(k, int(near[j])) for j in one]
                joined = np.isin(labels[waiting], groups)
                tree += waiting[joined].tolist()
                waiting = waiting[~joined]
    return out


_MET = "bucket bigint, a bigint, b bigint, sketch binary"


def _bucket_batches(batches, percent):
    """All entries of a task's buckets. Rows (a, b) are pairs that meet alone; rows without
    ``b`` are members of larger buckets, with their sketches."""
    blobs, task = [], 0
    for batch in batches:
        blobs += batch.column("entries").to_pylist()
        task = batch.column("task")[0].as_py() if batch.num_rows else task
    if not blobs:
        return
    held = np.frombuffer(b"".join(blobs), _ENTRY)
    blobs.clear()
    # most are alone in their bucket: only the others are gathered
    key = held["bucket"].astype(np.uint64) << np.uint64(32) | np.arange(len(held), dtype=np.uint64)
    key.sort()
    same = (key[1:] ^ key[:-1]) >> np.uint64(32) == 0
    shared = np.zeros(len(key), bool)
    shared[1:] |= same
    shared[:-1] |= same
    held = held[key[shared] & np.uint64(0xFFFFFFFF)]
    del key, same, shared
    if not len(held):
        return
    held = held[np.argsort(held["bucket"].astype(np.uint64) << np.uint64(32) | held["line"] >> np.uint64(32))]
    held = held[np.concatenate([[True], (held["bucket"][1:] != held["bucket"][:-1]) | (held["line"][1:] != held["line"][:-1])])]
    edge = np.flatnonzero(np.concatenate([[True], held["bucket"][1:] != held["bucket"][:-1], [True]]))
    begin, n = edge[:-1], np.diff(edge)
    # in small buckets all pairs of places are compared, a distance at a time
    small = np.repeat(n <= SMALL, n)
    end, bucket = np.repeat(begin + n, n), np.repeat(np.arange(len(n)), n)
    near: list[np.ndarray] = []
    for apart in range(1, SMALL):
        at = np.flatnonzero(small & (np.arange(len(held)) + apart < end))
        if not len(at):
            break
        near.append(at[close(held[at], held[at + apart], percent)][:, None] + [0, apart])
    near = np.concatenate(near) if near else np.zeros((0, 2), np.int64)
    met = bucket[near[:, 0]]
    alone = np.bincount(met, minlength=len(n))[met] == 1
    pairs, members = [held["line"][near[alone]].T.view(np.int64)], [held[np.unique(near[~alone])]]
    for b, k in zip(begin[n > SMALL], n[n > SMALL]):
        own = held[b : b + k]
        found = grow(k, np.arange(k), lambda j, others: close(own[j], own[others], percent))
        if len(found) == 1:
            pairs.append(own["line"][list(found[0])].view(np.int64)[:, None])
        elif found:  # a tree has every member that is close to any
            members.append(own[np.unique(np.array(found))])
    a, b = np.concatenate(pairs, axis=1)
    own = np.concatenate(members)
    name = own["bucket"].astype(np.int64) | np.int64(task) << np.int64(32)
    sketches = np.ascontiguousarray(own[["s0", "s1"]].astype([("s0", "<u8"), ("s1", "<u4")])).view("S12").tolist()
    none = lambda k: pa.nulls(k, pa.int64())
    yield pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([none(len(a)), pa.array(name)]),
            pa.concat_arrays([pa.array(np.minimum(a, b)), pa.array(own["line"].view(np.int64))]),
            pa.concat_arrays([pa.array(np.maximum(a, b)), none(len(own))]),
            pa.array([None] * len(a) + [x.ljust(12, b"\0") for x in sketches], pa.binary()),
        ],
        names=["bucket", "a", "b", "sketch"],
    )


def _search_batches(batches, percent, shingle):
    """Rows (lead, bucket, unit, line, sketch, text, label) sorted by unit; links of lines.

    What units of the same lead have found connected, and their sets, are held for the next.
    Units of the same lead share most lines, so they are searched as one up to PACK lines.
    """
    held: list[tuple] = []
    pack: dict[bytes, tuple] = {}
    root: dict[bytes, bytes] = {}
    known: dict[bytes, np.ndarray] = {}

    def find(k):
        while (up := root.get(k, k)) != k:
            k = up
        return k

    def search():
        held = list(pack.values())
        pack.clear()
        ids = [r[3] for r in held]
        tops = [find(r[6]) for r in held]
        if len(set(tops)) == 1:
            return []
        number: dict = {}
        labels = np.array([number.setdefault(t, len(number)) for t in tops])
        sketch = np.frombuffer(b"".join(r[4] for r in held), [("s0", "<u8"), ("s1", "<u4")])
        for r in held:
            if r[3] not in known:
                known[r[3]] = shingles(r[5], shingle)
        sets = [known[k] for k in ids]
        sizes = np.array([len(x) for x in sets])

        def linked(k, others):
            out = close(sketch[k], sketch[others], percent)
            asked = others[out]
            if len(asked):
                own, theirs = sets[k], np.concatenate([sets[j] for j in asked])
                at = np.searchsorted(own, theirs)
                at[at == len(own)] = 0
                ends = np.cumsum(sizes[asked])
                same = np.concatenate([[0], np.cumsum(own[at] == theirs)])
                both = same[ends] - same[ends - sizes[asked]]
                out[out] = 100 * both >= percent * (sizes[k] + sizes[asked] - both)
            return out

        found = grow(len(held), labels, linked)
        for i, j in found:
            a, b = sorted((find(tops[i]), find(tops[j])))
            root[b] = a
        return [(ids[i], ids[j]) for i, j in found]

    links: list[tuple] = []

    def packed():
        """Add the unit at hand to the pack, which is searched before if it has no room."""
        if pack and len(pack) + sum(r[3] not in pack for r in held) > PACK:
            links.extend(search())
        pack.update((r[3], r) for r in held)
        held.clear()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in range(2)], names=["line_a", "line_b"])

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("lead", "bucket", "unit", "line", "sketch", "text", "label")]):
            if held and row[:3] != held[0][:3]:
                lead = held[0][0]
                packed()
                if row[0] != lead:
                    links += search()
                    root.clear()
                    known.clear()
                if len(links) >= 10_000:
                    yield rows()
                    links.clear()
            held.append(row)
    if held:
        packed()
        links += search()
    if links:
        yield rows()


def _text_batches(batches):
    for batch in batches:
        ids, texts = [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            lines = (text or "").split("\n")
            for w in wanted:
                ids.append(w["line"])
                texts.append(normal(lines[w["line_no"]]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["line", "text"])


def _verify_batches(batches, percent, shingle):
    """Recent sets of either side are held; rows come in order of b."""
    held: dict[bytes, np.ndarray] = {}

    def of(line, text):
        found = held.get(line)
        if found is None:
            if len(held) >= SETS_KEPT:
                held.pop(next(iter(held)))
            found = held[line] = shingles(text, shingle)
        return found

    for batch in batches:
        links = []
        for a, b, x, y in zip(*[batch.column(c).to_pylist() for c in ("line_a", "line_b", "x", "y")]):
            s, t = of(a, x), of(b, y)
            if percent * max(len(s), len(t)) > 100 * min(len(s), len(t)):
                continue  # the sizes alone rule it out
            both = np.concatenate([s, t])
            both.sort()
            both = int((both[1:] == both[:-1]).sum())
            if 100 * both >= percent * (len(s) + len(t) - both):
                links.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in range(2)], names=["line_a", "line_b"])


_LINKS = "line_a binary, line_b binary"


def _low(line):
    """The first 64 bits of a line's identity, by which entries name it."""
    return F.conv(F.hex(F.substring(line, 1, 8)), 16, -10).cast("bigint")


def _meetings(keyed: DataFrame, n_lines: int, percent: int, shingle: int, scratch: common.Scratch) -> DataFrame:
    """What the buckets give: pairs and members, under 64 bits of the lines."""
    spark = keyed.sparkSession
    met = None
    for first in range(0, BANDS, BANDS_AT_ONCE):
        last = min(first + BANDS_AT_ONCE, BANDS)
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_lines * (last - first) // ENTRIES_PER_TASK))
        dealt = common.arrow_map(keyed.select("text"), f"{__name__}:_entry_batches", "task int, entries binary", shingle=shingle, first=first, last=last, tasks=tasks)
        part = scratch.write(common.arrow_map(dealt.repartitionById(tasks, F.col("task")), f"{__name__}:_bucket_batches", _MET, percent=percent), "met")
        scratch.tidy()
        met = part if met is None else met.unionByName(part)
    return met


def _components(keyed: DataFrame, distinct: DataFrame, met: DataFrame, percent: int, shingle: int, scratch: common.Scratch) -> DataFrame | None:
    """(id, component) of linked lines that differ, or None."""
    pairs = met.where("b is not null").select("a", "b").distinct()
    members = met.where("b is null").select("bucket", F.col("a").alias("low"), "sketch")
    # one bucket of all that have the same members
    shape = [F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("low", F.lit(k))).alias(f"x{k}") for k in range(2)]]
    chosen = members.groupBy("bucket").agg(*shape, F.min("low").alias("lead")).groupBy("n", "x0", "x1", "lead").agg(F.min("bucket").alias("bucket"))
    # buckets with the same least member mostly hold the same lines, so they go to one task: a line has BANDS at most
    members = scratch.write(members.join(chosen.select("bucket", "lead", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "bucket"), "members")
    pairs = scratch.write(pairs, "pairs")
    # the texts, once; lines that share 64 bits are searched and verified each for itself
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("low")).unionByName(members.select("low")).distinct()
    where = distinct.withColumn("low", _low(F.col("line"))).join(wanted, "low").select("line", "first._key", "first.line_no")
    lists = where.groupBy("_key").agg(F.collect_list(F.struct("line", "line_no")).alias("wanted"))  # no more than a document's lines
    texts = keyed.select("_key", "text").join(lists, "_key").select("text", "wanted")
    texts = scratch.write(common.arrow_map(texts, f"{__name__}:_text_batches", "line binary, text string").withColumn("low", _low(F.col("line"))), "texts")
    scratch.tidy()
    side = lambda low, line, text: texts.select(F.col("low").alias(low), F.col("line").alias(line), F.col("text").alias(text))
    both = pairs.join(side("a", "line_a", "x"), "a").join(side("b", "line_b", "y"), "b").select("line_a", "line_b", "x", "y")
    links = scratch.write(common.arrow_map(both, f"{__name__}:_verify_batches", _LINKS, percent=percent, shingle=shingle), "links")

    def searched(units: DataFrame, label) -> DataFrame:
        rows = units.join(texts, "low").withColumn("label", label)
        rows = rows.withColumn("lead", F.when(F.col("blocks") == 1, F.col("lead")).otherwise(F.xxhash64("bucket", "unit")))
        rows = rows.select("lead", "bucket", "unit", "line", "sketch", "text", "label").repartition("lead").sortWithinPartitions("lead", "bucket", "unit", "line")
        return scratch.write(common.arrow_map(rows, f"{__name__}:_search_batches", _LINKS, percent=percent, shingle=shingle), "links")

    block = F.pmod(F.xxhash64("low"), F.col("blocks"))
    links = links.unionByName(searched(members.withColumn("unit", block * F.col("blocks") + block), F.col("line")))
    if not links.head(1):
        return None
    components = common.connected_components(links, "line_a", "line_b")
    wide = members.where("blocks > 1")
    if wide.head(1):
        label = components.select(_low(F.col("id")).alias("low"), F.col("component").alias("label")).groupBy("low").agg(F.min("label").alias("label"))
        wide = wide.join(label, "low", "left").withColumn("label", F.coalesce("label", F.unhex(F.hex("low"))))
        open_ = wide.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
        other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != block)).alias("other")
        across = wide.join(open_, "bucket").select("lead", "bucket", "low", "sketch", "label", "blocks", block.alias("own"), other)
        across = across.withColumn("unit", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
        more = searched(across.drop("own", "other"), F.col("label"))
        components = common.connected_components(links.unionByName(more), "line_a", "line_b")
    return components


def duplicate_lines(keyed: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(_key, removed): places of the lines to remove from each document that loses any."""
    scratch = common.Scratch(keyed.sparkSession)
    lines = common.schema_of(keyed, ["_key", "doc_id"], "line_no int, line binary")
    lines = scratch.write(common.arrow_map(keyed.select("_key", "doc_id", "text"), f"{__name__}:_line_batches", lines), "lines")
    met = _meetings(keyed, lines.count(), percent, shingle, scratch)  # first, since its entries take the most room
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key", "line_no")
    distinct = scratch.write(lines.groupBy("line").agg(F.count("*").alias("n"), F.min(place).alias("first")), "distinct")
    components = _components(keyed, distinct, met, percent, shingle, scratch)
    if components is None:
        groups = distinct.where("n > 1").select("line", "first")
    else:
        joined = distinct.join(components.select(F.col("id").alias("line"), "component"), "line", "left")
        alone = joined.where("component is null and n > 1").select("line", "first")
        linked = joined.where("component is not null")
        best = linked.groupBy("component").agg(F.min("first").alias("best"))
        groups = alone.unionByName(linked.select("line", "component").join(best, "component").select("line", F.col("best").alias("first")))
    groups = scratch.write(groups.select("line", F.col("first._key").alias("stays"), F.col("first.line_no").alias("place")), "groups")
    scratch.drop(distinct)
    lost = lines.join(groups, "line").where("not (_key = stays and line_no = place)")
    removed = common.materialize(lost.groupBy("_key").agg(F.collect_set("line_no").alias("removed")), "removed")
    scratch.release()
    scratch.tidy()
    return removed


def _cut_batches(batches):
    for batch in batches:
        out, n_lines, n_removed, n_left = [], [], [], []
        for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist()):
            lines = text.split("\n") if text is not None else []
            n_lines.append(len(lines))
            n_removed.append(len(removed or ()))
            if removed:
                gone = set(removed)
                lines = [x for k, x in enumerate(lines) if k not in gone]
                text = "\n".join(lines)
            n_left.append(sum(not x.isspace() and x != "" for x in lines))
            out.append(text)
        counts = [pa.array(x, pa.int64()) for x in (n_lines, n_removed, n_left)]
        yield pa.RecordBatch.from_arrays([batch.column(common.KEEP), pa.array(out, pa.string()), *counts], names=[common.KEEP, "text", "n_lines", "n_removed", "n_left"])


_CUT = ("text", "n_lines", "n_removed", "n_left")


def _cut(docs: DataFrame, keep, replaced, percent: int, shingle: int) -> tuple[DataFrame, list[str]]:
    kept, names = common.packed(docs, keep, replaced)
    keyed = docs.select(kept, "doc_id", "text", common.document_key().alias("_key"))
    removed = duplicate_lines(keyed, percent, shingle)
    joined = keyed.select("_key", common.KEEP, "text").join(removed, "_key", "left").select(common.KEEP, "text", "removed")
    schema = common.schema_of(joined, [common.KEEP], "text string, n_lines bigint, n_removed bigint, n_left bigint")
    return common.arrow_map(joined, f"{__name__}:_cut_batches", schema), names


def remove_duplicate_lines(docs: DataFrame, *keep: str, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` with the remaining ``text``, ``n_lines`` before, ``n_removed``, and
    ``n_left``: lines left that aren't blank. Columns of ``keep`` with these names are replaced.
    """
    cut, names = _cut(docs, keep, _CUT, percent, shingle)
    return common.unpacked(cut, names, *_CUT)


def clean_documents(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The documents with their lines deduplicated and ``n_chars`` brought up to date.

    A document goes if it lost lines and nothing but blank ones is left.
    """
    cut, _ = _cut(docs, docs.columns, (), percent, shingle)
    changed = F.col("n_removed") > 0
    columns = []
    for n in docs.columns:
        column = F.col(common.KEEP).getField(n)
        if n == "text":
            column = F.col("text")
        elif n == "n_chars":
            column = F.when(changed, F.length("text").cast(docs.schema[n].dataType)).otherwise(column)
        columns.append(column.alias(n))
    return cut.where(~changed | (F.col("n_left") > 0)).select(*columns)
