"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding.

Encoding reads bytes from left to right. For every prefix of a piece the last token of
that prefix's encoding is unique: it is the token t ending there for which the last
token s of what precedes it forms a stable pair with t (encoding s + t gives s, t).
So a chain of stable pairs from the start to the end of what was read is its encoding.

Text to come can change the encoding of what was read only by a chain of merges, each
taking the token left of the last change: a merge (y, t) after a merge (z, ..) where t
begins with z and comes later in the merge list. The longest such chain, in bytes of
the tokens taken, is the merge list's sufficient lookahead; it is computed from the list
alone. Tokens that end so far before the last byte read are stable and are emitted, so
the window never holds more than the lookahead, a token and what was just read.

Decoding turns identifiers into bytes and feeds them to an incremental UTF-8 state
machine, which holds back at most three bytes.

Defined results: a null or empty text has no tokens and decodes to the empty text; equal
texts get equal results; columns of ``keep`` named as a result are replaced. A text
arrives whole; what is made of it is handed on in chunks of CHUNK characters, cut where
no piece crosses, and of long pieces in chunks as well. Pieces met before are looked up.
Files with settings that this encoder does not follow are refused.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Unicode's White_Space, as the tokenizer file's pattern understands \s.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pre-tokenizer's pattern (a fixed value of the byte-level format).
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
_PIECES = regex.compile(PATTERN)
#: A single space between two characters that are not white space: no piece crosses its left side.
_BREAK = regex.compile(rf"(?<=[^{_WS}]) (?=[^{_WS}])")
_ODD = regex.compile(rf"[{_WS}][ ]|[ ][{_WS}]|^ | $")
CHUNK = 1 << 16
END = 256
#: Longer pieces and their results aren't kept.
LONG_PIECE = 1 << 12
CACHE_ENTRIES = 350_000
PAIR_ENTRIES = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """Printable character of the byte-level format -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeList:
    """Vocabulary and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _refuse_others(spec)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.ids = {as_bytes(k): v for k, v in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        self.ranks = {}
        #: The two tokens that a token is merged from, and its rank; bytes have none.
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank_of = dict.fromkeys(self.ids.values(), -1)
        self.pair_ranks: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = map(as_bytes, merge.split(" ") if isinstance(merge, str) else merge)
            self.ranks[a, b] = rank
            left, right, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.pair_ranks[left << 20 | right] = rank
            if made not in self.parts:
                self.parts[made], self.rank_of[made] = (left, right), rank
        #: Nodes by byte, and under END the number of the token that ends there.
        self.trie: dict = {}
        for token, number in self.ids.items():
            node = self.trie
            for byte in token:
                node = node.setdefault(byte, {})
            node[END] = number
        #: No token is longer, so a later token starts within so many bytes of the end read.
        self.max_token = max(map(len, self.ids))
        self.lookahead = self.lookahead_bound()
        self.stable_pairs: dict[int, bool] = {}
        self.self_stable: dict[int, bool] = {}

    def lookahead_bound(self) -> int:
        """The merge list's sufficient lookahead in bytes: the heaviest chain of merges, see above."""
        first: dict[bytes, bytes] = {}  # left part of a token
        reach: dict[bytes, int] = {}  # heaviest chain of earlier merges that ends by taking this token
        for a, b in self.ranks:  # in order of rank
            before, z = 0, b
            while z is not None:
                before = max(before, reach.get(z, 0))
                z = first.get(z)
            reach[a] = max(reach.get(a, 0), len(a) + before)
            first.setdefault(a + b, a)
        return max(reach.values(), default=0)

    def merge(self, data: bytes) -> list[int]:
        """The definition: lowest rank first, leftmost among equals. Used for pairs and in tests."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                rank = self.ranks.get((parts[k], parts[k + 1]))
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if best is None:
                break
            a, b = parts[at], parts[at + 1]
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and parts[k] == a and parts[k + 1] == b:
                    out.append(a + b)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return [self.ids[p] for p in parts]

    def alone(self, token: int) -> bool:
        """Whether a token's own bytes encode to that token."""
        known = self.self_stable.get(token)
        if known is None:
            known = self.self_stable[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def _holds(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border between a and b while they are formed.

        Time runs backwards: the part next to the border that was formed last is taken
        apart, and a merge across the border must not come before what had formed it.
        Of equal ranks the one further left comes first.
        """
        ranks, parts, formed, limit = self.pair_ranks, self.parts, self.rank_of, len(self.ranks)
        while True:
            if ranks.get(a << 20 | b, limit) < limit:
                return False
            if formed[a] > formed[b]:
                limit, a = formed[a], parts[a][1]
            elif b in parts:
                limit, b = formed[b] + 1, parts[b][0]
            else:
                return True

    def stable(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b together encode to a, b."""
        key = a << 20 | b
        known = self.stable_pairs.get(key)
        if known is None:
            if len(self.stable_pairs) >= PAIR_ENTRIES:
                self.stable_pairs.clear()
            known = self.stable_pairs[key] = self._holds(a, b)
        return known


def _refuse_others(spec: dict) -> None:
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    added = all(not t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
    if not (plain and level and added and spec.get("normalizer") is None):
        raise ValueError("only plain byte-level BPE files are supported")


class Transducer:
    """Encodes one piece, fed in chunks. Memory: the window after the last emission."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.data = b""  # bytes after the last emission
        self.before = -1  # token emitted last
        self.peak = 0

    def feed(self, chunk: bytes) -> Iterator[int]:
        m = self.m
        window = m.lookahead + m.max_token
        for start in range(0, len(chunk), m.max_token):
            self.data += chunk[start : start + m.max_token]
            self.peak = max(self.peak, len(self.data))
            while len(self.data) > window:
                yield from self._settled()

    def _settled(self) -> Iterator[int]:
        """Emit the tokens that lie further back than the lookahead."""
        cut = 0
        for token in self._path(self.data):
            end = cut + len(self.m.bytes_of[token])
            if end > len(self.data) - self.m.lookahead:
                break
            yield token
            self.before, cut = token, end
        self.data = self.data[cut:]

    def finish(self) -> Iterator[int]:
        yield from self._path(self.data)
        self.data, self.before = b"", -1

    def whole(self, data: bytes) -> list[int]:
        """A piece that is all there; one within the window needs no emission before its end."""
        if len(data) > self.m.lookahead + self.m.max_token:
            return [*self.feed(data), *self.finish()]
        return self._path(data)

    def _path(self, data: bytes) -> list[int]:
        """The encoding of bytes after the token emitted last.

        From the left, the longest token that forms a stable pair with the one before it
        is tried first. As the last token of every prefix is unique, a place from which
        the end can't be reached is left for good.
        """
        m, size = self.m, len(data)
        trie, known = m.trie, m.stable_pairs.get
        tokens: list[int] = []
        open_: list[list[int]] = []  # what else could start at the places passed: ends and tokens, longest last
        ends: list[int] = []
        dead = bytearray(size + 1)
        at, left = 0, self.before
        while at < size:
            if len(open_) == len(tokens):  # a new place
                found, node = [], trie
                for k in range(at, size):
                    node = node.get(data[k])
                    if node is None:
                        break
                    if END in node:
                        found += (k + 1, node[END])
                open_.append(found)
            found = open_[-1]
            while found:
                token, end = found.pop(), found.pop()
                if dead[end]:
                    continue
                if left < 0:
                    good = m.alone(token)
                else:
                    good = known(left << 20 | token)
                    if good is None:
                        good = m.stable(left, token)
                if good:
                    tokens.append(token)
                    ends.append(end)
                    at, left = end, token
                    break
            else:
                if not tokens:
                    raise ValueError("a byte is missing from the vocabulary")
                dead[at] = 1
                open_.pop()
                tokens.pop()
                ends.pop()
                at, left = (ends[-1], tokens[-1]) if tokens else (0, self.before)
        return tokens


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Whole texts: special tokens, pieces, and a bounded cache of pieces already encoded."""

    def __init__(self, path: str):
        self.m = MergeList(path)
        self.transducer = Transducer(self.m)
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.m.special, key=len, reverse=True))) + ")") if self.m.special else None

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is not None:
            return found
        found = self.old_pieces.get(piece)
        if found is None:
            found = pack(self.transducer.whole(piece.encode("utf-8")))
        if len(piece) <= 64:
            if len(self.pieces) >= CACHE_ENTRIES:
                self.old_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = found
        return found

    def unit(self, unit: str) -> bytes:
        found = b"".join(map(self.piece, _PIECES.findall(unit)))
        if len(unit) <= 64:
            if len(self.units) >= CACHE_ENTRIES // 2:
                self.units.clear()
            self.units[unit] = found
        return found

    def _long(self, unit: str) -> Iterator[bytes]:
        """A unit without a place to cut, piece by piece; long pieces in chunks."""
        for match in _PIECES.finditer(unit):
            begin, end = match.span()
            if end - begin <= LONG_PIECE:
                yield self.piece(match[0])
                continue
            t = Transducer(self.m)
            for at in range(begin, end, LONG_PIECE):
                yield pack(list(t.feed(unit[at : min(end, at + LONG_PIECE)].encode("utf-8"))))
            yield pack(list(t.finish()))

    def _chunk(self, text: str) -> Iterator[bytes]:
        parts = _BREAK.split(text) if _ODD.search(text) else text.split(" ")
        known, unit = self.units.get, self.unit
        out = []
        for k, p in enumerate(parts):
            p = " " + p if k else p
            if len(p) > LONG_PIECE:
                yield b"".join(out)
                out = []
                yield from self._long(p)
            elif p:
                out.append(known(p) or unit(p))
        yield b"".join(out)

    def _plain(self, text: str) -> Iterator[bytes]:
        start = 0
        while len(text) - start > CHUNK and (cut := _BREAK.search(text, start + CHUNK)):
            yield from self._chunk(text[start : cut.start()])
            start = cut.start()
        yield from self._chunk(text[start:] if start else text)

    def stream(self, text: str | None) -> Iterator[bytes]:
        """Identifiers as little-endian unsigned 32-bit integers, chunk by chunk."""
        if not text:
            return
        if self.split_special is None or not any(s in text for s in self.m.special):
            yield from self._plain(text)
            return
        at = 0
        for found in self.split_special.finditer(text):
            if found.start() > at:
                yield from self._plain(text[at : found.start()])
            yield self.m.special[found[0]].to_bytes(4, "little")
            at = found.end()
        if at < len(text):
            yield from self._plain(text[at:])

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.stream(text))


class TextDecoder:
    """Byte-to-text state machine. Sequences that are not UTF-8 become U+FFFD, one for each longest valid beginning."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.held + data
        cut = len(data)
        if not final:
            for back in range(1, min(3, len(data)) + 1):
                byte = data[-back]
                if byte & 0xC0 == 0x80:
                    continue
                need = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
                if need > back:
                    cut = len(data) - back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")


def decode(m: MergeList, ids: Iterable[int], chunk: int = 4096) -> Iterator[str]:
    """Text of the identifiers in pieces; unknown identifiers are skipped, special tokens are spelled out."""
    machine, buffer = TextDecoder(), []
    for i in ids:
        buffer.append(m.bytes_of.get(i, b""))
        if len(buffer) >= chunk:
            yield machine.feed(b"".join(buffer))
            buffer.clear()
    yield machine.feed(b"".join(buffer), final=True)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    _ENCODERS.clear()


def _encode_batches(batches, path):
    e = encoder(path)
    for batch in batches:
        names = [n for n in batch.schema.names if n != "text"]
        ids = [e.encode(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(ids, pa.binary())], names=[*names, "ids"])


def _round_trip_batches(batches, path):
    e = encoder(path)
    table = e.m.bytes_of
    for batch in batches:
        names = [n for n in batch.schema.names if n != "text"]
        n, ids_sha, text_sha = [], [], []
        for text in batch.column("text").to_pylist():
            count, own, sha, machine = 0, hashlib.sha256(), hashlib.sha256(), TextDecoder()
            for ids in e.stream(text):
                own.update(ids)
                held = memoryview(ids).cast("I").tolist()
                count += len(held)
                sha.update(machine.feed(b"".join(map(table.__getitem__, held))).encode("utf-8"))
            sha.update(machine.feed(b"", final=True).encode("utf-8"))
            n.append(count)
            ids_sha.append(own.hexdigest())
            text_sha.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
            names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _decode_batches(batches, path):
    m = encoder(path).m
    for batch in batches:
        names = [n for n in batch.schema.names if n != "ids"]
        texts = ["".join(decode(m, memoryview(i or b"").cast("I").tolist())) for i in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], names=[*names, "text"])


def encode_documents(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """Columns ``keep`` and ``ids``: little-endian unsigned 32-bit identifiers."""
    return common.per_text(docs, f"{__name__}:_encode_batches", "ids binary", keep, path=path)


def decode_documents(encoded: DataFrame, path: str, *keep: str) -> DataFrame:
    """Columns ``keep`` and the ``text`` of ``ids``."""
    kept, names = common.packed(encoded, keep, ("text",))
    rows = encoded.select(kept, "ids")
    schema = common.schema_of(rows, [common.KEEP], "text string")
    return common.unpacked(common.arrow_map(rows, f"{__name__}:_decode_batches", schema, path=path), names, "text")


def round_trip(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """Encode and decode every text; token counts and digests of both sides."""
    return common.per_text(docs, f"{__name__}:_round_trip_batches", "n_tokens bigint, ids_sha256 string, decoded_sha256 string", keep, path=path)
