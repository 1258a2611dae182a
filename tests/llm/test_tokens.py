import hashlib
import json
import random
import zlib

import numpy as np
import pytest

from lorequarry.llm import bpe, queries, sharding, token_counts, token_store
from lorequarry.llm.common import shared_dir

from . import fixtures

BYTE = queries.vocabulary("byte_bpe_50k.json")
WORD = queries.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


def greedy(vocab, symbols):
    n = at = 0
    while at < len(symbols):
        end = next((e for e in range(len(symbols), at, -1) if symbols[at:e] in vocab), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


def test_automaton_counts_like_repeated_longest_match():
    rng = random.Random(5)
    for _ in range(60):
        vocab = {tuple(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(3, 25))}
        code = {tuple(map(ord, v)) for v in vocab}
        a = token_counts.Automaton(sorted(code))
        for _ in range(60):
            word = tuple(ord(rng.choice("abc")) for _ in range(rng.randint(0, 14)))
            assert a.count(word) == greedy(code, word), (vocab, word)


def test_token_counts_of_a_table(spark):
    pieces = set(token_counts.word_pieces(BYTE))
    found = token_counts.count_tokens(fixtures.table(spark), BYTE, "doc_id", "source").collect()
    got = sorted((r["doc_id"], r["n_tokens"]) for r in found if r["doc_id"] is not None)
    want = sorted((r[0], sum(greedy(pieces, (token_counts.START, *w)) for w in (r[1] or "").encode().split())) for r in fixtures.rows() if r[0] is not None)
    assert got == want
    assert token_counts.count_tokens(fixtures.empty(spark), BYTE, "doc_id").count() == 0


def test_encoder_equals_the_library(library):
    e, rng = bpe.Encoder(BYTE), random.Random(9)
    letters = "ab  \n\n\t.,'s're12é中😀 \x1c\x85 abcdefghij ' "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)] + [r[1] or "" for r in fixtures.rows()]
    for text in texts:
        assert memoryview(e.encode(text)).cast("I").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_transducer_emits_early_and_exactly(library):
    m, rng = bpe.MergeList(BYTE), random.Random(2)
    for text in ("a" * 4000, "ab" * 1500, "-=" * 1500, "".join(rng.choice("thean") for _ in range(4000))):
        t = bpe.Transducer(m)
        early = list(t.feed(text.encode()))
        assert early and t.peak <= m.lookahead_bound() + 2 * m.max_token < 1000
        assert early + list(t.finish()) == library.encode(text, add_special_tokens=False).ids


def test_text_to_come_changes_nothing_before_the_lookahead(library):
    m, rng = bpe.MergeList(BYTE), random.Random(3)
    tokens = [k.decode() for k in m.ids if k.isascii() and k.decode().isalpha()]
    ends = lambda text: set(np.cumsum([len(m.bytes_of[i]) for i in library.encode(text, add_special_tokens=False).ids]).tolist())
    for _ in range(300):
        pool = rng.sample(tokens, 3) if rng.random() < 0.5 else [rng.choice("abehstn") for _ in range(3)]
        text = "".join(rng.choice(pool) for _ in range(rng.randint(100, 400)))
        cut = rng.randint(len(text) // 2, len(text))
        settled = max(0, cut - m.lookahead)
        assert {e for e in ends(text[:cut]) if e <= settled} == {e for e in ends(text) if e <= settled}


def test_pair_stability_equals_merging():
    m, rng = bpe.MergeList(BYTE), random.Random(12)
    ids = sorted(m.ids.values())
    for k in range(4000):
        a, b = rng.choice(ids), rng.choice(ids) if k % 2 else rng.choice(ids[:600])
        if m.alone(a) and m.alone(b):
            assert m.stable(a, b) == (m.merge(m.bytes_of[a] + m.bytes_of[b]) == [a, b])


def test_other_tokenizer_files_are_refused(tmp_path):
    with open(BYTE, encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "x.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.MergeList(str(tmp_path / "x.json"))


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(6)
    letters = "abÄéß ñ\n\t.,'s're12é中😀\u0301 \u2003x-ſK# ' <|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(400)] + [r[1] for r in fixtures.rows()]
    for path in (WORD, BYTE):  # of the known kind, and of another
        library = Tokenizer.from_file(path)
        for text, ids in zip(texts, token_store.WordCache(path).encode_batch(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_decoder_state_machine_equals_one_pass():
    rng = random.Random(4)
    for _ in range(500):
        data = bytes(rng.choice(b"a\xc3\xa9\xe4\xb8\xad\xf0\x9f\x98\x80\xff\xc0") for _ in range(rng.randint(0, 20)))
        machine = bpe.TextDecoder()
        parts = [machine.feed(data[k : k + 1]) for k in range(len(data))] + [machine.feed(b"", final=True)]
        assert "".join(parts) == data.decode("utf-8", "replace"), data


def test_round_trip_query(spark, library):
    for r in bpe.round_trip(fixtures.table(spark), BYTE, "doc_id", "n_words").collect():
        text = {x[0]: x[1] for x in fixtures.rows()}.get(r["doc_id"]) if r["doc_id"] is not None else None
        if r["doc_id"] is None:
            continue
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode_documents(fixtures.table(spark), BYTE, "doc_id", "source")
    assert bpe.decode_documents(encoded, BYTE, "doc_id").where("text = 'one two three'").count() == 1
    assert bpe.round_trip(fixtures.empty(spark), BYTE, "doc_id").count() == 0


def test_store_round_trip_and_lookup(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    manifest = token_store.write_store(fixtures.table(spark), WORD, shared_dir(spark, "tokens"))
    got = token_store.read_store(manifest).collect()
    data = fixtures.rows()
    assert len(got) == len(data)
    ids_of = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    key = lambda d, ids: (d is not None, d or 0, ids)
    found = sorted(key(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got)
    assert found == sorted(key(r[0], ids_of(r[1])) for r in data)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted((r[0] for r in data), key=lambda d: (d is not None, d or 0))
    for doc_id in (0, 4, 17, 44, None, 10**6, -1):
        want = sorted(ids_of(r[1]) for r in data if r[0] == doc_id)
        assert sorted(x.tolist() for x in token_store.lookup(spark, manifest, doc_id)) == want
    empty = token_store.write_store(fixtures.empty(spark), WORD, shared_dir(spark, "tokens"))
    assert token_store.read_store(empty).count() == 0


def test_store_blocks_are_searched(tmp_path):
    with open(tmp_path / "x.sst", "wb") as f:
        w = token_store.TableWriter(f, 2)
        for k in range(0, 60_000, 3):
            w.add(token_store.make_key(k - 30_000, 0), np.arange(k % 11, dtype="<u4"))
        w.close()
    with open(tmp_path / "x.sst", "rb") as f:
        r = token_store.TableReader(f, (tmp_path / "x.sst").stat().st_size)
        assert len(r.index) > 3
        for k in range(0, 60_000, 997):
            found = [ids.tolist() for _, _, ids in r.lookup(k - 30_000)]
            assert found == ([list(range(k % 11))] if k % 3 == 0 else [])


def test_shards(spark, tmp_path):
    data = fixtures.rows()
    one = sharding.shuffle(fixtures.table(spark), 4, bucket_bytes=4000)
    rows = one.collect()
    assert one.columns.count("bucket") == 1 and len(rows) == len(data)
    counts = {}
    for r in rows:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    again = sharding.shuffle(fixtures.table(spark).repartition(7), 4, bucket_bytes=4000).collect()
    place = lambda rs: sorted((r["shard"], r["slot"], -1 if r["doc_id"] is None else r["doc_id"]) for r in rs)
    assert place(rows) == place(again)
    assert place(rows) != place(sharding.shuffle(fixtures.table(spark), 4, seed=8, bucket_bytes=4000).collect())
    assert sharding.write_shards(fixtures.empty(spark), 16, str(tmp_path / "e")).count() == 0
    assert sharding.write_shards(fixtures.table(spark), 16, str(tmp_path / "w")).count() == len(data)


def test_fisher_yates_is_a_fair_permutation():
    assert sorted(sharding.fisher_yates(100, 1, 2)) == list(range(100))
    firsts = [int(np.where(sharding.fisher_yates(4, s, 0) == 0)[0][0]) for s in range(2000)]
    assert all(abs(firsts.count(k) - 500) < 110 for k in range(4))
