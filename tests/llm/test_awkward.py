"""Every operator and stage on awkward tables, and every query on a small folder."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

import corpus_pipeline
from lorequarry.llm import bpe, common, decontaminate, jaccard_join, language_id, line_dedup, quality_rules, queries, sharding, suffix_dedup, token_counts, token_store

from . import fixtures
from .test_duplicates import brute_components, brute_lines
from .test_filters import brute_hits, brute_statistics

BYTE, WORD = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("word_bpe_49k.json")
#: Names that need quotes, and names that the operators use themselves.
ODD = ["a.b", "c d", "e`f", "_key", "_keep", "n_words", "kept", "shard", "items", "_doc", "spans", "line", "num", "bucket"]


def odd_rows(n=14):
    rng = random.Random(5)
    texts = [fixtures.prose(rng, 60) for _ in range(6)]
    texts += [texts[0], texts[0] + " more", None, "", " \n ", "word", "same same " * 40, texts[1].replace("ka", "ko", 1)]
    return [(f"id-{k % 13}" if k != 9 else None, t, *[k + j for j in range(len(ODD))]) for k, t in enumerate(texts[:n])]


def odd_table(spark, rows=None):
    kinds = [StructField("doc_id", StringType()), StructField("text", StringType()), *[StructField(n, IntegerType()) for n in ODD]]
    return spark.createDataFrame(odd_rows() if rows is None else rows, StructType(kinds)).repartition(2)


def operators(spark):
    benchmark = spark.createDataFrame([("x", odd_rows()[2][1][:200]), (None, None)], "item_id string, text string")
    labels = spark.createDataFrame([(f"id-{k}", k % 2) for k in range(8)], "doc_id string, quality int")
    keep = ["doc_id", *ODD]
    return {
        "count": lambda d: token_counts.count_tokens(d, BYTE, *keep),
        "language": lambda d: language_id.predict(d, language_id.train(d.withColumn("lang", F.lit("xx"))), *keep),
        "bpe": lambda d: bpe.decode_documents(bpe.encode_documents(d, BYTE, *keep), BYTE, *keep),
        "round_trip": lambda d: bpe.round_trip(d, BYTE, *keep),
        "shuffle": lambda d: sharding.shuffle(d, 3),
        "components": jaccard_join.components,
        "keep_one": jaccard_join.keep_one,
        "repeats": lambda d: suffix_dedup.remove_repeats(d, *keep, length=40),
        "repeats_none": lambda d: suffix_dedup.remove_repeats(d, *keep, length=40, keep="none"),
        "lines": lambda d: line_dedup.remove_duplicate_lines(d, *keep),
        "clean_lines": line_dedup.clean_documents,
        "hits": lambda d: decontaminate.hits(d, benchmark, *keep),
        "clean_hits": lambda d: decontaminate.clean_documents(d, benchmark),
        "rules": lambda d: quality_rules.apply(d, quality_rules.fit(d, labels), *keep),
        "filter": lambda d: quality_rules.filter_documents(d, quality_rules.fit(d, labels)),
    }


#: Operators that drop rows, with the columns that they replace.
FEWER = {"keep_one", "clean_lines", "clean_hits", "filter"}
REPLACED = {"count": {"n_words"}, "shuffle": {"bucket", "shard"}, "hits": {"n_words", "items"}, "rules": {"n_words", "kept"}, "repeats": {"spans", "kept"}, "repeats_none": {"spans", "kept"}, "components": set(ODD)}


@pytest.mark.parametrize("name", ["count", "language", "bpe", "round_trip", "shuffle", "components", "keep_one", "repeats", "repeats_none", "lines", "clean_lines", "hits", "clean_hits", "rules", "filter"])
def test_odd_names_and_string_ids(spark, name):
    run = operators(spark)[name]
    got = run(odd_table(spark))
    rows = got.collect()
    assert len(rows) <= len(odd_rows()) if name in FEWER else len(rows) == len(odd_rows())
    assert len(set(c.lower() for c in got.columns)) == len(got.columns)
    own = {r[2]: r for r in odd_rows()}  # "a.b" tells the rows apart
    stay = [n for n in ODD if n not in REPLACED.get(name, set())]
    for r in rows:
        r = r.asDict()
        if stay:
            source = own[r["a.b"]]
            assert [r[n] for n in stay] == [source[2 + ODD.index(n)] for n in stay] and r["doc_id"] == source[0]
    empty = run(odd_table(spark, []))
    assert empty.count() == 0 and empty.columns == got.columns


def test_token_store_wants_whole_numbers(spark):
    with pytest.raises(ValueError):
        token_store.write_store(odd_table(spark), WORD, common.shared_dir(spark, "tokens"))


def test_scratch_goes_and_settings_of_the_caller_stay(spark, tmp_path):
    before = spark.conf.get(common.BATCH_BYTES)
    spark.conf.set(common.BATCH_BYTES, "8388608b")
    with common.opened() as scratches:
        line_dedup.clean_documents(fixtures.table(spark)).count()
        jaccard_join.keep_one(fixtures.table(spark)).count()
        suffix_dedup.remove_repeats(fixtures.table(spark), "doc_id").count()
    # what the returned frames read themselves
    assert sum(len(s.paths) for s in scratches) <= 12
    assert spark.conf.get(common.BATCH_BYTES) == "8388608b"
    spark.conf.set(common.BATCH_BYTES, before)


# --- the queries themselves ----------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("folder")
    rng = random.Random(21)
    fixed = {"en": "the and that with this from have over under water stone".split(), "de": "der und dass mit dieses von haben über unter wasser stein".split()}
    rows = []
    for k in range(60):
        lang = "en" if k % 2 else "de"
        lines = [" ".join(rng.choice(fixed[lang]) + rng.choice(["", "s", "en", "ing"]) for _ in range(rng.randint(6, 16))) for _ in range(rng.randint(1, 9))]
        rows.append((k, "\n".join(lines), lang if k % 7 else None))
    rows += [(60, rows[3][1], "en"), (61, rows[4][1] + " tail", "de"), (62, None, None), (63, "", "en"), (64, "12 34", "de"), (65, "x" * 500, "en")]
    items = [(k, " ".join((rows[5 + k][1] or "").split()[:12])) for k in range(3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, k % 3 and 1, 0) for k in range(0, 60, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, items


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_op2_holds_a_fold_back(spark, folder):
    path, rows, _ = folder
    got = by_id(queries.op2_language_id(spark, path))
    assert len(got) == len(rows)
    right = 0
    for d, text, lang in rows:
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= got[d]["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert got[d]["lang_pred"] == "und"
        elif d < 60:
            right += got[d]["lang_pred"] == ("en" if d % 2 else "de")
    assert right >= 57


def test_op4_law_and_digests(spark, folder):
    path, rows, _ = folder
    got = queries.op4_sharding(spark, path).collect()
    counts = {}
    for r in got:
        text = dict((x[0], x[1]) for x in rows)[r["doc_id"]]
        data = (text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows) and set(counts) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    assert max(map(len, counts.values())) - min(len(counts.get(k, [])) for k in range(16)) <= 1


def test_op5_equals_brute_force(spark, folder):
    path, rows, _ = folder
    got = by_id(queries.op5_jaccard_join(spark, path))
    assert sorted(((d, r["n_shingles"], r["component_id"]) for d, r in got.items()), key=str) == brute_components(rows, 4, 85)


def test_op6_equals_brute_force(spark, folder):
    path, rows, _ = folder
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    seen = {}
    for d, t in texts.items():
        for k in range(len(t) - 199):
            seen.setdefault(t[k : k + 200], []).append((d, k))
    gone = {d: set() for d in texts}
    for places in seen.values():
        if len(places) > 1:
            for d, k in places:
                gone[d] |= set(range(k, k + 200))
    got = by_id(queries.op6_suffix_dedup(spark, path))
    assert any(gone.values())
    for d, t in texts.items():
        kept = bytes(b for k, b in enumerate(t) if k not in gone[d])
        spans = sum(k - 1 not in gone[d] for k in gone[d])
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == (len(t), len(gone[d]), spans, hashlib.sha256(kept).hexdigest())


def test_op7_reads_back_what_the_library_gives(spark, folder):
    from tokenizers import Tokenizer

    path, rows, _ = folder
    library, at = Tokenizer.from_file(WORD), 0
    got = by_id(queries.op7_token_store(spark, path))
    for d, text, _ in sorted(rows):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op8_equals_brute_force(spark, folder):
    path, rows, _ = folder
    got = by_id(queries.op8_line_dedup(spark, path))
    left = dict(brute_lines(rows))
    for d, text, _ in rows:
        n = len((text or "").split("\n")) if text is not None else 0
        assert got[d]["text_sha256"] == hashlib.sha256((left[d] or "").encode()).hexdigest() and got[d]["n_lines"] == n


def test_op9_equals_brute_force(spark, folder):
    path, rows, items = folder
    got = by_id(queries.op9_decontamination(spark, path))
    for d, text, _ in rows:
        n, hit, names = brute_hits(text, items)
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, len(hit), len(names), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()


def test_op10_equals_brute_force(spark, folder):
    path, rows, _ = folder
    got = by_id(queries.op10_quality_rules(spark, path))
    for d, text, _ in rows:
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == tuple(brute_statistics(text))
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_op1_and_op3_over_all_texts(spark, folder):
    path, rows, _ = folder
    one, three = by_id(queries.op1_token_counts(spark, path)), by_id(queries.op3_bpe(spark, path))
    assert set(one) == set(three) == {r[0] for r in rows}
    for d, text, _ in rows:
        assert three[d]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest() and one[d]["n_words"] == len((text or "").split())


# --- the stages ------------------------------------------------------------------------------


def test_stages_on_odd_and_empty_tables(spark, folder):
    path = folder[0]
    spark.createDataFrame([], "doc_id string, quality int").write.mode("overwrite").parquet(f"{path}-odd/labels.parquet")
    spark.createDataFrame([("x", "no such words at all")], "item_id string, text string").write.mode("overwrite").parquet(f"{path}-odd/benchmark.parquet")
    for rows in (odd_rows(), []):
        docs = odd_table(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, f"{path}-odd")
            if name != "bpe":
                assert out.dtypes == docs.dtypes
            out = spark.createDataFrame(out.collect(), out.schema)  # written, as it were
            assert out.count() <= docs.count() and (rows or out.count() == 0)
            docs = out
        if rows:
            assert docs.count() > 0
