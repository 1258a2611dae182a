import hashlib
import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lorequarry.llm import bpe, common, jaccard_join, quality_rules, queries

from . import fixtures
from .test_duplicates import brute_components, brute_lines
from .test_filters import brute_hits, brute_statistics

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(11)
    items = [(k, " ".join(fixtures.words(rng, 14))) for k in range(4)]
    texts = ["\n".join(" ".join(fixtures.words(rng, 16)) for _ in range(rng.randint(3, 8))) for _ in range(40)]
    texts += [texts[0], texts[1], texts[2].replace("ka", "ko", 1), texts[3] + "\n" + items[0][1], "short text", None, "", "same words again and again and on " * 12]
    texts += [" | ".join(fixtures.words(rng, 40)) for _ in range(40)]
    docs = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    labels = [(k, 0 if t and "|" in t else 1, 0) for k, t in enumerate(texts) if k % 2 == 0]
    return docs, items, labels


def test_the_pipeline_equals_brute_force(spark, tmp_path):
    docs, items, labels = corpus()
    spark.createDataFrame(docs, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labelled = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    labelled.write.parquet(str(tmp_path / "labels.parquet"))

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rules = quality_rules.fit(spark.createDataFrame(docs, COLUMNS), labelled)
    assert rules.rules
    rows = []
    for d in docs:
        n, _, _, _, repeated = brute_statistics(d[1])
        stats = dict(zip(quality_rules.STATISTICS, quality_rules.text_statistics(d[1])))
        table = {k: np.array([stats[a] / max(stats[b], 1) if b else stats[a]], float) for k, (a, b) in quality_rules.RATIOS.items()}
        if n >= 20 and 100 * repeated <= 30 * n and rules.predict(table, 1)[0]:
            rows.append(d)
    before = {d[0]: d[1] for d in rows}
    rows = [(k, t) for k, t in brute_lines(rows) if t == before[k] or t.strip()]
    groups = {}
    for k, n, c in brute_components(rows, 5, 80):
        groups.setdefault(c if n else ("none", k), []).append(k)
    stay = {min(g) for g in groups.values()}
    rows = [r for r in rows if r[0] in stay and not brute_hits(r[1], items)[1]]

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    assert set(got) == {k for k, _ in rows}
    for k, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert set(range(4, 40)) <= set(got) and {40, 41, 43, 44, 45, 46, 47, *range(48, 88)}.isdisjoint(got)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, items, labels = corpus()
    table = spark.createDataFrame(docs, COLUMNS)
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).dtypes == table.dtypes


class Captured:
    """Takes the function that a worker would run."""

    def __init__(self, spark):
        self.sparkSession = spark

    def mapInArrow(self, run, schema):
        return run


def test_a_worker_holds_the_caches_of_one_operator(spark):
    path = queries.vocabulary("byte_bpe_50k.json")
    texts = pa.RecordBatch.from_pydict({"text": ["some words of a text", "and of another one"]})
    sets = common.arrow_map(Captured(spark), "lorequarry.llm.jaccard_join:_token_batches", None, shingle=2, percent=80)
    encoded = common.arrow_map(Captured(spark), "lorequarry.llm.bpe:_encode_batches", None, path=path)
    contracted = common.arrow_map(Captured(spark), "lorequarry.llm.common:_contract_batches", None)

    first = list(sets([texts]))
    list(contracted([]))
    assert jaccard_join._WORDS
    ids = list(encoded([texts]))
    assert bpe._ENCODERS and not jaccard_join._WORDS
    assert list(sets([texts])) == first
    assert jaccard_join._WORDS and not bpe._ENCODERS
    assert list(encoded([texts])) == ids
