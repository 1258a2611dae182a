"""Small document tables with the awkward cases every operator must take."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket int, n_words string"
SYLLABLES = "ka lo mi ten dra vul pes ori qua zem blin hof".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def prose(rng, n):
    out, w = [], words(rng, n)
    while w:
        k = rng.randint(4, 14)
        out.append(" ".join(w[:k]).capitalize() + ".")
        w = w[k:]
    return "\n".join(out)


def rows(seed=3, n=30):
    """Prose with exact copies, near copies, nulls, empties, repeats, odd characters and one long text."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(30, 160)) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1]]
    for k in range(4):
        w = texts[2].split(" ")
        w[5 + 9 * k % max(len(w) - 6, 1)] = "edited"
        texts.append(" ".join(w))
    texts += [None, None, "", " \n\t ", "one", "one two three", "Ärger über Öl — naïve façade 😀 x y <|endoftext|> z", "a" * 700, prose(rng, 3000), "same words " * 60]
    out = [(k, t, "en" if k % 3 else None, f"s{k % 4}", None if t is None else len(t), k, "clash") for k, t in enumerate(texts)]
    out.append((None, texts[3], None, None, None, None, None))
    out.append((None, None, None, None, None, None, None))
    out.append(out[4])
    return out


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
