"""Fixtures in small, and brute force."""

import re

import public_tokenizers
from pyspark.sql import types as T

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: documents with further columns of names that operators use themselves
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("score", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_chars", T.LongType())])

ODD_TEXTS = ["", None, " ", "\n\n", "a", "one two three four", "Élan ß ÿ × 日本 \U0001f600", "x" * 5000, "word " * 3000, "1" * 4000, "don't <|endoftext|> it's\x00\x01\x02", "tab\tvtab\x0bff\x0cnbsp end\x1cx"]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "clash", None, "clash", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "in", "ou", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def shingles(text, k=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def components(ids, links):
    label = {i: i for i in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
