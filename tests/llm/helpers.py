"""Plain definitions that the operators are compared with, and a table of awkward rows."""

import math
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ["kept", "size", "slot", "shard", "start", "row", "id", "rid", "text_hash", "n", "no", "copy", "copies", "label", "digest", "h", "target", "each", "own", "rank"]


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def awkward_rows(seed=1):
    rng = random.Random(seed)
    base = sentence(rng, 60, 5000)
    near = base.split()
    near[30] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", None), (2, base, "en", None), (3, " ".join(near), None, "b"),
        (4, None, None, None), (5, "", "", ""), (6, " \n\t ", "en", "a"), (7, "one two", "en", "a"), (8, "one  two", "en", "b"),
        (None, "a null id with enough words to be a document of its own here", "en", "a"), (None, None, "en", "a"),
        (9, sentence(rng, 200_000, 10**9), "en", "b"), (10, "x" * 300_000, "en", "b"), (11, "é" * 50 + " 𝒳   ü ñ\x1c" * 20, "fr", "c"),
        (12, "same id, first text " * 4, "en", "a"), (12, "same id, second and other text " * 4, "en", "a"), (-3, "negative id " * 20, "en", "z"),
        (14, " " * 1_000_000 + "after a long run of white space" + "\n" * 5000, "en", "b"),
        (13, "null\x00byte and \\### Assistant: </turn> text " * 3, "en", "c"),
    ]
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d in rows]


def awkward(spark, clashing=True):
    df = spark.createDataFrame(awkward_rows(), DOC)
    if clashing:
        for i, c in enumerate(CLASHES):
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit(i))
    return df


def empty(spark):
    return spark.createDataFrame([], DOC)


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def links(texts):
    """{row: [linked rows]} at a Jaccard similarity of 0.8 or more."""
    sets = [shingles(t) for t in texts]
    out = {i: [] for i in range(len(texts))}
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                out[i].append(j)
                out[j].append(i)
    return out


def weighted_similarity(a, b, items):
    """Weighted multiset Jaccard similarity of two word lists; weights are IDFs over the items' shingles, as whole numbers."""
    n = min(5, len(b))

    def grams(w, n=n):
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    df = Counter(g for w in items if w for g in set(tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)))
    total = sum(1 for w in items if w)
    weight = lambda g: max(1, round(1000 * math.log(1 + total / max(1, df[g]))))
    x, y = grams(a), grams(b)
    shared = sum(weight(g) * k for g, k in (x & y).items())
    return shared / (sum(weight(g) * k for g, k in x.items()) + sum(weight(g) * k for g, k in y.items()) - shared)
