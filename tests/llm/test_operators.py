import base64
import gzip
import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, awkward_rows, base_counts, empty, links, sentence, weighted_similarity, words
from pyspark.sql import functions as F

from logweave.llm import chat, decontaminate, jaccard, licences, mixing, quality, queries, sharding, tokens, urls, warc

LABELS = "doc_id bigint, quality int, toxic int"


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# ---- 1 quality


def test_quality_base_counts(spark, sf):
    model = quality.Model(np.zeros(1 << quality.BITS, dtype=np.float32), 0.0, fitted=False)
    for df in (documents(spark, sf), awkward(spark)):
        texts = df.select("doc_id", "text").collect()
        got = quality.rules(df, model).collect()
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == Counter((r["doc_id"], *base_counts(r["text"])) for r in texts)
        for r in got:
            failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
            assert (r["base_failed"], r["kept"]) == (failed, not failed)


def test_quality_model_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    held = quality.rules(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("quality", "label"), "doc_id").where("not base_failed").toPandas()
    assert ((held["quality"] >= 0.5) == (held["label"] == 1)).mean() > 0.9
    assert held[held["label"] == 1]["kept"].mean() > 0.97
    again = quality.fit(docs.repartition(5), labels.where("doc_id % 2 = 0"))
    assert np.allclose(again.weights, model.weights) and again.slope == pytest.approx(model.slope)


def test_quality_without_usable_labels(spark):
    docs = awkward(spark)
    for rows in ([], [(1, None, 0)], [(1, 1, 0), (3, 1, 0)], [(None, 0, 0)]):
        model = quality.fit(docs, spark.createDataFrame(rows, LABELS))
        assert not model.fitted
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.rules(docs, model).where("kept").count()
    assert quality.rules(empty(spark), model).count() == 0 == quality.keep(empty(spark), model).count()


M64 = 2**64


def finalised(x):
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 % M64
    return x ^ x >> 32


def plain_logit(model, text):
    """The model's logit of one text, from its definition: n-grams one by one, with whole numbers."""
    p, n_step = 0x9E3779B97F4A7C15 | 1, 0xBF58476D1CE4E5B9

    def word_hash(w):
        b = w.encode()
        total = sum(finalised((x + 1) * 0xA0761D6478BD642F % M64) * pow(p, i, M64) for i, x in enumerate(b))
        return finalised((total + len(b) * n_step) % M64)

    slots, hashed = [], [word_hash(w) for w in words(text)]
    for n in quality.WORD_N:
        grams = []
        for i in range(len(hashed) - n + 1):
            h = hashed[i]
            for k in range(1, n):
                h = (h * n_step + hashed[i + k]) % M64
            grams.append(finalised((h + n) % M64) * (0x9FB21C651E98DF25 + 2 * n) % M64 >> 64 - quality.BITS)
        slots.append(grams)
    # a character's number: the lead byte's, then six bits for each byte that follows
    points = [int.from_bytes(c.encode()[:1]) if len(c.encode()) == 1 else None for c in text]
    for i, c in enumerate(text):
        if points[i] is None:
            b, value = c.encode(), c.encode()[0]
            for x in b[1:]:
                value = value << 6 | x & 0x3F
            points[i] = value
    for n in quality.CHAR_N:
        grams = []
        for i in range(len(points) - n + 1):
            h = points[i]
            for k in range(1, n):
                h = (h * 0x01000193 + points[i + k]) % 2**32
            h = (h ^ h >> 15) * (0x85EBCA6B + 2 * n) % 2**32
            grams.append(h >> 32 - quality.BITS)
        slots.append(grams)
    return model.bias + sum(quality._SCALE * sum(float(model.weights[x]) for x in g) / max(1, len(g)) for g in slots)


def test_quality_scores_by_definition(spark, sf):
    docs = documents(spark, sf)
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r["doc_id"], r["text"][:400]) for r in docs.orderBy("doc_id").limit(40).collect()] + [(-1, "é𝒳 ü ñ " * 9), (-2, "a b c d e f g h i j k")]
    got = {r["doc_id"]: r for r in quality.rules(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    for i, text in rows:
        z = model.slope * plain_logit(model, text) + model.shift
        p = 1 / (1 + np.exp(-z))
        assert got[i]["quality"] == pytest.approx(p, rel=1e-6)
        assert got[i]["kept"] == (not got[i]["base_failed"] and p >= quality.THRESHOLD)


def test_quality_sample_is_bounded(spark, monkeypatch):
    texts = {i: sentence(random.Random(i), 60, 300 if i % 2 else 10**6) for i in range(30)}
    rows = [(i, t) for i, t in texts.items()] + [(3, texts[3])] * 5000 + [(4, f"{texts[4]} other {i % 50}") for i in range(2000)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, i % 2, 0) for i in range(30)], LABELS)
    seen = []
    descend = quality._descend
    monkeypatch.setattr(quality, "_descend", lambda r, s, v, y: seen.append((len(y), len(s))) or descend(r, s, v, y))
    model = quality.fit(docs, labels)
    assert model.fitted and seen[-1][0] == 24  # four fifths of 30 rows, however often one is repeated
    again = quality.fit(docs.repartition(7), labels)
    assert np.allclose(again.weights, model.weights)
    monkeypatch.setattr(quality, "SAMPLE_SLOTS", 8000)
    assert quality.fit(docs, labels).fitted and seen[-1][0] < 24 and seen[-1][1] <= 8000


# ---- 2 sharding


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_are_gapless_and_even(spark, shards):
    rows = [(i, sentence(random.Random(i), 20 + i % 50), "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 5}", 1) for i in range(4000)]
    rows += [(5000 + i, "copy " * 30, "en", "hot", 1) for i in range(2000)]  # a hot group
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = sharding.shard(df, shards).toPandas()
    size = {r[0]: len(r[1].encode()) + 16 for r in rows}
    assert Counter(out["doc_id"]) == Counter(size.keys()) and all(size[i] == s for i, s in zip(out["doc_id"], out["size"]))
    assert all(zlib.crc32(r[1].encode()) == c for r, c in zip(sorted(rows), out.sort_values("doc_id")["text_crc32"]))
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    total = out.groupby("shard")["size"].sum()
    assert len(total) == shards and total.max() <= 1.15 * total.mean() and total.min() >= 0.85 * total.mean()


def test_shards_keep_small_groups_together_and_take_awkward_rows(spark):
    rows = [(i, f"text {i // 3} " + "x" * 40, "en", f"s{i % 4}", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = sharding.shard(df, 8).groupBy(F.floor(F.col("doc_id") / 3)).agg(F.count_distinct("shard").alias("k"))
    assert out.where("k > 1").count() == 0
    odd = sharding.shard(awkward(spark), 4).toPandas()
    assert len(odd) == len(awkward_rows()) and odd[odd["doc_id"] == 4]["size"].tolist() == [16]
    assert odd[odd["doc_id"] == 4]["text_crc32"].tolist() == [0]
    assert sharding.shard(empty(spark)).count() == 0


def test_shards_are_the_same_again_and_can_be_written(spark, sf, tmp_path):
    df = documents(spark, sf)
    a, b = (sorted(map(tuple, sharding.shard(x, 5).select("doc_id", "shard", "slot").collect())) for x in (df, df.repartition(7)))
    assert a == b
    sharding.write(df, f"{tmp_path}/shards", 5)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == df.count() and sorted(map(tuple, back.select("row.doc_id", "shard", "slot").collect())) == a


def test_one_row_repeated_is_spread(spark):
    rows = [(i, sentence(random.Random(i), 30)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' as lang", "'s' as source")
    copies = spark.range(6000).selectExpr("7L as doc_id", "repeat('one row again and again ', 6) as text", "'en' as lang", "'s' as source")
    out = [sharding.shard(x, 10).select("doc_id", "size", "shard", "slot").toPandas() for x in (df.unionAll(copies), df.unionAll(copies.repartition(3)).repartition(5))]
    assert sorted(map(tuple, out[0].values.tolist())) == sorted(map(tuple, out[1].values.tolist()))
    total = out[0].groupby("shard")["size"].sum()
    assert len(total) == 10 and total.max() <= 1.15 * total.mean() and total.min() >= 0.85 * total.mean()
    assert (out[0][out[0]["doc_id"] == 7].groupby("shard").size() > 0).sum() > 5
    for _, g in out[0].groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_cuts_are_weighted_medians_of_the_widest_dimension(spark):
    rng = random.Random(3)
    units = [([rng.random() * 0.3, rng.choice([0.1, 0.5, 0.9]) + rng.random() / 2**20, 0.5 + rng.random() / 2**20, rng.random() ** 3], rng.randrange(1, 100)) for _ in range(6000)]
    df = spark.createDataFrame([(i, at, w) for i, (at, w) in enumerate(units)], "id bigint, at array<double>, weight bigint")
    for shards in (1, 2, 7, 40):
        shard = {r["id"]: r["shard"] for r in sharding.tree(df, shards).collect()}
        todo = [(list(range(len(units))), 0, shards)]
        while todo:
            mine, first, n = todo.pop()
            assert {shard[i] for i in mine} <= set(range(first, first + n))
            if n == 1:
                continue
            dim = max(range(4), key=lambda d: max(units[i][0][d] for i in mine) - min(units[i][0][d] for i in mine))
            left, right = [i for i in mine if shard[i] < first + n // 2], [i for i in mine if shard[i] >= first + n // 2]
            assert max(units[i][0][dim] for i in left) < min(units[i][0][dim] for i in right)
            total = sum(units[i][1] for i in mine)
            off = sum(units[i][1] for i in left) - total * (n // 2) / n
            # as near as the tolerance, or one unit, allows
            assert abs(off) <= max(sharding.TOLERANCE * total / n, 100)
            todo += [(left, first, n // 2), (right, first + n // 2, n - n // 2)]


def test_written_shards_are_ranges_of_slots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "FILE_BYTES", 20_000)
    rows = [(i % 700, sentence(random.Random(i % 700), 30), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, extra bigint").selectExpr("*", "'en' as lang", "'s' as source")
    sharding.write(df, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out").select("row.*", "shard", "slot", F.input_file_name().alias("file"))
    assert sorted(r["extra"] for r in back.collect()) == list(range(1500))
    ranges = back.groupBy("shard", "file").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n")).orderBy("shard", "a").collect()
    assert len(ranges) > 8 and all(r["b"] - r["a"] + 1 == r["n"] for r in ranges)


# ---- 3 mixing


def test_mix_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 0)], "source string, source_size bigint")
    t = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # budget 1665; caps 20, 200, 2000: a and b stop, c gets the rest
    assert t == {"a": 20.0, "b": 200.0, "c": 1445.0, None: 0.0}


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def test_mix_takes_its_targets(spark, sf):
    for df in (documents(spark, sf), awkward(spark)):
        out = mixing.mix(df).toPandas()
        assert len(out) == df.count()
        sizes = defaultdict(int)
        for r in df.collect():
            sizes[r["source"]] += len(words(r["text"]))
        want = brute_targets(dict(sizes))
        out["source"] = [None if x is None or x != x else x for x in out["source"]]
        for s, g in out.groupby(out["source"].map(lambda x: (x is None, x or "")), dropna=False):
            name = None if s[0] else s[1]
            assert g["source_size"].iloc[0] == sizes[name] and g["target"].iloc[0] == pytest.approx(want[name], rel=1e-12)
            assert abs(g["taken"].sum() - want[name]) <= 1
        assert (out["taken"] <= 2 * out["size"]).all() and (out["taken"] >= 0).all()
    assert mixing.mix(empty(spark)).count() == 0 == mixing.apply(empty(spark)).count()


def test_mix_schedule_is_even_and_repeatable(spark):
    df = spark.createDataFrame([(i, f"a{i % 3}", 50) for i in range(6000)], "doc_id bigint, source string, size bigint")
    placed, sources = mixing.place(df)
    seg = mixing.segments(placed, sources, block_tokens=100).toPandas()
    again, sources2 = mixing.place(df.repartition(9))
    b = mixing.segments(again, sources2, block_tokens=100).toPandas()
    key = ["doc_id", "pass", "block", "first_word", "taken", "slot"]
    assert sorted(map(tuple, seg[key].fillna(-1).values.tolist())) == sorted(map(tuple, b[key].fillna(-1).values.tolist()))
    assert seg["slot"].notna().all() and sorted(seg["slot"].unique()) == list(range(seg["slot"].nunique()))
    # every prefix of the schedule holds about its share of each source
    slots = seg.dropna().drop_duplicates("slot").sort_values("slot")
    share = slots["source"].value_counts(normalize=True)
    for n in (100, 500, 2000):
        part = slots.head(n)["source"].value_counts()
        assert all(abs(part[s] - n * share[s]) < 6 for s in share.index)


def test_mix_lays_out_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_COPIES", 7)
    rows = [(i, "a", 5 + i % 3) for i in range(40)] + [(3, "a", 9)] * 50 + [(None, "a", i % 4) for i in range(60)] + [(1, None, 3)] * 3
    placed, _ = mixing.place(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint"))
    got = placed.collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(rows)
    for s in ("a", None):
        mine = sorted((r["start"], r["size"]) for r in got if r["source"] == s and r["size"])
        assert [a for a, _ in mine] == [sum(n for _, n in mine[:k]) for k in range(len(mine))]


def test_mix_apply_takes_rows_that_differ_in_other_columns(spark):
    rows = [(1, "the same words of one text here", "a", i % 2, {"k": i}) for i in range(10)] + [(2, "some other words", "b", 0, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra int, more map<string,int>")
    got = mixing.apply(df).collect()
    share = Counter(r["extra"] for r in got if r["doc_id"] == 1)
    assert share[0] and share[1] and all(n <= 10 for n in share.values())


def test_mix_apply_repeats_whole_documents(spark):
    df = awkward(spark)
    out = mixing.apply(df)
    assert out.columns == df.columns
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
    have = Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())
    assert all(n <= 2 * have[k] for k, n in got.items()) and all(words(k[1]) for k in got)
    taken = sum(n * len(words(k[1])) for k, n in got.items())
    assert abs(taken - 1.5 * sum(n * len(words(k[1])) for k, n in have.items())) < 450_000  # within the two long documents


def test_mix_apply_interleaves_and_stops_near_the_target(spark, monkeypatch):
    # a small source with one long document among short ones, and two sources of short documents
    rows = [(0, "w " * 20_000, "a")] + [(i, "w " * 100, "a") for i in range(1, 11)] + [(100 + i, "w " * 100, "bc"[i % 2]) for i in range(2000)]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sizes = df.select("source", mixing.words(df["text"]).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    targets = mixing.targets
    for weights in ((5, 2, 1), (1, 40, 40)):
        monkeypatch.setattr(mixing, "targets", lambda sizes, weights=weights: targets(sizes, weights))
        got = mixing.apply(df).collect()
        placed = mixing.place(df.select("doc_id", "source", mixing.words(F.col("text")).alias("size")))[0].collect()
        for s, stop in {r["source"]: r["stop"] for r in mixing.targets(sizes).collect()}.items():
            mine = [r for r in placed if r["source"] == s]
            ends = [r["start"] + p * r["source_size"] + d for r in mine for p in (0, 1) for d in (0, r["size"])]
            taken = sum(len(words(r["text"])) for r in got if r["source"] == s)
            assert abs(taken - stop) == min(abs(x - stop) for x in ends)
    # short documents of the last run: each stretch of the output holds about the shares of the whole
    share = Counter(r["source"] for r in got)
    for n in range(500, len(got), 500):
        part = Counter(r["source"] for r in got[:n])
        assert all(abs(part[s] - n * share[s] / len(got)) < 100 for s in "bc")


# ---- 4 licences


def brute_licences(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = "".join(c if ord(c) >= 0x80 or c.isalnum() and ord(c) < 0x80 else " " for c in low).split(" ")
    w = [x for x in w if x]
    places, labels = [], set()
    for label, phrase in licences.BASE:
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licences_base_places(spark, sf):
    more = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(["under the MIT License. " * 300, "CC BY-NC cc,by;nc CC BY NC-SA", "under the mit license", "Under THE\nMIT\tlicense", "apache license version 2", "the mit license", "under the mit licensed"])], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for df in (documents(spark, sf), awkward(spark), more):
        texts = Counter((r["doc_id"], *brute_licences(r["text"])) for r in df.collect())
        got = licences.scan(df).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == texts
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1 for r in got)
    assert licences.scan(empty(spark)).count() == 0


def brute_templates(text, idf):
    """Labels and score by trying every place of every template."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = "".join(c if ord(c) >= 0x80 or c.isalnum() else " " for c in low).split()
    places = lambda p: [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    labels, score = set(), 0.0
    for label, phrase in licences.BASE:
        if places(phrase.split()):
            labels.add(label)
            score = 1.0
    for label, notice, keys in licences.TEMPLATES:
        t, at, starts, want, before = licences.plain(notice), 0, None, None, 0
        for key in map(licences.plain, keys):
            at = next(i for i in range(at, len(t)) if t[i : i + len(key)] == key)
            there = places(key)
            if starts is None:
                first, pairs = at, [(s, s) for s in there]
            else:
                slack = max(1, round(licences.SLACK * (at - before)))
                pairs = [(s, min(near)) for s, x in pairs if (near := [y for y in there if abs(y - (x + at - before)) <= slack])]
            starts, before = [s for s, _ in pairs], at
        weight = [max(idf.get(x, 0.0), 1e-3) for x in t]
        best = 0.0
        for s in starts:
            share = sum(g for k, (x, g) in enumerate(zip(t, weight)) if any(0 <= s - first + k + d < len(w) and w[s - first + k + d] == x for d in range(-licences.SPREAD, licences.SPREAD + 1)))
            best = max(best, share / sum(weight))
        if best >= licences.MIN_SCORE:
            labels.add(label)
            score = max(score, min(best, 1.0))
    return ",".join(sorted(labels)), score


def test_licences_against_all_places(spark, sf):
    rng = random.Random(2)
    texts = [r["text"] for r in documents(spark, sf).limit(60).collect()]
    for _, notice, _ in licences.TEMPLATES:
        w = notice.split()
        for _ in range(2):
            v = [x if rng.random() > 0.06 else rng.choice([x + " extra", "other", ""]) for x in w]
            texts.append(sentence(rng, rng.randrange(12)) + " " + " ".join(v) + " " + sentence(rng, 5) + " " + rng.choice(licences.TEMPLATES)[1])
    texts += ["permission is hereby granted " * 40, "gnu general public license " * 30 + "version 3 of the license", "apache license version 2 " * 200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    idf = licences.word_idf(df)
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    found = set()
    for i, text in enumerate(texts):
        labels, score = brute_templates(text, idf)
        assert got[i]["labels"] == labels and got[i]["score"] == pytest.approx(score, abs=1e-9), text
        found |= set(labels.split(","))
    assert len(found) > 35


def test_licences_many_notices_in_one_text(monkeypatch):
    monkeypatch.setattr(licences, "AT_ONCE", 500)
    out = licences.PositionalIndex({}).scan(pa.array([(licences.TEMPLATES[0][1] + " and more ") * 3000, None]))
    assert out["labels"] == ["mit", ""] and out["score"] == pytest.approx([1.0, 0.0])


def test_licences_templates(spark):
    mit = licences.TEMPLATES[0][1]
    noisy = mit.replace("obtaining a copy", "who obtains one copy").title()
    cases = {mit: "mit", "x " * 50 + noisy: "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl-3", "GNU General Public License": "", "version 3 ... GNU General Public License": "", "permission is hereby granted free of charge": "", "Licensed under CC BY-NC 4.0. This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "cc-by-nc,mpl-2", "See the Mozilla Public License, v. 2.0": ""}
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(cases)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r["doc_id"]: r["labels"] for r in licences.scan(df).collect()} == dict(enumerate(cases.values()))


def test_licences_fsf_notices(spark):
    notice = "{} is free software{} you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation{} version {} of the License, or\n# (at your option) any later version.\n"
    cases = {notice.format("This program", ":", ", either", 3): "gpl-3", notice.format("This program", ";", "; either", 2): "gpl-2", "x " * 40 + notice.format("It", ":", "; either", 3): "gpl-3"}
    cases |= {"under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.": "gpl-2", "the GNU General Public License as published by the Free Software Foundation": ""}
    cases |= {notice.format("It", ";", ", either", 1): ""}
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(cases)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r["doc_id"]: r["labels"] for r in licences.scan(df).collect()} == dict(enumerate(cases.values()))
    lesser = df.where("doc_id < 2").withColumn("text", F.replace("text", F.lit("General"), F.lit("Lesser General")))
    assert not any("gpl-" in r["labels"] for r in licences.scan(lesser).collect())


# ---- 5 token output


def test_tokens_in_many_shards(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WRITERS", 3)
    monkeypatch.setattr(tokens, "PER_SHARD", 100)
    df, folder = documents(spark, sf), f"file://{tmp_path}/tokens"
    index = tokens.materialise(df, folder).toPandas().sort_values("slot")
    assert index["shard"].nunique() > 3 and (index["shard"].diff().dropna() >= 0).all()
    got = list(tokens.read(folder))
    assert [x[0] for x in got] == index["slot"].tolist() == list(range(len(index)))
    assert [zlib.crc32(x[3].tobytes()) for x in got] == index["token_crc32"].tolist()
    assert sorted(map(tuple, index[["doc_id", "seq"]].values.tolist())) == sorted((x[1], x[2]) for x in got)


def test_tokens_round_trip(spark, sf, tmp_path):
    tok = tokens.tokenizer()
    for k, df in enumerate((documents(spark, sf), awkward(spark), empty(spark))):
        folder = f"file://{tmp_path}/tokens{k}"
        index = tokens.materialise(df, folder).toPandas()
        parts, order = defaultdict(list), []
        for slot, doc, seq, ids in tokens.read(folder):
            order.append(slot)
            parts[doc].append((seq, ids))
        assert order == list(range(len(index))) and sorted(index["slot"]) == order
        want = Counter((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in df.collect())
        ids_by_doc = defaultdict(int)
        for (doc, text), n in want.items():
            count = len(tok.encode(text.encode())) + 1
            ids_by_doc[doc] += n * count
            if sum(v for (d, _), v in want.items() if d == doc) == 1:
                ids = np.concatenate([x for _, x in sorted(parts[doc], key=lambda p: p[0])])
                assert ids[-1] == tokens.END and tok.decode(ids[:-1]) == text
        assert {d: sum(len(x) for _, x in v) for d, v in parts.items()} == dict(ids_by_doc)
        for r in index.head(50).itertuples():
            slot, doc, seq, ids = next(tokens.read(folder, r.slot, r.slot + 1))
            assert (doc if doc != -1 else None) == (None if r.doc_id != r.doc_id else r.doc_id) and seq == r.seq and zlib.crc32(ids.tobytes()) == r.token_crc32
    assert [s for s, *_ in tokens.read(f"file://{tmp_path}/tokens0", 7, 12)] == [7, 8, 9, 10, 11]


def test_tokens_of_long_white_space():
    tok, rng = tokens.tokenizer(), random.Random(3)
    for n in (10**6, 10**7):
        for text in (" " * n, "a" + "\n" * n + "b", " \t" * (n // 2) + "\u3000x"):
            assert tok.decode(np.array(tok.encode(text.encode()))) == text
    for _ in range(40):  # where the pattern can do it whole, the ids are the same
        text = "".join(rng.choice(["word", "9", "!", ".", "é"]) + "".join(rng.choice(" \t\n\r\u3000\x85\xa0") for _ in range(rng.choice([1, 2, 4095, 4096, 4097, 9000]))) for _ in range(4)) + rng.choice(["", "end", " end"])
        assert tok.encode(text.encode()) == tok.encoding.encode_ordinary(text)


def test_tokens_stand_in_permuted_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "PER_SHARD", 64)
    monkeypatch.setattr(tokens, "PAGE", 3)
    rows = [(i, sentence(random.Random(i), 1 + i * 37 % 1500, 10**6)) for i in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/docs")
    df = spark.read.schema("doc_id bigint, text string").parquet(f"{tmp_path}/docs")
    parts, most, bound = tokens.number_range(df)
    # every document's numbers: its partition's part of the range, and the bounds of the rows before it there
    where = df.select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("no"), F.octet_length("text").alias("size")).orderBy("no").collect()
    first, used = {}, Counter()
    for r in where:
        first[r["doc_id"]] = r["part"] * most + used[r["part"]]
        used[r["part"]] += -(-(r["size"] + 1) // tokens.LENGTH)
    assert max(used.values()) == most and sum(used.values()) == bound and parts == max(used) + 1
    folder = f"file://{tmp_path}/tokens"
    index = tokens.materialise(df, folder).orderBy("slot").collect()
    place = tokens.permute(np.array([first[r["doc_id"]] + r["seq"] for r in index]), parts * most)
    assert [r["slot"] for r in index] == list(range(len(index))) and (np.diff(place) > 0).all()
    layout = tokens.json.loads(open(f"{tmp_path}/tokens/layout.json").read())
    assert len(layout["pages"]) > 2 and layout["sequences"] == len(index)
    assert [(s, d, q) for s, d, q, _ in tokens.read(folder, 11, len(index) - 5)] == [(r["slot"], r["doc_id"], r["seq"]) for r in index[11:-5]]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 65537])
def test_permutation(n):
    p = tokens.permute(np.arange(n), n, 42)
    assert sorted(p.tolist()) == list(range(n)) and (tokens.permute(p, n, 42, back=True) == np.arange(n)).all()
    if n > 100:
        assert (p != tokens.permute(np.arange(n), n, 43)).mean() > 0.9 and abs(np.corrcoef(p, np.arange(n))[0, 1]) < 0.2


# ---- 6 warc


PAGES = "page_id bigint, url string, html string"


def test_warc_round_trip(spark, sf):
    odd = spark.createDataFrame([(1, "u", "abc"), (2, "v", "abc"), (3, None, None), (4, "x\r\nWARC-Type: y", ""), (None, "z", "abc"), (5, "u", "é\r\n\r\n" * 100_000), (6, "u", "WARC/1.1\r\n\r\n")], PAGES).withColumn("first", F.lit(1)).withColumn("sha1", F.lit("x"))
    for pages in (spark.read.parquet(f"{sf}/pages.parquet"), odd, spark.createDataFrame([], PAGES)):
        rows = [(r["page_id"], r["html"] or "") for r in pages.collect()]
        top = {}
        for i, h in rows:
            top[h] = max((x for x in (top.get(h), i) if x is not None), default=None)
        want = Counter((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), *(("response", None) if i == top[h] else ("revisit", top[h]))) for i, h in rows)
        got = warc.read(warc.write(pages)).collect()
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
        assert all(r["digest_ok"] for r in got)


def test_warc_min_bytes_and_digests(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], PAGES)
    assert {r["record_type"] for r in warc.read(warc.write(pages, min_bytes=4)).collect()} == {"response"}
    good = warc.record(1, "http://a/", b"payload")
    bad = good.replace(b"\r\n\r\npayload", b"\r\n\r\npaylaad")
    (r,) = warc.records(io.BytesIO(warc.member(bad)))
    assert "sha1:" + warc.digest32(r.sha1) != r.headers["warc-payload-digest"]


def test_warc_reader_frames_members():
    many = [warc.record(i, "http://a/", bytes([i]) * (i * 40_000)) for i in range(6)]
    data = b"".join(map(warc.member, many))
    got = list(warc.records(io.BytesIO(data), keep_payload=True))
    assert [r.payload for r in got] == [bytes([i]) * (i * 40_000) for i in range(6)]
    assert gzip.decompress(data) == b"".join(many)
    for broken in (data[:-3], data[:-40] + b"junk", warc.member(many[1] + many[2]), warc.member(many[3][:-4]), b"plain text"):
        with pytest.raises(ValueError, match="record"):
            list(warc.records(io.BytesIO(broken)))


def warc_record(kind, block, *head):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", *head, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_reads_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    sha = warc.digest32(hashlib.sha1(b"abc").digest())
    kind = "Content-Type: application/http; msgtype=response"
    cases = [
        (warc_record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), ("warcinfo", 13, warc.digest32(hashlib.sha1(b"software: x\r\n").digest()), None)),
        (warc_record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request"), ("request", 0, warc.digest32(hashlib.sha1(b"").digest()), None)),
        (warc_record("response", http, kind), ("response", 3, sha, None)),
        (warc_record("response", http, kind, f"WARC-Payload-Digest: sha1:{sha.lower()}"), ("response", 3, sha, True)),
        (warc_record("response", http, kind, "WARC-Payload-Digest: sha1:" + "A" * 32), ("response", 3, "A" * 32, False)),
        (warc_record("response", http, kind, "WARC-Payload-Digest: sha256:00"), ("response", 3, sha, None)),
        (warc_record("revisit", b"", kind, f"WARC-Payload-Digest: sha1:{sha}"), ("revisit", None, sha, True)),
        (warc_record("revisit", b""), ("revisit", None, None, None)),
        (warc_record("metadata", b""), ("metadata", 0, warc.digest32(hashlib.sha1(b"").digest()), None)),
        (warc_record("response", b"HTTP/1.1 200 OK\r\nno end", kind), ("response", 0, warc.digest32(hashlib.sha1(b"").digest()), None)),
    ]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(warc.member(r) for r, _ in cases))
    got = warc.read(spark.createDataFrame([(str(path),)], "path string")).collect()
    assert [(r["record_type"], r["payload_bytes"], r["payload_digest"], r["digest_ok"]) for r in got] == [want for _, want in cases]
    assert all(r["page_id"] is None and r["refers_to"] is None and r["url"] is None for r in got)
    good = warc.member(cases[0][0])
    for broken in (good[:-9], warc.member(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n"), warc.member(b"WARC/1.0\r\nContent-Length: -1\r\n\r\n")):
        with pytest.raises(ValueError, match=f"record 2 at byte {2 * len(good)}"):
            list(warc.records(io.BytesIO(good * 2 + broken)))


# ---- 7 urls


def test_url_intervals_and_screen(spark):
    entry = "kind string, pattern string, category string, action string, day date"
    entries = spark.sql("SELECT * FROM VALUES ('domain', 'bad.example', 'x', 'add', date'2024-01-10'), ('domain', 'bad.example', 'x', 'remove', date'2024-02-01'), ('domain', 'bad.example', 'x', 'add', date'2024-03-01'), ('prefix', 'ok.example/a/b', 'y', 'add', date'2024-01-01'), ('domain', 'twice.example', 'x', 'remove', date'2024-01-05'), ('domain', 'twice.example', 'x', 'add', date'2024-01-05'), ('domain', null, 'x', 'add', date'2024-01-05') AS t(kind, pattern, category, action, day)")
    cases = [
        ("http://bad.example/", "2024-01-09", False), ("http://bad.example/", "2024-01-10", True), ("https://A.BAD.example:8080/x?y", "2024-01-31", True), ("http://bad.example", "2024-02-01", False),
        ("http://u:p@bad.example/", "2024-03-05", True), ("http://notbad.example/", "2024-03-05", False), ("http://ok.example/a/b/c", "2024-01-01", True), ("http://ok.example/a/bc", "2024-01-01", False),
        ("http://ok.example/a?b", "2024-01-01", False), ("http://twice.example/", "2024-01-05", True), (None, "2024-01-05", False), ("no url", "2024-01-05", False), ("http://bad.example/", None, False),
    ]
    caps = spark.createDataFrame([(i, u, d) for i, (u, d, _) in enumerate(cases)], "page_id bigint, url string, day string").withColumn("day", F.col("day").cast("date")).withColumn("host", F.lit("clash")).withColumn("kind", F.lit("clash"))
    got = {r["page_id"]: r["blocked"] for r in urls.screen(caps.unionAll(caps), entries).collect()}
    assert got == {i: b for i, (_, _, b) in enumerate(cases)} and urls.screen(caps.unionAll(caps), entries).count() == 2 * len(cases)
    assert urls.screen(caps.where("page_id < 0"), entries).count() == 0
    assert urls.screen(caps, spark.createDataFrame([], entry)).where("blocked").count() == 0


def test_url_lists_of_any_size_give_the_same(spark, sf, monkeypatch):
    sf = sf.replace("0.001", "0.01")
    want = sorted(map(tuple, queries.op7_url_filters(spark, sf).collect()), key=repr)
    assert any(r[3] for r in want)
    for bits in (26, 8):
        monkeypatch.setattr(urls, "SMALL_LIST", -1)
        monkeypatch.setattr(urls, "BITMAP_BITS", bits)
        assert sorted(map(tuple, queries.op7_url_filters(spark, sf).collect()), key=repr) == want


def test_url_candidates_that_no_list_has_are_not_shuffled(spark):
    hot = spark.range(3000).selectExpr("id as page_id", "concat('http://www.host', id % 3, '.com/a/b/', id) as url", "date'2024-01-05' as day")
    entries = spark.sql("SELECT 'domain' AS kind, 'host1.com' AS pattern, 'x' AS category, 'add' AS action, date'2024-01-01' AS day")
    assert urls.screen(hot, entries.withColumn("pattern", F.lit("ost1.com"))).where("blocked").count() == 0
    out = urls.screen(hot, entries)
    assert out.where("blocked").count() == 1000
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


# ---- 8 decontamination


def test_decontamination_finds_all_similar_windows():
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.choice([3, 4, 5, 12, 30, 50]), 10**6)) for i in range(40)] + [(100, None), (101, ""), (102, "one")]
    index = decontaminate.Index(items)
    texts, planted = [None, "", "x"], []
    for i, text in items[:40]:
        w = text.split()
        for edits in (0, 1, 2):
            v = w[:]
            for _ in range(edits):
                v[rng.randrange(len(v))] = f"edit{rng.randrange(10**6)}"
            planted.append((len(texts), i, v, w))
            texts.append(sentence(rng, 80, 10**6) + " \n" + " \t".join(v) + " " + sentence(rng, 60, 10**6))
    texts.append("one two")
    found = {(x[0], x[1]): x for x in index.search(pa.array(texts, pa.string()))}
    for row, item, v, w in planted:
        n = min(5, len(w))
        a, b = (Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1)) for x in (v, w))
        similar = sum((a & b).values()) / sum((a | b).values()) >= 0.8
        assert ((row, item) in found) == similar
        if v == w:
            assert found[row, item][2:] == (80, len(w), 0, 1.0)
    assert set(found) - {(r, i) for r, i, _, _ in planted} == {(len(texts) - 1, 102)}


def test_decontamination_by_weighted_similarity(monkeypatch):
    """Items with shared and own words: windows of unlike weights, against every window of every text."""
    rng = random.Random(12)
    frames = [sentence(rng, 30, 10**6).split() for _ in range(2)]
    items = [(i, " ".join(frames[i % 2] + sentence(rng, 20, 10**6).split())) for i in range(24)] + [(24, sentence(rng, 50, 10**6))]
    lists = [t.split() for _, t in items]
    index, texts = decontaminate.Index(items), []
    for w in lists:
        for edits in range(5):
            v = w[:]
            for _ in range(edits):
                v[rng.randrange(50)] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(sentence(rng, 9, 10**6).split() + v + sentence(rng, 9, 10**6).split()))
    found = {(x[0], x[1]): x for x in index.search(pa.array(texts, pa.string()))}
    want = {}
    for row, text in enumerate(texts):
        w = text.split()
        for item, b in enumerate(lists):
            best = max((weighted_similarity(w[a : a + 50], b, lists), -a) for a in range(len(w) - 49)) if set(w) & set(b) else (0.0, 0)
            if best[0] >= 0.8:
                want[row, item] = best
    assert len(want) > 40 and any(s < 0.9 for s, _ in want.values())
    # all that the fingerprints' radius reaches, with the exact similarity and place
    assert found.keys() <= want.keys() and len(found) >= 0.97 * len(want)
    for k, x in found.items():
        assert (x[5], -x[2]) == (pytest.approx(want[k][0], rel=1e-12), want[k][1])
    monkeypatch.setattr(decontaminate, "AT_ONCE", 7)
    assert {(x[0], x[1]): x for x in decontaminate.Index(items).search(pa.array(texts, pa.string()))} == found


def test_decontamination_of_a_very_long_item():
    rng = random.Random(13)
    w = sentence(rng, 30_000, 10**7).split()
    v = w[:]
    v[100] = v[20_000] = "changed"
    texts = [" ".join(["before"] * 5 + v + ["behind"]), " ".join(w[:29_000]), " ".join(w[:9000])]
    found = {x[0]: x[2:] for x in decontaminate.Index([(1, " ".join(w))]).search(pa.array(texts))}
    assert found.keys() == {0, 1} and found[0][:2] == (5, 30_000) and found[1][:2] == (0, 29_000)


def test_suspects_hold_all_that_can_match(spark, sf):
    docs, bench = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    blocks = decontaminate.item_blocks(bench)
    rows = docs.collect()
    flags = decontaminate.suspects(pa.array([r["text"] for r in rows], pa.string()), decontaminate.shingle_bitmap(blocks))
    matched = {r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()}
    assert matched <= {r["doc_id"] for r, f in zip(rows, flags) if f}
    grams = {n: {tuple(w[k : k + n]) for b in bench.collect() if len(w := words(b["text"])) and min(5, len(w)) == n for k in range(len(w) - n + 1)} for n in range(1, 6)}
    for r, flag in zip(rows, flags):
        w = words(r["text"])
        assert flag == any(tuple(w[k : k + n]) in g for n, g in grams.items() for k in range(len(w) - n + 1))
    assert not decontaminate.suspects(pa.array([None, "", "a b"], pa.string()), decontaminate.shingle_bitmap(blocks)).any()


def test_decontamination_finds_cut_items_that_stand_alone():
    rng = random.Random(6)
    items = [(i, sentence(rng, rng.choice([12, 30, 50, 300]), 10**6)) for i in range(40)]
    cuts = [(a, b) for a in range(4) for b in range(4)] + [(10, 10)]
    cases = [(i, w[a : len(w) - b]) for i, t in items for a, b in cuts if len((w := t.split())[a : len(w) - b]) > 0]
    texts = [" ".join(v) for _, v in cases] + ["nothing of any item stands here", None, ""]
    found = {(x[0], x[1]): x for x in decontaminate.Index(items).search(pa.array(texts, pa.string()))}
    # all shingles of the items stand in one item each, so they weigh the same
    want = {(row, i): (len(v) - 4) / (len(items[i][1].split()) - 4) for row, (i, v) in enumerate(cases)}
    want = {k: s for k, s in want.items() if s >= 0.8}
    assert found.keys() == want.keys() and len(want) > 200
    for (row, i), s in want.items():
        assert found[row, i][2:4] == (0, len(cases[row][1])) and found[row, i][5] == pytest.approx(s)


def test_decontamination_frames(spark, sf):
    docs, bench = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t in r["text"]}
    got = decontaminate.leaks(docs, bench)
    assert want and want <= {(r["doc_id"], r["item_id"]) for r in got.collect()}
    bad = {r["doc_id"] for r in got.collect()}
    clean = decontaminate.clean(docs, bench)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    odd = awkward(spark)
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.clean(odd, bench).count() == odd.count()
    own = spark.createDataFrame([(7, "a null id with enough words to be a document of its own here"), (None, "x"), (8, None)], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, own).collect()] == [(None, 7)]
    assert decontaminate.leaks(odd, own.where("item_id < 0")).count() == 0 == decontaminate.leaks(empty(spark), own).count()


def test_decontamination_in_blocks(spark, sf, monkeypatch):
    docs, bench = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert len(decontaminate.item_blocks(bench)) > 3
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == want


def test_decontamination_weights_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(8)
    frames = [sentence(rng, 40, 10**6).split() for _ in range(3)]
    items = [(i, " ".join(frames[i // 10 % 3] + sentence(rng, 24, 10**6).split())) for i in range(60)] + [(60, ""), (61, None)]
    docs = []
    for i, text in items[:60]:
        for edits in range(6):
            w = text.split()
            for _ in range(edits):
                w[40 + rng.randrange(24)] = f"edit{rng.randrange(10**6)}"
            # a part of a frame that this block may not know
            docs.append((len(docs), " ".join(frames[rng.randrange(3)][:20] + w + frames[rng.randrange(3)])))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    assert 60 < len(want) and any(x[5] < 0.9 for x in want)
    for n in (7, 25):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", n)
        assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == want
        assert {r[0] for r in decontaminate.clean(docs, bench).collect()} == {r[0] for r in docs.collect()} - {x[0] for x in want}


def test_decontamination_keeps_items_with_a_null_id(spark, monkeypatch):
    rng = random.Random(9)
    items = [(None, sentence(rng, 30, 10**6)), (4, sentence(rng, 30, 10**6)), (None, sentence(rng, 12, 10**6)), (None, None)]
    docs = spark.createDataFrame([(i, f"before it {t} behind it") for i, (_, t) in enumerate(items)], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for n in (2000, 2):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", n)
        assert {(r["doc_id"], r["item_id"], r["n_words"]) for r in decontaminate.leaks(docs, bench).collect()} == {(0, None, 30), (1, 4, 30), (2, None, 12)}
        assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [3]


# ---- 9 n-gram join


def near_rows(seed, groups=25):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = sentence(rng, rng.randrange(5, 120), 10**6).split()
        for _ in range(rng.choice([1, 2, 3, 9])):
            v = base[:]
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(v))
    passage = sentence(rng, 60, 10**6)
    rows += [passage + " " + sentence(rng, 70, 10**6) for _ in range(40)]
    return [(i * 3, t) for i, t in enumerate(rows)] + [(900_000 + i, t) for i, t in enumerate(rows[:10])]


def check_join(spark, rows, extra=None):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df = extra(df) if extra else df
    out = jaccard.join(df).collect()
    near = links([t for _, t in rows])
    label = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        label[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    assert Counter(map(tuple, out)) == Counter((rows[i][0], label[i], len(near[i])) for i in range(len(rows)))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_all_pairs(spark, seed):
    check_join(spark, near_rows(seed))


def test_join_splits_large_buckets_into_tiles(spark, monkeypatch):
    """Many near copies of one text, and many texts with one passage: buckets are split, then tiled."""
    rng = random.Random(4)
    base = sentence(rng, 80, 10**6).split()
    rows = []
    for i in range(130):
        v = base[:]
        v[rng.randrange(80)] = f"e{i}"
        rows.append((i, " ".join(v)))
    passage = sentence(rng, 60, 10**6)
    rows += [(1000 + i, passage + " " + sentence(rng, 50, 10**6)) for i in range(80)]
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "SMALL", 12)
    check_join(spark, rows)


def test_join_of_a_hot_text_and_a_hot_cluster(spark):
    rng = random.Random(14)
    base = sentence(rng, 90, 10**6).split()
    rows = [(i, "one text that very many documents are copies of " * 2) for i in range(400)]
    for i in range(300):
        v = base[:]
        v[rng.randrange(90)] = f"e{i}"
        rows.append((1000 + i, " ".join(v)))
    check_join(spark, rows)


def test_join_takes_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    check_join(spark, rows, lambda df: df.withColumn("digest", F.lit(1)).withColumn("rid", F.lit(2)).withColumn("tokens", F.lit(3)))
    assert jaccard.join(empty(spark)).count() == 0 == jaccard.keep_one(empty(spark)).count()


def test_join_keeps_one_of_each_group(spark):
    df = awkward(spark)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    base = awkward_rows()[0][1]
    assert got[1, base] == 1 and (2, base) not in got and not any(k[0] == 3 for k in got)
    assert got[4, None] == 1 and got[5, ""] == 1 and got[None, None] == 1
    assert sum(got.values()) == len(awkward_rows()) - 4  # two copies, one near copy, one of "one two"


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 102), (102, 101)]
    df = spark.createDataFrame([(f"{a:04d}", f"{b:04d}") for a, b in edges], "a string, b string")
    got = {r["node"]: r["label"] for r in jaccard.components(df).collect()}
    assert got == {f"{i:04d}": "0000" for i in range(61)} | {f"{i:04d}": "0100" for i in (100, 101, 102)}


# ---- 10 chat


def test_chat_round_trip(spark):
    said = ["plain", "\\### Assistant: </turn> ok", "### user: x</turn>\n### assistant: y", "ends in \\", "<|image:0|>", "\\\\<", "", None, "é𝒳\n\n", "</turn", "</turn></turn>"]
    rows = [(c, i, ["user", "assistant", "system", None, "a: b\n### c"][(c + i) % 5], said[(c * 7 + i) % len(said)]) for c in range(12) for i in range(c)]
    rows += [(None, 0, "user", "x"), (5, 2, "assistant", "tie"), (5, 2, "assistant", "tie"), (6, None, "user", "first"), (77, 0, "assistant", "long " * 100_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1)).withColumn("chunk", F.lit(1))
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append(((t is not None, t or 0), r is not None, r or "", x or ""))
    assert set(out) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        got = out[c]
        assert got["n_turns"] == len(turns) and got["loss_chars"] == len(loss) and got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert got["formatted_chars"] == sum(len(chat.OPEN + chat.escape(r, chat._ROLE_CONTROL) + ": " + chat.escape(x) + chat.CLOSE + "\n") for _, _, r, x in turns)
    assert chat.read_back(chat.format_turns(df.where("turn > 1000"))).count() == 0


def test_chat_chunks_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_CHARS", 50)
    rows = [(c, i, "assistant" if i % 2 else "user", f"turn {i} of {c}") for c in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    formatted = chat.format_turns(df)
    chunks = defaultdict(list)
    for r in formatted.orderBy("conv_id", "chunk").collect():
        chunks[r["conv_id"]].append(r)
    for c in range(3):
        assert len(chunks[c]) > 5 and [r["chunk"] for r in chunks[c]] == list(range(len(chunks[c])))
        assert [chat.unescape(t[1]) for r in chunks[c] for t in chat.parse(r["formatted"])] == [f"turn {i} of {c}" for i in range(40)]
        assert sum(r["n_turns"] for r in chunks[c]) == 40
    for r in chat.read_back(formatted).collect():
        said = "".join(f"turn {i} of {r['conv_id']}" for i in range(1, 40, 2))
        assert r["n_turns"] == 40 and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_chat_parts_of_any_kind(spark):
    part = "struct<type: string, text: string, ref: string>"
    parts = [None, ("video", None, "s3://v"), (None, "lost", None), ("text", "said", None), ("visit", "x", "y"), ("image", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [None]), (2, 0, "assistant", [])], f"conv_id bigint, turn bigint, role string, parts array<{part}>")
    rows = {r["conv_id"]: r for r in chat.format_turns(df).collect()}
    assert rows[1]["formatted"] == "### user: <|other:0|><|other:1|>said<|other:2|><|image:3|></turn>\n### assistant: </turn>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in rows[1]["attachments"]] == [("other", "s3://v", 0), ("other", None, 0), ("other", "y", 0), ("image", None, 0)]
    back = {r["conv_id"]: (r["n_turns"], r["n_attachments"], r["expanded_tokens"]) for r in chat.read_back(chat.format_turns(df)).collect()}
    assert back == {1: (2, 4, 0), 2: (1, 0, 0)}


def test_chat_parts(spark):
    part = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
    parts = [("text", "see <|image:9|> ", None, None, None, None, None), ("image", None, "s3://i", 56, 29, None, None), ("audio", None, "s3://a", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 3), ("text", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "assistant", [("image", None, "j", 10, 10, None, None)])], f"conv_id bigint, turn bigint, role string, parts array<{part}>")
    r = chat.format_turns(df).first()
    assert r["formatted"] == "### user: see \\<|image:9|> <|image:0|><|audio:1|><|document:2|></turn>\n### assistant: </turn>\n### assistant: <|image:0|></turn>\n"
    kinds = [(a["kind"], a["ref"], a["turn"], a["tokens"]) for a in r["attachments"]]
    assert kinds == [("image", "s3://i", 0, 4), ("audio", "s3://a", 0, 38), ("document", "d.pdf", 0, 1536), ("image", "j", 2, 1)]
    assert all(r["formatted"][a["offset"] :].startswith(f"<|{a['kind']}:") for a in r["attachments"]) and r["expanded_tokens"] == 1579


# ---- queries with SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, sf).toArrow(), c.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    names = sorted(a.column_names)
    assert names == sorted(b.column_names)
    assert sorted(zip(*[a[x].to_pylist() for x in names]), key=repr) == sorted(zip(*[b[x].to_pylist() for x in names]), key=repr)
