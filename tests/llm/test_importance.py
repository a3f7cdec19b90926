import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seedweave.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [Counter(map(bucket, features(t, longest))) for _, t in docs]
    s, t = sum(own, Counter()), Counter(bucket(f) for x in target for f in features(x, longest))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for (doc, text), counts in zip(docs, own):
        weight = sum(gain(b) * n for b, n in counts.items())
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, sum(counts.values()), weight, score, None, len(words(text))])
    may = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(may[: 10 * len(may) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdéß漢7") for _ in range(rnd.randint(1, 5))) for _ in range(500)]
    prose = lambda n: " ".join(rnd.choice(vocabulary[: rnd.choice([4, 60, 500])]) + rnd.choice(["", ".", "-", "_Q"]) for _ in range(n))
    docs = [(i, prose(rnd.randint(0, 70))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, ",;."), (403, prose(1) * 500), (5, docs[5][1]), (6, prose(30)), (None, docs[9][1])]
    return docs, [prose(40) for _ in range(8)] + [None, "", docs[3][1]]


def tables(spark, docs, target):
    shown = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id BIGINT, text STRING, weight STRING, rank INT")
    return shown, spark.createDataFrame([(t,) for t in target], "text STRING")


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("longest", [1, 2])
def test_equals_brute_force(spark, shared_folder, longest):
    docs, target = corpus(5)
    left, right = tables(spark, docs, target)
    assert found(importance.resampling(left.repartition(4), right, longest=longest)) == brute(docs, target, longest)


def test_planes_give_the_plain_sum():
    rnd = np.random.default_rng(2)
    gain = rnd.integers(-9000, 9000, 1000)
    row = np.sort(rnd.integers(0, 3000, 60_000))
    bucket = np.minimum(rnd.zipf(1.3, len(row)), 1000) - 1
    plain = np.bincount(row, weights=gain[bucket], minlength=3000).astype(np.int64)
    assert (importance.GainPlanes(gain).weights(row, bucket, 3000) == plain).all()


def test_equal_scores_go_by_doc_id(spark, shared_folder):
    rows = [(i % 50, i, 30, 30, 7, 7) for i in range(1000)]
    scores = spark.createDataFrame(rows, "doc_id BIGINT, text_key BIGINT, n_features BIGINT, n_words BIGINT, weight BIGINT, score BIGINT")
    drawn = importance.ranked(scores.repartition(7)).where("rank IS NOT NULL").collect()
    assert [(r["doc_id"], r["text_key"]) for r in sorted(drawn, key=lambda r: r["rank"])] == sorted((r[0], r[1]) for r in rows)[:100]
    assert sorted(r["rank"] for r in drawn) == list(range(1, 101))


def test_resampled_rows_are_whole(spark, shared_folder):
    docs, target = corpus(6)
    left, right = tables(spark, docs, target)
    drawn = {r[0] for r in brute(docs, target) if r[4]}
    kept = importance.resampled(left, right)
    assert kept.columns == left.columns and {r["doc_id"] for r in kept.collect()} == drawn


def test_empty_tables(spark, shared_folder):
    docs, target = corpus(7)
    left, right = tables(spark, docs[:60], target)
    assert importance.resampling(left.limit(0), right).count() == 0
    assert found(importance.resampling(left, right.limit(0))) == brute(docs[:60], [])


def test_very_long_text_is_cut_between_words():
    text = "Word other " * 200_000 + "x" * 1_500_000 + " word"
    texts = pa.array(["a b", text, None, "c"])
    counts = Counter()
    for _, row, bucket in importance.feature_buckets(texts, 1, 10_000):
        counts.update(zip(row.tolist(), bucket.tolist()))
    key = lambda i, w: (i, zlib.crc32(w.encode()) % 10_000)
    assert counts == Counter({key(0, "a"): 1, key(0, "b"): 1, key(3, "c"): 1, key(1, "word"): 200_001, key(1, "other"): 200_000, key(1, "x" * 1_500_000): 1})
