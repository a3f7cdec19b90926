import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from seedweave.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    big_n, big_l = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = {}
    for item, own in asked.items():
        found = []
        for (doc, c), n in zip(counts, lengths):
            if not n:
                continue
            m = 10 + (90 * n * big_n) // big_l
            w = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) for t in own if t in c}
            score = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in w)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out[item] = [(-s, None if none else d) for s, none, d in sorted(found)[:k]]
    return {i: v for i, v in out.items() if v}


def corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdéß漢7") for _ in range(rnd.randint(1, 4))) for _ in range(120)]
    prose = lambda n: " ".join(rnd.choice(words[: rnd.choice([5, 30, 120])]) + rnd.choice(["", ".", "-x", "_Y"]) for _ in range(n))
    docs = [(i, prose(rnd.randint(1, 60))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "... !"), (303, docs[5][1]), (304, docs[5][1]), (7, prose(20)), (None, docs[5][1]), (None, prose(3000))]
    items = [(i, prose(rnd.randint(1, 40))) for i in range(25)] + [(25, docs[5][1]), (26, None), (27, ";"), (3, prose(9)), (None, prose(5)), (28, "unheard of")]
    return docs, items


def tables(spark, docs, items):
    shown = spark.createDataFrame([(i, t, 5, "s") for i, t in docs], "doc_id BIGINT, text STRING, score INT, item_id STRING")
    return shown, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id BIGINT, text STRING, rank INT")


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        assert r["rank"] == len(out.setdefault(r["item_id"], [])) + 1
        out[r["item_id"]].append((r["score"], r["doc_id"]))
    return out


@pytest.mark.parametrize(("k", "query_bytes", "block"), [(10, lexical.QUERY_BYTES, lexical.BLOCK_DOCS), (3, 900, 16)])
def test_equals_brute_force(spark, shared_folder, monkeypatch, k, query_bytes, block):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    docs, items = corpus(1)
    left, right = tables(spark, docs, items)
    assert found(lexical.ranking(left.repartition(5), right, k, query_bytes).collect()) == brute(docs, items, k)


def test_accumulators_stop_and_survivors_stay_exact():
    rnd = np.random.default_rng(3)
    docs, n_terms = 2000, 40
    n = rnd.integers(20, 80, docs)
    share = np.linspace(0.01, 0.6, n_terms)
    held = rnd.random((docs, n_terms)) < share
    held[:6] = True
    row, term = np.nonzero(held)
    tf = rnd.integers(1, 4, len(row))
    block = lexical._Block(n, row, term, tf, n_terms, docs, int(n.sum()))
    weights = lexical.term_weight(docs, held.sum(axis=0))
    full = np.zeros(docs, np.int64)
    m = 10 + 90 * n * docs // int(n.sum())
    for d, t, f in zip(row, term, tf):
        full[d] += weights[t] * (10**9 * int(f) // (1000 * int(f) + 8 * m[d]))
    got, score = block.best(np.arange(n_terms), weights, 5, 0)
    lead = lexical._leading(got, score, 5)
    best = np.lexsort((np.arange(docs), -full))[:5]
    assert list(got[lead]) == list(best) and list(score[lead]) == list(full[best])
    # Most documents hold a term, few were followed to the end.
    assert len(got) < docs // 3 and (full > 0).all() and (full[got] == score).all()


def test_empty_tables(spark, shared_folder):
    docs, items = tables(spark, [(1, "a b")], [(1, "a")])
    assert lexical.ranking(docs.limit(0), items).count() == 0
    none = lexical.ranking(docs, items.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_very_long_text(spark, shared_folder):
    long = "common " * 300_000 + "needle " + "y" * 2_000_000 + " common"
    docs, items = tables(spark, [(1, long), (2, "common needle"), (3, "common")], [(9, "needle COMMON")])
    assert found(lexical.ranking(docs, items).collect()) == brute([(1, long), (2, "common needle"), (3, "common")], [(9, "needle COMMON")])
