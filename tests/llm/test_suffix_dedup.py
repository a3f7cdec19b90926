import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from seedweave.llm import suffix_dedup
from seedweave.llm.suffix_sort import SuffixSorter

SPAN = suffix_dedup.SPAN


def brute(texts):
    """(n_bytes, n_removed, n_spans, sha) per text, window by window."""
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + SPAN] for d in datas for i in range(len(d) - SPAN + 1))
    out = []
    for d in datas:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - SPAN + 1):
            if seen[d[i : i + SPAN]] > 1:
                gone[i : i + SPAN] = True
        starts = int(((~np.concatenate([[False], gone[:-1]])) & gone).sum())
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéß漢") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(70), prose(55)
    texts = [None, "", "short", prose(10), "x" * 199, "y" * 200, "z" * 201, "z" * 450, passage]
    texts += [prose(20) + passage + prose(30) for _ in range(12)]
    texts += [passage[: rnd.randint(100, 300)] + other[rnd.randint(0, 60) :] + prose(9) for _ in range(10)]
    base = prose(160)
    for _ in range(9):
        cut = rnd.randint(0, 500)
        texts.append(base[:cut] + word() + base[cut + rnd.randint(0, 5) :])
    texts += [base, base, prose(3000), prose(40) * 4]
    return texts


@pytest.mark.parametrize("most", [suffix_dedup.MOST_SNIPPETS, 2])
def test_equals_brute_force(documents, most):
    # With 2 nearly every anchor is split, and many parts down to single windows.
    texts = corpus()
    docs = documents(list(enumerate(texts))).repartition(5)
    got = suffix_dedup.deduplicated(docs, text=False, most_snippets=most)
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)


def test_rows_with_equal_or_no_id(spark, documents):
    long, other = "abcdefghij " * 40, "".join(chr(97 + (i * i + i // 7) % 26) for i in range(400))
    docs = documents([(1, long), (1, long), (2, other), (2, "unique"), (None, other), (None, None)])
    kept = suffix_dedup.deduplicated(docs.withColumnsRenamed({"n_chars": "n_bytes"}))
    rows = sorted((str(r["doc_id"]), r["text"] or "", r["n_bytes"], r["n_removed"]) for r in kept.collect())
    assert rows == [("1", "", 440, 440), ("1", "", 440, 440), ("2", "", 400, 400), ("2", "unique", 6, 0), ("None", "", 0, 0), ("None", "", 400, 400)]


def test_empty_table(documents):
    docs = documents([])
    out = suffix_dedup.deduplicated(docs)
    assert out.count() == 0 and out.columns[:5] == docs.columns


def test_long_text_is_cut_with_overlap(monkeypatch):
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefg ") for _ in range(3000))
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, 3000])
    _, at, n, a, _ = suffix_dedup.snippets(data, offsets)
    assert int(n.sum()) == 3000 - SPAN + 1 and list(at[1:]) == list((at + n)[:-1])
    assert ((a >= n - 1) & (a <= SPAN - suffix_dedup.GRAM)).all()


def test_suffixes_come_out_in_byte_order():
    rnd = random.Random(7)
    data = bytes(rnd.choice(b"ab") for _ in range(3000)) + b"ab" * 300
    starts = np.arange(len(data) - 40 + 1)
    order = SuffixSorter(np.frombuffer(data, np.uint8), 40).sort(starts)
    assert [data[i : i + 40] for i in order] == sorted(data[i : i + 40] for i in starts)


def test_equal_hashes_are_not_believed(monkeypatch):
    sorter = SuffixSorter(np.frombuffer(b"a" * 40 + b"b" * 40, np.uint8), 40)
    monkeypatch.setattr(sorter, "_same", lambda a, b, n: np.ones(len(a), bool))
    assert not sorter.repeated(np.array([0, 40])).any()


def test_parts_grow_with_the_snippets_of_a_hot_anchor(documents):
    rnd = random.Random(5)
    prose = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, made = prose(300), []
    for copies in (20, 60):
        texts = [prose(250) + passage + prose(250) for _ in range(copies)]
        docs = documents(list(enumerate(texts))).repartition(3)
        rows = suffix_dedup.repeated_anchors(suffix_dedup._keyed(docs)).collect()
        cut = docs.sparkSession.createDataFrame(
            [(1, r["id"], r["key"], r["at"], r["n"], r["a"], texts[r["id"]].encode()[r["at"] : r["at"] + r["n"] + SPAN - 1]) for r in rows],
            "m INT, id BIGINT, key BIGINT, at BIGINT, n INT, a INT, snippet BINARY",
        )
        parts = suffix_dedup._parts(cut).collect()
        assert sum(p["n"] for p in parts) == sum(r["n"] for r in rows)
        assert all(p["snippet"] == texts[p["id"]].encode()[p["at"] : p["at"] + p["n"] + SPAN - 1] for p in parts)
        assert len(parts) <= len(rows) * 14
        made.append(len(parts))
        got = suffix_dedup.deduplicated(docs, text=False, most_snippets=4)
        rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()}
        assert [rows[i] for i in range(len(texts))] == brute(texts)
    assert made[1] <= 3.2 * made[0]
