import hashlib
import random
import re

import pytest

from seedweave.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, span=10):
    asked = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            asked.setdefault(tuple(w[i : i + n]), set()).add(str(item) if item is not None else "")
    sizes = {len(s) for s in asked}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := asked.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdéß漢7") for _ in range(rnd.randint(1, 4))) for _ in range(150)]
    prose = lambda n, of=150: [rnd.choice(vocabulary[:of]) for _ in range(n)]
    say = lambda w: "".join(x + rnd.choice([" ", "\n", ", ", "-"]) for x in w)
    items = [prose(rnd.randint(10, 60)) for _ in range(20)] + [prose(n) for n in range(1, 10)] + [prose(30, 2) for _ in range(4)]
    items.append(items[3][5:30] + prose(12))
    docs = []
    for _ in range(120):
        parts = prose(rnd.randint(0, 40))
        for _ in range(rnd.randint(0, 3)):
            own = rnd.choice(items)
            a = rnd.randint(0, max(0, len(own) - 10))
            passage = own[a : a + rnd.randint(5, 40)]
            if rnd.random() < 0.3 and passage:
                passage[rnd.randrange(len(passage))] = "changed"
            parts += passage + prose(rnd.randint(0, 15))
        docs.append(say(parts))
    docs += [say(prose(60, 2)), "a " * 40, None, "", " .,;", docs[0], docs[0].upper() if docs[0].isascii() else docs[1]]
    rows = list(enumerate(docs)) + [(3, docs[3]), (3, docs[4]), (None, docs[2]), (None, docs[2])]
    asked = [(i, say(w)) for i, w in enumerate(items)] + [(90, None), (91, "?"), (None, say(items[0])), (2, say(items[4])), (5, say(items[5]))]
    return rows, asked + [(92, "a " * 25)]


def tables(spark, docs, items):
    shown = spark.createDataFrame([(i, t, 5, "s", "v") for i, t in docs], "doc_id BIGINT, text STRING, n_words INT, words STRING, v STRING")
    return shown, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id BIGINT, text STRING, n INT")


def found(df):
    rows = df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("piece", [decontamination.PIECE, 23])
def test_equals_brute_force(spark, shared_folder, piece):
    docs, items = corpus(2)
    left, right = tables(spark, docs, items)
    assert found(decontamination.contaminated(left.repartition(5), right, piece=piece)) == sorted(brute(docs, items), key=str)


def test_items_in_several_slices(spark, shared_folder, monkeypatch):
    docs, items = corpus(4)
    long = [x for x in items if len(words(x[1])) >= 10]
    left, right = tables(spark, docs, long)
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 40_000)
    assert found(decontamination.contaminated(left.repartition(3), right)) == sorted(brute(docs, long), key=str)


def test_every_shared_span_has_a_common_fingerprint(spark, shared_folder):
    # The same ten words between different neighbours.
    rnd = random.Random(8)
    prose = lambda n: [rnd.choice("abcdefg") + rnd.choice("xyz") for _ in range(n)]
    spans = [prose(10) for _ in range(150)]
    docs = [(i, " ".join(prose(20) + s + prose(20))) for i, s in enumerate(spans)]
    items = [(i, " ".join(prose(15) + s + prose(15))) for i, s in enumerate(spans)]
    left, right = tables(spark, docs, items)
    assert found(decontamination.contaminated(left, right)) == sorted(brute(docs, items), key=str)


def test_empty_tables(spark, shared_folder):
    docs, items = tables(spark, [(1, "a b"), (2, None)], [(1, "a b")])
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert found(decontamination.contaminated(docs, items.limit(0))) == sorted(brute([(1, "a b"), (2, None)], []), key=str)


def test_very_long_text(spark, shared_folder):
    passage = " ".join(f"p{i}" for i in range(12))
    long = "word " * 100_000 + passage + " word" * 70_000 + " " + passage
    left, right = tables(spark, [(1, long)], [(7, "x " + passage)])
    assert found(decontamination.contaminated(left, right)) == brute([(1, long)], [(7, "x " + passage)])


def test_no_python_in_the_plan(spark, shared_folder):
    left, right = tables(spark, [(1, "a b")], [(1, "a b")])
    plan = decontamination.contaminated(left, right)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
