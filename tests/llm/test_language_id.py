import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seedweave.llm import language_id as li

SOUNDS = {"aa": ["tha", "ing", "er", "ou"], "bb": ["sch", "ung", "ei", "ä"], "cc": ["ción", "ñe", "os", "la"]}


def prose(rnd, lang, n=40):
    return " ".join("".join(rnd.choice(SOUNDS[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def corpus(n=600, seed=1):
    rnd = random.Random(seed)
    langs = [rnd.choice(sorted(SOUNDS)) for _ in range(n)]
    return [(i, prose(rnd, lang), lang) for i, lang in enumerate(langs)]


def test_held_out_accuracy(documents):
    rows = corpus()
    docs = documents(rows)
    filters = li.fit(docs.where(~li.in_holdout(F.col("doc_id"))))
    got = li.predict(docs.drop("lang", "source"), filters).withColumn("held_out", li.in_holdout(F.col("doc_id"))).collect()
    truth = {i: lang for i, _, lang in rows}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(r["lang_pred"] == truth[r["doc_id"]] and 0 < r["score"] <= 1 for r in got)


def test_texts_without_letters_unknown_texts_and_nulls(spark, documents):
    docs = documents(corpus(100) + [(900, None, "aa"), (901, "text", None)])
    filters = li.fit(docs)
    odd = documents([(1, None), (2, ""), (3, "12 34 !?_"), (4, "qqqqq wwww"), (4, "qqqqq wwww"), (None, "thaing erou thaer")])
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["score"] > 0) for r in li.predict(odd, filters).collect())
    assert got == [("1", "und", False), ("2", "und", False), ("3", "und", False), ("4", filters.usual, False), ("4", filters.usual, False), ("None", "aa", True)]
    assert li.predict(documents([]), filters).count() == 0
    nothing = li.fit(documents([]))
    assert [r["lang_pred"] for r in li.predict(documents([(1, "word")]), nothing).collect()] == ["und"]


def test_more_languages_than_a_mask_has_bits(documents):
    rnd = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = ["".join(rnd.choice(letters) for _ in range(7)) for _ in range(70)]
    rows = [(i, " ".join([stems[i % 70]] * 9), f"l{i % 70:02}") for i in range(140)]
    filters = li.fit(documents(rows))
    assert len(filters.masks) == 2
    got = li.predict(documents(rows), filters).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id'] % 70:02}" for r in got) >= 138


def test_grams_stay_inside_documents():
    texts = pa.array(["abcd", "", "xy", "Éa1b", None, "wxyz!"])
    data, offsets = li.text_buffer(texts)
    codes, bounds = li._grams(data, offsets)
    shown = [[int(c).to_bytes(4, "big") for c in codes[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
    assert shown == [[b"abcd"], [], [], [b"\xc3\x89a ", b"\x89a b"], [], [b"wxyz", b"xyz "]]
    assert np.all(np.diff(bounds) >= 0)
