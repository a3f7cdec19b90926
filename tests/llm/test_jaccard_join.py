import random
import re
from itertools import combinations

import pytest

from seedweave.llm import jaccard_join
from seedweave.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(texts):
    """{doc_id: (size, component)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 5))) for _ in range(400)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage, texts = prose(60), []
    for size in (6, 12, 30, 80, 200, 500):
        for _ in range(6):
            base = prose(size)
            for _ in range(rnd.randint(1, 9)):
                copy = list(base)
                for _ in range(rnd.randint(0, max(1, size // 40))):
                    copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
                texts.append(" ".join(copy + prose(rnd.randint(0, size // 12))))
    texts += [" ".join(prose(rnd.randint(5, 15)) + passage + prose(rnd.randint(0, 9))) for _ in range(40)]
    texts += [None, "", " \t\n", "One two", "one TWO", "one two three", "a b c d e", "A b\tc d\x0be", texts[0].upper(), texts[40]]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "block"), [(1, jaccard_join.BLOCK_DOCS), (2, 3)])
def test_equals_brute_force(documents, monkeypatch, seed, block):
    # With 3 most groups are cut into many blocks.
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", block)
    texts = corpus(seed)
    got = jaccard_join.jaccard_components(documents(texts).repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(texts)
    assert len(got) == len(texts)


def test_rows_without_id_repeated_rows_and_extra_columns(spark, documents):
    text = "the quick brown fox jumps over it"
    docs = documents([(3, text), (3, text), (None, text), (1, "other words stand in this text"), (7, text), (2, None)])
    docs = docs.withColumnRenamed("lang", "component_id")
    got = sorted((str(r[0]), r[1], str(r[2])) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == [("1", 2, "1"), ("2", 0, "2"), ("3", 3, "3"), ("3", 3, "3"), ("7", 3, "3"), ("None", 3, "None")]
    kept = jaccard_join.keep_one(docs)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "None"]
    assert kept.columns == docs.columns


@pytest.mark.parametrize("empty", [None, " \n"])
def test_repeated_ids_with_an_empty_text_in_unsettled_groups(documents, empty):
    texts = corpus(1)
    docs = documents(texts + [(i, empty) for i, text in texts if shingles(text)]).repartition(4)
    got = jaccard_join.jaccard_components(docs).where("n_shingles > 0").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: x for i, x in brute(texts).items() if x[0]}


def test_the_row_of_a_repeated_id_that_stays_is_always_the_same(documents):
    rows = [(i, text) for i in range(40) for text in (None, "", f"one text of {i}", f"another text of {i}")]
    kept = {order: sorted((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(documents(rows[::order]).repartition(3)).collect()) for order in (1, -1)}
    assert kept[1] == kept[-1]
    assert [i for i, _ in kept[1]] == list(range(40)) and all(text for _, text in kept[1])


def test_empty_table(documents):
    assert jaccard_join.jaccard_components(documents([])).count() == 0


def test_components_of_chains_stars_and_loops(spark, shared_folder):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(500, 500), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_prefixes_of_linked_sets_share_enough():
    for n in range(1, 2000):
        must, least = jaccard_join.must_share(n), max(1, jaccard_join.must_share(n) // jaccard_join.EXTRA)
        assert 100 * must >= 80 * n > 100 * (must - 1)
        assert jaccard_join.prefix_length(n) - (n - must) >= least
        assert all(max(1, m // jaccard_join.EXTRA) >= least for m in (must, n, n + 1))
