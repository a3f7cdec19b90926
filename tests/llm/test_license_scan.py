import random

import duckdb

from seedweave.llm import license_scan as ls


def brute(rows, texts=ls.TEMPLATES):
    """All windows of all texts, shingle by shingle."""
    out = {}
    for template, text in zip(ls.templates_from(texts), texts.values()):
        words = ls.template_words(text)
        own = {tuple(words[i : i + ls.SHINGLE]) for i in range(len(words) - ls.SHINGLE + 1)}
        for doc_id, body in rows:
            words = ls.template_words(body or "")
            shingles = [tuple(words[i : i + ls.SHINGLE]) for i in range(len(words) - ls.SHINGLE + 1)]
            for first in range(0, max(len(shingles), 0), template.stride):
                held = len(own & set(shingles[first : first + template.window])) / len(own)
                if held >= ls.CONTAINMENT:
                    out.setdefault((doc_id, template.name), {}).setdefault(first, 0)
                    out[doc_id, template.name][first] = max(held, out[doc_id, template.name][first])
    return {k: (max(v.values()), min(v), len(v)) for k, v in out.items()}


def corpus():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    rows = [(0, None), (1, ""), (2, "four words are few"), (3, "Released under the MIT License.")]
    for i in range(120):
        before, after = [" ".join(word() for _ in range(rnd.randint(0, 40))) for _ in range(2)]
        notice = rnd.choice(list(ls.TEMPLATES.values())).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2])):
            spot = rnd.randrange(len(notice))
            notice[spot : spot + rnd.randint(0, 1)] = [word()]
        rows.append((10 + i, f"{before}\n{' '.join(notice).upper() if i % 9 == 0 else ' '.join(notice)} {after}"))
    rows.append((500, " ".join([ls.TEMPLATES["apache-2.0-notice"]] * 30)))
    return rows


def test_equals_brute_force(documents):
    rows = corpus()
    found = ls.scan(documents(rows).withColumnRenamed("lang", "license").repartition(3))
    got = {(r["doc_id"], r["license"]): (r["containment"], r["first_shingle"], r["n_windows"]) for r in found.collect()}
    assert got == brute(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql_says_the_same():
    rows = corpus()
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = {(r[0], r[1]): (r[2], r[3], r[4]) for r in db.execute(ls.scan_sql()).fetchall()}
    assert got == brute(rows)


def test_repeats_rows_without_id_and_empty_tables(documents):
    notice = ls.TEMPLATES["mit-notice"]
    got = ls.scan(documents([(1, notice), (1, notice), (None, notice)])).collect()
    assert sorted((str(r["doc_id"]), r["n_windows"]) for r in got) == [("1", 1), ("None", 1)]
    assert ls.scan(documents([])).count() == 0
    assert ls.scan(documents([(1, notice)]), {}).count() == 0


def test_bands_find_what_they_promise():
    for shingles in (1, 3, 8, 25, 90):
        window = -(-5 * shingles // 4)
        inside = -(-4 * shingles // 5)
        least = inside / (window + shingles - inside)
        assert least >= 1 or (1 - least) ** ls.bands_for(shingles, window) <= 1 - ls.COLLISION


def test_each_template_keeps_the_promise_for_random_partial_copies():
    rnd = random.Random(8)
    runs, missed = 5_000, {}
    for t in ls.templates_from(ls.TEMPLATES):
        inside = -(-4 * len(t.shingles) // 5)
        found = {b: ls.band_hash(h, b) for b, h in t.minima}
        misses = 0
        for _ in range(runs):
            own = set(rnd.sample(t.shingles, inside))
            # The smallest of n evenly spread hashes, drawn at once.
            others = lambda: (1 - rnd.random() ** (1 / (t.window - inside))) * 2**64 - 2**63
            misses += not any(h in own and others() > found[b] for b, h in t.minima)
        missed[t.name] = misses
    # Five deviations above one in ten thousand, the promise for any choice of shingles.
    assert max(missed.values()) <= runs * (1 - ls.COLLISION) + 5 * (runs * (1 - ls.COLLISION)) ** 0.5, missed


def test_partial_copies_in_many_places_are_all_found(documents):
    rnd = random.Random(9)
    rows = []
    for text in ls.TEMPLATES.values():
        words = ls.template_words(text)
        cut = (len(words) - 4) // 5
        for _ in range(12):
            first = rnd.randint(0, cut)
            own = words[first : len(words) - cut + first]
            before, after = [[f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(5, 20))] for _ in range(2)]
            rows.append((len(rows), " ".join([*before, *own, *after])))
    got = {(r["doc_id"], r["license"]): (r["containment"], r["first_shingle"], r["n_windows"]) for r in ls.scan(documents(rows)).collect()}
    assert got == brute(rows)


def test_band_hash_is_that_of_spark(spark):
    from pyspark.sql import functions as F

    rows = [(h, b) for h in (-(2**63), -5, 0, 7, 2**63 - 1) for b in (0, 1, 30)]
    got = spark.createDataFrame(rows, "h BIGINT, b BIGINT").select("h", "b", F.xxhash64("h", "b").alias("x")).collect()
    assert all(ls.band_hash(r["h"], r["b"]) == r["x"] for r in got)
