import random
import re

from seedweave.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_base_statistics_equal_brute_force(documents):
    rnd = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b c", "a b c a b c", "a a a a a", "x\n\nx\n x\n", "é漢😀 #*$ %&|<>", "\x0b\x0ca\rb", "a b " * 300]
    texts += [" ".join(rnd.choice("ab#c\n*d") for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    texts += ["w%d " % i * 2 for i in range(4)] + ["same line\nother\nsame line\nsame line"]
    docs = documents(list(enumerate(texts))).withColumnRenamed("lang", "n_words")
    rows = q.with_stats(docs.select("doc_id", "text", "n_words")).select("doc_id", "stats.*").collect()
    got = {r["doc_id"]: tuple(r[c] for c in q.BASE_STATS) for r in rows}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def labelled(documents, spark, n=240):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(60, 90))]
        rows.append((i, " ".join(w + "***" if bad else w for w in words)))
        if i % 3:
            labels.append((i, 0 if bad else 1, 0))
    return documents(rows), spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")


def test_learned_rules_generalize(spark, documents):
    docs, labels = labelled(documents, spark)
    rows = q.judge(docs, labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) and not r["base_failed"] for r in rows)
    kept = q.keep_good(docs.withColumnRenamed("source", "stats"), labels)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(240) if i % 4]
    assert kept.columns == ["doc_id", "text", "lang", "stats", "n_chars"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_base_rules_alone_without_labels(spark, documents):
    good = " ".join(f"word{i}" for i in range(50))
    docs = documents([(1, good), (2, good.rsplit(" ", 1)[0]), (3, "a b c " * 40), (4, None), (None, good), (1, good)])
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    assert sorted(str(r["doc_id"]) for r in q.keep_good(docs, none).collect()) == ["1", "1", "None"]
    assert q.judge(documents([]), none).count() == 0


def test_rules_are_ordered_conditions(spark):
    rules = [q.Rule((q.Condition("a", True, 1.0), q.Condition("b", False, 2.0))), q.Rule((q.Condition("a", True, 0.0),))]
    rows = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0), (0.0, 0.0), (None, 1.0)], "a DOUBLE, b DOUBLE")
    assert [r[0] for r in rows.select(q.verdict(rules)).collect()] == [1, 2, 0, 0]
    assert str(rules[0]) == "a > 1 and b <= 2"


def test_worst_label_counts(spark):
    stats = spark.createDataFrame([(1, *[1.0] * len(q.FEATURES))], ["doc_id", *q.FEATURES])
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, None)], "doc_id BIGINT, quality INT")
    assert [r["quality"] for r in q.labelled_stats(stats, labels).collect()] == [0]


def test_precise_rules_are_not_counted_off(spark, shared_folder, monkeypatch):
    rows = [(i, *[float(i)] * len(q.FEATURES), i % 2) for i in range(60)]
    stats = spark.createDataFrame(rows, ["doc_id", *q.FEATURES, "quality"])
    grown = iter([[(0, True, 40 - i)] for i in range(12)])
    monkeypatch.setattr(q, "_grow", lambda *_: next(grown, []))
    monkeypatch.setattr(q, "_prune", lambda rows, held, rule: (rule, 9, 0))
    assert len(q.learn(stats)) == 12
