import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rinsework.llm import classifier, langid, quality_rules, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept int, score string"
SF = "/root/testdata/sf0.01"


# language identification


def test_languages_of_held_out_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op6_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) > 0.97 * len(held)


def test_language_odd_rows(spark):
    rows = [(i, w * 30, lang, "s", 1, 1, "x") for i, (w, lang) in enumerate([("the cat and the dog ", "en"), ("der hund und die katze ", "de"), ("the dog ", None)] * 30)]
    rows += [(1000, None, "en", None, 1, 1, "x"), (1001, "123 !!", "en", None, 1, 1, "x"), (1002, "", None, None, 1, 1, "x"), (None, "die katze", "de", None, None, 1, "x"), (1003, "hundkatze " * 20_000, "de", None, 1, 1, "x")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 1000, 1001, 1002, None, 1003)] == ["en", "de", "en", "und", "und", "und", "de", "de"]
    assert got[1000].score == 0 and got[None].held_out is False
    nothing = langid.identify(spark.createDataFrame([(1, "a b", None, None, 1, 1, "")], DOCS)).collect()
    assert [r.lang_pred for r in nothing] == ["und"]
    assert langid.identify(spark.createDataFrame([], DOCS)).collect() == []


def test_backoff_goes_from_long_to_short():
    words = {"known": np.array([2.0, -2.0])}
    grams = [{"k": np.array([0.1, -0.1])}, {"kn": np.array([0.5, -0.5])}, {"kno": np.array([-1.0, 1.0])}, {}]
    m = langid.Model(["a", "b"], words, grams)
    assert m.score("known")[0] == 2 and m.score("kno!")[0] < 0 and m.score("knx")[0] > m.score("kx")[0] > 0 == m.score("zz")[0]


def slow_languages(docs):
    """(id, prediction, score) by plain dictionaries; docs: (id, text, lang)."""
    strip = ".,;:!?\"'()[]{}<>|#*$%&-_/\\0123456789"
    cut = lambda t: "".join(" " if c in strip else c for c in t.lower()).split()
    learnt = [(t, lang) for i, t, lang in docs if zlib.crc32(str(i).encode()) % 3 != 1 and lang is not None and t is not None]
    langs = sorted({lang for _, lang in learnt})
    counts = {x: {} for x in langs}
    for t, lang in learnt:
        for w in cut(t):
            counts[lang][w] = counts[lang].get(w, 0) + 1
    totals = [sum(counts[x].values()) for x in langs]

    def logs(table, totals):
        keys = {k for own in table.values() for k in own}
        rows = {k: [math.log((table[x].get(k, 0) + 0.5) / (n + 0.5 * len(keys) + 1)) for x, n in zip(langs, totals)] for k in keys}
        return {k: [v - sum(r) / len(r) for v in r] for k, r in rows.items()}

    words = logs({x: {w: n for w, n in counts[x].items() if n >= 3} for x in langs}, totals)
    grams = []
    for size in range(1, 5):
        table = {x: {} for x in langs}
        for x in langs:
            for w, n in counts[x].items():
                padded = f" {w} "
                for i in range(len(padded) - size + 1):
                    table[x][padded[i : i + size]] = table[x].get(padded[i : i + size], 0) + n
            table[x] = {g: n for g, n in table[x].items() if n >= 2}
        grams.append(logs(table, [sum(table[x].values()) for x in langs]))

    def score(w):
        if w in words:
            return words[w]
        padded = f" {w} "
        for size in (4, 3, 2, 1):
            found = [grams[size - 1][g] for i in range(len(padded) - size + 1) if (g := padded[i : i + size]) in grams[size - 1] and g != " "]
            if found:
                return [sum(c) * size / 4 / len(found) ** 0.5 for c in zip(*found)]
        return [0.0] * len(langs)

    out = []
    for i, t, _ in docs:
        own = [score(w) for w in cut(t or "") if any(map(str.isalpha, w))]
        if not own:
            out.append((i, "und", 0.0))
            continue
        total = [sum(c) / len(own) ** 0.5 for c in zip(*own)]
        out.append((i, langs[total.index(max(total))], 1 / sum(math.exp(v - max(total)) for v in total)))
    return out


def test_languages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()[:250]
    rows = [(r.doc_id, (r.text or "")[:3000] + " l'arbre-vert it's 3x", r.lang, r.source, 1, 1, "x") for r in docs]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    for i, lang, chance in slow_languages([r[:3] for r in rows]):
        assert got[i].lang_pred == lang and abs(got[i].score - chance) < 1e-6


def test_a_rare_language_among_many(spark):
    rnd = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = [["".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 9))) for _ in range(120)] for _ in range(30)]
    text = lambda k: " ".join(rnd.choice(vocabulary[k]) for _ in range(60))
    rows, wanted = [], {}
    for k in range(30):
        for _ in range(40 if k else 5):  # language 0 has five documents
            wanted[len(rows)] = f"l{k:02d}"
            rows.append((len(rows), text(k), f"l{k:02d}", "s", 1, 1, "x"))
    rows += [(i, text(0), None, "s", 1, 1, "x") for i in range(5000, 5020)]
    wanted |= {i: "l00" for i in range(5000, 5020)}
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, DOCS), sample=300, words=3000, grams=3000).collect()}
    assert np.mean([got[i] == x for i, x in wanted.items()]) > 0.98 and all(got[i] == "l00" for i in range(5000, 5020))


def test_a_model_of_150_languages_is_no_larger(spark, monkeypatch):
    """Its size is that of what was counted, its rows are those of dense tables, and a worker's memory may be short."""
    rnd = np.random.default_rng(5)
    totals = rnd.integers(500, 900, 150).astype(float)
    counts = {f"w{k}": {int(i): float(rnd.integers(1, 50)) for i in sorted(rnd.choice(150, 3, replace=False))} for k in range(4000)}
    monkeypatch.setattr(langid, "KEPT_BYTES", 20_000)
    table = langid.Table.of(counts, totals)
    assert sum(x.nbytes for x in table.parts[1:]) < 12 * 3 * 4000 + 8 * 4001 + 8 * 150 + 1000
    for k, by in [*counts.items()][::97] * 2:
        own = np.array([by.get(i, 0.0) for i in range(150)])
        logs = np.log((own + 0.5) / (totals + 0.5 * len(counts) + 1))
        assert np.array_equal(table[k], logs - logs.mean()) and len(table.rows) <= table.most < 20
    assert "x" not in table and table.get("x") is None


def test_one_id_on_most_rows_and_many_languages(spark):
    """Only about `sample` rows of a hot id are learnt from, and each of 120 languages is found."""
    rnd = random.Random(8)
    vocabulary = [["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(15)] for _ in range(120)]
    rows = [(7 if i % 3 else i, " ".join(rnd.choice(vocabulary[i % 120]) for _ in range(25)), f"l{i % 120:03}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, F.lit(True), sample=1200, words=6000, grams=6000)
    assert len(model.languages) == 120
    got = langid.predict(docs, model).collect()
    assert np.mean([g.lang_pred == r[2] for g, r in zip(got, rows, strict=True)]) > 0.99
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:05}")
    hot = spark.createDataFrame([(7, f"{letters(i)} " * 3, "en") for i in range(3000)], docs.schema)
    assert 50 < len(langid.learn(hot, F.lit(True), sample=100).words) < 200  # a word for each row


# quality rules


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b c", "a a a a", "a b c a b c", "é|é\n\né|é\n  \n", " x\x0by \x1c z", "w " * 40_000, "   "]
    texts += [" ".join(rnd.choice("abcde") for _ in range(rnd.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, None, None, 1, 1, "x") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: tuple(r)[1:6] for r in quality_rules.judge(df).collect()}
    assert got == {i: slow_counts(t) for i, t in enumerate(texts)}


def test_rules_sql_twin(spark):
    from tests.llm.twin import same

    same(spark, SF, "op7_quality_rules")


def test_fences_against_brute_force(spark):
    """Thresholds are quantiles of each group, of its language where it is small, and of all where that is."""
    rnd, rows = random.Random(8), []
    for lang, source, n, size in (("en", "a", 150, 5), ("en", "b", 300, 9), ("en", "c", 20, 6), ("de", "a", 60, 7), (None, None, 130, 4)):
        for _ in range(n):
            words = ["x" * max(1, round(rnd.gauss(size, 2))) + str(rnd.random())[2:5] for _ in range(rnd.randrange(50, 90))]
            lines = [" ".join(words[i : i + 7]) for i in range(0, len(words), 7)]
            lines += [lines[0]] * rnd.choice([0, 0, 0, 1, 2]) + ["#" * rnd.choice([0, 0, 1, 3, 60])]
            rows.append((len(rows), "\n".join(lines), lang, source, 1, 1, "x"))
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    ratios = {}
    for i, t, *_ in rows:
        r, n_lines = got[i], sum(bool(x.split()) for x in t.split("\n"))
        ratios[i] = (1000 * r.n_symbols // r.word_chars, 1000 * r.n_dup_lines // n_lines, 1000 * r.n_repeat_words // r.n_words, 100 * r.word_chars // r.n_words)
    good = [r for r in rows if not got[r[0]].base_failed]
    for i, _, lang, source, *_ in good:
        for level in (lambda r: r[2:4] == (lang, source), lambda r: r[2] == lang, lambda r: True):
            group = [ratios[r[0]] for r in good if level(r)]
            if len(group) >= quality_rules.LEAST:
                break
        kept = True
        for m, (lower, upper, times, floor, both) in enumerate(quality_rules.FENCES.values()):
            values = sorted(g[m] for g in group)
            low, high = (values[max(0, -(-len(values) * q // 100) - 1)] for q in (lower, upper))
            spread = times * (high - low) or floor
            kept &= ratios[i][m] <= high + spread and (not both or ratios[i][m] >= low - spread)
        assert got[i].kept == kept
    assert 0 < sum(not got[r[0]].kept for r in good) < 0.4 * len(good)


def test_rules_keep_clean_and_drop_junk(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op7_quality_rules(spark, SF).collect()}
    assert {d: tuple(r)[1:6] for d, r in got.items()} == {d: slow_counts(t) for d, t in docs.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [got[d].kept for d, q in labels.items() if q == 1 and not got[d].base_failed]
    bad = [got[d].kept for d, q in labels.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.5


def test_rules_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", None, None, None, 1, "x"), (None, None, "en", None, 1, 1, "x")], DOCS)
    assert [r.kept for r in quality_rules.judge(df).collect()] == [False, False]
    assert quality_rules.keep_good(df).columns == df.columns and quality_rules.keep_good(df).collect() == []
    assert quality_rules.judge(df.limit(0)).collect() == []
    fine = spark.createDataFrame([(i, " ".join(f"w{j * (i + 3)}" for j in range(80)), None, "s", 1, 1, "x") for i in range(60)], DOCS)
    assert quality_rules.keep_good(fine).count() == 60


def test_rules_have_no_python(spark, capsys):
    df = spark.createDataFrame([(1, "a b", None, None, None, 1, "x")], DOCS)
    quality_rules.measure(df, "doc_id", "lang", "source").explain()
    plan = capsys.readouterr().out
    assert "Project" in plan and "Python" not in plan and "Arrow" not in plan


# classifier


def test_classifier_on_unseen_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen, unseen = labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0")
    got = {r.doc_id: r for r in classifier.score(docs, classifier.train(docs, seen)).collect()}
    assert len(got) == docs.count()
    truth = [(r.quality, got[r.doc_id].kept) for r in unseen.collect()]
    assert np.mean([q == k for q, k in truth]) > 0.95
    assert np.mean([k for q, k in truth if q == 1]) > 0.97


def test_classifier_exchanges_labels():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 600).astype(float)
    a, b = (rng.normal(0, 0.6, (600, 3)) + (2 * y[:, None] - 1) for _ in range(2))
    shown = np.where(np.arange(600) < 60, y, np.nan)
    fold = np.arange(600) % 4 == 0
    m = classifier.co_train((a, b), shown, fold, sure=0.9)
    assert sum(map(sum, m.exchanged)) > 50
    assert np.mean((m.score(a, b)[2] > 0.5) == (y > 0.5)) > 0.95


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, 0, 0), (2, 0, 0)]])
def test_classifier_without_two_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a", None, None, None, 1, "x"), (1, None, "en", "s", 3, 1, "x"), (None, "w " * 90_000, "en", "s", -3, 1, "x")], DOCS)
    own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert all(r.kept for r in classifier.score(docs, classifier.train(docs, own)).collect())
    assert classifier.keep_good(docs, own).columns == docs.columns and classifier.keep_good(docs, own).count() == 3
    assert classifier.keep_good(docs.limit(0), own).collect() == []


def test_few_labels_in_many_documents(spark):
    rnd = random.Random(8)
    words = "the house of a small river and its people who walk slowly home".split()
    good = lambda: " ".join(rnd.choice(words) for _ in range(40))
    bad = lambda: " ".join(rnd.choice(("###", "$$$", "!!!", "%%", "XX")) for _ in range(40))
    rows = [(i, (good if i % 2 else bad)(), "en", "s", 200) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 3000, 37)], "doc_id long, quality int")
    model = classifier.train(docs, labels, sample=200)
    assert model.joint is not None
    with pytest.warns(UserWarning, match="nothing could be learnt"):
        assert classifier.train(docs, labels.filter("quality = 1"), sample=200).joint is None


@pytest.mark.parametrize("n", [2, 4, 6, 8, 12, 20])
def test_labels_of_both_classes_are_always_learnt(n):
    for seed in range(20):
        rng = np.random.default_rng(seed)
        y = np.full(400, np.nan)
        shown = rng.permutation(400)[:n]
        bad = rng.integers(1, n)  # of the labels, from one to all but one
        y[shown] = np.arange(n) >= bad
        truth = rng.integers(0, 2, 400)
        truth[shown] = y[shown]
        a, b = (rng.normal(0, 0.2, (400, 3)) + (2.0 * truth[:, None] - 1) for _ in range(2))
        fold = classifier.folds(y, rng.permutation(400))
        for used in (0, 1):
            assert len(np.unique(y[~np.isnan(y) & (fold != used)])) == 2
        m = classifier.co_train((a, b), y, fold)
        assert m.joint is not None and np.mean((m.score(a, b)[2] > 0.5) == (truth > 0)) > 0.9


def test_few_labels_through_spark(spark):
    docs = spark.createDataFrame([(i, ("river house " if i % 2 else "### $$$ ") * 30, "en", "s", 300) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    for ids in ([0, 1], [3, 4, 6], [10, 11, 12, 13]):
        model = classifier.train(docs, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int"))
        assert [r.kept for r in classifier.score(docs, model).orderBy("doc_id").collect()] == [bool(i % 2) for i in range(200)]


def test_a_rare_language_keeps_its_words(spark):
    rnd = random.Random(4)
    common = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rare = ["".join(rnd.choice("qrstuvwxyz") for _ in range(6)) for _ in range(20)]
    rows = [(i, " ".join(rnd.choice(rare if i % 500 == 7 else common) for _ in range(40)), "rr" if i % 500 == 7 else "cc") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, F.lit(True), sample=200, words=100, grams=200)
    assert model.languages == ["cc", "rr"]
    assert sum(w in model.words for w in rare) == len(rare)
    assert all(model.predict(t)[0] == lang for _, t, lang in rows if lang == "rr")
