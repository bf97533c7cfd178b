import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rinsework.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, value long, rank int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, most=200):
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    out = []
    for lang in documents:
        kept = [t for t, n in documents[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        own[None] = {t: sum(c[t] for c in own.values()) for t in kept}
        sums = {s: sum(c.values()) for s, c in own.items()}
        share = {s: {t: 1 + 10**9 * (n + 1) // (sums[s] + len(kept)) for t, n in c.items()} for s, c in own.items()}
        f = lambda p, q: (p - q) ** 2 // q
        for s in own.keys() - {None}:
            pairs = [(-sum(f(share[s][t], share[o][t]) for t in kept), o.encode(), o) for o in own.keys() - {None, s}]
            terms = [(-f(share[s][t], share[None][t]), t.encode(), t) for t in kept if own[s][t] and share[s][t] > share[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def check(spark, rows, **sizes):
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    assert sorted(map(tuple, divergence.audit(table, **sizes).collect())) == brute(rows, **sizes)


def some(seed, n):
    own = random.Random(seed)
    words = ["".join(own.choice("abcXYZéß漢😀") for _ in range(own.randrange(1, 4))) for _ in range(60)]
    joined = lambda: "".join(own.choice(words) + own.choice([" ", "_", "1", ". ", "\x00", "\n"]) for _ in range(own.randrange(0, 40)))
    return [(i, own.choice([None, "", joined(), joined(), joined()]), own.choice(["en", "de", None, "", "x"]), own.choice(["a", "b", "c", "d", None, ""])) for i in range(n)]


def test_against_brute_force(spark):
    check(spark, some(1, 300))
    check(spark, some(2, 60), most=3)


def test_many_shards_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD", 200)
    rows = some(3, 120)
    assert len(rows) > 50
    check(spark, rows)


def test_rare_terms_lone_sources_and_none(spark):
    check(spark, [(1, "one two", "en", "a"), (1, "three", "en", "b"), (2, None, "en", "c"), (3, "x x x", "fr", "a")])
    check(spark, [(i, "same Same", "en", s) for i, s in enumerate("aab")] + [(9, "...", "en", "void"), (9, "...", "en", "void")])
    check(spark, [])


def test_one_source_with_most_rows_and_a_very_long_text(spark):
    check(spark, [(i, f"common word{i % 7} {'rare' if i % 5 else 'seldom'}", "en", "hot" if i % 3 else f"s{i % 4}") for i in range(600)] + [(7, "long text " * 100_000, "en", "s9")])


def test_counts_beyond_what_a_long_product_holds(spark):
    row = spark.range(1).select(divergence._share(F.lit(10**12).cast("long"), F.lit(3 * 10**12).cast("long"), F.lit(7).cast("long")).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**12 + 1) // (3 * 10**12 + 7)


def test_sql_twin(spark):
    from tests.llm.twin import same

    same(spark, "/root/testdata/sf0.001", "op13_source_divergence")
