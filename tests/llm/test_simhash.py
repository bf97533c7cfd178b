import random
import re

import numpy as np
import xxhash

from rinsework.llm import queries, simhash
from rinsework.operators.components import components

SCHEMA = "doc_id long, text string, fp int"


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    """fps: (doc_id, fingerprint)."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    distinct = sorted({f for _, f in fps})
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in fps), key=repr)


def test_fingerprints():
    for t in ["", None, "a", "A b", "x y z", "  É b\x0bc \x1c d", "the cat\tsat on\nthe mat " * 40, "w " * 70_000]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_query_against_brute_force(spark):
    got = sorted((tuple(r) for r in queries.op3_simhash_near_dedup(spark, "/root/testdata/sf0.01").collect()), key=repr)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert got == slow_components([(d, slow_fingerprint(t)) for d, t in docs])


def test_trees_and_pieces(spark):
    rnd = random.Random(3)
    centre = [rnd.getrandbits(64) for _ in range(4)]
    values = set()
    for c in centre:
        x = c
        for _ in range(120):  # a chain: neighbours are linked, ends are far apart
            x ^= 1 << rnd.randrange(64)
            values.add(x)
    values |= {rnd.getrandbits(64) for _ in range(300)}
    signed = [(v - (v >> 63 << 64),) for v in values]
    df = spark.createDataFrame(signed, "fp long")
    roots = {r.node % 2**64: r.root for r in components(simhash.link(df, piece=16)).collect()}
    wanted = slow_components(list(enumerate(sorted(values))))
    groups = {}
    for d, f, c in wanted:
        groups.setdefault(c, set()).add(roots.get(int(f, 16), f))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_spanning_is_a_forest():
    values = np.arange(64, dtype=np.uint64)
    assert len(simhash.spanning(simhash.BKTree(values), values, 2, same=True)) == 63


def test_trees_find_what_a_scan_finds():
    rnd = np.random.default_rng(5)
    for bits in (8, 20, 64):
        values = np.unique(rnd.integers(0, 2**bits, 400, dtype=np.uint64, endpoint=False))
        queries = rnd.integers(0, 2**bits, 100, dtype=np.uint64, endpoint=False)
        tree = simhash.BKTree.unpack(simhash.BKTree(values).pack())
        found = {(int(tree.values[n]), int(q)) for n, hit in tree.search(queries, 3) for q in queries[hit]}
        assert found == {(int(v), int(q)) for v in values for q in queries if (int(v) ^ int(q)).bit_count() <= 3}
        edges = [(n, c) for n in range(len(tree.values)) for c in range(tree.first[n], tree.last[n])]
        assert len(edges) == len(values) - 1 and all(int(tree.values[n] ^ tree.values[c]).bit_count() == tree.edge[c] for n, c in edges)
    assert list(simhash.BKTree(np.zeros(0, np.uint64)).search(queries, 2)) == []


def test_odd_rows_and_keep_first(spark):
    rows = [(3, "a b c d", 1), (1, "a b c d", 1), (None, "a b c d", 1), (7, None, 1), (8, "", 1), (9, " \t", 1), (3, "a b c d", 1), (None, "zz yy xx ww", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert [(d, f"{f:016x}", c) for d, f, c in got] == slow_components([(d, slow_fingerprint(t)) for d, t, _ in rows])
    kept = simhash.keep_first(df, simhash.near_duplicates(df))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 7]
    empty = df.limit(0)
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_first(empty, simhash.near_duplicates(empty)).collect() == []


# ---- by similarity


def shingle_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rnd, words, share):
    return [rnd.choice(WORDS) if rnd.random() < share else w for w in words]


WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "je") for b in ("n", "r", "st", "t", "l", "m", "ck", "p")]


def test_similar_documents(spark):
    rnd = random.Random(9)
    texts = []
    for size in (60, 150, 400, 900):
        for _ in range(12):
            base = [rnd.choice(WORDS) for _ in range(size)]
            texts += [" ".join(base)] + [" ".join(edited(rnd, base, share)) for share in (0.005, 0.01, 0.02, 0.05, 0.3)]
    base = [rnd.choice(WORDS) for _ in range(500)]
    texts += [" ".join([*base[:i], "new", *base[i + 1 :]]) for i in range(300)]  # one large group of near copies
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, SCHEMA), piece=64).collect()}
    assert sorted(found) == list(range(len(texts)))
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    linked = [found[i] == found[j] for i, j in pairs]
    assert sum(linked) >= 0.97 * len(linked)
    parent = list(range(len(texts)))  # no component is larger than links of 0.77 make it
    for i in range(len(texts)):
        for j in range(i):
            if found[i] == found[j] and jaccard(sets[i], sets[j]) >= 0.77:
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
    roots = {}
    for i in range(len(texts)):
        a = i
        while parent[a] != a:
            a = parent[a]
        roots.setdefault(found[i], set()).add(a)
    assert all(len(r) == 1 for r in roots.values())
    assert all(found[c] == c for c in set(found.values()))


def test_similar_star(spark):
    rnd, texts = random.Random(3), []
    for _ in range(4):
        base = [rnd.choice(WORDS) for _ in range(400)]
        texts.append(" ".join(base))
        for _ in range(60):  # each is like the first, and hardly like another
            words = list(base)
            for i in rnd.sample(range(400), 7):
                words[i] = f"new{rnd.random()}"
            texts.append(" ".join(words))
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert len(pairs) >= 240 and all(found[i] == found[j] for i, j in pairs)


def test_similar_odd_rows(spark):
    rows = [(3, "a b c d", 1), (1, "A b c d", 1), (None, "a b c d", 1), (7, None, 1), (8, "", 1), (9, "zz yy", 1), (3, "a b c d", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id, r.component_id) for r in simhash.similar_documents(df).collect()) == [(1, 1), (3, 1), (3, 1), (7, 7), (8, 7), (9, 9)]
    assert simhash.similar_documents(df.limit(0)).collect() == []
    assert sorted(r.doc_id for r in simhash.keep_first(df, simhash.similar_documents(df)).filter("doc_id is not null").collect()) == [1, 7, 9]


def test_one_id_with_different_texts_loses_none(spark):
    rows = [(5, "one two three four five six seven", 1), (5, "quite another text of some more words", 2), (5, "quite another text of some more words", 3), (6, "one two three four five six seven", 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    for found in (simhash.similar_documents(df), simhash.near_duplicates(df)):
        assert sorted((r.doc_id, r.text) for r in simhash.keep_first(df, found).collect()) == [(5, rows[0][1]), (5, rows[1][1])]


def test_similar_families_are_whole(spark):
    """Families whose pairs straddle the threshold: the very components of brute force."""
    rnd, texts = random.Random(21), []
    for _ in range(60):
        base = [rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(300)]
        for _ in range(12):
            words = list(base)
            for i in rnd.sample(range(300), rnd.randrange(1, 14)):
                words[i] = f"new{rnd.random()}"
            texts.append(" ".join(words))
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets, least = [shingle_set(t) for t in texts], list(range(len(texts)))
    for _ in range(12):
        for i in range(len(texts)):
            for j in range(i // 12 * 12, i):
                if least[i] != least[j] and jaccard(sets[i], sets[j]) >= 0.8:
                    least[i] = least[j] = min(least[i], least[j])
    assert [found[i] for i in range(len(texts))] == least


def test_many_trees_find_what_a_scan_finds():
    rnd, radius = np.random.default_rng(11), 102
    for group in (np.zeros(0, int), np.zeros(1, int), np.repeat([4, 7, 9, 20], [1, 2, 60, 300]), np.arange(400) % 5):
        bases = rnd.integers(0, 2**64, (4, 8), dtype=np.uint64)
        flips = np.packbits(rnd.random((len(group), 512)) < 0.1 * rnd.random((len(group), 1)), axis=1).view(np.uint64)
        values = bases[np.arange(len(group)) % 4] ^ flips.reshape(-1, 8)
        values[len(group) // 2 :][:3] = values[:1]  # equal ones too
        apart = np.bitwise_count(values[:, None] ^ values[None]).sum(2, dtype=int)
        forest = simhash.BKForest(values, group)
        found = [(max(p), min(p), d) for i, j, ds in forest.within(radius, rows=64) for *p, d in zip(i.tolist(), j.tolist(), ds.tolist(), strict=True)]
        pairs = [(i, j, apart[i, j]) for i in range(len(group)) for j in range(i) if group[i] == group[j]]
        assert sorted(found) == [p for p in pairs if p[2] <= radius]
        assert forest.met < 0.6 * len(pairs) or len(pairs) < 2  # the trees leave out much of the other three families
        inner = np.flatnonzero(forest.parent >= 0)
        assert len(inner) == len(group) - len(set(group.tolist())) and all(apart[forest.places[n], forest.places[forest.parent[n]]] == forest.edge[n] for n in inner)
        for links, most in zip(simhash.near_links(values, group, 50, radius + 0.9, most=50), (49, radius), strict=True):
            assert len(links) == len(simhash.forest(links[:, 0], links[:, 1], len(group)))  # no cycles
            assert all(apart[i, j] <= most and group[i] == group[j] for i, j in links.tolist())
            near = np.array([p[:2] for p in pairs if p[2] <= most], int).reshape(-1, 2)
            assert len(simhash.forest(*near.T, len(group))) == len(links)


def test_similar_by_the_whole_fingerprint(spark):
    """Texts with a similarity of 0.81 and 0.83 whose fingerprints differ in over 20 bits of the first word: the trees' radius is over all words."""
    texts = []
    for seed in (2232, 15701, 23940):
        rnd = random.Random(seed)
        base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        words = list(base)
        for i in rnd.sample(range(200), 4):
            words[i] = f"new{i}"
        texts += [" ".join(base), " ".join(words)]
        assert jaccard(shingle_set(texts[-2]), shingle_set(texts[-1])) >= 0.8
        assert (int(simhash.wide_fingerprint(texts[-2], 5)[0]) ^ int(simhash.wide_fingerprint(texts[-1], 5)[0])).bit_count() > 20
    found = simhash.similar_documents(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 4)]
