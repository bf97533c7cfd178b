import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rinsework.llm import queries, substrings

SCHEMA = "doc_id long, text string, kept int, id int"


def brute(rows, window=13):
    """doc_id, words, removed words, kept text of each row."""
    least = {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1 if doc_id is not None else 0):
            w = tuple(words[i : i + window])
            least[w] = min(least.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1 if doc_id is not None else 0):
            if least[tuple(words[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        out.append((doc_id, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=repr)


def check(spark, rows, **how):
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    assert sorted(map(tuple, substrings.remove_repeats(table, **how).collect()), key=repr) == brute(rows, how.get("window", 13))


def corpus(seed, n):
    own = random.Random(seed)
    words = ["w%d" % i for i in range(300)] + ["é", "漢字", "\x01", "a b", "😀"]
    new = lambda k: [own.choice(words) for _ in range(k)]
    passages = [new(k) for k in (12, 13, 14, 20, 60)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(own.randrange(5)):
            parts += own.choice([new(own.randrange(30)), own.choice(passages), own.choice(passages)[own.randrange(3) :]])
        if texts and own.random() < 0.2:
            parts = own.choice(texts).split()
            if parts and own.random() < 0.7:
                parts[own.randrange(len(parts))] = "edit"
        texts.append("".join(w + own.choice([" ", "  ", "\n", "\t\x0b"]) for w in parts))
    return texts


def test_against_brute_force(spark):
    texts = corpus(1, 300)
    ids = random.Random(2).sample(range(1000), 300)
    check(spark, [*zip(ids, texts), (None, texts[5]), (None, texts[9]), (ids[3], texts[4]), (ids[8], texts[8]), (2000, None), (2001, "")])


@pytest.mark.parametrize("most", [3, 40])
def test_longer_prefixes_and_nodes_without_trees(spark, most):
    check(spark, [*enumerate(corpus(3, 150))], most=most)


@pytest.mark.parametrize("window", [1, 2, 5, 8])
def test_other_windows(spark, window):
    check(spark, [*enumerate(corpus(4, 60))], window=window)


def test_one_document_alone_keeps_its_own_repeats(spark):
    check(spark, [(1, "a b c d e f g h i j k l m " * 3)])
    check(spark, [(1, "a b c d e f g h i j k l m " * 3), (1, "a b c d e f g h i j k l m z"), (0, "x")])


def test_windows_are_judged_on_the_input(spark):
    w = [f"x{i}" for i in range(40)]
    check(spark, [(1, " ".join(w[:20])), (2, " ".join(w[:30])), (3, " ".join(w[10:40])), (4, " ".join(w[17:40]))])


def test_a_third_of_all_rows_alike_and_a_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, passage if i % 3 == 0 else f"{passage} own{i} " * 2 if i % 3 == 1 else f"other{i} words") for i in range(300)]
    check(spark, [*rows, (999, " ".join(f"n{i % 7919}" for i in range(200_000)))], most=20)


def test_empty(spark):
    check(spark, [])


def test_tree_nodes():
    texts = [b"a b c", b"a b d", b"a b c", b"b b c", b"a x y"]
    tree = substrings.SuffixTree(pa.array(texts, pa.large_binary()), 3)
    assert [texts[i] for i in tree.order] == sorted(texts)
    nodes = {d: [(int(a), int(b)) for a, b in zip(first, end)] for d, first, end in tree.nodes(1)}
    assert nodes == {1: [(0, 4)], 2: [(0, 3)], 3: [(0, 2)]}


def test_equal_windows_have_equal_anchors():
    own = random.Random(9)
    words = [str(own.randrange(50)) for _ in range(3000)]
    w = substrings.Words(pa.array([" ".join(words).encode(), " ".join(words[100:400]).encode()], pa.large_binary()))
    begin, _, hashes = substrings.anchors(w, 13)
    by = defaultdict(set)
    for b, h in zip(begin.tolist(), hashes.tolist()):
        by[tuple(w.hashes[b : b + 13].tolist())].add(h)
    assert all(len(x) == 1 for x in by.values()) and len(begin) == 3000 - 12 + 300 - 12
    assert np.array_equal(substrings.run_hashes(w.hashes, 1), w.hashes)


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    wanted = [(d, n, r, hashlib.sha256(k.encode()).hexdigest()) for d, n, r, k in brute(rows)]
    assert sorted(map(tuple, queries.op11_substring_dedup(spark, "/root/testdata/sf0.001").collect())) == sorted(wanted)
