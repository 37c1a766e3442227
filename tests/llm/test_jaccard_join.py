import random
import re

import pytest

from groundline.llm import components, jaccard_join

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    """{doc_id: (n_shingles, component)} by all pairs."""
    sets = {}
    for doc, text in rows:
        if doc is None:
            continue
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.setdefault(doc, set()).update([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in docs}


def corpus(seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["É", "ß", "日本"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    common = [text(13) for _ in range(3)]
    rows = [text(rng.choice([1, 3, 5, 8, 20, 60, 150])) for _ in range(60)]
    for _ in range(120):
        base = list(rng.choice(rows))
        for _ in range(rng.randrange(0, 4)):
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append(base if rng.random() < 0.7 else base + rng.choice(common))
    star = text(80)
    for _ in range(90):  # a large group of near copies
        near = list(star)
        for _ in range(rng.randrange(0, 3)):
            near[rng.randrange(80)] = rng.choice(words)
        rows.append(near)
    rows += [rng.choice(common) + text(rng.randrange(1, 30)) for _ in range(60)]
    out = [(i, rng.choice([" ", "  ", "\n"]).join(r).title() if i % 7 == 0 else " ".join(r)) for i, r in enumerate(rows)]
    rng.shuffle(out)
    return out + [(1000, None), (1001, ""), (1002, " \t\n"), (None, out[0][1]), (1003, "one"), (1004, "ONE"), (1005, "x y z " * 3000), (1006, "x y z " * 3000)]


@pytest.mark.parametrize(("seed", "hot", "block"), [(1, 48, 3_000_000), (2, 4, 3_000_000), (3, 8, 900)])
def test_against_all_pairs(spark, seed, hot, block):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, node string, h int").repartition(7)
    found = jaccard_join.classes(docs, hot=hot, block_shingles=block).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None} == brute(rows)
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None]


def test_rows_that_share_a_doc_id_are_not_mixed_up(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "p"), (1, b, "q"), (2, "c d e f g h", "r"), (3, a + " tail", "s"), (4, b + " tail", "t"), (1, a, "p"), (5, "", "u"), (6, None, "v"), (None, a, "w"), (None, a, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(3)
    found = jaccard_join.classes(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found if r["doc_id"] is not None) == [(1, 1), (1, 1), (1, 1), (2, 2), (3, 1), (4, 1), (5, 5), (6, 6)]
    kept = sorted((tuple(r) for r in jaccard_join.keep_one(docs).collect()), key=str)
    assert kept == sorted([rows[0], rows[1], rows[2], rows[6], rows[7], rows[8], rows[9]], key=str)


@pytest.mark.parametrize("fragments", [1, 4, 7])
def test_fragments_add_up(fragments):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(300) < rng.choice([0, 0.02, 0.1, 0.15, 0.5]), rng.integers(0, 1 << 62, 300).astype(np.uint64), base)) for _ in range(60)]
    sets += [np.array([k], np.uint64) for k in range(5)]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for u in range(len(sets)):
        for v in range(u):
            both = len(np.intersect1d(sets[u], sets[v]))
            if both and 100 * both >= 80 * (len(sets[u]) + len(sets[v]) - both):
                x, y = sorted((root(u), root(v)))
                up[y] = x
    found = dict(jaccard_join.linked_sets(list(range(len(sets))), sets, fragments=fragments))
    assert found == {k: root(k) for k in range(len(sets)) if root(k) != k} and found


def test_common_shingles_come_last(spark):
    import numpy as np

    common = (np.array([3, 5, 9], np.uint64), np.array([2, 0, 1]))
    assert jaccard_join.in_global_order(np.array([1, 3, 4, 5, 9, 12], np.uint64), common).tolist() == [1, 4, 12, 5, 9, 3]
    rows = [(i, "one two three four five " + " ".join(f"w{i}x{k}" for k in range(i % 9))) for i in range(60)]
    nodes = jaccard_join.nodes_of(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).cache()
    hashes, rank = jaccard_join.common_shingles(nodes)
    assert jaccard_join.shingles("One two three four five")[0] == hashes[np.argmax(rank)]


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.classes(docs).count() == 0
    assert jaccard_join.keep_one(docs).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)] + [(500, i) for i in range(501, 560)]
    up = list(range(600))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: root(x) for e in edges if e[0] != e[1] for x in e}
