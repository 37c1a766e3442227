import itertools

import pytest

from groundline.operators import rules


def pairs(spark, passages, texts):
    benchmark = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(tuple(r) for r in rules.passages(benchmark, docs).collect())


TEXTS = ["aa bb\ncc dd ee ff gg\nhh ii", "xx aa bb cc dd", "aa  bb\n\ncc dd ee ff", "", None, "one", "dd ee ff gg dd ee ff gg", "bb\ncc dd ee ff gg hh jj"]


@pytest.mark.parametrize(
    "passages",
    [
        ["bb\ncc dd ee ff gg", "b\ncc dd ee ff gg\nh"],  # line feeds in the key
        ["bb", "b\nc", "aa bb c", "a bb\ncc d", "b\ncc dd ee f"],  # too short for a whole inner key
        ["aa  bb\n\ncc dd", "\ncc", " ", "zz", None, "dd ee ff gg"],
        ["zz"],
        [None],
        [TEXTS[0][i:j] for i, j in itertools.combinations(range(len(TEXTS[0]) + 1), 2)],
    ],
)
def test_passages_equal_brute_force(spark, passages):
    want = sorted((i, j, t.index(p)) for i, p in enumerate(passages) for j, t in enumerate(TEXTS) if p is not None and t is not None and p in t)
    assert pairs(spark, passages, TEXTS) == want
