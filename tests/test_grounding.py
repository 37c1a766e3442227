import random

from groundline.operators import rules


def brute(text, sections, pages, span, start, end, named):
    """Symbol by symbol, every occurrence."""

    def holding(intervals, x):
        return next((i for i in intervals if i[1] <= x < i[2]), None)

    def hits(low, high):
        words = span.split()
        for i in range(low, high):
            for j in range(i + 1, high + 1):
                part = text[i:j]
                if part == part.strip() and part.split() == words:
                    yield i, j

    def ok(i, j, method):
        page = holding(pages, i)
        return i, j, method, None, holding(sections, i)[0], page and page[0]

    if not span.split():
        return None, None, "none", "empty_span", None, None
    explicit = next((s for s in sections if s[0] == named), None)
    if 0 <= start < end <= len(text):
        for i, j in hits(start, end):
            held = holding(sections, i)
            if held and j <= held[2] and (explicit is None or held == explicit):
                return ok(i, j, "range")
    held = explicit or holding(sections, start)
    if held is None:
        return None, None, "none", "no_section", None, None
    found = list(hits(held[1], held[2]))
    if not found:
        return None, None, "none", "not_found_in_section", None, None
    return ok(*min(found, key=lambda h: (abs(h[0] - start), h[0])), "section")


def test_grounding_in_sections_equals_brute_force(spark):
    rng = random.Random(5)
    docs, sections, pages, claims, want = [], [], [], [], {}
    for doc in range(40):
        text = "".join(rng.choice(["a", "b", "ab", " ", "\n", " \n", "\u00a0", "a a"]) for _ in range(rng.randrange(1, 25)))
        cuts = sorted({0, len(text), *(rng.randrange(len(text)) for _ in range(3))})
        parts = [(f"s{i:04d}", x, y) for i, (x, y) in enumerate(zip(cuts, cuts[1:]))] if doc % 10 else []
        sheets = [(1, 0, max(1, len(text) // 2)), (2, max(1, len(text) // 2), len(text))]
        docs.append((doc, text))
        sections += [(doc, *x) for x in parts]
        pages += [(doc, *x) for x in sheets]
        for k in range(30):
            span = rng.choice(["a", "ab", "a a", "a\nb", " a  a ", "b a", "", " \n", "zz", "(", "aa", text])
            start, end = rng.randrange(-2, len(text) + 3), rng.randrange(-2, len(text) + 3)
            named = rng.choice([None, None, "s0000", "s0001", "none"])
            claims.append((doc * 100 + k, doc, span, start, end, named))
            want[doc * 100 + k] = brute(text, parts, sheets, span, start, end, named)
    claims += [(9001, None, "a", 0, 1, None), (9002, 77, "a", 0, 1, None)]  # no document, and one without text
    want |= dict.fromkeys((9001, 9002), (None, None, "none", "no_section", None, None))
    found = rules.grounded_in_sections(
        spark.createDataFrame(claims, "claim long, doc_id long, span string, claimed_start long, claimed_end long, section string"),
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(sections, "doc_id long, section string, char_start long, char_end long"),
        spark.createDataFrame(pages, "doc_id long, page long, char_start long, char_end long"),
    ).collect()
    assert {r["claim"]: tuple(r)[2:] for r in found} == want
    assert {x[3] for x in want.values()} == {None, "empty_span", "no_section", "not_found_in_section"}
    assert {x[2] for x in want.values()} == {"none", "range", "section"}
