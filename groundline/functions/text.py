"""Column functions over text: occurrences with offsets, white space, markers, money, dates, day counts.

All patterns are Java regular expressions; offsets are code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: how contracts write redactions and blanks
REDACTED = r"(?i)\[\*{3}\]|\[\* \* \*\]|\*{3,}|\[redacted\]|\[confidential treatment requested\]"
BLANK = r"\[●\]|\[•\]|\[ +\]|_{4,}"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
LONG_DATE = rf"(?:{MONTHS}) [0-9]{{1,2}}, [0-9]{{4}}"
MONTH = MONTHS + "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
# the forms of a date, each with the groups of its year, month and day; the first symbol is looked at before anything that costs more
DATES = (
    (rf"(?U)(?=[JFMASOND])\b({MONTH})\.?\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})\b", 3, 1, 2),
    (rf"(?U)(?=[0-9])\b([0-9]{{1,2}})\s+({MONTH})\.?,?\s+([0-9]{{4}})\b", 3, 2, 1),
    (r"(?U)(?=[0-9])\b([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\b", 3, 1, 2),
    (r"(?U)(?=[0-9])\b([0-9]{4})-([0-9]{2})-([0-9]{2})\b", 1, 2, 3),
)
_AMOUNT = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]{2})?"
MONEY = (
    rf"(?=[-$(0-9])(?:(?<![0-9.,])-?\$\s?{_AMOUNT}(?![0-9]|,[0-9]|\.[0-9])"
    rf"|(?<![0-9.,])\(\s*\$\s?{_AMOUNT}\s*\)(?![0-9]|,[0-9]|\.[0-9])"
    rf"|(?<![0-9.,]){_AMOUNT}\s+(?i:dollars)\b)"
)
DUE_CUE = r"(?i)\b(?:on or before|no later than|by|until|due|prior to)\b"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with more columns that are computed once for each row.

    The optimizer puts a column's expression wherever the column is used, also
    into functions of array elements; it doesn't look through a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


#: A private-use code point that marks matches while gaps are measured, and what stands in for it where a text has it itself.
_MARK, _OTHER = "\ue000", "\ue001"


def occurrences(text: Column, pattern: str) -> Column:
    """array of (start, match) of all non-overlapping matches.

    Matches and the pieces between them alternate, so a match starts after all
    earlier pieces and matches. Matches are replaced by a mark and the text is
    cut at the marks, as a split by a pattern would compile it for each row; a
    text without a match isn't cut at all.
    """
    empty = F.array().cast("array<struct<start:bigint,match:string>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        entry = F.struct(start.cast("long").alias("start"), pair["match"].alias("match"))
        return F.struct((start + F.length(pair["match"])).cast("long").alias("at"), F.concat(state["out"], F.array(entry)).alias("out"))

    def placed(found: Column) -> Column:
        between = F.split(F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, _MARK), _MARK, -1)
        pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(g.alias("gap"), m.alias("match")))
        return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(pairs, start, step, lambda s: s["out"]))

    # within a function of array elements the matches are found once
    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), placed), F.lit(0))


def folded(text: Column) -> Column:
    """Runs of Unicode white space as one space, ends stripped."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def line_folded(text: Column) -> Column:
    """Runs of ASCII white space as one space; ends stripped of any white space."""
    return F.regexp_replace(F.regexp_replace(text, "[ \t\r\n\f\x0b]+", " "), r"(?U)^\s+|\s+$", "")


def merge_key(name: Column) -> Column:
    """A name without white space and case."""
    return F.lower(F.regexp_replace(name, r"(?U)\s", ""))


def is_redacted(text: Column) -> Column:
    """G05."""
    return text.rlike(REDACTED)


def is_blank(text: Column) -> Column:
    """G06."""
    return text.rlike(BLANK)


def status_of(quote: Column) -> Column:
    """What the quote itself shows."""
    return F.when(is_redacted(quote), "redacted").when(is_blank(quote), "blank").otherwise("active")


def dates(text: Column) -> Column:
    """Array of (start, date, end) of calendar dates; those that no calendar has are left out."""

    def read(match: Column, pattern: str, year: int, month: int, day: int) -> Column:
        word = F.regexp_extract(match, pattern, month)
        named = ((F.position(F.substring(word, 1, 3), F.lit("JanFebMarAprMayJunJulAugSepOctNovDec")) + 2) / 3).cast("int")
        number = F.when(word.rlike("^[0-9]"), word.try_cast("int")).otherwise(named).cast("string")
        parts = F.concat_ws("-", F.regexp_extract(match, pattern, year), number, F.regexp_extract(match, pattern, day).try_cast("int").cast("string"))
        return F.try_to_timestamp(parts, F.lit("yyyy-M-d")).cast("date")

    def form(pattern: str, *groups: int) -> Column:
        return F.transform(occurrences(text, pattern), lambda o: F.struct(o["start"].alias("start"), read(o["match"], pattern, *groups).alias("date"), (o["start"] + F.length(o["match"])).alias("end")))

    # null isn't kept either
    return F.array_sort(F.filter(F.concat(*(form(*x) for x in DATES)), lambda d: d["date"] >= F.lit("0001-01-01").cast("date")))


def money(text: Column) -> Column:
    """Amounts in cents that stand in the text as complete tokens; in brackets or after a minus they are negative."""
    tokens = F.regexp_extract_all(text, F.lit(MONEY), F.lit(0))

    def cents(token: Column) -> Column:
        plain = F.regexp_replace(token, r"[^0-9.]", "").try_cast("decimal(18,2)")
        return (plain * F.when(token.rlike(r"^[-(]"), -100).otherwise(100)).cast("long")

    return F.array_compact(F.transform(tokens, cents))


def has_due_cue(text: Column, start: Column) -> Column:
    """A cue within the 40 code points before a date."""
    low = F.greatest(F.lit(0), start - 40)
    return F.substring(text, (low + 1).cast("int"), (start - low).cast("int")).rlike(DUE_CUE)


# fixed values: a day count of one to three digits, and the words that tell its direction
DAYS = r"(?U)(?=[0-9])(?<![0-9.,])[0-9]{1,3}(?![0-9.,])\s*\)?\s*(?:calendar\s+)?days?\b"
LATER, EARLIER = r"(?i)\b(?:after|following|from|of)\b", r"(?iU)\b(?:before|prior\s+to)\b"


def day_offsets(text: Column) -> Column:
    """Signed day counts; the direction is read in the 60 code points after, words of after winning."""

    def signed(o: Column) -> Column:
        n = F.regexp_extract(o["match"], "^[0-9]+", 0).cast("int")
        rest = F.substring(text, (o["start"] + F.length(o["match"]) + 1).cast("int"), F.lit(60))
        return F.when(rest.rlike(LATER), n).when(rest.rlike(EARLIER), -n)

    return F.filter(F.transform(occurrences(text, DAYS), signed), lambda n: n.isNotNull())


def first_at(text: Column, needle: Column, any_case: bool = False) -> Column:
    """(start, end) in the text as it stands of the first place that equals the needle but for white space (and case); else null."""
    stripped = F.regexp_replace(needle, r"(?U)^\s+|\s+$", "")
    literal = F.regexp_replace(stripped, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    pattern = F.concat(F.lit("(?iuU)" if any_case else "(?U)"), F.regexp_replace(literal, r"(?U)\s+", r"\\s+"))
    match = F.call_function("regexp_extract", text, pattern, F.lit(0))
    start = (F.position(match, text) - 1).cast("long")
    return F.when((stripped != "") & (match != ""), F.struct(start.alias("start"), (start + F.length(match)).alias("end")))


def holds(text: Column, needle: Column, any_case: bool = False) -> Column:
    """Whether first_at() finds the needle."""
    return F.coalesce(first_at(text, needle, any_case).isNotNull(), F.lit(False))
