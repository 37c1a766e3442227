"""When an obligation falls due: the timing clause of a quote, and what it resolves to.

The grammar is data. A quote is parsed on its own (parsed); only then are the
dates of named events looked up (resolved). All is done by expressions: the
first construction that fits is chosen by its number, its text is cut out once,
and everything else is read from that short text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.functions import numbers
from groundline.functions import text as T

# fixed values: the closed grammar of timing clauses
REDACTED = ("[***]", "[*]", "[REDACTED]")
UNITS = (("business", r"business\s+days?"), ("hours", r"hours?"), ("months", r"(?:calendar\s+)?months?"), ("calendar", r"(?:calendar\s+)?days?"))
CONSTRUCTIONS = (  # name, words, relation, sign of the count; in order of precedence
    ("within_business_days", r"within COUNT business\s+days?", "lte", 0),
    ("within_after", r"within COUNT UNIT (?:after|following|of|from)", "lte", 1),
    ("no_later_than_after", r"no later than COUNT UNIT (?:after|following)", "lte", 1),
    ("count_prior_to", r"(?:at least )?COUNT UNIT (?:prior to|before)", "lte", -1),
    ("on_or_before", r"on or (?:before|prior to)", "lte", 0),
    ("no_later_than", r"no later than", "lte", 0),
    ("prior_to", r"(?:prior to|before)", "lt", 0),
    ("upon", r"(?:immediately )?upon", "eq", 0),
    ("on_defined", r"on", "eq", 0),
    ("after", r"(?:promptly )?(?:after|following)", "gt", 0),
)
TRIGGERS = (
    ("invoice", ("invoice", "invoices", "bill", "billing statement")),
    ("notice", ("notice", "notification", "written notice")),
    ("demand", ("demand", "request", "written request")),
    ("default", ("default", "event of default", "failure", "breach")),
    ("completion", ("completion", "substantial completion", "delivery")),
    ("term_end", ("expiration", "termination", "end of the term", "surrender")),
)
COMPOUND = "the (?:earlier|later) (?:to occur )?of"
CONDITION = r"(?:if|in the event that|in the event)\b"
ENUMERATION = r"\s*(?:[0-9]+(?:\.[0-9]+)*\.?|\([A-Za-z0-9]+\)|[A-Z]\.)(?=\s)"
RECURRING = ("per month", "per calendar month", "monthly installments", "on the first day of each", "on the first day of every", "each calendar month", "each calendar year", "every calendar year", "each year", "every year")
MONTHLY = "in the month (?:that|in which)"
CROSS = ("within the time (?:allowed|provided|set forth) (?:pursuant to|in|under) section", "as provided in section", "pursuant to section [0-9]")
CUES = ("within", "promptly", "once", "until", "during", "throughout", "no later than", "prior to", "on or before")
LABELS = ("Effective Date", "Commencement Date", "Target Commencement Date", "Outside Completion Date", "Early Access Date")

KINDS = ("scheduled", "contingent", "unresolved", "untimed")
NAME = r"(?>[A-Z0-9][A-Za-z0-9]*(?:\s+[A-Z0-9][A-Za-z0-9]*)*?\s+Date\b)(?!\s*[A-Z0-9])"
DAY = rf"(?:{T.MONTHS})\s{{1,9}}[0-9]{{1,2}}"
#: What follows the words: up to a comma, semicolon or full stop, but on over the comma of a date.
PHRASE = rf"[^,;.]*(?:(?<=(?i:{DAY})),\s?[0-9]{{4}}(?![0-9])[^,;.]*)*"


def _words(plain: str) -> str:
    return plain.replace(" ", r"\s+")


def _construction(words: str) -> str:
    count = rf"(?:\[\*{{3}}\]|\[\*\]|\[REDACTED\]|(?:{numbers.spelled_pattern()})(?:\s*\(\s*[0-9]+\s*\))?|[0-9]+)"
    unit = "(?:" + "|".join(u for _, u in UNITS) + ")"
    return _words(words).replace("COUNT", count).replace("UNIT", unit)


def _any_of(phrases: tuple[str, ...]) -> str:
    return rf"(?U)(?<!\w)(?:{'|'.join(phrases)})(?!\w)"


@dataclass(frozen=True)
class Grammar:
    """The patterns of the constructions, from data like CONSTRUCTIONS."""

    constructions: tuple[tuple[str, str, str, int], ...] = CONSTRUCTIONS

    def keywords(self, i: int) -> str:
        """A construction with a phrase after it that isn't blank, and with a name for `on`."""
        name, words, *_ = self.constructions[i]
        after = rf"(?=(?-i:\s*(?:the\s+)?{NAME}))" if name == "on_defined" else r"(?=[^,;.]*[^\s,;.])"
        return rf"\b{_construction(words)}\b{after}" if not words.startswith("COUNT") else rf"(?<!\w){_construction(words)}\b{after}"

    def first(self, quote: Column) -> Column:
        """The number of the first construction, in order of precedence, that the quote has."""
        out = F.lit(None).cast("int")
        for i in range(len(self.constructions) - 1, -1, -1):
            out = F.when(quote.rlike("(?iU)" + self.keywords(i)), i).otherwise(out)
        return out

    def choose(self, number: Column, value) -> Column:
        out = F.lit(None)
        for i in range(len(self.constructions)):
            out = F.when(number == i, value(i, *self.constructions[i])).otherwise(out)
        return out


def parsed(quotes: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """The columns of `quotes` (with `quote`) and what the quote alone says of its timing.

    construction, relation, offset (signed days or other units), unit,
    trigger_start, trigger_end (in the quote), trigger_kind, bound_name and
    reason, why the quote leaves it open.
    """
    grammar = grammar or Grammar()
    quote = F.col("quote")
    rows = quotes.withColumn("_i", grammar.first(quote))
    whole = grammar.choose(F.col("_i"), lambda i, *_: F.regexp_extract(quote, f"(?iU){grammar.keywords(i)}{PHRASE}", 0))
    rows = rows.withColumn("_m", F.when(F.col("_i").isNotNull(), whole).otherwise(F.regexp_extract(quote, f"(?iU){_words(MONTHLY)}{PHRASE}", 0)))
    words = grammar.choose(F.col("_i"), lambda i, *_: F.regexp_extract("_m", f"(?iU)^{grammar.keywords(i)}", 0))
    rows = rows.withColumn("_w", words).withColumn("_n", T.folded(F.lower(F.col("quote"))))
    start = F.position(F.col("_m"), quote) - 1
    digits, word = F.regexp_extract("_w", "[0-9]+", 0), T.folded(F.lower(F.regexp_extract("_w", f"(?iU)\\b(?:{numbers.spelled_pattern()})\\b", 0)))
    sign = grammar.choose(F.col("_i"), lambda i, name, words, relation, sign: F.lit(sign))
    count = F.when(digits != "", digits.try_cast("int")).otherwise(numbers.from_words(word))
    counted = grammar.choose(F.col("_i"), lambda i, name, words, *_: F.lit("COUNT" in words))
    unit = F.lit(None)
    for kind, pattern in reversed(UNITS):
        unit = F.when(F.col("_w").rlike(rf"(?iU)\b{pattern}"), kind).otherwise(unit)
    rows = rows.withColumns(
        {
            "_start": start,
            "_phrase": F.substring("_m", F.length("_w") + 1, F.length("_m")),
            "construction": grammar.choose(F.col("_i"), lambda i, name, *_: F.lit(name)),
            "relation": grammar.choose(F.col("_i"), lambda i, name, words, relation, sign: F.lit(relation)),
            "offset": F.when(counted & (sign != 0), count * sign),
            "unit": F.when(counted, unit),
        }
    )
    name = F.regexp_extract("_phrase", rf"(?U)^\s*(?:the\s+)?({NAME})", 1)
    rows = rows.withColumn("bound_name", F.when(F.col("_i").isNotNull() & (name != ""), name))
    window = T.folded(F.lower(F.regexp_extract(F.substring(quote, F.col("_start") + 1, F.length(quote)), "^[^;.]*", 0)))
    kind = F.lit("other_event")
    for label, phrases in reversed(TRIGGERS):
        kind = F.when(window.rlike(_any_of(phrases)), label).otherwise(kind)
    kind = F.when(F.col("bound_name").isNotNull(), "defined_event").otherwise(kind)
    has, n = F.col("_i").isNotNull(), F.col("_n")
    leading = F.regexp_extract(quote, rf"(?U)^(?:{ENUMERATION})?\s*(?i:{_words(CONDITION)})[^,]*", 0)
    redacted = F.lit(False)
    for token in REDACTED:
        redacted = redacted | F.contains("_m", F.lit(token))
    reason = (
        F.when(has & redacted, "redacted_offset")
        .when(n.rlike(COMPOUND) | (has & (F.col("_start") < F.length(leading))), "conditional_or_compound")
        .when(n.rlike("|".join(RECURRING)), "recurring_schedule")
        .when(has & F.col("unit").isin("hours", "months"), "unsupported_unit")
        .when(n.rlike(MONTHLY), "month_granularity")
        .when(n.rlike("|".join(CROSS)), "cross_reference")
        .when(has & (F.col("unit") == "business"), "business_days")
        .when(~has & n.rlike(_any_of(CUES)), "anchor_not_found")
    )
    rows = rows.withColumn("_reason", reason)
    # A calendar date is no event
    dated = has & F.col("bound_name").isNull() & F.col("_phrase").rlike(rf"(?U)^\s*(?:the\s+)?(?i:{DAY}(?:,\s+[0-9]{{4}})?(?![0-9]))")
    shown = has | (F.col("_reason") == "month_granularity") & (F.col("_m") != "")
    return rows.select(
        *quotes.columns,
        "construction",
        "relation",
        "offset",
        "unit",
        F.when(shown, F.col("_start")).cast("long").alias("trigger_start"),
        F.when(shown, F.col("_start") + F.length("_m")).cast("long").alias("trigger_end"),
        F.when(shown & ~dated, kind).alias("trigger_kind"),
        "bound_name",
        F.coalesce("_reason", F.when(dated, "anchor_not_found")).alias("reason"),
    )


def anchor_candidates(events: DataFrame, agreements: DataFrame) -> DataFrame:
    """For each agreement its own dated events and its base's. events: (agreement_id, name, date); agreements: (agreement_id, base_agreement_id)."""
    heirs = agreements.where("base_agreement_id IS NOT NULL").select(F.col("agreement_id").alias("_heir"), "base_agreement_id")
    of_base = events.join(heirs, F.col("agreement_id") == F.col("base_agreement_id")).select(F.col("_heir").alias("agreement_id"), "name", "date")
    return events.select("agreement_id", "name", "date").unionByName(of_base)


def resolved(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Kind, why, bound of each parsed row (with id, agreement_id, legacy_due).

    anchors: (agreement_id, name, date), any number. Names are compared with
    white space folded. Several dates of a name conflict, none leaves it open,
    and a stored due date that differs from the bound conflicts too.
    """
    dates = anchors.where("date IS NOT NULL").groupBy(F.col("agreement_id").alias("_a"), T.folded(F.col("name")).alias("_name"))
    dated = dates.agg(F.min("date").alias("_low"), F.max("date").alias("_high"))
    met = rows.join(dated, (F.col("agreement_id") == F.col("_a")) & (T.folded(F.col("bound_name")) == F.col("_name")), "left")
    named, bound = F.col("bound_name").isNotNull(), F.date_add("_low", F.coalesce("offset", F.lit(0)))
    open_ended = F.col("relation").isin("gt", "gte")
    late = (
        F.when(F.col("unit") == "business", "business_days")
        .when(F.col("unit").isin("hours", "months"), "unsupported_unit")
        .when(open_ended | ~named, None)
        .when(F.col("_low") != F.col("_high"), "conflicting_dates")
        .when(F.col("_low").isNull(), "anchor_without_date")
        .when(F.col("legacy_due") != bound, "conflicting_dates")
    )
    why = F.coalesce("reason", late)
    kind = F.when(F.col("construction").isNull() & F.col("reason").isNull(), "untimed").when(why.isNotNull(), "unresolved").when(named & ~open_ended, "scheduled").otherwise("contingent")
    rows = met.withColumn("kind", kind).withColumn("why", F.when(kind == "unresolved", why))
    return rows.select("id", "kind", "why", F.when(F.col("kind") == "scheduled", bound).alias("bound"))
