"""Proposals: parsing, grounding, field verification, timing."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions import text as T
from groundline.plans.overlay import Graph

RUN = re.compile(r"\s{2,}")
GROUNDED = pa.schema(
    [("claim", pa.int64()), ("doc_id", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("method", pa.string()), ("failure", pa.string()), ("section", pa.string()), ("page", pa.int64())]
)
UNITS = ("days", "business days", "hours", "months")
ITEM = "kind string, type string, amount double, due_date string, span string"
ITEM_KEYS = ("amount", "due_date", "kind", "span", "type")
def quotes(g: Graph) -> DataFrame:
    """Quotes laid over the lines: an amount in two forms, a timing clause in one of nine forms, a date in six, and sometimes a marker."""
    n = F.col("l_quantity").cast("int").cast("string")
    unit = F.element_at(F.array(*map(F.lit, UNITS)), (F.col("l_partkey") % 4 + 1).cast("int"))
    what = F.element_at(F.array(*map(F.lit, ("the Commencement Date", "receipt of an invoice", "written notice", "Substantial Completion", "expiration of it", "a sunny day"))), (F.col("l_suppkey") % 6 + 1).cast("int"))
    form = F.col("id") % 9
    parts = [
        ("within ", n, " business days after "), ("within ", n, F.concat(F.lit(" "), unit, F.lit(" following "))), ("no later than ", n, F.concat(F.lit(" "), unit, F.lit(" after "))),
        ("at least ", n, F.concat(F.lit(" "), unit, F.lit(" prior to "))), ("on or before ", "", ""), ("no later than ", "", ""), ("before ", "", ""), ("upon ", "", ""), ("promptly after ", "", ""),
    ]
    clause = F.element_at(F.array(*(F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in p)) for p in parts)), (form + 1).cast("int"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    number = F.format_number((cents / 100).cast("decimal(18,2)"), 2)
    amount = F.when(F.col("l_suppkey") % 4 == 3, F.concat(number, F.lit(" dollars"))).otherwise(F.concat(F.lit("$"), number))
    mark = F.when(F.col("l_partkey") % 11 == 0, " [***]").when(F.col("l_partkey") % 11 == 1, " ____").otherwise("")
    written = [F.date_format("l_shipdate", x) for x in ("MMM. d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "M/d/yyyy", "yyyy-MM-dd")]
    date = F.concat(F.lit("; due "), F.coalesce(F.get(F.array(*written), (F.col("l_partkey") % 6).cast("int")), F.date_format("l_shipdate", "MMMM d, yyyy")))
    return g.line.select(
        "id", form.alias("form"), F.col("l_quantity").cast("int").alias("n"), (F.col("l_partkey") % 4).alias("unit"), (F.col("l_suppkey") % 6).alias("event"), cents.alias("cents"),
        F.to_date("l_shipdate").alias("date"), (F.col("l_partkey") % 11).alias("marked"), F.col("l_orderkey").alias("agreement_id"),
        F.concat(F.lit("Tenant shall pay "), amount, mark, F.lit(" "), clause, what, F.when(F.col("l_linenumber") % 2 == 0, date).otherwise(F.lit("")), F.lit(".")).alias("quote"),
        (F.col("l_linenumber") % 2 == 0).alias("dated"),
    )


def verified_fields(q: DataFrame, claimed: Column | None = None) -> DataFrame:
    """Which claimed values the quote bears out. The claimed amount is right but where the id divides by 7."""
    claim = claimed if claimed is not None else F.col("cents") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)
    rows = T.once(q, _found=T.dates(F.col("quote")), _days=T.day_offsets(F.col("quote")), _money=T.money(F.col("quote")), _claim=claim)
    rows = T.once(rows, _due=F.filter("_found", lambda d: T.has_due_cue(F.col("quote"), d["start"])))
    amount_ok, due_ok, days = F.array_contains("_money", F.col("_claim")), F.size("_due") > 0, F.col("_days")
    return rows.select(
        "id",
        F.when(amount_ok, F.col("_claim")).alias("amount"),
        F.when(amount_ok, "USD").alias("currency"),
        F.when(due_ok, F.get("_due", F.lit(0))["date"]).alias("due_date"),
        F.when(~due_ok & (F.size(days) == 1), F.get(days, F.lit(0))).alias("offset_days"),
        T.status_of(F.col("quote")).alias("status"),
        F.array_join(F.array_compact(F.array(F.when(~amount_ok, F.lit("amount")), F.when(due_ok & (F.size(days) > 0), F.lit("offset_days")))), ",").alias("corrections"),
    )


def parsed_responses(raw: DataFrame) -> DataFrame:
    """Responses (id, stop, body) to a typed outcome; an item needs exactly the known keys and sound values."""
    item = F.from_json("body", ITEM)
    keys = F.array_sort(F.json_object_keys("body"))
    sound = item["kind"].isin("obligation", "event", "party") & (item["due_date"].isNull() | F.try_to_timestamp(item["due_date"], F.lit("yyyy-MM-dd")).isNotNull())
    outcome = (
        F.when(F.col("stop") == "refusal", "refused")
        .when(F.col("stop") == "max_tokens", "truncated")
        .when(keys.isNull(), "not_json")
        .when(keys != F.array(*map(F.lit, ITEM_KEYS)), "bad_keys")
        .when(~F.coalesce(sound, F.lit(False)), "bad_value")
        .otherwise("ok")
    )
    return raw.select("id", outcome.alias("outcome"), F.when(outcome == "ok", item["type"]).alias("type"))


def grounded(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """Claims (claim, doc_id, span, claimed_start) to the occurrence nearest to the claimed start, ties earlier, in documents without sections.

    White space counts as it stands; grounded_in_sections() is the whole of G02-G04. Overlapping occurrences count. Documents meet claims by doc_id; the text
    isn't searched for other documents' claims.
    """
    rows = claims.join(lines, "doc_id").where(F.col("text").contains(F.col("span")))
    # the text is split before each occurrence, so the pieces' lengths add up to the occurrences' starts
    before = F.expr(r"concat('(?=\\Q', span, '\\E)')")
    pieces = rows.select("claim", "doc_id", "span", "claimed_start", F.posexplode(F.split("text", before, -1)).alias("k", "piece"))
    upto = Window.partitionBy("claim").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("i", F.coalesce(F.sum(F.length("piece")).over(upto), F.lit(0)) + 1)
    hits = placed.where(F.col("piece").startswith(F.col("span")) | (F.col("k") > 0))
    order = Window.partitionBy("claim").orderBy(F.abs(F.col("i") - 1 - F.col("claimed_start")), "i")
    best = hits.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    found = best.select("claim", (F.col("i") - 1).cast("long").alias("char_start"), (F.col("i") - 1 + F.length("span")).cast("long").alias("char_end"))
    return claims.select("claim", "doc_id").join(found, "claim", "left").withColumn("failure", F.when(F.col("char_start").isNull(), "not_found"))


class Intervals:
    """Intervals of one kind that don't overlap, by where they start."""

    def __init__(self, rows: list[dict]):
        self.rows = sorted(rows, key=itemgetter("char_start"))
        self.starts = [r["char_start"] for r in self.rows]

    def holding(self, offset: int) -> dict | None:
        i = bisect_right(self.starts, offset) - 1
        return self.rows[i] if i >= 0 and offset < self.rows[i]["char_end"] else None


def folded(text: str) -> str:
    """Each run of white space as one space."""
    words = " ".join(text.split())
    return " " * text[:1].isspace() + words + " " * (bool(words) and text[-1:].isspace())


class Grounder:
    """Looks spans up in one document: white space is folded, offsets are those of the text as it stands."""

    def __init__(self, text: str, sections: list[dict], pages: list[dict]):
        self.length = len(text)
        self.folded = folded(text)
        # runs of two or more: where each starts in the text and folded, and how many symbols were left out up to its end
        self.runs, self.places, self.gone = [], [], [0]
        if len(self.folded) != self.length:
            for run in RUN.finditer(text):
                self.runs.append(run.start())
                self.places.append(run.start() - self.gone[-1])
                self.gone.append(self.gone[-1] + run.end() - run.start() - 1)
        self.sections, self.pages = Intervals(sections), Intervals(pages)
        self.by_id = {x["section"]: x for x in reversed(self.sections.rows)}

    def down(self, offset: int) -> int:
        """The first folded symbol at or after an offset."""
        i = bisect_left(self.runs, offset)
        return min(max(offset - self.gone[i], self.places[i - 1] + 1), len(self.folded)) if i else offset

    def up(self, place: int) -> int:
        return place + self.gone[bisect_left(self.places, place)]

    def span(self, place: int, size: int) -> tuple[int, int]:
        return self.up(place), self.up(place + size - 1) + 1

    def ground(self, span: str | None, start: int, end: int, section: str | None) -> tuple:
        """(char_start, char_end, method, failure, section, page)."""
        needle = " ".join((span or "").split())
        if not needle:
            return None, None, "none", "empty_span", None, None
        explicit = self.by_id.get(section)
        size = len(needle)
        if 0 <= start < end <= self.length:
            low, high = self.down(start), self.down(end)
            if explicit is not None:
                low, high = max(low, self.down(explicit["char_start"])), min(high, self.down(explicit["char_end"]))
            place = self.folded.find(needle, low, max(low, high))
            while place >= 0:
                hit = self.span(place, size)
                held = self.sections.holding(hit[0])
                if held is not None and hit[1] <= held["char_end"]:
                    return self.found(*hit, "range")
                place = self.folded.find(needle, place + 1, high)
        held = explicit or self.sections.holding(start)
        if held is None:
            return None, None, "none", "no_section", None, None
        low, high, claimed = self.down(held["char_start"]), self.down(held["char_end"]), self.down(max(0, min(start, self.length)))
        # the nearest hit is the last one that starts before the claimed start or the first one that doesn't
        before, after = self.folded.rfind(needle, low, max(low, min(high, claimed - 1 + size))), self.folded.find(needle, max(low, claimed), max(low, high))
        hits = [self.span(x, size) for x in (before, after) if x >= 0]
        if not hits:
            return None, None, "none", "not_found_in_section", None, None
        return self.found(*min(hits, key=lambda h: (abs(h[0] - start), h[0])), "section")

    def found(self, start: int, end: int, method: str) -> tuple:
        held, page = self.sections.holding(start), self.pages.holding(start)
        return start, end, method, None, held and held["section"], page and page["page"]


def gathered(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """One row for each document with its rows as a list."""
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias(name))


def grounded_in_sections(claims: DataFrame, texts: DataFrame, sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Claims (claim, doc_id, span, claimed_start, claimed_end, section) to their place in the text, or why they have none.

    White space is folded in spans and texts. First the claimed range is
    searched, then the section that is named or else holds the claimed start,
    for the occurrence nearest to that start, ties earlier. No occurrence
    crosses a section's bound; a known section that is named also bounds the
    range. Documents without sections ground nothing.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, parts, sheets, asked in zip(*(c.to_pylist() for c in batch.columns)):
                grounder = Grounder(text or "", parts or [], sheets or [])
                for c in asked:
                    start = -1 if c["claimed_start"] is None else c["claimed_start"]
                    end = -1 if c["claimed_end"] is None else c["claimed_end"]
                    out.append((c["claim"], doc, *grounder.ground(c["span"], start, end, c["section"])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * len(GROUNDED), GROUNDED.types)], schema=GROUNDED)

    asked = ("claim", "span", "claimed_start", "claimed_end", "section")
    rows = gathered(claims.where("doc_id IS NOT NULL"), "claims", *asked).join(texts, "doc_id", "left")
    rows = rows.join(gathered(sections, "sections", "section", "char_start", "char_end"), "doc_id", "left")
    rows = rows.join(gathered(pages, "pages", "page", "char_start", "char_end"), "doc_id", "left").select("doc_id", "text", "sections", "pages", "claims")
    # claims without a document stay apart: they have no text, and one filter for all inputs lets them share an exchange
    lost = claims.where("doc_id IS NULL").select("doc_id", F.array(F.struct(*asked)).alias("claims"))
    schema = "claim long, doc_id long, char_start long, char_end long, method string, failure string, section string, page long"
    return rows.unionByName(lost, allowMissingColumns=True).mapInArrow(kernel, schema)


def passages(benchmark: DataFrame, docs: DataFrame, words: int = 4) -> DataFrame:
    """Which documents hold a passage verbatim, and where first. Passages meet documents by whole words, then the text decides.

    A passage may start and end within a word, so its key is what follows its
    first word, `words` words at most and never its last one. A passage of one
    or two words has no such key and is looked for in every document.
    """

    def split(text: str) -> Column:
        return F.split(F.regexp_replace(text, "\n", " "), " ")

    def gram(tokens: str, at, size) -> Column:
        return F.array_join(F.slice(tokens, at, size), " ")

    def grams_of(size: int):
        return lambda i: gram("_w", i, F.lit(size))

    split_up = benchmark.where("text IS NOT NULL").select("item_id", F.col("text").alias("passage"), split("text").alias("_w"))
    sized = split_up.withColumn("_size", F.least(F.lit(words), F.greatest(F.lit(0), F.size("_w") - 2)))
    keyed = sized.select("item_id", "passage", "_size", gram("_w", F.lit(2), F.col("_size")).alias("_key"))
    # a bounded fact, words + 1 values at most: documents get grams only of sizes that a passage has
    sizes = sorted(r["_size"] for r in keyed.select("_size").distinct().collect())
    tokens = docs.select("doc_id", split("text").alias("_w"))
    place = F.expr("instr(text, passage) - 1").cast("long")
    found = []
    for size in filter(None, sizes):
        starts = F.sequence(F.lit(1), F.size("_w") - size + 1)
        grams = tokens.where(F.size("_w") >= size).select("doc_id", F.explode(F.array_distinct(F.transform(starts, grams_of(size)))).alias("_g"))
        keys = keyed.where(F.col("_size") == size).select("item_id", "_key")
        found.append(grams.join(F.broadcast(keys), F.col("_g") == F.col("_key")).select("doc_id", "item_id"))
    rows = docs.select("doc_id", "text")
    out = [keyed.where("_size = 0").select("item_id", "passage").join(rows, F.expr("contains(text, passage)")).select("item_id", "doc_id", place.alias("char_start"))] if 0 in sizes else []
    if found or not out:
        pairs = reduce(DataFrame.unionByName, found) if found else rows.join(keyed.select("item_id"), F.lit(False)).select("doc_id", "item_id")
        full = pairs.distinct().join(rows, "doc_id").join(keyed.select("item_id", "passage"), "item_id")
        out.append(full.withColumn("char_start", place).where("char_start >= 0").select("item_id", "doc_id", "char_start"))
    return reduce(DataFrame.unionByName, out)
