"""Documents, proposals and quotes laid over the tables for the verification queries, and their oracles.

Each row takes one form of a list; a form says what the text is and what must
come out. The Spark side sees only texts; the SQL side only forms and columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions import numbers
from groundline.operators import findings, ingest, proposals
from groundline.operators.lookup import Book
from groundline.plans.overlay import Graph, stored
from groundline.plans.overlay_sql import with_overlay
from groundline.plans.views_sql import VIEWS

DAY = "MMMM d, yyyy"
#: (text, construction, relation, sign, unit, trigger kind, name, reason); N is the count, S the count in words.
TIMED = (
    ("Pay within N business days after written notice.", "within_business_days", "lte", 0, "business", "notice", None, "business_days"),
    ("Pay within S (N) days following receipt of an invoice.", "within_after", "lte", 1, "calendar", "invoice", None, None),
    ("Pay no later than S calendar days after the Commencement Date.", "no_later_than_after", "lte", 1, "calendar", "defined_event", "Commencement Date", None),
    ("Give it at least N months prior to expiration of the Term.", "count_prior_to", "lte", -1, "months", "term_end", None, "unsupported_unit"),
    ("Pay on or before June 30, 2020, or else.", "on_or_before", "lte", 0, None, None, None, "anchor_not_found"),
    ("Pay on the Rent Commencement Date.", "on_defined", "eq", 0, None, "defined_event", "Rent Commencement Date", None),
    ("If Tenant moves within N days after notice, Landlord may act.", "within_after", "lte", 1, "calendar", "notice", None, "conditional_or_compound"),
    ("Pay upon the earlier to occur of demand or completion.", "upon", "eq", 0, None, "demand", None, "conditional_or_compound"),
    ("Pay before the first day; rent is paid per month.", "prior_to", "lt", 0, None, "other_event", None, "recurring_schedule"),
    ("Pay within [***] days after delivery.", "within_after", "lte", 0, "calendar", "completion", None, "redacted_offset"),
    ("Pay promptly, as provided in Section 4.1.", None, None, 0, None, None, None, "cross_reference"),
    ("Pay until the work is done.", None, None, 0, None, None, None, "anchor_not_found"),
    ("Pay in the month that starts with surrender.", None, None, 0, None, "term_end", None, "month_granularity"),
    ("Pay annually.", None, None, 0, None, None, None, None),
    ("Pay after a sunny day.", "after", "gt", 0, None, "other_event", None, None),
    ("Pay upon Substantial  Completion.", "upon", "eq", 0, None, "completion", None, None),
    ("Pay within N hours of a breach.", "within_after", "lte", 1, "hours", "default", None, "unsupported_unit"),
    ("Pay on the Commencement Date Conditions.", None, None, 0, None, None, None, None),
    ("(a) In the event of loss, pay within S days from demand.", "within_after", "lte", 1, "calendar", "demand", None, None),
    ("Pay no later than the Outside Completion Date.", "no_later_than", "lte", 0, None, "defined_event", "Outside Completion Date", None),
    ("Pay within N days\nafter the Effective Date.", "within_after", "lte", 1, "calendar", "defined_event", "Effective Date", None),
    ("Pay following the Effective Date.", "after", "gt", 0, None, "defined_event", "Effective Date", None),
    ("Pay before January 5 of the year.", "prior_to", "lt", 0, None, None, None, "anchor_not_found"),
    ("Pay pursuant to Section 12 within N days after notice.", "within_after", "lte", 1, "calendar", "notice", None, "cross_reference"),
    ("In the event that it rains, pay N days before the Effective Date.", "count_prior_to", "lte", -1, "calendar", "defined_event", "Effective Date", None),
)
NAMES = ("Effective Date", "Commencement  Date", "Outside Completion Date", "Rent Commencement Date")

#: (kind, new, old, label, old value, new value, outcome, correction, label out, resolution, old origin).
#: new and old name a part of a line; old is own:, base: or another document's; "" is absent.
FOUND = (
    ("supersedes", "P4", "base:P1", None, None, None, "kept", None, "Section 1 of the Original Lease", "section", "chain"),
    ("shifted_date", "P2", "base:P2", None, "day", "day", "kept", None, None, None, "chain"),
    ("price_change", "P3", "", None, None, "amount", "kept", None, None, None, "unresolved"),
    ("potential_conflict", "P9", "base:P1", None, None, None, "kept", None, None, None, "chain"),
    ("merges", "P9", "", None, None, None, "unknown_kind", None, None, None, None),
    ("supersedes", "gone:P4", "", None, None, None, "unknown_segment", None, None, None, None),
    ("supersedes", "none", "", None, None, None, "not_found_in_section", None, None, None, None),
    ("supersedes", "P4", "-1:P1", None, None, None, "old_doc_not_in_chain", None, None, None, None),
    ("supersedes", "P4", "base:", None, None, None, "old_side_incomplete", None, None, None, None),
    ("supersedes", "P4", "base:none", None, None, None, "not_found_in_section", None, None, None, None),
    ("supersedes", "P4", "", "Section 77", None, None, "target_label_not_in_quote", None, None, None, None),
    ("supersedes", "P9", "", None, None, None, "target_label_required", None, None, None, None),
    ("supersedes", "P6", "base:P1", None, None, None, "target_not_in_corpus", None, None, None, None),
    ("supersedes", "P5", "base:P1", None, None, None, "target_section_mismatch", None, None, None, None),
    ("supersedes", "P8", "base:P1", None, None, None, "target_clause_unresolved", None, None, None, None),
    ("supersedes", "P7", "base:P1", None, None, None, "kept", None, "Exhibit “B” to the Original Lease", "range", "chain"),
    ("supersedes", "P7", "self:P1", None, None, None, "target_range_mismatch", None, None, None, None),
    ("supersedes", "P9", "", "Nothing", None, None, "no_supersession_cue", None, None, None, None),
    ("supersedes", "P4", "", None, None, "1", "values_forbidden", None, None, None, None),
    ("shifted_date", "P2", "", None, None, "day", "old_side_required", None, None, None, None),
    ("shifted_date", "P1", "base:P2", None, "day", "day", "date_token_count", None, None, None, None),
    ("shifted_date", "P2", "base:P2", None, "day", "1900-01-01", "new_value_not_in_quote", None, None, None, None),
    ("shifted_date", "P2", "base:P2", None, "1900-01-01", "day", "old_value_not_in_quote", None, None, None, None),
    ("shifted_date", "P2", "self:P2", None, "day", "day", "dates_equal", None, None, None, None),
    ("shifted_date", "date", "base:P2", None, "day", "day", "date_role_outside_quote", None, None, None, None),
    ("shifted_date", "P3", "base:P2", None, "day", "day5", "date_role_mismatch", None, None, None, None),
    ("shifted_date", "P2", "self:P10", None, "day9", "day", "old_state_cue_missing", None, None, None, None),
    ("price_change", "P3", "", None, None, "$0.01", "new_value_not_in_quote", None, None, None, None),
    ("price_change", "P3", "base:P1", None, "1", "amount", "old_value_forbidden", None, None, None, None),
    ("price_change", "P3", "base:P1", None, None, "amount", "old_side_forbidden", None, None, None, None),
    ("price_change", "P3", "", "context", None, "amount", "context_not_found", None, None, None, None),
    ("potential_conflict", "P9", "", None, None, None, "old_side_required", None, None, None, None),
    ("potential_conflict", "P9", "self:P1", None, None, None, "old_side_forbidden", None, None, None, None),
    ("potential_conflict", "P9", "base:P1", None, "1", None, "values_forbidden", None, None, None, None),
    ("supersedes", "P4", "", None, None, None, "kept", None, "Section 1 of the Original Lease", "section", "unresolved"),
    ("price_change", "P3", "", "elsewhere", None, "amount", "kept", "target_label_not_in_quote", None, None, "unresolved"),
    ("supersedes", "P6", "", None, None, None, "kept", None, "Section 2 of the Side Letter", "unresolved", "unresolved"),
    ("supersedes", "P8", "", None, None, None, "kept", None, "Table 7 of the Original Lease", "document", "unresolved"),
    ("supersedes", "P11", "", None, None, None, "kept", None, "Item 5 of the Basic Lease Information", "document", "unresolved"),
)
#: (kind, span, values, outcome, corrections, where it goes wrong by the line's place).
PROPOSED = (
    ("obligation", "P3", {"type": "t1", "amount": "right", "currency": "USD", "due_date": "day5", "status": "active"}, "verified", ""),
    ("clause", "P3", {}, "bad_enum:kind", None),
    ("obligation", "P3", {}, "missing_field:type", None),
    ("obligation", "P3", {"type": "t99"}, "bad_enum:type", None),
    ("event", "P3", {}, "missing_field:name", None),
    ("party", "P13", {"name": "Acme Group"}, "missing_field:role", None),
    ("party", "P13", {"name": "Acme Group", "role": "king"}, "bad_enum:role", None),
    ("obligation", "gone:P3", {"type": "t1"}, "unknown_segment", None),
    ("obligation", "none", {"type": "t1"}, "not_found_in_section", None),
    ("obligation", "two", {"type": "t1"}, "multi_segment_evidence", None),
    ("obligation", "p0002:P1", {"type": "t1", "status": "active"}, "verified", "segment_id:relocated"),
    ("event", "P10", {"name": "it  MAY end", "date": "day9", "status": "active"}, "verified", "date:date_not_bound_to_event"),
    ("event", "P10", {"name": "Party", "status": "active"}, "event_name_not_in_quote", None),
    ("event", "P12", {"name": "Closing Day", "date": "day11", "status": "active"}, "verified", ""),
    ("party", "P13", {"name": "Acme Group", "role": "tenant"}, "verified", ""),
    ("party", "P13", {"name": "Acme Group", "role": "landlord"}, "role_not_bound_to_name", None),
    ("party", "P13", {"name": "Beta", "role": "tenant"}, "party_name_not_in_quote", None),
    ("obligation", "P3", {"type": "t1", "amount": "wrong", "currency": "USD", "status": "active"}, "verified", "amount:amount_not_in_quote,currency:currency_without_amount"),
    ("obligation", "P3", {"type": "t1", "due_date": "day9", "status": "active"}, "verified", "due_date:due_date_not_in_quote"),
    ("obligation", "P14", {"type": "t2", "offset": 10, "anchor": "closing day", "status": "active"}, "verified", ""),
    ("obligation", "P14", {"type": "t2", "offset": 10, "status": "active"}, "verified", "offset_days:unpaired_offset"),
    ("obligation", "P14", {"type": "t2", "anchor": "Closing Day", "status": "active"}, "verified", "anchor_event:anchor_without_offset"),
    ("obligation", "P14", {"type": "t2", "offset": 11, "anchor": "Opening", "status": "active"}, "verified", "offset_days:offset_not_in_quote,anchor_event:anchor_not_in_quote"),
    ("obligation", "P3", {"type": "t3", "trigger": "is  due by", "status": "active"}, "verified", ""),
    ("obligation", "P3", {"type": "t3", "trigger": "Is due by", "status": "active"}, "verified", "trigger:trigger_not_in_quote"),
    ("obligation", "P3", {"type": "t3", "owed_by": "Nobody Inc", "owed_to": "Tenant", "status": "active"}, "verified", "owed_by:party_not_in_agreement"),
    ("obligation", "P9", {"type": "t4", "description": "All is as it was.", "status": "active"}, "verified", "description:paraphrase_replaced_by_quote"),
    ("obligation", "P9", {"type": "t4", "description": "Nothing  changes\nhere.", "status": "redacted"}, "verified", "status:model_status_overridden"),
    ("obligation", "P15", {"type": "t5", "due_date": "day5", "offset": 3, "anchor": "Closing Day", "status": "active"}, "verified", "offset_days:deadline_conflict"),
    ("obligation", "P2", {"type": "t6", "status": "active"}, "verified", ""),
)
PROPOSED_TYPES = ("t1", "t2", "t3", "t4", "t5", "t6")
PROPOSED_TWICE = 29
COPIED = 34  # every row of this form is proposed twice


def _pick(form: Column, values: list) -> Column:
    return F.get(F.array(*(v if isinstance(v, Column) else F.lit(v).cast("string") for v in values)), form)


class Contracts:
    """Agreements as documents: one segment for each line, in two sections, and findings proposed about them."""

    def __init__(self, g: Graph):
        self.g, self.spark, self.sf_dir, self.buckets = g, g.spark, g.sf_dir, g.buckets

    @stored("doc_id")
    def lines(self) -> DataFrame:
        at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("id")) - 1
        day = F.to_date("l_shipdate")
        amount = F.format_number(F.round(F.col("l_extendedprice") * 100).cast("long").cast("decimal(18,0)") / 100, 2)
        parts = {
            "P1": F.concat(F.lit("Item "), F.col("id").cast("string"), F.lit(" stays.")),
            "P2": F.concat(F.lit("The term shall currently expire on "), F.date_format(day, DAY), F.lit(".")),
            "P3": F.concat(F.lit("Rent of $"), amount, F.lit(" is due by "), F.date_format(F.date_add(day, 5), DAY), F.lit(".")),
            "P10": F.concat(F.lit("It may end on "), F.date_format(F.date_add(day, 9), DAY), F.lit(".")),
            "P4": F.lit("Section 1 of the Original Lease is hereby replaced."),
            "P5": F.lit("Section 9 of the Original Lease is deleted."),
            "P6": F.lit("Section 2 of the Side Letter is superseded."),
            "P7": F.lit("Exhibit “B” to the Original Lease is replaced."),
            "P8": F.lit("Table 7 of the Original Lease is deleted."),
            "P9": F.lit("Nothing changes here."),
            "P11": F.lit("Item 5 of the Basic Lease Information is deleted."),
            "P12": F.concat(F.lit("The “Closing Day” means "), F.date_format(F.date_add(day, 11), DAY), F.lit(".")),
            "P13": F.lit("It is made by Acme Group, a Utah corporation, as Tenant."),
            "P14": F.lit("Notice is due 10 days after the Closing  Day."),
            "P15": F.concat(F.lit("Pay by "), F.date_format(F.date_add(day, 5), DAY), F.lit(" or 3 days after the Closing Day.")),
        }
        rows = self.g.line.select("id", F.col("l_orderkey").alias("doc_id"), at.alias("at"), day.alias("day"), F.concat(F.lit("$"), amount, F.lit("/month")).alias("amount"), F.struct(*(v.alias(k) for k, v in parts.items())).alias("p"))
        return rows.withColumn("segment", F.format_string("p%04d", F.col("at") + 1))

    @stored("doc_id")
    def texts(self) -> DataFrame:
        line = self.lines.select("doc_id", F.col("at").alias("line"), F.array_join(F.array("p.*"), " ").alias("span"))
        spans = F.array_sort(F.collect_list(F.struct("line", "span")))
        return line.groupBy("doc_id").agg(F.array_join(F.transform(spans, lambda x: x["span"]), "\n").alias("text"))

    @stored("doc_id")
    def segments(self) -> DataFrame:
        section = F.when(F.col("at") == 0, "s0001").otherwise("s0002")
        return ingest.segments(self.texts).select("doc_id", "at", F.format_string("p%04d", F.col("at") + 1).alias("segment"), section.alias("section"), "char_start", "char_end")

    @property
    def book(self) -> Book:
        rows = self.segments
        number = F.when(F.col("section") == "s0001", "1").otherwise("4.2")
        heading = F.when(number == "1", "Basics").when(F.col("doc_id") % 10 == 7, "Table of Contents").otherwise("Terms")
        sections = rows.groupBy("doc_id", "section").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
        sections = sections.select("doc_id", "section", number.alias("number"), heading.alias("heading"), "char_start", "char_end")
        return Book(self.texts, rows.drop("at"), sections, ingest.pages(rows, size=3))

    @stored("run_id")
    def raw(self) -> DataFrame:
        base = self.g.agreement.where("base_agreement_id IS NOT NULL").select(F.col("agreement_id").alias("_a"), "base_agreement_id")
        first = self.lines.where("at = 0").select(F.col("doc_id").alias("_b"), F.col("p").alias("bp"), F.col("day").alias("base_day"))
        rows = self.lines.join(base, F.col("doc_id") == F.col("_a")).join(first, F.col("base_agreement_id") == F.col("_b"))
        form = (F.col("id") % len(FOUND)).cast("int")

        def part(name: str, own: str) -> Column:
            if name == "none":
                return F.lit("no such words")
            if name == "date":
                return F.concat(F.lit("on "), F.date_format("day", DAY), F.lit("."))
            return F.col(f"{own}.{name}") if name else F.lit(None).cast("string")

        def value(form_row: tuple, text: str | None, old: bool) -> Column:
            day = F.col("base_day") if old and form_row[2].startswith("base") else F.col("day")
            known = {"day": day, "day5": F.date_add(day, 5), "day9": F.date_add(day, 9)}
            return F.date_format(known[text], "yyyy-MM-dd") if text in known else F.col("amount") if text == "amount" else F.lit(text).cast("string")

        def old(f: tuple, i: int) -> Column:
            doc, _, name = f[2].partition(":")
            where = {"base": F.col("base_agreement_id").cast("string"), "self": F.lit("self"), "-1": F.lit("-1")}
            segment = F.when(F.lit(doc == "base"), "p0001").otherwise(F.col("segment"))
            got = (where[doc], segment, part(name, "bp" if doc == "base" else "p")) if f[2] else (F.lit(None).cast("string"),) * 3
            return got[i]

        news = [f[1].partition(":") for f in FOUND]
        columns = {
            "kind": [f[0] for f in FOUND],
            "new_segment": [F.lit("p9999") if n[0] == "gone" else F.col("segment") for n in news],
            "new_quote": [part(n[2] or n[0], "p") for n in news],
            "old_doc": [old(f, 0) for f in FOUND],
            "old_segment": [old(f, 1) for f in FOUND],
            "old_quote": [old(f, 2) for f in FOUND],
            "target_label": [None if f[3] == "context" else f[3] for f in FOUND],
            "old_value": [value(f, f[4], True) for f in FOUND],
            "new_value": [value(f, f[5], False) for f in FOUND],
            "context_segment": ["p9999" if f[3] == "context" else None for f in FOUND],
            "context_quote": ["x" if f[3] == "context" else None for f in FOUND],
        }
        found = rows.select((F.col("id") * 2).alias("finding"), F.col("doc_id").alias("run_id"), F.lit("all").alias("category"), (F.col("id") * 2).alias("ordinal"), *(_pick(form, v).alias(k) for k, v in columns.items()), form.alias("_form"))
        twice = found.where(F.col("_form") == COPIED).withColumns({"finding": F.col("finding") + 1, "ordinal": F.col("ordinal") + 1})
        return found.unionByName(twice).drop("_form")

    @stored("run_id")
    def verified(self) -> DataFrame:
        bases = self.g.agreement.where("base_agreement_id IS NOT NULL").select(F.col("base_agreement_id").alias("base_id")).distinct()
        names = F.array(F.struct(F.lit("Original Lease").alias("alias"), F.col("base_id").alias("doc")), F.struct(F.lit("Lease").alias("alias"), F.col("base_id").alias("doc")), F.struct(F.lit("Side Letter").alias("alias"), F.lit(None).cast("long").alias("doc")))
        aliases = bases.select("base_id", F.explode(names).alias("n")).select("base_id", "n.alias", "n.doc")
        none = F.lit(None).cast("string")
        entries = bases.select(F.col("base_id").alias("doc"), F.lit("now").alias("text_hash"), F.lit("Exhibit").alias("kind"), F.lit("B").alias("part"), none.alias("qualifier"), none.alias("parent"), F.lit("p0001").alias("first_segment"), F.lit("p0001").alias("last_segment"))
        heads = self.g.agreement.where("base_agreement_id IS NOT NULL").select(F.col("agreement_id").alias("run_id"), F.col("base_agreement_id").alias("base_id"))
        member = F.array(F.struct(F.col("run_id").alias("agreement_id"), F.lit("change_order").alias("role")), F.struct(F.col("base_id").alias("agreement_id"), F.lit("base").alias("role")))
        chain = heads.select("run_id", F.explode(member).alias("m")).select("run_id", "m.agreement_id", "m.role", F.lit("now").alias("text_hash"))
        return findings.verified_findings(self.raw, chain, self.book, aliases, entries)


    @stored("doc_id")
    def proposals(self) -> DataFrame:
        """One proposal about each line."""
        rows = self.lines
        form = (F.col("id") % len(PROPOSED)).cast("int")
        cents = F.regexp_replace("amount", "[^0-9]", "").cast("long")
        day = lambda n: F.date_format(F.date_add("day", n), "yyyy-MM-dd")
        known = {"day5": day(5), "day9": day(9), "day11": day(11), "right": cents, "wrong": cents + 1}

        def span(name: str) -> Column:
            if name == "none":
                return F.lit("no such words")
            if name == "two":
                return F.concat(F.lit("days after the Closing Day. Item "), (F.col("id") + 1).cast("string"))
            return F.col(f"p.{name}")

        parts = [f[1].rpartition(":") for f in PROPOSED]
        field = lambda name: [known.get(v, F.lit(v)) if (v := f[2].get(name)) is not None else F.lit(None) for f in PROPOSED]
        texts = ("type", "name", "role", "status", "owed_by", "owed_to", "description", "currency", "due_date", "trigger", "date")
        columns = {
            "kind": _pick(form, [f[0] for f in PROPOSED]),
            "segment": _pick(form, [{"": F.col("segment"), "gone": "p9999", "p0002": "p0002"}[p[0]] for p in parts]),
            "span_text": _pick(form, [span(p[2]) for p in parts]),
            **{t: _pick(form, [v.cast("string") for v in field(t)]) for t in texts},
            "anchor_event": _pick(form, [v.cast("string") for v in field("anchor")]),
            "amount_cents": F.get(F.array(*(v.cast("long") for v in field("amount"))), form),
            "offset_days": F.get(F.array(*(v.cast("int") for v in field("offset"))), form),
        }
        found = rows.select((F.col("id") * 2).alias("item"), "doc_id", (F.col("id") * 2).alias("ordinal"), *(v.alias(k) for k, v in columns.items()), form.alias("_form"))
        twice = found.where(F.col("_form") == PROPOSED_TWICE).withColumns({"item": F.col("item") + 1, "ordinal": F.col("ordinal") + 1})
        return found.unionByName(twice).drop("_form")

    @stored("doc_id")
    def judged(self) -> DataFrame:
        return proposals.verified(self.proposals, self.book, PROPOSED_TYPES)


def timed_quotes(g: Graph) -> DataFrame:
    """id, agreement_id, quote, legacy_due: timing clauses in every form."""
    n = (F.col("l_quantity").cast("int") % 120 + 1).cast("int")
    text = F.get(F.array(*(F.lit(t[0]) for t in TIMED)), (F.col("id") % len(TIMED)).cast("int"))
    quote = F.replace(F.replace(text, F.lit("N "), F.concat(n.cast("string"), F.lit(" "))), F.lit("S "), F.concat(numbers.in_words(n), F.lit(" ")))
    quote = F.replace(quote, F.lit("(N)"), F.concat(F.lit("("), n.cast("string"), F.lit(")")))
    return g.line.select("id", F.col("l_orderkey").alias("agreement_id"), quote.alias("quote"), F.when(F.col("l_linenumber") == 5, F.lit("1900-01-01").cast("date")).alias("legacy_due"))


def anchors(g: Graph) -> DataFrame:
    """Dated events that lines declare for their agreement, under one of four names."""
    return g.line.where("l_suppkey % 3 = 0").select(F.col("l_orderkey").alias("agreement_id"), _pick((F.col("l_partkey") % len(NAMES)).cast("int"), list(NAMES)).alias("name"), F.to_date(F.date_trunc("year", "l_shipdate")).alias("date"))


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


def sql(query: str) -> str:
    extra = {
        "form_t": f"SELECT * FROM (VALUES {_values([(i, *t[1:]) for i, t in enumerate(TIMED)])}) AS t(form, construction, relation, sign, unit, trigger_kind, bound_name, reason)",
        "timed_q": f"""
SELECT l.id, l.l_orderkey AS agreement_id, f.*, CASE WHEN sign <> 0 THEN sign * (CAST(l_quantity AS INT) % 120 + 1) END AS "offset", CASE WHEN l_linenumber = 5 THEN DATE '1900-01-01' END AS legacy_due
FROM line l JOIN form_t f ON f.form = l.id % {len(TIMED)}""",
        "named_dates": f"""
SELECT l_orderkey AS agreement_id, (['{"', '".join(" ".join(n.split()) for n in NAMES)}'])[l_partkey % {len(NAMES)} + 1] AS name, CAST(date_trunc('year', l_shipdate) AS DATE) AS date FROM lineitem WHERE l_suppkey % 3 = 0""",
        "candidates": """
SELECT agreement_id, name, min(date) AS low, max(date) AS high FROM (
SELECT * FROM named_dates UNION ALL SELECT a.agreement_id, d.name, d.date FROM named_dates d JOIN agreement a ON a.base_agreement_id = d.agreement_id) GROUP BY 1, 2""",
        "form_p": f"SELECT * FROM (VALUES {_values([(i, f[0], *f[3:], int(f[1].startswith('p0002')), int(f[1] == 'two'), int(f[1].startswith('gone'))) for i, f in enumerate(PROPOSED)])}) AS t(form, kind, outcome, corrections, moved, two, gone)",
        "judged_p": f"""
SELECT l.id * 2 AS item, l.l_orderkey AS doc_id, f.form, f.kind, n, k, CAST(l_shipdate AS DATE) AS day, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
       CASE WHEN outcome LIKE 'bad_enum%' OR outcome LIKE 'missing_field%' OR gone = 1 OR outcome = 'not_found_in_section' THEN outcome
            WHEN moved = 1 AND n = 1 THEN 'unknown_segment' WHEN moved = 1 AND k = 0 THEN 'not_found_in_section' WHEN two = 1 AND (k = 0 OR k = n - 1) THEN 'not_found_in_section'
            WHEN two = 1 THEN 'multi_segment_evidence' WHEN k > 0 AND l.l_orderkey % 10 = 7 THEN 'toc_evidence' ELSE outcome END AS outcome,
       CASE WHEN moved = 1 AND k = 1 THEN '' ELSE corrections END AS corrections
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM line) l JOIN form_p f ON f.form = l.id % {len(PROPOSED)}""",
        "judged_all": f"SELECT * FROM judged_p UNION ALL SELECT * REPLACE (item + 1 AS item, CASE WHEN outcome = 'verified' THEN 'duplicate' ELSE outcome END AS outcome) FROM judged_p WHERE form = {PROPOSED_TWICE}",
        "form_f": f"SELECT * FROM (VALUES {_values([(i, f[0], f[5], *f[6:]) for i, f in enumerate(FOUND)])}) AS t(form, kind, claimed, outcome, correction, label, resolution, old_origin)",
        "proposed": f"""
SELECT l.id * 2 AS finding, l.l_orderkey AS run_id, f.*, CAST(l.l_shipdate AS DATE) AS day, b.day AS base_day, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
FROM line l JOIN agreement a ON a.agreement_id = l.l_orderkey JOIN form_f f ON f.form = l.id % {len(FOUND)}
JOIN (SELECT l_orderkey, min_by(CAST(l_shipdate AS DATE), id) AS day FROM line GROUP BY 1) b ON b.l_orderkey = a.base_agreement_id""",
        "decided": """
SELECT * REPLACE (CASE WHEN outcome IN ('date_role_outside_quote') AND day = base_day OR outcome = 'date_role_mismatch' AND day + 5 = base_day OR kind = 'shifted_date' AND outcome = 'kept' AND day = base_day THEN 'dates_equal' ELSE outcome END AS outcome) FROM proposed""",
    }
    return with_overlay(query, extra)


_KEPT = "CASE WHEN outcome = 'kept' THEN"
ORACLES = {
    "t02_parsed_timing": sql('SELECT id, construction, relation, "offset", unit, trigger_kind, bound_name, reason FROM timed_q'),
    "t10_resolved_timing": sql(
        "SELECT id, kind, CASE WHEN kind = 'unresolved' THEN why END AS why, CASE WHEN kind = 'scheduled' THEN low + coalesce(\"offset\", 0) END AS bound FROM ("
        "SELECT *, CASE WHEN construction IS NULL AND reason IS NULL THEN 'untimed' WHEN why IS NOT NULL THEN 'unresolved' WHEN bound_name IS NOT NULL AND relation <> 'gt' THEN 'scheduled' ELSE 'contingent' END AS kind FROM ("
        "SELECT q.*, c.low, CASE WHEN reason IS NOT NULL THEN reason WHEN bound_name IS NULL OR relation = 'gt' THEN NULL WHEN c.low <> c.high THEN 'conflicting_dates' WHEN c.low IS NULL THEN 'anchor_without_date' "
        "WHEN legacy_due <> c.low + coalesce(\"offset\", 0) THEN 'conflicting_dates' END AS why FROM timed_q q LEFT JOIN candidates c ON c.agreement_id = q.agreement_id AND c.name = q.bound_name))"
    ),
    "c05_verified_findings": sql(
        f"SELECT finding, run_id, kind, outcome, {_KEPT} correction END AS correction, {_KEPT} label END AS label, {_KEPT} resolution END AS resolution, {_KEPT} old_origin END AS old_origin, "
        f"CASE WHEN outcome = 'kept' AND kind = 'shifted_date' THEN strftime(day, '%Y-%m-%d') WHEN outcome = 'kept' AND kind = 'price_change' THEN CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS new_value, "
        f"CASE WHEN outcome = 'kept' AND kind = 'shifted_date' THEN CAST(day - base_day AS INT) END AS delta FROM decided "
        f"UNION ALL SELECT finding + 1, run_id, kind, 'duplicate', NULL, NULL, NULL, NULL, NULL, NULL FROM decided WHERE form = {COPIED}"
    ),
    "v17_verified": sql(
        "SELECT item, kind, outcome, CASE WHEN outcome IN ('verified', 'duplicate') THEN corrections END AS corrections, CASE WHEN outcome = 'verified' AND form = 0 THEN price END AS cents, "
        "CASE WHEN outcome = 'verified' AND form IN (0, 28) THEN day + 5 END AS due, CASE WHEN outcome = 'verified' AND form = 19 THEN 10 END AS offset_days, "
        "CASE WHEN outcome = 'verified' AND form = 13 THEN day + 11 END AS date, CASE WHEN outcome = 'verified' AND form = 23 THEN 'is due by' END AS trigger FROM judged_all"
    ),
    "v18_rates": sql(
        "SELECT kind, count(*) FILTER (outcome <> 'duplicate') AS proposed, count(*) FILTER (outcome = 'verified') AS verified, count(*) FILTER (outcome = 'verified') / nullif(count(*) FILTER (outcome <> 'duplicate'), 0) AS rate FROM judged_all GROUP BY kind"
    ),
    "v18_reasons": sql(
        "SELECT 'drop' AS what, outcome AS reason, count(*) AS items FROM judged_all WHERE outcome NOT IN ('verified', 'duplicate') GROUP BY 2 "
        "UNION ALL SELECT 'correction', reason, count(*) FROM (SELECT unnest(string_split(corrections, ',')) AS reason FROM judged_all WHERE outcome = 'verified' AND corrections <> '') GROUP BY 2"
    ),
    "c05_outcomes": sql(
        f"SELECT kind, outcome, count(*) AS findings, count(correction) AS corrected FROM (SELECT kind, outcome, {_KEPT} correction END AS correction FROM decided UNION ALL SELECT kind, 'duplicate', NULL FROM decided WHERE form = {COPIED}) GROUP BY 1, 2"
    ),
    **{
        name: sql(f"SELECT finding, outcome, {columns} FROM (SELECT finding, kind, outcome, form, label, resolution, day, base_day, cents, old_origin FROM decided UNION ALL SELECT finding + 1, kind, 'duplicate', form, NULL, NULL, NULL, NULL, NULL, NULL FROM decided WHERE form = {COPIED}) WHERE kind = '{kind}'")
        for name, kind, columns in (
            ("c06_supersedes", "supersedes", f"{_KEPT} label END AS label, {_KEPT} resolution END AS resolution"),
            ("c07_shifted_dates", "shifted_date", f"{_KEPT} strftime(day, '%Y-%m-%d') END AS new_value, {_KEPT} CAST(day - base_day AS INT) END AS delta"),
            ("c09_price_changes", "price_change", f"{_KEPT} CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS new_value, {_KEPT} 'USD' END AS currency"),
            ("c10_potential_conflicts", "potential_conflict", f"{_KEPT} old_origin END AS old_origin"),
        )
    },
    "m06_eight_fields": (
        "SELECT field, count(*) FILTER (g) AS gold_known, count(*) FILTER (p) AS pred_known, count(*) FILTER (g AND p) AS both_known, count(*) FILTER (g AND p AND same) AS both_known_equal, "
        "count(*) FILTER (g AND p AND same) / nullif(count(*) FILTER (g AND p), 0) AS accuracy_on_known, count(*) FILTER (g AND p) / nullif(count(*) FILTER (g), 0) AS coverage FROM ("
        + " UNION ALL ".join(
            f"SELECT '{f}' AS field, l_partkey % {i + 2} <> 0 AS g, l_suppkey % {i + 3} <> 0 AS p, l_linenumber <> {i % 7 + 1} AS same FROM lineitem"
            for i, f in enumerate(("owed_by", "owed_to", "amount", "currency", "due_date", "offset_days", "anchor_event", "status"))
        )
        + ") GROUP BY field"
    ),
    "m08_predictions": with_overlay(
        "SELECT o.id, o.agreement_id, o.type, c.ref_id, c.char_start, c.char_end, (SELECT min(name) FROM seen_party p WHERE p.agreement_id = o.agreement_id AND p.party_id = o.owed_by) AS owed_by, "
        "(SELECT min(name) FROM seen_party p WHERE p.agreement_id = o.agreement_id AND p.party_id = o.owed_to) AS owed_to, o.cents, o.due_date, o.offset_days, o.anchor_agreement AS anchor_event, o.status "
        "FROM seen_obligation o JOIN own_ref c ON c.obligation_id = o.id QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY c.ref_id) = 1",
        VIEWS,
    ),
    "m16_paired_runs": with_overlay(
        "SELECT run_id AS change_order, CASE WHEN run_id % 7 = 0 THEN 'stale_change_run' WHEN run_id % 5 = 0 OR run_id % 11 = 0 OR run_id % 13 = 0 THEN 'unmatched_pair' END AS fault, "
        "CASE WHEN run_id % 7 <> 0 AND run_id % 5 <> 0 AND run_id % 11 <> 0 AND run_id % 13 <> 0 THEN run_id * 2 END AS ungated, CASE WHEN run_id % 7 <> 0 AND run_id % 5 <> 0 AND run_id % 11 <> 0 AND run_id % 13 <> 0 THEN run_id * 2 + 1 END AS gated FROM change_run"
    ),
    "e03_attempts": with_overlay(
        "SELECT id, at_ AS \"at\", CASE WHEN l_linenumber > 1 AND at_ > 0 THEN 'm' || (at_ + 1) ELSE 'main' END AS model, CAST(l_quantity AS BIGINT) AS input, CASE WHEN l_linenumber > 1 THEN at_ + 1 ELSE 0 END + l_linenumber AS output, at_ < greatest(l_linenumber - 1, 1) - 1 AS refused "
        "FROM (SELECT *, unnest(range(0, greatest(l_linenumber - 1, 1))) AS at_ FROM line)"
    ),
    "w10_site_pins": with_overlay("SELECT CASE WHEN id % 5 <> 0 THEN 'site_pin_invalid' END AS fault, count(*) AS pins FROM line GROUP BY 1"),
}
