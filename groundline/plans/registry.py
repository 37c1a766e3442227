"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F
from pyspark.sql import Window

from groundline.functions import numbers, stats
from groundline.functions import text as T
from groundline.operators import binding, change, evaluation, findings, ingest, metrics, proposals, read, records, rules, snapshot, timing, views
from groundline.plans import change_sql, fixtures, read_sql, text_sql, views_sql
from groundline.operators.lookup import holding
from groundline.plans.overlay import Graph


def _graph(f: Callable[[Graph], DataFrame], *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Graph(spark, sf_dir)).select(*columns) if columns else f(Graph(spark, sf_dir))


VIEWS = {
    "d01_fresh_change_run": _graph(views.fresh_change_run),
    "d02_eligible_supersedes": _graph(views.eligible_supersedes),
    "d03_grounded_obligation": _graph(views.grounded_obligation, "id", "agreement_id", "type", "cents", "status", "due_date", "offset_days"),
    "d04_visible_timing": _graph(views.visible_obligation_timing),
    "d05_visible_obligation": _graph(views.visible_obligation),
    "d06_visible_supersedes": _graph(views.visible_supersedes),
    "d07_visible_guarantees": _graph(views.visible_guarantees),
    "d08_visible_triggers": _graph(views.visible_triggers),
    "d09_defined_term": _graph(views.visible_defined_term),
    "d09_party_binding": _graph(views.visible_party_binding),
    "d10_visible_finding": _graph(views.visible_change_finding, "finding_id", "run_id", "kind", "category", "old_origin", "new_ref", "old_ref"),
    "d11_obligation_clause": _graph(views.visible_obligation_clause),
    "d12_event_binding": _graph(views.visible_event_binding),
    "d12_site_binding": _graph(views.visible_site_binding),
    "d13_finding_refs": _graph(views.visible_change_finding_ref),
    "d14_citation_violations": _graph(views.citation_violations),
    "d15_constraint_violations": _graph(views.constraint_violations),
    "g07_ungrounded": _graph(views.ungrounded_visible),
}


AS_OF = "1997-01-01"
_ID = ("id", "agreement_id", "effective_due", "lifecycle")


def _place(rows: DataFrame) -> DataFrame:
    """The place of each row in the order of the read API, for a filtered listing."""
    order = Window.orderBy(F.col("effective_due").asc_nulls_last(), "agreement_id", "id")
    return rows.select("id", F.row_number().over(order).cast("long").alias("place"))


def _documents_to_resolve(g: Graph) -> DataFrame:
    c = g.table("customer").select(
        F.col("c_custkey").alias("doc"),
        F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("doc_key"),
        F.concat_ws("/", F.lit("data"), "c_mktsegment", (F.col("c_custkey") % 500).cast("string")).alias("path"),
        (F.col("c_custkey") % 700).cast("string").alias("name"),
        F.sha2("c_name", 256).alias("digest"),
    )
    wanted = c.select(F.explode(F.array("doc_key", "path", "name", "digest", F.concat(F.lit("none"), F.col("doc").cast("string")))).alias("text")).distinct()
    return read.resolve_document(c, wanted)


def _aliases(g: Graph) -> DataFrame:
    return read.unresolved_documents(g.table("documents"), ["License", "the and", "***", "Lizenz"])


READ = {
    "q01_list_agreements": _graph(read.list_agreements),
    "q02_page": _graph(lambda g: read.page(read.obligations(g, type_="t3"), 50, 100), *_ID),
    "q02_header": _graph(lambda g: read.page_header(read.obligations(g, type_="t3"), read.unresolved_parties(g, read.obligations(g, type_="t3")), 50, 100)),
    "q03_party_role": _graph(lambda g: read.obligations(g, party="Landlord"), *_ID),
    "q03_party_name": _graph(lambda g: read.obligations(g, party="00001"), *_ID),
    "q03_site": _graph(lambda g: read.obligations(g, site="Asia"), *_ID),
    "q04_order": _graph(lambda g: _place(read.obligations(g, type_="t5", status="redacted"))),
    "q05_unresolved": _graph(lambda g: read.unresolved_parties(g, read.obligations(g))),
    "q07_hydrated": _graph(lambda g: read.hydrated(g, read.obligations(g, type_="t2", include_superseded=True))),
    "q13_due_window": _graph(lambda g: read.due_window(g, AS_OF), "id", "agreement_id", "lifecycle", "due"),
    "q13_due_window_party": _graph(lambda g: read.due_window(g, AS_OF, party="provider"), "id", "agreement_id", "lifecycle", "due"),
    "q14_pending_partition": _graph(read.pending_partition),
    "q15_contingent_page": _graph(lambda g: read.pending_page(g, "contingent", 25, 10), *_ID),
    "q16_window_unresolved": _graph(lambda g: read.window_unresolved(g, AS_OF)),
    "q17_resolve_document": _graph(_documents_to_resolve),
    "q18_run_status": _graph(read.run_status),
    "q21_grouped_findings": _graph(read.grouped_findings),
    "q22_new_obligations": _graph(read.new_obligations),
    "q23_unresolved_documents": _graph(_aliases),
}


def _lines(g: Graph) -> DataFrame:
    return ingest.segments(g.table("documents"))


def _marked(g: Graph) -> DataFrame:
    return ingest.sections(ingest.with_headings(_lines(g)))


def _term_quotes(g: Graph) -> DataFrame:
    c = g.table("customer")
    form = F.col("c_custkey") % 4
    return c.select(
        F.col("c_custkey").alias("id"),
        F.when(form == 0, F.concat(F.lit("The “"), "c_name", F.lit("” means this.")))
        .when(form == 1, F.concat(F.lit("A lease (the “Lease”) by “"), "c_name", F.lit("” and (“Tenant”) or (“Tenant”).")))
        .when(form == 2, F.concat(F.lit("“"), "c_name", F.lit("” is quoted only.")))
        .otherwise(F.lit("Nothing here."))
        .alias("quote"),
    )


def _claims(g: Graph) -> DataFrame:
    """Documents' whole lines, claimed to start elsewhere; every 5th has a wrong letter, every 50th is blank, some are wrapped, some name the first section or one that isn't there."""
    at = F.col("at")
    wrong = F.when(at % 50 == 49, F.lit(" \n")).when(at % 5 == 4, F.concat(F.lit("\u00a7"), F.substring("span", 2, 2**31 - 1))).when(at % 4 == 1, F.replace("span", F.lit(" "), F.lit(" \n"))).otherwise(F.col("span"))
    start = F.col("char_start") + F.when(at % 2 == 0, at * 7 % 40).otherwise(0)
    named = F.when(at % 3 == 1, F.lit("s0000")).when(at % 3 == 2, F.lit("none"))
    return _lines(g).select((F.col("doc_id") * 100000 + at).alias("claim"), "doc_id", wrong.alias("span"), start.alias("claimed_start"), (start + F.length("span")).alias("claimed_end"), named.alias("section"))


def _grounded(g: Graph) -> DataFrame:
    # the texts are put together from the lines, so that all is dealt out by doc_id once
    spans = F.array_sort(F.collect_list(F.struct("char_start", "span")))
    texts = _lines(g).groupBy("doc_id").agg(F.array_join(F.transform(spans, lambda x: x["span"]), "\n").alias("text"))
    order = Window.partitionBy("doc_id").orderBy("char_start")
    sections = ingest.section_intervals(_marked(g)).withColumn("section", F.format_string("s%04d", F.row_number().over(order) - 1))
    return rules.grounded_in_sections(_claims(g), texts, sections, ingest.pages(_lines(g)))


def _responses(g: Graph) -> DataFrame:
    form = F.col("l_partkey") % 7
    obj = F.struct(F.lit("obligation").alias("kind"), F.concat(F.lit("t"), F.col("l_partkey") % 9).alias("type"), F.col("l_quantity").alias("amount"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("due_date"), F.lit("s").alias("span"))
    body = F.to_json(obj)
    return g.line.select(
        "id",
        F.when(form == 0, "refusal").when(form == 1, "max_tokens").otherwise("end").alias("stop"),
        F.when(form == 2, F.lit("no json")).when(form == 3, F.replace(body, F.lit('"span"'), F.lit('"extra":1,"span"'))).when(form == 4, F.replace(body, F.lit("obligation"), F.lit("other"))).otherwise(body).alias("body"),
    )


def _offsets(g: Graph) -> DataFrame:
    found = g.table("documents").select("doc_id", F.posexplode(T.occurrences(F.col("text"), "License|[*#%]{3}|the [a-z]+")).alias("n", "o"))
    return found.select("doc_id", F.col("n").cast("long").alias("n"), F.col("o.start").alias("char_start"), F.col("o.match").alias("match"))


def _contracts(relation: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return _graph(lambda g: getattr(fixtures.Contracts(g), relation), *columns)


def _of_kind(kind: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return _graph(lambda g: fixtures.Contracts(g).verified.where(F.col("kind") == kind), "finding", "outcome", *columns)


def _lookups(g: Graph) -> DataFrame:
    """Which line and page of its document hold every 40th offset, counted from 7."""
    lines = _lines(g)
    ends = lines.groupBy("doc_id").agg(F.max("char_end").alias("total"))
    points = ends.select("doc_id", F.explode(F.expr("sequence(7L, total + 40, 40L)")).alias("offset"))
    found = holding(points, lines.select("doc_id", "char_start", "char_end", F.col("at").alias("segment")), "segment")
    return holding(found, ingest.pages(lines), "page")


def _spelled(g: Graph) -> DataFrame:
    n = g.spark.range(1, numbers.SPELLED_MAX + 1).select(F.col("id").cast("int").alias("n"))
    words = numbers.in_words(F.col("n"))
    return n.select("n", words.alias("words"), numbers.from_words(words).alias("back"))


def _formats(g: Graph) -> DataFrame:
    share = F.when(F.col("l_linenumber") != 3, F.col("l_linenumber") / 8)
    return g.line.select("id", numbers.percent(share).alias("percent"), numbers.dollars(share).alias("dollars"), numbers.ratio(share).alias("ratio"))


TEXT = {
    "f01_offsets": _graph(_offsets),
    "g05_g06_markers": _graph(lambda g: rules.quotes(g).select("id", T.is_redacted(F.col("quote")).alias("redacted"), T.is_blank(F.col("quote")).alias("blank"))),
    "g05_redacted_documents": _graph(lambda g: g.table("documents").where(T.is_redacted(F.col("text"))).select("doc_id")),
    "g03_grounded": _graph(_grounded),
    "g03_passages": _graph(lambda g: rules.passages(g.table("benchmark"), g.table("documents"))),
    "i01_html_lines": _graph(lambda g: ingest.html_lines(g.table("pages"))),
    "i02_folded": _graph(lambda g: g.table("documents").select("doc_id", T.line_folded(F.col("text")).alias("folded"))),
    "i05_segments": _graph(_lines, "doc_id", "at", "char_start", "char_end"),
    "i06_pages": _graph(lambda g: ingest.pages(_lines(g))),
    "i07_sections": _graph(lambda g: _marked(g).where("kind IS NOT NULL"), "doc_id", "at", "kind", "number", "heading"),
    "i09_carried": _graph(lambda g: ingest.carried(_marked(g))),
    "i10_contents_runs": _graph(lambda g: ingest.contents_runs(_marked(g))),
    "i11_section_intervals": _graph(lambda g: ingest.section_intervals(_marked(g))),
    "i14_structure_faults": _graph(lambda g: ingest.structure_faults(ingest.pages(_lines(g)))),
    "i15_defined_terms": _graph(lambda g: ingest.defined_terms(_term_quotes(g))),
    "i16_chunks": _graph(lambda g: ingest.chunks(_marked(g))),
    "e01_responses": _graph(lambda g: rules.parsed_responses(_responses(g))),
    "v17_verified": _contracts("judged", "item", "kind", "outcome", "corrections", "cents", "due", "offset_days", "date", "trigger"),
    "v18_rates": _graph(lambda g: proposals.rates(fixtures.Contracts(g).judged)),
    "v18_reasons": _graph(lambda g: proposals.dropped_and_corrected(fixtures.Contracts(g).judged)),
    "i13_lookups": _graph(_lookups),
    "v04_money": _graph(lambda g: rules.quotes(g).select("id", F.get(T.money(F.col("quote")), F.lit(0)).alias("cents"), F.size(T.money(F.col("quote"))).cast("long").alias("n"))),
    "v05_verified_fields": _graph(lambda g: rules.verified_fields(rules.quotes(g))),
    "t02_parsed_timing": _graph(lambda g: timing.parsed(fixtures.timed_quotes(g)), "id", "construction", "relation", "offset", "unit", "trigger_kind", "bound_name", "reason"),
    "t10_resolved_timing": _graph(lambda g: timing.resolved(timing.parsed(fixtures.timed_quotes(g)), timing.anchor_candidates(fixtures.anchors(g), g.agreement))),
    "f06_spelled": _graph(_spelled),
    "f11_formats": _graph(_formats),
}


def _section_quotes(g: Graph) -> DataFrame:
    rows = g.obligation.where("base_agreement_id IS NOT NULL")
    a, b = (F.col("id") % 7).cast("string"), (F.col("supplier") % 7).cast("string")
    return rows.select("id", F.col("base_agreement_id").alias("base_id"), F.concat(F.lit("As in Sections "), a, F.lit(" and "), b, F.lit(" of the Original Lease, and Section 9 of it.")).alias("quote"))


def _signed(g: Graph) -> DataFrame:
    line = _lines(g)
    head = F.when(F.col("at") % 20 == 6, "IN WITNESS WHEREOF, they sign").when(F.col("at") % 20 == 11, "Exhibit A")
    return change.signature_lines(line.withColumn("span", F.coalesce(head, "span")))


def _reference(g: Graph) -> DataFrame:
    return change.gate_decisions(g).select("run_id", "category", ((F.col("run_id") + F.col("category")) % 4 == 0).alias("positive"))


def _runs(g: Graph) -> DataFrame:
    return g.line.select(F.col("l_partkey").alias("agreement_id"), F.col("id").alias("run"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("prompt"))


def _attempts(g: Graph) -> DataFrame:
    model = F.concat(F.lit("m"), (F.col("l_suppkey") % 40).cast("string"))
    return g.line.select(F.col("l_orderkey").alias("run"), model.alias("model"), F.col("l_quantity").cast("long").alias("tokens"))


def _tariff(g: Graph) -> DataFrame:
    return g.spark.range(39).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("model"), (F.col("id") + 1).alias("price"))


def _field_pairs(g: Graph) -> DataFrame:
    x = g.line
    return x.select(
        F.col("l_returnflag").alias("gold_flag"), F.when(F.col("l_partkey") % 3 != 0, F.lower("l_returnflag")).when(F.col("l_partkey") % 6 == 0, "x").alias("pred_flag"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linenumber")).alias("gold_line"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_linenumber") % 4).alias("pred_line"),
    )


def _bounds(g: Graph) -> DataFrame:
    rows = g.line.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)).alias("misses"), F.count(F.lit(1)).alias("n"))
    return rows.select("supplier", "misses", "n", F.round(stats.miss_bound(F.col("misses"), F.col("n")), 6).alias("bound"))


def _timing_labels(g: Graph) -> DataFrame:
    """Reference labels laid over the clauses of obligations that have a timing or none: each shifted by a few code points."""
    rows = g.clause_ref.where("ref_id = obligation_id AND ref_id % 3 = 0").join(g.timing.select(F.col("obligation_id").alias("_t"), F.col("timed_in").alias("_in"), "kind", "relation", "bound_date"), (F.col("agreement_id") == F.col("_in")) & (F.col("obligation_id") == F.col("_t")), "left")
    return rows.select(F.col("ref_id").alias("label"), "agreement_id", (F.col("char_start") + 3).alias("char_start"), (F.col("char_end") + 3).alias("char_end"), F.coalesce("kind", F.lit("untimed")).alias("kind"), "relation", "bound_date")


def _messages(g: Graph) -> DataFrame:
    def usage(n):
        return F.struct(F.col("l_quantity").cast("long").alias("input"), (n + F.col("l_linenumber")).alias("output"))

    step = lambda i: F.struct(F.when(i != 1, F.concat(F.lit("m"), i.cast("string"))).alias("model"), usage(i).alias("usage"))
    return g.line.select("id", F.lit("main").alias("model"), usage(F.lit(0).cast("long")).alias("usage"), F.when(F.col("l_linenumber") > 1, F.transform(F.expr("sequence(1L, l_linenumber - 1L)"), step)).alias("iterations"))


def _pinned(g: Graph) -> DataFrame:
    book = fixtures.Contracts(g)
    form = F.col("id") % 5
    quote = F.when(form == 1, "Acme Group, of Utah").otherwise(F.col("p.P13"))
    pins = book.lines.select(
        "doc_id", F.when(form == 2, "p9999").otherwise(F.col("segment")).alias("segment"), quote.alias("quote"), F.when(form == 3, "Beta").otherwise("Acme Group").alias("name"), F.when(form == 4, None).otherwise("Utah").alias("location"), "id"
    )
    return records.site_pins(pins.drop("id"), book.book).groupBy("fault").agg(F.count(F.lit(1)).alias("pins"))


def _paired(g: Graph) -> DataFrame:
    run = g.change_run.select(F.col("run_id").alias("change_order"), (F.col("run_id") * 2).alias("run"), F.lit("ungated").alias("mode"), F.col("run_id").alias("pair"), F.lit(None).cast("long").alias("baseline"), (F.col("run_id") % 7 != 0).alias("fresh"))
    k = F.col("run_id")
    gated = g.change_run.where("run_id % 5 <> 0").select(k.alias("change_order"), (k * 2 + 1).alias("run"), F.lit("gated").alias("mode"), (k + F.when(k % 11 == 0, 1).otherwise(0)).alias("pair"), (k * 2 + F.when(k % 13 == 0, 2).otherwise(0)).alias("baseline"), (k % 7 != 0).alias("fresh"))
    return evaluation.paired_runs(run.unionByName(gated))


def _eight_fields(g: Graph) -> DataFrame:
    x = g.line
    pairs = x.select(
        *(F.when(F.col("l_partkey") % (i + 2) != 0, F.col(c).cast("string")).alias(f"gold_{f}") for i, (f, c) in enumerate(_FIELD_COLUMNS)),
        *(F.when(F.col("l_suppkey") % (i + 3) != 0, F.when(F.col("l_linenumber") == i % 7 + 1, F.lit("x")).otherwise(F.concat(F.lit("  "), F.lower(F.col(c).cast("string"))))).alias(f"pred_{f}") for i, (f, c) in enumerate(_FIELD_COLUMNS)),
    )
    return evaluation.field_scores(pairs, numeric=())


_FIELD_COLUMNS = tuple(zip(evaluation.FIELDS, ("l_returnflag", "l_linestatus", "l_linenumber", "l_tax", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus")))


def _mentions(g: Graph) -> DataFrame:
    names = g.party.where("party_id % 2 = 1")
    rows = g.obligation.join(names, F.col("owed_to") == F.col("party_id"))
    return rows.select("id", "agreement_id", F.when(F.col("id") % 2 == 0, F.when(F.col("id") % 4 == 0, "landlord").otherwise("tenant")).alias("role"), "name")


def _anchor_requests(g: Graph) -> tuple[DataFrame, DataFrame]:
    wanted = g.obligation.where("k IN (1, 2)").select("id", "agreement_id", "base_agreement_id", F.concat(F.lit("e"), (F.col("id") % 3).cast("string")).alias("key"))
    events = g.line.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("agreement_id"), F.concat(F.lit("e"), (F.col("l_suppkey") % 3).cast("string")).alias("key"), F.col("id").alias("event_id"))
    return wanted, events


def _proposed_events(g: Graph, flag: str) -> DataFrame:
    name = F.concat(F.lit(" Event "), F.upper(F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("l_suppkey") % 2 + 1).cast("int"))))
    return g.line.where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("agreement_id"), name.alias("name"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"))


def _merged(g: Graph) -> DataFrame:
    return snapshot.merged_events(_proposed_events(g, "R"), _proposed_events(g, "A")).select("agreement_id", "key", "date")


def _replaced(g: Graph) -> DataFrame:
    stored = g.line.select("id", F.col("l_orderkey").alias("agreement_id"), F.lit("old").alias("version"))
    new = stored.where("agreement_id % 10 = 0 AND id % 2 = 0").withColumn("version", F.lit("new"))
    return snapshot.replaced(stored, new, "agreement_id").groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def _pins(g: Graph) -> DataFrame:
    rows = g.table("documents").select(F.col("doc_id").alias("doc"), F.sha2("text", 256).alias("digest"))
    pins = rows.where("doc % 9 <> 0").select("doc", F.when(F.col("doc") % 7 == 0, F.lit("0")).otherwise(F.col("digest")).alias("pin"))
    return snapshot.precondition_faults(rows, pins)


def _replayed(g: Graph) -> DataFrame:
    rows = g.table("documents").select(F.col("doc_id").alias("id"), snapshot.fingerprint(F.lit("v1"), F.col("lang"), F.col("text")).alias("fingerprint"))
    recorded = rows.where("id % 6 <> 0").groupBy("fingerprint").agg(F.max("id").alias("answer"))
    return snapshot.replay(rows, recorded)


def _logged(g: Graph) -> DataFrame:
    runs = change.current_extraction(_runs(g))
    log = _runs(g).where("run % 5 <> 0")
    return snapshot.log_mismatches(runs, log)


def _gold(g: Graph) -> DataFrame:
    line = g.line
    rows = line.select(
        "id", (F.col("l_partkey") % 50).alias("span_start"), (F.col("l_suppkey") % 50).alias("span_end"), F.when(F.col("l_linenumber") == 3, "gone").otherwise("active").alias("status"),
        F.when(F.col("l_partkey") % 4 == 0, F.date_format("l_shipdate", "yyyy-M-dd")).alias("due_date"), F.when(F.col("l_suppkey") % 3 == 0, "a").alias("anchor"), F.when(F.col("l_suppkey") % 6 == 0, 1).alias("offset_days"),
    )
    return snapshot.validation_errors(rows)


def _budget(g: Graph) -> DataFrame:
    rows = g.line.select(F.col("l_suppkey").alias("account"), F.col("id").alias("at"), F.col("l_quantity").cast("long").alias("amount"))
    return metrics.admitted(rows, 3000)


def _statements(g: Graph) -> DataFrame:
    """One statement about each customer in one of four forms, and one about a date."""
    form, name = F.col("c_custkey") % 4, F.replace("c_name", F.lit("#"), F.lit(" "))
    date = F.date_format(F.date_add(F.to_date(F.lit("2010-01-01")), (F.col("c_custkey") % 3000).cast("int")), "MMMM d, yyyy")
    quote = (
        F.when(form == 0, F.concat(F.lit("between Landlord "), name, F.lit(" and others")))
        .when(form == 1, F.concat(F.lit("made by "), name, F.lit(" (the “Tenant”)")))
        .when(form == 2, F.concat(name, F.lit(" is not as Tenant")))
        .otherwise(F.concat(F.lit("signed by "), name, F.lit(", a Utah corporation, as Guarantor")))
    )
    dated = F.when(form == 2, F.concat(F.lit("It is not said that "), name, F.lit(" means "), date, F.lit("."))).otherwise(F.concat(F.lit("So. The “"), name, F.lit("” shall mean "), date, F.lit(".")))
    target = (
        F.when(form == 0, F.concat(F.lit("in Section "), (F.col("c_custkey") % 9).cast("string"), F.lit(".1 of the Original Lease")))
        .when(form == 1, F.lit("Exhibit “B” to the Lease"))
        .when(form == 2, F.lit("Section 3 of the OS Rider"))
        .otherwise(F.lit("nowhere"))
    )
    return g.table("customer").select(F.col("c_custkey").alias("id"), name.alias("name"), quote.alias("quote"), dated.alias("dated"), target.alias("target"), form.alias("form"))


def _targets(g: Graph) -> DataFrame:
    aliases = F.array(*(F.struct(F.lit(a).alias("alias"), F.lit(d).cast("long").alias("doc")) for a, d in (("Original Lease", 1), ("Lease", 1), ("OS Rider", None))))
    rows = T.once(_statements(g), r=findings.reference(F.col("target"), aliases, F.lit(1).cast("long")))
    return rows.where("r IS NOT NULL").select("id", "r.kind", "r.part", "r.parent", "r.doc", "r.label")


CHANGE = {
    "c11_targets": _graph(_targets),
    "v10_mentioned": _graph(lambda g: _statements(g).select("id", binding.mentioned(F.col("quote"), F.when(F.col("id") % 2 == 0, F.lit("landlord")).otherwise(F.upper("name"))).alias("found"))),
    "v13_declared_dates": _graph(lambda g: _statements(g).select("id", binding.declared_date(F.col("dated"), F.col("name")).alias("date"))),
    "v15_bound_roles": _graph(lambda g: _statements(g).select("id", F.array_join(binding.bound_roles(F.col("quote"), F.col("name"), F.lit(None).cast("string")), ",").alias("roles"))),
    "c01_chain": _graph(lambda g: g.chain, "run_id", "agreement_id", "position", "role"),
    "c02_current_extraction": _graph(lambda g: change.current_extraction(_runs(g))),
    "c03_base_first": _graph(lambda g: change.base_first(g.agreement)),
    "c04_section_types": _graph(lambda g: change.section_types(g, views.grounded_obligation(g))),
    "c05_verified_findings": _contracts("verified", "finding", "run_id", "kind", "outcome", "correction", "label", "resolution", "old_origin", "new_value", "delta"),
    "c05_outcomes": _graph(lambda g: findings.outcomes(fixtures.Contracts(g).verified)),
    "c06_supersedes": _of_kind("supersedes", "label", "resolution"),
    "c07_shifted_dates": _of_kind("shifted_date", "new_value", "delta"),
    "c09_price_changes": _of_kind("price_change", "new_value", "currency"),
    "c10_potential_conflicts": _of_kind("potential_conflict", "old_origin"),
    "c12_first_of_key": _graph(lambda g: change.first_of_key(g.finding)),
    "c14_supersession_edges": _graph(views.supersession_edges),
    "c16_costs": _graph(lambda g: metrics.costs(_attempts(g), _tariff(g))),
    "ga01_lexicon_hits": _graph(lambda g: change.lexicon_hits(rules.quotes(g)), "id", "category", "word"),
    "ga02_section_references": _graph(lambda g: change.section_references(_section_quotes(g), change.section_types(g, views.grounded_obligation(g)))),
    "ga03_signature_lines": _graph(_signed),
    "ga06_cascade": _graph(lambda g: change.cascade(change.gate_decisions(g))),
    "q19_gate_summary": _graph(lambda g: read.gate_summary(change.cascade(change.gate_decisions(g)))),
    "m02_candidate_edges": _graph(metrics.candidate_edges),
    "m03_matching": _graph(lambda g: metrics.matched(metrics.candidate_edges(g))),
    "m05_label_scores": _graph(metrics.label_scores),
    "m05_macro_scores": _graph(metrics.macro_scores),
    "m06_field_accuracy": _graph(lambda g: metrics.field_accuracy(_field_pairs(g), ["flag", "line"])),
    "m10_multiset_matches": _graph(lambda g: metrics.multiset_matches(g.line.where("l_linestatus = 'O'").select("id", "l_suppkey", "l_returnflag"), g.line.where("l_linestatus = 'F'").select("id", "l_suppkey", "l_returnflag"), ["l_suppkey", "l_returnflag"])),
    "m13_gate_metrics": _graph(lambda g: metrics.gate_metrics(change.cascade(change.gate_decisions(g)), _reference(g))),
    "m14_miss_bound": _graph(_bounds),
    "m06_eight_fields": _graph(_eight_fields),
    "m07_sampled": _graph(lambda g: evaluation.sampled(metrics.label_scores(g))),
    "m08_predictions": _graph(evaluation.predictions),
    "m09_timing_scores": _graph(lambda g: evaluation.timing_scores(_timing_labels(g), evaluation.timing_predictions(g))),
    "m16_paired_runs": _graph(_paired),
    "e03_attempts": _graph(lambda g: records.attempts(_messages(g))),
    "w10_site_pins": _graph(_pinned),
    "x01_records": _graph(lambda g: records.obligation_records(g, read.obligations(g, type_="t2", include_superseded=True))),
    "m19_spread": _graph(lambda g: metrics.spread(g.line, "l_returnflag", "l_quantity")),
    "b02_admitted": _graph(_budget),
    "w05_party_dictionary": _graph(lambda g: snapshot.party_dictionary(g.party).agg(F.count(F.lit(1)).alias("names"), F.count_distinct("party_id").alias("ids"))),
    "w01_replaced": _graph(_replaced),
    "w06_merged_events": _graph(_merged),
    "w08_resolved_parties": _graph(lambda g: snapshot.resolved_parties(_mentions(g), views.visible_party_binding(g))),
    "w09_resolved_anchors": _graph(lambda g: snapshot.resolved_anchors(*_anchor_requests(g))),
    "s06_pins": _graph(_pins),
    "s11_replay": _graph(_replayed),
    "s15_validation_errors": _graph(_gold),
    "s16_log_mismatches": _graph(_logged),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return READ["q13_due_window"](spark, sf_dir)


def queries() -> dict:
    return {**VIEWS, **READ, **TEXT, **CHANGE}


def oracle_sql() -> dict:
    sampled = f"SELECT * REPLACE (CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS f1), precision AS precision_lower_bound FROM ({change_sql.ORACLES['m05_label_scores']})"
    return {"m07_sampled": sampled, **views_sql.ORACLES, **read_sql.ORACLES, **text_sql.ORACLES, **change_sql.ORACLES, **fixtures.ORACLES}
