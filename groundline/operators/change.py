"""Change orders: chains, findings, gates, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions import text as T
from groundline.plans.overlay import Graph, dealt

CATEGORIES = ("price", "dates", "term", "space", "parties", "other")
# fixed values: words that turn a gate on; a star stands for any ending
LEXICON = (("price", "rent*"), ("price", "pay"), ("dates", "within"), ("dates", "Commencement Date"), ("term", "expiration"), ("parties", "Tenant"), ("other", "invoice*"))


def total_or_null(value: Column) -> Column:
    """A sum that is null as soon as one addend is."""
    return F.when(F.count_if(value.isNull()) == 0, F.sum(value))


def current_extraction(runs: DataFrame) -> DataFrame:
    """The latest run of each agreement."""
    return runs.groupBy("agreement_id").agg(F.max("run").alias("run"), F.max_by("prompt", "run").alias("prompt"))


def base_first(agreements: DataFrame) -> DataFrame:
    """Each agreement's depth below its base; bases first, then by filing. A base has none itself, so two levels are all."""
    base = agreements.select(F.col("agreement_id").alias("_b"), F.col("base_agreement_id").alias("_bb"))
    rows = agreements.join(base, dealt("base_agreement_id", "agreement_id", "_b"), "left")
    return rows.select("agreement_id", F.when(F.col("base_agreement_id").isNull(), 0).when(F.col("_bb").isNull(), 1).otherwise(2).cast("long").alias("depth"))


def section_types(g: Graph, seen: DataFrame) -> DataFrame:
    """The types of visible obligations in each section of an agreement."""
    rows = g.clause_ref.where("grounded").join(seen.select(F.col("id").alias("_o"), F.col("agreement_id").alias("_a"), "type"), (F.col("obligation_id") == F.col("_o")) & (F.col("agreement_id") == F.col("_a")))
    return rows.groupBy("agreement_id", "section").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def first_of_key(findings: DataFrame) -> DataFrame:
    """Of findings with the same kind and spans the first stays, the others are dropped as duplicates."""
    at = F.row_number().over(Window.partitionBy("run_id", "kind", "new_ref", "old_ref").orderBy("finding_id"))
    return findings.withColumn("_n", at).groupBy(F.when(F.col("_n") == 1, "kept").otherwise("duplicate").alias("outcome")).agg(F.count(F.lit(1)).alias("findings"))


def lexicon_hits(quotes: DataFrame, lexicon: tuple = LEXICON) -> DataFrame:
    """GA01, GA04: which lexicon entries occur in a quote as whole words, and where first."""
    patterns = [(c, w, r"(?i)(?<![\p{L}\p{N}])" + r"\s+".join(x.replace("*", r"[\p{L}\p{N}]*") for x in w.split()) + r"(?![\p{L}\p{N}])") for c, w in lexicon]
    hits = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(w).alias("word"), F.get(T.occurrences(F.col("quote"), p), F.lit(0))["start"].alias("char_start")) for c, w, p in patterns))
    return quotes.select("id", F.explode(F.filter(hits, lambda h: h["char_start"].isNotNull())).alias("h")).select("id", "h.category", "h.word", "h.char_start")


def section_references(quotes: DataFrame, types: DataFrame) -> DataFrame:
    """GA02: sections that a quote names, with the obligation types of that section of its base."""
    numbers = F.regexp_extract_all(F.regexp_extract("quote", r"Sections? ([0-9]+(?: and [0-9]+)*) of the (?:Original )?Lease", 1), F.lit("[0-9]+"), F.lit(0))
    named = quotes.select("id", "base_id", F.explode(numbers).alias("number")).withColumn("section", F.col("number").cast("long"))
    return named.join(types, (F.col("base_id") == types["agreement_id"]) & (named["section"] == types["section"])).select("id", named["section"], "types")


def signature_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """GA03: lines from a signature block's start up to, and without, the next exhibit."""
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.max(F.when(F.col("span").startswith("IN WITNESS WHEREOF"), F.col("at"))).over(upto)
    end = F.max(F.when(F.upper("span").startswith("EXHIBIT"), F.col("at"))).over(upto)
    return lines.select(key, "at", (F.coalesce(start > F.coalesce(end, F.lit(-1)), F.lit(False))).alias("signature"))


def vote(samples: Column) -> tuple[Column, Column]:
    """GA05: (answer, confidence) of samples yes, no or null: a tie is yes, no usable sample is null."""
    yes = F.size(F.filter(samples, lambda s: F.coalesce(s, F.lit(False))))
    no = F.size(F.filter(samples, lambda s: F.coalesce(~s, F.lit(False))))
    return F.when(yes + no > 0, yes >= no), F.greatest(yes, no) / F.size(samples)


def cascade(decisions: DataFrame) -> DataFrame:
    """GA06: a rule's yes stops; only three plain noes of a sound classifier skip a check; all else runs it."""
    answer, confidence = vote(F.col("samples"))
    sure = F.coalesce(~answer, F.lit(False)) & (F.size(F.filter("samples", lambda s: F.coalesce(~s, F.lit(False)))) == 3) & F.col("error").isNull()
    tier = F.when(F.col("rule_hit"), "rules").when(F.col("error").isNull() & answer.isNotNull(), "classifier").otherwise("none")
    rows = decisions.withColumn("tier", tier).withColumn("answer", F.when(F.col("rule_hit"), True).otherwise(answer))
    return rows.select("run_id", "category", "tier", "answer", F.round(confidence, 6).alias("confidence"), (F.col("rule_hit") | ~sure).alias("run_check"))


def gate_decisions(g: Graph) -> DataFrame:
    """Six decisions of each run, laid over the flags of its first lines."""
    line = g.line.select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), "l_partkey", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("id")).alias("n"))
    first = line.where("n <= 6")
    head = g.agreement.where("base_agreement_id IS NOT NULL").select(F.col("agreement_id").alias("_a"))
    yes = [F.when(F.col("f") == "R", True).when(F.col("f") == "A", False), F.when(F.col("l_suppkey") % 3 != 2, F.col("l_suppkey") % 3 == 1), F.when(F.col("l_partkey") % 5 != 4, F.col("l_partkey") % 5 > 2)]
    return first.join(head, F.col("run_id") == F.col("_a"), "left_semi").select(
        "run_id", (F.col("n") - 1).cast("long").alias("category"), F.array(*yes).alias("samples"), F.when(F.col("l_partkey") % 13 == 0, "timeout").alias("error"), (F.col("l_suppkey") % 4 == 0).alias("rule_hit")
    )
