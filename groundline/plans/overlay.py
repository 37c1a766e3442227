"""The graph of agreements, obligations and citations, laid over the star-schema tables.

One order is an agreement, one line of it an obligation with one clause
reference, a customer's first order is the base of the later ones.

The graph's relations are written once for a session and a folder of tables,
bucketed and sorted by the agreement (or run, party) they belong to, and all
queries read them from there; so the views' joins are between tables that are
dealt out alike. The folder is taken to stay as it is while a session lasts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.session import bucketed

LINES_PER_BUCKET = 250_000
MOST_BUCKETS = 20_000
_written: dict[tuple[str, str, str], DataFrame] = {}
_buckets: dict[tuple[str, str], int] = {}


def stored(key: str) -> Callable[[Callable], cached_property]:
    """A relation that is computed and written at its first use in a session; `owner` has spark, sf_dir and buckets."""

    def wrap(build: Callable) -> cached_property:
        def get(owner) -> DataFrame:
            at = (owner.spark.sparkContext.applicationId, owner.sf_dir, build.__qualname__)
            if at not in _written:
                _written[at] = bucketed(build(owner), build.__name__, key, owner.buckets)
            return _written[at]

        get.__doc__ = build.__doc__
        return cached_property(get)

    return wrap


def dealt(key: str, row: str, other: str) -> Column:
    """That a key, which may be null, equals the other side's, for a left join: rows without one are dealt out by `row`, as nulls would all go to one task."""
    return (F.coalesce(key, -1 - F.col(row)) == F.col(other)) & F.col(key).isNotNull()


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    sf_dir: str

    def __post_init__(self):
        # joins by agreement and id are to use the buckets by agreement, instead of dealing both sides out anew by both keys
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def buckets(self) -> int:
        """How many buckets all relations have: by the number of lines, which the files' footers tell, and a core's worth at least."""
        at = (self.spark.sparkContext.applicationId, self.sf_dir)
        if at not in _buckets:
            wanted = -(-self.table("lineitem").count() // LINES_PER_BUCKET)
            most = max(MOST_BUCKETS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            _buckets[at] = max(self.spark.sparkContext.defaultParallelism, min(wanted, most))
        return _buckets[at]

    @stored("agreement_id")
    def agreement(self) -> DataFrame:
        by_customer = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        first = F.first("o_orderkey").over(by_customer)
        return self.table("orders").select(
            F.col("o_orderkey").alias("agreement_id"),
            F.col("o_custkey").alias("customer"),
            F.to_date("o_orderdate").alias("filing_date"),
            F.when(first != F.col("o_orderkey"), first).alias("base_agreement_id"),
            (F.col("o_orderstatus") == "P").alias("is_form"),
            F.col("o_orderpriority").alias("agreement_type"),
        )

    @stored("l_orderkey")
    def line(self) -> DataFrame:
        every = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*every))
        return self.table("lineitem").withColumn("id", F.col("l_orderkey") * 100 + at)

    @stored("agreement_id")
    def obligation(self) -> DataFrame:
        k = F.col("l_partkey") % 4
        sign = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)
        line = self.line.select(
            "id",
            F.col("l_orderkey").alias("agreement_id"),
            F.concat(F.lit("t"), F.col("l_partkey") % 9).alias("type"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
            k.alias("k"),
            F.when(k == 0, F.to_date("l_shipdate")).alias("due_date"),
            F.when(k.isin(1, 2), (F.col("l_quantity").cast("int") * sign)).cast("int").alias("offset_days"),
            F.when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 5 == 0), "redacted")
            .when((F.col("l_returnflag") == "A") & (F.col("l_partkey") % 5 == 1), "blank")
            .when(F.col("l_suppkey") % 17 == 5, "superseded")
            .otherwise("active")
            .alias("status"),
            (F.col("l_suppkey") * 2 + 1).alias("owed_to"),
            F.col("l_suppkey").alias("supplier"),
            F.col("l_linenumber").alias("line"),
        )
        base = self.agreement.select(F.col("agreement_id").alias("_a"), "base_agreement_id", "customer")
        return line.join(base, F.col("agreement_id") == F.col("_a")).select(
            *line.columns,
            (F.col("customer") * 2).alias("owed_by"),
            F.when(F.col("k") == 1, F.col("agreement_id")).when(F.col("k") == 2, F.coalesce("base_agreement_id", "agreement_id")).alias("anchor_agreement"),
            "base_agreement_id",
        )

    @stored("agreement_id")
    def event(self) -> DataFrame:
        """An event of each agreement; some are cited in another agreement's text."""
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("agreement_id"),
            F.when(key % 6 != 0, F.to_date("o_orderdate")).alias("event_date"),
            (key % 8 != 0).alias("grounded"),
            F.when(key % 19 == 7, key + 1).otherwise(key).alias("cited_in"),
        )

    @stored("agreement_id")
    def clause_ref(self) -> DataFrame:
        """Each obligation's clause, a second one of some, and some that point into another agreement, which must count for nothing."""
        start = (F.col("l_partkey") % 500) * 10
        line = self.line.select(
            F.col("id").alias("obligation_id"),
            "l_orderkey",
            (F.col("l_partkey") % 7).alias("section"),
            start.alias("start"),
            F.col("l_quantity").cast("long").alias("size"),
            (F.col("l_suppkey") % 10 != 3).alias("first"),
            F.when(F.col("l_linenumber") % 3 == 1, F.col("l_suppkey") % 4 != 1).alias("second"),
            (F.col("l_partkey") % 97 == 0).alias("astray"),
        )

        def ref(number: int, agreement, section, at, grounded):
            return F.struct(
                (F.col("obligation_id") + number * 10**12).alias("ref_id"), agreement.cast("long").alias("agreement_id"), section.alias("section"), at.alias("char_start"),
                (at + 20 + F.col("size")).alias("char_end"), grounded.alias("grounded"),
            )

        own, section = F.col("l_orderkey"), F.col("section")
        refs = F.array(
            ref(0, own, section, F.col("start"), F.col("first")),
            F.when(F.col("second").isNotNull(), ref(1, own, (section + 1) % 7, F.col("start") + 300, F.col("second"))),
            F.when(F.col("astray"), ref(2, own % 1000 + 1, section, F.col("start"), F.lit(True))),
        )
        rows = line.select("obligation_id", F.explode(F.array_compact(refs)).alias("r")).select("r.ref_id", "obligation_id", "r.agreement_id", "r.section", "r.char_start", "r.char_end", "r.grounded")
        return rows.withColumn("page", (F.floor(F.col("char_start") / 2000) + 1).cast("long"))

    @stored("agreement_id")
    def defined_term(self) -> DataFrame:
        """A term that each agreement defines in its first line; some are cited from the base instead."""
        ref = F.when(F.col("agreement_id") % 13 == 5, F.coalesce("base_agreement_id", "agreement_id")).otherwise(F.col("agreement_id"))
        return self.agreement.select("agreement_id", F.concat(F.lit("Term "), F.col("agreement_id") % 10).alias("term"), (ref * 100 + 1).alias("ref_id"))

    @stored("timed_in")
    def timing(self) -> DataFrame:
        """Stored timing of obligations with k = 3. Some have no trigger or one outside their clause, some an anchor in the base or elsewhere; the bound is off by a day on line 7."""
        kind = F.element_at(F.array(*map(F.lit, ("scheduled", "scheduled", "contingent", "unresolved"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
        start = (F.col("l_partkey") % 500) * 10
        days, bare = F.col("l_quantity").cast("int"), F.col("l_suppkey") % 7 == 3
        base = self.agreement.select(F.col("agreement_id").alias("_b"), "base_agreement_id")
        place = F.col("l_linenumber")
        anchor = F.when(place % 3 == 0, F.coalesce("base_agreement_id", "l_orderkey")).when(place == 5, F.col("l_orderkey") % 1000 + 1).otherwise(F.col("l_orderkey"))
        rows = self.line.where("l_partkey % 4 = 3 AND l_suppkey % 5 < 4").join(base, F.col("l_orderkey") == F.col("_b"))
        rows = rows.select(
            F.col("id").alias("obligation_id"),
            F.col("l_orderkey").alias("timed_in"),
            kind.alias("kind"),
            F.when(F.col("l_suppkey") % 5 == 0, "lt").when(F.col("l_suppkey") % 5 == 1, "lte").alias("relation"),
            days.alias("offset_days"),
            F.when(~bare, start + 2).alias("trigger_start"),
            F.when(~bare, start + F.when(place % 6 == 5, 100).otherwise(12)).alias("trigger_end"),
            F.when(~bare, F.col("l_suppkey") % 9 != 4).alias("trigger_grounded"),
            F.when((kind == "scheduled") | (F.col("l_suppkey") % 2 == 1), anchor).cast("long").alias("anchor_agreement"),
            F.when(place == 7, 1).otherwise(0).alias("_off"),
        )
        dated = self.event.select(F.col("agreement_id").alias("_e"), "event_date")
        return rows.join(dated, dealt("anchor_agreement", "obligation_id", "_e"), "left").select(
            *(c for c in rows.columns if c != "_off"), F.when(F.col("kind") == "scheduled", F.date_add("event_date", F.col("offset_days") + F.col("_off"))).alias("bound_date")
        )

    @stored("agreement_id")
    def agreement_party(self) -> DataFrame:
        tenants = self.table("orders").where("(o_custkey + o_orderkey) % 5 <> 0").select(
            F.col("o_orderkey").alias("agreement_id"), (F.col("o_custkey") * 2).alias("party_id"), F.lit("tenant").alias("role"), F.lit(True).alias("grounded")
        )
        others = (
            self.table("lineitem")
            .where("(l_suppkey + l_orderkey) % 5 <> 0")
            .groupBy(F.col("l_orderkey").alias("agreement_id"), (F.col("l_suppkey") * 2 + 1).alias("party_id"), F.when(F.col("l_suppkey") % 2 == 0, "landlord").otherwise("provider").alias("role"))
            .agg(F.min(F.col("l_suppkey") % 10 != 3).alias("grounded"))
        )
        return tenants.unionByName(others)

    @stored("party_id")
    def party(self) -> DataFrame:
        return (
            self.table("customer")
            .select((F.col("c_custkey") * 2).alias("party_id"), F.col("c_name").alias("name"))
            .unionByName(self.table("supplier").select((F.col("s_suppkey") * 2 + 1).alias("party_id"), F.col("s_name").alias("name")))
        )

    @stored("agreement_id")
    def agreement_site(self) -> DataFrame:
        places = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        homes = self.table("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("site"), F.col("r_name").alias("location"))
        return self.agreement.join(homes, F.col("customer") == F.col("c_custkey")).select("agreement_id", "site", "location")

    @stored("run_id")
    def change_run(self) -> DataFrame:
        """One run for each agreement that has a base; its stored size is wrong where the id divides by 13."""
        sized = self.chain.groupBy("run_id").agg(F.count(F.lit(1)).alias("members"))
        return sized.select(
            "run_id",
            F.col("run_id").alias("change_order"),
            (F.col("run_id") % 11 != 0).alias("completed"),
            (F.col("members") + F.when(F.col("run_id") % 13 == 0, 1).otherwise(0)).alias("chain_size"),
            F.when(F.col("run_id") % 5 == 2, "gated").otherwise("ungated").alias("mode"),
        )

    @stored("run_id")
    def chain(self) -> DataFrame:
        """Base, then the same base's amendments in order of filing, up to and with the change order itself."""
        member = self.agreement.select("agreement_id", "filing_date", F.coalesce("base_agreement_id", "agreement_id").alias("root"))
        head = self.agreement.where("base_agreement_id IS NOT NULL").select(
            F.col("agreement_id").alias("run_id"), F.col("filing_date").alias("_filed"), F.col("base_agreement_id").alias("_root")
        )
        earlier = (F.col("root") == F.col("agreement_id")) | (F.col("filing_date") < F.col("_filed")) | (F.col("agreement_id") == F.col("run_id"))
        pairs = head.join(member, (F.col("_root") == F.col("root")) & earlier)
        order = Window.partitionBy("run_id").orderBy((F.col("agreement_id") == F.col("run_id")).cast("int"), (F.col("agreement_id") != F.col("_root")).cast("int"), "filing_date", "agreement_id")
        return pairs.select(
            "run_id",
            "agreement_id",
            (F.row_number().over(order) - 1).cast("long").alias("position"),
            F.when(F.col("agreement_id") == F.col("run_id"), "change_order").when(F.col("agreement_id") == F.col("_root"), "base").otherwise("amendment").alias("role"),
            F.when(F.col("run_id") % 7 == 0, "old").otherwise("now").alias("text_hash"),
        )

    @stored("agreement_id")
    def extraction(self) -> DataFrame:
        """The current extraction of each agreement."""
        return self.table("orders").select(F.col("o_orderkey").alias("agreement_id"), F.lit("now").alias("text_hash"), (F.col("o_orderkey") % 17 != 0).alias("complete"))

    @stored("run_id")
    def finding(self) -> DataFrame:
        """Findings of runs: a clause of the change order over a clause of the base with equal type and overlapping span."""
        refs = self.clause_ref.where("ref_id = obligation_id").join(
            self.obligation.select(F.col("id").alias("_o"), F.col("agreement_id").alias("_oa"), "type", "base_agreement_id"), (F.col("agreement_id") == F.col("_oa")) & (F.col("obligation_id") == F.col("_o"))
        )
        new = refs.where("base_agreement_id IS NOT NULL").select(
            F.col("agreement_id").alias("run_id"), F.col("base_agreement_id").alias("_base"), F.col("type").alias("_type"), F.col("ref_id").alias("new_ref"),
            F.col("char_start").alias("_s"), F.col("char_end").alias("_e"), F.col("section").alias("new_section"),
        )
        old = refs.select("agreement_id", "type", F.col("ref_id").alias("old_ref"), "char_start", "char_end", F.col("section").alias("old_section"))
        met = new.join(old, (F.col("_base") == F.col("agreement_id")) & (F.col("_type") == F.col("type")) & (F.col("char_start") < F.col("_e")) & (F.col("char_end") > F.col("_s")))
        return met.select(
            (F.col("new_ref") * 100000 + F.col("old_ref") % 100000).alias("finding_id"),
            "run_id",
            F.element_at(F.array(*map(F.lit, ("supersedes", "shifted_date", "price_change", "potential_conflict"))), (F.col("new_ref") % 4 + 1).cast("int")).alias("kind"),
            (F.col("old_ref") % 6).alias("category"),
            F.when(F.col("old_ref") % 5 == 0, "unresolved").otherwise("chain").alias("old_origin"),
            "new_ref",
            F.when(F.col("old_ref") % 5 != 0, F.col("old_ref")).alias("old_ref"),
            F.when(F.col("new_ref") % 3 == 0, "section").when(F.col("new_ref") % 3 == 1, "range").otherwise("document").alias("resolution"),
            "type",
        )
