"""Mixing sources to target weights by pivotal dependent rounding, on DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilequarry.llm import native, scratch

#: Weights by a source's place in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Most times that a source's words, or a document, are taken.
MOST = 3
#: Members of a group at each level of the reduction tree.
FAN_IN = 64
#: Up to this many sources, their targets are broadcast; beyond, they are joined.
SMALL = 20_000


def targets(sizes: DataFrame, total_share: float = 1.0) -> DataFrame:
    """Targets for sizes(source, source_size, units): source, src (its place), source_size, units, target.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the words in that
    proportion; no target passes 3 times its source's size, and the excess is shared again by
    weight. That ends at min(cap, theta * weight) for one theta, which sorted sums of caps and
    weights give at once, whatever the number of sources.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("src", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("src"), F.lit(len(WEIGHTS))) + 1).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST)
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(total_share))
        .withColumn("left_mass", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("theta", F.col("left_mass") / F.col("left_weight"))
        .withColumn("free", F.col("theta") * F.col("weight") <= F.col("cap"))
    )
    first = F.first(F.when(F.col("free"), F.col("theta")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = ranked.withColumn("last_theta", first)
    share = F.when(F.col("last_theta").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("last_theta") * F.col("weight")))
    return ranked.select("source", F.col("src").cast("long").alias("src"), "source_size", "units", share.alias("target"))


def _pair(now: Column, item: Column) -> Column:
    """Move mass between the residual and the next document until one of them is integral."""
    a, b = now["res"], item
    up = F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"])
    down = F.least(a["size"] * a["p"], b["size"] * (1 - b["p"]))
    rise = native.unit(a["doc_id"], a["fp"], b["doc_id"], b["fp"], F.lit("pair")) * (up + down) < down
    a_full = a["size"] * (1 - a["p"]) <= b["size"] * b["p"]
    a_none = a["size"] * a["p"] <= b["size"] * (1 - b["p"])
    first_ends = F.when(rise, a_full).otherwise(a_none)
    left_p = F.when(rise, F.when(a_full, b["p"] - up / b["size"]).otherwise(a["p"] + up / a["size"])).otherwise(F.when(a_none, b["p"] + down / b["size"]).otherwise(a["p"] - down / a["size"]))
    took = F.when(first_ends, rise).otherwise(~rise)
    ended = F.struct(F.when(first_ends, a["doc_id"]).otherwise(b["doc_id"]).alias("doc_id"), F.when(first_ends, a["fp"]).otherwise(b["fp"]).alias("fp"), took.cast("int").alias("extra"))
    kept = F.when(first_ends, b).otherwise(a)
    rest = F.struct(kept["doc_id"].alias("doc_id"), kept["fp"].alias("fp"), kept["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), left_p)).alias("p"))
    return F.struct(rest.alias("res"), F.concat(now["out"], F.array(ended)).alias("out"))


def _fold(members: Column) -> Column:
    """Fold a group of at most FAN_IN documents: decisions in out, one residual in res."""
    start = F.struct(members[0].alias("res"), F.array().cast("array<struct<doc_id:bigint,fp:bigint,extra:int>>").alias("out"))
    return F.aggregate(F.slice(members, 2, FAN_IN), start, _pair)


def rounded(units: DataFrame, most_units: int) -> DataFrame:
    """Round units(src, ord, doc_id, fp, size, p) to extra 0 or 1: src, doc_id, fp, extra.

    A reduction tree of groups of FAN_IN neighbours: each keeps the words that it expects, up to
    one residual document, which the next level rounds with its neighbours' residuals. The last
    residual of a source is drawn by its own probability; the longest documents are paired first,
    so that it tends to be a short one. Every level is FAN_IN times smaller, so
    no task sees more than FAN_IN rows of a key, however hot a source is.
    """
    done, level = [], units
    while True:
        largest_first = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "ord", "doc_id", "fp", "size", "p")))
        members = F.transform(largest_first, lambda m: F.struct(m["doc_id"].alias("doc_id"), m["fp"].alias("fp"), m["size"].alias("size"), m["p"].alias("p")))
        grouped = level.groupBy("src", F.floor(F.col("ord") / FAN_IN).cast("long").alias("g")).agg(members.alias("members"))
        folded = scratch.store(grouped.select("src", F.col("g").alias("ord"), _fold(F.col("members")).alias("f")), "rounding")
        done.append(folded.select("src", F.explode("f.out").alias("d")).select("src", "d.doc_id", "d.fp", "d.extra"))
        level = folded.select("src", "ord", "f.res.doc_id", "f.res.fp", "f.res.size", "f.res.p")
        most_units = -(-most_units // FAN_IN)
        if most_units <= 1:
            break
    done.append(level.select("src", "doc_id", "fp", (native.unit(F.col("doc_id"), F.col("fp"), F.lit("last")) < F.col("p")).cast("int").alias("extra")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def fingerprint(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def copies(docs: DataFrame) -> DataFrame:
    """How often the mix takes each distinct document: doc_id, source, fp, size, source_size, target, rows, times, extras.

    Each of the ``rows`` rows that agree in doc_id, source and text is taken ``times`` times, and
    the first ``extras`` of them once more. Nulls: a null text has size 0, a null source is a
    source of its own, null ids agree. Documents without words are never taken.
    """
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), fingerprint(F.col("text")).alias("fp"), F.size(native.words(F.col("text"))).cast("long").alias("size"))
    units = scratch.store(sized.groupBy("doc_id", "source", "fp", "size").agg(F.count(F.lit(1)).alias("rows")), "units")
    by_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    goals = targets(by_source)
    few = goals.limit(SMALL + 1).collect()
    if len(few) <= SMALL:
        goals = F.broadcast(docs.sparkSession.createDataFrame(few, goals.schema))
        largest = max((r["units"] for r in few), default=0)
    else:
        goals = scratch.store(goals, "targets")
        largest = goals.agg(F.max("units")).first()[0]
    goals = goals.withColumnRenamed("source", "_source").drop("units")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rated = units.join(goals, units["source"].eqNullSafe(F.col("_source"))).drop("_source")
    rated = rated.withColumn("rate", rate).withColumn("times", F.when(F.col("size") > 0, F.floor("rate")).otherwise(F.lit(0)).cast("long"))
    rated = rated.withColumn("mass", F.when(F.col("size") > 0, (F.col("rate") - F.floor("rate")) * F.col("rows")).otherwise(F.lit(0.0)))
    rated = rated.withColumn("whole", F.floor("mass").cast("long")).withColumn("p", F.col("mass") - F.floor("mass"))
    rated = scratch.store(rated.select("doc_id", "source", "fp", "size", "source_size", "target", "rows", "src", "times", "whole", "p"), "rates")
    open_units = rated.where(F.col("p") > 0).select("src", "doc_id", "fp", F.col("size").cast("double").alias("size"), "p")
    spread = F.pmod(F.xxhash64("doc_id", "fp"), F.lit(1 << 40))
    lined = native.numbered(open_units, ["src"], ["doc_id", "fp"], spread, 4096, "ord")
    extra = rounded(lined, largest).select(F.col("src").alias("_src"), F.col("doc_id").alias("_doc"), F.col("fp").alias("_fp"), "extra")
    met = rated.join(extra, (F.col("src") == F.col("_src")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("fp") == F.col("_fp")), "left")
    return met.select("doc_id", "source", "fp", "size", "source_size", "target", "rows", "times", (F.col("whole") + F.coalesce(F.col("extra"), F.lit(0))).alias("extras"))


def taken(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words that the mix takes of it)."""
    own = copies(docs).withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    times = F.col("times") + (F.col("_nth") <= F.col("extras")).cast("long")
    return own.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it, rows not taken left out.

    All columns stay, whatever their names; the decisions of ``copies`` take effect. Rows meet their
    decision by doc_id, source and the text's hash; rows that agree in these are told apart by their
    number. Texts without words are left out; a null source is a source; an empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("doc"), F.col("source").cast("string").alias("source"), fingerprint(F.col("text")).alias("fp"))
    keyed = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "source", "fp").orderBy(F.lit(0))))
    plan = copies(docs).where((F.col("times") > 0) | (F.col("extras") > 0))
    plan = plan.select(F.col("doc_id").alias("plan_doc"), F.col("source").alias("plan_source"), F.col("fp").alias("plan_fp"), "times", "extras")
    met = keyed.join(plan, F.col("doc").eqNullSafe(F.col("plan_doc")) & F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("fp") == F.col("plan_fp")))
    taken_times = F.col("times") + (F.col("nth") <= F.col("extras")).cast("long")
    met = met.withColumn("copies", taken_times).where(F.col("copies") > 0)
    return met.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
