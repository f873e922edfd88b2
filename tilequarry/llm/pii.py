"""Personal data: patterns, and information-theoretic sanitisation of the terms that give them away.

DataFrame functions alone. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequarry.llm import scratch

KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns of the base kinds, written so that no long run makes them quadratic or recursive.
#: A run is entered at its start (or where the last match ended); loops are over single characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?=\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?!\.?[A-Za-z0-9-])",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]+?(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth trying.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
#: Code points on either side of a protected entity in which terms count as near; any further term counts by documents.
REACH = 64
#: Stands for the letters of base spans where only the words outside them are wanted.
HIDDEN = "\ufffc"
#: Different entities that a term must be near (or share documents with), and the shares of the most
#: information that a term can give about an entity's presence from which on it is generalised or removed.
MIN_ENTITIES, GENERALISE, REMOVE = 5, 0.9, 0.98
#: Up to this many terms are broadcast to be counted; beyond, all words are counted first.
SMALL = 50_000
#: Up to this many disclosing terms are literals of the plan; beyond, texts meet them in a join.
INLINE = 200
_SPAN = "array<struct<s:int,k:int,e:int,m:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def located(text: Column, pattern: str, kind: int, wanted: Callable[[Column], Column] | None = None) -> Column:
    """The matches of a pattern (the wanted ones), in order, as structs of start, kind, end and text.

    Functions that extract give no positions: they follow from the lengths of matches and of the
    pieces between them.
    """
    pieces = F.split(text, pattern, -1)
    sized = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 0), pieces, lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def add(now: Column, x: Column) -> Column:
        s = now["at"] + x["gap"]
        one = F.struct(s.alias("s"), F.lit(kind).alias("k"), (s + x["size"]).alias("e"), x["m"].alias("m"))
        out = F.concat(now["out"], F.array(one))
        if wanted is not None:
            out = F.when(wanted(x["m"]), out).otherwise(now["out"])
        return F.struct((s + x["size"]).alias("at"), out.alias("out"))

    return F.aggregate(F.filter(sized, lambda x: x["m"].isNotNull()), start, add, lambda end: end["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits; every second digit from the right counts twice, with its own digits summed."""

    def weigh(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weigh) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    digits = _digits(m)
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def _test(kind: str):
    return lambda x: _holds(kind, x["m"])


def base_spans(text: Column) -> Column:
    """All spans of the base kinds that hold, by start, then kind."""
    found = []
    for i, kind in enumerate(KINDS[:4]):
        worth = text.contains(NEEDS[kind]) if kind == "email" else text.rlike(NEEDS[kind])
        found.append(F.when(worth, F.filter(located(text, PATTERNS[kind], i), _test(kind))).otherwise(_none()))
    return F.sort_array(F.concat(*found))


def near_terms(text: Column, base: Column) -> Column:
    """Terms (runs of letters, whole ones) within REACH of a base span and outside all: s, e, term, ent."""
    letters = r"\p{L}+"

    def around(b: Column) -> Column:
        low = F.greatest(F.lit(0), b["s"] - REACH)
        left = located(F.substring(text, low + 1, b["s"] - low), letters, 4)
        right = located(F.substring(text, b["e"] + 1, F.lit(REACH)), letters, 4)
        left = F.filter(left, lambda x: (x["s"] > 0) | (low == 0))
        right = F.filter(right, lambda x: (x["e"] < REACH) | (b["e"] + REACH >= F.length(text)))
        moved = lambda xs, by: F.transform(xs, lambda x: F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), F.lower(x["m"]).alias("term"), F.concat(b["k"].cast("string"), F.lit(":"), b["m"]).alias("ent")))
        return F.concat(moved(left, low), moved(right, b["e"]))

    clear = F.filter(F.flatten(F.transform(base, around)), lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return F.when(F.size(base) > 0, clear).otherwise(F.array().cast("array<struct<s:int,e:int,term:string,ent:string>>"))


def terms_of(text: Column) -> Column:
    """The different runs of letters of a text, in lower case."""
    return F.array_remove(F.array_distinct(F.transform(F.split(text, r"[^\p{L}]+"), F.lower)), "")


def clear_words(text: Column, base: Column) -> Column:
    """The different terms outside all base spans, at any distance from them; none for a text without a span."""

    def hide(now: Column, x: Column) -> Column:
        size = x["e"] - x["s"]
        return F.overlay(now, F.regexp_replace(F.substring(now, x["s"] + 1, size), r"\p{L}", HIDDEN), x["s"] + 1, size)

    left = F.split(F.aggregate(base, F.translate(text, HIDDEN, " "), hide), rf"[^\p{{L}}{HIDDEN}]+")
    whole = F.filter(left, lambda w: (w != "") & ~w.contains(HIDDEN))
    return F.when(F.size(base) > 0, F.array_distinct(F.transform(whole, F.lower))).otherwise(F.array().cast("array<string>"))


def found(docs: DataFrame) -> DataFrame:
    """row (a struct of the columns of ``docs``), text (a null empty), base, near, far (all terms outside spans) and lead
    (the smallest entity, null without any) of every document."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    df = docs.select(row, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("base", base_spans(F.col("text"))).withColumn("near", near_terms(F.col("text"), F.col("base")))
    lead = F.array_min(F.transform("base", lambda b: F.concat(b["k"].cast("string"), F.lit(":"), b["m"])))
    return df.withColumns({"far": clear_words(F.col("text"), F.col("base")), "lead": lead})


def disclosing(docs: DataFrame, own: DataFrame) -> DataFrame:
    """Terms that reveal entities, near them or anywhere in their documents: term, entities, near_n, n, bits, share.

    ``own`` has the near, far and lead of every document with an entity. A term is judged by its
    places within REACH of entities and, whatever its distance, by its documents; the larger share counts.
    """
    both = near_disclosing(docs, own).unionByName(far_disclosing(docs, own))
    return both.groupBy("term").agg(F.max_by(F.struct("entities", "near_n", "n", "bits", "share"), "share").alias("x")).select("term", "x.*")


def _counts(spoken: DataFrame, known: DataFrame) -> DataFrame:
    """How often each of known(_t) is spoken(_w): _t, n; all other words count for a null."""
    if known.limit(SMALL + 1).count() <= SMALL:
        return spoken.join(F.broadcast(known), F.col("_w") == F.col("_t"), "left").groupBy("_t").agg(F.count(F.lit(1)).alias("n"))
    return spoken.groupBy("_w").agg(F.count(F.lit(1)).alias("n")).join(known, F.col("_w") == F.col("_t"), "left").groupBy("_t").agg(F.sum("n").alias("n"))


def near_disclosing(docs: DataFrame, near: DataFrame) -> DataFrame:
    """Terms that reveal entities near them: term, entities, near_n, n, bits, share.

    ``near`` has the near of every document. A term's bits are the pointwise mutual information
    of "this token is the term" and "this token lies near an entity", over all tokens of the
    corpus; its share is the bits over the most that they could be. Copies of one entity count as
    one, so that repeated text does not make its words look telling.
    """
    tokens = near.where(F.size("near") > 0)
    entities = tokens.select(F.explode("near").alias("x")).groupBy("x.term").agg(F.count_distinct("x.ent").alias("entities"))
    places = tokens.select(F.explode(F.array_distinct(F.transform("near", lambda x: F.struct(x["s"].alias("s"), x["term"].alias("term"))))).alias("x"))
    counted = places.groupBy("x.term").agg(F.count(F.lit(1)).alias("near_n"))
    candidates = scratch.store(entities.join(counted, "term").select("term", "entities", "near_n"), "terms")
    near_total = candidates.agg(F.sum("near_n")).first()[0] or 0
    likely = candidates.where(F.col("entities") >= MIN_ENTITIES)
    spoken = docs.select(F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), r"[^\p{L}]+")).alias("_w")).where("_w <> ''").select(F.lower("_w").alias("_w"))
    counts = scratch.store(_counts(spoken, likely.select(F.col("term").alias("_t"))), "term-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = F.log2(F.lit(float(total)) / F.lit(float(max(near_total, 1))))
    bits = F.log2(F.col("near_n") / F.col("n")) + most
    return likely.join(counts, F.col("term") == F.col("_t")).select("term", "entities", "near_n", "n", bits.alias("bits"), F.when(most > 0, bits / most).otherwise(F.lit(0.0)).alias("share")).where(F.col("share") >= GENERALISE)


def far_disclosing(docs: DataFrame, own: DataFrame) -> DataFrame:
    """Terms that reveal entities anywhere in their documents, in the columns of near_disclosing.

    ``own`` has the far and lead of every document with an entity. A term's bits are the pointwise
    mutual information of "this document has the term outside entities" and "this document has an
    entity", over all documents; near_n and n count documents. A document stands for one entity, its
    lead, so that a long one does not make all its words look telling. As all words of such
    documents are tried, the frequency must be so far above the usual one that chance gives less than one such term
    (Chernoff's bound). Where every document has an entity, no term says anything.
    """
    held = own.where(F.col("lead").isNotNull())
    with_entity, every = held.count(), docs.count()
    together = held.select(F.explode("far").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("near_n"))
    likely = scratch.store(together.where(F.col("near_n") >= MIN_ENTITIES), "far-terms")
    tried = likely.count()
    if not tried or with_entity == every:
        none = F.lit(0.0)
        return likely.select("term", F.col("near_n").alias("entities"), "near_n", F.col("near_n").alias("n"), none.alias("bits"), none.alias("share")).limit(0)
    spoken = docs.select(F.explode(terms_of(F.coalesce(F.col("text"), F.lit("")))).alias("_w"))
    usual = with_entity / every
    most = -math.log2(usual)
    counts = _counts(spoken, likely.select(F.col("term").alias("_t")))
    among = F.col("near_n") / F.col("n")
    bits = F.log2(among) + most
    rest = F.when(among < 1, (1 - among) * F.log2((1 - among) / (1 - usual))).otherwise(F.lit(0.0))
    sure = F.col("n") * (among * bits + rest) >= math.log2(tried)
    judged = likely.join(counts, F.col("term") == F.col("_t")).select("term", "near_n", "n", bits.alias("bits"), (bits / most).alias("share"), sure.alias("sure"))
    judged = scratch.store(judged.where((F.col("share") >= GENERALISE) & F.col("sure")).drop("sure"), "far-judged")
    met = held.select("lead", F.explode("far").alias("_t")).join(judged.select("term"), F.col("_t") == F.col("term"))
    entities = met.groupBy(F.col("term").alias("_term")).agg(F.count_distinct("lead").alias("entities")).where(F.col("entities") >= MIN_ENTITIES)
    return judged.join(entities, F.col("term") == F.col("_term")).select("term", "entities", "near_n", "n", "bits", "share")


def with_told(df: DataFrame, terms: DataFrame) -> DataFrame:
    """Add told and gone, the disclosing terms and those to be removed, for found documents; null or empty where a text has none.

    Up to INLINE terms are literals of the plan, alike for every document. Beyond, the words of
    each text (by its hash) meet the stored terms in a join, and a document carries those of its own.
    """
    few = terms.limit(INLINE + 1).collect()
    strings = "array<string>"
    if len(few) <= INLINE:
        listed_terms = lambda keep: F.array(*[F.lit(r["term"]) for r in few if keep(r)]).cast(strings)
        return df.withColumns({"told": listed_terms(lambda r: True), "gone": listed_terms(lambda r: r["share"] >= REMOVE)})
    keyed = df.withColumn("key", F.xxhash64("text"))
    words = keyed.select("key", F.explode(terms_of(F.col("text"))).alias("word"))
    met = words.join(terms.select("term", "share"), F.col("word") == F.col("term"))
    own = met.groupBy(F.col("key").alias("_key")).agg(F.collect_set("term").alias("told"), F.collect_set(F.when(F.col("share") >= REMOVE, F.col("term"))).alias("gone"))
    return keyed.join(own, F.col("key") == F.col("_key"), "left").drop("key", "_key")


def all_spans() -> Column:
    """Base spans and every disclosing term of the text outside them, near an entity or not, by start, then kind."""
    told = located(F.col("text"), r"\p{L}+", 4, lambda m: F.array_contains("told", F.lower(m)))
    clear = F.filter(told, lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    some = F.size(F.coalesce("told", F.array().cast("array<string>"))) > 0
    spoken = some & F.arrays_overlap(terms_of(F.col("text")), F.col("told"))  # only texts that have such a term are searched
    both = F.sort_array(F.concat(F.col("base"), F.transform(clear, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.lower(x["m"]).alias("m")))))
    return F.when(spoken, both).otherwise(F.col("base"))


def listed(spans: Column) -> Column:
    """The spans as text: kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.element_at(kinds, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base (spans), spans (all, with the method's).

    A null text is empty; an empty table gives an empty result; other columns are ignored.
    """
    whole = found(docs.select("doc_id", "text"))
    own = scratch.store(whole.select(F.col("row.doc_id").alias("doc_id"), "base", "near", "far", "lead"), "pii")
    terms = scratch.store(disclosing(docs, own), "disclosing")
    if terms.limit(1).count():
        # terms are looked up in the texts, which are read again rather than stored
        own = with_told(whole, terms).withColumn("doc_id", F.col("row.doc_id")).withColumn("spans", all_spans())
    else:
        own = own.withColumn("spans", F.col("base"))
    kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS[:4])]
    return own.select("doc_id", *counts, "base", "spans")


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in text replaced: base kinds and generalised terms by labels, removed terms by nothing.

    Where spans overlap, the first by start, then kind, is replaced. n_chars, if there is such a
    column, follows the new text; other columns and texts without a span stay as they are.
    """
    df = found(docs)
    terms = scratch.store(disclosing(docs, scratch.store(df.where(F.size("base") > 0).select("near", "far", "lead"), "pii")), "disclosing")
    df = with_told(df, terms).withColumn("spans", all_spans())
    start = F.struct(F.lit(0).alias("to"), _none().alias("out"))
    keep = lambda now, x: F.when(x["s"] >= now["to"], F.struct(x["e"].alias("to"), F.concat(now["out"], F.array(x)).alias("out"))).otherwise(now)
    df = df.withColumn("clear", F.aggregate("spans", start, keep, lambda end: end["out"]))
    labels = F.array(*[F.lit(LABELS[k]) for k in KINDS[:4]], F.lit("<TERM>"))

    def piece(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("clear", i - 1)["e"]).otherwise(F.lit(0))
        shown = F.when((x["k"] == 4) & F.array_contains("gone", x["m"]), F.lit("")).otherwise(F.element_at(labels, x["k"] + 1))
        return F.concat(F.substring("text", before + 1, x["s"] - before), shown)

    end = F.element_at("clear", -1)["e"]
    clean = F.concat(F.array_join(F.transform("clear", piece), ""), F.substring("text", end + 1, F.length("text")))
    some = F.size("clear") > 0
    df = df.withColumn("clean", F.when(some, clean).otherwise(F.col("row.text").cast("string")))
    out = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(some, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    return df.select(*[out[c].alias(c) if c in out else F.col(f"row.`{c}`") for c in docs.columns])
