"""Quality rules by distribution divergence, on DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequarry.llm import native, scratch

#: Common words of four languages, each list in order of frequency.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with", "as", "are", "this", "by"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "nicht", "ein", "dem", "im"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}
VOCABULARY = sorted({w for ws in COMMON_WORDS.values() for w in ws})
#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Largest Jensen-Shannon distance (base 2, so from 0 to 1) of a document's character classes from its language's.
MAX_CLASS_DISTANCE = 0.25
#: A text fails by its words at this share of the distance that a text without a common word has from
#: its language, if at least so many common words were to be expected in it.
WORDLESS, EXPECTED = 0.95, 8
#: A language of fewer documents than this is judged by the reference of all documents.
MIN_REFERENCE = 20
#: Up to this many languages, references are broadcast; beyond, they are joined.
SMALL = 5_000
CLASSES = ("upper", "digit", "mark", "symbol", "wide", "blank", "other")


#: The characters of the classes that are counted by name, and those that no such class has.
UPPER = "".join(map(chr, [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
DIGITS, MARKS = "0123456789", ".,;:!?'\"()-"
PLAIN = "".join(map(chr, range(0x61, 0x7B))) + " \t\n\v\f\r"
ASCII = "".join(map(chr, range(0x80)))


def packed(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns to keep, all by default), lang and t (text, a null empty) of every document.

    Nothing of ``docs`` stands beside what is computed, so its other columns may have any name.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    return docs.select(row.alias("row"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))


def counted(df: DataFrame) -> DataFrame:
    """Add w (words), word_chars and the two histograms, classes and common, to packed documents.

    The words' histogram ends with the count of all other words, capitalised ones among them.
    Counting goes by what translate and array_remove take away: of the letters and blanks first,
    so that the passes for the single classes see the few characters that are left.
    """
    left = lambda text, those: F.length(F.translate(text, those, "")).cast("long")
    df = df.withColumn("w", native.words(F.col("t"))).withColumn("rare", F.translate("t", PLAIN, ""))
    df = df.withColumns({"chars": F.length("t").cast("long"), "word_chars": F.length(F.array_join("w", "")).cast("long"), "rares": F.length("rare").cast("long")})
    upper, digit, mark, symbol = (F.col("rares") - left("rare", those) for those in (UPPER, DIGITS, MARKS, SYMBOLS))
    wide = left("rare", ASCII + UPPER[26:])
    df = df.withColumn("known", F.array(upper, digit, mark, symbol, wide, F.col("chars") - F.col("word_chars")))
    rest = F.col("chars") - F.aggregate("known", F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("classes", F.concat("known", F.array(rest)))
    df = df.withColumn("hits", F.filter("w", lambda w: w.isin(VOCABULARY)))
    found = F.transform(F.array(*map(F.lit, VOCABULARY)), lambda w: (F.size("hits") - F.size(F.array_remove("hits", w))).cast("long"))
    return df.withColumn("common", F.concat(found, F.array((F.size("w") - F.size("hits")).cast("long"))))


def references(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summed histograms of documents of MIN_WORDS or more words, from the stored counts.

    First those of each language with MIN_REFERENCE of them, as ref_lang, ref_classes, ref_common,
    then those of all documents in one row (null without any).
    """
    bins = own.where(F.col("n") >= MIN_WORDS).select("lang", F.posexplode(F.concat("classes", "common"))).groupBy("lang", "pos").agg(F.sum("col").alias("total"), F.count(F.lit(1)).alias("docs"))
    held = F.transform(F.sort_array(F.collect_list(F.struct("pos", "total"))), lambda x: x["total"])
    parts = (F.slice("every", 1, len(CLASSES)).alias("ref_classes"), F.slice("every", len(CLASSES) + 1, len(VOCABULARY) + 1).alias("ref_common"))
    by = bins.where(F.col("docs") >= MIN_REFERENCE).groupBy(F.col("lang").alias("ref_lang")).agg(held.alias("every"))
    whole = bins.groupBy("pos").agg(F.sum("total").alias("total")).agg(held.alias("every"))
    return by.select("ref_lang", *parts), whole.select(*parts)


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence, base 2, of two histograms (arrays of counts); null if either is empty."""
    total = lambda h: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(F.transform(p, lambda x: F.try_divide(x, total(p))), F.transform(q, lambda x: F.try_divide(x, total(q))), lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def _repeated(df: DataFrame) -> DataFrame:
    """Add repeat: words in three-word windows that come twice or more, each word once.

    Windows are compared by a 64-bit hash inside one document; sorting puts equal ones side by side.
    """
    n = F.size("w")
    df = df.withColumn("grams", F.when(n >= 3, F.transform(F.slice("w", 1, F.greatest(n - 2, F.lit(1))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("any", F.size(F.array_distinct("grams")) < F.size("grams"))
    none, pairs = F.array().cast("array<bigint>"), "array<struct<g:bigint,i:int>>"
    df = df.withColumn("s", F.when(F.col("any"), F.sort_array("grams")).otherwise(none))
    df = df.withColumn("dups", F.array_distinct(F.filter("s", lambda g, i: F.coalesce(F.get("s", i - 1) == g, F.lit(False)))))
    many = F.size("dups") > 256  # then looking each window up in a list would be quadratic
    df = df.withColumn("sorted", F.when(many, F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(F.array().cast(pairs)))
    same = lambda e, i: F.coalesce(F.get("sorted", i - 1)["g"] == e["g"], F.lit(False)) | F.coalesce(F.get("sorted", i + 1)["g"] == e["g"], F.lit(False))
    looked = F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains("dups", g), i)), lambda i: i.isNotNull())
    df = df.withColumn("twice", F.when(many, F.sort_array(F.transform(F.filter("sorted", same), lambda e: e["i"]))).when(F.size("dups") > 0, looked).otherwise(F.array().cast("array<int>")))
    cover = F.transform("twice", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("twice", i + 1) - x, F.lit(3))))
    return df.withColumn("repeat", F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x))


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Everything that is counted in a text, of every document, counted once and stored without the text (unless it is kept)."""
    df = _repeated(counted(packed(docs, keep)))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{native.BLANKS}]"))
    df = df.withColumn("lines", lines).withColumn("dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    return scratch.store(df.select("row", "lang", F.size("w").cast("long").alias("n"), "word_chars", "classes", "common", "repeat", "dup_lines"), "counts")


def _judged(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """row and the columns that judged() adds."""
    df = measured(docs, keep)
    refs, whole = references(df)
    few = refs.limit(SMALL + 1).collect()
    if len(few) <= SMALL:
        refs = F.broadcast(docs.sparkSession.createDataFrame(few, refs.schema))
    else:
        refs = scratch.store(refs, "references")
    df = df.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    own_reference = F.col("ref_common").isNotNull()
    every = F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("common", F.when(own_reference, F.col("common")).otherwise(F.array(every - F.element_at("common", -1), F.element_at("common", -1))))
    none = F.when(own_reference, F.array(*[F.lit(0).cast("long")] * len(VOCABULARY), F.lit(1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    df = df.withColumn("none", none)
    for name, value in zip(whole.columns, whole.first() or (), strict=True):
        if value:
            value = [sum(value[:-1]), value[-1]] if name == "ref_common" else value
            df = df.withColumn(name, F.coalesce(name, F.array(*map(F.lit, value)).cast("array<bigint>")))
    df = df.withColumn("bare", F.sqrt(F.greatest(F.lit(0.0), divergence(F.col("none"), F.col("ref_common")))))
    df = df.withColumn("class_d", F.sqrt(F.greatest(F.lit(0.0), divergence(F.col("classes"), F.col("ref_classes")))))
    df = df.withColumn("word_d", F.sqrt(F.greatest(F.lit(0.0), divergence(F.col("common"), F.col("ref_common")))))
    n, repeat = F.col("n"), F.col("repeat")
    failed = (n < MIN_WORDS) | (repeat * 100 > n * 50)
    far = F.coalesce(F.col("class_d") > MAX_CLASS_DISTANCE, F.lit(False))
    every = F.aggregate("ref_common", F.lit(0).cast("long"), lambda a, x: a + x)
    expected = n * (every - F.element_at("ref_common", -1)) >= EXPECTED * every
    wordless = F.coalesce(expected & (F.col("word_d") >= WORDLESS * F.col("bare")), F.lit(False))
    out = {
        "q_n_words": n, "q_word_chars": F.col("word_chars"), "q_n_symbols": F.col("classes")[CLASSES.index("symbol")], "q_n_dup_lines": F.col("dup_lines"),
        "q_n_repeat_words": repeat, "q_base_failed": failed, "q_class_distance": F.col("class_d"), "q_word_distance": F.col("word_d"), "q_kept": ~failed & ~far & ~wordless, "q_wordless": wordless,
    }
    return df.select("row", *[c.alias(name) for name, c in out.items()])


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` with word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words, base_failed, the distances, kept and wordless.

    References come from all documents of a language (column lang, null a language of its own).
    A document fails the method's rule when its character classes lie further than the largest
    distance from its language's, or when it is wordless: about as far from its language's common
    words as a text that has none of them, and long enough to expect some. Documents under MIN_WORDS
    words fail the base rule already; a language with few documents is judged by all documents'
    reference, for words by how many are common in any language. A null text counts as empty.
    New columns start with q_ and take the place of columns of these names; all others pass
    through untouched. Repeated rows are judged alike; an empty table gives an empty result.
    """
    own = _judged(docs)
    new = own.columns[1:]
    return own.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in new], *new)


def rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    own = _judged(docs, ["doc_id"])
    return own.select("row.doc_id", *[F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")], "q_class_distance", "q_word_distance")


def passing(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns as they were, whatever their names."""
    return _judged(docs).where("q_kept").select("row.*")
