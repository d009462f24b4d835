"""Quality rules: distribution divergence from language references, beside base counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITESPACE, durable, let, words

#: Common words of a language: at most COMMON of those that a share LEAST_SHARE of its documents has, the most frequent
#: first; longer words are no candidates. A language with fewer documents than LEAST_DOCS has no reference.
COMMON, LEAST_SHARE, LONGEST, LEAST_DOCS = 12, 0.05, 12, 20
#: Character classes in the order in which they are taken out of a text; what is left is the last class.
CLASSES = [("lower", "[a-z]+"), ("space", WHITESPACE), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"), ("punct", "[\\x21-\\x7E]+"), ("letter", "\\p{L}+")]
WINDOW = 5
LEAST_CHARS, LEAST_WORDS = 200, 60
#: Limits: of the class distance, and of the word distance as a share of that of a text without any common word.
MOST_CLASS_DISTANCE, MOST_WORD_SHARE = 0.35, 0.93


def repeat_words(ws: Column, window: int = WINDOW) -> Column:
    """Words of ws in windows that occur twice or more in it, the first occurrence included."""
    def covered(keys: Column) -> Column:
        def places(pairs: Column) -> Column:
            same = lambda p, k: F.coalesce(p["k"] == F.get(pairs, k)["k"], F.lit(False))
            return F.sort_array(F.transform(F.filter(pairs, lambda p, j: same(p, j - 1) | same(p, j + 1)), lambda p: p["i"]))

        add = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["at"])).alias("n"), i.alias("at"))
        repeated = let(F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), places)
        count = F.aggregate(repeated, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("at")), add)["n"]
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(count)

    def keyed(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    return F.when(F.size(ws) < window, F.lit(0)).otherwise(let(let(F.transform(ws, lambda w: F.xxhash64(w)), keyed), covered))


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """The common words of each language with LEAST_DOCS documents or more, lower-cased, from all documents (share of documents, then word)."""
    own = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = own.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    short = F.filter(F.array_distinct(words(F.lower("text"))), lambda w: F.length(w) <= LONGEST)
    said = own.select("lang", F.explode(short).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    often = said.join(sizes, "lang").where(F.col("n") >= LEAST_SHARE * F.col("docs"))  # one over LEAST_SHARE times a document's words, at most
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    found = {r["lang"]: [] for r in sizes.collect()}  # a row a language
    for r in often.withColumn("rank", rank).where(F.col("rank") <= COMMON).orderBy("lang", "rank").collect():  # COMMON rows a language
        found[r["lang"]].append(r["word"])
    return found


def profile(docs: DataFrame, bins: list[str], text_col: str = "text") -> DataFrame:
    """docs without the text, with base counts, class counts (__c) and the common words (__b: numbers in bins, __n: counts)."""
    keep = [c for c in docs.columns if c != text_col]
    df = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__t0"))
    df = df.withColumn("__w", words(F.col("__t0")))
    for k, (_, run) in enumerate(CLASSES):
        df = df.withColumn(f"__t{k + 1}", F.regexp_replace(f"__t{k}", run, ""))
    sizes = [F.length(f"__t{k}").cast("long") for k in range(len(CLASSES) + 1)]
    of = dict(zip([name for name, _ in CLASSES], range(len(CLASSES)), strict=True))
    lines = F.filter(F.split("__t0", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    spelled = [v for w in bins for v in dict.fromkeys((w, w.capitalize()))]
    df = df.select(
        *keep, "__w", F.size("__w").cast("long").alias("n_words"), (sizes[0] - (sizes[of["space"]] - sizes[of["space"] + 1])).alias("word_chars"),
        (sizes[of["symbol"]] - sizes[of["symbol"] + 1]).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.array(*[sizes[k] - sizes[k + 1] for k in range(len(CLASSES))], sizes[-1]).alias("__c"),
        F.sort_array(F.transform(F.filter("__w", lambda w: w.isin(spelled)), F.lower)).alias("__s"),
    )
    df = df.withColumn("__d", F.array_distinct("__s")).withColumn("__at", F.transform("__d", lambda w: F.array_position("__s", w)))
    following = lambda i: F.coalesce(F.get("__at", i + 1), F.size("__s") + 1)
    listed = F.array(*[F.lit(w) for w in bins]).cast("array<string>")
    return df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat_words(F.col("__w")).cast("long").alias("n_repeat_words"), "__c",
        F.transform("__d", lambda w: F.array_position(listed, w).cast("int") - 1).alias("__b"),
        F.transform("__at", lambda p, i: (following(i) - p).cast("long")).alias("__n"),
    )


def references(profiles: DataFrame, languages: list[str], bins: list[str], lang_col: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """By language: shares of the character classes, and of each bin and all other words, over all its documents."""
    own = profiles.where(F.col(lang_col).isin(languages))
    size = len(CLASSES) + 1
    sums = [F.sum(F.get("__c", F.lit(k))).alias(f"c{k}") for k in range(size)] + [F.sum("n_words").alias("words")]
    found, spoken = {}, {}
    for r in own.select(lang_col, F.explode(F.arrays_zip("__b", "__n")).alias("x")).groupBy(lang_col, F.col("x.__b").alias("b")).agg(F.sum("x.__n").alias("n")).collect():  # a row a language and bin
        spoken[r[lang_col], r["b"]] = r["n"]
    for r in own.groupBy(lang_col).agg(*sums).collect():  # a row a language
        chars, said = sum(r[f"c{k}"] for k in range(size)), r["words"]
        if chars and said:
            shares = [spoken.get((r[lang_col], k), 0) / said for k in range(len(bins))]
            found[r[lang_col]] = ([r[f"c{k}"] / chars for k in range(size)], [*shares, max(0.0, 1 - sum(shares))])
    return found


def _halves(p: Column, q: Column) -> Column:
    """What a bin with shares p and q adds to the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def class_distance(counts: Column, ref: list[float]) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    shares = F.array(*[F.lit(x) for x in ref])
    parts = F.zip_with(counts, shares, lambda c, q: _halves(c / total, q))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def word_distance(bins: Column, counts: Column, said: Column, ref: list[float]) -> Column:
    """Distance over common words and the rest; a bin that the text lacks adds half its reference share."""
    shares = F.array(*[F.lit(x) for x in ref])
    here = F.zip_with(bins, counts, lambda b, n: F.struct(_halves(n / said, F.get(shares, b)).alias("d"), F.get(shares, b).alias("q"), n.alias("n")))
    add = lambda a, x: F.struct((a["d"] + x["d"]).alias("d"), (a["q"] + x["q"]).alias("q"), (a["n"] + x["n"]).alias("n"))
    sums = let(F.aggregate(here, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q"), F.lit(0).cast("long").alias("n")), add),
               lambda s: s["d"] + (F.lit(1.0 - ref[-1]) - s["q"]) / 2 + _halves(1 - s["n"] / said, F.lit(ref[-1])))
    return F.sqrt(F.greatest(F.lit(0.0), sums))


def silent_distance(ref: list[float]) -> float:
    """word_distance() of a text that has none of the common words: what is left of a language where only its letters are."""
    rest = ref[-1]
    m = (1 + rest) / 2
    return math.sqrt(max(0.0, (1 - rest) / 2 + (-math.log2(m) + (rest * math.log2(rest / m) if rest > 0 else 0.0)) / 2))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the text, with base counts, base_failed, ref_lang, class_distance, word_distance and kept.

    Base: words ``[^\\x20\\x09-\\x0D]+``, their code points, symbols, repeated lines, words in repeated 5-word windows;
    base_failed if there are under 10 words or over a fifth of them repeat. A null text has no words and fails.

    References are the character-class and common-word histograms of all documents of each language with LEAST_DOCS
    documents or more; its common words are learned from them too. A document goes by the language whose two
    Jensen-Shannon distances (0 to 1) have the smallest sum (of equal sums the first language). Distances are null,
    and not judged, for texts with fewer than LEAST_CHARS characters (classes) or LEAST_WORDS words (words), and for
    documents of a language that has no reference. kept is false if base_failed or a distance is over its limit:
    MOST_CLASS_DISTANCE, and for words MOST_WORD_SHARE of the distance that a text without common words has from the
    same reference (a fixed limit would be above or below it as the language has few or many such words). A null lang
    is judged, but no reference. Rows repeat as they come; an empty table stays empty; input columns with
    the names of the new ones are replaced.
    """
    common = common_words(docs, text_col, lang_col)
    languages, bins = sorted(common), sorted({w for own in common.values() for w in own})
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ref_lang", "class_distance", "word_distance", "kept")
    profiles = durable(profile(docs.drop(*[c for c in new if c in docs.columns]), bins, text_col))
    refs = references(profiles, languages, bins, lang_col)
    keep = [c for c in profiles.columns if c not in new and not c.startswith("__")]
    chars = F.aggregate("__c", F.lit(0).cast("long"), lambda a, x: a + x)
    each = [
        F.struct(
            F.when(chars >= LEAST_CHARS, class_distance(F.col("__c"), c)).alias("c"),
            F.when(F.col("n_words") >= LEAST_WORDS, word_distance(F.col("__b"), F.col("__n"), F.col("n_words"), w)).alias("w"),
            F.lit(lang).alias("lang"), F.lit(MOST_WORD_SHARE * silent_distance(w)).alias("most"),
        )
        for lang, (c, w) in sorted(refs.items())
    ]
    best = F.lit(None).cast("struct<sum:double,lang:string,c:double,w:double,most:double>")
    if each:
        order = lambda s: F.struct((F.coalesce(s["c"], F.lit(0.0)) + F.coalesce(s["w"], F.lit(0.0))).alias("sum"), s["lang"].alias("lang"), s["c"].alias("c"), s["w"].alias("w"), s["most"].alias("most"))
        known = F.col(lang_col).isNull() | F.col(lang_col).isin(list(refs))
        best = F.when(known, F.array_min(F.transform(F.array(*each), order)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = F.coalesce(F.col("__best.c") <= MOST_CLASS_DISTANCE, F.lit(True)) & F.coalesce(F.col("__best.w") <= F.col("__best.most"), F.lit(True))
    return profiles.withColumn("__best", best).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(F.coalesce("__best.c", "__best.w").isNotNull(), F.col("__best.lang")).alias("ref_lang"),
        F.col("__best.c").alias("class_distance"), F.col("__best.w").alias("word_distance"), (~failed & fine).alias("kept"),
    )
