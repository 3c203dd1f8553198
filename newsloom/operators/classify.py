"""AGG-2: lexicon classification of headlines and of whole clusters.

The lexicon is a bounded parameter, so it is compiled into array expressions and the
classification of a headline needs no shuffle. A text yields its list of *hits*
(category, signal, weight); a cluster is classified from the distinct hits of all its
texts, a set no larger than the lexicon however many articles the cluster has.

A lexicon beyond what fits a plan is a table: stems and word runs of the texts meet its terms in one join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import dims
from newsloom.functions import text as tx
from newsloom.session import cut, small_side

# Fixed patterns.
STRIKE = (
    r"(?i)(?:^|[^A-Za-z0-9_])(?:strikes?|hits?)(?![A-Za-z0-9_]).{0,90}(?<![A-Za-z0-9_])"
    r"(?:base|bases|border|capital|cities|city|military|site|sites|territory)(?:[^A-Za-z0-9_]|$)"
)
TARIFF = r"(?i)(?:^|[^A-Za-z0-9_])tariffs?(?:[^A-Za-z0-9_]|$)"
BULLETIN = r"(?i)(?:^|[^A-Za-z0-9_])(?:latest )?news bulletin(?:[^A-Za-z0-9_]|$)"
HIT = "struct<category:string,signal:string,weight:int>"


def _split_terms(terms: tuple[str, ...]) -> tuple[list[str], list[str]]:
    words, phrases = [], []
    for term in terms:
        term = re.sub(r"\s+", " ", term.strip().lower())
        bucket, key = (phrases, term) if " " in term else (words, tx.stem_py(term))
        if key not in bucket:
            bucket.append(key)
    return words, phrases


def spaced(c: Column) -> Column:
    """Lower case, every punctuation run as ``|``, single blanks, blank-padded."""
    c = F.lower(tx.fold_width(F.coalesce(c, F.lit(""))))
    c = F.regexp_replace(c, r"[^\p{L}\p{N}\s]+", " | ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(" "))


def _phrase_needle(p: str) -> str:
    return " " + re.sub(r"\s+", " ", re.sub(r"[^\w\s]+", " | ", p)).strip() + " "


def hits(text: Column, tokens: Column, lexicon: dims.Lexicon) -> Column:
    """array<struct<category, signal, weight>> of a text."""
    return tx.let(spaced(text), lambda padded: _hits(text, padded, tokens, lexicon))


def _hits(text: Column, padded: Column, tokens: Column, lexicon: dims.Lexicon) -> Column:
    parts = []

    def entry(category: str, weight: int):
        return lambda s: F.struct(
            F.lit(category).alias("category"), s.alias("signal"), F.lit(weight).alias("weight")
        )

    def flag(category: str, signal: str, weight: int, cond: Column) -> Column:
        one = F.array(entry(category, weight)(F.lit(signal)))
        return F.when(cond, one).otherwise(F.array().cast(f"array<{HIT}>"))

    for category, terms in lexicon.terms:
        words, phrases = _split_terms(terms)
        if words:
            parts.append(F.transform(F.array_intersect(tokens, tx.lit_array(words)), entry(category, 1)))
        if phrases:
            parts.append(
                F.filter(
                    F.array(*[F.when(padded.contains(_phrase_needle(p)), entry(category, 2)(F.lit(p))) for p in phrases]),
                    lambda h: h.isNotNull(),
                )
            )
    low = F.lower(tx.fold_width(F.coalesce(text, F.lit(""))))
    named = {c for c, _ in lexicon.terms}
    if "Conflict and security" in named:
        parts.append(flag("Conflict and security", "#strike", 2, low.rlike(STRIKE)))
    if "Economy" in named:
        parts.append(flag("Economy", "#tariff", 2, low.rlike(TARIFF)))
    parts.append(flag("#bulletin", "#bulletin", 0, low.rlike(BULLETIN)))
    niche = tx.lit_array([tx.stem_py(t) for t in dims.NICHE_TERMS])
    parts.append(flag("#niche", "#niche", 0, F.arrays_overlap(tokens, niche)))
    return F.concat(*parts)


def _in_category(category: str):
    return lambda h: h["category"] == category


def category_of(hit_list: Column, lexicon: dims.Lexicon) -> Column:
    """Highest score, ties by fixed priority; without any hit a default."""
    ranked = []
    for category, _ in lexicon.terms:
        score = F.aggregate(
            F.filter(hit_list, _in_category(category)),
            F.lit(0),
            lambda acc, h: acc + h["weight"],
        )
        ranked.append(
            F.struct(score.alias("s"), F.lit(-dims.TIE_PRIORITY.index(category)).alias("p"), F.lit(category).alias("c"))
        )
    best = F.array_max(F.array(*ranked))
    has = lambda name: F.exists(hit_list, lambda h: h["category"] == name)
    return (
        F.when(has("#bulletin"), "Other")
        .when(best["s"] > 0, best["c"])
        .when(has("#niche"), "Other")
        .otherwise("Local affairs")
    )


def classify(text: Column, lexicon: dims.Lexicon, tokens: Column | None = None) -> Column:
    return category_of(hits(text, tx.tokens(text) if tokens is None else tokens, lexicon), lexicon)


def classify_headlines(articles: DataFrame, lexicon: dims.Lexicon, text: str = "title") -> DataFrame:
    """AGG-2 over an article table; two narrow projections, no shuffle."""
    return (
        articles.withColumn("_t", tx.tokens(F.col(text)))
        .withColumn("_h", hits(F.col(text), F.col("_t"), lexicon))
        .withColumn("category", category_of(F.col("_h"), lexicon))
        .drop("_t", "_h")
    )


def classify_groups(texts: DataFrame, key: str, text: str, lexicon: dims.Lexicon) -> DataFrame:
    """Category of all texts of a key read as one; state per key is bounded by the lexicon."""
    found = (
        texts.withColumn("_t", tx.tokens(F.col(text)))
        .withColumn("_h", hits(F.col(text), F.col("_t"), lexicon))
        .select(key, F.explode_outer("_h").alias("h"))
        .groupBy(key)
        .agg(F.collect_set("h").alias("_h"))
    )
    return found.select(key, category_of(F.col("_h"), lexicon).alias("category"))


# --- the lexicon as a table ---------------------------------------------------------------
def prepare_lexicon(terms: DataFrame) -> DataFrame:
    """(category, signal, weight, needle) of (category, term): a stem of weight 1 or a word run of weight 2."""
    term = F.trim(F.regexp_replace(F.lower(F.col("term")), r"\s+", " "))
    run = F.trim(F.regexp_replace(F.regexp_replace(term, r"[^\p{L}\p{N}_\s]+", " | "), r"\s+", " "))
    phrase = term.contains(" ")
    rows = terms.filter(F.col("category").isNotNull() & (term != "")).select(
        "category", F.when(phrase, term).otherwise(tx.stem(term)).alias("signal"), F.when(phrase, 2).otherwise(1).alias("weight"),
        F.when(phrase, run).otherwise(tx.stem(term)).alias("needle"),
    )
    return cut(rows.distinct())


def classify_by_table(articles: DataFrame, lexicon: DataFrame, text: str = "title", key: str = "id") -> DataFrame:
    """AGG-2 with a lexicon of any size (``prepare_lexicon``); ``key`` is unique.

    The lexicon is broadcast if it is small when measured, else both sides are shuffled by the term.
    """
    found = lexicon.agg(F.collect_set("category").alias("c"), F.max(F.when(F.col("weight") == 2, F.size(F.split("needle", " ")))).alias("n")).first()
    named = dims.lexicon_from({c: [] for c in sorted(found["c"])})  # categories are the fixed ones, or an error
    base = articles.select(key, tx.tokens(F.col(text)).alias("_t"), F.split(F.trim(spaced(F.col(text))), " ").alias("_w"))
    size = F.size("_w")

    def run(n: int):
        return lambda i: F.struct(F.lit(2).alias("weight"), F.array_join(F.slice("_w", i, n), " ").alias("needle"))

    runs = [F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), run(n))) for n in range(2, (found["n"] or 1) + 1)]
    stems = F.transform("_t", lambda t: F.struct(F.lit(1).alias("weight"), t.alias("needle")))
    none = F.array().cast("array<struct<weight:int,needle:string>>")
    met = base.select(key, F.inline(F.array_distinct(F.concat(stems, *[F.coalesce(r, none) for r in runs]))))
    hit = F.struct("category", "signal", "weight")
    scored = met.join(small_side(lexicon), ["weight", "needle"]).groupBy(key).agg(F.collect_set(hit).alias("_h"))
    flags = hits(F.col(text), F.col("_t"), named)
    every = F.concat(flags, F.coalesce("_h", F.array().cast(f"array<{HIT}>")))
    return (
        articles.join(scored, key, "left").withColumn("_t", tx.tokens(F.col(text))).withColumn("_h", every)
        .withColumn("category", category_of(F.col("_h"), named)).drop("_t", "_h")
    )
