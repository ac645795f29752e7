"""Relational matching of paired texts: two-text TF-IDF, BM25 against the ideal, skills and vocabulary phrases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.arrays import let
from ..functions.resume import cleaned

#: Function words left out of TF-IDF terms; pass another list where a larger one is wanted.
STOP_WORDS = (
    "a about after all also an and any are as at be been but by can could did do does for from had has have he her his how i if in into is it its "
    "may me more most my no not of on only or other our out over she should so some such than that the their them then there these they this "
    "those to under up was we were what when where which who will with would you your"
).split()
LONGEST = 2000


def _terms(c: Column, stop: Sequence[str]) -> Column:
    """Words of two characters or more without stop words, and pairs of what remains side by side."""
    words = F.regexp_extract_all(F.lower(c), F.lit(rf"[{t.WORD}]{{2,}}"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(list(stop)))
    pairs = F.zip_with(
        F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))),
        F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(kept, pairs)


def _runs(source: Column, target: Column) -> Column:
    """(term, a, b): how often each side has a term, from one sort of both lists; nothing leaves the row."""
    sided = lambda c, side: F.transform(c, lambda x: F.struct(x.alias("term"), F.lit(side).alias("side")))

    def starts(own: Column) -> Column:
        new = F.transform(own, lambda x, i: F.when((i == 0) | (F.get(own, i - 1)["term"] != x["term"]), i))
        return let(F.filter(new, lambda i: i.isNotNull()), lambda at: F.transform(at, lambda i, k: one(own, i, F.coalesce(F.get(at, k + 1), F.size(own)))))

    def one(own: Column, start: Column, stop: Column) -> Column:
        some = F.slice(own, start + 1, stop - start)
        b = F.aggregate(some, F.lit(0), lambda n, x: n + x["side"])
        return F.struct(F.get(own, start)["term"].alias("term"), (stop - start - b).cast("double").alias("a"), b.cast("double").alias("b"))

    return let(F.sort_array(F.concat(sided(source, 0), sided(target, 1))), starts)


def _total(runs: Column, value) -> Column:
    return F.aggregate(runs, F.lit(0.0), lambda n, r: n + value(r))


def _percent(ratio: Column) -> Column:
    return F.round(F.round(F.coalesce(ratio, F.lit(0.0)) * 100, 8), 2)


def _tfidf(source: Column, target: Column, stop: Sequence[str]) -> Column:
    def score(runs: Column) -> Column:
        weight = lambda r: F.when((r["a"] > 0) & (r["b"] > 0), 1.0).otherwise(F.log(F.lit(1.5)) + 1)
        norm = lambda side: F.sqrt(_total(runs, lambda r: r[side] * r[side] * weight(r) * weight(r)))
        return _percent(F.try_divide(_total(runs, lambda r: r["a"] * r["b"]), norm("a") * norm("b")))

    return let(_runs(_terms(source, stop), _terms(target, stop)), score)


def _bm25(query: Column, document: Column) -> Column:
    def score(runs: Column) -> Column:
        gain = lambda side: _total(runs, lambda r: r["a"] * r[side] * 2.5 / (r[side] + 1.5))
        return _percent(F.least(F.coalesce(F.try_divide(gain("b"), gain("a")), F.lit(0.0)), F.lit(1.0)))

    return let(_runs(t.tokens(query), t.tokens(document)), score)


def _text(c: str, clean: bool) -> Column:
    """The first ``LONGEST`` characters, as the matching rule has it, cleaned where that is asked for."""
    cut = F.coalesce(F.left(F.col(c), F.lit(LONGEST)), F.lit(""))
    return cleaned(cut) if clean else cut


def cleaned_text(c: str) -> Column:
    """A text as ``match`` takes it with ``clean``: texts that many pairs share are cleaned before they are paired."""
    return _text(c, True)


def tfidf_similarity(pairs: DataFrame, key: str, source: str, target: str, stop: Sequence[str] = STOP_WORDS, clean: bool = False) -> DataFrame:
    """(key, tfidf): cosine, in percent, of one- and two-word terms, weighted over just the pair's two texts.

    Only the first 2,000 characters count.  A term of both texts has weight 1, of one text 1 + ln 1.5.  A pair without a
    term on either side has 0.  Pairs are scored in their rows; no row moves.
    """
    return pairs.select(key, _tfidf(_text(source, clean), _text(target, clean), stop).alias("tfidf"))


def bm25_similarity(pairs: DataFrame, key: str, query: str, document: str, clean: bool = False) -> DataFrame:
    """(key, bm25): BM25 of the document for the query over that of the query for itself, at most 100."""
    return pairs.select(key, _bm25(_text(query, clean), _text(document, clean)).alias("bm25"))


def match(pairs: DataFrame, key: str, resume: str, job: str, stop: Sequence[str] = STOP_WORDS, clean: bool = False, job_cleaned: bool = False) -> DataFrame:
    """(key, tfidf, bm25, combined) for every pair; with ``job_cleaned`` the job's text is one of ``cleaned_text``."""
    both = F.struct(_text(resume, clean).alias("a"), (F.col(job) if job_cleaned else _text(job, clean)).alias("b"))
    scores = let(both, lambda x: F.struct(_tfidf(x["a"], x["b"], stop).alias("tfidf"), _bm25(x["b"], x["a"]).alias("bm25")))
    out = pairs.select(key, scores.alias("s")).select(key, "s.tfidf", "s.bm25")
    return out.withColumn("combined", F.round(F.col("tfidf") * 0.6 + F.col("bm25") * 0.4, 2))


# Spellings of skills and the name that scoring uses.
SKILL_ALIASES = {
    "js": "javascript",
    "ts": "typescript",
    "py": "python",
    "node": "node.js",
    "nodejs": "node.js",
    "react.js": "react",
    "reactjs": "react",
    "vue.js": "vue",
    "vuejs": "vue",
    "angular.js": "angular",
    "angularjs": "angular",
    "c++": "cpp",
    "c#": "csharp",
    "postgresql": "postgres",
    "mongo": "mongodb",
    "aws": "amazon web services",
    "gcp": "google cloud platform",
    "k8s": "kubernetes",
    "ml": "machine learning",
    "ai": "artificial intelligence",
    "dl": "deep learning",
    "tf": "tensorflow",
    "sql server": "microsoft sql server",
    "mssql": "microsoft sql server",
    "git & github": "git",
    "github": "git",
    "responsive web design": "responsive",
    "responsive design": "responsive",
}


def skill_name(c: Column) -> Column:
    """Lower case, without what follows a parenthesis, by the name that stands for its spellings."""
    bare = F.trim(F.split_part(F.lower(F.trim(c)), F.lit("("), F.lit(1)))
    known = F.create_map(*[F.lit(x) for kv in SKILL_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, bare), bare)


def skills_match(own: Column, required: Column) -> Column:
    """(matched, missing, percentage): required skills in their order, by the names that stand for them."""
    mine = F.transform(F.coalesce(own, F.array().cast("array<string>")), skill_name)
    wanted = F.coalesce(required, F.array().cast("array<string>"))
    names = F.transform(wanted, skill_name)
    hit = let(mine, lambda own: F.filter(names, lambda x: F.array_contains(own, x)))
    miss = let(mine, lambda own: F.filter(names, lambda x: ~F.array_contains(own, x)))
    empty = (F.size(mine) == 0) | (F.size(wanted) == 0)
    return F.struct(
        F.when(empty, F.array().cast("array<string>")).otherwise(hit).alias("matched"),
        F.when(empty, wanted).otherwise(miss).alias("missing"),
        F.when(empty, 0.0).otherwise(F.round(F.size(hit) * 100.0 / F.size(names), 1)).alias("percentage"),
    )


def phrases(docs: DataFrame, key: str, text: str, vocabulary: DataFrame, longest: int = 4) -> DataFrame:
    """(key, position, words, label): vocabulary phrases in the texts, the longest at each place, none inside another.

    ``vocabulary`` is (phrase, label) of lower-case words; it is joined by equality of the first word, so words that begin no
    phrase leave first, it may be of any size, and Spark broadcasts it only while it is small.  A phrase that begins inside a longer one that starts before it is dropped.
    """
    begun = let(t.tokens(F.col(text)), lambda w: F.transform(w, lambda x, i: F.struct((i + 1).alias("position"), x.alias("first"), F.slice(w, i + 1, F.lit(longest)).alias("span"))))
    sized = vocabulary.select("phrase", "label", F.split_part("phrase", F.lit(" "), F.lit(1)).alias("first"), F.size(F.split("phrase", " ")).alias("n"))
    rows = docs.select(key, F.explode(begun).alias("s")).select(key, "s.*").join(sized.filter(F.col("n") <= longest), "first")
    spelled = F.array_join(F.slice("span", F.lit(1), F.col("n")), " ")
    hits = rows.filter((F.size("span") >= F.col("n")) & (spelled == F.col("phrase"))).select(key, "position", F.col("n").alias("words"), "label")
    best = hits.groupBy(key, "position").agg(F.max_by(F.struct("words", "label"), F.struct("words", "label")).alias("b"))
    flat = best.select(key, "position", "b.words", "b.label")
    from pyspark.sql import Window as W

    reach = F.max(F.col("position") + F.col("words")).over(W.partitionBy(key).orderBy("position").rowsBetween(W.unboundedPreceding, -1))
    return flat.withColumn("_reach", reach).filter("_reach is null or position >= _reach").drop("_reach")
