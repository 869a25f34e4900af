"""Vector, text and typo-tolerant search."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from prismlake.functions.columns import cosine

#: BM25 with the usual constants, a floor for the weight of terms that most rows have.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def vector_topk(vectors: DataFrame, query: list[float], k: int = 200, threshold: float = 0.2, key: str = "file_id", vector: str = "embedding") -> DataFrame:
    """(key, score): the k rows of largest cosine of at least the threshold; ties go to the smaller key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(vector), q).alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), key).limit(k)


def vector_search(vectors: DataFrame, files: DataFrame, query: list[float], k: int = 200, threshold: float = 0.2) -> DataFrame:
    """vector_topk among shown files (files: id)."""
    return vector_topk(vectors.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi"), query, k, threshold)


def similar_to(vectors: DataFrame, item: int, k: int = 200, threshold: float = 0.2, key: str = "file_id", vector: str = "embedding") -> DataFrame:
    """(key, score): what resembles an item, the item left out. Filters don't apply here."""
    one = vectors.where(F.col(key) == item).select(F.col(vector).alias("_q")).limit(1)
    scored = vectors.where(F.col(key) != item).crossJoin(F.broadcast(one)).select(key, cosine(F.col(vector), F.col("_q")).alias("score"))
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), key).limit(k)


def text_query(vectors: DataFrame, files: DataFrame, text: str, embed: Callable[[str], list[float]], **how) -> DataFrame:
    """vector_search for a text, with an embedder that the caller provides."""
    return vector_search(vectors, files, embed(text), **how)


def query_terms(query: str) -> list[str]:
    """Terms of a query: compatibility forms, split at white space, letters, digits and underscores kept."""
    found = ("".join(re.findall(r"[^\W]", t)) for t in unicodedata.normalize("NFKC", query).split())
    return [t for t in found if t]


def index_words(text: Column) -> Column:
    """Words of the index: lower case without accents, letters and digits."""
    from prismlake.operators.filters import folded

    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def phrase_terms(query: str) -> list[str]:
    """What each word of the index is compared with: letters and digits of the query's terms."""
    return [t for q in query_terms(query) for t in re.findall(r"[^\W_]+", q.lower())]


def word_begins(term: str) -> Column:
    """Whether `word` begins like a term; a constant prefix, which prunes row groups of a table sorted by word."""
    from prismlake.operators.filters import folded

    return F.startswith("word", folded(F.lit(term)))


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, tf, len): one row for each word of each text."""
    words = rows.select(key, index_words(F.col(text)).alias("_w")).withColumn("len", F.size("_w"))
    return words.select(key, "len", F.explode("_w").alias("word")).groupBy(key, "word", "len").agg(F.count("*").alias("tf"))


def lengths(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, len) of every row with a text, also of those without a word."""
    return rows.where(F.col(text).isNotNull()).select(key, F.size(index_words(F.col(text))).alias("len"))


def refreshed_index(old: DataFrame, fresh: DataFrame, gone: DataFrame | None, key: str) -> DataFrame:
    """Stored postings or lengths with all rows of changed keys (fresh) replaced, and those of removed ones (gone: key) left out."""
    changed = fresh.select(key).distinct() if gone is None else fresh.select(key).union(gone.select(key)).distinct()
    return old.join(changed, key, "left_anti").select(*old.columns).unionByName(fresh)


def bm25_stored(stored: DataFrame, sizes: DataFrame, query: str, key: str = "file_id") -> DataFrame:
    """(key, score) as `bm25` gives them, from stored `postings` and `lengths`.

    Only postings of words in a term's range are read, so a table sorted by word is pruned; no text is looked at.
    """
    terms = phrase_terms(query)
    if not terms:
        return stored.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    begins = [word_begins(t) for t in terms]
    some = begins[0]
    for b in begins[1:]:
        some = some | b
    hit = stored.where(some).groupBy(key, "len").agg(*[F.sum(F.when(b, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, b in enumerate(begins)])
    figures = sizes.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = hit.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    return bm25_scores(hit.crossJoin(F.broadcast(figures.crossJoin(df))), key, len(terms))  # one row of figures


def bm25_scores(hit: DataFrame, key: str, terms: int) -> DataFrame:
    score = F.lit(0.0)
    for i in range(terms):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(LEAST_IDF))
        score = score - idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hit.select(key, score.alias("score"))


def bm25(rows: DataFrame, query: str, key: str = "file_id", text: str = "text") -> DataFrame:
    """(key, score) of rows with a word that begins like a term of the query; smaller (more negative) is better.

    Each term with its prefix reading is one phrase. Frequencies and lengths are those of all rows
    given, so filter the result, not the input. One pass counts phrases by row; the corpus figures
    are one aggregate over the same rows.
    """
    terms = phrase_terms(query)
    if not terms:
        return rows.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    from prismlake.operators.filters import folded

    words = rows.where(F.col(text).isNotNull()).select(key, index_words(F.col(text)).alias("_w"))
    begins = lambda t: lambda w: F.startswith(w, folded(F.lit(t)))
    tf = [F.size(F.filter("_w", begins(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = words.select(key, F.size("_w").alias("len"), *tf)
    figures = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hit = counted.where(F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) > 0).crossJoin(F.broadcast(figures))
    return bm25_scores(hit, key, len(terms))


def substring_hits(rows: DataFrame, query: str, key: str = "file_id", text: str = "text") -> DataFrame:
    """(key, score 0) of rows whose text contains the query without case."""
    return rows.where(F.contains(F.lower(text), F.lower(F.lit(query)))).select(key, F.lit(0.0).alias("score"))


def text_search(rows: DataFrame, query: str, limit: int = 200, key: str = "file_id", text: str = "text", visible: Column | None = None) -> DataFrame:
    """(key, score, label): BM25 and substring hits together, best first, the smaller key first among equals."""
    shown = rows if visible is None else rows.where(visible)
    ranked = bm25(rows, query, key, text)
    ranked = ranked if visible is None else ranked.join(shown.select(key), key, "left_semi")
    both = ranked.unionByName(substring_hits(shown, query, key, text)).groupBy(key).agg(F.min("score").alias("score"))
    label = F.when(F.col("score") < 0, "Text match").otherwise("Contains query")
    return both.withColumn("label", label).orderBy("score", key).limit(min(max(limit, 1), 5000))


def anchors(term: str) -> list[str]:
    """Three trigrams of a term of four letters or more, of which one edit leaves at least one whole for long terms."""
    m = (len(term) - 3) // 2
    return list(dict.fromkeys([term[:3], term[m : m + 3], term[-3:]]))


def _one_edit(term: str) -> Callable[[Column], Column]:
    return lambda w: (F.abs(F.length(w) - len(term)) <= 1) & (F.levenshtein(w, F.lit(term), 1) >= 0)


def typo_hits(rows: DataFrame, query: str, key: str = "file_id", text: str = "text") -> DataFrame:
    """(key) of rows with a word one edit (insertion, deletion, substitution) from a term of four letters or more.

    A text must contain an anchor trigram of the term before its words are compared. All such rows are compared.
    """
    terms = [t.lower() for t in re.findall(r"[\w]+", unicodedata.normalize("NFKC", query)) if len(t) >= 4]
    lower, hit = F.lower(text), F.lit(False)
    for t in terms:
        maybe = F.lit(False)
        for a in anchors(t):
            maybe = maybe | F.contains(lower, F.lit(a))
        words = F.regexp_extract_all(lower, F.lit(r"[\p{L}\p{N}_]+"), 0)
        hit = hit | (maybe & F.exists(words, _one_edit(t)))
    return rows.where(F.coalesce(hit, F.lit(False))).select(key)


def search_with_typos(rows: DataFrame, query: str, limit: int = 200, key: str = "file_id", text: str = "text") -> DataFrame:
    """text_search, followed by rows that only a typo keeps from matching (label `Similar text`)."""
    exact = text_search(rows, query, limit, key, text)
    more = typo_hits(rows, query, key, text).join(exact.select(key), key, "left_anti").select(key, F.lit(1.0).alias("score"), F.lit("Similar text").alias("label"))
    return exact.unionByName(more).orderBy("score", key).limit(min(max(limit, 1), 5000))


def visible_text(confidence: str = "mean_confidence") -> Column:
    return F.coalesce(F.col(confidence), F.lit(0.0)) > 0
