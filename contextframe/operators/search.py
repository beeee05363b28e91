"""Full-text search ranked by Okapi BM25 over several text columns.

Terms are joined by AND; a term that splits into several tokens is a phrase. Corpus counts
are taken over all records before any filter. A query reads the table in one pass for the
counts and in one for the scores: the counts are one row, and only the k best rows travel.
Tokens are runs of letters and digits in lower case, without accents. For many queries over one
table, :func:`postings` makes an index that is read by token.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of a record that are searched, and BM25's usual parameters.
COLUMNS = ("title", "text", "facts", "concepts", "observation_type")
K1, B = 1.2, 0.75
MOST_ROWS = 50


def _accents() -> tuple[str, str]:
    """Accented Latin letters and the letters without accents."""
    pairs = [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower()]
    kept = [(c, plain[0]) for c, plain in pairs if len(plain) > 1 and plain[0].isascii() and all(map(unicodedata.combining, plain[1:]))]
    return "".join(c for c, _ in kept), "".join(plain for _, plain in kept)


ACCENTED, PLAIN = _accents()


def folded(text: Column) -> Column:
    """A text in lower case, Latin letters without accents."""
    return F.translate(F.regexp_replace(F.lower(text), r"[\x{300}-\x{36F}]", ""), ACCENTED, PLAIN)


def terms_of(query: str) -> list[list[str]]:
    """The tokens of each term of a query; colons and quotes are dropped. No terms are an error."""
    cleaned = (re.sub(r'[:"]', "", term) for term in query.split())
    plain = str.maketrans(ACCENTED, PLAIN)
    terms = [tokens for term in cleaned if (tokens := re.findall(r"[^\W_]+", re.sub("[\u0300-\u036f]", "", term.lower()).translate(plain)))]
    if not terms:
        raise ValueError("the query has no terms")
    return terms


def _tokens(column: str) -> Column:
    return F.regexp_extract_all(folded(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _spaced(columns: tuple[str, ...]) -> Column:
    """The tokens of all columns, each between spaces of its own, columns apart."""
    parts = [F.array_join(_tokens(c), "  ") for c in columns]
    return F.concat(F.lit(" "), F.concat_ws("  |  ", *parts), F.lit(" "))


def _count(tokens: Column, term: list[str]) -> Column:
    phrase = " " + "  ".join(term) + " "
    return ((F.length(tokens) - F.length(F.replace(tokens, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))).cast("bigint")


def _part(k: int) -> Column:
    """What a term adds to the score of a record."""
    idf = F.greatest(F.log((F.col("_n") - F.col(f"_d{k}") + 0.5) / (F.col(f"_d{k}") + 0.5)), F.lit(1e-6))
    f = F.col(f"_f{k}")
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))


def search(records: DataFrame, query: str, *, key: str = "id", limit: int = 10, offset: int = 0, columns: tuple[str, ...] = COLUMNS, condition: Column | None = None) -> DataFrame:
    """(key, score) of the best records, ascending: the smaller the score, the better."""
    terms = terms_of(query)
    spaced = records.select(*records.columns, _spaced(columns).alias("_t"))
    bars = len(columns) - 1
    counted = spaced.select(*records.columns, (F.size(F.split(F.trim("_t"), " +")) - bars).alias("_dl"), *[_count(F.col("_t"), term).alias(f"_f{k}") for k, term in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_f{k}") > 0).alias(f"_d{k}") for k in range(len(terms))])
    hits = counted.where(reduce(Column.__and__, [F.col(f"_f{k}") > 0 for k in range(len(terms))]))
    if condition is not None:
        hits = hits.where(condition)

    score = F.round(-reduce(Column.__add__, [_part(k) for k in range(len(terms))]), 6)
    return hits.crossJoin(F.broadcast(stats)).select(key, score.alias("score")).orderBy("score", key).offset(offset).limit(min(limit, MOST_ROWS))


def postings(records: DataFrame, *, key: str = "id", columns: tuple[str, ...] = COLUMNS) -> tuple[DataFrame, DataFrame]:
    """The index (token, key, positions), and (key, length) of every record.

    Written sorted by token, a query reads only its own tokens. Columns lie apart by a
    position, so that no phrase goes from one to the next. Keys must be unique.
    """
    between = [part for c in columns for part in (F.array(F.lit("|")), _tokens(c))]
    rows = records.select(key, F.concat(*between).alias("_t"))
    found = rows.select(key, F.posexplode("_t").alias("_p", "token")).where("token <> '|'")
    lists = found.groupBy("token", key).agg(F.array_sort(F.collect_list("_p")).alias("positions"))
    return lists, rows.select(key, (F.size("_t") - len(columns)).alias("length"))


def search_postings(index: DataFrame, lengths: DataFrame, query: str, *, key: str = "id", limit: int = 10, offset: int = 0) -> DataFrame:
    """What :func:`search` gives, from an index."""
    terms = terms_of(query)
    needed = sorted({token for term in terms for token in term})
    own = index.where(F.col("token").isin(*needed)).groupBy(key).agg(*[F.first(F.when(F.col("token") == token, F.col("positions")), True).alias(f"_t{k}") for k, token in enumerate(needed)])

    def count(term: list[str]) -> Column:
        first, *rest = [F.coalesce(f"_t{needed.index(token)}", F.array().cast("array<int>")) for token in term]
        return F.size(F.filter(first, lambda p: reduce(Column.__and__, [F.array_contains(other, p + k) for k, other in enumerate(rest, 1)], F.lit(True))))

    counted = own.select(key, *[count(term).alias(f"_f{k}") for k, term in enumerate(terms)])
    seen = counted.agg(*[F.count_if(F.col(f"_f{k}") > 0).alias(f"_d{k}") for k in range(len(terms))])
    stats = lengths.agg(F.count("*").alias("_n"), F.avg("length").alias("_avg")).crossJoin(seen)
    hits = counted.where(reduce(Column.__and__, [F.col(f"_f{k}") > 0 for k in range(len(terms))])).join(lengths.withColumnRenamed("length", "_dl"), key)
    score = F.round(-reduce(Column.__add__, [_part(k) for k in range(len(terms))]), 6)
    return hits.crossJoin(F.broadcast(stats)).select(key, score.alias("score")).orderBy("score", key).offset(offset).limit(min(limit, MOST_ROWS))
