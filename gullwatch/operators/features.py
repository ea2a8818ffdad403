"""Term weights and document vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, PCA, HashingTF, Tokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from gullwatch.operators.sparse import column

UNKNOWN = "<UNK>"

#: Stop words that become part of an expression; more are joined.
MAX_LITERAL_STOPWORDS = 5000
#: Shares into which the rows of one token are dealt for a dictionary join.
SALTS = 8
#: Bytes of a dictionary that every task holds; a larger one is joined.
DICTIONARY_BYTES = 64 << 20
#: Bytes of vectors in one batch of concatenated posts, one post at least.
BATCH_BYTES = 8 << 20


def term_counts(df: DataFrame, words: str = "words", id_col: str = "id") -> DataFrame:
    """``(id, term, tf)``, empty tokens dropped.

    Posts are placed by id before their tokens are exploded. That moves each text once
    in compact form, and the grouping below then needs no shuffle of its own.
    """
    tokens = df.select(id_col, words).repartition(id_col).select(id_col, F.explode(words).alias("term"))
    return tokens.filter(F.col("term") != "").groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """``(term, df)`` from :func:`term_counts`.

    Joined back to the same counts, both sides read one shuffle of the texts.
    """
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1.0) / (df + 1.0))


def tfidf_terms(tf: DataFrame, frequencies: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``(id, term, tf, df, weight)``; terms found in every document (weight 0) are dropped.

    ``n_docs`` has one row ``n``; it is read as a scalar subquery. Terms the frequencies
    do not know count as ``df = 0``, as with a fitted model that never saw them.
    """
    n = n_docs.select("n").scalar()
    joined = tf.join(frequencies, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    weighted = joined.withColumn("weight", F.col("tf") * idf(n, F.col("df")))
    return weighted.filter(F.col("weight") != 0).select("id", "term", "tf", "df", "weight")


def universal_terms(df: DataFrame, words: str = "words") -> list[str]:
    """Terms of every post. Each lies in the shortest post, so only its terms are counted."""
    distinct = F.array_distinct(F.filter(F.col(words), lambda w: w != ""))
    row = df.select(distinct.alias("terms")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("terms", F.size("terms")).alias("shortest")
    ).first()
    if not row.n or not row.shortest:
        return []
    shared = F.array_intersect(F.col(words), F.array(*[F.lit(t) for t in row.shortest]))
    counted = df.select(F.explode(shared).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r.term for r in counted.filter(F.col("n") == row.n).select("term").collect())


def weighted_term_sets(df: DataFrame, words: str = "words", target: str = "terms") -> DataFrame:
    """Add the sorted distinct terms with a non-zero TF-IDF weight; row-local but for one scan."""
    everywhere = universal_terms(df, words)
    terms = F.array_sort(F.array_distinct(F.filter(F.col(words), lambda w: w != "")))
    if everywhere:
        terms = F.array_except(terms, F.array(*[F.lit(t) for t in everywhere]))
    return df.withColumn(target, terms)


def drop_stopwords(
    df: DataFrame, stopwords: DataFrame, words: str = "words", id_col: str = "id", max_literal: int = MAX_LITERAL_STOPWORDS
) -> DataFrame:
    """Stop-word removal for lists of any length, with one result.

    A list of up to ``max_literal`` words becomes part of the expression; a longer one is
    joined with the distinct words of each post. Posts of one id share the words of all of
    them, by position.
    """
    listed = stopwords.select("word").distinct()
    few = listed.take(max_literal + 1)
    if len(few) <= max_literal:
        stop = F.array(*[F.lit(r.word) for r in few]).cast("array<string>")
        return df.withColumn(words, F.filter(words, lambda w: ~F.coalesce(F.array_contains(stop, w), F.lit(False))))
    # what moves is each post's words, once and compact, and the few of them that are listed
    found = df.select(id_col, F.explode(F.array_distinct(words)).alias("word")).join(listed, "word", "left_semi")
    stops = found.groupBy(id_col).agg(F.collect_set("word").alias("_stops"))
    given = df.groupBy(id_col).agg(F.collect_list(words).alias("_lists"))
    placed = F.flatten(F.transform("_lists", lambda ws: F.transform(ws, lambda w, i: F.struct(i.alias("pos"), w.alias("word")))))
    merged = F.when(F.size("_lists") == 1, F.get("_lists", 0)).otherwise(F.sort_array(placed)["word"])
    empty = F.array().cast("array<string>")
    stop = F.coalesce("_stops", empty)
    kept = F.filter(merged, lambda w: ~F.coalesce(F.array_contains(stop, w), F.lit(False)))
    back = given.join(stops, id_col, "left").select(id_col, kept.alias("_kept"))
    return (
        df.withColumn("_given", F.col(words).isNotNull())
        .drop(words)
        .join(back, id_col, "left")
        .withColumn(words, F.when(F.col("_given"), F.coalesce("_kept", empty)))
        .drop("_kept", "_given")
    )


def hashed_tfidf_stages(num_features: int = 3000, text: str = "processedTweet") -> list:
    return [
        Tokenizer(inputCol=text, outputCol="words"),
        HashingTF(inputCol="words", outputCol="rawFeatures", numFeatures=num_features),
        IDF(inputCol="rawFeatures", outputCol="features"),
    ]


def hashed_tfidf_pipeline(num_features: int = 3000, text: str = "processedTweet") -> Pipeline:
    return Pipeline(stages=hashed_tfidf_stages(num_features, text))


def _unknown_vector(dictionary: DataFrame) -> list[float]:
    row = dictionary.filter(F.col("token") == UNKNOWN).select("vector").first()
    if row is None:
        raise ValueError(f"dictionary lacks {UNKNOWN}")
    return list(row.vector)


def token_vectors(tokens: DataFrame, dictionary: DataFrame, salts: int = SALTS) -> DataFrame:
    """Attach ``vector`` by token; unknown tokens get the ``<UNK>`` vector, one row.

    A token of every post is one join key. The dictionary, one row a token, is repeated for
    ``salts`` shares of each key, so such a token is spread over as many tasks.
    """
    kind = dictionary.schema["vector"].dataType
    unknown = F.array(*[F.lit(x) for x in _unknown_vector(dictionary)]).cast(kind)
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    rest = [c for c in tokens.columns if c != "token"]
    own = F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int") if rest else F.lit(0)
    looked_up = tokens.withColumn("_salt", own).join(dictionary.select("*", salt), ["token", "_salt"], "left")
    return looked_up.drop("_salt").withColumn("vector", F.coalesce(F.col("vector"), unknown))


class Lookup(NamedTuple):
    """A dictionary inside tasks: the vectors of token ``i`` are ``rows[first[i] : first[i] + count[i]]``; the last entry is ``<UNK>``."""

    tokens: pa.Array
    first: np.ndarray
    count: np.ndarray
    rows: np.ndarray
    matrix: np.ndarray

    def codes(self, words: pa.Array) -> np.ndarray:
        found = pc.index_in(words, value_set=self.tokens.cast(words.type))
        return pc.fill_null(found, len(self.tokens)).to_numpy(zero_copy_only=False)


def _lookup(dictionary: DataFrame, unknown: list[float], most_bytes: int) -> Lookup | None:
    """The dictionary, vectors in their order; None if it is too large, or a vector is not whole and as long as ``unknown``."""
    whole = (F.size("vector") == len(unknown)) & ~F.exists("vector", lambda x: x.isNull())
    shape = dictionary.agg(
        F.sum(F.coalesce(F.octet_length("token"), F.lit(0)) + 8 * len(unknown)).alias("bytes"),
        F.coalesce(F.bool_and(F.col("vector").isNull() | whole), F.lit(True)).alias("whole"),
    ).first()
    if not shape.whole or (shape.bytes or 0) > most_bytes or any(x is None for x in unknown):
        return None
    given = dictionary.filter(F.col("token").isNotNull()).select("token", "vector").toArrow().combine_chunks()
    kind = given["vector"].type.value_type.to_pandas_dtype()
    held = given.filter(pc.is_valid(given["vector"]))
    matrix = np.concatenate([pc.list_flatten(held["vector"]).to_numpy().astype(kind).reshape(-1, len(unknown)), np.array([unknown], kind)])
    place = np.full(given.num_rows, held.num_rows)  # a token without a vector has that of <UNK>
    place[pc.is_valid(given["vector"]).to_numpy()] = np.arange(held.num_rows)
    # vectors in order, as the copies of a token and of a position are
    order = np.lexsort(matrix.T[::-1]) if len(unknown) else np.arange(len(matrix))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    tokens = pc.unique(given["token"])
    code = pc.index_in(given["token"], value_set=tokens).to_numpy()
    own = np.lexsort((rank[place], code))
    count = np.bincount(code, minlength=len(tokens)).astype(np.int64)
    rows = np.append(rank[place][own], rank[-1])
    return Lookup(tokens, np.append(np.cumsum(count) - count, len(rows) - 1), np.append(count, 1), rows, matrix[order])


def _repeated(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, ``count[i]`` numbers for each ``i``."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def doc_vector_mean(df: DataFrame, dictionary: DataFrame, words: str = "words", most_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """``(id, vector)``: mean of the token vectors, repeated tokens weighted by their count.

    A post without tokens has the zero vector. A dictionary of up to ``most_bytes`` is held by
    the tasks, and a post leaves its task as one vector; the tokens meet a larger one in a join.
    """
    unknown = _unknown_vector(dictionary)
    zero = array_to_vector(F.array(*[F.lit(0.0)] * len(unknown)))
    found = _lookup(dictionary, unknown, most_bytes)
    if found is None:
        tf = term_counts(df, words).withColumnRenamed("term", "token")
        mean = Summarizer.mean(array_to_vector(F.col("vector")), F.col("tf").cast("double"))
        means = token_vectors(tf, dictionary).groupBy("id").agg(mean.alias("vector"))
        return df.select("id").distinct().join(means, "id", "left").select("id", F.coalesce("vector", zero).alias("vector"))
    held = df.sparkSession.sparkContext.broadcast(found)
    out = StructType([df.schema["id"], *df.selectExpr("0D AS n", "array(0D) AS vector").schema.fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        sums = np.add.reduceat(table.matrix[table.rows].astype(float), table.first)  # by token
        for batch in batches:
            lists = column(batch, "words")
            tokens = lists.flatten()
            post = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            real = pc.fill_null(pc.not_equal(tokens, ""), False).to_numpy(zero_copy_only=False)
            # each token of a post once, with its count
            pairs, times = np.unique(post[real] * len(sums) + table.codes(tokens)[real], return_counts=True)
            n = np.bincount(pairs // len(sums), times * table.count[pairs % len(sums)], len(lists))
            total = np.zeros((len(lists), sums.shape[1]))
            at = np.searchsorted(pairs // len(sums), np.arange(len(lists) + 1))
            for i in np.flatnonzero(n):
                own = pairs[at[i] : at[i + 1]] % len(sums)
                total[i] = times[at[i] : at[i + 1]] @ sums[own] / n[i]
            ends = np.arange(len(lists) + 1, dtype=np.int32) * sums.shape[1]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(n.astype(float)), pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel()))], names=["id", "n", "vector"])

    each = df.select("id", F.col(words).alias("words")).mapInArrow(task, out)
    # a weight that vanishes beside a token's, for a mean of posts without tokens
    mean = Summarizer.mean(array_to_vector(F.col("vector")), F.greatest("n", F.lit(1e-300)))
    means = each.groupBy("id").agg(mean.alias("vector"))
    return means.select("id", F.when(F.col("id").isNotNull(), F.col("vector")).otherwise(zero).alias("vector"))


def max_tokens(df: DataFrame, words: str = "words") -> DataFrame:
    """Longest post in tokens: fixes the padded width of concatenated vectors."""
    return df.agg(F.max(F.size(words)).alias("max_tokens"))


def doc_vector_concat(df: DataFrame, dictionary: DataFrame, dims: int, words: str = "words", most_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """``(id, size, values)``: token vectors in token order, as wide as the longest of these posts.

    Stored sparsely: positions from ``cardinality(values)`` up to ``size`` are zero. No token
    is ever cut; a post without tokens has no values. A dictionary of up to ``most_bytes`` is
    held by the tasks, so vectors are never shuffled; the tokens meet a larger one in a join.
    """
    kind = dictionary.schema["vector"].dataType
    width = F.greatest(F.coalesce(max_tokens(df, words).scalar(), F.lit(0)), F.lit(0))
    size = (width * dims).cast("long").alias("size")
    found = _lookup(dictionary, _unknown_vector(dictionary), most_bytes)
    if found is None:
        tokens = df.select("id", F.posexplode(words).alias("pos", "token"))
        vectors = token_vectors(tokens, dictionary).select("id", "pos", "vector")
        # one post's vectors per group
        parts = vectors.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "vector"))).alias("parts"))
        joined = df.select("id").distinct().join(parts, "id", "left")
        return joined.select("id", size, F.coalesce(F.flatten(F.col("parts.vector")), F.array().cast(kind)).alias("values"))
    held = df.sparkSession.sparkContext.broadcast(found)
    out = StructType([df.schema["id"], StructField("values", kind)])
    values_type = to_arrow_type(kind.elementType)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        per_batch = max(1, BATCH_BYTES // max(table.matrix[0].nbytes, 1))
        for batch in batches:
            lists = column(batch, "lists")
            parts = lists.flatten()
            lengths = pc.list_value_length(parts).to_numpy()
            copies = pc.list_value_length(lists).to_numpy()
            code = table.codes(parts.flatten())
            times = table.count[code]
            rows = table.rows[_repeated(table.first[code], times)]
            post = np.repeat(np.repeat(np.repeat(np.arange(len(lists)), copies), lengths), times)
            if len(copies) and copies.max() > 1:  # rows of one id: by position, then by vector
                position = np.repeat(_repeated(np.zeros(len(lengths), np.int64), lengths), times)
                rows = rows[np.lexsort((rows, position, post))]
            at = np.searchsorted(post, np.arange(len(lists) + 1))
            start = 0
            while start < len(lists):
                end = max(start + 1, int(np.searchsorted(at, at[start] + per_batch, "right")) - 1)
                values = pa.array(table.matrix[rows[at[start] : at[end]]].ravel(), values_type)
                ends = pa.array(((at[start : end + 1] - at[start]) * table.matrix.shape[1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([column(batch, "id").slice(start, end - start), pa.ListArray.from_arrays(ends, values)], names=["id", "values"])
                start = end

    # the words of one post, compact, in each group; a post without id has no values
    grouped = df.groupBy("id").agg(F.collect_list(F.when(F.col("id").isNotNull(), F.col(words))).alias("lists"))
    return grouped.mapInArrow(task, out).select("id", size, "values")


def padded_vector(size: int, values: Column) -> Column:
    """Dense ML vector of a concatenated document vector."""
    padding = F.array_repeat(F.lit(0.0), F.lit(size) - F.size(values))
    return array_to_vector(F.concat(values.cast("array<double>"), padding))


def pca(k: int = 30, features: str = "features", target: str = "projected") -> PCA:
    return PCA(k=k, inputCol=features, outputCol=target)


def linear_score(posts: DataFrame, long: DataFrame, weights: DataFrame) -> DataFrame:
    """``(id, margin)``: dot product of each post's terms with given ``(term, w)`` weights.

    Every post has a score; one without a weighted term scores 0.0.
    """
    joined = long.join(weights.select("term", "w"), "term")
    margins = joined.groupBy("id").agg(F.sum(F.col("weight") * F.col("w")).alias("margin"))
    return posts.select("id").distinct().join(margins, "id", "left").select("id", F.coalesce("margin", F.lit(0.0)).alias("margin"))
