"""Registered queries: every operator run over whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gullwatch.checks.inputs import (
    STOPWORDS,
    dictionary,
    documents,
    labels,
    lead_term,
    listed_clusters,
    posts,
    processed,
    table,
    term_clusters,
    texts,
    vectors,
    with_blanks,
    with_day,
    worded,
)
from gullwatch.functions import dates, text
from gullwatch.functions import vectors as V
from gullwatch.functions.fixed import CUTOFF_DAY
from gullwatch.operators import cohesion, components, distances, exemplars, features, kmeans, metrics, weeks
from gullwatch.functions.text import tokenise
from gullwatch.operators.classify import Spec, keyword_classify, train
from gullwatch.operators.sparse import column, entries, slices
from gullwatch.plans import clustering, experiments
from gullwatch.plans.listings import clean_listing, with_origin, write_clean_listing
from gullwatch.session import cut_lineage, kept_rows, scratch_path, tune
from gullwatch.sources import listing as listings
from gullwatch.sources import models, sinks
from gullwatch.sources import posts as io

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    _REGISTRY[fn.__name__] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_classify(processed(posts(spark, sf_dir)))


def _after_cutoff(df: DataFrame) -> DataFrame:
    return with_day(df).filter(F.col("day") > F.to_date(F.lit(CUTOFF_DAY)))


def _rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


# --- sources and sinks ---------------------------------------------------------------


@query
def posts_load(spark, sf_dir):
    path = scratch_path(spark, "posts")
    label = F.when(F.col("toxic") == 1, "unknown").otherwise(F.col("label").cast("string"))
    rows = posts(spark, sf_dir).withColumn("label", label)
    sinks.write_posts(rows.withColumn("tweet", text.squeeze_spaces(F.col("tweet"))), path)
    return io.read_posts(spark, path).withColumn("label", F.coalesce("label", F.lit(-1)))


@query
def posts_nonempty(spark, sf_dir):
    path = scratch_path(spark, "posts")
    tweet = F.when(F.col("lang") == "en", "").otherwise(text.squeeze_spaces(F.col("tweet")))
    sinks.write_posts(texts(spark, sf_dir).withColumn("tweet", tweet).withColumn("label", F.lit("?")), path)
    return io.removed_counts(io.read_posts(spark, path, label_type="string"))


@query
def embedding_dictionary(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    io.write_embeddings_text(dictionary(spark, sf_dir), path)
    return io.read_embeddings_text(spark, path).select(
        "token",
        F.size("vector").alias("dims"),
        F.round(V.array_sum(F.col("vector")), 6).alias("total"),
        F.get("vector", 0).alias("first_value"),
    )


@query
def processed_export(spark, sf_dir):
    path = scratch_path(spark, "processed")
    sinks.write_processed(processed(posts(spark, sf_dir)), path)
    rows = spark.read.schema("label int, processedTweet string").option("sep", "\t").csv(path)
    return rows.withColumn("processedTweet", F.coalesce("processedTweet", F.lit("")))


@query
def posts_after_cutoff(spark, sf_dir):
    rows = sinks.posts_after_cutoff(posts(spark, sf_dir))
    return rows.withColumn("date", F.col("date").cast("string"))


@query
def confusion_quadrants(spark, sf_dir):
    path = scratch_path(spark, "quadrants")
    sinks.write_quadrants(_scored(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("quadrant"), F.col("value").alias("line"))


@query
def metrics_record(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    results = metrics.classification_metrics(metrics.confusion(_scored(spark, sf_dir)))
    sinks.append_metrics(results, path, 3000)
    columns = ", ".join(f"{m} double" for m in metrics.METRICS)
    return spark.read.schema(f"num_features int, {columns}").csv(path)


# --- text ----------------------------------------------------------------------------


def _on_text(name: str, fn: Callable) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return texts(spark, sf_dir).select("id", fn(F.col("tweet")).alias("t"))

    run.__name__ = name
    query(run)


_on_text("text_lower", F.lower)
_on_text("text_stopwords", lambda c: text.remove_stopwords(F.lower(c), STOPWORDS))
_on_text("text_numbers_to_words", text.numbers_to_words)
_on_text("text_strip_escapes", lambda c: text.strip_escapes(F.replace(c, F.lit(" "), F.lit(" \\\\u2026 "))))
_on_text("text_normalise", lambda c: text.normalised(c, stopwords=STOPWORDS))
_on_text("text_normalise_keep_numbers", lambda c: text.normalised(c, numbers=False, stopwords=STOPWORDS))
_on_text("text_signature_clean", lambda c: text.clean_for_signature(c, STOPWORDS))
_on_text("token_signature", lambda c: text.token_signature(text.normalised(c)))


@query
def stopwords_file(spark, sf_dir):
    """Stop words read from a file, one a line; a short list and a long one that is joined."""
    path = scratch_path(spark, "stopwords")
    spark.createDataFrame([(w,) for w in STOPWORDS], "value string").write.text(path)
    words = F.split(F.rtrim(F.lower("tweet")), " ")
    rows = texts(spark, sf_dir).select("id", words.alias("words"))
    listed = io.read_stopwords(spark, path)
    short, joined = (features.drop_stopwords(rows, listed, max_literal=n).select("id", F.array_join("words", " ").alias(c)) for n, c in ((5000, "t"), (1, "joined")))
    return short.join(joined, "id").select("id", "t", F.col("t").eqNullSafe(F.col("joined")).alias("same"))


@query
def text_strip_urls(spark, sf_dir):
    page = F.concat_ws(" ", "url", "html")
    return io.spread(table(spark, sf_dir, "pages")).select("page_id", text.strip_urls(page).alias("t"))


@query
def tokens(spark, sf_dir):
    words = text.tokenise(F.col("tweet"))
    return texts(spark, sf_dir).select("id", F.array_join(words, "|").alias("t"), F.size(words).alias("n"))


@query
def signature_lines(spark, sf_dir):
    line = F.concat_ws("\t", "date", "id", text.squeeze_spaces(F.col("tweet")))
    return texts(spark, sf_dir).select("id", text.signature_line(line).alias("line"))


@query
def keyword_score(spark, sf_dir):
    return keyword_classify(processed(texts(spark, sf_dir))).select("id", F.col("prediction").alias("score"))


# --- dates ---------------------------------------------------------------------------


@query
def post_day(spark, sf_dir):
    return documents(spark, sf_dir).select("id", dates.post_day(F.concat("date", F.lit(" 10:00"))).alias("day"))


@query
def week_of_year(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.week_of_year(day, 7, 1).alias("week_us"),
        dates.week_of_year(day).alias("week_iso_rule"),
    )


@query
def week_buckets(spark, sf_dir):
    date = F.when(F.col("lang") == "es", "undated").otherwise(F.col("date"))
    rows = with_day(texts(spark, sf_dir).withColumn("date", date))
    found = weeks.week_buckets(rows)
    return found.select("id", F.coalesce("week", F.lit(-1)).alias("week"), F.coalesce("week_bucket", F.lit(-1)).alias("week_bucket"))


@query
def weekly_counts(spark, sf_dir):
    positive = _after_cutoff(_scored(spark, sf_dir).filter(F.col("prediction") > 0.0))
    return weeks.weekly_counts(weeks.week_buckets(positive.select("id", "day")))


@query
def cluster_dates(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.col("user_id").alias("cluster"), dates.format_cluster_time(F.col("ts")).alias("date")
    )
    return exemplars.cluster_dates(rows)


# --- numbers and vectors -------------------------------------------------------------


@query
def round_half_up(spark, sf_dir):
    quarter = F.col("value") / 4
    return table(spark, sf_dir, "events").select(
        "event_id", V.half_up(quarter, 2).alias("two"), V.half_up(quarter, 1).alias("one")
    )


def _on_pairs(name: str, fn: Callable) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
        b = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
        return a.join(b, "vec_id").select("vec_id", F.round(fn(F.col("a"), F.col("b")), 6).alias("d"))

    run.__name__ = name
    query(run)


_on_pairs("vector_sqdist", V.sqdist)
_on_pairs("vector_cosine", V.cosine)
_on_pairs("vector_manhattan", V.manhattan)


@query
def set_mean_sqdist(spark, sf_dir):
    return _rounded(distances.set_mean_sqdist(vectors(spark, sf_dir), ["cluster"]), mean_sqdist=6)


@query
def set_mean_cosine(spark, sf_dir):
    return _rounded(distances.set_mean_cosine(vectors(spark, sf_dir), ["cluster"]), mean_cosine=6)


@query
def set_mean_manhattan(spark, sf_dir):
    return _rounded(distances.set_mean_manhattan(vectors(spark, sf_dir), ["cluster"]), mean_manhattan=6)


@query
def exemplar(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _rounded(exemplars.exemplars(rows, exemplars.centroids(rows)), distance=6)


@query
def exemplar_refresh(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    first = rows.groupBy("cluster").agg(F.min("id").alias("exemplar_id"))
    current = first.join(exemplars.centroids(rows), "cluster")
    return exemplars.refresh_exemplars(current, rows)


@query
def kmeans_cost(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    centers = rows.groupBy("cluster").agg(F.min_by("vector", "id").alias("centroid"))
    assigned = kmeans.assign(rows.select("id", "vector"), centers)
    return assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 6).alias("sse")
    )


# --- features ------------------------------------------------------------------------


@query
def tfidf_terms(spark, sf_dir):
    rows = worded(texts(spark, sf_dir))
    n = documents(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    tf = features.term_counts(rows)
    return _rounded(features.tfidf_terms(tf, features.document_frequency(tf), n), weight=6)


@query
def tfidf_apply(spark, sf_dir):
    known = labels(spark, sf_dir).select("id")
    rows = texts(spark, sf_dir)
    fitted = worded(rows.join(known, "id", "left_semi"))
    others = worded(rows.join(known, "id", "left_anti"))
    n = rows.join(known, "id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    frequencies = features.document_frequency(features.term_counts(fitted))
    return _rounded(features.tfidf_terms(features.term_counts(others), frequencies, n), weight=6)


@query
def max_tokens(spark, sf_dir):
    return features.max_tokens(worded(texts(spark, sf_dir)))


@query
def linear_score(spark, sf_dir):
    rows = kept_rows(worded(with_blanks(texts(spark, sf_dir))).select("id", "words"))  # its ids are read again
    n = with_blanks(documents(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))
    tf = features.term_counts(rows)
    frequencies = features.document_frequency(tf)
    weighted = features.tfidf_terms(tf, frequencies, n)
    weights = frequencies.select("term", ((F.col("df") % 7 - 3) / 10.0).alias("w"))
    return _rounded(features.linear_score(rows, weighted, weights), margin=4)


@query
def token_embedding_lookup(spark, sf_dir):
    words = worded(texts(spark, sf_dir)).select(F.explode("words").alias("token")).filter(F.col("token") != "")
    counted = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    known = dictionary(spark, sf_dir)
    flagged = known.withColumn("known", F.lit(True))
    return features.token_vectors(counted, flagged).select(
        "token",
        "n",
        F.coalesce("known", F.lit(False)).alias("known"),
        F.round(V.array_sum(F.transform("vector", lambda x: x.cast("double"))), 6).alias("total"),
    )


@query
def doc_vector_mean(spark, sf_dir):
    mean = features.doc_vector_mean(worded(with_blanks(texts(spark, sf_dir))), dictionary(spark, sf_dir))
    values = mean.select("id", F.posexplode(vector_to_array("vector")).alias("pos", "x"))
    return _rounded(values, x=6)


@query
def doc_vector_concat(spark, sf_dir):
    rows = worded(with_blanks(texts(spark, sf_dir)))
    wide = features.doc_vector_concat(rows, dictionary(spark, sf_dir), 64)
    weighted = F.transform("values", lambda x, i: x.cast("double") * (i % 7 + 1))
    return wide.select(
        "id",
        "size",
        F.size("values").cast("long").alias("n_values"),
        F.round(V.array_sum(weighted), 4).alias("checksum"),
    )


@query
def embed_preview(spark, sf_dir):
    first = io.preview(with_blanks(texts(spark, sf_dir)), 1000)  # chosen before any text is embedded
    mean = features.doc_vector_mean(worded(io.spread(cut_lineage(first))), dictionary(spark, sf_dir))
    total = V.array_sum(vector_to_array("vector"))
    return mean.select("id", F.round(total, 6).alias("total"))


@query
def hashing_tf(spark, sf_dir):
    rows = processed(texts(spark, sf_dir))
    stages = features.hashed_tfidf_stages()
    counted = stages[1].transform(stages[0].transform(rows))
    counts = vector_to_array("rawFeatures")
    return counted.select("id", V.array_sum(counts).alias("n_tokens"))


@query
def tfidf_features(spark, sf_dir):
    rows = processed(texts(spark, sf_dir))
    model = features.hashed_tfidf_pipeline().fit(rows)
    weights = vector_to_array("features")
    nonzero = F.size(F.filter(weights, lambda x: x != 0))
    return model.transform(rows).select("id", nonzero.alias("n_terms"), F.round(V.array_sum(weights), 6).alias("total"))


@query
def pca_project(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    rows = vectors(spark, sf_dir).withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    model = features.pca(30).fit(rows)
    whole = features.pca(len(rows.first().vector), target="turned").fit(rows)
    both = whole.transform(model.transform(rows)).select("id", vector_to_array("projected").alias("p"), vector_to_array("turned").alias("t"))
    square = V.dot(F.col("t"), F.col("t"))  # all components: a rotation, which keeps lengths
    first = F.slice("t", 1, F.size("p"))
    same = V.sqdist(F.transform("p", F.abs), F.transform(first, F.abs)) <= 1e-9 * (1 + square)
    return both.select("id", F.size("p").alias("dims"), F.round(square, 4).alias("square"), same.alias("first_components"))


# --- classification ------------------------------------------------------------------


@query
def positives(spark, sf_dir):
    return labels(spark, sf_dir).join(documents(spark, sf_dir).select("id"), "id").filter(F.col("label") == 1).select("id", "label")


@query
def predicted_positives(spark, sf_dir):
    scored = keyword_classify(processed(texts(spark, sf_dir)))
    return scored.filter(F.col("prediction") > 0.0).select("id", "prediction")


@query
def confusion_counts(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir), ["source"])


@query
def classification_metrics(spark, sf_dir):
    return metrics.classification_metrics(metrics.confusion(_scored(spark, sf_dir), ["dataset"]))


@query
def keyword_classify_metrics(spark, sf_dir):
    return metrics.classification_metrics(metrics.confusion(_scored(spark, sf_dir)))


_REGISTRY["keyword_classify"] = _REGISTRY.pop("keyword_classify_metrics")


@query
def fold_summary(spark, sf_dir):
    by_source = metrics.classification_metrics(metrics.confusion(_scored(spark, sf_dir), ["source"]))
    path = scratch_path(spark, "summary")
    sinks.write_fold_summary(metrics.fold_summary(by_source), path)
    return sinks.read_fold_summary(spark, path)


@query
def basic_statistics(spark, sf_dir):
    return metrics.basic_statistics(table(spark, sf_dir, "events"), "value", ["event_type"])


def _labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled posts ``(id, label, processedTweet)``, normalised and written once: training and scoring read them again."""
    return kept_rows(processed(posts(spark, sf_dir)).select("id", "label", "processedTweet"))


def _agreeing(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """``(id, agrees)``: whether a margin is the sum of its features times the written ``(feature, w)``."""
    scored = kept_rows(scored.select("id", "prediction", *entries("features")))  # read twice
    long = scored.select("id", F.explode(F.arrays_zip("indices", "values")).alias("e"))
    sums = long.join(weights, F.col("e.indices") == F.col("feature")).groupBy("id").agg(F.sum(F.col("e.values") * F.col("w")).alias("sum"))
    total = F.coalesce("sum", F.lit(0.0))
    close = F.abs(F.col("prediction") - total) <= 1e-9 * (1 + F.abs(total))
    return scored.select("id", "prediction").join(sums, "id", "left").select("id", close.alias("agrees"))


def _written_weights(spark: SparkSession, scorer) -> DataFrame:
    stage = scorer.model.stages[-1]
    vector = stage.getScalingVec() if scorer.spec.by_steps else stage.coefficients
    path = scratch_path(spark, "weights")
    spark.createDataFrame([(i, float(w)) for i, w in enumerate(vector.toArray())], "feature int, w double").write.parquet(path)
    return spark.read.parquet(path)


def _classified(spark: SparkSession, sf_dir: str, spec: Spec):
    """The model trained on labelled documents, and the unlabelled ones that it scored."""
    known = labels(spark, sf_dir)
    scorer = train(processed(posts(spark, sf_dir)), spec)
    rest = processed(texts(spark, sf_dir).join(known, "id", "left_anti"))
    return scorer, scorer.transform(rest).select("id", "features", "prediction")


@query
def svm_train(spark, sf_dir):
    """Every labelled post's margin, from the model and from its written weights."""
    rows = _labelled_texts(spark, sf_dir)
    scorer = train(rows, Spec("SVM"))
    return _agreeing(scorer.transform(rows), _written_weights(spark, scorer))


@query
def svm_steps(spark, sf_dir):
    """Weights after a few gradient steps over 40 hashed features."""
    scorer = train(processed(posts(spark, sf_dir)), Spec("SVM", 40, reg=0.1, step=1.0, max_iter=4))
    return _rounded(_written_weights(spark, scorer), w=6)


@query
def svm_classify(spark, sf_dir):
    scorer, scored = _classified(spark, sf_dir, Spec("SVM"))
    return _agreeing(scored, _written_weights(spark, scorer))


@query
def svm_sgd_classify(spark, sf_dir):
    scorer, scored = _classified(spark, sf_dir, Spec("SVM", reg=2.0, step=0.1))
    return _agreeing(scored, _written_weights(spark, scorer))


@query
def mlp_train(spark, sf_dir):
    """Number of weights of the layers, and whether all are numbers and some were learned."""
    scorer = train(processed(posts(spark, sf_dir)), Spec("MLP"))
    weights = spark.createDataFrame([(float(w),) for w in scorer.model.stages[-1].weights.toArray()], "w double")
    return weights.agg(F.count("w").alias("n_weights"), F.count_if(F.isnan("w")).alias("n_nan"), (F.stddev("w") > 0).alias("learned"))


@query
def mlp_classify(spark, sf_dir):
    """Every unlabelled post's class, from the model and from a forward pass over its weights."""
    scorer, scored = _classified(spark, sf_dir, Spec("MLP"))
    model = scorer.model.stages[-1]
    layers, weights = model.getLayers(), model.weights.toArray()

    def forward(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, layers[0]))
            for part in slices(batch):
                out[part.start : part.end, part.columns] = part.matrix
            at = 0
            for i, (n, m) in enumerate(zip(layers, layers[1:])):
                matrix, bias = weights[at : at + n * m].reshape(n, m), weights[at + n * m : at + n * m + m]
                out, at = out @ matrix + bias, at + n * m + m
                if i < len(layers) - 2:
                    out = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
            agrees = out.argmax(axis=1) == column(batch, "prediction").to_numpy()
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(agrees)], names=["id", "agrees"])

    return scored.select("id", "prediction", *entries("features")).mapInArrow(forward, "id string, agrees boolean")


@query
def model_roundtrip(spark, sf_dir):
    """Saved and reloaded models of both solvers score alike: largest margin difference is 0."""
    rows = _labelled_texts(spark, sf_dir)
    parts = []
    for spec in (Spec("SVM"), experiments.ENSEMBLE_SVM["A"]):
        path = scratch_path(spark, "model")
        scorer = experiments.train_model(rows, spec, path)
        loaded = models.load_model(path, spec)
        a = scorer.transform(rows).select("id", F.col("prediction").alias("fitted"))
        b = loaded.transform(rows).select("id", F.col("prediction").alias("loaded"))
        parts.append(a.join(b, "id").select(F.lit(spec.params).alias("params"), "fitted", "loaded"))
    return parts[0].unionByName(parts[1]).groupBy("params").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("fitted") - F.col("loaded"))).alias("difference")
    )


# --- experiments ---------------------------------------------------------------------


@query
def fold_split(spark, sf_dir):
    return experiments.assign_folds(documents(spark, sf_dir).select("id"))


@query
def ratio_split(spark, sf_dir):
    return experiments.hash_split(documents(spark, sf_dir).select("id"))


@query
def cross_validate_keyword(spark, sf_dir):
    results = experiments.cross_validate_keyword(processed(posts(spark, sf_dir)))
    return experiments.cross_validation_summary(results)


@query
def cross_validate_fit_per_fold(spark, sf_dir):
    """General fold loop with the rule classifier: must equal the one-pass form."""
    rows = cut_lineage(processed(posts(spark, sf_dir)).select("id", "label", "processedTweet"))
    return experiments.cross_validate(rows, experiments.keyword_fit)


def _classes(results: DataFrame, *by: str) -> DataFrame:
    """Rows of each class, and whether the rates are those of the counts."""
    part = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0)), 5)
    agree = (F.col("tpr") == part("tp", "fn")) & (F.col("tnr") == part("tn", "fp")) & (F.col("precision") == part("tp", "fp"))
    return results.select(*by, (F.col("tp") + F.col("fn")).alias("positives"), (F.col("tn") + F.col("fp")).alias("negatives"), agree.alias("rates_agree"))


@query
def cross_validate_svm(spark, sf_dir):
    rows = cut_lineage(processed(posts(spark, sf_dir)).select("id", "label", "processedTweet"))
    results = experiments.cross_validate(rows, experiments.model_fit(Spec("SVM", max_iter=20)))
    return _classes(results, "fold", "part")


@query
def cross_validate_steps(spark, sf_dir):
    """Two step sizes and all folds in one pass over the posts for each step."""
    rows = cut_lineage(processed(posts(spark, sf_dir)).select("id", "label", "processedTweet"))
    specs = [Spec("SVM", 300, reg=0.1, step=s, max_iter=20) for s in (0.5, 2.0)]
    return _classes(experiments.cross_validate_steps(rows, specs), "setting", "fold", "part")


@query
def ensemble_keyword(spark, sf_dir):
    return experiments.ensemble_metrics(_scored(spark, sf_dir))


@query
def ensemble_union(spark, sf_dir):
    scored = _scored(spark, sf_dir).select("id", "dataset", "period", "label", "prediction")
    parts = [scored.filter(F.col("dataset") == d) for d in "ABCD"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _source_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["id", "label", "date", "dataset", "period", "processedTweet"]
    return cut_lineage(processed(posts(spark, sf_dir)).select(*columns))


@query
def ensemble_svm(spark, sf_dir):
    scored = experiments.ensemble(_source_posts(spark, sf_dir), experiments.ENSEMBLE_SVM)
    return _classes(experiments.ensemble_metrics(scored), "period")


@query
def ensemble_mlp(spark, sf_dir):
    scored = experiments.ensemble(_source_posts(spark, sf_dir), experiments.ENSEMBLE_MLP)
    return _classes(experiments.ensemble_metrics(scored), "period")


def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = documents(spark, sf_dir).join(labels(spark, sf_dir), "id")
    return known.select(F.explode(F.array("dataset", F.lit("ABCD"))).alias("dataset")).distinct()


@query
def grid_runs(spark, sf_dir):
    return experiments.grid(_datasets(spark, sf_dir))


@query
def pending_runs(spark, sf_dir):
    runs = experiments.grid(_datasets(spark, sf_dir))
    known = documents(spark, sf_dir).join(labels(spark, sf_dir), "id")
    counted = known.groupBy("dataset").agg(F.count_if(F.col("label") == 0).alias("n"))
    mean = counted.agg(F.avg("n").alias("mean")).scalar()
    few = counted.filter(F.col("n") < mean)  # the runs of sources with few negatives are done
    results = runs.join(few.select("dataset"), "dataset", "left_semi").select("run")
    return sinks.pending_runs(runs, results)


@query
def grid_best(spark, sf_dir):
    results = metrics.classification_metrics(metrics.confusion(_scored(spark, sf_dir), ["dataset", "source"]))
    named = results.withColumn("run", F.concat_ws("_", "dataset", "source"))
    return experiments.best_run(named, "accuracy", ["dataset"])


@query
def grid_search(spark, sf_dir):
    """A part of the grid with values of every axis: all SVM settings together, MLPs one by one."""
    runs = experiments.grid(_datasets(spark, sf_dir)).filter("num_features in (30, 50) and dataset in ('A', 'B')")
    runs = runs.filter("classifier = 'SVM' or params in ('2_5', '3_7')")
    results = experiments.run_grid(_source_posts(spark, sf_dir), runs, scratch_path(spark, "grid"), k=2, max_iter=10)
    within = reduce(lambda a, b: a & b, [F.col(m).between(0, 1) for m in metrics.METRICS])
    held = F.abs(F.col("tpr") - F.col("recall")) <= 1e-9
    return results.select("run", (within & held).alias("consistent"))


@query
def train_model(spark, sf_dir):
    """A model saved and read back scores as its written weights do."""
    path = scratch_path(spark, "model")
    spec = experiments.ENSEMBLE_SVM["A"]
    rows = _labelled_texts(spark, sf_dir)
    experiments.train_model(rows, spec, path)
    loaded = models.load_model(path, spec)
    return _agreeing(loaded.transform(rows), _written_weights(spark, loaded))


@query
def classify_saved(spark, sf_dir):
    rows = processed(posts(spark, sf_dir))
    path = scratch_path(spark, "model")
    parts = experiments.hash_split(rows)
    scorer = experiments.train_model(parts.filter(F.col("part") == "train"), experiments.BEST_PER_SOURCE["A"], path)
    test = parts.filter(F.col("part") == "test")
    return _classes(experiments.classify_saved(test, scorer.spec, path, scratch_path(spark, "quadrants")))


@query
def train_and_test(spark, sf_dir):
    rows = processed(posts(spark, sf_dir))
    results, _scored_rows, clusters, members = experiments.train_and_test(rows, Spec("SVM", max_iter=20))
    counted = clusters.agg(F.sum("n").alias("n_clustered"), F.bool_and("final").alias("all_final"))
    once = members.agg((F.count("id") == F.count_distinct("id")).alias("each_once"))
    return _classes(results).crossJoin(counted).crossJoin(once)  # three tables of one row


# --- posts ---------------------------------------------------------------------------


@query
def preview(spark, sf_dir):
    rows = processed(texts(spark, sf_dir)).select("id", F.col("processedTweet").alias("p"))
    return io.preview(rows, 1000)


@query
def posts_distinct(spark, sf_dir):
    rows = texts(spark, sf_dir).select("id", "tweet")
    return io.posts_distinct(rows.unionByName(rows.withColumn("tweet", F.concat(F.lit("!"), "tweet"))))


# --- clusters ------------------------------------------------------------------------


@query
def cluster_similarity(spark, sf_dir):
    return _rounded(cohesion.cluster_similarity(term_clusters(spark, sf_dir)), similarity=6)


def _weight_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(
        worded(texts(spark, sf_dir)).select("id", "words", lead_term(F.col("words")).alias("cluster"))
    )
    n = documents(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    tf = features.term_counts(rows)
    weighted = features.tfidf_terms(tf, features.document_frequency(tf), n)
    keys = rows.select("id", "cluster").filter(F.col("cluster") != "")
    long = weighted.join(keys, "id").select("cluster", "id", F.round("weight", 9).alias("weight"))
    return cohesion.cluster_weight_similarity(long)


@query
def cluster_weight_similarity(spark, sf_dir):
    return _rounded(_weight_similarity(spark, sf_dir), similarity=6).drop("final")


@query
def cluster_final_flag(spark, sf_dir):
    return _weight_similarity(spark, sf_dir).select("cluster", "final")


@query
def cluster_pair_overlap(spark, sf_dir):
    common = cohesion.common_terms(term_clusters(spark, sf_dir))
    return _rounded(cohesion.cluster_pair_overlap(common), min_overlap=6, max_overlap=6)


@query
def cluster_stats(spark, sf_dir):
    path = scratch_path(spark, "stats")
    sinks.append_cluster_stats(cohesion.cluster_stats(kept_rows(cohesion.common_terms(term_clusters(spark, sf_dir)))), path)
    return sinks.read_cluster_stats(spark, path)


@query
def cluster_diff(spark, sf_dir):
    rows = term_clusters(spark, sf_dir).select("cluster", "id")
    return exemplars.cluster_diff(rows, rows.join(labels(spark, sf_dir).select("id"), "id", "left_semi"))


@query
def term_set_ops(spark, sf_dir):
    rows = term_clusters(spark, sf_dir)
    first = rows.groupBy("cluster").agg(F.min_by("terms", "id").alias("first_terms"))
    both = rows.join(first, "cluster")
    return both.select(
        "id",
        F.size(F.array_intersect("terms", "first_terms")).alias("n_common"),
        F.size(F.array_union("terms", "first_terms")).alias("n_union"),
    )


@query
def cluster_listing(spark, sf_dir):
    rows = term_clusters(spark, sf_dir)
    members = rows.select(F.col("cluster").alias("cluster_id"), "id")
    return listings.listing_lines(listed_clusters(rows), members, documents(spark, sf_dir))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = term_clusters(spark, sf_dir)
    members = rows.select(F.col("cluster").alias("cluster_id"), "id")
    path = scratch_path(spark, "listing") + "/tweetsDF_acme.csv_clusters"
    listings.write_cluster_listing(listed_clusters(rows), members, documents(spark, sf_dir), path)
    return listings.read_cluster_listing(spark, path)


@query
def cluster_listing_parse(spark, sf_dir):
    return _parsed(spark, sf_dir).select("block", "position", "role", "date", "id", "tweet")


@query
def clean_cluster_listing(spark, sf_dir):
    cleaned = with_origin(clean_listing(_parsed(spark, sf_dir), STOPWORDS))
    return cleaned.select(
        "listing_type", "organisation", "order_key", "block", F.coalesce("position", F.lit(0)).alias("position"), "line"
    )


@query
def clean_listing_file(spark, sf_dir):
    path = scratch_path(spark, "clean")
    write_clean_listing(clean_listing(_parsed(spark, sf_dir), STOPWORDS), path)
    return with_origin(spark.read.text(path)).select("listing_type", "organisation", F.col("value").alias("line"))


@query
def eps_components(spark, sf_dir):
    return components.eps_components(vectors(spark, sf_dir).select("id", "vector"), 1.12)


@query
def kmeans_assign(spark, sf_dir):
    """Whether the cluster given to a post is that of the nearest center."""
    rows = cut_lineage(clustering.with_features(processed(texts(spark, sf_dir)).select("id", "processedTweet")).select("id", "features"))
    model = kmeans.fit(rows, 8)
    centers = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "cluster int, centroid array<double>")
    nearest = kmeans.assign(rows.select("id", vector_to_array("features").alias("vector")), centers)
    given = model.transform(rows).select("id", "prediction")
    return given.join(nearest, "id").select("id", (F.col("prediction") == F.col("cluster")).alias("nearest"))


@query
def kmeans_sweep(spark, sf_dir):
    """The costs of a sweep: k from two up by one, falling up to the last."""
    rows = cut_lineage(clustering.with_features(processed(texts(spark, sf_dir)).select("id", "processedTweet")).select("id", "features"))
    n = rows.count()
    sweep = kmeans.kmeans_sweep(rows, n)
    ks, costs = zip(*sweep.costs)
    falling = all(b < a for a, b in zip(costs[:-2], costs[1:-1]))
    ended = len(costs) < 2 or costs[-1] >= costs[-2] or costs[-1] == 0 or ks[-1] >= n
    return spark.createDataFrame([(ks[0], ks == tuple(range(ks[0], ks[0] + len(ks))), falling, ended)], "first_k int, one_by_one boolean, falling boolean, ended boolean")


def _verified(result: tuple[DataFrame, DataFrame], sets: DataFrame) -> DataFrame:
    """For each post: clusters that hold it, whether it has no terms, and whether its cluster keeps what it states."""
    clusters, members = (cut_lineage(d.drop("week_bucket")) for d in result)
    again = cohesion.cluster_similarity(members.join(kept_rows(sets.select("id", "terms")), "id"))  # read twice
    exemplar = members.join(clusters, (members["cluster"] == clusters["cluster"]) & (members["id"] == clusters["exemplar_id"]))
    kept = exemplar.select(members["cluster"].alias("cluster")).distinct().withColumn("has_exemplar", F.lit(True))
    empty = F.col("cluster").endswith("empty")
    same = F.abs(F.col("found") - F.col("similarity")) <= 1e-9
    judged = (
        clusters.join(again.select("cluster", F.col("n").alias("counted"), F.col("similarity").alias("found")), "cluster", "left")
        .join(kept, "cluster", "left")
        .select("cluster", empty.alias("without_terms"), (F.col("final") & (empty | (same & (F.col("found") >= 2 / 3)))).alias("cohesive"), ((F.col("n") == F.col("counted")) & F.coalesce("has_exemplar", F.lit(False))).alias("described"))
    )
    return members.join(judged, "cluster", "left").groupBy("id").agg(
        F.count(F.lit(1)).alias("in_clusters"), F.bool_or("without_terms").alias("without_terms"), F.bool_and("cohesive").alias("cohesive"), F.bool_and("described").alias("described")
    )


def _term_sets(rows: DataFrame, text: str = "processedTweet") -> DataFrame:
    return features.weighted_term_sets(rows.withColumn("words", tokenise(F.col(text))))


@query
def recursive_clusters(spark, sf_dir):
    rows = cut_lineage(processed(texts(spark, sf_dir)))
    return _verified(clustering.cluster_posts(rows), _term_sets(rows))


@query
def pooled_clusters(spark, sf_dir):
    """The rule that pools open posts, k carried from round to round, over the labelled posts."""
    rows = cut_lineage(processed(posts(spark, sf_dir)))
    return _verified(clustering.cluster_posts(rows, num_features=300, rule="pool", carry_k=True), _term_sets(rows))


@query
def cluster_positives(spark, sf_dir):
    rows = cut_lineage(processed(posts(spark, sf_dir)))
    return _verified(clustering.cluster_positives(rows), _term_sets(rows.filter("label = 1")))


@query
def cluster_raw(spark, sf_dir):
    rows = cut_lineage(texts(spark, sf_dir))
    return _verified(clustering.cluster_raw(rows), _term_sets(io.nonempty(rows), "tweet"))


@query
def weekly_clusters(spark, sf_dir):
    rows = cut_lineage(_after_cutoff(processed(texts(spark, sf_dir))))
    return _verified(clustering.weekly_clusters(rows), _term_sets(rows))


@query
def weekly_positive_clusters(spark, sf_dir):
    """Predicted positives after the cutoff: each in one cohesive cluster of its own week."""
    scored = experiments.ensemble(_source_posts(spark, sf_dir), experiments.BEST_PER_SOURCE)
    later = cut_lineage(scored.filter(F.col("period") != "d1"))
    clusters, members = clustering.weekly_positive_clusters(later)
    positives = _after_cutoff(later.filter("prediction > 0"))
    rows = _verified((clusters, members), _term_sets(positives)).join(positives.select("id", F.lit(True).alias("expected")), "id", "full")
    weeks = members.join(positives.select("id", F.weekofyear("day").alias("week")), "id").groupBy("cluster").agg(F.count_distinct("week").alias("weeks"))
    one = weeks.agg((F.coalesce(F.max("weeks"), F.lit(1)) == 1).alias("one_week"))
    fine = (F.col("in_clusters") == 1) & F.col("expected") & F.col("cohesive") & F.col("described")
    return rows.agg(F.coalesce(F.bool_and(F.coalesce(fine, F.lit(False))), F.lit(True)).alias("all_fine")).crossJoin(one)  # two tables of one row
