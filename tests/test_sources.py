from pyspark.sql import functions as F

from gullwatch.functions.fixed import LISTING_SEPARATOR
from gullwatch.plans.listings import clean_listing, with_origin, write_clean_listing
from gullwatch.sources import listing, posts, sinks


def lines(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def test_read_posts(spark, tmp_path):
    (tmp_path / "p").write_text("1\t2016-04-02\thello\t7\nx\t2016-04-03\t\t8\n")
    rows = posts.read_posts(spark, str(tmp_path / "p")).orderBy("id").collect()
    assert [(r.label, r.tweet, r.id) for r in rows] == [(1, "hello", "7"), (None, None, "8")]
    raw = posts.read_posts(spark, str(tmp_path / "p"), label_type="string")
    assert tuple(posts.removed_counts(raw).first()) == (2, 1, 1)
    assert posts.nonempty(raw).count() == 1


def test_stopwords(spark, tmp_path):
    (tmp_path / "s").write_text("the\nof\n")
    assert posts.stopword_list(posts.read_stopwords(spark, str(tmp_path / "s"))) == ["of", "the"]


def test_clean_and_quadrant_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "2016-04-01 x", "on cutoff", "1", 1.0), (1, "2016-04-03 y", "a\nb", "2", 1.0), (0, "2016-04-02 z", "c", "3", -1.0)],
        "label int, date string, tweet string, id string, prediction double",
    )
    sinks.write_clean(df, str(tmp_path / "clean"))
    assert lines(spark, tmp_path / "clean") == ["0\t2016-04-02\tc\t3", "1\t2016-04-03\ta b\t2"]
    sinks.write_quadrants(df, str(tmp_path / "q"))
    got = {(r.quadrant, r.value) for r in spark.read.text(str(tmp_path / "q")).collect()}
    assert got == {("tps", "1.0 on cutoff"), ("tps", "1.0 a b"), ("tns", "-1.0 c")}


def test_listing_round_trip(spark, tmp_path):
    table = spark.createDataFrame([(str(i), "2016-04-02", f"post {i}\nline") for i in range(30)], "id string, date string, tweet string")
    members = table.select(F.when(F.col("id").cast("int") < 20, "a").otherwise("b").alias("cluster_id"), "id")
    clusters = spark.createDataFrame([("a", "3"), ("b", "25")], "cluster_id string, exemplar_id string")
    path = str(tmp_path / "listing")
    listing.write_cluster_listing(clusters, members, table, path)
    first = lines(spark, path)[:5]
    assert first == ["", LISTING_SEPARATOR, "Cluster 1", "2016-04-02\t3\tpost 3 line", LISTING_SEPARATOR]
    back = listing.read_cluster_listing(spark, path).collect()
    assert sorted((r.block, r.id) for r in back if r.role == "exemplar") == [(1, "3"), (2, "25")]
    assert len([r for r in back if r.role == "member" and r.block == 1]) == 20
    assert len([r for r in back if r.role == "member"]) == 30


def test_listing_parsed_across_small_splits(spark, tmp_path):
    body = []
    for n in range(1, 40):
        body += ["", LISTING_SEPARATOR, f"Cluster {n}", f"d\te{n}\texemplar {n}", LISTING_SEPARATOR]
        body += [f"d\tm{n}-{i}\tmember {n} {i}" for i in range(n)]
    path = tmp_path / "tweetsDF_acme.csv_clusters"
    path.write_text("\n".join(body) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = listing.read_cluster_listing(spark, str(path))
        assert rows.rdd.getNumPartitions() >= 1
        got = rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for n in range(1, 40):
        block = sorted((r.position, r.id) for r in got if r.block == n)
        assert block == [(1, f"e{n}")] + [(i + 2, f"m{n}-{i}") for i in range(n)]
    origin = with_origin(rows).select("listing_type", "organisation").distinct().collect()
    assert [tuple(r) for r in origin] == [("tweets", "acme")]


def test_clean_listing(spark, tmp_path):
    text = ["", LISTING_SEPARATOR, "Cluster 1", "d\t1\tzebra", LISTING_SEPARATOR, "d\t1\tzebra yak", "d\t2\tyak ant", "", LISTING_SEPARATOR, "Cluster 2", "a\t3\tant", LISTING_SEPARATOR, "a\t3\tb a"]
    (tmp_path / "l").write_text("\n".join(text))
    cleaned = clean_listing(listing.read_cluster_listing(spark, str(tmp_path / "l")))
    write_clean_listing(cleaned, str(tmp_path / "out"))
    got = lines(spark, tmp_path / "out")
    assert got == ["a\t3\ta b\ta\t3\tb a", "", "d\t1\tyak zebra\td\t1\tzebra yak", "d\t2\tant yak\td\t2\tyak ant", ""]


def test_pending_runs_and_embeddings(spark, tmp_path):
    grid = spark.createDataFrame([("r1",), ("r2",)], "run string")
    assert [r.run for r in sinks.pending_runs(grid, grid.filter("run = 'r1'")).collect()] == ["r2"]
    vectors = spark.createDataFrame([("a", [0.1, -2.0])], "token string, vector array<double>")
    posts.write_embeddings_text(vectors, str(tmp_path / "v"))
    assert lines(spark, tmp_path / "v") == ["a: [0.1, -2.0]"]
    assert posts.read_embeddings_text(spark, str(tmp_path / "v")).collect() == vectors.collect()


def test_posts_distinct(spark):
    df = spark.createDataFrame([("1", "b"), ("1", "a"), ("2", "c")], "id string, tweet string")
    assert sorted(tuple(r) for r in posts.posts_distinct(df).collect()) == [("1", "a"), ("2", "c")]


def test_lines_of_a_listing_are_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "tweetsDF_x.csv_clusters")
    lines = ["", "%%%", "Cluster 1"] + [f"2016-04-02\t{i}\tpost {i}" for i in range(5)]
    spark.createDataFrame([(x,) for x in lines * 3], "value string").repartition(1).write.text(path)
    parsed = listing.read_cluster_listing(spark, path)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Window [" in x and "windowspecdefinition(split" in x for x in plan.splitlines()) == 3  # the windows over lines, for the rows alone and not for the carry too
    assert parsed.count() > 0
