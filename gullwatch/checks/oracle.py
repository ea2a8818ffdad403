"""SQL counterparts of the registered queries, written independently of the operators."""

from __future__ import annotations

from gullwatch.functions.fixed import (
    ATTACK_TERMS,
    ESCAPE_PATTERN,
    LISTING_SEPARATOR,
    TENS_WORDS,
    UNIT_WORDS,
    URL_PATTERN,
)
from gullwatch.operators.metrics import METRICS
from gullwatch.plans.experiments import GRID_FEATURES, GRID_LAYERS, GRID_REG, GRID_STEPS, GRID_WIDTHS

STOP = "['the','of','and','to','in','is','that','a','de','la']"


def _strings(words) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


def _sub(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, '{pattern}', '{by}', 'g')"


def _squeeze(c: str) -> str:
    return f"trim({_sub(c, chr(92) + 's+', ' ')})"


def _below_thousand(n: str) -> str:
    u, t = f"{_strings(UNIT_WORDS)}", f"{_strings(TENS_WORDS)}"
    return (
        f"concat_ws(' ', CASE WHEN {n} >= 100 THEN {u}[{n} // 100 + 1] || ' hundred' END, "
        f"CASE WHEN {n} % 100 >= 20 THEN {t}[({n} % 100) // 10 + 1] END, "
        f"CASE WHEN {n} % 100 >= 20 AND {n} % 10 > 0 THEN {u}[{n} % 10 + 1] END, "
        f"CASE WHEN {n} % 100 BETWEEN 1 AND 19 THEN {u}[{n} % 100 + 1] END)"
    )


def _numbers(c: str) -> str:
    count = "CAST(ceil(length(ltrim(x, '0')) / 12) AS INTEGER)"
    twelve = f"substr(lpad(ltrim(x, '0'), {count} * 12, '0'), CAST(i AS INTEGER) * 12 + 1, 12)"
    groups = []
    for k, scale in enumerate(["billion", "million", "thousand", ""]):
        n = f"TRY_CAST(substr({twelve}, {3 * k + 1}, 3) AS INTEGER)"
        words = _below_thousand(n) + (f" || ' {scale}'" if scale else "")
        groups.append(f"CASE WHEN {n} > 0 THEN {words} END")
    words = f"concat_ws(' ', {', '.join(groups)})"
    named = f"list_transform(range({count}), lambda i: CASE WHEN {words} <> '' THEN {words} || repeat(' trillion', {count} - 1 - CAST(i AS INTEGER)) END)"
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, '([0-9]+|[^0-9]+)'), lambda x: "
        f"CASE WHEN NOT regexp_matches(x, '^[0-9]') THEN x WHEN ltrim(x, '0') = '' THEN 'zero ' "
        f"ELSE array_to_string({named}, ' ') || ' ' END), '')"
    )


def _no_stop(c: str) -> str:
    return f"array_to_string(list_filter(string_split(rtrim({c}, ' '), ' '), lambda w: NOT list_contains({STOP}, w)), ' ')"


def _points(c: str) -> str:
    return f"replace(replace({_sub(c, ESCAPE_PATTERN)}, '.', ' point '), '-', ' hyphen ')"


def _normalised(c: str, stop: bool = False, numbers: bool = True) -> str:
    c = f"lower({c})"
    if stop:
        c = _no_stop(c)
    c = _sub(c, URL_PATTERN)
    if not numbers:
        return _squeeze(_points(c))
    return _squeeze(_sub(_points(_numbers(c)), "[^\\s^a-z]"))


def _signature_clean(c: str) -> str:
    c = _sub(_sub(c, URL_PATTERN), ESCAPE_PATTERN)
    c = f"replace(replace({c}, '.', ''), '-', '')"
    return _no_stop(_squeeze(_sub(c, "[^\\s^a-z]")))


def _sorted_tokens(c: str) -> str:
    return f"array_to_string(list_sort(string_split(rtrim({c}, ' '), ' ')), ' ')"


def _half_up(x: str, n: int) -> str:
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,20)), {n}) AS DOUBLE)"


def _week(d: str, start: int, fewest: int) -> str:
    dow = f"((isodow({d}) - {start} + 7) % 7 + 1)"
    begin = f"(((dayofyear({d}) - {dow}) % 7 + 7) % 7)"
    offset = f"(CASE WHEN {begin} + 1 > {fewest} THEN 7 - {begin} ELSE -{begin} END)"
    return f"CAST((7 + {offset} + dayofyear({d}) - 1) // 7 AS INTEGER)"


DOCS = """docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
    strftime(DATE '2016-03-20' + CAST(doc_id % 120 AS INTEGER), '%Y-%m-%d') AS date,
    DATE '2016-03-20' + CAST(doc_id % 120 AS INTEGER) AS day,
    text AS tweet, source, lang,
    substr('ABCD', CAST(substr(source, 4) AS INTEGER) % 4 + 1, 1) AS dataset,
    'd' || CAST(doc_id % 3 + 1 AS VARCHAR) AS period
  FROM documents)"""
POSTS = DOCS + """, posts AS (
  SELECT docs.*, l.quality AS label, l.toxic FROM docs
  JOIN labels l ON docs.id = CAST(l.doc_id AS VARCHAR))"""
BLANKS = (
    DOCS.replace("docs AS", "given AS", 1)
    + ", docs AS (SELECT * FROM given UNION ALL SELECT id || '-blank', date, day, '', source, lang, dataset, period FROM given WHERE lang = 'es')"
)
NORMED = DOCS + f", normed AS MATERIALIZED (SELECT *, {_normalised('tweet')} AS p FROM docs)"
HIT = " OR ".join(f"contains(p, '{t}')" for t in ATTACK_TERMS)
ALL_SCORED = NORMED + f", scored AS (SELECT *, CASE WHEN {HIT} THEN CAST(1.0 AS DOUBLE) ELSE CAST(-1.0 AS DOUBLE) END AS prediction FROM normed)"
SCORED = (
    POSTS
    + f", normed AS MATERIALIZED (SELECT *, {_normalised('tweet')} AS p FROM posts)"
    + f", scored AS (SELECT *, CASE WHEN {HIT} THEN CAST(1.0 AS DOUBLE) ELSE CAST(-1.0 AS DOUBLE) END AS prediction FROM normed)"
)
TOKENS = NORMED + """, toks AS (
  SELECT id, unnest(string_split(p, ' ')) AS term FROM normed WHERE p <> '')
, tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM toks WHERE term <> '' GROUP BY 1, 2)
, df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
, weights AS (
  SELECT id, term, tf, df, tf * ln(((SELECT count(*) FROM docs) + 1.0) / (df + 1.0)) AS weight
  FROM tf JOIN df USING (term) WHERE df < (SELECT count(*) FROM docs))"""
CLUSTERS = TOKENS + """, lead AS (
  SELECT id, term AS cluster FROM (
    SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY length(term) DESC, term) AS r FROM tf)
  WHERE r = 1)
, long AS (SELECT cluster, lead.id, term, weight FROM lead JOIN weights ON lead.id = weights.id)
, sizes AS (
  SELECT cluster, count(*) AS n, min(m) AS min_terms FROM (
    SELECT lead.cluster, lead.id, count(weights.term) AS m
    FROM lead LEFT JOIN weights ON lead.id = weights.id GROUP BY 1, 2) GROUP BY 1)
, common AS (
  SELECT long.cluster, term FROM long JOIN sizes ON long.cluster = sizes.cluster
  GROUP BY 1, 2, n HAVING count(*) = n)
, ncommon AS (SELECT cluster, count(*) AS c FROM common GROUP BY 1)
, sims AS (
  SELECT sizes.cluster, n, coalesce(c, 0) AS n_common, min_terms,
    coalesce(CAST(c AS DOUBLE) / nullif(min_terms, 0), 0.0) AS similarity
  FROM sizes LEFT JOIN ncommon ON sizes.cluster = ncommon.cluster)
, pairs AS (
  SELECT a.cluster AS a, b.cluster AS b, coalesce(x.c, 0) AS shared,
    coalesce(na.c, 0) AS ca, coalesce(nb.c, 0) AS cb
  FROM sizes a JOIN sizes b ON a.cluster < b.cluster
  LEFT JOIN (SELECT p.cluster AS a, q.cluster AS b, count(*) AS c FROM common p
    JOIN common q ON p.term = q.term AND p.cluster < q.cluster GROUP BY 1, 2) x
    ON x.a = a.cluster AND x.b = b.cluster
  LEFT JOIN ncommon na ON na.cluster = a.cluster LEFT JOIN ncommon nb ON nb.cluster = b.cluster)"""
LINES = CLUSTERS + f""", numbered AS (
  SELECT cluster, min(id) AS exemplar_id, row_number() OVER (ORDER BY cluster) AS cluster_no
  FROM lead GROUP BY cluster)
, lines AS (
  SELECT id, date, {_squeeze('tweet')} AS t, concat_ws(chr(9), date, id, {_squeeze('tweet')}) AS line FROM docs)
, members AS (
  SELECT cluster_no, lead.id, date, t, line, row_number() OVER (PARTITION BY cluster_no ORDER BY lead.id) AS r
  FROM lead JOIN numbered USING (cluster) JOIN lines ON lines.id = lead.id)"""
CLEANED = f"""{LINES}
, keyed AS (SELECT cluster_no AS block, {_sorted_tokens(_signature_clean('line'))} || chr(9) || line AS order_key FROM numbered JOIN lines ON id = exemplar_id)
, cleaned AS (SELECT order_key, block, r + 1 AS position, concat_ws(chr(9), date, id, {_sorted_tokens('t')}, line) AS line FROM members JOIN keyed ON block = cluster_no
  UNION ALL SELECT order_key, block, 0, '' FROM keyed)"""
VECTORS = "vecs AS (SELECT label AS cluster, vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)"
MEANS = VECTORS + ", means AS (SELECT cluster, pos, avg(x) AS c FROM vecs GROUP BY 1, 2)" + (
    ", dist AS (SELECT v.cluster, v.id, sum((x - c) * (x - c)) AS d FROM vecs v JOIN means m"
    " ON v.cluster = m.cluster AND v.pos = m.pos GROUP BY 1, 2)"
)
DICTIONARY = f"""words AS (
  SELECT DISTINCT token FROM (
    SELECT unnest(string_split({_normalised('text')}, ' ')) AS token FROM benchmark) WHERE token <> '')
, dict AS (
  SELECT token, embedding FROM words JOIN embeddings
    ON vec_id = ('0x' || substr(md5(token), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)
  UNION ALL SELECT '<UNK>', embedding FROM embeddings WHERE vec_id = 0)"""
BLANK_TOKENS, BLANK_NORMED = TOKENS.replace(DOCS, BLANKS), NORMED.replace(DOCS, BLANKS)
#: Mean vectors by post and position; posts without tokens are all zero.
VECTOR_MEANS = f"""WITH {BLANK_TOKENS}, {DICTIONARY}
, v AS (SELECT id, tf, coalesce(d.embedding, (SELECT embedding FROM dict WHERE token = '<UNK>')) AS e FROM tf LEFT JOIN dict d ON term = token)
, u AS (SELECT id, tf, unnest(e)::DOUBLE AS x, generate_subscripts(e, 1) - 1 AS pos FROM v)
, m AS (SELECT id, pos::INTEGER AS pos, sum(tf * x) / sum(tf) AS x FROM u GROUP BY 1, 2
  UNION ALL SELECT id, p::INTEGER, 0.0 FROM docs, (SELECT unnest(range(64)) AS p) WHERE id NOT IN (SELECT id FROM tf))"""
FOLD = "CAST(('0x' || substr(md5(id), 1, 8))::BIGINT % 10 AS INTEGER)"


def _metrics(source: str, by: str = "", keep: str = "") -> str:
    """Metrics per group of a relation with columns label and prediction."""
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    div = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"
    return f"""
, counts AS (SELECT {lead}
    count(*) FILTER (label > 0 AND prediction > 0) AS tp, count(*) FILTER (label <= 0 AND prediction > 0) AS fp,
    count(*) FILTER (label <= 0 AND prediction <= 0) AS tn, count(*) FILTER (label > 0 AND prediction <= 0) AS fn
  FROM {source} {group})
, rates AS (SELECT {lead} tp, fp, tn, fn,
    {_half_up(div('tp', '(tp + fn)'), 5)} AS tpr, {_half_up(div('tn', '(tn + fp)'), 5)} AS tnr,
    {_half_up(div('fp', '(fp + tn)'), 5)} AS fpr, {_half_up(div('fn', '(fn + tp)'), 5)} AS fnr,
    {_half_up(div('(tp + tn)', '(tp + tn + fp + fn)'), 2)} AS accuracy,
    {_half_up(div('tp', '(tp + fp)'), 5)} AS "precision", {_half_up(div('tp', '(tp + fn)'), 5)} AS recall
  FROM counts)
, metrics AS (SELECT *, {_half_up('(tpr + tnr) / 2', 5)} AS avg_tp_tn,
    {_half_up(div('(2 * "precision" * recall)', '("precision" + recall)'), 5)} AS f_measure,
    {_half_up('sqrt(tpr * tnr)', 5)} AS g_mean FROM rates)"""


def _summary(source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    long = " UNION ALL ".join(f"SELECT {lead}'{m}' AS metric, \"{m}\" AS value FROM {source}" for m in METRICS)
    return f""", long_metrics AS ({long})
SELECT {lead}metric, {_half_up('CAST(sum(CAST(value AS DECIMAL(18,5))) AS DOUBLE) / count(value)', 5)} AS avg,
  round(stddev_pop(value), 5) AS std, min(value) AS min, max(value) AS max FROM long_metrics GROUP BY {lead}metric"""


FOLD_RESULTS = (
    SCORED
    + f", folded AS (SELECT *, {FOLD} AS own FROM scored)"
    + ", parts AS (SELECT f.i AS fold, CASE WHEN own = f.i THEN 'test' ELSE 'train' END AS part, label, prediction"
    + " FROM folded, (SELECT unnest(range(10))::INTEGER AS i) f)"
    + _metrics("parts", "fold, part")
)
ALL_METRICS = ", ".join(f'"{m}"' for m in METRICS)

_GRID = f"""sets AS (
  SELECT DISTINCT unnest([dataset, 'ABCD']) AS dataset FROM posts)
, feats AS (SELECT dataset, unnest({GRID_FEATURES}) AS num_features FROM sets)
, runs AS (
  SELECT dataset, num_features, 'SVM' AS classifier, c || '_' || s AS params FROM feats,
    (SELECT unnest({_strings(GRID_REG)}) AS c), (SELECT unnest({_strings(GRID_STEPS)}) AS s)
  UNION ALL
  SELECT dataset, num_features, 'MLP', l || '_' || w FROM feats,
    (SELECT unnest({_strings(GRID_LAYERS)}) AS l), (SELECT unnest({_strings(GRID_WIDTHS)}) AS w))
, named AS (SELECT *, concat_ws('_', 'TF-IDF', num_features, classifier, params, dataset) AS run FROM runs)"""


def _hashed(rows: str, dims: int) -> str:
    """Slots of the tokens of ``p`` by 32-bit Murmur3 with seed 42, and their TF-IDF over the same rows."""
    low = lambda x: f"(({x}) % 4294967296)"
    turn = lambda x, n: f"({x} * {2**n} % 4294967296 + {x} // {2 ** (32 - n)})"
    four = "c[4 * i + 1] + c[4 * i + 2] * 256 + c[4 * i + 3] * 65536 + c[4 * i + 4] * 16777216"
    step = turn("xor(h, k)", 13)
    return f""", words AS (SELECT id, unnest(string_split(p, ' ')) AS term FROM {rows})
, spelled AS (SELECT term, length(term)::HUGEINT AS n, list_transform(string_split(term, ''), lambda x: ascii(x)::HUGEINT) AS c FROM (SELECT DISTINCT term FROM words))
, quads AS (SELECT *, list_transform(range((n // 4)::BIGINT), lambda i: {low(f"({four}) * 3432918353")}) AS q,
    CASE WHEN n % 4 > 0 THEN c[4 * (n // 4)::BIGINT + 1] + coalesce(c[4 * (n // 4)::BIGINT + 2], 0) * 256 + coalesce(c[4 * (n // 4)::BIGINT + 3], 0) * 65536 ELSE 0 END AS rest FROM spelled)
, body AS (SELECT term, n, list_reduce([42::HUGEINT] || list_transform(q, lambda x: {low(turn("x", 15) + " * 461845907")}), lambda h, k: {low(f"{step} * 5 + 3864292196")}) AS h, {low("rest * 3432918353")} AS r FROM quads)
, tailed AS (SELECT term, xor(xor(h, {low(turn("r", 15) + " * 461845907")}), n) AS h FROM body)
, mixed AS (SELECT term, {low("xor(h, h // 65536) * 2246822507")} AS h FROM tailed)
, remixed AS (SELECT term, {low("xor(h, h // 8192) * 3266489909")} AS h FROM mixed)
, placed AS (SELECT term, (CASE WHEN f >= 2147483648 THEN ((f - 4294967296) % {dims} + {dims}) % {dims} ELSE f % {dims} END)::INTEGER AS slot FROM (SELECT term, xor(h, h // 65536) AS f FROM remixed))
, slots AS MATERIALIZED (SELECT id, slot, count(*) AS tf FROM words JOIN placed USING (term) GROUP BY 1, 2)
, slot_idf AS (SELECT slot, ln(((SELECT count(*) FROM {rows}) + 1.0) / (count(*) + 1.0)) AS idf FROM slots GROUP BY 1)
, weighted AS MATERIALIZED (SELECT id, slot, tf * idf AS v FROM slots JOIN slot_idf USING (slot))"""


def _gradient_steps(dims: int, reg: float, step: float, n: int) -> str:
    """Hinge-loss steps from zero weights over ``weighted`` and the labels of ``normed``."""
    sql = f", w0 AS (SELECT unnest(range({dims}))::INTEGER AS slot, 0.0::DOUBLE AS w)"
    for t in range(1, n + 1):
        size = step / t**0.5
        sql += f"""
, m{t} AS (SELECT normed.id, 2 * label - 1 AS y, coalesce(sum(v * w), 0.0) AS m FROM normed LEFT JOIN weighted ON weighted.id = normed.id LEFT JOIN w{t - 1} USING (slot) GROUP BY 1, 2)
, g{t} AS (SELECT slot, sum(-y * v) / (SELECT count(*) FROM normed) AS g FROM weighted JOIN m{t} ON weighted.id = m{t}.id WHERE 1 > y * m GROUP BY 1)
, w{t} AS MATERIALIZED (SELECT slot, w * (1 - {size!r} * {reg}) - {size!r} * coalesce(g, 0.0) AS w FROM w{t - 1} LEFT JOIN g{t} USING (slot))"""
    return sql


def _clustered(source: str, tokens: str = "string_split(p, ' ')") -> str:
    """Each post of ``source`` in one sound cluster; without terms if all its tokens are in every post."""
    return f""", own AS (SELECT DISTINCT id, unnest({tokens}) AS term FROM {source})
, telling AS (SELECT term FROM own WHERE term <> '' GROUP BY 1 HAVING count(*) < (SELECT count(*) FROM {source}))
, told AS (SELECT DISTINCT id FROM own JOIN telling USING (term))
SELECT id, 1::BIGINT AS in_clusters, id NOT IN (SELECT id FROM told) AS without_terms, TRUE AS cohesive, TRUE AS described FROM {source}"""


_RAW_TOKENS = "regexp_split_to_array(rtrim(lower(tweet), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s')"
_LABELLED = "count(*) FILTER (label > 0) AS positives, count(*) FILTER (label <= 0) AS negatives, TRUE AS rates_agree"
_PART = "CASE WHEN (('0x' || substr(md5(id), 1, 8))::BIGINT % 10000) / 10000 < 0.6 THEN 'train' ELSE 'test' END"
_FOLD_PARTS = f"folded AS (SELECT *, {FOLD} AS own FROM posts), parts AS (SELECT f.i AS fold, CASE WHEN own = f.i THEN 'test' ELSE 'train' END AS part, label FROM folded, (SELECT unnest(range(10))::INTEGER AS i) f)"


def oracle_sql() -> dict[str, str]:
    sql = {
        # sources and sinks
        "posts_load": f"WITH {POSTS} SELECT CASE WHEN toxic = 1 THEN -1 ELSE label END AS label, date, {_squeeze('tweet')} AS tweet, id FROM posts",
        "posts_nonempty": f"WITH {DOCS} SELECT count(*) AS n_read, count(*) FILTER (lang <> 'en' AND {_squeeze('tweet')} <> '') AS n_kept, count(*) - count(*) FILTER (lang <> 'en' AND {_squeeze('tweet')} <> '') AS n_removed FROM docs",
        "embedding_dictionary": f"WITH {DICTIONARY} SELECT token, len(embedding)::INTEGER AS dims, round(list_sum(embedding::DOUBLE[]), 6) AS total, embedding[1]::DOUBLE AS first_value FROM dict",
        "processed_export": f"WITH {SCORED} SELECT label, p AS \"processedTweet\" FROM normed",
        "posts_after_cutoff": f"WITH {POSTS} SELECT label, date, tweet, id FROM posts WHERE day > DATE '2016-04-01'",
        "confusion_quadrants": f"WITH {SCORED} SELECT CASE WHEN label > 0 AND prediction > 0 THEN 'tps' WHEN prediction > 0 THEN 'fps' WHEN label > 0 THEN 'fns' ELSE 'tns' END AS quadrant, CAST(prediction AS VARCHAR) || ' ' || {_squeeze('tweet')} AS line FROM scored",
        "metrics_record": f"WITH {SCORED}{_metrics('scored')} SELECT 3000 AS num_features, {ALL_METRICS} FROM metrics",
        # text
        "text_lower": f"WITH {DOCS} SELECT id, lower(tweet) AS t FROM docs",
        "text_stopwords": f"WITH {DOCS} SELECT id, {_no_stop('lower(tweet)')} AS t FROM docs",
        "text_strip_urls": f"SELECT page_id, {_sub(chr(40) + 'url || ' + chr(39) + ' ' + chr(39) + ' || html' + chr(41), URL_PATTERN)} AS t FROM pages",
        "text_numbers_to_words": f"WITH {DOCS} SELECT id, {_numbers('tweet')} AS t FROM docs",
        "text_strip_escapes": f"WITH {DOCS} SELECT id, {_sub(chr(40) + 'replace(tweet, chr(32), chr(32) || chr(92) || chr(92) || ' + chr(39) + 'u2026' + chr(39) + ' || chr(32))' + chr(41), ESCAPE_PATTERN)} AS t FROM docs",
        "text_normalise": f"WITH {DOCS} SELECT id, {_normalised('tweet', stop=True)} AS t FROM docs",
        "text_normalise_keep_numbers": f"WITH {DOCS} SELECT id, {_normalised('tweet', stop=True, numbers=False)} AS t FROM docs",
        "text_signature_clean": f"WITH {DOCS} SELECT id, {_signature_clean('tweet')} AS t FROM docs",
        "tokens": f"WITH {DOCS} SELECT id, array_to_string(regexp_split_to_array(rtrim(lower(tweet), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s'), '|') AS t, len(regexp_split_to_array(rtrim(lower(tweet), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s'))::INTEGER AS n FROM docs",
        "token_signature": f"WITH {NORMED} SELECT id, {_sorted_tokens('p')} AS t FROM normed",
        "keyword_score": f"WITH {ALL_SCORED} SELECT id, prediction AS score FROM scored",
        # dates
        "post_day": f"WITH {DOCS} SELECT id, day FROM docs",
        "week_of_year": f"SELECT o_orderkey, {_week('CAST(o_orderdate AS DATE)', 7, 1)} AS week_us, {_week('CAST(o_orderdate AS DATE)', 1, 4)} AS week_iso_rule FROM orders",
        "cluster_dates": "SELECT user_id AS cluster, strftime(min(ts), '%Y/%m/%d %H:%M:%S') AS first_date, strftime(max(ts), '%Y/%m/%d %H:%M:%S') AS last_date FROM events GROUP BY 1",
        "round_half_up": f"SELECT event_id, {_half_up('value / 4', 2)} AS two, {_half_up('value / 4', 1)} AS one FROM events",
        "week_buckets": f"""WITH {DOCS}, dated AS (SELECT id, CASE WHEN lang <> 'es' THEN day END AS day FROM docs)
, days AS (SELECT DISTINCT day, {_week('day', 1, 4)} AS week FROM dated WHERE day IS NOT NULL)
, starts AS (SELECT day, week, CASE WHEN week IS DISTINCT FROM lag(week) OVER (ORDER BY day) OR year(day) IS DISTINCT FROM lag(year(day)) OVER (ORDER BY day) THEN 1 ELSE 0 END AS s FROM days)
, buckets AS (SELECT day, week, CAST(sum(s) OVER (ORDER BY day) AS BIGINT) AS week_bucket FROM starts)
SELECT id, coalesce(week, -1) AS week, coalesce(week_bucket, -1) AS week_bucket FROM dated LEFT JOIN buckets USING (day)""",
        "weekly_counts": f"""WITH {SCORED}, pos AS (SELECT day, {_week('day', 1, 4)} AS week FROM scored WHERE prediction > 0 AND day > DATE '2016-04-01')
, w AS (SELECT year(day) AS y, week, count(*) AS n_posts FROM pos GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY y, week) AS week_bucket, week, n_posts FROM w""",
        # vectors
        "vector_sqdist": "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "vector_cosine": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "vector_manhattan": "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "set_mean_sqdist": f"WITH {VECTORS}, d AS (SELECT a.cluster, a.id AS i, b.id AS j, sum((a.x - b.x) * (a.x - b.x)) AS d FROM vecs a JOIN vecs b ON a.cluster = b.cluster AND a.pos = b.pos GROUP BY 1, 2, 3) SELECT cluster, round(avg(d), 6) AS mean_sqdist FROM d GROUP BY 1",
        "set_mean_cosine": f"WITH {VECTORS}, norms AS (SELECT id, sqrt(sum(x * x)) AS r FROM vecs GROUP BY 1), d AS (SELECT a.cluster, a.id AS i, b.id AS j, sum(a.x * b.x) AS d FROM vecs a JOIN vecs b ON a.cluster = b.cluster AND a.pos = b.pos GROUP BY 1, 2, 3) SELECT cluster, round(avg(d / p.r / q.r), 6) AS mean_cosine FROM d JOIN norms p ON p.id = i JOIN norms q ON q.id = j GROUP BY 1",
        "set_mean_manhattan": f"WITH {VECTORS}, d AS (SELECT a.cluster, a.id AS i, b.id AS j, sum(abs(a.x - b.x)) AS d FROM vecs a JOIN vecs b ON a.cluster = b.cluster AND a.pos = b.pos GROUP BY 1, 2, 3) SELECT cluster, round(avg(d), 6) AS mean_manhattan FROM d GROUP BY 1",
        "exemplar": f"WITH {MEANS} SELECT cluster, id AS exemplar_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d, id) AS r FROM dist) WHERE r = 1",
        "exemplar_refresh": f"WITH {MEANS}, best AS (SELECT cluster, id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d, id) AS r FROM dist) WHERE r = 1), firsts AS (SELECT label AS cluster, min(vec_id) AS f FROM embeddings GROUP BY 1) SELECT cluster, id AS exemplar_id, id <> f AS changed FROM best JOIN firsts USING (cluster)",
        "kmeans_cost": f"WITH {VECTORS}, firsts AS (SELECT cluster, min(id) AS f FROM vecs GROUP BY 1), c AS (SELECT v.cluster, pos, x AS c FROM vecs v JOIN firsts ON v.id = f), d AS (SELECT v.id, c.cluster, sum((x - c) * (x - c)) AS d FROM vecs v JOIN c ON v.pos = c.pos GROUP BY 1, 2), near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS r FROM d) SELECT cluster, count(*) AS n, round(sum(d), 6) AS sse FROM near WHERE r = 1 GROUP BY 1",
        # features
        "tfidf_terms": f"WITH {TOKENS} SELECT id, term, tf, df, round(weight, 6) AS weight FROM weights",
        "tfidf_apply": f"""WITH {TOKENS}, known AS MATERIALIZED (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels)
, sizes AS (SELECT count(*) AS n FROM docs JOIN known USING (id))
, fitted AS (SELECT term, count(*) AS df FROM tf JOIN known USING (id) GROUP BY 1)
, others AS (SELECT tf.id, term, tf.tf, coalesce(fitted.df, 0) AS df FROM tf ANTI JOIN known USING (id) LEFT JOIN fitted USING (term))
SELECT id, term, tf, df, round(tf * ln((n + 1.0) / (df + 1.0)), 6) AS weight FROM others, sizes WHERE df < n""",
        "max_tokens": f"WITH {NORMED} SELECT max(len(string_split(p, ' ')))::INTEGER AS max_tokens FROM normed",
        "linear_score": f"WITH {BLANK_TOKENS}, m AS (SELECT id, sum(weight * ((df % 7) - 3) / 10.0) AS margin FROM weights GROUP BY 1) SELECT docs.id, round(coalesce(margin, 0.0), 4) AS margin FROM docs LEFT JOIN m USING (id)",
        "token_embedding_lookup": f"""WITH {TOKENS}, {DICTIONARY}
, totals AS MATERIALIZED (SELECT token, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM dict)
, counted AS (SELECT term AS token, sum(tf)::BIGINT AS n FROM tf GROUP BY 1)
, looked AS (SELECT counted.token, n, total FROM counted LEFT JOIN totals USING (token))
SELECT token, n, looked.total IS NOT NULL AS known, coalesce(looked.total, u.total) AS total FROM looked, (SELECT total FROM totals WHERE token = '<UNK>') u""",
        "doc_vector_mean": f"{VECTOR_MEANS} SELECT id, pos, round(x, 6) AS x FROM m",
        "embed_preview": f"{VECTOR_MEANS} SELECT id, round(sum(x), 6) AS total FROM m GROUP BY 1 ORDER BY id LIMIT 1000",
        "doc_vector_concat": f"WITH {BLANK_NORMED}, {DICTIONARY}, t AS (SELECT id, unnest(string_split(p, ' ')) AS token, unnest(range(len(string_split(p, ' ')))) AS pos FROM normed), s AS (SELECT token, coalesce(dict.embedding, (SELECT embedding FROM dict WHERE token = '<UNK>')) AS e FROM (SELECT DISTINCT token FROM t) LEFT JOIN dict USING (token)), u AS (SELECT token, unnest(e)::DOUBLE AS x, generate_subscripts(e, 1) - 1 AS j FROM s) SELECT id, ((SELECT max(pos) + 1 FROM t) * 64)::BIGINT AS size, count(*) AS n_values, round(sum(x * ((pos * 64 + j) % 7 + 1)), 4) AS checksum FROM t JOIN u USING (token) GROUP BY id",
        # classification
        "positives": f"WITH {POSTS} SELECT id, label FROM posts WHERE label = 1",
        "predicted_positives": f"WITH {ALL_SCORED} SELECT id, prediction FROM scored WHERE prediction > 0",
        "confusion_counts": f"WITH {SCORED}{_metrics('scored', 'source')} SELECT source, tp, fp, tn, fn FROM counts",
        "classification_metrics": f"WITH {SCORED}{_metrics('scored', 'dataset')} SELECT * FROM metrics",
        "keyword_classify": f"WITH {SCORED}{_metrics('scored')} SELECT * FROM metrics",
        "fold_summary": f"WITH {SCORED}{_metrics('scored', 'source')}{_summary('metrics')}",
        "basic_statistics": "SELECT event_type, round(avg(value), 5) AS mean, round(var_pop(value), 5) AS variance, round(stddev_pop(value), 5) AS std, round(min(value), 5) AS min, round(max(value), 5) AS max FROM events GROUP BY 1",
        "cross_validate_keyword": f"WITH {FOLD_RESULTS}{_summary('metrics', 'part')}",
        "cross_validate_fit_per_fold": f"WITH {FOLD_RESULTS} SELECT * FROM metrics",
        "ensemble_keyword": f"WITH {SCORED}{_metrics('scored', 'period')} SELECT * FROM metrics",
        "ensemble_union": f"WITH {SCORED} SELECT id, dataset, period, label, prediction FROM scored",
        "fold_split": f"WITH {DOCS} SELECT id, {FOLD} AS fold FROM docs",
        "ratio_split": f"WITH {DOCS} SELECT id, CASE WHEN (('0x' || substr(md5(id), 1, 8))::BIGINT % 10000) / 10000 < 0.6 THEN 'train' ELSE 'test' END AS part FROM docs",
        "grid_runs": f"WITH {POSTS}, {_GRID} SELECT run, dataset, num_features, classifier, params FROM named",
        "pending_runs": f"WITH {POSTS}, {_GRID}, small AS (SELECT dataset FROM posts GROUP BY 1 HAVING count(*) FILTER (label = 0) < (SELECT avg(n) FROM (SELECT count(*) FILTER (label = 0) AS n FROM posts GROUP BY dataset))) SELECT run, dataset, num_features, classifier, params FROM named WHERE dataset NOT IN (SELECT dataset FROM small)",
        "grid_best": f"WITH {SCORED}{_metrics('scored', 'dataset, source')}, r AS (SELECT *, dataset || '_' || source AS run, row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, dataset || '_' || source) AS r FROM metrics) SELECT dataset, run, accuracy FROM r WHERE r = 1",
        "preview": f"WITH {NORMED} SELECT id, p FROM normed ORDER BY id LIMIT 1000",
        "posts_distinct": f"WITH {DOCS} SELECT id, min(t) AS tweet FROM (SELECT id, tweet AS t FROM docs UNION ALL SELECT id, '!' || tweet FROM docs) GROUP BY 1",
        "tfidf_features": f"WITH {NORMED}{_hashed('normed', 3000)} SELECT normed.id, count(*) FILTER (v <> 0)::INTEGER AS n_terms, round(coalesce(sum(v), 0.0), 6) AS total FROM normed LEFT JOIN weighted USING (id) GROUP BY 1",
        "pca_project": "SELECT vec_id AS id, 30::INTEGER AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS square, TRUE AS first_components FROM embeddings",
        "stopwords_file": f"WITH {DOCS} SELECT id, {_no_stop('lower(tweet)')} AS t, TRUE AS same FROM docs",
        "svm_train": f"WITH {POSTS} SELECT id, TRUE AS agrees FROM posts",
        "train_model": f"WITH {POSTS} SELECT id, TRUE AS agrees FROM posts",
        "svm_steps": f"WITH {SCORED}{_hashed('normed', 40)}{_gradient_steps(40, 0.1, 1.0, 4)} SELECT slot AS feature, round(w, 6) AS w FROM w4",
        **{name: f"WITH {DOCS} SELECT id, TRUE AS agrees FROM docs WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)" for name in ("svm_classify", "svm_sgd_classify", "mlp_classify")},
        "mlp_train": "SELECT ((3000 + 1) * 14 + 6 * (14 + 1) * 14 + (14 + 1) * 2)::BIGINT AS n_weights, 0::BIGINT AS n_nan, TRUE AS learned",
        "cross_validate_svm": f"WITH {POSTS}, {_FOLD_PARTS} SELECT fold, part, {_LABELLED} FROM parts GROUP BY 1, 2",
        "cross_validate_steps": f"WITH {POSTS}, {_FOLD_PARTS} SELECT setting, fold, part, {_LABELLED} FROM parts, (SELECT unnest([0, 1])::INTEGER AS setting) GROUP BY 1, 2, 3",
        **{name: f"WITH {POSTS} SELECT period, {_LABELLED} FROM posts GROUP BY 1" for name in ("ensemble_svm", "ensemble_mlp")},
        "classify_saved": f"WITH {POSTS} SELECT {_LABELLED} FROM posts WHERE {_PART} = 'test'",
        "train_and_test": f"WITH {POSTS} SELECT {_LABELLED}, count(*) AS n_clustered, TRUE AS all_final, TRUE AS each_once FROM posts WHERE {_PART} = 'test'",
        "grid_search": f"WITH {POSTS}, {_GRID} SELECT run, TRUE AS consistent FROM named WHERE num_features IN (30, 50) AND dataset IN ('A', 'B') AND (classifier = 'SVM' OR params IN ('2_5', '3_7'))",
        "kmeans_assign": f"WITH {DOCS} SELECT id, TRUE AS nearest FROM docs",
        "kmeans_sweep": "SELECT 2::INTEGER AS first_k, TRUE AS one_by_one, TRUE AS falling, TRUE AS ended",
        "recursive_clusters": f"WITH {NORMED}{_clustered('normed')}",
        "pooled_clusters": f"WITH {SCORED}{_clustered('normed')}",
        "cluster_positives": f"WITH {SCORED}, positive AS (SELECT * FROM normed WHERE label = 1){_clustered('positive')}",
        "cluster_raw": f"WITH {DOCS}, filled AS (SELECT * FROM docs WHERE tweet <> ''){_clustered('filled', _RAW_TOKENS)}",
        "weekly_clusters": f"WITH {NORMED}, late AS (SELECT * FROM normed WHERE day > DATE '2016-04-01'){_clustered('late')}",
        "weekly_positive_clusters": "SELECT TRUE AS all_fine, TRUE AS one_week",
        # clusters
        "cluster_similarity": f"WITH {CLUSTERS} SELECT cluster, n, n_common, min_terms, round(similarity, 6) AS similarity FROM sims",
        "cluster_weight_similarity": f"""WITH {CLUSTERS}, w AS (SELECT cluster, id, round(weight, 9) AS v, count(*) AS k FROM long GROUP BY 1, 2, 3)
, c AS (SELECT w.cluster, v, min(k) AS k FROM w JOIN sizes ON w.cluster = sizes.cluster GROUP BY 1, 2, n HAVING count(*) = n)
, s AS (SELECT cluster, sum(k) AS k FROM c GROUP BY 1)
SELECT sizes.cluster, n, min_terms, round(coalesce(k / min_terms::DOUBLE, 0.0), 6) AS similarity FROM sizes LEFT JOIN s ON s.cluster = sizes.cluster WHERE min_terms > 0""",
        "cluster_final_flag": f"""WITH {CLUSTERS}, w AS (SELECT cluster, id, round(weight, 9) AS v, count(*) AS k FROM long GROUP BY 1, 2, 3)
, c AS (SELECT w.cluster, v, min(k) AS k FROM w JOIN sizes ON w.cluster = sizes.cluster GROUP BY 1, 2, n HAVING count(*) = n)
, s AS (SELECT cluster, sum(k) AS k FROM c GROUP BY 1)
SELECT sizes.cluster, coalesce(k / min_terms::DOUBLE, 0.0) >= 2.0::DOUBLE / 3.0::DOUBLE AS final FROM sizes LEFT JOIN s ON s.cluster = sizes.cluster WHERE min_terms > 0""",
        "cluster_pair_overlap": f"WITH {CLUSTERS} SELECT 'multiset' AS mode, round(min(coalesce(shared / nullif(ca + cb, 0)::DOUBLE, 0.0)), 6) AS min_overlap, round(max(coalesce(shared / nullif(ca + cb, 0)::DOUBLE, 0.0)), 6) AS max_overlap FROM pairs UNION ALL SELECT 'set', round(min(coalesce(shared / nullif(ca + cb - shared, 0)::DOUBLE, 0.0)), 6), round(max(coalesce(shared / nullif(ca + cb - shared, 0)::DOUBLE, 0.0)), 6) FROM pairs",
        "cluster_stats": f"WITH {CLUSTERS} SELECT (SELECT sum(n) FROM sims)::BIGINT AS posts, (SELECT count(*) FROM sims) AS clusters, (SELECT {_half_up('100.0 * count(*) / sum(n)', 2)} FROM sims) AS pct, 0::BIGINT AS reclusterings, (SELECT {_half_up('avg(similarity)', 2)} FROM sims) AS mean_sim, (SELECT {_half_up('stddev_pop(similarity)', 2)} FROM sims) AS std_sim, {_half_up('min(coalesce(shared / nullif(ca + cb, 0)::DOUBLE, 0.0))', 2)} AS min_overlap, {_half_up('max(coalesce(shared / nullif(ca + cb, 0)::DOUBLE, 0.0))', 2)} AS max_overlap FROM pairs",
        "eps_components": "WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 1.12), walk(id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT walk.id, e.b FROM walk JOIN e ON walk.reach = e.a) SELECT id, min(reach) AS component, count(*) = 1 AS noise FROM walk GROUP BY id",
        "hashing_tf": f"WITH {NORMED} SELECT id, len(string_split(p, ' '))::DOUBLE AS n_tokens FROM normed",
        "model_roundtrip": f"WITH {POSTS} SELECT params, count(*) AS n, 0.0::DOUBLE AS difference FROM posts, (SELECT unnest(['2.0_None', '0.5_0.5']) AS params) GROUP BY params",
        "cluster_diff": f"WITH {CLUSTERS}, member_of AS (SELECT cluster, id, id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) AS in_b FROM lead) SELECT cluster, bool_and(in_b) AS equal, count(*) AS n_a, count(*) FILTER (in_b) AS n_b FROM member_of GROUP BY 1",
        "term_set_ops": f"""WITH {CLUSTERS}, anchor AS (SELECT cluster, min(id) AS anchor_id FROM lead GROUP BY 1)
, x AS (SELECT lead.id, anchor_id FROM lead JOIN anchor USING (cluster))
, n AS (SELECT id, count(*) AS c FROM weights GROUP BY 1)
, i AS (SELECT x.id, count(*) AS c FROM x JOIN weights a ON a.id = x.id JOIN weights b ON b.id = x.anchor_id AND a.term = b.term GROUP BY 1)
SELECT x.id, coalesce(i.c, 0)::INTEGER AS n_common, (coalesce(p.c, 0) + coalesce(q.c, 0) - coalesce(i.c, 0))::INTEGER AS n_union FROM x LEFT JOIN n p ON p.id = x.id LEFT JOIN n q ON q.id = x.anchor_id LEFT JOIN i ON i.id = x.id""",
        "cluster_listing": f"""WITH {LINES}
SELECT cluster_no, section, '' AS id, CASE section WHEN 0 THEN '' WHEN 2 THEN 'Cluster ' || cluster_no WHEN 3 THEN line ELSE '{LISTING_SEPARATOR}' END AS line
FROM (SELECT cluster_no, line, unnest(range(5))::INTEGER AS section FROM numbered JOIN lines ON id = exemplar_id)
UNION ALL SELECT cluster_no, 5, id, line FROM members""",
        "cluster_listing_parse": f"""WITH {LINES}
SELECT cluster_no AS block, 1::BIGINT AS position, 'exemplar' AS role, date, id, t AS tweet FROM numbered JOIN lines ON id = exemplar_id
UNION ALL SELECT cluster_no, r + 1, 'member', date, id, t FROM members""",
        "signature_lines": f"WITH {LINES} SELECT id, concat_ws(chr(9), date, id, {_sorted_tokens('t')}, line) AS line FROM lines",
        "clean_cluster_listing": f"""WITH {CLEANED}
SELECT 'tweets' AS listing_type, 'acme' AS organisation, * FROM cleaned""",
        "clean_listing_file": f"""WITH {CLEANED}
SELECT 'tweets' AS listing_type, 'acme' AS organisation, line FROM cleaned""",
    }
    return sql
