"""DuckDB counterparts of the queries of this folder that SQL can express, written apart from the operators."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TOKEN = r"[^\x20\x09-\x0D]+"


def _words(table: str, key: str, pattern: str, ahead: int) -> str:
    """Rows (key, pos, cnt, lw): each word with those after it, up to ``ahead`` in all."""
    return f"""lists AS (SELECT {key}, regexp_extract_all({_LOWER}, '{pattern}') AS w FROM {table})
, toks AS (SELECT {key}, len(w) AS cnt, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM lists)
, runs AS (SELECT {key}, cnt, pos, [{", ".join(f"lead(word, {k}) OVER o" for k in range(ahead))}] AS lw FROM toks WINDOW o AS (PARTITION BY {key} ORDER BY pos))"""


def _named(sql: str, mark: str) -> str:
    for name in ("lists", "toks", "runs"):
        sql = sql.replace(f"{name} AS (", f"{mark}_{name} AS (").replace(f"FROM {name}", f"FROM {mark}_{name}")
    return sql


DECONTAMINATION = f"""WITH {_named(_words("documents", "doc_id", _WORD, 10), "d")}
, {_named(_words("benchmark", "item_id", _WORD, 10), "b")}
, wins AS (SELECT DISTINCT item_id, least(10, cnt) AS n, array_to_string(lw[1:least(10, cnt)], ' ') AS g FROM b_runs WHERE pos + least(10, cnt) - 1 <= cnt)
, sizes AS (SELECT DISTINCT n FROM wins)
, hits AS (SELECT DISTINCT doc_id, pos, n, item_id FROM (
    SELECT doc_id, pos, sizes.n, array_to_string(lw[1:sizes.n], ' ') AS g FROM d_runs JOIN sizes ON pos + sizes.n - 1 <= cnt) JOIN wins USING (n, g))
, covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY 1)
, items AS (SELECT doc_id, count(*) AS n_items, array_to_string(list_sort(list(CAST(item_id AS VARCHAR))), ',') AS joined
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d_lists LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

# kind, pattern, group and least length of the group, in the order of the kinds
_KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("prefixed_token", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
]


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, a, a + length(m) AS b FROM (
    SELECT doc_id, m, v, list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN whole[1:i - 1]]), 0) AS a FROM (
      SELECT doc_id, gaps, whole, unnest(whole) AS m, unnest(vals) AS v, generate_subscripts(whole, 1) AS i FROM (
        SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {group}) AS vals
        FROM docs WHERE regexp_matches(t, '{pattern}')))) WHERE length(v) >= {least}"""


SECRETS = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
, spans AS ({" UNION ALL ".join(_spans(i, *k) for i, k in enumerate(_KINDS))})
, named AS (SELECT *, kind || ':' || a || ':' || b AS s FROM spans)
SELECT docs.doc_id, count(s) FILTER (rank = 0) AS n_assign, count(s) FILTER (rank = 1) AS n_access, count(s) FILTER (rank = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY a, rank) FILTER (rank <= 2), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY a, rank), '') AS spans
FROM docs LEFT JOIN named ON named.doc_id = docs.doc_id GROUP BY docs.doc_id"""

NEAR_DUPLICATES = f"""WITH RECURSIVE {_words("documents", "doc_id", _TOKEN, 5)}
, shingles AS (SELECT DISTINCT doc_id, array_to_string(lw[1:least(5, cnt)], ' ') AS s FROM runs WHERE pos + least(5, cnt) - 1 <= cnt)
, sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1)
, shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
, links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c))
, walk(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT walk.doc_id, links.b FROM walk JOIN links ON walk.reach = links.a)
, components AS (SELECT doc_id, min(reach) AS component_id FROM walk GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM components LEFT JOIN sizes USING (doc_id)"""

# label, notice, key phrase, base
_NOTICES = [
    ("cc-by", "licensed under cc by", "cc by", True),
    ("gpl", "this work is licensed under the gnu general public license version", "general public license", True),
    ("reserved", "all rights reserved", "all rights reserved", True),
    ("agpl", "under the gnu affero general public license version 3", "affero general public license", False),
    ("apache", "licensed under the apache license version 2 0", "apache license", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", False),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", False),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd", False),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", False),
    ("lgpl", "under the gnu lesser general public license version", "lesser general public license", False),
    ("mit", "released under the mit license", "mit license", False),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge", False),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license", False),
]

LICENSES = f"""WITH notices(id, label, notice, phrase, base) AS (VALUES {", ".join(f"({i}, '{a}', '{b}', '{c}', {d})" for i, (a, b, c, d) in enumerate(_NOTICES))})
, docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents)
, split AS (SELECT id, label, base, string_split(phrase, ' ') AS p, string_split(notice, ' ') AS n,
    len(string_split(split_part(' ' || notice || ' ', ' ' || phrase || ' ', 1), ' ')) - 1 AS lead FROM notices)
, vocabulary AS (SELECT DISTINCT unnest(n) AS word FROM split)
, held AS (SELECT word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(w)) AS word FROM docs) JOIN vocabulary USING (word) GROUP BY 1)
, weights AS (SELECT word, CAST(floor(1000 * ln((2 * (SELECT count(*) FROM documents) + 2) / (2 * coalesce(df, 0) + 1))) AS BIGINT) AS weight FROM vocabulary LEFT JOIN held USING (word))
, toks AS (SELECT doc_id, w, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs)
, places AS (SELECT doc_id, w, id, label, base, lead, n, pos FROM toks JOIN split ON word = p[1] WHERE w[pos:pos + len(p) - 1] = p)
, around AS (SELECT doc_id, id, pos, unnest(n) AS word, generate_subscripts(n, 1) AS k, w, lead FROM places)
, scored AS (SELECT doc_id, id, pos, sum(CASE WHEN pos - lead + k - 1 >= 1 AND w[pos - lead + k - 1] = word THEN weight ELSE 0 END) AS matched, sum(weight) AS total
    FROM around JOIN weights USING (word) GROUP BY 1, 2, 3)
, found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(pos - 1) FILTER (base) AS first_word, max(pos - 1) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(CAST(matched AS DOUBLE) / CAST(total AS DOUBLE)) AS score FROM places JOIN scored USING (doc_id, id, pos) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN found USING (doc_id)"""

SEARCH = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents)
, sizes AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM docs WHERE len(w) > 0)
, terms AS (SELECT item_id, word, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_WORD}')) AS word FROM benchmark) GROUP BY 1, 2)
, tf AS (SELECT r, doc_id, len(w) AS n, word, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS word FROM docs) WHERE word IN (SELECT word FROM terms) GROUP BY ALL)
, weights AS (SELECT word, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT word, count(*) AS df FROM tf GROUP BY 1), sizes)
, scores AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words)))) AS BIGINT) AS score
    FROM terms JOIN tf USING (word) JOIN weights USING (word), sizes GROUP BY 1, 2, 3)
, ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10"""

# crc32 of a decimal text, bit by bit
_CRC32 = """xor(list_reduce([4294967295] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')],
    lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

PREFIX_TRIE = f"""WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos, digest, chars FROM (
    SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars
    FROM conversations WHERE conv_id IS NOT NULL))
, convs AS (SELECT conv_id, n_own, conv_id - conv_id % 100 AS donor, {_CRC32} % 6 AS h FROM (SELECT conv_id, count(*) AS n_own FROM own GROUP BY 1))
, lent AS (SELECT convs.conv_id, own.pos, digest, chars FROM convs JOIN own ON own.conv_id = donor AND own.pos <= h)
, kept AS (SELECT own.conv_id, own.pos - h + coalesce(n, 0) AS pos, digest, chars FROM own JOIN convs USING (conv_id)
    LEFT JOIN (SELECT conv_id, count(*) AS n FROM lent GROUP BY 1) USING (conv_id) WHERE own.pos > h)
, turns AS (SELECT * FROM lent UNION ALL SELECT * FROM kept)
, totals AS (SELECT conv_id, count(pos) AS total FROM convs LEFT JOIN turns USING (conv_id) GROUP BY 1)
, prefixes AS (SELECT conv_id, 0 AS depth, '' AS key, 0 AS chars FROM convs
    UNION ALL SELECT conv_id, pos, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY pos)), chars FROM turns)
, nodes AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends_sha256 FROM prefixes JOIN totals USING (conv_id) GROUP BY 1, 2)
, linked AS (SELECT nodes.*, p.key AS parent_key, up.conv_id AS parent_conv_id FROM nodes LEFT JOIN prefixes p ON p.conv_id = nodes.conv_id AND p.depth = nodes.depth - 1
    LEFT JOIN nodes up ON up.depth = p.depth AND up.key = p.key)
, kids AS (SELECT depth - 1 AS depth, parent_key AS key, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2)
, full_nodes AS (SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN kids USING (depth, key))
, subtrees AS (SELECT p.depth, p.key, count(*) FILTER (u.n_children = 0) AS n_leaves, CAST(sum((u.n_convs - 1) * u.chars) AS BIGINT) AS saved_tokens
    FROM full_nodes u JOIN prefixes p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY 1, 2)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM full_nodes JOIN subtrees USING (depth, key)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_benchmark_decontamination": DECONTAMINATION,
        "op8_secret_scan": SECRETS,
        "op10_minhash_near_duplicates": NEAR_DUPLICATES,
        "op11_prefix_trie": PREFIX_TRIE,
        "op12_ranked_search": SEARCH,
        "op13_license_scan": LICENSES,
    }
