import math
import re

from helpers import LOWER, SCHEMA, no_documents, odd_documents, rows_of

from gullwatch.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Licensed under CC BY-NC 4.0. All rights reserved! ALL RIGHTS, reserved",
    "This work is licensed under the GNU General Public License, version 3; cc\x00by cc by cc by",
    "general public licenses, all rights  are reserved; ccby",
    "Released under the MIT License. Licensed under the Apache License, Version 2.0",
    "reserved rights all rights reserved cc",
    "under the mit license " * 3,
    "CC by the way, Kelvin K éCC BY",
    None,
    "",
    "all",
]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts):
    own = [words(t) for t in texts]
    vocabulary = {w for t in licenses.TEMPLATES for w in t.notice.split()}
    df = {w: sum(w in o for o in own) for w in vocabulary}
    weight = {w: math.floor(1000 * math.log((2 * len(own) + 2) / (2 * df[w] + 1))) for w in vocabulary}
    out = []
    for o in own:
        places = []
        for t in licenses.TEMPLATES:
            notice, key = t.notice.split(), t.phrase.split()
            lead = [notice[i : i + len(key)] for i in range(len(notice))].index(key)
            for s in range(len(o)):
                if o[s : s + len(key)] == key:
                    met = sum(weight[w] for i, w in enumerate(notice) if 0 <= s - lead + i < len(o) and o[s - lead + i] == w)
                    places.append((t.base, s, t.label, met / sum(weight[w] for w in notice)))
        base = [p[1] for p in places if p[0]]
        out.append(
            (len(o), len(base), min(base, default=None), max(base, default=None))
            + (",".join(sorted({p[2] for p in places if p[0]})), ",".join(sorted({p[2] for p in places})), max((p[3] for p in places), default=0.0))
        )
    return out


def test_equals_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(spark.createDataFrame(rows_of(TEXTS), SCHEMA).repartition(3)).collect()}
    assert [got[i] for i in range(len(TEXTS))] == brute(TEXTS)
    assert got[0][1:4] == (3, 2, 10) and got[0][5] == "cc-by,cc-by-nc,reserved"


def test_one_rare_word_finds_the_same_places(spark):
    docs = spark.createDataFrame(rows_of(TEXTS), SCHEMA)
    one, two = (sorted((r.doc_id, [tuple(x) for x in r.found]) for r in licenses.find(docs, rare=n).collect()) for n in (1, 2))
    assert one == two


def test_odd_rows(spark):
    docs = odd_documents(spark).selectExpr("*", "'x' AS w", "'x' AS hits", "'x' AS found", "'x' AS word")
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count() and all(tuple(r)[2:] == (0, None, None, "", "", 0.0) for r in rows)
    assert {r.doc_id: r.n_words for r in rows if r.doc_id in (0, 1, 4, 8)} == {0: 0, 1: 0, 4: 2, 8: 30_000}
    assert licenses.scan(no_documents(spark)).count() == 0


def test_long_repeats_stay_linear(spark):
    (r,) = licenses.scan(spark.createDataFrame(rows_of(["cc by " * 100_000]), SCHEMA)).collect()
    assert (r.n_base, r.first_word, r.last_word) == (100_000, 0, 199_998)


def test_no_python_on_the_main_path(spark):
    plan = licenses.scan(spark.createDataFrame(rows_of(TEXTS), SCHEMA))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_expressions_do_not_grow_with_the_templates(spark):
    docs = spark.createDataFrame(rows_of(TEXTS), SCHEMA)
    few, many = (licenses.find(docs, t)._jdf.queryExecution().analyzed().toString().count("lambdafunction(") for t in (licenses.BASE, licenses.TEMPLATES))
    assert few == many
