import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from helpers import LOWER, SCHEMA, babble, no_documents, odd_documents, rows_of
from pyspark.sql import functions as F

from gullwatch.llm import mixing
from gullwatch.llm.common import crc32_fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


@pytest.mark.parametrize(("known", "symbols"), [(mixing.KNOWN, mixing.SYMBOLS), (60, 30)])
def test_base_score_and_model(spark, monkeypatch, known, symbols):
    monkeypatch.setattr(mixing, "KNOWN", known)
    monkeypatch.setattr(mixing, "SYMBOLS", symbols)
    rng = random.Random(5)
    vocabulary = [w for i in range(150) for w in [f"W{i}é"] * (150 // (i + 1) + 1)]
    texts = [babble(rng, rng.randint(0, 60), vocabulary) for _ in range(120)] + [None, "never seen words"]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4)
    model, counts = mixing.train(docs, crc32_fold(F.col("doc_id"), 5) != 1)
    got = {r.doc_id: r for r in mixing.score(docs, model, counts).collect()}
    seen = Counter(t for i, x in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(x))
    n, v = sum(seen.values()), len(seen)
    for i, text in enumerate(texts):
        own = tokens(text)
        base = sum(math.log10((seen[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(seen[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and -1e6 < r.score < 0
    held = [i for i, x in enumerate(texts) if x and zlib.crc32(str(i).encode()) % 5 == 1]
    assert sum(got[i].bits_per_token * got[i].n_tokens for i in held) < 9 * sum(got[i].n_tokens for i in held)


def test_next_symbols_share_one(spark):
    """Over all symbols that may follow a given start, probabilities add up to 1."""
    rng = random.Random(1)
    docs = spark.createDataFrame(rows_of([babble(rng, 20, ["aa", "bb", "cc"]) for _ in range(20)]), SCHEMA)
    model, _ = mixing.train(docs, F.lit(True))
    total = 0.0
    for symbol in range(len(model.code.size)):
        chain = np.array([symbol], np.int32)
        parts = mixing.decisions(chain, np.array([0, 1]), model.code)
        total += math.exp(mixing.log_probabilities(*parts, model)[0])
    assert total == pytest.approx(1, abs=1e-3)


def test_huffman_is_a_prefix_code():
    code = mixing.huffman(np.array([5, 1, 1, 9, 3]))
    assert sum(2.0**-n for n in code.size) == 1


def test_lookup():
    rng = np.random.RandomState(2)
    hashes = np.unique(rng.randint(0, 1 << 62, 5_000).astype(np.uint64))
    find = mixing.Lookup(hashes)
    assert (find(hashes) == np.arange(len(hashes))).all() and (find(hashes + np.uint64(1)) >= 0).sum() == np.isin(hashes + np.uint64(1), hashes).sum()


def test_weights_are_refined_inside_a_long_text(spark):
    docs = spark.createDataFrame(rows_of(["aa bb " * 30] * 20), SCHEMA)
    model, counts = mixing.train(docs, F.lit(True))
    rows = mixing.score(spark.createDataFrame(rows_of(["bb bb cc " * 4_000, "bb bb cc " * 40]), SCHEMA), model, counts)
    long_, short = (r.bits_per_token for r in rows.orderBy("doc_id").collect())
    assert long_ < short


def test_odd_rows(spark):
    docs = odd_documents(spark)
    for learn in (F.lit(True), F.lit(False)):
        model, counts = mixing.train(docs, learn)
        rows = mixing.score(docs, model, counts).collect()
        assert len(rows) == docs.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    model, counts = mixing.train(no_documents(spark), F.lit(True))
    assert mixing.score(no_documents(spark), model, counts).count() == 0


def plain_logs(node, bit, first, second, before, model):
    """Log probability of each decision, one by one."""
    out = []
    for a, b in zip(before[:-1], before[1:]):
        slopes, block = np.zeros(3), []
        for k, i in enumerate(range(a, b)):
            if k and k % mixing.ADAPT == 0:
                slopes += sum(block)
                block = []
            x1, x2 = model.table[first[i]], model.table[second[i]]
            gate = (int(np.float32(x1).view(np.int32)) & 3) * 4 + (int(np.float32(x2).view(np.int32)) & 3)
            x = np.array([model.code.odds[node[i]], x1, x2], float)
            dot = float(model.weights[gate].astype(float) @ x)
            block.append((bit[i] - 1 / (1 + math.exp(-max(-12, min(12, dot))))) * x)
            slower = math.sqrt(max((k // mixing.ADAPT * mixing.ADAPT) / mixing.ADAPT_FULL, 1))
            dot += float(np.clip(mixing.ADAPT_RATE * slopes / slower, -mixing.ADAPT_MOST, mixing.ADAPT_MOST) @ x)
            out.append(-math.log1p(math.exp(-max(-12, min(12, dot if bit[i] else -dot)))))
    return out


def test_score_equals_brute_force(spark):
    rng = random.Random(13)
    texts = [babble(rng, rng.choice((0, 3, 60, 150)), [f"w{i}" for i in range(90)]) for _ in range(40)]
    long = [t for t in texts if len(t.split()) >= 60]
    texts += [long[0], long[1], long[1] + " w1 more", "a " + long[2], long[3], long[3], None, "zzz"] + [babble(rng, 120, ["x", "y", "z"]) for _ in range(6)]
    learn = crc32_fold(F.col("doc_id"), 5) != 1
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    model, counts = mixing.train(docs, learn)
    trained = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    parts = []
    for text in texts:
        (hashes, _, first, word_at), decided = mixing._row_decisions(pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["text"]), model)
        logs = plain_logs(*decided, model)
        begin, pair, past = mixing.chunks(hashes, first)
        edges = [*(int(word_at[b]) for b in begin), len(logs)] if len(begin) else [0, len(logs)]
        parts.append((sum(logs[: edges[0]]), [(int(p), int(q), sum(logs[a:b])) for p, q, a, b in zip(pair, past, edges, edges[1:])] if len(begin) else [], sum(logs)))
    follow, before = Counter(), Counter()
    for (_, own, _), mine in zip(parts, trained):
        for pair, past, _ in own:
            if mine and past:
                follow[pair] += 1
                before[past] += 1
    gate = (sum(c for c in follow.values() if c > 1) + 0.5) / (sum(follow.values()) + 1)
    assert model.chunk_gate == pytest.approx(gate) and any(c > 1 for c in follow.values())
    got = {r.doc_id: r.score for r in mixing.score(docs, model, counts, learn).collect()}
    for i, ((lead, own, whole), mine) in enumerate(zip(parts, trained)):
        want = lead if own else whole
        for pair, past, bits in own:
            c, n = follow[pair] - mine, before[past] - mine
            share = gate * c / n if past and c > 0 else 0.0
            want += bits if not past else math.log(share + (1 - gate) * math.exp(bits))
        assert got[i] == pytest.approx(want / math.log(10), rel=1e-4, abs=1e-4)


def test_chunks_do_not_depend_on_where_a_text_lies():
    rng = np.random.RandomState(4)
    rows = [rng.randint(1, 1 << 62, n).astype(np.uint64) for n in (0, 5, 200, 1, 90)]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    begin, pair, past = mixing.chunks(np.concatenate(rows), first)
    for i, r in enumerate(rows):
        own = mixing.chunks(r, np.array([0, len(r)]))
        here = (begin >= first[i]) & (begin < first[i + 1])
        assert (begin[here] - first[i] == own[0]).all() and (pair[here] == own[1]).all() and (past[here] == own[2]).all()
        assert not len(r) or (past[here][0] == 0 and pair[here][0] == 0)


def test_texts_that_occur_twice_score_apart(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(200)]
    once, twice = ([babble(rng, 120, vocabulary) for _ in range(40)] for _ in range(2))
    docs = spark.createDataFrame(rows_of([*once, *twice, *twice]), SCHEMA)
    model, counts = mixing.train(docs, F.lit(True))
    bits = [r.bits_per_byte for r in mixing.score(docs, model, counts, F.lit(True)).orderBy("doc_id").collect()]
    assert max(bits[40:]) < min(bits[:40])


def test_weights_are_learned_in_the_pass_over_all_rows(spark):
    rng = random.Random(9)
    texts = [babble(rng, 15, ["aa", "bb", "cc", "dd"]) for _ in range(700)] + [babble(rng, 1_600, ["aa", "bb"]) + " " + "ee ff gg " * 1_500]
    model, _ = mixing.train(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(5), F.lit(True))
    assert np.isfinite(model.weights).all()
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    node, bit, first, second, before = mixing._row_decisions(batch, model)[1]
    start = mixing.Learner()
    plain = mixing.Model(model.hashes, model.counts, model.symbols, model.tokens, model.kinds, model.code, model.table, start.weights.astype(np.float32))
    learned, given = (mixing.decision_logs(node, bit, first, second, before, m).sum() for m in (model, plain))
    assert learned > given


def test_learner_finds_the_weights_of_a_plain_fit():
    rng = np.random.RandomState(7)
    x = rng.randn(3, 60_000).astype(np.float32)
    bit = (rng.rand(60_000) < 1 / (1 + np.exp(-np.array([0.2, 0.7, -0.3]) @ x))).astype(np.uint8)
    parts = [mixing.Learner() for _ in range(2)]
    for i in range(0, 60_000, 2_000):
        parts[i // 2_000 % 2].learn(x[:, i : i + 2_000], np.full(2_000, 5), bit[i : i + 2_000])
    weights = mixing.averaged(sum(p.sums() for p in parts))
    assert np.allclose(weights[5], [0.2, 0.7, -0.3], atol=0.05) and np.allclose(weights[6], [0.5, 0.3, 0.3])


def test_short_texts_are_refined_and_have_bits_per_byte(spark):
    docs = spark.createDataFrame(rows_of(["aa bb " * 30] * 20), SCHEMA)
    model, counts = mixing.train(docs, F.lit(True))
    texts = ["bb bb cc " * 2, "bb bb cc " * 40, "é", "", None]
    rows = mixing.score(spark.createDataFrame(rows_of(texts), SCHEMA), model, counts).orderBy("doc_id").collect()
    assert rows[1].bits_per_token < rows[0].bits_per_token
    for r, text in zip(rows, texts):
        size = len((text or "").encode())
        assert r.bits_per_byte is None if size == 0 else r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / size)
    parts = mixing._row_decisions(pa.RecordBatch.from_arrays([pa.array([texts[1]])], names=["text"]), model)[1]
    assert mixing.ADAPT < len(parts[0]) < 2_048
    whole = mixing.log_probabilities(*parts, model)[0]
    cuts = range(0, len(parts[0]), mixing.ADAPT)  # each block a text of its own: fixed weights
    fixed = sum(mixing.log_probabilities(*(x[a : a + mixing.ADAPT] for x in parts[:4]), np.array([0, min(mixing.ADAPT, len(parts[0]) - a)]), model)[0] for a in cuts)
    assert whole > fixed


def test_weights_are_learned_from_every_decision(spark, monkeypatch):
    rng = random.Random(4)
    texts = [babble(rng, 300, ["alpha", "beta", "gamma", "delta", "rare"]) for _ in range(20)]
    model, _ = mixing.train(spark.createDataFrame(rows_of(texts), SCHEMA), F.lit(True))
    learned = []

    class Recorder(mixing.Learner):
        def learn(self, inputs, gate, bit):
            learned.append(len(bit))
            super().learn(inputs, gate, bit)

    monkeypatch.setattr(mixing, "Learner", Recorder)
    monkeypatch.setattr(mixing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    _, (node, *_) = mixing._row_decisions(batch, model)
    list(mixing._table_batches(iter([batch]), SimpleNamespace(value=model)))
    assert sum(learned) == len(node)
