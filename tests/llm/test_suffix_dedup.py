import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import no_documents, odd_documents

from gullwatch.llm import suffix_dedup


def brute(rows):
    seen, out = set(), {}
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        rest = bytes(c for c, m in zip(raw, gone) if not m)
        spans = sum(1 for i, m in enumerate(gone) if m and (i == 0 or not gone[i - 1]))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def crafted():
    rng = random.Random(2)
    base, rows = "".join(rng.choice("abcdefgh ") for _ in range(600)), []
    for k in range(30):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(600)] = "é"
        rows.append((k, "".join(text[rng.randrange(300) :])))
    return [*rows, (100, "a" * 450), (101, "ab" * 300), (102, None), (103, ""), (104, "x" * 99), (105, "x" * 100), (106, "x" * 101), (107, "x" * 100)]


def found(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}


def test_sorts():
    rng = random.Random(5)
    for _ in range(100):
        strings = [bytes(rng.choice(b"\0ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 12))]
        assert [strings[i] for i in suffix_dedup.blind_trie_order(strings)] == sorted(strings)
        table, sizes = np.zeros((len(strings), 16), np.uint8), np.array([len(s) for s in strings])
        for i, s in enumerate(strings):
            table[i, : len(s)] = list(s)
        group = np.array([rng.randint(0, 2) for _ in strings])
        order = suffix_dedup.deep_shallow_order(group, table, sizes, shallow=8)
        assert [(group[i], strings[i]) for i in order] == sorted(zip(group, strings))


@pytest.mark.parametrize("hot", [20_000, 5])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = crafted()
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    long_ = next(r for r in rows if r.doc_id == 7)
    assert (long_.n_bytes, long_.n_removed, long_.n_spans) == (50_000, 49_999, 1)
    assert suffix_dedup.remove_repeats(no_documents(spark)).count() == 0


def hot_parts(rows):
    """Parts of one task whose rows (id, text) have hot anchors only."""
    texts = pa.array([t for _, t in rows])
    found = [[] for _ in rows]
    data, at = suffix_dedup.utf8(texts)
    for row, h, first, count, lead in zip(*(x.tolist() for x in suffix_dedup.anchors(data, at))):
        found[row].insert(0, {"h": h, "place": suffix_dedup._packed(first, count, lead), "hot": True})
    kind = pa.list_(pa.struct([("h", pa.int64()), ("place", pa.int64()), ("hot", pa.bool_())]))
    names = ["doc_id", "tie", "text", "wanted"]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([0] * len(rows)), texts, pa.array(found, kind)], names=names)
    return pa.Table.from_batches(suffix_dedup._part_batches(iter([batch]))).to_pylist()


def test_a_hot_string_reaches_its_partition_once_a_task(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(250))
    parts = hot_parts([(k, text) for k in range(200)])
    strings = [p["h"] for p in parts if p["bytes"]]
    assert len(strings) == len(set(strings)) == 151
    assert max(sum(p["h"] == h for p in parts) for h in {p["h"] for p in parts}) == 1
    assert sum((p["place"] >> 8) & 255 for p in parts if p["again"]) == 199 * 151
    monkeypatch.setattr(suffix_dedup, "_HOT_SEEN", 151)  # room for one text: still once
    assert len([p for p in hot_parts([(k, text) for k in range(200)]) if p["bytes"]]) == 151


def test_repeated_rows_and_hot_repeats_inside_a_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    rng = random.Random(6)
    part = "".join(rng.choice("abcdefgh ") for _ in range(220))
    rows = [(k, part + f" {k} " + part + "tail") for k in range(20)]
    want = brute(rows)
    got = suffix_dedup.remove_repeats(spark.createDataFrame([*rows, *rows[:3], *rows[:3]], "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 26
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)


def test_parts_are_compared_anchor_by_anchor(monkeypatch):
    """A task holds the parts of a bounded number of anchors, not those of its partition, and finds the same repeats."""
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3_000))
    texts = pa.array([base[rng.randrange(1_500) :] for _ in range(20)])
    data, at = suffix_dedup.utf8(texts)
    row, h, first, counts, lead = suffix_dedup.anchors(data, at)
    order = h.argsort(kind="stable")
    cut = [bytes(data[at[r] + f : at[r] + f + c + 99]) for r, f, c in zip(row, first, counts)]
    batch = pa.table({"doc_id": row, "tie": row * 0, "h": h, "place": suffix_dedup._packed_place(first, counts, lead), "bytes": pa.array(cut, pa.binary()), "again": pa.array([False] * len(row))}).take(order)
    batches = batch.to_batches(max_chunksize=50)
    sizes, whole = [], suffix_dedup.repeats

    def counted(key, *rest):
        sizes.append(len(key))
        return whole(key, *rest)

    monkeypatch.setattr(suffix_dedup, "repeats", counted)
    runs = {tuple(r.values()) for b in suffix_dedup._repeat_batches(iter(batches)) for r in b.to_pylist()}
    assert sizes == [len(row)]
    monkeypatch.setattr(suffix_dedup, "SORTED_PARTS", 100)
    sizes.clear()
    assert {tuple(r.values()) for b in suffix_dedup._repeat_batches(iter(batches)) for r in b.to_pylist()} == runs
    assert len(sizes) > 3 and max(sizes) <= 200 and sum(sizes) == len(row)
