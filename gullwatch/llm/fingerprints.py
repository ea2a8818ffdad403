"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: lines, cut again after sentence ends and after ``RUN`` words.
Each paragraph's digest holds a hash and its length; a repeated one is told apart by its
occurrence. A sketch adds every digest to three of its cells (count, sum of digests, sum of
checks). Two sketches of one size subtract cell by cell: what is common cancels, and
peeling the cells that hold one digest recovers the differing digests. Where peeling stops
short, both sketches are built again four times as large. The likeness of two texts is the
share of their length that lies in common paragraphs.

Defined results: null and empty texts have no paragraphs and an all-zero sketch; two such
texts have likeness 1; null ids come first; rows with one id stand in the order of their
text hash; a single row is its own next; extra columns are not read. A text without white
space is one paragraph.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gullwatch.llm.common import CHUNK_BYTES, NOT_SPACE, mix, range_hashes, row_starts, settings, utf8, word_bounds

RUN = 8
#: Cells of the stored sketch, and the factor by which a failed one grows.
CELLS, GROWTH, HASHES = 24, 4, 3

_STOP = np.array([b in b".!?" for b in range(256)])
_LENGTH = np.uint64(0xFFFF)


def paragraph_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of each text (hash above 16 bits of length in bytes), and bounds by text."""
    data, at = utf8(pa.array(texts, pa.string()))
    starts, ends, first = word_bounds(data, at, NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    fresh = np.ones(len(starts), bool)  # whether a word begins a paragraph
    fresh[1:] = _STOP[data[ends[:-1] - 1]] | (newline[starts[1:]] > newline[ends[:-1]]) | (row[1:] != row[:-1])
    place = np.arange(len(starts)) - np.maximum.accumulate(np.where(fresh, np.arange(len(starts)), 0))
    begin = np.flatnonzero(place % RUN == 0)
    within = place % RUN
    codes = mix(range_hashes(data, starts, ends) + within.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    hashes = mix(np.add.reduceat(codes, begin))
    last = np.append(begin[1:], len(starts)) - 1
    size = np.minimum(ends[last] - starts[begin], int(_LENGTH)).astype(np.uint64)
    owner = row[begin]
    order = np.lexsort((hashes, owner))
    same = np.zeros(len(order), bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    number = np.arange(len(order)) - np.maximum.accumulate(np.where(~same, np.arange(len(order)), 0))
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = number
    digests = (mix(hashes + occurrence * np.uint64(0xD1B54A32D192ED03)) & ~_LENGTH) | size
    return digests, row_starts(np.bincount(owner, minlength=len(texts)))


def _cells(digests: np.ndarray, m: int) -> np.ndarray:
    """The HASHES cells of each digest in a sketch of m cells."""
    part = m // HASHES
    return np.stack([mix(digests ^ np.uint64(0xA24BAED4963EE407 * (j + 1) % (1 << 64)) ^ np.uint64(m)) % np.uint64(part) + np.uint64(j * part) for j in range(HASHES)]).astype(np.int64)


def sketches(digests: np.ndarray, owner: np.ndarray, sign: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest sums and check sums of n sketches of m cells; sign -1 subtracts."""
    counts, sums, checks = np.zeros(n * m, np.int64), np.zeros(n * m, np.uint64), np.zeros(n * m, np.uint64)
    factor = sign.astype(np.int64).view(np.uint64)
    signed, check = digests * factor, mix(digests) * factor
    for cell in _cells(digests, m):
        place = owner * m + cell
        np.add.at(counts, place, sign)
        np.add.at(sums, place, signed)
        np.add.at(checks, place, check)
    return counts, sums, checks


def peel(counts: np.ndarray, sums: np.ndarray, checks: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Recovered digests, their sketches, and whether each sketch is empty afterwards. The cells are used up."""
    found, of = [], []
    look = np.arange(n * m)
    while len(look):
        look = look[np.abs(counts[look]) == 1]
        factor = counts[look].view(np.uint64)
        digest = sums[look] * factor
        pure = checks[look] * factor == mix(digest)
        digest, sign, owner = digest[pure], counts[look][pure], look[pure] // m
        _, once = np.unique(np.stack([digest, owner.astype(np.uint64)]), axis=1, return_index=True) if len(digest) else (None, np.zeros(0, np.int64))
        digest, sign, owner = digest[once], sign[once], owner[once]
        found.append(digest)
        of.append(owner)
        gone = (-sign).view(np.uint64)
        touched = []
        for cell in _cells(digest, m):
            place = owner * m + cell
            np.add.at(counts, place, -sign)
            np.add.at(sums, place, digest * gone)
            np.add.at(checks, place, mix(digest) * gone)
            touched.append(place)
        look = np.unique(np.concatenate(touched))
    empty = ((counts == 0) & (sums == 0)).reshape(n, m).all(1)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate(of) if of else np.zeros(0, np.int64), empty


def likeness(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Share of common length of the i-th texts of both sides, from their subtracted sketches."""
    n = len(left[1]) - 1
    sizes = [np.diff(side[1]) for side in (left, right)]
    owner = np.concatenate([np.repeat(np.arange(n), s) for s in sizes])
    digests = np.concatenate([left[0], right[0]])
    sign = np.repeat(np.array([1, -1], np.int64), [len(left[0]), len(right[0])])
    total = np.bincount(owner, (digests & _LENGTH).astype(np.float64), minlength=n)
    result = np.ones(n)
    open_, m = np.arange(n), CELLS
    while len(open_):
        place = np.full(n, -1)
        place[open_] = np.arange(len(open_))
        own = place[owner]
        use = own >= 0
        found, of, done = peel(*sketches(digests[use], own[use], sign[use], len(open_), m), len(open_), m)
        apart = np.bincount(of, (found & _LENGTH).astype(np.float64), minlength=len(open_))
        closed = open_[done]
        result[closed] = 1 - apart[done] / np.maximum(total[closed], 1)
        open_, m = open_[~done], m * GROWTH
        if len(open_) and m > 64 * (CELLS + int(np.bincount(owner, minlength=n)[open_].max())):
            for i in open_:  # two equal digests on one side never peel: count them out
                kinds, inverse = np.unique(digests[owner == i], return_inverse=True)
                rest = np.abs(np.bincount(inverse, sign[owner == i]))
                result[i] = 1 - float(rest @ (kinds & _LENGTH).astype(np.float64)) / max(total[i], 1)
            break
    return result


def serialized(digests: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The stored sketch of each text: counts, sums and check sums of CELLS cells."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    counts, sums, checks = sketches(digests, owner, np.ones(len(digests), np.int64), n, CELLS)
    parts = (counts.astype("<u4").reshape(n, CELLS), sums.astype("<u8").reshape(n, CELLS), (checks & np.uint64(0xFFFFFFFF)).astype("<u4").reshape(n, CELLS))
    return [base64.b64encode(b"".join(p[i].tobytes() for p in parts)).decode() for i in range(n)]


def _compared(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of all texts but the last, which is only the next of the one before it."""
    own = texts[:-1]
    edited = []
    for text, after in zip(own, texts[1:]):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
    digests, bounds = paragraph_digests(texts)
    changed = paragraph_digests(edited)
    n = len(own)
    mine = (digests[: bounds[n]], bounds[: n + 1])
    next_ = (digests[bounds[1] :], bounds[1:] - bounds[1])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:n], pa.int64()),
            pa.array([len(x) for x in own], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array(serialized(*mine), pa.string()),
            pa.array(serialized(*changed), pa.string()),
            pa.array(likeness(mine, changed)),
            pa.array(likeness(mine, next_)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition in order: own rows, then the row after the last."""
    ids, texts, size, closed = [], [], 0, False
    for batch in batches:
        for doc, text, guest in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "guest"))):
            if closed:
                break
            ids.append(doc)
            texts.append(text)
            size += len(text)
            closed = guest
            if len(texts) > 1 and (closed or size > CHUNK_BYTES):
                yield _compared(ids, texts)
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])


def in_id_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, guest: partitions of ascending id ranges, each followed by its next row as a guest.

    The bounds are quantiles of the ids, at most one for each shuffle partition.
    """
    spark = settings(docs.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)] or [0.5]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    (row,) = own.agg(F.percentile_approx("doc_id", shares, 20 * n).alias("q")).collect()
    bounds = sorted(set(row.q or [])) if n > 1 else []
    where = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    # a null id matches no bound and stands first
    placed = own.select("doc_id", "text", F.xxhash64("text").alias("tie"), where.cast("int").alias("range"))
    lead = F.struct(F.col("doc_id").isNotNull().alias("real"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie")
    firsts = [r for r in placed.groupBy("range").agg(F.min(lead).alias("first")).orderBy("range").collect()]  # one row a range
    guests = [(firsts[k - 1].range, *firsts[k].first) for k in range(len(firsts))]
    table = spark.createDataFrame(guests, "target int, real boolean, id long, first_tie long")
    match = (F.col("doc_id").isNotNull() == F.col("real")) & (F.coalesce("doc_id", F.lit(0)) == F.col("id")) & (F.col("tie") == F.col("first_tie"))
    both = placed.join(F.broadcast(table), match, "left")  # at most one row for each range
    dealt = both.select(
        "doc_id",
        "text",
        "tie",
        F.explode(F.filter(F.array(F.struct(F.col("range").alias("to"), F.lit(False).alias("guest")), F.struct(F.col("target").alias("to"), F.lit(True).alias("guest"))), lambda s: s["to"].isNotNull())).alias("at"),
    ).select("doc_id", "text", "tie", "at.to", "at.guest")
    return dealt.repartitionById(n, F.col("to")).sortWithinPartitions("guest", F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text", "guest")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likenesses."""
    return in_id_order(docs).mapInArrow(
        _compare_batches, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
