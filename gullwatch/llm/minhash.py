"""Near duplicates by b-bit MinHash over shingles of words.

One pass over the texts gives each document the number and key of its shingle set, the low
``BITS`` bits of ``HASHES`` minima packed into four longs, and band values of ``ROWS`` full
minima, so many that the threshold decides (``band_count``). Documents with equal sets collapse
to their set, which its key stands for up to the end. Inside a
band bucket every member is a candidate with the bucket's smallest member only; a candidate
is kept when its collision-corrected estimate, by bit counts of the packed signatures, does
not lie surely below the threshold, and confirmed on the full shingle sets. Confirmed links
give components; a bucket whose members all lie in one component needs nothing more. The
members of the other buckets are compared across their components, in blocks inside tasks
that emit likely links alone, so that no link is lost and no pair within a component is
ever formed.

Defined results: no words, null or empty text: empty set, linked with nothing; fewer words
than a shingle: the whole sequence is the one shingle; repeated ids are one document: sets of
one id are linked, and all its rows, empty ones too, have its component; rows without an id are linked with nothing and kept; extra
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gullwatch.llm.common import LOWER, NOT_SPACE, gram_hashes, kept_table, long_column, mix, pieces, range_hashes, utf8, word_bounds

SHINGLE = 5
#: Percent of the union that two sets must share to be linked.
PERCENT = 85
HASHES, BITS, ROWS = 128, 2, 4
#: Chance that a pair right at the threshold shares no band: that of 20 bands at 0.85.
MISS = (1 - 0.85**ROWS) ** 20
#: Signatures compared with as many others in one step.
BLOCK = 512

_rng = np.random.RandomState(7)
_MULTIPLIERS = (_rng.randint(0, 1 << 31, HASHES, dtype=np.int64) * 2 + 1).astype(np.uint32)
_ADDENDS = _rng.randint(0, 1 << 32, HASHES, dtype=np.int64).astype(np.uint32)

_SETS = "doc_id long, n_shingles long, set_key long, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def band_count(percent: int) -> int:
    """Bands that a pair of ``percent`` misses with a chance of at most ``MISS``."""
    n = max(1, math.ceil(math.log(MISS) / math.log1p(-((min(percent, 99) / 100) ** ROWS)) - 1e-9))
    if n * ROWS > HASHES:
        raise ValueError(f"{percent} percent needs {n} bands, more than {HASHES} hashes hold")
    return n


def slack(percent: int) -> float:
    """Five standard errors of the estimate at the threshold, rounded up: no link is lost."""
    chance = 2.0**-BITS
    agree = percent / 100 * (1 - chance) + chance
    return math.ceil(500 * math.sqrt(agree * (1 - agree) / HASHES) / (1 - chance)) / 100


def shingle_sets(batch: pa.RecordBatch, shingle: int) -> tuple[pa.Array, list[np.ndarray]]:
    """Ids and the sorted distinct shingle hashes of each row."""
    data, at = utf8(batch.column(batch.schema.get_field_index("text")))
    data = LOWER[data]
    starts, ends, first = word_bounds(data, at, NOT_SPACE)
    words = range_hashes(data, starts, ends)
    grams = gram_hashes(words, shingle)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        elif b > a:
            out.append(gram_hashes(words[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return batch.column(batch.schema.get_field_index("doc_id")), out


def set_key(hashes: np.ndarray) -> int:
    """Hash of a set, whatever the order of its members."""
    return int(mix((mix(hashes).sum(dtype=np.uint64) ^ np.uint64(len(hashes))).reshape(1)).view(np.int64)[0])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each non-empty set."""
    flat = np.concatenate(sets)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = (mix(flat) >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((HASHES, len(sets)), np.uint32)
    buffer = np.empty_like(low)
    for k in range(HASHES):
        np.multiply(low, _MULTIPLIERS[k], out=buffer)
        np.add(buffer, _ADDENDS[k], out=buffer)
        np.bitwise_xor(buffer, buffer >> np.uint32(15), out=buffer)
        minima[k] = np.minimum.reduceat(buffer, begin)
    return np.ascontiguousarray(minima.T)


def packed(minima: np.ndarray) -> np.ndarray:
    """Low BITS bits of each minimum in four longs, bit planes one after the other."""
    planes = np.concatenate([(minima >> np.uint32(b)) & np.uint32(1) for b in range(BITS)], axis=1).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(planes, axis=1)).view(np.int64)


def band_values(minima: np.ndarray, bands: int) -> np.ndarray:
    own = minima[:, : bands * ROWS].astype(np.uint64).reshape(len(minima), bands, ROWS)
    total = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), own.shape[:2]).copy()
    for r in range(ROWS):
        total = mix(total ^ own[:, :, r])
    return total.view(np.int64)


def estimate(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures, corrected for minima whose low bits agree by chance."""
    differing = (left ^ right).view(np.uint64)  # the bits of a signed number would be those of its absolute value
    half = differing.shape[-1] // BITS
    unequal = differing[..., :half].copy()
    for b in range(1, BITS):
        unequal |= differing[..., b * half : (b + 1) * half]
    share = 1 - np.bitwise_count(unequal).sum(-1, dtype=np.int64) / HASHES
    chance = 2.0**-BITS
    return (share - chance) / (1 - chance)


def _set_batches(batches: Iterator[pa.RecordBatch], shingle: int, n_bands: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        ids, sets = shingle_sets(batch, shingle)
        sizes = np.array([len(s) for s in sets], np.int64)
        keys = np.zeros(len(sets), np.int64)
        longs, bands = np.zeros((len(sets), 4), np.int64), np.zeros((len(sets), n_bands), np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            minima = signatures([sets[i] for i in full])
            longs[full], bands[full] = packed(minima), band_values(minima, n_bands)
            keys[full] = [set_key(sets[i]) for i in full]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes), pa.array(keys), *(pa.array(longs[:, k].copy()) for k in range(4)), pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1)), n_bands).cast(pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "set_key", "s0", "s1", "s2", "s3", "bands"],
        )


def document_sets(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    bands = band_count(percent)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: _set_batches(batches, shingle, bands), _SETS)


def _estimated(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda side: np.stack([long_column(batch, f"{side}{k}") for k in range(4)], 1)
        yield batch.select(["a", "b"]).filter(pa.array(estimate(get("l"), get("r")) >= least))


def _likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose packed signatures do not rule them out."""
    sides = [reps.select(F.col("rep").alias(k), *(F.col(f"s{i}").alias(f"{s}{i}") for i in range(4))) for k, s in (("a", "l"), ("b", "r"))]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", *(f"{s}{i}" for s in "lr" for i in range(4))).mapInArrow(lambda x: _estimated(x, least), "a long, b long")


def _hash_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        ids, sets = shingle_sets(batch, shingle)
        columns = [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([np.unique(s.astype(np.uint32)).tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays([ids, *columns], names=["first_id", "id", "hashes", "low"])


def _set_hashes(texts: DataFrame, wanted: DataFrame, again: DataFrame, shingle: int) -> DataFrame:
    """id, hashes and low of every wanted set, from the row of its smallest id; one row a set."""
    schema = "first_id long, id long, hashes binary, low binary"
    mine = wanted.withColumnRenamed("rep", "id")

    def made(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(lambda batches: _hash_batches(batches, shingle), schema)

    if again.isEmpty():
        return made(texts).select("id", "hashes", "low")
    once = made(texts.join(again, "doc_id", "left_anti"))
    repeated = made(texts.join(again, "doc_id", "left_semi")).join(mine, ["id", "first_id"], "left_semi")
    return once.select("id", "hashes", "low").unionAll(repeated.groupBy("id").agg(F.first("hashes").alias("hashes"), F.first("low").alias("low")))


def _confirm_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (batch.column(batch.schema.get_field_index(k)) for k in ("left", "right"))
        keep = []
        for x, y in zip(left, right):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                keep.append(False)
                continue
            shared = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
            keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, hashes: DataFrame, percent: int) -> DataFrame:
    sides = [hashes.select(F.col("id").alias(k), F.col("hashes").alias(n)) for k, n in (("a", "left"), ("b", "right"))]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "left", "right").mapInArrow(lambda x: _confirm_batches(x, percent), "a long, b long")


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over the edges (a, b); nodes without edges are absent.

    Each round points every node to the smallest label among its own, its neighbours' and
    its label's label; labels are written to the shared folder between rounds.
    """
    links = kept_table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = kept_table(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        near = links.join(labels, links["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        new = kept_table(
            labels.join(near, "node").join(up, "component", "left").select("node", F.least("component", "near", "above").alias("component"), F.col("component").alias("was")), "labels"
        )
        if new.where("component <> was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def _block_links(side, rep, component, sizes, band, longs, bands, lows, least: float, percent: int) -> np.ndarray:
    """Links of one block couple between different components, each in the first band that both rows share.

    The estimate rules out most pairs; of the others the sets of low hash halves are
    intersected, which can only overstate what two sets share.
    """
    big, small = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    near = component[big][:, None] != component[small][None, :]
    near &= 100 * np.minimum(sizes[big][:, None], sizes[small][None, :]) >= percent * np.maximum(sizes[big][:, None], sizes[small][None, :])
    i, j = np.nonzero(near)
    i, j = big[i], small[j]
    keep = estimate(longs[i], longs[j]) >= least
    i, j = i[keep], j[keep]
    keep = (bands[i] == bands[j]).argmax(1) == band
    i, j = i[keep], j[keep]
    found = []
    bounds = np.flatnonzero(np.diff(i, prepend=-1))
    for x, y in zip(bounds, np.append(bounds[1:], len(i))):
        one, others = lows[i[x]], [lows[k] for k in j[x:y]]
        flat = np.concatenate(others)
        place = np.minimum(np.searchsorted(one, flat), len(one) - 1)
        lengths = np.array([len(o) for o in others])
        shared = np.add.reduceat((one[place] == flat).astype(np.int64), np.cumsum(lengths) - lengths)
        shared += np.maximum(sizes[i[x]] - len(one), sizes[j[x:y]] - lengths)  # equal halves inside a set
        linked = j[x:y][100 * shared >= percent * (sizes[i[x]] + sizes[j[x:y]] - shared)]
        found.append(np.stack([np.minimum(rep[i[x]], rep[linked]), np.maximum(rep[i[x]], rep[linked])], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _block_batches(batches: Iterator[pa.RecordBatch], least: float, percent: int) -> Iterator[pa.RecordBatch]:
    """Block couples stand one after the other; one has at most 2 * BLOCK rows and some by chance."""
    held: list[pa.RecordBatch] = []

    def solved(table: pa.Table) -> pa.RecordBatch:
        column = lambda n: table.column(n).to_numpy()
        side, rep, component, sizes, band = (column(n) for n in ("side", "rep", "component", "n_shingles", "band"))
        longs = np.stack([column(f"s{k}") for k in range(4)], 1)
        bands = np.stack([column(f"b{k}") for k in range(band_count(percent))], 1)
        lows = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("low")]
        cuts = [0, *_changes(table), len(rep)]
        found = [
            _block_links(side[a:b], rep[a:b], component[a:b], sizes[a:b], band[a], longs[a:b], bands[a:b], lows[a:b], least, percent) for a, b in zip(cuts, cuts[1:]) if b - a > 1
        ]
        both = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        whole = pa.Table.from_batches(held)
        changes = _changes(whole)
        if len(changes):  # all couples but the last are complete
            yield solved(whole.slice(0, changes[-1]))
            held = whole.slice(changes[-1]).combine_chunks().to_batches()
    if held:
        yield solved(pa.Table.from_batches(held))


def _changes(table: pa.Table) -> np.ndarray:
    """Rows at which another block couple begins."""
    keys = [table.column(c).to_numpy() for c in ("bucket", "x", "y")]
    return np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1


def open_pairs(buckets: DataFrame, reps: DataFrame, hashes: DataFrame, components: DataFrame, least: float, percent: int) -> DataFrame:
    """Likely links across components of the buckets that hold several.

    In such a bucket the members of the smallest component are the big side. They meet the
    others only, block by block, and the others meet each other.
    """
    named = buckets.join(components, buckets["rep"] == components["node"], "left").select("bucket", "band", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("main"), F.max("component").alias("last")).where("main < last").select("bucket", "main")
    members = kept_table(named.join(mixed, "bucket").select("bucket", "band", "rep", "component", F.expr("component = main").alias("big")), "members")
    sizes = members.groupBy("bucket").agg(F.expr(f"int(ceil(count_if(big) / {BLOCK}))").alias("bigs"), F.expr(f"int(ceil(count_if(not big) / {BLOCK}))").alias("smalls"))
    rows = members.join(sizes, "bucket").withColumn("own", F.expr("int(pmod(xxhash64(rep), if(big, bigs, smalls)))"))
    # couples (x, y): x is a big block below bigs or a small block from there on, y a small block
    placed = rows.select(
        "bucket",
        "band",
        "rep",
        "component",
        F.explode(
            F.expr(
                """if(big, transform(sequence(0, smalls - 1), y -> named_struct('x', own, 'y', y, 'side', 1)),
                concat(transform(sequence(0, bigs - 1), x -> named_struct('x', x, 'y', own, 'side', 2)),
                       transform(sequence(0, smalls - 1), o -> named_struct('x', bigs + least(own, o), 'y', greatest(own, o),
                           'side', if(o = own, 3, if(own < o, 1, 2))))))"""
            )
        ).alias("at"),
    ).select("bucket", "band", "rep", "component", "at.x", "at.y", "at.side")
    known = reps.select("rep", "n_shingles", "s0", "s1", "s2", "s3", *(F.col("bands")[k].alias(f"b{k}") for k in range(band_count(percent)))).join(hashes.select(F.col("id").alias("rep"), "low"), "rep")
    dealt = placed.join(known, "rep").repartition(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return dealt.mapInArrow(lambda batches: _block_batches(batches, least, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    least = percent / 100 - slack(percent)
    sets = kept_table(document_sets(docs, shingle, percent), "sets")
    full = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = kept_table(
        full.groupBy("set_key", "n_shingles").agg(F.min(F.struct("doc_id", "s0", "s1", "s2", "s3", "bands")).alias("first")).select(F.col("set_key").alias("rep"), "n_shingles", F.col("first.doc_id").alias("first_id"), "first.s0", "first.s1", "first.s2", "first.s3", "first.bands"),
        "reps",
    )
    filled = F.when(F.col("n_shingles") > 0, F.col("set_key"))
    again = sets.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count(filled).alias("n_filled"), F.min(filled).alias("low"), F.max(filled).alias("high")).where("n > 1")
    again = kept_table(again, "again")
    same_id = full.join(again.where("low < high").select("doc_id", "low"), "doc_id").where("set_key <> low").select(F.col("low").alias("a"), F.col("set_key").alias("b")).distinct()
    exploded = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    # written down, so that the join below has plain shuffles on both sides and hot buckets are split
    centres = kept_table(exploded.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre < last").select("bucket", "centre"), "centres")
    buckets = kept_table(exploded.join(centres, "bucket").select("bucket", "band", "rep", "centre"), "buckets")
    stars = buckets.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    wanted = kept_table(reps.select("rep", "first_id").join(buckets.select("rep").distinct(), "rep"), "wanted")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # by a shuffle at every size: the ids of large inputs are no table to broadcast
    texts = own.join(wanted.select(F.col("first_id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    hashes = kept_table(_set_hashes(texts, wanted, again, shingle), "hashes")
    links = kept_table(_confirmed(_likely(stars, reps, least), hashes, percent).union(same_id), "stars")
    components = smallest_reachable(links)
    rest = kept_table(open_pairs(buckets, reps, hashes, components, least, percent), "rest")
    if not rest.isEmpty():
        more = kept_table(_confirmed(rest.join(stars, ["a", "b"], "left_anti"), hashes, percent), "more")
        if not more.isEmpty():
            components = smallest_reachable(links.union(more))
    classes = reps.join(components, reps["rep"] == components["node"], "left").select("rep", "first_id", F.coalesce("component", "rep").alias("component"))
    firsts = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = kept_table(classes.join(firsts, "component").select("rep", "component_id"), "classes")
    joined = sets.withColumn("rep", filled).join(classes, "rep", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    blank = again.where("n_filled > 0 AND n_filled < n").select("doc_id", F.col("low").alias("rep"))
    if not blank.isEmpty():  # rows without words of an id that has words elsewhere
        given = blank.join(classes, "rep").select("doc_id", F.col("component_id").alias("given"))
        joined = joined.join(given, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "given").alias("component_id"))
    joined = joined.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The first document of each component, with every column of ``docs``; null ids stay.

    Of repeated rows with one id the first by text stays, a null text last.
    """
    rows = near_duplicates(docs, shingle, percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(~F.col("kept")).alias("lost"))
    marked = kept_table(rows.where("lost OR n > 1").select(F.col("doc_id").alias("_marked"), "lost"), "marked")
    own = docs["doc_id"].cast("long")
    single = docs.join(marked.select("_marked"), own == marked["_marked"], "left_anti")
    repeated = marked.where("NOT lost").select("_marked")
    if repeated.isEmpty():
        return single
    again = docs.join(repeated, own == repeated["_marked"], "left_semi")
    tie = F.xxhash64(*(F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema))
    first = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(F.col("text").isNull(), F.col("text"), tie))
    # by a key of its own, so that the join's hot ids are split and added up before they meet
    once = again.groupBy(F.struct("doc_id").alias("_id")).agg(first.alias("_first")).select("_first.*")
    return single.union(once)
