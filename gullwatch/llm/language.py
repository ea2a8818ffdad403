"""Language of words and texts by a linear-chain conditional random field.

A text is a chain of words (runs of letters). A word's emission scores are sums of learned
weights of its features: prefixes and suffixes, byte n-grams and the word itself as a
lexicon entry, all in one hashed table. Transition weights between neighbouring words are
learned with them. Forward-backward gives the probability of each label at each word, so
code-switched text is labelled word by word; a text's language is the label with the
largest expected share of words, and its score is that share.

Training sees a sample of labelled rows: at most ``ROWS_PER_LABEL`` of each of the
``MOST_LABELS`` most frequent labels, those with the smallest hashes of their ids, one text
an id. Of a text over ``WINDOWS`` times ``WINDOW_CHARS`` characters it sees as many windows,
spread evenly from its start to its end. They are cut in the tasks, so the driver holds
bounded text. The pieces are joined to chains that switch language, so that transitions are
learned from switches too; a last chain is filled up from the first words.

Forward-backward works in blocks of ``BLOCK`` words: a block's product of step matrices is
formed for all blocks of a slice at once, the products are chained along each text, and
all blocks are then filled in at once. This is exact and takes few steps for any length.

Defined results: null texts and texts without a letter are ``und`` with score 0; without
labelled rows every text is ``und``; ties go to the first label in order; repeated rows are
labelled one by one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gullwatch.llm.common import mix, pieces, range_hashes, utf8, word_bounds

ROWS_PER_LABEL, MOST_LABELS = 300, 256
WINDOWS, WINDOW_CHARS = 24, 240
#: Hashed feature slots, lengths of affixes, lengths of n-grams.
SLOTS, AFFIXES, GRAMS = 1 << 18, (1, 2, 3, 4), (1, 2, 3)
EPOCHS, BATCH, CHAIN, RATE, DECAY = 4, 256, 96, 0.3, 1e-5
BLOCK = 64
UNKNOWN = "und"

_LETTER_BYTES = np.array([b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_PREDICTED = "doc_id long, lang_pred string, score double"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # SLOTS x labels
    steps: np.ndarray  # labels x labels, log weights of neighbours


def letter_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, and the number of words before each text."""
    data, at = utf8(pa.array([(x or "").lower() for x in texts], pa.string()))
    return data, *word_bounds(data, at, _LETTER_BYTES)


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of the distinct words, and for each word its distinct one."""
    hashes = range_hashes(data, starts, ends)
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = (ends - starts)[first]
    after = np.cumsum(sizes)
    own = data[np.repeat(starts[first] - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)]
    return own, after - sizes, after, of


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, slot) of every feature of every word, kind by kind; words ascend within a kind."""
    number, sizes = np.arange(len(starts)), ends - starts

    def slot(hashes: np.ndarray, kind: int) -> np.ndarray:
        return (mix(hashes + np.uint64(kind * 0x632BE59BD9B4E019 % (1 << 64))) >> np.uint64(64 - 18)).astype(np.int64)

    yield number, slot(range_hashes(data, starts, ends), 1)
    for n in AFFIXES:
        long_ = np.flatnonzero(sizes >= n)
        yield long_, slot(range_hashes(data, starts[long_], starts[long_] + n), 10 + n)
        yield long_, slot(range_hashes(data, ends[long_] - n, ends[long_]), 20 + n)
    for n in GRAMS:
        counts = np.maximum(sizes - n + 1, 0)
        after = np.cumsum(counts)
        at = np.repeat(starts - (after - counts), counts) + np.arange(after[-1] if len(after) else 0)
        yield np.repeat(number, counts), slot(range_hashes(data, at, at + n), 30 + n)


def emissions(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log scores of each word under each label."""
    n, k = len(starts), weights.shape[1]
    total = np.zeros((n, k))
    for word, slot in features(data, starts, ends):
        for label in range(k):
            total[:, label] += np.bincount(word, weights[slot, label], minlength=n)
    return total


def chain_marginals(scores: np.ndarray, first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Label probabilities of every word; ``first`` bounds the words of each text."""
    n, k = scores.shape
    if not n:
        return scores
    sizes = np.diff(first)
    blocks = -(-sizes // BLOCK)
    block_first = np.concatenate([[0], np.cumsum(blocks)])
    total, text = int(block_first[-1]), np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(n) - first[text]
    row, place = block_first[text] + within // BLOCK, within % BLOCK
    potential = np.ones((BLOCK, total, k))
    potential[place, row] = np.exp(scores - scores.max(1, keepdims=True))
    used = np.zeros((BLOCK, total), bool)  # a real word that has a word before it
    used[place, row] = within > 0
    trans = np.exp(steps - steps.max())
    straight = np.broadcast_to(np.eye(k), (total, k, k))
    product = straight.copy()
    for t in range(BLOCK):
        moved = np.where(used[t][:, None, None], product @ trans, product) * potential[t][:, None, :]
        product = moved / moved.sum((1, 2), keepdims=True)
    enter, leave = np.full((total, k), 1.0 / k), np.full((total, k), 1.0 / k)
    longest = int(blocks.max())
    for j in range(1, longest):
        rows = block_first[:-1][blocks > j] + j
        into = np.einsum("nk,nkl->nl", enter[rows - 1], product[rows - 1])
        enter[rows] = into / into.sum(1, keepdims=True)
    for j in range(longest - 1, 0, -1):
        rows = block_first[:-1][blocks > j] + j
        back = np.einsum("nkl,nl->nk", product[rows], leave[rows])
        leave[rows - 1] = back / back.sum(1, keepdims=True)
    forward = np.empty((BLOCK, total, k))
    now = enter
    for t in range(BLOCK):
        now = np.where(used[t][:, None], now @ trans, now) * potential[t]
        now /= now.sum(1, keepdims=True)
        forward[t] = now
    now = leave
    for t in range(BLOCK - 1, -1, -1):
        forward[t] *= now
        now = now * potential[t]
        now = np.where(used[t][:, None], now @ trans.T, now)
        now /= now.sum(1, keepdims=True)
    out = forward[place, row]
    return out / out.sum(1, keepdims=True)


def _chains(words: list[np.ndarray], labels: np.ndarray, rng: np.random.RandomState) -> tuple[np.ndarray, np.ndarray]:
    """Chains of CHAIN words made of pieces of several rows, and the label of each word."""
    parts, marks = [], []
    for own, label in zip(words, labels):
        at = 0
        while at < len(own):
            step = rng.randint(8, 49)
            parts.append(own[at : at + step])
            marks.append(label)
            at += step
    order = rng.permutation(len(parts))
    ids = np.concatenate([parts[i] for i in order])
    gold = np.concatenate([np.full(len(parts[i]), marks[i]) for i in order])
    size = min(CHAIN, len(ids))
    fill = np.arange(-(-len(ids) // size) * size) % len(ids)
    return ids[fill].reshape(-1, size), gold[fill].reshape(-1, size)


def _word_slots(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature slots of all words, word by word and kind by kind, and where those of each word begin."""
    counts = np.zeros(len(starts), np.int64)
    for word, _ in features(data, starts, ends):
        counts += np.bincount(word, minlength=len(starts))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    slots, filled = np.empty(int(bounds[-1]), np.int32), bounds[:-1].copy()
    for word, slot in features(data, starts, ends):
        own = np.bincount(word, minlength=len(starts))
        slots[filled[word] + np.arange(len(word)) - (np.cumsum(own) - own)[word]] = slot
        filled += own
    return bounds, slots


def fit(texts: list[str], langs: list[str]) -> Model:
    """Weights by stochastic gradient steps on the log likelihood of chains."""
    labels = sorted(set(langs))
    data, starts, ends, first = letter_words(texts)
    number = {x: i for i, x in enumerate(labels)}
    k = len(labels)
    model = Model(labels, np.zeros((SLOTS, max(k, 1)), np.float32), np.zeros((max(k, 1), max(k, 1))))
    if k < 2 or not len(starts):
        return model
    own, a, b, of = distinct_words(data, starts, ends)
    rows = [of[x:y] for x, y in zip(first[:-1], first[1:])]
    bounds, slot = _word_slots(own, a, b)
    weights, steps = np.zeros((SLOTS, k)), np.zeros((k, k))
    squares, step_squares = np.full((SLOTS, k), 1e-3), np.full((k, k), 1e-3)
    grad, room = np.empty((SLOTS, k)), np.empty((SLOTS, k))  # the driver holds no more tables than these four
    rng = np.random.RandomState(11)
    for _ in range(EPOCHS):
        chains, gold = _chains(rows, np.array([number[x] for x in langs]), rng)
        for at in range(0, len(chains), BATCH):
            ids, truth = chains[at : at + BATCH], gold[at : at + BATCH]
            used, inverse = np.unique(ids, return_inverse=True)
            inverse = inverse.reshape(ids.shape)
            counts = bounds[used + 1] - bounds[used]
            after = np.cumsum(counts)
            pick = slot[np.repeat(bounds[used] - (after - counts), counts) + np.arange(after[-1])]
            owner = np.repeat(np.arange(len(used)), counts)
            scores = np.stack([np.bincount(owner, weights[pick, c], minlength=len(used)) for c in range(k)], 1)
            flat = inverse.reshape(-1)
            wrong, step_wrong = _gradient(scores[inverse], steps, truth)
            by_word = np.stack([np.bincount(flat, wrong.reshape(-1, k)[:, c], minlength=len(used)) for c in range(k)], 1)
            for c in range(k):
                grad[:, c] = np.bincount(pick, by_word[owner, c], minlength=SLOTS)
            grad /= len(ids)
            grad -= np.multiply(weights, DECAY, out=room)
            squares += np.square(grad, out=room)
            grad *= RATE
            grad /= np.sqrt(squares, out=room)
            weights += grad
            step_grad = step_wrong / len(ids) - DECAY * steps
            step_squares += step_grad**2
            steps += RATE * step_grad / np.sqrt(step_squares)
    model.weights, model.steps = weights.astype(np.float32), steps
    return model


def _gradient(scores: np.ndarray, steps: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed less expected counts of labels at words and of neighbouring labels."""
    n, t, k = scores.shape
    potential, trans = np.exp(scores - scores.max(2, keepdims=True)), np.exp(steps - steps.max())
    forward, backward = np.empty((t, n, k)), np.full((t, n, k), 1.0 / k)
    now = potential[:, 0] / potential[:, 0].sum(1, keepdims=True)
    forward[0] = now
    for i in range(1, t):
        now = (now @ trans) * potential[:, i]
        now /= now.sum(1, keepdims=True)
        forward[i] = now
    for i in range(t - 2, -1, -1):
        now = (backward[i + 1] * potential[:, i + 1]) @ trans.T
        backward[i] = now / now.sum(1, keepdims=True)
    single = forward * backward
    single /= single.sum(2, keepdims=True)
    expected = np.zeros((k, k))
    for i in range(1, t):
        pair = forward[i - 1][:, :, None] * trans[None] * (potential[:, i] * backward[i])[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    seen = np.bincount((truth[:, :-1] * k + truth[:, 1:]).reshape(-1), minlength=k * k).reshape(k, k)
    return np.eye(k)[truth] - single.transpose(1, 0, 2), seen - expected


def train(docs: DataFrame, learn: Column) -> Model:
    """Fit on the bounded sample of rows with a label where ``learn`` holds."""
    docs = docs.where(learn).select("doc_id", "lang", "text")
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    frequent = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LABELS)
    labels = [r.lang for r in frequent.collect()]  # at most MOST_LABELS
    own = docs.where(F.col("lang").isin(labels)).select("doc_id", "lang")
    turn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # the rank limit is applied before the shuffle, so a label sends few rows from each task
    chosen = own.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= ROWS_PER_LABEL).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    texts = docs.join(F.broadcast(chosen), docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["lang"] == F.col("_lang"))).select("doc_id", "lang", "text")
    cut = texts.mapInArrow(_window_batches, "doc_id long, lang string, text string")
    once = cut.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # bounded texts, one an id
    rows = sorted(once.collect(), key=lambda r: (r.lang, r.doc_id is None, r.doc_id or 0))
    return fit([r.text for r in rows], [r.lang for r in rows])


def windows(text: str) -> str:
    """The text, or windows of it without the words that their ends cut."""
    if len(text) <= WINDOWS * WINDOW_CHARS:
        return text
    starts = [i * (len(text) - WINDOW_CHARS) // (WINDOWS - 1) for i in range(WINDOWS)]
    parts = []
    for a in starts:
        own = text[a : a + WINDOW_CHARS]
        words = own.split()
        parts.append(" ".join(words[1:-1]) if len(words) > 2 else own)
    return " ".join(parts)


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([windows(t) for t in batch.column(2).to_pylist()], pa.string())], names=["doc_id", "lang", "text"])


def label_texts(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    data, starts, ends, first = letter_words(texts)
    k = len(model.labels)
    own, a, b, of = distinct_words(data, starts, ends)
    shares = np.zeros((len(texts), max(k, 1)))
    if k and len(starts):
        chance = chain_marginals(emissions(own, a, b, model.weights)[of], first, model.steps)
        sums = np.concatenate([np.zeros((1, k)), np.cumsum(chance, 0)])
        shares = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None]
    best = shares.argmax(1)
    out = []
    for i, text in enumerate(texts):
        known = k > 0 and bool(text) and any(c.isalpha() for c in text)
        out.append((model.labels[best[i]], min(1.0, float(shares[i, best[i]]))) if known else (UNKNOWN, 0.0))
    return out


def word_labels(text: str, model: Model) -> list[tuple[str, str]]:
    """Each word of one text with its most probable label."""
    data, starts, ends, first = letter_words([text])
    own, a, b, of = distinct_words(data, starts, ends)
    chance = chain_marginals(emissions(own, a, b, model.weights)[of], first, model.steps)
    raw = data.tobytes()
    return [(raw[x:y].decode(errors="replace"), model.labels[c]) for x, y, c in zip(starts, ends, chance.argmax(1))]


def _predict_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        said = label_texts(batch.column(batch.schema.get_field_index("text")).to_pylist(), model.value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said])], names=["doc_id", "lang_pred", "score"]
        )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lambda batches: _predict_batches(batches, shared), _PREDICTED)


def _accept_batches(batches: Iterator[pa.RecordBatch], model, least: float) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        said = label_texts(batch.column(batch.schema.get_field_index("text")).to_pylist(), model.value)
        yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in said], pa.bool_()))


def accept(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows whose language is known with at least this score; every column as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda batches: _accept_batches(batches, shared, least), docs.schema)
