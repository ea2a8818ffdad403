import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import ODD_TEXTS, SCHEMA, no_documents, odd_documents, rows_of
from tokenizers import Tokenizer

from gullwatch.llm import packing, token_files
from gullwatch.llm.tokens import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["The house, it's on fire!\nRun  away \t now", "one two three   four", " lead", "trail ", "á b́", "<|endoftext|> x", "don't  'tis", *ODD_TEXTS]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_ids_of_the_text(path):
    plain, encoder = Tokenizer.from_file(path), Encoder(path)
    for texts in (TEXTS, TEXTS[::-1]):
        ids, bounds = encoder(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_round_trip(spark, tmp_path):
    rows = rows_of(TEXTS * 3)
    folder = str(tmp_path / "ids")
    token_files.write_token_files(spark.createDataFrame(rows, SCHEMA).repartition(3), WORD, 2, folder)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, folder, with_ids=True).collect()}
    plain, at = Tokenizer.from_file(WORD), 0
    for doc, text, *_ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    few = {r.doc_id: r.ids for r in token_files.read_documents(spark, folder, [2, 5]).collect()}
    assert few == {2: got[2].ids, 5: got[5].ids}


def test_packing_covers_every_id_once(spark):
    rows = rows_of(TEXTS * 3)
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(2), BYTE, window=64).collect()
    plain, sequences = Tokenizer.from_file(BYTE), {}
    for doc, text, *_ in rows:
        ids, at = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted((r for r in pieces if r.doc_id == doc), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_cuts_are_the_cheapest():
    rng = np.random.RandomState(3)
    for _ in range(40):
        at = [0, *np.cumsum(rng.randint(1, 6, 12)).tolist()]
        penalty = [0, *rng.randint(0, 9, 12).tolist()]

        def cost(cuts, at=at, penalty=penalty):
            ends = [0, *cuts]
            return sum(10 - (b - a) + penalty[at.index(b)] for a, b in zip(ends, ends[1:]))

        best = {0: 0}
        for i in range(1, len(at)):
            best[at[i]] = penalty[i] + min(best[a] + 10 - (at[i] - a) for a in best if at[i] - a <= 10)
        cuts = packing.choose_cuts(at, penalty, 10)
        assert cuts[-1] == at[-1] and cost(cuts) == best[at[-1]]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert token_files.round_trip(docs, WORD, 2).count() == docs.count()
    assert token_files.round_trip(no_documents(spark), WORD, 2).count() == 0
    ends = [r for r in packing.pack(docs, BYTE).collect() if r.start + r.length == r.doc_tokens]
    assert len(ends) == docs.count()
    assert packing.pack(no_documents(spark), BYTE).count() == 0
