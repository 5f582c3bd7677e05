from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import token_files
from ledgerline.llm.common import reading, writing
from ledgerline.llm.tokens import Encoder, default_path

ODD = [
    "", " ", "a ", " a", "  a", "a  ", "a\n b", "a\n  b", "x   y", "it's 'tis they'd can't", "\t\t a", "a \n\n b\r\n",
    "<|endoftext|> x", "é ñ 日本 語", "a\x1c b \x1cc", "１２ ३४5 ½", "a  　b", "\x85 x \x85", "\n \n",
]


@pytest.fixture(scope="module")
def tool():
    return Encoder(default_path())


def plain(text):
    known = Tokenizer.from_file(default_path())
    return known.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'st .,\n\té日 1２ \x1c", max_size=40))
def test_encoder_gives_the_library_s_ids(text):
    assert np.frombuffer(TOOL.encode(text), "<u4").tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


TOOL = Encoder(default_path())
REFERENCE = Tokenizer.from_file(default_path())


def test_encoder_on_real_and_odd_texts(tool, small_docs):
    for text in [*ODD, *(r["text"] for r in small_docs.select("text").limit(60).collect())]:
        assert np.frombuffer(tool.encode(text), "<u4").tolist() == REFERENCE.encode(text, add_special_tokens=False).ids
    assert tool.encode(None) == b""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60_000), st.integers(0, 2**32 - 1)), min_size=1, max_size=700))
def test_segment_round_trip(ids):
    ids = np.array(ids, dtype="<u4")
    data = token_files.encode_segment(ids)
    assert token_files.decode_segment(data).tolist() == ids.tolist()
    blocks = -(-len(ids) // 128)
    assert token_files.decode_segment(data, blocks - 1).tolist() == ids[(blocks - 1) * 128 :].tolist()


def test_outliers_do_not_widen_a_block():
    ids = np.arange(128, dtype="<u4") % 16
    wide = ids.copy()
    wide[5] = 2**31
    assert len(token_files.encode_segment(wide)) == len(token_files.encode_segment(ids)) + 5


def test_file_random_access(tmp_path):
    draw = np.random.default_rng(4)
    docs = [draw.integers(0, 50_257, n).astype("<u4") for n in (3, 1, 600_000, 77, 128, 65_536)]
    address = f"file://{tmp_path}/one.pfor"
    writer = token_files.FileWriter(writing(address))
    for i, ids in enumerate(docs):
        writer.add(None if i == 0 else i, ids.tobytes())
    writer.close()
    every = np.concatenate(docs)
    with reading(address) as file:
        reader = token_files.FileReader(file)
        for start, end in ((0, 4), (2, 131), (524_280, 524_300), (199_000, 200_100), (len(every) - 5, len(every)), (7, 7)):
            assert reader.tokens(start, end).tolist() == every[start:end].tolist()
        found = list(reader.documents())
    assert [f[0] for f in found] == [None, 1, 2, 3, 4, 5]
    assert [f[2] for f in found] == [len(d) for d in docs]
    assert [f[3] for f in found] == [zlib.crc32(d.tobytes()) for d in docs]


def test_files_hold_every_document_in_order(spark, tricky, no_docs):
    files = token_files.write_token_files(spark, tricky.repartition(3))
    rows = sorted(tuple(r) for r in ((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(files).collect()))
    assert [r[1] for r in rows] == [None, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10]
    at = 0
    texts = {r["doc_id"]: r["text"] for r in tricky.collect()}
    for start, doc, count, crc in rows:
        ids = np.array([*plain(texts[doc] or ""), 2], "<u4")
        assert (start, count, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += count
    empty = token_files.write_token_files(spark, no_docs)
    assert token_files.read_token_files(empty).count() == 0
