import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from seedweave.llm import pieces
from seedweave.llm.queries import piece_model


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(piece_model())


HARD = [
    "", " ", "  ", "a", "▁", " ▁ ", "<s>", "</s> <unk> <0x41>", "\n\n\t", "a" * 3000, "ab" * 1500, " " * 4000, "=-" * 900, "漢" * 300,
    "x" * 5001, "aaab" * 700, "é", "́́", "😀😀", "\x00\x01", "Hello  world\r\n the end ", "�",
]


def test_equals_the_library(model, library):
    rnd = random.Random(4)
    alphabet = [*"aaabeinst  .,!ABC\n\té漢字ñß▁😀0123", "the", "ing", "   "]
    texts = HARD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 70))) for _ in range(1500)]
    assert model.encode(texts) == library.encode(texts, num_threads=1)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(model, library, text):
    ids = model.encode([text])[0]
    assert ids == library.encode(text)
    assert model.decode(ids) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=9))
def test_decoding_any_ids(model, library, ids):
    assert model.decode(ids) == library.decode(ids)


def test_query_digests(documents, library):
    texts = [None, *HARD]
    got = {r["doc_id"]: r for r in pieces.digests(documents(list(enumerate(texts))).repartition(3), piece_model()).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_round_trip_with_extra_columns_and_empty_table(documents):
    docs = documents([(1, "round trip"), (1, "round trip"), (None, None)]).withColumnRenamed("lang", "ids")
    rows = pieces.encoded(docs, piece_model()).collect()
    assert sorted((str(r["doc_id"]), r["decoded"], len(r["ids"])) for r in rows) == [("1", "round trip", 2), ("1", "round trip", 2), ("None", "", 0)]
    assert pieces.encoded(documents([]), piece_model()).count() == 0
