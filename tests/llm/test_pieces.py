"""SentencePiece encoding against the library itself: ids, decoded texts, spans, compiled character maps."""

import random
import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from salescope.llm import pieces
from salescope.llm.queries import tokenizer_file
from tests.llm.data import docs, empty, texts

PATH = tokenizer_file("piece_bpe_32k.model")
OWN = pieces.model(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MIX = "aábc  \n\t▁你<0x0A></s>\u0000\U0001f600zthe in erﬁ①Ａｶﾞ​　"


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def handmade(squeeze, dummy):
    """A small byte-pair model over a compiled character map with compatibility rules."""
    spec = dict(pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec()))
    vocabulary = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    vocabulary += [(p, -float(i), 1) for i, p in enumerate(["th", "▁th", "the", "▁the", "fi", "in", "▁▁", "er", "ガ1", *"▁thefinrabcガ1"])]
    raw = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in vocabulary)
    raw += field(2, field(3, 2) + field(35, 1))
    return raw + field(3, field(1, b"own") + field(2, spec[2]) + field(3, int(dummy)) + field(4, int(squeeze)) + field(5, 1))


def compare(own, library, ts):
    ids, begins, ends, before = own.encode(ts)
    for i, t in enumerate(ts):
        mine = list(zip(*(x[before[i]:before[i + 1]].tolist() for x in (ids, begins, ends)), strict=True))
        assert [m[0] for m in mine] == library.encode(t), t
        yield t, mine


def test_ids_equal_the_library(spark):
    rng = random.Random(1)
    ts = ["".join(rng.choice(MIX) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    ts += ["", " ", "  ", "a" * 3000, "▁", "\n", "x" + " " * 40, *[t or "" for t in texts()]]
    for t, mine in compare(OWN, LIBRARY, ts):
        assert "".join(t.encode()[b:e].decode() for _, b, e in mine) == t


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(MIX), max_size=30))
def test_spans_equal_the_library(t):
    spans = list(compare(OWN, LIBRARY, [t]))[0][1]
    assert spans == [(p.id, p.begin, p.end) for p in LIBRARY.encode(t, return_type="proto").pieces]


@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("dummy", [True, False])
def test_a_compiled_map_is_applied_by_longest_prefix(squeeze, dummy):
    raw = handmade(squeeze, dummy)
    own, library = pieces.PieceModel(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    rng = random.Random(7)
    ts = ["".join(rng.choice(MIX + "ﬁ①Ａｶﾞ か゛¨") for _ in range(rng.randint(0, 25))) for _ in range(600)]
    for t, mine in compare(own, library, ["", "   ", " ﬁ  the ｶﾞ① ", *ts]):
        want = [(p.id, p.begin, p.end) for p in library.encode(t, return_type="proto").pieces]
        assert mine == want, t


def test_documents_with_awkward_rows(spark):
    d = docs(spark, extra=(None, "copy", "copy"))
    rows = pieces.encode_pieces(d, PATH).collect()
    given_texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    assert len(rows) == len(given_texts)
    for r in rows:
        t = given_texts[r["doc_id"]]
        assert list(r["ids"]) == [*LIBRARY.encode(t), OWN.end] and r["decoded"] == LIBRARY.decode(list(r["ids"]))
        assert r["begins"][-1] == r["ends"][-1] == len(t.encode())
    assert pieces.encode_pieces(empty(spark), PATH).count() == 0
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, len(r["ids"])) for r in pieces.encode_pieces(same, PATH, end=False, decode=False).collect())
    assert out == [(0, 2), (0, 2), (3, 0)]
    coded = pieces.encode_pieces(same, PATH)
    assert {r["decoded"] for r in pieces.decode_pieces(coded.select("doc_id", "ids"), PATH).collect()} == {"a b", ""}


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="byte-pair"):
        pieces.PieceModel(field(2, field(3, 1)))
