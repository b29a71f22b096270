"""Operator 7 beside the library: raw id lists, a model with a real character map, one without byte fallback."""

import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece as sp
from sentencepiece import sentencepiece_model_pb2 as pb

from lectern.llm import spm


def model(change):
    proto = pb.ModelProto()
    with open(spm.default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    change(proto)
    return proto.SerializeToString()


def pair(path, blob):
    path.write_bytes(blob)
    return sp.SentencePieceProcessor(model_file=str(path)), spm.Encoder(str(path))


def texts():
    r = random.Random(1)
    parts = ["a", " ", "ﬁ", "①", "　", "é", "é", "\n", "ｆ", "😀", "中", "​", "½"]
    fixed = ["ﬁne ①② ｆｕｌｌ  width　 ok ", "  a  b ", "\t\n x", " ", "", "Ünïcode ½ 中文😀 ​ z", "㌔ ﷺ end ", "long " * 3000]
    return fixed + ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(300)]


def squeezed(p):
    q = pb.ModelProto()
    q.ParseFromString(sp.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    p.normalizer_spec.precompiled_charsmap = q.normalizer_spec.precompiled_charsmap
    p.normalizer_spec.remove_extra_whitespaces = True


def mapped(p):
    squeezed(p)
    p.normalizer_spec.remove_extra_whitespaces = False


def unknowing(p):
    for piece in p.pieces:
        if piece.type == pb.ModelProto.SentencePiece.BYTE:
            piece.type = pb.ModelProto.SentencePiece.UNUSED
    p.trainer_spec.byte_fallback = False


@pytest.mark.parametrize("change", [lambda p: None, squeezed, mapped, unknowing])
def test_ids_spans_and_texts_equal_the_library(tmp_path, change):
    lib, own = pair(tmp_path / "m.model", model(change))
    some = texts()
    for text, (n, joined, decoded, *_) in zip(some, own.digests(some), strict=True):
        ids = lib.encode(text)
        told = lib.encode(text, return_type="proto")
        assert own.spans(text) == [(p.id, p.begin, p.end) for p in told.pieces]
        assert (n, joined, decoded) == (len(ids), ",".join(map(str, ids)), lib.decode(ids) if ids else "")


@pytest.mark.parametrize("change", [lambda p: None, squeezed])
def test_decode_equals_the_library_on_any_ids(tmp_path, change):
    lib, own = pair(tmp_path / "m.model", model(change))
    r, mark = random.Random(2), own.pieces.index(spm.SPACE)
    first = min(own.byte)
    cases = [[], [0], [0, 5], [5, 0], [first + 0xE2, first + 0x82], [first + 0xF0, first + 0x9F, first + 0x98, 300], [1, 1000], [1, 2, 0, 1000], [mark], [mark, mark, 500], [1, mark, mark]]
    cases += [[r.choice([0, 1, 2, mark, r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randint(1, 9))] for _ in range(1000)]
    assert [own.decode(c) for c in cases] == [lib.decode(c) if c else "" for c in cases]
    for wrong in ([-1], [1 << 20]):
        with pytest.raises(IndexError):
            own.decode(wrong)


def test_awkward_rows(spark):
    """Null ids and texts, repeated rows, other columns of the results' names, an empty table."""
    rows = [(1, "a b", 7), (1, "a b", 8), (None, "c", 9), (None, None, None), (2, "x" * 300_000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens bigint")
    lib = sp.SentencePieceProcessor(model_file=spm.default_model())
    want = sorted(((i, len(lib.encode(t or "")), hashlib.sha256((t or "").encode()).hexdigest(), lib.encode(t or "")) for i, t, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.decoded_sha256, r.ids) for r in spm.digest(df, ids=True).collect()), key=repr) == want
    assert spm.digest(df.limit(0), ids=True).count() == 0 and spm.encode(df.limit(0)).count() == 0
    back = spm.decode(spm.encode(df)).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((i, t or "") for i, t, _ in rows), key=repr)


def test_a_worker_keeps_no_cuts_and_no_array_for_each_cut(spark, monkeypatch):
    import tracemalloc

    held = []
    docs = spark.createDataFrame([(1, "")], "doc_id bigint, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: held.append(run))
    spm.digest(docs, ids=True)
    words = [f"w{i}" for i in range(2000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(200), "text": [" ".join(words)] * 200})
    model = spm.encoder(spm.default_model())
    want = model.encode(" ".join(words))
    assert model.cache
    tracemalloc.start()
    try:
        (out,) = held[0](iter([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert not model.cache
    assert out.column(out.schema.get_field_index("ids")).to_pylist() == [want] * 200
    assert peak < 32 << 20
