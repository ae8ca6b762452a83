from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from epistola.llm import pieces, token_counts

FILE = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  a  b ", "日本語テキスト\n\n\t😀x▁y", "a" * 500, "\x00x", "é" * 30 + "  " * 20, "<s> </s> <0x0A>", "x" * 70 + " " * 3, "▁", "▁▁a ▁b", "\ufffd",
    "cafe\u0301 " * 3, " 123 4567 ".join("qwertyuiop"), "ThequickbrownfoxjumpsoverthelazydogThequickbrown", "word " * 20_000,
]


@pytest.fixture(scope="module")
def model():
    with open(FILE, "rb") as f:
        return pieces.Model(f.read())


def test_encodes_and_decodes_as_the_library(model, spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for text, ids in zip(texts, library.encode(texts, num_threads=1, add_bos=True, add_eos=True), strict=True):
        made = model.encode(text)
        assert np.frombuffer(made[0], "<u4").tolist() == ids
        assert made[3].decode() == library.decode(ids) == model.decode(ids)


def test_offsets_are_the_library_s(model):
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    for text in ["  a  b ", "the quick brown fox", "▁▁a ▁b", "cafe\u0301 au lait", "x y z"]:
        data = text.encode()
        _, starts, ends, _ = model.encode(text)
        surfaces = [data[a:b].decode() for a, b in zip(starts[1:-1], ends[1:-1], strict=True)]
        assert surfaces == [p.surface for p in library.encode(text, return_type="proto").pieces]


def test_spans_cover_the_text_in_order(model):
    for text in ODD:
        _, starts, ends, _ = model.encode(text)
        assert (np.diff(starts) >= 0).all() and (ends >= starts).all()
        assert ends[-1] == len(text.encode())


def test_bytes_that_are_no_character_decode_as_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    r = random.Random(3)
    for _ in range(300):
        ids = [r.choice([3 + r.randrange(256), 3 + r.randrange(128, 256), r.randrange(300, 31000)]) for _ in range(r.randrange(1, 12))]
        assert model.decode(ids) == library.decode(ids)


def test_compiled_character_map_and_alignment():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    normalizer = pieces.Normalizer(proto.normalizer_spec)
    assert normalizer.map.units
    for text in ["①② ｱｲｳ ﬁ Ⅷ  x　y  z ", "plain text", "  ", "", "Å\u0301 e\u0301"]:
        out, offsets = normalizer(text)
        assert out.decode() == library.normalize(text)
        assert len(offsets) == len(out) + 1 and (np.diff(offsets) >= 0).all()


def test_encode_table_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "a b", None), (None, "a b", "z")], "doc_id long, text string, n_tokens string")
    rows = pieces.encode(docs, FILE).collect()
    assert len(rows) == 4 and pieces.encode(docs.limit(0), FILE).count() == 0
    empty = [r for r in rows if r.text in (None, "")]
    assert {r.ids_sha256 for r in empty} == {hashlib.sha256(struct.pack("<2I", 1, 2)).hexdigest()}
    assert {r.n_tokens for r in empty} == {2} and all(r.decoded == "" for r in empty)


def test_query_and_stage_make_the_spans_of_the_library(spark, sf):
    import corpus_pipeline
    from epistola.llm.queries import QUERIES

    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {}
    for i, text in texts.items():
        at, starts, ends = 0, [0], [0]
        for p in library.encode(text, return_type="proto").pieces:
            starts.append(at)
            at += len(p.surface.encode())
            ends.append(at)
        size = len(text.encode())
        want[i] = hashlib.sha256(struct.pack(f"<{2 * len(starts) + 2}q", *starts, size, *ends, size)).hexdigest()
    plain = [i for i, t in texts.items() if all(p.id > 258 for p in library.encode(t, return_type="proto").pieces)]  # no byte pieces, which share spans
    for frame in (QUERIES["op4_sentencepiece"](spark, sf), corpus_pipeline.token_stage(spark, docs, sf)):
        got = {r.doc_id: r.spans_sha256 for r in frame.collect()}
        assert len(plain) > 10 and {i: got[i] for i in plain} == {i: want[i] for i in plain}


@pytest.fixture(scope="module")
def tokenizer():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return token_counts.Tokenizer(f.read(), public_tokenizers.PATTERN)


def test_edits_keep_the_tree_equal_to_a_fresh_one(tokenizer):
    r = random.Random(5)
    parts = ["", "'", "'s", "re", " ", "  ", "\n", "a", "12", "é", "!!", " foo bar", "\t \n x", "ll", "日本"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(60)))
        tree = token_counts.TokenTree(text, tokenizer, r.choice([1, 2, 64]))
        for _ in range(3):
            at, gone, new = r.randrange(len(text) + 3), r.choice([0, 1, 2, 5, 30]), "".join(r.choice(parts) for _ in range(r.randrange(4)))
            tree.edit(at, gone, new)
            at = min(at, len(text))
            text = text[:at] + new + text[at + gone :]
            assert tree.text() == text and len(tree) == len(text)
            assert tree.tokens == len(tokenizer.bpe.encode_ordinary(text))
            assert [t for p, _ in tree.leaves for t in p] == tokenizer.cut(text)


def test_an_edit_cuts_only_its_surroundings(tokenizer):
    tree = token_counts.TokenTree("some ordinary words here. " * 20_000, tokenizer)
    tree.edit(260_000, 4, "other")
    assert tree.recut < 200


def test_count_table_with_odd_rows(spark):
    from epistola.llm.queries import sample_edits

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six")], "doc_id long, text string")
    made = token_counts.count_edited(docs.withColumn("edits", sample_edits("text")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, texts=True)
    rows = made.collect()
    assert len(rows) == 4 and rows[0].n_tokens == 0 and rows[2].n_tokens == rows[3].n_tokens == 6
    assert rows[0].text_after == "Draft:  also the 2nd note's" or rows[0].n_chars_after == len(rows[0].text_after)
    plain = docs.selectExpr("doc_id", "text", "cast(null as array<struct<position:bigint,deleted:bigint,inserted:string>>) as edits")
    same = token_counts.count_edited(plain, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert all(r.n_tokens == r.n_tokens_after and r.n_recut == 0 for r in same)
    changes = spark.createDataFrame([(3, 2, 0, 3, "1"), (3, 1, 0, 0, "x ")], "doc_id long, seq int, position long, deleted long, inserted string")
    joined = token_counts.with_edits(docs, changes).where("doc_id = 3").first()
    assert [e.inserted for e in joined.edits] == ["x ", "1"]


def test_edits_join_beside_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a", "k", "f", "old"), (2, "b", None, None, None)], "doc_id long, text string, __key string, key string, Edits string")
    changes = spark.createDataFrame([(1, 2, 0, 0, "y"), (1, 1, 0, 1, "x")], "doc_id long, seq int, position long, deleted long, inserted string")
    rows = {r["doc_id"]: r for r in token_counts.with_edits(docs, changes).collect()}
    assert (rows[1]["__key"], rows[1]["key"]) == ("k", "f") and [e["inserted"] for e in rows[1]["edits"]] == ["x", "y"] and rows[2]["edits"] is None
