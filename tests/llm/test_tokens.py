"""Token counts, the codec and token files against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe_codec, token_counts, token_files

ODD = [
    None,
    "",
    "a<|endoftext|> b",
    "   \n\n x",
    "՘֋ x",
    "I'm 12² \x1c\x85 　z 'S 'll",
    "漢字 кот ΣΑΣ É É",
    "ab" * 4000,
    " " * 3000,
    "the same",
    "the same",
]
ROWS = [(k, t, 7, "x") for k, t in enumerate(ODD)] + [(None, "no key", 7, "x"), (3, ODD[3], 7, "x")]
SCHEMA = "doc_id long, text string, n_tokens int, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def library(name):
    t = Tokenizer.from_file(P.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_counts_are_the_librarys(spark, docs):
    encode = library("byte_bpe_50k.json")
    found = token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"))
    want = sorted((str(k), len((t or "").encode()), len(encode(t)), len(encode(t)) > 512) for k, t, *_ in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect()) == want
    assert token_counts.count_tokens(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_counts_of_a_sentencepiece_model(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    found = token_counts.count_tokens(docs, P.path("piece_bpe_32k.model"))
    assert sorted(r.n_tokens for r in found.collect()) == sorted(len(model.encode(t or "")) for _, t, *_ in ROWS)


def test_whole_tokens_are_proven():
    counter = token_counts.WholeTokenCounter(open(P.path("byte_bpe_50k.json")).read())
    assert len(counter.whole) > 40_000
    some = random.Random(1).sample(sorted(counter.whole), 300)
    assert all(len(counter.library.encode(s).ids) == 1 for s in some)


RANKS = bpe_codec.parse_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
CODEC = bpe_codec.Codec(RANKS, P.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=200), max_size=5))
def test_codec_is_tiktoken_and_goes_back(texts):
    ids, ends = CODEC.encode(texts)
    assert [x.tolist() for x in np.split(ids, ends[:-1])][: len(texts)] == [TIKTOKEN.encode_ordinary(t) for t in texts]
    assert CODEC.decode(ids, ends) == [t.encode() for t in texts]


@pytest.mark.parametrize("piece", [b"a" * 65, b"ab" * 500, bytes(range(256)) * 3, "é".encode() * 77])
def test_long_pieces_merge_like_short_ones(piece):
    merger = CODEC.merger
    assert merger._one(piece) == merger._rows([piece], 1 << (len(piece) - 1).bit_length())[0]


def test_codec_operators(docs):
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe_codec.encode(docs, ranks, P.PATTERN)
    rows = bpe_codec.decode(encoded, ranks).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t, *_ in ROWS)
    assert sorted(tuple(r.ids) for r in encoded.collect()) == sorted(tuple(TIKTOKEN.encode_ordinary(t or "")) for _, t, *_ in ROWS)
    both = bpe_codec.encode(docs, ranks, P.PATTERN, decoded="bytes").collect()
    assert sorted(bytes(r.bytes) for r in both) == sorted((t or "").encode() for _, t, *_ in ROWS)
    assert bpe_codec.decode(bpe_codec.encode(docs.limit(0), ranks, P.PATTERN), ranks).count() == 0


def test_rank_file_must_have_all_bytes():
    with pytest.raises(ValueError):
        bpe_codec.RankMerger({b"a": 0})
    assert base64.b64decode(b"YQ==") == b"a"


def test_token_files(spark, docs, tmp_path):
    encode = library("word_bpe_49k.json")
    shards = token_files.write_token_files(docs, P.path("word_bpe_49k.json"), f"file://{tmp_path}/a", tasks=3)
    rows = token_files.read_token_files(spark, shards).collect()
    want = [(k, [*encode(t), 1]) for k, t, *_ in ROWS]
    assert sorted((str(r.doc_id), r.ids) for r in rows) == sorted((str(k), x) for k, x in want)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids)
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    keys = [r.doc_id for r in rows]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    few = token_files.read_token_files(spark, shards, keys={3, 7}).collect()
    assert sorted(r.doc_id for r in few) == [3, 3, 7]
    assert token_files.write_token_files(docs.limit(0), P.path("word_bpe_49k.json"), f"file://{tmp_path}/b") == []


def test_shards_are_closed_when_large(spark, docs, tmp_path):
    name, rows = P.path("word_bpe_49k.json"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, 2)
    try:
        whole = token_files.write_token_files(docs, name, f"file://{tmp_path}/a", tasks=2)
        cut = token_files.write_token_files(docs, name, f"file://{tmp_path}/b", tasks=2, shard_docs=2)
    finally:
        spark.conf.set(rows, before)
    assert len(cut) > len(whole) == 2
    one, other = (sorted(map(tuple, token_files.read_token_files(spark, x).drop("doc_id").collect())) for x in (whole, cut))
    assert one == other


def test_names_that_clash(docs):
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    for wrong in ("ids", "doc_id"):
        with pytest.raises(ValueError):
            bpe_codec.encode(docs, ranks, P.PATTERN, decoded=wrong)
    encoded = bpe_codec.encode(docs, ranks, P.PATTERN, decoded="decoded")
    with pytest.raises(ValueError):
        bpe_codec.decode(encoded, ranks)


LONG = "Wort für Wörter 12 " * 60_000


def test_texts_over_a_million_characters(spark, tmp_path):
    assert len(LONG) > 1_000_000
    rows = [(1, LONG), (2, "short"), (3, LONG + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    encode = library("byte_bpe_50k.json")
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()}
    assert found == {k: len(encode(t)) for k, t in rows}
    ids = {r.doc_id: (r.ids, bytes(r.back)) for r in bpe_codec.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, decoded="back").collect()}
    assert ids == {k: (TIKTOKEN.encode_ordinary(t), t.encode()) for k, t in rows}
    words = library("word_bpe_49k.json")
    shards = token_files.write_token_files(docs, P.path("word_bpe_49k.json"), f"file://{tmp_path}/a")
    assert {r.doc_id: r.ids for r in token_files.read_token_files(spark, shards).collect()} == {k: [*words(t), 1] for k, t in rows}


def test_frames_are_read_alone_and_checked(tmp_path):
    at = tmp_path / "x"
    with open(at, "wb") as out:
        writer = token_files.ShardWriter(out, "u2")
        for k in range(40):
            writer.add(k, np.full(30_000, k))
        assert writer.close() == (40, 1_200_000)
    with open(at, "rb") as source:
        reader = token_files.ShardReader(source)
        opened = []
        frame = reader.frame
        reader.frame = lambda k: opened.append(k) or frame(k)
        assert [(k, set(ids.tolist())) for k, ids in reader.find({39})] == [(39, {39})]
        assert opened == [len(reader.checksums) - 1] and len(reader.checksums) > 1
    data = bytearray(at.read_bytes())
    import zstandard

    assert len(zstandard.ZstdDecompressor().decompress(bytes(data[int(reader.at[0]) : int(reader.at[1])]))) == reader.plain[1]
    reader.checksums[0] ^= 1
    with open(at, "rb") as reader.source, pytest.raises(ValueError):
        reader.frame(0)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("́Σ՘’一")), max_size=60))
def test_words_are_the_librarys(text):
    encoder = token_files._encoder(open(P.path("word_bpe_49k.json")).read())
    assert encoder.encode([text])[0].tolist() == encoder._whole([text])[0]


def test_digests_of_the_query(spark):
    from tessera.llm.queries import QUERIES

    row = QUERIES["op2_bpe_codec"](spark, "/root/testdata/sf0.001").filter("doc_id = 0").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id = 0").first().text
    ids = TIKTOKEN.encode_ordinary(text)
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_shares_of_text():
    mega = 1 << 20
    shares = lambda size, cores: token_files.shares(size, 64 * mega, 4 * mega, cores)
    assert [shares(0, 8), shares(3 * mega, 8), shares(25 * mega, 8), shares(25 * mega, 2), shares(6400 * mega, 8)] == [1, 1, 6, 2, 100]
