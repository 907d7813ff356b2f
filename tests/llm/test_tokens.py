import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from rosterwise.llm import bpe, token_files
from rosterwise.llm.queries import RANKS, TOKENIZER

PATH, JSON = public_tokenizers.path(RANKS), public_tokenizers.path(TOKENIZER)
PARTS = [
    "'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "\r", "a", "Z", "é", "ß", "1", "²", "!", "#", "漢", "😀", "\0",
    "\x1c", "\x85", "'S", "́", "Ⅷ", "​", "　", "﻿", "<|endoftext|>", "thnan", "edble",
]


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as lines:
        return bpe.read_ranks(lines)


@pytest.fixture(scope="module")
def texts():
    random.seed(2)
    many = ["".join(random.choices(PARTS, k=random.randint(0, 30))) for _ in range(5000)]
    return [*many, "", "a" * 20000, "ab" * 9000, " " * 4000 + "x", "'" * 900, "\n\n  \n x", ""]


def test_ids_are_those_of_the_libraries(ranks, texts):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, decoder = bpe.Encoder(ranks), bpe.Decoder(ranks)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert decoder.decode(ids) == text.encode()
    tokenizer = Tokenizer.from_file(JSON)
    for text, ids in zip(texts, token_files.LibraryEncoder(JSON).encode(texts), strict=True):
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, token_files.END_ID]


def test_a_lower_rank_that_a_merge_makes_comes_first():
    pieces = [b"a", b"b", b"c", b"d", b"abc", b"ab", b"cd"]
    ranks = {p: i for i, p in enumerate(pieces)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for word in ("abcd", "ababcabcd", "cdabcab", "abab", "abcabcdab"):
        ids = np.frombuffer(bpe.Encoder(ranks).merged(word.encode()), "<u4").tolist()
        assert ids == library.encode_ordinary(word)


def test_round_trip_of_rows(odd_docs, no_docs, ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def row(r):
        ids = library.encode_ordinary(r.text or "")
        sha = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), (r.text or "").encode())]
        return (r.doc_id, len(ids), *sha)

    got = sorted(map(tuple, bpe.round_trip(odd_docs, PATH).collect()), key=str)
    assert got == sorted(map(row, odd_docs.collect()), key=str)
    assert bpe.encode_documents(no_docs, PATH).count() == 0


def test_files_read_back(spark, odd_docs, no_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 500)  # several blocks per shard
    tokenizer = Tokenizer.from_file(JSON)
    token_files.write_token_files(odd_docs, JSON, str(tmp_path / "files"))
    got = sorted(map(tuple, token_files.token_index(spark, str(tmp_path / "files")).collect()), key=lambda r: r[1])
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, want = 0, []
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    some = rows[20]
    assert token_files.read_ids(spark, str(tmp_path / "files"), some.doc_id) == [*tokenizer.encode(some.text or "", add_special_tokens=False).ids, 0]
    with pytest.raises(KeyError):
        token_files.read_ids(spark, str(tmp_path / "files"), 10**9)
    token_files.write_token_files(no_docs, JSON, str(tmp_path / "none"))
    assert token_files.token_index(spark, str(tmp_path / "none")).count() == 0


def test_added_tokens_and_rows_of_one_id(spark, tmp_path):
    encoder, tokenizer = token_files.LibraryEncoder(JSON), Tokenizer.from_file(JSON)
    assert next(encoder.encode(["a <|endoftext|> b"])).tolist() == [*tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids, 0]
    rows = [(7, f"{i * 7919 % 3000:04d} " + "x" * (i % 90)) for i in range(3000)] + [(None, "b"), (None, "a"), (8, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    token_files.write_token_files(docs, JSON, str(tmp_path / "one"))
    got = token_files.token_index(spark, str(tmp_path / "one")).orderBy("start").collect()
    want = [tokenizer.encode(t, add_special_tokens=False).ids for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array([*ids, 0], "<u4").tobytes()) for ids in want]


def test_dictionary_sample_reaches_the_ends_of_documents(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SAMPLE_CHARS", 100)
    texts = ["".join(f"{d}-{i:05d} " for i in range(500)) for d in range(3)] + ["short", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = [t[i : i + 100] for t in texts if t for i in range(0, len(t), 100)] + ["", ""]
    assert sorted(token_files.drawn_blocks(docs)) == sorted(pieces)
    monkeypatch.setattr(token_files, "SAMPLE", 20)
    few = token_files.drawn_blocks(docs)
    assert len(few) == 20 and set(few) <= set(pieces)
    assert any(not t.startswith(x) for x in few for t in texts if t and x in t)


def test_kept_words_come_and_go(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT", 40)
    encoder, tokenizer = token_files.LibraryEncoder(JSON), Tokenizer.from_file(JSON)
    texts = [" ".join(f"word{i * j % 97}" for j in range(30)) + " " + "long" * (i + 20) for i in range(60)]
    for text in [*texts, "", *texts]:  # a call each, so that words are dropped and met again
        (ids,) = encoder.encode([text])
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, token_files.END_ID]
        assert len(encoder.known) == len(encoder.sizes) == len(encoder.used) <= 40 and encoder.sizes.sum() == len(encoder.flat)
