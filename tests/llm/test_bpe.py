"""Prefix table against the public library on the public vocabularies."""

import base64
import hashlib
import random
import re
from array import array

import pyarrow as pa
import pytest
import tiktoken

import public_tokenizers
from claimweave.llm import bpe
from claimweave.llm.common import ready

FILES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


def both(name):
    ranks = bpe.read_ranks(public_tokenizers.path(name))
    own = bpe.encoder(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.vocabulary.rank, special_tokens={})
    return own, library


def words(rng, n):
    letters = ["th", "e", "r", "ung", "é", "ß", "aa", "1", "'s", "_", "日本", "‍", "Z", "🙂"]
    return "".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) + rng.choice([" ", "  ", "\n", "\t ", ""]) for _ in range(n))


@pytest.mark.parametrize("name", FILES)
def test_matches_the_library(name):
    own, library = both(name)
    rng = random.Random(4)
    texts = ["", " ", "a" * 700, "ab" * 400 + "é", "x y", "\x00\x01", "'ll 'LL"] + [words(rng, 60) for _ in range(40)]
    for text in texts:
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_appends_and_edits():
    own, _ = both(FILES[0])
    rng = random.Random(5)
    data = words(rng, 200).encode()
    table = bpe.Prefixes(own.vocabulary, data[:300])
    before = list(table.last)
    table.append(data[300:])
    assert table.last[:300] == before
    assert table.last == bpe.Prefixes(own.vocabulary, data).last
    for _ in range(12):
        start = rng.randint(0, len(table.data))
        end = min(len(table.data), start + rng.randint(0, 9))
        again = table.edit(start, end, words(rng, rng.randint(0, 3)).encode())
        fresh = bpe.Prefixes(own.vocabulary, bytes(table.data))
        assert table.last == fresh.last
        assert table.tokens() == fresh.tokens()
        assert again <= len(table.data)
    assert table.edit(10, 11, b"q") < len(table.data) / 2


def test_documents(spark):
    own, library = both(FILES[0])
    texts = [(1, "Ähnlich wie the others 12"), (2, None), (3, ""), (4, "b " * 5000), (4, "b " * 5000), (None, "lone퟿")]
    docs = ready(spark).createDataFrame([(*row, "x") for row in texts], "doc_id bigint, text string, ids string")
    ranks = bpe.read_ranks(public_tokenizers.path(FILES[0]))
    found = bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).collect()
    expected = []
    for doc_id, text in texts:
        ids = library.encode_ordinary(text or "")
        expected.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert bpe.encode_documents(docs.limit(0), ranks, public_tokenizers.PATTERN).collect() == []


def test_long_batches_leave_in_pieces():
    own, library = both(FILES[0])
    rng = random.Random(8)
    texts = [words(rng, rng.randrange(60)) for _ in range(40)] + [""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(41)), "_utf8": [text.encode() for text in texts]})
    pieces = list(bpe.encoded(batch, own, ("doc_id",), True, held=400))
    assert len(pieces) > 5
    for piece in pieces:
        assert 4 * sum(map(len, piece["ids"].to_pylist()[:-1])) < 400
    rows = [row for piece in pieces for row in zip(piece["doc_id"].to_pylist(), piece["ids"].to_pylist(), piece["n_tokens"].to_pylist())]
    wanted = [library.encode_ordinary(text) for text in texts]
    assert rows == [(i, ids, len(ids)) for i, ids in enumerate(wanted)]
    assert len(list(bpe.encoded(batch, own, ("doc_id",), False, held=400))) == 1
    assert list(bpe.encoded(batch.slice(0, 0), own, ("doc_id",), True)) == []


def test_digests_without_a_list_of_ids(monkeypatch):
    """Tokens are told at once and digests taken from columns; ids with gaps between them stay apart."""
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"bc", b"abc", "ä".encode()]
    encoder = bpe.Encoder(bpe.Vocabulary(b"\n".join(base64.b64encode(token) + b" %d" % (3 * rank) for rank, token in enumerate(tokens))), r"\S+|\s+")
    asked, piece = [], encoder.piece
    monkeypatch.setattr(encoder, "piece", lambda match: (asked.append(match), piece(match))[1])
    texts = ["", "abc ä", "abc abcab ää z\x00", "bcab " * 3000]
    batch = pa.RecordBatch.from_pydict({"_utf8": [text.encode() for text in texts]})
    (out,) = bpe.encoded(batch, encoder, (), False)
    for i, text in enumerate(texts):
        ids = [encoder.vocabulary.rank[part] for match in re.findall(r"\S+|\s+", text) for part in encoder.vocabulary.merged(match.encode())]
        row = [out[name][i].as_py() for name in ("n_tokens", "ids_sha256", "decoded_sha256")]
        assert row == [len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
    assert not {"abc", "ä", " "} & set(asked)


def test_ids_are_kept_as_bytes_and_pairs_are_bounded(monkeypatch):
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"bc", b"abc", b"ca", b"abca", b"aa", b"aaaa"]
    lines = b"\n".join(base64.b64encode(token) + b" %d" % rank for rank, token in enumerate(tokens))
    encoder = bpe.Encoder(bpe.Vocabulary(lines), r"\S+|\s+")
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    asked, apart = [], encoder.vocabulary._stay_apart
    monkeypatch.setattr(encoder.vocabulary, "_stay_apart", lambda left, right: (asked.append((left, right)), apart(left, right))[1])
    draw = random.Random(5)
    for _ in range(200):
        text = "".join(draw.choice("aaabc ä") for _ in range(draw.randrange(30)))
        wanted = [encoder.vocabulary.rank[part] for piece in re.findall(r"\S+|\s+", text) for part in encoder.vocabulary.merged(piece.encode())]
        packed = encoder.packed(text)
        assert encoder.encode(text) == wanted == array("i", packed).tolist() and encoder.decode(wanted) == text.encode()
        assert sum(map(len, encoder.vocabulary._after)) <= bpe.REMEMBERED and len(encoder._known) <= 4
    assert asked and all(isinstance(known, bytes) for known in encoder._known.values())
    encoder.forget()
    assert not any(encoder.vocabulary._after) and not encoder._known
    lacking = bpe.Vocabulary(b"YQ== 0\nYg== 1")
    for data in (b"x", b"ax", b"xa", b"axb"):
        with pytest.raises(ValueError):
            lacking.extend([], data)
