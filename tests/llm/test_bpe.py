import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from trackloom.llm.bpe import Codec, decode, encode

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    out = ["", " ", "Hello world", "a" * 1000, "ab" * 3000, "<|endoftext|>", "日本語 テキスト", "🙂👍🏽 x", "tab\t\tnew\n\n\r\n  end ", "x" * 255 + "y", "z" * 257, "é" * 400, "\u0000\u0001", "don't DON'T we'll"]
    for _ in range(200):
        out.append("".join(rng.choice(["the", " ", "ing", "Q", "9", "é", "ß", "\n", "_", "%", "th", "qu", "zz", "漢"]) for _ in range(rng.randrange(60))))
    return out


def test_same_ids_as_the_library_and_round_trip(spark, theirs):
    rows = [(i, t, i, "x") for i, t in enumerate(texts())] + [(-1, None, 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids long, decoded string")
    got = decode(encode(df, PATH, P.PATTERN), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.token_ids == theirs.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_matrix_and_heap_agree():
    with open(PATH, "rb") as f:
        codec = Codec(f.read(), P.PATTERN)
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"theringao ABC\xc3\xa9\xff") for _ in range(rng.randint(2, 90))) for _ in range(300)]
    for piece, ids in zip(pieces, codec.encode_pieces(pieces), strict=True):
        want = [codec.ranks[piece]] if piece in codec.ranks else codec._merge_long(piece).tolist()
        assert ids.tolist() == want


@pytest.mark.parametrize("n", [255, 256, 257, 511, 513, 1025, 5000, 40_000])
def test_pieces_around_and_beyond_one_matrix_row(theirs, n):
    rng = random.Random(n)
    with open(PATH, "rb") as f:
        codec = Codec(f.read(), P.PATTERN)
    for letters in ("a", "ab", "etaoinshrdlu", "é漢"):
        piece = "".join(rng.choice(letters) for _ in range(n))
        assert codec.encode_pieces([piece.encode()])[0].tolist() == theirs._encode_single_piece(piece)
