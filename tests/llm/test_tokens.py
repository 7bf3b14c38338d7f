import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factline.llm import piece_codec, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TRICKY = ["", "a  b   c \n\n x\t\t y  ", "<|endoftext|>hi<|endoftext|>", "aaaa" * 700, "x   y \x1c z!\x1c  q", "日本語のテキスト " * 20, "it's we'll don't 1234 $$$###  ", " " * 50, "é" * 3000 + " \n", "   x \r\n y"]


def test_counts_agree_with_the_library(texts):
    samples = [*texts.values(), *TRICKY]
    want = [len(e.ids) for e in Tokenizer.from_file(BPE).encode_batch(samples, add_special_tokens=False)]
    assert token_counts.Counter(token_counts.load_bpe(BPE)).count(samples) == want


def test_long_sequences_merge_alike():
    bpe = token_counts.load_bpe(BPE)
    for text in (b"abcabcaaaa" * 20, "thequickbrown".encode() * 30, bytes(range(256)) * 2):
        assert token_counts.merge_long(bpe, bpe["bytes"][np.frombuffer(text, dtype=np.uint8)]) == token_counts.merge_counts(bpe, [text])[0]


def test_count_rows(odd, empty, odd_rows):
    out = token_counts.count_tokens(odd, BPE)
    rows = out.select("doc_id", "n_bytes", "n_tokens", "over_limit", "_text").collect()
    assert len(rows) == len(odd_rows)
    null = next(r for r in rows if r["doc_id"] == 50)
    assert (null["n_bytes"], null["n_tokens"], null["over_limit"], null["_text"]) == (0, 0, False, "x")
    assert next(r for r in rows if r["doc_id"] == 60)["over_limit"]
    assert token_counts.count_tokens(empty, BPE).count() == 0


def test_pieces_agree_with_the_library(texts):
    samples = [*texts.values(), *TRICKY[:2], *TRICKY[3:], "thequickbrownfox" * 90, "(((((((())))" * 30]
    codec = piece_codec.Codec(piece_codec.load_pieces(PIECES))
    got = codec.encode(samples)
    assert got == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(samples)
    assert [codec.decode(x) for x in got] == samples


@pytest.mark.parametrize("text", ["thequickbrownfoxjumps" * 40, "aaaaaaa" * 99, "abcdefghijklmnop" * 60])
def test_stream_commits_what_the_whole_search_finds(text):
    pieces = piece_codec.load_pieces(PIECES)
    chars = pieces["chars"][np.array([ord(c) for c in text])].astype(np.int64)
    assert list(piece_codec.stream(pieces, iter(chars.tolist()))) == piece_codec.search(pieces, piece_codec.Steps(pieces), chars, np.array([len(chars)]))[0].tolist()


def test_piece_rows(odd, empty, odd_rows):
    rows = piece_codec.check_pieces(odd, PIECES).select("doc_id", "n_tokens", "exact").collect()
    assert len(rows) == len(odd_rows) and all(r["exact"] for r in rows)
    assert piece_codec.check_pieces(empty, PIECES).count() == 0
    coded = piece_codec.encode_checked(odd.select("doc_id", "text", "_in"), PIECES)
    back = {r["doc_id"]: (r["text"], r["back"]) for r in piece_codec.decode_pieces(coded, PIECES, into="back").collect()}
    assert all((a or "") == b for a, b in back.values())
