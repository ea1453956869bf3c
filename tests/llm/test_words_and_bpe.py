import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from lupa.llm import edit_counts, long_bpe, token_files
from lupa.llm import words as W
from lupa.llm.bpe import Vocabulary

ALPHABETS = ["ab", "a ", " \n", "abc'", "the'restmdl ", "aé漢 ", "0 9a", " !?'s", "hello world", ["<|endoftext|>", "a", " "],
             [chr(c) for c in range(0x180)] + list("İΣσς é́𝔘🙂")]


def texts(n, longest=60, seed=1):
    rng = random.Random(seed)
    return [None, "", *("".join(rng.choice(a) for _ in range(rng.randint(0, longest))) for _ in range(n) for a in ALPHABETS)]


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def vocab(request):
    return Vocabulary(public_tokenizers.path(request.param))


@pytest.fixture(scope="module")
def byte_vocab():
    return Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_are_the_runs_between_separators():
    rows = texts(200)
    for table, pattern in ((W.split_table(), rb"[^\x20\x09-\x0D]+"), (W.ascii_words_table(), rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = W.words_of(pa.array(rows), table)
        for i, text in enumerate(rows):
            data = (text or "").encode()
            if table[0x41] == 0x61:
                data = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
            found = [words.word(j).replace(b"\xff", b"\0") for j in range(words.first[i], words.first[i + 1])]
            assert found == regex.findall(pattern, data)


def test_equal_words_and_windows_have_equal_hashes():
    words = W.words_of(pa.array(["a b a b a b", "x a b"]), W.split_table())
    assert len(set(words.hash.tolist())) == 3
    run = W.windows(words.hash, 2)
    assert run[0] == run[2] == run[4] == run[7] != run[1]
    assert W.whole_windows(words, 3).tolist() == [0, 1, 2, 3, 6]


def test_encoding_equals_the_library(vocab):
    rows = texts(300)
    expected = vocab.tokenizer.encode_batch([t or "" for t in rows], add_special_tokens=False)
    ids, counts = vocab.encode_column(pa.array(rows))
    bounds = np.append(0, np.cumsum(counts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [x.ids for x in expected]


def test_decoding_equals_the_library(byte_vocab):
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert byte_vocab.decode(np.array(ids, "<u4")) == byte_vocab.tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("long", [1, 8, 4096])
def test_joined_parts_equal_the_whole(byte_vocab, monkeypatch, long):
    monkeypatch.setattr(long_bpe, "_WINDOW", 8)
    monkeypatch.setattr(long_bpe, "_LONG", long)
    rng = random.Random(3)
    for text in texts(15, 400, seed=long):
        if text and not byte_vocab.has_special_text(text):
            parts = [long_bpe.encoded(byte_vocab, x) for x in long_bpe.halves(text.encode(), rng.choice([2, 5, 40, 100]))]
            assert long_bpe.tree(byte_vocab, parts).ids.tolist() == byte_vocab.tokenizer.encode(text, add_special_tokens=False).ids


def test_edited_trees_count_the_edited_text(byte_vocab, monkeypatch):
    rng = random.Random(5)
    for text in texts(30, 500, seed=7):
        monkeypatch.setattr(edit_counts, "LEAF", rng.choice([1, 2, 8]))
        sizes, counts, _ = edit_counts.leaves(byte_vocab, pa.array([text]))
        tree, text = edit_counts.grow(counts), text or ""
        sizes = sizes if len(sizes) else np.zeros(1, np.int64)
        cuts = sorted(rng.choice([0, len(text), rng.randint(0, len(text))]) for _ in range(2 * rng.randint(1, 4)))
        edits = [(a, b, rng.choice(["", "x", " 's", "é"])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        new, at = "", 0
        for a, b, put in edits:
            new, at = new + text[at:a] + put, b
        new += text[at:]
        data, sizes, tree, _ = edit_counts.apply(byte_vocab, text.encode(), sizes, tree, edit_counts._in_bytes(text, edits))
        assert data.decode() == new and sizes.sum() == len(data)
        assert tree[0] == len(byte_vocab.tokenizer.encode(new, add_special_tokens=False).ids)
        assert (edit_counts.grow(tree[(len(tree) + 1) // 2 - 1 :]) == tree).all()


def test_a_change_in_a_long_text_encodes_little(byte_vocab):
    text = "word and more " * 5000
    sizes, counts, _ = edit_counts.leaves(byte_vocab, pa.array([text]))
    *_, again = edit_counts.apply(byte_vocab, text.encode(), sizes, edit_counts.grow(counts), [(30000, 30004, b"x")])
    assert again < 1000


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 20000, 1_200_000])
def test_blocks_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 49000).astype(np.uint32)
    table = token_files.Table.of(token_files.scaled(np.bincount(ids, minlength=2)))
    data = token_files.block(pa.array([None, 3]), np.array([0, n]), ids, table)
    names, counts, back = token_files.read_block(data, table)
    assert names.to_pylist() == [None, 3] and counts.tolist() == [0, n] and (back == ids).all()
    if n:
        broken = bytearray(data)
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            token_files.read_block(bytes(broken), table)


def test_scaled_frequencies_keep_every_id():
    counts = np.array([10**12, 1, 0, 1, 5])
    scaled = token_files.scaled(counts)
    assert scaled.sum() == 1 << token_files.BITS and ((scaled > 0) == (counts > 0)).all()
