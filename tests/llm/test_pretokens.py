"""Segments of texts: each distinct one is encoded once, and laid out again in order."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from folioscope.llm import arrow_ids, bpe, pretokens

PARTS = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "\r\n", "​", "a", "the", "The", "é", "'s", "12", "!", "x" * 200, "日本", "<|endoftext|>"]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    return [None, "", " ", "\n", " a", "a ", "\na", *("".join(rng.choices(PARTS, k=rng.randrange(14))) for _ in range(2000))]


def test_a_segment_is_encoded_once():
    """What a process has met in one slice of texts isn't encoded again, in that slice or a later one."""
    seen: list[bytes] = []
    split = pretokens.Splitter(public_tokenizers.PATTERN, lambda segments: seen.extend(segments) or [s.upper() + b"|" for s in segments])
    assert split(["a b a b\nb", None, "b a"]).to_pylist() == [b"A| B| A| B|\n|B|", b"", b"B| A|"]
    assert split(["b b c"]).to_pylist() == [b"B| B| C|"]
    assert sorted(seen) == sorted([b"a", b" b", b" a", b"\n", b"b", b" c"])


def test_memory_of_segments_is_bounded(monkeypatch):
    monkeypatch.setattr(pretokens, "CACHE_ENTRIES", 10)
    split = pretokens.Splitter(public_tokenizers.PATTERN, lambda segments: segments)
    texts = [" ".join(f"w{j % 40}" for j in range(i, i + 30)) for i in range(50)]
    assert [x.decode() for t in texts for x in split([t]).to_pylist()] == texts
    assert len(split.segments) <= 30


def test_a_worker_keeps_its_encoder():
    first = pretokens.kept("test", (1,), object)
    assert pretokens.kept("test", (1,), object) is first and pretokens.kept("test", (2,), object) is not first


def test_odd_white_space_and_added_tokens(odd_texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = bpe.Encoder(ranks, bpe.PerfectHash(ranks), public_tokenizers.PATTERN).texts(odd_texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == [own.encode_ordinary(t or "") for t in odd_texts]
    decoder = bpe.Decoder(bpe._tokens(ranks))
    assert [x.decode() for x in decoder.plain(ids).to_pylist()] == [t or "" for t in odd_texts]
    assert [x.decode() for x in decoder.plain(ids.slice(9, 70)).to_pylist()] == [t or "" for t in odd_texts[9:79]]

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        encoder = arrow_ids.LibraryEncoder(f.read(), public_tokenizers.PATTERN, "<u2")
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.texts(odd_texts).to_pylist()]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in odd_texts]


def test_the_library_meets_a_word_once(monkeypatch):
    """Words are encoded by the library together, and not again in later slices."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = arrow_ids.LibraryEncoder(f.read(), public_tokenizers.PATTERN, "<u2")
    calls, ids = [], encoder.ids
    monkeypatch.setattr(encoder, "ids", lambda text: calls.append(text) or ids(text))
    first = encoder.texts(["one two three two", "one four"]).to_pylist()
    assert calls == [" two three four", "one"]
    assert encoder.texts(["one two three two", "one four"]).to_pylist() == first and len(calls) == 2


def test_the_library_keeps_no_words_of_its_own(monkeypatch):
    from types import SimpleNamespace

    from folioscope.llm import arrow_ids

    sizes = []
    library = SimpleNamespace(model=SimpleNamespace(_resize_cache=sizes.append), get_added_tokens_decoder=dict, get_vocab=dict)
    monkeypatch.setattr(arrow_ids, "Tokenizer", SimpleNamespace(from_str=lambda _: library))
    arrow_ids.LibraryEncoder("", r"\S+", "<u2")
    assert sizes == [0]
