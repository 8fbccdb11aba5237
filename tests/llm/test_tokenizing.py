import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import columns as C
from tessera.llm import tokenizing
from tests.llm import cases

ODD = [
    "", "  a  b   c \n\n d ", " lead", "trail ", "a \n  b", "x　 y   z", "<|endoftext|> hi<|endoftext|>a <|startoftext|>b", "\x1c \x1d a",
    "emoji 😀 é́ ǆ ﬁ İ ΑΣ ΣΣ's don't I'LL\x00 a\x00b", "12 345 ½ ² 3áe", "ſ K Å ﬀ ǅ", "  a \x85 b", "é́ á̧", "﻿a b", "\x00", " \x00 ",
    "<|ENDOFTEXT|> <|endof text|>", "a\n \nb", "a\n\n\n b  ", "ÄÖÜ " * 50, "don't we'll 'S 's 're",
]


@pytest.fixture(scope="module")
def libraries():
    return [(tokenizing.byte_bpe(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))), (tokenizing.word_bpe(), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))]


def agree(encoder, library, texts):
    ids, starts = encoder.encode(C.filled(pa.array(texts, pa.string())))
    got = [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]
    assert got == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_are_the_libraries(libraries):
    for encoder, library in libraries:
        agree(encoder, library, ODD + cases.texts())
        agree(encoder, library, [])


def test_every_vocabulary_entry_encodes_to_itself():
    assert tokenizing.word_bpe().faithful()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t　'sStT1é́a"), st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_ids_of_any_text(libraries, texts):
    for encoder, library in libraries:
        agree(encoder, library, texts)


def test_rank_encoder_is_tiktoken():
    ranks = tokenizing.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids, starts = tokenizing.ByteBPE(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode(C.filled(pa.array(ODD)))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [enc.encode_ordinary(t) for t in ODD]
