import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from tokenizers import Tokenizer

from pagegraph.llm import bpe, dac, units

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [
    " ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "Word", "é", "ñ", "×", "÷", "ß", "Ω", "я", "日本", "😀", "'s", "'", "don't", ",", ".", "***", "—", "“", "42", "٣",
    " ", "\u0085", " ", " ", "　", " ", "́", "\x1c", "\x00", "<|endoftext|>", "<|endof", "_", "@x",
]


def texts(seed: int, n: int) -> list[str | None]:
    rng = random.Random(seed)
    return [None, "", " ", "\n", *("".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 30))) for _ in range(n)), "end ", " "]


@pytest.mark.parametrize("seed", range(3))
def test_no_pretoken_crosses_a_cut(seed):
    pretokens = regex.compile(units.PATTERN).findall
    for text in filter(None, texts(seed, 1500)):
        data = text.encode()
        starts = [0, *(int(i) for i in np.flatnonzero(units.cuts(data)) if i), len(data)]
        parts = [data[a:b].decode() for a, b in zip(starts, starts[1:])]
        assert [t for p in parts for t in pretokens(p)] == pretokens(text), (text, parts)


@pytest.mark.parametrize("made", [dac._parts, bpe._parts])
@pytest.mark.parametrize("room", [48_000_000, 20_000, 0])
def test_parts_agree_with_the_library(made, room):
    t = Tokenizer.from_file(VOCAB)
    parts = made(VOCAB)
    parts.room, parts.kept, parts.old = room, units.Kept(), units.Kept()
    for seed in range(6):
        rows = texts(seed, 400)
        ids, sizes = parts.ids(pa.array([None, *rows], pa.string()).slice(1))
        want = [t.encode(x or "", add_special_tokens=False).ids for x in rows]
        assert sizes.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
        if not room:
            assert parts.kept.n <= 20_000
    parts.room = 48_000_000
    assert [len(x) for x in parts.ids(pa.array([], pa.string()))] == [0, 0]
