"""What a worker holds beside the texts it works on: two workers and a heap of 60 % share an executor's memory."""

import sys

import numpy as np
import pyarrow as pa

from quillon.llm import sentencepiece_lattice, token_files
from quillon.llm.queries import vocabulary

LETTERS = str.maketrans("0123456789", "ghijklmnop")


def numbered(first, n):
    """n words of letters that occur nowhere else."""
    return " ".join("q" + f"{k:x}z".translate(LETTERS) for k in range(first, first + n))


def test_encoder_holds_few_bytes():
    encode, most = token_files.Encoder(vocabulary("byte_bpe_50k.json")), 0
    for first in range(0, 1_000_000, 50_000):
        texts = [numbered(first, 50_000), numbered(first, 20), ""]
        flat, count = encode(pa.array(texts))
        assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == [x.tolist() for x in encode.whole(texts)]
        held = sys.getsizeof(encode.known) + sum(sys.getsizeof(p) + 32 for p in encode.known) + encode.ids.nbytes + encode.begin.nbytes + encode.size.nbytes
        most = max(most, held)
    assert most < 100 << 20


def test_lattice_holds_few_bytes():
    lattice, most = sentencepiece_lattice.Lattice(sentencepiece_lattice.load_pieces(vocabulary("piece_bpe_32k.model")), False), 0
    for first in range(0, 500_000, 20_000):
        text = numbered(first, 20_000)
        (ids,) = lattice([text])
        assert ids == b"".join(lattice(text.split(" ")))
        most = max(most, sys.getsizeof(lattice.known) + sum(sys.getsizeof(u) + sys.getsizeof(x) for u, x in lattice.known.items()))
    assert most < 28 << 20
