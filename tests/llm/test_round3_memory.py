"""What a worker holds, by the bytes of its texts."""

import random
import tracemalloc

import numpy as np
import public_tokenizers

from ledgerloom.llm.chunked_bpe import ChunkCoder, chunks, cuts

from .conftest import prose


def test_encoded_chunks_are_held_in_few_bytes():
    code = ChunkCoder(public_tokenizers.path("byte_bpe_50k.json"))
    raw = prose(random.Random(11), 60_000).encode()
    parts = list(chunks(raw, cuts(np.frombuffer(raw, np.uint8))))
    tracemalloc.start()
    for part in parts:
        code.chunk(part)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(code.store) > 100 and held < 5 * len(raw)  # lists of ids took 12 times the text
