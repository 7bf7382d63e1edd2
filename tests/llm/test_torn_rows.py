"""op9_packing: rows without doc_id whose pieces are torn at a sequence's end."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from curul.llm import packing
from curul.llm.common import texts


def test_torn_rows_without_doc_id_stay(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = Tokenizer.from_file(path).encode
    rows = [(None if i % 4 else i, " ".join(f"w{i * 50 + j}" for j in range(i % 5 + 7))) for i in range(80)]
    got = packing.packed(texts(spark.createDataFrame(rows, "doc_id long, text string")), path, size=32, step=4).collect()
    ids = [[*encode(t, add_special_tokens=False).ids, 1] for _, t in rows]
    assert sum(r.length for r in got if r.doc_id is None) == sum(len(x) for (d, _), x in zip(rows, ids, strict=True) if d is None)
    assert sum(r.length for r in got) == sum(map(len, ids))
    pieces = {(len(x), s, e - s, zlib.crc32(np.array(x[s:e], "<u4").tobytes())) for x in ids for s in range(len(x)) for e in range(s + 1, min(len(x), s + 32) + 1)}
    assert all((r.doc_tokens, r.start, r.length, r.ids_crc32) in pieces for r in got)
    # More than one piece of 32 ids or less after a start that is no multiple of 32: some were torn.
    assert sum(r.start % 32 > 0 and r.doc_id is None for r in got) > 5
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
