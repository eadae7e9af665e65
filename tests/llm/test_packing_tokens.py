import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from pagewarden.llm import packing

TEXTS = ["a<|endoftext|>b", "<|endoftext|>", "two  <|endoftext|> \n\n<|endoftext|><|endoftext|> x ", "no end", "<|endoftext|", "", None, "é<|ENDOFTEXT|>", "word <|endoftext|> " * 900]


def test_ids_are_those_of_the_tokenizer_as_loaded(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = set()
    for i, text in enumerate(TEXTS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, packing.END_OF_DOCUMENT], "<u4")
        want |= {(i, *piece) for piece in packing.pieces_of(ids, packing.CAPACITY)}
        assert text != TEXTS[0] or 50256 in ids
        assert zlib.crc32(ids.tobytes()) in {c for d, *_, c in want if d == i} or len(ids) > packing.CAPACITY
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pack_documents(docs).collect()}
    assert got == want


def test_runs_of_millions_of_blanks(spark):
    """Texts that the fast encoder's pattern can't match as a whole have the tokenizer's ids all the same."""
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["start" + blank * 2_000_000 + "end" for blank in (" ", "\n", " ")]
    for text in texts:
        assert packing.ids_of(text, packing.TOKENIZER).tolist() == t.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, texts[0]), (2, "short")], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    ids = np.array([*t.encode(texts[0], add_special_tokens=False).ids, packing.END_OF_DOCUMENT], "<u4")
    assert {tuple(r)[:5] for r in rows if r["doc_id"] == 1} == {(1, *piece) for piece in packing.pieces_of(ids, packing.CAPACITY)}
