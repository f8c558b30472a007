"""Ids of texts that spell out an added token, against the tokenizer files with nothing set."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracelens.llm import queries
from tracelens.llm.textbytes import texts
from tracelens.llm.tokens import encoder

GIVEN = ["hello <|endoftext|> world", "a<|endoftext|>b", "<|endoftext|><|startoftext|>", "x <|startoftext|>\n\n y", "<|ENDOFTEXT|> it's", "<|endoftext", "|> plain text", "", "<<|endoftext|>>", "é <|endoftext|>"]


@pytest.mark.parametrize(("name", "leading"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_those_of_the_unmodified_tokenizer(name, leading):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_file(name))
    want = [t.encode(x, add_special_tokens=False).ids for x in GIVEN]
    for _ in range(2):
        ids, ends = encoder(queries.tokenizer_file(name), leading, True).encode(*texts(pa.array(GIVEN)))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want


def test_queries_give_a_marker_its_one_id(spark, tmp_path):
    from tokenizers import Tokenizer

    spark.createDataFrame(list(enumerate(GIVEN)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for query, name, end, n, crc in ((queries.op9_bit_packed_ids, "word_bpe_49k.json", 2, "n_tokens", "ids_crc32"), (queries.op1_packing, "byte_bpe_50k.json", 1, "doc_tokens", None)):
        t = Tokenizer.from_file(queries.tokenizer_file(name))
        want = {i: [*t.encode(x, add_special_tokens=False).ids, end] for i, x in enumerate(GIVEN)}
        got = query(spark, str(tmp_path)).collect()
        assert {(r.doc_id, r[n]) for r in got} == {(i, len(x)) for i, x in want.items()}
        if crc:
            assert {(r.doc_id, r[crc]) for r in got} == {(i, zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
