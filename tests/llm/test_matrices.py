"""Written matrices hold the packed rows, byte for byte."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from remitlens.llm import token_output

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_matrices_are_written_and_read_back(spark, tmp_path):
    lines = [(i, " ".join(f"w{i}x{j}" for j in range(i * 7 % 60))) for i in range(40)]
    lines += [(100, None), (101, ""), (102, "long " * 3000)]
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    packed = token_output.packed_matrices(docs, WORD, capacity=128, shard_docs=8)
    path = str(tmp_path / "matrices")
    token_output.write_matrices(packed, path)
    read = spark.read.parquet(path)
    assert sorted(map(str, read.collect())) == sorted(map(str, packed.collect()))
    assert read.schema.simpleString() == packed.schema.simpleString()
    for r in read.collect():
        assert len(r.input_ids) == len(r.position_ids) == 256  # fixed width: 128 ids of 2 bytes
        ends = np.array(r.cu_seqlens)
        assert ends[0] == 0 and (np.diff(ends) > 0).all() and ends[-1] == r.n_tokens <= 128
    pieces = read.select(F.explode(F.arrays_zip("doc_ids", "pieces")).alias("p")).select("p.*")
    assert pieces.count() == pieces.distinct().count()
    assert {r.doc_ids for r in pieces.collect()} == {i for i, _ in lines}
