"""Exact round trip of token files, their order, encodings and page indexes."""

import glob
import zlib

import numpy as np
import pyarrow.parquet as pq

from folium.llm import tokens, tokenstore


def check(df, got):
    encode = tokens.encoder(tokenstore.VOCABULARY).whole.encode
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, want = 0, []
    for doc_id, text in rows:
        ids = np.array([*encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_table(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    path = str(tmp_path / "t")
    tokenstore.write_tokens(df.repartition(3), path, files=3, page_rows=20)
    check(df, tokenstore.digests(spark, path).collect())
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
        assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    tokenstore.write_tokens(df, str(tmp_path / "d"), files=2, dictionary=False)
    meta = pq.ParquetFile(glob.glob(f"{tmp_path}/d/*.parquet")[0]).metadata
    assert "DELTA_BINARY_PACKED" in meta.row_group(0).column(4).encodings
    check(df, tokenstore.digests(spark, str(tmp_path / "d")).collect())


def test_row_groups(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokenstore.write_tokens(df, str(tmp_path / "g"), files=1, row_group_bytes=100_000, page_bytes=8_000)
    assert pq.ParquetFile(glob.glob(f"{tmp_path}/g/*.parquet")[0]).metadata.num_row_groups > 2


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(4, None, 1), (2, "", 2), (9, "a b " * 20000, 3), (9, "A", 3), (9, "A", 3), (None, "x", 4)], "doc_id long, text string, part int")
    tokenstore.write_tokens(df, str(tmp_path / "o"))
    check(df, tokenstore.digests(spark, str(tmp_path / "o")).collect())
    tokenstore.write_tokens(df.where("false"), str(tmp_path / "e"))
    assert tokenstore.digests(spark, str(tmp_path / "e")).count() == 0


def test_selective_read(spark, sf, tmp_path):
    tokenstore.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), str(tmp_path / "s"))
    plan = tokenstore.read_tokens(spark, str(tmp_path / "s")).where("doc_id < 5").select("n_tokens")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[-1] and "LessThan(doc_id,5)" in plan
