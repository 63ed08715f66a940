"""Operator 7: token ids as Parquet lists for selective reads.

Texts are encoded in Arrow batches and written by Spark's own Parquet writer
and commit protocol, one list of ids for each document beside its metadata. The caller
chooses dictionary pages or delta-packed integers for the ids, the size of row
groups, and the rows of a page. Rows are sorted by id within each file, so that
the page index narrows a read by id to a few pages, and a read of metadata
touches no page of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import tokens
from quern.llm.work import new_folder, small_batches

ENCODING = "dictionary"
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 1 << 20, 1000

_SCHEMA = "doc_id long, source string, lang string, n_tokens int, tokens array<int>"


def encoded(docs: DataFrame, vocabulary_path: str = tokens.VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, n_tokens, tokens) of every row.

    A null or empty text has an empty list; a null id, source or language stays
    null, and a missing source or language column is null. Repeated rows are
    encoded each. Texts are encoded whole; strings that look like special tokens
    are ordinary text. Other columns aren't read. An empty table gives no rows.
    """
    vocabulary = tokens.read_vocabulary(vocabulary_path)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens.tokenizer(vocabulary)
        for b in batches:
            for i, j, ids, off in t.encode(b.column(3)):
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(3)), pa.array(np.diff(off).astype(np.int32)), lists], names=["doc_id", "source", "lang", "n_tokens", "tokens"])

    null = F.lit(None).cast("string")
    own = [docs[c].cast("string").alias(c) if c in docs.columns else null.alias(c) for c in ("source", "lang")]
    return docs.select(docs[id_col].cast("long").alias("doc_id"), *own, docs[text_col].cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def write_tokens(table: DataFrame, path: str, encoding: str = ENCODING, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Writes ``encoded`` rows; ``encoding`` of the ids is "dictionary" or "delta"."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding: {encoding}")
    options = {
        "compression": "zstd",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.dictionary.page.size": 1 << 20,
        "parquet.writer.version": "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0",
        "parquet.enable.dictionary#tokens.list.element": str(encoding == "dictionary").lower(),
    }
    table.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The written rows, or those of some ids and columns only; both choices reach the scan."""
    df = spark.read.schema(_SCHEMA).parquet(path)
    if ids is not None:
        df = df.where(F.col("doc_id").isin(ids))
    return df.select(*columns) if columns else df


def token_table(docs: DataFrame, vocabulary_path: str = tokens.VOCABULARY, encoding: str = ENCODING) -> DataFrame:
    """``docs`` encoded, written to the shared folder and read again; see ``encoded``."""
    src = docs.sortWithinPartitions("doc_id")
    path = new_folder(docs.sparkSession, "tokens")
    write_tokens(encoded(src, vocabulary_path), path, encoding)
    return read_tokens(docs.sparkSession, path)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
