"""Encoding a corpus with a public byte-level tokenizer, each distinct word once.

One pass splits every text into words (pre-tokens) and cuts the documents into blocks: a
document becomes the places of its words in its block's list of distinct words. The
words of all blocks are brought together, each distinct one is encoded once, and its ids
return to the blocks, where documents are put together by place. A word has one row per
block that holds it; words in very many blocks are looked up in a table of bounded
length, so that no task ever has a word's rows to itself.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyard.durable import materialise
from tallyard.operators.spread import spread

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the published split pattern of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


@lru_cache(4)
def _token_bytes(path: str) -> dict[int, bytes]:
    with open(path, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}


def words(text: str | None) -> list[str]:
    """Pre-tokens of a text in order; their concatenation is the text."""
    return _splitter().findall(text) if text else []


#: Most words that are looked up in a table sent to all tasks; the least rows that make a word one of them.
HOT_WORDS, HOT_ROWS = 1_000_000, 100_000


def split(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(documents, words): (block, id, places) and (part, no, word), a part for a block, written in one pass over the texts.

    A block holds the documents of one task up to ``block_bytes`` of text, or one longer
    document. Places are the numbers of a document's words in its block, in order.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("id", id_type), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("no", T.IntegerType()), T.StructField("word", T.StringType())])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, number, held = TaskContext.get().partitionId() << 32, {}, 0
        for pdf in batches:
            ids, places, of = [], [], []
            for i, text in zip(pdf["id"], pdf["text"]):
                size = len(text) if text else 0
                if held and held + size > block_bytes:
                    yield from _flush(ids, places, of, number, block)
                    ids, places, of, number, held, block = [], [], [], {}, 0, block + 1
                held += size
                ids.append(i)
                places.append(np.fromiter((number.setdefault(w, len(number)) for w in words(text)), dtype="int32"))
                of.append(block)
            yield from _flush(ids, places, of, {}, block)
        yield from _flush([], [], [], number, block)

    rows = spread(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text")
    table = materialise(rows.mapInPandas(cut, schema), "split")
    return table.where("places is not null").select("block", "id", "places"), table.where("word is not null").select(F.col("block").alias("part"), "no", "word")


def _flush(ids: list, places: list, of: list, number: dict[str, int], block: int) -> Iterator[pd.DataFrame]:
    """Documents, and the words of their finished block, as rows of one table."""
    if ids:
        yield pd.DataFrame({"block": np.array(of, dtype="int64"), "id": pd.Series(ids, dtype=object), "places": places, "no": pd.Series([None] * len(ids), dtype=object), "word": pd.Series([None] * len(ids), dtype=object)})
    if number:
        n = len(number)
        yield pd.DataFrame({"block": np.full(n, block, dtype="int64"), "id": pd.Series([None] * n, dtype=object), "places": pd.Series([None] * n, dtype=object), "no": np.arange(n, dtype="int32"), "word": list(number)})


def encoded_words(held: DataFrame, tokenizer: str, lengths: bool) -> DataFrame:
    """(word, n, ids) of every distinct word of ``held`` (word): n rows, encoded once."""

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(tokenizer)
        for pdf in batches:
            ids = [e.ids for e in t.encode_batch(pdf["word"].tolist(), add_special_tokens=False)]
            yield pdf.assign(ids=[len(i) for i in ids] if lengths else ids)

    distinct = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))  # reduced inside the tasks before the shuffle
    return distinct.mapInPandas(encoded, f"word string, n bigint, ids {'int' if lengths else 'array<int>'}")


def returned(held: DataFrame, known: DataFrame, hot_words: int = HOT_WORDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(part, no, ids): the ids of every word of every block.

    Words with more rows than ``hot_rows`` and a ``hot_words``-th of all rows are looked up
    in a broadcast table, which has fewer than ``hot_words`` rows for that reason; all others
    meet by word, so no task has more rows of one word than that.
    """
    known = materialise(known, "known")
    total = int(known.agg(F.sum("n")).first()[0] or 0)
    most = max(hot_rows, total // hot_words)
    hot = known.where(F.col("n") > most).select("word", "ids")
    cold = known.where(F.col("n") <= most).select("word", "ids")
    out = held.join(cold, "word").select("part", "no", "ids")
    if not hot.isEmpty():
        out = out.unionByName(held.join(F.broadcast(hot), "word").select("part", "no", "ids"))
    return out


def _reassembled(documents: DataFrame, table: DataFrame, id_type: T.DataType, lengths: bool) -> DataFrame:
    out = T.StructType([T.StructField("id", id_type), T.StructField("ids", T.IntegerType() if lengths else T.ArrayType(T.IntegerType()))])

    def join(docs: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        values = of.sort_values("no")["ids"]
        if lengths:
            n = values.to_numpy(dtype="int64")
            return pd.DataFrame({"id": docs["id"], "ids": [int(n[np.asarray(p)].sum()) if len(p) else 0 for p in docs["places"]]})
        size = np.fromiter(map(len, values), dtype="int64", count=len(values))
        flat = np.concatenate([*values, np.empty(0, dtype="int32")])
        start = size.cumsum() - size
        ids = []
        for p in docs["places"]:
            p = np.asarray(p, dtype="int64")
            k = size[p]
            ids.append(flat[np.repeat(start[p] - (k.cumsum() - k), k) + np.arange(int(k.sum()))].astype("int32"))
        return pd.DataFrame({"id": docs["id"], "ids": ids})

    return documents.groupBy("block").cogroup(table.groupBy("part")).applyInPandas(join, out)


def _encode(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, block_bytes: int, lengths: bool) -> DataFrame:
    documents, held = split(docs, id_col, text_col, block_bytes)
    table = returned(held, encoded_words(held, tokenizer, lengths))
    return _reassembled(documents, table, docs.schema[id_col].dataType, lengths)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json", block_bytes: int = 2 << 20) -> DataFrame:
    """(id, ids) of every row: token ids of its text, without special tokens.

    Null and empty texts have the empty list; strings that look like special tokens
    are ordinary text; repeated rows stay repeated; a null id stays null; other
    columns are not looked at. An empty table gives an empty table.
    """
    return _encode(docs, id_col, text_col, tokenizer, block_bytes, lengths=False).toDF(id_col, "ids")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json", block_bytes: int = 2 << 20) -> DataFrame:
    """(id, n_tokens) of every row, by the same way as ``encode`` but with lengths in place of ids."""
    return _encode(docs, id_col, text_col, tokenizer, block_bytes, lengths=True).toDF(id_col, "n_tokens")


def decode(encoded: DataFrame, ids: str = "ids", ranks: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``encoded`` with a column ``text``: the bytes of its ids, looked up in the token-byte table.

    The table has the vocabulary's size, whatever the corpus. Null ids give null; the
    empty list gives the empty text.
    """

    @F.pandas_udf(T.StringType())
    def text(lists: pd.Series) -> pd.Series:
        table = _token_bytes(ranks)
        return lists.map(lambda x: None if x is None else b"".join([table[i] for i in x]).decode("utf-8", "replace"))

    return encoded.withColumn("text", text(F.col(ids)))
