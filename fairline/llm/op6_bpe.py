"""BPE encoding and decoding of a text column, by `bpe.Backtracking`.

Null and empty texts have no ids. Repeated rows and ids give a row each; a row depends on its text alone. Texts of any length are
encoded whole. Other columns are not read.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from .common import once, rows_pass


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array of int) for each row."""
    def make():
        import numpy as np
        from .bpe import Backtracking
        coder = once(("bpe", tokenizer), lambda: Backtracking(tokenizer))
        return lambda i, t: (i, np.frombuffer(coder.encode(t), "<u4").tolist())
    return rows_pass(df, [id_col, text_col], f"{id_col} {dict(df.dtypes)[id_col]}, ids array<int>", make)


def decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, text for each row; null ids: empty text."""
    def make():
        import numpy as np
        from .bpe import Backtracking
        coder = once(("bpe", tokenizer), lambda: Backtracking(tokenizer))
        return lambda i, x: (i, coder.decode(np.asarray(x or [], "<u4").tobytes()))
    return rows_pass(df, [id_col, ids_col], f"{id_col} {dict(df.dtypes)[id_col]}, text string", make)


def digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", cache: int = 500_000) -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them. `cache` bounds the entries of a cache: it
    changes the speed and the memory of a worker alone."""
    def make():
        from .bpe import Backtracking
        coder = once(("bpe", tokenizer, cache), lambda: Backtracking(tokenizer, cache))

        def row(i, t):
            ids = coder.encode(t)
            back = coder.decode(ids)
            return i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()
        return row
    return rows_pass(df, [id_col, text_col], f"{id_col} {dict(df.dtypes)[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
