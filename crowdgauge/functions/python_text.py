"""Arrow-batched Python helpers for what Spark has no expression for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# Text made only of these characters is already in its compatibility form.
STABLE = "^[\\x00-\\x7FÀ-ÖØ-öø-ÿ一-鿿、-】ぁ-ん]*$"


def nfkc(c) -> Column:
    """Exact NFKC. Only rows that can change are sent to Python; the rest pass as NULL."""

    def run(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")

    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    udf = F.pandas_udf(run, StringType())
    return F.coalesce(udf(F.when(~text.rlike(STABLE), text)), text)


def simhash64(c, unit: str = "char", size: int = 2, digest: str = "blake2b") -> Column:
    """64-bit similarity fingerprint as a signed bigint.

    The input is text already passed through ``norm_for_hash`` (``unit='char'``) or
    lower-cased text split on non-alphanumerics (``unit='word'``). Each distinct gram is
    hashed once and votes with its multiplicity, so a long text costs its vocabulary.
    Empty text gives 0.
    """

    def run(values: pd.Series) -> pd.Series:
        import hashlib
        import re
        from collections import Counter

        import numpy as np

        word = re.compile(r"[0-9a-z一-鿿]+")

        def code(gram: str) -> bytes:
            raw = gram.encode("utf-8")
            if digest == "blake2b":
                return hashlib.blake2b(raw, digest_size=8).digest()
            return hashlib.md5(raw).digest()[:8]

        def one(text) -> int:
            parts = word.findall(text or "") if unit == "word" else (text or "")
            if not parts:
                return 0
            if unit == "word":
                n = max(len(parts) - size + 1, 1)
                grams = Counter(" ".join(parts[i:i + size]) for i in range(n))
            else:
                n = max(len(parts) - size + 1, 1)
                grams = Counter(parts[i:i + size] for i in range(n))
            bits = np.unpackbits(
                np.frombuffer(b"".join(code(g) for g in grams), dtype=np.uint8).reshape(-1, 8), axis=1
            ).astype(np.int64)
            weight = np.fromiter(grams.values(), dtype=np.int64, count=len(grams))
            votes = (bits * 2 - 1).T @ weight
            return int(np.packbits(votes > 0).view(">u8")[0].astype(np.int64))

        return values.map(one).astype("int64")

    return F.pandas_udf(run, LongType())(F.col(c) if isinstance(c, str) else c)
