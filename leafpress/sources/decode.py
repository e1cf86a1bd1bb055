"""Bytes of unknown encoding to text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Tried in this order.
CODES = ("utf-8", "gbk", "hz", "gb18030")


def decode_bytes(raw: Column, codes: tuple[str, ...] = CODES) -> Column:
    """UTF-8 if that comes first and is valid (in the JVM), else the first of the codes that fits."""

    @F.pandas_udf(T.StringType())
    def decoded(raw: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            for code in codes:
                try:
                    return bytes(b).decode(code) if b is not None else None
                except UnicodeDecodeError:
                    continue
            return None

        return raw.map(one)

    if codes[0] != "utf-8":
        return decoded(raw)
    text = F.try_validate_utf8(raw.cast("string"))
    return F.coalesce(text, decoded(F.when(text.isNull(), raw)))
