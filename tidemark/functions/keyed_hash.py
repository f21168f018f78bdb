"""Keyed hashes that Spark lacks, by the standard library in Arrow batches."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import functions as F


def hmac_sha256(key: str):
    """A function of a text column: the HMAC-SHA256 under the key, in lowercase hex; null stays null."""

    @F.pandas_udf("string")
    def sign(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest())

    return sign


def hkdf_sha256(context: str, length: int = 32):
    """A function of two text columns, secret and salt: HKDF-SHA256 (extract, then expand) in lowercase hex."""

    @F.pandas_udf("string")
    def derive(secret: pd.Series, salt: pd.Series) -> pd.Series:
        def one(s: str | None, n: str | None) -> str | None:
            if s is None or n is None:
                return None
            key, out, block, i = hmac.new(n.encode(), s.encode(), hashlib.sha256).digest(), b"", b"", 1
            while len(out) < length:
                block = hmac.new(key, block + context.encode() + bytes([i]), hashlib.sha256).digest()
                out, i = out + block, i + 1
            return out[:length].hex()

        return pd.Series([one(s, n) for s, n in zip(secret, salt, strict=True)])

    return derive


def pbkdf2_verify(rounds: int = 200_000):
    """A function of password, salt and stored hex digest: whether they belong together."""

    @F.pandas_udf("boolean")
    def verify(password: pd.Series, salt: pd.Series, stored: pd.Series) -> pd.Series:
        same = lambda p, s, d: hmac.compare_digest(hashlib.pbkdf2_hmac("sha256", p.encode(), s.encode(), rounds).hex(), d)
        return pd.Series([None not in (p, s, d) and same(p, s, d) for p, s, d in zip(password, salt, stored, strict=True)])

    return verify
