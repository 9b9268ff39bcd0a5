"""What no built-in expresses: Unicode decomposition, BLAKE2b hash vectors, ratio of matching blocks. Arrow-batched."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

_WORDS = re.compile(r"[A-Za-z0-9_]+")


@F.pandas_udf(StringType())
def nfkd_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def hash_vector(text: str | None, dimensions: int) -> np.ndarray:
    """Signed token counts at hashed places."""
    vector = np.zeros(dimensions, np.float32)
    for word in _WORDS.findall((text or "").lower()):
        digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
        vector[int.from_bytes(digest[:4], "big") % dimensions] += 1.0 if digest[4] % 2 == 0 else -1.0
    return vector


def hash_vector_udf(text: Column, dimensions: int = 384, normalize: bool = True) -> Column:
    """Hash embedding of a text; with ``normalize`` of unit length (a zero vector stays)."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        rows = []
        for t in texts:
            v = hash_vector(t, dimensions)
            norm = float(np.linalg.norm(v))
            rows.append(v / norm if normalize and norm else v)
        return pd.Series(rows)

    return embed(text)


@F.pandas_udf(DoubleType())
def title_score_udf(query: pd.Series, candidate: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two titles, three places; null if either is missing or empty."""
    score = lambda a, b: round(SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio(), 3) if a and b else None
    return pd.Series([score(a, b) for a, b in zip(query, candidate, strict=True)], dtype="float64")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, inside the JVM; null if either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))
