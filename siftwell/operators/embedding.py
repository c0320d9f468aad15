"""Text to vectors. A provider is anything with ``dimension`` and ``embed(texts)``; it is made once a worker."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import constants as C


class Provider(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Stub:
    """Zeros: every distance is 0. For parity tests."""

    dimension = C.EMBEDDING_DIM

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.zeros((len(texts), self.dimension), np.float32)


class HashedTokens:
    """Signed token hashing, of unit length (a text without tokens stays zero). Not a trained model."""

    def __init__(self, dimension: int = C.EMBEDDING_DIM):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for token in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
            norm = np.linalg.norm(row)
            if norm:
                row /= norm
        return out


class LocalModel:
    """A local sentence model (onnxruntime and tokenizers): masked mean of the last layer, unit length.

    The files' SHA-256 may be pinned; nothing is downloaded.
    """

    def __init__(self, model: str, tokenizer: str, sha256: str | None = None, max_tokens: int = 512, dimension: int = C.EMBEDDING_DIM):
        if sha256 and checksum(model) != sha256:
            raise ValueError(f"{model} is not the pinned file")
        import onnxruntime
        from tokenizers import Tokenizer

        self.dimension = dimension
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # one core a task
        self._session = onnxruntime.InferenceSession(model, options)
        self._tokenizer = Tokenizer.from_file(tokenizer)
        self._tokenizer.enable_truncation(max_tokens)
        self._tokenizer.enable_padding()

    def embed(self, texts: list[str]) -> np.ndarray:
        encoded = self._tokenizer.encode_batch(texts)
        ids, mask = (np.array([getattr(e, n) for e in encoded], np.int64) for n in ("ids", "attention_mask"))
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        hidden = self._session.run(None, {i.name: given[i.name] for i in self._session.get_inputs()})[0]
        mean = (hidden * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        norm = np.linalg.norm(mean, axis=1, keepdims=True)
        return np.where(norm > 0, mean / np.where(norm > 0, norm, 1), mean).astype(np.float32)


def checksum(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def embed(df: DataFrame, make: Callable[[], Provider] = HashedTokens, column: str = "content", batch: int = 32) -> DataFrame:
    """``df`` with its ``embedding`` column set."""
    columns = [f for f in df.schema.fields if f.name != "embedding"]
    schema = T.StructType([*columns, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for rows in batches:
            texts = rows[column].fillna("").tolist()
            found = [v for k in range(0, len(texts), batch) for v in provider.embed(texts[k : k + batch])]
            yield rows.assign(embedding=[v.tolist() for v in found])

    return df.select(*[f.name for f in columns]).mapInPandas(run, schema)
