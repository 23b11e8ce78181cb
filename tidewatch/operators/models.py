"""Pluggable model boundaries with deterministic offline defaults, and the generic model stage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors from hashed tokens: equal texts, equal vectors."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return encode


def embed(rows: DataFrame, key: str, text: str, factory: Callable[[], Callable[[list[str]], np.ndarray]], dim: int) -> DataFrame:
    """(key, embedding). The model is made once in each worker; a wrong dimension fails the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for pdf in frames:
            m = encode(pdf[text].fillna("").tolist())
            if m.shape[1] != dim:
                raise ValueError(f"the model returned {m.shape[1]} dimensions, not {dim}")
            yield pd.DataFrame({key: pdf[key], "embedding": list(m)})

    return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, embedding array<float>")


def model_stage(backlog: DataFrame, key: str, prompt: str, client: Callable[[], Callable[[str], str]], parallelism: int = 8) -> DataFrame:
    """(key, raw, status, error): one call for each row; a transport error is a row, other errors fail the task. Write it before it is used twice."""
    kind = dict(backlog.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for pdf in frames:
            out = []
            for k, p in zip(pdf[key], pdf[prompt], strict=True):
                try:
                    out.append((k, call(p), "answered", None))
                except (ConnectionError, TimeoutError) as e:
                    out.append((k, None, "transport_error", str(e)))
            yield pd.DataFrame(out, columns=[key, "raw", "status", "error"])

    return backlog.select(key, prompt).repartition(parallelism).mapInPandas(run, f"{key} {kind}, raw string, status string, error string")


def verify_registered(registry: DataFrame, identity: dict) -> None:
    """The registered row must equal identity in every field; it is never updated."""
    rows = registry.where(F.col("model_id") == identity["model_id"]).limit(2).collect()
    if len(rows) != 1 or any(rows[0][k] != v for k, v in identity.items()):
        raise ValueError("the registered model differs")


def verify_prompt(path_text: str, registered: str) -> None:
    if path_text.encode() != registered.encode():
        raise ValueError("the prompt differs from the registered one")


def single_contract(rows: DataFrame, cols: list[str]) -> tuple:
    found = rows.select(*cols).distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("upstream rows follow no single contract")
    return tuple(found[0])
