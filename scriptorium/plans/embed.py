"""Embedding backfill: providers, and the batch job over pending chunks."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.text import contextual_header

Embedder = Callable[[list[str]], list[list[float]]]
PROVIDER_URLS = {
    "openai": "https://api.openai.com/v1/embeddings",
    "ollama": "http://localhost:11434/api/embed",
}


def http_embedder(provider: str, model: str, api_key: str | None = None, url: str | None = None, timeout: int = 120) -> Embedder:
    """An embedding service in either of the two common wire formats."""
    endpoint = url or PROVIDER_URLS.get(provider)
    if endpoint is None:
        raise ValueError(f"provider {provider!r} needs a url")
    headers = {"Content-Type": "application/json"}
    if api_key and provider != "ollama":
        headers["Authorization"] = f"Bearer {api_key}"

    def embed(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": texts}).encode()
        request = urllib.request.Request(endpoint, data=body, headers=headers, method="POST")
        with urllib.request.urlopen(request, timeout=timeout) as response:
            data = json.loads(response.read())
        return data["embeddings"] if provider == "ollama" else [item["embedding"] for item in data["data"]]

    return embed


def pool_tokens(states: np.ndarray, mask: np.ndarray, dim: int) -> np.ndarray:
    """Masked mean over tokens, unit length, cut to ``dim``, unit length again."""
    weights = mask[:, :, None].astype(np.float32)
    mean = (states * weights).sum(axis=1) / np.clip(weights.sum(axis=1), 1e-9, None)

    def unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.clip(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12, None)

    return unit(unit(mean)[:, :dim])


def onnx_embedder(model_dir: str, dim: int = 384, max_tokens: int = 512) -> Embedder:
    """A local model from ``tokenizer.json`` and ``model.onnx``; each Python
    worker loads it once."""
    loaded: dict = {}

    def embed(texts: list[str]) -> list[list[float]]:
        if not loaded:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(f"{model_dir}/tokenizer.json")
            tokenizer.enable_padding()
            tokenizer.enable_truncation(max_length=max_tokens)
            options = onnxruntime.SessionOptions()
            options.inter_op_num_threads = options.intra_op_num_threads = 1
            session = onnxruntime.InferenceSession(f"{model_dir}/model.onnx", sess_options=options)
            loaded.update(tokenizer=tokenizer, session=session, inputs=[i.name for i in session.get_inputs()])
        encoded = loaded["tokenizer"].encode_batch(texts)
        ids = np.array([e.ids for e in encoded], dtype=np.int64)
        mask = np.array([e.attention_mask for e in encoded], dtype=np.int64)
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        states = loaded["session"].run(None, {n: given[n] for n in loaded["inputs"]})[0]
        return pool_tokens(states, mask, dim).tolist()

    return embed


def onnx_pair_scorer(model_dir: str, max_tokens: int = 512) -> Callable[[list[str], list[str]], list[float]]:
    """A local cross-encoder as the pair scorer of ``rerank``."""
    loaded: dict = {}

    def score(queries: list[str], passages: list[str]) -> list[float]:
        if not queries:
            return []
        if not loaded:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(f"{model_dir}/tokenizer.json")
            tokenizer.enable_padding()
            tokenizer.enable_truncation(max_length=max_tokens)
            session = onnxruntime.InferenceSession(f"{model_dir}/model.onnx")
            loaded.update(tokenizer=tokenizer, session=session, inputs=[i.name for i in session.get_inputs()])
        encoded = loaded["tokenizer"].encode_batch(list(zip(queries, passages)))
        given = {
            "input_ids": np.array([e.ids for e in encoded], dtype=np.int64),
            "attention_mask": np.array([e.attention_mask for e in encoded], dtype=np.int64),
            "token_type_ids": np.array([e.type_ids for e in encoded], dtype=np.int64),
        }
        return loaded["session"].run(None, {n: given[n] for n in loaded["inputs"]})[0].reshape(len(queries), -1)[:, 0].tolist()

    return score


def embed_chunks(chunks: DataFrame, embedder: Embedder, batch_size: int = 50) -> DataFrame:
    """(file_path, chunk_index, embedding, failed) of the given chunks.

    A batch that fails marks its own rows only; they stay pending.
    """
    header = contextual_header(F.col("file_path"), F.col("title"))
    texts = chunks.select("file_path", "chunk_index", F.concat(header, "content").alias("text"))
    schema = T.StructType(
        [
            T.StructField("file_path", T.StringType()),
            T.StructField("chunk_index", T.IntegerType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("failed", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                try:
                    vectors = [list(map(float, v)) for v in embedder(part["text"].tolist())]
                except Exception:
                    vectors = [None] * len(part)
                yield part[["file_path", "chunk_index"]].assign(embedding=vectors, failed=[v is None for v in vectors])

    return texts.mapInPandas(run, schema)
