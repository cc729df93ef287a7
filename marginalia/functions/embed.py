"""Sentences to unit vectors. Weights are given by path, never shipped; without them the judging degrades to phrases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import lexicon as L

#: Tokens that a model reads at most, and sentences in one of its batches.
TOKENS, CHUNK = 256, 32


def clip(text: str, most: int = L.CLIP_BYTES) -> str:
    """At most so many bytes, cut between characters."""
    raw = text.encode("utf-8", "replace")
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore")


def embed(text: Column, model: str, tokenizer: str) -> Column:
    """Vectors by an ONNX model and a tokenizer file: clipped, the mean over the tokens that aren't padding, at length 1.
    Each worker opens the model once; batches are sorted by length, which no result depends on."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        import onnxruntime
        from tokenizers import Tokenizer

        session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        own = Tokenizer.from_file(tokenizer)
        own.enable_truncation(TOKENS)
        own.enable_padding()
        wanted = {i.name for i in session.get_inputs()}
        for batch in batches:
            texts = [clip(t or "") for t in batch]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i].encode()))
            out: list = [None] * len(texts)
            for at in range(0, len(order), CHUNK):
                part = order[at : at + CHUNK]
                encoded = own.encode_batch([texts[i] for i in part])
                mask = np.array([e.attention_mask for e in encoded], np.int64)
                given = {"input_ids": np.array([e.ids for e in encoded], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
                hidden = session.run(None, {k: v for k, v in given.items() if k in wanted})[0].astype(np.float64)
                mean = (hidden * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1), 1)[:, None]
                size = np.linalg.norm(mean, axis=1, keepdims=True)
                for i, v in zip(part, np.where(size > 0, mean / np.where(size > 0, size, 1), mean)):
                    out[i] = v.astype(np.float32).tolist()
            yield pd.Series(out)

    return run(text)
