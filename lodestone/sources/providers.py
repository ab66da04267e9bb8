"""Embedding and context providers: a registry, retries, HTTP clients and a local embedder."""

from __future__ import annotations

import hashlib
import json
import logging
import math
import re
import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.context import fallback_context, full_context, parse_context, prompt
from ..schema import Config

log = logging.getLogger("lodestone")

#: Seconds before each further try, and until a request is given up.
WAITS, EMBED_TIMEOUT, CONTEXT_TIMEOUT = (1, 2, 4), 30, 60


#: Texts of a batch that are taken out of it and embedded before the next ones.
TEXTS = 256


class EmbeddingProvider(Protocol):
    def embed(self, text: str) -> list[float]: ...


class ContextProvider(Protocol):
    def answer(self, prompt: str) -> str: ...


def passing(error: BaseException) -> bool:
    """Whether a failure may pass: HTTP 500, a reset or a timeout."""
    if isinstance(error, HTTPError):
        return error.code == 500
    if isinstance(error, URLError):
        return isinstance(error.reason, ConnectionResetError | TimeoutError)
    return isinstance(error, ConnectionResetError | TimeoutError)


def retrying(call: Callable[[], object], waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> object:
    """call(), tried again after each wait if its failure may pass."""
    for wait in (*waits, None):
        try:
            return call()
        except Exception as e:
            if wait is None or not passing(e):
                raise
            sleep(wait)
    raise AssertionError


def post(url: str, body: Mapping[str, object], timeout: float, key: str = "") -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urlopen(Request(url, json.dumps(body).encode(), headers), timeout=timeout) as r:
        return json.loads(r.read())


def embedding_of(answer: Mapping) -> list[float]:
    """The vector in any of the three shapes of answer."""
    for found in (((answer.get("data") or [{}])[0] or {}).get("embedding"), answer.get("embedding"), (answer.get("embeddings") or [None])[0]):
        if found:
            return [float(x) for x in found]
    raise ValueError("the answer has no embedding")


class HashingEmbedder:
    """Deterministic and local: signed counts of hashed words and their trigrams, of length 1."""

    def __init__(self, dimensions: int = 256) -> None:
        self.dimensions = dimensions

    def embed(self, text: str) -> list[float]:
        out = [0.0] * self.dimensions
        for word in re.findall(r"\w+", text.lower()):
            for part in (word, *(word[i : i + 3] for i in range(len(word) - 2))):
                h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "big")
                out[(h >> 1) % self.dimensions] += 1.0 if h & 1 else -1.0
        size = math.sqrt(sum(x * x for x in out))
        return [x / size for x in out] if size else out


class OllamaEmbedder:
    def __init__(self, url: str, model: str, keep_alive: str = "5m") -> None:
        self.url, self.model, self.keep_alive = url.rstrip("/"), model, keep_alive

    def embed(self, text: str) -> list[float]:
        body = {"model": self.model, "prompt": text, "keep_alive": self.keep_alive}
        return embedding_of(retrying(lambda: post(f"{self.url}/api/embeddings", body, EMBED_TIMEOUT)))


class CustomEmbedder:
    """An OpenAI-style server at /v1/embeddings or, if that request fails in any way, a plain one at
    /embeddings, which takes the text alone. Both are tried again if the second failure may pass."""

    def __init__(self, url: str, model: str, key: str = "") -> None:
        self.url, self.model, self.key = url.rstrip("/"), model, key

    def embed(self, text: str) -> list[float]:
        def ask() -> dict:
            try:
                return post(f"{self.url}/v1/embeddings", {"model": self.model, "input": text}, EMBED_TIMEOUT, self.key)
            except Exception:
                return post(f"{self.url}/embeddings", {"text": text}, EMBED_TIMEOUT, self.key)

        return embedding_of(retrying(ask))


class OllamaContext:
    def __init__(self, url: str, model: str, keep_alive: str = "5m") -> None:
        self.url, self.model, self.keep_alive = url.rstrip("/"), model, keep_alive

    def answer(self, text: str) -> str:
        body = {"model": self.model, "prompt": text, "stream": False, "keep_alive": self.keep_alive, "options": {"temperature": 0.3, "top_p": 0.9}}
        return str(retrying(lambda: post(f"{self.url}/api/generate", body, CONTEXT_TIMEOUT))["response"])


class CustomContext:
    def __init__(self, url: str, model: str, key: str = "") -> None:
        self.url, self.model, self.key = url.rstrip("/"), model, key

    def answer(self, text: str) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": text}], "temperature": 0.3, "max_tokens": 500}
        found = retrying(lambda: post(f"{self.url}/v1/chat/completions", body, CONTEXT_TIMEOUT, self.key))
        choice = found["choices"][0]
        return str(choice["message"]["content"] if "message" in choice else choice["text"])


EMBEDDERS: dict[str, Callable[..., EmbeddingProvider]] = {"hashing": HashingEmbedder, "ollama": OllamaEmbedder, "custom": CustomEmbedder}
CONTEXTS: dict[str, Callable[..., ContextProvider]] = {"ollama": OllamaContext, "custom": CustomContext}


def embedder_of(config: Config) -> EmbeddingProvider:
    return EMBEDDERS[config.embedding_provider](**config.embedding_options)


def context_of(config: Config) -> ContextProvider | None:
    """The configured provider of contexts; None if contexts aren't wanted."""
    wanted = config.enable_context and config.context_provider != "none"
    return CONTEXTS[config.context_provider](**config.context_options) if wanted else None


def _each(call: Callable[[object], object], items: Iterable, at_a_time: int, what: str) -> list:
    """call(item) of each, None where it fails; at_a_time of them at once."""

    def one(x: object) -> object:
        try:
            return None if x is None else call(x)
        except Exception as e:
            log.warning("%s failed: %s", what, e)
            return None

    items, began = list(items), time.perf_counter()
    if at_a_time == 1 or len(items) < 2:
        out = list(map(one, items))
    else:
        with ThreadPoolExecutor(min(at_a_time, len(items))) as pool:
            out = list(pool.map(one, items))
    log.debug("%s: %d in %.3f s, %.4f s each", what, len(items), took := time.perf_counter() - began, took / max(1, len(items)))
    return out


def ping(provider: EmbeddingProvider | ContextProvider) -> bool:
    """Whether a provider answers at all."""
    try:
        return bool(provider.embed("test") if hasattr(provider, "embed") else provider.answer("test"))
    except Exception:
        return False


def _embedded(provider: EmbeddingProvider, batches: Iterable[pa.Array], at_a_time: int, failed: Accumulator | None) -> Iterator[pa.Array]:
    """The embeddings of arrays of texts, of which few at a time are Python strings beside the array."""
    for b in batches:
        for at in range(0, len(b), TEXTS):
            out = _each(provider.embed, b.slice(at, TEXTS).to_pylist(), at_a_time, "embedding")
            if failed is not None:
                failed.add(sum(x is None for x in out))
            yield pa.array(out, pa.list_(pa.float32()))


def embed_column(provider: EmbeddingProvider, text: Column, at_a_time: int = 1, failed: Accumulator | None = None) -> Column:
    """The embedding of a column of texts, null where the provider fails; Arrow batches, of whose texts
    at_a_time are sent at once. Not deterministic to Spark, so no plan asks twice for a row. failed: counts the
    texts that could not be embedded; a task that Spark runs again counts them again."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _embedded(provider, batches, at_a_time, failed)

    return run.asNondeterministic()(text)


def enrich(chunks: DataFrame, provider: ContextProvider, template: str = "", at_a_time: int = 1) -> DataFrame:
    """chunks with a context column, from the provider's answers or, where it fails, what stands in.

    A column related, an array of structs with file_path, language and content, goes into the prompts."""
    names = ["file_path", "start_line", "end_line", "content", "language", *(["related"] if "related" in chunks.columns else [])]

    def answer(r: dict) -> str:
        near = r.pop("related", None)
        return provider.answer(prompt(r, template, [] if near is None else list(near)))

    @F.pandas_udf("string")
    def ask(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(_each(answer, rows.to_dict("records"), at_a_time, "context"), dtype=object)

    asked = chunks.withColumn("answer_", ask.asNondeterministic()(F.struct(*names)))
    own = {k: F.col(k) for k in ("file_path", "function_name", "class_name", "content", "start_line", "end_line")}
    parsed = parse_context(F.col("answer_"))
    fields = {k: parsed[k] for k in ("summary", "purpose", "related_concepts", "usage_patterns", "dependencies")}
    made = F.struct(*[c.alias(k) for k, c in fields.items()], full_context(own, fields).alias("full_context"))
    return asked.withColumn("context", F.when(F.col("answer_").isNotNull(), made).otherwise(fallback_context(own))).drop("answer_")
