"""What callers can bring: tokenisers, embedders, language models, sinks of progress; and how one is
chosen among several."""

from __future__ import annotations

import json
import queue
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from threadmill.functions import text as X


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


LlmBackend = Callable[[str, str], str]
Tokenizer = Callable[[Column], Column]
KEPT_TAGS = ("NNG", "NNP", "NNB", "VV", "VA", "SL")
_tokenizers: dict[str, Tokenizer] = {"words": X.tokens}


def register_tokenizer(name: str, factory: Callable[[], Callable[[str], list[tuple[str, str]]]], tags: tuple[str, ...] = KEPT_TAGS) -> None:
    """Adds a morphological tokeniser: the factory, called once in each worker, gives a function from a
    text to (form, tag) pairs. Forms of more than one character with a kept tag are tokens, lower-cased;
    a text that fails is split into words."""

    def column(text: Column) -> Column:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            analyse = factory()

            def one(t: str | None) -> list[str] | None:
                if t is None:
                    return None
                try:
                    return [w.lower() for w, tag in analyse(t) if tag in tags and len(w) > 1]
                except Exception:  # noqa: BLE001 - the analyser is the caller's
                    return X.query_tokens(t)

            for s in batches:
                yield s.map(one)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "array<string>")(text)

    _tokenizers[name] = column


def tokenizer(name: str = "words", fallback: tuple[str, ...] = ()) -> tuple[str, Tokenizer]:
    """The tokeniser of that name, else the first of `fallback` that there is, else the one for words; and
    its name."""
    found = next((n for n in (name, *fallback) if n in _tokenizers), "words")
    return found, _tokenizers[found]


def _post(url: str, body: dict[str, Any], key: str | None, timeout: float) -> Any:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as r:
        return json.load(r)


def http_embedder(url: str, model: str, key: str | None = None, timeout: float = 60) -> Embedder:
    """A server that takes {model, input: [...]} and answers {embeddings: [[...]]} or {data: [{embedding}]}."""

    def run(texts: list[str]) -> list[list[float]]:
        said = _post(url, {"model": model, "input": texts}, key, timeout)
        found = said["embeddings"] if "embeddings" in said else [x["embedding"] for x in sorted(said["data"], key=lambda x: x.get("index", 0))]
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return found

    return run


def single_http_embedder(url: str, model: str, key: str | None = None, timeout: float = 60) -> Embedder:
    """A server that takes one {model, prompt} at a time and answers {embedding: [...]}."""
    return lambda texts: [_post(url, {"model": model, "prompt": t}, key, timeout)["embedding"] for t in texts]


def onnx_embedder(folder: str, max_tokens: int = 512) -> Embedder:
    """A model on the machine: model.onnx and tokenizer.json in a folder that all machines have; the mean
    of the token vectors that aren't padding, at unit length. Loaded once in each worker."""
    loaded: dict[str, Any] = {}

    def run(texts: list[str]) -> list[list[float]]:
        import numpy as np

        if not loaded:
            import onnxruntime
            from tokenizers import Tokenizer as Words

            loaded["words"], loaded["model"] = Words.from_file(f"{folder}/tokenizer.json"), onnxruntime.InferenceSession(f"{folder}/model.onnx", providers=["CPUExecutionProvider"])
            loaded["words"].enable_truncation(max_tokens)
            loaded["words"].enable_padding()
        told = loaded["words"].encode_batch(list(texts))
        given = {"input_ids": [t.ids for t in told], "attention_mask": [t.attention_mask for t in told], "token_type_ids": [t.type_ids for t in told]}
        wanted = {i.name for i in loaded["model"].get_inputs()}
        (out, *_) = loaded["model"].run(None, {k: np.array(v, dtype=np.int64) for k, v in given.items() if k in wanted})
        return mean_pool(out, np.array(given["attention_mask"])).tolist()

    return run


def mean_pool(vectors: Any, mask: Any) -> Any:
    """Means over the tokens whose mask isn't 0, at unit length; zeros where there are none."""
    import numpy as np

    m = (np.asarray(mask) != 0)[:, :, None]
    total = (np.asarray(vectors) * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1)
    n = np.linalg.norm(total, axis=1, keepdims=True)
    return total / np.where(n > 0, n, 1)


@dataclass
class Prefixed:
    """An embedder whose model wants a word before queries and another before passages."""

    embedder: Embedder
    query: str = ""
    passage: str = ""

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return self.embedder([self.passage + t for t in texts])

    def embed_query(self, text: str) -> list[float]:
        return self.embedder([self.query + text])[0]


def embed_query(embedder: Embedder, text: str) -> list[float]:
    return embedder.embed_query(text) if isinstance(embedder, Prefixed) else embedder([text])[0]


def choose_embedder(preferred: str, factories: dict[str, Callable[[], Embedder]], fallback: tuple[str, ...] = ()) -> tuple[str, Embedder] | None:
    """The first of `preferred` and `fallback` whose factory works and which embeds a probe; None where
    none does, and search then goes by words alone. "none" asks for that."""
    for name in (preferred, *fallback):
        if name == "none":
            return None
        try:
            made = factories[name]()
            if len(embed_query(made, "probe")) > 0:
                return name, made
        except Exception:  # noqa: BLE001, S112 - one that can't be used is passed over for the next
            continue
    return None


@dataclass
class Models:
    """Lists of models by backend: what was asked for less than `ttl` ago, else what the backend says, else
    a list that is given; with the word for which of these it was."""

    ttl: timedelta = timedelta(seconds=3600)
    known: dict[str, tuple[datetime, list[str]]] = field(default_factory=dict)

    def list(self, backend: str, fetch: Callable[[], list[str]] | None, fallback: list[str], now: datetime, force: bool = False) -> tuple[list[str], str]:
        at, names = self.known.get(backend, (None, []))
        if not force and at is not None and now - at < self.ttl:
            return names, "cached"
        try:
            names = list(fetch()) if fetch is not None else []
        except Exception:  # noqa: BLE001 - the backend is the caller's; the given list stands in
            names = []
        if not names:
            return list(fallback), "fallback"
        self.known[backend] = (now, names)
        return names, "dynamic"


class Channel:
    """Progress for several listeners: each has the last `size` events that it hasn't taken; older ones
    give way."""

    def __init__(self, size: int = 64) -> None:
        self.size, self.listeners = size, []

    def listen(self) -> queue.Queue[tuple[str, int]]:
        self.listeners.append(queue.Queue(self.size))
        return self.listeners[-1]

    def __call__(self, phase: str, n: int) -> None:
        for q in self.listeners:
            while True:
                try:
                    q.put_nowait((phase, n))
                    break
                except queue.Full:
                    q.get_nowait()


def server_sent(events: queue.Queue[tuple[str, int]]) -> Iterator[str]:
    """The waiting events as text/event-stream."""
    while True:
        try:
            phase, n = events.get_nowait()
        except queue.Empty:
            return
        yield f"event: progress\ndata: {json.dumps({'phase': phase, 'n': n})}\n\n"


def ask(prompts: DataFrame, backend: LlmBackend, system: str = "") -> DataFrame:
    """(id, answer, error) of prompts (id, prompt): one call each on the executors; a call that fails
    gives its error and no answer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for i, p in zip(pdf["id"], pdf["prompt"], strict=True):
                try:
                    rows.append((i, backend(system, p), None))
                except Exception as e:  # noqa: BLE001 - told in the row
                    rows.append((i, None, str(e)[:300]))
            yield pd.DataFrame(rows, columns=["id", "answer", "error"])

    return prompts.select(F.col("id").cast("string").alias("id"), "prompt").mapInPandas(run, "id string, answer string, error string")


class Progress(StreamingQueryListener):
    """Hands the rows of each batch of a stream to a sink, as (phase, rows) events."""

    def __init__(self, sink: Callable[[str, int], None]) -> None:
        self.sink = sink

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.sink("started", 0)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.sink("progress", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.sink("failed" if event.exception else "done", 0)
