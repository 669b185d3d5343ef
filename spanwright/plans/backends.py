"""The seam to a model: a backend turns requests into responses, DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BackendUnavailable, Misconfigured
from ..operators.joins import lookup_recordings
from ..shipping import ship_package
from ..sources.recordings import described

Transform = Callable[[DataFrame], DataFrame]
Call = Callable[[pd.DataFrame], pd.Series]


@dataclass(frozen=True)
class Backend:
    """What a model can do: requests to requests with ``raw`` (extract), or polls to polls with ``text`` (caption, one subject
    a row; caption_many, all subjects of a poll in one text), or requests to requests with ``p_yes`` (detect)."""

    name: str
    extract: Transform
    caption: Transform | None = None
    caption_many: Transform | None = None
    detect: Transform | None = None
    model: str | None = None
    served_models: Callable[[], list[str]] | None = None
    about: Callable[[], dict] | None = None

    def __call__(self, requests: DataFrame) -> DataFrame:
        return self.extract(requests)

    def able(self, what: str) -> Transform:
        """The named call; a run that needs one the model lacks is refused before it starts."""
        call = getattr(self, what)
        if call is None:
            raise Misconfigured(f"the {self.name} backend cannot {what}")
        return call


    def describe(self) -> dict:
        """The backend's name, whether it is a stub, its model, what it can do, and what it tells of itself."""
        able = [k for k in ("extract", "caption", "caption_many", "detect") if getattr(self, k) is not None]
        return {"backend": self.name, "stub": self.name == "stub", "model": self.model, "able": able} | (self.about() if self.about else {})

    def check(self) -> None:
        """Refuse an endpoint that does not serve the model, to which its answers would be put down."""
        if self.served_models is None:
            return
        try:
            found = self.served_models()
        except Exception as e:
            raise BackendUnavailable(f"the model endpoint cannot be reached: {e}") from e
        if self.model not in found:
            raise BackendUnavailable(f"the endpoint serves {found or 'nothing'}, the model is {self.model}; serve that model, or name one of those")


#: Fixed values of the stub's pattern: how many of 100 requests are silent, and for start, length and confidence the bits of the
#: hash that are dropped first, the number of steps of a hundredth, and the least value.
SEED, SILENT = "vrs", 45
START, LENGTH, CONFIDENCE = (8, 40, 0.0), (16, 35, 0.15), (24, 55, 0.4)


def hash_mod(hexed: Column, dropped_bits: int, modulus: int) -> Column:
    """The number that 40 hex digits spell, without its last bits (whole digits), modulo a small number; eight digits at a time."""
    kept, out = 40 - dropped_bits // 4, F.lit(0).cast("long")
    for at in range(0, kept, 8):
        n = min(8, kept - at)
        out = F.pmod(out * 16**n + F.conv(F.substring(hexed, at + 1, n), 16, 10).cast("long"), F.lit(modulus))
    return out


def stub(seed: str = SEED) -> Backend:
    """Responses from a hash of the request's window and query: the same on every run and engine, and marked as a stub."""

    def respond(requests: DataFrame) -> DataFrame:
        hashed = requests.withColumn("_h", F.sha1(F.concat_ws(":", F.lit(seed), F.col("index").cast("string"), F.col("query")).cast("binary")))
        h = F.col("_h")  # a column of its own, as it is read many times
        part = lambda way: way[2] + hash_mod(h, way[0], way[1]) / 100.0
        span = F.col("end_s") - F.col("start_s")
        start = F.col("start_s") + span * part(START)
        end = F.least(F.col("end_s"), start + span * part(LENGTH))
        told = F.format_string('{"events": [{"start_s": %.3f, "end_s": %.3f, "confidence": %.3f, "evidence": "stub"}]}', start, end, part(CONFIDENCE))
        return hashed.withColumn("raw", F.when(hash_mod(h, 0, 100) < SILENT, '{"events": []}').otherwise(told)).drop("_h").withColumn("stub", F.lit(True))

    return Backend("stub", respond)


def replay(recordings: DataFrame) -> Backend:
    """Responses recorded before, by the whole key, else without the variant."""

    def respond(requests: DataFrame) -> DataFrame:
        whole = ["video", "prompt_variant", "index", "query"]
        return lookup_recordings(requests, recordings, whole, ["video", "index", "query"]).withColumn("stub", F.lit(False))

    def about() -> dict:
        if "read_error" not in recordings.columns:
            return {"recordings": recordings.count()}
        return described(recordings).first().asDict()

    return Backend("replay", respond, about=about)


def answers(call: Call, part: pd.DataFrame, attempts: int, timeout_s: float | None) -> tuple[list, list]:
    """Answers and errors of a batch of rows. A call that fails or takes too long is tried again, then row by row."""
    errors: list[str | None] = []
    for _ in range(attempts):
        pool = ThreadPoolExecutor(1)
        try:
            return list(pool.submit(call, part).result(timeout_s)), [None] * len(part)
        except TimeoutError:
            errors = [f"timeout: no answer within {timeout_s} s"]
        except Exception as e:  # a model's errors are of any kind; they are told in the row
            errors = [f"{type(e).__name__}: {e}"]
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
    if len(part) == 1:
        return [None], errors
    rows = [answers(call, part.iloc[k : k + 1], attempts, timeout_s) for k in range(len(part))]
    return [a for told, _ in rows for a in told], [e for _, bad in rows for e in bad]


def asked(call: Call, answer: str, kind: str, attempts: int = 1, timeout_s: float | None = None) -> Transform:
    """Rows with two columns more: the answer that a function on the executors gives for each batch, and call_error.

    A row whose call fails has no answer and its error, and other rows keep theirs.
    """

    def respond(rows: DataFrame) -> DataFrame:
        ship_package(rows.sparkSession)
        names = rows.columns

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                told, errors = answers(call, part[names], attempts, timeout_s) if len(part) else ([], [])
                yield part[names].assign(**{answer: pd.Series(told, part.index, object), "call_error": pd.Series(errors, part.index, object)})

        fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
        return rows.mapInPandas(ask, f"{fields}, `{answer}` {kind}, call_error STRING").withColumn("stub", F.lit(False))

    return respond


def served(extract: Call, caption: Call | None = None, caption_many: Call | None = None, detect: Call | None = None, model: str | None = None, served_models: Callable[[], list[str]] | None = None, attempts: int = 1, timeout_s: float | None = None) -> Backend:
    """A model behind functions from a batch of rows to their answers, called on the executors."""
    more = {name: asked(call, answer, kind, attempts, timeout_s) for name, call, answer, kind in (("caption", caption, "text", "STRING"), ("caption_many", caption_many, "text", "STRING"), ("detect", detect, "p_yes", "DOUBLE")) if call}
    return Backend("served", asked(extract, "raw", "STRING", attempts, timeout_s), **more, model=model, served_models=served_models)


def detected(requests: DataFrame, backend: Backend, threshold: float = 0.5) -> DataFrame:
    """The requests worth asking about: those that the cheap question is answered to with at least the threshold."""
    return backend.able("detect")(requests).where(F.col("p_yes") >= threshold).select(*requests.columns)


def make_backend(kind: str, recordings: DataFrame | None = None, call: Call | None = None) -> Backend:
    """auto: the served model if there is one, else recordings, else the stub."""
    if kind in ("auto", "served") and call is not None:
        return served(call)
    if kind in ("auto", "replay") and recordings is not None:
        return replay(recordings)
    if kind in ("auto", "stub"):
        return stub()
    raise BackendUnavailable(f"nothing to make a {kind} backend of")
