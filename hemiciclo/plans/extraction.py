"""Reviewable candidates from texts: user regexes, and user models over character windows. A candidate is never a fact: its status is review_required."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemiciclo.functions.ids import short_id
from hemiciclo.operators.windows import char_windows

REVIEW = "review_required"


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    flags: int = 0
    group: int = 0


@dataclass(frozen=True)
class Task:
    """What is asked of a model, and its bounds."""

    name: str
    instructions: str = ""
    size: int = 24_000
    overlap: int = 500
    most: int = 100

    def __post_init__(self):
        if not 0 <= self.overlap < self.size <= 32_000 or self.most < 1:
            raise ValueError("0 <= overlap < size <= 32000, most >= 1")


class Registry:
    """Named extractors and models; a name is taken once, reserved names never."""

    def __init__(self, reserved: Sequence[str] = ("regex",)):
        self._made: dict[str, Callable] = {}
        self._reserved = frozenset(reserved)

    def register(self, name: str, backend: Callable) -> None:
        if name in self._reserved or name in self._made:
            raise ValueError(f"{name} is taken")
        if not callable(backend):
            raise TypeError("a backend is a callable")
        self._made[name] = backend

    def get(self, name: str) -> Callable:
        if name not in self._made:
            raise LookupError(f"no backend {name}; there are {sorted(self._made)}")
        return self._made[name]

    def names(self) -> list[str]:
        return sorted(self._made)


_SPANS = pa.list_(pa.struct([("rule", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def regex_candidates(texts: DataFrame, rules: Sequence[Rule], *, key: str, text: str = "text") -> DataFrame:
    """A row a match of each rule: candidate_id, rule, value, start and end (code points, 0-based, half open), confidence 1, evidence of 80 characters around."""
    compiled = [(r.name, re.compile(r.pattern, r.flags), r.group) for r in rules]

    @F.arrow_udf("array<struct<rule: string, value: string, start: int, end: int>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[{"rule": n, "value": m[g], "start": m.start(g), "end": m.end(g)} for n, p, g in compiled for m in p.finditer(t or "") if m[g] is not None] for t in batch.to_pylist()], _SPANS)

    from hemiciclo.functions.text import evidence_window

    rows = texts.select(key, text, F.explode(spans(F.col(text))).alias("c")).select(key, text, "c.*")
    return rows.select(
        short_id(F.col(key).cast("string"), F.col("rule"), F.col("start").cast("string"), F.col("end").cast("string")).alias("candidate_id"), key, "rule", "value", "start", "end",
        F.lit(1.0).alias("confidence"), F.lit(False).alias("inferred"), F.lit(REVIEW).alias("status"), evidence_window(F.col(text), F.col("start"), F.col("end")).alias("evidence"),
    )


def parse_envelope(raw) -> list[dict]:
    """The candidates of a model's answer (a mapping, JSON text or bytes); anything else is an error."""
    if isinstance(raw, (bytes, bytearray)):
        raw = raw.decode()
    data = json.loads(raw) if isinstance(raw, str) else raw
    if not isinstance(data, Mapping) or not isinstance(data.get("candidates"), list):
        raise ValueError("an answer holds a list of candidates")
    out = []
    for c in data["candidates"]:
        if not isinstance(c.get("kind"), str) or not isinstance(c.get("value"), str):
            raise ValueError("a candidate has a kind and a value")
        confidence = c.get("confidence")
        if confidence is not None and not 0 <= float(confidence) <= 1:
            raise ValueError("confidence lies between 0 and 1")
        out.append({"kind": c["kind"], "value": c["value"], "quote": c.get("quote"), "confidence": None if confidence is None else float(confidence)})
    return out


def quote_spans(text: str, quote: str | None) -> list[tuple[int, int]]:
    """Where a quote stands, without overlaps."""
    spans, at = [], 0
    while quote and (at := text.find(quote, at)) >= 0:
        spans.append((at, at + len(quote)))
        at += len(quote)
    return spans


_FOUND = "kind string, value string, confidence double, start long, end long, literal boolean, error string"


def model_candidates(texts: DataFrame, task: Task, backends: Sequence[Callable[[Task, str], object]], *, key: str, text: str = "text") -> DataFrame:
    """Candidates of each text's windows, grouped by kind and value with their different pieces of evidence.

    The first backend that answers counts; a window for which none does leaves a row with `error`. A quote that is
    not in the text leaves one piece of evidence that is not literal, with no place.
    """
    windows = char_windows(texts.select(key, text), text, size=task.size, overlap=task.overlap, most=task.most).select(key, "start", "piece")
    kind = dict(windows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, offset, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                error = "no backend"
                for backend in backends:
                    try:
                        found = parse_envelope(backend(task, piece))
                    except Exception as e:  # whatever a backend raises, the next one is asked
                        error = f"{type(e).__name__}: {e}"
                        continue
                    error = None
                    for c in found:
                        spans = quote_spans(piece, c["quote"])
                        rows += [(k, c["kind"], c["value"], c["confidence"], offset + a, offset + b, True, None) for a, b in spans] or [(k, c["kind"], c["value"], c["confidence"], None, None, False, None)]
                    break
                if error:
                    rows.append((k, None, None, None, None, None, False, error))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[key, "kind", "value", "confidence", "start", "end", "literal", "error"])

    found = windows.mapInArrow(run, f"`{key}` {kind}, {_FOUND}")
    evidence = F.array_sort(F.collect_set(F.when(F.col("error").isNull(), F.struct("start", "end", "literal"))))
    return found.groupBy(key, "kind", "value", "error").agg(F.max("confidence").alias("confidence"), evidence.alias("evidence")).withColumn("status", F.lit(REVIEW))


def entity_backend(pipeline: Callable[[str], object], labels: Sequence[str] = ()) -> Callable[[Task, str], dict]:
    """A backend of a named-entity pipeline: its document has `ents` with `text` and `label_`; other labels than the wanted ones go."""

    def backend(task: Task, text: str) -> dict:
        return {"candidates": [{"kind": e.label_, "value": e.text, "quote": e.text, "confidence": None} for e in pipeline(text).ents if not labels or e.label_ in labels]}

    return backend


def generative_backend(generate: Callable[[str, str], str], kind: str = "text") -> Callable[[Task, str], dict]:
    """A backend of a model that answers in free text: never literal, as nothing says where in the source it stands."""

    def backend(task: Task, text: str) -> dict:
        return {"candidates": [{"kind": kind, "value": line, "quote": None, "confidence": None} for line in generate(task.instructions, text).splitlines() if line.strip()]}

    return backend


#: What a provider's answer must look like.
ANSWER_SCHEMA = {
    "type": "object", "required": ["candidates"], "additionalProperties": False,
    "properties": {"candidates": {"type": "array", "items": {"type": "object", "required": ["kind", "value"], "properties": {"kind": {"type": "string"}, "value": {"type": "string"}, "quote": {"type": ["string", "null"]}, "confidence": {"type": ["number", "null"], "minimum": 0, "maximum": 1}}}}},
}


def provider_backend(call: Callable[[str, str, dict], object], model: str) -> Callable[[Task, str], object]:
    """A backend of a provider's client: `call(model, prompt, schema)` answers as JSON; the client and its key are the caller's."""

    def backend(task: Task, text: str) -> object:
        return call(model, f"{task.instructions}\n\n{text}", ANSWER_SCHEMA)

    return backend


def discover(registry: Registry, group: str) -> list[str]:
    """Registers the backends that installed packages name as entry points of `group`; returns their names. One that cannot be loaded is an error."""
    from importlib.metadata import entry_points

    found = sorted(entry_points(group=group), key=lambda e: e.name)
    for e in found:
        registry.register(e.name, e.load())
    return [e.name for e in found]
