"""Page texts of documents: injected readers in Arrow batches, the better text of each page, scans, reading order, source maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemiciclo.functions.text import fold, page_quality, squeeze
from hemiciclo.operators.filters import needs_ocr

#: Readers whose texts agree less than this disagree; an agreement that vouches for a page; what is unsafe below.
DISAGREE, VOUCHED, SAFE = 0.85, 0.98, 0.7
_PAGE = "reader string, page int, text string, error string"


def read_pages(objects: DataFrame, readers: Mapping[str, Callable[[bytes], Sequence[str]]], *, key: str = "doc", content: str = "content") -> DataFrame:
    """A row for each page that a reader finds: key, reader, page (from 1), text; a reader that fails leaves one row with its error.

    The readers are the caller's PDF libraries; a NULL content has no pages. One document is in memory at a time.
    """
    kind = dict(objects.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, rows = batch.column(1)[i].as_py(), []
                for name, read in readers.items() if data is not None else ():
                    try:
                        rows += [(name, n, text, None) for n, text in enumerate(read(data), 1)]
                    except Exception as e:  # whatever a reader raises, the others are asked
                        rows.append((name, None, None, f"{type(e).__name__}: {e}"))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                types = [pa.string(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows), pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, "reader", "page", "text", "error"])

    return objects.select(key, content).mapInArrow(run, f"`{key}` {kind}, {_PAGE}")


def literal_text(content: Column) -> Column:
    """What an uncompressed PDF shows by its Tj operators, a line each: the last resort when no reader finds a page."""
    shown = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"\(([^()]*)\)\s*Tj"), F.lit(1))
    return F.array_join(F.filter(F.transform(shown, lambda x: F.trim(x)), lambda x: x != ""), "\n")


def chosen_text(first: Column, second: Column, agreement: Column, names: tuple[str, str]) -> Column:
    """STRUCT<text, method, confidence, issues> of a page that two readers saw: the text of higher quality, the first of equals.

    The confidence is the quality, at most .99 and what the agreement allows; near identity makes it .92 at least.
    """
    a, b = F.coalesce(first, F.lit("")), F.coalesce(second, F.lit(""))
    blank = lambda x: squeeze(x) == ""
    qa, qb = page_quality(a), page_quality(b)
    capped = F.least(F.lit(0.99), F.greatest(qa, qb), F.coalesce(0.55 + 0.45 * agreement, F.lit(0.99)))
    confidence = F.when(blank(a) & blank(b), 0.0).when(agreement >= VOUCHED, F.greatest(capped, F.lit(0.92))).otherwise(capped)
    found = F.array(F.when(agreement < DISAGREE, "disagreement"), F.when(blank(a), f"{names[0]}_empty"), F.when(blank(b), f"{names[1]}_empty"))
    issues = F.when(blank(a) & blank(b), F.array(F.lit("empty_page"))).otherwise(F.array_compact(found))
    method = F.when((qa >= qb) | (blank(a) & blank(b)), names[0]).otherwise(names[1])
    return F.struct(F.when(method == names[0], a).otherwise(b).alias("text"), method.alias("method"), confidence.alias("confidence"), issues.alias("issues"))


def page_texts(objects: DataFrame, first: tuple[str, Callable], second: tuple[str, Callable], scans: DataFrame | None = None, *, key: str = "doc", content: str = "content") -> DataFrame:
    """key, page, text, method, confidence, agreement, issues, unsafe: the better of two readers' texts, and of `scans` (key, page, text, confidence) where that is unsafe.

    A page is unsafe if it has little text that the readers do not share, a confidence below .7, or readers that disagree;
    a scan's text of at least the same quality then replaces it. Documents without a page get one of their literal text.
    """
    from hemiciclo.plans.speech import similarity

    rows = read_pages(objects, dict((first, second)), key=key, content=content).where("error is null")
    side = lambda name, out: rows.where(F.col("reader") == name).select(key, "page", F.col("text").alias(out))
    both = side(first[0], "_a").join(side(second[0], "_b"), [key, "page"], "full_outer")
    same = lambda c: fold(squeeze(F.coalesce(F.col(c), F.lit(""))))
    shared = F.when((same("_a") != "") & (same("_b") != ""), similarity(same("_a"), same("_b")))
    native = both.withColumn("agreement", shared).withColumn("c", chosen_text(F.col("_a"), F.col("_b"), F.col("agreement"), (first[0], second[0])))
    native = native.select(key, "page", "c.*", "agreement")
    rest = objects.join(native.select(key).distinct(), key, "left_anti").select(key, F.lit(1).alias("page"), literal_text(F.col(content)).alias("text"), F.lit("literal").alias("method"), F.lit(0.3).alias("confidence"), F.array(F.lit("literal_fallback")).alias("issues"), F.lit(None).cast("double").alias("agreement"))
    pages = native.unionByName(rest)
    unsafe = (needs_ocr(F.col("text")) & (F.coalesce("agreement", F.lit(0.0)) < 0.95)) | (F.col("confidence") < SAFE) | F.array_contains("issues", "disagreement")
    pages = pages.withColumn("unsafe", unsafe)
    if scans is None:
        return pages
    s = scans.where(squeeze(F.col("text")) != "").select(key, "page", F.col("text").alias("_s"), F.col("confidence").alias("_c"))
    met = pages.join(s, [key, "page"], "left")
    take = F.col("unsafe") & F.col("_s").isNotNull() & (page_quality(F.col("_s")) >= page_quality(F.col("text")))
    pick = lambda yes, no: F.when(take, yes).otherwise(F.col(no)).alias(no)
    return met.select(key, "page", pick(F.col("_s"), "text"), pick(F.lit("scan"), "method"), pick(F.col("_c"), "confidence"), "agreement", pick(F.array(F.lit("scan_selected")), "issues"), F.when(take, F.col("_c") < SAFE).otherwise(F.col("unsafe")).alias("unsafe"))


def document_status(pages: DataFrame, *, key: str = "doc") -> DataFrame:
    """key, pages, status: empty_text without any, needs_review with an unsafe page, else ok."""
    status = F.when(F.count_if(squeeze(F.coalesce("text", F.lit(""))) != "") == 0, "empty_text").when(F.count_if("unsafe") > 0, "needs_review").otherwise("ok")
    return pages.groupBy(key).agg(F.count("*").alias("pages"), status.alias("status"))


def engine_lines(boxes: Column, texts: Column, scores: Column) -> Column:
    """ARRAY<STRUCT<box, text, score>> of an engine's parallel arrays; arrays of different lengths are an error."""
    made = F.transform(F.arrays_zip(boxes.alias("box"), texts.alias("text"), scores.alias("score")), lambda z: F.struct(z["box"].alias("box"), z["text"].alias("text"), z["score"].cast("double").alias("score")))
    return F.when((F.size(boxes) == F.size(texts)) & (F.size(texts) == F.size(scores)), made).otherwise(F.raise_error(F.lit("boxes, texts and scores differ in length")).cast("array<struct<box: array<double>, text: string, score: double>>"))


def reading_order(lines: Column) -> Column:
    """The lines that say something from top to bottom, those of one height from left to right."""
    placed = F.transform(F.filter(lines, lambda x: F.trim(x["text"]) != ""), lambda x: F.struct(x["box"][1].alias("top"), x["box"][0].alias("left"), x["text"].alias("text"), x["score"].alias("score")))
    return F.array_sort(placed)


def gutter(pixels: np.ndarray) -> int | None:
    """The column that parts a grey page (0 black) in two: the middle of a rule, or of the widest blank strip, in its central third; None for one column.

    A rule may lean, so a narrow band counts as inked in a row if any of its pixels is; bands come from running sums.
    """
    height, width = pixels.shape
    if min(height, width) < 100:
        return None
    body = pixels[int(height * 0.1) : int(height * 0.92)]
    left, right, reach = int(width * 0.35), int(width * 0.65), max(4, int(width * 0.004))
    sums = np.cumsum(np.pad(body < 200, ((0, 0), (1, 0))), axis=1)
    centres = np.arange(left + reach, right - reach)
    inked = (sums[:, centres + reach + 1] - sums[:, centres - reach] > 0).mean(axis=0)
    if len(inked) and inked.max() >= max(0.58, 1.35 * np.median(inked)):
        return int(round(float(centres[inked >= 0.995 * inked.max()].mean())))
    blank = (body[:, left:right] < 180).mean(axis=0) < 0.03
    edge = np.diff(np.concatenate([[0], blank.astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begins) or (ends - begins).max() < reach:
        return None
    widest = int((ends - begins).argmax())
    return left + int(begins[widest] + ends[widest]) // 2


def page_regions(pixels: np.ndarray, steps: int = 12) -> list[np.ndarray]:
    """A page's regions in the order they are read: the columns, or a heading over its whole width and the columns below it."""
    height = len(pixels)
    for top in range(0, height * 3 // 4, max(1, height // steps)):
        if (split := gutter(pixels[top:])) is not None:
            return [*([pixels[:top]] if top else []), pixels[top:, :split], pixels[top:, split + 1 :]]
    return [pixels]


def scan_pages(images: DataFrame, engine: Callable[[np.ndarray], tuple[Sequence, Sequence, Sequence]], *, key: str = "doc") -> DataFrame:
    """images: key, page, height, width, pixels (grey, a byte each). key, page, text, confidence (mean score) by the caller's engine, which gives boxes, texts and scores of a region."""
    kind = dict(images.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, means = [], []
            for i in range(batch.num_rows):
                page = np.frombuffer(batch.column(4)[i].as_py(), np.uint8).reshape(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                lines = []
                for region in page_regions(page):
                    boxes, said, scores = engine(region)
                    lines += sorted(((b[1], b[0]), t, s) for b, t, s in zip(boxes, said, scores, strict=True) if t.strip())  # region by region
                texts.append("\n".join(t for _, t, _ in lines))
                means.append(float(np.mean([s for _, _, s in lines])) if lines else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(means)], names=[key, "page", "text", "confidence"])

    return images.select(key, F.col("page").cast("int"), F.col("height").cast("int"), F.col("width").cast("int"), "pixels").mapInArrow(run, f"`{key}` {kind}, page int, text string, confidence double")


def located(source: Column, content: Column) -> Column:
    """STRUCT<start, end> (0-based, half open) of the first place where `source` says `content`, white space of any kind and length being equal; NULL for none."""
    words = F.transform(F.split(squeeze(content), " "), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.array_join(words, r"[\s ]+")
    start = F.regexp_instr(source, pattern)
    return F.when((squeeze(content) != "") & (start > 0), F.struct((start - 1).alias("start"), (start - 1 + F.length(F.regexp_substr(source, pattern))).alias("end")))


def source_map(source: Column, content: Column) -> Column:
    """ARRAY<STRUCT<content_start, content_end, source_start, source_end, kind>>: where each run of `content` stands in the slice `source` that it was squeezed from.

    Runs are words (identity) and the gaps between them (space); a content that is not the squeezed source is an error.
    """
    runs = F.regexp_extract_all(source, F.lit(r"([\s ]+|[^\s ]+)"), F.lit(1))
    item = "struct<content_start: int, content_end: int, source_start: int, source_end: int, kind: string>"
    begin = F.struct(F.array().cast(f"array<{item}>").alias("items"), F.lit(0).alias("c"), F.lit(0).alias("s"))
    last = F.length(content)

    def step(at, run):
        gap = run.rlike(r"^[\s ]")
        shown = F.when(gap, F.when((at["c"] > 0) & (at["c"] < last), 1).otherwise(0)).otherwise(F.length(run))
        made = F.struct(at["c"].alias("content_start"), (at["c"] + shown).alias("content_end"), at["s"].alias("source_start"), (at["s"] + F.length(run)).alias("source_end"), F.when(gap, "space").otherwise("identity").alias("kind"))
        return F.struct(F.when(shown > 0, F.array_append(at["items"], made)).otherwise(at["items"]).alias("items"), (at["c"] + shown).alias("c"), (at["s"] + F.length(run)).alias("s"))

    items = F.aggregate(runs, begin, step, lambda at: at["items"])
    return F.when(squeeze(source) == content, items).otherwise(F.raise_error(F.lit("the slice does not squeeze to the content")).cast(f"array<{item}>"))
