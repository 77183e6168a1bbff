"""Quality rules: counts over words and lines, and compression bands.

Compression bands: zstandard ratios (compressed bytes by bytes) of the whole text and of fixed chunks. A text
is rejected if its whole ratio lies outside the band for its length, or if at least half of its chunks lie
outside the chunk band: too low is repetitive, too high is noise such as encoded binary. The limits come from the
ratios of texts labelled good (``fit_bands`` takes them from a table; the defaults are of sf0.1): the upper ones are a tenth above the greatest of a length, the lower ones
a quarter (from 2 KB and for chunks a third) below the least. For 64 KB and more, where no text is labelled, the
least is that of good texts of one language joined. Texts under 256 bytes, where the format's own bytes weigh, are
not judged. Chunks cover the whole text: a tail of less than half a chunk belongs to the chunk before it. A text of less
than half a chunk has no chunks, as the bands for its length judge all of it.

A text is judged by itself, so there is no shuffle and no skew; memory is that of one slice of texts, or of one text that is
longer: some 30 bytes a byte (measured: 0.6 GB for 20 MB).

Nulls: a null text is an empty text (no words, so base_failed). Null ids are kept as rows. Repeated rows are judged
each. Ties: a ratio that equals a limit is inside the band; of equal lines the first is no duplicate. An empty table
gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.frames import small_batches
from noticeflow.llm.textkit import SPACE, Rolling, Slice, column, mix, slices, text_buffers, tidy, valid_windows

MAX_ROWS = 5000  # labelled texts that bands are fitted to
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Bands:
    """(bytes from, lowest ratio, highest ratio), the last that applies counts."""

    whole: tuple[tuple[int, float, float], ...] = field(default=((0, 0.0, 9.0), (256, 0.40, 0.81), (512, 0.38, 0.75), (1024, 0.34, 0.63), (2048, 0.30, 0.57), (4096, 0.28, 0.51), (8192, 0.27, 0.49), (16384, 0.26, 0.48), (65536, 0.23, 0.48)))
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.31, 0.63)
    bad_share: float = 0.5
    level: int = 3


BANDS = Bands()
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, whole_ratio double, n_chunks int, n_bad_chunks int, bands_failed boolean"


def per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return sums[bounds[1:]] - sums[bounds[:-1]]


def base_counts(s: Slice) -> dict[str, np.ndarray]:
    starts, ends, first = s.words()
    buf, bounds = s.buf, s.bounds
    out = {"n_words": np.diff(first), "word_chars": per_doc(((buf & 0xC0) != 0x80) & ~SPACE[buf], bounds), "n_symbols": per_doc(SYMBOL[buf], bounds)}

    # lines: between newlines and document bounds; those with a word that equal an earlier line of the document
    newline = np.flatnonzero(buf == 10)
    begin = np.unique(np.r_[bounds[:-1], newline + 1])
    line_doc = np.searchsorted(bounds, begin, "right") - 1
    ok = line_doc < s.n
    begin, line_doc = begin[ok], line_doc[ok]
    after = np.r_[newline, len(buf)]
    end = np.minimum(after[np.searchsorted(newline, begin)], bounds[line_doc + 1])
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, line_doc = begin[worded], end[worded], line_doc[worded]
    rolling = Rolling(s.byte_codes())
    key = mix(rolling.ranges(begin, end) + mix(line_doc.astype(np.uint64)))
    _, at = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(line_doc, minlength=s.n) - np.bincount(line_doc[at], minlength=s.n)

    # words in windows of three that occur twice or more in the document
    words = rolling.ranges(starts, ends)
    ok = valid_windows(first, 3)
    doc = s.doc_of_word()
    key = mix(Rolling(words, 1).windows(3)[ok] + mix(doc[ok].astype(np.uint64))) if len(ok) else np.zeros(0, np.uint64)
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    again = ok[order[same[1:] | same[:-1]]]
    hit = np.zeros(len(starts) + 2, bool)
    for step in range(3):
        hit[again + step] = True
    out["n_repeat_words"] = per_doc(hit[: len(starts)], first)
    return out


def band(n: int, bands: Bands) -> tuple[float, float]:
    low, high = 0.0, 9.0
    for least, a, b in bands.whole:
        if n >= least:
            low, high = a, b
    return low, high


def compression(text: memoryview, squeeze: zstandard.ZstdCompressor, bands: Bands) -> tuple[float, int, int, bool]:
    """Ratio of the whole text, chunks, chunks outside their band, and the verdict."""
    n = len(text)
    if not n:
        return 0.0, 0, 0, False
    ratio = len(squeeze.compress(text)) / n
    low, high = band(n, bands)
    chunks = (n + bands.chunk_bytes // 2) // bands.chunk_bytes
    bad = 0
    for k in range(chunks):
        part = text[k * bands.chunk_bytes : (k + 1) * bands.chunk_bytes if k < chunks - 1 else n]
        r = ratio if len(part) == n else len(squeeze.compress(part)) / len(part)
        bad += not bands.chunk[0] <= r <= bands.chunk[1]
    return ratio, chunks, bad, not low <= ratio <= high or bool(chunks) and bad >= bands.bad_share * chunks


def measures(docs: DataFrame, bands: Bands = BANDS, text_col: str = "text") -> DataFrame:
    """A row a document with the counts of SCHEMA."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            doc_ids = column(batch, "doc_id")
            for s in slices(data, offsets):
                counts = base_counts(s)
                view = memoryview(np.ascontiguousarray(s.buf))
                zipped = [compression(view[a:b], squeeze, bands) for a, b in zip(s.bounds[:-1], s.bounds[1:], strict=True)]
                ratio, chunks, bad, failed = zip(*zipped, strict=True)
                names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(s.i, s.n), *(pa.array(counts[c].astype(np.int64)) for c in names), pa.array(ratio, pa.float64()), pa.array(chunks, pa.int32()), pa.array(bad, pa.int32()), pa.array(failed)],
                    ["doc_id", *names, "whole_ratio", "n_chunks", "n_bad_chunks", "bands_failed"],
                )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), SCHEMA)


def fit_bands(docs: DataFrame, labels: DataFrame, bands: Bands = BANDS, above: float = 0.1, below: float = 0.25, least: int = 20, max_rows: int = MAX_ROWS) -> Bands:
    """Bands from the ratios of texts labelled good (labels: doc_id, label 1): ``above`` over the greatest of a length, ``below``
    under the least. A length of which fewer than ``least`` such texts are known keeps the limits of ``bands``, as do chunks.

    The ratios of at most max_rows labelled texts, those least by a hash of the id, are taken; the driver gets a row a length.
    """
    good = labels.where("label = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(good), "doc_id")
    steps = [n for n, _, _ in bands.whole]
    size = F.octet_length("text")
    length = F.size(F.filter(F.array(*map(F.lit, steps)), lambda n: n <= size)) - 1
    rows = measures(texts.where(size > 0).select(length.alias("doc_id"), "text"), bands).groupBy("doc_id")  # a row a length
    found = {r["doc_id"]: r for r in rows.agg(F.count("*").alias("n"), F.min("whole_ratio").alias("low"), F.max("whole_ratio").alias("high")).collect()}
    whole = tuple((n, (1 - below) * found[i]["low"], (1 + above) * found[i]["high"]) if i and i in found and found[i]["n"] >= least else (n, a, b) for i, (n, a, b) in enumerate(bands.whole))
    return replace(bands, whole=whole)


def judged(docs: DataFrame, bands: Bands = BANDS, least_words: int = 50, most_repeat_percent: int = 50) -> DataFrame:
    """measures() with base_failed and kept."""
    m = measures(docs, bands)
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    return m.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~F.col("bands_failed"))
