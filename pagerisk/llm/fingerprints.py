"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to a
wide vector of lanes, and the fingerprint is the sum of these vectors modulo powers
of two. So it does not depend on the order of paragraphs, and paragraphs
can be added to or taken from a fingerprint without the text.

The lanes have two parts. The first, IDENTITY lanes of 16 bits, is an
extendable-output hash of the paragraph: equal sums mean equal multisets. The second, LIKENESS
lanes of 32 bits, is a signed count of the paragraph's 8-byte windows in hashed
places, more than any text has:
the inner product of two such sums estimates the windows the texts share, so the
fingerprints alone tell how alike two texts are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerisk.llm.common import bucket_of, shuffle_parts

IDENTITY, LIKENESS, WINDOW = 256, 256, 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def paragraphs(text: str) -> list[bytes]:
    """The lines of a text; the empty text has none."""
    return text.encode().split(b"\n") if text else []


def state(parts: Iterable[bytes]) -> np.ndarray:
    """The fingerprint of a multiset of paragraphs, as lanes."""
    parts = list(parts)
    lanes = np.zeros(IDENTITY + LIKENESS, np.uint32)
    if not parts:
        return lanes
    digests = b"".join(hashlib.shake_128(p).digest(2 * IDENTITY) for p in parts)
    lanes[:IDENTITY] = np.frombuffer(digests, "<u2").reshape(-1, IDENTITY).sum(axis=0, dtype=np.uint16)
    # Short paragraphs have one window, filled up with zero bytes, so each has a place of its own.
    data = np.frombuffer(b"\n".join(p.ljust(WINDOW, b"\0") for p in parts), np.uint8)
    n = len(data) - WINDOW + 1
    windows = np.ndarray((n,), "<u8", data, 0, (1,))
    ends = np.cumsum([max(len(p), WINDOW) + 1 for p in parts[:-1]], dtype=np.int64) - 1
    place = (windows * _ODD) >> np.uint64(64 - 1 - int(LIKENESS).bit_length() + 1)
    if len(ends):  # no window reaches over the end of its paragraph
        inside = np.ones(n, bool)
        over = (ends[:, None] - np.arange(WINDOW)).ravel()
        inside[over[(over >= 0) & (over < n)]] = False
        place = place[inside]
    signed = np.bincount(place.astype(np.int64), minlength=2 * LIKENESS)
    lanes[IDENTITY:] = (signed[:LIKENESS] - signed[LIKENESS:]).astype(np.uint32)
    return lanes


def _modulo(lanes: np.ndarray) -> np.ndarray:
    lanes[:IDENTITY] &= 0xFFFF
    return lanes


def added(lanes: np.ndarray, parts: Iterable[bytes]) -> np.ndarray:
    return _modulo(lanes + state(parts))


def removed(lanes: np.ndarray, parts: Iterable[bytes]) -> np.ndarray:
    return _modulo(lanes - state(parts))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of the likeness lanes between 0 and 1; exactly 1 for equal fingerprints only."""
    if np.array_equal(a, b):
        return 1.0
    x, y = a[IDENTITY:].view(np.int32).astype(np.float64), b[IDENTITY:].view(np.int32).astype(np.float64)
    size = np.sqrt((x @ x) * (y @ y))
    return float(min(max((x @ y) / size, 0.0), 1 - 1e-9)) if size else 0.0


def text_form(lanes: np.ndarray) -> str:
    return base64.b64encode(lanes[:IDENTITY].astype("<u2").tobytes() + lanes[IDENTITY:].astype("<u4").tobytes()).decode()


def lanes_of(form: str) -> np.ndarray:
    raw = base64.b64decode(form)
    return np.concatenate([np.frombuffer(raw, "<u2", IDENTITY).astype(np.uint32), np.frombuffer(raw, "<u4", LIKENESS, 2 * IDENTITY)])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text; NULL text is empty, rows are handled one by one without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [text_form(state(paragraphs(t or ""))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fingerprint": pa.array(forms, pa.string())})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fingerprint string")


def in_descending_order(docs: DataFrame) -> DataFrame:
    """(part, border, doc_id, text): rows of a part are neighbours in descending order of doc_id.

    The ids are cut into parts at ids that occur; the row of such an id also goes
    to the part above it, marked ``border``, because it follows that part's last
    row. The largest id likewise follows the last row of the lowest part. Rows
    without doc_id come last of all. One shuffle of the texts.
    """
    spark = docs.sparkSession
    n = 4 * shuffle_parts(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # NULL ids stand below all others.
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    found = rows.select(order.alias("o")).agg(
        F.percentile_approx("o", [i / n for i in range(1, n)], 10 * n).alias("cuts"), F.max("o").alias("top"),
    ).first()
    if found["top"] is None:
        return rows.limit(0).selectExpr("0 AS part", "false AS border", "doc_id", "text")
    cuts = sorted({c for c in found["cuts"] if c < found["top"]})
    part = bucket_of(order, cuts)
    # Of several rows with the id of a cut the first in order leads; readers take the first border row.
    above = F.when(order == found["top"], 0).when(order.isin(cuts), part + 1) if cuts else F.when(order == found["top"], 0)
    places = F.array_compact(F.array(F.struct(part.alias("part"), F.lit(False).alias("border")), F.when(above.isNotNull(), F.struct(above.alias("part"), F.lit(True).alias("border")))))
    dealt = rows.select("doc_id", "text", F.inline(places))
    return dealt.select("part", "border", "doc_id", "text").repartition(shuffle_parts(spark), "part").sortWithinPartitions("part", "border", F.desc_nulls_last("doc_id"), "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edits with the next document.

    The next document follows in descending doc_id, the first follows the last;
    rows of one id are ordered by text (NULL first), rows without id come last,
    and a single row follows itself. Of the text's n code points the last
    floor(n / 2) are replaced by the first as many of the next text. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited
    and near_next. NULL text is empty; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, out, size = None, [], 0

        def emit(row, after) -> tuple:
            (doc_id, text, own), (_, follower, its) = row, after
            half = len(text) // 2
            edited = text[: len(text) - half] + follower[:half]
            lanes = state(paragraphs(edited))
            return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), text_form(own), text_form(lanes), likeness(own, lanes), likeness(own, its)

        def block() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for part, border, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "border", "doc_id", "text")), strict=True):
                text = text or ""
                if waiting and waiting[0] != part:
                    raise AssertionError("a part without the row that follows it")
                if border and waiting is None:
                    continue  # further rows of the border's id
                row = (doc_id, text, state(paragraphs(text)))
                if waiting:
                    out.append(emit(waiting[1], row))
                waiting = None if border else (part, row)
                if len(out) >= 1000:
                    yield block()
                    out.clear()
        if out:
            yield block()

    return in_descending_order(docs).mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
