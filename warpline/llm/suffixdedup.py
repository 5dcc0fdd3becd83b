"""Suffix-array dedup: bytes that lie in a repeated string of `window` bytes are removed.

Windows are brought together by anchors (repeats.py); in each shard, external induced sorting
(induced.py) gives the suffixes in order with their common prefixes, and windows between which the
prefix never falls below the window are equal.

Defined cases: null counts as empty; texts shorter than the window keep all bytes; repeated rows are
places of their own, so both lose what they share; null doc_ids keep their row; an empty table gives
an empty result; very long texts are cut into overlapping pieces; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.llm.common import NO_ID, materialise, spare
from warpline.llm.induced import suffix_array
from warpline.llm.repeats import cut, keyed, packed, repeated


#: symbols of a shard: its queue and arrays are longer than what induced.MEMORY lets stay in memory
SHARD = 2 << 20


def byte_classes(contents: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, offset, class) of every window of a shard; equal windows have one class."""
    size = np.array([len(c) for c in contents], np.int64)
    text = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
    starts = np.cumsum(size + 1) - (size + 1)
    text[starts + size] = 0  # between contents: below all bytes
    places, prefix = suffix_array(text, window)
    same = np.cumsum(prefix < window, dtype=np.int32)
    who = np.repeat(np.arange(len(contents), dtype=np.int32), size + 1)[places]
    offset = (places - starts[who]).astype(np.int32)
    ok = offset + window <= size[who]
    return who[ok], offset[ok], same[ok]


def _spans(docs: DataFrame, window: int, id_col: str, text_col: str, mode: str, **limits: int) -> tuple[DataFrame, DataFrame]:
    if not 32 <= window < 256:
        raise ValueError("window must be 32 to 255 bytes")
    base = keyed(docs, id_col, text_col)
    texts = packed(base)
    return texts, repeated(base, texts, byte_classes, words=False, window=window, k=16 if window < 64 else 32, mode=mode, **{"shard": SHARD, **limits})


def deduplicate(docs: DataFrame, *, window: int = 200, id_col: str = "doc_id", text_col: str = "text", mode: str = "all", keep_text: bool = False, **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary, if keep_text)."""
    texts, spans = _spans(docs, window, id_col, text_col, mode, **limits)
    out = cut(texts, spans, words=False, window=window, keep_text=keep_text).withColumnRenamed("n_units", "n_bytes")
    return out if keep_text else out.drop("kept")


def clean(docs: DataFrame, *, window: int = 200) -> DataFrame:
    """docs with the text (and n_chars) that stays; every row and column is kept.

    A character that a removed stretch cuts in two goes as a whole.
    """
    texts, spans = _spans(docs, window, "doc_id", "text", "all")
    touched = materialise(cut(texts.join(spans, ["nid", "th"], "left_semi").dropDuplicates(["nid", "th"]), spans, words=False, window=window, keep_text=True, characters=True))
    mark = spare(docs)
    nid, th, kept = (mark + n for n in ("nid", "th", "kept"))
    now = touched.select(F.col("nid").alias(nid), F.col("th").alias(th), F.col("kept").cast("string").alias(kept))
    own = docs.withColumns({nid: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), th: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    changed = own.join(now, [nid, th], "left").withColumn("text", F.coalesce(F.col(kept), F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(kept).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*[f"`{c}`" for c in docs.columns])
