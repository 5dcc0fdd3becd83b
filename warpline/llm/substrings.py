"""Substring dedup: words that lie in a window of words which also starts earlier are removed.

Windows are brought together by anchors (repeats.py); each shard gets a compressed FM-index
(fmindex.py), and its texts are streamed against it: backward search gives the matching statistic
at each window's end, and windows whose statistic reaches the window are reported with their rows.

Defined cases: null and blank texts have no words; texts of fewer words than a window keep all;
repeated rows (same doc_id and text) tie, so neither is earlier; null doc_ids come first; an empty
table gives an empty result; extra columns are not read; texts are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from warpline.llm.fmindex import FMIndex
from warpline.llm.repeats import cut, keyed, packed, repeated

HOT = 1000  # contents of an anchor from which it is dealt over salts


def word_classes(contents: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, offset, class) of every window of a shard; equal windows have one class."""
    size = np.array([len(c) for c in contents], np.int64)
    number: dict[bytes, int] = {}
    ids = np.zeros(int(size.sum()) + len(contents), np.int64)
    starts = np.cumsum(size + 1) - (size + 1)
    at = 0
    for c in contents:
        ids[at : at + len(c)] = [number.setdefault(w, len(number) + 1) for w in c]
        at += len(c) + 1
    index = FMIndex(ids, window)
    windows = np.maximum(size - window + 1, 0)
    who = np.repeat(np.arange(len(contents)), windows)
    offset = np.arange(len(who)) - np.repeat(np.cumsum(windows) - windows, windows)
    ends = starts[who] + offset + window
    length, low = np.empty(len(who), np.int64), np.empty(len(who), np.int64)
    for s in range(0, len(who), 1 << 16):  # the queries are streamed
        length[s : s + (1 << 16)], low[s : s + (1 << 16)], _ = index.statistics(ids, ends[s : s + (1 << 16)], window)
    same = np.where(length >= window, low, index.n + np.arange(len(who)))  # above the threshold: the rows are the class
    return who, offset, same


def deduplicate(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, **limits: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_spans and kept (binary, if keep_text)."""
    if window < 9:
        raise ValueError("window must be 9 words or more")
    base = keyed(docs, id_col, text_col)
    texts = packed(base)
    spans = repeated(base, texts, word_classes, words=True, window=window, k=8, mode="later", **{"hot": HOT, **limits})
    out = cut(texts, spans, words=True, window=window, keep_text=keep_text).withColumnRenamed("n_units", "n_words")
    return out if keep_text else out.drop("kept")
