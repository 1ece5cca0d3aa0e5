"""Substring dedup by sparse suffix arrays.

Of all suffixes (from each word on) only those are kept that start at a minimiser:
the least k-gram of some window of ``w`` k-grams. A passage of k + w - 1 words or more
has the same minimisers in every document, so no repeat of that length is left
without a suffix. The suffixes whose first k words occur in two documents are sorted by these,
and those that agree in more words to the right, and to the left, are brought together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from factloom.llm.repeats import HOT, MIN_WORDS, Anchors, long_repeats
from factloom.llm.textkit import kgrams, minimisers

K = 18


def minimiser_anchors(k: int, w: int) -> Anchors:
    def choose(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grams, _ = kgrams(hashes, first, k)
        at = minimisers(grams, first, k, w)
        return at, grams[at]

    return choose


def suffix_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, k: int = K, hot: int = HOT) -> DataFrame:
    """Stretches of ``min_words`` or more words that two documents share (see ``long_repeats``).

    All of them are found. ``k`` is at most ``min_words``. A text of fewer words than that shares nothing;
    an empty table gives no rows. Repeated rows are one document, and a tie between partners goes to the least id.
    """
    k = min(k, min_words)
    w = min_words - k + 1
    # a shared passage's first minimiser is within w - 1 words of its start, its last one within w - 1 + k of its end
    return long_repeats(docs, minimiser_anchors(k, w), left=max(1, w - 1), right=w - 1 + k, doc_id=doc_id, text=text, min_words=min_words, hot=hot)
