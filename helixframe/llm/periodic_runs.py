"""Periodic runs of words: stretches that repeat a phrase, found in one pass over diagonals.

A run is a maximal stretch of words with smallest period q that is at least
``min_length`` words and ``min_periods`` periods long. On the diagonal of lag q, where
word i is compared with word i - q, it is a maximal sequence of matches. Following each
word back to every earlier occurrence would take a number of steps quadratic in a
frequent word's count, so occurrences are those of a word with k words of context:
inside a run with q <= k the latest earlier occurrence of the context lies exactly q
words back (nearer ones would give a smaller period), so every word has one active lag
per context length. Its match length grows by one while the lag stays the same, and when
it changes the diagonal has ended and is emitted if it is long enough. Contexts double:
the first finds all periods up to its length (every run has that many matches), a
context of k words those above k / 2, and a text in which no context comes twice is done.

Null and empty texts have no words and no runs; a null id is kept; equal rows get equal
results, an empty table an empty one; other columns are neither read nor changed. Words
are compared by 64-bit hashes. A task holds one text at a time and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from helixframe.llm.text import mix, raw, window_hashes, word_hashes

STEP = np.uint64(0x9E3779B97F4A7C15)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
OUT_DDL = "runs array<struct<start long, length long, period long>>, n_words long, collapsed string"


def least_matches(min_length: int, min_periods: int) -> int:
    """Fewest matches that a run of any period has on its diagonal."""
    return min(max((min_periods - 1) * q, min_length - q) for q in range(1, max(2, min_length)))


def latest_lags(contexts: np.ndarray) -> np.ndarray:
    """Distance of each context to its latest earlier occurrence, 0 where there is none."""
    order = np.argsort(contexts, kind="stable")
    ranked = contexts[order]
    again = np.flatnonzero(ranked[1:] == ranked[:-1])
    lags = np.zeros(len(contexts), np.int64)
    lags[order[again + 1]] = order[again + 1] - order[again]
    return lags


def find_runs(words: np.ndarray, min_length: int = 24, min_periods: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of word hashes, by start, then period."""
    if min_periods < 3:
        raise ValueError("runs of fewer than three periods are not determined by their latest occurrences")
    k, n, found, below = max(1, least_matches(min_length, min_periods)), len(words), [], 0
    contexts = window_hashes(words, k) if n >= max(min_length, min_periods) else words[:0]
    while len(contexts):
        lags = latest_lags(contexts)
        if not lags.any():
            break
        ends = np.append(np.flatnonzero(np.diff(lags)) + 1, len(lags))
        starts = np.append(0, ends[:-1])
        periods = lags[starts]
        lengths = ends - starts + k - 1 + periods
        good = (periods > below) & (periods <= k) & (lengths >= np.maximum(min_length, min_periods * periods))
        found += zip((starts - periods)[good].tolist(), lengths[good].tolist(), periods[good].tolist())
        if min_periods * (k + 1) > n:
            break
        contexts = mix(contexts[:-k] * STEP + contexts[k:]) if len(contexts) > k else contexts[:0]
        below, k = k, 2 * k
    return sorted(found, key=lambda r: (r[0], r[2]))


def keep_mask(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for the words of a run after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_periods: int = 3) -> DataFrame:
    """Id, runs (by start, then period), n_words and the words outside the repeated periods, joined by one space."""
    least_matches(min_length, min_periods)
    chosen = docs.select(id_col, F.col(text_col).alias("_text" if id_col != "_text" else "_words"))
    schema = StructType([StructField(id_col, chosen.schema[0].dataType), *StructType.fromDDL(OUT_DDL)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, counts, kept = [], [], []
            for t in batch.column(1).to_pylist():
                text = raw(t)
                found, words = find_runs(word_hashes(text), min_length, min_periods), text.split()
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                counts.append(len(words))
                if found:
                    words = [words[i] for i in np.flatnonzero(keep_mask(len(words), found)).tolist()]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(RUN)), pa.array(counts, pa.int64()), pa.array(kept, pa.string())],
                                             names=schema.names)

    return chosen.mapInArrow(scan, schema)


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text for trial runs: where the id's checksum ends in 0 the words from a place on repeat a phrase (null ids stay whole)."""
    check = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.array_remove(F.split(F.coalesce(text_col, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    g, n = F.floor(check / 10), F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    phrase = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(phrase, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return docs.select(id_col, F.when((check % 10 == 0) & (n > 0), repeated).otherwise(F.col(text_col)).alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the run of most periods (ties: the first) and checksums of all runs and of the words kept."""
    best = F.reduce("runs", F.col("runs")[0], lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"),
                       F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select(id_col, "n_runs", "best.start", "best.length", "best.period",
                      F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
