"""Stupid-backoff scores of documents under trigram counts of the whole corpus, each document left out of its own counts.

For a word w after u v, with counts c over all other documents: log(c(uvw) / c(uv)) where c(uvw) > 0, else
log(ALPHA c(vw) / c(v)) where c(vw) > 0, else log(ALPHA^2 max(c(w), 1) / max(N, 1)), N being the words of the
other documents. The first word of a document starts at the last form without ALPHA, the second at the second
without ALPHA. A document's score is the sum over its words.

With its own n-grams among the counts, a document would never back off: each of its trigrams would occur at least once.

Counts are those of counts.py: tables of the three orders are partitioned by hash, joined to the exploded
n-grams of each chunk of documents, and summed by document.

Defined results: null or empty text has 0 words, score 0 and a null mean; a null doc_id is scored and returned
as null; repeated rows are documents of their own, each with a result; very long texts are scored whole; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import buckets
from .counts import BITS, ask, chunked, distinct, unpack_answers
from .textops import SLICE_BYTES, U, buffers, mix, slices, word_table, words

ALPHA = 0.4


def grams(column) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Row of each word; per order the keys, and the index of the word that each ends at."""
    at, data = buffers(column)
    table, cache, rows, hashes = word_table(), {}, [], []
    for lo, hi in slices(at, SLICE_BYTES):
        row, h, _, _ = words(at, data, lo, hi, table, cache)
        rows.append(row + lo)
        hashes.append(h)
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, U)
    shift = U(64 - BITS)
    keys, ends = [h >> shift], [np.arange(len(h))]
    two = mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:])
    end = np.flatnonzero(row[:-1] == row[1:]) + 1
    keys.append(two[end - 1] >> shift)
    ends.append(end)
    three = mix(two[:-1] * U(0xD6E8FEB86659FD93) + h[2:]) if len(h) > 2 else np.zeros(0, U)
    end = np.flatnonzero(row[:-2] == row[2:]) + 2 if len(h) > 2 else np.zeros(0, np.int64)
    keys.append(three[end - 2] >> shift)
    ends.append(end)
    return row, keys, ends


def levels(column):
    row, keys, _ = grams(column)
    return [(k, c) for k, _, c in map(distinct, keys)], len(row)


def score(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, mean_log_score, log_score (both rounded to 4 decimals) and n_words of every row."""
    chunks = buckets(docs.sparkSession, 2)

    def use(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        rows = t.num_rows
        row, keys, ends = grams(t.column("text"))
        totals, all_words, _ = unpack_answers(answers)
        n = np.bincount(row, minlength=rows)
        others = np.maximum(all_words - n, 1)[row]
        count = []
        for k, end, total in zip(keys, ends, totals):
            found, place, _ = distinct(k)
            _, pair, own = distinct((row[end].astype(U) * U(max(1, len(found)))) + place.astype(U))
            left = np.zeros(len(row), np.float64)
            left[end] = total[place].astype(np.float64) - own[pair].astype(np.float64)
            count.append(left)
        place_in_row = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        before = lambda x: np.concatenate(([0.0], x[:-1]))[: len(x)]
        one, two, three = count
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.log(np.maximum(one, 1) / others) + np.log(alpha) * np.minimum(place_in_row, 2)
            s = np.where((place_in_row >= 1) & (two > 0), np.log(two / before(one)) + np.log(alpha) * (place_in_row > 1), s)
            s = np.where((place_in_row >= 2) & (three > 0), np.log(three / before(two)), s)
        sums = np.bincount(row, s, rows).astype(np.float64)  # without words it counts in integers
        mean = np.round(sums / np.maximum(n, 1), 4)
        return pa.table({"doc_id": t.column("doc_id").cast(pa.int64()), "mean_log_score": pa.array(mean, mask=n == 0), "log_score": pa.array(np.round(sums, 4)), "n_words": pa.array(n, pa.int64())})

    base = chunked(docs, chunks)
    answers = ask(base, levels, chunks)
    return base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(use, "doc_id bigint, mean_log_score double, log_score double, n_words bigint")


def score_sql(alpha: float = ALPHA) -> str:
    """DuckDB SQL for score() over documents of distinct doc_ids."""
    return f"""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\v\\f]+'), lambda w: w <> '') AS ws FROM documents),
    p AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM d),
    g AS (SELECT doc_id, i, w, lag(w) OVER k AS v, lag(w, 2) OVER k AS u FROM p WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
    n AS (SELECT count(*) AS total FROM p), m AS (SELECT doc_id, count(*) AS own FROM p GROUP BY 1),
    c1d AS (SELECT doc_id, w, count(*) AS c FROM p GROUP BY ALL), c1 AS (SELECT w, sum(c) AS c FROM c1d GROUP BY 1),
    c2d AS (SELECT doc_id, v, w, count(*) AS c FROM g WHERE i > 1 GROUP BY ALL), c2 AS (SELECT v, w, sum(c) AS c FROM c2d GROUP BY ALL),
    c3d AS (SELECT doc_id, u, v, w, count(*) AS c FROM g WHERE i > 2 GROUP BY ALL), c3 AS (SELECT u, v, w, sum(c) AS c FROM c3d GROUP BY ALL),
    l1 AS (SELECT doc_id, w, c1.c - c1d.c AS c FROM c1d JOIN c1 USING (w)),
    l2 AS (SELECT doc_id, v, w, c2.c - c2d.c AS c FROM c2d JOIN c2 USING (v, w)),
    l3 AS (SELECT doc_id, u, v, w, c3.c - c3d.c AS c FROM c3d JOIN c3 USING (u, v, w)),
    s AS (SELECT g.doc_id, CASE WHEN i > 2 AND l3.c > 0 THEN ln(l3.c / b.c) WHEN i > 1 AND l2.c > 0 THEN ln(l2.c / a.c) + CASE WHEN i > 2 THEN ln({alpha}) ELSE 0 END
        ELSE ln(greatest(l1.c, 1) / greatest(total - own, 1)) + ln({alpha}) * least(i - 1, 2) END AS s
      FROM g JOIN m USING (doc_id) CROSS JOIN n JOIN l1 ON l1.doc_id = g.doc_id AND l1.w = g.w
      LEFT JOIN l1 a ON a.doc_id = g.doc_id AND a.w = g.v LEFT JOIN l2 ON l2.doc_id = g.doc_id AND l2.v = g.v AND l2.w = g.w
      LEFT JOIN l2 b ON b.doc_id = g.doc_id AND b.v = g.u AND b.w = g.v LEFT JOIN l3 ON l3.doc_id = g.doc_id AND l3.u = g.u AND l3.v = g.v AND l3.w = g.w)
    SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(sum(s), 0), 4) AS log_score, round(sum(s) / nullif(len(ws), 0), 4) AS mean_log_score
    FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id, ws"""
