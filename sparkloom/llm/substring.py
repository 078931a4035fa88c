"""Exact repeated passages, found by the hashes of all windows.

Every rolling window of MIN_WORDS words is hashed. A window that occurs before (in order of doc_id and position, at any
offset) is repeated, and the repeated words of a document are those of its repeated windows: no partner is left out,
since one earlier occurrence is all that a window needs. Its reference is the occurrence just before it where that is in
the same document (so text that goes round and round lies on one diagonal), else the first. Each diagonal is then
compared with the reference's words over the whole stretch of repeated windows around it, which a repeat cannot
outreach, so what is reported is maximal as to its reference. The first occurrence is never reported, so one copy of
each passage stays, and a window costs one row at most, whatever the number of its copies.

Windows travel packed: sorted hashes as differences in byte planes, with doc_id and position, some 10 bytes each;
repeated windows likewise. The text is shuffled by doc_id, to compare and to cut.

Defined results: null doc_id or null text takes no part and passes through; texts under MIN_WORDS words have no
repeats; rows of one doc_id count as one document, whose windows are checked against each row's own text; repeats
within a document count; ties go to the lower position; very long texts are used whole; an empty table gives an
empty result; extra columns pass through remove(). A document of which nothing is left is dropped by remove().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buckets, shielded, shuffle_files_go, written
from .textops import U, buffers, mix, pack_sorted, planes, rolling, slices, unpack_sorted, unplanes, word_table, words

MIN_WORDS = 50
#: Bits of a window's hash. What collides is found out when words are compared; a window is lost only where the one it collides with comes first.
BITS = 52
#: Windows that a task sorts at a time.
CHUNK = 1 << 21
#: Bytes of reference words in a batch.
BATCH = 1 << 23


def windows(docs: DataFrame, parts: int, width: int) -> DataFrame:
    """Packets of (hash, doc_id, position) of every window, one for each bucket of hashes and chunk of a task."""
    edges = (np.arange(1, parts, dtype=U) << U(BITS)) // U(parts)

    def run(batches):
        held: list[tuple] = []

        def flush():
            key, doc, pos = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(key)
            key, doc, pos = key[order], doc[order], pos[order]
            cut = np.concatenate(([0], np.searchsorted(key, edges), [len(key)]))
            n = np.diff(cut)
            own = [b for b in range(parts) if n[b]]
            make = lambda f, x: pa.array([f(x[cut[b] : cut[b + 1]]) for b in own], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own], pa.int32()), make(pack_sorted, key), make(planes, doc), make(planes, pos)], ["bucket", "n", "k", "d", "p"])

        table, cache = word_table(), {}
        for batch in batches:
            at, data = buffers(batch.column(1))
            ids = batch.column(0).cast(pa.int64()).to_numpy()
            for lo, hi in slices(at):
                row, h, _, _ = words(at, data, lo, hi, table, cache)
                start, key = rolling(h, row, width, cache)
                if not len(start):
                    continue
                first = np.searchsorted(row, np.arange(hi - lo))
                held.append((key >> U(64 - BITS), ids[lo:hi][row[start]].view(U), (start - first[row[start]]).astype(np.uint32)))
                if sum(len(x[0]) for x in held) >= CHUNK:
                    yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, n int, k binary, d binary, p binary")


def repeated(packets: DataFrame, parts: int) -> DataFrame:
    """Packets of (doc, pos, ref, ref_pos) of each window that occurs before, one for each part of the documents."""
    names = ["d", "p", "r", "q"]

    def run(t: pa.Table) -> pa.Table:
        n = t.column("n").to_pylist()
        read = lambda c, f: np.concatenate([f(b, m) for b, m in zip(t.column(c).to_pylist(), n)])
        key = read("k", unpack_sorted)
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        several = np.concatenate((same, [False])) | np.concatenate(([False], same))
        key, order = key[several], order[several]
        doc, pos = read("d", unplanes)[order].view(np.int64), read("p", unplanes)[order].astype(np.int64)
        order = np.lexsort((pos, doc, key))
        key, doc, pos = key[order], doc[order], pos[order]
        own: list[int] = []
        if len(key):
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])))
            key, doc, pos = key[new], doc[new], pos[new]
            head = np.concatenate(([True], key[1:] != key[:-1]))
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            i = np.flatnonzero(~head)
            j = np.where(doc[i - 1] == doc[i], i - 1, first[i])
            part = (mix(doc[i].view(U)) % U(parts)).astype(np.int64)
            order = np.lexsort((pos[i], doc[i], part))
            i, j, part = i[order], j[order], part[order]
            cut = np.searchsorted(part, np.arange(parts + 1))
            own = np.flatnonzero(np.diff(cut)).tolist()
        make = lambda x: pa.array([planes(x[cut[b] : cut[b + 1]].view(U)) for b in own], pa.binary())
        columns = [make(x) for x in (doc[i], pos[i], doc[j], pos[j])] if own else [pa.array([], pa.binary())] * 4
        return pa.table([pa.array(own, pa.int32()), pa.array([int(cut[b + 1] - cut[b]) for b in own], pa.int32()), *columns], ["part", "n", *names])

    return packets.groupBy("bucket").applyInArrow(run, "part int, n int, d binary, p binary, r binary, q binary")


def diagonals(packets: DataFrame, width: int) -> DataFrame:
    """(doc, ref, shift, lo, hi): the diagonals (position less the reference's) in each stretch of repeated windows, words lo to hi of doc."""

    def run(t: pa.Table) -> pa.Table:
        n = t.column("n").to_pylist()
        doc, pos, ref, ref_pos = (np.concatenate([unplanes(b, m) for b, m in zip(t.column(c).to_pylist(), n)]).view(np.int64) for c in ("d", "p", "r", "q"))
        order = np.lexsort((pos, doc))
        doc, pos, ref, ref_pos = doc[order], pos[order], ref[order], ref_pos[order]
        new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > width))))
        size = np.diff(np.append(new, len(doc)))
        lo, hi = np.repeat(pos[new], size), np.repeat(pos[new + size - 1] + width, size)
        shift = pos - ref_pos
        order = np.lexsort((shift, ref, lo, doc))
        doc, ref, shift, lo, hi = (x[order] for x in (doc, ref, shift, lo, hi))
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1]) | (ref[1:] != ref[:-1]) | (shift[1:] != shift[:-1])))
        return pa.table({"doc": doc[new], "ref": ref[new], "shift": shift[new], "lo": lo[new], "hi": hi[new]})

    return packets.groupBy("part").applyInArrow(run, "doc bigint, ref bigint, shift bigint, lo bigint, hi bigint")


def word_hashes(text: pa.Array, i: int, table: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes and first bytes (within the text) of the words of row i."""
    at, data = buffers(text.slice(i, 1))
    _, h, start, _ = words(at, data, 0, 1, table, cache)
    return (h >> U(32)).astype(np.uint32), start - at[0]


def lists(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and the flat fields of a column of lists of structs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False), 0)
    return np.concatenate(([0], np.cumsum(size))), flat.flatten()


def strips(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """The reference's words beside the diagonals: each stretch of them once, with its diagonals."""
    names = ["doc", "ref", "at", "words", "shift", "lo", "hi"]
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.list_(pa.int64())] * 3

    def run(batches):
        table, cache = word_table(), {}
        make = lambda out: pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out) if out else [[]] * 7, kinds)], names)
        for batch in batches:
            edge, fields = lists(batch.column(2))
            doc, shift, lo, hi = (x.to_numpy() for x in fields)
            out, held = [], 0
            for i, ref in enumerate(batch.column(0).to_pylist()):
                h, _ = word_hashes(batch.column(1), i, table, cache)
                s = slice(edge[i], edge[i + 1])
                d, g, x, y = doc[s], shift[s], lo[s], hi[s]
                start, end = np.maximum(x - g, 0), np.minimum(y - g, len(h))
                order = np.lexsort((start, d))
                d, g, x, y, start, end = (v[order] for v in (d, g, x, y, start, end))
                a = 0
                while a < len(d):
                    b, top = a + 1, int(end[a])
                    while b < len(d) and d[b] == d[a] and start[b] <= top:
                        top, b = max(top, int(end[b])), b + 1
                    part = h[start[a] : top].tobytes()
                    out.append((int(d[a]), ref, int(start[a]), part, g[a:b], x[a:b], y[a:b]))
                    a, held = b, held + len(part)
                    if held >= BATCH:
                        yield make(out)
                        out, held = [], 0
            yield make(out)

    # A reference that thousands of documents repeat is split over salts, so no list holds all of them.
    asked = hits.groupBy("ref", F.pmod(F.xxhash64("doc"), F.lit(16)).alias("salt")).agg(F.collect_list(F.struct("doc", "shift", "lo", "hi")).alias("hits")).select(F.col("ref").alias("doc_id"), "hits")
    both = docs.select("doc_id", "text").join(asked.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "hits")
    return both.mapInArrow(run, "doc bigint, ref bigint, at bigint, words binary, shift array<bigint>, lo array<bigint>, hi array<bigint>")


def extended(h: np.ndarray, runs: list[tuple], min_words: int) -> list[tuple[int, int, int, int]]:
    """Maximal repeats (start, end, ref, ref start) of a document's words h, of min_words at least."""
    out = set()
    for ref, at, part, shifts, los, his in runs:
        w = np.frombuffer(part, np.uint32)
        for g, lo, hi in zip(shifts, los, his):
            a, b = max(lo, at + g), min(hi, at + g + len(w), len(h))
            if b - a < min_words:
                continue
            edges = np.concatenate(([-1], np.flatnonzero(h[a:b] != w[a - g - at : b - g - at]), [b - a]))
            n = np.diff(edges) - 1
            for k in np.flatnonzero(n >= min_words).tolist():
                start = a + int(edges[k]) + 1
                out.add((start, start + int(n[k]), ref, start - g))
    return sorted(out)


def prepared(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id and the list of its strips. Windows and strips are written, so the packets' files can go."""
    spark = docs.sparkSession
    real = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    with shuffle_files_go(spark):
        parts = buckets(spark)
        hits = written(repeated(windows(real, parts, min_words), parts), "repeated")
        runs = written(strips(diagonals(hits, min_words), real), "strips")
    return runs.groupBy("doc").agg(F.collect_list(F.struct("ref", "at", "words", "shift", "lo", "hi")).alias("__runs")).select(F.col("doc").alias("__doc"), "__runs")


def rows_of_runs(column):
    edge, fields = lists(column)
    fields = [f.to_pylist() for f in fields]
    return [list(zip(*[f[a:b] for f in fields])) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies of passages: doc_id, start_word, n_words, ref_doc_id, ref_start_word."""
    names = ["doc_id", "start_word", "n_words", "ref_doc_id", "ref_start_word"]

    def run(batches):
        table, cache = word_table(), {}
        for batch in batches:
            out = []
            for i, (doc, runs) in enumerate(zip(batch.column(0).to_pylist(), rows_of_runs(batch.column(2)))):
                out += [(doc, s, e - s, ref, r) for s, e, ref, r in extended(word_hashes(batch.column(1), i, table, cache)[0], runs, min_words)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(5)], names)

    runs = prepared(docs, min_words)
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(runs.hint("shuffle_hash"), F.col("doc_id") == F.col("__doc")).select("doc_id", "text", "__runs")
    return both.mapInArrow(run, ", ".join(f"{c} bigint" for c in names)).distinct()


def without(text: bytes, start: np.ndarray, spans: list[tuple]) -> bytes:
    """The text without the words of the spans, each cut from its first byte to that of the next word."""
    out, at = [], 0
    for a, b, *_ in spans:
        first, end = int(start[a]), int(start[b]) if b < len(start) else len(text)
        if first > at:
            out.append(text[at:first])
        at = max(at, end)
    out.append(text[at:])
    return b"".join(out).rstrip() if at >= len(text) else b"".join(out)


def remove(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without their later copies of passages; the columns stay, n_chars is counted anew."""
    return shielded(docs, lambda d: cut(d, min_words))


def cut(docs: DataFrame, min_words: int) -> DataFrame:
    columns = docs.columns
    schema = T.StructType([T.StructField(f.name, T.LongType() if f.name == "n_chars" else f.dataType, True) for f in docs.schema])
    at = columns.index("text")

    def run(batches):
        table, cache = word_table(), {}
        for batch in batches:
            text, stays = batch.column(at), np.ones(len(batch), bool)
            has = np.flatnonzero(batch.column(len(columns)).is_valid().to_numpy(zero_copy_only=False))
            if not len(has):
                yield batch.select(columns)
                continue
            new = text.to_pylist()
            runs = rows_of_runs(batch.column(len(columns)))
            for i in has.tolist():
                h, start = word_hashes(text, i, table, cache)
                spans = extended(h, runs[i], min_words)
                if spans:
                    new[i] = without(new[i].encode(), start, spans).decode()
                    stays[i] = bool(new[i].strip())
            fresh = pa.array(new, text.type)
            values = [fresh if c == "text" else pa.compute.coalesce(pa.compute.utf8_length(fresh).cast(pa.int64()), batch.column(k).cast(pa.int64())) if c == "n_chars" else batch.column(k) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(values, schema.names).filter(pa.array(stays))

    runs = prepared(docs, min_words)
    both = docs.join(runs.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("__doc"), "left").select(*[docs[f"`{c}`"] for c in columns], "__runs")
    return both.mapInArrow(run, schema)
