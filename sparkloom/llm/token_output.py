"""Token ids as Parquet list columns that can be read selectively.

Texts are encoded with a byte-level BPE vocabulary file given by path (ranks in base64, one a line). Texts
are split by the tokenizer's pattern on byte arrays, a slice of documents at a time, and each distinct piece is encoded
once per task; all others are looked up by hash and compared byte by byte, which gives the very ids of encoding the whole text. write_tokens() stores ids and metadata so that readers take what they need: ids in
delta-binary-packed pages or with a dictionary, metadata with dictionaries, bounded row groups and pages, a page index
(column and offset index) and rows in order of doc_id inside each file, so a filter on doc_id or n_tokens skips row
groups and pages, and a projection without token_ids never touches them.

Defined results: null text has null token_ids and null n_tokens; empty text has an empty list and 0; null doc_id is
kept; repeated rows are each encoded; very long texts are encoded whole; an empty table gives an empty one; extra
columns pass through, and token_ids and n_tokens replace columns of these names (in any case of letters). Byte sequences that aren't in a vocabulary can't
occur: all 256 bytes are tokens.
"""

from __future__ import annotations

import base64
import importlib.util
import itertools
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import BASE, INVERSE, U, buffers, mix, powers, slices

#: The splitting pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
#: Bytes of text that are encoded at a time.
SLICE = 256 << 10


def default_vocabulary() -> str:
    """The path of the installed 50k byte-level vocabulary."""
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None or not spec.origin:
        raise FileNotFoundError("no package public_tokenizers: give the path of a vocabulary")
    return str(Path(spec.origin).parent / "byte_bpe_50k.tiktoken")


def encoding_of(path: str, pattern: str = PATTERN):
    """The library's tokenizer. It keeps many copies of a compiled pattern, so where pieces are all that is encoded, the pattern is a short one."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def character_classes() -> np.ndarray:
    """The class of every code point, as PATTERN tells them apart."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    signs = [(k, regex.compile(p)) for k, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+"))]
    for first in range(0, 0x110000, 0x800):
        if first != 0xD800:  # the surrogates
            block = np.arange(first, first + 0x800, dtype=np.uint32).tobytes().decode("utf-32-le")
            for kind, sign in signs:
                for m in sign.finditer(block):
                    out[first + m.start() : first + m.end()] = kind
    return out


def code_points(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and code point of each character of UTF-8 bytes."""
    start = np.flatnonzero((seg & 0xC0) != 0x80)
    cp = seg[start].astype(np.int32)
    wide = np.flatnonzero(cp >= 0x80)
    if len(wide):
        at, lead, n = start[wide], cp[wide], len(seg) - 1
        follow = [(seg[np.minimum(at + i, n)] & 0x3F).astype(np.int32) for i in (1, 2, 3)]
        two, three = ((lead & 0x1F) << 6) | follow[0], ((lead & 0x0F) << 12) | (follow[0] << 6) | follow[1]
        four = ((lead & 0x07) << 18) | (follow[0] << 12) | (follow[1] << 6) | follow[2]
        cp[wide] = np.minimum(np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)), 0x10FFFF)
    return start, cp


def piece_starts(seg: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """First bytes of the pieces into which PATTERN splits texts that begin at rows (offsets in seg)."""
    start, cp = code_points(seg)
    n = len(start)
    kind = classes[cp]
    edge = np.zeros(n + 1, bool)  # a text begins here, or all texts have ended
    edge[np.searchsorted(start, rows)] = True
    edge[n] = True
    run = edge.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    out = run[:n].copy()
    # The last white space before other characters: a blank goes with them, anything else is a piece of its own.
    last = np.flatnonzero((kind[:-1] == SPACE) & run[1:n] & ~edge[1:n])
    out[last] = True
    out[last[cp[last] == 32] + 1] = False
    # Contractions, where the apostrophe begins a piece.
    quote = np.flatnonzero((cp == 39) & out)
    if len(quote):
        letter = np.append(np.where(cp < 128, cp, 0), [0, 0, 0])
        same = lambda k: ~np.append(edge, [True] * 3)[quote + k]
        a, b = letter[quote + 1], letter[quote + 2]
        one = same(1) & np.isin(a, [ord(c) for c in "sdmt"])
        two = same(1) & same(2) & (((a == ord("l")) & (b == ord("l"))) | (((a == ord("v")) | (a == ord("r"))) & (b == ord("e"))))
        out[quote[one | two] + 1] = False
        for at in (quote[one] + 2, quote[two] + 3):
            out[at[at < n]] = True
    return start[out]


def grown(x: np.ndarray, n: int) -> np.ndarray:
    while len(x) < n:
        x = np.concatenate((x, np.zeros_like(x)))
    return x


class Pieces:
    """Ids of pieces by hash, in a table of open addressing that is read for all pieces of a slice at once.

    Every hit is compared byte by byte with the piece that it stands for, so a collision can't give wrong ids.
    """

    BITS, LONGEST = 20, 64

    def __init__(self, single):
        self.single, self.cache = single, {}
        self.clear()

    def clear(self):
        self.key, self.slot = np.zeros(1 << self.BITS, U), np.zeros(1 << self.BITS, np.int32)
        self.n = 0
        # Of each piece: first byte and number of bytes in text, first id and number of ids in ids.
        self.meta, self.text, self.ids = np.zeros((1 << 12, 4), np.int64), np.zeros(1 << 16, np.uint8), np.zeros(1 << 14, np.int32)
        self.used = [0, 0]

    def add(self, pieces: list[bytes]) -> np.ndarray:
        """Encodes pieces, and gives their places in meta."""
        ids = list(map(self.single, pieces))
        size, n = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.fromiter(map(len, ids), np.int64, len(ids))
        place = np.arange(self.n, self.n + len(pieces))
        self.meta, self.text, self.ids = (grown(x, k) for x, k in ((self.meta, self.n + len(pieces)), (self.text, self.used[0] + int(size.sum())), (self.ids, self.used[1] + int(n.sum()))))
        self.meta[place] = np.stack((self.used[0] + np.cumsum(size) - size, size, self.used[1] + np.cumsum(n) - n, n), 1)
        self.text[self.used[0] : self.used[0] + int(size.sum())] = np.frombuffer(b"".join(pieces), np.uint8)
        self.ids[self.used[1] : self.used[1] + int(n.sum())] = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(n.sum()))
        self.used = [self.used[0] + int(size.sum()), self.used[1] + int(n.sum())]
        self.n += len(pieces)
        return place

    def enter(self, h: np.ndarray, place: np.ndarray) -> None:
        """Puts distinct hashes that aren't there into the table."""
        at = (h >> U(64 - self.BITS)).astype(np.int64)
        while len(h):
            first = np.zeros(len(h), bool)
            first[np.unique(at, return_index=True)[1]] = True
            first &= self.key[at] == 0
            self.key[at[first]], self.slot[at[first]] = h[first], place[first]
            h, place, at = h[~first], place[~first], (at[~first] + 1) & ((1 << self.BITS) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in meta, -1 where it isn't known."""
        out = np.full(len(h), -1, np.int64)
        todo, at = np.arange(len(h)), (h >> U(64 - self.BITS)).astype(np.int64)
        while len(todo):
            key = self.key[at]
            hit = key == h[todo]
            out[todo[hit]] = self.slot[at[hit]]
            left = ~hit & (key != 0)
            todo, at = todo[left], (at[left] + 1) & ((1 << self.BITS) - 1)
        return out

    def encode(self, seg: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece of seg, and all ids."""
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        if self.n > 1 << (self.BITS - 1) or self.used[0] > 1 << 25:  # bounds a worker's memory
            self.clear()
        end = np.append(start[1:], len(seg))
        size = end - start
        value = self.cache.get("bytes")
        if value is None:
            value = self.cache["bytes"] = mix(np.arange(1, 257, dtype=U) * U(BASE))
        total = np.empty(len(seg) + 1, U)
        total[0] = 0
        np.cumsum(value[seg] * powers(len(seg), BASE, self.cache), out=total[1:])
        h = np.maximum(mix((total[end] - total[start]) * powers(len(seg), INVERSE, self.cache)[start] + size.astype(U)), U(1))
        place = self.find(h)
        i = np.flatnonzero((place < 0) & (size <= self.LONGEST))
        i = i[np.unique(h[i], return_index=True)[1]]
        whole = seg.tobytes()
        self.enter(h[i], self.add([whole[x:y] for x, y in zip(start[i].tolist(), end[i].tolist())]))
        new = np.flatnonzero(place < 0)
        place[new] = self.find(h[new])
        known = np.maximum(place, 0)
        wrong = (place < 0) | (self.meta[known, 1] != size)
        # All bytes against those of the pieces that the hashes stand for.
        first = np.where(wrong, 0, self.meta[known, 0])
        at = np.repeat(first - start, np.where(wrong, 0, size)) + (np.arange(len(seg)) if not wrong.any() else np.flatnonzero(np.repeat(~wrong, size)) + start[0])
        differ = self.text[at] != (seg[start[0] :] if not wrong.any() else seg[start[0] :][np.repeat(~wrong, size)])
        if differ.any():
            wrong |= np.bincount(np.repeat(np.arange(len(start)), np.where(wrong, 0, size))[differ], minlength=len(start)) > 0
        meta = self.meta
        if wrong.any():  # long pieces, and collisions: encoded on their own and not kept
            spot, mark = self.n, list(self.used)
            place[wrong] = self.add([whole[x:y] for x, y in zip(start[wrong].tolist(), end[wrong].tolist())])
            meta, self.n, self.used = self.meta, spot, mark
        n, from_ = meta[place, 3], meta[place, 2]
        at = np.repeat(from_ - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return n, self.ids[at]


def tokenize(docs: DataFrame, vocabulary: str | None = None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with n_tokens and token_ids (without the text unless keep_text)."""
    path = vocabulary or default_vocabulary()
    names = [c for c in docs.columns if c.lower() not in ("n_tokens", "token_ids")]
    kept = [c for c in names if c != text or keep_text]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_tokens", T.IntegerType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        pieces, classes = Pieces(encoding_of(path, "x")._encode_single_piece), character_classes()
        for batch in batches:
            column = batch.column(names.index(text))
            offsets, data = buffers(column)
            for lo, hi in slices(offsets, SLICE):
                edge = offsets[lo : hi + 1] - offsets[lo]
                seg = data[offsets[lo] : offsets[hi]]
                start = piece_starts(seg, edge[:-1], classes) if len(seg) else np.zeros(0, np.int64)
                n, ids = pieces.encode(seg, start)
                edge = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(start, edge)].astype(np.int32)
                null = column.slice(lo, hi - lo).is_null()
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(ids), mask=null)
                count = pa.array(np.diff(edge), mask=null.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column(names.index(c)).slice(lo, hi - lo) for c in kept] + [count, lists], schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def write_tokens(tokens: DataFrame, path: str, encoding: str = "delta", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, mode: str = "errorifexists") -> None:
    """Writes tokens; encoding is "delta" or "dictionary" and holds for token_ids."""
    if encoding not in ("delta", "dictionary"):
        raise ValueError(encoding)
    options = {
        "parquet.writer.version": "PARQUET_2_0",  # integers without a dictionary are then delta-binary-packed
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#token_ids.list.element": str(encoding == "dictionary").lower(),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": "1000",
        "parquet.block.size.row.check.min": "10",
        "parquet.page.write-checksum.enabled": "true",
        "compression": "zstd",
    }
    tokens.sortWithinPartitions("doc_id").write.mode(mode).options(**options).parquet(path)


def decode(ids, path: str) -> str:
    """The text of ids; what encode() made comes back exactly."""
    ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return b"".join(ranks[int(i)] for i in ids).decode("utf-8", errors="strict")
