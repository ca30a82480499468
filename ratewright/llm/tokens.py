"""Encoding of a whole corpus with a public tokenizer; long texts by tree concatenation.

A long text is cut in halves down to leaves, which are encoded on their own, the leaves of very long texts by several
tasks. At each join the tokens around the cut are encoded again, in a window that grows until both sides agree: up to the
next place on each side that splits the text in any context, or, where there is none (one unsplit run), until the window's
outermost tokens are those that either side had. Byte-pair merges are determined by neighbours, so the tokens beyond are
then the same as those of the whole text. The result is exact, and no text is too long for the pattern's matcher.
"""

from __future__ import annotations

import base64
import functools
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; give another as a parameter.
FOLDER = "/opt/tokenizers"
#: Characters of a leaf, and of the pieces that go to tasks of their own.
LEAF = 8192
SPREAD = 32_768
FILES = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken", "word_bpe_49k": "word_bpe_49k.json", "piece_bpe_32k": "piece_bpe_32k.model"}
#: How the rank files' texts are split before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_W = r"\t-\r \x85\xa0  -     　"
_L = r"A-Za-zÀ-ÖØ-öø-ɏА-я一-龥"
_O = r"!-&(-/:-@\[-`{-~"
#: Places where PATTERN splits whatever stands around, and whose text before splits alike if it ends there. Two or three
#: characters decide, all of classes that no Unicode version moved.
CUT = regex.compile(
    rf"(?<=[^{_W}])(?=[{_W}])|(?<=[{_W}])(?=[{_W}][^{_W}])"
    rf"|(?<=[{_L}])(?=[0-9])|(?<=[0-9])(?=[{_L}])|(?<=[{_L}0-9])(?=[{_O}'])|(?<=[{_O}'])(?=[0-9])|(?<=[{_O}])(?=[{_L}])"
)
#: Characters from the join within which no cut is trusted, as its context reaches over it.
MARGIN = 4


class RankEncoder:
    """Byte-level BPE from a rank file."""

    def __init__(self, data: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.core = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, rank in ranks.items():
            size[rank] = len(token)
        self.size = size

    def encode(self, text: str, leaf: int = LEAF) -> array:
        if len(text) <= leaf:
            return array("i", self.core.encode_ordinary(text))
        return self.concatenate([text[i : i + leaf] for i in range(0, len(text), leaf)])

    def concatenate(self, texts: list[str], ids: list[array] | None = None) -> array:
        """Ids of the joined texts from those of each, by halves."""
        if ids is None:
            ids = [self.encode(t) for t in texts]
        parts = [(t, i) for t, i in zip(texts, ids) if t]
        if not parts:
            return array("i")
        while len(parts) > 1:
            joined = [(a[0] + b[0], self.join(*a, *b)) for a, b in zip(parts[::2], parts[1::2])]
            parts = joined + parts[len(joined) * 2 :]
        return parts[0][1]

    def join(self, left: str, li: array, right: str, ri: array) -> array:
        """Ids of ``left + right`` from the ids of both."""
        p, keep, sure_left = self._left(left, li)
        q, drop, sure_right = self._right(right, ri)
        wl, wr = 32, 32
        while True:
            if not sure_left:
                keep = max(0, len(li) - wl)
                p = len(left) if keep == len(li) else self._start(left, li, keep)
            if not sure_right:
                drop = min(len(ri), wr)
                q = self._end(right, ri, drop)
            if p is None or q is None:  # the window's edge lies inside a character
                wl, wr = (wl + 1, wr) if p is None else (wl, wr + 1)
                continue
            mid = self.core.encode_ordinary(left[p:] + right[:q])
            agree_left = sure_left or keep == 0 or list(mid[:4]) == list(li[keep : keep + 4])
            agree_right = sure_right or drop == len(ri) or list(mid[-4:]) == list(ri[max(0, drop - 4) : drop])
            if agree_left and agree_right and (len(mid) >= 12 or (sure_left or keep == 0) and (sure_right or drop == len(ri))):
                return li[:keep] + array("i", mid) + ri[drop:]
            wl, wr = wl * (1 if agree_left and len(mid) >= 12 else 2), wr * (1 if agree_right and len(mid) >= 12 else 2)

    def _left(self, text: str, ids: array) -> tuple[int, int, bool]:
        width = 64
        while True:
            lo = max(0, len(text) - width)
            cuts = [m.start() for m in CUT.finditer(text, max(0, lo - MARGIN)) if lo <= m.start() <= len(text) - MARGIN and m.start() > 0]
            if cuts:
                p = cuts[-1]
                want, keep = len(text[p:].encode()), len(ids)
                while want > 0:
                    keep -= 1
                    want -= int(self.size[ids[keep]])
                if want == 0:
                    return p, keep, True
            if lo == 0:
                return 0, 0, False
            width *= 4

    def _right(self, text: str, ids: array) -> tuple[int, int, bool]:
        width = 64
        while True:
            hi = min(len(text), width)
            # The piece's own end is no context: a cut found in its last characters isn't trusted either.
            q = next((m.start() for m in CUT.finditer(text, 0, min(len(text), hi + MARGIN)) if MARGIN <= m.start() <= hi - MARGIN), None)
            if q is not None:
                want, drop = len(text[:q].encode()), 0
                while want > 0:
                    want -= int(self.size[ids[drop]])
                    drop += 1
                if want == 0:
                    return q, drop, True
            if hi == len(text):
                return 0, 0, False
            width *= 4

    def _start(self, text: str, ids: array, keep: int) -> int | None:
        return self._at(text, sum(int(self.size[i]) for i in ids[keep:]), from_end=True)

    def _end(self, text: str, ids: array, drop: int) -> int | None:
        return self._at(text, sum(int(self.size[i]) for i in ids[:drop]), from_end=False)

    @staticmethod
    def _at(text: str, size: int, from_end: bool) -> int | None:
        part = (text[-size:] if from_end else text[:size]).encode() if size else b""
        part = part[len(part) - size :] if from_end else part[:size]
        try:
            count = len(part.decode())
        except UnicodeDecodeError:
            return None
        return len(text) - count if from_end else count


class WholeEncoder:
    """Tokenizers that come with their own splitting; texts are given to them whole."""

    def __init__(self, call: Callable[[str], list[int]]):
        self.call = call

    def encode(self, text: str, leaf: int = LEAF) -> array:
        return array("i", self.call(text))


@functools.lru_cache(maxsize=4)
def encoder(name: str, data: bytes) -> RankEncoder | WholeEncoder:
    if name.endswith(".tiktoken"):
        return RankEncoder(data)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_buffer(data)
        t.encode_special_tokens = True
        return WholeEncoder(lambda s: t.encode(s, add_special_tokens=False).ids)
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=data)
    return WholeEncoder(lambda s: p.encode(s))


def vocabulary(name: str, folder: str = FOLDER) -> tuple[str, bytes]:
    """File name and content of a public tokenizer; a megabyte or two, whatever the corpus."""
    file = FILES.get(name, name)
    with open(os.path.join(folder, file), "rb") as f:
        return file, f.read()


def _lists(ids: list[array]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(i) for i in ids], out=offsets[1:])
    flat = array("i")
    for i in ids:
        flat.extend(i)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32)))


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER, spread: int = SPREAD, leaf: int = LEAF, counts_only: bool = False) -> DataFrame:
    """``(key, ids)`` of every row, or ``(key, tokens)`` with ``counts_only``: the ids of its text, no special tokens added.

    Empty and null texts have an empty list. Strings that look like special tokens are ordinary text. Rows that repeat, or
    have a null key, each have their row. Texts longer than ``spread`` characters are cut into pieces that are encoded as
    rows of their own and joined again; only they are shuffled. Extra columns are ignored; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vocabulary(tokenizer, folder))
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    result = "tokens int" if counts_only else "ids array<int>"
    whole = not FILES.get(tokenizer, tokenizer).endswith(".tiktoken")

    def finish(keys: pa.Array, ids: list[array]) -> pa.RecordBatch:
        out = pa.array([len(i) for i in ids], pa.int32()) if counts_only else _lists(ids)
        return pa.RecordBatch.from_arrays([keys, out], names=["key", "tokens" if counts_only else "ids"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*held.value)
        for b in batches:
            yield finish(b.column(0), [enc.encode(t, leaf) if t else array("i") for t in b.column(1).to_pylist()])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*held.value)
        for b in batches:
            ids = [enc.encode(t, leaf) for t in b.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("__key"), b.column("n"), b.column("piece"), _lists(ids)], names=["u", "__key", "n", "piece", "ids"])

    def together(table: pa.Table) -> pa.Table:
        enc = encoder(*held.value)
        order = np.argsort(table.column("n").to_numpy(), kind="stable")
        texts, lists = table.column("piece").to_pylist(), table.column("ids").to_pylist()
        ids = enc.concatenate([texts[i] for i in order], [array("i", lists[i]) for i in order])
        return pa.Table.from_batches([finish(table.column("__key").combine_chunks().slice(0, 1), [ids])])

    size = F.char_length("__text")
    is_long = F.coalesce(size > spread, F.lit(False)) if not whole else F.lit(False)
    out = rows.where(~is_long).mapInArrow(short, f"key {kind}, {result}")
    if not whole:
        n = F.explode(F.sequence(F.lit(0), F.floor((size - 1) / spread).cast("int"))).alias("n")
        # Numbered before the pieces are made: in one select each piece would get a number of its own.
        cut = rows.where(is_long).withColumn("u", F.monotonically_increasing_id()).select("u", "__key", "__text", n)
        cut = cut.select("u", "__key", "n", F.substr("__text", F.col("n") * spread + 1, F.lit(spread)).alias("piece")).repartition("u", "n")
        encoded = cut.mapInArrow(pieces, f"u long, __key {kind}, n int, piece string, ids array<int>")
        out = out.unionByName(encoded.groupBy("u").applyInArrow(together, f"key {kind}, {result}"))
    return out.withColumnRenamed("key", key)
