"""Byte-pair encoding of whole texts with a public vocabulary, and decoding."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, without_columns

#: Encoded words that one generation of a worker's cache holds; two generations are kept.
CACHE = 1 << 17
#: Low bits of a merge that hold the symbol made.
BITS = 32
MADE = (1 << BITS) - 1


class Piece(NamedTuple):
    """An encoded word: its ids, the same in decimal, and its decoded tokens, the last two joined by spaces."""

    n: int
    ids: tuple[int, ...]
    decimal: str
    decoded: str


def byte_letters() -> list[str]:
    """The visible character that stands for each byte: itself where it is printable, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in visible}, 0x100
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


class Tokenizer:
    """Reads a tokenizer file with a BPE model, word-end suffix, lower-casing and byte-level letters."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this operator handles BPE files that normalise by NFC, white space and lower case")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        # An added token has its own id and string outside the model.
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        letters = byte_letters()
        # Symbols as numbers: letters, the same at a word's end, and whatever takes part in a merge or comes of one.
        self.symbols = list(dict.fromkeys([*letters, *(x + self.suffix for x in letters), *(x for a, b in merges for x in (a, b, a + b))]))
        number = {s: k for k, s in enumerate(self.symbols)}
        self.inner, self.last = [number[x] for x in letters], [number[x + self.suffix] for x in letters]
        #: By first symbol and second one, what they merge to: the symbol made, and the rank above its bits.
        none: dict[int, int] = {}
        self.merge = [none] * len(self.symbols)
        for k, (a, b) in enumerate(merges):
            if self.merge[number[a]] is none:
                self.merge[number[a]] = {}
            self.merge[number[a]][number[b]] = k << BITS | number[a + b]
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(split.replace(r"\s", r"\p{White_Space}"), regex.V0)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.cache = CACHE
        self.young: dict[str, Piece] = {}
        self.old: dict[str, Piece] = {}

    def merged(self, word: str) -> list[str]:
        """The symbols of one word after all merges.

        Symbols form a doubly linked list over positions. A heap holds the merge
        and place of every mergeable neighbour pair, the lowest rank first; an
        entry is stale when its pair's place has another merge or none, and is skipped.
        """
        raw, inner, merge = word.encode(), self.inner, self.merge
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # What each symbol and the one after it merge to; 0 where they don't, or there is none.
        made = [merge[a].get(b, 0) for a, b in zip(symbols, symbols[1:], strict=False)]
        made.append(0)
        heap = [(m, i) for i, m in enumerate(made) if m]
        heapify(heap)
        while heap:
            m, i = heappop(heap)
            if made[i] != m:
                continue
            j, symbol = after[i], m & MADE
            symbols[i], symbols[j], made[j] = symbol, -1, 0
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                made[i] = m = merge[symbol].get(symbols[k], 0)
                if m:
                    heappush(heap, (m, i))
            else:
                made[i] = 0
            h = before[i]
            if h >= 0:
                made[h] = m = merge[symbols[h]].get(symbol, 0)
                if m:
                    heappush(heap, (m, h))
        return [self.symbols[s] for s in symbols if s >= 0]

    def piece(self, word: str) -> Piece:
        found = self.young.get(word) or self.old.get(word)
        if found is None:
            symbols = self.merged(word)
            ids = tuple([self.vocab[s] for s in symbols])
            found = Piece(len(ids), ids, " ".join(map(str, ids)), " ".join(symbols))
        if len(self.young) >= self.cache:
            self.old, self.young = self.young, {}
        self.young[word] = found
        return found

    def normalised(self, text: str) -> str:
        # One character at a time, so a sigma at a word's end is lower-cased like any other.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str | None) -> list[Piece]:
        out: list[Piece] = []
        for k, stretch in enumerate(self.special.split(text or "") if self.special else [text or ""]):
            if k % 2:
                i = self.added[stretch]
                out.append(Piece(1, (i,), str(i), stretch))
            elif stretch:
                young, piece = self.young, self.piece
                out += [young.get(w) or piece(w) for w in self.split.findall(self.normalised(stretch))]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for p in self.pieces(text) for i in p.ids]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, joined by spaces as the file names no decoder."""
        return " ".join(self.text[i] for i in ids)


_LOADED: dict[str, Tokenizer] = {}


def encoded(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids: bool = True, decoded: bool = False, cache: int | None = None) -> DataFrame:
    """df with n_tokens (long), ids_sha256, decoded_sha256, and on request ids (array<int>) and decoded (string).

    Whole texts are encoded; a null text counts as empty: no tokens, and the
    digests of the empty string. Columns of these names, in capitals or not, are replaced, all other
    columns and repeated rows pass through, and an empty table stays empty. The
    driver reads the vocabulary file, whose size doesn't grow with the data,
    and broadcasts its content. Every worker keeps a cache of at most
    2 * ``cache`` encoded words (2 * CACHE where none is given), some 450 bytes each (reckoned).
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    made = {"n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}
    base = without_columns(df, made)
    made = {k: v for k, v in made.items() if k not in ("ids", "decoded") or {"ids": ids, "decoded": decoded}[k]}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), *(f"{k} {v[0]}" for k, v in made.items())])
    names = base.columns
    at_text = names.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _LOADED:
            _LOADED[tokenizer_path] = Tokenizer(content.value)
        tokenizer = _LOADED[tokenizer_path]
        tokenizer.cache = cache or CACHE
        for table in gathered(batches, 4 << 20):
            new: dict[str, list] = {k: [] for k in made if k != "ids"}
            flat, ends = array("i"), [0]
            for text in table.column(at_text).to_pylist():
                pieces = tokenizer.pieces(text)
                whole = " ".join([p.decoded for p in pieces])
                new["n_tokens"].append(sum([p.n for p in pieces]))
                new["ids_sha256"].append(hashlib.sha256(" ".join([p.decimal for p in pieces]).encode()).hexdigest())
                new["decoded_sha256"].append(hashlib.sha256(whole.encode()).hexdigest())
                if ids:
                    for p in pieces:
                        flat.extend(p.ids)
                    ends.append(len(flat))
                if decoded:
                    new["decoded"].append(whole)
            columns = {k: pa.array(x, made[k][1]) for k, x in new.items()}
            if ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
            out = pa.table([*table.columns, *(columns[k] for k in made)], names=[*names, *made])
            yield from out.to_batches()

    return base.mapInArrow(kernel, schema)


def decoded(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col, the text of its array of token ids: joined by the vocabulary map inside Spark.

    A null array gives null, an empty one the empty string; an id outside the
    vocabulary is an error.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        strings = Tokenizer(f.read()).text
    table = df.sparkSession.sparkContext.broadcast(strings)
    base = df.drop(out_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if x is None else " ".join([table.value[i] for i in x]) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, out_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), f"`{out_col}` string"])
    return base.mapInArrow(kernel, schema)
