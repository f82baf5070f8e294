"""BPE encoding and decoding by forced-boundary splitting (operator 12).

A text becomes a row of initial symbols: one per byte, and another one for a
byte that ends a word. Two symbols that stand side by side in no token of the
vocabulary can never be merged, nor can anything that holds them, so between
them lies a certain cut. The table of such pairs follows from the merges: the
symbols that meet inside a token are the last of the left and the first of the
right part of some merge. All adjacent pairs of a batch are looked up in that
table at once; the fragments between the cuts are encoded independently, each
distinct one once, and their ids are concatenated. Word ends are cuts of this
kind too, since nothing follows a word end inside a token.

The vocabulary file (``tokenizers`` JSON of a BPE with word ends) is read on
the driver and broadcast; its size is that of the vocabulary. Strings of added
tokens inside a text become their own ids, as the library does by default.
Ids of words are remembered per task, up to ``REMEMBERED`` characters of them. Long texts
are cut where a space stands between two letters, which changes no word.

``encode`` gives ids as a binary column of little-endian unsigned 32-bit
integers, the layout of a shard of training tokens; ``decode`` turns such a
column into text as the library does where no decoder is set: the tokens in
order, one space between them.

Defined results: a null or empty text has no ids and decodes to an empty text;
ids without a token decode to nothing; repeated rows are encoded as often as
they come; extra columns are passed through, and an input column named like
an output column is replaced by the output.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from taskwatch.llm.common import fresh
from taskwatch.llm.ragged import row_slices
from taskwatch.session import ship_package

VOCABULARY = "word_bpe_49k.json"
#: characters of words whose ids are remembered, and symbols of fragments
REMEMBERED = 4_000_000
#: characters of a text that are held as words at once
PIECE = 1 << 20

# The library's tables are those of Unicode 16. Letters and numbers that
# the ``regex`` module knows from later versions, as ranges of code points; and pairs
# (first capital, last capital, first small letter) that Python's tables lack.
LATER_LETTERS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F)]
LATER_NUMBERS = [(0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6)]
LATER_CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
    (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]

#: each capital to its small letter without a look at its neighbours, so a final sigma is one like any other
_SMALL = {0x3A3: 0x3C3} | {c: small + c - a for a, b, small in LATER_CAPITALS for c in range(a, b + 1)}
_CAPITALS = regex.compile("[" + "".join(map(chr, _SMALL)) + "]")
_LATER = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER_LETTERS + LATER_NUMBERS) + "]"
_CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")
#: what is added to a symbol that ends a word
_END = 256


def _byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    names = dict(zip(shown, map(chr, shown))) | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


def _expected(spec: dict) -> str:
    """The word pattern of a file of this kind; anything else is refused."""
    model, parts = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or steps != ["NFC", "Replace", "Lowercase"] \
            or [p["type"] for p in parts] != ["Split", "ByteLevel"] or spec.get("decoder"):
        raise ValueError("not a BPE with word ends over normalised, lower-case text")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take their surroundings along are not supported")
    return parts[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")


def load(path: str) -> dict:
    """Tables of the vocabulary at ``path``; ``cut[a, b]`` says that the
    symbols a and b stand side by side in no token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pattern, vocab = _expected(spec), spec["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    chars = _byte_chars()
    first_ids = [vocab[c] for c in chars] + [vocab[c + "</w>"] for c in chars]
    head, tail = {i: s for s, i in enumerate(first_ids)}, {i: s for s, i in enumerate(first_ids)}
    cut, merges = np.ones((2 * _END, 2 * _END), dtype=bool), {}
    for rank, (a, b) in enumerate(pairs):
        left, right, made = vocab[a], vocab[b], vocab[a + b]
        merges[left, right] = (rank, made)
        cut[tail[left], head[right]] = False
        head[made], tail[made] = head[left], tail[right]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in added.items()}
    return {"first": first_ids, "merges": merges, "cut": cut, "pattern": pattern, "added": added,
            "tokens": [tokens.get(i) for i in range(max(tokens) + 1)]}


def merge(symbols: list[int], merges: dict) -> list[int]:
    """Ids of one fragment: the pair of lowest rank, the leftmost first, is
    merged until none is left."""
    n, sym = len(symbols), list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(merges[p][0], i, merges[p][1]) for i, p in enumerate(zip(sym, sym[1:])) if p in merges]
    heapq.heapify(heap)
    while heap:
        _, i, made = heapq.heappop(heap)
        j = after[i]
        if sym[i] is None or j >= n or merges.get((sym[i], sym[j]), (0, None))[1] != made:
            continue   # one of the two has been merged meanwhile
        sym[i], sym[j], after[i] = made, None, after[j]
        if after[j] < n:
            before[after[j]] = i
            found = merges.get((made, sym[after[j]]))
            if found:
                heapq.heappush(heap, (found[0], i, found[1]))
        h = before[i]
        if h >= 0:
            found = merges.get((sym[h], made))
            if found:
                heapq.heappush(heap, (found[0], h, found[1]))
    return [s for s in sym if s is not None]


class Codec:
    """Encodes texts with one vocabulary."""

    def __init__(self, table: dict):
        self.table = table
        pattern = table["pattern"]
        self.find = regex.compile(pattern).findall
        # the same words where a text holds later code points, which are neither letters nor numbers
        unlike = (pattern.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|{_LATER})")
                  .replace(r"[\p{L}]", rf"(?:(?!{_LATER})\p{{L}})").replace(r"[\p{N}]", rf"(?:(?!{_LATER})\p{{N}})"))
        self.find_later = regex.compile(unlike).findall
        self.later = regex.compile(_LATER).search
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(table["added"], key=len, reverse=True))) + ")") \
            if table["added"] else None
        self.first = np.array(table["first"], dtype=np.int64)
        self.fragments: dict[bytes, bytes] = {}
        self.symbols = 0   # of all remembered fragments
        self._forget()

    def _forget(self):
        # the key of an added token holds a space, so no word equals it
        self.known = {" " + t: np.array([i], dtype="<u4").tobytes() for t, i in self.table["added"].items()}
        self.chars = 0   # of all remembered words

    def words(self, text: str) -> list[str]:
        """Words of a normalised text."""
        text = unicodedata.normalize("NFC", text)
        if not text.isascii() and _CAPITALS.search(text):
            text = text.translate(_SMALL)
        text = text.lower()
        return self.find_later(text) if not text.isascii() and self.later(text) else self.find(text)

    def _pieces(self, text: str):
        """Lists of words (and keys of added tokens) of about ``PIECE`` characters."""
        for k, part in enumerate(self.added.split(text) if self.added else [text]):
            if k % 2:
                yield [" " + part]
                continue
            at = 0
            while len(part) - at > PIECE:
                stop = _CUT.search(part, at + PIECE)
                if stop is None:
                    break
                yield self.words(part[at:stop.start()])
                at = stop.start()
            if at < len(part):
                yield self.words(part[at:])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        for i, t in enumerate(texts):
            for found in self._pieces(t or ""):
                held.append((i, found))
                size += len(found)
                if size * 4 >= PIECE:
                    self._settle(held, out)
                    held, size = [], 0
        self._settle(held, out)
        return [b"".join(o) for o in out]

    def _settle(self, held, out) -> None:
        met = set().union(*(w for _, w in held)) if held else set()
        new = [w for w in met if w not in self.known]
        size = sum(map(len, new))
        if self.chars + size > REMEMBERED:
            self._forget()
            new = [w for w in met if w not in self.known]
            size = sum(map(len, new))
        self.chars += size
        if new:
            self.known.update(zip(new, self._encoded(new)))
        for i, found in held:
            out[i].append(b"".join(map(self.known.__getitem__, found)))

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids of words: all their symbols in one row, cut where no token goes on."""
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(r) for r in raw])
        sym = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint16)
        sym[ends - 1] += _END
        stops = np.append(np.flatnonzero(self.table["cut"][sym[:-1], sym[1:]]) + 1, len(sym))
        if self.symbols + len(sym) > REMEMBERED:
            self.fragments, self.symbols = {}, 0
        buffer, ids, at = sym.tobytes(), [], 0
        for stop in stops.tolist():
            key = buffer[2 * at:2 * stop]
            got = self.fragments.get(key)
            if got is None:
                got = np.array(merge(self.first[sym[at:stop]].tolist(), self.table["merges"]), dtype="<u4").tobytes()
                self.fragments[key] = got
                self.symbols += stop - at
            ids.append(got)
            at = stop
        # a word's end is a cut, so every word is a whole number of fragments
        last = np.searchsorted(stops, ends, side="left") + 1
        return [b"".join(ids[a:b]) for a, b in zip([0, *last[:-1].tolist()], last.tolist())]


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with ``ids`` (binary)."""
    spark = docs.sparkSession
    ship_package(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "ids"]
    table = spark.sparkContext.broadcast(load(path))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.BinaryType())])
    source = docs.select(*keep, F.col(text).alias(fresh(docs, "_encoded")))

    def run(batches):
        codec = Codec(table.value)
        for b in batches:
            for at, part in row_slices(b.column(b.num_columns - 1)):
                ids = codec.encode(part.to_pylist())
                rows = b.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(ids, pa.binary())],
                                                 names=[*b.schema.names[:-1], "ids"])

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", name: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``encoded`` with the text of the column ``ids``."""
    spark = encoded.sparkSession
    ship_package(spark)
    keep = [c for c in (encoded.columns if keep is None else keep) if c.lower() != name.lower()]
    tokens = spark.sparkContext.broadcast(load(path)["tokens"])
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField(name, T.StringType())])
    source = encoded.select(*keep, F.col(ids).alias(fresh(encoded, "_decoded")))

    def run(batches):
        known = tokens.value
        text = np.array(known + [None], dtype=object)
        for b in batches:
            for at, part in row_slices(b.column(b.num_columns - 1)):
                texts = []
                for raw in part.to_pylist():
                    got = text[np.minimum(np.frombuffer(raw or b"", dtype="<u4"), len(known))].tolist()
                    texts.append(" ".join(got if None not in got else [t for t in got if t is not None]))
                rows = b.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(texts, pa.string())],
                                                 names=[*b.schema.names[:-1], name])

    return source.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from taskwatch.llm.common import read
    path = public_tokenizers.path(VOCABULARY)
    ids = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path, keep=["doc_id"])
    return decode(ids, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
