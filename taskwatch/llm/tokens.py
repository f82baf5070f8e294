"""Token counts by rank-synchronous merging (operator 7).

Texts are cut into pre-tokens; the pre-tokens of a batch not met before are
held as one ragged numpy array of symbols. In each round every sequence finds
the lowest rank among its adjacent pairs and merges all its occurrences of
that pair, all sequences at the same time; sequences without a mergeable pair
leave with their number of symbols. Because a merge's result has a higher rank
than the merge itself, this equals merging pair by pair. Only pairs next to a
merge are looked up again.

The vocabulary file (``tokenizers`` JSON of a byte-level BPE) is read once on
the driver and broadcast as sorted arrays; its size is that of the vocabulary.
Strings of added tokens inside a text count as one token each, as the library
does by default. Counts of pre-tokens are remembered per task, at most
``REMEMBERED`` of them. Long texts are cut where a single space stands between
two words, which never changes the pre-tokens.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
are counted as often as they come; extra columns are passed through when named
in ``keep``.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from taskwatch.llm.common import fresh
from taskwatch.session import ship_package

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
REMEMBERED = 200_000
#: characters of text that are held as pre-tokens at once
PIECE = 1 << 20

#: how a byte-level vocabulary cuts text before merging (fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
_CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")
_NONE = np.int64(1 << 40)


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 characters for themselves, others from U+0100 upwards."""
    shown = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def load(path: str) -> dict:
    """Merge tables of the vocabulary at ``path``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
    right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
    span = np.int64(max(vocab.values()) + 1)
    key = left * span + right
    order = np.argsort(key, kind="stable")
    added = spec.get("added_tokens") or []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens that take white space along are not supported")
    return {"bytes": np.array([vocab[c] for c in _byte_symbols()], dtype=np.int64), "span": span,
            "key": key[order], "rank": order.astype(np.int64), "made": made[order],
            "added": sorted((t["content"] for t in added), key=len, reverse=True)}


def merge_counts(pretokens: list[bytes], table: dict) -> np.ndarray:
    """Symbols left of each pre-token (none empty) when no pair can be merged."""
    size = np.array([len(p) for p in pretokens], dtype=np.int64)
    sym = table["bytes"][np.frombuffer(b"".join(pretokens), dtype=np.uint8)]
    seq = np.repeat(np.arange(len(pretokens)), size)
    keys, last = table["key"], len(table["key"]) - 1

    def look(at):  # rank and product of the pairs that start at these places
        ok = at < len(sym) - 1
        nxt = np.minimum(at + 1, len(sym) - 1)
        ok &= seq[at] == seq[nxt]
        pair = sym[at] * table["span"] + sym[nxt]
        i = np.minimum(np.searchsorted(keys, pair), last)
        ok &= keys[i] == pair
        return np.where(ok, table["rank"][i], _NONE), np.where(ok, table["made"][i], 0)

    out = size.copy()
    if not len(sym):
        return out
    rank, made = look(np.arange(len(sym)))
    while len(sym):
        start = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        low = np.minimum.reduceat(rank, start)
        n = np.diff(np.concatenate((start, [len(sym)])))
        out[seq[start]] = n
        live = np.repeat(low < _NONE, n)
        low = np.repeat(low, n)
        if not live.all():
            sym, seq, rank, made, low = sym[live], seq[live], rank[live], made[live], low[live]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == low)
        # in a run of overlapping pairs (aaa) every second one is merged
        step = np.concatenate(([True], np.diff(hit) > 1))
        run = np.flatnonzero(step)
        offset = np.arange(len(hit)) - np.repeat(run, np.diff(np.concatenate((run, [len(hit)]))))
        hit = hit[offset % 2 == 0]
        sym[hit] = made[hit]
        stay = np.ones(len(sym), dtype=bool)
        stay[hit + 1] = False
        place = np.cumsum(stay) - 1
        sym, seq, rank, made = sym[stay], seq[stay], rank[stay], made[stay]
        new = place[hit]
        again = np.unique(np.concatenate((new, np.maximum(new - 1, 0))))
        rank[again], made[again] = look(again)
    return out


class Counter:
    """Counts tokens of texts with one vocabulary."""

    def __init__(self, table: dict):
        self.table, self.known = table, {}
        self.find = regex.compile(PATTERN).findall
        self.added = regex.compile("|".join(regex.escape(a) for a in table["added"])) if table["added"] else None

    def _pieces(self, text: str):
        for part in (self.added.split(text) if self.added else [text]):
            at = 0
            while len(part) - at > PIECE:
                cut = _CUT.search(part, at + PIECE)
                if cut is None:
                    break
                yield part[at:cut.start()]
                at = cut.start()
            if at < len(part):
                yield part[at:]

    def counts(self, texts: list[str | None]) -> list[int]:
        out = [len(self.added.findall(t)) if t and self.added else 0 for t in texts]
        held, chars = [], 0
        for i, t in enumerate(texts):
            for piece in self._pieces(t or ""):
                held.append((i, self.find(piece)))
                chars += len(piece)
                if chars >= PIECE:
                    self._settle(held, out)
                    held, chars = [], 0
        self._settle(held, out)
        return out

    def _settle(self, held, out) -> None:
        met = set().union(*(p for _, p in held)) if held else set()
        new = [p for p in met if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list(met)
        if new:
            self.known.update(zip(new, merge_counts([p.encode() for p in new], self.table).tolist()))
        for i, pre in held:
            out[i] += sum(map(self.known.__getitem__, pre))


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None,
                 limit: int = LIMIT) -> DataFrame:
    """``keep`` columns of ``docs`` with ``n_bytes``, ``n_tokens``, ``over_limit``."""
    spark = docs.sparkSession
    ship_package(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_bytes", "n_tokens", "over_limit")]
    table = spark.sparkContext.broadcast(load(path))
    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    source = docs.select(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                         F.col(text).alias(fresh(docs, "_counted")))

    def run(batches):
        counter = Counter(table.value)
        for b in batches:
            n = counter.counts(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())],
                                             names=[*b.schema.names[:-1], "n_tokens"])

    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from taskwatch.llm.common import read
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(VOCABULARY), keep=["doc_id"])
