"""Benchmark decontamination by spaced seeds (operator 4).

Texts and benchmark items become token hashes. A seed is a fixed mask over
consecutive tokens whose zeros are ignored, so a substituted token under a
zero does not break a hit. The hashes of all masked windows of the items are
the test side; every masked window of every document is looked up in it, by a
join against a broadcast block of items. Around the hits, item and document
are aligned on the hit's diagonal and compared token by token: the best
segment, matches counting +1 and substitutions ``-PENALTY``, is a leak if it
has enough matching tokens. An item of at most ``SHORT``
tokens is judged whole: it leaked where ``MIN_SHARE`` of its tokens match on the
diagonal, wherever the substituted ones stand. Such items have more seeds, and
all of these placements are found; the four seeds of longer items can miss an
overlap of 16 tokens with four substitutions (one in 255 of those accepted).

Items go out in blocks of at most ``BLOCK_TOKENS`` tokens, each block bounded
on the driver and in every task, and each document is read once per block. No
row is shuffled: the decision about a document needs its text and the items.

Tokens are runs of letters and digits; Unicode punctuation separates like the
ASCII one, and in scripts written without spaces (``UNSPACED``) each character
is a token, so the numbers of tokens below are numbers of characters there.

Defined results: null or empty texts and items match nothing; items shorter
than the widest mask are looked for with any one token left out (all that
``MIN_SHARE`` allows), and below ``MIN_TOKENS`` tokens as the whole sequence, of
which ``leaks`` reports the first place and which are no reason for ``clean`` to
remove a document (a word or two are in many); repeated items are one item with the smallest id; repeated rows
are judged each by itself; a null key is returned as null; letter case and
punctuation do not matter; extra columns do not matter to ``leaks`` and
are passed through by ``clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from taskwatch.llm import ragged
from taskwatch.llm.common import fresh
from taskwatch.session import ship_package

#: 1: the token counts, 0: it is ignored (fixed seeds, weight 6)
MASKS = [(1, 1, 0, 1, 1, 0, 1, 1), (1, 0, 1, 1, 0, 1, 0, 1, 1), (1, 1, 1, 0, 0, 1, 0, 1, 0, 1),
         (1, 1, 0, 0, 1, 0, 0, 1, 1, 1)]
#: with these, any substitutions ``MIN_SHARE`` allows to items of ``SPAN`` to ``SHORT`` tokens are found (fixed seeds)
MORE = [(1, 1, 1, 1, 1, 1), (1, 0, 0, 1, 0, 0, 1, 1, 1, 1), (1, 1, 1, 0, 1, 1, 1)]
SPAN = max(map(len, MASKS))
#: shorter items are looked for as they are
MIN_TOKENS = 5
#: matching tokens a leak needs, or this share of a shorter item
MIN_MATCH = 12
MIN_SHARE = 0.8
#: the longest item of which ``MIN_SHARE`` is no more than ``MIN_MATCH``
SHORT = int(MIN_MATCH / MIN_SHARE)
PENALTY = 2
BLOCK_TOKENS = 200_000
_BITS = 22

#: letters of scripts without spaces between words (with the marks of long sounds)
UNSPACED = (r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tai_Le}\p{New_Tai_Lue}"
            r"\p{Tai_Tham}\p{Tai_Viet}\p{Javanese}\p{Balinese}\x{30FC}\x{FF70}]")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and offsets of lowered texts (see ``ragged.words``)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pc.invert(pc.string_is_ascii(texts)).fill_null(False)
    if pc.any(wide).as_py():
        spaced = pc.replace_substring_regex(texts.filter(wide), r"[\p{P}\p{S}\p{Z}]+", " ")
        texts = pc.replace_with_mask(texts, wide, pc.replace_substring_regex(spaced, f"({UNSPACED})", r" \1 "))
    return ragged.words(texts, ragged.NOT_ALNUM, lower=False)


def _short(n: int) -> list[tuple[int, ...]]:
    """Masks that find an item of ``n`` tokens with any one token left out: at
    an end, which also finds all of it, or within."""
    return [(1,) * (n - 1)] + [tuple(int(k != gap) for k in range(n)) for gap in range(1, n - 1)]


class Block:
    """Items of one block: their tokens and the index of their masked windows."""

    def __init__(self, ids: list[int], texts: list[str], least_tokens: int = 1):
        self.ids = np.array(ids, dtype=np.int64)
        self.tokens, self.offsets = tokens(pa.array(texts, pa.string()))
        n = np.diff(self.offsets)
        self.masks = []
        for mask, least, most in [(m, SPAN, np.inf) for m in MASKS] + [(m, SPAN, SHORT) for m in MORE] + [
                (m, k, k) for k in range(MIN_TOKENS, SPAN) for m in _short(k)] + [
                ((1,) * k, k, k) for k in range(1, MIN_TOKENS)]:
            h, item, pos = ragged.windows(self.tokens, self.offsets, mask)
            use = (n[item] >= max(least, least_tokens)) & (n[item] <= most)
            h, item, pos = h[use], item[use], pos[use]
            if len(h):
                order = np.argsort(h, kind="stable")
                h = h[order]
                bits = np.zeros(1 << _BITS, dtype=bool)
                bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
                self.masks.append((mask, h, item[order], pos[order], bits, most < MIN_TOKENS))

    def candidates(self, tokens, offsets):
        """Distinct ``(text, item, diagonal)`` of all hits."""
        out = []
        for mask, index, item, ipos, bits, whole in self.masks:
            h, text, pos = ragged.windows(tokens, offsets, mask)
            near = np.flatnonzero(bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(index, h[near], "left"), np.searchsorted(index, h[near], "right")
            count = hi - lo
            if not count.any():
                continue
            at = np.repeat(near, count)
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            hits = np.stack([text[at], item[k], pos[at] - ipos[k]])
            if whole:  # the first place of each text and item is enough
                hits = hits[:, np.unique(hits[:2], axis=1, return_index=True)[1]]
            out.append(hits)
        return np.unique(np.concatenate(out, axis=1), axis=1).T if out else np.empty((0, 3), dtype=np.int64)

    def verify(self, doc: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """``(start, tokens, matches)`` of the leak on this diagonal, if it is one."""
        own = self.tokens[self.offsets[item]:self.offsets[item + 1]]
        lo, hi = max(0, diagonal), min(len(doc), diagonal + len(own))
        same = doc[lo:hi] == own[lo - diagonal:hi - diagonal]
        if len(own) <= SHORT:
            at = np.flatnonzero(same)
            if len(at) < np.ceil(MIN_SHARE * len(own)):
                return None
            return lo + int(at[0]), int(at[-1] - at[0]) + 1, len(at)
        total = np.concatenate(([0], np.cumsum(np.where(same, 1, -PENALTY))))
        floor = np.minimum.accumulate(total)
        end = int(np.argmax(total - floor))
        start = int(np.argmin(total[:end + 1])) if end else 0
        matches = int(same[start:end].sum())
        if matches < MIN_MATCH:
            return None
        return lo + start, end - start, matches

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """``(row, item id, start, tokens, matches)``, the best per row and item."""
        best: dict = {}
        for first, part in ragged.row_slices(texts):
            own, offsets = tokens(part)
            for text, item, diagonal in self.candidates(own, offsets).tolist():
                found = self.verify(own[offsets[text]:offsets[text + 1]], item, diagonal)
                row = first + text
                if found and (found[2], -found[0]) > best.get((row, item), (0, 0))[:2]:
                    best[row, item] = (found[2], -found[0], found)
        return [(t, int(self.ids[i]), *f) for (t, i), (_, _, f) in sorted(best.items())]


def blocks(items: DataFrame, key: str = "item_id", text: str = "text", least_tokens: int = 1):
    """Broadcast blocks of the items of at least ``least_tokens``, made one after the other."""
    spark = items.sparkSession
    sized = (items.where(F.col(text).isNotNull()).groupBy(F.lower(F.col(text)).alias("text"))
             .agg(F.min(F.col(key).cast("long")).alias("id"))
             .withColumn("n", F.when(F.octet_length("text") > F.length("text"), F.length("text"))
                         .otherwise(F.length("text") / 2 + 1).cast("long")))  # tokens at most
    total = sized.agg(F.sum("n")).first()[0] or 0
    parts = -(-total // BLOCK_TOKENS)
    for b in range(parts):
        rows = sized.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == b).select("id", "text").orderBy("id").collect()
        if rows:
            yield spark.sparkContext.broadcast(Block([r["id"] for r in rows], [r["text"] for r in rows], least_tokens))


LEAKS = "doc_id long, item_id long, start long, n_tokens long, n_matches long"


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and leaked item: where it starts (in tokens), how
    long the segment is and how many of its tokens match."""
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.lower(F.col(text)).alias("text"))
    out = spark.createDataFrame([], LEAKS)
    for block in blocks(items):
        def run(batches, block=block):
            for b in batches:
                found = block.value.leaks(b.column(1))
                if found:
                    rows, *rest = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(rows)), *[pa.array(x, pa.int64()) for x in rest]],
                        names=["doc_id", "item_id", "start", "n_tokens", "n_matches"])

        out = out.unionByName(source.mapInArrow(run, LEAKS))
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak of an item of ``MIN_TOKENS`` or more,
    with the columns they came with."""
    ship_package(docs.sparkSession)
    columns, lowered = docs.columns, fresh(docs, "_lowered")
    for block in blocks(items, least_tokens=MIN_TOKENS):
        def run(batches, block=block):
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[f[0] for f in block.value.leaks(b.column(b.num_columns - 1))]] = False
                yield b.select(columns).filter(pa.array(keep))

        docs = docs.withColumn(lowered, F.lower(F.col(text))).mapInArrow(run, docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    from taskwatch.llm.common import read
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
