"""MinHash banding over word shingles, and the exact measures that verify its candidates."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.durable import materialise
from tallyard.operators.spread import spread

SHINGLE, SIMILAR = 5, 0.8
#: 12 bands of 4: a pair of similarity 0.8 meets in some band with probability 0.998.
BANDS, ROWS = 12, 4
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def shingle_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles(text: str | None, k: int = SHINGLE) -> set[tuple[str, ...]]:
    w = shingle_words(text)
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else set()


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x and y else float(a == b)


#: Beginnings of this many words are measured: a text of n words is compared over more than half of them.
BEGINNINGS = tuple(6 * 2**i for i in range(40))
ENDS = np.array(BEGINNINGS) - SHINGLE + 1
#: 6 bands of 3 for each beginning: similarity 0.8 meets with probability 0.986, an exact beginning always.
PREFIX_BANDS, PREFIX_ROWS = 6, 3


def grams_of(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(SHINGLE))))


def beginning_grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    """The shingles of the first n words, and of a quarter more for insertions."""
    return grams_of(words[: n + n // 4 + SHINGLE])


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(1, 1 << 63, n, dtype="uint64") | np.uint64(1), rng.integers(0, 1 << 63, n, dtype="uint64")


def _hashes(w: list[str]) -> np.ndarray:
    """A number for each shingle of at least five words, in order."""
    h = np.fromiter((crc32(x.encode()) for x in w), dtype="uint64", count=len(w))
    n = len(h) - SHINGLE + 1
    s = np.zeros(n, dtype="uint64")
    for i in range(SHINGLE):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return s ^ (s >> np.uint64(29))


def signature(text: str, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    w = shingle_words(text)
    if len(w) < SHINGLE:
        return None
    s = _hashes(w)
    n = len(s)
    least = np.full(len(a), np.iinfo("uint64").max, dtype="uint64")
    for at in range(0, n, 4096):
        least = np.minimum(least, (s[at : at + 4096, None] * a + b).min(axis=0))
    return least


def band_keys(texts: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, key): one row per text and band; texts of fewer than five words have none."""
    kind = texts.schema[id_col].dataType.simpleString()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _coefficients(bands * rows)
        mix = np.arange(1, rows + 1, dtype="uint64") * np.uint64(0xC2B2AE3D27D4EB4F)
        for pdf in batches:
            ids, out = [], []
            for i, t in zip(pdf["id"], pdf["text"]):
                if t and (s := signature(t, a, b)) is not None:
                    k = (s.reshape(bands, rows) * mix).sum(axis=1, dtype="uint64") * np.uint64(31) + np.arange(bands, dtype="uint64")
                    ids.extend([i] * bands)
                    out.append(k.view("int64"))
            if ids:
                yield pd.DataFrame({"id": ids, "key": np.concatenate(out)})

    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(keys, f"id {kind}, key bigint")


def prefix_keys(texts: DataFrame) -> DataFrame:
    """(tid, open, own, all) of ``texts`` (tid, text, open): band keys of the longest measured beginning, and of all of them.

    Texts of fewer than six words have none. The minima run on from one beginning to the
    next, so a text is hashed once however many beginnings it has.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _coefficients(PREFIX_BANDS * PREFIX_ROWS)
        mix = np.arange(1, PREFIX_ROWS + 1, dtype="uint64") * np.uint64(0xC2B2AE3D27D4EB4F)
        marks = np.array(BEGINNINGS, dtype="uint64")[:, None] * np.array([[0x9E3779B97F4A7C15]], dtype="uint64") + np.arange(PREFIX_BANDS, dtype="uint64")
        for pdf in batches:
            out = []
            for tid, text, is_open in zip(pdf["tid"], pdf["text"], pdf["open"]):
                w = shingle_words(text)
                if len(w) < BEGINNINGS[0]:
                    continue
                s, least = _hashes(w), np.full(len(a), np.iinfo("uint64").max, dtype="uint64")
                m = bisect_right(BEGINNINGS, len(w))
                ends = ENDS[:m]
                if ends[-1] <= 4096:
                    minima = np.minimum.accumulate(s[: ends[-1], None] * a + b, axis=0)[ends - 1]
                else:
                    rows, at = [], 0
                    for end in ends:
                        for lo in range(at, end, 4096):
                            least = np.minimum(least, (s[lo : min(lo + 4096, end), None] * a + b).min(axis=0))
                        rows.append(least)
                        at = end
                    minima = np.stack(rows)
                k = (minima.reshape(m, PREFIX_BANDS, PREFIX_ROWS) * mix).sum(axis=2, dtype="uint64") * np.uint64(31) + marks[:m]
                every = k.view("int64")
                out.append((tid, is_open, every[-1], every.ravel()))
            yield pd.DataFrame(out, columns=["tid", "open", "own", "all"])

    return spread(texts, "tid").mapInPandas(keys, "tid string, open boolean, own array<bigint>, all array<bigint>")


#: Members of a band that meet in a task; larger bands are split into blocks of pairs of parts.
PART = 1024


def verified_links(texts: DataFrame, id_col: str, text_col: str, part: int = PART) -> DataFrame:
    """(a, b): links between ids (strings) of distinct texts that span all pairs of similarity 0.8 or more.

    All members of a band are compared with each other, parts of ``part`` members by parts,
    unless links found before connect them already; a task writes a forest and never pairs.
    """
    keys = materialise(band_keys(texts, id_col, text_col), "bands")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int")
    m = keys.join(sizes, "key").select("key", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    m = m.select("key", "id", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")
    m = m.join(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held, root = None, [], {}

        def find(x: str) -> str:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for pdf in batches:
            out = []
            for key, lo, hi, own_, i, text in zip(pdf["key"], pdf["lo"], pdf["hi"], pdf["own"], pdf["id"], pdf["text"]):
                if (key, lo, hi) != group:
                    group, held, root = (key, lo, hi), [], {}
                grams = shingles(text)
                root[i] = i
                for own_2, i2, grams2 in held:
                    if lo != hi and own_2 == own_:  # these meet in the block of their own part
                        continue
                    small, large = sorted((len(grams), len(grams2)))
                    if small < SIMILAR * large or find(i) == find(i2):
                        continue
                    common = len(grams & grams2)
                    if common >= SIMILAR * (small + large - common):
                        root[find(i)] = find(i2)
                        out.append((i, i2))
                held.append((own_, i, grams))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=object)

    order = ("key", "lo", "hi")
    return m.repartition(*order).sortWithinPartitions(*order, "own").select(*order, "own", "id", "text").mapInPandas(links, "a string, b string").distinct()
