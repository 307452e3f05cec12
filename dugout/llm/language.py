"""Language identification with bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm.common import col

UNKNOWN = "und"
#: Code points of a gram; a gram may cover a word's start or end, which are white space.
GRAM = 4
#: Rows of the filter, and rows a gram sets.
SLOT_BITS, PROBES = 20, 3
#: The fit reads about so many documents of each language, and keeps grams found in at least this share of them.
DOCS_PER_LANGUAGE, MIN_SHARE = 1500, 0.01
#: Code points handled at once; longer texts are cut into pieces that overlap by a gram less one.
PIECE = 1 << 18
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=np.uint8, count=0x110000)


class Grams:
    """Hashes of the n-grams of many texts at once."""

    def __init__(self):
        self.letters = _letters()

    def pieces(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hash of each gram, index of its text), in pieces of bounded size."""
        held, of, size = [], [], 0
        for i, text in enumerate(texts):
            points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
            points = np.where(self.letters[points] > 0, points, 32).astype(np.uint64)
            # one blank for any run of other characters, one before and one behind
            points = np.concatenate([[32], points, [32]]).astype(np.uint64)
            points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
            for start in range(0, max(1, len(points) - GRAM + 1), PIECE):
                part = points[start : start + PIECE + GRAM - 1]
                if len(part) < GRAM:
                    continue
                held.append(part)
                of.append(i)
                size += len(part)
                if size >= PIECE:
                    yield self._hashed(held, of)
                    held, of, size = [], [], 0
        if held:
            yield self._hashed(held, of)

    def _hashed(self, parts: list[np.ndarray], of: list[int]) -> tuple[np.ndarray, np.ndarray]:
        points = np.concatenate(parts)
        lengths = np.array([len(p) for p in parts])
        text = np.repeat(np.array(of), lengths)
        n = len(points) - GRAM + 1
        hashes = np.zeros(n, dtype=np.uint64)
        for k in range(GRAM):
            hashes += points[k : k + n] * _ODD[k]
        ends = np.cumsum(lengths)
        whole = np.arange(n) + GRAM <= np.repeat(ends, lengths)[:n]
        hashes ^= hashes >> np.uint64(29)
        return hashes[whole] * _ODD[1], text[:n][whole]


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [(hashes >> np.uint64(64 - SLOT_BITS * (k + 1))) & mask for k in range(PROBES)]


class LanguageFilter:
    """Row i of planes holds one bit per language: whether one of its grams set slot i."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray]):
        self.languages = languages
        self.planes = np.zeros(((len(languages) + 63) // 64, 1 << SLOT_BITS), dtype=np.uint64)
        for i, name in enumerate(languages):
            for at in slots(grams[name]):
                self.planes[i // 64][at] |= np.uint64(1 << i % 64)
        share = np.array([
            float(np.count_nonzero(self.planes[i // 64] & np.uint64(1 << i % 64))) for i in range(len(languages))
        ]) / (1 << SLOT_BITS)
        self.false_rate = share**PROBES

    def counts(self, texts: list[str | None], grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Grams of each text, and those that pass each language's filter."""
        total = np.zeros(len(texts), dtype=np.int64)
        hits = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        for hashes, text in grams.pieces(texts):
            total += np.bincount(text, minlength=len(texts))
            at = slots(hashes)
            for p, plane in enumerate(self.planes):
                found = plane[at[0]]
                for rows in at[1:]:
                    found = found & plane[rows]
                for i in range(p * 64, min(p * 64 + 64, len(self.languages))):
                    bit = (found >> np.uint64(i % 64)) & np.uint64(1)
                    hits[:, i] += np.bincount(text, weights=bit, minlength=len(texts)).astype(np.int64)
        return total, hits

    def predict(self, texts: list[str | None], grams: Grams) -> tuple[list[str], np.ndarray]:
        """Best language and the share of the text's grams that it explains, false positives taken off."""
        total, hits = self.counts(texts, grams)
        wide = np.maximum(total, 1)[:, None]
        shares = np.clip((hits / wide - self.false_rate) / (1 - self.false_rate), 0.0, 1.0)
        best = shares.argmax(axis=1) if self.languages else np.zeros(len(texts), dtype=int)
        names, scores = [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            lettered = bool(self.languages) and text is not None and any(map(str.isalpha, text))
            names.append(self.languages[best[i]] if lettered else UNKNOWN)
            scores[i] = shares[i, best[i]] if lettered else 0.0
        return names, scores


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageFilter:
    """Filters of the grams that occur in enough of a sample's documents of each language.

    labelled: rows to learn from; those with a null language teach nothing. The sample holds about DOCS_PER_LANGUAGE
    documents of each language, chosen by a hash of their key; counts of documents per gram are aggregated by Spark,
    and what reaches the driver is at most one gram for each slot a language could fill.
    """
    known = labelled.filter(col(lang).isNotNull()).select(
        col(lang).alias("lang"), col(text).alias("text"), col(key).alias("key")
    )
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    chance = F.pmod(F.xxhash64(F.lit("language"), "key", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.join(F.broadcast(sizes), "lang").filter(chance * F.col("docs") < DOCS_PER_LANGUAGE)

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for batch in batches:
            each: list[list[np.ndarray]] = [[] for _ in range(len(batch))]
            for hashes, of in grams.pieces(batch["text"]):
                for i in np.unique(of):
                    each[i].append(hashes[of == i])
            for i, name in enumerate(batch["lang"]):
                found = np.unique(np.concatenate(each[i])) if each[i] else np.array([], dtype=np.uint64)
                yield pd.DataFrame({"lang": name, "gram": found.view(np.int64)})

    docs = {r["lang"]: r["docs"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).collect()}
    least = F.create_map(*[x for name, n in docs.items() for x in (F.lit(name), F.lit(max(min(2, n), MIN_SHARE * n)))]) if docs else None
    languages = sorted(docs)
    grams = {name: np.array([], dtype=np.uint64) for name in languages}
    if languages:
        kept = (
            sample.select("lang", "text")
            .mapInPandas(seen, "lang string, gram long")
            .groupBy("lang", "gram")
            .agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= least[F.col("lang")])
        )
        found = kept.select("lang", "gram").toPandas()
        for name, part in found.groupby("lang"):
            grams[name] = part["gram"].to_numpy().view(np.uint64)
    return LanguageFilter(languages, grams)


def too_short(text: Column) -> Column:
    """Whether a text has a letter but no gram, a single one between any other characters; nothing can be said of it."""
    return F.coalesce(F.rlike(text, F.lit(r"^\P{L}*\p{L}\P{L}*\z")), F.lit(False))


def identify(docs: DataFrame, model: LanguageFilter, *, text: str = "text") -> Column:
    """Column struct(lang, score) of a text.

    Null texts and texts without a letter are und with score 0. A tie goes to the language that comes first by name;
    a text of which no gram is known gets that one too, with score 0. Without any learned language all are und.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for texts in batches:
            names, scores = held.value.predict(list(texts), grams)
            yield pd.DataFrame({"lang": names, "score": scores})

    return predict(col(text))
