"""Language identification by rank-order profiles.

A language profile is the ranked list of its most frequent character n-grams (one to three
characters, words padded by a blank); a document has the same kind of list, and the language
whose profile lies nearest by out-of-place distance wins. An n-gram at rank r of the document
and rank s of the profile costs abs(r - s); one that the profile lacks costs the profile's
length. Counting covers every training text whole: tasks count their own texts, Spark adds up.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from lexweave.llm.common import free_name, given_back, stored

PROFILE = 400  # n-grams in a profile
UNKNOWN = "und"
COUNTS = "lang string, gram bigint, n bigint"
CHUNK = 1 << 18  # characters that are counted at once, but for a longer word

_tables: list = []


def _letters() -> tuple:
    """(is letter, lower case) for every code point; built once per process."""
    if not _tables:
        letter = np.zeros(0x110000, bool)
        lower = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if unicodedata.category(c)[0] == "L":
                letter[i] = True
                small = c.lower()
                if len(small) == 1:
                    lower[i] = ord(small)
        _tables.extend((letter, lower))
    return tuple(_tables)


def grams(text: str):
    """Codes of all n-grams of a text, or None if it has no letter.

    Letters are lower-cased, any other run is one blank, n-grams don't span a word. A code packs
    up to three code points, 21 bits each.
    """
    letter, lower = _letters()
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter[c]
    if not is_letter.any():
        return None
    c = np.where(is_letter, lower[c], np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    c, is_letter = c[keep], is_letter[keep]
    c = np.concatenate(([32], c, [32])).astype(np.int64)
    gap = c == 32
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate((c[~gap], two[~(gap[:-1] & gap[1:])], three[~gap[1:-1]]))


def _pieces(text: str):
    """A text in pieces of about ``CHUNK`` characters, cut where no letter stands."""
    letter, at = _letters()[0], 0
    while len(text) - at > CHUNK:
        cut = at + CHUNK
        while cut < len(text) and letter[ord(text[cut])]:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def gram_counts(text: str):
    """(codes, counts) of all n-grams of a whole text, piece by piece; None if it has no letter."""
    total = None
    for piece in _pieces(text):
        codes = grams(piece)
        if codes is not None:
            found = np.unique(codes, return_counts=True)
            total = found if total is None else _added(total, found)
    return total


def _added(a, b):
    """Counts of both together."""
    code, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return code, np.bincount(at, weights=np.concatenate((a[1], b[1]))).astype(np.int64)


def _ranked(counted, top: int):
    """The ``top`` most frequent codes, most frequent first, ties by code."""
    code, n = counted
    if len(code) > top:
        least = np.partition(n, len(n) - top)[len(n) - top]
        code, n = code[n >= least], n[n >= least]
    return code[np.lexsort((code, -n))][:top]


@dataclass(frozen=True)
class Profiles:
    """Languages and, for each, its n-grams in ascending order of code with their ranks."""

    langs: tuple
    codes: tuple
    ranks: tuple
    size: int

    @classmethod
    def of(cls, ranked: dict, size: int) -> "Profiles":
        langs = tuple(sorted(ranked))
        order = [np.argsort(ranked[x], kind="stable") for x in langs]
        return cls(langs, tuple(ranked[x][o] for x, o in zip(langs, order)), tuple(order), size)

    def nearest(self, text: str | None) -> tuple[str, float]:
        """(language, score): score is 1 at a perfect match of ranks and 0 if no n-gram is known."""
        counted = gram_counts(text) if text else None
        if counted is None or not self.langs:
            return UNKNOWN, 0.0
        own = _ranked(counted, self.size)
        best, least = UNKNOWN, None
        for lang, code, rank in zip(self.langs, self.codes, self.ranks):
            at = np.minimum(np.searchsorted(code, own), len(code) - 1)
            away = np.where(code[at] == own, np.abs(rank[at] - np.arange(len(own))), self.size)
            total = int(away.sum())
            if least is None or total < least:
                best, least = lang, total
        return best, 1.0 - least / (self.size * len(own))


def learn(train: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of each non-null ``lang`` from all of ``text``; rows without either are skipped.

    Only counts leave the tasks; the driver gets ``size`` n-grams per language.
    """

    def count(batches):
        import pyarrow as pa

        kept: dict = {}
        for batch in (b.slice(a, 512) for b in batches for a in range(0, b.num_rows, 512)):
            pending: dict = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in _pieces(text):
                    codes = grams(piece)
                    if codes is not None:
                        held = pending.setdefault(lang, [])
                        held.append(codes)
                        if sum(map(len, held[-64:])) > CHUNK * 4 or len(held) >= 512:
                            _add(kept, lang, pending.pop(lang))
            for lang, held in pending.items():
                _add(kept, lang, held)
        for lang, (code, n) in kept.items():
            yield pa.record_batch([pa.array([lang] * len(code)), pa.array(code), pa.array(n)], names=["lang", "gram", "n"])

    def _add(kept, lang, held):
        code, n = np.unique(np.concatenate(held), return_counts=True)
        kept[lang] = _added(kept[lang], (code, n)) if lang in kept else (code, n.astype(np.int64))

    rows = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = stored(rows.mapInArrow(lambda b: given_back(count(b)), COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram_counts")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", "place")
    ranked: dict = {}
    for lang, gram, _ in sorted(top.collect(), key=lambda r: (r[0], r[2])):  # size rows per language
        ranked.setdefault(lang, []).append(gram)
    return Profiles.of({lang: np.array(g, dtype=np.int64) for lang, g in ranked.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score.

    ``und`` with score 0 for a text that is null or has no letter (or if nothing was learned);
    ties go to the language that sorts first. Columns of ``docs`` with those names are replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast(profiles)

    def each(parts):
        for texts in parts:
            found = [known.value.nearest(t) for t in texts]
            yield pd.DataFrame({"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    @pandas_udf("lang_pred string, score double")
    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return given_back(each(parts))

    found = free_name(docs, "found")
    out = docs.withColumn(found, nearest(F.col(text)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return out.select(*kept, F.col(found)["lang_pred"].alias("lang_pred"), F.col(found)["score"].alias("score"))
