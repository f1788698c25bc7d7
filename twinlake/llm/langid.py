"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Letters are lower-cased, all else becomes space; character pairs and triples of whole texts are counted in 4,096
hashed columns, damped by log(1 + n), weighted by inverse document frequency and normalised. Document frequencies
come from every training row. Each language gets several centroids by spherical k-means over a bounded sample of its
training rows (`sample` rows to be expected, chosen by a hash of id and text). The language of the centroid with the
greatest cosine is predicted, the cosine is the score, and a text further from its language's centroids than nearly
all training texts are, by a margin, is rejected.

Null texts and texts without letters are `und` with score 0, and rejected; so is everything where there is nothing to
learn from. Ties go to the language that sorts first. Very long texts are counted whole, a block of letters at a time.
Repeated rows count each, an empty table gives no rows. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm.common import map_arrow, need

COLUMNS, CENTROIDS, SAMPLE, MARGIN = 4096, 4, 600, 0.5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the columns
    centroids: np.ndarray
    languages: tuple[str, ...]  # of the centroids
    floors: dict[str, float]  # least accepted cosine


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True where a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(texts: list[str], most: int = 1 << 18) -> np.ndarray:
    """Hashed counts of letter pairs and triples, a row per text; `most` letters are looked at at once."""
    if not texts:
        return np.zeros((0, COLUMNS), np.float32)
    # two spaces before and one behind: no n-gram holds letters of two texts
    rows = [f"  {t.lower()} " for t in texts]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(r) for r in rows])
    every = "".join(rows) + "  "
    out = np.zeros(len(texts) * COLUMNS, np.int32)
    for at in range(0, len(row), most):
        size = min(most, len(row) - at)
        c = np.frombuffer(every[at : at + size + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(_letters()[c], c, np.uint32(32))
        first = int(row[at])
        place = (row[at : at + size] - first) * COLUMNS
        a, b, d = c[:size], c[1 : size + 1], c[2:]
        pair = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)
        triple = (pair ^ (pair >> np.uint32(15))) * np.uint32(0xC2B2AE3D) ^ d * np.uint32(0x27D4EB2F)
        some = (a != 32) | (b != 32)
        for h, use in ((pair * np.uint32(0x2C1B3C6D), some), (triple * np.uint32(0x297A2D39), some | (d != 32))):
            h = ((h ^ (h >> np.uint32(16))) & np.uint32(COLUMNS - 1)).astype(np.int32)
            n = np.bincount(place[use] + h[use])
            out[first * COLUMNS : first * COLUMNS + len(n)] += n.astype(np.int32)
    return out.reshape(len(texts), COLUMNS).astype(np.float32)


def vectors(texts: list[str], weights: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(texts)) * weights
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=v, where=n > 0)


def has_letters(t: str | None) -> bool:
    return bool(t) and (any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t)))


def chunks(n: int, of: int = 128):
    return (slice(i, i + of) for i in range(0, n, of))


def clusters(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from seeds that lie far apart; deterministic."""
    seeds = [int(np.argmax(v @ v.mean(axis=0)))]
    near = v @ v[seeds[0]]
    while len(seeds) < min(k, len(v)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[seeds[-1]])
    c = v[seeds].copy()
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-9)
    return c


def fit(train: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model | None:
    """A model from doc_id, text and lang; rows without text or language are left out."""
    train = need(train, "doc_id", "text", "lang").where("text is not null and lang is not null")

    def presence(cols: dict[str, list]) -> dict[str, list]:
        seen = np.zeros(COLUMNS, np.int64)
        for s in chunks(len(cols["text"])):
            seen += (counts(cols["text"][s]) > 0).sum(axis=0)
        at = np.flatnonzero(seen)
        return {"col": at.tolist(), "n": seen[at].tolist()}

    total = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not total:
        return None
    found = map_arrow(train.select("text"), presence, "col int, n long", 4096).groupBy("col").agg(F.sum("n").alias("n")).collect()
    weights = np.full(COLUMNS, np.log(1 + sum(total.values())) + 1, np.float32)
    for r in found:
        weights[r["col"]] = np.log((1 + sum(total.values())) / (1 + r["n"])) + 1
    # rows of a hash below each language's share; sizes vary as those of a random sample
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(sample / n)) for k, n in sorted(total.items())])
    part = train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30))

    def sparse(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"lang": [], "at": [], "n": []}
        for s in chunks(len(cols["text"])):
            for lang, t, row in zip(cols["lang"][s], cols["text"][s], counts(cols["text"][s]), strict=True):
                if has_letters(t):
                    at = np.flatnonzero(row)
                    out["lang"].append(lang)
                    out["at"].append(at.astype("<u2").tobytes())
                    out["n"].append(row[at].astype("<f4").tobytes())
        return out

    rows = map_arrow(part.select("lang", "text"), sparse, "lang string, at binary, n binary", 256).collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"])))
    languages, centres, floors = [], [], {}
    for lang in sorted({r["lang"] for r in rows}):
        own = [r for r in rows if r["lang"] == lang]
        v = np.zeros((len(own), COLUMNS), np.float32)
        for x, r in zip(v, own, strict=True):
            x[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<f4")
        v = np.log1p(v) * weights
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        c = clusters(v, centroids)
        centres.append(c)
        languages += [lang] * len(c)
        floors[lang] = float(np.quantile((v @ c.T).max(axis=1), 0.005)) * (1 - MARGIN)
    return Model(weights, np.concatenate(centres), tuple(languages), floors) if languages else None


def predict(df: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each whole text."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": cols["doc_id"], "lang_pred": [], "score": [], "rejected": []}
        for s in chunks(len(cols["text"])):
            texts = cols["text"][s]
            known = [i for i, t in enumerate(texts) if model and has_letters(t)]
            got = {}
            if known:
                cos = vectors([texts[i] for i in known], model.weights).astype(np.float64) @ model.centroids.T.astype(np.float64)
                best = cos.argmax(axis=1)
                got = {i: (model.languages[b], min(1.0, max(0.0, float(c[b])))) for i, b, c in zip(known, best, cos, strict=True)}
            for i in range(len(texts)):
                lang, score = got.get(i, ("und", 0.0))
                out["lang_pred"].append(lang)
                out["score"].append(score)
                out["rejected"].append(lang == "und" or score < model.floors[lang])
        return out

    return map_arrow(need(df, "doc_id", "text"), run, "doc_id long, lang_pred string, score double, rejected boolean", 1024)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """A quarter of the ids, never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def select(df: DataFrame, model: Model | None) -> DataFrame:
    """The rows of df, all columns, that are not rejected; without a model all rows."""
    from twinlake.llm.quality import keep_rows

    if model is None:
        return df

    def kept(texts: list[str | None]) -> list[bool]:
        out = []
        for s in chunks(len(texts)):
            known = [i for i, t in enumerate(texts[s]) if has_letters(t)]
            ok = [False] * len(texts[s])
            if known:
                cos = vectors([texts[s][i] for i in known], model.weights).astype(np.float64) @ model.centroids.T.astype(np.float64)
                for i, c in zip(known, cos, strict=True):
                    b = int(c.argmax())
                    ok[i] = bool(c[b] >= model.floors[model.languages[b]])
            out += ok
        return out

    return keep_rows(df, kept)
