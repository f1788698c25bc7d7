"""Quality by ordinal cumulative-link regression on graded ratings.

Grades: 0 for toxic, 1 for low quality, 2 for good. A text's distinct words, their closing marks, the beginnings that
two or more of its words share (families of ever new forms), and buckets of its length, repetition, capitals and marks
are hashed to 65,536 columns; one weight vector gives the score f, and ordered
thresholds give P(grade >= g) = sigmoid(f - threshold g). The expected grade is their sum, the tail probability that
of the best grade. It is fitted on a bounded sample of labelled rows (`sample` rows to be expected, by a hash of id
and text), four fifths for the weights, the rest for the cut that keeps all but `lose` of the good ones: the greatest
such cut, hence that with the greatest toxic recall. The model reports the toxic recall of the rest by language.

Null text counts as empty. Very long texts are read whole; what is collected of a sampled one are its distinct columns,
of which the `most` least by a hash stand for it, so that the sample's bytes are bounded too. Without labels every text
is kept, with expected grade and tail of null. Of several labels of an id the least quality and the greatest toxicity
hold. A text at the cut is kept; ties go no other way. Repeated rows are scored each, an empty table gives no rows;
other columns, whatever their names, take no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm.common import map_arrow, map_whole, need

COLUMNS, SAMPLE, LOSE, GRADES = 1 << 16, 8000, 0.005, 3
BEGINNINGS = (4, 5, 6, 7)
#: Columns of a sampled text that are collected at most.
MOST = 4096
_CACHE: dict[str, tuple[str, tuple[int, ...]]] = {}
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float  # least kept probability of the best grade
    toxic: dict[str, tuple[int, int]] = field(default_factory=dict)  # by language, the held-out toxic rows below the cut, and all


def forget() -> None:
    """Empty the words kept between texts."""
    _CACHE.clear()


def _column(feature: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(feature.encode()) & (COLUMNS - 1)


def _word(raw: str) -> tuple[str, tuple[int, ...]]:
    """A word's lower-cased stem, and the columns of it and its closing marks."""
    stem = raw.rstrip(_MARKS)
    marks = raw[len(stem) :]
    stem = stem.lower()
    out = []
    if stem:
        out.append(_column(f"w {stem}"))
    if marks:
        out.append(_column(f"m {marks[:8]}"))
    return stem, tuple(out)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct columns of a text."""
    words = (text or "").split()
    distinct = set(words)
    if len(_CACHE) > 100_000:
        _CACHE.clear()
    got: set[int] = set()
    stems: set[str] = set()
    for w in distinct:
        f = _CACHE.get(w)
        if f is None:
            f = _CACHE[w] = _word(w)
        stems.add(f[0])
        got.update(f[1])
    # in order, stems of one beginning stand side by side
    last = ""
    shared: set[str] = set()
    for stem in sorted(stems):
        for n in BEGINNINGS:
            begun = stem[:n]
            if len(last) < n or begun != last[:n]:
                break
            shared.add(begun)
        last = stem
    got.update([_column(f"b {x}") for x in shared])
    n, d = max(len(words), 1), max(len(distinct), 1)
    share = lambda x: int(8 * x)
    got.update(
        map(
            _column,
            (
                f"length {n.bit_length()}",
                f"repeated {n.bit_length() > 4} {share(1 - d / n)}",
                f"capitals {share(sum(map(str.isupper, distinct)) / d)}",
                f"marked {share(sum(not w[-1].isalnum() for w in distinct) / d)}",
                f"bars {share(sum(w == '|' for w in words) / n)}",
            ),
        )
    )
    lines = (text or "").split("\n")
    got.add(_column(f"lines {share(1 - len(set(lines)) / len(lines))}"))
    return np.array(sorted(got), np.int64)


def _bounded(at: np.ndarray, most: int = MOST) -> np.ndarray:
    if len(at) <= most:
        return at
    mixed = at.astype(np.uint32) * np.uint32(0x9E3779B1)
    return np.sort(at[np.argsort(mixed, kind="stable")[:most]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[np.ndarray], grades: np.ndarray, rounds: int = 150, rate: float = 0.1, l2: float = 2e-3, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient descent (Adam) on the cumulative-link likelihood."""
    n = len(rows)
    lengths = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n), lengths)
    often = np.bincount(flat, minlength=COLUMNS)
    use = often[flat] >= least
    flat, owner = flat[use], owner[use]
    w = np.zeros(COLUMNS)
    shares = np.clip([(grades >= g).mean() for g in range(1, GRADES)], 0.01, 0.99)
    # thresholds are the first one and the logs of the steps between, so that they stay in order
    start = -np.log(shares / (1 - shares))
    t = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    m = [np.zeros(COLUMNS), np.zeros(len(t))]
    v = [np.zeros(COLUMNS), np.zeros(len(t))]
    for k in range(1, rounds + 1):
        f = np.bincount(owner, w[flat], minlength=n)
        theta = np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])
        above = np.column_stack([np.ones(n), *[_sigmoid(f - x) for x in theta], np.zeros(n)])
        low, high = above[np.arange(n), grades], above[np.arange(n), grades + 1]
        p = np.maximum(low - high, 1e-9)
        slope = lambda a: a * (1 - a)
        df = -(slope(low) - slope(high)) / p / n
        dtheta = np.array([((grades == g + 1) * slope(above[:, g + 1]) / p - (grades == g) * slope(above[:, g + 1]) / p).sum() / n for g in range(GRADES - 1)])
        dt = np.concatenate([[dtheta.sum()], [dtheta[i:].sum() * np.exp(t[i]) for i in range(1, len(t))]])
        for x, g, a, b in ((w, np.bincount(flat, df[owner], minlength=COLUMNS) + l2 * w / 10, m[0], v[0]), (t, dt, m[1], v[1])):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-6)
    return w.astype(np.float32), np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])


def tails(rows: list[np.ndarray], weights: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= g) for g from 1 on, a row per text."""
    f = np.array([weights[r].sum(dtype=np.float64) for r in rows])
    return _sigmoid(f[:, None] - thresholds[None, :])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lose: float = LOSE) -> Model | None:
    """A model from documents and labels (doc_id, quality 0/1, toxic 0/1)."""
    graded = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    graded = graded.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade")).where("grade is not null")
    n = graded.count()
    if not n:
        return None
    chosen = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < sample / n * (1 << 30))
    docs = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    rows = need(docs, "doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")  # bounded by sample

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "lang": cols["lang"], "grade": cols["grade"], "at": [_bounded(features(t)).astype("<i4").tobytes() for t in cols["text"]]}

    got = map_arrow(rows.select("doc_id", "text", "lang", "grade"), run, "doc_id long, lang string, grade int, at binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["doc_id"], bytes(r["at"])))
    x = [np.frombuffer(r["at"], "<i4").astype(np.int64) for r in got]
    y = np.array([r["grade"] for r in got])
    tune = np.array([r["doc_id"] % 5 == 0 for r in got])
    if tune.all() or not tune.any():
        tune = np.arange(len(got)) % 5 == 0
    weights, thresholds = train([r for r, k in zip(x, tune, strict=True) if not k] or x, y[~tune] if (~tune).any() else y)
    good = tails([r for r, k, g in zip(x, tune, y, strict=True) if k and g == GRADES - 1], weights, thresholds)
    cut = float(np.quantile(good[:, -1], lose)) if len(good) else 0.0
    held = [(r["lang"] or "", a) for r, a, k, g in zip(got, x, tune, y, strict=True) if k and g == 0]
    below = tails([a for _, a in held], weights, thresholds)[:, -1] < cut if held else []
    toxic = {of: (sum(bool(b) for (lang, _), b in zip(held, below, strict=True) if lang == of), sum(lang == of for lang, _ in held)) for of in sorted({lang for lang, _ in held})}
    return Model(weights, thresholds, cut, toxic)


def score(df: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, expected_grade, tail, selected) of each whole text."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        n = len(cols["doc_id"])
        if model is None:
            return {"doc_id": cols["doc_id"], "expected_grade": [None] * n, "tail": [None] * n, "selected": [True] * n}
        p = tails([features(t) for t in cols["text"]], model.weights, model.thresholds)
        return {"doc_id": cols["doc_id"], "expected_grade": p.sum(axis=1).tolist(), "tail": p[:, -1].tolist(), "selected": (p[:, -1] >= model.cut).tolist()}

    return map_arrow(need(df, "doc_id", "text"), run, "doc_id long, expected_grade double, tail double, selected boolean", 1024)


def select(df: DataFrame, model: Model | None) -> DataFrame:
    """The rows of df, all columns, whose text is selected."""

    if model is None:
        return df
    return keep_rows(df, lambda texts: (tails([features(t) for t in texts], model.weights, model.thresholds)[:, -1] >= model.cut).tolist())


def keep_rows(df: DataFrame, kept) -> DataFrame:
    """The rows of df for whose texts `kept` says so; no join, whole rows pass through the worker."""

    def change(part):
        import pyarrow as pa

        return part.filter(pa.array(kept(part.column("text").to_pylist()), pa.bool_()))

    return map_whole(df, change, forget)
