"""Quality of notes: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.notes import give_back, map_notes, noted, slices, small_batches
from emberline.llm.samples import labelled_sample

FEATURES = (
    "log_words", "word_bytes", "letters", "capitals", "digits", "stops", "symbols", "shouts", "bars", "gaps", "line_ends",
    "distinct_words", "repeated_next", "repeated_lines", "top_byte", "other_scripts", "symbol_words",
)


def _bytes_in(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars)).astype(float)


_UPPER, _LOWER, _DIGIT = _bytes_in(bytes(range(65, 91))), _bytes_in(bytes(range(97, 123))), _bytes_in(b"0123456789")
_GAP, _STOP, _SHOUT = _bytes_in(b" \t\n\r\x0b\x0c"), _bytes_in(b".,;:'\"-()"), _bytes_in(b"!?")
_HIGH = (np.arange(256) >= 128).astype(float)
_SYMBOL = 1.0 - np.clip(_UPPER + _LOWER + _DIGIT + _GAP + _STOP + _SHOUT + _HIGH, 0, 1)
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _STOP, _SYMBOL, _SHOUT, _GAP, _HIGH], 1)
_MARKS = frozenset(b"#$%&*+/<=>@\\^_`|~!?")


def note_features(notes: list[bytes]) -> np.ndarray:
    """One row of FEATURES per whole note; all shares are 0 for an empty one."""
    out = np.zeros((len(notes), len(FEATURES)))
    for r, note in enumerate(notes):
        if not note:
            continue
        counts = np.bincount(np.frombuffer(note, np.uint8), minlength=256)
        upper, lower, digit, stop, symbol, shout, gap, high = counts @ _CLASSES
        words, lines = note.split(), note.split(b"\n")
        n, size = max(len(words), 1), len(note)
        seen = max(size - gap, 1)
        out[r] = (
            np.log1p(len(words)), seen / n, (upper + lower + high) / seen, upper / max(upper + lower, 1), digit / seen, stop / seen, symbol / seen,
            shout / n, counts[124] / n, gap / size, len(lines) / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
            1 - len(set(lines)) / len(lines), np.delete(counts, 32).max() / seen, high / seen, sum(w[-1] in _MARKS for w in words) / n,
        )
    return out


class AdditiveModel:
    """Lookup tables per feature and per pair of features; the score is a sum over bins."""

    def __init__(self, edges: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]], coarse: list[np.ndarray], base: float):
        self.edges, self.tables, self.pairs, self.coarse, self.base = edges, tables, pairs, coarse, base

    @staticmethod
    def _leaves(g: np.ndarray, h: np.ndarray, splits: int, reg: float) -> np.ndarray:
        """Values per bin of a shallow tree: greedily the ``splits`` cuts that gain most, Newton steps in its leaves."""
        cuts = [0, len(g)]
        cg, ch = np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()])
        for _ in range(splits):
            best = (1e-9, None)
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo < 2:
                    continue
                at = np.arange(lo + 1, hi)
                lg, lh = cg[at] - cg[lo], ch[at] - ch[lo]
                rg, rh = cg[hi] - cg[at], ch[hi] - ch[at]
                gain = lg**2 / (lh + reg) + rg**2 / (rh + reg) - (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + reg)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(at[k]))
            if best[1] is None:
                break
            cuts = sorted([*cuts, best[1]])
        out = np.zeros(len(g))
        for lo, hi in zip(cuts, cuts[1:]):
            out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + reg)
        return out

    @classmethod
    def _plane(cls, g: np.ndarray, h: np.ndarray, reg: float) -> np.ndarray:
        """A tree of depth two over two features: the better of cutting rows first or columns first."""
        best, out = -1.0, np.zeros_like(g)
        for turn in (False, True):
            a, b = (g.T, h.T) if turn else (g, h)
            for cut in range(1, len(a)):
                value = np.zeros_like(a)
                for part in (slice(0, cut), slice(cut, None)):
                    value[part] = cls._leaves(a[part].sum(0), b[part].sum(0), 1, reg)
                gain = float((2 * value * a - value**2 * (b + reg / b.size)).sum())
                if gain > best:
                    best, out = gain, value.T if turn else value
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, bins: int = 32, coarse_bins: int = 6, rounds: int = 150, pair_rounds: int = 25,
            n_pairs: int = 6, rate: float = 0.15, splits: int = 3, reg: float = 2.0) -> AdditiveModel:
        """Cyclic boosting: every round visits each feature in turn, then the pairs that explain most of the rest."""
        share = float(np.clip(np.average(y, weights=weight) if len(y) else 0.5, 1e-3, 1 - 1e-3))
        base = float(np.log(share / (1 - share)))
        cut = lambda v, k: np.unique(np.quantile(v, np.arange(1, k) / k)) if len(v) else np.zeros(0)
        edges = [cut(x[:, f], bins) for f in range(x.shape[1])]
        coarse = [cut(x[:, f], coarse_bins) for f in range(x.shape[1])]
        tables = [np.zeros(len(e) + 1) for e in edges]
        if len(set(y.tolist())) < 2:
            return cls(edges, tables, [], coarse, base)
        where = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
        wide = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
        total = np.full(len(y), base)

        def slope():
            p = 1 / (1 + np.exp(-total))
            return weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)

        for _ in range(rounds):
            for f, at in enumerate(where):
                g, h = slope()
                n = len(tables[f])
                step = rate * cls._leaves(np.bincount(at, g, n), np.bincount(at, h, n), splits, reg)
                tables[f] += step
                total += step[at]
        g, h = slope()
        size = [len(e) + 1 for e in coarse]
        gain = {}
        for a, b in combinations(range(x.shape[1]), 2):
            cell = wide[a] * size[b] + wide[b]
            gain[a, b] = float((np.bincount(cell, g, size[a] * size[b]) ** 2 / (np.bincount(cell, h, size[a] * size[b]) + reg)).sum())
        chosen = sorted(gain, key=lambda k: (-gain[k], k))[:n_pairs]
        planes = {k: np.zeros((size[k[0]], size[k[1]])) for k in chosen}
        for _ in range(pair_rounds):
            for a, b in chosen:
                g, h = slope()
                cell, shape = wide[a] * size[b] + wide[b], (size[a], size[b])
                n = size[a] * size[b]
                step = rate * cls._plane(np.bincount(cell, g, n).reshape(shape), np.bincount(cell, h, n).reshape(shape), reg)
                planes[a, b] += step
                total += step.ravel()[cell]
        return cls(edges, tables, [(a, b, planes[a, b]) for a, b in chosen], coarse, base)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for a, b, plane in self.pairs:
            total += plane[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def fit_quality(observations: DataFrame, ratings: DataFrame, rating: str = "reliable", per_rating: int = 10_000) -> AdditiveModel:
    """Learn which notes are worth keeping from ``ratings`` (obs_id, 1 or 0).

    Ratings that are NULL teach nothing; an id rated twice counts with the smaller rating. The fit uses
    some ``per_rating`` rated notes of each value (chosen by id hash), weighted so that both
    values have their share of all ratings. Their features, 17 numbers a note, meet on the driver. Without
    two classes every note gets the prior (one half when there is no rating at all).
    """
    known = ratings.where(F.col("obs_id").isNotNull() & F.col(rating).isNotNull()).groupBy("obs_id").agg((F.min(rating) > 0).cast("int").alias("__y"))
    chosen = labelled_sample(known, "__y", per_rating).withColumnRenamed("obs_id", "__id")
    rows = observations.select("obs_id", "note").join(F.broadcast(chosen), F.col("obs_id") == F.col("__id")).drop("__id")
    columns = ", ".join(f"{f} double" for f in FEATURES)

    def make():
        return lambda notes: dict(zip(FEATURES, note_features(notes).T))

    got = map_notes(rows, make, columns, "__y").drop("obs_id").toPandas()
    got = got.sort_values(["__y", *FEATURES])  # the fit does not depend on arrival order
    x, y = got[list(FEATURES)].to_numpy(float), got["__y"].to_numpy(float)
    rated = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    share = {v: rated[v] / sum(rated.values()) / max((y == v).sum(), 1) * len(y) for v in rated}
    return AdditiveModel.fit(x, y, np.array([share[int(v)] for v in y]))


def score_notes(observations: DataFrame, model: AdditiveModel, keep_from: float = 0.3) -> DataFrame:
    """obs_id, score, predicted per observation: 0 to 1, and 1 where the score is ``keep_from`` or more.

    The whole note is read; a NULL note is an empty one and is scored like it. Repeated rows each get
    their row, a NULL obs_id is kept, other columns are ignored, an empty table gives an empty one.
    """
    sent = observations.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        return lambda notes: {"score": model.score(note_features(notes))}

    scored = map_notes(noted(observations), make, "score double")
    return scored.withColumn("predicted", (F.col("score") >= keep_from).cast("int"))


def keep_reliable(observations: DataFrame, model: AdditiveModel, keep_from: float = 0.3) -> DataFrame:
    """The rows of ``observations``, all columns, whose note scores ``keep_from`` or more.

    The same scores as ``score_notes``; a NULL note is judged as an empty one and stays NULL if kept.
    """
    sent = observations.sparkSession.sparkContext.broadcast(model)
    small_batches(observations.sparkSession)

    def keep(batches):
        for part in slices(batches):
            notes = part.column("note").cast(pa.binary()).fill_null(b"").to_pylist()
            yield part.filter(pa.array(sent.value.score(note_features(notes)) >= keep_from))
        give_back()

    return observations.mapInArrow(keep, observations.schema)
