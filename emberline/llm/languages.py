"""Language of notes: the family first, then pairwise linear support vector machines within it."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.notes import map_notes, noted
from emberline.llm.samples import labelled_sample, squared_hinge

BUCKETS = 2048
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
# Letters in lower case, bytes of other scripts as they are, everything else a gap.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(note: bytes) -> bool:
    return any(97 <= c | 32 <= 122 for c in note[:64]) or _LETTER.search(note.decode("utf-8", "replace")) is not None


def ngram_features(notes: list[bytes]) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs and triples of every whole note."""
    sizes = np.fromiter(map(len, notes), np.int64, len(notes))
    out = np.zeros((len(notes), BUCKETS), np.float32)
    flat = np.frombuffer(b"".join(n.translate(_FOLD) for n in notes) + b"   ", np.uint8).astype(np.uint32)
    if not sizes.sum():
        return out
    row = np.repeat(np.arange(len(notes), dtype=np.int64), sizes)
    last = np.cumsum(sizes) - 1
    n, half = int(sizes.sum()), BUCKETS // 2
    pair = flat[:n] << 8 | flat[1 : n + 1]
    triple = pair << 8 | flat[2 : n + 2]
    for base, gram, tail in ((0, pair, 1), (half, triple, 2)):
        bucket = (gram * np.uint32(2654435761)) >> np.uint32(22)  # the top ten bits
        keep = np.ones(n, bool)
        for back in range(tail):  # grams do not reach into the next note
            at = last[sizes > back] - back
            keep[at] = False
        counts = np.bincount(row[keep] * half + bucket[keep], minlength=len(notes) * half).reshape(len(notes), half)
        out[:, base : base + half] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1) / 2)
    return out


class LanguageModel:
    """Families of languages, one machine per family against the rest, one per pair within a family."""

    def __init__(self, families: list[list[str]], family_w: np.ndarray, pair_w: dict[tuple[str, str], np.ndarray]):
        self.families, self.family_w, self.pair_w = families, family_w, pair_w

    @classmethod
    def fit(cls, x: np.ndarray, lang: np.ndarray) -> LanguageModel:
        """Families are found by average linkage of the languages' mean features, about sqrt(n) of them."""
        names = sorted(set(lang.tolist()))
        groups = [[n] for n in names]
        mean = {n: x[lang == n].mean(0) for n in names}
        near = lambda a, b: float(np.mean([mean[p] @ mean[q] for p in a for q in b]))
        while len(groups) > max(1, round(len(names) ** 0.5)):
            a, b = max(combinations(range(len(groups)), 2), key=lambda ab: near(groups[ab[0]], groups[ab[1]]))
            groups[a] = sorted(groups[a] + groups.pop(b))
        family_w = np.zeros((len(groups), BUCKETS + 1), np.float32)
        pair_w = {}
        for k, group in enumerate(groups):
            inside = np.isin(lang, group)
            if len(groups) > 1:
                family_w[k] = squared_hinge(x, np.where(inside, 1, -1).astype(np.float32))
            for p, q in combinations(group, 2):
                of = (lang == p) | (lang == q)
                pair_w[p, q] = squared_hinge(x[of], np.where(lang[of] == p, 1, -1).astype(np.float32))
        return cls(groups, family_w, pair_w)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language and a confidence in 0..1: the family's share times the mean of the won pairs."""
        sure = lambda m: 1 / (1 + np.exp(-3.0 * m))
        margin = x @ self.family_w[:, :-1].T + self.family_w[:, -1]
        family = margin.argmax(1)
        best = margin.max(1)
        score = sure(best) if len(self.families) > 1 else np.ones(len(x))
        names = np.empty(len(x), object)
        for k, group in enumerate(self.families):
            at = np.flatnonzero(family == k)
            votes = np.zeros((len(at), len(group)))
            trust = np.zeros((len(at), len(group)))
            for p, q in combinations(range(len(group)), 2):
                w = self.pair_w[group[p], group[q]]
                m = x[at] @ w[:-1] + w[-1]
                votes[:, p] += m >= 0
                votes[:, q] += m < 0
                trust[:, p] += sure(m)
                trust[:, q] += sure(-m)
            pick = (votes + trust / (len(group) + 1)).argmax(1)
            names[at] = np.array(group, object)[pick]
            if len(group) > 1:
                score[at] *= trust[np.arange(len(at)), pick] / (len(group) - 1)
        return names, np.clip(score, 0.0, 1.0)


def fit_languages(observations: DataFrame, label: str = "language", per_language: int = 1500) -> LanguageModel | None:
    """Learn from notes and their ``label``; NULL labels, NULL notes and notes without a letter teach nothing.

    The project's observations carry no language, so the label column is the caller's. The fit uses
    some ``per_language`` notes of each language (chosen by id hash); their features, 8 KB a note,
    meet on the driver. Returns None when there is nothing to learn from.
    """
    usable = observations.where(F.col("note").isNotNull() & F.col(label).isNotNull())
    chosen = F.broadcast(labelled_sample(usable.select("obs_id", label), label, per_language).select("obs_id").withColumnRenamed("obs_id", "__id"))
    rows = usable.select("obs_id", "note", label).join(chosen, F.col("obs_id") == F.col("__id")).drop("__id")

    def make():
        def features(notes: list[bytes]) -> dict:
            keep = [i for i, n in enumerate(notes) if has_letter(n)]
            x = ngram_features([notes[i] for i in keep]).astype(np.float16)
            return {"rows": keep, "x": [v.tobytes() for v in x]}

        return features

    got = map_notes(rows, make, "x binary", label).select(label, "x").toPandas()
    if got.empty:
        return None
    x = np.stack([np.frombuffer(v, np.float16) for v in got["x"]]).astype(np.float32)
    order = np.lexsort((*x.T[:4], got[label].to_numpy(str)))  # the fit does not depend on arrival order
    return LanguageModel.fit(x[order], got[label].to_numpy(object)[order])


def detect_language(observations: DataFrame, model: LanguageModel | None) -> DataFrame:
    """obs_id, lang_pred, score per observation, from the whole note and nothing else.

    A NULL note, one without a letter, or any note when there is no model, is ``und`` with score 0.
    Repeated rows each get their row, a NULL obs_id is kept, other columns are ignored, an empty table
    gives an empty one. Invalid UTF-8 is read with replacement.
    """
    sent = observations.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def detect(notes: list[bytes]) -> dict:
            names = np.full(len(notes), UNKNOWN, object)
            score = np.zeros(len(notes))
            at = np.array([i for i, n in enumerate(notes) if model is not None and has_letter(n)], int)
            if len(at):
                names[at], score[at] = model.predict(ngram_features([notes[i] for i in at]))
            return {"lang_pred": names.tolist(), "score": score}

        return detect

    return map_notes(noted(observations), make, "lang_pred string, score double")
