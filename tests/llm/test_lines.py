"""Recurring lines against a brute-force version of the template tree."""

import random
from collections import defaultdict

import duckdb
import pytest

from emberline.llm.lines import drop_recurring_lines
from emberline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def templates(line, depth, tokens, general):
    """Leaf, words after the leading ones and templates of a line; no leaf for a blank one."""
    raw = [t.decode() for t in line.encode().split()]
    if len(raw) < tokens:
        return ((("whole", *raw), None, {("whole", *raw)}) if raw else (None, None, set()))
    w = ["<*>" if any(c in "0123456789" for c in t) else t for t in raw]
    leaf, rest = (len(w), *w[:depth]), w[depth:]
    out = {(leaf, None, tuple(rest))}
    if len(w) >= general:
        for k in range(5):
            lo, hi = k * len(rest) // 5, (k + 1) * len(rest) // 5
            out.add((leaf, k, tuple(rest[:lo]), tuple(rest[hi:])))
    return leaf, tuple(rest) if len(w) >= 5 and rest else None, out


def opened(texts, depth, least):
    """(leaf, words) -> templates with scattered open words, from the texts that hold each different line."""
    seen, fits = defaultdict(int), defaultdict(set)
    for (leaf, words), who in texts.items():
        for at, w in enumerate(words):
            seen[leaf, at, w] += len(who)
    for leaf, words in texts:
        for level in (least * 4**k for k in range(14)):
            kept = tuple(w if seen[leaf, at, w] >= level else None for at, w in enumerate(words))
            if 0 < 5 * kept.count(None) <= len(words) + depth:
                fits[leaf, "open", kept].add((leaf, words))
    out = defaultdict(set)
    for t, lines in fits.items():
        for line in lines if len(lines) > 1 else ():
            out[line].add(t)
    return out


def brute(rows, depth=3, least=5, tokens=3, general=10):
    fits, texts, varied = defaultdict(set), defaultdict(set), defaultdict(set)
    notes = sorted({(i is None, i or 0, t or "") for i, t in rows})
    for note in notes:
        for k, line in enumerate(note[2].split("\n")):
            leaf, words, found = templates(line, depth, tokens, general)
            for t in found:
                fits[t].add((note, k))
            if words:
                texts[leaf, words].add(note[2])
                varied[leaf, words].add((note, k))
    for line, found in opened(texts, depth, least).items():
        for t in found:
            fits[t] |= varied[line]
    gone = defaultdict(set)
    for found in fits.values():
        if len({note[2] for note, _ in found}) >= least:
            for note, k in found - {min(found)}:
                gone[note].add(k)
    out = []
    for i, t in rows:
        drop = gone[i is None, i or 0, t or ""]
        lines = t.split("\n") if t else []
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in drop) if drop else t or "", len(lines), len(drop)))
    return sorted(out, key=str)


def scene():
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") * rng.randrange(1, 3)
    prose = lambda n: " ".join(word() for _ in range(n))
    boiler = ["Licensed under the Wide License", "See also page 12 of 40", "one two three four five six seven eight nine ten eleven twelve"]
    rows = []
    for k in range(60):
        lines = [prose(rng.randrange(1, 14)) for _ in range(rng.randrange(1, 5))]
        if k % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), boiler[0])
        if k % 4 == 0:
            lines.append(f"See also page {k} of {k + 50}")
        if k % 5 == 0:
            w = boiler[2].split()
            w[3 + k % 9] = f"x{'y' * (k % 7)}"
            lines.insert(0, " ".join(w))
        rows.append((k, "\n".join(lines)))
    whole = "\n".join(prose(12) for _ in range(4))
    rows += [(100 + k, whole) for k in range(8)]  # copies: nothing recurs
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, " \t\r\n x y"), (204, "\n".join(["same line here"] * 9)), (7, rows[7][1]), (None, f"z\n{boiler[0]}\nq"), (300, "é ü ñ " * 4000)]
    return rows


def test_matches_brute_force(spark):
    rows = scene()
    df = spark.createDataFrame([(i, t, "k", 2) for i, t in rows], "obs_id long, note string, line string, n_lines int")
    got = sorted((tuple(r) for r in drop_recurring_lines(df).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[3] for r in got) > 30


def test_copies_and_repeats_within_a_note_stay(spark):
    rows = scene()
    got = {r.obs_id: r for r in drop_recurring_lines(spark.createDataFrame(rows, "obs_id long, note string")).collect() if r.obs_id is not None}
    assert all(got[100 + k].n_dropped == 0 for k in range(8)) and got[204].n_dropped == 0
    assert got[0].n_dropped < got[3].n_dropped + 3


@pytest.mark.parametrize("carry", [["lang", "n_lines"]])
def test_carried_columns_and_empty_table(spark, carry):
    df = spark.createDataFrame([(1, "a b c", "x", 5), (2, None, None, None)], "obs_id long, note string, lang string, n_lines int")
    got = drop_recurring_lines(df, carry=["lang"]).collect()
    assert sorted((r.obs_id, r.note, r.lang) for r in got) == [(1, "a b c", "x"), (2, "", None)]
    assert drop_recurring_lines(df.limit(0)).count() == 0


def test_query_drops_planted_lines(spark):
    docs = dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    got = {r.doc_id: r for r in QUERIES["op3_line_dedup"](spark, SF).collect()}
    assert len(got) == len(docs)
    want = {r[0]: r for r in brute(list(docs.items()))}
    assert all((r.n_lines, r.n_dropped) == want[i][2:] for i, r in got.items())
