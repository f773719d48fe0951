"""Recurring lines that are short, stand in blocks, or vary in some of their words."""

import random

from emberline.llm.lines import drop_recurring_lines


def dropped(spark, rows):
    """obs_id -> lines that are left."""
    got = drop_recurring_lines(spark.createDataFrame(rows, "obs_id long, note string")).collect()
    assert all(r.n_lines - r.n_dropped == len(r.note.split("\n")) or r.n_lines == r.n_dropped for r in got)
    return {r.obs_id: r.note.split("\n") if r.note else [] for r in got}


def prose(rng, n):
    return " ".join(f"p{''.join(rng.choice('abcdefgh') for _ in range(8))}" for _ in range(n))


def test_lines_of_one_and_two_tokens_recur_as_they_are(spark):
    rng = random.Random(1)
    rows = [(k, "\n".join([prose(rng, 7), "And ornd.", "", prose(rng, 9), "Les.", f"Page {k}", str(k), prose(rng, 2)])) for k in range(6)]
    rows += [(10 + k, f"{prose(rng, 6)}\nRare one.\n{prose(rng, 6)}") for k in range(4)]
    left = dropped(spark, rows)
    assert left[0] == rows[0][1].split("\n")
    for k in range(1, 6):
        assert left[k] == [x for x in rows[k][1].split("\n") if x not in ("And ornd.", "Les.")]
    assert all(len(left[10 + k]) == 3 for k in range(4))


def test_blocks_footers_and_single_line_notes_recur(spark):
    rng = random.Random(2)
    block = ["Top of the banner", "Middle of the banner", "End of the banner"]
    rows = [(k, "\n".join([prose(rng, 8), *block, prose(rng, 8), "Foot of the page", "Last line of all"])) for k in range(7)]
    rows += [(20 + k, f"Station report number {k} received") for k in range(6)]
    whole = "\n".join(prose(rng, 6) for _ in range(3))
    rows += [(50 + k, whole) for k in range(9)]
    left = dropped(spark, rows)
    assert left[0] == rows[0][1].split("\n") and len(left[20]) == 1
    assert all(len(left[k]) == 2 for k in range(1, 7))
    assert all(left[20 + k] == [] for k in range(1, 6))
    assert all(left[50 + k] == whole.split("\n") for k in range(9))


def test_scattered_and_short_variable_words_are_opened(spark):
    rng = random.Random(3)
    name = lambda: f"n{''.join(rng.choice('abcdefgh') for _ in range(9))}"
    few = [name() for _ in range(8)]
    frame = "This article first came out in the {} weekly and was sent to us by our reader {} who owns all rights to it"
    rows = [(k, f"{prose(rng, 8)}\nPosted in the {name()} section\n{prose(rng, 9)}") for k in range(8)]
    rows += [(20 + k, f"{prose(rng, 8)}\n{frame.format(name(), name())}") for k in range(8)]
    rows += [(40 + k, f"{prose(rng, 8)}\nWritten on a day for {few[k // 8]} readers and {few[k % 8]} writers of all ages") for k in range(64)]
    rows += [(200 + k, f"{prose(rng, 8)}\nWe saw that {prose(rng, 4)}") for k in range(8)]
    left = dropped(spark, rows)
    assert len(left[0]) == 3 and len(left[20]) == 2 and len(left[40]) == 2
    assert all(len(left[k]) == 2 for k in range(1, 8))
    assert all(len(left[20 + k]) == 1 for k in range(1, 8))
    assert all(len(left[40 + k]) == 1 for k in range(1, 64))
    assert all(len(left[200 + k]) == 2 for k in range(8))
