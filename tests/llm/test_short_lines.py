"""Lines under six words: crowded blocks and SimHashes far apart lose no link."""

from __future__ import annotations

import random

from test_lines import run, slow_dedup

LETTERS = [chr(c) for c in [*range(0x61, 0x7B), *range(0x3B1, 0x3C9)]]


def test_many_short_near_copies_are_one_group(spark):
    rows = [(i, f"subscribe to our newsletter {LETTERS[i % 50]}{LETTERS[i * 7 % 50]}") for i in range(100)]
    assert run(spark, rows) == slow_dedup(rows) == {i: "" if i else rows[0][1] for i in range(100)}


def test_pairs_beside_a_common_word(spark):
    """Two-word lines of one common word, some of which are near copies by the word or by the other one."""
    rng = random.Random(1)
    rows = [(i, f"overview {''.join(rng.choices('abcdefghijklm', k=12))}") for i in range(120)]
    rows += [(200 + i, f"{x[:-1]}z") for i, x in rows[:20]] + [(300 + i, f"overvieww {x[9:]}") for i, x in rows[20:40]]
    got = run(spark, rows)
    assert got == slow_dedup(rows) and sum(x == "" for x in got.values()) >= 40


def test_one_edited_letter_in_two_to_five_words(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(5, 9))) for _ in range(2 + i % 4)]
        at = rng.randrange(len(words))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:at], words[at][:-1] + "z", *words[at + 1 :]]))]
    assert run(spark, rows) == slow_dedup(rows)
