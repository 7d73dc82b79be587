import random

import pytest
from pyspark.sql import functions as F

from tracewarden.llm.line_dedup import with_part_keys


def thirds(words, size):
    t = size // 3
    return {(0, size, " ".join(words[:t])), (1, size, " ".join(words[len(words) - t :]))}


def expected(words, least):
    """Texts that name the parts of a line: its ends, its middle, the same one place further, and the ends of a line a word shorter."""
    n = len(words)
    if n < least:
        return set()
    t = n // 3
    middles = {(2, n, " ".join(words[max(a, 0) : a + n - 2 * t])) for a in (t, t - 1)}
    return thirds(words, n) | middles | (thirds(words, n - 1) if n > least else set())


@pytest.mark.parametrize("least", [8, 1])
def test_parts_are_the_thirds_of_a_line(spark, least):
    """Lines of all sizes, with words of several bytes a letter: every part is where words that are put apart say it is."""
    rnd = random.Random(5)
    lines = [[rnd.choice(["a", "été", "日本", "word", "ü"]) for _ in range(n)] for n in [*range(1, 40), 8, 9, 10, 11, 12, 300]]
    rows = spark.createDataFrame([(" ".join(w), len(w)) for w in lines], "line string, n int")
    got = {r["line"]: set(r["parts"]) for r in with_part_keys(rows, "line", "n", least).collect()}
    made = sorted({p for w in lines for p in expected(w, least)})
    keys = spark.createDataFrame(made, "kind int, n int, part string").select("*", F.xxhash64("kind", F.col("n"), "part").alias("h")).collect()
    named = {(r["kind"], r["n"], r["part"]): r["h"] for r in keys}
    assert all(got[" ".join(w)] == {named[p] for p in expected(w, least)} for w in lines)
