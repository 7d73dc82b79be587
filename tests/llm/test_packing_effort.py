import random

from tracewarden.llm import bin_packing


def test_packing_goes_on_while_it_can_be_better(spark, tmp_path):
    """Forty bins, cut into three pieces each: best fit needs 46, the few children of a fixed count 44."""
    rnd, lengths = random.Random(1), []
    for _ in range(40):
        a = rnd.randrange(251, 499)
        b = rnd.randrange(251, 750 - a)
        lengths += [a, b, 1000 - a - b]
    spark.createDataFrame(list(enumerate(lengths)), "uid long, length long").coalesce(1).write.parquet(str(tmp_path / "pieces"))
    pieces = spark.read.parquet(str(tmp_path / "pieces"))
    placed = {r["uid"]: (r["sequence_id"], r["offset"]) for r in bin_packing.pack(pieces, 1000).collect()}
    assert sorted(placed) == list(range(120))
    used = {}
    for uid, (bin_, offset) in placed.items():
        used.setdefault(bin_, []).append((offset, lengths[uid]))
    for held in used.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 1000
    assert len(used) <= 42, len(used)


def test_pieces_over_half_a_bin_bound_the_bins():
    there = bin_packing.Population([600, 600, 600, 100], 1000, random.Random(0))
    there.start(2)
    there.evolve(0, 5)
    assert there.least == 3 and there.crossovers == 0
