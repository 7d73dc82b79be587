"""The pipeline's stages on a small table with planted cases."""

import collections
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from test_operators import check_packing, plain_components, plain_dedup, plain_random_spans, plain_set, plain_toxicity, prose
from tracewarden.llm import toxicity
from tracewarden.llm.common import materialise


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, at = random.Random(21), tmp_path_factory.mktemp("corpus")
    docs, labels = [], []
    for k in range(300):
        words = prose(rnd, rnd.randint(40, 90)).split()
        if k % 6 == 0:
            for _ in range(8):
                words.insert(rnd.randrange(len(words)), rnd.choice(("awfuls", "nasty", "rotten")))
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 6 == 0)))
    passage = prose(rnd, 60)
    docs += [(400 + k, prose(rnd, 50) + "\n" + passage) for k in range(6)]
    docs += [(500, docs[1][1]), (501, docs[2][1].replace(" ", "  "))]
    # a near copy that differs in more than one word
    words = docs[7][1].split()
    words[3], words[-4] = "other", "thing"
    docs += [(502, " ".join(words)), (503, f"{prose(rnd, 30)} token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff end"), (504, None), (505, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder), "test")
        seen[name] = docs
        if name != "best-fit packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    text = {n: {r["doc_id"]: r["text"] for r in d.collect()} for n, d in seen.items() if n != "best-fit packing"}
    toxic = {k for k in range(300) if k % 6 == 0}
    left = set(text["toxicity"])
    assert len(toxic & left) <= 3 and len(set(range(300)) - toxic - left) <= 2
    lines = text["line dedup"]
    assert 500 not in lines and 501 not in lines and 504 in lines and 505 in lines
    assert [i for i in lines if i in range(400, 406) and "\n" in lines[i]] == [400]
    near = text["n-gram Jaccard join"]
    assert 7 in near and 502 not in near and 8 in near
    assert "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" not in text["secret scans"][503] and set(text["secret scans"]) == set(near)
    packed = seen["best-fit packing"].collect()
    assert {r["doc_id"] for r in packed} == set(near)
    check_packing(packed, 2048)


def test_every_stage_against_brute_force(spark, folder):
    """Each stage's rows, from those of the stage before, by plain Python."""
    import public_tokenizers
    from tokenizers import Tokenizer

    def rows(df):
        return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda r: r[0])

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = rows(docs)
    stages = dict(corpus_pipeline.STAGES)

    def step(name):
        nonlocal docs
        docs = materialise(stages[name](spark, docs, folder), "test")
        return docs

    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    learned = {k: marks[i] for k, (i, _) in enumerate(before) if i in marks and zlib.crc32(str(i).encode()) % 3 != 1}
    scores, _, _ = plain_toxicity([t for _, t in before], learned, toxicity.Settings())
    assert min(abs(x - 0.7) for x in scores) > 1e-6
    want = [r for r, x in zip(before, scores) if x < 0.7]
    assert rows(step("toxicity")) == want and len(want) < len(before)

    want = [(i, t) for i, t, n, exact, near in sorted(plain_dedup(want).elements()) if not n or n > exact + near]
    assert rows(step("line dedup")) == want

    sets = {i: plain_set(t) for i, t in want}
    ids = list(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = plain_components(ids, links)
    want = [(i, t) for i, t in want if not sets[i] or root[i] == i]
    assert rows(step("n-gram Jaccard join")) == want and links

    spans = plain_random_spans([t or "" for _, t in want])
    clean = []
    for (i, t), found in zip(want, spans):
        found = found | {m.span() for m in re.finditer(r"token\x20*=\x20*[A-Za-z0-9+/_.=-]{8,}|[0-9a-f]{32,}", t or "")}
        out, at = "", 0
        for a, b in sorted(found):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        clean.append((i, out + t[at:] if found else t))
    assert rows(step("secret scans")) == clean and clean != want

    packed = step("best-fit packing").collect()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = collections.Counter()
    for i, t in clean:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expected.update((i, p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for p, a in enumerate(range(0, len(ids), 2048)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == expected
    assert check_packing(packed, 2048) <= -(-sum(r["length"] for r in packed) // 2048) + 1


def test_empty_tables(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
