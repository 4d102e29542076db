"""The corpus pipeline and its stages against brute force, on rows with null and repeated keys."""

import random

import corpus_pipeline
import pytest

from fieldloom.llm import packing, setjoin, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)


def prose(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60))


def kept_rows(rows):
    """Brute force: all pairs of shingle sets, connected groups, the least key of each."""
    sets = [frozenset(setjoin.shingles(t, {}).tolist()) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            same = len(a & b) >= 0.8 * len(a | b) if a and b else not a and not b and rows[i][:2] == rows[j][:2]
            if same and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        first.setdefault(group[i], i)
    return [rows[i] for i in first.values()]


def test_one_of_each_group_keeps_different_texts(spark):
    near = prose(7).split()
    rows = [(None, prose(1), "en"), (None, prose(2), "en"), (None, prose(3), "en"), (5, prose(3) + " tail", "en"), (6, prose(4), "en"), (6, prose(5), "en"), (6, prose(5), "en")]
    rows += [(8, " ".join(near), "en"), (9, " ".join([*near[:-1], "other"]), "en"), (9, prose(8), "en"), (10, prose(4) + " more", "en"), (-1, prose(9), "en")]
    rows += [(11, None, None), (None, None, None), (None, None, None), (12, "...", "en"), (12, "!!!", "en"), (13, "", None)]
    docs = frame(spark, rows)
    got = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(((i, t) for i, t, _ in kept_rows(rows)), key=repr)
    assert corpus_pipeline.one_of_each_group(spark, docs.limit(0), "").collect() == []


def test_language_stage_drops_noise_and_unknown_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(3)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(n)) for n in (60, 300, 1000)]
    other = ["Zażółć gęślą jaźń oraz wiele innych polskich słów, które trudno jest wymówić bez przygotowania", "漢字だけの文章はここにあります。これは日本語です", "12 34", None]
    odd = frame(spark, [(10**9 + i, t, None) for i, t in enumerate(noise + other)])
    got = corpus_pipeline.keep_known_language(spark, docs.select(*odd.columns).union(odd), SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.filter("text rlike '\\\\p{L}'").collect())


@pytest.fixture
def small(spark, tmp_path):
    """Tables with insults, near copies, null and repeated keys, texts without a letter and noise; and the rows."""
    rows = [(i, f"{prose(100 + i)}. {'you idiot' if i % 3 == 0 else 'the end'} {i}. {prose(300 + i)}", "en") for i in range(60)]
    rows += [(None, prose(1), "en"), (None, prose(2), None), (None, None, "en"), (70, "", "en"), (71, "12 34", "en"), (72, "Ж" * 9 + "ЩЪЫЮЯ" * 9, None), (1, prose(3), "en"), (1, prose(3), "en"), (73, prose(3) + " tail", "en"), (74, prose(4) + ". oh you idiot", None)]
    marks = [(i, 0, int(i % 3 == 0)) for i in range(50)] + [(None, 0, 1), (51, 0, None), (999, 1, 1), (2, 0, 0)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows, marks


def test_run_and_stages_against_brute_force(spark, small):
    sf_dir, rows, marks = small
    flat = lambda df: sorted(((r.doc_id, r.text, r.lang) for r in df.collect()), key=repr)
    known = sorted({(i, t, y) for i, t, _ in rows for k, _, y in marks if i is not None and i == k and t is not None and y is not None})
    known = [(t, y) for _, t, y in known]
    model, at = toxicity.train(known), toxicity.threshold(known)
    want = [r for r in rows if model.score(r[1])[0] < at]
    assert not any("idiot" in (t or "") for _, t, _ in want) and len(want) == len(rows) - 21
    docs = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert flat(docs) == sorted(want, key=repr)
    want = [r for r in want if any(c.isalpha() for c in r[1] or "") and "Ж" not in r[1]]
    docs = corpus_pipeline.keep_known_language(spark, docs, sf_dir)
    assert flat(docs) == sorted(want, key=repr)
    want = kept_rows(want)
    assert flat(corpus_pipeline.one_of_each_group(spark, docs, sf_dir)) == sorted(want, key=repr)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in out), key=repr) == sorted(((i, len(t.split())) for i, t, _ in want), key=repr)
    assert len({(r.bucket, r.batch, r.slot) for r in out}) == len(out) and all(r.n_tokens <= r.bucket_tokens for r in out)
    lengths = sorted({len(t.split()) for _, t, _ in want})
    assert {r.bucket_tokens for r in out} == set(packing.boundaries(lengths, [sum(len(t.split()) == n for _, t, _ in want) for n in lengths], 16))


def test_run_on_empty_tables(spark, small, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{small[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
