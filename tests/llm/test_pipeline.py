import numpy as np

import corpus_pipeline
from pulseloom.llm import robust_quality, tier_packing, toxicity_fst
from tests.llm import test_shingle_sets
from tests.llm.test_robust_quality import brute_kept, brute_statistics, corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = corpus(400, 11)
    for k in range(0, len(rows), 7):
        words = rows[k][1].split(" ")
        words[len(words) // 2] = str(rng.choice(["grunk", "zlobber"]))
        rows[k] = (rows[k][0], " ".join(words), *rows[k][2:])
    rows += [(1000 + r[0], r[1].replace("a", "A"), *r[2:]) for r in rows[::9]] + [(5000, None, "en", "hot"), (5001, "", None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(r[0], 1, int("grunk" in (r[1] or "").lower() or "zlobber" in (r[1] or "").lower())) for r in rows[::2]], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    kept, _ = brute_kept([brute_statistics(r[1]) for r in rows], [(r[2], r[3]) for r in rows], robust_quality.LEAST)
    rows = [r for r, k in zip(rows, kept) if k]
    stage = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = toxicity_fst.train(stage, labels)
    assert set(model.words) >= {"grunk", "zlobber"}
    clean = [r for r in rows if not {"grunk", "zlobber"} & set(r[1].lower().split())]
    assert 0 < len(clean) < len(rows)
    ids = {i for _, i in test_shingle_sets.brute_kept(clean)}
    left = {r[0]: r[1] for r in clean if r[0] in ids}
    assert len(left) < len(clean)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(left)
    assert sum(r["length"] for r in got) == sum(len(tier_packing.bpe.encode(t)) + 1 for t in left.values())
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, current, str(tmp_path)).columns == current.columns


def test_empty_and_repeated(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text, "en", "a", 1)] * 3 + [(None, text + " more", "en", "a", 1), (None, None, None, None, None), (2, " ".join(f"w{k}" for k in range(90)), None, None, None)]
    for name, data, want in (("empty", [], []), ("repeated", rows, [1, 2])):
        spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert [r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").select("doc_id").distinct().orderBy("doc_id").collect()] == want
