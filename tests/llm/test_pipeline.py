import random

import numpy as np

import corpus_pipeline
from tallyloom.llm import encode

from .helpers import classes, documents, edited, empty, odd_texts, prose
from .test_filters import plain
from .test_scans import pii_base


def test_pipeline_against_its_parts_by_brute_force(spark, tmp_path):
    rng = random.Random(11)
    items = [prose(rng, 30, 5000) for _ in range(5)]
    clean = [prose(rng, 120, 5000) for _ in range(20)]
    texts = [*clean, clean[0], edited(rng, clean[1], 2), prose(rng, 60, 5000) + " " + items[2] + " " + prose(rng, 60, 5000), prose(rng, 90, 5000) + " me@x.org " + prose(rng, 9, 5000), *odd_texts()]
    documents(spark, texts, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    left = []
    for i, t in enumerate(texts[:-1]):
        n, chars, symbols, dup, rep = plain(t)
        letters = [c for c in t or "" if c.upper() != c.lower()]
        bad = n < 50 or 100 * rep > 50 * n or not 2 * n <= chars <= 15 * n or 4 * symbols > n or 2 * dup > (t or "").count("\n") + 1
        if not bad and not (len(letters) >= 20 and 2 * sum(c.isupper() for c in letters) > len(letters)):
            left.append(i)
    cls = classes([texts[i] for i in left])
    left = [i for k, i in enumerate(left) if cls[k] == k]
    left = [i for i in left if not any(x.lower() in texts[i].lower() for x in items)]
    assert set(range(20)) <= set(left)
    assert sorted(out["doc_id"].unique().tolist()) == left
    ids_of = encode.encoder(encode.default_file())
    for i in left:
        t = texts[i]
        for k, a, e in sorted(pii_base(t), key=lambda s: -s[1]):
            t = t[:a] + "[" + ("EMAIL", "IP", "CARD", "PHONE")[k] + "]" + t[e:]
        assert out[out["doc_id"] == i]["length"].sum() == len(np.append(ids_of(t), 2))


def test_stages_take_an_empty_table_and_keep_columns(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 50)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        docs = stage(spark, docs, str(tmp_path))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
