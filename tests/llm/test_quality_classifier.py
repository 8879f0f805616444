import math
from collections import Counter

import numpy as np

from loopwright.llm.quality_classifier import gram_buckets, gumbel, resample


def test_buckets_count_words_and_pairs():
    a, b, c = gram_buckets([b"One two one", b"", b"one TWO one"], 1 << 20)
    assert len(a) == 5 and len(b) == 0 and a.tolist() == c.tolist()
    assert sorted(Counter(a.tolist()).values()) == [1, 1, 1, 2]


def test_weights_match_brute_force(llm, make_docs):
    texts = {1: "good text here", 2: "good text again", 3: "junk junk junk", 4: None, 5: "text"}
    target = llm.createDataFrame([(1,), (2,), (2,), (None,), (77,)], "doc_id long")
    rows = resample(make_docs(list(texts.items())), target, buckets=64).collect()
    owns = dict(zip(texts, gram_buckets([t.encode() if t else None for t in texts.values()], 64)))
    raw, good = np.ones(64), np.ones(64)
    for d, own in owns.items():
        np.add.at(raw, own, 1)
        if d in (1, 2):
            np.add.at(good, own, 1)
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    for r in rows:
        assert math.isclose(r["log_weight"], ratio[owns[r["doc_id"]]].sum(), abs_tol=1e-9)


def test_gumbel_noise_has_its_mean_and_top_k_is_kept(llm, make_docs):
    noise = llm.range(20_000).select(gumbel(3, "id").alias("g"))
    mean, spread = noise.selectExpr("avg(g)", "stddev(g)").first()
    assert abs(mean - 0.5772) < 0.03 and abs(spread - math.pi / math.sqrt(6)) < 0.03
    docs = make_docs([(i, f"word{i % 13} of text {i}") for i in range(200)])
    rows = resample(docs, docs.filter("doc_id < 50").select("doc_id"), fraction=0.3).collect()
    kept = [r["draw"] for r in rows if r["kept"]]
    assert len(kept) == 60 and min(kept) > max(r["draw"] for r in rows if not r["kept"])


def test_odd_rows(llm, odd, none):
    target = odd.filter("doc_id = 5").select("doc_id")
    rows = resample(odd, target).collect()
    assert len(rows) == odd.count()
    assert all(r["log_weight"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert len({r["draw"] for r in rows if r["doc_id"] == 5}) == 1
    assert resample(none, target).collect() == []
    assert resample(odd, target.limit(0), fraction=1.0).filter("kept").count() == odd.count()
