import itertools
import random

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def jaccard(a, b):
    x, y = (set(zip(*(t.split()[i:] for i in range(5)))) for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_against_brute_force_jaccard(spark):
    rng = random.Random(7)
    texts = {}
    for i in range(40):  # one to seven scattered words of 300 replaced: similarities 0.97 to 0.79
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts[2 * i] = " ".join(words)
        for at in rng.sample(range(5, 290, 9), 1 + i % 7):
            words[at] = f"v{at}"
        texts[2 * i + 1] = " ".join(words)
    near = {b for a, b in itertools.combinations(texts, 2) if jaccard(texts[a], texts[b]) >= 0.8}
    assert 30 <= len(near) < 40
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in texts.items()], "doc_id long, text string, n_chars long")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(texts) - near
