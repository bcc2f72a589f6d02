"""Features worked out before vectors are added, as the queries do, are those of the whole rows."""

import numpy as np

from lumenflow.plans import preference as P


def test_scalars_before_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 2, k, k, k // 4, k % 3, float(k), 50.0, 10.0, "bride", rng.normal(size=3).tolist(), rng.normal(size=2).tolist()) for k in range(20)]
    df = spark.createDataFrame(rows, "gallery_id long, photo_id long, display_order long, burst_id long, embed_group_id long, technical_pct double, aesthetic_pct double, sharpness_pct double, subject string, embedding array<double>, clip array<double>")
    vectors = df.select("photo_id", "embedding", "clip")
    add = lambda rows: rows.join(vectors, "photo_id")
    plain = P.scalars(df.drop("embedding", "clip"))
    got = P.centred(add(plain), P.gallery_means(df)).select("photo_id", "scalar", "emb").orderBy("photo_id").collect()
    want = P.features(df).select("photo_id", "scalar", "emb").orderBy("photo_id").collect()
    assert len(got) == 20
    for g, w in zip(got, want):
        assert np.allclose(g.scalar, w.scalar) and np.allclose(g.emb, w.emb)
