"""Rounds in one task, and cuts within components, give what the matrix of distances gives."""

import numpy as np
import pytest

from lumenflow.operators import linkage


def partition(labels):
    return {frozenset(np.flatnonzero(labels == k).tolist()) for k in range(labels.max() + 1)}


def near_copies(rng, n, dims):
    c = rng.normal(size=(n // 8, dims))
    x = c[rng.integers(0, len(c), n)] + 0.2 * rng.normal(size=(n, dims))
    x[: n // 10] = x[n // 10 : 2 * (n // 10)]
    x[-n // 10 :] = x[0]  # more equal ones than a list holds
    return x


@pytest.mark.parametrize("kind", ["average", "ward"])
@pytest.mark.parametrize("few", [1, 40])
def test_rounds_of_lists_against_the_matrix(monkeypatch, kind, few):
    rng = np.random.default_rng(21)
    x, size = near_copies(rng, 500, 6), rng.integers(1, 5, 500).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = linkage._agglomerated(x, size, kind, 1 << 40)
    monkeypatch.setattr(linkage, "FEW", few)
    monkeypatch.setattr(linkage, "SCAN", (64, 96))
    got = linkage._agglomerated(x, size, kind, 0)
    assert np.allclose([h for *_, h in got], [h for *_, h in want], atol=1e-6) and len(got) == 499
    for k in (2, 36, 200):
        assert partition(linkage._labels(500, got[: 500 - k])) == partition(linkage._labels(500, want[: 500 - k]))


def test_chains_end_few_clusters_only(monkeypatch):
    """A chain reads all means at each step; groups of many vectors come to it after rounds."""
    seen, merges = [], linkage._merges
    monkeypatch.setattr(linkage, "_merges", lambda clusters, n: seen.append(n) or merges(clusters, n))
    x = near_copies(np.random.default_rng(22), 900, 16)
    assert len(linkage.ward_linkage(x, matrix_bytes=0)) == 899 and max(seen) <= 512


def test_cuts_cluster_near_vectors_only(monkeypatch):
    seen, merges = [], linkage._merges
    rng = np.random.default_rng(23)
    x = rng.normal(size=(900, 48))
    x = np.vstack([x, x[:200] + 0.1 * rng.normal(size=(200, 48)), x[:60], 3 * x[:20], np.zeros((4, 48))])
    all_ = linkage.average_linkage(x)
    monkeypatch.setattr(linkage, "_merges", lambda clusters, n: seen.append(n) or merges(clusters, n))
    near = linkage._near_linkage(x, 0.35)
    under = [h for *_, h in all_ if h <= 0.35]
    assert len(near) == len(under) == 280 and np.allclose([h for *_, h in near], under)
    assert partition(linkage._labels(len(x), near)) == partition(linkage._labels(len(x), all_[:280]))
    linkage.cut_groups(x)
    assert max(seen) < 10


def test_equal_vectors_need_no_lists(monkeypatch):
    """Each of few vectors occurs more often than a list is long."""
    seen, scan = [], linkage._Lists.scan
    monkeypatch.setattr(linkage._Lists, "scan", lambda self, rows: seen.append(self.n) or scan(self, rows))
    x = np.random.default_rng(24).normal(size=(520, 8))
    merges = linkage.ward_linkage(np.tile(x, (40, 1))[:3000], matrix_bytes=0)
    assert set(seen) == {520} and len(merges) == 2999 and sum(h == 0 for *_, h in merges) == 2480
