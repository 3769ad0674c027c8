"""The quality classifier: held-out labels, and posteriors of sites against a plain loop."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    weights = quality.fit(docs, labels.where(~held))
    rows = quality.evidence(docs.join(labels.where(held).select("doc_id"), "doc_id", "left_semi"), weights, ("doc_id",)).join(labels, "doc_id").select("own", "quality").collect()
    good, bad = ([r.own for r in rows if r.quality == q] for q in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    print("held-out AUC", round(auc, 3), len(good), len(bad))
    assert auc > 0.75


def test_posteriors(spark):
    rows = [(i, f"https://Big.example:80/a/{i}.html", "good words here " * (i % 3)) for i in range(30)]
    rows += [(100 + i, "https://big.example/b/x", "junk ### " * 5) for i in range(2)] + [(200, "http://small.example/only", "one lone text"), (201, None, None), (201, "no url", "")]
    docs = spark.createDataFrame(rows, "doc_id long, url string, text string").withColumns({"host": F.lit("clash"), "own": F.lit(1)})
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(100, 0)], "doc_id long, quality int")
    got = quality.classify(docs, labels, url="url").collect()
    assert len(got) == len(rows)
    assert {(r.host, r.path) for r in got} == {("big.example", "/a"), ("big.example", "/b"), ("small.example", "/"), ("", "")}
    p = {(i, r.host, r.path): 1 / (1 + math.exp(-r.own)) for i, r in enumerate(got)}

    def strength(groups):
        n, k = sum(map(len, groups)), len(groups)
        s, q = sum(map(sum, groups)), sum(x * x for g in groups for x in g)
        b = sum(sum(g) ** 2 / len(g) for g in groups)
        within = max((q - b) / (n - k), 1e-9)
        between = (b - s * s / n - (k - 1) * within) / max(n - sum(len(g) ** 2 for g in groups) / n, 1e-9)
        return min(1e6, within / max(between, 1e-9))

    hosts, paths = defaultdict(list), defaultdict(list)
    for (_, host, path), x in p.items():
        hosts[host].append(x)
        paths[host, path].append(x)
    mean = sum(p.values()) / len(p)
    mh, mp = strength(list(hosts.values())), strength(list(paths.values()))
    host_mean = {h: (sum(x) + mh * mean) / (len(x) + mh) for h, x in hosts.items()}
    logit = lambda x: math.log(min(max(x, 1e-4), 1 - 1e-4) / (1 - min(max(x, 1e-4), 1 - 1e-4)))
    for r in got:
        x = paths[r.host, r.path]
        path_mean = (sum(x) + mp * host_mean[r.host]) / (len(x) + mp)
        assert (r.host_mean, r.path_mean) == pytest.approx((host_mean[r.host], path_mean))
        assert r.score == pytest.approx(1 / (1 + math.exp(-(r.own + logit(path_mean) - logit(mean)))))
        if len(x) == 1:  # a site of one document lies between its own mean and its host's posterior
            assert min(x[0], host_mean[r.host]) - 1e-9 <= r.path_mean <= max(x[0], host_mean[r.host]) + 1e-9


def test_bounds_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c " * 20_000), (3, None)], "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit(None).cast("string")})
    labels = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    assert not quality.fit(docs, labels).any()  # the only labelled text is over the bound
    assert quality.fit(docs, labels, longest=50_000).any()
    assert [r.score for r in quality.classify(docs, labels.limit(0)).collect()] == [0.5] * 3
    assert quality.classify(docs.limit(0), labels).collect() == []
