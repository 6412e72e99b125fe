"""The pipeline's stages, one after the other, each against brute force on what the stage before it left."""

import math
import re
from collections import Counter
from hashlib import md5

import numpy as np
import tiktoken

import corpus_pipeline
from stellara.llm import bpe, mixing, quality, simhash
from tests.llm.conftest import prose, write_tables
from tests.llm.test_native import cleaned, poisson

SF = "/root/testdata/sf0.001"


def plain_score(net: quality.Network, text: str | None) -> float:
    """The network by its definition, window by window."""
    data = (text or "").encode()
    data += bytes(-(len(data) + quality.WIDTH) % quality.HALF + quality.WIDTH + quality.HALF + quality.WIDTH)
    n = len(data) - quality.WIDTH
    windows = np.stack([net.embed[list(data[i : i + quality.WIDTH])].ravel() for i in range(0, n, quality.STEP)]).astype(np.float64)
    y = np.maximum(windows @ net.kernel + net.lift, 0).reshape(-1, quality.HALF // quality.STEP, quality.FILTERS).mean(axis=1)[:-1]
    chunks = (y[:-1] + y[1:]) / 2 if len(y) > 1 else y
    return 1 / (1 + math.exp(-float(chunks.max(axis=0) @ net.out + net.bias[0])))


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def survivors(rows: list) -> set:
    """The least id of each component of texts whose shingle sets have the similarity 0.8."""
    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in root}


def test_network_against_its_definition(spark, odd_docs):
    net = quality.fresh(3)
    got = Counter((r["text"], round(r["p"], 4)) for r in quality.score(odd_docs, net, column="p").collect())
    assert got == Counter((r["text"], round(plain_score(net, r["text"]), 4)) for r in odd_docs.collect())


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        seen[name] = (docs.collect(), after.collect())
        docs = after

    before, after = seen["quality"]
    net = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: plain_score(net, r["text"]) for r in before}
    unsure = {i for i, p in scores.items() if abs(p - quality.THRESHOLD) < 1e-4}
    assert {r["doc_id"] for r in after} - unsure == {i for i, p in scores.items() if p >= quality.THRESHOLD} - unsure

    before, after = seen["line_dedup"]
    want = cleaned([(r["doc_id"], r["text"]) for r in before if r["text"] is not None])
    assert len(before) == len(after) and all(r["text"] == want.get(r["doc_id"]) for r in after)

    before, after = seen["simhash_dedup"]
    assert Counter(r["doc_id"] for r in after) == Counter(survivors(before))

    before, after = seen["mixing"]
    sizes = Counter(r["source"] for r in before)
    whole, weight = len(before), sum(math.sqrt(n) for n in sizes.values())
    want = Counter()
    for r in before:
        u = (int(md5(f"{mixing.SEED}:{r['doc_id']}:1".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        want[r["doc_id"]] = poisson(math.sqrt(sizes[r["source"]]) / weight * whole / sizes[r["source"]], u)
    assert Counter(r["doc_id"] for r in after) == +want

    before, after = seen["byte_bpe"]
    library = tiktoken.Encoding("own", pat_str=bpe.vocabulary()[1], mergeable_ranks=bpe.parse_ranks(bpe.vocabulary()[0]), special_tokens={})
    text = {r["doc_id"]: r["text"] for r in before}
    assert len(before) == len(after) and all(r["token_ids"] == library.encode_ordinary(text[r["doc_id"]] or "") for r in after)


def test_run_and_odd_rows(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (10, 0, 1)], "doc_id long, quality int, toxic int")
    for name, docs in (("a", odd_docs), ("b", no_docs)):
        out = corpus_pipeline.run(spark, write_tables(tmp_path / name, documents=docs, labels=labels))
        assert out.columns == [c for c in docs.columns if c != "text"] + ["token_ids"] and out.count() <= 4 * odd_docs.count()


def test_near_copies_leave_one(spark):
    long = prose(3, 400)
    docs = spark.createDataFrame([(5, long), (2, long), (9, long.replace("alpha", "ALPHA")), (7, prose(8, 300))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.dedup(docs).collect()) == [2, 7]
