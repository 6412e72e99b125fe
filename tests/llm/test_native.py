"""Sharding, mixing, line dedup and lookup sketches against brute force and SQL."""

import math
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from stellara.llm import iblt, lines, mixing, sharding
from tests.llm.conftest import prose, write_tables


def long_hash(v: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed)


def int_hash(v: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(v.to_bytes(4, "little", signed=True), seed)


def test_sharding_against_brute_force(spark):
    weights = [1.0, 2.0, 0.5, 1.0, 1.5]
    for r in sharding.place(spark.range(300), "id", weights[:4], weights[4]).collect():
        times = [-math.log(((int_hash(s, long_hash(r["id"], 42)) >> 11) + 0.5) / (1 << 53)) / w for s, w in enumerate(weights)]
        assert (r["shard"], r["grown_shard"]) == (times.index(min(times[:4])), times.index(min(times)))


def test_shards_follow_weights(spark):
    weights = [1.0, 2.0, 0.5, 1.0]
    shares = Counter(r["shard"] for r in sharding.place(spark.range(20_000), "id", weights).collect())
    for s, w in enumerate(weights):
        assert abs(shares[s] / 20_000 - w / sum(weights)) < 0.02


def test_one_more_shard_takes_rows_only_into_itself(spark):
    few = {r["id"]: r["shard"] for r in sharding.place(spark.range(3000), "id", [1.0] * 10, 1.0).collect()}
    many = {r["id"]: r["shard"] for r in sharding.place(spark.range(3000), "id", [1.0] * 11).collect()}
    moved = [i for i in few if few[i] != many[i]]
    assert moved and all(many[i] == 10 for i in moved) and len(moved) < 3000 / 11 * 1.4


def test_op3(spark, odd_docs, no_docs, tmp_path):
    got = sharding.op3(spark, write_tables(tmp_path / "a", documents=odd_docs)).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in odd_docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter({(i, len(t.encode()) + 16, zlib.crc32(t.encode())): n for (i, t), n in texts.items()})
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.op3(spark, write_tables(tmp_path / "b", documents=no_docs)).count() == 0


def test_slots_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 16)
    rows = sharding.place(spark.range(2000), "id", [1.0] * 3)
    out = sharding.slotted(rows, "id", ["id"], 2000, 3).collect()
    for s in range(3):
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own)))


def test_alike_rows_get_slots_of_their_own(spark):
    rows = spark.createDataFrame([(1, 0, 3), (2, 0, 2), (1, 0, 4)], "id long, shard int, times long")
    got = sorted((r["id"], r["slot"]) for r in sharding.slotted(rows, "id", ["id"], 9, 1, times="times").collect())
    assert Counter(i for i, _ in got) == {1: 7, 2: 2} and sorted(s for _, s in got) == list(range(9))


def test_placing_keeps_other_columns(spark):
    rows = spark.range(20).withColumns({"times": F.col("id") * 2, "row": F.col("id") * 3, "shard": F.lit(-1)})
    for r in sharding.place(rows, "id", [1.0, 1.0]).collect():
        assert (r["times"], r["row"]) == (r["id"] * 2, r["id"] * 3) and r["shard"] in (0, 1)


def test_bad_weights(spark):
    with pytest.raises(ValueError):
        sharding.place(spark.range(1), "id", [1.0, 0.0])


def poisson(rate: float, u: float) -> int:
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_mixing_against_brute_force(spark):
    rows = [(i, "big" if i % 3 else "small", f"t{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = Counter(r["doc_id"] for r in mixing.mix(docs, {"big": 1.0, "small": 3.0}).collect())
    for i, s, _ in rows:
        rate = 3000 * (0.25 if s == "big" else 0.75) / (2000 if s == "big" else 1000)
        u = (int(md5(f"{mixing.SEED}:{i}:1".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        assert got[i] == poisson(rate, u)
    assert abs(sum(n for i, n in got.items() if i % 3 == 0) / sum(got.values()) - 0.75) < 0.03


def test_mixing_large_rates_and_many_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "one", "x") for i in range(5)] + [(100 + i, f"s{i}", "y") for i in range(500)], "doc_id long, source string, text string")
    n = mixing.mix(docs, {"one": 1.0}).groupBy("source").count().collect()
    assert [r["source"] for r in n] == ["one"] and abs(n[0]["count"] - 505) < 120
    plain = Counter(map(tuple, mixing.mix(docs).collect()))
    import stellara.llm.common as common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    assert Counter(map(tuple, mixing.mix(docs).collect())) == plain


def test_mixing_odd_rows(spark, odd_docs, no_docs):
    out = mixing.mix(odd_docs)
    assert out.columns == odd_docs.columns and out.count() > 0
    assert mixing.mix(no_docs).count() == 0 and mixing.mix(no_docs, {"s0": 1.0}).count() == 0


def test_mixing_to_unequal_weights(spark):
    rows = mixing.op6(spark, "/root/testdata/sf0.01").collect()
    rates = {r["source"]: r["rate"] for r in rows}
    assert len(set(rates.values())) == 4 and all(rates[f"src{i}"] == pytest.approx(rates["src0"] * (1 + i % 4), abs=1e-5) for i in range(20))
    share = Counter(int(r["source"][3:]) % 4 for r in rows)
    assert all(abs(share[i] / len(rows) - (1 + i) / 10) < 0.04 for i in range(4))


def test_mixing_is_shuffled(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    ids = [r["doc_id"] for r in mixing.mix(docs).collect()]
    assert sum(a < b for a, b in zip(ids, ids[1:], strict=False)) < 0.6 * len(ids)


def cleaned(docs: list[tuple[int, str]]) -> dict[int, str]:
    """Line dedup by brute force over all templates."""

    def templates(line: str) -> list[tuple]:
        m = [lines.FIELD if any(c.isdigit() for c in t) else t for t in line.split()]
        n = len(m)
        out = [("line", *m)]
        if n >= lines.BLOCK_TOKENS:
            b = [tuple(m[n * i // 4 : n * (i + 1) // 4]) for i in range(4)]
            out += [(j, n, *m[: lines.LEAD], *(("|", *b[i]) for i in range(4) if i != j)) for j in (1, 2, 3)]
        return out

    where, held = defaultdict(list), defaultdict(set)
    for i, text in docs:
        for line in set(text.split("\n")):
            if line.strip():
                for t in templates(line):
                    where[t].append(i)
                    held[i, line].add(t)
    out = {}
    for i, text in docs:
        kept = []
        for line in text.split("\n"):
            if not any(min(where[t]) < i for t in held[i, line]):
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup_against_brute_force(spark):
    shared = prose(99, 55)
    own = lambda i: " ".join(chr(97 + (i * 7 + j) % 26) + chr(97 + i // 26) + chr(97 + (i * j) % 26) + "a" * j for j in range(20))
    docs = [(i, "\n".join([own(i), shared if i % 4 == 0 else prose(1000 + i, 9), f"posted by user{i} on day {i * 3} in the town of {'abc'[i % 3]}", "See you.", ""])) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup(frame).collect()}
    assert got == cleaned(docs)
    assert shared in got[0] and all(shared not in got[i] for i in range(4, 40, 4))
    assert all("posted" not in t for i, t in got.items() if i) and all("See you." not in t for i, t in got.items() if i)
    assert all(own(i) in got[i] for i in got)


def test_lines_that_only_begin_alike_stay(spark):
    docs = [(1, "The report was read by John in May"), (2, "The report was read at school last Tuesday"), (3, "It is a dog that I once had here"), (4, "It is a house on the hill over there")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(docs)


def test_short_lines_and_rows_without_an_own_id(spark):
    docs = [(1, "See you\nalpha"), (2, "See you\nbeta"), (None, "See you\ngamma"), (None, "gamma\nnew"), (5, "gamma\nfive"), (5, "six\nfive\nbeta"), (5, "six\nfive\nbeta")]
    got = Counter((r["doc_id"], r["text"]) for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == Counter([(1, "See you\nalpha"), (2, "beta"), (None, ""), (None, "new"), (5, "gamma\nfive"), (5, "six\nfive"), (5, "six\nfive")])


def test_line_dedup_odd_rows(spark, odd_docs, no_docs):
    out = lines.dedup(odd_docs, detail=False)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[1] == prose(1, 60) and got[2] == "" and got[3] is None and got[4] == "" and got[5] == " \n\t" and got[6] == "word"
    assert len(got[7]) == len(prose(7, 40_000)) and got[8] == "日本語 🎉 é\u0000"
    assert lines.dedup(no_docs).count() == 0


@pytest.mark.parametrize(("name", "query", "sql"), [("op6", mixing.op6, mixing.OP6_SQL), ("op9", lines.op9, lines.OP9_SQL)])
def test_sql(spark, name, query, sql):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got, want = query(spark, "/root/testdata/sf0.001").toPandas(), con.sql(sql).df()
    columns = sorted(got.columns)
    as_rows = lambda f: sorted(map(tuple, f[columns].astype(str).itertuples(index=False)))
    assert as_rows(got) == as_rows(want)


def pieces(text: str) -> set[str]:
    import re

    return set(re.findall(iblt.PIECES.replace("\\n", "\n"), text))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def check_sketches(docs, got):
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, signed(d[1]), d[1]))
    want = Counter()
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        e = edited(text, following)
        a, b, n = pieces(text), pieces(e), pieces(following)
        like = lambda x, y: round(len(x & y) / len(x | y), 9) if x | y else 1.0
        want[i, len(text), sha256(e.encode()).hexdigest(), like(a, b), like(a, n), len(a ^ b), len(a ^ n)] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9), r["edited_recovered"], r["next_recovered"]) for r in got) == want


def test_sketches_against_brute_force(spark, odd_docs, no_docs, tmp_path):
    docs = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    got = iblt.op1(spark, write_tables(tmp_path / "a", documents=odd_docs)).collect()
    check_sketches(docs, got)
    by = defaultdict(set)
    for r in got:
        by[dict((i, t) for i, t in docs)[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(f) == 1 for f in by.values())
    assert iblt.op1(spark, write_tables(tmp_path / "b", documents=no_docs)).count() == 0


def test_sketches_retry_larger_and_cross_buckets(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(iblt, "BUCKET_ROWS", 4)
    docs = [(i * i * 17, "\n".join(f"line {i if j % 3 else 0} {j}" for j in range(3 + 30 * (i % 5)))) for i in range(24)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = iblt.op1(spark, write_tables(tmp_path, documents=frame)).collect()
    check_sketches(docs, got)
    assert len(iblt.borders(frame.select(F.col("doc_id").alias("key")))) >= 5
    assert {r["next_level"] for r in got} - {0} and max(r["next_level"] for r in got) < iblt.LEVELS


def test_neighbours_of_distant_hot_and_null_ids(spark, monkeypatch, tmp_path):
    """One id far from all others, one id and no id with a third of the rows each: no bucket gets many rows."""
    monkeypatch.setattr(iblt, "BUCKET_ROWS", 8)
    monkeypatch.setattr(iblt, "STRIDE", 4)
    docs = [(1 << 60, "far away")] + [(i, f"own {i}") for i in range(60)] + [(17, f"hot {i}") for i in range(60)] + [(None, f"none {i}") for i in range(60)] + [(-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check_sketches(docs, iblt.op1(spark, write_tables(tmp_path, documents=frame)).collect())
    rows = frame.select("doc_id", F.struct(F.col("doc_id").isNull().cast("int").alias("void"), F.coalesce("doc_id", F.lit(0)).alias("key"), F.xxhash64("text").alias("mark")).alias("o"))
    sizes = rows.groupBy(iblt.bucket_of(F.col("o"), iblt.borders(frame.select(F.col("doc_id").alias("key")))).alias("b")).count().collect()
    assert max(r["count"] for r in sizes) <= 24 and len(sizes) > 12


def test_pieces_meet_again_after_an_insertion():
    line = " ".join(f"Sentence {i} of a long line that goes on for some words more." for i in range(80))
    a, b = pieces(line), pieces("Something new. " + line)
    assert len(a & b) >= len(a) - 4
