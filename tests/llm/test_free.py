"""Encoding, counting, fingerprints, graphs and classifiers against brute force, libraries and held-out rows."""

import math
import random
from collections import Counter, defaultdict
from functools import reduce
from hashlib import sha256
from operator import xor
from pathlib import Path

import numpy as np
import pytest
import regex
import tiktoken
import xxhash

from stellara.llm import bpe, components, hnsw, quality, simhash, toxicity, wordpiece
from stellara.llm.sample import labelled, unlabelled
from tests.llm.conftest import WORDS, prose, write_tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(*bpe.vocabulary())


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=bpe.vocabulary()[1], mergeable_ranks=codec.machine.ranks, special_tokens={})


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text), "<u4")


def test_transducer_equals_the_library(codec, library):
    rnd = random.Random(4)
    texts = ["", "a" * 5000, "aab" * 700, " \n\n  x\t", "日本語🎉 naïve ﬁ", "<|endoftext|>", "".join(rnd.choice("abcde fgh") for _ in range(30_000)), "".join(chr(rnd.randrange(32, 0x2000)) for _ in range(2000) if True).replace("՘", "").replace("֌", "").replace("౜", "")]
    for t in texts:
        assert ids_of(codec, t).tolist() == library.encode_ordinary(t)


def test_transducer_equals_merging_on_small_vocabularies(monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 7)
    for seed in range(12):
        monkeypatch.setattr(bpe, "FEW", 1 + 200 * (seed % 2))
        rnd = random.Random(seed)
        ranks = {bytes([b]): b for b in b"abc"}
        ranks = {b: i for i, b in enumerate(ranks)}
        while len(ranks) < 14:
            ranks.setdefault(rnd.choice(list(ranks)) + rnd.choice(list(ranks)), len(ranks))
        machine = bpe.Transducer(ranks)
        words = [bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 120 if k % 9 == 0 else 25))) for k in range(300)]
        want = [bpe.merge_by_rank(ranks, w) for w in words]
        assert [machine.encode(w) for w in words] == want
        count = np.array([len(w) for w in words], np.int32)
        ids, sizes = machine.encode_all(np.frombuffer(b"".join(words), np.uint8), np.cumsum(count, dtype=np.int32) - count, count)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_pieces_follow_the_rule(codec):
    rnd = random.Random(8)
    signs = ["a", "Z", "é", "日", "1", "٣", "²", " ", " ", " ", "\n", "\t", "\u00a0", "\u3000", "'", "'", "s", "re", "ll", "v", "!", "_", "🎉", "\u0000", "\u0301"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for _ in range(4000)] + ["", "'", "'s", " 's", "''s", "x'rex", "'r", "'v", " ", "  a", "a  "]
    data, first, count, per_text = codec.cut(texts)
    found = [data[a : a + n].tobytes().decode() for a, n in zip(first.tolist(), count.tolist(), strict=True)]
    split = regex.compile(bpe.vocabulary()[1]).findall
    assert bpe.vocabulary()[1] == bpe.RULE
    assert found == [p for t in texts for p in split(t)] and per_text.tolist() == [len(split(t)) for t in texts]


def test_slabs_and_other_rules(codec, library, monkeypatch):
    texts = [prose(k, 30 + 700 * (k % 5 == 0)) + "  \n x" * (k % 3) for k in range(40)] + ["", None, "日本語🎉" * 300, "ab" * 900]
    want = [library.encode_ordinary(t or "") for t in texts]
    for slab in (1 << 20, 1000, 37):
        monkeypatch.setattr(bpe, "SLAB", slab)
        assert [ids.tolist() for ids in codec.encode_many(texts)] == want
    monkeypatch.setattr(codec, "power", np.zeros(1 << 16, np.uint64))  # all hashes alike: bytes decide
    assert [ids.tolist() for ids in codec.encode_many(texts)] == want
    words = bpe.Codec(codec.machine.ranks, r"\w+")
    assert [ids.tolist() for ids in words.encode_many(["one, two!", "", "three"])] == [[i for w in t for i in library.encode_ordinary(w)] for t in (["one", "two"], [], ["three"])]


@pytest.mark.parametrize("step", [1, 2, 7, 1 << 16])
def test_streaming_decode_gives_whole_characters(codec, step):
    text = "é日本語 🎉👩‍👩‍👧 " + prose(5, 40) + "𝔘𝔫𝔦"
    out = list(codec.decode(ids_of(codec, text), step))
    assert "".join(p.decode() for p in out) == text


def test_decode_keeps_bytes_that_are_no_text(codec):
    for data in (b"\xff\xfe\x80", b"\xe6\x97", b"\xe6\x97A", b"\xed\xa0\x80", b"\xf0\x9f", b"\xc3\xc3\xa9"):
        ids = np.array([codec.machine.ranks[bytes([b])] for b in data])
        assert b"".join(codec.decode(ids, 1)) == data


def test_op2_odd_rows(spark, codec, library, odd_docs, no_docs, tmp_path):
    got = bpe.op2(spark, write_tables(tmp_path / "a", documents=odd_docs)).collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want
    assert bpe.op2(spark, write_tables(tmp_path / "b", documents=no_docs)).count() == 0
    ids = bpe.encode(odd_docs, *bpe.vocabulary())
    assert ids.columns == [c for c in odd_docs.columns if c != "text"] + ["token_ids"]
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in ids.collect()) == Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"] or ""))) for r in odd_docs.collect())


def greedy(pieces: set, word: tuple) -> int:
    n, i, most = 0, 0, max(map(len, pieces))
    while i < len(word):
        j = next((j for j in range(min(len(word), i + most), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


def test_automaton_equals_greedy_matching():
    for seed in range(8):
        rnd = random.Random(seed)
        pieces = {tuple(rnd.choice(b"ab" if seed % 2 else b"abc") for _ in range(rnd.randrange(1, 6))) for _ in range(12)} | ({(97,), (98,)} if seed % 4 < 2 else set())
        pieces |= {(*p, wordpiece.END) for p in list(pieces)[:6]}
        machine = wordpiece.Automaton(sorted(pieces))
        for _ in range(300):
            word = (*(rnd.choice(b"abc") for _ in range(rnd.randrange(12))), wordpiece.END)
            assert machine.count(word) == greedy(pieces, word)


def test_op4_odd_rows(spark, odd_docs, no_docs, tmp_path):
    import public_tokenizers

    data = Path(public_tokenizers.path("word_bpe_49k.json")).read_bytes()
    pieces = set(wordpiece.parse_vocabulary(data))
    found = {r: regex.findall(wordpiece.PATTERN, (r["text"] or "").lower()) for r in odd_docs.collect()}
    counts = {w: greedy(pieces, (*w.encode(), wordpiece.END)) for words in found.values() for w in set(words)}
    got = Counter(map(tuple, wordpiece.op4(spark, write_tables(tmp_path / "a", documents=odd_docs)).collect()))
    want = Counter((r["doc_id"], len(words), sum(counts[w] for w in words)) for r, words in [(r, regex.findall(wordpiece.PATTERN, (r["text"] or "").lower())) for r in odd_docs.collect()])
    assert got == want
    assert wordpiece.op4(spark, write_tables(tmp_path / "b", documents=no_docs)).count() == 0


def simple_fingerprint(text: str | None) -> int:
    words = regex.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(ids: list, fps: list[int], bits: int) -> dict:
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits and find(i) != find(j):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for k, i in enumerate(ids):
        least[find(k)].append(i)
    return {(i, f): min((x for x in least[find(k)] if x is not None), default=None) for k, (i, f) in enumerate(zip(ids, fps, strict=True))}


def test_op10_odd_rows(spark, odd_docs, no_docs, tmp_path):
    rows = odd_docs.collect()
    want = grouped([r["doc_id"] for r in rows], [simple_fingerprint(r["text"]) for r in rows], 4)
    got = simhash.op10(spark, write_tables(tmp_path / "a", documents=odd_docs)).collect()
    assert len(got) == len(rows) and {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in got} == want
    assert simhash.op10(spark, write_tables(tmp_path / "b", documents=no_docs)).count() == 0
    kept = simhash.dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 6, 7, 8, 10]
    assert simhash.dedup(no_docs).count() == 0


def test_op10_on_the_tables(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = grouped([r["doc_id"] for r in rows], [simple_fingerprint(r["text"]) for r in rows], 4)
    got = {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in simhash.op10(spark, SF).collect()}
    assert got == want and sum(k[0] != v for k, v in got.items()) > 10


def test_golay_keys_meet_within_four_bits():
    rng, g = np.random.default_rng(2), simhash.golay()
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * 2 + rng.integers(0, 2, 2000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for j in rng.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(j)
    sets = []
    for x in (a, b):
        own = [set() for _ in x]
        for keys, row in g.keys(x):
            for k, r in zip(keys.tolist(), row.tolist(), strict=True):
                own[r].add(k)
        sets.append(own)
    assert all(x & y for x, y in zip(*sets, strict=True))
    assert sum(map(len, sets[0])) / 2000 < 100


def test_long_runs_are_linked_like_short_ones(monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for c in centre]))
    sizes = []
    for run in (10_000, 4):
        monkeypatch.setattr(simhash, "RUN", run)
        forest = simhash.Forest()
        simhash.compare(np.zeros(len(fps), np.int32), fps, fps[:, None], 4, forest)
        sizes.append(Counter(forest.root(int(f)) for f in fps))
    assert sizes[0] == sizes[1] and len(sizes[0]) == 6


def shingles(text: str, words: int = 5) -> set:
    found = text.lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def test_wide_fingerprints_follow_similarity():
    rnd, most = random.Random(1), simhash.within(0.8, 4)
    near, far = [], []
    for seed in range(60):
        words = [f"{rnd.choice('abcdefgh')}{rnd.randrange(900)}" for _ in range(rnd.randrange(100, 900))]
        other = list(words)
        for i in rnd.sample(range(len(words)), max(1, len(words) // rnd.choice((30, 60, 150)))):
            other[i] = "new"
        a, b = " ".join(words), " ".join(other)
        similarity = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        distance = sum((x ^ y).bit_count() for x, y in zip(simhash.fingerprint(a.encode(), 5, 4), simhash.fingerprint(b.encode(), 5, 4), strict=True))
        if similarity >= 0.85:
            near.append(distance <= most)
        elif similarity < 0.6:
            far.append(distance <= most)
    unrelated = [simhash.fingerprint(" ".join(f"{seed}w{i}" for i in range(300)).encode(), 5, 4) for seed in range(40)]
    far += [sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) <= most for a, b in zip(unrelated, unrelated[1:], strict=False)]
    assert len(near) > 15 and np.mean(near) > 0.9 and np.mean(far) < 0.1


def test_equal_lanes_do_not_hide_a_near_copy(spark):
    rnd = random.Random(5)
    words = [f"{rnd.choice('abcdefgh')}{rnd.randrange(900)}" for _ in range(10_000)]
    own, at = simhash.fingerprint(" ".join(words).encode(), 5, 4), 0
    while True:
        other = " ".join([*words[:at], "new", *words[at + 1 :]])
        fps = simhash.fingerprint(other.encode(), 5, 4)
        if fps[:2] == own[:2] and fps != own:
            break
        at += 7
    docs = spark.createDataFrame([(1, " ".join(words)), (2, other)], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.dedup(docs).collect()] == [1]


def test_pairs_at_the_similarity_are_found_and_others_stay(spark):
    rnd, docs = random.Random(7), []
    for i in range(200):
        words = [f"{i}w{rnd.randrange(10**6)}" for _ in range(304)]
        other = list(words)
        # a changed word spoils 5 of 300 shingles: similarity 0.82 with 6 of them, 0.76 with 8
        for j in range(6 if i % 2 else 8):
            other[20 + 35 * j] = f"{i}new{j}"
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets = [shingles(t) for _, t in docs]
    near = [len(a & b) / len(a | b) >= 0.8 for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(near) == 100
    kept = {r["doc_id"] for r in simhash.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in docs if not (i % 2 and near[i // 2])}


def test_dedup_follows_the_components_of_exact_similarity(spark):
    """Revisions that chain around 0.8, some large, so that links of a band's least text do not suffice."""
    rnd, docs = random.Random(11), []
    for g in range(12):
        words = [f"{g}w{rnd.randrange(10**6)}" for _ in range(120)]
        for _ in range(25):
            words = list(words)
            words[rnd.randrange(len(words))] = f"v{rnd.randrange(10**6)}"
            words[rnd.randrange(len(words))] = f"v{rnd.randrange(10**6)}"
            docs.append((rnd.randrange(10**9), " ".join(words)))
    sets, root = [shingles(t) for _, t in docs], {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, _) in enumerate(docs):
        for m in range(k):
            if len(sets[k] & sets[m]) / len(sets[k] | sets[m]) >= 0.8:
                x, y = find(i), find(docs[m][0])
                root[max(x, y)] = min(x, y)
    kept = sorted(r["doc_id"] for r in simhash.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert kept == sorted({find(i) for i, _ in docs})


def test_rows_without_an_own_key_stay_if_their_texts_differ(spark):
    texts = [(None, prose(21, 60)), (None, prose(22, 60)), (None, prose(22, 60)), (None, prose(23, 60)), (4, prose(24, 60)), (4, prose(25, 60)), (4, prose(23, 60)), (4, prose(24, 60)), (9, prose(26, 60)), (9, prose(25, 60))]
    got = simhash.dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter({(None, prose(21, 60)), (None, prose(22, 60)), (4, prose(23, 60)), (4, prose(24, 60)), (4, prose(25, 60)), (9, prose(26, 60))})


def codewords() -> list[int]:
    return [reduce(xor, (simhash.GENERATOR << i for i in range(12) if m >> i & 1), 0) for m in range(1 << 12)]


def test_near_dedup_meets_in_golay_codewords_of_simhash(spark):
    """Keys of the stage against brute force: of the codewords within four bits of a segment, one that the fewest votes are against."""
    texts = ["one", prose(31, 8), prose(32, 90), prose(33, 700)]
    rows = {r["doc_id"]: r for r in simhash.set_marks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 5).collect()}
    words = codewords()
    for i, text in enumerate(texts):
        own = simhash.shingle_set(text.encode(), 5)
        votes = [sum(1 if int(h) >> b & 1 else -1 for h in own) for b in range(64)]
        assert rows[i]["checks"][0] % (1 << 64) == sum(1 << b for b, v in enumerate(votes) if v > 0)
        for segment in range(2):
            part = votes[segment * 23 : segment * 23 + 23]
            cost = {}
            for w in words:
                against = [abs(v) for b, v in enumerate(part) if (v > 0) != bool(w >> b & 1)]
                if len(against) <= 4:
                    cost[w >> 11] = sum(against)
            key = rows[i]["keys"][segment]
            assert key >> 12 == segment and cost[key & 4095] == min(cost.values())


def test_golay_keys_meet_at_the_similarity():
    rng = np.random.default_rng(12)
    for both, a, b in ((4, 0, 1), (8, 1, 1), (8, 0, 2), (160, 20, 20), (160, 0, 40)):
        sets = [rng.integers(0, 1 << 64, both + a + b, dtype=np.uint64) for _ in range(500)]
        (keys, checks), (others, others_checks) = (simhash.segment_keys([np.sort(s[own]) for s in sets]) for own in (slice(both + a), [*range(both), *range(both + a, both + a + b)]))
        assert (keys == others).any(axis=1).all()
        differ = np.bitwise_count(checks ^ others_checks)
        assert (differ[:, : simhash.CHECK].sum(axis=1) <= simhash.APART).all()
        assert both <= simhash.FEW or (differ.sum(axis=1) <= simhash.WIDE).all()


def test_rows_of_a_key_find_what_is_near(monkeypatch):
    """Short and long runs against brute force."""
    rng = np.random.default_rng(4)
    keys = np.sort(rng.integers(0, 5, 700)).astype(np.int32)
    sizes = rng.integers(50, 100, 700).astype(np.int32)
    order = np.lexsort((sizes, keys))
    sizes, checks = sizes[order], rng.integers(0, 1 << 63, (700, simhash.CHECK), dtype=np.uint64)
    for i in range(0, 600, 9):
        checks[i] = checks[i + int(rng.integers(1, 60))] ^ np.uint64(0b1011)
    near = np.bitwise_count(checks[:, None] ^ checks[None]).sum(axis=2) <= simhash.APART
    near &= (keys[:, None] == keys[None]) & ~np.eye(700, dtype=bool)
    fits = np.minimum(sizes[:, None], sizes[None]) >= 0.8 * np.maximum(sizes[:, None], sizes[None])
    want = (near & fits).any(axis=1)
    assert 20 < want.sum() < 200 and (want != near.any(axis=1)).any()
    assert (simhash.partnered(keys, sizes, checks, 0.8) == want).all()
    monkeypatch.setattr(simhash, "LONG", 20)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    found = simhash.partnered(keys, sizes, checks, 0.8)
    assert (found >= want).all() and (found <= near.any(axis=1)).all()


def test_a_wanted_set_is_copied(spark, monkeypatch):
    """Many pairs of one text: all keep both sets, whatever is copied."""
    pairs = spark.createDataFrame([(1, i) for i in range(2, 4000)] + [(i, 9000) for i in range(5, 3000)], "a long, b long")
    sets = spark.createDataFrame([(i, [i, i + 1]) for i in [*range(1, 4000), 9000, 9001]], "node long, set array<long>")
    monkeypatch.setattr(simhash, "SPREAD", 100)
    got = simhash.with_sets(simhash.with_sets(pairs, sets, "a", 7000), sets, "b", 7000).collect()
    assert Counter((r["a"], r["b"]) for r in got) == Counter(map(tuple, pairs.collect()))
    assert all(r["a_set"] == [r["a"], r["a"] + 1] and r["b_set"] == [r["b"], r["b"] + 1] for r in got)


def test_hubs_are_linked_like_others(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_LINKS", 20)
    monkeypatch.setattr(components, "HUBS", 10)
    links = [(5, 100 + i) for i in range(150)] + [(1000 + i, 2000) for i in range(90)] + [(3000 + i, 3001 + i) for i in range(12)] + [(249, 1000)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[100 + i] == 5 for i in range(150)) and all(got[1000 + i] == 5 for i in range(90)) and got[2000] == 5
    assert all(got[3001 + i] == 3000 for i in range(12))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 199)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {200: 199}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(rows, least=0.9):
    good = [(i, np.array(e, float)) for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, root = Counter(), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(good):
        for j, b in good[:k]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i, _ in rows}


def test_op8_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in (base[i % 6] + rng.normal(scale=0.12, size=16) if i % 3 else rng.normal(size=16))]) for i in range(260)]
    rows += [(300 + i, [1.0] * 16) for i in range(20)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [float("inf")] + [1.0] * 15), (404, [None] + [1.0] * 15), (405, []), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (408, [-0.0, 1.0]), (409, [0.0, 1.0]), (410, [1e-30] * 16)]
    frame = spark.createDataFrame([(i, e, None, "x") for i, e in rows], "vec_id long, embedding array<float>, label int, v string")
    got = hnsw.op8(spark, write_tables(tmp_path / "a", embeddings=frame)).collect()
    held = [(i, [None if x is None else float(np.float32(x)) for x in e] if e is not None else None) for i, e in rows]
    want = brute_links(held)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got) and len(got) == len(rows)
    empty = spark.createDataFrame([], frame.schema)
    assert hnsw.op8(spark, write_tables(tmp_path / "b", embeddings=empty)).count() == 0


def test_op8_tells_rows_of_one_id_or_none_apart(spark, tmp_path):
    near, far = [1.0, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, [1.0, 0.0, 0.0]), (None, near), (7, far), (7, [0.0, 0.1, 1.0]), (None, None), (None, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = Counter(map(tuple, hnsw.op8(spark, write_tables(tmp_path, embeddings=frame)).collect()))
    assert got == Counter([(1, 1, 1, True), (None, 1, 1, False), (7, 1, 7, True), (7, 1, 7, True), (None, 0, None, True), (None, 1, None, True), (None, 1, None, True)])


def planted(n: int, groups: tuple[int, ...], dim: int) -> np.ndarray:
    rng = np.random.default_rng(6)
    return np.concatenate([rng.normal(size=(n, dim)), *(c + rng.normal(scale=0.05, size=(k, dim)) for c, k in zip(rng.normal(size=(len(groups), dim)), groups, strict=True))])


def test_op8_recall_by_graphs(spark, tmp_path, monkeypatch):
    """Two shards of 1,500 vectors, small broadcasts, groups on both sides of FEW; planted pairs at 0.9 to 0.95."""
    monkeypatch.setattr(hnsw, "SHARDS", 2)
    monkeypatch.setattr(hnsw, "WAVE_BYTES", 1 << 10)
    rng = np.random.default_rng(3)
    x = hnsw.normalised(planted(2000, (2, 3, 5, 9, 17, 30, 60, 150, 300), 24))
    away = rng.normal(size=(300, 24))
    away -= np.einsum("ad,ad->a", away, x[:300])[:, None] * x[:300]
    c = rng.uniform(0.902, 0.95, size=(300, 1))
    x = np.concatenate((x, c * x[:300] + np.sqrt(1 - c * c) * hnsw.normalised(away))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.op8(spark, write_tables(tmp_path, embeddings=frame)).collect()}
    unit = hnsw.normalised(x)
    truth = unit @ unit.T >= 0.9
    np.fill_diagonal(truth, False)
    links = truth.sum(axis=1)
    assert all(got[i][0] <= links[i] for i in got)
    assert sum(n for n, _ in got.values()) >= 0.97 * links.sum()
    pairs = [(i, 2576 + i) for i in range(300) if truth[i, 2576 + i]]
    assert len(pairs) > 290 and np.mean([got[i][1] == got[j][1] for i, j in pairs]) >= 0.9


def test_graph_recall():
    x = hnsw.normalised(planted(1500, (2, 3, 5, 9, 17, 30, 60, 2, 3, 4, 150, 300), 24)).astype(np.float32)
    graph = hnsw.Graph.build(x)
    width = graph.audit(0.9)
    assert width < len(x) // 2
    found = {(i, j) for a, b in graph.within(x, 0.9, width) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    truth = set(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.9)), strict=True))
    own = {(i, i) for i in range(len(x))}
    assert found <= truth | own and len(found - own) >= 0.98 * len(truth - own)


def test_audit_widens_a_broken_graph():
    x = hnsw.normalised(planted(1500, (), 24)).astype(np.float32)
    graph = hnsw.Graph.build(x)
    graph.layers[0][:, 3:] = -1
    assert graph.audit(0.9) > hnsw.BEAM


def test_spanning_links():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    s, t = hnsw.spanning(a, b)
    first, second = simhash.Forest(), simhash.Forest()
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        first.link(i, j)
    for i, j in zip(s.tolist(), t.tolist(), strict=True):
        second.link(i, j)
    assert len(s) == len(first.fresh) and all(first.root(i) == second.root(i) for i in range(400))


def test_network_gradients_and_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(32, 120, n, dtype=np.uint8)) for n in (0, 5, 70, 300)]
    y, net = np.array([0, 1, 0, 1], np.float32), quality.fresh(2)
    for p in net.parts():
        p += rng.normal(0, 0.05, p.shape).astype(np.float32)

    def loss():
        p = 1 / (1 + np.exp(-quality.scores(net, texts)))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for p, g in zip(net.parts(), quality.gradients(net, texts, y), strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[i], 1e-2
        p[i] = old + step
        up = loss()
        p[i] = old - step
        down = loss()
        p[i] = old
        assert abs((up - down) / (2 * step) - g[i]) < 0.15 * abs(g[i]) + 1e-4
    whole = quality.scores(net, [texts[3] * 9, texts[2]])
    monkeypatch.setattr(quality, "PIECE", 640)
    assert np.allclose(quality.scores(net, [texts[3] * 9, texts[2]]), whole, atol=1e-4)


def auc(score, label):
    rank = np.argsort(np.argsort(score))
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.parametrize(("op", "label", "least"), [(quality.op5, "quality", 0.9), (toxicity.op7, "toxic", 0.85)])
def test_classifiers_on_held_out_rows(spark, op, label, least):
    got = {r["doc_id"]: r for r in op(spark, SF).collect()}
    held = [(got[r["doc_id"]], r[label]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    score, y = np.array([g["score"] for g, _ in held]), np.array([x for _, x in held])
    assert len(got) == 1000 and auc(score, y) > least
    assert all(g["predicted"] == (g["score"] >= 0.3) and 0 <= g["score"] <= 1 for g in got.values())


@pytest.mark.parametrize("op", [quality.op5, toxicity.op7])
def test_classifiers_on_odd_rows(spark, op, odd_docs, no_docs, tmp_path):
    label = "quality" if op is quality.op5 else "toxic"
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1), (10, 0), (6, None), (None, 1), (3, 0), (4, 1)], f"doc_id long, {label} int")
    got = op(spark, write_tables(tmp_path / "a", documents=odd_docs, labels=labels)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert op(spark, write_tables(tmp_path / "b", documents=no_docs, labels=labels)).count() == 0
    none = op(spark, write_tables(tmp_path / "c", documents=odd_docs, labels=labels.limit(0))).collect()
    assert len({r["score"] for r in none}) == 1


def test_bags_hold_what_enough_texts_have():
    texts = [prose(k % 7, 12) + (" Idiotic" if k % 2 else "") for k in range(30)]
    bags = toxicity.Bags(texts)
    sets = [toxicity.counted(toxicity.features(w) for w in set(toxicity.WORD.findall(t.lower()))) for t in texts]
    count = Counter(f for own in sets for f in own)
    names = bags.names(np.arange(len(bags.keys)))
    assert set(names) == {f for f, n in count.items() if n >= toxicity.LEAST_TEXTS} and sorted(names.values()) == list(range(len(names)))
    for f, i in names.items():
        assert bags.have(np.array([i])).tolist() == [f in own for own in sets]
    y = np.arange(30) % 2
    odds, g = bags.telling(y)
    i = names["idiot*"]
    assert odds[i] == pytest.approx(math.log(15.5 / 16) - math.log(0.5 / 16)) and g[i] == pytest.approx(2 * 30 * math.log(2))
    assert bags.have(np.array([i])).tolist() == (y == 1).tolist()


def test_toxicity_scores_by_plain_sums(spark, odd_docs):
    weights, bias = {"alpha": 0.5, "alph*": 0.25, "alph*2": 1.0, "word": -0.5, "beta": 0.125}, -0.75

    def plain(text):
        words = set(regex.findall(r"\w+", (text or "").lower()))
        n = sum(w.startswith("alph") and len(w) > 4 for w in words)
        z = bias + 0.5 * ("alpha" in words) + 0.25 * (n > 0) + 1.0 * (n >= 2) - 0.5 * ("word" in words) + 0.125 * ("beta" in words)
        return round(1 / (1 + math.exp(-z)), 9)

    got = Counter((r["doc_id"], round(r["score"], 9)) for r in toxicity.score(odd_docs, weights, bias).collect())
    assert got == Counter((r["doc_id"], plain(r["text"])) for r in odd_docs.collect())


def test_samples_are_bounded_by_bytes_and_take_one_text_an_id(spark):
    docs = spark.createDataFrame([(1, "a" * 50), (1, "b" * 50), (2, "c" * 500), (3, "d" * 40), (4, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, quality int")
    texts, y, _ = labelled(docs, labels, "quality", 1, 1, (9, 9))
    assert len(texts) == 4 and sorted(map(len, texts)) == [0, 40, 50, 500] and y.sum() == 2
    assert sorted(map(len, labelled(docs, labels, "quality", 1, 1, (9, 9), 120)[0])) == [0, 40, 50]
    assert sorted(map(len, unlabelled(docs, 1, 1, 9))) == [0, 40, 50, 500] and len(unlabelled(docs, 1, 1, 2)) == 2


def test_samples_leave_the_fold_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    import zlib

    texts, y, _ = labelled(docs, labels, "quality", 5, 0, (10_000, 10_000))
    free = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    assert len(texts) == len(free) and y.sum() == sum(r["quality"] for r in free)
    assert len(labelled(docs, labels, "quality", 5, 0, (3, 4))[0]) == 7


def drawn_votes(rng, truth, right, wrong):
    """A voter that is right, wrong or abstains with these chances."""
    u = rng.random(len(truth))
    sign = np.where(truth, 1, -1)
    return np.where(u < right, sign, np.where(u < right + wrong, -sign, 0))


def test_label_model_finds_classes_and_accuracies_without_labels():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    kinds = [(0.8, 0.02), (0.7, 0.05), (0.6, 0.1), (0.5, 0.05), (0.3, 0.02)]
    v = np.stack([drawn_votes(rng, truth, *k) for k in kinds], axis=1).astype(np.int8)
    post, p, together = toxicity.label_model(v)
    assert ((post > 0.5) == truth).mean() > 0.97
    for j, (right, wrong) in enumerate(kinds):
        assert np.allclose(p[1, j], [wrong, 1 - right - wrong, right], atol=0.06) and np.allclose(p[0, j], [right, 1 - right - wrong, wrong], atol=0.06)
    assert np.abs(together).max() < 0.2


def test_label_model_against_plain_sums():
    """One more round by loops leaves the posteriors as they are."""
    rng = np.random.default_rng(1)
    truth = rng.random(500) < 0.3
    v = np.stack([drawn_votes(rng, truth, 0.7, 0.05 * j) for j in range(4)], axis=1).astype(np.int8)
    post, _, _ = toxicity.label_model(v)
    share = (post.sum() + 1) / (len(v) + 2)
    prior = toxicity.PRIOR * np.array([[0.5, 0.45, 0.05], [0.15, 0.45, 0.4]])
    chance = [[[sum((q if y else 1 - q) for q, row in zip(post, v, strict=True) if row[j] == x) + prior[y][x + 1] for x in (-1, 0, 1)] for j in range(4)] for y in (0, 1)]
    for q, row in zip(post, v, strict=True):
        odds = share / (1 - share)
        for j in range(4):
            odds *= (chance[1][j][row[j] + 1] / sum(chance[1][j])) / (chance[0][j][row[j] + 1] / sum(chance[0][j]))
        assert abs(odds / (1 + odds) - q) < 0.01


def test_voters_that_copy_each_other_share_their_weight():
    rng = np.random.default_rng(4)
    truth = rng.random(3000) < 0.3
    noisy = drawn_votes(rng, truth, 0.55, 0.35)
    v = np.stack([drawn_votes(rng, truth, 0.8, 0.02), drawn_votes(rng, truth, 0.75, 0.03), drawn_votes(rng, truth, 0.7, 0.05), *[noisy] * 3], axis=1).astype(np.int8)
    post, _, together = toxicity.label_model(v)
    assert together[3, 4] > 0.5 and ((post > 0.5) == truth).mean() > 0.95


def test_posteriors_are_no_copy_of_labels():
    """Labels that are wrong in a tenth of the rows don't reach the posteriors."""
    rng = np.random.default_rng(7)
    toxic = rng.random(1500) < 0.3
    texts = [" ".join([*rng.choice(WORDS, 30), *(rng.choice(["idiot", "scum", "vile", "rotten", "foul"], 3) if t else [])]) for t in toxic]
    y = np.where(rng.random(1500) < 0.1, ~toxic, toxic).astype(float)
    bags = toxicity.Bags(texts)
    post = toxicity.label_model(toxicity.votes(texts, bags, toxicity.voters(bags, y)))[0]
    assert ((post > 0.5) == toxic).mean() > 0.97 and ((post > 0.5) != (y > 0.5)).sum() > 100
