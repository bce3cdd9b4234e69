"""Brute-force versions of the operators on documents."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from ranklake.llm import line_dedup, mixing, packing, secret_scan, sharding, simhash

from .fixtures import documents, no_documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def test_sharding_rows_law(spark, docs):
    out = sharding.shard_documents(docs, 16).collect()
    data = rows()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in data)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(16)]
    assert max(counts) - min(counts) <= 1
    again = sharding.shard_documents(docs, 16).collect()
    assert sorted(out, key=str) == sorted(again, key=str)
    assert sharding.shard_documents(no_documents(spark), 16).count() == 0


def test_sharding_writes_whole_documents(spark, docs, tmp_path):
    """Text and further columns stand in the shards, and buckets hold them."""
    path = str(tmp_path / "shards")
    digest = sharding.shard_documents(docs, 4, path=path, bucket_bytes=20_000).collect()
    back = spark.read.parquet(path).collect()
    assert Counter(tuple(r.rec) for r in back) == Counter(rows())
    assert back[0].rec.__fields__ == docs.columns
    place = lambda i, t, r: (str(i), zlib.crc32((t or "").encode()), r.shard, r.slot)
    assert sorted(place(r.rec.doc_id, r.rec.text, r) for r in back) == sorted(
        (str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in digest)
    assert sorted(r.position for r in back) == list(range(len(back)))


def test_shuffle_buckets_and_uniformity(spark):
    recs = spark.range(4000).selectExpr("id as bucket", "'r' as rec", "id % 3 as at")
    from pyspark.sql import functions as F
    out = sharding.external_shuffle(recs, F.lit(100), bucket_bytes=20_000).collect()
    assert sorted(r.position for r in out) == list(range(4000))
    assert sorted(r.bucket for r in out) == list(range(4000))
    # a random order: about half of the neighbours ascend, and few stay in place
    order = [r.bucket for r in sorted(out, key=lambda r: r.position)]
    up = sum(a < b for a, b in zip(order, order[1:]))
    assert 1800 < up < 2200
    assert sum(a == b for a, b in enumerate(order)) < 20


def test_write_shards(spark, docs, tmp_path):
    out = sharding.cut_shards(sharding.external_shuffle(docs.select("doc_id", "text"), __import__("pyspark").sql.functions.lit(100)), 4)
    sharding.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(rows())
    assert back.select("shard").distinct().count() == 4


def test_packing_against_tokenizers(spark, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = packing.pack(docs, longest=64, with_ids=True).collect()
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    lengths = [r.length for r in sorted(out, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 64 for r in out)
    want = Counter()
    for d in rows():
        ids = tok.encode(d[1] or "", add_special_tokens=False).ids + [1]
        at = 0
        for n in packing.binary_lengths(len(ids), 64):
            part = ids[at:at + n]
            crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            want[(d[0], at, n, crc, len(ids), tuple(part))] += 1
            at += n
        assert at == len(ids)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in out) == want
    assert packing.pack(no_documents(spark)).count() == 0


def test_encoder_equals_tokenizers():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in ("", " ", "  two  spaces ", "tab\t\n x", "<|endoftext|> y", "x<|endoftext|><|endoftext|>\n<|endoftext", "<|endoftext|>", "don't I'll WE'VE", "é ß 漢字 ٣", "a\r\n\r\nb", "\x1c\x85!", "🙂👍🏽 é", "x" * 5000):
        assert packing.encoder("byte_bpe_50k.json")(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def brute_fingerprint(text, words=3):
    toks = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not toks:
        return 0
    grams = [" ".join(toks[i:i + words]) for i in range(len(toks) - words + 1)] or [" ".join(toks)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, linked):
    of = list(range(len(items)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = root(i), root(j)
                of[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(items))]


@pytest.mark.parametrize("words,bits", [(3, 2), (3, 6), (1, 0)])
def test_simhash(spark, docs, words, bits):
    data = rows()
    fps = [brute_fingerprint(d[1], words) for d in data]
    comp = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= bits)
    least = {}
    for d, c in zip(data, comp):
        if d[0] is not None:
            least[c] = min(least.get(c, d[0]), d[0])
    want = Counter((d[0], f"{f:016x}", least.get(c)) for d, f, c in zip(data, fps, comp))
    out = simhash.near_duplicates(docs, words, bits).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in out) == want
    kept = simhash.keep_one(docs, words, bits)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(comp))


def test_simhash_pairs_random(spark):
    import random
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(15):
            y = x
            for _ in range(rng.randrange(5)):
                y ^= 1 << rng.randrange(64)
            fps.add(y - (1 << 64) if y >> 63 else y)
    fps = sorted(fps)
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    got = simhash.near_pairs(spark.createDataFrame([(f,) for f in fps], "fp long"), 2)
    assert {(r.a, r.b) for r in got.collect()} == want
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(data, min_docs, min_chars=1, corpus=None):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    df = Counter()
    for d in corpus if corpus is not None else data:
        df.update({k for k in map(key, (d[1] or "").split("\n")) if len(k) >= min_chars})
    out = []
    for d in data:
        lines = (d[1] or "").split("\n")
        kept = [x for x in lines if df[key(x)] < min_docs]
        out.append((d[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 1), (2, 4)])
def test_line_dedup(spark, docs, min_docs, min_chars):
    out = line_dedup.digest(docs, min_docs, min_chars).collect()
    assert Counter(tuple(r) for r in out) == brute_lines(rows(), min_docs, min_chars)
    assert line_dedup.digest(no_documents(spark)).count() == 0


def test_line_dedup_is_reversible(spark, docs, tmp_path):
    one, two = docs.where("doc_id < 14"), docs.where("doc_id >= 14 or doc_id is null")
    first = line_dedup.LineIndex.empty(spark, min_docs=4, shards=4).insert(one)
    both = first.insert(two)
    whole = line_dedup.LineIndex.empty(spark, min_docs=4, shards=4).insert(docs)
    table = lambda x: sorted((r.a, r.b, r.n) for r in x.counts.collect())
    assert table(both) == table(whole)
    back = both.delete(two)
    assert table(back) == table(first)

    def held(x):
        return sum(int((line_dedup.CuckooFilter.of_bytes(r.data).table != 0).sum()) for r in x.filters.collect())
    hot = lambda x: x.counts.where("n >= 4").count()
    assert [held(x) for x in (first, both, back)] == [hot(x) for x in (first, both, back)]
    both.save(str(tmp_path / "state"))
    loaded = line_dedup.LineIndex.load(spark, str(tmp_path / "state"), min_docs=4, shards=4)
    got = loaded.clean(docs.select("doc_id", "text")).collect()
    kept = Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got)
    assert kept == brute_lines(rows(), 4)


def test_line_dedup_shards_grow(spark, docs, monkeypatch, tmp_path):
    """More frequent keys than the shards hold: shards double, filters are
    built anew, decisions and later deletions stay right."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    one, two = docs.where("doc_id < 14"), docs.where("doc_id >= 14 or doc_id is null")
    first = line_dedup.LineIndex.empty(spark, min_docs=4, shards=1).insert(one)
    both = first.insert(two)
    hot = both.counts.where("n >= 4").count()
    assert both.shards >= hot > 1 and both.shards >= first.shards
    held = sum(int((line_dedup.CuckooFilter.of_bytes(r.data).table != 0).sum()) for r in both.filters.collect())
    assert held == hot
    both.save(str(tmp_path / "grown"))
    for state in (both, line_dedup.LineIndex.load(spark, str(tmp_path / "grown"), min_docs=4), both.delete(two).insert(two)):
        got = state.clean(docs.select("doc_id", "text")).collect()
        kept = Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got)
        assert kept == brute_lines(rows(), 4)


def test_line_dedup_without_filters(spark, docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", -1)
    out = line_dedup.digest(docs, 3).collect()
    assert Counter(tuple(r) for r in out) == brute_lines(rows(), 3)


def test_cuckoo_filter():
    import numpy as np
    rng = np.random.default_rng(1)
    keys = rng.integers(-2**63, 2**63 - 1, 5000, dtype=np.int64)
    f = line_dedup.build_filter(keys)
    assert f.contains(keys).all()
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all()
    assert f.contains(keys[:2500]).mean() < 0.01
    assert (f.table != 0).sum() == 2500


def brute_spans(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), m[2]))
    for kind, pat, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end(), m[0]) for m in re.finditer(pat, text) if len(m[0]) >= least]
    return sorted(out)


def test_secret_scan(spark, docs):
    names = ("assign", "access", "hex", "live")
    owners, repos, texts = defaultdict(set), defaultdict(set), defaultdict(set)
    found = []
    for d in rows():
        t = d[1] or ""
        base = brute_spans(t)
        toks = [(m.start(), 3, m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", t)
                if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])]
        found.append((d, base, toks))
        for s in base + toks:
            owners[s[3]].add(d[3])
            repos[s[3]].add(d[0])
            texts[s[3]].add(t)
    lives = lambda v: len(owners[v]) <= 1 and min(len(repos[v]), len(texts[v])) <= secret_scan.MAX_REPOS
    want = Counter()
    for d, base, toks in found:
        live = {(s[2] - len(s[3]), 3, s[2], s[3]) for s in base + toks if lives(s[3])}
        text = lambda ss: ",".join(f"{names[s[1]]}:{s[0]}:{s[2]}" for s in sorted(ss))
        n = Counter(s[1] for s in base)
        want[(d[0], n[0], n[1], n[2], hashlib.sha256(text(base).encode()).hexdigest(), text(base + list(live)))] += 1
    got = Counter(tuple(r) for r in secret_scan.scan_digest(docs).collect())
    assert got == want
    assert secret_scan.scan_digest(no_documents(spark)).count() == 0


def test_secret_scan_by_repositories(spark):
    """One owner's value in many documents is a copied example; one document's
    exact copies are one place."""
    key = "password=%s end"
    data = [(i, f"{i} " + key % "EXAMPLE99key", "s1") for i in range(50)]
    data += [(100 + i, key % "hunter2live", "s1") for i in range(50)]
    data += [(200 + i, f"{i} " + key % "twoplaces1", "s1") for i in range(2)]
    data += [(300 + i, f"{i} " + key % "twoowners1", f"s{i}") for i in range(2)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")

    def live(**options):
        return {r.doc_id // 100 for r in secret_scan.scan_digest(docs, **options).collect() if "live" in r.spans}
    assert live(max_repos=1) == {1}
    assert live(max_repos=2) == {1, 2}
    assert live() == {1, 2}  # the rule of the registered query and its SQL


def test_secret_scan_of_many_spans(spark):
    """Lists longer than a chunk, and a text of thousands of hits."""
    for n in (1, 127, 128, 129, 300, 20_000):
        text = " ".join(f"{i:024x}é" for i in range(n)) + " tail"
        row = secret_scan.scan(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
        assert [(s.start, s.end) for s in row.base] == [(26 * i, 26 * i + 24) for i in range(n)]
        assert len(row.found) == 2 * n


def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == pytest.approx([5, 10, 15])
    assert mixing.targets([1, 100, 10], [1, 1, 1]) == pytest.approx([3, 78, 30])
    assert mixing.targets([0, 5], [1, 1]) == pytest.approx([0, 5])
    assert mixing.targets([], []) == []


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        p = mixing.Permutation(n, (1, 2, 3))
        at = p.at(range(n))
        assert sorted(at.tolist()) == list(range(n))
        assert all(p.slot_of(b) == at.tolist().index(b) for b in range(min(n, 20)))


@pytest.mark.parametrize("block", [7, 64, 100_000])
def test_mixing(spark, docs, block):
    out = mixing.mix_digest(docs, block=block, shards=5).collect()
    data = rows()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r.size) for r in out) == Counter((d[0], size(d[1])) for d in data)
    names = sorted({d[3] for d in data if d[3]}) + [None]
    by = Counter()
    for d in data:
        by[d[3]] += size(d[1])
    goal = mixing.targets([by[n] for n in names], [1 + i % 3 for i in range(len(names))])
    taken = Counter()
    source = {d[0]: d[3] for d in data}
    for r in out:
        n = source[r.doc_id]
        assert r.source_size == by[n] and r.target == pytest.approx(goal[names.index(n)])
        assert 0 <= r.taken <= 3 * r.size
        taken[n] += r.taken
    assert [taken[n] for n in names] == [round(g) for g in goal]
    again = mixing.mix_digest(docs, block=block, shards=5).collect()
    assert Counter(out) == Counter(again)
    assert mixing.mix_digest(no_documents(spark)).count() == 0


def test_mixed_documents(spark, docs):
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r.doc_id: r.taken for r in mixing.mix_digest(plain, block=50, shards=3).collect()}
    out = mixing.mixed_documents(plain, block=50, shards=3)
    assert out.columns == plain.columns
    got = Counter()
    texts = {r.doc_id: r.text for r in plain.collect()}
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
    assert all(got[d] == n for d, n in want.items())
    assert mixing.mixed_documents(no_documents(spark)).count() == 0


def test_mixing_of_many_sources(spark, docs, monkeypatch):
    """Beyond max_sources the plan is a table: same targets, same taken words."""
    monkeypatch.setattr(mixing, "GROUP_SOURCES", 50)
    monkeypatch.setattr(mixing, "SLOT_RUN", 3)
    data = [(k, " ".join(["w"] * (k * k % 97)), f"s{k % 173:03}" if k % 173 else None) for k in range(900)]
    many = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    few = {None: 2.0, "s001": 1.0, "s002": 0.5, "none": 4.0}
    for table, options in ((many, {}), (many, {"weights": few}), (docs, {})):
        def sums(**more):
            out = mixing.mix_digest(table, block=7, shards=5, **options, **more).collect()
            assert all(0 <= r.taken <= 3 * r.size for r in out)
            by = Counter()
            names = {r.doc_id: r.source for r in table.collect()}
            for r in out:
                by[names[r.doc_id], r.source_size, round(r.target, 6)] += r.taken
            return len(out), by
        assert sums(max_sources=1) == sums()
    again = [Counter(mixing.mix_digest(many, block=7, shards=5, max_sources=1).collect()) for _ in range(2)]
    assert again[0] == again[1]
    assert mixing.mix_digest(no_documents(spark), max_sources=-1).count() == 0
