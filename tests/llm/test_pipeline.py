"""Toxicity on held-out labels, and the pipeline against brute force."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from ranklake.llm import mixing, queries, toxicity

from .test_text_operators import LOWER, WORD, brute_components, brute_fingerprint

BAD = ["moronic", "idiot", "scumbag", "pathetic"]


def corpus(n=260, seed=8):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(max(2, len(words) // 25)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words) + ("\nall rights reserved" if i % 3 == 0 else ""), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(bad)))
    docs += [(n + k, docs[5 + k][1], "en", "s1", 0) for k in range(6)] + [(900, None, "en", None, 0), (901, "", None, "s2", 0), (None, "no id here", None, "s0", 0)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, labels = corpus()
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, labels


def test_toxicity(spark, tables):
    folder, docs, labels = tables
    out = {r.doc_id: r for r in queries.op9_toxicity(spark, folder).collect()}
    assert len(out) == len(docs)
    truth = {i: t for i, _, t in labels}
    import zlib
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items() if i is not None)
    held = [(truth[i], out[i].predicted) for i in truth if out[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    assert out[900].score == out[901].score and out[900].predicted == 0


def test_misspelt_words_score(spark, tables):
    folder, docs, labels = tables
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    clean = docs[1][1]
    low, high = model.scores([clean, clean[:150] + " moronik idiiot scumbagg patheticc"])
    assert low < 0.7 <= high


def test_parts_of_words():
    """The vectorised parts against a loop over words and their n-grams."""
    import re
    texts = [None, "", " .", "Ab, cDe", "x", "été ab\nlonger-word (q)", "ab " * 50, "a" * 300]
    number = {}
    for i, t in enumerate(texts):
        words = [w for w in re.split(rb"[" + re.escape(toxicity.BETWEEN) + rb"]+", (t or "").lower().encode()) if w]
        want = Counter()
        for w in words:
            edged = b" " + w + b" "
            own = [("word", w)] + [(n, edged[k:k + n]) for n in toxicity.GRAMS for k in range(len(edged) - n + 1)]
            for p in own:
                want[p] += 1 / (len(own) * len(words))
        owner, bucket, weight = toxicity.parts(texts[:i] + [t])
        got = Counter()
        for o, b, x in zip(owner, bucket, weight):
            if o == i:
                got[int(b)] += x
        assert sum(got.values()) == pytest.approx(1 if words else 0)
        # equal parts share a bucket wherever they stand
        alone = {}
        for p in want:
            if p[0] == "word":
                o, b, x = toxicity.parts([p[1].decode()])
                alone[p] = int(b[-1])
                assert number.setdefault(p, alone[p]) == alone[p]
        for p, b in alone.items():
            assert got[b] >= want[p] - 1e-9
        ids, ws = toxicity.text_bags(texts)[i]
        assert dict(zip(ids.tolist(), ws.tolist())) == pytest.approx(dict(got), rel=1e-5)


def test_toxicity_without_labels(spark, tables):
    folder, docs, _ = tables
    d, none = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").limit(0)
    out = toxicity.score_digest(spark, d, none).collect()
    assert len(out) == len(docs) and not any(r.predicted for r in out)
    assert toxicity.score_digest(spark, d.limit(0), none).count() == 0


def test_toxicity_with_few_labels(spark):
    """No bucket reaches the evidence of many labels: what cannot be told apart
    is not toxic, what can be is found."""
    rng = random.Random(6)
    vocab = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]

    def fitted(insult):
        texts = [" ".join(rng.choice(vocab) for _ in range(30)) + (insult if i < 6 else "") for i in range(52)]
        ids = [i for i in range(400) if not toxicity.zlib.crc32(str(i).encode()) % 3 == 1][:52]
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        labels = spark.createDataFrame([(i, 1, int(k < 6)) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
        return toxicity.fit(docs, labels), texts
    model, texts = fitted("")
    assert (model.scores(texts + [None, "", "unseen"]) < 0.7).all()
    model, texts = fitted(" idiot moronic idiot")
    got = model.scores(texts) >= 0.7
    assert got[:6].all() and not got[6:].any()
    # margins that all tie tell nothing apart
    one = toxicity.text_bags(["same words"] * 40)
    assert toxicity.train(one, [1] * 8 + [0] * 32).scores(["same words", None]).max() < 0.7


def test_rare_insult_scores(spark):
    """An insult in 5 of 1,200 toxic rows (chi-squared 12.5) counts."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    ids = [i for i in range(7000) if toxicity.zlib.crc32(str(i).encode()) % 3 != 1][:4200]
    docs, labels = [], []
    for k, i in enumerate(ids):
        words = [rng.choice(vocab) for _ in range(rng.randint(15, 40))]
        for _ in range(2 if k < 1200 else 0):
            words.insert(rng.randrange(len(words)), "zwyxhead" if k < 5 else rng.choice(["moronic", "idiot", "scumbag"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(k < 1200)))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    plain = [" ".join(rng.choice(vocab) for _ in range(25)) for _ in range(100)]
    assert (model.scores(plain) < 0.7).all()
    assert (model.scores([p + " zwyxhead zwyxhead" for p in plain]) >= 0.7).mean() > 0.5


def test_stages_against_brute_force(spark, tables, tmp_path):
    folder, data, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "simhash near-dedup", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    pred = {r.doc_id: r.predicted for r in queries.op9_toxicity(spark, folder).collect()}
    rest = [d for d in data if not pred[d[0]]]
    assert Counter(r.doc_id for r in kept["toxicity"]) == Counter(d[0] for d in rest)

    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = Counter()
    for d in rest:
        seen.update({key(x) for x in (d[1] or "").split("\n")} - {""})
    cut = [(d[0], d[1] and "\n".join(x for x in d[1].split("\n") if seen[key(x)] < 10), d[3]) for d in rest]
    assert Counter((r.doc_id, r.text) for r in kept["line dedup"]) == Counter((i, t) for i, t, _ in cut)

    fps = [brute_fingerprint(t) for _, t, _ in cut]
    comp = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    groups = defaultdict(list)
    for (i, t, s), c in zip(cut, comp):
        groups[c].append((i is None, i or 0, t, s))
    firsts = [min(g, key=lambda x: x[:2]) for g in groups.values()]
    assert Counter(r.doc_id for r in kept["simhash near-dedup"]) == Counter(None if none else i for none, i, _, _ in firsts)

    size = lambda t: len(WORD.findall(t or ""))
    by, source, text = Counter(), {}, {}
    for none, i, t, s in firsts:
        by[s] += size(t)
        source[None if none else i], text[None if none else i] = s, t
    order = sorted(s for s in by if s) + [None] * (None in by)
    goal = mixing.targets([by[s] for s in order], [1 + k % 3 for k in range(len(order))])
    taken, per = Counter(), Counter()
    for r in kept["mixing"]:
        assert r.text in text[r.doc_id]
        taken[source[r.doc_id]] += size(r.text)
        per[r.doc_id] += size(r.text)
    assert [taken[s] for s in order] == [round(g) for g in goal]
    assert all(n <= 3 * size(text[i]) for i, n in per.items())

    import public_tokenizers as P
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole = Counter(tuple(tok.encode(r.text, add_special_tokens=False).ids + [1]) for r in kept["mixing"])
    assert sum(r.length for r in kept["packing"]) == sum(len(i) * n for i, n in whole.items())
    assert len({r.sequence_id for r in kept["packing"]}) == len(kept["packing"])
    assert Counter(t for r in kept["packing"] for t in r.ids) == Counter(t for i, n in whole.items() for t in i * n)


def test_registered():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
