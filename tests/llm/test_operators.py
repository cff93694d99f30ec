"""The operators' queries against brute force on a small table with nulls, empty and long texts, repeated rows and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from callatlas.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made_documents():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "naïve", "#tag", "x|y", "🙂"]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = [None, "", "   \n\t ", "<|endoftext|>One <|ENDOFTEXT|> it's", "one", "a b c", "x " * 40, "under the MIT license, all", "licensed under the GNU General Public License version 3 now"]
    for i in range(40):
        t = " ".join(rng.choices(vocabulary, k=rng.randint(5, 90)))
        texts.append(f"{t}\n{passage} {t[::-1]}" if i % 5 == 0 else t)
    texts += [texts[10], texts[10], texts[12] + " tail", "same line here\n" * 6, " ".join(rng.choices(vocabulary, k=6000))]
    rows = [{"doc_id": i * 3, "text": t, "lang": "en", "source": [None, "a", "b", "c"][i % 4], "n_chars": len(t or ""), "n_words": "clash", "row": 1} for i, t in enumerate(texts)]
    return [*rows, dict(rows[11])]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("n_words", pa.string()), ("row", pa.int64())])


@pytest.fixture(scope="module")
def docs():
    return made_documents()


@pytest.fixture(scope="module")
def sf(tmp_path_factory, docs):
    at = tmp_path_factory.mktemp("sf")
    pq.write_table(pa.Table.from_pylist(docs, SCHEMA), at / "documents.parquet")
    pages = [{"page_id": i, "url": f"http://h{i % 3}/{i}", "html": [None, "", "<p>a</p>", f"<p>é{i // 2}</p>"][i % 4]} for i in range(30)]
    pq.write_table(pa.Table.from_pylist(pages), at / "pages.parquet")
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    vectors = [(base[i % 12] + rng.normal(size=16) * (0.02 if i % 3 else 0.6)).tolist() for i in range(120)]
    vectors += [None, [0.0] * 16, [float("nan")] * 16, vectors[3], vectors[3]]
    rows = [{"vec_id": i, "embedding": v, "label": None if i % 11 == 0 else i % 2} for i, v in enumerate(vectors)]
    column = duckdb.sql("select * from '/root/testdata/sf0.001/embeddings.parquet' limit 0").columns
    name = next(c for c in column if c not in ("vec_id", "label"))
    pq.write_table(pa.Table.from_pylist([{"vec_id": r["vec_id"], name: r["embedding"], "label": r["label"]} for r in rows]), at / "embeddings.parquet")
    return str(at), rows


def got(spark, sf, name, *columns):
    return sorted((tuple(r) for r in queries.QUERIES[name](spark, sf[0]).select(*columns).collect()), key=repr)


def ordered(rows):
    return sorted(rows, key=repr)


def oracle(sf, name, columns):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf[0]}/{t}.parquet'")
    return ordered(con.sql(f"select {', '.join(columns)} from ({queries.ORACLE[name]})").fetchall())


def components(n, links):
    of = list(range(n))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_op1(spark, sf):
    rows, links = sf[1], []
    usable = [(r["vec_id"], r["label"], np.array(r["embedding"], float)) for r in rows if r["embedding"] and r["label"] is not None and np.isfinite(r["embedding"]).all() and any(r["embedding"])]
    for i, (a, la, x) in enumerate(usable):
        links += [(a, b) for b, lb, y in usable[i + 1 :] if la == lb and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98]
    count, of = Counter(x for p in links for x in p), components(len(rows), links)
    assert len(links) > 50
    assert got(spark, sf, "op1_cover_tree_dedup", "vec_id", "n_links", "component_id", "kept") == ordered((i, count[i], of[i], of[i] == i) for i in range(len(rows)))


def test_op2(spark, sf, docs):
    texts = [(d["text"] or "").encode() for d in docs]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    expect = []
    for d, t in zip(docs, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        expect.append((d["doc_id"], len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert got(spark, sf, "op2_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == ordered(expect)


def test_op3(spark, sf, docs):
    first, words = {}, [WORD.findall(d["text"] or "") for d in docs]
    for d, w in zip(docs, words, strict=True):
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d["doc_id"]), d["doc_id"])
    expect = []
    for d, w in zip(docs, words, strict=True):
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d["doc_id"] for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        expect.append((d["doc_id"], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert got(spark, sf, "op3_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == ordered(expect)


def test_op4(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expect = []
    for d in docs:
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            piece = ids[at : at + 2048]
            expect.append((d["doc_id"], p, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    rows = got(spark, sf, "op4_sum_of_squares_packing", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    assert ordered(r[:5] for r in rows) == ordered(expect)
    places = {}
    for *_, length, _, sequence, offset in rows:
        places.setdefault(sequence, []).append((offset, length))
    for p in places.values():
        ends = [0]
        for offset, length in sorted(p):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert len(places) <= -(-sum(x[3] for x in expect) // 2048) + 2


def test_op5(spark, sf, docs):
    expect = []
    for d in docs:
        t = d["text"] or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        expect.append((d["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = got(spark, sf, "op5_quality_rules", *columns, "kept")
    assert ordered(r[:7] for r in rows) == ordered(expect)
    assert not any(r[6] and r[7] for r in rows)


@pytest.mark.parametrize("name", queries.ORACLE)
def test_against_sql(spark, sf, name):
    columns = sorted(queries.QUERIES[name](spark, sf[0]).columns)
    assert got(spark, sf, name, *columns) == oracle(sf, name, columns)


def test_op8(spark, sf, docs):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    expect = []
    for d in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (d["text"] or "").translate(lower))
        hits = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        expect.append((d["doc_id"], len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    rows = got(spark, sf, "op8_license_templates", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert ordered(r[:6] for r in rows) == ordered(expect)
    assert all(set(filter(None, r[5].split(","))) <= set(r[6].split(",")) and 0 <= r[7] <= 1 for r in rows)
    assert {r[6] for r in rows} == {"", "mit", "gpl-3"}


def test_op9(spark, sf, docs):
    tokens, held = [], []
    for d in docs:
        tokens.append([*WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), d["text"] or "")), None])
        held.append(zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2)
    c = Counter(x for t, h in zip(tokens, held, strict=True) if not h for x in t)
    n, v = sum(c.values()), len(c)
    expect = ordered((d["doc_id"], h, len(t), sum(x in c for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for d, t, h in zip(docs, tokens, held, strict=True))
    rows = got(spark, sf, "op9_backoff_scoring", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert [r[:5] for r in rows] == [r[:5] for r in expect]
    assert np.allclose([r[5] for r in rows], [r[5] for r in expect], rtol=1e-9)
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in rows)


def test_op10(spark, sf, docs):
    prints = []
    for d in docs:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), d["text"] or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    of = components(len(docs), links)
    assert got(spark, sf, "op10_simhash", "doc_id", "fingerprint", "component_id") == ordered((d["doc_id"], f"{p:016x}", docs[o]["doc_id"]) for d, p, o in zip(docs, prints, of, strict=True))


def readable_documents():
    """Texts that pass the quality rules, with exact and near copies and a passage that every fourth one has."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(900)]
    passage, texts = rng.choices(vocabulary, k=60), [None, "", "too short"]
    for i in range(40):
        w = rng.sample(vocabulary, rng.randint(40, 150))
        texts.append(" ".join([*w, *passage] if i % 4 == 0 else w))
        if i % 5 == 0:
            texts += [texts[-1], texts[-1] + " tail"]
    return [{"doc_id": 7 * i % 101, "text": t, "lang": "en", "source": [None, "a", "b"][i % 3], "n_chars": len(t or ""), "n_words": "clash", "row": 1} for i, t in enumerate(texts)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline
    from callatlas.llm.common import keep, load

    sf = (str(tmp_path),)
    pq.write_table(pa.Table.from_pylist(readable_documents(), SCHEMA), tmp_path / "documents.parquet")

    now, stages, columns = load(spark, sf[0], "documents"), [], [*SCHEMA.names]
    for name, stage in pipeline.STAGES[:-1]:
        now = keep(stage(spark, now, sf[0]))
        assert now.columns == columns, name
        stages.append([(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()])
    quality, near, substring, _ = stages
    kept = Counter(r[0] for r in got(spark, sf, "op5_quality_rules", "doc_id", "kept") if r[1])
    assert Counter(d for d, _ in quality) == kept
    of = near_groups([t for _, t in quality])
    first = {}
    for d, t in quality:
        first[of[shingled(t)]] = min(first.get(of[shingled(t)], (d, t)), (d, t))
    assert sorted(near) == sorted(first.values())
    where, expect = {}, []
    for d, t in sorted(near):
        w = WORD.findall(t)
        for i in range(len(w) - 12):
            where.setdefault(tuple(w[i : i + 13]), d)
    for d, t in near:
        w = WORD.findall(t)
        gone = {j for i in range(len(w) - 12) if where[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        if len(gone) < len(w):
            expect.append((d, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t))
    assert len(near) < len(quality) and expect != near and sorted(substring) == sorted(expect)
    assert pipeline.STAGES[-1][1](spark, now, sf[0]).count() > 0


def test_pipeline_places_all_tokens(spark, sf):
    import corpus_pipeline as pipeline

    rows = pipeline.run(spark, sf[0]).collect()
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        ends = [0, *(o + n for o, n in sorted(p))]
        assert [o for o, _ in sorted(p)] == ends[:-1] and ends[-1] <= 2048
    assert len(places) <= -(-sum(r.length for r in rows) // 2048) + 2


@pytest.mark.parametrize("size", [300, 1000])
def test_packing_carries_open_sequences_on(spark, size):
    from callatlas.llm.packing import packed

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packed(docs, size=size).select("length", "sequence_id").collect()
    assert len({r.sequence_id for r in rows}) <= 1.012 * sum(r.length for r in rows) / 2048 + 1


@pytest.mark.parametrize("bits", [64, 4])
def test_op3_in_shards_with_colliding_words(spark, monkeypatch, bits):
    """Hashes of words with few bits collide all the time; the source words decide."""
    from callatlas.llm import grams
    from callatlas.llm.substring_dedup import remove_repeated_words

    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    shared = [rng.choices(words, k=rng.randint(13, 90)) for _ in range(12)]
    texts = [[*rng.choices(words, k=rng.randint(0, 40)), *rng.choice(shared)[rng.randint(0, 5) :], *rng.choices(words, k=rng.randint(0, 40)), *rng.choice(shared)] for _ in range(150)]
    first = {}
    for d, w in enumerate(texts):
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    gone = [len({j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}) for d, w in enumerate(texts)]
    real = grams.span_hashes
    monkeypatch.setattr(grams, "span_hashes", lambda *a: real(*a) & np.uint64((1 << bits) - 1))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in remove_repeated_words(docs, size=9000).select("doc_id", "n_removed").collect()}
    assert sum(gone) > 1000 and got == dict(enumerate(gone))


def test_hot_buckets_of_simhash(spark, sf, docs):
    from callatlas.llm.common import load
    from callatlas.llm.simhash import near_duplicates

    many = load(spark, sf[0], "documents")
    show = lambda df: sorted(map(repr, df.collect()))
    assert show(near_duplicates(many, radius=12, chunk=2)) == show(near_duplicates(many, radius=12))


def test_ledger_and_ablations(spark, sf):
    from callatlas.llm import quality_rules as Q
    from callatlas.llm.common import load

    entries = Q.ledger(load(spark, sf[0], "documents")).collect()
    got = {r.rule: (r.n_failed, r.n_failed_alone) for r in Q.ablations(Q.ledger(load(spark, sf[0], "documents"))).collect()}
    mask = Q.POLICIES[Q.LATEST]
    assert got == {n: (sum(bool(e.failed & b) for e in entries), sum(e.failed & mask == b for e in entries)) or None for n, b in Q.BIT.items() if b & mask and any(e.failed & mask for e in entries)}
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    assert Q.measured([f"{thue}\n{thue.translate(str.maketrans('ab', 'ba'))}".encode()])[4] == 0


def shingled(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_groups(texts):
    """For each distinct set of shingles, the smallest row number of its group."""
    sets = list(dict.fromkeys(map(shingled, texts)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and len(a & b) >= 0.8 * len(a | b)]
    return dict(zip(sets, components(len(sets), links), strict=True))


def test_near_copies(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(500)]
    texts = [None, "", " \n", "Ein Wort", "ein wort", "a b c d e", "a b c d e f"]
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.randint(40, 400))
        texts.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 3])):
            v = list(w)
            for _ in range(rng.randint(0, len(w) // 40)):
                v[rng.randrange(len(v))] = "edited"
            texts.append(" ".join(v))
    texts += [texts[7]] * 40
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(7, texts[7], "x", 7), (None, texts[7], "x", 1), (None, "alone here", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, digest long")
    out = pipeline.near_copies(spark, docs, "")
    assert out.columns == docs.columns
    kept = [r for r in out.collect()]
    of, first = near_groups([r[1] for r in rows]), {}
    for r in rows:
        first.setdefault(of[shingled(r[1])], r)
    want = set(first.values())
    assert {tuple(r) for r in kept} >= want  # nothing else goes
    assert len(kept) == len({tuple(r) for r in kept}) <= len(want) + 1  # RECALL is under one


def test_empty_tables(spark, tmp_path):
    at = str(tmp_path)
    pq.write_table(pa.Table.from_pylist([], SCHEMA), f"{at}/documents.parquet")
    for name in ("pages", "embeddings"):
        pq.write_table(pq.read_table(f"/root/testdata/sf0.001/{name}.parquet").slice(0, 0), f"{at}/{name}.parquet")
    import corpus_pipeline

    for name, f in (queries.QUERIES | corpus_pipeline.QUERIES).items():
        assert f(spark, at).count() == 0, name
