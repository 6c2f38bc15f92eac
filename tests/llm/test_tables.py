"""op5 to op9 and the pipeline."""

import gzip
import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from pelagia.llm import bpe, packing, simhash, topk, url_filters, warc
from pelagia.llm.components import components
from pyspark.sql import functions as F
from tests.llm.conftest import rows_of

JSON = public_tokenizers.path("byte_bpe_50k.json")


# --- op5 -----------------------------------------------------------------------------------------------------------


def test_topk_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], 1) for i in range(600)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(60)]  # ties
    rows += [(2000, None, 1), (2050, [1.0] * 7 + [None], 1), (2100, [float("nan")] * 8, 1), (2150, [float("inf")] * 8, 1), (None, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = rows_of(topk.top_k(df, F.col("vec_id") % 50 == 0))
    ok = {i: np.floor(256 * np.array(e)).astype(int) for i, e, _ in rows if i is not None and e is not None and None not in e and np.isfinite(e).all()}
    want = []
    for q in ok:
        if q % 50 == 0:
            best = sorted(((-int(ok[q] @ v), i) for i, v in ok.items() if i != q))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want, key=repr)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df.filter("vec_id in (50, 51, 52)"), F.col("vec_id") == 50).count() == 2


@pytest.mark.parametrize(("steps", "few"), [(1, 1), (7, 2), (24, 8), (400, 1)])
def test_nra_bounds_lose_nothing(steps, few):
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_cauchy((400, 5)) * 20)
    x[:, 4] = 0
    x[5] = 0  # a query of zeros: every candidate ties
    got = topk.nra(x[:20], np.arange(20), x, np.arange(400), 5, steps, few)
    for q in range(20):
        s = x @ x[q]
        want = sorted((-int(s[i]), i) for i in range(400) if i != q)[:5]
        assert [(-s, i) for a, i, s, _ in got if a == q] == want


def test_nra_stops_early_and_reads_no_more():
    """One candidate stands out: its lists are read a step, and nothing else is looked at."""
    rng = np.random.default_rng(1)
    x = rng.integers(-9, 9, (1000, 6)).astype(float)
    x[:5] = 500
    got = topk.nra(np.ones((1, 6)), np.array([-1]), x, np.arange(1000), 5)
    assert [i for _, i, _, _ in got] == [0, 1, 2, 3, 4] and {d for *_, d in got} == {-(-1000 // topk.STEPS)}
    deep = np.argsort(np.argsort(x, axis=0, kind="stable"), axis=0) < 1000 - 42
    other = np.where(deep, -9.0, x)  # what lies deeper than is read does not matter but for the far end
    again = topk.nra(np.ones((1, 6)), np.array([-1]), other, np.arange(1000), 5)
    assert [i for _, i, _, _ in again] == [0, 1, 2, 3, 4] and {d for *_, d in again} == {42}
    rank, lists = np.argsort(np.argsort(x, axis=0, kind="stable"), axis=0), np.sort(x, axis=0)
    for depth in topk.depths(1000):
        lower, upper = topk.bounds(depth, rank, lists, x, np.ones((6, 1)), np.zeros((6, 1)))
        assert (lower[:, 0] <= x.sum(1)).all() and (x.sum(1) <= upper[:, 0]).all()
    assert (lower == upper).all()


def test_topk_of_several_lengths(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, [3.0, 1.0]), (3, [2.0]), (50, [5.0]), (100, []), (101, []), (150, [0.1] * 3)]
    got = rows_of(topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0))
    assert got == sorted([(0, 1, 2, 5 * 65536), (50, 1, 3, 10 * 65536), (50, 2, 1, 5 * 65536), (100, 1, 101, 0)], key=repr)


def test_topk_of_repeated_rows_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (50, [0.0, 2.0]), (50, [1.0, 1.0])]
    df = spark.createDataFrame([(i, e, 9, "x", 1, 2, 3, 4) for i, e in rows], "vec_id long, embedding array<double>, rank int, query_id string, score int, version int, q int, dims int")
    got = rows_of(topk.top_k(df, F.col("vec_id") % 50 == 0))
    want = []
    for q, e in {(i, tuple(e)) for i, e in rows if i % 50 == 0}:
        best = sorted((-int(sum(256 * a * 256 * b for a, b in zip(e, v))), i) for i, v in rows if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want, key=repr)


# --- op6 -----------------------------------------------------------------------------------------------------------


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_masks_cover_every_pair_of_positions():
    ms = [m & (2**64 - 1) for m in simhash.masks()]
    assert len(ms) == 15
    r = random.Random(0)
    for _ in range(3000):
        diff = sum(1 << i for i in r.sample(range(64), r.randint(1, 3)))
        assert any(m & diff == 0 for m in ms)


@pytest.mark.parametrize("block", [1024, 7])
def test_simhash_links_nothing_less(spark, block):
    r = random.Random(9)
    prints = [r.getrandbits(64) - 2**63 for _ in range(150)]
    for _ in range(350):  # chains and a dense cloud
        x = r.choice(prints[:40])
        for b in r.sample(range(63), r.randint(1, 3)):
            x ^= 1 << b
        prints.append(x)
    prints = sorted(set(prints))
    found = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"), block=block)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in found.collect())
    roots = {x.node: x.root for x in components(found).collect()}
    want = brute_components(prints)
    first = {w: min(prints[i] for i in range(len(prints)) if want[i] == w) for w in set(want)}
    assert [roots.get(x, x) for x in prints] == [first[w] for w in want]


def test_simhash_documents(spark, docs, none, small):
    import xxhash

    def brute(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ")
        words = [w for w in words if w]
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    out = simhash.near_duplicates(docs, keep=["doc_id"]).select("row.doc_id", simhash.as_hex(F.col("fp")), "component_id")
    prints = [brute(t) for _, t, _ in small]
    comps = brute_components(prints)
    least = {c: min((i for (i, _, _), d in zip(small, comps) if d == c and i is not None), default=None) for c in comps}
    assert rows_of(out) == sorted(((i, f"{p:016x}", least[c]) for (i, _, _), p, c in zip(small, prints, comps)), key=repr)
    kept = simhash.stage(spark, docs, "")
    assert kept.schema == docs.schema and kept.count() == len(set(comps))
    assert simhash.stage(spark, none, "").count() == 0


def jaccard_brute(texts, k=5):
    """Component of each text: sets of k-word shingles with a Jaccard similarity of at least 0.8, transitively."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("hot", "block"), [(256, 1024), (5, 4)])
def test_stage_finds_all_near_copies(spark, monkeypatch, hot, block):
    from functools import partial

    from pelagia.llm import setjoin

    monkeypatch.setattr(setjoin, "links", partial(setjoin.links, hot=hot, rows=block))  # small and large lists and groups
    r = random.Random(8)
    prose = lambda n: [f"w{r.randint(0, 400)}" for _ in range(n)]
    common, texts = prose(40), ["", None, " \n", "one two", "one two three four", "one two three four five six seven"]
    for _ in range(25):  # copies with several words changed, on both sides of 0.8, and chains of them
        words = prose(r.choice([8, 30, 150, 400]))
        texts.append(" ".join(words))
        for _ in range(6):
            words = list(words)
            for _ in range(r.randint(0, max(1, len(words) // 45))):
                words[r.randrange(len(words))] = "x%d" % r.randint(0, 999)
            texts.append(" ".join(words))
    texts += [" ".join(prose(30) + common) for _ in range(40)]  # a common passage links nothing
    base = prose(120)
    for _ in range(40):  # a group around one text, its members on both sides of 0.8
        words = list(base)
        for _ in range(r.randint(0, 8)):
            words[r.randrange(120)] = "y%d" % r.randint(0, 99999)
        texts.append(" ".join(words))
    comps = jaccard_brute(texts)
    assert len(set(comps)) < len(texts) - 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(x.doc_id for x in simhash.stage(spark, df, "").collect()) == sorted(set(comps))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(120)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(121)} | {1000 + i: 1000 for i in range(80)}


# --- op7 -----------------------------------------------------------------------------------------------------------


def test_packing_places_every_token_once(docs, none, small):
    out = packing.pack(docs, JSON).collect()
    enc = bpe.encoding(JSON)
    want = []
    for i, t, _ in small:
        ids = [*enc.encode_ordinary(t or ""), 0]
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            want.append((i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in out)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r.length for r in out) // 2048)
    assert packing.pack(none, JSON).count() == 0


def test_packing_takes_added_tokens_as_tokenizers_does(spark, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n b", "x<|endoftext|", " <|endoftext|> 's <|ENDOFTEXT|>", "<|endoftext|>é" * 3000, *[x for _, x, _ in small if x]]
    want = []
    for i, x in enumerate(texts):
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        want += [(i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))]
    out = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), JSON).collect()
    assert sorted(want) == sorted(tuple(r)[:5] for r in out)


def test_cut_only_the_first_piece_is_shorter():
    for n in (1, 2047, 2048, 2049, 4096, 5000):
        got = packing.cut(n)
        assert sum(x for _, x in got) == n and all(x == 2048 for _, x in got[1:]) and got[0][0] == 0
    assert packing.cut(2048) == [(0, 2048)]


def test_local_search_improves_and_loses_nothing():
    r = random.Random(1)
    better = 0
    for _ in range(25):
        counts = Counter(r.randint(1, 2048) if r.random() < 0.5 else r.randint(300, 900) for _ in range(300))
        bfd = packing.best_fit(counts)
        done = packing.local_search(bfd)
        got = Counter()
        for b, n in done.items():
            assert packing.fill(b) <= 2048
            for x, k in b:
                got[x] += k * n
        assert got == counts and sum(done.values()) <= sum(bfd.values())
        better += sum(done.values()) < sum(bfd.values())
    assert better
    flat = packing.local_search(packing.best_fit(Counter({700: 1000})))
    assert flat == {((700, 2),): 500}


# --- op8 -----------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [
        "http://example.org/es/1", "http://EXAMPLE.org/en/12?x=/de/", "https://a.b.example.org/en/2", "http://x.com/fr/", "http://x.com/de/1#y", "http://com/de/", "http://notorg/", "http://org",
        "http://org/", "http://myexample.org/es/", None, "", "no scheme", "ftp://h.com?/fr/", "a://b://c.org/", "http://x.com/fr", "http://" + "a." * 300 + "com/de/" + "z" * 5000, "http://\n.org/x",
    ]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string")
    out = url_filters.judge(df, url_filters.rule_table(spark, url_filters.RULES)).collect()
    assert len(out) == 2 * len(urls)

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].translate(str.maketrans(url_filters.UPPER, url_filters.LOWER)), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(len(h + p), v == "block", h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id]), urls[r.page_id]
    plain = url_filters.judge(df.limit(3), url_filters.rule_table(spark, []))
    assert {r.verdict for r in plain.collect()} == {"allow"} and url_filters.judge(df.limit(0), url_filters.rule_table(spark, [])).count() == 0


# --- op9 -----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big, other = "é" * 800, "y" * 1000
    rows = [(1, big, 1), (2, big, 1), (3, big, 1), (4, "small", 1), (5, "small", 1), (6, None, 1), (7, "", 1), (8, other, 1), (9, "y" * 999, 1), (10, "y" * 999, 1), (None, other, 1), (11, "z" * 300000, 1)]
    df = spark.createDataFrame([(*x, 1, "p", "r", "n") for x in rows], "page_id long, html string, digest int, id int, payload string, refers_to string, last string").repartition(3)
    (tmp_path / "w").mkdir()
    names = warc.archive(df, f"file://{tmp_path}/w")
    out = warc.scan(names.repartition(3, "archive"))
    assert out.filter("kind = 'gap'").count() == 0
    got = {r.id: (r.record_type, r.refers_to, r.n_bytes, r.digest) for r in out.collect()}
    for i, t, _ in rows:
        b = (t or "").encode()
        last = {big: 3, other: 8}.get(t)
        ref = str(last) if last is not None and last != i else None
        assert got[None if i is None else str(i)] == ("revisit" if ref else "response", ref, len(b), hashlib.sha1(b).hexdigest())
    assert warc.scan(warc.archive(df.limit(0), f"file://{tmp_path}/w")).count() == 0


def records(n):
    return [warc.record({"WARC-Type": "response", "X-Page-ID": str(i), "WARC-Payload-Digest": "sha1:" + hashlib.sha1(b"p%d" % i * 50).hexdigest()}, b"p%d" % i * 50) for i in range(n)]


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(packed):
    parts = [warc.member(r) if packed else r for r in records(8)]
    whole = [(k, h["x-page-id"]) for k, _, _, (h, _) in warc.read(io.BytesIO(b"".join(parts)))]
    assert whole == [("record", str(i)) for i in range(8)]
    hurt = list(parts)
    hurt[2] = hurt[2][: len(hurt[2]) // 2]  # cut short
    hurt[5] = hurt[5][:-30] + b"\x00" * 30 if packed else hurt[5].replace(b"p5p5", b"p5XX", 1)  # checksum, digest
    data = b"junk" + b"".join(hurt) + b"\x1f\x8b\x08tail"
    got = list(warc.read(io.BytesIO(data)))
    ids = {x[0]["x-page-id"] for k, _, _, x in got if k == "record"}
    assert ids == {"0", "1", "3", "4", "6", "7"}
    gaps = [(a, z) for k, a, z, _ in got if k == "gap"]
    assert gaps[0] == (0, 4) and len(gaps) == 4
    covered = sorted((a, z) for _, a, z, _ in got)
    assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(covered, covered[1:]))


def test_warc_reads_a_bounded_window():
    """A wrong digest or trailer is final: the window never grows beyond the record and a read."""
    rec = [warc.record({"WARC-Type": "response", "X-Page-ID": str(i), "WARC-Payload-Digest": "sha1:" + hashlib.sha1(bytes([i]) * 300_000).hexdigest()}, bytes([i]) * 300_000) for i in range(40)]
    rec[3] = rec[3].replace(b"\x03\x03", b"\x03\x09", 1)
    rec[9] = rec[9][:-4] + b"\r\nxx"
    rec[15] = rec[15].replace(b"Content-Length: 300000", b"Content-Length: 3000000000", 1)
    most = []

    class Watched(warc._Source):
        def need(self, n):
            out = super().need(n)
            most.append(len(self.data))
            return out

    whole, found = warc._Source, []
    warc._Source = Watched
    try:
        found = list(warc.read(io.BytesIO(b"".join(rec)), largest=1 << 20))
    finally:
        warc._Source = whole
    assert [int(x[0]["x-page-id"]) for k, _, _, x in found if k == "record"] == [i for i in range(40) if i not in (3, 9, 15)]
    assert max(most) <= (1 << 20) + 3 * warc.READ
    spans = sorted((a, z) for _, a, z, _ in found)
    assert spans[0][0] == 0 and spans[-1][1] == sum(map(len, rec)) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_warc_members_are_plain_gzip():
    data = b"".join(map(warc.member, records(3)))
    assert gzip.decompress(data) == b"".join(records(3))


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline
    from pelagia.llm import quality_rules

    r = random.Random(2)
    words = [a + b for a in ("the", "and", "with", "thing", "there", "what", "when", "sea") for b in ("", "s", "ing", "er")]
    prose = lambda n: ". ".join(" ".join(r.choice(words) for _ in range(9)).capitalize() for _ in range(n)) + "."
    rows = [(i, prose(r.randint(4, 30)), "en", "s", 0) for i in range(120)]
    rows += [(500 + i, rows[0][1], "en", "s", 0) for i in range(5)] + [(600, rows[1][1] + " Write to a.b@c.org now.", "en", "s", 0)]
    rows += [(700 + i, "SHOUT!! " * 40 + str(i), "en", "s", 0) for i in range(10)] + [(800, None, None, None, None), (801, "two words", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    ids = {x.doc_id for x in at.collect()}
    assert ids >= set(range(2, 120)) and not ids & {*range(500, 505), *range(700, 710), 800, 801}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in out.collect()} == ids
    texts = {x.doc_id: x.text for x in at.collect()}
    if 600 in texts:
        assert "[EMAIL]" in texts[600]
    assert all(texts[i] == rows[i][1] for i in range(2, 120))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash_dedup", "pii", "packing"]
    assert quality_rules.RULES == tuple(quality_rules.rules())


def test_pipeline_on_awkward_tables(spark, docs, none, small, tmp_path):
    """Nulls, repeated rows, a very long text and columns with clashing names; and no rows at all."""
    import corpus_pipeline

    docs.unionByName(docs).write.parquet(f"{tmp_path}/two/documents.parquet")
    none.write.parquet(f"{tmp_path}/no/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/two")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = Counter((r.doc_id, r.piece) for r in out.collect())
    assert got and max(got.values()) == 1 and {i for i, _ in got} <= {i for i, *_ in small}  # repeated rows are copies
    assert corpus_pipeline.run(spark, f"{tmp_path}/no").collect() == []
