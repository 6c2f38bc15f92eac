"""op11, op12 and op13 against brute force, with every awkward case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from pelagia.llm import centroids, setjoin, spelling
from tests.llm.conftest import SCHEMA, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- op11 ----------------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("letters", ["ab", "aéz"])
def test_tries_give_every_pair_once(letters):
    r = random.Random(len(letters))
    for _ in range(300):
        size = r.randint(1, 6)
        words = list({"".join(r.choice(letters) for _ in range(size + r.randint(0, 1))) for _ in range(r.randint(0, 40))})
        got = Counter(tuple(sorted(p)) for p in spelling.one_edit(words, size, size))
        assert max(got.values(), default=1) == 1
        assert set(got) == {(j, i) for i in range(len(words)) for j in range(i) if size in (len(words[i]), len(words[j])) and near(words[i], words[j])}


@pytest.mark.parametrize("group", [20_000, 3])
def test_groups_lose_no_pair(spark, group):
    r = random.Random(2)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 9))) for _ in range(500)} | {"a" * 12 + c + d for c in "abcd" for d in "abcde"})
    df = spark.createDataFrame([(w, 1 + i) for i, w in enumerate(words)], "word string, n long")
    got = Counter((x["word"], x["near"]) for x in spelling.pairs(df, group, 200).collect())
    assert max(got.values()) == 1
    assert set(got) == {(a, b) for a in words for b in words if a != b and near(a, b)}


def spelling_brute(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    form, count = {}, {}
    for w in n:
        found = [v for v in n if v != w and near(v, w)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        count[w] = len(found)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], count[w], n.get(form[w])) for w in n), key=repr)


def test_spelling_against_brute_force(spark, docs, none, small):
    def words(df):
        return spelling.variants(spelling.counted(df).filter("n >= 2"))

    assert rows_of(words(docs)) == spelling_brute([(i, t) for i, t, _ in small])
    assert rows_of(words(none)) == []
    # chains of forms, ties, an upper-case word that is another's form, letters beyond ASCII, a very long run
    rows = [(1, "Abcdefgh " * 2000 + "Abcdefg " * 150), (2, "abcdefé " * 14 + "abcdefx " * 2), (3, "hhiijjkk " * 40 + "hhiijjk " * 2 + "hhiijkk\n" * 2), (None, "ÉtoileÉtoile " * 30 + "étoileÉtoile " * 31), (4, "z" * 100000 + " " + "z" * 99999), (4, "z" * 100000), (5, "")]
    rows += [(10 + i, "wordword variants") for i in range(40)]
    assert rows_of(words(spark.createDataFrame(rows, "doc_id long, text string"))) == spelling_brute(rows)


# --- op12 ----------------------------------------------------------------------------------------------------------


def lloyd(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    c = [e for _, _, e in sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), e, e) for i, e in kept)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(e, v, strict=True)), j) for j, v in enumerate(c)) for _, e in kept]

    for _ in range(rounds):
        members = defaultdict(list)
        for (_, e), (_, j) in zip(kept, assign(), strict=True):
            members[j].append(e)
        for j, es in members.items():
            c[j] = [sum(x) // len(es) for x in zip(*es, strict=True)]
    got = assign()
    per = Counter()
    for d, j in got:
        per[j] += d
    return sorted(((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, got, strict=True)), key=repr)


@pytest.mark.parametrize("k", [7, 500])
def test_clusters_against_brute_force(spark, k):
    r = random.Random(4)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 2.0]) * r.choice([1, 1, 9]) for _ in range(4)]) for i in range(150)]  # many ties
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, [0.25] * 4), (900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan")] * 4), (903, [float("inf")] + [0.0] * 3), (904, [1.0] * 3), (905, []), (906, [0.0] * 4)]
    df = spark.createDataFrame([(i, e, "c", 1) for i, e in rows], "vec_id long, embedding array<float>, cluster string, distance int").repartition(5)
    assert rows_of(centroids.clusters(df, k, dims=4)) == lloyd(rows, k, 5, 4)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert centroids.clusters(df).collect() == [] and centroids.clusters(df.filter("vec_id < 0")).collect() == []


def test_annulus_holds_the_nearest_and_leaves_others_out():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (400, 3)) * rng.integers(1, 30, (400, 1))
    for k in (1, 2, 60):
        c = x[rng.choice(400, k, replace=False)]
        annuli = centroids.Annuli(c)
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        at, least = annuli.nearest(x)
        assert (least == d.min(1)).all() and (at == d.argmin(1)).all()
        low, high = annuli.ranges(x)
        assert (high - low).mean() < (k if k > 1 else 1.01)
    # centroids of different norms: vectors near one meet it alone
    c = rng.normal(0, 1, (50, 8))
    c = np.rint(c / np.linalg.norm(c, axis=1, keepdims=True) * 300 * np.arange(1, 51)[:, None]).astype(int)
    near = c[rng.integers(0, 50, 500)] + rng.integers(-3, 4, (500, 8))
    low, high = centroids.Annuli(c).ranges(near)
    assert (high - low).max() == 1


def test_huge_components_fail_with_a_reason(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        centroids.clusters(df, dims=2).collect()


# --- op13 ----------------------------------------------------------------------------------------------------------


def join_brute(rows, k=4, t="0.85"):
    t = Fraction(t)
    sets = []
    for _, x in rows:
        w = WORD.findall(lower(x or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) * t.denominator >= len(a | b) * t.numerator:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    least = {c: min((d for d in v if d is not None), default=None) for c, v in ids.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)], links[i]) for i in range(len(rows))), key=repr)


def near_copies():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(10):
        base = [r.choice(vocabulary) for _ in range(r.choice([8, 20, 40, 90, 200]))]
        for _ in range(r.choice([2, 5, 25])):
            x = list(base)
            for _ in range(r.randint(0, 4)):
                p, what = r.randrange(len(x)), r.random()
                if what < 0.5:
                    x[p] = r.choice(vocabulary)
                elif what < 0.75:
                    x.insert(p, r.choice(vocabulary))
                else:
                    del x[p]
            rows.append((len(rows), " ".join(x)))
    shared = " ".join(f"t{i}" for i in range(40))  # too little for a link
    rows += [(1000 + i, " ".join(f"u{i}x{j}" for j in range(4)) + " " + shared) for i in range(50)]
    drift = [f"d{i}" for i in range(60)]
    rows += [(2000 + i, " ".join(drift[:i] + [f"e{j}" for j in range(i, 60)])) for i in range(20)]  # a chain of links
    return rows


@pytest.mark.parametrize(("hot", "block"), [(setjoin.HOT, setjoin.ROWS), (4, 3)])
@pytest.mark.parametrize(("k", "t"), [(4, "0.85"), (5, "0.8"), (1, "0.5")])
def test_join_against_brute_force(spark, small, monkeypatch, k, t, hot, block):
    monkeypatch.setattr(setjoin.links, "__defaults__", (hot, block))
    rows = near_copies() + [(i, x) for i, x, _ in small if x is None or len(x) < 30000]
    df = spark.createDataFrame([(i, x, "fp", 3) for i, x in rows], "doc_id long, text string, fp string, n int").repartition(6)
    assert rows_of(setjoin.joined(df, shingle=k, similarity=t)) == join_brute(rows, k, t)


def test_join_of_awkward_tables(docs, none, small):
    got = rows_of(setjoin.joined(docs))
    assert got == join_brute([(i, x) for i, x, _ in small])
    assert none.schema.simpleString() and SCHEMA and setjoin.joined(none).collect() == []


def test_long_texts_have_the_sets_of_short_segments(monkeypatch):
    r = random.Random(1)
    text = " ".join(r.choice(["a", "b", "cc", "DÉ", "e" * 50]) for _ in range(3000))
    whole = setjoin.shingle_set(text, 4)
    words = WORD.findall(lower(text))
    assert len(whole) == len({tuple(words[i : i + 4]) for i in range(len(words) - 3)})
    cut = setjoin.segments
    monkeypatch.setattr(setjoin, "segments", lambda raw: cut(raw, 7))
    assert (setjoin.shingle_set(text, 4) == whole).all()
    assert len(setjoin.shingle_set("one two", 4)) == 1 and len(setjoin.shingle_set(" \n", 4)) == 0


def test_shared_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30))) for _ in range(50)]
    want = [[len(set(a) & set(b)) for b in sets] for a in sets]
    for often in (128, 5, 1):
        assert (setjoin.shared_counts(sets, often) == want).all()


def group_rows(spark, texts):
    """What links() returns, in rows, and the largest number of rows that its tables of visits hold."""
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    from pyspark.sql import functions as F

    keyed = df.withColumn("key", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(2), "text").alias("b")))
    return setjoin.links(setjoin.sets_of(keyed, 5, "0.8"), keyed.select("key", "text"), 5, "0.8")


def test_rows_grow_with_the_group_not_its_square(spark):
    def copies(n, seed=9):
        r = random.Random(seed)
        base = [f"w{r.randrange(10**6)}" for _ in range(80)]
        return [" ".join(w if j != i % 80 else f"x{i}" for j, w in enumerate(base)) for i in range(n)]

    one, two = group_rows(spark, copies(300)).count(), group_rows(spark, copies(600)).count()
    assert 300 <= one and two <= 2.3 * one


def test_templates_and_long_unrelated_texts_give_no_rows(spark):
    shared = " ".join(f"t{i}" for i in range(40))
    assert group_rows(spark, [" ".join(f"u{i}x{j}" for j in range(5)) + " " + shared for i in range(400)]).count() == 0
    r = random.Random(3)
    assert group_rows(spark, ["same start here now " + " ".join(str(r.randrange(10**9)) for _ in range(3000)) for i in range(40)]).count() == 0


# --- op6, op10 -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("task", [50_000, 7])
def test_simhash_groups_follow_the_rows(spark, monkeypatch, task):
    from pelagia.llm import simhash

    monkeypatch.setattr(simhash, "TASK", task)
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(6)]
    prints = sorted({b ^ sum(1 << k for k in r.sample(range(63), r.randint(0, 3))) for b in base for _ in range(25)})
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), block=8).collect()
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for x in found:
        assert (x.a ^ x.b).bit_count() <= 3
        root[max(find(x.a), find(x.b))] = min(find(x.a), find(x.b))
    for a in prints:
        for b in prints:
            assert (a ^ b).bit_count() > 3 or find(a) == find(b)


def test_bpe_of_repeated_long_rows(spark):
    import public_tokenizers

    from pelagia.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    r = random.Random(5)
    long = " ".join(r.choice(["tide", "reef,", "Krill's", "12", "é漢", "\n\n"]) for _ in range(3000))
    rows = [(1, long)] * 3 + [(2, long), (None, long), (3, "short"), (3, "short"), (4, "y" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((x.doc_id, tuple(x.ids)) for x in bpe.encode(df, path, chunk=256, overlap=32, spread=2).collect())
    enc = bpe.encoding(path)
    assert got == Counter((i, tuple(enc.encode_ordinary(t))) for i, t in rows)
    assert bpe.encode_text(path, long + "z" * 500).tolist() == enc.encode_ordinary(long + "z" * 500)
    assert 0 < max(map(len, bpe.known(path))) <= bpe.SHORT


# --- op3: the stored model -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "part"), [(10**6, 10**6), (500, 200)])
def test_stored_model_scores_as_the_scorer(spark, docs, none, small, tmp_path, block, part):
    from pelagia.llm import katz

    path = f"{tmp_path}/model"
    katz.train(docs, path, block=block, part=part)
    key = lambda r: repr((r[0], r[1], round(r[3], 4)))
    want = sorted(((r.doc_id, r.n_tokens, r.n_known, r.score) for r in katz.score(docs).collect()), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.score) for r in katz.score_stored(docs, path).collect()), key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-9)
    # of every history the probabilities of all known words and of one unknown word add up to 1
    words = {r.id: r.p for r in katz.stored_words(spark, path).collect()}
    unknown = 1 - math.fsum(words.values())
    after = defaultdict(dict)
    for r in katz.stored_bigrams(spark, path).collect():
        after[r.h][r.w] = r.p
    for r in katz.stored_histories(spark, path).collect():
        left = 1 - math.fsum(words[w] for w in after[r.h])
        assert math.fsum(after[r.h].values()) + r.alpha * left == pytest.approx(1)
    assert 0 < unknown < 1 and len(after) > 10
    assert katz.score_stored(none, path).collect() == []
    new = spark.createDataFrame([(1, "alphaa never-seen betab"), (2, None), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens) for r in katz.score_stored(new, path).collect()) == [(1, 4), (2, 1), (2, 1)]


def test_a_model_of_nothing(spark, none, tmp_path):
    from pelagia.llm import katz

    katz.train(none, f"{tmp_path}/model")
    new = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = katz.score_stored(new, f"{tmp_path}/model").first()
    assert (r.n_tokens, r.n_known, r.score) == (3, 0, 0.0)


# --- op4 -----------------------------------------------------------------------------------------------------------


def language_brute(rows, k=4, rounds=15, margin=0.8):
    """Every step in plain Python: hashed n-grams, TF-IDF, spherical k-means, cosines and rejection."""

    def grams(text):
        if not text or not any(c.isalpha() for c in text):
            return None
        chars, out = [ord(c) if ord(c) >= 65 else 32 for c in f" {text.lower()} "], Counter()
        mixed = [0] * len(chars)
        for n in (1, 2, 3):
            mixed = [(m + c) * 0x9E3779B97F4A7C15 % 2**64 for m, c in zip(mixed, chars[n - 1 :])]
            out.update((m ^ n) >> 52 for m in mixed)
        return out

    def unit(v):
        norm = math.sqrt(math.fsum(x * x for x in v.values()))
        return {i: x / norm for i, x in v.items()}

    def dot(a, b):
        return math.fsum(x * b[i] for i, x in a.items() if i in b)

    def mean(vs):
        out = defaultdict(float)
        for v in vs:
            for i, x in v.items():
                out[i] += x / len(vs)
        return unit(out)

    learned = sorted(((x, t) for i, t, x in rows if t is not None and x is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 3 != 1), key=lambda r: r[0])
    counts = [(x, c) for x, c in ((x, grams(t)) for x, t in learned) if c is not None]
    df = Counter(i for _, c in counts for i in c)
    idf = lambda i: math.log((1 + len(counts)) / (1 + df[i])) + 1
    vector = lambda c: unit({i: math.log1p(n) * idf(i) for i, n in c.items()})
    of = defaultdict(list)
    for x, c in counts:
        of[x].append((c, vector(c)))
    cents = []
    for x in sorted(of):
        m = [v for _, v in of[x]]
        middle = mean(m)
        at = [max(range(len(m)), key=lambda i: dot(m[i], middle))]
        while len(at) < min(k, len(m)):
            at.append(min(range(len(m)), key=lambda i: max(dot(m[i], m[j]) for j in at)))
        c = [m[i] for i in at]
        for _ in range(rounds):
            near = [max(range(len(c)), key=lambda j: dot(v, c[j])) for v in m]
            c = [mean([v for v, j in zip(m, near) if j == i]) if i in near else c[i] for i in range(len(c))]
        cents += [(x, v) for v in c]
    size = lambda c: min(int(math.log2(sum(c.values()) + 1)), 20)
    by_size = defaultdict(list)
    for x in of:
        for c, v in of[x]:
            by_size[size(c)].append(max(dot(v, w) for _, w in cents))

    def quantile(v):
        v, at = sorted(v), 0.02 * (len(v) - 1)
        return v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at))

    low = [quantile(by_size[s]) if s in by_size else None for s in range(21)]
    for s in range(1, 21):
        low[s] = low[s - 1] if low[s] is None else low[s]
    for s in range(19, -1, -1):
        low[s] = low[s + 1] if low[s] is None else low[s]
    least = [min(low[s:]) * margin for s in range(21)]
    out = []
    for i, t, _ in rows:
        c = grams(t)
        if c is None:
            out.append((i, "und", 0.0, True))
            continue
        score, x = max(((dot(vector(c), w), x) for x, w in cents), key=lambda r: r[0])
        out.append((i, x, min(max(score, 0), 1), score < least[size(c)]))
    return out


def test_language_against_brute_force(spark):
    from pelagia.llm import language_id

    r = random.Random(6)
    letters = {"aa": "abcdeilmno", "bb": "xyzwqkuteö", "cc": "漢字文本語言学習日本"}
    word = lambda x: "".join(r.choice(letters[x]) for _ in range(r.randint(2, 7)))
    rows = [(i, " ".join(word(x) for _ in range(r.randint(3, 60))) + r.choice(["", ".", " 12!"]), x) for i, x in enumerate(r.choice(sorted(letters)) for _ in range(90))]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "123 !", "cc"), (203, rows[0][1], None), (None, rows[1][1], "aa"), (4, rows[4][1], rows[4][2]), (204, "ξενη γλωσσα " * 20, None)]
    df = spark.createDataFrame([(*x, "p", True) for x in rows], "doc_id long, text string, lang string, lang_pred string, rejected boolean").repartition(4)
    out = language_id.identify(df, language_id.train(df), keep=["doc_id"]).select("row.doc_id", "lang_pred", "score", "rejected").collect()
    key = lambda x: (repr(x[0]), x[1], round(x[2], 3))
    got, want = sorted((tuple(x) for x in out), key=key), sorted(language_brute(rows), key=key)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-4)
    assert sum(a[3] != b[3] for a, b in zip(got, want)) == 0 and {x[3] for x in got} == {True, False}


# --- op7 -----------------------------------------------------------------------------------------------------------


def test_a_packing_that_needs_the_search(spark):
    """Best fit leaves a third bin open; the search exchanges pieces until it is empty."""
    import public_tokenizers

    from pelagia.llm import packing

    lengths = [5, 4, 4, 3, 2, 2] * 7
    first = packing.best_fit(Counter(lengths), 10)
    least = -(-sum(lengths) // 10)
    assert sum(first.values()) > least
    rows = [(i, " ".join("a" for _ in range(n - 1))) for i, n in enumerate(lengths)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), public_tokenizers.path("byte_bpe_50k.json"), size=10).collect()
    assert sorted(r.length for r in out) == sorted(lengths)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 10
    assert len(bins) == least
