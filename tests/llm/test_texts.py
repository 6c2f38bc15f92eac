"""op1, op2, op3, op4 and op10 against brute force on a small fixture with every awkward case."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pelagia.llm import bpe, katz, language_id, pii, quality_rules
from tests.llm.conftest import rows_of

TIKTOKEN, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- op1 -----------------------------------------------------------------------------------------------------------

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, p) in enumerate(KINDS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if (kind == "card" and not (14 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), n, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, n, e, k in sorted(out))


def test_pii_base_spans(spark, docs):
    import random

    r = random.Random(5)
    bits = ["1", "2.", "3", " ", "-", ".", "@", "a", "b.c", "+1", "(555) ", "255", "256", "000", "4111 1111 1111 1111", "\n", "é", "_x", "x@y.zz", "192.168.0.1", "😀", "@d.e"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(800)] + [(800, "1" * 5000), (801, "a@b.c " * 700), (802, "9.9.9.9" * 300), (803, None)]
    got = dict(pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), keep=["doc_id"]).select("row.doc_id", pii.joined("base")).collect())
    assert got == {i: base_spans(t) for i, t in rows}


@pytest.mark.parametrize("literal", [5000, 0])
def test_pii_discloses_terms(spark, literal):
    plain = [(i, f"line {i} some common words about nothing much number{i}") for i in range(300)]
    told = [(1000 + i, f"{'abcdefgh'[i]}xq{'word' * (i + 1)} Zorblatt wrote to boss@acme.com about {'qrstuvwx'[i]}thing") for i in range(5)]
    more = [(2000, "zorblatt alone here, not zorblatts"), (None, None), (2001, ""), (2001, "")]
    found = pii.find(spark.createDataFrame(plain + told + more, "doc_id long, text string"), literal=literal)
    assert found.count() == len(plain + told + more)
    texts = {r[0]: (r[1], r[2]) for r in pii.sanitised(found).select("row.doc_id", pii.joined("spans"), "clean").collect()}
    assert texts[2000] == ("secret:0:8", " alone here, not zorblatts")
    assert "boss" not in texts[1001][1] and "[EMAIL]" in texts[1001][1] and "Zorblatt" not in texts[1001][1]
    assert texts[5] == ("", plain[5][1])


def pii_brute(rows, window=pii.WINDOW, support=2, generalise=0.8, remove=0.95):
    """Per row its spans and its sanitised text, by loops over everything."""
    term = re.compile(r"[^\W\d_]{3,}")
    texts = [t or "" for _, t in rows]
    base = [[(int(s), KINDS_AT[k], int(e), k) for k, s, e in (x.split(":") for x in base_spans(t).split(",") if x)] for t in texts]
    near, held, n = defaultdict(lambda: (set(), set())), defaultdict(set), len(rows)
    for u, (t, spans) in enumerate(zip(texts, base)):
        for s, _, e, k in spans:
            a, z = max(s - window, 0), min(e + window, len(t))
            left, right = t[a:s], t[e:z]
            left = re.sub(r"^[^\W\d_]+", "", left) if a else left
            right = re.sub(r"[^\W\d_]+$", "", right) if z < len(t) else right
            around, c = (left + "\n" + right).lower(), (k, t[s:e].lower())
            held[c].add(u)
            for w in set(term.findall(around)):
                near[c, w][0].add(around)
                near[c, w][1].add(u)
    df_t = Counter(w for t in texts for w in set(term.findall(t.lower())))
    share = {}
    for (c, w), (around, us) in near.items():
        if len(around) >= support and len(held[c]) < n:
            x = math.log2(n * len(us) / (len(held[c]) * df_t[w])) / math.log2(n / len(held[c]))
            share[w] = max(share.get(w, 0), x)
    out = []
    for t, spans in zip(texts, base):
        all_ = list(spans)
        for m in term.finditer(t):
            x = share.get(m[0].lower(), 0)
            if x >= generalise and not any(s < m.end() and m.start() < e for s, _, e, _ in spans):
                all_.append((m.start(), 4, m.end(), "secret" if x >= remove else "term"))
        clean, at = "", 0
        for s, _, e, k in sorted(all_):
            if s >= at:
                clean += t[at:s] + ("" if k == "secret" else f"[{k.upper()}]")
            at = max(at, e)
        out.append((",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(all_)), clean + t[at:]))
    return out


KINDS_AT = {k: i for i, (k, _) in enumerate(KINDS)}


@pytest.mark.parametrize("literal", [5000, 0])
def test_pii_against_brute_force(spark, literal):
    import random

    r = random.Random(11)
    names = ["Zorblatt", "quibble", "Örtlich", "marlowe", "fennec"]
    words = ["the", "of", "and", "with", "some", "thing", "reads", "a", "to"] + [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(8) for j in range(8)]
    data = ["boss@acme.com", "10.0.0.1", "+1 (555) 123-4567", "4111 1111 1111 1111", "a.1.2.3.4@x.yz", "+12 345 678 90 11.12.13.14"]
    rows = []
    for i in range(220):
        parts = [r.choice(words) for _ in range(r.randint(0, 90))]
        if r.random() < 0.3:
            j = r.randrange(5)
            at = r.randint(0, len(parts))
            parts[at:at] = [names[j] if r.random() < 0.8 else "", data[j], r.choice(words)]
        if r.random() < 0.1:
            parts.insert(r.randint(0, len(parts)), r.choice(data))
        rows.append((i, " ".join(parts)))
    rows += rows[:60] + rows[:20] + [(900, None), (900, None), (None, "fennec 😀 10.0.0.1 fennec")]  # repeated rows, code points beyond 16 bits
    found = pii.sanitised(pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), literal=literal, keep=["doc_id"]))
    got = sorted((repr(x[0]), x[1], x[2]) for x in found.select("row.doc_id", pii.joined("spans"), "clean").collect())
    want = sorted((repr(i), *x) for (i, _), x in zip(rows, pii_brute(rows)))
    assert got == want and any("term" in x[1] or "secret" in x[1] for x in got)


def test_pii_of_a_text_of_many_spans(spark):
    """A text of a megabyte and 100,000 addresses takes seconds, not the square of their number."""
    import time

    text = "".join(f"u{i}@a.b " for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id long, text string")
    begun = time.time()
    out = {x.doc_id: x.text for x in pii.stage(spark, df, "").collect()}
    assert out == {1: "[EMAIL] " * 100_000, 2: "nothing"} and time.time() - begun < 120


def test_pii_stage_keeps_rows_and_columns(spark, docs, none, small):
    out = pii.stage(spark, docs, "")
    assert out.columns == docs.columns and out.schema == docs.schema
    assert sorted(map(repr, [(r.doc_id, r.text) for r in out.collect()])) == sorted(map(repr, [(i, t) for i, t, _ in small]))
    assert pii.stage(spark, none, "").count() == 0


# --- op2 -----------------------------------------------------------------------------------------------------------


def counted(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(docs, none, small):
    out = quality_rules.judge(docs, keep=["doc_id"]).select("row.doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept")
    want = []
    for i, t, _ in small:
        c = counted(t)
        want.append((i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert sorted(map(repr, [tuple(r)[:-1] for r in out.collect()])) == sorted(map(repr, want))
    assert not any(r.kept and r.base_failed for r in out.collect())
    assert quality_rules.judge(none).count() == 0 and quality_rules.stage(None, docs, "").columns == docs.columns


def test_quality_em_finds_the_bad_class():
    rng = np.random.default_rng(0)
    good = rng.choice([1, 0, -1], (900, 9), p=[0.8, 0.19, 0.01])
    bad = rng.choice([1, 0, -1], (100, 9), p=[0.2, 0.2, 0.6])
    model = quality_rules.fit(np.concatenate([good, bad]), np.ones(1000))
    assert model["prior"] == pytest.approx(0.9, abs=0.05)
    assert (model["p"][0][:, 0] > model["p"][1][:, 0]).all()
    assert quality_rules.fit(np.empty((0, 9), int), np.empty(0))["prior"] == 0.5


def em_brute(votes, rounds=400):
    """P(good) of each document, by loops over documents: three outcomes of a rule for each class."""
    q = [0.98 if v.count(-1) == 0 else 0.3 if v.count(-1) == 1 else 0.05 for v in votes]
    for _ in range(rounds):
        p = [[{x: 0.5 for x in (-1, 0, 1)} for _ in range(9)] for _ in range(2)]
        for v, g in zip(votes, q):
            for j, x in enumerate(v):
                p[1][j][x] += g
                p[0][j][x] += 1 - g
        prior = min(max(sum(q) / len(q), 1e-3), 1 - 1e-3)
        new = []
        for v in votes:
            like = [prior if y else 1 - prior for y in (0, 1)]
            for y in (0, 1):
                for j, x in enumerate(v):
                    like[y] *= p[y][j][x] / sum(p[y][j].values())
            new.append(like[1] / (like[0] + like[1]))
        moved, q = max(abs(a - b) for a, b in zip(q, new)), new
        if moved < 1e-9:
            break
    return q


def test_quality_verdict_against_brute_force(spark, docs, none, small):
    import random

    r = random.Random(6)
    prose = lambda n: " ".join(r.choice("sea tide reef krill mund alpha beta gamma delta".split()) + r.choice("abcdefg") * r.randint(0, 3) for _ in range(n)) + ".\nEnd."
    texts = [prose(r.randint(1, 200)) for _ in range(150)] + ["BUY NOW!! " * r.randint(3, 40) for _ in range(15)] + ["# $ | <a> 12 | " * r.randint(2, 30) for _ in range(15)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:30])] + [(i, t) for i, t, _ in small]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    votes = quality_rules.judge(df).select("row.doc_id", "row.text", "base_failed", "kept", "posterior", *[v.alias(k) for k, v in quality_rules.rules().items()]).collect()
    want = em_brute([[x[k] for k in quality_rules.RULES] for x in votes])
    assert np.allclose([x.posterior for x in votes], want, atol=1e-6)
    assert all(x.kept == (not x.base_failed and w >= 0.5) for x, w in zip(votes, want) if abs(w - 0.5) > 1e-6)
    assert {x.kept for x in votes} == {True, False}
    kept = sorted(repr((x.doc_id, x.text)) for x in votes if x.kept)
    assert sorted(repr(tuple(x)) for x in quality_rules.stage(spark, df, "").collect()) == kept
    assert quality_rules.stage(spark, none, "").count() == 0


# --- op3 -----------------------------------------------------------------------------------------------------------


def katz_brute(rows, K=5):
    tokens = [[*((x or "").encode().lower().split()), None] for _, x in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    uni, bi = Counter(), Counter()
    for w, h in zip(tokens, held):
        if not h:
            uni.update(w)
            bi.update(zip([None, *w], w))
    n, v = sum(uni.values()), len(uni)

    def disc(c):
        nr = Counter(c.values())
        tail = (K + 1) * nr[K + 1] / nr[1] if nr[1] else 1
        d = [1] + [((r + 1) * nr[r + 1] / (r * nr[r]) - tail) / (1 - tail) if nr[r] and tail < 1 else 0 for r in range(1, K + 1)]
        return d if all(0 < x < 1 for x in d[1:]) else [1] + [(r - 0.5) / r for r in range(1, K + 1)]

    lower = lambda d, c: d[c] * c if c <= K else c
    d1, d2 = disc(uni), disc(bi)
    pu = {w: lower(d1, c) / n for w, c in uni.items()}
    unknown = 1 - math.fsum(pu.values())
    after = defaultdict(dict)
    for (h, w), c in bi.items():
        after[h][w] = c
    model = {}
    for h, x in after.items():
        half, c_h = all(c > K for c in x.values()), sum(x.values())
        p = {w: (c - 0.5 if half else lower(d2, c)) / c_h for w, c in x.items()}
        model[h] = p, (1 - math.fsum(p.values())) / (1 - math.fsum(pu[w] for w in x))
        everything = math.fsum(p.values()) + model[h][1] * (1 - math.fsum(pu[w] for w in x))
        assert everything == pytest.approx(1)
    out = []
    for (i, _), w, hd in zip(rows, tokens, held):
        score = base = known = 0
        for h, x in zip([None, *w], w):
            p = pu.get(x, unknown)
            if h in model:
                p = model[h][0].get(x) or model[h][1] * p
            score += math.log10(p)
            base += math.log10((uni[x] + 1) / (n + v + 1))
            known += x in uni
        out.append((i, hd, len(w), known, n, base, score))
    return out


@pytest.mark.parametrize(("block", "part"), [(10**6, 10**6), (500, 200)])
def test_katz_scores(docs, none, small, block, part):
    got = sorted((tuple(r) for r in katz.score(docs, block=block, part=part).collect()), key=lambda r: repr((r[:5], round(r[6], 3))))
    want = sorted(katz_brute([(i, t) for i, t, _ in small]), key=lambda r: repr((r[:5], round(r[6], 3))))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    assert katz.score(none).count() == 0


def test_katz_splits_hot_histories(spark):
    rows = [(i, "the " + " the ".join(f"w{j % 97}" for j in range(i, i + 400))) for i in range(40)]
    got = sorted(tuple(r) for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string"), block=2000, part=100).collect())
    want = sorted(katz_brute(rows))
    assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[6] for r in got], [r[6] for r in want])


def test_packed_arrays_come_back():
    for a in ([], [0], [255, 256], [-1, 5], [2**40]):
        assert katz.unpack(katz.pack(np.array(a, np.int64))).tolist() == a
    assert katz.unpack(katz.pack(np.array([0.5, -1])), "f8").tolist() == [0.5, -1]


# --- op4 -----------------------------------------------------------------------------------------------------------


def test_language_id(spark, docs, none):
    sets = {"en": ["the", "with", "there", "thing", "and", "what"], "fr": ["le", "été", "nous", "avec", "être", "que"], "de": ["und", "über", "schön", "nicht", "straße", "ein"]}
    import random

    r = random.Random(1)
    rows = [(i, " ".join(r.choice(sets[x]) for _ in range(r.randint(8, 60))), x) for i, x in enumerate(sorted(sets) * 80)] + [(900, None, "en"), (901, "123 ...", "fr"), (902, "qzx jjkq vvww " * 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {x.row.doc_id: x for x in language_id.identify(df, language_id.train(df), keep=["doc_id"]).collect()}
    held = [x for x in rows[:240] if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert held and all(out[i].lang_pred == x and not out[i].rejected for i, _, x in held)
    assert (out[900].lang_pred, out[900].score, out[901].lang_pred) == ("und", 0.0, "und")
    assert out[902].rejected and 0 <= out[902].score <= 1
    assert language_id.identify(docs, language_id.train(none)).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language_id.stage(spark, docs, "").columns == docs.columns and language_id.stage(spark, none, "").count() == 0


def test_language_id_rejects_an_unlearned_language():
    import random

    shared = "museum radio hotel taxi metro opera program central national animal capital material general digital music photo".split()
    words = {
        "en": "the of and to in is was that for with on are this from they have were which their there would about when",
        "fr": "le la les des une dans est que pour avec sur sont cette par ils ont qui leur nous elle mais plus comme",
        "es": "el los las una en es que para con sobre son esta por ellos han cual nos ella pero muy como todo desde",
        "de": "der die das und ein nicht ist mit auf von sind dieser aus sie haben waren welche ihr wir aber mehr wie",
    }
    r = random.Random(4)
    prose = lambda x: " ".join(r.choice(words[x].split() if r.random() < 0.35 else shared) for _ in range(r.randint(40, 120)))
    rows = [(x, prose(x)) for x in sorted(words) * 90]
    learned, held = rows[:240], rows[240:]
    lost = let_in = 0
    for out in words:
        use = [(x, t) for x, t in learned if x != out]
        model = language_id.fit([language_id.counts(t) for _, t in use], [x for x, _ in use])
        got = language_id.predict(model, [t for _, t in held])["rejected"].tolist()
        let_in += sum(not g for g, (x, _) in zip(got, held) if x == out)
        lost += sum(g for g, (x, _) in zip(got, held) if x != out)
    assert let_in <= 0.1 * len(held) and lost <= 0.03 * 3 * len(held), (let_in, lost)


# --- op10 ----------------------------------------------------------------------------------------------------------


def test_bpe_digests(docs, none, small):
    enc = bpe.encoding(TIKTOKEN)
    want = [(i, enc.encode_ordinary(t or "")) for i, t, _ in small]
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (400, 40), (64, 16)):
        got = bpe.encode(docs, TIKTOKEN, chunk=chunk, overlap=overlap)
        assert rows_of(got) == sorted(want, key=repr)
    assert bpe.encode(none, TIKTOKEN).count() == 0
    n, ids, back = bpe.digest(TIKTOKEN, want[0][1])
    assert (n, back) == (len(want[0][1]), hashlib.sha256(small[0][1].encode()).hexdigest())
    assert ids == hashlib.sha256(" ".join(map(str, want[0][1])).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab '\n\tsre1é漢.!😀 ", min_size=1, max_size=120), st.integers(8, 30), st.integers(4, 8))
def test_bpe_stitches_to_the_whole(text, chunk, overlap):
    parts = [bpe.pieces(TIKTOKEN, text[i : i + chunk + overlap]) for i in range(0, len(text), chunk)]
    ids = bpe.stitch(parts, chunk)
    assert ids is None or ids.tolist() == bpe.encoding(TIKTOKEN).encode_ordinary(text)


def test_ranks_of_both_files_agree_with_tokenizers(small):
    from tokenizers import Tokenizer

    assert bpe.ranks(JSON) == bpe.ranks(TIKTOKEN)
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    for _, text, _ in small:
        assert t.encode(text or "", add_special_tokens=False).ids == bpe.encoding(JSON).encode_ordinary(text or "")
