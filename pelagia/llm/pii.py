"""PII by information-theoretic sanitisation, in DataFrame expressions only.

Personal data found by pattern (emails, IPv4 addresses, payment cards, phone numbers) are protected entities. A term is
a run of at least three letters, in lower case. Over the whole corpus of n rows, df(c) hold entity c, df(t) hold term t
and co(c, t) have t within ``window`` code points of c: co is at most what whole texts would give, so a share is never
overstated. The share of c's information that t discloses is

    PMI(c; t) / IC(c) = log2(n * co / (df(c) * df(t))) / log2(n / df(c)).

Terms with at least ``support`` different surroundings beside c and a share of at least ``generalise`` are spans of kind
``term`` wherever they stand outside base spans; from ``remove`` on their kind is ``secret``. sanitised() replaces base
spans by their kind, terms by a placeholder and removes secrets.

Defined cases: null text is the empty text; of base spans, kinds may overlap each other, spans of one kind never do;
repeated rows get repeated results, and each counts in n, df and co but not as surroundings; null ids
are kept; a text's size bounds the work: spans are cut from blocks of the text, not each from its beginning; an empty table gives an empty result; other columns are not read (stage keeps them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.llm.shared import materialise, row_key, table

#: In the order of the contract. Possessive where a match cannot end earlier; (?:\G|...) starts a run only where it begins.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
TERM = r"\p{L}{3,}"
WINDOW, SUPPORT, GENERALISE, REMOVE = 120, 2, 0.8, 0.95
#: Terms that go into a plan as a literal, about half a megabyte; more of them are joined.
LITERAL = 50_000
#: Terms that are broadcast: a few megabytes.
SENT = 200_000
#: Matches whose positions are summed in one go.
RUN = 256


#: Code points of a block of a text.
BLOCK = 256


def blocks(text: Column) -> Column:
    """The text in blocks, from which parts are cut without reading it from its beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(parts: Column, begin: Column, end: Column) -> Column:
    """Code points begin to end (exclusive) of a text in blocks."""
    first = F.floor(begin / BLOCK).cast("int")
    some = F.array_join(F.slice(parts, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1), "")
    return F.when(end > begin, F.substring(some, begin - first * BLOCK + 1, end - begin)).otherwise(F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is made once, also where body uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def reached(spans: Column, end: Callable[[Column], Column]) -> Column:
    """For each of the spans, the largest ``end`` of those before it, 0 for the first: by runs, so that it costs no square."""
    some = lambda ends, begin, n: F.coalesce(F.array_max(F.slice(ends, begin, n)), F.lit(0))
    numbers = F.when(F.size(spans) > 0, F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / RUN).cast("int"))).otherwise(F.array().cast("array<int>"))

    def each(ends: Column, before: Column) -> Column:
        run = lambda i: F.floor(i / RUN).cast("int")
        return F.transform(ends, lambda _, i: F.greatest(F.get(before, run(i)), some(ends, run(i) * RUN + 1, i % RUN)))

    tops = lambda ends: F.transform(numbers, lambda r: some(ends, r * RUN + 1, F.lit(RUN)))
    upto = lambda t: F.transform(t, lambda _, r: some(t, F.lit(1), r))
    return let(F.transform(spans, end), lambda ends: let(tops(ends), lambda t: let(upto(t), lambda before: each(ends, before))))


def _luhn(digits: Column) -> Column:
    """Whether the digits pass: from the right, every second doubled, digits of the products summed."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2).try_cast("int")))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        n = F.length(digits)
        return F.when(n.between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


SPAN = "struct<start: int, kind_no: int, end: int, kind: string, value: string>"


def _located(df: DataFrame, text: str, pattern: Column | str, kind: str, kind_no: int, out: str, test: Column | None = None) -> DataFrame:
    """Add column ``out``: spans of the pattern's matches. Positions are sums of the lengths of gaps and matches, taken
    in runs of RUN so that a text of many matches costs no square of their number."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    t = F.col(text)
    has = F.coalesce(F.rlike(t, p) if test is None else test & F.rlike(t, p), F.lit(False))
    df = df.withColumn("_m", F.when(has, F.regexp_extract_all(t, p, F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_g", F.when(has, F.transform(F.split(t, p, -1), F.length)).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_s", F.zip_with(F.slice("_g", 1, F.size("_m")), F.transform("_m", F.length), lambda g, m: g + m))
    runs = F.sequence(F.lit(0), F.floor((F.size("_s") - 1) / RUN).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    df = df.withColumn("_r", F.when(F.size("_s") > 0, F.transform(runs, lambda r: total(F.slice("_s", r * RUN + 1, RUN)))).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_b", F.transform("_r", lambda _, r: total(F.slice("_r", F.lit(1), r))))

    def span(m: Column, i: Column) -> Column:
        run = F.floor(i / RUN).cast("int")
        before = F.get("_b", run) + total(F.slice("_s", run * RUN + 1, i % RUN))
        start = before + F.get("_g", i)
        return F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("value"))

    spans = F.when(F.size("_m") > 0, F.transform("_m", span)).otherwise(F.array().cast(f"array<{SPAN}>"))
    return df.withColumn(out, F.filter(spans, lambda s: _valid(kind, s["value"]))).drop("_m", "_g", "_s", "_r", "_b")


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base``: the spans of all kinds by start, then kind."""
    tests = {"email": F.contains(F.col(text), F.lit("@")), "phone": F.contains(F.col(text), F.lit("+"))}
    for i, kind in enumerate(KINDS):
        df = _located(df, text, PATTERNS[kind], kind, i, f"_{kind}", tests.get(kind))
    return df.withColumn("base", F.array_sort(F.concat(*[f"_{k}" for k in KINDS]))).drop(*[f"_{k}" for k in KINDS])


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _surroundings(found: DataFrame, window: int) -> DataFrame:
    """(entity, uid, around, term): a row for each term near an entity, once for each row of found (uid, text, base)."""

    def near(b: Column, n: Column, s: Column) -> Column:
        begin, end = F.greatest(s["start"] - window, F.lit(0)), F.least(s["end"] + window, n)
        left, right = cut(b, begin, s["start"]), cut(b, s["end"], end)
        # a word that the window cuts is left out
        left = F.when(begin > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
        right = F.when(end < n, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
        return F.struct(F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"), F.lower(F.concat_ws("\n", left, right)).alias("around"))

    rows = found.select("uid", F.explode(let(blocks(F.col("text")), lambda b: let(F.length("text"), lambda n: F.transform("base", lambda s: near(b, n, s))))).alias("s"))
    return rows.select("uid", "s.entity", F.xxhash64("s.around").alias("around"), F.explode(terms_of(F.col("s.around"))).alias("term"))


def _among(terms: DataFrame, n: int) -> Callable[[Column], Column]:
    """Whether a term is one of the n ``term`` of terms, which go into the plan as one string, cut into buckets by hash. A look
    costs the same however many terms there are, and no text moves. Terms are letters only, so blanks part them."""
    size = 1 << max(n - 1, 0).bit_length()
    bucket = lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int")
    held = terms.groupBy(bucket(F.col("term")).alias("b")).agg(F.concat_ws(" ", F.collect_list("term")).alias("terms"))
    found = {r["b"]: r["terms"] for r in held.collect()}
    buckets = F.split(F.lit("\n".join(f" {found.get(b, '')} " for b in range(size))), "\n")
    return lambda t: F.contains(F.get(buckets, bucket(t)), F.concat(F.lit(" "), t, F.lit(" ")))


def _holding(rows: DataFrame, terms: DataFrame, literal: int) -> DataFrame:
    """(key, term) for the terms that the texts of rows (key, text) hold. Up to ``literal`` terms are in the plan; more, up to
    SENT of them, are broadcast; beyond that the texts' terms are dealt out by term."""
    n = terms.count()
    if n <= literal:
        return rows.select("key", F.explode(F.filter(terms_of(F.col("text")), _among(terms, n))).alias("term"))
    some = terms.select("term")
    return rows.select("key", F.explode(terms_of(F.col("text"))).alias("term")).join(F.broadcast(some) if n <= SENT else some, "term", "left_semi")


def disclosing(rows: DataFrame, window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE, literal: int = LITERAL) -> DataFrame:
    """(term, share): terms and the largest share of an entity's information that they disclose, at least ``generalise``.

    rows: key, text, base."""
    n = rows.count()
    # exploding an array of none or one keeps the same rows as a filter, but a filter would move below and find the spans twice
    one = F.explode(F.when(F.size("base") > 0, F.array(F.struct("text", "base")))).alias("r")
    found, _ = materialise(rows.select(one).select("r.*").withColumn("uid", F.monotonically_increasing_id()), "entities")
    near = _surroundings(found, window)
    often = near.groupBy("entity", "term").agg(F.count("*").alias("mentions")).filter(F.col("mentions") >= support)
    likely = near.join(often.select("entity", "term"), ["entity", "term"], "left_semi")
    # distinct surroundings and rows, each by an aggregate of its own, so that a common pair is summed before it moves
    different = likely.select("entity", "term", "around").distinct().groupBy("entity", "term").agg(F.count("*").alias("different")).filter(F.col("different") >= support)
    co = likely.select("entity", "term", "uid").distinct().groupBy("entity", "term").agg(F.count("*").alias("co"))
    pairs, _ = materialise(different.join(co, ["entity", "term"]), "pairs")
    if not pairs.head(1):
        return pairs.select("term", F.lit(0.0).alias("share"))
    entity = F.explode(F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))).alias("entity")
    df_c = found.select(entity).groupBy("entity").agg(F.count("*").alias("df_c"))
    df_t = _holding(rows, pairs.select("term").distinct(), literal).groupBy("term").agg(F.count("*").alias("df_t"))
    scored = pairs.join(df_c, "entity").join(df_t, "term")
    pmi = F.log2(F.lit(float(n)) * F.col("co") / (F.col("df_c") * F.col("df_t")))
    share = F.when(F.col("df_c") < n, pmi / F.log2(F.lit(float(n)) / F.col("df_c")))
    return scored.groupBy("term").agg(F.max(share).alias("share")).filter(F.col("share") >= generalise)


def find(docs: DataFrame, text: str = "text", window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, literal: int = LITERAL, keep: list[str] | None = None) -> DataFrame:
    """keep columns of docs under ``row``, ``text``, ``base`` and ``spans`` (base ones and terms, by start, then kind)."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(row.alias("row"), body.alias("text"), row_key(*[f"`{c}`" for c in dict.fromkeys([*(docs.columns if keep is None else keep), text])]).alias("key"))
    rows = base_spans(rows)
    terms, _ = materialise(disclosing(rows.select("key", "text", "base"), window, support, generalise, literal), "terms")
    n = terms.count()
    if not n:
        return rows.select("row", "text", "base", F.col("base").alias("spans"))
    if n <= literal:
        secret = terms.filter(F.col("share") >= remove)
        rows = rows.withColumn("_terms", F.filter(terms_of(F.col("text")), _among(terms, n))).withColumn("_secret", F.filter("_terms", _among(secret, n)))
    else:
        held = _holding(rows.select("key", "text"), terms, literal).distinct().join(terms, "term")
        held = held.groupBy("key").agg(F.collect_set("term").alias("_terms"), F.collect_set(F.when(F.col("share") >= remove, F.col("term"))).alias("_secret"))
        rows = rows.join(held, "key", "left")
        rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("_terms", "_secret")})
    either = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("_terms", "|"), F.lit(r")(?!\p{L})"))
    pattern = F.when(F.size("_terms") > 0, either).otherwise(F.lit(r"(?!)"))
    rows = _located(rows, "text", pattern, "term", len(KINDS), "_found", F.size("_terms") > 0)
    # in order of start, a term is clear of base spans if none before it reaches it and the next one begins after it
    both = F.array_sort(F.concat("base", F.filter("_found", lambda t: F.array_contains("_terms", F.lower(t["value"])))))
    kind = lambda s: F.when(s["kind"] == "term", 0).otherwise(s["end"])
    clear = lambda both, before, s, i: (s["kind"] != "term") | ((F.get(before, i) <= s["start"]) & (F.coalesce(F.get(both, i + 1)["start"], s["end"]) >= s["end"]))
    told = lambda both, before: F.transform(both, lambda s, i: F.when(clear(both, before, s, i), s))
    left = let(both, lambda x: let(reached(x, kind), lambda before: F.array_compact(told(x, before))))
    named = F.transform(left, lambda s: F.when((s["kind"] == "term") & F.array_contains("_secret", F.lower(s["value"])), s.withField("kind", F.lit("secret"))).otherwise(s))
    return rows.select("row", "text", "base", F.when(F.size("_terms") > 0, named).otherwise(F.col("base")).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1(spark, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return out.select("row.doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sanitised(df: DataFrame, out: str = "clean") -> DataFrame:
    """Add ``out``: ``text`` with every one of ``spans`` replaced; overlapping spans are replaced as one, by the first one's kind."""
    token = lambda s: F.when(s["kind"] == "secret", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    part = lambda b, at, s, i: F.when(s["start"] >= F.get(at, i), F.concat(cut(b, F.get(at, i), s["start"]), token(s))).otherwise(F.lit(""))
    rest = lambda b, spans: cut(b, F.array_max(F.transform(spans, lambda s: s["end"])), F.length("text"))
    whole = lambda b, spans, at: F.concat(F.array_join(F.transform(spans, lambda s, i: part(b, at, s, i)), ""), rest(b, spans))
    clean = let(F.col("spans"), lambda spans: let(blocks(F.col("text")), lambda b: let(reached(spans, lambda s: s["end"]), lambda at: whole(b, spans, at))))
    return df.withColumn(out, F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts sanitised and n_chars counted again where a text changed; null texts stay null."""
    found = sanitised(find(docs))
    changed = F.size("spans") > 0
    new = {"text": F.when(changed, F.col("clean")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("clean").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if new.get(c) is not None else F.col(f"row.`{c}`") for c in docs.columns])
