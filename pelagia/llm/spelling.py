"""Spelling variants: words at one edit from each other, by merging light subtrees of errata tries.

Which words can meet is decided by equal halves. Two words at one edit, the shorter of length l, have one place p of the
edit (their common prefix); either p is in the second half of the shorter and the first halves are equal, or the other way
round. So each word is in four groups: as the shorter and as the longer one, by its first and by its last part. A group
that is too large is cut in the same way again: the range of places is halved, and a further part must be equal. A range
of one place leaves two letters open, so a group of it holds at most a + a * a words of a letters; none is collected whole
before it is that small or under the bound.

In a group the sorted words are a trie. At every node the child with the most words is heavy; only the words of the light
children and of the node itself are merged, small to large: with the node's letter replaced by the heavy one, skipped, or
with the heavy letter put before it. A merged word that coincides with a terminal is a pair at one edit, as are two light
words that coincide without their letters. A word is light at most log2(n) times.

Words: maximal runs of Latin letters, A to Z lower-cased. Optionally one letter of some runs is deleted by a hash of the
document and the run (the contract of op11, which makes misspellings in a made-up corpus).

Defined cases: null and empty texts have no words; a null id is hashed as empty text; repeated rows count again; equal counts
of near words: the smaller word in code-point order; texts of any length are read by segments that no run spans; an empty table
gives an empty result; other columns are not read. Words are told apart whole, not by hashes.
"""

from __future__ import annotations

import os.path
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.shared import BATCH_BYTES, bounded, drop, materialise, segments, table

LENGTH, COUNT, TIMES, MOD = 7, 2, 10, 31
#: Different words that a task counts before it hands the counts on; words of a group that are merged in one trie; words of a task.
HELD, GROUP, TASK = 200_000, 20_000, 60_000
#: UTF-8 of [A-Za-zÀ-ÿ]+ after lower-casing A to Z.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def damaged(raw: bytes, doc_id: bytes, mod: int = MOD) -> str:
    """A run, with the letter deleted that the hash of document and run names, if it does."""
    word = raw.decode()
    h = crc32(doc_id + b":" + raw)
    if h % mod:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def counted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, mod: int = MOD) -> DataFrame:
    """(word, n) of the words of at least length code points; tasks add up before words move."""
    bounded(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for batch in batches:
            for i, t in zip(batch["id"], batch["text"], strict=True):
                if not t:
                    continue
                key = i.encode()
                for part in segments(t.encode("utf-8", "surrogatepass").lower(), BATCH_BYTES):
                    # a hash is that of all equal runs of a document
                    for raw, n in Counter(_RUN.findall(part)).items():
                        if len(raw) >= length and len(word := damaged(raw, key, mod)) >= length:
                            held[word] += n
                    if len(held) >= HELD:
                        yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                        held.clear()
        yield pd.DataFrame({"word": list(held), "n": list(held.values())}, columns=["word", "n"]).astype({"word": "object", "n": "int64"})

    some = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").alias("text"))
    return some.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(words: list[str], shorter: int, places: int) -> Iterator[tuple[int, int]]:
    """Pairs (places in words) at one edit, of different words of length shorter or shorter + 1, of which one has length
    shorter, and whose common prefix is at most places long."""
    order = sorted(range(len(words)), key=words.__getitem__)
    words_sorted = [words[i] for i in order]
    terminal = {w: i for i, w in zip(order, words_sorted, strict=True)}
    stack = [(0, len(order), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2:
            continue
        # nodes with one child and no terminal have nothing to merge
        depth += len(os.path.commonprefix([words_sorted[low][depth:], words_sorted[high - 1][depth:]]))
        if depth > places:
            continue
        children, at = [], low
        while at < high:
            letter, end = words_sorted[at][depth : depth + 1], at + 1
            while end < high and words_sorted[end][depth : depth + 1] == letter:
                end += 1
            children.append((end - at, at, end, letter))
            if letter:
                stack.append((at, end, depth + 1))
            at = end
        heavy = max((c for c in children if c[3]), default=None)
        if heavy is None:
            continue
        put, merged = heavy[3], defaultdict(list)
        for child in children:
            if child is heavy:
                continue
            for w in words_sorted[child[1] : child[2]]:
                mine, head, letter, rest = terminal[w], w[:depth], child[3], w[depth + 1 :]
                if len(w) == shorter:
                    if letter:
                        if (other := terminal.get(head + put + rest)) is not None:
                            yield mine, other
                        for twin in merged[rest]:
                            yield mine, twin
                        merged[rest].append(mine)
                    if (other := terminal.get(head + put + w[depth:])) is not None:
                        yield mine, other
                elif letter and rest[:1] != letter and (other := terminal.get(head + rest)) is not None:
                    yield mine, other


def _groups(rows: DataFrame) -> DataFrame:
    """rows (word, n, short, lo, hi), cut in two: the places lo to hi of an edit that the shorter of length short allows."""
    mid = F.floor((F.col("lo") + F.col("hi") + 1) / 2).cast("int")
    halves = F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), (mid - 1).alias("hi")))
    cut = rows.filter("lo < hi").select("word", "n", "short", F.explode(halves).alias("h")).select("word", "n", "short", "h.lo", "h.hi")
    tail = F.greatest(F.lit(0), F.col("short") - F.col("hi") - 1)
    same = F.concat(F.substring("word", F.lit(1), F.col("lo")), F.lit(" "), F.substring("word", F.length("word") - tail + 1, tail))
    return cut.withColumn("same", same)


def pairs(words: DataFrame, group: int = GROUP, task: int = TASK) -> DataFrame:
    """(word, near, near_n) of every two words (word, n) at one edit, in both directions, each once."""
    key = ["short", "lo", "hi", "same"]
    size = F.length("word").cast("int")
    roles = F.explode(F.array(size, size - 1)).alias("short")
    rows = _groups(words.select("word", "n", roles).withColumns({"lo": F.lit(0), "hi": F.col("short")}))

    def merged(g: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, str, int]] = []
        for (short, lo, hi, _), x in g.groupby(key, sort=False):
            if len(x) < 2:
                continue
            tail = max(0, short - hi - 1)
            names, n = x["word"].tolist(), x["n"].tolist()
            for a, b in one_edit([w[lo : len(w) - tail] for w in names], short - lo - tail, hi - lo):
                out += [(names[a], names[b], n[b]), (names[b], names[a], n[a])]
        return pd.DataFrame(out, columns=["word", "near", "near_n"]).astype({"near_n": "int64"})

    found = None
    while True:
        sized, _ = materialise(rows.groupBy(*key).agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        rows, _ = materialise(rows.join(sized, key), "groups")
        small, large = rows.filter((F.col("size") <= group) | (F.col("lo") == F.col("hi"))), rows.filter((F.col("size") > group) & (F.col("lo") < F.col("hi")))
        counts = rows.agg(F.count("*").alias("n"), F.count_if((F.col("size") > group) & (F.col("lo") < F.col("hi"))).alias("large")).first()
        tasks = max(1, ceil(counts["n"] / task))
        dealt = small.withColumn("task", F.pmod(F.xxhash64(*key), F.lit(tasks)))
        now = dealt.groupBy("task").applyInPandas(merged, "word string, near string, near_n long")
        found = now if found is None else found.unionByName(now)
        if not counts["large"]:
            return found
        rows = _groups(large)


def variants(words: DataFrame, times: int = TIMES, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    spark = words.sparkSession
    near = pairs(words, group).select("word", "near", "near_n", F.lit(None).cast("long").alias("n"))
    own = words.select("word", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"), "n")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), "near"))).alias("best")
    rows = own.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best)
    wins = -F.col("best.m") >= times * F.col("n")
    rows = rows.select("word", "n", "n_near", F.when(wins, F.col("best.near")).alias("form"), F.when(wins, -F.col("best.m")).alias("form_n"))
    rows, _ = materialise(rows, "forms")

    # forms grow by the factor each time, so a way to the last is short; a round doubles the steps taken
    step, at = materialise(rows.filter("form is not null").select("word", F.col("form").alias("to")), "steps")
    while True:
        on = step.select(F.col("word").alias("to"), F.col("to").alias("then"))
        joined = step.join(on, "to", "left")
        new, new_at = materialise(joined.select("word", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("more")), "steps")
        drop(spark, at)
        step, at = new.select("word", "to"), new_at
        if not new.filter("more").head(1):
            break
    return rows.join(step, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark, sf_dir: str) -> DataFrame:
    words, _ = materialise(counted(table(spark, sf_dir, "documents")).filter(F.col("n") >= COUNT), "words")
    return variants(words)


#: crc32 goes through its 256-entry table, which is made by rule; near words meet by equal words with one letter left out.
OP11_SQL = """
with recursive crc as materialized (select list(v order by i) as t from (select i, list_reduce(list_prepend(i::bigint, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)::bigint as v from range(256) r(i))),
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents),
found as materialized (select doc_id, w, count(*) as n from runs where length(w) >= 7 group by all),
bytes as (select w, n, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || w, ''),
    lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end)) as b from found),
hashed as (select w, n, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from bytes, crc),
words as materialized (select word, sum(n)::bigint as n, row_number() over (order by word) as id from (
    select case when h % 31 = 0 then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, n from hashed)
  where length(word) >= 7 group by word having sum(n) >= 2),
cut as materialized (select id, word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from (select id, word, n, unnest(range(1, length(word) + 1))::int as i from words)),
near as materialized (
  select distinct a.id, b.word as near, b.n as near_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.id <> b.id
  union all (select distinct a.id, w.word, w.n from cut a join words w on a.rest = w.word)
  union all (select distinct w.id, a.word, a.n from cut a join words w on a.rest = w.word)),
best as (select id, count(*) as n_near, max(near_n) as m, arg_min(near, (-near_n, near)) as near from near group by id),
forms as materialized (select word, n, coalesce(n_near, 0) as n_near, case when m >= 10 * n then near end as form, case when m >= 10 * n then m end as form_n from words left join best using (id)),
way as (select word, word as stop, 0 as k from forms union all select way.word, forms.form, k + 1 from way join forms on forms.word = way.stop where forms.form is not null),
roots as (select word, arg_max(stop, k) as root from way group by word)
select word, form, root, n, n_near, form_n from forms join roots using (word)
"""
