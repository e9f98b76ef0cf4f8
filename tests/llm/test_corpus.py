"""Operators that relate documents to each other, against plain versions on small tables."""

import collections
import itertools
import re
import unicodedata

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import jaccard, lines, resharding
from foliant.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sets:
    """Union-find, the least member as root."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, a):
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def variants(seed, count, words=60, changes=1):
    rng = np.random.default_rng(seed)
    base = [f"w{seed}x{i}" for i in range(words)]
    for _ in range(count):
        text = list(base)
        for _ in range(changes):
            text[int(rng.integers(words))] = f"z{int(rng.integers(5))}"
        yield " ".join(text)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(-1, None), (-2, ""), (-3, " \n "), (-4, "One Two"), (-5, "one TWO"), (-6, "one"), (-7, "one\ntwo")]
    rows += [(-100 - k, x) for k, x in enumerate(variants(1, 50))] + [(-200 - k, x) for k, x in enumerate(variants(2, 12, 80, 2))]
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return spark.createDataFrame(rows, "doc_id long, text string").unionByName(real).withColumn("k", F.lit(1)).withColumn("node", F.lit(1)).cache()


def shingle_sets(rows, words):
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out[i] = frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset()
    return out


def groups(sets, percent):
    found, ids = Sets(sets), sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                found.join(i, j)
    return {i: found.root(i) for i in sets}


@pytest.mark.parametrize(("percent", "words", "block"), [(90, 3, 3000), (90, 3, 10), (80, 5, 3000)])
def test_jaccard(docs, monkeypatch, percent, words, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SHARED", 3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = shingle_sets(rows, words)
    expected = groups(sets, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(docs, percent, words).collect()}
    assert got == {i: (len(sets[i]), expected[i]) for i in sets}


def test_jaccard_tasks_are_bounded_in_a_group_of_near_misses(spark, monkeypatch):
    """A group of many blocks of sets of which hardly any link: no search holds more than two blocks, and the few links are found."""
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    monkeypatch.setattr(jaccard, "SHARED", 3)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base[: k % 58 + 1], f"only{k - (k % 100 == 59)}", *base[k % 58 + 2 :]])) for k in range(600)]
    rows += [(10_000 + k, rows[k][1] + f" end{k}") for k in range(0, 600, 60)]
    held, plain = [], jaccard.searched

    def counted(df, *args):
        keys = [c for c in ("group", "block", "part") if c in df.columns]
        held.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return plain(df, *args)

    monkeypatch.setattr(jaccard, "searched", counted)
    got = {r.doc_id: r.component_id for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups(shingle_sets(rows, 3), 90)
    assert len(held) == 2 and max(held) <= 2.8 * jaccard.BLOCK, held


def test_jaccard_near_misses_with_texts_of_their_own(spark, monkeypatch):
    """Pages of one template with something of their own meet nothing a second time, but for the few that may link, however many pages there are."""
    monkeypatch.setattr(jaccard, "BLOCK", 60)
    monkeypatch.setattr(jaccard, "SHARED", 3)
    template, sent = [f"w{i}" for i in range(200)], []
    plain = jaccard.searched

    def counted(df, percent, labelled, batches):
        if labelled:
            sent.append(df.count())
        return plain(df, percent, labelled, batches)

    monkeypatch.setattr(jaccard, "searched", counted)
    for n in (240, 480):
        rows = [(k, " ".join([*template[k % 7 :], *[f"own{k}x{i}" for i in range(18)]])) for k in range(n)]
        # some links across blocks: texts that lack a few of another one's words
        rows += [(10_000 + k, " ".join(rows[k][1].split(" ")[: -1 - k % 3])) for k in range(0, n, 40)]
        got = {r.doc_id: r.component_id for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == groups(shingle_sets(rows, 3), 90)
    # in full it would be every page times every block
    assert sent[1] <= 2.5 * sent[0] + 50 and sent[1] <= 4 * 480, sent


def test_jaccard_edges(spark, docs):
    assert jaccard.joined(docs.where("doc_id = 99999999")).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (2, "x y z x y z"), (3, None), (4, None), (4, "k l m n o p")], "doc_id long, text string").withColumn("rep", F.lit("c"))
    got = collections.Counter((r.doc_id, r.component_id) for r in jaccard.joined(rows).collect())
    assert got == {(1, 1): 2, (None, 1): 1, (None, None): 1, (2, 2): 1, (3, 3): 1, (4, 4): 2}
    kept = jaccard.representatives(rows, 80, 5)
    assert kept.columns == rows.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "a b c d e f"), (None, "q r s t u v"), (2, "x y z x y z"), (3, None), (4, None), (4, "k l m n o p")], key=str)


def test_group_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(80, int(rng.integers(1, 70)))).astype(np.uint64) for _ in range(60)]
    group = jaccard.Group(sets)
    for i in range(60):
        assert group.overlaps(i).tolist() == [len(np.intersect1d(sets[i], x)) for x in sets]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, k) for k in range(2001, 2100)]
    found = Sets({x for e in edges for x in e if e[0] != e[1]})
    for a, b in edges:
        if a != b:
            found.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: found.root(i) for i in found.up}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def distance(a, b):
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def normal(line):
    return " ".join("".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in line.lower()).split())


def similar(a, b):
    longest = max(len(a), len(b))
    return distance(a, b) <= int((1 - lines.SIMILAR) * longest + 1e-9)


def of_lines(spark, docs):
    """What the search found: node numbers by line, and the links between them."""
    source = docs.select(F.col("doc_id").alias("id"), "text")
    table = lines.written(lines.line_table(source), "lines")
    found = {(r.u, r.v) for r in lines.links(table, source).collect()}
    plain = sorted({x for r in docs.collect() for x in (r.text or "").split("\n") if x.strip(" \t\r\f\v")})
    rows = spark.createDataFrame([(x,) for x in plain] or [("",)], "line string").selectExpr("line", f"xxhash64(btrim(lower(line), {lines.BLANKS})) AS node").collect()
    return {r.line: r.node for r in rows}, found


def removed_by_hand(spark, docs):
    """All but the first of each group of equal or linked lines."""
    nodes, found = of_lines(spark, docs)
    name = {v: k for k, v in nodes.items()}
    for u, v in found:
        assert similar(normal(name[u]), normal(name[v]))
    sets = Sets(nodes.values())
    for u, v in found:
        sets.join(u, v)
    last, where = 2**63, collections.defaultdict(set)
    for r in docs.collect():
        for k, line in enumerate((r.text or "").split("\n")):
            if line.strip(" \t\r\f\v"):
                where[sets.root(nodes[line])].add((last if r.doc_id is None else r.doc_id, k))
    out = collections.defaultdict(set)
    for places in where.values():
        for i, k in sorted(places)[1:]:
            out[None if i == last else i].add(k)
    return out


BASE = "the quick brown fox jumps over the lazy dog while seven wizards boldly make toxic brew for the evil queen and jack in the quiet village nearby"


def test_lines(spark):
    rows = [(-9, None), (-8, ""), (-7, "\n\n"), (1, BASE + "\nshort\nAll rights reserved 2020"), (2, BASE.upper() + "!! 7\nshort\nALL RIGHTS, reserved 2021"), (3, BASE.replace("jack", "jacky")), (3, BASE.replace("jack", "jacky")), (None, "x\n" + BASE), (4, BASE + "\n" + BASE)]
    rows += [(100 + k, x + "\n" + y) for k, (x, y) in enumerate(zip(variants(7, 12, 90), variants(8, 12, 40), strict=True))] + [(200, "letters " * 3000), (201, "Letters, " * 3000), (2**63 - 1, "short")]
    rows += [(300 + k, f"The rate in {1990 + k} was {k * 7}.{k}, and it fell in all of the other countries") for k in range(0, 40, 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__key", F.lit(7)).withColumn("out", F.lit("x")).withColumn("key", F.lit("k"))
    expected = removed_by_hand(spark, docs)
    for r in lines.report(docs).collect():
        assert r.removed == ",".join(map(str, sorted(expected[r.doc_id]))), r
        assert r.n_removed == len(expected[r.doc_id])
    kept = lines.deduplicated(docs, drop_emptied=True)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[-9] is None and texts[-8] == "" and texts[1] == BASE + "\nshort\nAll rights reserved 2020" and texts[2] == "ALL RIGHTS, reserved 2021" and 3 not in texts and texts[None] == "x" and 201 not in texts
    assert {(r["__key"], r.out, r.key) for r in kept.collect()} == {(7, "x", "k")}
    assert texts[300] and 2**63 - 1 not in texts
    assert lines.report(docs.where("doc_id = 12345")).count() == 0


def test_simhashes_are_made_within_the_row(spark):
    """No exchange for the votes; the bits are those that most words of a block vote for, in short lines and in very long ones."""
    rng = np.random.default_rng(11)
    texts = ["\n".join(" ".join(f"w{k:06d}z" for k in rng.integers(0, 900, n)) for n in (3, 4, 17, 60, 511, 512, 2500)), "one two three four\n\n yes", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = lines.line_table(docs)
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.line_no): r for r in table.collect()}
    assert {k for k in got} == {(0, n) for n in range(7)} | {(1, 0), (1, 2)}
    words = [(i, n, w, 2 * k // len(found)) for i, t in enumerate(texts) for n, line in enumerate((t or "").split("\n")) for found in [re.findall("[a-z0-9]{4,}", line)] if len(found) >= lines.WORDS for k, w in enumerate(found)]
    hashed = spark.createDataFrame(words, "id long, line_no int, w string, half long").selectExpr("id", "line_no", "xxhash64(w, half) AS h").collect()
    by_line = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in hashed:
        by_line[r.id, r.line_no][r.h % 2**64 >> 61].append(r.h % 2**64)
    for at, r in got.items():
        found, expected = by_line.get(at, {}), [0] * lines.PAIRS
        for j, votes in found.items():
            # the lowest bit counts votes and is none
            bits = sum(1 << 9 * k + i for k in range(7) for i in range(4) if (k, i) != (0, 0) and 2 * sum(v >> 9 * k + i & 1 for v in votes) > len(votes))
            expected[j // 2] |= sum((bits >> 9 * k + i & 1) << 9 * k + (8 if j % 2 == 0 else 4) - i for k in range(7) for i in range(4))
        assert [r[f"p{s}"] % 2**64 for s in range(lines.PAIRS)] == expected, at
        assert [r.flags >> j & 1 for j in range(lines.GROUPS)] == [int(len(found.get(j, [])) >= (lines.FILLED if len(found) and sum(map(len, found.values())) <= lines.MOST else 1)) for j in range(lines.GROUPS)]


def test_roots_of_lines_are_those_of_all_links(spark):
    """Components of the first links are tied by later ones as if all were searched together."""
    rng = np.random.default_rng(12)
    base = [" ".join(f"{''.join(rng.choice(list('abcdefgh'), 7))}" for _ in range(40)) for _ in range(4)]
    texts = [" ".join(w if k not in (n % 40, (n * 7) % 40) else f"{w}{n}" for k, w in enumerate(b.split())) for b in base for n in range(8)]
    source = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = lines.written(lines.line_table(source), "lines")
    got = {(r.node, r.root) for r in lines.linked(table, source).collect()}
    assert got == {(r.node, r.root) for r in components(lines.links(table, source)).collect()} and len(got) > 8


def test_components_with_nothing_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(13)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))], "u long, v long")
    few = {(r.node, r.root) for r in components(edges).collect()}
    monkeypatch.setattr("foliant.llm.components.BROADCAST_ROWS", 0)
    assert {(r.node, r.root) for r in components(edges).collect()} == few and few


def test_line_recall(spark):
    """Of all pairs of lines with enough edit similarity, however they differ in their SimHashes, nine in ten are found at least."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    nodes, found = of_lines(spark, docs)
    sets = Sets(nodes.values())
    for u, v in found:
        sets.join(u, v)
    words, by_pair = {}, collections.defaultdict(set)
    for line, node in nodes.items():
        w = normal(line).split()
        words[node] = " ".join(w)
        for a, b in zip(w, w[1:]):
            by_pair[a, b].add(node)
    shared = collections.Counter((a, b) for held in by_pair.values() if len(held) < 400 for a in held for b in held if a < b)
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.3 * len(set(words[a].split())) and min(len(words[a]), len(words[b])) >= lines.SIMILAR * max(len(words[a]), len(words[b]))]
    con = duckdb.connect()
    held = pd.DataFrame([(a, b, words[a], words[b]) for a, b in pairs], columns=["a", "b", "x", "y"])  # noqa: F841
    true = con.execute(f"SELECT a, b FROM held WHERE levenshtein(x, y) <= floor({1 - lines.SIMILAR:.6f} * greatest(length(x), length(y)))").fetchall()
    assert len(true) > 200
    assert sum(sets.root(a) == sets.root(b) for a, b in true) >= 0.9 * len(true)


def test_brief_lines(spark):
    """Lines of few words, or in a script without blanks, link as all pairs of them do that are similar and have the same numbers; those with more words that lost or won one by an edit are among them."""
    rng = np.random.default_rng(14)
    texts = ["read it now", "read it, now!", "Read it nnow", "chapter twelve a", "chaptr twelve a", "chapter 12 of it", "chapter 13 of it", "chapter 12 of itt", "---", "***", "ab", "ac", "a.b", "one hundred lines here", "one hundred linesh ere", "item 1000", "item 100", "item 1", "fff done", "done"]
    han = "".join(map(chr, rng.integers(0x4E00, 0x4E00 + 3000, 1040)))
    for n in (9, 10, 30, 49, 99, 100, 101, 200, 520, 521, 1040):
        for k in range(3):
            chars = list(han[:n])
            for at in rng.choice(n, n // (10 + 5 * k), replace=False):  # as many edits as may be, and fewer
                chars[at] = ("", chars[at] + "又", "又")[int(rng.integers(0, 3))]
            texts += [han[:n], "".join(chars)]
    for n in (5, 12, 25, 45, 70, 94, 105):
        for _ in range(6):
            base = "".join(rng.choice(list("ab c"), n)).strip()
            chars = list(base)
            for at in rng.choice(len(chars), max(1, len(chars) // 10), replace=False):
                chars[at] = ("", chars[at] + "b", " ", "\U00020000")[int(rng.integers(0, 4))]
            texts += [base, "".join(chars)]
    # four words whose votes are scattered have no key
    texts += [x for _ in range(30) for w in ["".join(rng.choice(list("abcdefgh"), 28)) for _ in range(1)] for a in [f"{w[:7]} {w[7:14]} {w[14:21]} {w[21:]}"] for x in (a, a[:-1], a + "a")]
    texts = sorted({x for x in texts if x.strip()})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes, found = of_lines(spark, docs)
    name = {v: k for k, v in nodes.items()}
    table = lines.line_table(docs.selectExpr("doc_id AS id", "text"))
    keyed = {r.node for r in lines.with_keys(table, "node").collect()}
    assert any(node not in keyed and len(re.findall("[a-z]{4,}", name[node])) == lines.WORDS for node in name)
    true = set()
    for (a, u), (b, v) in itertools.combinations(sorted(nodes.items()), 2):
        x, y = normal(a), normal(b)
        if x and y and not {u, v} <= keyed and abs(len(x) - len(y)) <= (1 - lines.SIMILAR) * max(len(x), len(y)) + 1e-9 and similar(x, y) and re.findall(r"\d+", x) == re.findall(r"\d+", y):
            true.add((min(u, v), max(u, v)))
    assert {p for p in found if not set(p) <= keyed} == true and len(true) > 60
    named = {frozenset((name[u], name[v])) for u, v in true}
    assert {frozenset(("read it now", "read it, now!")), frozenset(("chapter 12 of it", "chapter 12 of itt")), frozenset(("one hundred lines here", "one hundred linesh ere"))} <= named
    assert not named & {frozenset(("chapter 12 of it", "chapter 13 of it")), frozenset(("---", "***")), frozenset(("ab", "ac"))}
    assert len({nodes[x] for x in ("item 1000", "item 100", "item 1", "fff done", "done")}) == 5


def test_cells_of_brief_lines(spark, monkeypatch):
    """However few nodes a cell has, all pairs of a key meet."""
    texts = [f"read {x}{y} it now" for x in "abcdefghij" for y in "abcdefghij"]
    source = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = lines.written(lines.line_table(source), "lines")
    words = table.select("id", "node").join(source, "id").selectExpr("node", "text AS normal")
    nodes = lines.brief_nodes(table)
    pairs = {(r.u, r.v) for r in lines.brief_pairs(nodes, words).collect()}
    monkeypatch.setattr(lines, "PART", 7)
    monkeypatch.setattr("foliant.llm.common.BROADCAST_ROWS", 0)
    assert {(r.u, r.v) for r in lines.brief_pairs(nodes, words).collect()} == pairs and len(pairs) >= 900


def test_lines_of_the_same_words_in_other_orders(spark):
    """Two thousand orders of the same words share words, but hardly any keys, so that far from all pairs are candidates."""
    rng = np.random.default_rng(4)
    words = BASE.split()
    rows = [(k, " ".join(rng.permutation(words).tolist())) for k in range(2000)]
    source = spark.createDataFrame(rows, "id long, text string")
    table = lines.written(lines.line_table(source), "lines")
    buckets = lines.buckets(table)
    met = buckets.groupBy("key").count().selectExpr("sum(count * (count - 1) / 2) AS n").first()["n"]
    assert met < 2000 * 1999 / 2 / 4
    assert lines.links(table, source).count() == 0


def templates(rng, n):
    """Lines of 34 equal words with one long unlike word inside; no two are similar."""
    words = [f"{w}{'abcdefghij'[k % 10]}" for k, w in enumerate((BASE + " and later " + BASE).split()[:34])]
    return [" ".join([*words[:17], "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 36)), *words[17:]]) for _ in range(n)]


def named(spark, texts):
    """What `meetings` works on if the first links tie nothing, and the lines' words."""
    source = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = lines.written(lines.line_table(source), "lines")
    words = table.select("id", "node").join(source, "id").selectExpr("node", f"array_join({lines.ALL_WORDS.replace('line', 'text')}, ' ') AS normal")
    return table, source, lines.buckets(table).select("key", *lines.NODE, F.col("node").alias("label")), words.dropDuplicates(["node"])


def test_lines_of_one_template(spark):
    """A template with unlike words put in isn't paired in full, however many lines it has; lines that share what was put in still meet."""
    rng = np.random.default_rng(8)
    for n in (250, 1000):
        table, source, rows, words = named(spark, templates(rng, n))
        assert rows.groupBy("key").count().agg(F.max("count")).first()[0] > n / 2
        assert lines.meetings(rows, words).count() <= 10 * n
        assert lines.links(table, source).count() == 0
    once = templates(rng, 300)
    again = [x.replace(w, f"{w[:20]}q{w[20:]}") for x in once[:100] for w in [max(x.split(), key=len)]]
    other = [x.replace(w, f"{w} of") for x in once[100:200] for w in [max(x.split(), key=len)]]
    table, source, rows, words = named(spark, once + again + other)
    sets = Sets(r.node for r in table.collect())
    for r in lines.links(table, source).collect():
        sets.join(r.u, r.v)
    node = {r.id: r.node for r in table.collect()}
    assert sum(sets.root(node[k]) == sets.root(node[300 + k]) for k in range(200)) >= 196
    assert len({sets.root(node[k]) for k in range(300)}) == 300


def test_no_link_of_a_large_bucket_is_left_out(spark):
    """Lines of one template, and copies whose put in word begins and ends otherwise, so that no word and no end of one is theirs alone: all pairs that share a key, by SQL."""
    rng = np.random.default_rng(9)
    once = templates(rng, 150)
    again = [x.replace(w, f"qq{w[2:17]}xx{w[19:-2]}zz") for x in once for w in [max(x.split(), key=len)]]
    table, source, rows, words = named(spark, once + again)
    held, text = rows.toPandas(), words.toPandas()  # noqa: F841
    assert held.groupby("key").size().max() > 200
    bits = " + ".join(f"bit_count(xor(a.p{s}, b.p{s}))" for s in range(lines.PAIRS))
    pairs = f"SELECT DISTINCT a.node AS u, b.node AS v FROM held a JOIN held b ON a.key = b.key AND a.node < b.node WHERE {bits} <= {lines.DIFFER}"
    close = f"levenshtein(x.normal, y.normal) <= floor({1 - lines.SIMILAR:.6f} * greatest(length(x.normal), length(y.normal)))"
    true = set(duckdb.connect().execute(f"SELECT u, v FROM ({pairs}) JOIN text x ON x.node = u JOIN text y ON y.node = v WHERE {close}").fetchall())
    assert len(true) >= 140
    sets = Sets(r.node for r in table.collect())
    for r in lines.links(table, source).collect():
        sets.join(r.u, r.v)
    assert all(sets.root(u) == sets.root(v) for u, v in true)
    found = [(r.u, r.v) for r in lines.meetings(rows, words).collect()]
    assert len(found) == len(set(found)) and set(found) == true


def test_pipeline_drops_lines_of_a_large_bucket(spark):
    """The pipeline's line stage drops the later of two lines that only their edit distance ties, among 300 of one template."""
    rng = np.random.default_rng(9)
    once = templates(rng, 150)
    again = [x.replace(w, f"qq{w[2:17]}xx{w[19:-2]}zz") for x in once for w in [max(x.split(), key=len)]]
    docs = spark.createDataFrame(list(enumerate(once + again)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert len(kept) >= 100 and sum(k >= 150 for k in kept) <= 10


def far_apart(rng, n):
    """Pairs of lines of 64 words of 11 letters; the second one has another letter in each of them."""
    out = []
    for _ in range(n):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 11)) for _ in range(64)]
        out.append((words, [f"{w[:5]}{'q' if w[5] != 'q' else 'z'}{w[6:]}" for w in words]))
    return out


def test_links_of_far_simhashes(spark):
    """Lines that share a key and are similar are linked however many bits their SimHashes differ in, in small buckets, in a large one and in the pipeline."""
    rng = np.random.default_rng(12)
    made = far_apart(rng, 12)
    hashes = spark.createDataFrame([(w, k) for x, _ in made for k, w in enumerate(x)], "w string, k int").selectExpr("w", "shiftrightunsigned(xxhash64(w, 2 * k div 64), 61) AS block").collect()
    block = {r.w: r.block for r in hashes}
    texts = []
    for x, y in made:
        held = collections.Counter(block[w] for w in x).most_common(1)[0][0]
        # the block of most words stays as it is: none of its words goes, and none comes
        new = spark.createDataFrame([(w, k) for k, w in enumerate(y)], "w string, k int").selectExpr("w", "shiftrightunsigned(xxhash64(w, 2 * k div 64), 61) AS block").collect()
        block |= {r.w: r.block for r in new}
        z = [a if block[a] == held or block[b] == held else b for a, b in zip(x, y, strict=True)]
        texts += [" ".join(x), " ".join(z)]
    source = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = lines.written(lines.line_table(source), "lines")
    at = {r.id: r for r in table.collect()}
    held = collections.defaultdict(set)
    for r in lines.buckets(table).select("key", "node").collect():
        held[r.key].add(r.node)
    far = [k for k in range(0, len(texts), 2) if any({at[k].node, at[k + 1].node} <= x for x in held.values()) and sum(bin((at[k][f"p{s}"] ^ at[k + 1][f"p{s}"]) & (2**64 - 1)).count("1") for s in range(lines.PAIRS)) > lines.DIFFER]
    assert len(far) >= 8 and all(similar(texts[k], texts[k + 1]) for k in far)
    found = {(r.u, r.v) for r in lines.links(table, source).collect()}
    assert all(tuple(sorted((at[k].node, at[k + 1].node))) in found for k in far)
    # the same in one large bucket
    rows = table.selectExpr("7L AS key", *lines.NODE, "node AS label")
    words = table.select("id", "node").join(source, "id").selectExpr("node", "text AS normal")
    got = {(r.u, r.v) for r in lines.meetings(rows, words).collect()}
    assert got == {tuple(sorted((at[k].node, at[k + 1].node))) for k in range(0, len(texts), 2) if similar(texts[k], texts[k + 1])}
    kept = {r.doc_id for r in corpus_pipeline.drop_repeated_lines(spark, source.withColumnRenamed("id", "doc_id"), "").collect()}
    assert kept.isdisjoint(k + 1 for k in far) and kept.issuperset(range(0, len(texts), 2))


def test_bounds_of_the_edit_distance_lose_nothing(spark):
    """Pairs about as far apart as links may be, with differences in one place or spread, against a plain distance."""
    rng = np.random.default_rng(5)
    letters, pairs = list("abcde fghi é"), []
    for k in range(300):
        a = " ".join("".join(rng.choice(letters, rng.integers(20, 120))).split())
        b = list(a)
        for _ in range(rng.integers(0, max(2, len(a) // 3))):
            at = int(rng.integers(0, len(b)) if k % 2 else min(len(b) - 1, len(a) // 3))
            b[at : at + int(rng.integers(0, 2))] = rng.choice(letters, rng.integers(0, 2)).tolist()
        pairs.append((k, -k - 1, a, " ".join("".join(b).split())))
    both = spark.createDataFrame(pairs, "u long, v long, x string, y string")
    expected = {(u, v) for u, v, x, y in pairs if similar(x, y)}
    assert 50 < len(expected) < 260
    assert {(r.u, r.v) for r in lines.alike(both).collect()} == expected
    nodes = [(i, t, [1]) for u, v, x, y in pairs for i, t in ((u, x), (v, y))]
    rows = spark.createDataFrame([(1, i, len(t), 0, 0, 0, 0, i) for i, t, _ in nodes], f"key long, {', '.join(f'{c} long' for c in lines.NODE)}, label long")
    words = spark.createDataFrame([(i, t) for i, t, _ in nodes], "node long, normal string")
    got = {(r.u, r.v) for r in lines.meetings(rows, words).collect()}
    assert {(min(p), max(p)) for p in expected} <= got


def test_lines_with_a_hub(spark):
    """A node with very many pairs is dealt to several tasks; its links are all there."""
    base = BASE + " " + BASE
    pairs = spark.createDataFrame([(0, k) for k in range(1, 5001)] + [(k, 5001) for k in range(1, 3001)], "u long, v long")
    words = spark.createDataFrame([(0, base)] + [(k, f"{base} {k % 7}") for k in range(1, 5001)] + [(5001, BASE)], "node long, normal string")
    assert {r.node: r.parts for r in lines.dealt(pairs).collect()} == {0: 3, 5001: 2}
    assert sorted((r.u, r.v) for r in lines.verified(pairs, words, 8).collect()) == [(0, k) for k in range(1, 5001)]


def test_flow_moves_the_least():
    flow = resharding.min_cost_flow([10, 0, 50], [20, 20, 20], [[int(i != j) for j in range(3)] for i in range(3)])
    assert flow == [[10, 0, 0], [0, 0, 0], [10, 20, 20]]
    # a detour that needs a residual edge
    assert resharding.min_cost_flow([1, 1], [1, 1], [[1, 2], [1, 9]]) == [[0, 1], [1, 0]]


def test_flow_against_all_ways():
    """Small cases, by trying every way to send whole units."""
    rng = np.random.default_rng(6)
    for _ in range(30):
        supply = rng.integers(0, 4, 3).tolist()
        capacity = rng.integers(0, 4, 2).tolist()
        capacity[0] += max(0, sum(supply) - sum(capacity))
        cost = rng.integers(0, 5, (3, 2)).tolist()
        best = min(
            sum((s - x) * c[1] + x * c[0] for s, x, c in zip(supply, xs, cost, strict=True))
            for xs in itertools.product(*[range(s + 1) for s in supply])
            if sum(xs) <= capacity[0] and sum(supply) - sum(xs) <= capacity[1]
        )
        flow = resharding.min_cost_flow(supply, capacity, cost)
        assert [sum(f) for f in flow] == supply
        assert sum(f * c for fs, cs in zip(flow, cost, strict=True) for f, c in zip(fs, cs, strict=True)) == best


def test_resharding(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(spark.createDataFrame([(5000, None, None), (5001, "", "a"), (5001, "", "a"), (None, "é", "b")], "doc_id long, text string, source string")).withColumn("shard", F.lit("x"))
    old = F.when(F.col("source") == "src0", 9).otherwise(F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(8)))
    placed = resharding.resharded(resharding.sized(docs, old), 8).collect()
    assert len(placed) == docs.count()
    assert sorted((str(r.doc_id), r.size) for r in placed) == sorted((str(r.doc_id), len((r.text or "").encode()) + 1) for r in docs.collect())
    bytes_, slots, before = collections.Counter(), collections.defaultdict(list), collections.Counter()
    for r in placed:
        bytes_[r.shard] += r.size
        before[r.old_shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(bytes_.values()) / 8
    assert set(bytes_) == set(range(8)) and all(abs(b - mean) <= 0.02 * mean for b in bytes_.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.size for r in placed if r.shard != r.old_shard)
    least = sum(b if s > 7 else max(0, b - mean) for s, b in before.items())
    assert moved <= 1.1 * least + 0.02 * mean * 8
    assert resharding.resharded(resharding.sized(docs.where("doc_id = -1"), F.lit(0)), 8).count() == 0


def test_rewrite_touches_only_affected_shards(spark, tmp_path):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('x', cast(id % 7 AS int)) AS text")
    placed = resharding.resharded(resharding.sized(docs, F.when(F.col("doc_id") < 200, 0).otherwise(1)), 3)
    written = resharding.rewrite(docs, placed, str(tmp_path / "out"))
    assert written == [0, 1, 2]
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
    still = resharding.resharded(resharding.sized(docs, F.lit(0)), 1)
    assert resharding.rewrite(docs, still, str(tmp_path / "none")) == []


def test_rewrite_writes_every_row_once(spark, tmp_path):
    """Repeated and null ids, in different old shards, one of which is given up."""
    docs = spark.range(600).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id", "repeat('x', cast(id % 5 AS int)) AS text", "id AS mark")
    placed = resharding.resharded(resharding.sized(docs, F.when(F.col("mark") < 300, 0).otherwise(5)), 3)
    folder = str(tmp_path / "out")
    assert resharding.rewrite(docs, placed, folder) == [0, 1, 2, 5]
    files = spark.read.schema("doc_id long, text string, mark long, shard int").parquet(folder)
    key = ["doc_id", "text", "mark"]
    assert collections.Counter(map(tuple, files.select(key).collect())) == collections.Counter(map(tuple, docs.select(key).collect()))
    assert files.where("shard = 5").count() == 0
    out = resharding.moved(placed)
    names = ["doc_id", "size", "text_crc32", "old_shard", "shard"]
    assert collections.Counter(map(tuple, out.select(names).collect())) == collections.Counter(map(tuple, placed.select(names).collect()))
    assert any("/shards-" in f for f in out.inputFiles())


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder).cache()
        if name != "packing":
            assert docs.columns == names
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "line_dedup":
            gone = removed_by_hand(spark, before)
            texts = {r.doc_id: r.text for r in docs.collect()}
            for r in before.collect():
                left = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[r.doc_id])
                assert texts.get(r.doc_id) == (left if left.strip() or not gone[r.doc_id] else None)
        if name == "ngram_jaccard":
            expected = groups(shingle_sets([(r.doc_id, r.text) for r in before.collect()], 5), 80)
            assert {r.doc_id for r in docs.collect()} == {i for i, root in expected.items() if i == root}
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_moved_rows_with_clashing_columns(spark):
    """Columns named like those that placement adds stay apart from them, whatever their case."""
    docs = spark.createDataFrame([(i, "x" * (i % 40)) for i in range(300)] + [(7, None), (None, "y")], "doc_id long, text string")
    for name in ("slot", "old_shard", "shard", "size", "text_crc32", "SHARD", "law"):
        table = docs.withColumn(name, F.lit("clash"))
        placed = resharding.resharded(resharding.sized(table, F.lit(0)), 4)
        out = resharding.moved(placed)
        assert out.columns == ["doc_id", "size", "text_crc32", "old_shard", "shard", "slot"]
        rows = out.collect()
        assert len(rows) == 302 and {r.old_shard for r in rows} == {0} and {r.shard for r in rows} == {0, 1, 2, 3}
        for shard in range(4):
            assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_sample_of_repeated_ids(spark):
    """Which of unlike texts with one id is learned from doesn't hang on how rows are dealt."""
    from foliant.llm import toxicity

    docs = spark.createDataFrame([(i % 20, f"text {i}") for i in range(200)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1)], "doc_id long, toxic int")
    drawn = [sorted((r.doc_id, r.text or "", r.toxic) for r in toxicity.sample(docs.repartition(n, F.rand(n)), labels).collect()) for n in (1, 3, 7)]
    assert drawn[0] == drawn[1] == drawn[2] and len({r[0] for r in drawn[0]}) == len(drawn[0]) > 5
