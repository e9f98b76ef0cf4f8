"""Operators that take each document by itself, against plain versions, with nulls, blanks, long texts, repeats and empty tables."""

import collections
import gc
import hashlib
import json
import math
import random
import re
import time
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import byte_bpe, common, packing, pii, quality, toxicity, transport, unigram

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", "\n \t\n", "One two, three. It's we'll I'd.", "a  b\n\n c \n d e　f \x1c", "日本語 テキスト 😀😀 👨‍👩‍👧 é́ İ. ΑΣ.", "<|endoftext|> x", "z" * 5000, "word, word. " * 3000,
    "same words here again and same words here again\nsame words here again\n\nsame words here again", "# $ % & | < > *" * 20, "One two, three. It's we'll I'd.",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(4, TEXTS[4]), (None, "no id")]
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    # columns whose names clash with what the operators make
    return spark.createDataFrame(rows, "doc_id long, text string").unionByName(real).withColumn("score", F.lit(1)).withColumn("words", F.lit("x")).withColumn("node", F.lit(2)).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def nothing(docs):
    return docs.where("doc_id = -12345")


def test_byte_bpe(docs, rows):
    got = by_id(byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.vocabulary(RANKS, public_tokenizers.PATTERN)[0].ranks, special_tokens={})
    for i, text in rows:
        ids = plain.encode_ordinary(text)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), text[:80]
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encode(docs.where("doc_id = 4"), RANKS, public_tokenizers.PATTERN).first().ids == plain.encode_ordinary(TEXTS[4])
    assert byte_bpe.round_trip(nothing(docs), RANKS, public_tokenizers.PATTERN).count() == 0


def test_very_long_words(monkeypatch):
    """Rows on their own come to what matrices do, and a long one is no quadratic matter."""
    bpe = byte_bpe.vocabulary(RANKS, public_tokenizers.PATTERN)[0]
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(11)
    kinds = ["ab", "a", "abcdefghijklmnopqrstuvwxyz", "etaoinshr", "é日本ßa語", ["the", "ing", "tion", "aa", "a", "x"]]
    words = ["".join(rng.choices(rng.choice(kinds), k=rng.randint(9, 90))).encode() for _ in range(800)]
    wide = bpe.encode_words(words)
    monkeypatch.setattr(byte_bpe, "LONG", 8)
    assert bpe.encode_words(words) == wide
    for letters in kinds:
        text = "".join(rng.choices(letters, k=150_000))
        began = time.monotonic()
        ids = np.frombuffer(byte_bpe.encode_texts([text], RANKS, public_tokenizers.PATTERN)[0][0], np.int32)
        assert time.monotonic() - began < 20
        assert ids.tolist() == plain.encode_ordinary(text)


def test_unigram(docs, rows):
    pieces, cut, _, _ = unigram.model(RANKS, public_tokenizers.PATTERN)
    words = sorted({w.encode() for _, t in rows for w in cut.findall(t) if len(w.encode()) <= 11})[:300]
    for w, n in zip(words, pieces.count(words), strict=True):
        best = max(s for s, _ in unigram.brute_force(w, pieces.scores))
        assert n in {k for s, k in unigram.brute_force(w, pieces.scores) if best - s < 1e-4}, w
        assert n == pieces._along(w)
    got = by_id(unigram.counted(docs, RANKS, public_tokenizers.PATTERN))
    for i, text in rows:
        found = cut.findall(text)
        assert (got[i].n_tokens, got[i].n_pretokens) == (sum(pieces.count([w.encode() for w in found])), len(found)), text[:80]
    assert unigram.counted(nothing(docs), RANKS, public_tokenizers.PATTERN).count() == 0


def test_packing(docs, rows):
    capacity = 256
    tok = Tokenizer.from_file(WORDS)
    got = packing.pack(packing.pieces(docs, WORDS, capacity), capacity, block=60).collect()
    expected = collections.Counter()
    total = 0
    for i, text in rows:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        total += len(ids)
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4")
            expected[i, k // capacity, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by_sequence) <= 1.03 * -(-total // capacity) + 2
    assert packing.pack(packing.pieces(nothing(docs), WORDS, capacity), capacity).count() == 0


def test_words_are_looked_up_once(monkeypatch):
    """A slice's distinct words go to the cache, not all of its words; words with the separator of words in them come out as alone."""
    texts = ["", " ", "|", "a | b|c || |", "Ünïcode, naïve. x. y, 1.5, (z). e\u0301. \u0301a <|endoftext|>|", "the | the\nthe. the, " * 50, "\u03a3\u03c2. \u0130 \u4e2d\u6587,"]
    tok, cache, cores = packing.tokenizer(WORDS)
    asked = []

    class Spy:
        def resolve(self, lists, make):
            asked.extend(w for x in lists for w in x)
            return cache.resolve(lists, make)

    monkeypatch.setattr(packing, "tokenizer", lambda path: (tok, Spy(), cores))
    got = packing.token_ids(texts, WORDS)
    assert got == [np.array(tok.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert len(asked) == len(set(asked))
    assert packing.token_ids([""], WORDS) == [b""] and packing.token_ids([], WORDS) == []


def test_words_are_looked_up_without_their_stops(monkeypatch):
    """One look-up for a word with and without a full stop or comma behind it, where that is a match of its own."""
    tok, cache, plain = packing.tokenizer(WORDS)
    asked = []

    class Spy:
        def resolve(self, lists, make):
            asked.extend(w for x in lists for w in x)
            return cache.resolve(lists, make)

    monkeypatch.setattr(packing, "tokenizer", lambda path: (tok, Spy(), plain))
    text = "the. the, the naïve. naïve 1.5. 1.5 é, \u0301. . ,, ß\n\u4e2d. ÷ x÷y ﬁn"
    assert packing.token_ids([text], WORDS) == [np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert sorted(asked) == sorted(["the", "naïve", "1.5", "é", "\u0301.", ".", ",,", "ß", "\u4e2d.", "÷", "x÷y", "ﬁn"])


def test_plain_words_by_the_plain_tokenizer():
    """Words of Latin-1 letters come out of the tokenizer without normaliser and pattern as out of the whole one."""
    tok, _, plain = packing.tokenizer(WORDS)
    rng = np.random.default_rng(3)
    letters = [c for c in map(chr, range(256)) if packing.PLAIN(c)]
    for word in [*letters, *("".join(rng.choice(letters, n)) for n in rng.integers(2, 30, 500))]:
        assert plain.encode(word, add_special_tokens=False).ids == tok.encode(word, add_special_tokens=False).ids, word


def test_held_words_take_little_memory():
    """Words that a worker holds don't take a Python object each; what they come to stays right past the bound and where hashes meet."""
    packing.tokenizer.cache_clear()
    held = packing.tokenizer(WORDS)[1]
    packing.tokenizer.cache_clear()

    def make(words: list[str]) -> list[bytes]:
        return [w.encode() * 2 for w in words]

    gc.collect()
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    for k in range(0, 300_000, 30_000):
        words = [f"word{i}" for i in range(k, k + 30_000)]
        assert held.resolve([words], make) == [make(words)]
    del words
    taken = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert len(held) == 300_000 and taken < 25_000_000
    asked: list[str] = []
    assert held.resolve([["word7", "new", "word299999", "new"], ["", "word7"]], lambda w: asked.extend(w) or make(w)) == [make(["word7", "new", "word299999", "new"]), make(["", "word7"])]
    assert sorted(asked) == ["", "new"]
    few = packing.Held(3)
    few.hashes, few.at, few.words, few.ids = np.array([hash("a")]), np.array([0]), pa.array(["b"], pa.large_string()), pa.array([b"-"], pa.large_binary())
    assert few.resolve([["a"]], make) == [[b"aa"]]
    for words in (["a", "c", "d"], ["e"], ["a", "b", "c", "d", "e"], ["f" * 97], []):
        assert few.resolve([words], make) == [make(words)] and len(few) <= 3


def test_evolution_ends_with_a_grouping_at_the_bound(monkeypatch):
    """Where best fit has as few bins as there can be, no other groupings are made; where it hasn't, they still are."""
    calls, plain = [], packing.refit
    monkeypatch.setattr(packing, "refit", lambda *x: calls.append(1) or plain(*x))
    assert len(packing.evolve([50, 50, 30, 70, 100, 20], 100, 1, [], 5)) == 4 and len(calls) == 2
    calls.clear()
    packing.evolve([51] * 6, 100, 1, [], 5)
    assert len(calls) > 6


def test_batches_for_python_are_bounded(spark):
    """Pieces are tokenized from batches of a few rows, and the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with common.batches_of(spark, 7):
        found = spark.range(0, 40, 1, 2).mapInArrow(lambda x: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"]) for b in x), "n long").collect()
    assert max(r.n for r in found) == 7 and sum(r.n for r in found) == 40 and spark.conf.get(name) == before


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 100, 200).tolist()
    a, b = packing.refit([], list(range(200)), size, 100), packing.refit([], list(rng.permutation(200)), size, 100)
    for child in (packing.cross(a, b, size, 100, rng), packing.mutate(a, size, 100, rng)):
        assert sorted(i for x in child for i in x) == list(range(200))
        assert all(sum(size[i] for i in x) <= 100 for x in child)


def test_search_gains_bins():
    """Where sizes in thirds of a bin leave best fit above the bound, crossover and migrants take bins away."""
    first, last = 0, 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        size = [x for a, b in rng.integers(25, 45, (60, 2)).tolist() for x in (a, b, 100 - a - b)]
        plain = packing.refit([], list(range(len(size))), size, 100)
        elites = [packing.evolve(size, 100, k * 100 + seed, [], 30) for k in (1, 2)]
        best = packing.evolve(size, 100, 7 + seed, elites, 30)
        assert sorted(i for b in best for i in b) == list(range(len(size)))
        assert len(best) <= min(map(len, elites)) <= len(plain)
        first, last = first + len(plain), last + len(best)
    assert last < first


def plain_reader(media):
    """Another parser: packet by packet, by the standard's field positions."""
    packets = [media[k : k + 188] for k in range(0, len(media), 188)]
    assert all(p[0] == 0x47 and len(p) == 188 for p in packets)

    def body(p):
        return p[4 + (1 + p[4] if p[3] & 0x20 else 0) :] if p[3] & 0x10 else b""

    def pid(p):
        return int.from_bytes(p[1:3], "big") & 0x1FFF

    table = next(body(p) for p in packets if pid(p) == 0 and p[1] & 0x40)
    table = table[1 + table[0] :]
    map_pid = int.from_bytes(table[10:12], "big") & 0x1FFF
    mapped = next(body(p) for p in packets if pid(p) == map_pid and p[1] & 0x40)
    mapped = mapped[1 + mapped[0] :]
    info = int.from_bytes(mapped[10:12], "big") & 0x0FFF
    stream_pid = int.from_bytes(mapped[13 + info : 15 + info], "big") & 0x1FFF
    units, points, last = [], [], None
    for p in packets:
        if pid(p) == stream_pid:
            assert last is None or (p[3] & 15) == (last + 1) % 16
            last = p[3] & 15
            if p[1] & 0x40:
                units.append(b"")
                points.append(bool(p[3] & 0x20 and p[4] and p[5] & 0x40))
            units[-1] += body(p)
    payload, stamps = b"", []
    for u in units:
        assert u[:3] == b"\0\0\1" and len(u) == 6 + int.from_bytes(u[4:6], "big")
        t = u[9:14]
        stamps.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
        payload += u[9 + u[8] :]
    return payload, stamps, points


def test_transport_by_another_parser(rows):
    for _, text in [*rows[:40], (0, "long " * 60_000)]:
        raw = text.encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = transport.write_stream(payload)
        read = transport.read_stream(media)
        assert plain_reader(media) == (payload, read.stamps.tolist(), read.points.tolist()) and read.payload == payload


def test_damaged_streams_are_null(spark):
    whole = transport.write_stream(bytes(range(256)) * 40)
    lost = whole[: 188 * 9] + whole[188 * 10 :]
    twice = whole[: 188 * 9] + whole[188 * 8 : 188 * 9] + whole[188 * 9 :]
    media = spark.createDataFrame([(1, 5, whole), (2, 5, whole[:-7]), (3, 5, b"x" * 188), (4, 5, None), (5, 5, lost), (6, 5, twice), (7, 5, b"")], "doc_id long, n_bytes long, media binary")
    got = by_id(transport.described(media))
    assert got[1].error is None and got[6].error is None and got[6].payload_sha256 == got[1].payload_sha256
    assert all(got[k].error and got[k].payload_sha256 is None for k in (2, 3, 4, 7))
    assert got[5].error


def test_transport(docs, rows):
    got = by_id(transport.described(transport.to_media(docs)))
    for i, text in rows:
        payload = text.encode()
        payload = payload.ljust(max(64, -(-len(payload) // 64) * 64), b"\0")
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(payload[-64:])
        media = transport.write_stream(payload)
        assert (got[i].media_bytes, got[i].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    stream = transport.write_stream(bytes(range(256)) * 250)
    read = transport.read_stream(stream)
    assert read.payload == bytes(range(256)) * 250 and read.broken == 0
    assert read.stamps.tolist() == [90_000 * (k + 1) for k in range(8)] and read.points.tolist() == [True, False, False, False] * 2
    damaged = bytearray(stream)
    damaged[188 + 10] ^= 1
    with pytest.raises(transport.Damaged):
        transport.read_stream(bytes(damaged))
    points = transport.units(transport.to_media(docs.where("doc_id = 8"))).first()
    assert points.stamps == [90_000] and points.points == [True] and points.starts == [0]


def test_quality(docs, rows):
    got = by_id(quality.judged(docs))
    for i, text in rows:
        words = WORD.findall(text)
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        seen = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(seen) - len(set(seen)), len(repeated), failed)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected, text[:80]
        assert not (r.kept and failed)
    assert quality.judged(nothing(docs)).count() == 0
    assert quality.judged(docs, []).where("kept = base_failed").count() == 0


def test_toxicity(spark, docs):
    given = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels = given.unionByName(spark.createDataFrame([(None, None, None), (3, None, 1)], "doc_id long, quality int, toxic int"))
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.learn(real, labels)
    held = by_id(toxicity.scored(real, model))
    tested = [r for r in given.where("toxic IS NOT NULL").where(toxicity.held_out(F.col("doc_id"))).collect() if r.doc_id in held]
    caught = [held[r.doc_id].score >= 0.7 for r in tested if r.toxic]
    assert sum(caught) >= 0.75 * len(caught) > 0
    clean = [held[r.doc_id].score < 0.7 for r in tested if not r.toxic]
    assert sum(clean) >= 0.98 * len(clean)
    got = by_id(toxicity.scored(docs, model))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[0].score == got[1].score
    kept = toxicity.rejecting(docs, model, 0.7)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert toxicity.scored(nothing(docs), model).count() == 0
    alone = toxicity.learn(docs, labels.where("doc_id < 0"))
    assert alone.score("you idiot, you stupid m0ron, wоrthless scum") > 0.7 > alone.score("the trash can and an idiot proof clown car in the garden of the house")


def test_hits_against_a_plain_search():
    rng = np.random.default_rng(8)
    words = ["idiot", "idiotic", "scum", "pond", "soap", "proof", "car", "clown", "the", "moron", "id10t"]
    lexicon = {" idiot ": 3.0, " idio": 1.0, " scum ": 3.0, " mor": 2.0, " clown ": 1.5}
    phrases = ["pond scum", "soap scum", "idiot proof", "clown car"]
    for _ in range(200):
        text = " ".join(rng.choice(words, int(rng.integers(0, 30))).tolist())
        plain = toxicity.folded(text)
        best = {}
        for entry, weight in lexicon.items():
            for at in range(len(plain)):
                if plain.startswith(entry, at) and not any(plain.startswith(f" {p} ", b) and b <= at and at + 1 < b + len(p) + 1 for p in phrases for b in range(at + 1)):
                    best[at] = max(best.get(at, 0.0), weight)
        assert toxicity.hits(text, json.dumps(lexicon), tuple(phrases))[:2] == (sum(best.values()), len(best)), text


def test_many_exception_phrases_take_linear_time():
    began = time.perf_counter()
    toxicity.hits("clown car idiot " * 50_000, json.dumps({" idiot ": 1.0, " clown ": 1.0}), ("clown car",))
    assert time.perf_counter() - began < 10


def test_folding():
    assert toxicity.folded("ІDI0T! wоrd $tupid x2 3") == " idiot word stupid x2 3 "


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(x) if k % 2 == 0 else 2 * int(x) - 9 * (int(x) > 4) for k, x in enumerate(reversed(d))) % 10 == 0


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def test_pii(spark):
    texts = [
        None, "", "x a@b.c_d@e.f, mail a@b.com-@x.y 1.2.3.4.5.6.7.8 0256.1.1.1 00025.1.1.1 +49 (170) 123-4567- +1234567", "4111 1111 1111 1111 4111-1111-1111-1112 😀 4111111111111111", "é😀" * 300 + " q@r.st",
        "+" + "1(" * 5000, "1 " * 5000 + "a" * 3000 + "@",
    ]
    texts += [f"w{k} Zorbax keeps {k}{k}ss the address zed.qux@corp.org for q{k}r" for k in range(6)]
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    docs = docs.withColumn("start", F.lit(1)).withColumn("term", F.lit("t"))
    report = pii.report(docs)
    assert report.count() == docs.count()
    got = by_id(report)
    for i, text in [(r.doc_id, r.text or "") for r in docs.collect()]:
        found = {k: [(m.start(), m.end()) for m in re.finditer(p, text) if valid(k, m[0])] for k, p in PATTERNS.items()}
        base = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in found[k])
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in found.values()], text[:80]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        if not base:
            assert r.spans == ""
    assert "term:3:9" in got[7].spans  # Zorbax stands with that address only, unlike the words around
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[0] is None and clean[1] == "" and clean[7] == "w0 [TERM] [TERM] [TERM] the [TERM] [EMAIL] for [TERM]"
    assert pii.sanitised(docs, generalise=False).columns == docs.columns
    assert pii.report(docs.where("doc_id = -5")).count() == 0 and pii.sanitised(docs.where("doc_id = -5")).count() == 0


def test_disclosing_terms_against_a_plain_count(spark):
    """Documents, counts, lower bounds and neighbours in plain Python."""
    rng = np.random.default_rng(9)
    plain = [f"word{chr(97 + k)}" for k in range(20)]
    texts = []
    for k in range(300):
        words = rng.choice(plain, 12).tolist()
        if k % 10 == 0:
            words[3:3] = ["contact", f"user{k}@mail.org"] if k % 20 else ["contact", "boss@mail.org", "zorba"]
        if k % 30 == 0:
            words += ["key", f"ab{k}cd" * 5]
        texts.append(" ".join(words))
    texts += ["the same passage with copied words and copy@mail.org inside of it"] * 9
    source = spark.createDataFrame([(x,) for x in texts], "text string")
    got = {r.term for r in pii.disclosing(source).collect()}

    def terms(text):
        text = re.sub(PATTERNS["email"], " ", text.lower())
        words = re.findall(r"[^\W_]{3,}", text)
        mixed = [w for w in words if re.search("[0-9]", w) and re.search("[a-z]", w)]
        return {w for w in words if not re.search("[0-9]", w)} | {"<long mixed>" for w in mixed if len(w) >= 16} | {"<mixed>" for w in mixed if len(w) < 16}

    def share(both, term, entity, total):
        z, p = pii.SURE**2, min(1.0, both / term)
        low = (p + z / 2 / term - pii.SURE * math.sqrt(p * (1 - p) / term + z / 4 / term / term)) / (1 + z / term)
        return 1 - math.log(max(low, 1e-12)) / math.log(entity / total)

    found = [(terms(x), bool(re.search(PATTERNS["email"], x)), re.sub(PATTERNS["email"], " ", x.lower()).split()) for x in texts]
    entities = sum(e for _, e, _ in found)
    expected = set()
    for term in {t for ts, _, _ in found for t in ts}:
        n, both = sum(term in ts for ts, _, _ in found), sum(term in ts for ts, e, _ in found if e)
        if both >= pii.SUPPORT and share(both, n, entities, len(texts)) >= pii.DISCLOSED:
            around = set()
            for _, e, words in found:
                if e:
                    for i, w in enumerate(words):
                        same = w == term or (term == "<long mixed>" and len(w) >= 16 and re.search("[0-9]", w))
                        if same:
                            around.add((words[i - 1] if i else None, words[i + 1] if i + 1 < len(words) else None))
            if len(around) >= max(pii.SUPPORT, pii.VARIED * both):
                expected.add(term)
    assert "contact" in expected and "passage" not in expected
    # a value's own terms come on top of those of its kind
    assert expected <= got and "zorba" in got and not got & set(plain) and "passage" not in got


def test_spans_of_many_matches(spark):
    """Two hundred thousand words and numbers, and thousands of matches, in one text."""
    text = "12 a " * 100_000 + " a@b.cc " * 3000
    began = time.perf_counter()
    r = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_email == 3000 and r.spans.startswith("email:500001:500007,email:500009:")
    assert time.perf_counter() - began < 120


@pytest.mark.parametrize("name", ["op6_quality_rules", "op10_ngram_jaccard"])
def test_sql(spark, name):
    from foliant.llm import queries

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    found = con.execute(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert collections.Counter(map(tuple, df.select(names).collect())) == collections.Counter(map(tuple, found.fetchall()))


def test_personal_data_with_nothing_broadcast(spark, docs, monkeypatch):
    """What is too large to be broadcast, counted in bytes, is joined otherwise, with the same spans."""
    table = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    wide = spark.createDataFrame([(k, ["word" * 10] * 3) for k in range(4)], "key long, held array<string>")
    assert "hint" in pii.light(wide, "held")._jdf.logicalPlan().toString().lower()
    one = sorted((r.doc_id, r.spans) for r in pii.report(table).collect())
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert "hint" not in pii.light(wide, "held")._jdf.logicalPlan().toString().lower()
    assert sorted((r.doc_id, r.spans) for r in pii.report(table).collect()) == one
