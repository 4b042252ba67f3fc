"""Operators on small tables with nulls, empty texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayflow.llm import compaction, exact_dedup, language_id, mixing, ngram_join, packing, quality_crf, repair_shards, secrets
from wayflow.llm.tokens import ChunkEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, rank long"


def docs(spark, n=60):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma,", "delta.", "Épsilon", "zeta!!", "it's", "a1b2"]
    texts = [None, "", "  \n\t", "x" * 5000, "alpha beta", "alpha  beta", "alpha beta gamma", "nbsp   two", "<|endoftext|> x", "a<|endoftext|>b [SEP] <s> [UNK]x<|ENDOFTEXT|>"]
    base = [r.choice(words) + str(r.randrange(50)) for _ in range(120)]
    for k in range(n):
        w = list(base)
        for _ in range(r.randrange(14)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    texts += texts[-3:]
    rows = [(k, t, ["en", "de", None][k % 3], ["src1", "src2", None][k % 3], 1, "clash", 7) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(3, texts[3], "en", "src1", 1, "clash", 7), (None, "no id", None, None, None, None, None)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_cuckoo_index_inserts_deletes_and_resizes():
    index, live = exact_dedup.CuckooIndex(2), {}
    r = random.Random(1)
    keys = [hashlib.sha256(b"%d" % k).digest() for k in range(3000)]
    for _ in range(20000):
        k = r.choice(keys)
        if r.random() < 0.4:
            assert index.delete(k) == (live.pop(k, None) is not None)
        else:
            index.put(k, k[:3])
            live[k] = k[:3]
    assert dict(index.items()) == live and index.size == len(live) and index.resizes > 0
    assert all(index.get(k) == live.get(k) for k in keys)


def test_exact_dedup(spark):
    d = docs(spark)
    groups = {}
    for r in d.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    want = sorted((i if i is not None else -1, sorted(g)[0][2], len(g)) for g in groups.values() for _, _, i in g)
    got = exact_dedup.exact_dedup(d).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size) for r in got) == want
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_index_versions(spark):
    d = docs(spark)
    first = exact_dedup.apply_changes(None, d, spark.createDataFrame([], "digest binary"))
    n = first.count()
    gone = first.limit(2).select("digest")
    assert exact_dedup.apply_changes(first, d.limit(0), gone).count() == n - 2


def components(rows, n, percent):
    """(doc_id, set) of each row to its component, by comparing every pair of rows."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()

    items = [(i, grams(t)) for i, t in rows]
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, s) in enumerate(items):
        for b, (_, t) in enumerate(items[:a]):
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(items):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(items))


BOUNDS = ({}, {"group_docs": 7, "group_tokens": 400, "block_docs": 5})


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, n, percent):
    d = docs(spark)
    want = components([(r.doc_id, r.text) for r in d.where("doc_id IS NOT NULL").collect()], n, percent)
    # small bounds split the groups and blocks, which must change nothing
    for bounds in BOUNDS:
        got = ngram_join.ngram_join(d, n, percent, **bounds).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == want
        assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert ngram_join.ngram_join(empty(spark)).count() == 0


def test_parities_bound_the_overlap():
    r = np.random.default_rng(2)
    for size in (1, 40, 127, 128, 500, 3000):
        a = r.integers(0, 1 << 63, size, np.uint64)
        a[: size // 2] = a[: size // 2] // np.uint64(1 << 16) * np.uint64(1 << 16)  # crowded buckets
        for keep in (0.5, 0.9, 1.0):
            b = np.unique(np.concatenate([a[: int(size * keep)], r.integers(0, 1 << 63, max(1, size // 5), np.uint64)]))
            sets = [np.unique(a), b]
            c = ngram_join.Parities([ngram_join.parities(x) for x in sets], np.array([len(x) for x in sets]))
            assert c.bound(np.array([0]), 1)[0] >= len(np.intersect1d(*sets))


@pytest.mark.parametrize("bounds", BOUNDS)
def test_ngram_join_ids_with_two_texts(spark, bounds):
    """Ids that two different texts share, chains of links, and a passage that all texts have."""
    r = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    common, rows = r.choices(words, k=60), []
    for k in range(25):
        text = r.choices(words, k=70) + common
        for step in range(5):  # each a little further from the first
            rows.append(((7 * k + step) % 60, " ".join(text)))
            text = [*text[:3 * step], r.choice(words), *text[3 * step + 1 :]]
        rows.append(((7 * k) % 60, " ".join(r.choices(words, k=90) + common)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((3, 90), (5, 80)):
        got = ngram_join.ngram_join(d, n, percent, **bounds).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(rows, n, percent)


def test_ngram_join_moves_a_text_once_a_place(spark, monkeypatch):
    """As many texts go to the cells when all rows share an id as when each has its own."""
    r, texts, moved = random.Random(2), [], []
    for _ in range(40):
        t = [f"w{r.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(t), " ".join([*t[:-1], "other"])]
    plain = ngram_join._texts

    def counted(*a):
        moved[-1] += (out := plain(*a)).count()
        return out

    monkeypatch.setattr(ngram_join, "_texts", counted)
    for rows in ([*enumerate(texts)], [(7, t) for t in texts]):
        moved.append(0)
        d = spark.createDataFrame(rows, "doc_id long, text string")
        got = ngram_join.ngram_join(d, 5, 80).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(rows, 5, 80)
    assert 0 < moved[1] <= moved[0]


def test_ngram_join_very_long_text(spark):
    """More than 65,535 n-grams in one bucket of counts, were it not for its width; and a near copy of it."""
    one = " ".join(str(k) for k in range(300_000))
    d = spark.createDataFrame([(1, one), (2, one + " tail"), (3, "short text")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.ngram_join(d, 3, 90).collect()) == [(1, 1), (2, 1), (3, 3)]


def _ids(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4")


def test_repair_round_trip(spark, tmp_path):
    d, ids = docs(spark), _ids("byte_bpe_50k.json", 2)
    repair_shards.write_shards(d, str(tmp_path / "a"), public_tokenizers.path("byte_bpe_50k.json"), shard_ids=2000)
    got = {r.doc_id: r for r in repair_shards.read_shards(spark, str(tmp_path / "a")).collect()}
    start = 0
    rows = sorted(d.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in rows:
        x = ids(r.text)
        if r.doc_id != 3:
            assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    shard = repair_shards.Shard(bytes(spark.read.parquet(str(tmp_path / "a")).first().shard))
    assert sum(len(shard.ids(k)) for k in range(len(shard.doc_id))) == len(shard.all_ids()) == shard.n_ids().sum()
    repair_shards.write_shards(empty(spark), str(tmp_path / "b"), public_tokenizers.path("byte_bpe_50k.json"))
    assert repair_shards.read_shards(spark, str(tmp_path / "b")).count() == 0


def test_packing(spark):
    d, ids = docs(spark), _ids("word_bpe_49k.json", 0)
    got = packing.pack(d, public_tokenizers.path("word_bpe_49k.json"), capacity=64).collect()
    want = []
    for r in d.collect():
        x = ids(r.text)
        want += [(r.doc_id if r.doc_id is not None else -1, k, a, len(x[a : a + 64]), zlib.crc32(x[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(x), 64))]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(w[3] for w in want) // 64)
    assert least <= len(by) <= least + max(1, least // 10)
    assert packing.pack(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing_equals_best_fit_on_single_pieces():
    """The plan over counts fills as many sequences as best-fit decreasing over pieces, one by one."""
    r = random.Random(8)
    for _ in range(30):
        sizes = [r.randrange(1, 33) for _ in range(r.randrange(1, 200))]
        room = []
        for n in sorted(sizes, reverse=True):
            fits = [x for x in room if x >= n]
            x = min(fits) if fits else 32
            if fits:
                room.remove(x)
            room.append(x - n)
        histogram = {n: sizes.count(n) for n in set(sizes)}
        assert packing.plan(histogram, 32)[1] == len(room)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_ids_are_the_library_s(name):
    """Marks that compose or not, letters whose lower case is of other bytes, controls: in batches and in sequence, with one cache."""
    from tokenizers import Tokenizer

    pieces = [" ", "\n", "\t", "  ", "e", "o", "T", "H", "J", "W", "Y", "I", "K", "a", "the", "And", "1", ".", "=", "'s", "'", "\u0308", "\u0331", "\u030a", "\u030c", "\u0307", "\u0338", "\u0345"]
    pieces += ["\u0130", "\u212a", "\u1e9e", "\u03a3", "\u00e9", "\u00c9", "\u00df", "\x00", "\x01", "\x07", "\x1b", "\x1c", "\x7f", "\x85", "\u00ad", "\u200d", "\ufffd", "\u1100\u1161", "\u4e2d", "\U0001f600", "\u0660", "\u2160", "\ufb01"]
    path = public_tokenizers.path(name)
    encoder, library, r = ChunkEncoder(path), Tokenizer.from_file(path), random.Random(3)
    batches = [[" o\u0308 \u0130 o\u0308"], [" e\u0308 \u0130"], ["a \u0130 b", "a e\u0308 b", "T\u0308 h\u0331 H\u0331"]]
    batches += [["".join(r.choices(pieces, k=r.randrange(14))) for _ in range(size)] for size in [1] * 500 + [100] * 150]
    for texts in batches:
        ids, off = encoder.encode(pa.array(texts, pa.string()))
        assert [ids[a:z].tolist() for a, z in zip(off, off[1:], strict=False)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_secrets():
    text = "é password: hunter2secret AKIA" + "A" * 16 + " " + "0af" * 9 + " pwd = Xk9$vQ2!mZ7p token=abc"
    spans = secrets.base_spans(text)
    assert [(k, text[a:b]) for a, k, b in spans] == [(0, "password: hunter2secret"), (1, "AKIA" + "A" * 16), (2, "0af" * 9)]
    guesser = secrets.Guesser()
    cost = lambda v: guesser.cost(v)[0]
    assert "Xk9$vQ2!mZ7p" in [text[a:b] for a, _, b, _ in secrets.guess_spans(text, 8.0, guesser)]
    assert cost("password1") < 3 < cost("Xk9$vQ2!") and cost("asdfghjklove") < 6
    assert cost("aaaaaaaa") < 4 and cost("qwertyuiop") < 6 and cost("19840521") < 6


@pytest.mark.parametrize(("text", "value"), [
    ("DB_PASSWORD_PROD=Xk9$vQ2!mZ7p", "Xk9$vQ2!mZ7p"), ("Authorization: Bearer eyJhbGciOi9", "eyJhbGciOi9"), ("aws_secret_access_key = wJalrXUtnFEMI9", "wJalrXUtnFEMI9"),
    ("bearer eyJhbGciOi9", "eyJhbGciOi9"), ("the password is required", None), ("login: Monday", None), ("spinning: Xk9$vQ2!mZ7p", None),
])
def test_credential_context(text, value):
    guesser = secrets.Guesser([*secrets.WORDS, "required", "monday"])
    assert [text[a:b] for a, _, b, _ in secrets.guess_spans(text, 8.0, guesser)] == ([value] if value else [])


def test_guess_cost_is_the_least_of_all_segmentations():
    words = ["ab", "pass", "love", "one"]
    guesser = secrets.Guesser(words)

    def segments(v, memo):
        """Prices of the whole of v as one segment, by the definitions."""
        low = secrets.lower(v)
        if len(v) == 1:
            yield secrets.brute_cost(v)
        for rank, w in enumerate(words):
            if w in (low, low.translate(secrets.LEET)):
                yield secrets.word_cost(v, rank)
        if any(f.fullmatch(v) for f in secrets.DATES):
            yield secrets.date_cost(v)
        for kind, linked in (("walk", secrets.walks), ("sequence", secrets.follows)):
            if len(v) >= 3 and all(linked(a, b) for a, b in zip(low, low[1:], strict=False)):
                yield secrets.run_cost(kind, len(v))
        for p in range(1, len(v) // 2 + 1):
            if len(v) % p == 0 and v == v[:p] * (len(v) // p):
                yield least(v[:p], memo) + np.log10(len(v) // p)

    def least(v, memo):
        if v not in memo:
            memo[v] = 0.0 if not v else min(least(v[:k], memo) + c for k in range(len(v)) for c in segments(v[k:], memo))
        return memo[v]

    r, memo = random.Random(4), {}
    pieces = ["ab", "Ab", "p4ss", "love", "2019", "21-05-1984", "19840521", "aaa", "qwer", "asdf", "cba", "123", "x", "!", "É", "one", "0ne", "aab", "."]
    for _ in range(400):
        v = "".join(r.choices(pieces, k=r.randrange(1, 6)))
        v = v * r.choice((1, 1, 2, 3)) if len(v) < 9 else v
        cost, parts = guesser.cost(v)
        assert abs(cost - least(v, memo)) < 1e-9, v
        assert "".join(p for _, p in parts) == v
    for k in range(10):  # runs far longer than a keyboard's row, with something at both ends
        row = ["qwertyuiop", "asdfghjkl", "aab", "ab1x", "q", "12321"][k % 6]
        v = r.choice(pieces) + r.choice(pieces) + (row + (row[-2:0:-1] if k % 6 < 2 else "")) * 40
        v = v[: r.randrange(66, 110)] + r.choice(pieces) + r.choice(pieces)
        assert abs(guesser.cost(v)[0] - least(v, memo)) < 1e-9, v


def test_guess_cost_of_very_long_values():
    guesser = secrets.Guesser()
    assert guesser.cost("a" * 100_000)[0] < 8 and guesser.cost("abcd" * 30_000)[0] < 8
    assert guesser.cost("".join(random.Random(1).choices("abcXYZ019+/", k=200_000)))[0] > 1000


def test_secret_scan(spark):
    """Base spans by the patterns one by one, on every text."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = {}
    for r in d.collect():
        t = r.text or ""
        found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 24]
        want[r.doc_id] = hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(found)).encode()).hexdigest()
    got = secrets.op3_secret_scan(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: r.base_sha256 for r in got} == want
    assert all(len(r.spans.split(",")) == r.n_assign + r.n_access + r.n_hex + r.n_guess for r in got if r.spans)


def test_secret_scan_edges(spark):
    assert secrets.scan_secrets(docs(spark)).count() == docs(spark).count()
    assert secrets.scan_secrets(empty(spark)).count() == 0 and secrets.corpus_words(empty(spark)) == []


def test_language_id(spark):
    d = docs(spark)
    out = language_id.predict(d, language_id.train(d)).collect()
    assert len(out) == d.count() and {r.lang_pred for r in out if r.doc_id in (0, 1, 2)} == {"und"}
    assert {r.lang_pred for r in language_id.predict(d, language_id.train(empty(spark))).collect()} == {"und"}


def test_language_id_in_parts(spark):
    """Seven languages in parts of two, with one language's counts held at once, give what one matrix gives."""
    d = docs(spark).withColumn("lang", F.concat(F.lit("l"), F.pmod(F.xxhash64("text"), F.lit(7)).cast("string")))
    read = lambda model: sorted((r.doc_id is not None, r.doc_id, r.lang_pred, round(r.score, 9)) for r in language_id.predict(d.where("doc_id IS NOT NULL"), model).collect())
    whole = read(language_id.train(d))
    model = language_id.train(d, most=2, held=1)
    assert len(model.parts) > 2 and len({x[2] for x in whole}) > 3
    assert read(model) == whole


def test_language_id_equals_plain_naive_bayes(spark):
    """Counts in dictionaries, character by character, with the same hash; and what it gets right of held-out documents."""
    from math import exp, log

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mul, two, three, mask = 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0xFFFFFFFF

    def grams(text):
        c = [ord(x) if x.isalpha() else 32 for x in (text or "").lower()]
        out = []
        for k, x in enumerate(c):
            b, a = c[k - 1] if k else 32, c[k - 2] if k > 1 else 32
            h1 = x * mul & mask
            h2 = ((b * two & mask) ^ h1) * mul & mask
            h3 = ((a * three & mask) ^ h2) * mul & mask
            out += [h >> 16 | 1 for h, on in ((h1, x != 32), (h2, x != 32 or b != 32), (h3, b != 32)) if on]
        return out

    rows = d.collect()
    counts, many = {}, {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            many[r.lang] = many.get(r.lang, 0) + 1
            table = counts.setdefault(r.lang, {})
            for g in grams(r.text):
                table[g] = table.get(g, 0) + 1
    size = {k: sum(t.values()) + 0.5 * (1 << 16) for k, t in counts.items()}
    got = {r.doc_id: r for r in language_id.op10_language_id(spark, "/root/testdata/sf0.001").collect()}
    right = []
    for r in rows:
        gs = grams(r.text)
        points = {k: log(many[k] / sum(many.values())) + sum(log(t.get(g, 0) + 0.5) - log(size[k]) for g in gs) for k, t in counts.items()}
        best = max(points, key=points.get)
        assert got[r.doc_id].lang_pred == (best if any(x.isalpha() for x in r.text or "") else "und")
        if got[r.doc_id].lang_pred != "und":
            assert abs(got[r.doc_id].score - 1 / sum(exp(p - points[best]) for p in points.values())) < 0.02
            if got[r.doc_id].held_out and r.lang is not None:
                right.append(got[r.doc_id].lang_pred == r.lang)
    assert sum(right) / len(right) > 0.95


def test_chain_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    emit, link = r.normal(size=(4, 2)), r.normal(size=(2, 2))
    good, pairs, z = quality_crf.forward_backward(emit, link, np.array([0, 4]))
    total, marginal = 0.0, np.zeros(4)
    for code in range(16):
        y = [code >> k & 1 for k in range(4)]
        w = np.exp(sum(emit[k, y[k]] for k in range(4)) + sum(link[y[k - 1], y[k]] for k in range(1, 4)))
        total += w
        marginal += w * np.array(y)
    assert np.allclose(good, marginal / total) and np.isclose(z, np.log(total)) and np.isclose(pairs.sum(), 3)


def test_quality_score_of_each_document_and_held_out_area(spark):
    """The score from plain features' marginals, one document at a time; and how well it ranks held-out labels."""
    import pyarrow as pa

    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    quality = {r.doc_id: r.quality for r in labels.collect()}
    held = {i for i in quality if zlib.crc32(str(i).encode()) % 5 == 0}
    model = quality_crf.train(d, spark.createDataFrame([(i, q) for i, q in quality.items() if i not in held], "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality_crf.op4_quality_crf(spark, sf).collect()}
    for r in d.limit(150).collect():
        x, n, off = quality_crf.line_features(pa.array([r.text or ""]))
        assert len(x) == (r.text or "").count("\n") + 1 and list(n) == [len(line.encode()) for line in (r.text or "").split("\n")]
        emit = np.stack([np.zeros(len(x)), x @ model.weights], 1)
        alpha = [emit[0]]
        for t in range(1, len(x)):
            alpha.append(emit[t] + np.logaddexp(alpha[-1][0] + model.link[0], alpha[-1][1] + model.link[1]))
        beta = [np.zeros(2)]
        for t in range(len(x) - 1, 0, -1):
            v = emit[t] + beta[0]
            beta.insert(0, np.logaddexp(model.link[:, 0] + v[0], model.link[:, 1] + v[1]))
        full = np.array(alpha) + np.array(beta)
        good = 1 / (1 + np.exp(full[:, 0] - full[:, 1]))
        want = 1 / (1 + np.exp(-(model.curve[0] * (good @ n) / n.sum() + model.curve[1]))) if n.sum() else model.prior
        assert abs(got[r.doc_id].score - want) < 1e-6 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
    good, bad = ([got[i].score for i in held if quality[i] == q] for q in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.95


def test_quality_edges(spark):
    d = docs(spark)
    labels = spark.createDataFrame([(k, k % 2 if k < 40 else None, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    out = quality_crf.score(d, quality_crf.train(d, labels)).collect()
    assert len(out) == d.count() and all(0 <= r.score <= 1 for r in out)
    assert quality_crf.score(d, quality_crf.train(empty(spark), labels)).where("score = 0.5").count() == d.count()


def test_compaction(spark, tmp_path):
    d = docs(spark)
    store = compaction.compacted(d, path=str(tmp_path / "s"))
    assert sorted(map(str, store.snapshot().collect())) == sorted(map(str, d.collect()))
    assert len(store.manifest()["runs"]) < 16
    with pytest.raises(compaction.Conflict):
        store.commit([], store.manifest()["version"] - 1)
    assert compaction.compacted(empty(spark), path=str(tmp_path / "e")).snapshot().count() == 0


def test_writers_that_race(spark, tmp_path):
    """A rival commits just before each of a writer's first commits: nothing is lost, and no snapshot shows part of an append."""
    d = docs(spark)
    by = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(8))
    store, rival = (compaction.RunStore(spark, str(tmp_path / "s"), d.schema, retain=50) for _ in range(2))
    commit, left = store.commit, [3]

    def late(runs, after):
        if left[0]:
            left[0] -= 1
            rival.append(d.limit(1))
        return commit(runs, after)

    store.commit = late
    store.append(d, by)
    n = d.count()
    assert [store.snapshot(v).count() for v in store.versions()] == [1, 2, 3, 3 + n]
    left[0] = 2
    store.compact()
    assert store.snapshot().count() == 3 + n + 2 and store.snapshot(4).count() == 3 + n


def test_a_writer_that_fails_leaves_nothing(spark, tmp_path):
    d = docs(spark)
    store = compaction.RunStore(spark, str(tmp_path / "s"), d.schema, tries=2)
    store.append(d)

    def conflict(runs, after):
        raise compaction.Conflict(after)

    store.commit = conflict
    before = sorted((tmp_path / "s" / "runs").iterdir())
    with pytest.raises(compaction.Conflict):
        store.append(d)
    assert sorted((tmp_path / "s" / "runs").iterdir()) == before


def test_old_versions_stay_readable_for_a_while(spark, tmp_path):
    d = docs(spark)
    store = compaction.RunStore(spark, str(tmp_path / "s"), d.schema, fanout=2, retain=2)
    for _ in range(2):
        store.append(d)
    old = store.snapshot(2)
    assert store.compact() == 3
    assert old.count() == store.snapshot(2).count() == store.snapshot().count() == 2 * d.count()
    store.append(d)
    store.compact()
    with pytest.raises(compaction.Gone):
        store.snapshot(2)


def test_mixing_redistributes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, F.lit(400.0), {"domain": {"d0": 1, "d1": 1}}, epochs=1).collect()}
    assert got == {"a": 10, "b": 190, "c": 200}


def test_mixing_edges(spark):
    assert mixing.mix(docs(spark)).count() == docs(spark).count()
    assert mixing.mix(empty(spark)).count() == 0
