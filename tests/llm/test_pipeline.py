"""Each stage of the corpus pipeline against a plain version of it, on rows with nulls, repeats and ids that two texts share."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_llm_operators import components  # noqa: E402

from wayflow.llm import mixing, quality_crf  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, class_key string, many string, k0 long"


def table(spark, n=50):
    r = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(n):
        w = r.choices(words, k=r.randrange(1, 90))
        rows.append((k, " ".join(w)))
        if k % 3 == 0:
            rows.append((100 + k, "  ".join(w)))  # equal without white space, and longer
        if k % 4 == 0 and len(w) > 60:
            rows.append((200 + k, " ".join([*w[:-1], "changed"])))
        if k % 7 == 0:
            rows.append((k + 1, " ".join(r.choices(words, k=40))))  # an id with two texts
    rows += [(900, None), (901, ""), (902, " \n"), (None, "no id"), (None, "no id"), (3, rows[3][1]), (3, rows[3][1]), (903, "x" * 30000)]
    rows = [(i, t, ["en", "de", None][k % 3], ["s1", "s2", "s3", None][k % 4], len(t or ""), "clash", "clash", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, COLUMNS)


def as_lists(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_quality_keeps_what_scores_enough(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.quality(spark, d, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    model = quality_crf.train(d, spark.createDataFrame([(i, q) for i, q in labels.items() if zlib.crc32(str(i).encode()) % 5], "doc_id long, quality int"))
    want = set()
    for r in d.collect():  # one document at a time
        x, n, off = quality_crf.line_features(pa.array([r.text or ""]))
        if model.score(x, n, off)[0] >= 0.3:
            want.add(r.doc_id)
    assert got == want and 0 < len(want) < d.count()
    assert corpus_pipeline.quality(spark, d, SF).columns == d.columns


def test_quality_edges(spark):
    d = table(spark)
    out = corpus_pipeline.quality(spark, d, SF)
    assert out.schema == d.schema and set(plain(out)) <= set(plain(d))
    assert corpus_pipeline.quality(spark, d.limit(0), SF).count() == 0


def test_exact_leaves_one_row_a_text(spark):
    d = table(spark)
    groups = {}
    for r in d.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    got = Counter((r.doc_id, re.sub(r"[\x20\x09-\x0D]", "", r.text or "")) for r in corpus_pipeline.exact(spark, d, SF).collect())
    assert got == Counter({(None if (best := min(g))[1] else best[2], t): 1 for t, g in groups.items()})
    assert corpus_pipeline.exact(spark, d.limit(0), SF).count() == 0


def test_near_leaves_one_row_a_group(spark):
    d = table(spark)
    rows = sorted({(r.doc_id, r.text or "") for r in d.collect() if r.doc_id is not None})
    want = components(rows, 5, 80)
    got = [r for r in corpus_pipeline.near(spark, d, SF).collect()]
    assert [r for r in got if r.doc_id is None][0].text == "no id"
    named = sorted((r.doc_id, r.text or "") for r in got if r.doc_id is not None)
    # the rows that stay are those whose id is their component's; none is left out, and none comes twice
    assert len(named) == len(set(named)) and {i for i, _ in named} == {i for i, _, c in want if i == c}
    assert corpus_pipeline.near(spark, d.limit(0), SF).count() == 0


def test_mixed_takes_the_prefix_of_each_leaf(spark):
    d = table(spark)
    rows = [(r.doc_id, r.lang, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.k0) for r in d.collect()]
    total = sum(r[3] for r in rows)
    name = lambda s: "d" + str(int(re.search(r"(\d+)$", s or "0")[1]) % 4)

    def share(items, budget, level):
        """Budget of each leaf below ``items``, by water filling."""
        if level == 3:
            return {items[0][:3]: budget}
        by = {}
        for leaf in items:
            by.setdefault(leaf[level], []).append(leaf)
        weight = mixing.WEIGHTS[("domain", "lang", "source")[level]]
        left, given, open_ = budget, {}, set(by)
        while open_:
            x = left / sum(weight.get(c, 1) for c in open_)
            full = [c for c in open_ if sum(v[3] for v in by[c]) < weight.get(c, 1) * x]
            if not full:
                given |= {c: weight.get(c, 1) * x for c in open_}
                break
            for c in full:
                given[c] = sum(v[3] for v in by[c])
                left -= given[c]
                open_.remove(c)
        out = {}
        for c, v in by.items():
            out |= share(v, given[c], level + 1)
        return out

    leaves = {}
    for i, lang, source, n, _ in rows:
        key = (name(source), lang, source)
        leaves[key] = leaves.get(key, 0) + n
    budget = share([(*k, n) for k, n in leaves.items()], corpus_pipeline.FRACTION * total, 0)
    want = []
    for key, n in leaves.items():
        b = int(budget[key] + 1e-6)
        whole, rest = (b // n, b % n) if n else (0, 0)
        at = 0
        order = sorted((hashlib.md5(f"42:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] if r[0] is not None else -1, r[3]) for r in rows if (name(r[2]), r[1], r[2]) == key)
        for _, i, t in order:
            at += t
            if whole + (at <= rest):
                want.append((i, *key[1:], t))
    got = [(-1 if r.doc_id is None else r.doc_id, r.lang, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in corpus_pipeline.mixed(spark, d, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert corpus_pipeline.mixed(spark, d.limit(0), SF).count() == 0


def test_packed_holds_every_token(spark):
    from tokenizers import Tokenizer

    d = table(spark)
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    want = []
    for r in d.collect():
        ids = np.array([*encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            want.append((-1 if r.doc_id is None else r.doc_id, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())))
    got = corpus_pipeline.packed(spark, d, SF).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert corpus_pipeline.packed(spark, d.limit(0), SF).count() == 0


def test_run_is_the_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    assert as_lists(corpus_pipeline.run(spark, SF).drop("sequence_id", "offset")) == as_lists(docs.drop("sequence_id", "offset"))
