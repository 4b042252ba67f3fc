"""Fill-in-middle against a plain version: odd white space, marks, very long texts, nulls and repeated rows."""

import hashlib
import random
import re

from wayflow.llm import fill_middle

SCHEMA = "doc_id long, text string, form string, n long, output string, cut string"


def plain(doc_id, text, seed=42, percent=50, spm_percent=80):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(tokens)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:z], tokens[z:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm_percent:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def table():
    r = random.Random(7)
    pieces = [" ", "  ", "\n", "\t\x0b\x0c\r", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "a", "wort", "é", "e\u0301", "\U0001f600", "\u200d", "\0", "<", "P>", "<P", "<S>x", "中文"]
    texts = [None, "", " ", "\n\n\n", "a", " a ", "<P>", "x<S>y", "a <M> b", "<P", "S>", "word " * 9000, " " * 70_000, "x" * 70_000, " " * 40_000 + "a" + " " * 40_000, ("ab" * 40_000 + " ") * 3, "\U0001f600 " * 40_000]
    texts += ["".join(r.choice(pieces) for _ in range(r.randrange(60))) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + rows[-5:] + [(None, "no id"), (None, "no id"), (-5, "minus five"), (3, "another text of three")]


def test_outputs_are_those_of_a_plain_version(spark):
    rows = table()
    docs = spark.createDataFrame([(k, t, "clash", 1, "clash", "clash") for k, t in rows], SCHEMA)
    for options in ({}, {"seed": 7, "percent": 100, "spm_percent": 30}):
        out = fill_middle.fill_in_middle(docs, **options)
        out = out.withColumn("back", fill_middle.restore(out.output, out.form))
        got = out.collect()
        assert sorted((tuple(r)[:1] + tuple(r)[2:7] for r in got), key=str) == sorted((plain(k, t, **options) for k, t in rows), key=str)
        assert all(r.back == r.text for r in got)
        assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_end_where_tokens_end():
    split = fill_middle._splitter()
    r = random.Random(1)
    for _ in range(5):
        text = "".join(r.choice(["a", "b", " ", "\n", "é", "\U0001f600"]) for _ in range(3 * fill_middle.BLOCK + r.randrange(9)))
        assert fill_middle.token_ends(text, split).tolist() == [m.end() for m in re.finditer(fill_middle.PATTERN, text)]
