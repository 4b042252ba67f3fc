"""Fill-in-middle transformation: documents cut at two token borders and written with their middle last.

The tokenizers library's ``Split`` pre-tokenizer gives the code-point offsets of a pattern's isolated matches; nothing is trained.
The number of offsets is the number of tokens, and the offsets at two drawn ranks are where the text is cut.  Which documents are
transformed, and where, is a hash of the id, so every run and every task that starts again decides alike.  Only two numbers a text
come back from Python; slices, output and its inverse are column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, read

PATTERN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARKS = ("<P>", "<S>", "<M>")
#: A token ends where white space follows something else, so longer texts are cut there into blocks of about this many characters.
BLOCK = 1 << 15
_EDGE = re.compile(r"[^\x20\x09-\x0D][\x20\x09-\x0D]")


def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(PATTERN), "isolated")


def token_ends(text: str, split) -> np.ndarray:
    """Where each token ends, in code points; the last one ends the text.  An empty text has none."""
    ends, a = [], 0
    while a < len(text):
        edge = _EDGE.search(text, a + BLOCK) if len(text) - a > BLOCK else None
        z = edge.end() - 1 if edge else len(text)
        found = split.pre_tokenize_str(text[a:z])
        ends.append(np.fromiter((at[1] for _, at in found), np.int64, len(found)) + a)
        a = z
    return np.concatenate(ends) if ends else np.zeros(0, np.int64)


CUT = "n long, first long, second long"


def cuts(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The number n of a text's tokens, and the code points before its middle and before its suffix.

    The two draws (not negative) modulo n + 1 are the numbers of tokens before them, the smaller first.
    """
    split = _splitter()
    for texts, one, two in columns:
        out = np.zeros((3, len(texts)), np.int64)
        for k, (text, x, y) in enumerate(zip(texts, one.to_pylist(), two.to_pylist(), strict=True)):
            ends = token_ends(text.as_py(), split)
            n = len(ends)
            at = sorted((x % (n + 1), y % (n + 1)))
            out[:, k] = n, *(ends[r - 1] if r else 0 for r in at)
        yield pa.StructArray.from_arrays([pa.array(c) for c in out], ["n", "first", "second"])


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32: the first groups of eight digits of the sha256 of ``seed:doc_id``; a null id has no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone: ``plain`` as it is, else what stands between the three marks, in order."""
    prefix, suffix, middle = MARKS

    def between(a: str, z: str | None) -> Column:
        begin = F.locate(a, output) + len(a)
        return F.substring(output, begin, F.locate(z, output) - begin if z else F.length(output))

    psm = F.concat(between(prefix, suffix), between(middle, None), between(suffix, middle))
    spm = F.concat(between(prefix, middle), between(middle, None), between(suffix, prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """Per row: doc_id, text, n, form, prefix_chars, middle_chars and output.

    ``form`` is plain (the output is the text), psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each part after its mark.
    Null texts are empty; empty texts, and texts that hold a mark, stay plain, so that :func:`restore` is exact; plain rows have no
    prefix_chars and middle_chars.  Prefix, middle or suffix may be empty.  Very long texts are cut whole, in blocks that end where a
    token ends.  Repeated rows and rows with equal ids are decided alike and stay rows of their own; rows without an id share
    their draws.  Other columns are left out, whatever their names; an empty table gives an empty result.
    """
    one, two, kind, order = draws(F.col("doc_id"), seed)
    marked = F.greatest(*(F.contains("text", F.lit(m)) for m in MARKS))
    form = F.when((F.col("text") == "") | marked | (kind % 100 >= percent), "plain").when(order % 100 < spm_percent, "spm").otherwise("psm")
    rows = id_text(docs).select("doc_id", "text", form.alias("form"), F.arrow_udf(cuts, CUT)("text", one, two).alias("cut"))
    rows = rows.select("doc_id", "text", "form", "cut.n", F.col("cut.first").cast("int").alias("first"), F.col("cut.second").cast("int").alias("second"))
    prefix, middle = F.substring("text", F.lit(1), F.col("first")), F.substring("text", F.col("first") + 1, F.col("second") - F.col("first"))
    suffix = F.substring("text", F.col("second") + 1, F.length("text"))
    p, s, m = (F.lit(x) for x in MARKS)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "text", "n", "form", F.when(cut, F.col("first").cast("long")).alias("prefix_chars"), F.when(cut, (F.col("second") - F.col("first")).cast("long")).alias("middle_chars"), output.alias("output"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(read(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = restore(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
SQL = {
    "op13_fill_in_middle": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
v AS (SELECT *, CAST(len(tok) AS BIGINT) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z FROM v),
x AS (SELECT *, array_to_string(tok[1:a], '') AS p, array_to_string(tok[a + 1:z], '') AS m, array_to_string(tok[z + 1:], '') AS s FROM w)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM x"""
}
