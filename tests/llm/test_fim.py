"""Fill-in-middle: cuts against a plain reading of the rule, and the way back."""

import hashlib
import re

from pyspark.sql import functions as F

from ledgerlark.llm import fim


def plainly(doc_id, text, rate=90, spm=20):
    text = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(w), "plain", None, None, text
    return (len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_rule_and_way_back(spark, odd, empty):
    texts = ["a<P>b", "<S", "M>", "<<P", "P>x <", "one, two\n\nthree  four-five é😀 six.", "<P", "a\tb\r\n"] * 30 + ["word " * 300 + "é" * 50]
    rows = [(1000 + i, t) for i, t in enumerate(texts)]
    df = odd.select("doc_id", "text", "score").unionByName(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1).cast("long")))
    df = df.withColumn("form", F.lit("x"))
    out = fim.transform(df, keep=("text", "score", "form")).withColumn("back", fim.restored(F.col("output"), F.col("form_")))
    assert out.columns == ["text", "score", "form", "doc_id", "n", "form_", "prefix_chars", "middle_chars", "output", "back"]
    got = out.collect()
    assert len(got) == df.count()
    forms = set()
    for r in got:
        assert (r.n, r.form_, r.prefix_chars, r.middle_chars, r.output) == plainly(r.doc_id, r.text)
        assert r.back == (r.text or "")
        forms.add(r.form_)
    assert forms == {"plain", "psm", "spm"}
    assert fim.transform(empty).collect() == []


def test_blocks_do_not_cut_words():
    split = fim.splitter()
    for text in ("", "a", "abc def", "abcdefghij klm", "é" * 9, "ab é cd" * 20, "x" * 50):
        whole = fim.token_ends(text, split).tolist()
        assert whole == [m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        for block in (1, 2, 3, 7):
            assert fim.token_ends(text, split, block).tolist() == whole
