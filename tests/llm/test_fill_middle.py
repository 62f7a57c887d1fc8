"""Fill-in-middle against the token pattern itself, and read back."""

import random
import re

import pytest
from pyspark.sql import types as T

from batchloom.llm import fill_middle as fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_cuts_are_token_ends():
    r = random.Random(3)
    for k in range(2000):
        text = "".join(r.choice("ab é\n\t日  ") for _ in range(r.randrange(40)))
        tokens, raw = TOKEN.findall(text), text.encode()
        h = fim.draws(k)
        n, a, b = fim.cut(raw, h[0], h[1])
        x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        assert (n, raw[:a].decode(), raw[:b].decode()) == (len(tokens), "".join(tokens[:x]), "".join(tokens[:y]))


@pytest.mark.parametrize("rate", [0, 50, 100])
def test_every_case_is_read_back(spark, rate):
    texts = [None, "", " ", "one", "a b  c\n", "has <M> inside", "<P><S>", "é" * 5000 + " 日本 語", "x y " * 200_000, "same words here", "same words here"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("form", T.StringType()), T.StructField("id", T.LongType())])
    docs = spark.createDataFrame([(None if k == 3 else min(k, 9), t, "clash", k) for k, t in enumerate(texts)], schema)
    rows = fim.transform(docs, rate=rate).collect()
    assert sorted(r["restored"] for r in rows) == sorted((t or "").encode() for t in texts)
    for r in rows:
        text = bytes(r["restored"]).decode()
        assert r["n"] == len(TOKEN.findall(text))
        marked = not text or any(m in text for m in ("<P>", "<S>", "<M>"))
        assert (r["form"] == "plain") == (marked or fim.draws(r["doc_id"])[2] % 100 >= rate)
        if r["form"] == "plain":
            assert r["prefix_chars"] is None and r["middle_chars"] is None and r["output"] == r["restored"]
        else:
            h = fim.draws(r["doc_id"])
            x, y = sorted((h[0] % (r["n"] + 1), h[1] % (r["n"] + 1)))
            tokens = TOKEN.findall(text)
            p, m, s = ("".join(q) for q in (tokens[:x], tokens[x:y], tokens[y:]))
            assert (len(p), len(m)) == (r["prefix_chars"], r["middle_chars"])
            assert bytes(r["output"]).decode() == ("<P>" + p + "<S>" + s + "<M>" + m if r["form"] == "psm" else "<S>" + s + "<P>" + p + "<M>" + m)


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id string, text string")).collect() == []
