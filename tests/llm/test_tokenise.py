import base64
import os
import random

import pytest

from methyloom.llm import tokenise as tk

pytestmark = pytest.mark.skipif(not os.path.exists(tk.VOCABULARY), reason="no vocabulary file here")


def texts():
    rnd = random.Random(1)
    odd = ["", None, " ", "\n\n  x  \t y'll <|endoftext|>", "\x1c\x1d \x85 ​", "\x00", "é", "👩‍🔬🇺🇳", "ＡＢ 12345678", "a" * 30_000, "你" * 9_000, " " * 5_000]
    return odd + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0, 0x3000), rnd.randrange(0x10000, 0x1FFFF)])) for _ in range(150)) for _ in range(200)]


def test_equals_the_reference_encoder(spark):
    import tiktoken

    with open(tk.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {r.doc_id: r.ids for r in tk.encode(df, "text", ["doc_id"]).collect()}
    assert ids == {i: own.encode_ordinary(t) if t else [] for i, t in rows}
    counts = {r.doc_id: r.n_tokens for r in tk.count_tokens(df, "text", ["doc_id"]).collect()}
    assert counts == {i: len(x) for i, x in ids.items()}


def test_round_trip(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    back = {r.doc_id: r.text for r in tk.decode(tk.encode(df, "text", ["doc_id"]), "ids", ["doc_id"]).collect()}
    assert back == {i: t or "" for i, t in rows}


def test_forgetting_changes_nothing(monkeypatch):
    model = tk.serialise(tk.read_vocabulary())
    want = [list(tk.Encoder(model).encode(t)) for t in texts()]
    monkeypatch.setattr(tk, "_CACHED_PIECES", 3)
    small = tk.Encoder(model)
    assert [list(small.encode(t)) for t in texts()] == want and len(small) <= 3


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tk.encode(df, "text", ["doc_id"]).collect() == []
    odd = spark.createDataFrame([(1, "a b", [7], None)], "`doc id` long, text string, x array<int>, y string")
    r = tk.encode(odd, "text", ["doc id", "x", "text", "y"]).first()
    assert (r["doc id"], r.x, r.text, r.y, len(r.ids)) == (1, [7], "a b", None, 2)
