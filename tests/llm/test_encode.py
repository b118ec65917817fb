import random

from hypothesis import given, settings
from hypothesis import strategies as st

from boardloom.llm.encode import Reuse, cuts, default_path, encode, encoder, lengths, safe_places

PATH = default_path()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the rail ", "don't ", "世界", "é", "  ", "\n\n", "\t", "abc123", "<|endoftext|>", "😀", "\xa0", "'s", "0" * 40, "=+/-", "x" * 70, "\u200b"]), max_size=160).map("".join))
def test_exact(text):
    assert Reuse(PATH).encode(text) == encoder(PATH)[0].encode_ordinary(text)


def test_against_the_other_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", "It's 3.5 V, isn't it?", "<|endoftext|> as text", "日本語のテキスト。" * 40, "x" * 3000, "a\r\nb\u2028c"]
    assert [Reuse(PATH).encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_shared_passages_are_encoded_once():
    shared = "".join(f"Sentence {n} says something about rail {n * 7}. " for n in range(400))
    r = Reuse(PATH)
    for k in range(5):
        r.encode(f"Own start {k}. " + shared + f" own end {k}")
    assert r.reused > 3.5 * len(shared) and r.encoded < 1.6 * len(shared)


def test_joins_are_repaired():
    r = Reuse(PATH)
    r0 = random.Random(1)
    text = "".join(chr(r0.randint(0x4E00, 0x9FFF)) for _ in range(9000)) + " and " + "".join(chr(r0.randint(0x4E00, 0x9FFF)) for _ in range(3000))
    assert r.encode(text) == encoder(PATH)[0].encode_ordinary(text) and r.repairs > 0


def test_cuts_depend_on_content():
    import numpy as np

    body = "".join(f"alpha {n} beta {n * n} " for n in range(600)).encode()
    a, b = np.frombuffer(b"short start " + body, np.uint8), np.frombuffer(b"a rather longer opening of it " + body, np.uint8)
    x, y = set((cuts(a, safe_places(a)) - 12).tolist()), set((cuts(b, safe_places(b)) - 30).tolist())
    assert len(x & y) > 0.9 * len(x)


def test_operator(spark):
    df = spark.createDataFrame([(1, "hello world", 1), (2, "", 1), (3, None, 1), (1, "hello world", 1), (None, "x", 1)], "id long, text string, ids int")
    got = [(r["id"], list(r["ids"])) for r in encode(df, "id", "text").collect()]
    assert sorted(got, key=str) == sorted([(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, []), (None, [87])], key=str)
    assert encode(df.limit(0), "id", "text").count() == 0
    assert sorted(r["tokens"] for r in lengths(df, "id", "text").collect()) == [0, 0, 1, 2, 2]
