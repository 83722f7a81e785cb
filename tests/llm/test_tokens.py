import random

import pytest

from packetlens.llm import tokens

PATH = tokens.vocabulary_path()
TEXTS = [
    None, "", " ", "\n\n", "Hello world", "<|endoftext|> don't we'll I'VE", "  two  blanks\t\ttabs \r\n", "naïve Ünïcode 中文 字符 🙂🙃", "a" * 5000,
    "x1 22 333 ½ ² ٣", " nbsp thin​zero", "\x00\x1c\x1f\x85 ctl", "▁piece", "'s 't ' s", "é" * 300 + "!" * 70,
]


@pytest.fixture(scope="module")
def other():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {t: i for i, t in enumerate(tokens.load_vocabulary(PATH))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_another_library(other):
    coder = tokens.Encoder(PATH)
    rnd = random.Random(5)
    alphabet = "abcdeXYZ 019.,'\n\té中🙂-_"
    texts = TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 120))) for _ in range(300)]
    for text, ids in zip(texts, coder.encode_many(texts)):
        assert ids == (other.encode_ordinary(text) if text else [])
        assert coder.decode(ids) == (text or "")
        assert coder.encode(text) == ids


def test_ascii_texts_are_cut_as_others():
    regex = pytest.importorskip("regex")
    coder = tokens.Encoder(PATH)
    assert coder.encode("a\n\n\x1d{") == [64, 198, 198, 217, 90]
    rnd = random.Random(6)
    alphabet = "aZ0'{ \t\n\r\f\v\x00\x1b\x1c\x1d\x1e\x1f\x7f"
    for _ in range(2000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 30)))
        assert coder.cut_ascii(text) == regex.findall(tokens.PATTERN, text)


def test_json_vocabulary_agrees():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [x for x in TEXTS if x]
    got = tokens.Encoder(PATH).encode_many(texts)
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_frames(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rows = tokens.encode_texts(df, text="text", keep=["doc_id"]).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == tokens.Encoder(PATH).encode_many(TEXTS)
    sizes = tokens.count_tokens(df, text="text", keep=["doc_id"]).orderBy("doc_id").collect()
    assert [r.n_tokens for r in sizes] == [len(r.ids) for r in rows]
    assert tokens.encode_texts(df.limit(0), text="text", keep=["doc_id"]).count() == 0


def test_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_SIZE", 3)
    coder = tokens.Encoder(PATH)
    for _ in range(2):
        assert coder.decode(coder.encode("one two three four five six")) == "one two three four five six"
        coder.encode("seven")
