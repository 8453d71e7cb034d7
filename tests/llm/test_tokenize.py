import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm import tokenize as tk

FILE = f"{tk.FOLDER}/{tk.BYTE_BPE}"


def whole(text):
    return tk.encoder(FILE).encode_ordinary(text)


ALPHABET = "ab e'st\n\t  1!.,é字กि  \U0001f600-"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=120), st.integers(1, 12))
def test_pieces_and_joins_give_the_ids_of_the_whole(text, size):
    cuts = tk.pieces(text, size)
    assert "".join(p for p, _ in cuts) == text
    parts = [(k, tk.word_ids(p, FILE, 3) if k else tk.encoder(FILE).encode_ordinary(p)) for p, k in cuts]
    assert tk.concatenated(parts, FILE) == whole(text)
    assert tk.text_ids(text, FILE, size) == whole(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60), st.integers(1, 5))
def test_any_characters(text, size):
    text = text.encode("utf-8", "ignore").decode()
    assert tk.text_ids(text, FILE, size) == whole(text)


@pytest.mark.parametrize("text", ["a" * 30_000, "the cat" * 3_000, "ab" * 9_000 + " tail\n\n" + "=" * 20_000, "x\n\n" + "é" * 9_000, " " * 20_000 + "a", "字" * 12_000])
def test_long_words(text):
    assert tk.text_ids(text, FILE, 512) == whole(text)


def test_same_ids_as_the_json_vocabulary():
    t = Tokenizer.from_file(f"{tk.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ["Hello  world's\n\n  <|endoftext|> 12,5 €", "Привет, мир! 你好。", "​ก็ नमस्ते \r\n x"]:
        assert tk.text_ids(text, FILE) == t.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    long = "word " * 5_000 + "z" * 9_000 + "\n\nq" * 3_000
    rows = [(1, "plain text"), (2, None), (3, ""), (4, long), (4, long), (5, "   "), (None, "no id"), (6, "y" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as ids", "1 as row", "2 as kind")
    got = sorted(((r.doc_id or 0, tuple(r.ids)) for r in tk.token_ids(df, piece=1_000).collect()))
    assert got == sorted((k or 0, tuple(whole(t or ""))) for k, t in rows)
    counts = tk.token_counts(df.limit(0)).collect()
    assert counts == []
