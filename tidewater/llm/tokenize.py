"""Problem 7: encoding whole texts with a public byte-level BPE tokenizer.

Texts are encoded in Arrow batches in one scan, without a shuffle. A long text is
cut into pieces that are encoded in parallel by the task's threads and put
together again by tree concatenation; it has to fit in a row anyway, so it is
never sent over the network for that.

Cuts are made where the tokenizer's own splitting pattern ends a word; there the
ids of both sides simply follow each other. A word that is longer than a piece
(a long unsplit run) is halved between any two characters, and the join is
repaired: the last tokens of the left and the first of the right half are
re-encoded as one run, in a window that grows until the new tokens agree with
the old ones at both ends. Agreement is exact, not
likely: a sequence of BPE tokens is the encoding of its bytes if and only if
every two neighbours are the encoding of theirs, so joining the window back is
right when the pairs at both of its edges are.

Edge cases: null and empty texts have no ids, an empty list; special tokens
written in a text are ordinary text; unpaired surrogates can't occur in a
Spark string; rows with the same id are encoded each for itself.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kept import kept

FOLDER = os.environ.get("TIDEWATER_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a piece of a long text, and of a run that is halved.
PIECE, RUN = 65_536, 4_096
#: Threads that encode the pieces of one long text.
THREADS = 4

#: Kinds of pieces: whole words, and the first and later parts of one long word.
WORDS, FIRST, LATER = 0, 1, 2


def encoder(file: str):
    """tiktoken encoding of a rank file; made once per Python worker."""
    return kept(("encoder", file), lambda: _encoder(file))


def _encoder(file: str):
    import tiktoken

    with open(file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(file), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int) -> list[tuple[str, int]]:
    """``text`` cut into (piece, kind). Pieces of whole words have about ``size``
    characters; a word longer than that is cut every ``size`` characters.

    Words end where the splitting pattern ends them in the full text. A cut
    there is safe if the character before is no white space or the one after is
    some: then both sides split alone as they do together. The one other case,
    a single white space before a long word, gets a piece of its own."""
    import regex

    out, start = [], 0

    def close(end: int) -> None:
        nonlocal start
        if end > start:
            out.append((text[start:end], WORDS))
        start = end

    for m in regex.finditer(PATTERN, text):
        a, b = m.span()
        safe = a > 0 and (not _space(text[a - 1]) or _space(text[a]))
        if b - a > size:
            if a > 0 and not safe:
                close(a - 1)
            close(a)
            out += [(text[k : min(k + size, b)], FIRST if k == a else LATER) for k in range(a, b, size)]
            start = b
        elif safe and a - start >= size:
            close(a)
    close(len(text))
    return out


def _space(char: str) -> bool:
    import regex

    return bool(regex.match(r"\s", char))


def joined(left: list[int], right: list[int], file: str) -> list[int]:
    """Ids of two parts of one word, exactly as the whole is encoded."""
    if not left or not right:
        return left + right
    enc, window = encoder(file), 4

    def agree(a: int, b: int) -> bool:
        return _word(enc, enc.decode_bytes([a, b])) == [a, b]

    while True:
        i, j = max(0, len(left) - window), min(len(right), window)
        middle = _word(enc, enc.decode_bytes(left[i:] + right[:j]))
        if (i == 0 or agree(left[i - 1], middle[0])) and (j == len(right) or agree(middle[-1], right[j])):
            return left[:i] + middle + right[j:]
        window *= 2


def _word(enc, data: bytes) -> list[int]:
    """BPE of the bytes as one word; they need not be whole characters."""
    return enc._encode_single_piece(data)


def _run_ids(run: str, file: str) -> list[int]:
    """Ids of a part of one word. Where the splitting pattern leaves the part
    whole it goes through the call that lets other threads run."""
    import regex

    if not run.startswith("'") and regex.fullmatch(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+", run):
        return encoder(file).encode_ordinary(run)
    return _word(encoder(file), run.encode("utf-8"))


def word_ids(text: str, file: str, size: int = RUN) -> list[int]:
    """Ids of one unsplit word, by halving it down to ``size`` characters."""
    if len(text) <= size:
        return _run_ids(text, file)
    half = len(text) // 2
    return joined(word_ids(text[:half], file, size), word_ids(text[half:], file, size), file)


def concatenated(parts: list[tuple[int, list[int]]], file: str) -> list[int]:
    """Ids of a text from the (kind, ids) of its pieces in order. The parts of a
    long word are joined as a tree, pair by pair; other pieces just follow."""
    out: list[int] = []
    k = 0
    while k < len(parts):
        word = [parts[k][1]]
        k += 1
        while k < len(parts) and parts[k][0] == LATER:
            word.append(parts[k][1])
            k += 1
        while len(word) > 1:
            pairs = [joined(word[i], word[i + 1], file) for i in range(0, len(word) - 1, 2)]
            word = pairs + word[len(pairs) * 2 :]
        out += word[0]
    return out


def text_ids(text: str | None, file: str, run: int = RUN, piece: int = PIECE) -> list[int]:
    """Ids of a text. Words longer than ``run`` characters are halved; a text of
    more than two pieces is encoded piece by piece in parallel."""
    import regex

    if not text:
        return []
    if len(text) > 2 * piece:
        from concurrent.futures import ThreadPoolExecutor

        cuts = pieces(text, piece)
        one = lambda c: (c[1], word_ids(c[0], file, run) if c[1] else text_ids(c[0], file, run, len(c[0])))
        with ThreadPoolExecutor(THREADS) as pool:
            return concatenated(list(pool.map(one, cuts)), file)
    if len(text) > run and regex.search(rf"\S{{{run}}}|\s{{{run}}}", text):
        parts = [(kind, word_ids(p, file, run) if kind else encoder(file).encode_ordinary(p)) for p, kind in pieces(text, run)]
        return concatenated(parts, file)
    return encoder(file).encode_ordinary(text)


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", file: str | None = None, piece: int = PIECE) -> DataFrame:
    """(key, ids array<int>) for every row of ``docs``."""
    file = file or f"{FOLDER}/{BYTE_BPE}"
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        want = pa.list_(pa.int32())
        for b in batches:
            ids = [text_ids(t, file, piece=piece) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, want)], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(encode, schema)


def texts(tokens: DataFrame, key: str = "doc_id", ids: str = "ids", file: str | None = None) -> DataFrame:
    """(key, text) of encoded texts: the inverse of ``token_ids``, with the empty
    text for null ones."""
    file = file or f"{FOLDER}/{BYTE_BPE}"
    schema = T.StructType([T.StructField(key, tokens.schema[key].dataType), T.StructField("text", T.StringType())])

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = [encoder(file).decode_bytes(i or []).decode("utf-8") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return tokens.select(key, ids).mapInArrow(decode, schema)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", file: str | None = None) -> DataFrame:
    """(key, n_tokens): sizes in tokens; ids are dropped where they are made."""
    return token_ids(docs, key, text, file).select(key, F.size("ids").alias("n_tokens"))
