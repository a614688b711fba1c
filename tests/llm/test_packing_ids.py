"""The packed sequences can be rebuilt from the output alone."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from quillmine.llm import packing, queries


def test_sequences_hold_their_ids(spark, tmp_path):
    texts = ["some words of a text " * k for k in (1, 3, 1200, 7)] + ["", None]
    rows = [(min(i, 3), t) for i, t in enumerate(texts)]  # an id that repeats
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = Tokenizer.from_file(packing.default_tokenizer())
    want = [tuple(plain.encode(t or "", add_special_tokens=False).ids) + (packing.SEPARATOR,) for t in texts]
    want = sorted(t[a : a + packing.WINDOW] for t in want for a in range(0, len(t), packing.WINDOW))
    got = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert sorted(tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    digests = queries.QUERIES["op10_packing"](spark, str(tmp_path))
    assert digests.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(r.ids_crc32 for r in digests.collect()) == sorted(zlib.crc32(np.asarray(t, "<u4").tobytes()) for t in want)


def test_encoder_agrees_with_the_tokenizer():
    rng = np.random.default_rng(4)
    letters = [chr(c) for c in (*range(33, 127), *range(0xC0, 0x250), 0x130, 0x3A3, 0x301, 0x4E2D, 0x1F600)]
    words = ["".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(3000)]
    words += ["I'LL", "don't", "<|endoftext|>", "x<|startoftext|>y", "İx", "ΟΔΟΣ", "é", "a\x0bb", "\x00", "x" * 5000]
    encode = packing.Encoder(packing.default_tokenizer())
    assert encode.split is not None
    for text in [*words, " ".join(words), "a\n b\t\r c", ""]:
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_of_letters_are_one_part():
    """Finding on op10's time: words of ASCII letters skip the split, and ids stay those of the whole tokenizer."""
    from quillmine.llm import packing

    encoder = packing.Encoder(packing.default_tokenizer())
    assert encoder.whole
    for word in ("Plain", "startoftext", "it's", "x1y", "café", "<|endoftext|>", "a<|endoftext|>b", "Zz", "don'tell", "A-B"):
        assert np.frombuffer(encoder(word), "<u4").tolist() == encoder.tokenizer.encode(word, add_special_tokens=False).ids, word


def test_marks_after_letters_are_one_part():
    """letters with marks after them skip the split as well, and words are looked up without a pass for the new ones."""
    from quillmine.llm import packing

    encoder = packing.Encoder(packing.default_tokenizer())
    assert encoder.tailed
    encoder.split = None  # not needed for these
    for word in ("Plain,", "end.", "x!?", "A-", "word...\"", "a|>", "b[]{}", "Zz;=@`~"):
        assert packing.TAILED.fullmatch(word)
        assert np.frombuffer(encoder(f"{word} {word}"), "<u4").tolist() == encoder.tokenizer.encode(f"{word} {word}", add_special_tokens=False).ids, word
    assert not any(map(packing.TAILED.fullmatch, ("it's", "a<|endoftext|>", "x1", "1x", "a,b", "caf\u00e9")))
