import random

import pytest
from tokenizers import Tokenizer

from lumiframe.llm import bpe, queries

TEXTS = ["", " ", "aaaaaaa aaa", "<|endoftext|>hi<|endoftext|>  x\n\n y", "don't we'll ’s I'M 'S", "  　 \x1c\x1d \u0085z​q", "日本語 ½ ²３ Ⅷ é́ 🙂🙂", "\n \n", "a" * 3000, " " * 2000, "<|endoftext", "x<|endoftext|>", "�\u0000"]


def test_against_the_library():
    t = Tokenizer.from_file(queries.tokenizer())
    rng = random.Random(5)
    alphabet = "abcdeéß \n\t'’.,!?0123½日🙂<|>ABC"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(500)]
    encoder = bpe.Encoder(bpe.Vocabulary(queries.tokenizer()))
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert encoder(texts) == want
    encoder.known.clear()
    assert [encoder([x])[0] for x in texts] == want


def test_round_trip(spark):
    t = Tokenizer.from_file(queries.tokenizer())
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(None, None), (3, "twice"), (3, "twice"), (4, "word " * 60000)]
    docs = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, decoded string")
    out = bpe.decode(bpe.encode(docs, queries.tokenizer()), queries.tokenizer()).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["decoded"] == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), queries.tokenizer()).count() == 0


def test_decoding_odd_ids(spark):
    v = bpe.Vocabulary(queries.tokenizer())
    rows = [(1, [220, -5, 10**6, None, 50256]), (2, None), (3, []), (4, [v.byte_ids[0xC3]])]
    out = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), queries.tokenizer()).orderBy("doc_id").collect()
    assert [r["decoded"] for r in out] == [" <|endoftext|>", "", "", "�"]


def test_merges_of_a_small_vocabulary(tmp_path):
    import json

    pytest.importorskip("tokenizers")
    chars = bpe.byte_symbols()
    vocab = {c: i for i, c in enumerate(chars)}
    merges = ["b c", "a b", "ab c", "a a", "aa a"]
    for m in merges:
        vocab.setdefault(m.replace(" ", ""), len(vocab))
    pre = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    d = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": pre, "post_processor": None, "decoder": pre, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges}}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(d))
    t, e = Tokenizer.from_file(str(path)), bpe.Encoder(bpe.Vocabulary(str(path)))
    rng = random.Random(1)
    for _ in range(400):
        x = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 14)))
        assert e([x])[0] == t.encode(x, add_special_tokens=False).ids


def test_files_that_ask_for_more_are_refused(tmp_path):
    import json

    import pytest

    vocab = {s: i for i, s in enumerate([*bpe.byte_symbols(), "ab", "abc", "bc"])}
    good = {"added_tokens": [], "normalizer": None, "model": {"type": "BPE", "vocab": vocab, "merges": ["a b", "ab c"]}}
    put = lambda d: (path := tmp_path / "t.json").write_text(json.dumps(d)) and str(path)
    assert bpe.Vocabulary(put(good)).size == len(vocab)
    for change in ({"normalizer": {"type": "NFC"}}, {"model": good["model"] | {"ignore_merges": True}}, {"model": good["model"] | {"merges": ["a b", "b c", "ab c", "a bc"]}}, {"added_tokens": [{"id": 400, "content": "<x>", "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.Vocabulary(put(good | change))
