import random

import public_tokenizers

from sightline.llm.sentencepiece_codec import Codec, encode_decode

from .cases import empty_table, filler, odd_rows, odd_table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "  a  b\t c\n\x00 é 😀 <s> </s> ▁x", "▁", "\n\n a\n ", "   ", "ﬁ ½ Ａ", "x" * 300, " y" * 100, "<0x0A>", "a▁▁b", "日本語テキスト" * 30 + " z​q", "<unk>", "ab" * 4000]


def texts():
    rng = random.Random(0)
    return ODD + ["".join(rng.choice("aeit hn\n▁ éß日😀s,.") for _ in range(rng.randint(1, 120))) for _ in range(500)] + [filler(300, 9)]


def test_codec_is_the_library(monkeypatch):
    import sightline.llm.sentencepiece_codec as module

    monkeypatch.setattr(module, "REMEMBERED", 500)
    codec = Codec(MODEL)
    for start in range(0, len(texts()), 100):
        part = texts()[start : start + 100]
        ids, at, agreed = codec.encode(part)
        assert agreed.all()
        theirs = codec.library.encode(part, add_eos=True)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == theirs
        assert codec.decode(ids, at) == [codec.library.decode(x) for x in theirs]


def test_ids_that_come_from_no_text():
    import numpy as np

    codec = Codec(MODEL)
    ids = [200, 201, 2]
    assert codec.decode(np.array(ids), np.array([0, 3])) == [codec.library.decode(ids)]


def test_table(spark):
    library = Codec(MODEL).library
    rows = encode_decode(odd_table(spark), MODEL).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        want = library.encode(r.text or "", add_eos=True)
        assert r.ids == want and r.decoded == library.decode(want) and r.agreed
    assert encode_decode(empty_table(spark), MODEL).count() == 0
