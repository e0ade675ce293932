import random

import public_tokenizers
import sentencepiece

from textbayes.llm.sentencepieces import Normalizer, Pieces, Segmenter, _fields, mapped
from tests.llm import plain


def rule(name):
    """A public character map and the library's own normalizer with it."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=name, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=True)
    spec = next(v for n, v in _fields(library.serialized_model_proto()) if n == 3)
    return dict(_fields(spec)).get(2, b""), library


def test_normalization_against_the_library():
    rnd = random.Random(5)
    odd = [t for t in plain.ODD if t and "\0" not in t and len(t) < 3000] + ["  ﬁ  ½ Ａ　b  ", "e\u0301 \u1100\u1161 Ⅷ ㌔", "ＡＢＣ①②③", "\u200b \u00a0x\u3000"]
    odd += ["".join(chr(rnd.choice([rnd.randrange(32, 0x250), rnd.randrange(0x300, 0x1200), rnd.randrange(0x2000, 0x2800), rnd.randrange(0x3000, 0xD7A0), rnd.randrange(0xF900, 0xFFF0)])) for _ in range(60)) for _ in range(200)]
    for name in ("nmt_nfkc", "nfkc_cf"):
        charmap, library = rule(name)
        own = Normalizer(charmap, True, [])
        assert len(mapped(charmap)) > 1000
        assert [own(t.encode()).decode() for t in odd] == [library.normalize(t) for t in odd]


def test_models_with_normalization():
    """A model with pieces of a file and a character map: texts that normalize alike have the same ids; user-defined pieces stay."""
    pieces = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    plain_ids = Segmenter(pieces).encode([b"file 12 times"])[0].tolist()
    pieces.normalizer = Normalizer(rule("nmt_nfkc")[0], True, [])
    segmenter = Segmenter(pieces)
    assert [x.tolist() for x in segmenter.encode(["  ﬁle １２\u3000times ".encode(), b"", b"   "])] == [plain_ids, [], []]
    assert segmenter.decode(plain_ids) == b"file 12 times"
    assert Normalizer(rule("nmt_nfkc")[0], False, ["Ⅷx".encode()])("a Ⅷx  Ⅷ".encode()).decode() == "a Ⅷx  VIII"
