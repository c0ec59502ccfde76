"""Small documents with nulls, empty, blank and long texts, copies, repeated rows, equal ids and columns that clash."""

import random

_rng = random.Random(11)
_syllables = "an ber ti on é lich the ou vi str a".split()


def _prose(n, rng=_rng):
    return " ".join("".join(rng.choice(_syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


_passage = _prose(60)
_long = _prose(9_000)
_base = [_prose(_rng.randint(5, 300)) for _ in range(40)]
_texts = _base + [
    None, None, "", "", " \t\n", "x", "one two", "12 34 !!", _long, _long + " end", _long, "a" * 900, "a" * 901 + "b" + "a" * 300,
    _passage, _prose(20) + _passage + _prose(20), _passage + _passage, "\0" * 150, "é" * 300 + _passage,
    'Password = "abcdefgh12" token=secret =longvalue1 SECRET: x', "AKIA" + "Q" * 12 + " " + "0123456789abcdef" * 3 + " api_key:'" + "ab" * 20,
    "<|endoftext|>Hi <|startoftext|> it's", _base[3], _base[3].upper(), _base[4] + " tail", "日本語 テキスト",
]
SCHEMA = "doc_id long, text string, lang string, source string, fp string, size int, key int, hash string, slot int, spans int, digest int"
DOCS = [
    (i, t, [None, "en", "de", "fr"][i % 4], [None, "s0", "s0", "s0", "Z", "é"][i % 6], "x", 1, None, "h", 2, 3, 4) for i, t in enumerate(_texts)
]
DOCS += [DOCS[2], DOCS[2], DOCS[0]]
DOCS += [(8, "another text of id eight", "en", "s0", "x", 1, None, "h", 2, 3, 4), (None, _base[7], "de", None, "x", 1, None, "h", 2, 3, 4), (None, None, None, None, *[None] * 7)]
