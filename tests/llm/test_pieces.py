"""The transducer against the public library, and unigram paths against all segmentations."""

import itertools
import random
import struct

import numpy as np
import pytest
import sentencepiece

from millrace.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
HARD = ["", " ", "  ", "a", " a", "a  b", "a \n b", "\n", "\n\n x", "x\n", "x \n", "▁a▁", "日本語 🦙 é", "\x00a", "a\tb\r\n", "aaaa" * 50, " " * 70 + "x", "<s></s><unk>", "<0x0A>", "x" * 3000, "....!!!!", "ß" * 9]


@pytest.fixture(scope="module")
def both():
    with open(MODEL, "rb") as f:
        return pieces.Codec(f.read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(codec, text):
    return np.frombuffer(codec.encode(text), dtype="<i4").tolist()


def test_hard_texts(both):
    codec, library = both
    for t in HARD:
        assert ids(codec, t) == library.encode(t), t
        assert codec.decode(np.array(library.encode(t), dtype=np.int32)) == library.decode(library.encode(t))


def test_random_texts(both):
    codec, library = both
    rng = random.Random(5)
    for _ in range(1500):
        t = "".join(rng.choice("aeinrst  \n.,TheéüßйあA0123456789-_()=▁") for _ in range(rng.randint(1, 60)))
        assert ids(codec, t) == library.encode(t), t


def test_documents(both, spark, small):
    codec, library = both
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = pieces.encode_documents(docs, MODEL).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.exact


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3, value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3 | 2]) + varint(len(value)) + value
    return out


SCORED = {"▁": -3.0, "a": -2.5, "b": -2.0, "c": -2.75, "ab": -3.25, "▁a": -2.125, "ba": -4.75, "aba": -5.5, "▁ab": -6.0, "fi": -4.0, "f": -5.0, "i": -5.25, "A": -3.5, ".": -6.5}
MERGED = {p: -float(i) for i, p in enumerate(["ab", "▁a", "▁ab", "ba", "fi", "aba", "▁ba", "a", "b", "▁", "c", "f", "i", "A", "."])}


@pytest.mark.parametrize("kind,scores", [(1, SCORED), (2, MERGED)])
@pytest.mark.parametrize("squeeze,prefix", [(0, 1), (1, 1), (1, 0), (0, 0)])
@pytest.mark.parametrize("rule", ["", "nmt_nfkc"])
@pytest.mark.parametrize("user", [(), ("[x]", "ab.")])
@pytest.mark.parametrize("has_bytes", [False, True])
def test_models_of_all_kinds(kind, scores, squeeze, prefix, rule, user, has_bytes):
    """Character maps, squeezed white space, user-defined pieces and byte fallback, against the public library."""
    blob = b""
    if rule:
        proto = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        blob = dict(pieces._fields(dict(pieces._fields(proto))[3]))[2]
    entries = [message((1, b"<unk>"), (2, 0.0), (3, 2))] + [message((1, p.encode()), (2, s)) for p, s in scores.items()] + [message((1, u.encode()), (2, 0.0), (3, 4)) for u in user]
    entries += [message((1, f"<0x{i:02X}>".encode()), (2, 0.0), (3, 6)) for i in range(256)] if has_bytes else []
    trainer = message((3, kind)) + (b"\x98\x02\x01" if has_bytes else b"")
    model = b"".join(message((1, e)) for e in entries) + message((2, trainer), (3, message((1, b"x"), (2, blob), (3, prefix), (4, squeeze))))
    codec, library = pieces.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(kind)
    texts = ["", " ", "  a", "a  ", "ａ ﬁ\tb", "[x]ab.[x] ab", "日本", "a\u00a0b", "\n a\n", "…", "é日a"] + ["".join(rng.choice("aab bcﬁ .[x]Ａ日\n") for _ in range(rng.randint(1, 25))) for _ in range(60)]
    for t in texts:
        want, got = library.encode(t), ids(codec, t)
        if kind == 1 and got != want:  # paths of equal weight
            weigh = lambda path: sum(scores.get(library.id_to_piece(i), -99.0) for i in path)
            assert "".join(map(library.id_to_piece, got)) == "".join(map(library.id_to_piece, want)) and weigh(got) == pytest.approx(weigh(want)), t
        else:
            assert got == want, t


def test_very_long_text(both):
    codec, library = both
    t = "".join(random.Random(3).choice("abc de\n") for _ in range(1_200_000))
    assert ids(codec, t) == library.encode(t)


def test_unigram_path_is_the_lightest():
    scores = {"▁": -3.0, "a": -2.5, "b": -2.0, "ab": -3.25, "▁a": -2.0, "ba": -4.75, "aba": -5.5, "▁ab": -6.0}
    model = message((1, message((1, b"<unk>"), (2, 0.0), (3, 2))), *((1, message((1, p.encode()), (2, s))) for p, s in scores.items()), (2, message((3, 1))), (3, message((3, 1), (4, 0))))
    codec = pieces.Codec(model)
    names = ["<unk>", *scores]
    for n in range(1, 7):
        for t in itertools.product("ab", repeat=n):
            text = "▁" + "".join(t)
            every = [[text[a:b] for a, b in itertools.pairwise((0, *cut, len(text)))] for k in range(len(text)) for cut in itertools.combinations(range(1, len(text)), k)]
            least = min(-sum(scores[p] for p in path) for path in every if all(p in scores for p in path))
            got = [names[i] for i in ids(codec, "".join(t))]
            assert "".join(got) == text and -sum(scores[p] for p in got) == pytest.approx(least)


def test_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "x y")], "doc_id long, text string").selectExpr("*", "1 AS ids")
    got = pieces.encode_documents(df, MODEL)
    assert sorted(r.n_tokens for r in got.collect()) == [0, 0, 0, 2]
    assert pieces.encode_documents(df.limit(0), MODEL).collect() == []
