import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")
from lexmill.llm import common as C  # noqa: E402
from lexmill.llm import token_store as S  # noqa: E402

TEXTS = ["", " ", "a", "a  b", "a \nb", "a\n \nb", "Hello, world.\nNew line", "x y z", "tab\tand space ", "\nlead", "don't <|endoftext|> stop", "É é ́x", "line\n\nline", "ÜBER straße 12 345", "a b c", "x" * 5000, "one, two. three.. four., five's. six,\nseven.\nEight \x01, é, ü. a,", "3,000. 4.", "thre*** of%%% Été, straße. ﬁx İstanbul, ΣΑΣ. naïve's x_y_ ñ—a «b» Ǆ, ŉ", "\nStart\nof_line, \x01x"]


@pytest.mark.parametrize(("file", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_equals_library(file, kind):
    path = public_tokenizers.path(file)
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    enc = S.Encoder(path, kind)
    for t in TEXTS * 2:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize(("file", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_pieces_give_the_ids_of_whole_texts(file, kind, monkeypatch):
    import random

    monkeypatch.setattr(S, "CACHE", 50)
    enc, rng = S.Encoder(public_tokenizers.path(file), kind), random.Random(2)
    tokens = [t.replace("</w>", "") for t in enc.tok.get_vocab() if t.isascii()]
    space = [" ", " ", " ", "  ", "   ", "\n", "\n\n", " \n", "\n ", "\t", "\u00a0", "\x1c", "\u0301", "'s ", "\u2028", "\x85", "\u3000 "]
    texts = ["".join(rng.choice(tokens) + rng.choice(space) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    for at in range(0, 3000, 100):
        assert enc.encode_all(texts[at : at + 100]) == [enc.library(t) for t in texts[at : at + 100]]


#: Every character that Python or the libraries take for white space.
WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["\u200b", "\u180e", "\ufeff", "\0"]


@pytest.mark.parametrize(("file", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_white_space_alone_first_last_and_between(file, kind):
    enc = S.Encoder(public_tokenizers.path(file), kind)
    for w in WHITE:
        for near in (["a normal text", w, "another"], ["b", w], [w, "c"], [f"{w}a", f"a{w}", f"a{w}b", f" {w}", f"{w} ", f"a {w} b", f"a{w}{w} b"], [w * 3, f"x, {w}y", f"\n{w}", f"{w}\n"]):
            enc.clear()
            want = [enc.library(t) for t in near]
            assert enc.encode_all(near) == want == enc.encode_all(near), repr(w)


def test_a_lost_mark_is_noticed(monkeypatch):
    """Even pieces that ate a mark would be encoded alone."""
    enc = S.Encoder(public_tokenizers.path("byte_bpe_50k.json"), "byte")
    enc.between = " "  # so that no mark is found
    texts = ["one two", "three four"]
    assert enc.encode_all(texts) == [enc.library(t) for t in texts]


def test_mph_is_minimal_and_perfect():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    f = S.Mph.build(keys)
    assert sorted(f.slots(keys).tolist()) == list(range(5000))
    assert len(S.Mph.build(keys[:0]).slots(keys)) == 5000
    with pytest.raises(ValueError, match="distinct"):
        S.Mph.build(keys[[0, 1, 0]])


def test_round_trip(spark):
    rows = [(5, "b a"), (None, "null id"), (-3, None), (5, "a"), (5, "a"), (7, "")] + [(100 + i, "word " * i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    root = C.new_path(spark, "t")
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = S.write_store(docs, root, path, "word", 2, shard_bytes=400)
    got = [tuple(r) for r in S.read_store(manifest).orderBy("start").collect()]
    tok = Tokenizer.from_file(path)
    want, start = [], 0
    hashed = {r.text: r.h for r in docs.selectExpr("coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").collect()}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1] or ""])):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    shard = S.Shard([r.path for r in manifest.orderBy("shard").collect()][-1])
    assert shard.ids(129)[0].tolist() == [*tok.encode("word " * 29, add_special_tokens=False).ids, 2]
    assert shard.ids(10**12) == []
    asked = spark.createDataFrame([(5,), (5,), (-3,), (None,), (120,), (77,), (10**12,)], "doc_id long")
    assert sorted(map(tuple, S.lookup(asked, manifest).collect())) == sorted(w for w in want if w[0] in (5, -3, 120))


def test_a_key_of_many_rows_is_spread_and_null_is_no_key(spark):
    null = 0x6E756C6C6E756C6C
    rows = [(7, f"text {k} " * 20) for k in range(200)] + [(None, "none"), (null, "a key as any"), (-(2**63), "least"), (2**63 - 1, "greatest")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, shard string, h int").repartition(4)
    manifest = S.write_store(docs, C.new_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json"), "word", 2, shard_bytes=4000)
    m = manifest.orderBy("shard").collect()
    assert sum(r.least <= 7 <= r.greatest for r in m if r.least is not None) > 2 and sum(r.n_null for r in m) == 1
    got = [tuple(r) for r in S.read_store(manifest).orderBy("start").collect()]
    assert [g[0] for g in got] == [None, -(2**63), *[7] * 200, null, 2**63 - 1]
    assert [g[1] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    assert S.lookup(docs, manifest).count() == 203


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.read_store(S.write_store(docs, C.new_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json"), "word", 2)).count() == 0


@pytest.mark.parametrize(("file", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_the_library_gets_few_pieces_at_a_time_and_plain_words_go_to_the_model(file, kind, monkeypatch):
    enc, given = S.Encoder(public_tokenizers.path(file), kind), []

    class Spy:
        def __init__(self, tok):
            self.tok = tok

        def encode_batch_fast(self, texts, **how):
            given.append(texts[0].count(enc.mark))
            return self.tok.encode_batch_fast(texts, **how)

        def encode_batch(self, texts, **how):
            return self.tok.encode_batch(texts, **how)

    whole = Tokenizer.from_file(public_tokenizers.path(file))
    enc.tok = Spy(enc.tok)
    monkeypatch.setattr(S, "NEW", 4)
    text = "Größe ÀÉ ñu µm ªb straße É×É a1 b2 c3 d4 e5 f6 Ünïcode xÿz ﬁn ſo"
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert given and max(given) <= 4


def byte_encoder():
    return S.encoder(public_tokenizers.path("byte_bpe_50k.json"), "byte")


def whole(enc, texts):
    """Ids of whole texts by the library, and each text's number."""
    each = [x.ids for x in enc.rest.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    return [i for x in each for i in x], [len(x) for x in each]


def test_columns_are_cut_where_the_pre_tokenizer_cuts():
    import itertools
    import random

    import pyarrow as pa

    enc, rng = byte_encoder(), random.Random(4)
    assert isinstance(enc, S.ByteEncoder)
    kinds = ["a", "s", "1", ".", "'", " ", "\n", "\t", "é", "×", " ", "　", "中", "́"]
    texts = ["".join(x) for n in range(5) for x in itertools.product(kinds, repeat=n)]
    texts += ["".join(rng.choice(kinds) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [*TEXTS, *(x for w in WHITE for x in (w, f"a{w}", f"{w}a", f"a{w}b", f"a {w}b", f"a{w} b", f"\n{w}\na", f"{w}{w}'s")), None]
    letters = [chr(c) for c in (*range(0x80, 0x530), *range(0x900, 0x930), 0x1E9E, 0xFB01, 0x1F600)]
    texts += [f"a{c}b {c}1{c} .{c}. {c}\n{c}'{c}{c}  {c}\n" for c in letters]
    rng.shuffle(texts)
    texts[5] = None
    want = whole(enc, texts)
    for column in (pa.array(texts), pa.array(["x y", *texts, "z"], pa.large_string()).slice(1, len(texts))):
        enc.clear()
        for _ in range(2):
            ids, n = enc.encode_column(column)
            assert n.tolist() == want[1] and ids.tolist() == want[0]
    for column in (pa.array([], pa.string()), pa.array([None, "", None], pa.string())):
        ids, n = enc.encode_column(column)
        assert len(ids) == 0 and n.tolist() == [0] * len(column)


def test_words_go_to_the_library_many_at_a_time_and_repeated_ones_are_kept(monkeypatch):
    import pyarrow as pa

    enc, given = byte_encoder(), []
    enc.clear()

    class Spy:
        def encode_batch_fast(self, texts, words=enc.words, **how):
            given.append(len(texts[0].split()))
            return words.encode_batch_fast(texts, **how)

    monkeypatch.setattr(enc, "words", Spy())
    monkeypatch.setattr(enc.rest, "library", None)
    monkeypatch.setattr(enc.rest, "encode_new", None)  # which plain words don't need
    text = " ".join(f"w{k}x, größe{k}." for k in range(900))
    first = enc.encode_column(pa.array([text, text]))
    assert len(given) == 1 and given[0] < 5000
    again = enc.encode_column(pa.array([text]))
    assert len(given) == 1 and again[0].tolist() == first[0][: len(again[0])].tolist()
    monkeypatch.setattr(S, "CACHE", 3)
    assert enc.encode_column(pa.array([text]))[0].tolist() == again[0].tolist() and len(given) == 2


def test_a_vocabulary_without_some_byte_is_noticed(monkeypatch):
    import pyarrow as pa

    enc = byte_encoder()
    enc.clear()
    monkeypatch.setattr(enc, "size", enc.size + 1)  # so that ids and pieces don't have the same bytes
    texts = ["one two", "three, four"]
    ids, n = enc.encode_column(pa.array(texts))
    assert (ids.tolist(), n.tolist()) == whole(enc, texts)
    enc.clear()


def test_pieces_met_again_stay_when_there_are_too_many(monkeypatch):
    import pyarrow as pa

    enc = byte_encoder()
    enc.clear()
    monkeypatch.setattr(S, "CACHE", 10)
    texts = ["aa bb aa bb", " ".join(f"x{k}" for k in "abcdefgh"), "cc bb. 'tis é×", "aa dd"]
    for t in texts * 3:
        ids, n = enc.encode_column(pa.array([t]))
        assert (ids.tolist(), n.tolist()) == whole(enc, [t])
        assert len(enc.known) == len(enc.length) == len(enc.met) and int(enc.length.sum()) == len(enc.ids)
    enc.clear()
    enc.encode_column(pa.array([" bb bb bb", " " + texts[1], " cc", " ee"]))
    assert len(enc.known) > 10
    enc.encode_column(pa.array([" dd"]))
    assert enc.known.to_pylist() == [b" bb", b" dd"]
    enc.clear()
