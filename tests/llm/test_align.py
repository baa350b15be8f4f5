import hashlib
import random
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from sentencepiece import SentencePieceProcessor  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from lexmill.llm import align as A  # noqa: E402

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """Whole texts encoded as they are."""
    tok, sp, v = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1]), A.Vocabularies(*PATHS)
    tok.encode_special_tokens = True
    made, counts = [], Counter()
    for i, text in rows:
        groups = []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            if b"".join(v.a_bytes[x] for x in a) == b"".join(v.b_bytes[x] for x in b) == (" " + text).encode():
                at_a = at_b = 0
                mine = ([], [])
                a, b = list(a), list(b)
                while a or b:
                    if at_a <= at_b:
                        mine[0].append(a.pop(0))
                        at_a += len(v.a_bytes[mine[0][-1]])
                    else:
                        mine[1].append(b.pop(0))
                        at_b += len(v.b_bytes[mine[1][-1]])
                    if at_a == at_b:
                        groups.append(mine)
                        mine = ([], [])
        made.append((i, groups))
        counts.update((x[-1], y[-1]) for x, y in groups)
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for i, g in made:
        links = [(x[-1], y[-1]) for x, y in g]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(g), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "The", "antidisestablishment", "über", "straße", "x1", "don't", "12,345.6", "<s>", "<unk>", "<|endoftext|>", "<0x41>", "日本語", "😀", "é", "ﬁ", " ", "à ", "​", "\0", " b", "...", "_"]
    gaps = [" ", " ", " ", " ", "  ", "    ", "\n", " \n", "\n ", "\n\n ", "\t", " \t ", "  ", "  ", "\r\n", "\x1c ", "　 "]
    rows = []
    for i in range(150):
        n = rng.choice([1, 2, 5, 30])
        rows.append((i, rng.choice(["", "", " ", "  ", "\n", "\n "]) + "".join(rng.choice(words) + rng.choice(gaps if i % 3 else [" "]) for _ in range(n)) + rng.choice(["", "end"])))
    return [*rows, rows[1], (3, "another"), (None, "null id"), (200, None), (201, ""), (202, " "), (203, "   "), (204, "bad ▁ one"), (205, "a▁"), (206, "word " * 3000), (207, "n" * 3000), (208, "the")]


@pytest.mark.parametrize("chunk", [200, 6 << 20])
def test_equals_whole_texts(spark, chunk):
    rows = corpus(chunk)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, codes string, chunk int").repartition(3)
    assert sorted(map(tuple, A.align(df, *PATHS, chunk_bytes=chunk).collect()), key=repr) == brute(rows)


def test_segments_join_to_the_text():
    for _, t in corpus(5):
        assert " ".join(A.segments(t or "")) == (t or "")
    assert A.segments("a  b c ") == ["a", " b", "c "] and A.segments(" ") == [" "] and A.segments("a\n b") == ["a\n b"]


def test_vocabularies_are_checked():
    v = A.Vocabularies(*PATHS)
    v.check()
    v.b_bytes[500] = b" of the"
    with pytest.raises(ValueError, match="merge across"):
        v.check()


def test_empty_table(spark):
    assert A.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0
