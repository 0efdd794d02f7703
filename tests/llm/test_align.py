"""Token alignment against a brute force over byte ranges, on whole texts and both tokenizers as they come."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakelens.llm import align

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["the", " ", "  ", "\n", "\t", " \n ", "Straße", "é", "é", "don't", "'s", "123", "4,5", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "日本語", "🙂", "　", "\xa0", "\x1c", "\x00", "x" * 90, "--", "​", "ﬁ", "𐍈", "a", " b", "c ", "\r\n"]
ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "two words"), (None, None), (4, "x" * 50_000), (5, " \t\n"), (6, " "), (7, "a▁b"), (8, "   lead and trail   "), (9, "🙂" * 300)]


def by_hand(rows):
    import sentencepiece

    first, second = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    first.encode_special_tokens = True
    with open(FIRST.replace(".json", ".tiktoken"), "rb") as f:
        entry = {int(i): base64.b64decode(b) for b, i in map(bytes.split, f)}
    docs = []
    for doc_id, text in rows:
        a, b = first.encode(" " + (text or ""), add_special_tokens=False).ids, second.encode(text or "")
        x = [entry[i] for i in a]
        y = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
            docs.append((doc_id, 0, 0, "", [], 0))
            continue
        spans = []
        for tokens in (x, y):
            at, out = 0, []
            for t in tokens:
                out.append((at, at + len(t)))
                at += len(t)
            spans.append(out)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, i, j, links = [], 0, 0, []
        for e in ends:
            i2, j2 = i, j
            while i2 < len(a) and spans[0][i2][1] <= e:
                i2 += 1
            while j2 < len(b) and spans[1][j2][1] <= e:
                j2 += 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            links += [(a[p], b[q]) for p in range(i, i2) for q in range(j, j2) if max(spans[0][p][0], spans[1][q][0]) < min(spans[0][p][1], spans[1][q][1])]
            i, j = i2, j2
        docs.append((doc_id, len(a), len(b), hashlib.sha256(";".join(groups).encode()).hexdigest(), links, len(groups)))
    held = Counter(p for d in docs for p in set(d[4]))
    top = Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return Counter((d[0], d[1], d[2], d[5], len(d[4]), d[3], sum(held[p] == top[p[0]] for p in d[4]), sum(held[p] for p in d[4])) for d in docs)


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "doc_id long, text string, pair string, n long, UID int").repartition(3)


def got(df):
    return Counter(tuple(r[c] for c in align.OUT) for r in df.collect())


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_against_brute_force(spark, most):
    rng = random.Random(5)
    rows = ODD + [(100 + i, "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 30)))) for i in range(300)] + [(900 + i, "the same text, don't you see") for i in range(150)]
    assert got(align.align_tokens(table(spark, rows), FIRST, SECOND, most)) == by_hand(rows)
    assert align.align_tokens(table(spark, []), FIRST, SECOND, most).count() == 0


def test_small_memos_change_nothing():
    text = " ".join(PIECES * 3)
    small = align.Aligner(FIRST, SECOND, most=2, longest=4)
    small.transducer.most = 3
    a, b = small.document(text), align.Aligner(FIRST, SECOND).document(text)
    again = small.document(text)
    assert a[:5] == b[:5] == again[:5] and a[5].tolist() == b[5].tolist() and a[6].tolist() == b[6].tolist()


def test_fallback_vocabulary_gives_the_same_ids(tmp_path):
    alone = tmp_path / "own.json"
    alone.write_bytes(open(FIRST, "rb").read())  # no ranks beside it
    (a, a_bytes), (b, b_bytes) = align._first_side(str(alone)), align._first_side(FIRST)
    for p in PIECES:
        assert a(" " + p) == b(" " + p) and [a_bytes(i) for i in a(p)] == [b_bytes(i) for i in b(p)]


def test_transducer_rejects_other_bytes():
    words = [b"ab", b"c", b"a", b"bc", b"x", b"abc"]
    t = align.Transducer(words.__getitem__, words.__getitem__)
    assert t.align([0, 1], [2, 3]) == ([(0, 2, 0, 2)], [2, 3, align.SECOND + 3])
    assert t.align([0, 1], [2, 4]) is None and t.align([0], [0, 4]) is None and t.align([0, 1], [0]) is None and t.align([], []) == ([], [])
