"""Cross-tokenizer alignment against a plain restatement."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helixspark.llm import alignment

A = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
LETTERS = {}
for b in range(256):
    LETTERS[chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(256 + len([x for x in LETTERS.values() if not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174)]))] = b


def plain(text):
    """The groups of a text, by offsets where tokens of both sides end."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    sides = [[(i, bytes(LETTERS[c] for c in A.id_to_token(i))) for i in a], [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in b]]
    whole = f" {text}".encode()
    if any(b"".join(x for _, x in side) != whole for side in sides):
        return []
    ends = []
    for side in sides:
        at, own = 0, set()
        for _, x in side:
            at += len(x)
            own.add(at)
        ends.append(own)
    cuts = sorted(ends[0] & ends[1])
    out = [([], []) for _ in cuts]
    for k, side in enumerate(sides):
        at = 0
        for i, x in side:
            at += len(x)
            out[sum(c < at for c in cuts)][k].append(i)
    return out


def expected(rows):
    found = [plain(t) for _, t in rows]
    count = Counter(p for gs in found for p in {(x, y) for a, b in gs for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), gs in zip(rows, found, strict=True):
        links = [(x, y) for a, b in gs for x in a for y in b]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((i, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if gs else ""))
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab<s>|▁'é漢"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_groups_of_any_text(text):
    found = alignment._pack(ALIGNER, [text])
    gs = plain(text)
    assert found["n_groups"].tolist() == [len(gs)] and found["n_links"].tolist() == [sum(len(a) * len(b) for a, b in gs)]
    shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
    assert found["groups_sha256"] == [hashlib.sha256(shown.encode()).hexdigest() if gs else ""]


ALIGNER = alignment.Aligner()


def test_stabbing_queries():
    starts, ends = np.array([0, 2, 3, 7]), np.array([2, 3, 7, 9])
    for begin in range(9):
        for end in range(begin + 1, 10):
            over = [k for k in range(4) if starts[k] < end and ends[k] > begin]
            first, last = alignment.stabbed(starts, ends, np.array([begin]), np.array([end]))
            assert (first[0], last[0]) == (over[0], over[-1] + 1)
    assert [x.tolist() for x in alignment.groups(np.array([1, 2, 3]), np.array([3, 1, 2]))] == [[0, 2], [0, 1]]
    assert [x.tolist() for x in alignment.groups(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [[], []]


def test_groups_of_many_links(monkeypatch):
    texts = ["x" * 300 + "ab" * 50, "the xyzzy", "1" * 90]
    want = alignment._pack(ALIGNER, texts)
    monkeypatch.setattr(alignment, "MANY", 0)
    got = alignment._pack(ALIGNER, texts)

    def shown(found):
        links = sorted(zip(np.repeat(np.arange(len(found["pair_ends"])), np.diff(found["pair_ends"], prepend=0)).tolist(), found["pairs"][found["piece_pairs"]].tolist(), found["piece_links"].tolist(), strict=True))
        return links, sorted(zip(found["pairs"].tolist(), found["docs"].tolist(), strict=True))

    assert shown(got) == shown(want) and all(np.array_equal(got[c], want[c]) for c in want if c not in ("pairs", "docs", "piece_pairs", "piece_links"))


def test_alignment_equals_plain_counts(spark):
    rng = random.Random(3)
    words = ["the", "Überraschung", "tion", "x1y2", "漢字", "<|endoftext|>", "a\nb", "1234567", "don't", "<s>", "🎉", "running,"]
    texts = [None, "", " ", "  lead", "trail ", "a▁b", "a ▁ the x", "the the the", "a" * 700, " ".join(f"w{k}" for k in range(400)), "x" * 70_000 + " the tail", " " * 90]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(60)]
    texts += [texts[-1]] * 40  # one text repeated
    rows = [*enumerate(texts), (None, "the x"), (7, "the x"), (7, "the x")]
    want = expected(rows)
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, pair string")
    for block in (1 << 22, 300):
        got = [tuple(r) for r in alignment.align_tokens(df.repartition(3), block=block).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_alignment_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_tokens(df).collect() == []
    other = spark.createDataFrame([("k", "one two"), ("l", None)], "doc_id string, text string")
    assert {r.doc_id: r.n_groups for r in alignment.align_tokens(other).collect()} == {"k": 2, "l": 0}


def test_texts_that_end_or_begin_with_blanks_stand_alone_in_a_block():
    texts = ["one two ", "three four  ", "  five", "six\n", "\tseven ", "one two", " ", "eight", "nine  ", "ten ​", "᠎ x"]
    found = alignment._pack(ALIGNER, texts)
    groups = [plain(t) for t in texts]
    assert found["n_b"].tolist() == [sum(len(b) for _, b in gs) for gs in groups]
    assert found["n_groups"].tolist() == [len(gs) for gs in groups]
    shown = [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs) for gs in groups]
    assert found["groups_sha256"] == [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\tab<s>|▁'é漢"), max_size=12), max_size=8))
def test_groups_of_any_block(texts):
    found = alignment._pack(ALIGNER, texts)
    groups = [plain(t) for t in texts]
    shown = [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs) for gs in groups]
    assert found["groups_sha256"] == [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]
