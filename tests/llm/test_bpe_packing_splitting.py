import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from foliograph.llm.bpe import PATTERN, VOCABULARY, Encoder, count_tokens, encode_texts
from foliograph.llm.packing import closest, fill, pack
from foliograph.llm.splitting import pieces, split_oversized

ENCODER = Encoder(VOCABULARY)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_same_ids_as_the_public_library(texts):
    assert ENCODER.encode(texts) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_long_runs_and_special_strings():
    texts = ["a" * 5000, "ab" * 3000, "0" * 999, "<|endoftext|>", "中文" * 700, " \n\t" * 50, "", None]
    assert ENCODER.encode(texts) == [REFERENCE.encode_ordinary(t or "") for t in texts]


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, "tidal logs", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_texts(df, "doc_id", "text").collect())
    assert got == [(1, REFERENCE.encode_ordinary("tidal logs")), (2, []), (3, []), (3, [])]
    assert {r.n_tokens for r in count_tokens(df, "doc_id", "text").collect()} == {0, len(got[0][1])}
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_closest_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 30), 5)}
        room = rng.randint(0, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = closest(counts, room)
        assert all(got[n] <= counts[n] for n in got)
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= room)


def test_fill_keeps_everything():
    rng = random.Random(2)
    sizes = sorted([rng.randint(1, 900) for _ in range(500)] + [0, 0, 5000])
    containers = fill(sizes, 2048)
    assert all(sum(n for _, _, n in c) <= 2048 for c in containers)
    total = {}
    for c in containers:
        for i, _, n in c:
            total[i] = total.get(i, 0) + n
    assert [total[i] for i in range(len(sizes))] == sizes
    assert len(containers) <= -(-sum(sizes) // 2048) + 1


def test_pack_rows(spark):
    rows = [(1, 5, "a"), (2, None, "b"), (3, 0, "c"), (4, 25, "d"), (5, 5, "e"), (5, 5, "e"), (None, 3, "f")]
    got = pack(spark.createDataFrame(rows, "doc_id long, n int, container string"), key="doc_id", size="n", capacity=10).collect()
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in got) == [(1, 0, 5), (2, 0, 0), (3, 0, 0), (4, 0, 10), (4, 1, 10), (4, 2, 5), (5, 0, 5)]
    assert pack(spark.createDataFrame([], "doc_id long, n int"), key="doc_id", size="n", capacity=10).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text("ab .\n#;中", min_size=1, max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_tile_the_text(text, limit, overlap):
    got = pieces(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b in got)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    cores = [text[got[i - 1][1] if i else 0 : b] for i, (_, b) in enumerate(got)]
    assert "".join(cores) == text
    assert all(b == max(0, a_end - overlap) for (_, a_end), (b, _) in zip(got, got[1:]))


def test_natural_boundaries():
    text = "# One\n" + "Alpha beta gamma. " * 10 + "\n\n# Two\n" + "Delta epsilon zeta. " * 10
    ends = [b for _, b in pieces(text, 120, 0)][:-1]
    assert all(text[b - 1].isspace() for b in ends) and text.index("# Two") in ends
    with pytest.raises(ValueError):
        pieces("abc", 2, 2)


def test_split_rows(spark):
    rows = [("a", "word " * 50, 1), ("a", "word " * 50, 2), ("b", "short", 3), ("c", None, 4), (None, "word " * 50, 5)]
    got = split_oversized(spark.createDataFrame(rows, "k string, t string, piece int"), key="k", text="t", limit=100, overlap=10).collect()
    assert {r.k for r in got} == {"a"} and len(got) == len({r.piece_no for r in got})


def test_nested_tree():
    # a section of depth 1 with two of depth 2: the second one alone is opened, and its parts do not mix with its siblings
    text = "# A\n" + "intro. " * 3 + "\n## B\n" + "bee. " * 6 + "\n## C\n" + "sea. " * 30 + "\n# D\n" + "dee. " * 4
    got = [text[a:b] for a, b in pieces(text, 80, 0)]
    assert "".join(got) == text and max(map(len, got)) <= 80
    assert got[0].startswith("# A") and got[0].rstrip().endswith("bee.") and got[1].startswith("## C") and got[-1].startswith("# D")
    steps = "\n".join(" " * (3000 - i) + "x" for i in range(3000))
    got = pieces(steps, 5000, 10)
    assert got[0][0] == 0 and got[-1][1] == len(steps) and max(b - a for a, b in got) <= 5000
