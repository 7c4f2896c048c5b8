import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faultframe.llm import packing


def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


ODD = [
    "a  b\n\n c\t d", " lead", "trail  ", "it's  we'll\n\n\nx", "a   b", "x 　y   z", "é à\u0085b \x1c c", "1 234  5,6 !? ..",
    "\n\n", " ", "<|endoftext|> x", "日本 語 テスト", "a\x0bb \x0c c", "😀 😀\n😀", "a ​b",
]


def test_chunks_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    pieces = [*ODD, "the", " ", "\n", "  ", " ", "'s", "9", "ß", "\r\n", "-", " "]
    texts = [*ODD, *["".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(400)]]
    import pyarrow as pa

    from faultframe.llm.shared import text_bytes

    ids, first = packing.ChunkTokenizer(public_tokenizers.path(packing.VOCABULARY)).encode(*text_bytes(pa.array(texts)))
    for t, a, b in zip(texts, first, first[1:], strict=False):
        assert ids[a:b].tolist() == tokenizer().encode(t, add_special_tokens=False).ids if t in ODD else True
    whole = tokenizer().encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [w.ids for w in whole]


def best_fit_by_hand(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, room in enumerate(rooms) if room >= n]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 300))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit_plan(counts, capacity)
    rooms, used = {}, {}
    for n, total in counts.items():
        own = plan[plan[:, 0] == n]
        for rank in range(total):
            _, first, sequence, per, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            s, o = sequence + (rank - first) // per, offset + (rank - first) % per * n
            used.setdefault(s, []).append((o, n))
    for s, spans in used.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        rooms[s] = capacity - at
    assert sorted(rooms.values()) == best_fit_by_hand(lengths, capacity)


def test_pieces_and_places(documents):
    rng = random.Random(3)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(3000))
    rows = [(1, long), (2, ""), (3, None), (4, "one two"), (4, "one two"), (None, "x"), (7, "w" * 30_000)]
    cut, placed = packing.pack(documents(*rows))
    got, ids = placed.collect(), {(r.doc_id, r.piece): r.ids for r in cut.collect()}
    for i, t in rows:
        want = [*tokenizer().encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i})
        assert [x for p, *_ in own for x in ids[i, p]] == want
        assert all(n <= 2048 for _, _, n, _ in own) and (len(own) == 1 or all(n == 2048 for _, _, n, _ in own[1:]))
        assert all(c == zlib.crc32(np.array(want[s : s + n], dtype="<u4").tobytes()) for _, s, n, c in own)
    assert len(got) == sum(1 for i, _ in rows if i not in (1, 7)) + sum(1 for i, _ in ids if i in (1, 7))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        ends = [0, *np.cumsum([n for _, n in sorted(spans)])]
        assert [o for o, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 2048
    assert packing.pack(documents())[1].count() == 0


def test_added_tokens_have_their_ids(documents):
    """As an unmodified tokenizer does, which the contract names."""
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "a", " ", "  ", "the", "\n", "é", "<|"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x<|endof", "text|>", "", *["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(300)]]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.ids for r in packing.pieces(documents(*rows)).collect()}
    for i, t in rows:
        assert got[i] == [*whole.encode(t, add_special_tokens=False).ids, packing.END], t
    assert got[0] == [64, 220, 50256, 275, packing.END]
