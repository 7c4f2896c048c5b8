import hashlib
import random
import re

import pyspark.sql.functions as F

from faultframe.llm import fingerprints as fp


def true_likeness(a, b):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """The edited texts, by brute force."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        yield i, t, t[: len(t) - m] + nxt[:m], nxt


def test_against_brute_force(documents):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("ab cd éf gh ij KL mn op".split()) + str(rng.randrange(40)) for _ in range(n))
    rows = [(i * 7, text(rng.choice([0, 1, 3, 30, 300]))) for i in range(60)] + [(3, None), (5, ""), (8, "Ä" * 50_000), (None, text(9))]
    rows += [(900, rows[4][1]), (901, rows[4][1])]
    got = fp.edited_pairs(documents(*rows), rows_per_run=10).collect()
    want = sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in expected(rows))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
    by = {r.edited_sha256 + str(r.doc_id): r for r in got}
    errors = []
    for i, t, e, nxt in expected(rows):
        r = by[hashlib.sha256(e.encode()).hexdigest() + str(i)]
        errors.append(abs(r.near_edited - true_likeness(t, e)))
        assert 0 <= r.near_next <= 1 and abs(r.near_next - true_likeness(t, nxt)) < 0.3
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.3
    prints = {}
    for r in got:
        t = next(t for i, t, _, _ in expected(rows) if i == r.doc_id)
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint


def test_one_row_repeated_rows_and_empty_table(documents):
    (one,) = fp.edited_pairs(documents((4, "a b c d e f g h i"))).collect()
    assert (one.n_chars, one.near_next) == (17, 1.0)
    again = fp.edited_pairs(documents(*[(4, "a b c d e f g")] * 5)).collect()
    assert len(again) == 5 and len({r.edited_sha256 for r in again}) == 1
    assert fp.edited_pairs(documents()).count() == 0


def test_column_keeps_others_and_replaces_a_clashing_one(documents):
    docs = documents((1, None), (2, "x y"), (3, "X  y")).withColumn("fingerprint", F.lit(0))
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(docs).collect()}
    assert got[1] == "" and got[2] == got[3] != ""
