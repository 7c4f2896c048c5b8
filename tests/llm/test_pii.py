import random
import re

import pytest
from pyspark.sql import functions as F

from faultframe.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def by_hand(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(len(p) < 1000 and int(p) <= 255 for p in m[0].split(".")),  # noqa: B023
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),  # noqa: B023
                "phone": lambda: 9 <= len(digits) <= 15,  # noqa: B023
            }[kind]()
            if good:
                out.append((m.start(), m.end(), rank))
    return sorted(out, key=lambda x: (x[0], x[2]))


ODD = [
    "", "@", "a@b", "a@b.c", "x.a@b.c.d@e.f", "a@@b.c", "a@b..c", "a@b.c-", ".%+-@-.-", "é@a.b", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.255",
    "1.1.1.1111", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "4111  1111", "+1 (555) 555-0100", "+1+2 345 678 90 12", "++49 30 123456 78",
    "+1 (((((", "+12345678901234567", "4111 1111 1111 1111 2", "1" * 5000 + ".1.1.1", "٣.٣.٣.٣", "+1.2.3.4.5.6.7.8.9", "a+1 689 555 4072@mail.com", "12 - 3",
]


def test_patterns_against_brute_force():
    rng = random.Random(7)
    parts = ["a", "@", ".", "b.c", "+", "1", "22", " ", "-", "(", ")", "4111111111111111", "10.0.0.1", "\n", "é", "%", "+1 689 555 4072", "x@y.z", "300"]
    for text in ODD + ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(4000)]:
        assert pii.base_spans(text) == by_hand(text), text


def test_numbers_beside_each_other():
    text = "+1 (269) 555-3296 4524132264652876 and 4451718024887799 27.65.93.188"
    assert [k for *_, k in pii.base_spans(text)] == [1]
    assert pii.written(pii.number_and_base_spans(text)) == "phone:0:17,card:18:34,card:39:55,ip:56:68"
    assert pii.number_spans("order 4524132264652877 of 12 34 56", []) == []


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 150_000, "+1 " * 130_000, "+1" + " " * 400_000, "@" + "a" * 300_000):
        pii.number_and_base_spans(text)


@pytest.fixture
def corpus():
    """anna@x.example is always met beside `quillon`, a word that is nowhere else."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(40)}"
    rows = [(k, " ".join(word() for _ in range(20)) + " writes to and later again") for k in range(200)]
    rows += [(300 + k, f"{word()} {word()} Quillon writes to anna@x.example {word()} {word()} and later quillon, again") for k in range(6)]
    rows += [(400 + k, "copied rarity zebrano by bob@x.example here") for k in range(6)]
    return rows


def test_disclosing_terms_are_marked(documents, corpus):
    rows = [*corpus, (1, None), (2, ""), (None, "carl@x.example"), (300, corpus[200][1])]
    got = pii.find(documents(*rows).withColumn("base", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        want = pii.written(by_hand(t or ""))
        assert all(r.base == want for r in by[i]) or i in (1, 2)
    for i, t in corpus[200:206]:
        terms = [m.span() for m in re.finditer("[Qq]uillon", t)]
        assert by[i][0].n_term == 2 and all(f"term:{a}:{b}" in by[i][0].spans for a, b in terms)
        starts = [int(s.split(":")[1]) for s in by[i][0].spans.split(",")]
        assert starts == sorted(starts) and len(starts) == 3
    assert not any(r.n_term for i in by for r in by[i] if not 300 <= (i or 0) < 306)


def test_sanitised_texts(documents, corpus):
    docs = documents(*corpus, (1000, None), (1001, ""), (1002, "+1 689 555 4072 4111111111111111 10.0.0.1"))
    got = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert pii.sanitise(docs).columns == docs.columns
    assert got[1000].text is None and got[1001].text == "" and got[1002].text == "[PHONE] [CARD] [IP]"
    assert "uillon" not in got[300].text and "anna" not in got[300].text and "[EMAIL]" in got[300].text and "[TERM]" in got[300].text
    assert got[400].text == "copied rarity zebrano by [EMAIL] here"
    assert all(r.text is None or r.n_chars == len(r.text) for r in got.values())
    assert all(got[i].text == t for i, t in corpus[:200])
    assert pii.find(documents()).count() == 0 and pii.sanitise(documents()).count() == 0


@pytest.mark.parametrize("passage", [False, True])
def test_copies_hide_no_disclosing_term(documents, corpus, passage):
    """Thirty copies of one of the texts around a disclosing term, exact or of the passage alone."""
    head, tail = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen sixteen"
    text = f"{head} Quillon writes to anna@x.example {tail}"
    more = [(1000 + k, text + f" end{k} other{k}" * passage) for k in range(31)]
    got = {r.doc_id: r for r in pii.find(documents(*corpus, *more)).collect()}
    assert all("quillon" in t.lower() and got[i].n_term == len(re.findall("[Qq]uillon", t)) for i, t in [*corpus[200:206], *more])
    assert not any(r.n_term for i, r in got.items() if i < 300 or 400 <= i < 406)


def test_contexts_reach_over_long_words_and_hide_long_entities():
    text = "secret " + "z" * 330 + " a@b.example tail"
    spans = pii.number_and_base_spans(text)
    assert pii.contexts(text, spans) == [["secret", "z" * 330, "tail"]]
    long = "n" * 500 + "@" + "d" * 20 + ".example"
    text = f"one {long} two x@y.example three"
    spans = pii.number_and_base_spans(text)
    assert pii.contexts(text, spans) == [["one", "two", "three"], ["one", "two", "three"]]
    assert pii.without("abcdef", [(1, 3, 0), (2, 4, 1)]) == "a   ef"
