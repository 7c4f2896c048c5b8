import random
import re

from pyspark.sql import functions as F

from faultframe.llm import licenses as lc


def grams(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def by_hand(rows, templates):
    out = set()
    for i, t in rows:
        for k, (name, text) in enumerate(templates):
            own = grams(text)
            n = len(own & grams(t))
            if own and n >= lc.CONTAINED * len(own):
                out.add((i, name, k, n, len(own)))
    return out


def test_against_brute_force(documents):
    rng = random.Random(4)
    word = lambda: rng.choice("of the to and in license under public version is".split()) + rng.choice(["", "", str(rng.randrange(30))])
    templates = [*lc.TEMPLATES, ("own", " ".join(word() for _ in range(60))), ("short", "four words are few"), ("none", "")]
    rows = [(0, None), (1, ""), (2, "licensed under"), (None, lc.TEMPLATES[0][1])]
    for k in range(3, 90):
        w = [word() for _ in range(rng.choice([0, 3, 50, 200]))]
        for _ in range(rng.choice([0, 1, 2])):
            passage = rng.choice(templates)[1].split()
            if rng.random() < 0.3 and len(passage) > 30:
                passage[rng.randrange(len(passage))] = "changed"
            if rng.random() < 0.2:
                passage = passage[: len(passage) // 2]
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        rows.append((k, rng.choice([" ", "\n ", " * "]).join(w)))
    rows.append((3, rows[7][1]))
    got = lc.scan(documents(*rows).withColumn("keys", F.lit("clash")), templates).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == by_hand(rows, templates)


def test_bands_make_collisions_as_certain_as_asked():
    for like in (0.5, 0.6, 0.8):
        n = lc.bands(like)
        assert 1 - (1 - like**lc.ROWS) ** n >= lc.CERTAINTY > 1 - (1 - like**lc.ROWS) ** (n - 1)


def test_empty_table_and_no_templates(documents):
    assert lc.scan(documents()).count() == 0 and lc.scan(documents((1, "a b c d e f")), ()).count() == 0


def test_cut_notices_as_whole_documents(documents):
    notices = [text.split() for _, text in lc.TEMPLATES]
    rows = list(enumerate(" ".join(w[:n]) for w in notices for n in range(1, len(w) + 1)))
    got = {tuple(r) for r in lc.scan(documents(*rows)).collect()}
    assert got == by_hand(rows, lc.TEMPLATES)
