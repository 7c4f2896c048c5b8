"""Personal data: pattern spans, and information-theoretic sanitisation of the terms around them.

Every value that a pattern finds is a protected entity. The terms near its mentions are counted over the corpus. A term t
reveals entity e by their pointwise mutual information, PMI(e; t) = log2 p(e | t) / p(e), and discloses it where that
reaches a share 1 / ALPHA of all there is to know, IC(e) = -log2 p(e). In texts that mention e, terms that disclose it
are generalised like the entity itself. A term must be seen with e in SUPPORT different contexts.

Copies make a term neither more nor less telling: equal texts count once everywhere, and texts in which t stands in the same
context of e, as in a passage that several texts share, count once among those with e and among those with t alike.
"""

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import words
from .shared import REMEMBERED, bit_map, in_map, slices, small_batches, stored, text_bytes

KINDS = ("email", "ip", "card", "phone", "term")
ALPHA = 1.25
SUPPORT = 3
# Words on either side of a mention that count as its context.
NEAR = 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Addresses and numbers lie inside such stretches.
_STRETCH = re.compile(r"[0-9+][0-9 ().+-]{6,}")
# A match that starts inside a run of digits would have started at its head; so each run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Inside runs of numbers that hold for none of the patterns as a whole: numbers written in groups, and cards alone.
_GROUPED_PHONE = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])")
_WHOLE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{12,19}|(?:[0-9]{4}[ -]){3}[0-9]{4})(?![0-9])")
_TERM = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """`[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, from each @ outwards: a long word costs its length once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all pattern matches that hold, by start and kind, in code points."""
    found = [(s, e, 0) for s, e in emails(text)]
    for stretch in _STRETCH.finditer(text):
        low, high = stretch.span()
        for m in _IP.finditer(text, low, high):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                found.append((*m.span(), 1))
        for m in _CARD.finditer(text, low, high):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
        for m in _PHONE.finditer(text, low, high):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((*m.span(), 3))
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


def number_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Cards and phone numbers that the patterns lose, because other numbers stand next to them; none overlaps `known`."""
    found = []
    for stretch in _STRETCH.finditer(text):
        low, high = stretch.span()
        taken = [x[:2] for x in known if x[0] < high and low < x[1]]
        for kind, pattern in ((3, _GROUPED_PHONE), (2, _WHOLE_CARD)):
            for m in pattern.finditer(text, low, high):
                digits = re.sub("[^0-9]", "", m[0])
                good = luhn(digits) if kind == 2 else 9 <= len(digits) <= 15
                if good and not any(s < m.end() and m.start() < e for s, e in taken):
                    found.append((*m.span(), kind))
                    taken.append(m.span())
    return found


def number_and_base_spans(text: str) -> list[tuple[int, int, int]]:
    """Everything that is protected in itself, by start and kind."""
    base = base_spans(text)
    return sorted([*base, *number_spans(text, base)], key=lambda x: (x[0], x[2], x[1]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def entity(kind: int, value: str) -> str:
    """One name for the spellings of a value."""
    return KINDS[kind] + ":" + (value.lower() if kind < 2 else re.sub("[^0-9]", "", value))


def term_hashes(terms: list[str]) -> np.ndarray:
    return words.word_hashes(*text_bytes(pa.array(terms, pa.string())), words.MARKS)[0].view(np.int64)


def without(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with spaces over all spans (by start)."""
    out, at = [], 0
    for start, end, _ in spans:
        if end > at:
            start = max(at, start)
            out += [text[at:start], " " * (end - start)]
            at = end
    return "".join([*out, text[at:]])


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[list[str]]:
    """For each span the terms next to it, at most NEAR on each side; other spans hold no terms."""
    terms = list(_TERM.finditer(without(text, spans)))
    starts = [m.start() for m in terms]
    found = []
    for start, end, _ in spans:
        before, after = bisect_left(starts, start), bisect_left(starts, end)
        found.append([m[0] for m in [*terms[max(0, before - NEAR) : before], *terms[after : after + NEAR]]])
    return found


def mentions(texts: DataFrame) -> DataFrame:
    """Stored: (key, entity, context, term) for each entity mention and term near it; equal texts count once in a task."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for rows, column in slices(batches, "text"):
            keys, names, places, terms = [], [], [], []
            if len(seen) > REMEMBERED:
                seen.clear()
            for key, text in zip(rows.column("key").to_pylist(), column.to_pylist(), strict=True):
                spans = number_and_base_spans(text)
                if not spans or key in seen:
                    continue
                seen.add(key)
                for (start, end, kind), near in zip(spans, contexts(text, spans), strict=True):
                    terms += near or [""]
                    keys += [key] * max(1, len(near))
                    names += [entity(kind, text[start:end])] * max(1, len(near))
                    places += [" ".join(near).lower()] * max(1, len(near))
            if keys:
                hashes = np.zeros(len(terms), dtype=np.int64)
                full = [k for k, t in enumerate(terms) if t]
                hashes[full] = term_hashes([terms[k] for k in full])
                columns = [pa.array(keys, pa.int64()), pa.array(names, pa.string()), pa.array(places, pa.string()), pa.array(hashes)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "name", "place", "term"])

    found = texts.mapInArrow(work, "key long, name string, place string, term long").distinct()
    return stored(found.select("key", F.xxhash64("name").alias("entity"), F.xxhash64("place").alias("context"), "term"), "mentions")


def text_counts(texts: DataFrame, copied: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): in how many different texts each term of `terms` is. A bit map spares the other words of the corpus.

    `copied` has the keys of repeated texts; only their terms travel by text, those of the others are counted in place, in
    a row for each slice.
    """
    context = texts.sparkSession.sparkContext
    table = context.broadcast(bit_map(terms, F.col("term")))
    repeated = context.broadcast(bit_map(copied, F.col("key")))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, number = set(), 0
        for rows, column in slices(batches, "text"):
            keys = np.asarray(rows.column("key"))
            twice = in_map(repeated.value, keys)
            fresh = ~twice
            if len(seen) > REMEMBERED:
                seen.clear()
            for k in np.flatnonzero(twice).tolist():
                fresh[k] = keys[k] not in seen
                seen.add(keys[k])
            found, first = words.word_hashes(*text_bytes(column), words.MARKS)
            may = np.flatnonzero(in_map(table.value, found))
            found, text = found[may], np.searchsorted(first, may, "right") - 1
            found, text = found[fresh[text]], text[fresh[text]]
            order = np.lexsort((found, text))
            found, text = found[order], text[order]
            new = np.ones(len(found), dtype=bool)
            new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
            found, text = found[new], text[new]
            once = np.unique(found[~twice[text]], return_counts=True)
            found, text = found[twice[text]], text[twice[text]]
            owners, first = np.unique(text, return_index=True)
            number += 1
            ends = len(once[0]) + np.append(first, len(found))
            term, n = np.concatenate([once[0], found]).view(np.int64), np.concatenate([once[1], np.ones(len(found), np.int64)])
            lists = [pa.ListArray.from_arrays(pa.array(np.insert(ends, 0, 0), pa.int32()), pa.array(c)) for c in (term, n)]
            part = [f"{TaskContext.get().partitionId()}:{number}", *[None] * len(owners)]
            key = pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(keys[owners], pa.int64())])
            yield pa.RecordBatch.from_arrays([key, pa.array(part, pa.string()), *lists], ["key", "part", "terms", "counts"])

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, where = np.unique(np.asarray(batch.column("terms").flatten()), return_inverse=True)
            n = np.zeros(len(term), dtype=np.int64)
            np.add.at(n, where, np.asarray(batch.column("counts").flatten()))
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n)], ["term", "n"])

    met = texts.mapInArrow(work, "key long, part string, terms array<long>, counts array<long>")
    met = met.groupBy("key", "part").agg(F.first(F.struct("terms", "counts")).alias("met")).select("met.terms", "met.counts")
    return met.mapInArrow(summed, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).join(terms, "term", "left_semi")


def disclosing(texts: DataFrame, alpha=ALPHA, support=SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(entity, term, pmi, ic) of the terms that disclose an entity, and all mentions."""
    seen = mentions(texts)
    keys = stored(texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "text-keys")
    total = max(1, keys.count())
    entities = seen.select("entity", "context").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    pairs = seen.where("term <> 0").groupBy("entity", "term").agg(F.count_distinct("context").alias("n_both"), F.count_distinct("key").alias("n_texts"))
    pairs = stored(pairs.where(F.col("n_both") >= support), "entity-terms")
    counts = text_counts(texts, keys.where("n > 1"), pairs.select("term").distinct()) if not pairs.isEmpty() else pairs.select("term", F.lit(1).cast("long").alias("n"))
    measured = pairs.join(counts, "term").join(entities, "entity")
    p_entity = F.least(F.lit(1.0), F.col("n_entity") / total)
    # Texts where the term is not near the entity, and each context where it is.
    p_given = F.col("n_both") / (F.col("n_both") + F.greatest(F.lit(0), F.col("n") - F.col("n_texts")))
    measured = measured.select("entity", "term", F.log2(p_given / p_entity).alias("pmi"), (-F.log2(p_entity)).alias("ic"))
    return measured.where((F.col("pmi") > 0) & (F.col("pmi") >= F.col("ic") / alpha)), seen


def term_spans(texts: DataFrame, alpha=ALPHA, support=SUPPORT) -> DataFrame:
    """Stored: (key, extra), the places of disclosing terms in each text that has any, as (start, end) in code points."""
    known, seen = disclosing(texts, alpha, support)
    known = stored(known, "disclosing")
    wanted = seen.select("key", "entity").distinct().join(known.select("entity", "term"), "entity")
    wanted = stored(wanted.select("key", "term").distinct().groupBy("key").agg(F.collect_list("term").alias("terms")), "text-terms")
    table = texts.sparkSession.sparkContext.broadcast(bit_map(wanted, F.col("key")))

    def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_map(table.value, np.asarray(batch.column("key")))))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, column in slices(batches, "text"):
            keys, places = [], []
            for i, text in enumerate(column.to_pylist()):
                own = set(rows.column("terms")[i].as_py())
                taken = number_and_base_spans(text)
                met = list(_TERM.finditer(text))
                marked = [m.span() for m, h in zip(met, term_hashes([m[0] for m in met]).tolist(), strict=True) if h in own] if met else []
                free, k, edge = [], 0, 0
                for start, end in marked:  # both in order
                    while k < len(taken) and taken[k][0] < end:
                        edge, k = max(edge, taken[k][1]), k + 1
                    if start >= edge:
                        free.append({"start": start, "end": end})
                if free:
                    keys.append(rows.column("key")[i].as_py())
                    places.append(free)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, kind)], ["key", "extra"])

    near = texts.mapInArrow(chosen, texts.schema).groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")
    return stored(near.mapInArrow(work, "key long, extra array<struct<start:long,end:long>>"), "term-spans")


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`docs` with a key of the text, and the texts (key, text) for the statistics."""
    docs = docs.withColumn("__key", F.xxhash64("text"))
    return docs, docs.where("text is not null").select(F.col("__key").alias("key"), "text")


def find(docs: DataFrame, alpha=ALPHA, support=SUPPORT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base, spans) for each row of `docs` (doc_id, text, any others).

    `base` and `spans` are comma-joined kind:start:end by start, then kind in the order of KINDS; offsets in code points,
    the end exclusive. `spans` adds numbers that the patterns lose beside others, and disclosing terms. NULL and empty texts have none. A term that lies in a pattern's span is not marked again.
    """
    small_batches(docs.sparkSession)
    docs, texts = keyed(docs)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, column in slices(batches, "text"):
            spans = [base_spans(t) for t in column.to_pylist()]
            full = [written(sorted([*s, *number_spans(t, s)], key=lambda x: (x[0], x[2], x[1]))) for t, s in zip(column.to_pylist(), spans, strict=True)]
            counts = [pa.array([sum(k == kind for *_, k in s) for s in spans], pa.int64()) for kind in range(4)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("__key"), *counts, pa.array([written(s) for s in spans], pa.string()), pa.array(full, pa.string())], names)

    names = ["doc_id", "__key", "n_email", "n_ip", "n_card", "n_phone", "base", "full"]
    schema = "doc_id long, __key long, n_email long, n_ip long, n_card long, n_phone long, base string, full string"
    rows = docs.select(F.col("doc_id").cast("long"), "__key", "text").mapInArrow(work, schema)
    extra = term_spans(texts, alpha, support).withColumnRenamed("key", "__key")
    rows = rows.join(extra, "__key", "left")
    own = F.transform(F.filter(F.split("full", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("start"), s.alias("span")))
    more = F.transform("extra", lambda x: F.struct(x.start.alias("start"), F.concat_ws(":", F.lit("term"), x.start, x.end).alias("span")))
    # Other spans come in order and no term starts where one does, so only the start has to be compared.
    order = lambda a, b: F.when(a.start < b.start, -1).when(a.start > b.start, 1).otherwise(0)
    merged = F.when(F.col("extra").isNull(), F.col("full")).otherwise(F.array_join(F.transform(F.array_sort(F.concat(own, more), order), lambda x: x.span), ","))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_term"), "base", merged.alias("spans"))


def generalised(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of the first."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, alpha=ALPHA, support=SUPPORT) -> DataFrame:
    """`docs` with personal data in `text` generalised to its kind, and n_chars (if there is one) brought up to date.

    NULL texts stay; further columns stay. Repeated rows are sanitised alike.
    """
    small_batches(docs.sparkSession)
    columns = docs.columns
    docs, texts = keyed(docs.drop("extra"))
    extra = term_spans(texts, alpha, support).withColumnRenamed("key", "__key")
    joined = docs.join(extra, "__key", "left")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, column in slices(batches, "text"):
            more = rows.column("extra").to_pylist()
            known = rows.column("text").is_valid().to_pylist()
            texts = [
                generalised(t, number_and_base_spans(t) + [(x["start"], x["end"], 4) for x in e or []]) if k else None
                for t, e, k in zip(column.to_pylist(), more, known, strict=True)
            ]
            out = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([out[c].cast(rows.schema.field(c).type) if c in out else rows.column(c) for c in kept], kept)

    kept = [c for c in columns if c != "extra"]
    return joined.mapInArrow(work, docs.select(*kept).schema)
