"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities over the pieces of a fixed public vocabulary. A word, with the space before it, can be
cut into pieces in many ways; the forward algorithm adds up the probabilities of all of them. A text's likelihood is the
product over its words (runs of letters, lower-cased), the answer the language of the highest one, the score its
posterior under equal priors. Piece probabilities are learned by expectation maximisation over the same segmentations.
"""

import base64
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import slices, small_batches, stored
from .words import mix

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# The classifier is fitted on about this many labelled documents of each language, drawn by a hash of doc_id, and learns
# this many languages, those with most documents. Both are bounds on the training sample only.
SAMPLE_DOCS, MOST_LANGUAGES = 1000, 500
ROUNDS = 4
SMOOTHING = 0.1
# Probability of a letter that is no piece; the same for all languages, so it says nothing.
UNKNOWN = 1e-7
# Longest piece, and longest run of letters scored at once (longer runs are scored in parts), in letters.
PIECE, RUN = 16, 32
UNDETERMINED = "und"
# Words whose likelihoods a worker remembers before it starts again; a matter of memory, not of the result.
REMEMBERED = 1_500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 0x20


@cache
def kinds() -> np.ndarray:
    """Code points by kind: 2 for letters, 1 for marks, which may belong to a word, 0 for the rest."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], dtype=np.int8)


@cache
def letters() -> np.ndarray:
    """Which code points are letters or marks on letters."""
    return kinds() > 0


def lettered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, 0 for whatever is no letter and behind each text; index of each text."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\0".join([*lower, ""]).encode("utf-32-le"), dtype=np.uint32)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower])])
    return np.where(letters()[points], points, np.uint32(0)), first


def runs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of letters, in parts of at most RUN."""
    solid = np.concatenate([[False], points != 0, [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    parts = -(-lengths // RUN)
    inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(starts, parts) + inside * RUN, np.minimum(RUN, np.repeat(lengths, parts) - inside * RUN)


def run_hashes(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(RUN, _BASE)]))
    terms = mix(points[np.repeat(starts, lengths) + place].astype(np.uint64)) * powers[place]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))


class Pieces:
    """The usable pieces of the vocabulary, those of letters with or without a space before, found by hash."""

    def __init__(self, path: str):
        found = set()
        with open(path, "rb") as lines:
            for line in lines:
                try:
                    piece = base64.b64decode(line.split()[0]).decode().lower()
                except UnicodeDecodeError:
                    continue
                body = piece.removeprefix(" ")
                if len(piece) <= PIECE and (body or piece == " ") and all(letters()[ord(c)] for c in body):
                    found.add(piece)
        self.names = sorted(found)
        keys = np.array([self.key(p) for p in self.names], dtype=np.uint64)
        self.longest = max(map(len, self.names))
        self.bits = 64 - int(len(keys) * 8).bit_length()
        self.keys = np.zeros(1 << (64 - self.bits), dtype=np.uint64)
        self.ids = np.full(len(self.keys), -1, dtype=np.int32)
        self.probes = 0
        for i, key in enumerate(keys):
            slot, n = int(mix(key[None])[0] >> np.uint64(self.bits)), 0
            while self.ids[slot] >= 0:
                slot, n = (slot + 1) % len(self.ids), n + 1
            self.keys[slot], self.ids[slot], self.probes = key, i, max(self.probes, n)

    @staticmethod
    def key(piece: str) -> np.uint64:
        value = 0
        for c in piece:
            value = (value * int(_BASE) + int(mix(np.array([ord(c)], dtype=np.uint64))[0])) % (1 << 64)
        return np.uint64(value)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of piece keys, -1 where there is no such piece."""
        slot = (mix(keys) >> np.uint64(self.bits)).astype(np.int64)
        ids = np.where(self.keys[slot] == keys, self.ids[slot], -1)
        open_ = np.flatnonzero((ids < 0) & (self.ids[slot] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) % len(self.ids)
            s = slot[open_]
            ids[open_] = np.where(self.keys[s] == keys[open_], self.ids[s], -1)
            open_ = open_[(ids[open_] < 0) & (self.ids[s] >= 0)]
        return ids


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def blocks(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length at a time: their numbers, and their hashed letters behind a space."""
    order = np.argsort(lengths, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        for rows in np.split(some, range(20_000, len(some), 20_000)):
            if len(rows):
                body = points[starts[rows][:, None] + np.arange(lengths[rows[0]])].astype(np.uint64)
                yield rows, mix(np.hstack([np.full((len(rows), 1), _SPACE, np.uint64), body]))


def piece_ids(table: Pieces, values: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """For each stretch (start, end) of the words in a block the piece that it is."""
    found, width = {}, values.shape[1]
    for start in range(width):
        key = np.zeros(len(values), dtype=np.uint64)
        for end in range(start + 1, min(width, start + table.longest) + 1):
            key = key * _BASE + values[:, end - 1]
            ids = table.find(key)
            if end == start + 1 or (ids >= 0).any():
                found[start, end] = ids
    return found


@dataclass
class Model:
    languages: list[str]
    probabilities: np.ndarray  # pieces x languages
    path: str
    usual: np.ndarray | None = None  # for each language: log likelihood of a letter, and spread of a word's around its letters'
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def likelihoods(model: Model, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, over all its segmentations."""
    table, out = pieces(model.path), np.zeros((len(starts), len(model.languages)))
    known = np.vstack([model.probabilities, np.zeros(len(model.languages))])  # the last row is for no piece
    for rows, values in blocks(points, starts, lengths):
        forward = np.zeros((values.shape[1] + 1, len(rows), len(model.languages)))
        forward[0] = 1.0
        for (start, end), ids in piece_ids(table, values).items():
            if end == start + 1:
                forward[end] += forward[start] * np.where((ids >= 0)[:, None], known[ids], UNKNOWN)
            else:
                hit = np.flatnonzero(ids >= 0)
                forward[end, hit] += forward[start, hit] * known[ids[hit]]
        out[rows] = np.log(forward[-1])
    return out


def expected_counts(model: Model, points, starts, lengths, language: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the weighted words, each in its own language."""
    table, out = pieces(model.path), np.zeros_like(model.probabilities)
    for rows, values in blocks(points, starts, lengths):
        own, width = language[rows], values.shape[1]
        found = piece_ids(table, values)
        chance = {}
        for at, ids in found.items():
            p = np.where(ids >= 0, model.probabilities[ids, own], UNKNOWN if at[1] == at[0] + 1 else 0.0)
            chance[at] = p
        forward, backward = np.zeros((width + 1, len(rows))), np.zeros((width + 1, len(rows)))
        forward[0], backward[width] = 1.0, 1.0
        for start, end in found:  # in order of starts
            forward[end] += forward[start] * chance[start, end]
        for start, end in reversed(found):
            backward[start] += backward[end] * chance[start, end]
        scale = weight[rows] / forward[width]
        for (start, end), ids in found.items():
            hit = ids >= 0
            share = forward[start] * chance[start, end] * backward[end] * scale
            np.add.at(out, (ids[hit], own[hit]), share[hit])
    return out


def held_out(doc_id="doc_id") -> Column:
    """Every third document or so, by the crc32 of its id as text, is kept from training; so is a NULL id from both."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, sample_docs=SAMPLE_DOCS, rounds=ROUNDS, vocabulary: str | None = None) -> Model:
    """Piece probabilities for each non-NULL `lang` of `labelled` (doc_id, text, lang), from a bounded sample of it."""
    spark = labelled.sparkSession
    small_batches(spark)
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    labelled = labelled.where("lang is not null and text is not null")
    known = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r.lang: r.n for r in known.collect()}
    labelled = labelled.where(F.col("lang").isin(*counts))
    languages = sorted(counts)
    model = Model(languages, np.full((len(pieces(path).names), len(languages)), 1.0 / len(pieces(path).names)), path)
    if not languages:
        return model
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_docs / n))])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("language sample")), 11) / float(1 << 53)
    sample = labelled.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in slices(batches, "text"):
            points, first = lettered(column.to_pylist())
            starts, lengths = runs(points)
            text = np.searchsorted(first, starts, "right") - 1
            lang = np.array([languages.index(x) for x in part.column("lang").to_pylist()], dtype=np.int64)
            keys = run_hashes(points, starts, lengths) + lang[text].astype(np.uint64)
            _, seen, n = np.unique(keys, return_index=True, return_counts=True)
            spelled = [points[a : a + k].astype("<u4").tobytes().decode("utf-32-le") for a, k in zip(starts[seen], lengths[seen], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(lang[text][seen], pa.int32()), pa.array(spelled, pa.string()), pa.array(n)], ["lang", "word", "n"])

    words = sample.mapInArrow(counted, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stored(words, "language-words")

    for _ in range(rounds):
        current = spark.sparkContext.broadcast(model)

        def expected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(current.value.probabilities)
            for part in batches:
                spelled = part.column("word").to_pylist()
                points = np.frombuffer("".join(spelled).encode("utf-32-le"), dtype=np.uint32)
                lengths = np.array([len(w) for w in spelled], dtype=np.int64)
                language = np.asarray(part.column("lang"))
                total += expected_counts(current.value, points, np.cumsum(lengths) - lengths, lengths, language, np.asarray(part.column("n"), dtype=float))
            piece, lang = np.nonzero(total)
            columns = [pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])]
            yield pa.RecordBatch.from_arrays(columns, ["piece", "lang", "n"])

        # As many rows as pieces times languages, whatever the input.
        got = words.mapInArrow(expected, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        table = np.full_like(model.probabilities, SMOOTHING)
        table[np.asarray(got.column("piece")), np.asarray(got.column("lang"))] += np.asarray(got.column("n"))
        model = Model(languages, table / table.sum(axis=0), path)
    model.usual = usual_likelihoods(words, model)
    return model


def usual_likelihoods(words: DataFrame, model: Model) -> np.ndarray:
    """(languages, 2): over the training words (lang, word, n), what a letter of a language has as log likelihood, and how
    far a word lies from what its letters let expect (root of the mean square)."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(model.languages), 6))
        for part in batches:
            spelled = part.column("word").to_pylist()
            if not spelled:
                continue
            points = np.frombuffer("".join(spelled).encode("utf-32-le"), dtype=np.uint32)
            size = np.array([len(w) for w in spelled], dtype=np.int64)
            lang, n = np.asarray(part.column("lang")), np.asarray(part.column("n"), dtype=float)
            own = likelihoods(shared.value, points, np.cumsum(size) - size, size)[np.arange(len(size)), lang]
            for k, v in enumerate((np.ones(len(size)), size, own, size * size, size * own, own * own)):
                sums[:, k] += np.bincount(lang, weights=n * v, minlength=len(sums))
        columns = [pa.array(np.arange(len(sums), dtype=np.int32)), *[pa.array(c) for c in sums.T]]
        yield pa.RecordBatch.from_arrays(columns, ["lang", *NAMES])

    NAMES = ("n", "l", "p", "ll", "lp", "pp")
    rows = words.mapInArrow(work, "lang int, " + ", ".join(f"{c} double" for c in NAMES))
    found = np.zeros((len(model.languages), 2))
    for r in rows.groupBy("lang").agg(*[F.sum(c).alias(c) for c in NAMES]).collect():
        if r.l:
            rate = r.p / r.l
            found[r.lang] = rate, np.sqrt(max(0.0, (r.pp - 2 * rate * r.lp + rate * rate * r.ll) / r.n))
    return found


_memory: dict = {}


def text_likelihoods(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each text in each language, and how many words it has; 0 for one of marks alone, without a letter."""
    if _memory.get("model") != model.name:
        _memory.update(model=model.name, keys=np.empty(0, np.uint64), values=np.empty((0, len(model.languages)), np.float32))
    points, first = lettered(texts)
    starts, lengths = runs(points)
    text = np.searchsorted(first, starts, "right") - 1
    keys, seen, which = np.unique(run_hashes(points, starts, lengths), return_index=True, return_inverse=True)
    place = np.searchsorted(_memory["keys"], keys)
    known = np.zeros(len(keys), dtype=bool)
    inside = place < len(_memory["keys"])
    known[inside] = _memory["keys"][place[inside]] == keys[inside]
    values = np.empty((len(keys), len(model.languages)), np.float32)
    values[known] = _memory["values"][place[known]]
    new = seen[~known]
    values[~known] = likelihoods(model, points, starts[new], lengths[new])
    if len(_memory["keys"]) > REMEMBERED:
        _memory.update(keys=keys, values=values)
    else:
        _memory.update(keys=np.insert(_memory["keys"], place[~known], keys[~known]), values=np.insert(_memory["values"], place[~known], values[~known], axis=0))
    total = np.stack([np.bincount(text, weights=values[which, k], minlength=len(texts)) for k in range(len(model.languages))], axis=1)
    proper = np.searchsorted(first, np.flatnonzero(kinds()[points] == 2), "right") - 1
    n = np.bincount(text, minlength=len(texts))
    return total, np.where(np.bincount(proper, minlength=len(texts)) > 0, n, 0)


def predict(docs: DataFrame, model: Model, text="text") -> DataFrame:
    """`docs` with `lang_pred` and `score` (the posterior of that language, 0 to 1).

    A NULL text, or one without letters, is `und` with score 0; so is every text if no language was learned. Equal
    likelihoods give the first language by name. Columns of those names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, column in slices(batches, text):
            if model.languages:
                total, n = text_likelihoods(model, column.to_pylist())
                best = total.argmax(axis=1)
                score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best, n, strict=True)]
                score = np.where(n > 0, score, 0.0)
            else:
                names, score = [UNDETERMINED] * len(column), np.zeros(len(column))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names, pa.string()), pa.array(score)], [*rows.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(work, docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


# Below this posterior no language is more likely than all others together.
LEAST_SCORE = 0.5
# How far the mean word of a text may lie below what its letters let expect, in spreads of a word of the language: a lasting
# part, as texts differ in what they speak of, and one that chance takes off with the number of words.
LASTING, BY_CHANCE = 4.0, 8.0


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` without the rows whose text has no letters, no language above LEAST_SCORE, or no likelihood of its language.

    The posterior of a long text is near 1 for one of the languages whatever the text is. So its likelihood per word is held
    against that of the language's own training words: a text of noise or of a language that was not learned lies far
    below. Columns of `docs` keep their names and values.
    """
    spark, names = docs.sparkSession, docs.columns
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, column in slices(batches, "text"):
            if not model.languages:
                continue
            texts = column.to_pylist()
            total, n = text_likelihoods(model, texts)
            points, first = lettered(texts)
            letters_of = np.add.reduceat((points != 0).astype(np.int64), first[:-1])
            best = total.argmax(axis=1)
            score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            rate, spread = model.usual[best].T
            many = np.maximum(n, 1)
            below = (rate * letters_of - total[np.arange(len(texts)), best]) / many
            keep = (n > 0) & (score >= LEAST_SCORE) & (below <= spread * (LASTING + BY_CHANCE / np.sqrt(many)))
            yield rows.filter(pa.array(keep))

    return docs.mapInArrow(work, docs.schema).select(*names)
