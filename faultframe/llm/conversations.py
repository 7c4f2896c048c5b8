"""Faults of conversations and their cheapest structural repair.

A repaired conversation has the role initials (s?(ua)+)?, so its grammar has four states. What the rest of a conversation
costs depends only on the signature of its remaining rows: one symbol for each row, made of role and fault. Equal endings
are therefore one node of an automaton that shares suffixes. Signatures of all conversations are made distinct, dealt in
the order of their reversed spelling, and read one after the other: what two neighbours have in common at the end is
there already, and each new node finds its cost-to-go and best edit for the four grammar states from the node behind it.
An audit is read off along these edits.

Costs: keep 0, rerole 3, delete 4, insert 3; blank and duplicate rows have to go, a truncated row that stays adds 3.
"""

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.joins import attach_counted
from .shared import small_batches, stored

# Turn numbers whose rows one task puts in order at a time; a parameter of the shuffle, not of the result.
RUN_TURNS = 1024
# Frequent signatures up to this length are broadcast with their audits.
SHORT = 1024

# Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEXT = (USER, USER, ASSISTANT, USER)  # where an inserted or reroled row leads
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
GONE = "x"  # the symbol of a row that has to go
NEVER = 1 << 60

REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Node:
    """Cost-to-go and the first of the best edits for each grammar state; '' ends the conversation."""

    __slots__ = ("costs", "edits")

    def __init__(self, costs: tuple, edits: tuple):
        self.costs, self.edits = costs, edits


def closed(options: list[dict[str, int]]) -> Node:
    """The best of each state's edits and of insertions, the ASCII-least among equals. Targets are unique for each edit,
    so the least first edit gives the least audit."""
    best = [min(o.values(), default=NEVER) for o in options]
    costs = [min(best[g], 3 + best[NEXT[g]], 6 + best[NEXT[NEXT[g]]]) for g in range(4)]
    edits = [min(e for e, c in [*o.items(), ("I", 3 + costs[NEXT[g]])] if c == costs[g]) for g, o in enumerate(options)]
    return Node(tuple(costs), tuple(edits))


END = closed([{"": 0} if g in ENDS else {} for g in range(4)])


@cache
def stepped(symbol: str, behind: tuple) -> Node:
    """The node of `symbol` before a node of costs `behind`. Costs are taken relative to the least, so few nodes differ."""
    extra = 3 if symbol.isupper() else 0
    options = []
    for g in range(4):
        found = {"D": 4 + behind[g]}
        if symbol != GONE:
            found["R"] = 3 + extra + behind[NEXT[g]]
            if (g, symbol.lower()) in KEEP:
                found["K"] = extra + behind[KEEP[g, symbol.lower()]]
        options.append(found)
    return closed(options)


class Suffixes:
    """The nodes on the path of the latest signature, from its end; the next signature goes on from the common part."""

    def __init__(self):
        self.spelling, self.path, self.made = "", [END], 0

    def read(self, signature: str) -> tuple[int, str]:
        """Cost and audit of a signature."""
        turned, shared = signature[::-1], 0
        for a, b in zip(self.spelling, turned, strict=False):
            if a != b:
                break
            shared += 1
        del self.path[shared + 1 :]
        for symbol in turned[shared:]:
            behind = self.path[-1].costs
            least = min(behind)
            node = stepped(symbol, tuple(c - least for c in behind))
            self.path.append(Node(tuple(c + least for c in node.costs), node.edits))
        self.made += len(turned) - shared
        self.spelling = turned
        return self.path[-1].costs[START], "".join(edit for edit, _, _ in self.walk(signature))

    def walk(self, signature: str) -> Iterator[tuple[str, int, int]]:
        """(edit, row, state behind it) along the best edits."""
        row, state = 0, START
        while edit := self.path[len(signature) - row].edits[state]:
            if edit == "K":
                state = KEEP[state, signature[row].lower()]
            elif edit != "D":
                state = NEXT[state]
            yield edit, row, state
            row += edit != "I"


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, tie): NULL role and text as one space; rows of one turn follow a hash, equal ones together."""
    one = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), one("role"), one("text"))
    return rows.withColumn("tie", F.xxhash64("role", "text"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, initial, fault) of `ordered` rows: the first of blank, duplicate, truncated, or ok."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    narrow = rows.select(
        "conv_id", "turn", "tie", F.xxhash64("text", "role").alias("other"), F.substring("role", 1, 1).alias("initial"), last.alias("last")
    )
    seen = F.row_number().over(W.partitionBy("conv_id", "tie", "other").orderBy("turn")) > 1
    fault = F.when(F.col("last") == "", "blank").when(seen, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("ok")
    return narrow.withColumn("fault", fault).drop("other", "last")


def signatures(found: DataFrame) -> DataFrame:
    """Stored, from `faults`: (conv_id, gaps, blank, duplicate, truncated, illegal, signature) of every conversation.

    The signature has one symbol for each row: x if it has to go, else the role's initial (o for another), upper case if
    it is truncated. Rows are put in order in runs of turn numbers; runs are joined as strings.
    """
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    rows = found.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / RUN_TURNS), F.lit(-(1 << 62))).alias("run"), "fault",
        F.struct("turn", "tie", symbol.alias("symbol"), known.alias("role")).alias("row"),
    )
    spelled = lambda field: F.array_join(F.transform("rows", lambda x: x[field]), "")
    kinds = ("blank", "duplicate", "truncated")
    runs = (
        rows.groupBy("conv_id", "run")
        .agg(F.array_sort(F.collect_list("row")).alias("rows"), *[F.count_if(F.col("fault") == k).alias(k) for k in kinds])
        .select(
            "conv_id", *kinds,
            F.array_min(F.transform("rows", lambda x: x["turn"])).alias("low"),
            F.array_max(F.transform("rows", lambda x: x["turn"])).alias("high"),
            F.size(F.array_distinct(F.filter(F.transform("rows", lambda x: x["turn"]), lambda x: x.isNotNull()))).alias("turns"),
            F.struct("run", spelled("symbol").alias("symbol"), spelled("role").alias("role")).alias("part"),
        )
    )
    joined = lambda field: F.array_join(F.transform("parts", lambda x: x[field]), "")
    whole = runs.groupBy("conv_id").agg(
        *[F.sum(k).alias(k) for k in kinds],
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
        F.array_sort(F.collect_list("part")).alias("parts"),
    )
    pairs = F.length("roles") - 1 - F.regexp_count("roles", F.lit("(?=su|ua|au)"))
    whole = whole.withColumn("roles", joined("role"))
    return stored(
        whole.select("conv_id", "gaps", *kinds, pairs.cast("long").alias("illegal"), joined("symbol").alias("signature")), "signatures"
    )


def audits(kinds: DataFrame) -> DataFrame:
    """(signature, n, cost, audit) of distinct signatures (signature, n).

    Reversed spellings are dealt in ranges and sorted, so that an ending that many signatures share is worked out once in
    a task; only the endings at the borders of the ranges are worked out twice. A task holds one path.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Suffixes()
        for batch in batches:
            found = [automaton.read(s) for s in batch.column("signature").to_pylist()]
            columns = [batch.column("signature"), batch.column("n"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["signature", "n", "cost", "audit"])

    tasks = int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kinds.repartitionByRange(tasks, F.reverse("signature")).sortWithinPartitions(F.reverse("signature"))
    return dealt.select("signature", "n").mapInArrow(work, "signature string, n long, cost long, audit string")


def reports(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Stored: the columns REPORT of each conversation of `ordered` rows, and of those of `ids` without rows."""
    found = signatures(faults(rows))
    kinds = stored(found.groupBy("signature").agg(F.count(F.lit(1)).alias("n")), "distinct-signatures")
    short = F.when(F.length("signature") <= SHORT, F.col("n")).otherwise(0)
    repairs = stored(audits(kinds).withColumn("n", short), "audits")
    names = [c.split()[0] for c in REPORT.split(", ")]
    found = attach_counted(found, repairs, "signature", found.count()).select(*names)
    if ids is not None:
        every = ids.select(F.col("conv_id").cast("long").alias("id")).union(found.select("conv_id")).distinct()
        found = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("id", "conv_id")
        found = found.na.fill(0, names[1:-1]).na.fill("", ["audit"]).select(*names)
    return stored(found, "reports")


class Replay:
    """Carries out an audit on the rows of a conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield "I", ROLE[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what stands before this row and of the row, unless it is deleted."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEEP[self.state, role[0]]
            yield edit, role, text
        elif edit == "R":
            self.state = NEXT[self.state]
            yield edit, ROLE[self.state], text


def replayed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's report ahead of its rows, in order; one conversation's rows follow each other in a task."""
    names = found.columns
    heads = found.select(*names, F.lit(0).alias("kind"), *[F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("tie", "long"), ("role", "string"), ("text", "string"))])
    body = rows.withColumn("kind", F.lit(1))
    both = heads.unionByName(body, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "tie")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, pos, edit, role, text): the rows of the repaired conversations, from `ordered` rows and their `reports`."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, name, pos = Replay(""), None, 0
        for batch in batches:
            out = []
            for conv, kind, audit, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "kind", "audit", "role", "text")], strict=True):
                if kind == 0:
                    made = list(replay.inserted())
                    out += [(name, pos + k, *m) for k, m in enumerate(made)]
                    replay, name, pos = Replay(audit), conv, 0
                    continue
                made = list(replay.row(role, text))
                out += [(name, pos + k, *m) for k, m in enumerate(made)]
                pos += len(made)
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in out], kinds)
        out = [(name, pos + k, *m) for k, m in enumerate(replay.inserted())]
        yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in out], kinds)

    kinds = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    small_batches(rows.sparkSession)
    return replayed(rows, found.select("conv_id", "audit")).mapInArrow(work, "conv_id long, pos long, edit string, role string, text string")


def with_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`reports` with repaired_sha256, the SHA-256 of the repaired rows `role:text`, joined by newlines.

    A digest has to read a conversation from front to back; its rows pass as a stream, and a task holds one batch.
    """
    names = found.columns
    small_batches(rows.sparkSession)

    class Digest:
        def __init__(self, report: dict):
            self.report, self.replay, self.sha, self.empty = report, Replay(report["audit"]), hashlib.sha256(), True

        def add(self, made):
            for _, role, text in made:
                self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
                self.empty = False

        def done(self) -> dict:
            self.add(self.replay.inserted())
            return self.report | {"repaired_sha256": self.sha.hexdigest()}

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = None
        for batch in batches:
            schema, out = pa.schema([*[batch.schema.field(c) for c in names], ("repaired_sha256", pa.string())]), []
            heads = iter(batch.select(names).filter(pc.equal(batch.column("kind"), 0)).to_pylist())
            for kind, role, text in zip(*[batch.column(c).to_pylist() for c in ("kind", "role", "text")], strict=True):
                if kind == 0:
                    out += [digest.done()] if digest else []
                    digest = Digest(next(heads))
                else:
                    digest.add(digest.replay.row(role, text))
            yield pa.RecordBatch.from_pylist(out, schema)
        if digest:
            yield pa.RecordBatch.from_pylist([digest.done()], schema)

    return replayed(rows, found).mapInArrow(work, f"{REPORT}, repaired_sha256 string")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The repaired rows (conv_id, pos, edit, role, text), and a report with digest for each conversation.

    `rows` (conv_id, turn, role, text, any others) are taken by turn, NULL turns first; rows of one turn follow a hash of
    role and text, so equal rows stand side by side. NULL roles and texts are one space, which makes the text blank; a NULL
    conv_id is a conversation like any other. Conversations of `ids` without rows are reported with zeros, an empty audit
    and the digest of an empty text. An empty table gives empty tables.
    """
    rows = ordered(rows)
    found = reports(rows, ids)
    return repaired(rows, found), with_digests(rows, found)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with planted faults, by the CRC-32 of `conv_id:turn` modulo 20; NULLs are one space.

    0 drops a row, 1 empties its text, 2 removes its marks [.!?], 3 repeats it, 4 makes it the user's.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), draw.alias("draw")).where("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")
