"""Conversations brought into the order system, then user and assistant in turn.

Rows are judged first: blank, a duplicate of an earlier row, or truncated. A generalised LR
parser over the role grammar (:mod:`adloom.llm.glr`) then finds the cheapest edits that
give a legal conversation; among equally cheap ones those whose initials come first.

Rows are dealt out by ranges of (conversation, turn, digest of role and text), so that a
conversation of any length spreads over tasks. A task judges the rows of its range as a
stream and repairs the conversations that lie within it. The first and last of a range, and
any that outgrows ``BLOCK_BYTES``, leave in blocks: their judgements, one byte a row, meet
to be repaired together, and the edits go back to the blocks. That an equal row came in an
earlier turn is found beforehand by an aggregation over digests.

Defined results: a null role or text is one space, which makes the text blank; an empty
role, like any that does not begin with s, u or a, can't be kept. Rows without a turn come
first. Rows that share a turn are taken by the digest of role and text, so that repeated
rows are neighbours. Rows without an id form one conversation. Turns further apart than 64
bits have the largest gap. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from adloom.llm import common as C
from adloom.llm.glr import DELETE, INSERT, KEEP, Costs, Kind, Parser

# White space, signs that end a text, the roles, their grammar, the pairs of
# neighbours that are legal, and what a truncated row costs unless it is deleted.
SPACES = " \t\n\x0b\f\r"
ENDINGS = ".!?"
USER, ASSISTANT = "user", "assistant"
GRAMMAR = [
    ("T", ()),
    ("T", ("s", "B")),
    ("T", ("B",)),
    ("B", ("u", "a")),
    ("B", ("B", "u", "a")),
]
LEGAL = {"su", "ua", "au"}
TRUNCATED_COST = 5
#: Judgements of a row, written after its role's initial (x: none of s, u, a).
FINE, BLANK, DUPLICATE, TRUNCATED = "fbdt"
#: Bytes of one conversation's texts that a task holds.
BLOCK_BYTES = 4 << 20
#: Conversations that leave together.
OUT_ROWS = 500
LARGEST = (1 << 63) - 1

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPORTED = [part.split()[0] for part in REPORT.split(", ")]
STATS = (
    "n_blank long, n_duplicate long, n_truncated long, n_illegal long, n_turns long, "
    "first_turn long, last_turn long, first_initial string, last_initial string"
)
ROWS = "rows array<struct<role: string, text: string>>"
FOUND = f"conv_id long, seq long, {REPORT}, {STATS}, codes string, {ROWS}"
SOLVED = f"conv_id long, seq long, {REPORT}, edits array<string>, pending boolean"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by a hash of their place; ``present`` is false where a row
    was dropped, so that its conversation is not forgotten."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text, hit = spaced("role"), spaced("text"), F.col("_hit")
    rows = conversations.select("conv_id", "turn", role, text, (F.crc32(key) % 20).alias("_hit"))
    copies = F.array_repeat(hit != 0, F.when(hit == 3, 2).otherwise(1))
    return rows.select(
        "conv_id",
        "turn",
        F.when(hit == 4, USER).otherwise(F.col("role")).alias("role"),
        F.when(hit == 1, "")
        .when(hit == 2, F.translate("text", ENDINGS, ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(copies).alias("present"),
    )


def spaced(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(" ")).alias(column)


def judged(rows: DataFrame) -> DataFrame:
    """Rows with a digest of role and text, and initial and judgement as two letters."""
    initial = F.substring("role", 1, 1)
    ending = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    judgement = (
        F.when(ending == "", BLANK).when(~ending.isin(*ENDINGS), TRUNCATED).otherwise(FINE)
    )
    told = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumns(
        {
            "code": F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), judgement),
            "digest": F.unhex(F.sha2(told, 256)),
        }
    )


def repeats(rows: DataFrame) -> DataFrame:
    """Turn and digest of the rows that had an equal one in an earlier turn."""
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("_turn")
    narrow = rows.filter(~F.col("code").endswith(BLANK)).select("conv_id", "digest", turn)
    first = narrow.groupBy("conv_id", "digest").agg(
        F.min("_turn").alias("_first"), F.max("_turn").alias("_last")
    )
    first = first.filter("_first < _last").withColumnsRenamed({"conv_id": "_id", "digest": "_digest"})
    same = F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    later = narrow.join(first, same & (F.col("_turn") > F.col("_first")))
    return later.select("conv_id", F.col("_turn.turn").alias("turn"), "digest").distinct()


def kind(code: str) -> Kind:
    lost = code[1] in (BLANK, DUPLICATE)
    return ("" if lost else code[0]), TRUNCATED_COST * (code[1] == TRUNCATED), lost


def parser() -> Parser:
    return Parser(GRAMMAR, "ua", Costs())


#: Every code that a row can have; a parser looks them up instead of taking them apart.
KINDS = {a + b: kind(a + b) for a in "suax" for b in (FINE, BLANK, DUPLICATE, TRUNCATED)}


@dataclass
class Stats:
    """What is counted over consecutive rows of a conversation."""

    n_blank: int = 0
    n_duplicate: int = 0
    n_truncated: int = 0
    n_illegal: int = 0
    n_turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first_initial: str | None = None
    last_initial: str | None = None

    def add(self, turn: int | None, code: str) -> None:
        initial, judgement = code
        if judgement == BLANK:
            self.n_blank += 1
        elif judgement == DUPLICATE:
            self.n_duplicate += 1
        elif judgement == TRUNCATED:
            self.n_truncated += 1
        if self.last_initial is None:
            self.first_initial = initial
        elif self.last_initial + initial not in LEGAL:
            self.n_illegal += 1
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn

    def then(self, later: Stats) -> Stats:
        """Both together, where ``later`` follows."""
        met = self.last_turn is not None and self.last_turn == later.first_turn
        pair = (self.last_initial or "") + (later.first_initial or "")
        return Stats(
            self.n_blank + later.n_blank,
            self.n_duplicate + later.n_duplicate,
            self.n_truncated + later.n_truncated,
            self.n_illegal + later.n_illegal + (len(pair) == 2 and pair not in LEGAL),
            self.n_turns + later.n_turns - met,
            later.first_turn if self.first_turn is None else self.first_turn,
            self.last_turn if later.last_turn is None else later.last_turn,
            self.first_initial or later.first_initial,
            later.last_initial or self.last_initial,
        )

    def report(self) -> tuple[int, int, int, int, int]:
        gaps = 0
        if self.first_turn is not None:
            gaps = min(self.last_turn - self.first_turn + 1 - self.n_turns, LARGEST)
        return gaps, self.n_blank, self.n_duplicate, self.n_truncated, self.n_illegal

    def values(self) -> tuple:
        return tuple(vars(self).values())


def edited(
    rows: Iterable[dict], edits: Iterable[str], pending: bool = False
) -> tuple[list[dict], bool]:
    """The rows after their edits. ``pending``: the row before was a user's, here and in
    what is returned. Edits beyond the rows are inserts."""
    made, source = [], iter(rows)
    for each in edits:
        for edit in each:
            row = {"role": "", "text": ""} if edit == INSERT else next(source)
            if edit == DELETE:
                continue
            if edit != KEEP:
                row = {"role": ASSISTANT if pending else USER, "text": row["text"]}
            made.append(row)
            pending = row["role"][:1] == USER[0]
    return made, pending


@dataclass
class Block:
    """Rows of one conversation that are at hand."""

    conv_id: int | None
    open: bool
    stats: Stats = field(default_factory=Stats)
    codes: list[str] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    held: int = 0

    def add(self, turn: int | None, code: str, role: str, text: str) -> None:
        self.stats.add(turn, code)
        self.codes.append(code)
        self.rows.append({"role": role, "text": text})
        self.held += len(role) + len(text)

    def solved(self, parse: Parser) -> tuple:
        cost, edits = parse.repair(map(KINDS.__getitem__, self.codes))
        made, _ = edited(self.rows, edits)
        nothing = (None,) * len(vars(self.stats))
        return (self.conv_id, None, *self.stats.report(), cost, "".join(edits), *nothing, None, made)

    def left(self, seq: int) -> tuple:
        return (self.conv_id, seq, *(None,) * 7, *self.stats.values(), "".join(self.codes), self.rows)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches; a row's texts may be long, so batches also end by bytes."""
    held: list[tuple] = []
    n = 0
    for row in rows:
        held.append(row)
        n += sum(len(r["text"]) for r in row[-1]) if isinstance(row[-1], list) else 0
        if len(held) >= size or n >= BLOCK_BYTES:
            yield batch_of(held, schema)
            held, n = [], 0
    if held:
        yield batch_of(held, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, f.type) for column, f in zip(zip(*rows), schema)], schema=schema
    )


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def ranged(rows: DataFrame) -> DataFrame:
    """Per conversation or block of one: what was found, written to the shared folder."""
    schema = arrow_schema(FOUND)
    marked = judged(rows.filter("present"))
    whole = marked.withColumn("_kind", F.lit(1))
    earlier = repeats(marked).withColumn("_kind", F.lit(0))
    gone = rows.filter(~F.col("present")).select("conv_id", F.lit(2).alias("_kind"))
    columns = ("conv_id", "turn", "digest", "_kind", "code", "role", "text")
    both = whole.unionByName(earlier, True).unionByName(gone, True).select(*columns)
    keys = columns[:3]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        seq = TaskContext.get().partitionId() << 32
        parse, block, before, mark = parser(), None, None, None
        for batch in batches:
            for conv_id, turn, digest, what, code, role, text in zip(
                *(batch.column(c).to_pylist() for c in columns)
            ):
                if block is None or block.conv_id != conv_id:
                    if block is not None:
                        yield block.left(seq) if block.open else block.solved(parse)
                    # The first of a range may have begun in the one before.
                    block, before, mark = Block(conv_id, block is None), None, None
                    seq += 1
                if what == 2:
                    continue
                place = turn, digest
                if what == 0:
                    mark = place
                    continue
                if code[1] != BLANK and place in (before, mark):
                    code = code[0] + DUPLICATE
                before = place
                block.add(turn, code, role, text)
                if block.held > BLOCK_BYTES:
                    yield block.left(seq)
                    block, seq = Block(conv_id, True), seq + 1
        if block is not None:
            # The last of a range may go on in the next one.
            yield block.left(seq)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(work(batches), schema, OUT_ROWS)

    ordered = both.repartitionByRange(*keys).sortWithinPartitions(*keys, "_kind")
    return C.staged(ordered.mapInArrow(run, FOUND), "ranges")


def by_conversation(rows: DataFrame, work: Callable, ddl: str) -> DataFrame:
    """Hand the blocks of each conversation (the first column) in order to ``work``."""
    schema = arrow_schema(ddl)
    columns = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (
            dict(zip(columns, values))
            for batch in batches
            for values in zip(*(batch.column(c).to_pylist() for c in columns))
        )
        return batches_of(work(stream), schema, 1)

    ordered = rows.repartition(columns[0]).sortWithinPartitions(columns[0], "seq")
    return ordered.mapInArrow(run, ddl)


def solve_blocks(stream: Iterator[dict]) -> Iterator[tuple]:
    """Edits of every block, and a row without a block for the conversation."""
    parse, names = parser(), list(vars(Stats()))
    for conv_id, rows in groupby(stream, itemgetter("conv_id")):
        stats, codes, blocks = [], [], []
        for row in rows:
            stats.append(Stats(**{name: row[name] for name in names}))
            codes.append(row["codes"])
            blocks.append((row["seq"], len(row["codes"]) // 2))
        whole = "".join(codes)
        cost, edits = parse.repair(KINDS[whole[i : i + 2]] for i in range(0, len(whole), 2))
        report = reduce(Stats.then, stats, Stats()).report()
        yield (conv_id, None, *report, cost, "".join(edits), None, None)
        at, pending = 0, False
        for number, (seq, size) in enumerate(blocks):
            mine = edits[at : at + size + (number == len(blocks) - 1)]
            yield (conv_id, seq, *(None,) * 7, mine, pending)
            at += size
            pending = user_last(whole[2 * (at - size) : 2 * at : 2], mine, pending)


def user_last(initials: str, edits: list[str], pending: bool) -> bool:
    """Whether the last row that is left is a user's."""
    for initial, each in zip(initials, edits):
        for edit in each:
            if edit != DELETE:
                pending = initial == "u" if edit == KEEP else not pending
    return pending


def repaired(rows: DataFrame) -> DataFrame:
    """Repair conversations (``conv_id``, ``turn``, ``role``, ``text``, ``present``).

    A conversation is one row with its report and ``rows``, the repaired ones. If it lay in
    several blocks, ``rows`` is null in that row, and more rows, numbered by ``seq``, have
    the repaired rows of its blocks and no report.
    """
    found = ranged(rows.select("conv_id", "turn", spaced("role"), spaced("text"), "present"))
    blocks = found.filter("seq IS NOT NULL")
    solved = by_conversation(blocks.drop("rows", *REPORTED), solve_blocks, SOLVED)
    solved = C.staged(solved, "edits")
    # A block's number is its own, whatever its conversation.
    edits = solved.filter("seq IS NOT NULL").select("seq", "edits", "pending")
    pieces = blocks.select("conv_id", "seq", "rows").join(edits, "seq")
    pieces = pieces.select("conv_id", "seq", "edits", "pending", "rows")
    made = pieces.mapInArrow(apply_edits, f"conv_id long, seq long, {ROWS}")
    kept = ("conv_id", "seq", *REPORTED)
    whole = found.filter("seq IS NULL").select(*kept, "rows")
    apart = solved.filter("seq IS NULL").select(*kept)
    return whole.unionByName(apart, True).unionByName(made, True)


def apply_edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given = zip(*(batch.column(c).to_pylist() for c in ("edits", "pending", "rows")))
        made = [edited(rows, edits, pending)[0] for edits, pending, rows in given]
        column = pa.array(made, batch.schema.field("rows").type)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("seq"), column], names=["conv_id", "seq", "rows"]
        )


def lines() -> Column:
    return F.transform("rows", lambda row: F.concat(row.role, F.lit(":"), row.text))


def digest_blocks(stream: Iterator[dict]) -> Iterator[tuple]:
    for conv_id, rows in groupby(stream, itemgetter("_id")):
        digest, begun = hashlib.sha256(), False
        for row in rows:
            if row["n"]:
                digest.update((("\n" if begun else "") + row["piece"]).encode())
                begun = True
        yield conv_id, digest.hexdigest()


def digests(conversations: DataFrame) -> DataFrame:
    """The report over damaged conversations, with a digest of each repaired one."""
    found = repaired(damaged(conversations))
    joined = F.array_join(lines(), "\n")
    digest = F.sha2(joined, 256).alias("repaired_sha256")
    whole = found.filter("seq IS NULL AND rows IS NOT NULL").select("conv_id", *REPORTED, digest)
    pieces = found.filter("seq IS NOT NULL").select(
        F.col("conv_id").alias("_id"), "seq", F.size("rows").alias("n"), joined.alias("piece")
    )
    streamed = by_conversation(pieces, digest_blocks, "_id long, repaired_sha256 string")
    same = F.col("conv_id").eqNullSafe(F.col("_id"))
    apart = found.filter("seq IS NULL AND rows IS NULL").select("conv_id", *REPORTED)
    return whole.unionByName(apart.join(streamed, same).drop("_id"))
