"""Repair of conversation structure by cheapest edits, with Four-Russians block tables.

A conversation's roles have to read `(s?(ua)+)?`, told by four states. From a row on, the least cost to the end is a vector
over the states. As inserts lead from state to state, its entries lie close together, so that less their minimum only a few
vectors exist. For each block of BLOCK row symbols and each such vector behind the block, a table holds the vector before it
and what to add. A conversation is read from its end, a block a lookup. To trace the edits, which go from the start, the
blocks of a chunk are looked up again and each is expanded backward into the vectors between its rows; then at each row the
ASCII-least edit that keeps to the vector is taken. Each edit leads to one state, so this gives the ASCII-least of all
cheapest edits, which a trace from costs of beginnings would not.

Rows without texts pass the first exchange; the second takes the texts. Both deal by conversation and stream sorted rows, in
memory bounded by CHUNK symbols and one audit, however long a conversation is. A hot conversation is one task's stream, as a
SHA-256 has to read it in order; all else goes on beside it.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from subgrade.llm.common import map_batches, table
from subgrade.llm.crc import crc32_sql

BLOCK, CHUNK = 3, 768
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after s, after u, after a. What comes next by an insert or a new role, and where it leads.
FINAL = (0, 2 * INSERT, INSERT, 0)
NEXT_ROLE, NEXT_STATE = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: Where keeping a row of an initial leads from each state, if it may be kept there.
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None,) * 4}
#: A row's symbol: its role's initial (o: another), upper case if truncated; b blank, d duplicate. Both have to go.
SYMBOLS = "suaoSUAObd"
CODE = {s: i for i, s in enumerate(SYMBOLS)}
WHITE = " \t\n\x0b\x0c\r"

EDITS = "conv_id long, position long, role string, text string, edit string"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _choices(symbol: str, behind: tuple[int, ...]) -> list[list[tuple[str, int, int]]]:
    """For each state the edits that consume the row: letter, cost with what follows, next state."""
    late = TRUNCATED * symbol.isupper()
    out = []
    for q in range(4):
        ways = [("D", DELETE + behind[q], q)]
        if symbol not in "bd":
            kept = KEEP[symbol.lower()][q]
            if kept is not None:
                ways.append(("K", late + behind[kept], kept))
            ways.append(("R", late + REROLE + behind[NEXT_STATE[q]], NEXT_STATE[q]))
        out.append(ways)
    return out


def _before(symbol: str, behind: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a row, from that behind it."""
    v = [min(cost for _, cost, _ in ways) for ways in _choices(symbol, behind)]
    v[2], v[3] = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + v[2]), min(v[1], INSERT + v[2]), v[2], v[3]


def _normal(v: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(v)
    return tuple(x - least for x in v), least


class BlockTables:
    """All normalised vectors reachable from a conversation's end; transitions of single rows and of blocks; the edits."""

    def __init__(self, length: int = BLOCK):
        self.vectors = [_normal(FINAL)[0]]
        self.number = {self.vectors[0]: 0}
        steps: list[list[tuple[int, int]]] = []
        for v in self.vectors:  # grows meanwhile
            row = []
            for s in SYMBOLS:
                w, add = _normal(_before(s, v))
                if w not in self.number:
                    self.number[w] = len(self.vectors)
                    self.vectors.append(w)
                row.append((self.number[w], add))
            steps.append(row)
        #: One row: [vector behind][symbol] -> vector before, what to add.
        self.one_to, self.one_add = (np.array([[x[k] for x in row] for row in steps], dtype=np.int64) for k in (0, 1))
        #: A block: [block's number][vector behind] -> the same. Numbers read a block as digits, its first row highest.
        n = len(SYMBOLS)
        to, add = self.one_to.T, self.one_add.T
        for _ in range(length - 1):
            # one more row before each shorter block
            to, add = (
                np.concatenate([self.one_to[to, s] for s in range(n)]),
                np.concatenate([add + self.one_add[to, s] for s in range(n)]),
            )
        self.length, self.to, self.add = length, to.tolist(), add.tolist()
        self.step = self.one_to.tolist()

    def blocks(self, symbols: str) -> list[str]:
        """symbols in blocks, all full but the first."""
        first = len(symbols) % self.length
        return ([symbols[:first]] if first else []) + [symbols[i : i + self.length] for i in range(first, len(symbols), self.length)]

    def look_up(self, block: str, behind: int) -> tuple[int, int]:
        """The vector before a block, and what to add."""
        if len(block) < self.length:
            base = 0
            for s in reversed(block):
                base, behind = base + int(self.one_add[behind, CODE[s]]), self.step[behind][CODE[s]]
            return behind, base
        k = 0
        for s in block:
            k = k * len(SYMBOLS) + CODE[s]
        return self.to[k][behind], self.add[k][behind]

    def behind_each(self, symbols: str, end: int) -> list[int]:
        """The vector behind each row of a chunk: lookups give those behind each block, and each block is expanded backward."""
        parts = self.blocks(symbols)
        ends = [end]
        for block in reversed(parts[1:]):
            ends.append(self.look_up(block, ends[-1])[0])
        out: list[int] = []
        for block, v in zip(parts, reversed(ends)):
            inner = [v]
            for s in reversed(block[1:]):
                inner.append(self.step[inner[-1]][CODE[s]])
            out += reversed(inner)
        return out

    @functools.cache
    def edits(self, symbol: str, behind: int, state: int) -> tuple[str, int]:
        """The ASCII-least cheapest letters up to and with the row's own, from a state; the next state."""
        ways, before = _choices(symbol, self.vectors[behind]), _before(symbol, self.vectors[behind])
        letters = ""
        while True:
            fits = {letter: to for letter, cost, to in ways[state] if cost == before[state]}
            if INSERT + before[NEXT_STATE[state]] == before[state]:
                fits["I"] = NEXT_STATE[state]
            least = min(fits)
            letters, state = letters + least, fits[least]
            if least != "I":
                return letters, state


@functools.cache
def block_tables(length: int = BLOCK) -> BlockTables:
    return BlockTables(length)


def _rows(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls of the latter two as one space, and a digest that orders the rows of one turn."""
    rows = convs.select(
        F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"),
        F.coalesce(F.col("`role`"), F.lit(" ")).alias("role"), F.coalesce(F.col("`text`"), F.lit(" ")).alias("text"),
    )
    return rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def _symbol() -> Column:
    """A row's symbol but for duplicates, which need the others."""
    bare = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), initial).otherwise(F.upper(initial))


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


CHUNKS = "conv_id long, turn long, digest string, chunk long, symbols string, behind int, cost long"


def _emit(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [pa.field(n, kinds[t]) for n, t in (c.split() for c in schema.split(","))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=pa.schema(fields))
    rows.clear()
    return batch


def _settled(own: Iterator[tuple]) -> Iterator[tuple[str, int | None, str]]:
    """Symbol, turn and digest of each row, from a conversation's last to its first: a row is the first of its content if a
    mark comes next, and a duplicate otherwise."""
    held = None
    for _, turn, digest, is_row, symbol in own:
        if not is_row:
            yield held
            held = None
            continue
        if held:
            yield ("b" if held[0] == "b" else "d", *held[1:])
        held = (symbol, turn, digest)


def _chunks(rows: DataFrame) -> DataFrame:
    """The symbols of each conversation in chunks of at most CHUNK rows, numbered from its end, with the key of the chunk's
    first row, the vector behind it and the cost of all from the chunk on.

    The least place of each (conversation, content) is a mark beside the rows; a row that no mark stands before is a
    duplicate. So neither a hot conversation nor a hot content meets in a join or a window.
    """
    small = rows.select("conv_id", "turn", "digest", F.lit(1).alias("is_row"), _symbol().alias("symbol"))
    marks = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("at"))
    marks = marks.select("conv_id", F.col("at.turn").alias("turn"), "digest", F.lit(0).alias("is_row"), F.lit("").alias("symbol"))
    dealt = small.unionByName(marks).repartition("conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", F.col("turn").desc_nulls_last(), F.desc("digest"), F.desc("is_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, out = block_tables(), []
        for conv, own in itertools.groupby(_values(batches), key=lambda r: r[0]):
            settled, behind, total = _settled(own), 0, 0
            for chunk in itertools.count():
                part = list(itertools.islice(settled, CHUNK))
                if not part:
                    break
                symbols, end = "".join(r[0] for r in reversed(part)), behind
                for block in reversed(tables.blocks(symbols)):
                    behind, add = tables.look_up(block, behind)
                    total += add
                out.append((conv, part[-1][1], part[-1][2], chunk, symbols, end, total + tables.vectors[behind][0]))
                if len(out) >= 500:
                    yield _emit(out, CHUNKS)
        if out:
            yield _emit(out, CHUNKS)

    return map_batches(dealt, run, CHUNKS)


def _streams(convs: DataFrame, all_ids: DataFrame) -> DataFrame:
    """For each conversation a row of its own (part 0), its chunks (1) and its rows (2), in order, a chunk before its rows."""
    rows = _rows(convs)
    nothing = {"turn": "long", "digest": "string", "role": "string", "text": "string", "chunk": "long", "symbols": "string", "behind": "int", "cost": "long"}
    columns = ["conv_id", "part", *nothing]

    def shaped(df: DataFrame, part: int) -> DataFrame:
        missing = {c: F.lit(None).cast(t) for c, t in nothing.items() if c not in df.columns}
        return df.withColumns({**missing, "part": F.lit(part)}).select(columns)

    ids = all_ids.select(F.col("`conv_id`").cast("long").alias("conv_id")).distinct()
    dealt = shaped(ids, 0).unionByName(shaped(_chunks(rows), 1)).unionByName(shaped(rows, 2)).repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", F.col("part") > 0, F.col("turn").asc_nulls_first(), "digest", "part", F.desc("chunk"))


def _walk(own: Iterator[tuple]) -> Iterator[tuple]:
    """A conversation's rows with their edits: turn, role, text (None, None, None after the last), symbol, and the letters
    with the roles they give."""
    tables, state, queue, now = block_tables(), 0, deque(), iter(())
    for _, part, turn, _, role, text, _, symbols, behind, cost in own:
        if part == 0:
            continue
        if part == 1:
            queue.append((symbols, behind))
            continue
        step = next(now, None)
        if step is None:
            symbols, behind = queue.popleft()
            now = iter(list(zip(symbols, tables.behind_each(symbols, behind))))
            step = next(now)
        letters, _ = tables.edits(*step, state)
        given = []
        for letter in letters:
            given.append((letter, role if letter == "K" else None if letter == "D" else NEXT_ROLE[state]))
            if letter in "IR":
                state = NEXT_STATE[state]
            elif letter == "K":
                state = KEEP[step[0].lower()][state]
        yield turn, role, text, step[0], given
    given = []
    while FINAL[state]:
        given.append(("I", NEXT_ROLE[state]))
        state = NEXT_STATE[state]
    yield None, None, None, "", given


def repaired_turns(convs: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text and edit (K kept, R given another role, I inserted) of each repaired turn.

    Input: conv_id, turn, role, text; other columns are not read. A conversation's rows are taken by turn, nulls first, rows
    of one turn by the MD5 of role and text. Null roles and texts count as one space. Blank rows and repeats go. A null
    conv_id is a conversation. A role without an initial of system, user or assistant, also an empty one, can't be kept.
    An empty table, or a conversation of which nothing is kept, gives no rows.
    """
    empty = convs.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, own in itertools.groupby(_values(batches), key=lambda r: r[0]):
            position = 0
            for _, _, text, _, given in _walk(own):
                for letter, role in given:
                    if letter != "D":
                        out.append((conv, position, role, "" if letter == "I" else text, letter))
                        position += 1
                if len(out) >= 500:
                    yield _emit(out, EDITS)
        if out:
            yield _emit(out, EDITS)

    return map_batches(_streams(convs, empty), run, EDITS)


def repair_report(convs: DataFrame, all_ids: DataFrame | None = None) -> DataFrame:
    """One row for each conv_id of all_ids (or convs): faults, illegal neighbours, cost, the edits' letters and the SHA-256
    of the repaired `role:text` lines. Rules as in repaired_turns; an id without rows has zeros, no letters, no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, own in itertools.groupby(_values(batches), key=lambda r: r[0]):
            first_turn, last_turn, distinct, faults, illegal, cost = None, None, 0, {"b": 0, "d": 0, "late": 0}, 0, 0
            initial, letters, lines, digest = None, [], 0, hashlib.sha256()
            for turn, role, text, symbol, given in _walk(own):
                if symbol:
                    if turn is not None and turn != last_turn:
                        first_turn, last_turn, distinct = turn if first_turn is None else first_turn, turn, distinct + 1
                    fault = "late" if symbol.isupper() else symbol
                    if fault in faults:
                        faults[fault] += 1
                    if initial is not None and initial + role[:1] not in ("su", "ua", "au"):
                        illegal += 1
                    initial = role[:1]
                for letter, given_role in given:
                    letters.append(letter)
                    cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[letter] + TRUNCATED * (letter in "KR" and symbol.isupper())
                    if letter != "D":
                        digest.update(("\n" * (lines > 0) + f"{given_role}:{'' if letter == 'I' else text}").encode())
                        lines += 1
            gaps = last_turn - first_turn + 1 - distinct if distinct else 0
            out.append((conv, gaps, faults["b"], faults["d"], faults["late"], illegal, cost, "".join(letters), digest.hexdigest()))
            if len(out) >= 500:
                yield _emit(out, REPORT)
        if out:
            yield _emit(out, REPORT)

    return map_batches(_streams(convs, convs if all_ids is None else all_ids), run, REPORT)


def damaged(convs: DataFrame) -> DataFrame:
    """convs with the query's damages, by the CRC-32 of `conv_id:turn`; nulls are one space."""
    space = F.lit(" ")
    rows = convs.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("nth")).drop("nth")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage, and what its cheapest repair is."""
    convs = table(spark, sf_dir, "conversations")
    return repair_report(damaged(convs), convs)


def _sql() -> str:
    """The query in DuckDB's SQL: costs with their letters from each conversation's last row on, one row a step."""
    white = r"[^\x20\x09-\x0D]"
    late = f"{TRUNCATED} * (sym = upper(sym))::INT"

    def way(letter: str, cost: str, behind: str) -> str:
        # a cost of eight digits, then the letters: ordered as text, the least is the cheapest, ASCII-least
        return f"printf('%08d', (left({behind}, 8)::BIGINT + {cost})::BIGINT) || '{letter}' || substr({behind}, 9)"

    def direct(q: int) -> str:
        keeps = [(s, to[q]) for s, to in KEEP.items() if to[q] is not None]
        keep = " ".join(f"WHEN lower(sym) = '{s}' THEN {way('K', late, f'v{to}')}" for s, to in keeps)
        given = f"CASE WHEN sym IN ('b', 'd') THEN NULL ELSE {way('R', f'{REROLE} + {late}', f'v{NEXT_STATE[q]}')} END"
        return f"least({way('D', str(DELETE), f'v{q}')}, CASE {keep} END, {given})"

    return f"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations
), bad AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0
), told AS (
  SELECT *, left(role, 1) AS initial, regexp_extract(text, '({white})[\\x20\\x09-\\x0D]*$', 1) AS last_char,
         md5(length(role)::VARCHAR || ':' || role || text) AS digest
  FROM bad
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS before
  FROM told
), rows AS (
  SELECT *, CASE WHEN last_char = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN last_char IN ('.', '!', '?') THEN kept ELSE upper(kept) END AS sym
  FROM (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS kept,
               row_number() OVER (PARTITION BY conv_id, digest ORDER BY pos) AS nth FROM numbered)
), steps AS (
  SELECT conv_id, max(n) + 1 AS pos, '00000000' AS v0, '00000006II' AS v1, '00000003I' AS v2, '00000000' AS v3 FROM rows GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos, least(d0, {way('I', '3', 'w2')}), least(d1, {way('I', '3', 'w2')}), w2, w3
  FROM (SELECT *, least(d2, {way('I', '3', 'd3')}) AS w2, least(d3, {way('I', '3', 'd2')}) AS w3
        FROM (SELECT rows.conv_id, rows.pos, {', '.join(f'{direct(q)} AS d{q}' for q in range(4))}
              FROM steps JOIN rows ON rows.conv_id IS NOT DISTINCT FROM steps.conv_id AND rows.pos = steps.pos - 1))
), best AS (
  SELECT conv_id, left(v0, 8)::BIGINT AS cost, substr(v0, 9) AS audit FROM steps WHERE pos = 1
), letters AS (
  SELECT conv_id, k, substr(audit, k::BIGINT, 1) AS letter,
         k - length(replace(left(audit, k::BIGINT), 'I', '')) AS inserted, length(replace(left(audit, k::BIGINT), 'D', '')) AS nth_out
  FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS k FROM best)
), outs AS (
  SELECT letters.*, rows.role, rows.text, rows.initial, letters.k AS at
  FROM letters LEFT JOIN rows ON rows.conv_id IS NOT DISTINCT FROM letters.conv_id AND letter <> 'I' AND rows.pos = k - inserted
  WHERE letter <> 'D'
), led AS (
  SELECT *, max(CASE WHEN nth_out = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led
  FROM outs
), repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth_out - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha
  FROM led GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE sym = 'b') AS blank,
         count(*) FILTER (WHERE sym = 'd') AS duplicate, count(*) FILTER (WHERE sym = upper(sym)) AS truncated,
         count(*) FILTER (WHERE pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS ids
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


OP12_SQL = _sql()
