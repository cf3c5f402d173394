"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(system? (user assistant)+)?``.

Each conversation is a lattice that is never built: a node is a turn index and a grammar state (nothing yet, after a
system, user or assistant row), its edges are Keep (0; the row's role initial must fit), Rerole to the role that fits (2),
Delete (3; the only choice for blank and duplicate rows) and Insert of an empty row (2); a truncated row that stays adds
1. Dijkstra's search runs over it with the priority (cost, audit), the audit being the edits' initials so far, and stops
at the first accepting end node it pops. Of equal cost, the audit that is least in ASCII wins. Keys of two paths to one
node can't be equal in cost and prefixes of each other (what one has more is Inserts, which cost), so the order of
audits stays the order of whole paths.

Scale: rows are dealt by conversation, sorted within partitions (Spark's sorts spill) and streamed. A conversation of at
most CHUNK rows is searched at once. A longer one is searched chunk by chunk, from the best paths into the chunk's
states to those out of them; a path holds its hash and the part of its audit that the others don't share, so a
conversation that holds a third of all rows needs the memory of a chunk and of its audit. Its rows pass through one
task, one after another, as the hash of its repaired rows is defined so; no other conversation waits for them but those
of its partition. Repeated rows are found by Spark before, in the same partitions.

Order: by turn, nulls first; rows of one turn by role, text and copy number, so that the result doesn't depend on partitions.

Edge cases: a null role or text is one space, so a null text is blank, and a null role fits no state. An empty role has no
initial. A null conversation id is a conversation. gaps ignores null turns (all null: 0; more than a long holds: the
greatest long). Rows for which ``present`` isn't true only name their conversation; one without present rows has zeros,
an empty audit and the hash of nothing. Repeated rows are duplicates and go. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, table, trim
from .line_dedup import BLANK

#: Rows and bytes of text searched at once.
CHUNK, CHUNK_BYTES = 256, 4_000_000
BLANK_ROW, DUPLICATE, TRUNCATED = 1, 2, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept row, by state and initial; state after an inserted or reroled row; its role.
FITS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: b"user", ASSISTANT: b"assistant"}
MOST_LONG = 2**63 - 1


def shortest(rows: list[tuple[str, int]], starts: list[tuple[int, str, int]], last: bool) -> dict[int, tuple[int, str, int, str]]:
    """Best (cost, audit, start state, letters) by end state, from starts (cost, audit, state) over rows of (initial, fault).

    With ``last`` only the first accepting end node that is popped, else all end nodes that can be reached.
    """
    heap = [(cost, audit, 0, state, state, len(audit)) for cost, audit, state in starts]
    heapq.heapify(heap)
    done, ends = set(), {}
    while heap:
        cost, audit, i, state, start, own = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and (not last or state in (NOTHING, ASSISTANT)):
            ends[state] = (cost, audit, start, audit[own:])
            if last or len(ends) == 4:
                return ends
        after = [(cost + 2, audit + "I", i, NEXT[state])]
        if i < len(rows):
            initial, fault = rows[i]
            after.append((cost + 3, audit + "D", i + 1, state))
            if fault not in (BLANK_ROW, DUPLICATE):
                more = fault == TRUNCATED
                after.append((cost + 2 + more, audit + "R", i + 1, NEXT[state]))
                if (state, initial) in FITS:
                    after.append((cost + more, audit + "K", i + 1, FITS[state, initial]))
        for step in after:
            if step[2:] not in done:
                heapq.heappush(heap, (*step, start, own))
    return ends


class Conversation:
    """A conversation read row by row."""

    def __init__(self, key):
        self.key, self.rows, self.size, self.faults = key, [], 0, [0, 0, 0, 0]
        self.first = self.turn = self.initial = None
        self.distinct = self.illegal = 0
        self.settled, self.paths = [], {NOTHING: (0, "", hashlib.sha256())}

    def add(self, turn: int | None, role: bytes, text: bytes, initial: str, fault: int) -> None:
        if len(self.rows) >= CHUNK or self.size >= CHUNK_BYTES:
            self._search(False)
        self.rows.append((role, text, initial, fault))
        self.size += len(text)
        self.faults[fault] += 1
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.distinct = turn, self.distinct + 1
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial

    def _search(self, last: bool) -> None:
        ends = shortest([(initial, fault) for _, _, initial, fault in self.rows], [(cost, audit, state) for state, (cost, audit, _) in self.paths.items()], last)
        paths = {state: (cost, audit, self._replayed(start, letters)) for state, (cost, audit, start, letters) in ends.items()}
        shared = commonprefix([audit for _, audit, _ in paths.values()])
        self.settled.append(shared)
        self.paths = {state: (cost, audit[len(shared) :], print_) for state, (cost, audit, print_) in paths.items()}
        self.rows, self.size = [], 0

    def _replayed(self, state: int, letters: str):
        """The hash of the rows repaired so far, after the chunk's edits."""
        print_, i = self.paths[state][2].copy(), 0
        for letter in letters:
            role, text, initial, _ = self.rows[i] if letter != "I" else (b"", b"", "", 0)
            i += letter != "I"
            if letter == "D":
                continue
            if state != NOTHING:
                print_.update(b"\n")
            state = FITS[state, initial] if letter == "K" else NEXT[state]
            print_.update((role if letter == "K" else ROLES[state]) + b":" + text)
        return print_

    def result(self) -> tuple:
        self._search(True)
        ((cost, audit, print_),) = self.paths.values()
        gaps = min(self.turn - self.first + 1 - self.distinct, MOST_LONG) if self.distinct else 0
        return (self.key, gaps, *self.faults[1:], self.illegal, cost, "".join([*self.settled, audit]), print_.hexdigest())


def _ordered(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column) -> DataFrame:
    """The rows by conversation, in order within partitions, with their faults."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.coalesce(present, F.lit(False)).alias("present"))
    rows = rows.repartition("conv").withColumns({"h": F.xxhash64("role", "text"), "g": F.xxhash64(F.lit(7), "text", "role")})
    # Dealt by conversation already, so that this needs no shuffle of its own; equal rows have equal hashes (128 bits).
    copy = F.row_number().over(W.partitionBy("conv", "h", "g", "present").orderBy("turn"))
    bare = F.rtrim("text", F.lit(BLANK))
    fault = F.when(bare == "", BLANK_ROW).when(F.col("copy") > 1, DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    rows = rows.withColumn("copy", copy).withColumn("fault", fault.cast("int")).withColumn("initial", F.substring("role", 1, 1))
    return rows.sortWithinPartitions("conv", "turn", "role", "text", "copy").select("conv", "turn", F.col("role").cast("binary"), F.col("text").cast("binary"), "initial", "fault", "present")


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """A row for each conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    rows = _ordered(conversations, conv_col, turn_col, role_col, text_col, F.lit(True) if present is None else present)
    kind = rows.schema["conv"].dataType.simpleString()
    names = [conv_col, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches):
        now, out, types = None, [], None

        def given():
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for b in slices(batches, 256):
            types = types or [b.column(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for conv, turn, role, text, initial, fault, there in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv != now.key:
                    if now is not None:
                        out.append(now.result())
                        if len(out) >= 500:
                            yield given()
                    now = Conversation(conv)
                if there:
                    now.add(turn, role, text, initial, fault)
        if now is not None:
            out.append(now.result())
            yield given()
        trim()

    longs = ", ".join(f"{n} long" for n in names[1:7])
    return rows.mapInArrow(run, f"`{conv_col}` {kind}, {longs}, audit string, repaired_sha256 string")


def repaired_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """The repaired rows: conversation, position (from 0), turn (null where inserted), role, text and edit (K, R or I)."""
    present = F.lit(True) if present is None else present
    audits = repair(conversations, conv_col, turn_col, role_col, text_col, present).select(F.col(conv_col).alias("conv"), "audit")
    rows = _ordered(conversations, conv_col, turn_col, role_col, text_col, present).where("present")
    rows = rows.withColumns({"role": F.col("role").cast("string"), "text": F.col("text").cast("string")})
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("conv").orderBy("turn", "role", "text", F.col("fault") == DUPLICATE)))
    edits = audits.where("audit <> ''").select("conv", F.posexplode(F.split("audit", "")).alias("p", "edit"))
    so_far = W.partitionBy("conv").orderBy("p")
    edits = edits.withColumns({"n": F.sum((F.col("edit") != "I").cast("long")).over(so_far), "position": F.sum((F.col("edit") != "D").cast("long")).over(so_far) - 1})
    edits = edits.where("edit <> 'D'").withColumn("n", F.when(F.col("edit") != "I", F.col("n")))
    both = edits.alias("e").join(rows.alias("r"), F.col("e.conv").eqNullSafe(F.col("r.conv")) & (F.col("e.n") == F.col("r.n")), "left").select("e.conv", "position", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), "edit", "initial")
    led = F.max(((F.col("position") == 0) & (F.col("edit") == "K") & (F.col("initial") == "s")).cast("int")).over(W.partitionBy("conv"))
    role = F.when(F.col("edit") == "K", F.col("role")).when((F.col("position") + led) % 2 == 0, "user").otherwise("assistant")
    return both.select(F.col("conv").alias(conv_col), "position", "turn", role.alias("role"), "text", "edit")


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations after the damage of the query's contract: (conv_id, turn, role, text, present); dropped rows aren't present."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"), F.pmod(F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")), F.lit(20)).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("d") != 0).alias("present"), "d")
    return rows.withColumn("copy", F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("d", "copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return repair(rows, present=F.col("present"))


#: The same by a table of best paths, row after row, with crc32 written out.
SQL = r"""
WITH RECURSIVE
crc_table AS (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ord(ch)::BIGINT) AS bytes FROM conversations),
dealt AS (SELECT conv_id, turn, role, text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS d FROM given, crc_table),
damaged AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
  CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE d WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM dealt),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare, role[1] AS initial FROM damaged),
marked AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM numbered),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
inserts(p, q, ins, added) AS (VALUES (0, 0, '', ''), (0, 2, 'I', chr(10) || 'user:'), (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 1, '', ''), (1, 2, 'I', chr(10) || 'user:'), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, '', ''), (2, 3, 'I', chr(10) || 'assistant:'), (3, 3, '', ''), (3, 2, 'I', chr(10) || 'user:')),
edits(q, edit, initial, r) AS (VALUES (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3),
  (0, 'R', NULL, 2), (1, 'R', NULL, 2), (2, 'R', NULL, 3), (3, 'R', NULL, 2), (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (3, 'K', 'u', 2), (2, 'K', 'a', 3)),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'body': ''} AS best FROM ids
  UNION ALL
  SELECT w.conv_id, m.i, e.r, min({'cost': w.best.cost + 2 * length(x.ins) + CASE e.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e.edit <> 'D' AND m.fault = 'truncated' THEN 1 ELSE 0 END,
    'audit': w.best.audit || x.ins || e.edit,
    'body': w.best.body || x.added || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || m.role || ':' || m.text ELSE chr(10) || CASE e.r WHEN 2 THEN 'user:' ELSE 'assistant:' END || m.text END})
  FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 JOIN inserts x ON x.p = w.state JOIN edits e ON e.q = x.q
  WHERE e.edit = 'D' OR m.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR e.initial = m.initial)
  GROUP BY w.conv_id, m.i, e.r),
ends AS (
  SELECT w.conv_id, min({'cost': w.best.cost + 2 * length(x.ins), 'audit': w.best.audit || x.ins, 'body': w.best.body || x.added}) AS best
  FROM walk w JOIN inserts x ON x.p = w.state LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(c.n, 0) AND x.q IN (0, 3) GROUP BY w.conv_id)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit, sha256(best.body[2:]) AS repaired_sha256
FROM ids LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id JOIN ends e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
