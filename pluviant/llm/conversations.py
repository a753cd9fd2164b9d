"""Repair of conversation structure: the cheapest edits that make roles alternate, by A* on the lattice of rows and role states.

Rows of a conversation stream through one task in order, sorted by Spark, and are searched in windows: A* goes from the at most
four states that a window may begin in to those that it may end in, and what all surviving paths share is settled and forgotten.
So a conversation of any length takes the memory of a window and of the rows that are still open.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a window.
WINDOW = 256
#: States by the roles so far: none, a system row alone, last a user row, last an assistant row. What comes next, by initial.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (EMPTY, ASSISTANT)
#: The role that an edit of a row or an insertion makes, by the state that it leads to.
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: From the cheapest state any other one's continuations cost at most this much more, so a state beyond it is never best.
SLACK = 8


class Row(NamedTuple):
    initial: str
    doomed: bool  # blank or a duplicate: has to be deleted
    truncated: bool
    role: str
    text: str


class Path(NamedTuple):
    """A way to a state: its cost, the edits' initials and the repaired rows' texts since the last settled row."""

    cost: int
    audit: str
    out: tuple | None  # (before, "role:text"), a chain


def search(rows: list[Row], starts: dict[int, Path], last: bool) -> dict[int, Path]:
    """The cheapest paths, the ASCII-least audit of equally cheap ones, from `starts` over all rows to each state, or to the best
    final state alone if these are the last rows.

    A* keyed by (cost + heuristic, audit). What the rows left cost at least is the sum of their mandatory deletions and of what
    each truncated one costs whether it stays or goes. Of two equally cheap paths to a state neither audit begins with the other
    one, so the order of audits stays whatever follows.
    """
    n = len(rows)
    ahead = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (DELETE if rows[k].doomed else min(TRUNCATED, DELETE) if rows[k].truncated else 0)
    heap = [(p.cost + ahead[0], p.audit, 0, q, p.cost, p.out) for q, p in starts.items()]
    heapq.heapify(heap)
    seen, found = set(), {}
    while heap:
        least, audit, k, state, cost, out = heapq.heappop(heap)
        if found and least > min(p.cost for p in found.values()) + SLACK:
            return found
        if (k, state) in seen:
            continue
        seen.add((k, state))
        if k == n:
            if not last:
                found[state] = Path(cost, audit, out)
                if len(found) == len(NEXT):
                    return found
            elif state in FINAL:
                return {state: Path(cost, audit, out)}

        # One edit more.
        def push(edit: str, charge: int, at: int, to: int, more: str | None) -> None:
            if (at, to) not in seen:
                g = cost + charge  # noqa: B023
                heapq.heappush(heap, (g + ahead[at], audit + edit, at, to, g, out if more is None else (out, more)))  # noqa: B023

        for to in NEXT[state].values():
            if to in ROLES:
                push("I", INSERT, k, to, f"{ROLES[to]}:")
        if k < n:
            row = rows[k]
            push("D", DELETE, k + 1, state, None)
            if not row.doomed:
                charge = TRUNCATED if row.truncated else 0
                if row.initial in NEXT[state]:
                    push("K", KEEP + charge, k + 1, NEXT[state][row.initial], f"{row.role}:{row.text}")
                for to in NEXT[state].values():
                    if to in ROLES:
                        push("R", REROLE + charge, k + 1, to, f"{ROLES[to]}:{row.text}")
    return found


class Repair:
    """One conversation, fed row by row."""

    def __init__(self, conv, window: int):
        self.conv, self.window, self.rows = conv, window, []
        self.paths = {EMPTY: Path(0, "", None)}
        self.audit, self.digest, self.written = [], hashlib.sha256(), False
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.turn = None
        self.turns, self.before = 0, None

    def feed(self, turn, row: Row, blank: bool, duplicate: bool) -> None:
        if turn is not None:
            if self.turn != turn:  # turns come in order
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        if self.before is not None and self.before + row.initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = row.initial
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += row.truncated
        self.rows.append(row)
        if len(self.rows) == self.window:
            self.paths, self.rows = search(self.rows, self.paths, False), []
            self.settle()

    def _write(self, chain: list[str]) -> None:
        for part in chain:
            self.digest.update((("\n" if self.written else "") + part).encode())
            self.written = True

    def settle(self) -> None:
        """Hand over what all paths begin with. From one state, equal edits of equal rows make equal texts and lead to one state."""
        audits = [p.audit for p in self.paths.values()]
        same = _common(audits)
        made = same - audits[0][:same].count("D")
        chains = {q: _chain(p.out) for q, p in self.paths.items()}
        self.audit.append(audits[0][:same])
        self._write(next(iter(chains.values()))[:made])
        self.paths = {q: Path(p.cost, p.audit[same:], _linked(chains[q][made:])) for q, p in self.paths.items()}

    def result(self) -> tuple:
        (path,) = search(self.rows, self.paths, True).values()
        self._write(_chain(path.out))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, path.cost, "".join(self.audit) + path.audit, self.digest.hexdigest())


def _chain(out: tuple | None) -> list[str]:
    parts = []
    while out:
        out, part = out
        parts.append(part)
    return parts[::-1]


def _linked(parts: list[str]) -> tuple | None:
    out = None
    for part in parts:
        out = (out, part)
    return out


def _common(texts: list[str]) -> int:
    low, high = min(texts), max(texts)
    return next((k for k, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(map(len, texts)))


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """conv, turn, role, text of the rows after damage, by crc32 of `conv:turn` modulo 20: 0 drops a row (it stays with `gone`), 1 empties its text,
    2 removes `.`, `!` and `?`, 3 repeats it, 4 makes it a user's. Nulls of role and text, and in the key, are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col))) % 20
    body = F.when(code == 1, "").when(code == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    role = F.when(code == 4, "user").otherwise(text("role"))
    copies = F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), body.alias("text"), (code == 0).alias("gone"), copies.alias("copy"))
    return out.select("conv", "turn", *[F.when(~F.col("gone"), F.col(c)).alias(c) for c in ("role", "text")], "gone")


def repaired(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """conv, turn, role, text, gone -> a row for each conv: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows of a conversation stand by turn (nulls first), then role, then text; rows without a conv are one conversation. A row
    that is `gone` only says that its conversation is there. Repeated rows are duplicates. A conversation of no rows has zeros,
    an empty audit and the hash of no text; an empty table gives an empty table.
    """
    import pyarrow as pa

    # Where a repeated text stands first is found by a key of the text, so no task has to hold what a conversation said.
    turn = F.struct(F.isnotnull("turn").alias("has"), F.col("turn").alias("turn"))
    seen = rows.withColumn("key", F.when(~F.col("gone"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))
    first = seen.filter("not gone").groupBy("conv", "key").agg(F.count(F.lit(1)).alias("n"), F.min(turn).alias("first")).filter("n > 1")
    first = first.select(F.col("conv").alias("c"), F.col("key").alias("k"), "first")
    marked = seen.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left").drop("c", "k")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    key, late = F.when(F.col("first").isNotNull(), F.col("key")), F.coalesce(F.col("first") != turn, F.lit(False))
    flat = marked.select("conv", "turn", "role", "text", "gone", blank.alias("blank"), cut.alias("cut"), key.alias("key"), late.alias("late"))
    ordered = flat.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    kind = rows.schema["conv"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = f"conv_id {kind}, {', '.join(f'{n} long' for n in names[1:7])}, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, done = None, None, []

        def table() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, turn, role, text, gone, blank, cut, key, late in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.result())
                    now, before = Repair(conv, window), None
                if gone:
                    continue
                again = not blank and key is not None and (late or key == before)  # equal rows of one turn stand together
                before = key
                now.feed(turn, Row(role[:1], blank or again, not blank and not again and cut, role, text), blank, again)
            if len(done) >= 1000:
                yield table()
                done = []
        if now is not None:
            done.append(now.result())
        if done:
            yield table()

    return ordered.mapInArrow(run, schema)


def repair_report(conversations: DataFrame) -> DataFrame:
    """The query's rows: damage as `damaged` does it, then `repaired`. Columns other than conv_id, turn, role and text aren't read."""
    return repaired(damaged(conversations.select("conv_id", "turn", "role", "text")))


def repair_sql() -> str:
    """The same for DuckDB: all four states of a conversation, row by row."""
    on = lambda s, edit, cost, out: f"struct_pack(c := {s}.c + {cost}, a := {s}.a || '{edit}', o := {s}.o || {out})"
    line = lambda s, role, text="t": f"CASE WHEN {s}.o = '' THEN '' ELSE chr(10) END || {role} || ':' || {text}"
    least = lambda *options: f"list_sort([{', '.join(options)}])[1]"
    kept = lambda s, i: f"CASE WHEN i1 = '{i}' AND NOT doomed THEN {on(s, 'K', f'{KEEP} + late', line(s, 'r'))} ELSE never END"
    rerole = lambda s, role: f"CASE WHEN NOT doomed THEN {on(s, 'R', f'{REROLE} + late', line(s, repr(role)))} ELSE never END"
    gone = lambda s: on(s, "D", DELETE, "''")
    insert = lambda s, role: on(s, "I", INSERT, line(s, repr(role), "''"))
    closed = f"""SELECT * REPLACE ({least('a', insert('u', 'assistant'))} AS a) FROM (
    SELECT * REPLACE ({least('u', *(insert(s, 'user') for s in 'esa'))} AS u) FROM ({{rows}}))"""
    start = "SELECT DISTINCT conv_id, 0 AS k, struct_pack(c := 0, a := '', o := '') AS e, never AS s, never AS u, never AS a FROM conversations, n"
    moved = f"""SELECT conv_id, k, {gone('e')} AS e, {least(gone('s'), kept('e', 's'))} AS s,
      {least(gone('u'), *(f(s, x) for s in 'esa' for f, x in ((kept, 'u'), (rerole, 'user'))))} AS u, {least(gone('a'), kept('u', 'a'), rerole('u', 'assistant'))} AS a
    FROM (SELECT w.conv_id, d.k, e, s, u, a, r, t, i1, doomed, late, never FROM w, d, n WHERE d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.k = w.k + 1)"""
    return f"""
WITH RECURSIVE z AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), crc AS (
  SELECT key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda k: ascii(key[k])::BIGINT)),
    lambda x, y: list_reduce(list_prepend(xor(x, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, w: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) % 20 AS code
  FROM (SELECT DISTINCT key FROM z)
), p AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE r END AS r, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(t, '.!?', '') ELSE t END AS t
  FROM (SELECT z.*, code, unnest(CASE code WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) FROM z JOIN crc USING (key))
), q AS (
  SELECT *, min(k) OVER (PARTITION BY conv_id, r, t) < k AS again, NOT regexp_matches(t, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(t, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut, left(r, 1) AS i1
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS k FROM p)
), n AS (SELECT struct_pack(c := 1000000000, a := '', o := '') AS never
), d AS MATERIALIZED (
  SELECT *, blank OR again AS doomed, CASE WHEN cut AND NOT blank AND NOT again THEN {TRUNCATED} ELSE 0 END AS late, lag(i1) OVER (PARTITION BY conv_id ORDER BY k) || i1 AS pair FROM q
), w AS (
  {closed.format(rows=start)}
  UNION ALL
  {closed.format(rows=moved)}
), best AS (
  SELECT conv_id, {least('e', 'a')} AS f FROM w LEFT JOIN (SELECT conv_id AS id, max(k) AS top FROM d GROUP BY conv_id) m ON w.conv_id IS NOT DISTINCT FROM m.id WHERE k = coalesce(top, 0)
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
         count(*) FILTER (WHERE late > 0) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM d GROUP BY conv_id
)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(f.c AS BIGINT) AS cost, f.a AS audit, sha256(f.o) AS repaired_sha256
FROM best LEFT JOIN c ON best.conv_id IS NOT DISTINCT FROM c.conv_id"""
