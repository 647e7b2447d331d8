r"""Conversation structure repair by run-length dynamic programming.

A conversation's rows, by turn, are to read as role initials ``(s?(ua)+)?``. Edits:
Keep costs 0, Rerole to user or assistant 1, Delete 2 (the only choice for blank rows
and duplicates), Insert an empty user or assistant turn 5; a truncated row that stays adds
5. The cheapest edits are chosen; among equally cheap ones, those whose initials (D, I, K, R) are
ASCII-least.

A row is one of nine symbols: its role initial (user, assistant, system, other), truncated
or not, or "must go". A symbol is a 4 x 4 min-plus matrix over what has been
written so far (nothing, s, u, a), inserts before the row included. Equal
consecutive symbols form a run, and n of them are applied through cached binary powers of the
matrix. The costs still to come are known before the edits are chosen from the front; a letter
leads to one next state, so the least letter on a cheapest way is always right.

Conversations of at most ``ROWS`` rows and ``BYTES`` of text are dealt out by id and solved whole within
one task. A longer one is spread by a range exchange over (conv_id, turn) and cut into blocks:
matrices of blocks are multiplied in parallel, costs still to come pass
backward over the block rows (one small row for many turns, streamed with four numbers held), the four possible end
states of each block are found in parallel, the true state passes forward in the same way, and
the blocks' edits are chosen in parallel. First occurrences are a grouped minimum joined on the row, so
a text that fills a third of the rows is no hot join key. Both ways give the same edits.

Defined results: a null role or text is one space; null turns come first; rows of one turn
are ordered by role, then SHA-256 of the text; a null conv_id is a conversation of its own;
an empty role has no initial and cannot be kept; initials are case-sensitive; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import ASCII_SPACE, spool
from panelcast.session import Spool

ROWS = 4096                   # a longer conversation is cut into blocks
BYTES = 32 << 20              # of text, likewise
SHIFT = 12                    # a block has at most 2^SHIFT rows

# ------------------------------------------------------------- the problem

START, S, U, A = range(4)     # what has been written: nothing, s, u, a
AFTER_INSERT = (U, U, A, U)   # an insert writes the one role that may follow
KEEP = {"u": {START: U, S: U, A: U}, "a": {U: A}, "s": {START: S}, "o": {}}
GONE = "X"                    # symbol of a row that must be deleted; capitals are truncated rows
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
NEVER = 1 << 60
Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def product(a: Matrix, b: Matrix) -> Matrix:
    cols = tuple(zip(*b))
    return tuple(tuple(min(x + y for x, y in zip(row, col)) for col in cols) for row in a)


def apply(m: Matrix, v: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, v)) for row in m)


def _inserts() -> Matrix:
    out = []
    for s in range(4):
        row, cost = [NEVER] * 4, 0
        while row[s] == NEVER:
            row[s], s, cost = cost, AFTER_INSERT[s], cost + INSERT
        out.append(tuple(row))
    return tuple(out)


INSERTS = _inserts()
FINAL: Vector = tuple(min(row[START], row[A]) for row in INSERTS)       # costs to come after the last row


def choices(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row, letters ascending."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        more = TRUNCATED if symbol.isupper() else 0
        kept = KEEP[symbol.lower()].get(state)
        if kept is not None:
            out.append(("K", more, kept))
        out.append(("R", REROLE + more, AFTER_INSERT[state]))
    return out


@lru_cache(None)
def step(symbol: str) -> Matrix:
    rows = []
    for s in range(4):
        row = [NEVER] * 4
        for _, cost, t in choices(symbol, s):
            row[t] = min(row[t], cost)
        rows.append(tuple(row))
    return product(INSERTS, tuple(rows))


@lru_cache(None)
def power(symbol: str, k: int) -> Matrix:
    """The matrix of 2^k equal symbols."""
    return step(symbol) if k == 0 else product(power(symbol, k - 1), power(symbol, k - 1))


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]


def across(symbol: str, n: int, v: Vector) -> Vector:
    """Costs to come before a run of n equal symbols from those after it."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            v = apply(power(symbol, k), v)
    return v


def block_matrix(symbols: str) -> Matrix:
    out = None
    for symbol, n in runs(symbols):
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = power(symbol, k) if out is None else product(out, power(symbol, k))
    return out


def unroll(symbols: str, state: int, after: Vector, last: bool) -> tuple[list[str], int]:
    """(the letters of each row, end state): inserts stand before the row they precede, those at
    the conversation's end after its last row."""
    parts = runs(symbols)
    ends = [after]
    for symbol, n in reversed(parts):
        ends.append(across(symbol, n, ends[-1]))
    ends.reverse()
    out = []
    for (symbol, n), end in zip(parts, ends[1:]):
        before = [end]
        for _ in range(n):
            before.append(apply(step(symbol), before[-1]))
        for left in range(n, 0, -1):                       # rows of the run that are left
            here, then, letters = before[left], before[left - 1], ""
            while True:
                options = [(letter, t, False) for letter, cost, t in choices(symbol, state) if cost + then[t] == here[state]]
                t = AFTER_INSERT[state]
                if INSERT + here[t] == here[state]:
                    options.append(("I", t, True))
                letter, state, more = min(options)
                letters += letter
                if not more:
                    break
            out.append(letters)
    if last and out:
        tail = ""
        while after[state]:
            tail, state = tail + "I", AFTER_INSERT[state]
        out[-1] += tail
    return out, state


@lru_cache(1 << 14)
def solve(symbols: str) -> tuple[tuple[str, ...], int]:
    """(letters of each row, cost) of a whole conversation."""
    v = FINAL
    for symbol, n in reversed(runs(symbols)):
        v = across(symbol, n, v)
    return tuple(unroll(symbols, START, FINAL, True)[0]), v[START]


def written(letters: str, initial: str, state: int) -> tuple[str, int]:
    """(what each letter writes: u, a, or - for the row's own role, next state)."""
    out = ""
    for c in letters:
        if c in "IR":
            state = AFTER_INSERT[state]
            out += "ua"[state == A]
        else:
            out += "-"
            state = state if c == "D" else KEEP[initial][state]
    return out, state


LEGAL = {"su", "ua", "au"}


def illegal(initials: str) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


# ------------------------------------------------------------- on DataFrames

@dataclass
class Repaired:
    """``whole``: one row for each conversation; ``split``: the parts of long conversations, one for
    each row in order of ``part`` (None where there is none). Both: conv_id, part,
    turns ARRAY<STRUCT<action, role, text>> (deleted turns included) and the whole
    conversation's gaps, blank, duplicate, truncated, illegal and cost."""
    whole: DataFrame
    split: DataFrame | None

    def parts(self) -> DataFrame:
        return self.whole if self.split is None else self.whole.unionByName(self.split)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
TURN = pa.struct([("action", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _prepared(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(" "))
    shown = F.rtrim(text, F.lit(ASCII_SPACE))
    role = F.coalesce("role", F.lit(" "))
    first = F.substring(role, 1, 1)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                       F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"),
                       (shown == "").alias("is_blank"), (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("is_cut"),
                       F.when(first.isin("u", "a", "s"), first).otherwise(F.lit("o")).alias("initial"))


ORDER = ("conv_id", "turn", "role", "digest")          # ascending, nulls first


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Re-cuts a stream in order of conv_id into tables of whole conversations with their bounds."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column(0).to_pylist()
        cut = next((i for i in range(len(conv) - 1, 0, -1) if conv[i] != conv[i - 1]), 0)
        if held and conv[0] != last and not cut:
            yield _bounded(held)
            held = []
        if cut:
            yield _bounded([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
        last = conv[-1]
    if held:
        yield _bounded(held)


def _bounded(held: list[pa.RecordBatch]) -> tuple[pa.Table, list[tuple[int, int]]]:
    t = pa.Table.from_batches(held).combine_chunks()
    conv = t.column(0).to_pylist()
    starts = [i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1]]
    return t, list(zip(starts, [*starts[1:], len(conv)]))


def _solve_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, bounds in _conversations(batches):
        turn, role, digest, blank, cut, initial = (
            t.column(c).to_pylist() for c in ("turn", "role", "digest", "is_blank", "is_cut", "initial"))
        at, action, said, sizes, facts = [], [], [], [0], []
        for a, b in bounds:
            seen, symbols, n = set(), "", [0, 0, 0]
            for i in range(a, b):
                key = (role[i], digest[i])
                fault = 0 if blank[i] else 1 if key in seen else 2 if cut[i] else 3
                seen.add(key)
                if fault < 3:
                    n[fault] += 1
                symbols += GONE if fault < 2 else initial[i].upper() if fault == 2 else initial[i]
            letters, cost = solve(symbols)
            state = START
            for i, row in zip(range(a, b), letters):
                roles, state = written(row, initial[i], state)
                for c, r in zip(row, roles):
                    at.append(None if c == "I" else i)
                    action.append(c)
                    said.append(role[i] if r == "-" else "user" if r == "u" else "assistant")
            sizes.append(len(at))
            turns = {x for x in turn[a:b] if x is not None}
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            facts.append((gaps, *n, illegal("".join(initial[a:b])), cost))
        text = t.column("text").combine_chunks().take(pa.array(at, pa.int64())).fill_null("")
        turns = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(action, pa.string()), pa.array(said, pa.string()), text.cast(pa.string())], fields=list(TURN)))
        first = pa.array([a for a, _ in bounds])
        yield pa.record_batch([t.column(0).combine_chunks().take(first), pa.array([0] * len(bounds), pa.int64()), turns,
                               *(pa.array(c, pa.int64()) for c in zip(*facts))], ["conv_id", "part", "turns", *COUNTS])


def repair(spark: SparkSession, rows: DataFrame, max_rows: int = ROWS, max_bytes: int = BYTES, shift: int = SHIFT) -> Repaired:
    """Repairs the conversations of ``rows`` (conv_id, turn, role, text)."""
    sp = spool(spark)
    kind = dict(rows.dtypes)["conv_id"]
    out = f"conv_id {kind}, part long, turns array<struct<action: string, role: string, text: string>>, " + ", ".join(
        f"{c} long" for c in COUNTS)
    rows = _prepared(rows)
    size = F.sum(F.octet_length("text").cast("long"))
    long = sp.put(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), size.alias("bytes"))
                  .filter((F.col("n") > max_rows) | (F.col("bytes") > max_bytes)).select(F.col("conv_id").alias("_long"), F.lit(1).alias("_is")))
    some = not long.isEmpty()
    short = rows.join(long, F.col("conv_id").eqNullSafe(F.col("_long")), "left_anti") if some else rows
    whole = short.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(_solve_whole, out)
    if not some:
        return Repaired(whole, None)
    hot = rows.join(long, F.col("conv_id").eqNullSafe(F.col("_long")), "left_semi")
    return Repaired(whole, _solve_split(hot, kind, shift, sp))


def _streamed(rows: DataFrame, order: list, schema: str, fn) -> DataFrame:
    """A task's conversations through ``fn(row, carried) -> (output row, carried)``; ``carried`` is None at the first
    row of a conversation."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, carried = object(), None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["conv_id"] != conv:
                    conv, carried = r["conv_id"], None
                row, carried = fn(r, carried)
                out.append(row)
            if out:
                keep = {n: [r[n] for r in out] for n in names}
                types = {"conv_id": b.schema.field("conv_id").type, "symbols": pa.string(), "initials": pa.string(),
                         "m": pa.list_(pa.int64()), "after": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()),
                         "is_last": pa.bool_()}
                yield pa.record_batch([pa.array(v, types.get(n, pa.int64())) for n, v in keep.items()], names)
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def _solve_split(rows: DataFrame, kind: str, shift: int, sp: Spool) -> DataFrame:
    laid = sp.put(rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("uid", F.monotonically_increasing_id()))
    first = laid.groupBy("conv_id", "role", "digest").agg(F.min("uid").alias("uid")).select("uid", F.lit(True).alias("is_first"))
    fault = (F.when(F.col("is_blank"), 0).when(F.col("is_first").isNull(), 1).when(F.col("is_cut"), 2).otherwise(3))
    marked = sp.put(laid.select("conv_id", "uid", "turn", "is_blank", "is_cut", "initial").join(first, "uid", "left")
                    .withColumn("fault", fault)
                    .select("conv_id", "uid", "turn", "fault", "initial",
                            F.when(F.col("fault") < 2, F.lit(GONE)).when(F.col("fault") == 2, F.upper("initial"))
                            .otherwise(F.col("initial")).alias("symbol")))
    listed = F.array_sort(F.collect_list(F.struct("uid", "symbol", "initial")))        # at most 2^shift rows
    blocks = (marked.groupBy("conv_id", F.shiftright("uid", shift).alias("block")).agg(listed.alias("l")).select(
        "conv_id", "block", F.col("l")[0]["uid"].alias("uid"), F.array_join(F.col("l.symbol"), "").alias("symbols"),
        F.array_join(F.col("l.initial"), "").alias("initials")))

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [[x for row in block_matrix(s) for x in row] for s in b.column(3).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(m, pa.list_(pa.int64()))], [*b.schema.names, "m"])
    given = f"conv_id {kind}, block long, uid long, symbols string, initials string"
    blocks = sp.put(blocks.mapInArrow(multiplied, given + ", m array<long>"))

    def backward(r: dict, carried):
        after = FINAL if carried is None else carried
        m = r.pop("m")
        before = apply(tuple(tuple(m[4 * i:4 * i + 4]) for i in range(4)), after)
        return r | {"after": list(after), "is_last": carried is None, "cost": before[START]}, before
    known = sp.put(_streamed(blocks, ["conv_id", F.desc("block")], given + ", after array<long>, is_last boolean, cost long", backward))

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            ends = [[unroll(r["symbols"], s, tuple(r["after"]), False)[1] for s in range(4)] for r in rows]
            yield pa.record_batch([*b.columns, pa.array(ends, pa.list_(pa.int64()))], [*b.schema.names, "ends"])
    known = sp.put(known.mapInArrow(ended, given + ", after array<long>, is_last boolean, cost long, ends array<long>"))

    def forward(r: dict, carried):
        state, before = carried or (START, "")
        out = r | {"state": state, "illegal": illegal(before + r["initials"]), "cost": 0 if carried else r["cost"]}
        return out, (r["ends"][state], r["initials"][-1])
    placed = sp.put(_streamed(known, ["conv_id", "block"], given + ", after array<long>, is_last boolean, cost long, state long, illegal long",
                              forward))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                letters, _ = unroll(r["symbols"], r["state"], tuple(r["after"]), r["is_last"])
                state, roles = r["state"], []
                for row, initial in zip(letters, r["initials"]):
                    out, state = written(row, initial, state)
                    roles.append(out)
                yield pa.record_batch([pa.array(range(r["uid"], r["uid"] + len(letters)), pa.int64()),
                                       pa.array(letters), pa.array(roles)], ["uid", "letters", "roles"])
    edits = placed.mapInArrow(chosen, "uid long, letters string, roles string")
    facts = _facts(marked, placed)
    turn = F.transform(F.sequence(F.lit(1), F.length("letters")), lambda i: F.struct(
        F.substring("letters", i, F.lit(1)).alias("action"),
        F.when(F.substring("roles", i, F.lit(1)) == "u", F.lit("user")).when(F.substring("roles", i, F.lit(1)) == "a", F.lit("assistant"))
        .otherwise(F.col("role")).alias("role"),
        F.when(F.substring("letters", i, F.lit(1)) == "I", F.lit("")).otherwise(F.col("text")).alias("text")))
    parts = laid.select("conv_id", "uid", "role", "text").join(edits, "uid").select("conv_id", F.col("uid").alias("part"), turn.alias("turns"))
    return (parts.join(facts.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")))
            .select("conv_id", "part", "turns", *COUNTS))


def _facts(marked: DataFrame, placed: DataFrame) -> DataFrame:
    """The counts of each long conversation."""
    distinct = marked.groupBy("conv_id", "turn").agg(*[F.sum((F.col("fault") == i).cast("long")).alias(c)
                                                       for i, c in enumerate(("blank", "duplicate", "truncated"))])
    turns = distinct.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    rest = placed.groupBy(F.col("conv_id").alias("_b")).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    return turns.join(rest, F.col("conv_id").eqNullSafe(F.col("_b"))).select("conv_id", *COUNTS)


def digests(repaired: Repaired) -> DataFrame:
    """(conv_id, counts, audit, repaired_sha256) of each conversation. The one digest of a long conversation
    is sequential: its parts stream through one task in order; what grows with it is its audit text."""
    line = F.transform(F.filter("turns", lambda t: t["action"] != "D"), lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    out = repaired.whole.select("conv_id", *COUNTS, F.concat_ws("", F.col("turns.action")).alias("audit"),
                                F.sha2(F.encode(F.concat_ws("\n", line), "UTF-8"), 256).alias("repaired_sha256"))
    if repaired.split is None:
        return out
    kind = dict(repaired.split.dtypes)["conv_id"]
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, sha, facts, any_line, key_type = object(), [], None, None, False, None

        def flush():
            return pa.record_batch([pa.array([conv], key_type), *(pa.array([v], pa.int64()) for v in facts),
                                    pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names)
        for b in batches:
            key_type = b.schema.field("conv_id").type
            for r in b.to_pylist():
                if r["conv_id"] != conv or facts is None:
                    if facts is not None:
                        yield flush()
                    conv, audit, sha, any_line = r["conv_id"], [], hashlib.sha256(), False
                    facts = [r[c] for c in COUNTS]
                for t in r["turns"]:
                    audit.append(t["action"])
                    if t["action"] != "D":
                        sha.update((("\n" if any_line else "") + f"{t['role']}:{t['text']}").encode())
                        any_line = True
        if facts is not None:
            yield flush()
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return out.unionByName(repaired.split.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, chosen by crc32(``conv_id:turn``) % 20:
    0 drops the row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 makes the role user. Nulls
    count as one space."""
    def named(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.encode(F.concat(named("conv_id"), F.lit(":"), named("turn")), "UTF-8")) % 20
    text = named("text")
    d = rows.select("conv_id", "turn", h.alias("h"), F.when(h == 4, F.lit("user")).otherwise(named("role")).alias("role"),
                    F.when(h == 1, F.lit("")).when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text")).filter("h <> 0")
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


ORACLE = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
         CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t
), o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
             lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 20 AS h
  FROM conversations, tab
), d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM o, range(2) c(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)
), r AS (
  SELECT *, CASE WHEN left(role, 1) IN ('u', 'a', 's') THEN left(role, 1) ELSE 'o' END AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM d
), f AS (
  SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair,
         CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM r
), ins(s, t, c, w, x) AS (
  VALUES (0, 0, 0, '', ''), (0, 2, 5, 'I', 'u'), (0, 3, 10, 'II', 'ua'), (1, 1, 0, '', ''), (1, 2, 5, 'I', 'u'), (1, 3, 10, 'II', 'ua'),
         (2, 2, 0, '', ''), (2, 3, 5, 'I', 'a'), (3, 3, 0, '', ''), (3, 2, 5, 'I', 'u')
), act(l, s, t, i, c) AS (
  SELECT 'D', s, s, CAST(NULL AS VARCHAR), 2 FROM range(4) z(s)
  UNION ALL VALUES ('K', 0, 1, 's', 0), ('K', 0, 2, 'u', 0), ('K', 1, 2, 'u', 0), ('K', 3, 2, 'u', 0), ('K', 2, 3, 'a', 0),
                   ('R', 0, 2, NULL, 1), ('R', 1, 2, NULL, 1), ('R', 3, 2, NULL, 1), ('R', 2, 3, NULL, 1)
), p(conv_id, pos, s, cost, audit, said) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM conversations
  UNION ALL
  SELECT p.conv_id, f.pos, act.t, p.cost + ins.c + act.c + CASE WHEN l <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END,
         p.audit || w || l,
         p.said || list_transform(list_filter(string_split(x, ''), lambda y: y <> ''), lambda y: CASE y WHEN 'u' THEN 'user:' ELSE 'assistant:' END)
         || CASE l WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text]
                   ELSE [CASE act.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END
  FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1
  JOIN ins ON ins.s = p.s JOIN act ON act.s = ins.t AND (act.i IS NULL OR act.i = f.i)
  WHERE l = 'D' OR fault IN ('none', 'truncated')
  QUALIFY row_number() OVER (PARTITION BY p.conv_id, act.t ORDER BY
    p.cost + ins.c + act.c + CASE WHEN l <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END, p.audit || w || l) = 1
), n AS (
  SELECT o.conv_id, count(f.pos) AS n, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id GROUP BY o.conv_id
), e AS (
  SELECT p.conv_id, p.cost + ins.c AS cost, p.audit || w AS audit,
         p.said || list_transform(list_filter(string_split(x, ''), lambda y: y <> ''), lambda y: CASE y WHEN 'u' THEN 'user:' ELSE 'assistant:' END) AS said
  FROM p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.n = p.pos JOIN ins ON ins.s = p.s AND ins.t IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + ins.c, p.audit || w) = 1
)
SELECT n.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
FROM n JOIN e ON e.conv_id IS NOT DISTINCT FROM n.conv_id
"""
