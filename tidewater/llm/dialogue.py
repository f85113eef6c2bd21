"""Repair of conversations to system? (user assistant)+ by A* over the edit lattice.

Rows of a conversation stand in the order of their turn (nulls first), then role and text.  A row is kept (0), gets the other role
(1) or is deleted (2), and empty turns are inserted (5); blank and repeated rows must go, a truncated row that stays
costs 5 more.  A node of the lattice is (rows read, state of the role pattern); the heuristic is the suffix sum of
what the rows ahead cost at least, 2 for each that must go and 2 for each truncated one.  Nodes are taken by
(cost plus heuristic, audit), so the first way to a node is its cheapest, and the ASCII-least of those.

Rows are range-partitioned by conversation and turn, so a conversation of any length is spread over tasks.  A task reads
conversations as they pass.  One that ends in its task and has at most SPAN rows is solved at once.  Of others, pieces of SPAN rows (or
some BYTES of text) are solved from each of the four states to each; a fold over the pieces joins them, and each piece is then repaired by its
part of the audit.  Only costs and audits of a conversation meet in one task, and its repaired text passes
through one for its digest, which is a running hash.

Null role or text: one space.  A null conversation id is an id; null turns come first.  A row without a first letter in its role fits
nowhere as it is.  Repeated rows: all but the first are duplicates.  Empty table: an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bound_batches, materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPAN, BYTES = 256, 1 << 20
SPACE = " \t\n\x0b\x0c\r"
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3

#: States: nothing yet, after s, after u, after a.  What may follow each, and where it leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ADDED = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (START, ASSISTANT)

STATS = "blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, first_turn long, last_turn long, first_role string, last_role string"
REPAIRED = "array<struct<edit:string,role:string,text:string>>"


def charge(fault: int) -> int:
    """What a row costs at least: its deletion, or none."""
    return DELETE if fault else 0


def solve(rows: list[tuple[str, int]], start: int, accepted: tuple[int, ...] | None = None) -> list[tuple[int, int, str]]:
    """(state, cost, audit) for every state that ends the rows; the one best of the accepted states if these are given.

    rows: (first letter of the role, fault).
    """
    n = len(rows)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + charge(rows[i][1])
    queue, closed, out = [(ahead[0], "", 0, start)], set(), []
    while queue:
        f, audit, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n:
            if accepted is None or state in accepted:
                out.append((state, f, audit))
            if accepted and out or len(out) == 4:
                return out
        cost, new = f - ahead[i], USER if state != USER else ASSISTANT
        steps = [(INSERT, "I", i, new)]
        if i < n:
            role, fault = rows[i]
            steps.append((DELETE, "D", i + 1, state))
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                steps.append((REROLE + more, "R", i + 1, new))
                if role in NEXT[state]:
                    steps.append((KEEP + more, "K", i + 1, NEXT[state][role]))
        for c, edit, j, to in steps:
            if (j, to) not in closed:
                heapq.heappush(queue, (cost + c + ahead[j], audit + edit, j, to))
    return out


def apply(audit: str, state: int, roles: list[str], texts: list[str]) -> list[dict]:
    """The repaired rows; state: of the pattern before the first row."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            role, text = roles[i], texts[i]
            state = NEXT[state][role[:1]]
        else:
            state = USER if state != USER else ASSISTANT
            role, text = ADDED[state], texts[i] if edit == "R" else ""
        i += edit != "I"
        out.append({"edit": edit, "role": role, "text": text})
    return out


def stats(rows: list[tuple], before: str | None) -> dict:
    """Counts over (turn, role, fault) rows; before: the first letter of the role just before them."""
    turns = sorted({t for t, _, _ in rows if t is not None})
    letters = [r[:1] for _, r, _ in rows]
    pairs = zip([before, *letters] if before is not None else letters, letters if before is not None else letters[1:], strict=False)
    kinds = [f for _, _, f in rows]
    return {
        "blank": kinds.count(BLANK), "duplicate": kinds.count(DUPLICATE), "truncated": kinds.count(CUT), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in pairs),
        "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(turns), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "first_role": letters[0], "last_role": letters[-1],
    }


def arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def pieces_schema(conv: str) -> str:
    return f"conv_id {conv}, part int, nth int, whole boolean, {STATS}, cost long, audit string, repaired {REPAIRED}, paths array<struct<start:int,state:int,cost:long,audit:string>>, roles array<string>, texts array<string>"


def to_pieces(schema: str):
    """Rows sorted by conversation and place: a record for each whole conversation, or for each piece of others."""
    fields = arrow(schema)

    def run(batches):
        part, nth, done, size = TaskContext.get().partitionId(), 0, [], 0
        held: list[tuple] = []  # (turn, role, text, fault) of the conversation so far
        held_bytes, conv, first, cut, last = 0, None, True, False, None

        def record(whole: bool) -> None:
            nonlocal nth, held, held_bytes, size
            codes = [(r[:1], f) for _, r, _, f in held]
            roles, texts = [x[1] for x in held], [x[2] for x in held]
            out = {"conv_id": conv, "part": part, "nth": nth, "whole": whole} | stats([(t, r, f) for t, r, _, f in held], None)
            if whole:
                _, cost, audit = solve(codes, START, ACCEPTED)[0]
                out |= {"cost": cost, "audit": audit, "repaired": apply(audit, START, roles, texts)}
            else:
                out |= {"paths": [{"start": s, "state": q, "cost": c, "audit": a} for s in range(4) for q, c, a in solve(codes, s)], "roles": roles, "texts": texts}
            nth += 1
            size += held_bytes
            held, held_bytes = [], 0
            done.append(out)

        def flush():
            nonlocal done, size
            out, done, size = pa.RecordBatch.from_pylist(done, fields), [], 0
            return out

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "later")]
            for c, turn, role, text, fault, later in zip(*columns, strict=True):
                if last is not None and c != conv:
                    record(not first and not cut)
                    first, cut, last = False, False, None
                elif len(held) >= SPAN or held_bytes >= BYTES:
                    record(False)
                    cut = True
                if size >= BYTES:
                    yield flush()
                conv = c
                if fault != BLANK and (later or (turn, role, text) == last):
                    fault = DUPLICATE
                last = (turn, role, text)
                held.append((turn, role, text, fault))
                held_bytes += len(text)
        if held:
            record(False)
        if done:
            yield flush()

    return run


def precedes(x: tuple, y: tuple) -> bool:
    """Whether x's audit is less than y's. Nodes are (cost, node before, audit of the piece, start) of the same piece."""
    a, b = [], []
    while x is not y:
        a.append(x[2])
        b.append(y[2])
        x, y = x[1], y[1]
    return "".join(reversed(a)) < "".join(reversed(b))


def fold(schema: str):
    """Pieces of conversations in order: each piece's part of the best audit; the last one has the conversation's counts and audit."""
    fields = arrow(schema)

    def run(batches):
        root = (0, None, "", None)
        conv, states, held, total = None, {}, [], None

        def close():
            best = None
            for q in ACCEPTED:
                x = states.get(q)
                if x and (best is None or (x[0], 0) < (best[0], 0) or x[0] == best[0] and precedes(x, best)):
                    best = x
            audits, x = [], best
            while x is not root:
                audits.append((x[3], x[2]))
                x = x[1]
            audits.reverse()
            out = [{"conv_id": conv, "part": p, "nth": n, "start": s, "audit": a, "last": False} for (p, n), (s, a) in zip(held, audits, strict=True)]
            out[-1] |= total | {"last": True, "cost": best[0], "whole_audit": "".join(a for _, a in audits)}
            return out

        done = []
        for b in batches:
            for r in b.to_pylist():
                if held and r["conv_id"] != conv:
                    done += close()
                    held = []
                    if len(done) >= 1000:
                        yield pa.RecordBatch.from_pylist(done, fields)
                        done = []
                if not held:
                    conv, states, total = r["conv_id"], {START: root}, None
                new: dict[int, tuple] = {}
                for x in r["paths"]:
                    if (before := states.get(x["start"])) is not None:
                        node = (before[0] + x["cost"], before, x["audit"], x["start"])
                        old = new.get(x["state"])
                        if old is None or node[0] < old[0] or node[0] == old[0] and precedes(node, old):
                            new[x["state"]] = node
                states = new
                held.append((r["part"], r["nth"]))
                total = merged(total, {k.split()[0]: r[k.split()[0]] for k in STATS.split(", ")})
        if held:
            done += close()
        if done:
            yield pa.RecordBatch.from_pylist(done, fields)

    return run


def merged(a: dict | None, b: dict) -> dict:
    """Counts of two stretches of a conversation, a before b."""
    if a is None:
        return b
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last_role"] + b["first_role"] not in ("su", "ua", "au")
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    known = [x for x in (a["low"], b["low"]) if x is not None], [x for x in (a["high"], b["high"]) if x is not None]
    out |= {"low": min(known[0], default=None), "high": max(known[1], default=None), "first_role": a["first_role"], "last_role": b["last_role"]}
    out |= {"first_turn": a["first_turn"] if a["first_turn"] is not None else b["first_turn"], "last_turn": b["last_turn"] if b["last_turn"] is not None else a["last_turn"]}
    return out


def to_repaired(schema: str):
    """Adds the repaired rows of a piece by its part of the audit."""
    fields = arrow(schema)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                fixed = apply(r["audit"], r["start"], r["roles"], r["texts"])
                yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in fields.names} | {"repaired": fixed}], fields)

    return run


def digest_pieces(schema: str):
    """Pieces of conversations in order: the digest of the repaired rows beside the last piece's columns."""
    fields = arrow(schema)

    def run(batches):
        running, some = hashlib.sha256(), False
        for b in batches:
            for r in b.to_pylist():
                for x in r["repaired"]:
                    running.update(("\n" * some + x["role"] + ":" + x["text"]).encode("utf-8", "surrogatepass"))
                    some = True
                if r["last"]:
                    yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in fields.names} | {"repaired_sha256": running.hexdigest()}], fields)
                    running, some = hashlib.sha256(), False

    return run


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault, later): blank and truncated rows, and those that repeat one of an earlier turn."""
    key = [F.xxhash64(F.lit(i), "conv_id", "role", "text").alias(f"k{i}") for i in (1, 2)]
    text = F.col("text")
    end = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    fault = F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~end.isin(".", "!", "?"), CUT).otherwise(NONE)
    d = rows.select("*", *key, F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("at"))
    again = d.groupBy("k1", "k2").agg(F.min("at").alias("first"), F.max("at").alias("latest")).where("first < latest").drop("latest")
    return d.join(again, ["k1", "k2"], "left").select("conv_id", "turn", "role", "text", fault.alias("fault"), F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("later"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole conversations, pieces of others) of rows (conv_id, turn, role, text).

    Whole: STATS, cost, audit and repaired.  Pieces: part and nth in order, audit of the piece and repaired; the last one of a
    conversation (`last`) has STATS, cost and whole_audit besides.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    conv = rows.schema["conv_id"].dataType.simpleString()
    d = bound_batches(faults(rows))
    d = d.repartitionByRange(parts, "conv_id", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pieces_schema(conv)
    found = materialize(d.mapInArrow(to_pieces(schema), schema), "dialogue-pieces")
    split = found.where("not whole")
    order = ["conv_id", "part", "nth"]
    chosen = f"conv_id {conv}, part int, nth int, start int, audit string, last boolean, {STATS}, cost long, whole_audit string"
    light = split.select(*order, *[c.split()[0] for c in STATS.split(", ")], "paths")
    ways = materialize(light.repartition(parts, "conv_id").sortWithinPartitions(*order).mapInArrow(fold(chosen), chosen), "dialogue-audits")
    both = ways.join(split.select("part", "nth", "roles", "texts"), ["part", "nth"])
    fixed = f"{chosen}, repaired {REPAIRED}"
    whole = found.where("whole").select("conv_id", *[c.split()[0] for c in STATS.split(", ")], "cost", "audit", "repaired")
    return whole, both.mapInArrow(to_repaired(fixed), fixed)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, hit): rows damaged by the checksum of `conv_id:turn`; dropped ones are still there, with hit 0."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    d = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"), hit.cast("int").alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("hit") == 3, 2).otherwise(1)
    return d.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "hit", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def conversation_report(rows: DataFrame) -> DataFrame:
    d = damaged(rows)
    whole, pieces = repair(d.where("hit <> 0").select("conv_id", "turn", "role", "text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    whole = whole.withColumn("repaired_sha256", F.sha2(F.array_join(line, "\n"), 256)).drop("repaired")
    conv = rows.schema["conv_id"].dataType.simpleString()
    last = f"conv_id {conv}, {STATS}, cost long, whole_audit string, repaired_sha256 string"
    split = pieces.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "nth").mapInArrow(digest_pieces(last), last).withColumnRenamed("whole_audit", "audit")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    out = whole.unionByName(split).select("conv_id", gaps, *columns[2:])
    zero = F.lit(0).cast("long")
    gone = d.groupBy("conv_id").agg(F.max("hit").alias("hit")).where("hit = 0")
    return out.union(gone.select("conv_id", *[zero.alias(c) for c in columns[1:7]], F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))


#: The same by dynamic programming: dp has, for each conversation, rows read and state, the least (cost, audit, repaired).
CONVERSATION_SQL = """
with recursive raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: unicode(c)::bigint) as bytes
  from conversations),
hits as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b:
    list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint) % 20 as hit
  from raw),
d as (
  select conv_id, turn, case when hit = 4 then 'user' else role end as role,
    case when hit = 1 then '' when hit = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when hit = 3 then 2 else 1 end)) as copy
  from hits where hit <> 0),
o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen
  from d),
f as materialized (
  select conv_id, turn, role, text, i, role[1] as c, lag(role[1]) over (partition by conv_id order by i) || role[1] as pair,
    case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 1 when seen > 1 then 2
      when right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) not in ('.', '!', '?') then 3 else 0 end as fault
  from o),
ins(q, added, q1, cost, out) as (values
  (0, '', 0, 0, ''), (1, '', 1, 0, ''), (2, '', 2, 0, ''), (3, '', 3, 0, ''),
  (0, 'I', 2, 5, chr(10) || 'user:'), (1, 'I', 2, 5, chr(10) || 'user:'), (2, 'I', 3, 5, chr(10) || 'assistant:'), (3, 'I', 2, 5, chr(10) || 'user:'),
  (0, 'II', 3, 10, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 'II', 3, 10, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 'II', 2, 10, chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 'II', 3, 10, chr(10) || 'user:' || chr(10) || 'assistant:')),
edits(q1, edit, c, q2, cost, role) as (values
  (0, 'K', 's', 1, 0, ''), (0, 'K', 'u', 2, 0, ''), (1, 'K', 'u', 2, 0, ''), (2, 'K', 'a', 3, 0, ''), (3, 'K', 'u', 2, 0, ''),
  (0, 'R', null, 2, 1, 'user'), (1, 'R', null, 2, 1, 'user'), (2, 'R', null, 3, 1, 'assistant'), (3, 'R', null, 2, 1, 'user'),
  (0, 'D', null, 0, 2, ''), (1, 'D', null, 1, 2, ''), (2, 'D', null, 2, 2, ''), (3, 'D', null, 3, 2, '')),
dp(conv_id, i, q, best) as (
  select distinct conv_id, 0::bigint, 0, {'cost': 0::bigint, 'audit': '', 'out': ''} from f
  union all
  select dp.conv_id, dp.i + 1, e.q2, min({'cost': (dp.best.cost + s.cost + e.cost + case when f.fault = 3 and e.edit <> 'D' then 5 else 0 end)::bigint, 'audit': dp.best.audit || s.added || e.edit,
    'out': dp.best.out || s.out || case e.edit when 'K' then chr(10) || f.role || ':' || f.text when 'R' then chr(10) || e.role || ':' || f.text else '' end})
  from dp join f on f.conv_id is not distinct from dp.conv_id and f.i = dp.i + 1 join ins s on s.q = dp.q join edits e on e.q1 = s.q1 and (e.edit <> 'K' or e.c = f.c) and (e.edit = 'D' or f.fault not in (1, 2))
  group by 1, 2, 3),
n as (
  select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from f group by 1),
z as (
  select dp.conv_id, min({'cost': (dp.best.cost + s.cost)::bigint, 'audit': dp.best.audit || s.added, 'out': dp.best.out || s.out}) as best
  from dp join n on n.conv_id is not distinct from dp.conv_id and n.n = dp.i join ins s on s.q = dp.q where s.q1 in (0, 3) group by 1)
select a.conv_id, coalesce(n.gaps, 0) as gaps, coalesce(n.blank, 0) as blank, coalesce(n.duplicate, 0) as duplicate, coalesce(n.truncated, 0) as truncated, coalesce(n.illegal, 0) as illegal,
  coalesce(z.best.cost, 0) as cost, coalesce(z.best.audit, '') as audit, sha256(coalesce(substr(z.best.out, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join n on n.conv_id is not distinct from a.conv_id left join z on z.conv_id is not distinct from a.conv_id
"""
