"""Operator 13 - conversation structure repair by error-correcting Earley parsing.

A weighted grammar says which role may follow which; besides its own productions
there are three of error: delete a row, give it another role, insert an empty
row. A chart's items keep the least (cost, audit) that leads to them, an audit
being the edits' initials in order; the completed chart yields the cheapest
repair, ties to the least audit. The grammar is left-recursive, so all items begin
at the start of the conversation and a set of the chart has few of them.

A conversation of any length, one may hold a third of all rows, is parsed by
many tasks: rows are range-partitioned by conversation and turn; a stretch of at
most ``SEGMENT`` rows is parsed once from every item that may stand at its start
(its moves); a pass over the moves, numbers only, finds the items at which the
cheapest parse passes from one segment to the next. Insertions are made just
before the next row is read. So audits of one cost that stand at one border, of
which each has a letter a row and ends with one, are never the start of each
other, and comparing them by segments is right. Conversations that lie within a
segment are done at once. Only the hash of a repaired conversation, and its
audit, pass through one task in order, streamed in large pieces.

Rows of a conversation go by turn (null first), then role, then the text's hash.
A row's first fault counts: blank (nothing but whitespace), duplicate (role and
text seen earlier), truncated (its last character that is no whitespace is none
of ``.!?``). Blank and duplicate rows must be deleted.

Defined results: a null conversation id is a conversation of its own; null roles
and texts are one space. ``copies`` says how often a row stands; conversations
with no rows left have zeros, an empty audit and the hash of nothing. Repeated
rows are duplicates. An empty table gives no rows. Columns other than those named
in the call do not come in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEGMENT, SEGMENT_BYTES = 1024, 1 << 20
BLANK = " \t\n\x0b\x0c\r"
RETYPE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Roles that rows can be given or made with, by initial.
NAMES = {"u": "user", "a": "assistant"}
END = "$"

#: (head, body); small letters are roles' initials, the first head is the goal.
GRAMMAR = (("Talk", (END,)), ("Talk", ("Done", END)), ("Done", ("Open", "a")), ("Open", ("u",)), ("Open", ("Head", "u")), ("Open", ("Done", "u")), ("Head", ("s",)))
#: An item is (production, dot).
Item = tuple[int, int]
Set = dict[Item, tuple[int, str]]


def awaited(item: Item) -> str | None:
    """What stands behind the dot."""
    body = GRAMMAR[item[0]][1]
    return body[item[1]] if item[1] < len(body) else None


def completed(item: Item) -> list[Item]:
    """The items waiting for a row once the terminal behind ``item``'s dot is read: completion goes on with the items of the first set that wait for a finished head."""
    todo, out = [(item[0], item[1] + 1)], []
    while todo:
        now = todo.pop()
        if awaited(now) is not None:
            out.append(now)
        else:
            todo += [(p, 1) for p, (_, body) in enumerate(GRAMMAR) if body[0] == GRAMMAR[now[0]][0]]
    return out


#: Items that may wait for a row, all predicted at the start or reached from there.
WAITING = sorted({(p, d) for p, (_, body) in enumerate(GRAMMAR) for d, x in enumerate(body) if x == END or x.islower()})
NEXT = {item: completed(item) for item in WAITING}
#: What stood last before an item: the role that was read, none at the start.
LAST = {item: None if item[1] == 0 else {"Head": "s", "Open": "u", "Done": "a"}[GRAMMAR[item[0]][1][0]] for item in WAITING}
START: Set = {item: (0, "") for item in WAITING if item[1] == 0}


def take(chart: Set, item: Item, value: tuple[int, str]) -> bool:
    if item not in chart or value < chart[item]:
        chart[item] = value
        return True
    return False


def with_insertions(chart: Set) -> Set:
    """``chart`` and what empty rows put in at this place lead to."""
    out, todo = dict(chart), list(chart)
    while todo:
        item = todo.pop()
        if awaited(item) in NAMES:
            cost, audit = out[item]
            todo += [n for n in NEXT[item] if take(out, n, (cost + INSERT, audit + "I"))]
    return out


def scanned(chart: Set, initial: str, must_go: bool, cut: bool) -> Set:
    """The next set: the row is deleted, kept or given another role."""
    out: Set = {}
    for item, (cost, audit) in with_insertions(chart).items():
        take(out, item, (cost + DELETE, audit + "D"))
        word = awaited(item)
        if must_go or not (word == initial or word in NAMES):
            continue
        value = (cost + cut * CUT, audit + "K") if word == initial else (cost + RETYPE + cut * CUT, audit + "R")
        for n in NEXT[item]:
            take(out, n, value)
    return out


def parsed(chart: Set, rows: list[tuple[str, bool, bool]]) -> Set:
    for row in rows:
        chart = scanned(chart, *row)
    return chart


def accepted(chart: Set) -> tuple[int, str]:
    """The cheapest (cost, audit) of a completed chart."""
    return min(v for item, v in with_insertions(chart).items() if awaited(item) == END)


def repaired(audit: str, rows: list[tuple[str, str]], last: str | None) -> Iterator[str]:
    """``role:text`` of the rows (role, text) after the edits; ``last`` is the initial that stands before them."""
    at = iter(rows)
    for edit in audit:
        role, text = next(at) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = NAMES["a" if last == "u" else "u"]
        last = role[:1]
        yield f"{role}:{text}"


def fault(text: str, again: bool) -> str | None:
    body = text.strip(BLANK)
    return "blank" if not body else "duplicate" if again else "truncated" if body[-1] not in ".!?" else None


COUNTS = ("blank", "duplicate", "truncated", "illegal")
FACTS = "seg long, no_id boolean, id string, size int, " + ", ".join(f"{c} long" for c in COUNTS) + ", first string, last string, turns long, low long, high long"
MOVE = "enter int, leave int, cost long, place int, audit string"
SEGMENTS = f"{FACTS}, done boolean, cost long, audit string, sha256 string, moves array<struct<{MOVE.replace(' ', ': ').replace(',: ', ', ')}>>, roles array<string>, texts array<string>"
LEGAL = ("su", "ua", "au")


def segment(seg: int, no_id: bool, id_: str, rows: list[tuple], whole: bool) -> dict:
    """The row of one stretch: (turn, role, text, fault) of its rows. ``whole``: it is a conversation."""
    faults = [r[3] for r in rows]
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    out = dict.fromkeys((c.split()[0] for c in FACTS.split(", ")), None) | {"seg": seg, "no_id": no_id, "id": id_, "size": len(rows), "done": whole}
    out |= {c: faults.count(c) for c in COUNTS[:3]}
    out["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    out |= {"turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None)}
    if rows:
        out |= {"first": initials[0], "last": initials[-1]}
    read = [(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)]
    if whole:
        cost, audit = accepted(parsed(START, read))
        lines = "\n".join(repaired(audit, [r[1:3] for r in rows], None))
        return out | {"cost": cost, "audit": audit, "sha256": hashlib.sha256(lines.encode()).hexdigest()}
    moves = [(WAITING.index(i), WAITING.index(j), cost, audit) for i in WAITING for j, (cost, audit) in parsed({i: (0, "")}, read).items()]
    places = {a: n for n, a in enumerate(sorted({m[3] for m in moves}))}
    made = [{"enter": i, "leave": j, "cost": c, "place": places[a], "audit": a} for i, j, c, a in moves]
    return out | {"moves": made, "roles": [r[1] for r in rows], "texts": [r[2] for r in rows]}


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Stretches of the rows (no_id, id, no_turn, turn, role, text, h, n, fresh), which are sorted in range partitions; finished where a conversation lies within one."""
    spark = rows.sparkSession
    fields = spark.createDataFrame([], SEGMENTS).schema

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        base, seq = TaskContext.get().partitionId() << 33, 0
        group, held, size, split, inner = None, [], 0, False, False
        for batch in batches:
            for r in batch.to_pylist():
                if group != (r["no_id"], r["id"]):
                    if group is not None:
                        yield segment(base + seq, *group, held, inner and not split)
                        seq, inner = seq + 1, True
                    group, held, size, split = (r["no_id"], r["id"]), [], 0, False
                for copy in range(r["n"]):
                    if len(held) >= most or size > SEGMENT_BYTES:
                        yield segment(base + seq, *group, held, False)
                        seq, held, size, split = seq + 1, [], 0, True
                    held.append((None if r["no_turn"] else r["turn"], r["role"], r["text"], fault(r["text"], copy > 0 or not r["fresh"])))
                    size += len(r["text"])
        if group is not None:  # may go on in the next partition
            yield segment(base + seq, *group, held, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in stretches(batches):
            rows.append(row)
            size += sum(map(len, row.get("texts") or ())) + 200
            if size > SEGMENT_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=shape)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=shape)

    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(fields)
    return rows.mapInArrow(run, fields)


TOTALS = "cost long, blank long, duplicate long, truncated long, illegal long, gaps long"


def chosen(parts: DataFrame) -> DataFrame:
    """For each segment of conversations with several (or one at a partition's border): where the cheapest parse enters and leaves it, what is put in at the end, and on the last the conversation's totals.

    The segments of a conversation come in order; of each, a few numbers are held until its last.
    """
    moves = "transform(moves, m -> struct(m.enter, m.leave, m.cost, m.place)) as moves"
    ordered = parts.selectExpr(*(c.split()[0] for c in FACTS.split(", ")), moves).repartition("no_id", "id").sortWithinPartitions("no_id", "id", "seg")
    schema = f"seg long, enter int, leave int, tail string, {TOTALS}"
    names = [c.split()[0] for c in schema.split(", ")]

    class Talk:
        """A conversation so far: the set at its end as item -> (cost, rank), and the way back."""

        def __init__(self):
            self.chart = {WAITING.index(i): (0, 0) for i in START}
            self.way: list[tuple[int, dict[int, int]]] = []
            self.counts, self.turns, self.low, self.high, self.last = dict.fromkeys(COUNTS, 0), 0, None, None, None

        def add(self, r: dict) -> None:
            found: dict[int, tuple] = {}
            for m in r["moves"]:
                if m["enter"] in self.chart:
                    cost, rank = self.chart[m["enter"]]
                    value = (cost + m["cost"], rank, m["place"], m["enter"])
                    if m["leave"] not in found or value < found[m["leave"]]:
                        found[m["leave"]] = value
            ranks = {v: n for n, v in enumerate(sorted({v[1:3] for v in found.values()}))}
            self.chart = {i: (v[0], ranks[v[1:3]]) for i, v in found.items()}
            self.way.append((r["seg"], {i: v[3] for i, v in found.items()}))
            if r["size"]:
                for c in COUNTS:
                    self.counts[c] += r[c]
                self.counts["illegal"] += self.last is not None and self.last + r["first"] not in LEGAL
                self.last = r["last"]
            if r["turns"]:
                self.turns += r["turns"] - (r["low"] == self.high)  # a turn may go on in the next segment
                self.low, self.high = r["low"] if self.low is None else self.low, r["high"]

        def rows(self) -> Iterator[tuple]:
            # of sets with one rank the insertions decide, as behind equal audits
            ends = {}
            for i, (cost, rank) in self.chart.items():
                for j, (more, tail) in with_insertions({WAITING[i]: (0, "")}).items():
                    if awaited(j) == END:
                        ends[i, j] = (cost + more, rank, tail, i)
            cost, _, tail, at = min(ends.values())
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            back = []
            for seg, came in reversed(self.way):
                back.append((seg, came[at], at))
                at = came[at]
            for n, (seg, enter, leave) in enumerate(reversed(back)):
                end = n == len(back) - 1
                yield (seg, enter, leave, *((tail, cost, *self.counts.values(), gaps) if end else ("", *[None] * 6)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, talk = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if group != (r["no_id"], r["id"]):
                    out += talk.rows() if talk else ()
                    group, talk = (r["no_id"], r["id"]), Talk()
                talk.add(r)
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=shape)
        if talk:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in talk.rows()], schema=shape)

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    shape = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])
    return ordered.mapInArrow(run, schema)


def joined(parts: DataFrame, ways: DataFrame) -> DataFrame:
    """One row a conversation, from its segments and the way through them: pieces are put together in the tasks, then hashed in order."""
    head = f"no_id boolean, id string, seg long, body binary, audit string, {TOTALS}"
    totals = [c.split()[0] for c in TOTALS.split(", ")]
    both = parts.selectExpr("no_id", "id", "seg", "moves", "roles", "texts").join(ways, "seg")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["audit"] = next(m["audit"] for m in r["moves"] if (m["enter"], m["leave"]) == (r["enter"], r["leave"])) + r["tail"]
                lines = repaired(r["audit"], list(zip(r["roles"], r["texts"], strict=True)), LAST[WAITING[r["enter"]]])
                r["body"] = "".join("\n" + x for x in lines).encode()
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("no_id", "id", "seg", "body", "audit", *totals)} for r in rows], schema=shape)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audit, empty = hashlib.sha256(), [], True
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                body = r["body"][1:] if empty else r["body"]
                empty = empty and not r["body"]
                digest.update(body)
                audit.append(r["audit"])
                if r["cost"] is not None:
                    out.append({k: r[k] for k in ("no_id", "id", *totals)} | {"audit": "".join(audit), "sha256": digest.hexdigest()})
                    digest, audit, empty = hashlib.sha256(), [], True
            yield pa.RecordBatch.from_pylist(out, schema=last)

    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    schema_of = lambda ddl: pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])
    result = f"no_id boolean, id string, {TOTALS}, audit string, sha256 string"
    shape, last = schema_of(head), schema_of(result)
    made = both.mapInArrow(pieces, head).repartition("no_id", "id").sortWithinPartitions("no_id", "id", "seg")
    return made.mapInArrow(hashed, result)


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: str = "1", segment_rows: int = SEGMENT) -> DataFrame:
    """One row a conversation: its id, gaps, the four counts, cost, audit, repaired_sha256. ``copies`` is an SQL expression: how often a row stands."""
    kind = dict(rows.dtypes)[id_col]
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(
        F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.col(turn_col).isNull().alias("no_turn"), F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"),
        space(role_col).alias("role"), space(text_col).alias("text"), F.expr(copies).cast("int").alias("n"),
    )
    key = ["no_id", "id", "no_turn", "turn", "role", "h"]
    once = plain.withColumn("h", F.sha2("text", 256)).groupBy(*key).agg(F.max("text").alias("text"), F.sum("n").cast("int").alias("n"))
    # where a role and text stand first: nulls are the first turn
    first = once.where("n > 0").groupBy("no_id", "id", "role", "h").agg(F.min(F.struct(~F.col("no_turn"), "turn")).alias("f"))
    first = first.selectExpr("no_id", "id", "not f.col1 as no_turn", "f.turn as turn", "role", "h", "true as fresh")
    by = [F.col("no_id"), F.col("id"), F.desc("no_turn"), F.col("turn"), F.col("role"), F.col("h")]
    dealt = once.join(first, key, "left").fillna(False, ["fresh"]).repartitionByRange(*by).sortWithinPartitions(*by)
    parts = common.stored(segments(dealt.select("no_id", "id", "no_turn", "turn", "role", "text", "n", "fresh"), segment_rows), "segments")
    whole = parts.where("done").selectExpr("no_id", "id", "cost", *COUNTS, "coalesce(high - low + 1 - turns, 0) as gaps", "audit", "sha256")
    rest = parts.where("not done")
    out = whole.unionByName(joined(rest, common.stored(chosen(rest), "segment_ways")))
    return out.select(F.when(~F.col("no_id"), F.col("id")).cast(kind).alias(id_col), "gaps", *COUNTS, "cost", "audit", F.col("sha256").alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults of five kinds, by a hash of conversation and turn: conv_id, turn, role, text, and copies (0, 1 or 2)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(space("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(common.read_table(spark, sf_dir, "conversations"))
    return repair(rows.withColumn("conv_id", F.col("conv_id").cast("long")), copies="copies")



def _edit(value: str, cost: str, letter: str) -> str:
    """SQL for a (cost, audit), kept as text of nine digits and the audit, with one edit more."""
    return f"(printf('%09d', {value}[:9]::int + {cost}) || {value}[10:] || '{letter}')"


def _closed(v: list[str]) -> list[str]:
    """SQL of the four states (start, after s, after u, after a) with what insertions lead to."""
    u = [v[2], *(_edit(v[i], "2", "I") for i in (0, 1, 3))]
    a = [v[3], _edit(v[2], "2", "I"), *(_edit(v[i], "4", "II") for i in (0, 1))]
    return [v[0], v[1], f"least({', '.join(u)})", f"least({', '.join(a)})"]


def _read(v: list[str]) -> list[str]:
    """SQL of the states after a row (initial i, must_go, cut), from closed ones."""
    keep = lambda x, role: f"case when must_go then '999999999' when i = '{role}' then {_edit(x, 'cut', 'K')} else {_edit(x, '2 + cut', 'R')} end"
    system = f"case when must_go or i <> 's' then '999999999' else {_edit(v[0], 'cut', 'K')} end"
    gone = [_edit(x, "3", "D") for x in v]
    return [gone[0], f"least({gone[1]}, {system})", f"least({gone[2]}, {', '.join(keep(v[x], 'u') for x in (0, 1, 3))})", f"least({gone[3]}, {keep(v[2], 'a')})"]


_NOW, _SHUT = ["s0", "s1", "s2", "s3"], ["c0", "c1", "c2", "c3"]

SQL = rf"""
with recursive steps as (
  select list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) as crc
), given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
), hashed as (
  select k, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(k)), lambda i: ascii(k[i + 1])::bigint)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind
  from (select distinct k from given), steps
), hurt as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy
  from given join hashed using (k)
), placed as (
  select *, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as body, role[1] as i,
    row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as n,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again,
    lag(role[1]) over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as before
  from hurt
), judged as (
  select *, case when body = '' then 'blank' when again > 1 then 'duplicate' when body[-1] not in ('.', '!', '?') then 'truncated' else '' end as fault,
    before is not null and before || i not in ('su', 'ua', 'au') as wrong
  from placed
), rows as (
  select conv_id, n, i, role, text, fault in ('blank', 'duplicate') as must_go, (fault = 'truncated')::int as cut from judged
), walk as (
  select conv_id, 0::bigint as n, '000000000' as s0, '999999999' as s1, '999999999' as s2, '999999999' as s3 from (select distinct conv_id from conversations)
  union all
  select conv_id, n, {', '.join(f'{x}::varchar' for x in _read(_SHUT))} from (
    select w.conv_id, w.n + 1 as n, {', '.join(f'{x} as {name}' for x, name in zip(_closed(_NOW), _SHUT, strict=True))}, r.i, r.must_go, r.cut
    from walk w join rows r on r.conv_id is not distinct from w.conv_id and r.n = w.n + 1)
), best as (
  select conv_id, least(s0, {_closed(_NOW)[3]}) as v from walk qualify row_number() over (partition by conv_id order by n desc) = 1
), edits as (
  select conv_id, v[10:] as audit, unnest(string_split(v[10:], '')) as e, generate_subscripts(string_split(v[10:], ''), 1) as place from best where len(v) > 9
), read as (
  select *, sum((e <> 'I')::int) over (partition by conv_id order by place) as n from edits
), standing as (
  select e.conv_id, e.place, e.e, r.i, r.role, r.text, row_number() over (partition by e.conv_id order by e.place) as k,
    first_value(e.e = 'K' and r.i = 's') over (partition by e.conv_id order by e.place) as led
  from read e left join rows r on e.conv_id is not distinct from r.conv_id and e.n = r.n and e.e <> 'I' where e.e <> 'D'
), texts as (
  select conv_id, string_agg(case when e = 'K' then role when (k - coalesce(led, false)::int) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by place) as t from standing group by conv_id
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
    count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where wrong) as illegal
  from judged group by conv_id
)
select b.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  v[:9]::bigint as cost, v[10:] as audit, sha256(coalesce(t, '')) as repaired_sha256
from best b left join counts c on b.conv_id is not distinct from c.conv_id left join texts t on b.conv_id is not distinct from t.conv_id
"""

QUERIES = {"op13_turn_repair": op13_turn_repair}
ORACLES = {"op13_turn_repair": SQL}
