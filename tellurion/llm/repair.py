"""Conversation structure repair by a run-length min-plus DP.

A row is a symbol: the class of its role's initial (s, u, a or other) and what is wrong with it. Blank rows and rows whose
role and text came before must go. Edits keep a row, give it the role user or assistant, delete it or insert an empty row,
and the roles that are left must spell `(s?(ua)+)?`. A symbol moves the four states of that language by a min-plus
matrix, so a run of equal symbols is a power of it, made of cached binary powers. Costs run from the end of a
conversation to its start, choices from the start to the end: halves of a power, remembered by what follows, give the
audit without a step for each row of a long run.

Scale: rows alike in all columns become one row with a count first. Rows are dealt out by ranges of (conversation, turn,
role, text) and each range is a piece, so a conversation of a third of all rows is many pieces, each a bounded group of
symbols without texts. Pieces of a conversation pass by one at a time, last to first with a vector of four costs, first
to last with one state. Texts join their edits by row. A result that is one value for a conversation, an audit or a
digest, is made in one task; texts stream through the digest, so they are not held.

Defined cases: a null role or text is one space; turns go null first, rows of one turn by role, then text, in code-point
order; a turn need not be unique; a null conv_id is a conversation; other columns are not looked at, so their names do
not matter; repeated rows are duplicates; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import stored, table

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")

#: States: nothing yet, after the system row, after a user row, after an assistant row; what each may be followed by.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
STATES = range(len(NEXT))
NEVER = 1 << 60
#: A row's symbol: lower case is sound, upper case truncated, a digit has to go (0 to 3 for s, u, a and other).
CLASSES = "suao"
GOES = "0123"


def _target(state: int) -> str:
    """The role that a new or changed row has to have."""
    return "u" if "u" in NEXT[state] else "a"


def _minplus(x: tuple, y: tuple) -> tuple:
    return tuple(tuple(min(x[i][k] + y[k][j] for k in STATES) for j in STATES) for i in STATES)


def _applied(x: tuple, v: tuple) -> tuple:
    return tuple(min(x[i][k] + v[k] for k in STATES) for i in STATES)


def _inserts() -> tuple:
    """Cost from state to state by inserted rows alone."""
    one = tuple(tuple(0 if i == j else INSERT if NEXT[i].get(_target(i)) == j else NEVER for j in STATES) for i in STATES)
    return _minplus(_minplus(one, one), one)


INSERTS = _inserts()
#: What is still to pay at a conversation's end.
FINAL = _applied(INSERTS, tuple(0 if i in ENDS else NEVER for i in STATES))


def _choices(symbol: str, state: int) -> list[tuple[str, str, int, int]]:
    """(edit, role, cost, state after) of the edits of the row itself, in ASCII order."""
    out = [("D", ".", DELETE, state)]
    if symbol not in GOES:
        more = TRUNCATED if symbol.isupper() else 0
        if (to := NEXT[state].get(symbol.lower())) is not None:
            out.append(("K", ".", more, to))
        role = _target(state)
        out.append(("R", role, REROLE + more, NEXT[state][role]))
    return out


@lru_cache(None)
def power(symbol: str, k: int) -> tuple:
    """The matrix of 2^k rows of the symbol, each with what is inserted before it."""
    if k:
        half = power(symbol, k - 1)
        return _minplus(half, half)
    own = [[NEVER] * len(NEXT) for _ in NEXT]
    for i in STATES:
        for _, _, cost, to in _choices(symbol, i):
            own[i][to] = min(own[i][to], cost)
    return _minplus(INSERTS, tuple(map(tuple, own)))


def _powers(n: int) -> list[int]:
    return [k for k in range(n.bit_length()) if n >> k & 1]


def before(symbol: str, n: int, v: tuple) -> tuple:
    """Costs before n rows of the symbol, of those behind them."""
    for k in _powers(n):
        v = _applied(power(symbol, k), v)
    return v


@lru_cache(1 << 16)
def _unrolled(symbol: str, k: int, state: int, v: tuple) -> tuple[str, str, int]:
    """Edits, their roles and the state after 2^k rows; v: costs behind them, less the least one."""
    if k:
        middle = _applied(power(symbol, k - 1), v)
        x, xr, state = _unrolled(symbol, k - 1, state, _level(middle))
        y, yr, state = _unrolled(symbol, k - 1, state, v)
        return x + y, xr + yr, state
    costs = _applied(power(symbol, 0), v)
    edits = roles = ""
    while True:
        options = _choices(symbol, state)
        role = _target(state)
        options.insert(1, ("I", role, INSERT, NEXT[state][role]))
        for edit, role, cost, to in options:
            if cost + (costs if edit == "I" else v)[to] == costs[state]:
                edits, roles, state = edits + edit, roles + role, to
                break
        if edit != "I":
            return edits, roles, state


def _level(v: tuple) -> tuple:
    return tuple(x - min(v) for x in v)


def unroll(symbol: str, n: int, state: int, v: tuple) -> tuple[str, str, int]:
    """Least edits of n rows of the symbol before costs v, their roles, and the state behind them."""
    behind, blocks = v, []
    for k in _powers(n):
        blocks.append((k, behind))
        behind = _applied(power(symbol, k), behind)
    edits, roles = [], []
    for k, rest in reversed(blocks):
        e, r, state = _unrolled(symbol, k, state, _level(rest))
        edits.append(e)
        roles.append(r)
    return "".join(edits), "".join(roles), state


def runs(symbols: str, copies: list[int]) -> list[tuple[str, int]]:
    """Runs of equal symbols; the copies of a row behind its first have to go."""
    out: list[list] = []
    for s, n in zip(symbols, copies):
        gone = s if s in GOES else GOES[CLASSES.index(s.lower())]
        for symbol, times in ((s, 1), (gone, n - 1)):
            if out and (out[-1][0] == symbol or symbol in GOES and out[-1][0] in GOES):
                out[-1][1] += times
            elif times:
                out.append([symbol, times])
    return [(s, n) for s, n in out]


def _per_row(edits: str, roles: str, copies: list[int]) -> tuple[list[str], list[str]]:
    """The edits of each row: as many that are no insert as it has copies, and the inserts before them; the last has the rest."""
    own = [i + 1 for i, e in enumerate(edits) if e != "I"]
    ends, n = [], 0
    for c in copies:
        n += c
        ends.append(own[n - 1])
    ends[-1] = len(edits)
    starts = [0, *ends[:-1]]
    return [edits[a:b] for a, b in zip(starts, ends)], [roles[a:b] for a, b in zip(starts, ends)]


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces come last to first within a conversation; each gets the costs behind it and whether it is the last."""
    now, v = object(), FINAL
    for b in batches:
        behind, last = [], []
        for conv, symbols, copies in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))):
            last.append(conv != now)
            if conv != now:
                now, v = conv, FINAL
            behind.append(v)
            for symbol, n in reversed(runs(symbols, copies)):
                v = before(symbol, n, v)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(behind, pa.list_(pa.int64())), pa.array(last, pa.bool_())], names=[*b.schema.names, "behind", "last"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces come first to last within a conversation; each gets its edits, its share of the cost, and pairs of neighbours that are no order of roles."""
    now, state, left = object(), 0, ""
    for b in batches:
        out: list[tuple] = []
        for conv, symbols, copies, behind, last in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 5, 6))):
            if conv != now:
                now, state, left = conv, 0, ""
            edits, roles, illegal, cost, v = [], [], 0, 0, tuple(behind)
            parts = []
            for symbol, n in reversed(runs(symbols, copies)):
                parts.append((symbol, n, v))
                v = before(symbol, n, v)
            for symbol, n, rest in reversed(parts):
                e, r, state = unroll(symbol, n, state, rest)
                edits.append(e)
                roles.append(r)
                cost += DELETE * e.count("D") + REROLE * e.count("R") + INSERT * e.count("I") + TRUNCATED * symbol.isupper() * (e.count("K") + e.count("R"))
            while last and state not in ENDS:
                role = _target(state)
                edits.append("I")
                roles.append(role)
                state, cost = NEXT[state][role], cost + INSERT
            for s, n in zip(symbols, copies):
                c = CLASSES[GOES.index(s)] if s in GOES else s.lower()
                illegal += n - 1 + (left != "" and left + c not in ("su", "ua", "au"))
                left = c
            e, r = "".join(edits), "".join(roles)
            out.append((e, cost, illegal, *_per_row(e, r, copies)))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
        own = [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), *own], names=["conv_id", "seg", "ats", "edits", "cost", "illegal", "own", "roles"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation, joined by line feeds; conversations come one after the other."""
    now, h, kind = object(), None, None
    for b in batches:
        kind, out = b.schema[0].type, []
        for conv, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if conv != now:
                if h:
                    out.append((now, h.hexdigest()))
                now, h = conv, hashlib.sha256(line)
            else:
                h.update(b"\n" + line)
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], pa.string())], names=["conv_id", "repaired_sha256"])
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([h.hexdigest()])], names=["conv_id", "repaired_sha256"])


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def _schema(rows: DataFrame, own: str) -> StructType:
    return StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *StructType.fromDDL(own).fields])


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, fault and symbol of the distinct rows; fault is that of the first copy, the others of a row that is not blank are duplicates."""
    distinct = rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    distinct = distinct.withColumn("digest", F.md5("text"))
    first = distinct.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct(F.col("turn").alias("t"))).alias("first"))
    both = distinct.join(first, F.expr("conv_id <=> c and role = r and digest = d")).withColumn("early", F.expr("turn <=> first.t"))
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", "b").when(~F.col("early"), "d").when(~F.right(bare, F.lit(1)).isin(*STOPS), "t").otherwise("")
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    found = both.withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1)).withColumn("kind", kind)
    symbol = F.when(F.col("fault").isin("b", "d"), F.translate("kind", CLASSES, GOES)).when(F.col("fault") == "t", F.upper("kind")).otherwise(F.col("kind"))
    return found.select("conv_id", "turn", "role", "text", "copies", "fault", symbol.alias("symbol"))


def placed(rows: DataFrame) -> DataFrame:
    """The judged rows with `at`, ascending in their order over the whole table, and `seg`, the range that they are in."""
    spark, keys = rows.sparkSession, ["conv_id", "turn", "role"]
    # texts that begin alike stay in one range, where they are put in order as a whole
    ranged = judged(rows).repartitionByRange(*keys, F.substring("text", 1, 64)).sortWithinPartitions(*keys, "text")
    return stored(spark, ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("seg", F.shiftright("at", 33)), "repair-rows")


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, seg, ats, edits, cost, illegal, own and roles for each piece of placed rows."""
    pieces = rows.groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list(F.struct("at", "symbol", "copies"))).alias("x"))
    pieces = pieces.select("conv_id", "seg", F.array_join("x.symbol", "").alias("symbols"), F.col("x.copies").alias("copies"), F.col("x.at").alias("ats"))
    pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg"))
    costs = pieces.mapInArrow(_costs, _schema(rows, "seg bigint, symbols string, copies array<bigint>, ats array<bigint>, behind array<bigint>, last boolean"))
    # a partition still holds whole conversations
    return costs.sortWithinPartitions("conv_id", "seg").mapInArrow(_edits, _schema(rows, "seg bigint, ats array<bigint>, edits string, cost bigint, illegal bigint, own array<string>, roles array<string>"))


def edited(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, at, k, edit, role, text: a row for each edit, in the order of at and k; deleted rows have edit D and their own role and text."""
    each = found.select(F.explode(F.arrays_zip("ats", "own", "roles")).alias("e")).select(F.col("e.ats").alias("at"), F.col("e.own").alias("own"), F.col("e.roles").alias("new"))
    both = rows.join(each, "at").select("conv_id", "at", "role", "text", "new", F.posexplode(F.split("own", "")).alias("k", "edit")).where("edit <> ''")
    new = F.expr("substring(new, k + 1, 1)")
    role = F.when(new == "u", "user").when(new == "a", "assistant").otherwise(F.col("role"))
    return both.select("conv_id", "at", "k", "edit", role.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows conv_id, turn, role, text: edits as edited() gives them, and for each conversation conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit."""
    at = placed(rows)
    found = stored(rows.sparkSession, audits(at), "repair-audits")
    copies = lambda fault: F.sum(F.when(F.col("fault") == fault, F.when(F.lit(fault == "b"), F.col("copies")).otherwise(1)).otherwise(0))
    duplicate = F.sum(F.when(F.col("fault") == "b", 0).when(F.col("fault") == "d", F.col("copies")).otherwise(F.col("copies") - 1))
    turns = at.groupBy("conv_id", "turn").agg(copies("b").alias("blank"), duplicate.alias("duplicate"), copies("t").alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    faults = turns.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "edits"))), lambda x: x["edits"]), "")
    whole = found.groupBy(F.col("conv_id").alias("c")).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), joined.alias("audit"))
    return edited(at, found), faults.join(whole, F.expr("conv_id <=> c")).drop("c")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults of the query's contract."""
    kind = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    role, text = _spaced("role"), _spaced("text")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, "".join(STOPS), "")).otherwise(text)
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")


def repaired_conversations(all_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """For each conversation of all_rows the measures of repair(rows) and repaired_sha256; zeros where no row is left."""
    edits, measures = repair(rows)
    kept = edits.where("edit <> 'D'").select("conv_id", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"), "at", "k")
    kept = kept.repartition("conv_id").sortWithinPartitions("conv_id", "at", "k").select("conv_id", "line")
    digests = kept.mapInArrow(_digests, _schema(rows, "repaired_sha256 string"))
    names = all_rows.select(F.col("conv_id").alias("name")).distinct()
    found = names.join(measures, F.expr("name <=> conv_id"), "left").drop("conv_id").join(digests, F.expr("name <=> conv_id"), "left")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("name").alias("conv_id"), *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repaired_conversations(rows, damage(rows))


def brute_force(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and digest of one conversation's damaged rows (turn, role,
    text), by the least of all edits: every prefix's best audit for each sequence state, row by row."""
    rows = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(BLANKS)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in STOPS else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    best = {0: (0, "", ())}

    def better(into: dict, state: int, found: tuple) -> None:
        if state not in into or found < into[state]:
            into[state] = found

    def inserted(now: dict) -> dict:
        for _ in range(3):
            for s, (cost, audit, out) in list(now.items()):
                role = _target(s)
                better(now, NEXT[s][role], (cost + INSERT, audit + "I", (*out, ({"u": "user", "a": "assistant"}[role], ""))))
        return now

    for (_, role, text), fault in zip(rows, faults):
        after: dict = {}
        for s, (cost, audit, out) in inserted(dict(best)).items():
            better(after, s, (cost + DELETE, audit + "D", out))
            if fault not in ("b", "d"):
                more = TRUNCATED if fault else 0
                if role[:1] in NEXT[s]:
                    better(after, NEXT[s][role[:1]], (cost + more, audit + "K", (*out, (role, text))))
                new = _target(s)
                better(after, NEXT[s][new], (cost + REROLE + more, audit + "R", (*out, ({"u": "user", "a": "assistant"}[new], text))))
        best = after
    cost, audit, out = min(v for s, v in inserted(best).items() if s in ENDS)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest)


#: CRC-32 from its definition; then row by row the least (cost, audit) of each state.
SQL = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
key AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::BIGINT)), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1]))) % 20 AS kind FROM key, tab),
bad AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE kind <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM bad),
row AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))[-1:] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM num),
num_rows AS (SELECT conv_id, max(i) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM row GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (0, 2, 5, 'I', 'u'), (0, 3, 10, 'II', 'ua'), (1, 1, 0, '', ''), (1, 2, 5, 'I', 'u'), (1, 3, 10, 'II', 'ua'), (2, 2, 0, '', ''), (2, 3, 5, 'I', 'a'), (3, 3, 0, '', ''), (3, 2, 5, 'I', 'u')) v(s, to_s, cost, edits, roles)),
move AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(s, initial, to_s)),
target AS (SELECT * FROM (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)) v(s, role, to_s)),
step AS (SELECT conv_id, i, i0.s, i0.to_s AS mid, i0.cost AS c0, i0.edits, i0.roles, row.role, row.text, fault FROM row, ins i0),
edge AS (SELECT conv_id, i, s, mid AS to_s, c0 + 2 AS cost, edits || 'D' AS edits, roles, NULL AS role, NULL AS text FROM step
  UNION ALL SELECT conv_id, i, step.s, move.to_s, c0 + CASE fault WHEN 't' THEN 5 ELSE 0 END, edits || 'K', roles, role, text FROM step JOIN move ON move.s = mid AND initial = role[1] WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT conv_id, i, step.s, target.to_s, c0 + 1 + CASE fault WHEN 't' THEN 5 ELSE 0 END, edits || 'R', roles, target.role, text FROM step JOIN target ON target.s = mid WHERE fault NOT IN ('b', 'd')),
cheap AS (SELECT conv_id, i, s, to_s, arg_min(struct_pack(cost := cost, edits := edits, new := list_concat(list_transform(CASE WHEN roles = '' THEN [] ELSE string_split(roles, '') END, lambda r: CASE r WHEN 'u' THEN 'user:' ELSE 'assistant:' END), CASE WHEN role IS NULL THEN [] ELSE [role || ':' || text] END)), struct_pack(cost := cost, edits := edits)) AS e
  FROM edge GROUP BY conv_id, i, s, to_s),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0 AS cost, '' AS audit, []::VARCHAR[] AS new FROM num_rows
  UNION ALL SELECT conv_id, i, s, b.cost, b.audit, b.new FROM (SELECT dp.conv_id, cheap.i, cheap.to_s AS s, arg_min(struct_pack(cost := dp.cost + e.cost, audit := audit || e.edits, new := list_concat(dp.new, e.new)), struct_pack(cost := dp.cost + e.cost, audit := audit || e.edits)) AS b
    FROM dp JOIN cheap ON cheap.conv_id = dp.conv_id AND cheap.i = dp.i + 1 AND cheap.s = dp.s GROUP BY dp.conv_id, cheap.i, cheap.to_s)),
done AS (SELECT conv_id, arg_min(struct_pack(cost := dp.cost + ins.cost, audit := audit || edits, new := list_concat(new, list_transform(CASE WHEN roles = '' THEN [] ELSE string_split(roles, '') END, lambda r: CASE r WHEN 'u' THEN 'user:' ELSE 'assistant:' END))), struct_pack(cost := dp.cost + ins.cost, audit := audit || edits)) AS b
  FROM dp JOIN num_rows USING (conv_id) JOIN ins ON ins.s = dp.s WHERE dp.i = last AND ins.to_s IN (0, 3) GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
  coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.new, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN num_rows USING (conv_id) LEFT JOIN done USING (conv_id)
"""
