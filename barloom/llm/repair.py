"""Cheapest edits that turn a conversation into ``(s?(ua)+)?``, by a Viterbi pass that emits once its survivors agree.

Rows are (conv_id, turn, role, text), taken by turn with nulls first; ties go by role, then by the SHA-256 of the text.
States are what was said last: nothing, system, user or assistant. Each state keeps one survivor, the cheapest path and
among equals the ASCII-least string of edits. Survivors are leaves of a tree of back pointers that counts references:
paths that lost are freed at once, and as soon as all survivors share an ancestor the edits up to it are emitted.
A survivor that costs more than another one plus the price of following any of its continuations from there is dropped,
so the path that deletes everything does not hold the root for ever. Ties compare the whole unresolved suffixes.

A conversation is cut into blocks of ``BLOCK`` turns that are solved on their own, from each state they may be entered
in; a second pass of the same kind chooses the states between blocks from at most sixteen costs a block. So one endless
conversation spreads over tasks, and no task holds more than a block of back pointers. Only the digest's SHA-256, which
has to read a conversation's repaired text in order, streams a whole conversation through one task, a batch at a time.

Faults: ``blank`` (no character but white space), ``duplicate`` (role and text seen earlier), ``truncated`` (the last
character that is not white space is none of ``.!?``); the first that holds counts. Null roles and texts are one space,
so such a text is blank and such a role fits nowhere. A null conv_id is a conversation of its own, null turns come
first. Repeated rows are duplicates of the first. An empty text is blank; very long texts are seen only by built-in
functions and as bytes. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import written

BLOCK = 1024
SPACE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: State after a role's initial is said in a state; pairs that are missing are illegal.
SAID = {
    (NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT,
}
#: The role that an insertion or a new role must have in a state.
NEEDED = ("user", "user", "assistant", "user")
#: What it can cost at most to follow, from the first state, a continuation of the second one.
FOLLOW = {
    (NOTHING, SYSTEM): 0, (NOTHING, USER): 3, (NOTHING, ASSISTANT): 0,
    (SYSTEM, NOTHING): 6, (SYSTEM, USER): 3, (SYSTEM, ASSISTANT): 6,
    (USER, NOTHING): 7, (USER, SYSTEM): 3, (USER, ASSISTANT): 3,
    (ASSISTANT, NOTHING): 4, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 3,
}
#: Insertions that end a conversation in a state, and their cost.
TAIL = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def moves(initial: str, gone: bool, cut: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of one row. Insertions stand before a kept row; before a deleted one they are never least."""
    out = [(q, q, DELETE, "D") for q in range(4)]
    if gone:
        return out
    extra = TRUNCATED if cut else 0
    for q in range(4):
        for inserted in (0, 1):
            at = SAID[q, NEEDED[q][0]] if inserted else q
            lead, cost = "I" * inserted, INSERT * inserted + extra
            if (at, initial) in SAID:
                out.append((q, SAID[at, initial], cost, lead + "K"))
            out.append((q, SAID[at, NEEDED[at][0]], cost + RE_ROLE, lead + "R"))
    return out


def followed(costs: dict[int, int]) -> list[int]:
    """States that no other survivor beats on all continuations."""
    return [p for p in costs if not any(q != p and costs[q] + FOLLOW[q, p] < costs[p] for q in costs)]


class Tree:
    """Back pointers with reference counts; ``emitted`` grows when all leaves share an ancestor below the root."""

    def __init__(self, starts):
        self.root = [None, None, 0, []]  # parent, label, references, children
        self.leaves = {s: self.root for s in starts}
        self.root[2] = len(self.leaves)
        self.emitted = []

    def grow(self, chosen: dict[int, tuple[int, object]]) -> None:
        """Replace the leaves by children: state -> (state of the parent, label)."""
        old, new = self.leaves, {}
        for state, (parent, label) in chosen.items():
            up = old[parent]
            new[state] = node = [up, label, 1, []]
            up[2] += 1
            up[3].append(node)
        self.leaves = new
        for node in old.values():
            self.release(node)
        while self.root[2] == 1 and len(self.root[3]) == 1:
            self.root = self.root[3][0]
            self.root[0] = None
            self.emitted.append(self.root[1])

    def release(self, node) -> None:
        node[2] -= 1
        while node[2] == 0 and node[0] is not None:
            up = node[0]
            up[3][:] = [x for x in up[3] if x is not node]
            up[2] -= 1
            node = up

    def suffixes(self, a, b) -> tuple[list, list]:
        """Labels of two equally deep nodes since their last common ancestor."""
        left, right = [], []
        while a is not b:
            left.append(a[1])
            right.append(b[1])
            a, b = a[0], b[0]
        return left[::-1], right[::-1]

    def path(self, state: int) -> list:
        """All labels from the start to a leaf, those emitted first."""
        node, out = self.leaves[state], []
        while node is not self.root:
            out.append(node[1])
            node = node[0]
        return self.emitted + out[::-1]


class Viterbi:
    """Survivors over the rows of one block, from one state."""

    def __init__(self, start: int):
        self.tree, self.costs = Tree([start]), {start: 0}

    def before(self, a, b) -> bool:
        """Whether path ``a`` (state, edits) of the same rows is ASCII-less than ``b``; whole unresolved suffixes count."""
        left, right = self.tree.suffixes(self.tree.leaves[a[0]], self.tree.leaves[b[0]])
        return "".join([*left, a[1]]) < "".join([*right, b[1]])

    def step(self, row_moves) -> None:
        costs, chosen = {}, {}
        for state, to, cost, edits in row_moves:
            if state not in self.costs:
                continue
            cost += self.costs[state]
            if to not in costs or cost < costs[to] or (cost == costs[to] and self.before((state, edits), chosen[to])):
                costs[to], chosen[to] = cost, (state, edits)
        alive = followed(costs)
        self.costs = {s: costs[s] for s in alive}
        self.tree.grow({s: chosen[s] for s in alive})

    def exits(self) -> list[tuple[int, int, int, str]]:
        """(state, cost, rank among the exits, edits)."""
        paths = {s: "".join(self.tree.path(s)) for s in self.costs}
        rank = {s: i for i, s in enumerate(sorted(paths, key=paths.get))}
        return [(s, self.costs[s], rank[s], paths[s]) for s in paths]


class Blocks:
    """Survivors over the blocks of one conversation; ranks stand for the order of their whole strings."""

    def __init__(self):
        self.tree, self.costs, self.rank = Tree([NOTHING]), {NOTHING: 0}, {NOTHING: 0}

    def step(self, block, cells) -> None:
        """``cells``: (entry, exit, cost, rank among the exits of that entry)."""
        best = {}
        for entry, leave, cost, order in cells:
            if entry in self.costs:
                found = (self.costs[entry] + cost, self.rank[entry], order, entry)
                if leave not in best or found < best[leave]:
                    best[leave] = found
        alive = followed({s: x[0] for s, x in best.items()})
        self.costs = {s: best[s][0] for s in alive}
        self.rank = {s: i for i, s in enumerate(sorted(alive, key=lambda s: best[s][1:3]))}
        self.tree.grow({s: (best[s][3], (block, best[s][3], s)) for s in alive})

    def resolved(self) -> list:
        out, self.tree.emitted = self.tree.emitted, []
        return out

    def end(self) -> tuple[list, str, int]:
        """Last blocks with their states, closing insertions and the whole cost."""
        total = {s: c + INSERT * len(TAIL[s]) for s, c in self.costs.items()}
        state = min(total, key=lambda s: (total[s], self.rank[s]))
        return self.tree.path(state), TAIL[state], total[state]


def prepared(rows: DataFrame) -> DataFrame:
    """Rows with nulls as one space, their block, text hash and own faults; ``text`` stays for those who read it."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    base = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    block = F.coalesce(F.floor(F.col("turn") / F.lit(BLOCK)).cast("long"), F.lit(-(1 << 63)).cast("long"))
    return base.select("conv_id", block.alias("block"), "turn", "role", "text", F.sha2("text", 256).alias("h"))


ORDER = ["turn", "role", "h"]
CELLS = "array<struct<entry:int,leave:int,cost:long,rank:int,edits:string>>"
STATS = "blank long, duplicate long, truncated long, illegal long, low long, high long, turns long"


def _blocks(batches):
    import pyarrow as pa

    from barloom.llm import repair as R
    from barloom.llm.common import groups_of

    table = {}
    for (conv, block, first), rows in groups_of(batches, ["conv_id", "block", "first"]):
        col = {n: rows.column(n).to_pylist() for n in ("turn", "initial", "blank", "again", "cut")}
        tries = [R.Viterbi(s) for s in ((R.NOTHING,) if first else range(4))]
        faults, illegal, turns, last = [0, 0, 0], 0, set(), None
        for turn, initial, blank, again, cut in zip(*col.values()):
            key = (initial, blank or again, cut)
            if key not in table:
                table[key] = R.moves(*key)
            for t in tries:
                t.step(table[key])
            fault = 0 if blank else 1 if again else 2 if cut else None
            if fault is not None:
                faults[fault] += 1
            if last is not None and (last, initial) not in (("s", "u"), ("u", "a"), ("a", "u")):
                illegal += 1
            last = initial
            if turn is not None:
                turns.add(turn)
        cells = [dict(entry=e, leave=s, cost=c, rank=k, edits=x) for e, t in enumerate(tries) for s, c, k, x in t.exits()]
        yield pa.RecordBatch.from_pylist([dict(
            conv_id=conv, block=block, cells=cells, head=col["initial"][0], last=last, blank=faults[0], duplicate=faults[1],
            truncated=faults[2], illegal=illegal, low=min(turns, default=None), high=max(turns, default=None), turns=len(turns),
        )], schema=pa.schema([
            ("conv_id", pa.int64()), ("block", pa.int64()),
            ("cells", pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("edits", pa.string())]))),
            ("head", pa.string()), ("last", pa.string()),
            *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns")],
        ]))


def solved_blocks(rows: DataFrame) -> DataFrame:
    """One row a block: cheapest edits from each entry to each exit, fault counts and edge initials. No text is shuffled."""
    bare = F.rtrim("text", F.lit(SPACE))
    narrow = rows.select(
        "conv_id", "block", "turn", "role", "h", F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    same = Window.partitionBy("conv_id", "role", "h").orderBy(F.col("turn").asc_nulls_first())
    flagged = narrow.withColumn("again", F.row_number().over(same) > 1)
    firsts = rows.groupBy(F.col("conv_id").alias("c")).agg(F.min("block").alias("b"))
    ready = flagged.join(firsts, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("first", F.col("block") == F.col("b"))
    ordered = ready.select("conv_id", "block", "first", "turn", "role", "h", "again", "initial", "blank", "cut").repartition("conv_id", "block")
    ordered = ordered.sortWithinPartitions("conv_id", "block", *ORDER, "again")
    return ordered.mapInArrow(_blocks, f"conv_id long, block long, cells {CELLS}, head string, last string, {STATS}")


def _chosen(batches):
    import pyarrow as pa

    from barloom.llm import repair as R

    schema = pa.schema([
        ("conv_id", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("tail", pa.string()), ("cost", pa.int64()),
        *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal")],
    ])

    def row(conv, step, **more):
        return dict.fromkeys(schema.names) | dict(conv_id=conv, block=step[0], entry=step[1], leave=step[2], tail="") | more

    def closed(conv, run, sums):
        steps, tail, cost = run.end()
        gaps = 0 if sums["low"] is None else sums["high"] - sums["low"] + 1 - sums["turns"]
        counts = {n: sums[n] for n in ("blank", "duplicate", "truncated", "illegal")}
        return [*(row(conv, s) for s in steps[:-1]), row(conv, steps[-1], tail=tail, cost=cost, gaps=gaps, **counts)]

    run, conv, sums, held = None, None, None, None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if run is None or r["conv_id"] != conv:
                if run is not None:
                    out += closed(conv, run, sums)
                run, conv, sums, held = R.Blocks(), r["conv_id"], None, []
            run.step(r["block"], [(c["entry"], c["leave"], c["cost"], c["rank"]) for c in r["cells"]])
            # the newest block of the conversation waits, as it carries the totals if it is the last
            held += run.resolved()
            out += [row(conv, s) for s in held[:-1]]
            held = held[-1:]
            run.tree.emitted, held = (held, []) if held else ([], [])
            if sums is None:
                sums = {n: r[n] for n in ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns")}
            else:
                for n in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    sums[n] += r[n]
                sums["illegal"] += (last, r["head"]) not in (("s", "u"), ("u", "a"), ("a", "u"))
                sums["low"] = r["low"] if sums["low"] is None else sums["low"]
                sums["high"] = sums["high"] if r["high"] is None else r["high"]
            last = r["last"]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if run is not None:
        yield pa.RecordBatch.from_pylist(closed(conv, run, sums), schema=schema)


COUNTS = ["cost", "gaps", "blank", "duplicate", "truncated", "illegal"]


def edits(rows: DataFrame) -> DataFrame:
    """(conv_id, block, entry, edits) for ``prepared`` rows; a conversation's last block has its cost and counts as well.

    ``edits`` has one letter a row, K, R or D, each behind the insertions before it; the last block ends with those that
    close the conversation. ``entry`` is the state before the block.
    """
    blocks = written(solved_blocks(rows))
    slim = F.transform("cells", lambda c: F.struct(*[c[n].alias(n) for n in ("entry", "leave", "cost", "rank")]))
    scan = blocks.withColumn("cells", slim).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    schema = "conv_id long, block long, entry int, leave int, tail string, " + ", ".join(f"{n} long" for n in COUNTS)
    picked = scan.mapInArrow(_chosen, schema)
    left = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("cells").alias("_cells"))
    both = picked.join(left, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    cell = F.filter("_cells", lambda c: (c.entry == F.col("entry")) & (c.leave == F.col("leave")))[0]
    return both.select("conv_id", "block", "entry", F.concat(cell.edits, "tail").alias("edits"), *COUNTS)


def _stream(rows: DataFrame, made: DataFrame, *keys: str) -> DataFrame:
    """Edits and rows in one sorted stream: a block's edits come right before its rows."""
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    heads = made.select(
        "conv_id", "block", F.lit(0).alias("kind"), none("long", "turn"), none("string", "role"), none("string", "h"),
        F.col("edits").cast("binary").alias("body"), "entry", *COUNTS,
    )
    tails = rows.select(
        "conv_id", "block", F.lit(1).alias("kind"), "turn", "role", "h", F.col("text").cast("binary").alias("body"),
        none("int", "entry"), *[none("long", n) for n in COUNTS],
    )
    return heads.unionByName(tails).repartition(*keys).sortWithinPartitions("conv_id", "block", "kind", *ORDER)


def steps(batches):
    """Walk the stream: (head, None) for a block's edits, then (row, (role, text, edit)) for each row and insertion."""
    from barloom.llm import repair as R

    names = ["conv_id", "block", "kind", "turn", "role", "body", "entry", *R.COUNTS]
    letters, at, end, state = "", 0, 0, 0

    def insertions(upto):
        nonlocal at, state
        while at < upto and letters[at] == "I":
            role, at = R.NEEDED[state], at + 1
            state = R.SAID[state, role[0]]
            yield role, b"", "I"

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            turn, role, body = row[3:6]
            if row[2] == 0:
                letters, at, state = body.decode(), 0, row[6]
                end = len(letters.rstrip("I"))
                yield row, None
                continue
            for made in insertions(end):
                yield (*row[:3], None), made
            edit, at = letters[at], at + 1
            if edit != "D":
                role = role if edit == "K" else R.NEEDED[state]
                state = R.SAID[state, role[0]]
            yield row, (role, body, edit)
            if at == end:
                for made in insertions(len(letters)):
                    yield (*row[:3], None), made


def _repaired(batches):
    import pyarrow as pa

    from barloom.llm import repair as R

    names = ["conv_id", "turn", "role", "text", "edit", "block", "place"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
    held, size, place, schema = [], 0, 0, pa.schema(list(zip(names, types)))

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], schema=schema)

    for row, made in R.steps(batches):
        if made is None:
            place = 0
            continue
        role, text, edit = made
        held.append((row[0], row[3], role, text, edit, row[1], place))
        place, size = place + 1, size + len(text)
        if size > 1 << 24 or len(held) >= 4096:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def repaired(conversations: DataFrame) -> DataFrame:
    """Every row with its edit (K, R, I or D) and new role; order by block, then place. Deleted rows are listed with D."""
    rows = prepared(conversations)
    out = _stream(rows, edits(rows), "conv_id", "block").mapInArrow(
        _repaired, "conv_id long, turn long, role string, text binary, edit string, block long, place long")
    return out.withColumn("text", F.col("text").cast("string"))


def _digest(batches):
    import hashlib

    import pyarrow as pa

    from barloom.llm import repair as R

    conv, audit, sha, started, last, out = None, [], None, False, None, []
    schema = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in R.COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def closed():
        return dict(zip(R.COUNTS, last[7:])) | dict(conv_id=conv, audit="".join(audit), repaired_sha256=sha.hexdigest())

    for row, made in R.steps(batches):
        if made is None:
            if last is None or row[0] != conv:
                if last is not None:
                    out.append(closed())
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                conv, audit, sha, started = row[0], [], hashlib.sha256(), False
            audit.append(row[5].decode())
            last = row
        elif made[2] != "D":
            if started:
                sha.update(b"\n")
            sha.update(made[0].encode("utf-8", "surrogatepass") + b":")
            sha.update(made[1])
            started = True
    if last is not None:
        out.append(closed())
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def digest(conversations: DataFrame) -> DataFrame:
    """One row a conversation: cost and counts, the audit string, and the SHA-256 of the repaired ``role:text`` lines."""
    rows = prepared(conversations)
    schema = "conv_id long, " + ", ".join(f"{n} long" for n in COUNTS) + ", audit string, repaired_sha256 string"
    return _stream(rows, edits(rows), "conv_id").mapInArrow(_digest, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows hurt by their key's CRC-32: dropped, emptied, without end marks, repeated, or given to the user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("col")


def report(conversations: DataFrame) -> DataFrame:
    """The digest after damage, with a row for every conversation there was before it."""
    nothing = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    made = digest(damaged(conversations)).withColumnRenamed("conv_id", "c")
    every = conversations.select("conv_id").distinct()
    both = every.join(made, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in COUNTS]
    return both.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
