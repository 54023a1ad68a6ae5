"""A sheet of named expressions over one ordered series per symbol.

Each entry is SQL text over earlier entries. Asking twice for the same text
gives the same column. Entries are placed by what they read, as (round, depth,
step): all recurrences of a round are one grouped map (see
:mod:`barloom.functions.recur`), all windows of a depth are one ``selectExpr``
that Spark runs in one pass over one sort by symbol and day, and plain
expressions follow as steps that Spark folds into the next projection.

A series is bounded: bars are unique by (symbol, bar time), so a symbol never
has more rows than the calendar has bars. Raw ticks never get here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import recur

NAME = re.compile(r"\bx\d+\b")
BY_DAY = "PARTITION BY symbol ORDER BY day"


def rows(n: int) -> str:
    """Frame of the last ``n`` rows, this one included."""
    return f"OVER ({BY_DAY} ROWS BETWEEN {int(n) - 1} PRECEDING AND CURRENT ROW)"


def prior_rows(n: int) -> str:
    """Frame of the ``n`` rows before this one."""
    return f"OVER ({BY_DAY} ROWS BETWEEN {int(n)} PRECEDING AND 1 PRECEDING)"


def so_far() -> str:
    return f"OVER ({BY_DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def before() -> str:
    return f"OVER ({BY_DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def lag(x: str, k: int = 1) -> str:
    return x if k == 0 else f"lag({x}, {int(k)}) OVER ({BY_DAY})"


WINDOW = re.compile(r"OVER \(" + BY_DAY + r"(?: ROWS BETWEEN (\w+) PRECEDING AND [^)]*)?\)")
LAG = re.compile(r"lag\((\w+), (\d+)\) OVER \(" + BY_DAY + r"\)")
RUNNING_MEAN = re.compile(r"\((x\d+) - (x\d+)\) / (\d+)")


def clog(spark: SparkSession) -> None:
    """Register ``clog(x)``, the natural log of the C library; null where there is none.

    Spark's ``ln`` is Java's, which differs from it in the last bit for one value in fourteen. Where two estimates of
    the same values are compared, that bit decides.
    """

    def log(x):
        import math

        return math.log(x) if x is not None and x > 0 else None

    spark.udf.register("clog", F.udf(log, "double", useArrow=True))


@dataclass
class Entry:
    name: str
    level: tuple[int, int, int]
    text: str
    duck: str | None = None
    fold: tuple | None = None


@dataclass
class Sheet:
    entries: list[Entry] = field(default_factory=list)
    by_text: dict = field(default_factory=dict)
    level_of: dict = field(default_factory=dict)

    def __post_init__(self):
        self.t = self.put(f"CAST(row_number() OVER ({BY_DAY}) - 1 AS INT)")

    def _add(self, key, level: tuple[int, int, int], **kw) -> str:
        if key in self.by_text:
            return self.by_text[key]
        name = f"x{len(self.entries)}"
        self.entries.append(Entry(name=name, level=level, **kw))
        self.by_text[key] = name
        self.level_of[name] = level
        return name

    def put(self, text: str, duck: str | None = None) -> str:
        """Column of ``text``. ``duck`` is given where ANSI text differs from Spark's."""
        if NAME.fullmatch(text):
            return text
        reads = max((self.level_of[n] for n in NAME.findall(text)), default=(0, 0, 0))
        if " OVER (" in text:
            level = (reads[0], reads[1] + 1, 0)
        else:
            level = (reads[0], reads[1], reads[2] + 1)
        return self._add(text, level, text=text, duck=duck)

    def recur(self, kind: str, inputs: list[str], out: str = "v", **args) -> str:
        """Column ``out`` of the recurrence ``kind`` run over the input columns."""
        inputs = [x if x in ("o", "h", "l", "c") else self.put(x) for x in inputs]
        reads = max(self.level_of.get(x, (0, 0, 0)) for x in inputs)
        call = (kind, tuple(inputs), tuple(sorted(args.items())))
        return self._add((call, out), (reads[0] + 1, 0, 0), text=f"{kind}:{out}", fold=(call, out))

    def levels(self) -> list[list[Entry]]:
        groups: dict = {}
        for e in self.entries:
            groups.setdefault(e.level, []).append(e)
        return [groups[k] for k in sorted(groups)]

    def lookback(self, column: str) -> int | None:
        """Rows before a row that its value of ``column`` depends on, or None where it depends on the whole series.

        Frames and lags add up along what an entry reads. The row number only guards the warm-up, which the frames cover
        themselves. A running sum is open-ended, but the difference of it and of itself some rows ago is not. A
        recurrence remembers everything.
        """
        reach: dict[str, int | None] = {}
        totals: set[str] = set()
        lags: dict[str, tuple[str, int]] = {}
        for e in self.entries:
            if e.fold is not None:
                reach[e.name] = None
                continue
            if e.text.startswith("CAST(row_number()"):
                reach[e.name] = 0
                continue
            own = [int(k) for _, k in LAG.findall(e.text)]
            text = LAG.sub(r"\1", e.text)
            frames = WINDOW.findall(text)
            reads = [n for n in NAME.findall(text) if n != e.name]
            if m := LAG.fullmatch(e.text):
                lags[e.name] = (m[1], int(m[2]))
            if len(frames) == 1 and frames[0] == "UNBOUNDED" and e.text.startswith("sum(") and all(reach[n] is not None for n in reads):
                totals.add(e.name)
                reach[e.name] = max((reach[n] for n in reads), default=0)
                continue
            far = [int(f) if f.isdigit() else None for f in frames]
            mean = RUNNING_MEAN.search(text)
            if mean and mean[1] in totals and lags.get(mean[2], (None, 0))[0] == mean[1]:
                reach[e.name] = reach[mean[1]] + lags[mean[2]][1]
                continue
            open_ended = any(n in totals for n in reads) and e.name not in lags
            if None in far or open_ended or any(reach[n] is None for n in reads):
                reach[e.name] = None
            else:
                reach[e.name] = max((reach[n] for n in reads), default=0) + max([*far, *own, 0])
        return reach.get(column, 0)

    def run(self, bars: DataFrame) -> DataFrame:
        """``bars`` with every entry as a column."""
        df = bars
        if any("clog(" in e.text for e in self.entries):
            clog(bars.sparkSession)
        for entries in self.levels():
            if entries[0].fold is None:
                df = df.selectExpr("*", *[f"{e.text} AS {e.name}" for e in entries])
            else:
                df = recur.attach(df, [(e.name, *e.fold) for e in entries])
        return df
