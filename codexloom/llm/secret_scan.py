"""Secrets by one combined deterministic automaton.

All rule regexes are compiled together: Thompson construction, subset construction
over byte classes, Moore minimisation, one flat transition array.  A text is read once,
byte by byte, for all rules.  Where the automaton tells the first end of a rule, a
backward automaton of that rule finds the leftmost start behind the rule's last match
and a forward one the longest end.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K
from .automata import Automaton


class Rule(NamedTuple):
    kind: str
    pattern: str
    any_case: bool = False
    #: Shortest match that counts; shorter ones are used up and dropped.
    shortest: int = 1
    #: Shortest assigned value, if the bound is on the value alone.
    value: int = 0


_VALUE = "A-Za-z0-9+/_.=-"
#: The base rules, in the order in which they are listed for one start.
BASE = (
    Rule("assign", rf"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[{_VALUE}]+", True, value=8),
    Rule("access", r"AKIA[A-Z0-9]+", shortest=16),
    Rule("hex", r"[0-9a-f]{32,}", shortest=32),
)
#: Further credentials of well-known form.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", shortest=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", shortest=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", shortest=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", shortest=30),
)
RULES = BASE + MORE

SECRETS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.all = Automaton([(r.pattern, r.any_case) for r in rules], search=True)
        self.ahead = [Automaton([(r.pattern, r.any_case)], search=False) for r in rules]
        self.back = [Automaton([(r.pattern, r.any_case)], search=False, backward=True) for r in rules]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted; leftmost and without overlap by rule.

        Of the matches that share their first end, the leftmost is taken."""
        events = []
        table, accepting, state = self.all.table, self.all.accepting, self.all.start
        at = 0
        for c in data.translate(self.all.classes):
            state = table[state + c]
            at += 1
            if state >= accepting:
                events.append((at, state))
        found, used = [], [0] * len(self.rules)
        for at, state in events:
            for k in self.all.outputs[state]:
                if at <= used[k]:
                    continue
                back = self.back[k].longest(data[used[k] : at].translate(self.back[k].classes)[::-1])
                if back < 0:  # it began inside the rule's last match
                    continue
                start = at - back
                used[k] = start + self.length(k, data, start)
                if self.counts(k, data, start, used[k]):
                    found.append((start, k, used[k]))
        return sorted(found)

    def length(self, k: int, data: bytes, start: int) -> int:
        size = 256
        while True:  # in growing parts, so that a short match in a long text costs little
            part = data[start : start + size]
            n = self.ahead[k].longest(part.translate(self.ahead[k].classes))
            if n < len(part) or start + size >= len(data):
                return n
            size *= 8

    def counts(self, k: int, data: bytes, start: int, end: int) -> bool:
        rule = self.rules[k]
        if end - start < rule.shortest:
            return False
        if not rule.value:
            return True
        # The value follows the first : or = and the blanks and quote behind it.
        at = next(i for i in range(start, end) if data[i] in b":=") + 1
        while data[at] == 0x20:
            at += 1
        at += data[at] in b"\"'"
        return end - at >= rule.value


def _scanner(text_col: str, scanner, n_kept: int):
    def scan(batches):
        rules = scanner.value
        names = [r.kind for r in rules.rules]
        for batch in batches:
            for piece in K.pieces(batch, text_col):
                raw, off = K.raw_bytes(piece.column(text_col))
                whole, bounds = raw.tobytes(), off.tolist()
                out = []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    data = whole[a:b]
                    out.append([{"kind": names[k], "start": s, "end": e} for s, k, e in _points(data, rules.scan(data))])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*piece.columns[:n_kept], pa.array(out, kind)], names=[*piece.schema.names[:n_kept], "secrets"])

    return scan


def _points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points."""
    if not found or data.isascii():
        return found
    out, at, points = [], 0, 0
    for s, k, e in found:  # by start; matches are ASCII
        points += len(data[at:s].decode())
        at = s
        out.append((points, k, points + e - s))
    return out


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``secrets``: kind, start and end (code points, end exclusive) of each match,
    by start and then in the order of the rules.

    Null and empty texts have none; letters of other scripts never match; repeated rows
    each get their result; an input column called secrets is replaced.
    """
    kept = docs.select(*(c for c in docs.columns if c != "secrets"))
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    schema = T.StructType([*kept.schema.fields, T.StructField("secrets", SECRETS)])
    return kept.mapInArrow(_scanner(text_col, scanner, len(kept.columns)), schema)


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with each secret in the text replaced by ``mark``;
    overlapping secrets are replaced together."""
    found = find_secrets(docs, text_col)
    begin = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))

    def cut(done: Column, span: Column) -> Column:
        between = F.substring(F.col(text_col), (done["at"] + 1).cast("int"), F.greatest(span["start"] - done["at"], F.lit(0)).cast("int"))
        added = F.when(span["start"] >= done["at"], F.concat(done["text"], between, F.lit(mark))).otherwise(done["text"])
        return F.struct(added.alias("text"), F.greatest(done["at"], span["end"]).alias("at"))

    done = F.aggregate("secrets", begin, cut)
    rest = F.substring(F.col(text_col), (done["at"] + 1).cast("int"), F.length(text_col))
    clean = F.when(F.size("secrets") > 0, F.concat(done["text"], rest)).otherwise(F.col(text_col))
    return found.select(*(clean.alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "secrets"))
