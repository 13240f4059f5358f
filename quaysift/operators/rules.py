"""Rules by the thousand, and rules over content that comes in chunks.

Many rules: each has bytes that any match must hold (a literal itself, or the longest plain run of a regular expression). The gram of
these bytes that the fewest texts have is the rule's key. A text is read once for all rules: its grams are looked up among the keys, and only rules
whose key it has are tried on it, by the engine. Rules without such bytes, such as bare classes, are conditions of their own.

Chunks: a rule is an automaton over bytes. What a chunk does to every state is worked out for each chunk by itself, in parallel,
and a file's chunks are put together in order by looking states up: exact for matches of any length, wherever chunks are cut.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from re import _parser as syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import valid_rules
from .matching import Rule, match_rules

#: Bytes of a gram at most, grams of a rule among which the key is chosen, and rules that an index holds.
GRAM, CHOICE, MOST_RULES = 4, 16, 1_000_000
_SLOTS = 1 << 20


def required(rule: Rule) -> bytes:
    """Bytes that every match of a rule holds: the longest run of characters that no alternative or option can leave out. Empty where none is plain to see.

    Expressions with flags, with classes inside classes, or that the standard library reads otherwise than the engine may, have none.
    """
    _, _, kind, pattern = rule
    if kind != "regex":
        return bytes.fromhex(pattern) if kind == "hex" else pattern.encode()
    if re.search(r"\[[^\]]*\[|\\[0QEGZbB]|\(\?[^:]", pattern):
        return b""
    try:
        parts = syntax.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return b""
    runs = [""]

    def walk(parts) -> None:
        for op, value in parts:
            name = str(op)
            if name == "LITERAL":
                runs[-1] += chr(value)
            elif name == "SUBPATTERN":
                walk(value[3])
            else:
                if name in ("MAX_REPEAT", "MIN_REPEAT") and value[0]:
                    walk(value[2])
                runs.append("")

    walk(parts)
    return max((x.encode("utf-8", "ignore") for x in runs), key=len)


def _codes(data: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the grams of ``n`` bytes at each place."""
    out = np.full(max(len(data) - n + 1, 0), n, np.int64)
    for i in range(n):
        out = out << 8 | data[i : i + len(out)]
    return out


class Index:
    """Grams, sorted, and the rules that each is a key of."""

    def __init__(self, grams: np.ndarray, rules: list[list[int]]) -> None:
        self.grams, self.rules = grams, rules
        self.sizes = sorted({int(g).bit_length() // 8 for g in grams})  # a gram's number begins with its size
        self.may = np.zeros(_SLOTS, bool)
        self.may[self._slot(grams)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * 0x9E3779B1 >> 13) & (_SLOTS - 1)

    def found(self, text: bytes) -> np.ndarray:
        """Places, in ``grams``, of those that a text has."""
        data, out = np.frombuffer(text, np.uint8), []
        for n in self.sizes:
            codes = _codes(data, n)
            codes = np.unique(codes[self.may[self._slot(codes)]])
            at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
            out.append(at[self.grams[at] == codes])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _grams_of(needed: bytes) -> list[int]:
    n = min(GRAM, len(needed))
    every = _codes(np.frombuffer(needed, np.uint8), n).tolist()
    return every[:: max(1, -(-len(every) // CHOICE))]


def _counted(files: DataFrame, content: str, index: Index) -> dict[int, int]:
    """Texts that have each gram."""
    held = files.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value.grams), np.int64)
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    total[held.value.found(t.as_py())] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = files.select(F.col(content).cast("binary")).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    held.destroy()
    return {r["at"]: r["n"] for r in rows}


def match_many(files: DataFrame, rules: list[Rule] | DataFrame, key: str = "file_id", content: str = "content", most: int = MOST_RULES) -> DataFrame:
    """``key, ordinal, rule_id`` as ``match_rules`` gives them, for rules by the thousand: a list, or a table ``ordinal, rule_id, kind, pattern``.

    Rules are an operator's configuration: more than ``most`` are an error, and up to that the index (a few dozen bytes a rule) is broadcast.
    Texts are read twice, to choose keys by how few texts have them and to look them up; nothing is shuffled but counts of grams. A
    rule is tried on the texts that have its key alone.
    """
    if isinstance(rules, DataFrame):
        got = rules.select(F.col("ordinal").cast("int").alias("ordinal"), "rule_id", "kind", "pattern").limit(most + 1).collect()
        rules = [tuple(r) for r in got]
    if len(rules) > most:
        raise ValueError(f"more than {most} rules")
    rules = valid_rules(rules)[0]
    needed = {i: required(r) for i, r in enumerate(rules)}
    bare = match_rules(files, [rules[i] for i, x in needed.items() if not x], key, content)
    needed = {i: x for i, x in needed.items() if x}
    if not needed:
        return bare
    spark = files.sparkSession
    choice = {i: _grams_of(x) for i, x in needed.items()}
    every = np.unique(np.concatenate([np.array(x) for x in choice.values()]))
    times = _counted(files, content, Index(every, []))
    place = {int(g): at for at, g in enumerate(every)}
    keyed: dict[int, list[int]] = defaultdict(list)
    for i, grams in choice.items():
        keyed[min(grams, key=lambda g: (times.get(place[g], 0), g))].append(i)
    grams = sorted(keyed)
    held = spark.sparkContext.broadcast(Index(np.array(grams), [keyed[g] for g in grams]))
    text_type, key_type = (files.schema[c].dataType.simpleString() for c in (content, key))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for b in batches:
            tried = [[i for at in index.found(t.as_py()).tolist() for i in index.rules[at]] if t.is_valid else [] for t in b.column(1).cast(pa.large_binary())]
            some = pa.array([k for k, x in enumerate(tried) if x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some), pa.array([x for x in tried if x], pa.list_(pa.int32()))], ["_key", "_text", "_tried"])

    table = spark.createDataFrame([(i, *rules[i]) for i in needed], "_rule int, ordinal int, rule_id string, kind string, pattern string")
    hits = files.select(key, content).mapInArrow(look, f"_key {key_type}, _text {text_type}, _tried array<int>").select("_key", "_text", F.explode("_tried").alias("_rule"))
    c, p = F.col("_text").cast("string"), F.col("pattern")
    occurs = F.when(F.col("kind") == "literal", c.contains(p)).when(F.col("kind") == "regex", F.call_function("rlike", c, p)).otherwise(c.contains(F.unhex(p).cast("string")))
    return hits.join(F.broadcast(table), "_rule").filter(occurs).select(F.col("_key").alias(key), "ordinal", "rule_id").unionByName(bare)


# Automata. An expression is read by the standard library; here it becomes states over bytes.

_ANY = [[(0xC2, 0xDF)], [(0xE0, 0xEF), (0x80, 0xBF)], [(0xF0, 0xF4), (0x80, 0xBF), (0x80, 0xBF)]]
_CLASSES = {"CATEGORY_DIGIT": "0123456789", "CATEGORY_SPACE": " \t\n\x0b\f\r", "CATEGORY_WORD": "0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: States that an automaton may have.
MOST_STATES = 2_000


class _States:
    """States that wait for bytes in a range, or pass on at once."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[int, int, int]]] = []
        self.free: list[list[int]] = []

    def new(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def span(self, a: int, low: int, high: int) -> int:
        b = self.new()
        self.moves[a].append((low, high, b))
        return b

    def chars(self, a: int, wanted: set[int], but: bool) -> int:
        """One character of a set, or one outside of it."""
        out = self.new()
        for c in range(128):
            if (c in wanted) != but:
                self.moves[a].append((c, c, out))
        wide = sorted(c for c in wanted if c > 127)
        if but and wide:
            raise ValueError("a class that leaves out characters beyond ASCII")
        for c in wide:
            at = a
            for byte in chr(c).encode():
                at = self.span(at, byte, byte)
            self.free[at].append(out)
        if but:
            for rest in _ANY:
                at = a
                for low, high in [*rest, (0x80, 0xBF)]:
                    at = self.span(at, low, high)
                self.free[at].append(out)
        return out

    def add(self, a: int, parts) -> int:
        """The state behind ``parts``, which begin at ``a``."""
        for op, value in parts:
            name = str(op)
            if name == "LITERAL":
                a = self.chars(a, {value}, False)
            elif name == "NOT_LITERAL":
                a = self.chars(a, {value}, True)
            elif name == "ANY":
                a = self.chars(a, {10}, True)
            elif name == "IN":
                a = self.chars(a, *_members(value))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = value
                for _ in range(low):
                    a = self.add(a, inner)
                out = self.new()
                if high == syntax.MAXREPEAT:
                    loop = self.new()
                    self.free[a].append(loop)
                    self.free[self.add(loop, inner)].append(loop)
                    self.free[loop].append(out)
                else:
                    self.free[a].append(out)
                    for _ in range(high - low):
                        a = self.add(a, inner)
                        self.free[a].append(out)
                a = out
            elif name == "SUBPATTERN" and not (value[1] or value[2]):
                a = self.add(a, value[3])
            elif name == "BRANCH":
                out = self.new()
                for way in value[1]:
                    start = self.new()
                    self.free[a].append(start)
                    self.free[self.add(start, way)].append(out)
                a = out
            else:
                raise ValueError(f"{name} isn't matched across chunks")
            if len(self.moves) > 50 * MOST_STATES:
                raise ValueError("too many states")
        return a


def _members(items) -> tuple[set[int], bool]:
    wanted, but = set(), False
    for op, value in items:
        name = str(op)
        if name == "NEGATE":
            but = True
        elif name == "LITERAL":
            wanted.add(value)
        elif name == "RANGE":
            wanted.update(range(value[0], value[1] + 1))
        elif name == "CATEGORY" and str(value) in _CLASSES:
            wanted.update(map(ord, _CLASSES[str(value)]))
        else:
            raise ValueError(f"{value} isn't matched across chunks")
    return wanted, but


def automaton(rule: Rule) -> np.ndarray:
    """Next state by state and byte; 0 is the start, and the last state, which isn't left, says that the rule has occurred.

    Literals, hex and regular expressions of characters, classes, groups, alternatives and repeats, on UTF-8. Anchors, look-around, back references, flags
    and others aren't: a ValueError. The engine's own ``\\\\d``, ``\\\\s`` and ``\\\\w`` are of ASCII, and so are these.
    """
    _, _, kind, pattern = rule
    s = _States()
    start = s.new()
    if kind == "regex":
        parsed = syntax.parse(pattern)
        if parsed.state.flags & ~re.UNICODE:
            raise ValueError("flags aren't matched across chunks")
        end = s.add(start, parsed)
    else:
        end = start
        for byte in bytes.fromhex(pattern) if kind == "hex" else pattern.encode():
            end = s.span(end, byte, byte)

    def closed(states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for x in s.free[todo.pop()]:
                if x not in states:
                    states.add(x)
                    todo.append(x)
        return frozenset(states)

    first = closed({start})
    number, order, rows = {first: 0}, [first], []
    for now in order:  # grows
        if end in now:
            rows.append(None)
            continue
        row = np.zeros(256, np.int64)
        to: dict[int, set[int]] = defaultdict(set)
        for x in now:
            for low, high, y in s.moves[x]:
                for byte in range(low, high + 1):
                    to[byte].add(y)
        known: dict[frozenset[int], int] = {}
        for byte, ys in to.items():
            plain = frozenset(ys)
            if plain not in known:
                then = closed(set(ys) | {start})
                if then not in number:
                    number[then] = len(order)
                    order.append(then)
                    if len(order) > MOST_STATES:
                        raise ValueError("too many states")
                known[plain] = number[then]
            row[byte] = known[plain]
        rows.append(row)
    last = sum(r is not None for r in rows)
    names, n = np.full(len(rows), last), 0
    for i, r in enumerate(rows):
        if r is not None:
            names[i], n = n, n + 1
    table = [names[r] for r in rows if r is not None] + [np.full(256, last)]
    if rows[0] is None:  # matches nothing at all
        table = [np.ones(256, np.int64), np.ones(256, np.int64)]
    return np.array(table, np.uint16)


def effect(table: np.ndarray, data: bytes) -> np.ndarray:
    """The state that each state is in after ``data``: each byte's effect on all states, put together two by two."""
    now = np.arange(len(table), dtype=np.uint16)
    piece = max(1, (1 << 22) // len(table))
    for a in range(0, len(data), piece):
        steps = table.T[np.frombuffer(data[a : a + piece], np.uint8)]
        while len(steps) > 1:
            even = len(steps) & ~1
            made = np.take_along_axis(steps[1:even:2], steps[0:even:2].astype(np.int64), axis=1)
            steps = np.concatenate([made, steps[even:]])
        now = steps[0][now]
    return now


#: Bytes that are walked at once by a lane, lanes walked side by side, and bytes and states of these together.
PIECE, LANES, HELD = 2048, 4096, 1 << 22


class Automata:
    """Several automata side by side, their states numbered through all of them."""

    def __init__(self, tables: list[np.ndarray]) -> None:
        sizes = [len(t) for t in tables]
        self.first = np.cumsum([0, *sizes[:-1]])
        self.last = self.first + sizes - 1
        self.total, self.of = sum(sizes), np.repeat(np.arange(len(tables)), sizes)
        self.next = np.concatenate([t.astype(np.int32) + np.int32(f) for t, f in zip(tables, self.first, strict=True)]).ravel()
        self.inner = np.setdiff1d(np.arange(self.total), [*self.first, *self.last])

    def effects(self, chunks: list[bytes]) -> np.ndarray:
        """A row for each chunk: the state that each state is in after it.

        Chunks are walked side by side, a byte of each at a time, and long ones in pieces that are put together after. Only starts are walked to the end: another
        state soon meets the walk from its automaton's start, or the last state, and from there on it is the same.
        """
        data = np.frombuffer(b"".join(chunks), np.uint8)
        ends = np.cumsum([len(c) for c in chunks])
        cuts = [(i, a, min(PIECE, end - a)) for i, (end, c) in enumerate(zip(ends.tolist(), chunks, strict=True)) for a in range(end - len(c), end, PIECE)]
        owner, start, length = (np.array(x, np.int64) for x in zip(*cuts, strict=True)) if cuts else (np.zeros(0, np.int64),) * 3
        made = np.empty((len(cuts), self.total), np.int32)
        order = np.argsort(-length, kind="stable")
        a = 0
        while a < len(order):
            n = max(1, min(LANES, HELD // int(length[order[a]]), HELD // 4 // self.total))
            some = order[a : a + n]
            made[some] = self._walked(data, start[some], length[some])
            a += n
        out = np.tile(np.arange(self.total, dtype=np.int32), (len(chunks), 1))
        begins = np.searchsorted(owner, np.arange(len(chunks)))
        alone = np.bincount(owner, minlength=len(chunks)) == 1
        out[alone] = made[begins[alone]]
        for k in np.flatnonzero(~alone[owner]) if len(owner) else ():
            out[owner[k]] = made[k][out[owner[k]]]
        return out

    def _walked(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Effects of pieces, the longest first."""
        n, most = len(start), int(length[0])
        at = np.minimum(start[:, None] + np.arange(most), len(data) - 1)
        columns = np.ascontiguousarray(data[at].T)
        del at
        open_ = n - np.searchsorted(length[::-1], np.arange(most), "right")  # pieces that go on at each place
        out = np.tile(np.arange(self.total, dtype=np.int32), (n, 1))
        main = np.repeat(self.first.astype(np.int32)[:, None], n, axis=1)
        piece, source = np.repeat(np.arange(n), len(self.inner)), np.tile(self.inner, n)
        rule, state = self.of[source], source.astype(np.int32)
        for p in range(most):
            k = open_[p]
            column = columns[p, :k].astype(np.int32)
            main[:, :k] = self.next[(main[:, :k] << 8) | column]
            if not len(piece):
                continue
            if (j := np.searchsorted(piece, k)) < len(piece):  # pieces that have ended
                out[piece[j:], source[j:]] = state[j:]
                piece, source, rule, state = piece[:j], source[:j], rule[:j], state[:j]
            state = self.next[(state << 8) | column[piece]]
            if p < 8 or p % 8 == 7:
                same = state == main[rule, piece]
                done = state == self.last[rule]
                out[piece[done], source[done]] = state[done]
                same &= ~done
                out[piece[same], source[same]] = -1
                left = ~(same | done)
                piece, source, rule, state = piece[left], source[left], rule[left], state[left]
        out[piece, source] = state
        out[:, self.first] = main.T
        return np.where(out < 0, main[self.of].T, out)


def scan_chunks(chunks: DataFrame, rules: list[Rule], key: str = "file_id", chunk: str = "chunk") -> DataFrame:
    """``key, ordinal, rule_id`` of all rules that occur in files that come in rows ``key, chunk_idx, chunk``, across any edges.

    Chunks are judged where they are; what is shuffled is a number a chunk and state of the rules, never bytes. Null and empty chunks hold nothing.
    Rules that can't be matched in chunks (see ``automaton``) are an error, invalid ones are skipped.
    """
    rules = valid_rules(rules)[0]
    spark = chunks.sparkSession
    if not rules:
        return chunks.filter(F.lit(False)).select(key, F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("rule_id"))
    all_rules = Automata([automaton(r) for r in rules])
    held = spark.sparkContext.broadcast(all_rules)
    key_type = chunks.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        step = max(1, min(LANES, HELD // 4 // m.total))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                data = b.column(2).to_pylist()
                some = pa.array([i for i, x in enumerate(data) if x], pa.int64())
                to = m.effects([x for x in data if x])
                steps = pa.ListArray.from_arrays(pa.array(np.arange(len(to) + 1, dtype=np.int32) * np.int32(m.total)), pa.array(to.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some), steps], ["_key", "_at", "_to"])

    known = spark.createDataFrame([(i, r[0], r[1], int(x)) for i, (r, x) in enumerate(zip(rules, all_rules.last, strict=True))], "_rule int, ordinal int, rule_id string, _last int")
    found = chunks.select(key, F.col("chunk_idx").cast("long"), F.col(chunk).cast("binary")).mapInArrow(judge, f"_key {key_type}, _at long, _to array<int>")
    files = found.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_at", "_to"))).alias("_steps"))  # a row a chunk of one file
    starts = F.array(*(F.lit(int(x)) for x in all_rules.first))
    states = F.aggregate("_steps", starts, lambda now, step: F.transform(now, lambda s: F.get(step["_to"], s)))
    ends = files.select("_key", F.posexplode(states).alias("_rule", "_state"))
    return ends.join(F.broadcast(known), "_rule").filter("_state = _last").select(F.col("_key").alias(key), "ordinal", "rule_id")
