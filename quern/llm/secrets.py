"""Operator 6, secret scans by one combined deterministic automaton.

All rules are compiled together, whatever they are: a Thompson NFA over bytes of
`.*(rule1|rule2|...)`, each rule reversed, made deterministic by subset construction and minimised by
partition refinement, as transition arrays over byte classes. One pass over a text's bytes from its
end tells at which places a match of which rules begins. A second automaton of all rules, forward
and anchored, runs from such places alone and gives the longest match from each; matches of a kind
are leftmost and do not overlap.
"""

from __future__ import annotations

from functools import cached_property
from re import _constants as K
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, pieces, table, texts_of


def _either_case(words: list[str]) -> str:
    return "|".join("".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in w) for w in words)


#: Rules by kind, in the order of output. The first three are the base. Minimum lengths that could
#: change what a leftmost match covers are checked after matching, by CHECKS; so are those of which
#: a part in the rule is enough to make places rare, since counting on would multiply states.
RULES: dict[str, str] = {
    "assign": f"(?:{_either_case(['password', 'passwd', 'secret', 'token', 'api_?key'])})[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{8,}",
    # On to the END line, or without one over the lines of base64 that follow.
    "pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:-{0,4}[^-])*-----END [A-Z ]*PRIVATE KEY-----|(?:\\r?\\n[A-Za-z0-9+/=]{20,})+(?:\\r?\\n[A-Za-z0-9+/]+={1,2})?)?",
    "forge": "gh[opsu]_[A-Za-z0-9]+",
    "jwt": "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+",
    "chat": "xox[abprs]-[A-Za-z0-9-]+",
}
BASE = ("assign", "access", "hex")


def _assigned(match: bytes) -> bool:
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[at + 1 :].lstrip(b" ")
    return len(value[1:] if value[:1] in (b'"', b"'") else value) >= 6


CHECKS = {"assign": _assigned, "access": lambda m: len(m) >= 20, "hex": lambda m: len(m) >= 24, "forge": lambda m: len(m) >= 40, "chat": lambda m: len(m) >= 15}

class Nfa:
    """Thompson construction; byte edges and empty edges by state."""

    def __init__(self):
        self.byte: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.byte.append([])
        self.empty.append([])
        return len(self.byte) - 1

    def add(self, tree, at: int, reverse: bool) -> int:
        """Adds a parsed pattern from state `at`; the state behind it."""
        for op, arg in reversed(list(tree)) if reverse else tree:
            at = self.one(op, arg, at, reverse)
        return at

    def one(self, op, arg, at: int, reverse: bool) -> int:
        if op in (K.LITERAL, K.NOT_LITERAL, K.IN, K.ANY):
            end = self.state()
            self.byte[at].append((_bytes(op, arg), end))
            return end
        if op is K.SUBPATTERN:
            return self.add(arg[-1], at, reverse)
        if op is K.BRANCH:
            end = self.state()
            for x in arg[1]:
                self.empty[self.add(x, self._from(at), reverse)].append(end)
            return end
        if op is K.MAX_REPEAT:
            low, high, tree = arg
            for _ in range(low):
                at = self.add(tree, at, reverse)
            if high is K.MAXREPEAT:
                loop, end = self._from(at), self.state()
                self.empty[self.add(tree, loop, reverse)].append(loop)
                self.empty[loop].append(end)
                return end
            end = self.state()
            self.empty[at].append(end)
            for _ in range(high - low):
                at = self.add(tree, at, reverse)
                self.empty[at].append(end)
            return end
        raise ValueError(f"{op} is not a regular operator that this compiler takes")

    def _from(self, at: int) -> int:
        new = self.state()
        self.empty[at].append(new)
        return new


def _bytes(op, arg) -> frozenset:
    every = frozenset(range(256))
    if op is K.LITERAL:
        return frozenset((arg,))
    if op is K.NOT_LITERAL:
        return every - {arg}
    if op is K.ANY:
        return every - {10}
    got, negate = set(), False
    for o, a in arg:
        if o is K.NEGATE:
            negate = True
        elif o is K.LITERAL:
            got.add(a)
        elif o is K.RANGE:
            got.update(range(a[0], a[1] + 1))
        else:
            raise ValueError(f"{o} in a set")
    return every - got if negate else frozenset(got)


class Dfa:
    """Minimal deterministic automaton of rules: state s goes to rows[s][classes[byte]]; `accept[s]` are the rules that end in it."""

    def __init__(self, rules: dict[str, str], anywhere: bool = False, reverse: bool = False):
        nfa, ends = Nfa(), {}
        start = nfa.state()
        for name, pattern in rules.items():
            ends[nfa.add(parser.parse(pattern), nfa._from(start), reverse)] = name
        ordered = sorted({s for edges in nfa.byte for s, _ in edges}, key=sorted)
        group: dict[tuple, int] = {}
        self.classes = bytes(group.setdefault(tuple(b in s for s in ordered), len(group)) for b in range(256))
        first = [self.classes.index(c) for c in range(len(group))]

        def closed(state: int) -> int:
            """What empty edges reach, as bits."""
            todo, got = [state], 1 << state
            while todo:
                for x in nfa.empty[todo.pop()]:
                    if not got >> x & 1:
                        got |= 1 << x
                        todo.append(x)
            return got

        reach = [closed(s) for s in range(len(nfa.byte))]
        edges = {s: [([c for c, b in enumerate(first) if b in on], reach[t]) for on, t in e] for s, e in enumerate(nfa.byte) if e}
        busy = sum(1 << s for s in edges)
        number, todo, step = {reach[start]: 0}, [reach[start]], []
        for now in todo:  # subset construction
            row = [reach[start] if anywhere else 0] * len(first)
            left = now & busy
            while left:
                bit = left & -left
                left ^= bit
                for on, to in edges[bit.bit_length() - 1]:
                    for c in on:
                        row[c] |= to
            for to in row:
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
            step.append([number[to] for to in row])
        label = [frozenset(name for s, name in ends.items() if x >> s & 1) for x in todo]
        # A state from which nothing more can end is dead, and merges with others of its kind below.
        part = {x: i for i, x in enumerate(dict.fromkeys(label))}
        block, table, kinds = np.array([part[x] for x in label]), np.array(step), 0
        while kinds < (kinds := int(block.max()) + 1):  # partition refinement
            seen: dict[bytes, int] = {}
            block = np.array([seen.setdefault(row.tobytes(), len(seen)) for row in np.column_stack([block, block[table]]).astype(np.int32)])
        _, one = np.unique(block, return_index=True)
        self.accept = [label[s] for s in one]
        self.rows = block[table[one]].tolist()
        self.start = int(block[0])
        self.dead = {i for i, row in enumerate(self.rows) if not self.accept[i] and all(t == i for t in row)}

    @cached_property
    def linked(self) -> list[list]:
        """The same table as rows that hold rows, each with its own accepted rules last: one index a byte."""
        linked: list[list] = [[] for _ in self.rows]
        for i, row in enumerate(self.rows):
            linked[i].extend([*(linked[t] for t in row), self.accept[i]])
        return linked

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "linked"}

    def marks(self, data: bytes) -> list[tuple[int, frozenset]]:
        """Offsets after which some match ends, with its rules: the one pass over all bytes."""
        state, at = self.linked[self.start], []
        for i, c in enumerate(data.translate(self.classes), 1):
            state = state[c]
            if state[-1]:
                at.append((i, state[-1]))
        return at

    def longest(self, data: bytes, start: int, kind: str) -> int:
        """The end of the longest match of a rule from start, or -1."""
        state, end = self.start, -1
        for i in range(start, len(data)):
            state = self.rows[state][self.classes[data[i]]]
            if kind in self.accept[state]:
                end = i + 1
            elif state in self.dead:
                break
        return end


class Scanner:
    """Spans of any rules in the syntax that Nfa takes; a rule that matches the empty text is refused."""

    def __init__(self, rules: dict[str, str] = RULES, checks: dict = CHECKS):
        self.kinds, self.checks = list(rules), checks
        self.backward, self.forward = Dfa(rules, anywhere=True, reverse=True), Dfa(rules)
        if self.forward.accept[self.forward.start]:
            raise ValueError(f"rules that match the empty text: {sorted(self.forward.accept[self.forward.start])}")

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points, by start and then in the order of the rules."""
        data = text.encode("utf-8", "surrogatepass")
        found, end = [], dict.fromkeys(self.kinds, 0)
        for i, kinds in reversed(self.backward.marks(data[::-1])):
            at = len(data) - i
            for kind in kinds:
                if at >= end[kind]:
                    end[kind] = self.forward.longest(data, at, kind)
                    check = self.checks.get(kind)
                    if not check or check(data[at : end[kind]]):
                        found.append((at, end[kind], kind))
        found.sort(key=lambda x: (x[0], self.kinds.index(x[2])))
        if len(data) != len(text):
            place, at, chars = {}, 0, 0
            for x in sorted({x for a, b, _ in found for x in (a, b)}):  # one pass, however many spans
                chars += len(data[at:x].decode("utf-8", "surrogatepass"))
                place[x] = chars
                at = x
            found = [(place[a], place[b], k) for a, b, k in found]
        return found


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): spans an array of (start, end, kind). Null is the empty text; repeated rows
    each return a row; an empty table returns none; extra columns are left out."""
    kind, scanner = dict(docs.dtypes)["doc_id"], Scanner()

    def make():
        return lambda b: {"doc_id": b.column("doc_id"), "spans": [[{"start": s, "end": e, "kind": k} for s, e, k in scanner.spans(t)] for t in texts_of(b)]}

    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, spans array<struct<start:long,end:long,kind:string>>", "text", make)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    say = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    base = F.filter("spans", lambda x: x.kind.isin(*BASE))
    of = lambda kind: F.filter("spans", lambda x: x.kind == kind)
    n = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *n, F.sha2(say(base).cast("binary"), 256).alias("base_sha256"), say("spans").alias("spans"))


def hidden(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each stretch that spans cover replaced by a mark of the first kind there."""
    out, end = [], 0
    for start, stop, kind in spans:
        if start >= end:
            out += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets in `text` replaced by marks; n_chars, if there, follows. Other columns stay, whatever
    their names, and so do null and empty texts; repeated rows each return a row, an empty table none."""
    scanner = Scanner()

    def run(batches):
        for batch in pieces(batches, "text"):
            texts = batch.column("text").to_pylist()
            spans = [scanner.spans(t) if t else [] for t in texts]
            new = [hidden(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            cols["text"] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(new, spans, cols["n_chars"].to_pylist(), strict=True)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
