"""Secrets by pattern, and by grammars learnt from the secrets the patterns find.

The values behind the base patterns are labelled credentials, one language per
kind. All distinct values of a kind become a prefix tree over classes of characters, counted
by Spark: its states of enough support a few depths at a time, then all values along them. Where fewer than SUPPORT values share a prefix,
frequencies say nothing, so such states of one depth are one state: lengths and fixed
beginnings survive however random the rest is. From the root on, states of enough
support are then merged when their outgoing frequencies, and those of the
states behind them, are statistically compatible (Hoeffding bound). What is left is a
probabilistic automaton per kind.

Everything else of SHORTEST or more characters of the credential alphabet is scored: whole
tokens, and their parts that begin after a '=', '/' or '.' and end before or behind a
later one; base spans cut tokens. The score is the log2 likelihood under the
automaton, the end of the string included, above that under the letters of ordinary tokens
of the corpus (classes of characters and lengths). A part becomes a span of kind
``format`` when its score reaches the automaton's threshold: MIN_BITS, or the score
that all but a ``quantile`` of the training values reach, if that is more. Of the parts of a
token those without overlap are taken whose scores above the threshold add up to the most (of
equal sums the one found first from the left). One pass finds them, with one best
beginning per state of an automaton, so a token takes time by its length. A kind of fewer than
MIN_VALUES values adds nothing.

The fit takes all distinct values and all distinct ordinary tokens, whatever their length. Depths are told apart
up to ``depth``; what values have beyond is one state that leads to itself. The driver and the tasks hold the tree: at most a state for
SUPPORT characters of the values, and one a depth. Patterns, candidates and
scores cover all texts. Null and empty texts have no spans. Repeated rows are
judged each by itself. Without base matches no automaton is learnt and nothing
is added. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm import words as W
from alertloom.llm.batches import bounded
from alertloom.session import cut_lineage, own_tables

KINDS = ("assign", "access", "hex", "format")
#: depth to which places of a value are told apart, depths of the tree that are counted at a time
DEPTH, STEP = 256, 8
ALPHA = 0.05
QUANTILE = 0.02
#: values that must share a state before its frequencies are compared, values a kind needs, least score of a span
SUPPORT, MIN_VALUES, MIN_BITS = 30, 30, 12.0
_NEVER = float("-inf")
#: what a part counts besides its excess, so that one of excess 0 is taken too
_PLACE = 1e-6
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_PART = re.compile("[=/.]")
SHORTEST = 6
#: scores of values a worker remembers before it starts anew, and their longest
REMEMBERED, LONGEST = 300_000, 64
_HINTS = ("passw", "secret", "token", "api")


def base_matches(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, credential) of the base patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(0, m.start(), m.end(), m.group(1)) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m.group()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end(), m.group()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """(start, end) of the tokens, and of what base spans leave of them."""
    out, i, open_ = [], 0, []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while i < len(base) and base[i][1] < b:
            open_.append(base[i][1:3])
            i += 1
        open_ = [span for span in open_ if span[1] > a]
        for low, high in open_:
            if low - a >= SHORTEST:
                out.append((a, low))
            a = max(a, min(high, b))
        if b - a >= SHORTEST:
            out.append((a, b))
    return out


def symbol(c: str) -> str:
    """The class of a character: digits, hex letters, other small letters, capitals; others stand for themselves."""
    return "0" if "0" <= c <= "9" else "a" if "a" <= c <= "f" else "g" if "g" <= c <= "z" else "A" if "A" <= c <= "Z" else c


_CLASS_BITS = {"0": math.log2(10), "a": math.log2(6), "g": math.log2(20), "A": math.log2(26)}


def _symbols(value: str) -> str:
    return "".join(map(symbol, value))


def _class_counts(tokens) -> Counter:
    counts: Counter = Counter()
    for token in tokens:
        counts.update(_symbols(token))
        counts[""] += 1
    return counts


def _prefixes(words, low: int, high: int, known: set[str]) -> Counter:
    """How many of the weighted words begin with each prefix of ``low + 1`` to ``high`` classes behind a known one of ``low``."""
    counts: Counter = Counter()
    for word, n in words:
        if len(word) > low and word[:low] in known:
            for size in range(low + 1, min(high, len(word)) + 1):
                counts[word[:size]] += n
    return counts


def _paths(words, known: set[str], depth: int) -> Counter:
    """Uses of (state, class) by the weighted words, class "" for an end.

    A state is "=" and its prefix where that is known, else "#" and its depth, one for all beyond ``depth``.
    """
    counts: Counter = Counter()
    for word, n in words:
        alone = True
        for at in range(len(word) + 1):
            alone = alone and (not at or word[:at] in known)
            counts["=" + word[:at] if alone else f"#{min(at, depth + 1)}", word[at:at + 1]] += n
    return counts


class Ordinary:
    """Characters and ends of ordinary tokens, each character by itself."""

    def __init__(self, tokens: list[str]):
        self._weigh(_class_counts(tokens))

    @classmethod
    def counted(cls, counts: dict[str, int]) -> Ordinary:
        """Of the counts of classes, and of tokens under the empty one."""
        out = cls.__new__(cls)
        out._weigh(counts)
        return out

    def _weigh(self, counts: dict[str, int]) -> None:
        tokens = counts.get("", 0)
        total = sum(counts.values()) + 8  # an unseen class counts as one of eight
        self.bits = {c: math.log2(n / total) for c, n in counts.items() if c}
        self.unseen, self.end = math.log2(1 / total), math.log2((tokens + 1) / total)

    def of(self, c: str) -> float:
        return self.bits.get(c, self.unseen)


class Automaton:
    """A probabilistic automaton inferred from words by merging compatible prefix-tree states."""

    def __init__(self, values: list[str], alpha: float = ALPHA, support: int = SUPPORT, ordinary: Ordinary | None = None):
        words, known, low = Counter(map(_symbols, values)), {""}, 0
        while known_here := {w for w in known if len(w) == low and low < DEPTH}:
            known |= {w for w, n in _prefixes(words.items(), low, min(low + STEP, DEPTH), known_here).items() if n >= support}
            low += STEP
        self._infer(_paths(words.items(), known, DEPTH), known, DEPTH, alpha, support, ordinary)
        self.limit(sorted(map(self.score, values)))

    @classmethod
    def counted(cls, paths: dict[tuple[str, str], int], known: set[str], depth: int, alpha: float, ordinary: Ordinary) -> Automaton:
        """Of the counts of ``_paths``; the threshold is not set."""
        out = cls.__new__(cls)
        out._infer(paths, known, depth, alpha, SUPPORT, ordinary)
        return out

    def limit(self, scores: list[float]) -> None:
        """Sets the threshold by the sorted scores of the values, or by the one at their quantile."""
        self.threshold = max(MIN_BITS, scores[int(QUANTILE * (len(scores) - 1))]) if scores else math.inf

    def _infer(self, paths: dict[tuple[str, str], int], known: set[str], depth: int, alpha: float, support: int, ordinary: Ordinary | None) -> None:
        self.count, self.final, self.next = [], [], []  # by state; next: class of character -> [state, count]
        self.support, self.bound = support, math.sqrt(0.5 * math.log(2 / alpha))
        self._tree(paths, known, depth)
        self.same = list(range(len(self.count)))
        self._merge_states()
        ordinary = ordinary or Ordinary([])
        #: class of character -> (state, score), and the score of ending, by state; scores are those above ordinary tokens
        self.step = [{c: (self._find(t), math.log2(n / self.count[q]) - ordinary.of(c)) for c, (t, n) in self.next[q].items()} if self._find(q) == q else {}
                     for q in range(len(self.count))]
        self.end = [math.log2(f / n) - ordinary.end if f else _NEVER for f, n in zip(self.final, self.count, strict=True)]

    def _state(self) -> int:
        self.count.append(0)
        self.final.append(0)
        self.next.append({})
        return len(self.count) - 1

    def _tree(self, paths: dict[tuple[str, str], int], known: set[str], depth: int) -> None:
        """The prefix tree, its states of little support joined by depth."""
        uses: dict[str, list[tuple[str, int]]] = {}
        for (name, c), n in paths.items():
            uses.setdefault(name, []).append((c, n))
        level, at, last = [("=", self._state())], 0, f"#{depth + 1}"
        while level:
            below, joined = [], None
            for name, state in level:
                for c, n in sorted(uses.get(name, ())):
                    self.count[state] += n
                    if not c:
                        self.final[state] = n
                        continue
                    if name == last:
                        target = state
                    elif name[0] == "=" and name[1:] + c in known:
                        target = self._state()
                        below.append((name + c, target))
                    else:
                        joined = target = self._state() if joined is None else joined
                    self.next[state][c] = [target, n]
            if joined is not None:
                below.append((f"#{at + 1}", joined))
            level, at = below, at + 1

    def _find(self, state: int) -> int:
        while self.same[state] != state:
            self.same[state] = self.same[self.same[state]]
            state = self.same[state]
        return state

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (n1 ** -0.5 + n2 ** -0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = (self._find(x) for x in todo.pop())
            if a == b or (a, b) in seen or min(self.count[a], self.count[b]) < self.support:
                continue
            seen.add((a, b))
            if self._differ(self.final[a], self.count[a], self.final[b], self.count[b]):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differ(x[1] if x else 0, self.count[a], y[1] if y else 0, self.count[b]):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, into: int, other: int) -> None:
        """Makes two states one, and with them the states that the same characters lead to."""
        todo = [(into, other)]
        while todo:
            a, b = (self._find(x) for x in todo.pop())
            if a == b:
                continue
            self.same[b] = a
            self.count[a] += self.count[b]
            self.final[a] += self.final[b]
            for c, (target, n) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][1] += n
                    todo.append((self.next[a][c][0], target))
                else:
                    self.next[a][c] = [target, n]

    def _merge_states(self) -> None:
        kept = [0]
        while True:
            kept = list(dict.fromkeys(map(self._find, kept)))
            inside = set(kept)
            border = {self._find(target) for s in kept for target, _ in self.next[s].values()} - inside
            if not border:
                break
            new = max(border, key=lambda q: (self.count[q], -q))  # the best known state first
            old = next((q for q in kept if self._compatible(q, new)), None) if self.count[new] >= self.support else None
            if old is None:
                kept.append(new)
            else:
                self._fold(old, new)
        self.states = len(kept)

    def score(self, value: str) -> float:
        """log2 likelihood above that of ordinary characters, the end included."""
        state, total = 0, 0.0
        for c in map(symbol, value):
            edge = self.step[state].get(c)
            if edge is None:
                return _NEVER
            state, gain = edge
            total += gain
        return total + self.end[state]

    def excess(self, value: str) -> float:
        return self.score(value) - self.threshold


class Scorer:
    """Finds the parts of tokens that an automaton knows; keeps the scores of the values it has seen."""

    def __init__(self, automata: dict[str, Automaton]):
        self.automata, self.seen = automata, {}

    def best(self, value: str) -> tuple[float, str]:
        found = self.seen.get(value)
        if found is None:
            found = max(((a.excess(value), name) for name, a in self.automata.items()), default=(-1.0, ""))
            if len(value) <= LONGEST:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[value] = found
        return found

    def parts(self, value: str, cuts: list[int]) -> list[tuple[int, int, str, float]]:
        """(start, end, format, excess) of the parts without overlap whose excesses add up to the most.

        ``total`` is the best sum up to a place, ``link`` how it is reached. Of the
        beginnings that are in one state of an automaton only the best sum can
        still win, whatever follows; they compete from SHORTEST characters on.
        """
        classes, n = _symbols(value), len(value)
        starts, stops = {0, *(c + 1 for c in cuts)}, {*cuts, *(c + 1 for c in cuts), n}
        known = list(self.automata.items())
        total, link = 0.0, None
        live: list[dict[int, tuple]] = [{} for _ in known]  # state -> (sum, sum at the beginning, beginning, link there)
        waiting: dict[int, list[tuple]] = {}
        for at in range(n + 1):
            for k, state, score, start, before, way in waiting.pop(at, ()):
                if state not in live[k] or live[k][state][0] < before + score:
                    live[k][state] = (before + score, before, start, way)
            if at in stops:
                for (name, a), states in zip(known, live, strict=True):
                    for state, (x, before, start, way) in states.items():
                        over = x - before + a.end[state] - a.threshold
                        if over >= 0 and before + over + _PLACE > total:
                            total, link = before + over + _PLACE, (start, at, name, over, way)
            if at in starts and at + SHORTEST <= n:
                for k, (_, a) in enumerate(known):
                    state, score = 0, 0.0
                    for c in classes[at: at + SHORTEST]:
                        edge = a.step[state].get(c)
                        if edge is None:
                            break
                        state, score = edge[0], score + edge[1]
                    else:
                        waiting.setdefault(at + SHORTEST, []).append((k, state, score, at, total, link))
            if at < n:
                c = classes[at]
                for k, (_, a) in enumerate(known):
                    if live[k]:
                        moved: dict[int, tuple] = {}
                        for state, (x, before, start, way) in live[k].items():
                            edge = a.step[state].get(c)
                            if edge is not None and (edge[0] not in moved or moved[edge[0]][0] < x + edge[1]):
                                moved[edge[0]] = (x + edge[1], before, start, way)
                        live[k] = moved
        out = []
        while link:
            out.append(link[:4])
            link = link[4]
        return out[::-1]

    def spans(self, text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str, float]]:
        """(start, end, format, excess) of the format spans of a text."""
        out = []
        for a, b in candidates(text, base) if self.automata else ():
            value = text[a:b].rstrip(".")
            if len(value) < SHORTEST:
                continue
            cuts = [m.start() for m in _PART.finditer(value)]
            if cuts:
                out += [(a + x, a + y, name, over) for x, y, name, over in self.parts(value, cuts)]
                continue
            over, name = self.best(value)
            if over >= 0:
                out.append((a, b if b - a == len(value) else a + len(value), name, over))
        return out


_BASE = "array<struct<kind:string,start:int,end:int,value:string>>"


def _scan_rows(batches):
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    for rows, _, _ in W.slices(batches):
        base = [[{"kind": KINDS[k], "start": a, "end": b, "value": v} for k, a, b, v in base_matches(text)] if text else []
                for text in W.column(rows, "text").to_pylist()]
        yield pa.RecordBatch.from_arrays([W.column(rows, "doc_id"), pa.array(base, span)], names=["doc_id", "base"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base`` of every document."""
    rows = bounded(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scan_rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {_BASE}")


def _token_rows(batches):
    """The different tokens outside base spans, of each slice."""
    for rows, _, _ in W.slices(batches, limit=8 * W.SLICE):
        tokens: set[str] = set()
        for text in W.column(rows, "text").to_pylist():
            if text:
                base = base_matches(text)
                tokens.update([text[a:b] for a, b in candidates(text, base)] if base else _TOKEN.findall(text))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(tokens), pa.string())], names=["token"])


def _class_rows(batches):
    counts: Counter = Counter()
    for batch in batches:
        counts += _class_counts(batch.column(0).to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["c", "n"])


def _word_rows(batches):
    for batch in batches:
        words = [_symbols(v) for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string())], names=["kind", "word"])


def _by_kind(batch) -> dict[str, list[tuple[str, int]]]:
    found: dict[str, list[tuple[str, int]]] = {}
    for kind, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        found.setdefault(kind, []).append((word, n))
    return found


def _prefix_rows(known: dict[str, set[str]], low: int, high: int):
    def run(batches):
        for batch in batches:
            rows = [(kind, w, n) for kind, words in _by_kind(batch).items() for w, n in _prefixes(words, low, high, known.get(kind, set())).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "word", "n"])
    return run


def _path_rows(known: dict[str, set[str]], depth: int):
    def run(batches):
        for batch in batches:
            rows = [(kind, s, c, n) for kind, words in _by_kind(batch).items() for (s, c), n in _paths(words, known.get(kind, set()), depth).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))],
                                             names=["kind", "state", "c", "n"])
    return run


def _value_scores(automata):
    def run(batches):
        for batch in batches:
            scores = [automata.value[kind].score(word) for kind, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), batch.column(2)], names=["kind", "score", "n"])
    return run


def _at_place(scores: DataFrame, place: int) -> float:
    """The score that has place ``place`` in sorted order, from counts below 64 edges a round; scores (score, n)."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        edges = sorted({low + (high - low) * i / 64 for i in range(64)} | {low})
        below = scores.agg(*[F.sum(F.when(F.col("score") <= e, F.col("n")).otherwise(0)) for e in edges]).first()
        i = next((i for i, n in enumerate(below) if n > place), len(edges))
        inside = F.lit(True)
        if i:
            inside = inside & (F.col("score") > edges[i - 1])
        if i < len(edges):
            inside = inside & (F.col("score") <= edges[i])
        low, high = scores.where(inside & F.col("score").between(low, high)).agg(F.min("score"), F.max("score")).first()
    return low


def learn(rows: DataFrame, scanned: DataFrame, depth: int = DEPTH, alpha: float = ALPHA) -> dict[str, Automaton]:
    """An automaton per kind of credential of which enough values occur; ``rows`` hold the texts, ``scanned`` their base spans."""
    spark = rows.sparkSession
    values = scanned.select(F.explode("base").alias("b")).select("b.kind", "b.value").distinct()
    words = cut_lineage(values.mapInArrow(_word_rows, "kind string, word string").groupBy("kind", "word").agg(F.count("*").alias("n")), "words")
    sizes = {r["kind"]: r["n"] for r in words.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # three kinds
    labelled = [kind for kind in KINDS[:3] if sizes.get(kind, 0) >= MIN_VALUES]
    if not labelled:
        return {}
    words = words.where(F.col("kind").isin(labelled))
    known, low = {kind: {""} for kind in labelled}, 0
    while low < depth and any((known_here := {kind: {w for w in some if len(w) == low} for kind, some in known.items()}).values()):
        high = min(low + STEP, depth)
        counted = words.mapInArrow(_prefix_rows(known_here, low, high), "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))
        for r in counted.where(F.col("n") >= SUPPORT).select("kind", "word").toLocalIterator():
            known[r["kind"]].add(r["word"])
        low = high
    paths: dict[str, dict[tuple[str, str], int]] = {kind: {} for kind in labelled}
    walked = words.mapInArrow(_path_rows(known, depth), "kind string, state string, c string, n bigint")
    for r in walked.groupBy("kind", "state", "c").agg(F.sum("n").alias("n")).collect():
        paths[r["kind"]][r["state"], r["c"]] = r["n"]
    tokens = rows.select("text").where("text is not null").mapInArrow(_token_rows, "token string").distinct()
    classes = tokens.mapInArrow(_class_rows, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    ordinary = Ordinary.counted({r["c"]: r["n"] for r in classes.collect()})
    automata = {kind: Automaton.counted(paths[kind], known[kind], depth, alpha, ordinary) for kind in labelled}
    shared = spark.sparkContext.broadcast(automata)
    scores = cut_lineage(words.mapInArrow(_value_scores(shared), "kind string, score double, n bigint").groupBy("kind", "score").agg(F.sum("n").alias("n")), "scores")
    for kind, automaton in automata.items():
        automaton.limit([_at_place(scores.where(F.col("kind") == kind), int(QUANTILE * (sizes[kind] - 1)))])
    return automata


def _score_rows(automata):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("format", pa.string()), ("score", pa.float64())]))

    def run(batches):
        known = Scorer(automata.value)
        for rows, _, _ in W.slices(batches):
            out = []
            for text in W.column(rows, "text").to_pylist():
                base = base_matches(text) if text else []
                spans = [{"kind": KINDS[k], "start": a, "end": b, "format": KINDS[k], "score": None} for k, a, b, _ in base]
                spans += [{"kind": "format", "start": a, "end": b, "format": name, "score": float(over)} for a, b, name, over in (known.spans(text, base) if text else ())]
                out.append(sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([W.column(rows, "doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])
    return run


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """``doc_id, spans``: base and format spans by start, then kind; ``score`` is the likelihood above the threshold."""
    rows = bounded(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with own_tables(docs.sparkSession):
        scanned = cut_lineage(scan(rows).where(F.size("base") > 0), "secrets")
        known = learn(rows, scanned, depth)
    automata = docs.sparkSession.sparkContext.broadcast(known)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_score_rows(automata), f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,format:string,score:double>>")


def digest(found: DataFrame) -> DataFrame:
    """The result of ``find_secrets`` as counts, a hash of the base spans, and all spans as one string."""
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "format")), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
