"""Mapping freely typed values to a canonical list.

The entries and their alias paths (other order of the parts, one part alone, consonants only) are laid into
one trie. Typed values run through it as Levenshtein automata, bit-parallel ones whose states are the positions
reached with 0, 1, 2, 3 errors, with neighbouring letters that changed places as one error. All values of a batch
walk the trie together, one machine word for each value and number of errors, so a step costs a few array
operations whatever the number of values. Exact names, aliases and cut-off values (a path that ends inside the
trie with one entry below it) are found by the same walk, with 0 errors. How many errors are allowed depends on
the length. What fits no entry, or several equally well, means none.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The reference list goes to every task, so it must stay small; a longer list is refused.
MAX_ENTRIES = 100_000
#: Values that walk the trie together. Results don't depend on it.
WALK_VALUES = 50_000
#: Letters of a window that fit the machine word of the joint walk; longer ones walk one by one.
WORD_LETTERS = 62
#: Values up to which a step of the joint walk is dearer than one step for each.
FEW = 12
VOWELS = frozenset("aeiou")


@dataclass(frozen=True)
class Spelling:
    """What may be done to a name in writing.

    alone: the part (`first` or `last`) that may stand for an entry where no other entry has it; with `first` it
    may stand anywhere in the value. joining: words that may come or go. errors: letters from which on one more
    error is allowed. cut_letters: how far behind the first part a cut-off value must go on. alone_letters: how
    long a part that stands alone must be.
    """

    alone: str = "last"
    joining: frozenset[str] = frozenset({"and", "the"})
    errors: tuple[int, ...] = (5, 7, 14)
    cut_letters: int = 2
    alone_letters: int = 4

    def fold(self, text: str) -> list[str]:
        """Words of text in lower case, without accents and without joining words."""
        plain = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
        return [w for w in re.findall(r"[^\W_]+", plain) if w not in self.joining]

    def allowed_errors(self, length: int) -> int:
        return sum(length >= least for least in self.errors)


@dataclass
class _Node:
    children: dict[str, _Node] = field(default_factory=dict)
    entries: dict[str, set[int]] = field(default_factory=dict)  # by alias class
    below: set[int] = field(default_factory=set)  # entries whose full names pass here
    cut: int = 1 << 30  # letters of the longest first part among them
    shortest: int = 1 << 30  # lengths of the paths through here
    longest: int = 0


#: (alias class, errors, entries); a cut-off value is of class `cut`.
Hit = tuple[str, int, frozenset[int]]


class CanonTrie:
    """The trie of one kind of entries. An alias class is `full`, `alone` or `bare` (consonants only)."""

    def __init__(self, entries: list[tuple[int, str]], spelling: Spelling | str = Spelling()) -> None:
        self.spelling = Spelling(spelling) if isinstance(spelling, str) else spelling
        self.root = _Node()
        self.letters: dict[int, Counter[str]] = {}
        self.longest = 0
        singles: dict[str, set[int]] = {}
        for number, name in entries:
            joined = ["".join(p) for p in self._parts(name)]
            self.letters[number] = Counter("".join(joined))
            self._add("".join(joined), "full", number, len(joined[0]))
            if len(joined) > 1:
                self._add("".join(joined[1:] + joined[:1]), "full", number, len("".join(joined[1:])))
                bare = "".join(c for c in joined[0] if c not in VOWELS)
                if len(bare) > 2:
                    self._add(bare + "".join(joined[1:]), "bare", number)
                singles.setdefault(joined[0] if self.spelling.alone == "first" else "".join(joined[1:]), set()).add(number)
        for word, numbers in singles.items():
            if len(word) >= self.spelling.alone_letters:
                for number in numbers:
                    self._add(word, "alone", number)

    def _parts(self, name: str) -> list[list[str]]:
        sides = [self.spelling.fold(s) for s in re.split(r"[/>|\\]", name)]
        sides = [s for s in sides if s]
        if len(sides) == 1:
            words = sides[0]
            return [words[:1], words[1:]] if len(words) > 1 else [words]
        return [sides[0], [w for s in sides[1:] for w in s]] if sides else [[""]]

    def _add(self, path: str, kind: str, number: int, first: int | None = None) -> None:
        self.longest = max(self.longest, len(path))
        node = self.root
        for c in path:
            node = node.children.setdefault(c, _Node())
            node.shortest, node.longest = min(node.shortest, len(path)), max(node.longest, len(path))
            if kind == "full":
                node.below.add(number)
                node.cut = min(node.cut, first)
        node.entries.setdefault(kind, set()).add(number)

    def _letters_apart(self, text: str, number: int) -> int:
        a, b = Counter(text), self.letters[number]
        return sum(((a - b) + (b - a)).values())

    def _met(self, node: _Node, depth: int) -> Iterator[tuple[str, frozenset[int]]]:
        """What a value that ends at node without errors may be besides its entries."""
        if depth >= node.cut + self.spelling.cut_letters:
            yield "cut", frozenset(node.below)

    def _descend(self, masks: dict[str, int], size: int, errors: int, stack: list[tuple]) -> list[Hit]:
        """What one text of that size meets below the nodes of stack: (node, depth, states by errors, swaps by errors)."""
        goal, found = 1 << size, []
        whole = (goal << 1) - 1
        while stack:
            node, depth, reached, swapping = stack.pop()
            for c, child in node.children.items():
                m = masks.get(c, 0)
                now, swap, last = [], [0], 0
                for e in range(errors + 1):
                    r = (reached[e] & m) << 1
                    if e:
                        r |= reached[e - 1] | reached[e - 1] << 1 | last << 1 | (swapping[e] & m) << 2
                        swap.append(reached[e - 1] & m >> 1)
                    last = r & whole
                    now.append(last)
                if last & goal:
                    d = next(e for e in range(errors + 1) if now[e] & goal)
                    found += [(kind, d, frozenset(numbers)) for kind, numbers in child.entries.items()]
                    if not d:
                        found += [(kind, 0, numbers) for kind, numbers in self._met(child, depth + 1)]
                if (last or swap[-1]) and (child.shortest <= size + errors and size - errors <= child.longest or now[0]):
                    stack.append((child, depth + 1, now, swap))
        return found

    def walk_one(self, text: str, errors: int) -> list[Hit]:
        """All paths within errors of text, and what it is cut off from; a machine word of any length."""
        masks: dict[str, int] = {}
        for i, c in enumerate(text):
            masks[c] = masks.get(c, 0) | 1 << i
        whole = (1 << len(text) + 1) - 1
        return self._descend(masks, len(text), errors, [(self.root, 0, [((1 << (e + 1)) - 1) & whole for e in range(errors + 1)], [0] * (errors + 1))])

    def walk(self, texts: list[str]) -> list[list[Hit]]:
        """walk_one() for many texts, each with the errors its length allows; the trie is walked once for each number of errors."""
        found: list[list[Hit]] = [[] for _ in texts]
        groups: dict[int, list[int]] = defaultdict(list)
        for i, text in enumerate(texts):
            errors = self.spelling.allowed_errors(len(text))
            if len(text) > WORD_LETTERS:
                found[i] = self.walk_one(text, errors) if len(text) <= self.longest + errors else []
            elif text:
                groups[errors].append(i)
        for errors, members in groups.items():
            self._walk_group([texts[i] for i in members], np.array(members), errors, found)
        return found

    def _walk_group(self, texts: list[str], places: np.ndarray, errors: int, found: list[list[Hit]]) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), sizes)
        spot = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        one = np.uint64(1)
        bit = one << spot.astype(np.uint64)
        masks: dict[str, np.ndarray] = {}
        for code in np.unique(codes).tolist():
            here = codes == code
            masks[chr(code)] = mask = np.zeros(len(texts), np.uint64)
            np.bitwise_or.at(mask, owner[here], bit[here])
        nothing = np.zeros(len(texts), np.uint64)
        goals = one << sizes.astype(np.uint64)
        wholes = (goals << one) - one
        two = np.uint64(2)
        start = [np.full(len(texts), (1 << (e + 1)) - 1, np.uint64) & wholes for e in range(errors + 1)]
        alone: dict[int, dict[str, int]] = {}
        stack = [(self.root, 0, np.arange(len(texts)), start, [nothing] * (errors + 1))]
        while stack:
            node, depth, own, reached, swapping = stack.pop()
            goal, whole, size = goals[own], wholes[own], sizes[own]
            for c, child in node.children.items():
                m = masks.get(c, nothing)[own]
                now, swap = [(reached[0] & m) << one & whole], [nothing[:1]]
                for e in range(1, errors + 1):
                    before = reached[e - 1]
                    r = (reached[e] & m) << one | before | before << one | now[-1] << one | (swapping[e] & m) << two
                    now.append(r & whole)
                    swap.append(before & m >> one)
                if child.entries:
                    left = np.ones(len(own), bool)
                    for e in range(errors + 1):
                        hit = np.flatnonzero(left & (now[e] & goal != 0))
                        if len(hit):
                            left[hit] = False
                            for kind, numbers in child.entries.items():
                                note = (kind, e, frozenset(numbers))
                                for i in places[own[hit]].tolist():
                                    found[i].append(note)
                ended = np.flatnonzero(now[0] & goal)
                if len(ended):
                    for kind, numbers in self._met(child, depth + 1):
                        for i in places[own[ended]].tolist():
                            found[i].append((kind, 0, numbers))
                # On go the values that a path through here may still be near to in length, and those that may be cut off.
                alive = (now[-1] | swap[-1] if errors else now[0]) != 0
                alive &= (size + errors >= child.shortest) & (size - errors <= child.longest) | (now[0] != 0)
                on = np.flatnonzero(alive)
                if not child.children:
                    continue
                if len(on) <= FEW:  # where few are left each goes on alone
                    for k in on.tolist():
                        i = int(own[k])
                        letters = alone.setdefault(i, {})
                        if not letters:
                            letters.update((x, int(mask[i])) for x, mask in masks.items() if mask[i])
                        found[places[i]] += self._descend(letters, int(size[k]), errors, [(child, depth + 1, [int(r[k]) for r in now], [0, *(int(x[k]) for x in swap[1:])])])
                else:
                    stack.append((child, depth + 1, own[on], [r[on] for r in now], [nothing[:1], *(s[on] for s in swap[1:])]))

    def windows(self, words: list[str]) -> list[str]:
        """The value without its blanks first, then every run of its words that may be a name.

        A name may be typed run together or with blanks inside its words, so only its letters end a window.
        """
        out = ["".join(words)]
        for i in range(len(words)):
            part = ""
            for word in words[i:]:
                part += word
                if len(part) > self.longest + self.spelling.allowed_errors(len(part)):
                    break
                out.append(part)
        return list(dict.fromkeys(out))

    def decide(self, words: list[str], hits: dict[str, list[Hit]]) -> int:
        """The entry that a value of these words means, given what its windows met; 0 if it means none."""
        windows = self.windows(words)
        whole = windows[0]

        def one(candidates: Iterator[frozenset[int]]) -> int | None:
            every = set().union(*candidates)
            return None if not every else next(iter(every)) if len(every) == 1 else 0

        # The least distance over all windows; of entries equally far those with the most letters in common.
        full = [(d, w, numbers) for w in windows for kind, d, numbers in hits[w] if kind == "full"]
        if full:
            least = min(d for d, _, _ in full)
            apart: dict[int, int] = {}
            for d, w, numbers in full:
                for number in numbers if d == least else ():
                    far = self._letters_apart(w, number) if d else 0
                    apart[number] = min(far, apart.get(number, far))
            return one([{n for n, far in apart.items() if far == min(apart.values())}])
        for kind, asked in (("cut", windows), ("bare", windows), ("alone", [whole, *words] if self.spelling.alone == "first" else [whole])):
            answer = one(numbers for w in asked for k, d, numbers in hits.get(w, ()) if k == kind and not d)
            if answer is not None:
                return answer
        for least in range(1, self.spelling.allowed_errors(len(whole)) + 1):
            answer = one(numbers for k, d, numbers in hits[whole] if k == "alone" and d == least)
            if answer is not None:
                return answer
        return 0

    def find_all(self, values: list[str | None]) -> list[int | None]:
        """The entry each value means; 0 if it means none; None if there is no value (null, blank)."""
        split = [None if v is None or not v.strip() else tuple(self.spelling.fold(v)) for v in values]
        known: dict[tuple[str, ...] | None, int | None] = {None: None, (): 0}
        distinct = [w for w in dict.fromkeys(split) if w]
        texts = list(dict.fromkeys(w for words in distinct for w in self.windows(list(words))))
        hits = dict(zip(texts, self.walk(texts)))
        for words in distinct:
            known[words] = self.decide(list(words), hits)
        return [known[words] for words in split]

    def find(self, value: str | None) -> int | None:
        return self.find_all([value])[0]


def map_values(values: DataFrame, canon: DataFrame, kind: str, value_col: str, id_col: str, spelling: Spelling = Spelling(), max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(row_id, canon_id) for each row of values whose value is not null or blank; canon_id 0 means none.

    Rows that repeat stay repeated, extra columns are ignored, an empty table of values gives no rows, an
    empty list of entries maps all values to 0. Values are read whole. Each distinct value is searched once,
    after an aggregate with map-side partials, and joined back to its rows; AQE splits the rows of a value that
    fills a third of the table. The list, of at most max_entries rows, travels to the workers.
    """
    spark = values.sparkSession
    entries = [(r[0], r[1]) for r in canon.filter(F.col("kind") == kind).filter(F.col("name").isNotNull()).select("canon_id", "name").limit(max_entries + 1).collect()]
    if len(entries) > max_entries:
        raise ValueError(f"more than {max_entries} entries; map against a shorter list or raise max_entries")
    schema = T.StructType([T.StructField("_value", T.StringType()), T.StructField("canon_id", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = CanonTrie(entries, spelling)
        held: list[str] = []

        def searched() -> pa.RecordBatch:
            found = [(v, n) for v, n in zip(held, trie.find_all(held)) if n is not None]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.string()), pa.array([n for _, n in found], pa.int32())], names=schema.names)

        for batch in batches:
            held += batch.column(0).to_pylist()
            if len(held) >= WALK_VALUES:
                yield searched()
        yield searched()

    rows = values.select(F.col(id_col).cast("long").alias("row_id"), F.col(value_col).cast("string").alias("_value")).filter("_value is not null")
    # A quarter of the tasks the session shuffles into: the values are few bytes but much work, so AQE mustn't join
    # them up, but a task walks the trie once for all its values, so it should have many.
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    # By a hash of its own: a repartition by the value itself would be taken for the aggregate's and be joined up again.
    found = rows.select("_value").distinct().repartition(tasks, F.xxhash64("_value")).mapInArrow(run, schema)
    return rows.join(found, "_value").select("row_id", "canon_id")
